"""One consistent form for text that looks alike but differs in its characters."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points with the Unicode property Default_Ignorable_Code_Point, and blanks other than U+0020.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
BLANKS = [(0x9, 0xD), (0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
CONTROLS = [(0x0, 0x8), (0xE, 0x1B), (0x7F, 0x84), (0x86, 0x9F)]
GREEK, CYRILLIC, LATIN = [(0x370, 0x3FF), (0x1F00, 0x1FFF)], [(0x400, 0x52F)], [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)]
# Letters that look alike, Latin beside the other script.
CYRILLIC_ALIKE = ("ABEKMHOPCTXYSIJaeopcxysijdqwhlv", "АВЕКМНОРСТХУЅІЈаеорсхуѕіјԁԛԝһӏѵ")
GREEK_ALIKE = ("ABEZHIKMNOPTYXovapikuxtyn", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναρικυχτγη")



def _class(*ranges: list) -> re.Pattern:
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for r in ranges for a, b in r) + "]")


_CUT, _SPACE, _CONTROL, _OTHER = _class(IGNORABLE), _class(BLANKS), _class(CONTROLS), _class(GREEK, CYRILLIC)
_WORD = re.compile(f"(?:[^\\W\\d_][{chr(0x300)}-{chr(0x36F)}]*)+")
_SCRIPTS = {"latin": _class(LATIN), "greek": _class(GREEK), "cyrillic": _class(CYRILLIC)}
_TO = {
    "latin": str.maketrans(CYRILLIC_ALIKE[1] + GREEK_ALIKE[1], CYRILLIC_ALIKE[0] + GREEK_ALIKE[0]),
    "greek": str.maketrans(GREEK_ALIKE[0], GREEK_ALIKE[1]),
    "cyrillic": str.maketrans(CYRILLIC_ALIKE[0], CYRILLIC_ALIKE[1]),
}
_ALIKE = {"latin": set(CYRILLIC_ALIKE[0] + GREEK_ALIKE[0]), "greek": set(GREEK_ALIKE[1]), "cyrillic": set(CYRILLIC_ALIKE[1])}


def _one_script(m: re.Match) -> str:
    word = m.group()
    letters = {s: r.findall(word) for s, r in _SCRIPTS.items()}
    present = [s for s in letters if letters[s]]
    if len(present) < 2:
        return word
    # the script with the most letters that no other script has; Latin where none has any
    own = {s: sum(c not in _ALIKE[s] for c in letters[s]) for s in present}
    best = max(present, key=lambda s: (own[s], s == "latin", len(letters[s])))
    return word.translate(_TO[best])


def one_form(text: str) -> str:
    """The one form: NFKC, no default-ignorable or control characters, U+0020 as the only space, one script a word.

    Other blanks become U+0020, but none is added at an end of the text. Case, Greek words and vowels with their marks stay.
    """
    before = _CONTROL.sub("", _CUT.sub("", text))
    out = _SPACE.sub(" ", _CUT.sub("", unicodedata.normalize("NFKC", _SPACE.sub(" ", before))))
    lead, tail = len(before) - len(before.lstrip(" ")), len(before) - len(before.rstrip(" "))
    bare = out.strip(" ")
    out = " " * lead + bare + " " * tail if bare else " " * before.count(" ")
    if _OTHER.search(out):
        out = unicodedata.normalize("NFC", _WORD.sub(_one_script, out))
    return out


def fold_key(text: str) -> str:
    """Key for caseless comparison: full case folding of the one form, composed again."""
    return unicodedata.normalize("NFKC", one_form(text).casefold())


def _vector(f):  # noqa: ANN001, ANN202
    def over(s: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(s)  # each distinct value of a batch once; null is code -1
        done = [f(x) for x in distinct]
        return pd.Series([done[c] if c >= 0 else None for c in codes], index=s.index, dtype=object)

    return over


def _apply(text: Column, f, plain: Column) -> Column:  # noqa: ANN001
    """`f` on the texts that need it; printable ASCII stays in the JVM and goes through `plain`."""
    udf = F.pandas_udf(_vector(f), "string")
    odd = text.rlike(r"[^\x20-\x7E]")
    return F.when(odd, udf(F.when(odd, text))).otherwise(plain)


def normalised(text: Column) -> Column:
    """The one form of a text column; null gives null, empty gives empty."""
    return _apply(text, one_form, text)


def comparison_key(text: Column) -> Column:
    """The case-folded one form of a text column."""
    return _apply(text, fold_key, F.lower(text))


def not_in_form(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is not in the one form; null and empty texts are in it."""
    return df.where(F.col(text).rlike(r"[^\x20-\x7E]")).where(normalised(F.col(text)) != F.col(text))
