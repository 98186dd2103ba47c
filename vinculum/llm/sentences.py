"""Sentence boundaries across languages and scripts, however the text is cut into units now.

Every character is tagged as boundary or inside by a linear chain, decoded with Viterbi. Characters that no boundary can
stand at (all but end marks, and blanks after Thai) have one tag only, so the chain runs over the others with the distance
between them as a feature of the transition. Its weights are learned by pseudo-likelihood on a bounded sample of the corpus
that `weak_kinds` labels by rules and by the abbreviations that the whole corpus shows; for a script whose sentences end at
blanks the chain is trained on text from which marks are stripped and in which unit ends are blanks like any other.

Documents are cut into chunks of units, each read with `REACH` characters to either side. What a chunk needs of the rest
of its document is small: which quotations are open, and the best scores of the chain up to it and from it on. Both are
carried over one summary row a chunk, so the tags are those of the document decoded as a whole, and no document is one task.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.llm.normalise import _CUT, one_form
from vinculum.runtime import cut

CHUNK = 400  # places of units
REACH = 64  # characters to either side that a feature may depend on
SAMPLE_UNITS = 20_000  # units that the chain is trained on, chosen by a hash of their chunk
SLOTS = 1 << 17
FAR = (2, 8, 24, REACH)  # borders of the distances between two places of the chain
SHORT, OFTEN, ALWAYS, MOST = 4, 5, 0.9, 10_000  # a learned abbreviation: letters, occurrences, share before a stop, how many

# Abbreviations, words that frame a quotation, Thai months and eras.
ABBREVIATIONS = set("a.d a.u.c kal non id f cos sc cf v vol p pp l ll ch chap fig no nos ca e.g i.e a.m p.m mr mrs ms dr st prof ed eds etc vs sex sp ti cn app ser tib usw z.b d.h nr bd s vgl jh bzw ca evtl hrsg aufl डॉ श्री د พ.ศ ค.ศ น.ส".split())
FRAMES = set("inquit inquam inquiunt ait aiunt asked said cried replied answered wrote fragte sagte rief antwortete dit demanda ἔφη ἔφασαν εἶπεν εἶπε قال قالت سأل سألت".split())
THAI_MONTHS = set("มกราคม กุมภาพันธ์ มีนาคม เมษายน พฤษภาคม มิถุนายน กรกฎาคม สิงหาคม กันยายน ตุลาคม พฤศจิกายน ธันวาคม ม.ค. ก.พ. มี.ค. เม.ย. พ.ค. มิ.ย. ก.ค. ส.ค. ก.ย. ต.ค. พ.ย. ธ.ค.".split())
CLOSERS, QUOTES, CJK_CLOSERS = "\"”’»)]}>」』》）】“", "\"”’»」』“", "」』》）】"

_MARK = re.compile(r"[.…]+|[?!？！؟;;。।॥።፧｡]+")
_MARK_OR_BLANK = re.compile(r"[.…]+|[?!？！؟;;。।॥።፧｡]+| +")
_NUMERAL = re.compile(r"[ivxlcdm]+")
_THAI = re.compile("[฀-๿]")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_WORD = re.compile(r"\S+")
_OPEN = "(\"“„«‘[{「『"

INSIDE, BOUNDARY = 0, 1
#: The weak label of each kind of context, for training alone.
LABEL = {
    "number": 0, "internal": 0, "abbreviation": 0, "initial": 0, "month": 0, "author": 0, "year": 0, "ordinal": 0, "omission": 0, "frame": 0, "in_quote": 0, "thai_date": 0,
    "stop": 1, "question": 1, "script_stop": 1, "trail": 1, "after_quote": 1, "thai_blank": 1,
}


def _thai_blank(s: str, i: int, j: int) -> str | None:
    """The kind of a blank s[i:j] after Thai."""
    last = s[i - 1] if i else ""
    if not (_THAI.match(last) or last in ".0123456789" and _THAI.search(s[max(0, i - 12) : i])):
        return None
    before, after = _WORD.findall(s[max(0, i - 24) : i]), _WORD.findall(s[j : j + 24])
    if not after:
        return None
    if last == "." or s[max(0, i - 4) : i] in ("พ.ศ.", "ค.ศ."):
        return "thai_date"
    if before and (any(before[-1].endswith(m) for m in THAI_MONTHS) and after[0][0].isdigit() or before[-1][-1:].isdigit() and any(after[0].startswith(m) for m in THAI_MONTHS)):
        return "thai_date"
    if after[0].startswith(("พ.ศ.", "ค.ศ.")) and before and any(before[-1].endswith(m) for m in THAI_MONTHS):
        return "thai_date"
    return "thai_blank"


def _closing(s: str, j: int, state: tuple, tokens: bool) -> int:
    """Where the closing quotes and brackets that follow an end mark end; state: of the quotations at the mark."""
    low, straight, k = state[2], state[3], j
    while k < len(s):
        n = k
        if tokens and s[n] == " ":
            n += 1
        elif s[n] == "\n" and n + 1 < len(s) and s[n + 1] in CJK_CLOSERS:
            n += 1
        if n >= len(s) or s[n] not in CLOSERS:
            break
        c = s[n]
        if c == "“":
            if not low:
                break
            low = 0
        if tokens and c == '"':
            if not straight:
                break
            straight = 0
        k = n + 1
    return k


def _stop_kind(s: str, i: int, since: str, known: frozenset) -> str:
    """The kind of a single full stop at s[i]."""
    before, after = s[i - 1] if i else " ", s[i + 1] if i + 1 < len(s) else " "
    if before.isdigit() and after.isdigit():
        return "number"
    if after.isalpha() and before.isalpha():
        return "internal"
    words = since.split()
    word = words[-1].lstrip(_OPEN).casefold() if words else ""
    prior = words[-2].lstrip(_OPEN).casefold() if len(words) > 1 else ""
    if word.isdigit():
        return "ordinal" if prior in ("im", "am", "vom", "zum", "des") else "stop"
    if prior == "a.u.c." and _NUMERAL.fullmatch(word):
        return "year"
    if word in ABBREVIATIONS or word in known or word.endswith(("พ.ศ", "ค.ศ")):
        return "abbreviation"
    if len(word) == 1 and word.isalpha() and not _GREEK.match(word):
        return "initial"
    if prior == "kal." and len(word) <= 4:
        return "month"
    follows = s[i + 1 : i + 12].lstrip()
    if prior == "cf." and follows[:1].isdigit():
        return "author"
    return "stop"


def _dots_kind(s: str, i: int, j: int, since: str, cased: bool) -> str:
    if i and s[i - 1] in "([":
        return "omission"
    if i and _CJK.match(s[i - 1]):
        return "omission"
    words = since.split()
    if len(words) <= 1 or len(words) == 2 and words[0].casefold() in ("the", "der", "die", "das", "a"):
        return "omission"
    after = s[j : j + 40].split()
    if cased and after and after[0][:1].islower() and not after[0].casefold().startswith("a.d"):
        return "omission"
    return "trail"


def _quoted_kind(s: str, i: int, j: int, k: int, since: str, cased: bool) -> str | None:
    """The kind of an end mark s[i:j] whose closers end at k, as to the quotation it stands in; None: no matter."""
    closers = [c for c in s[j:k] if c in QUOTES]
    if not closers:
        # inside a quotation of a script without blanks, a mark that the quotation goes on after
        if since.count("「") > since.count("」") or since.count("『") > since.count("』"):
            return "in_quote"
        return None
    rest = s[k : k + 60].strip()
    if not rest:
        return "after_quote"
    if closers[-1] in "」』":
        at = max(since.rfind("「"), since.rfind("『"))
        if at > 0 and since[at - 1] in "：:，,":
            return "after_quote"
        return "after_quote" if rest[0] in "「『" else "frame"
    word = re.split(r"[\s,;.:!?،؛]", rest.lstrip(",，،; "))[0].casefold()
    if word in FRAMES or re.match(r"\S+ ने कहा", rest):
        return "frame"
    if cased and rest[0].islower() and not word.startswith("a") or cased and rest[0] in ",;":
        return "frame"
    if cased and rest[0].islower() and not rest.casefold().startswith("a.d"):
        return "frame"
    return "after_quote"


def weak_kinds(s: str, places: list[tuple[int, int, int]], tokens: bool, cased: bool, known: frozenset) -> list[str]:
    """The kind of context of each place (mark's start and end, end behind closing quotes) by rules; training labels only."""
    start, out = 0, []
    flat = s.replace("\n", " ")
    for i, j, k in places:
        since, mark = s[start:i], s[i:j]
        if flat[i] == " ":
            kind, k = _thai_blank(flat, i, j) or "thai_date", j
        elif mark == ".":
            if tokens:  # a stop that is a token of its own ends a sentence, one within a token does not
                kind = "stop" if s[i - 1 : i] in ("", " ") else "abbreviation"
            else:
                kind = _stop_kind(flat, i, since, known)
        elif mark[0] in ".…":
            kind = _dots_kind(s, i, j, since, cased)
        else:
            kind = "question" if mark[0] in "?!？！؟;;፧" else "script_stop"
        if LABEL[kind] and flat[i] != " ":
            kind = _quoted_kind(s, i, j, k, since, cased) or kind
        out.append(kind)
        if LABEL[kind]:
            start = k
    return out


# --- places of the chain and their features ---

_EVENT = re.compile(_MARK.pattern + "|[「」『』„“\"]")
_EVENT_OR_BLANK = re.compile(_MARK_OR_BLANK.pattern + "|[「」『』„“\"]")
#: State at a place: open quotations 「 and 『 (0 none, 1 open, 2 open after a colon or comma), „ and " (0 or 1).
CLOSED = (0, 0, 0, 0)


def places(s: str, tokens: bool, state: tuple = CLOSED, first: int = 0, last: int | None = None) -> tuple[list[tuple[int, int, int, tuple]], tuple]:
    """(start and end of the mark, end behind its closing quotes, state there) for the places from `first` up to `last`; the state at `last`.

    tokens: the text is token rows joined by blanks, so that blanks say nothing of where a quote belongs.
    """
    one, two, low, straight = state
    last = len(s) if last is None else last
    flat, out, done = s.replace("\n", " "), [], first
    for m in (_EVENT if tokens or not _THAI.search(s) else _EVENT_OR_BLANK).finditer(flat):
        i, j = m.span()
        if i < first:
            done = max(done, j)
            continue
        if i >= last:
            break
        c = flat[i]
        if c in "「『":
            opened = 2 if i and s[i - 1] in "：:，," else 1
            one, two = (opened, two) if c == "「" else (one, opened)
        elif c in "」』":
            one, two = (0, two) if c == "」" else (one, 0)
        elif c in "„“":
            low = int(c == "„")
        elif c == '"':
            straight ^= 1
        elif i >= done and _stands(flat, s, i, j):
            now = (one, two, low, straight)
            k = i if c == " " else _closing(s, j, now, tokens)
            out.append((i, j, k, now))
            done = max(j, k)
            if tokens and flat[j : j + 2] != ' "':
                straight = 0
    return out, (one, two, low, straight)


def _stands(flat: str, s: str, i: int, j: int) -> bool:
    """Whether a boundary may stand at a mark or blank at all."""
    if flat[i] == " ":
        return bool(i and (_THAI.match(flat[i - 1]) or flat[i - 1] in ".0123456789" and _THAI.search(flat[max(0, i - 12) : i])) and flat[j : j + REACH].strip())
    if flat[i] in ";;":
        before, after = flat[max(0, i - REACH) : i].rstrip()[-1:], s[j : j + 40].lstrip(" \n" + CLOSERS)[:1]
        return bool(before and _GREEK.match(before)) and not (after.islower() and not _GREEK.match(after))
    return True


def _class(c: str) -> str:
    return "-" if not c else "0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "t" if _THAI.match(c) else "c" if _CJK.match(c) else "l" if c.isalpha() else c


def _word_type(word: str, known: frozenset) -> str:
    if not word:
        return "none"
    if word.isdigit():
        return "number"
    if word in ABBREVIATIONS or word.endswith(("พ.ศ", "ค.ศ")):
        return "listed"
    if word in known:
        return "learned"
    if len(word) == 1:
        return "greek letter" if _GREEK.match(word) else "letter" if word.isalpha() else "sign"
    return "numeral" if _NUMERAL.fullmatch(word) else "short" if len(word) <= 4 else "long"


_SPLIT = re.compile(r"[\s,;.:!?،؛。、，]")


def features(s: str, place: tuple, tokens: bool, cased: bool, known: frozenset) -> list[str]:
    """What the chain sees of a place: up to `REACH` characters to either side, and the state of the quotations."""
    i, j, k, state = place
    flat_before, after = s[max(0, i - REACH) : i].replace("\n", " "), s[k : k + REACH].replace("\n", " ")
    ahead = after.strip()
    follows = _class(ahead[:1])
    if s[i] in " \n":
        ahead = s[j : j + REACH].replace("\n", " ").strip()
        follows, end = _class(ahead[:1]), flat_before[-5:]
        last = flat_before[-1:]
        return ["t", "t1 " + _class(last), f"t2 {end}", f"t3 {ahead[:5]}", f"t4 {_class(last)}{follows}", f"t5 {flat_before[-4:]}{follows}", f"t6 {_class(last)}{ahead[:4]}", f"t7 {end[-3:]} {ahead[:4]}"]
    mark = s[i] if s[i] not in ".…" else "." if j == i + 1 and s[i] == "." else "…"
    words = flat_before.split()
    word = words[-1].lstrip(_OPEN).casefold()[-12:] if words else ""
    prior = words[-2].lstrip(_OPEN).casefold()[-12:] if len(words) > 1 else ""
    kind, near = _word_type(word, known), _class(flat_before[-1:])
    gap = "+" if after[:1] in ("", " ") else "-"
    marks = list(_MARK.finditer(flat_before))
    since = flat_before[marks[-1].end() :] if marks else flat_before
    count = min(3, len(since.strip(CLOSERS + " ").split())) if marks or i <= REACH else 3
    closers = "".join(c for c in s[j:k] if not c.isspace())
    quoted = "".join(c for c in closers if c in QUOTES)[-1:]
    next_word = _SPLIT.split(ahead.lstrip(",，،; "))[0].casefold()[:10]
    frame = "f" if next_word in FRAMES or re.match(r"\S+ ने कहा", ahead) else ""
    case = "c" if cased else "n"
    inner = f"{state[0]}{state[1]}"
    lone = "o" if count <= 1 or count == 2 and since.split()[0].casefold() in ("the", "der", "die", "das", "a") else ""
    era = "e" if ahead[:3].casefold() == "a.d" else ""
    out = [
        "b", f"m {mark}", f"mf {mark}{follows}{case}", f"mg {mark}{gap}{near}{follows}", f"mq {mark}{inner}{bool(quoted)}", f"q {quoted}{follows}{case}{frame}{era}", f"qi {quoted}{inner}{follows}",
        f"qn {quoted}{next_word}" if quoted else "qn", f"mc {mark}{count}{lone}", f"mn {mark}{lone}{near}{follows}{case}{era}", f"ma {mark}{ahead[:1] in '「『'}{quoted}{inner}",
    ]
    if mark == ".":
        out += [f"k {kind}", f"kf {kind}{follows}{gap}", f"kp {kind} {prior}", f"w {word}", f"wf {word} {follows}", f"wp {prior} {word}", f"g {near}{_class(s[j : j + 1])}", f"kg {kind}{gap}{near}{tokens}", f"pl {prior}{min(5, len(word))}", f"lw {len(word)}{near}{gap}"]
    return out


def _slots(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode()) % SLOTS for x in names]


def _distance(before: int | None, at: int) -> int:
    """The step between two places, by the characters between them."""
    return len(FAR) if before is None else bisect_right(FAR, max(0, at - before))


class Chain(NamedTuple):
    """A linear chain of the tags inside and boundary: weights of features (for boundary), and of steps by tags and distance."""

    weights: np.ndarray
    move: np.ndarray  # [tag before, tag, distance]
    known: frozenset  # abbreviations that the corpus shows

    def emissions(self, s: str, found: list[tuple], tokens: bool, cased: bool) -> list[float]:
        w = self.weights
        return [float(w[_slots(features(s, p, tokens, cased, self.known))].sum()) for p in found]

    def decode(self, score: list[float], step: list[int], before: tuple = (0.0, -1e9), after: tuple = (0.0, 0.0)) -> list[int]:
        """The best tags (Viterbi), given the best scores of either tag before the first place and after the last."""
        best, back = before, []
        for e, d in zip(score, step):
            way = [[best[a] + self.move[a][t][d] for a in (0, 1)] for t in (0, 1)]
            back.append([int(x[1] > x[0]) for x in way])
            best = max(way[0]), max(way[1]) + e
        tag, out = int(best[1] + after[1] > best[0] + after[0]), []
        for b in reversed(back):
            out.append(tag)
            tag = b[tag]
        return out[::-1]

    def over(self, score: list[float], step: list[int]) -> list[list[float]]:
        """[tag before][tag at the end]: the best score through a run of places."""
        out = [[0.0, -1e9], [-1e9, 0.0]]
        for e, d in zip(score, step):
            m = self.move
            out = [[max(x[0] + m[0][0][d], x[1] + m[1][0][d]), max(x[0] + m[0][1][d], x[1] + m[1][1][d]) + e] for x in out]
        return out


def train(runs: list[tuple[list[list[int]], list[int], list[int]]], known: frozenset = frozenset(), rounds: int = 80, l2: float = 1e-6) -> Chain:
    """A chain from runs of places (slots, steps, tags) by pseudo-likelihood: each tag given its features and its neighbours' tags."""
    n = len(FAR) + 1
    slots, tags, moves = [], [], []
    for each, step, tag in runs:
        for k, (x, t) in enumerate(zip(each, tag)):
            d = np.zeros((2, 2, n))  # what a boundary here adds over none, by the weights of the steps to and from it
            if k:
                d[tag[k - 1], 1, step[k]] += 1
                d[tag[k - 1], 0, step[k]] -= 1
            if k + 1 < len(tag):
                d[1, tag[k + 1], step[k + 1]] += 1
                d[0, tag[k + 1], step[k + 1]] -= 1
            slots.append(x)
            tags.append(t)
            moves.append(d.ravel())
    if not slots:
        return Chain(np.zeros(SLOTS, dtype=np.float32), np.zeros((2, 2, n)), known)
    row, col = np.repeat(np.arange(len(slots)), [len(x) for x in slots]), np.concatenate([np.array(x) for x in slots])
    y, d = np.array(tags, dtype=np.float64), np.array(moves)
    w, m, v = (np.zeros(SLOTS + 4 * n) for _ in range(3))
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(y)) + d @ w[SLOTS:]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        slope = np.r_[np.bincount(col, g[row], SLOTS), g @ d] + l2 * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Chain(w[:SLOTS].astype(np.float32), w[SLOTS:].reshape(2, 2, n), known)


# --- units, chunks and what they know of each other ---


class Text:
    """Units joined to one text, with the way back from its characters to the units' own."""

    def __init__(self, units: list, tokens: bool, forms: dict):
        self.units, self.tokens, self.starts, self.back = units, tokens, [], []
        parts, at = [], 0
        for unit in units:
            self.starts.append(at)
            if tokens:
                each = [forms[t] if t in forms else forms.setdefault(t, (one_form(t) or " ").replace(" ", "_").replace("\n", "_")) for t in unit]
                ends = []
                for f in each:
                    ends.append((ends[-1] if ends else 0) + len(f) + 1)
                self.back.append(ends)
                parts.append("".join(f + " " for f in each))
            else:
                kept = [(k, c) for k, c in enumerate(unit) if not _CUT.match(c)] if _CUT.search(unit) else None
                parts.append(re.sub(r"[\n\r\t\xa0]", " ", unit if kept is None else "".join(c for _, c in kept)) + "\n")
                self.back.append(None if kept is None else [k for k, _ in kept])
            at += len(parts[-1])
        self.whole = "".join(parts)

    def end(self, k: int) -> tuple[int, int] | None:
        """(unit, characters or tokens of it) up to the place k of the joined text."""
        u = bisect_right(self.starts, k - 1) - 1
        n = k - self.starts[u]
        if self.tokens:
            return u, bisect_right(self.back[u], n - 1) + 1
        n = min(n, (self.starts[u + 1] if u + 1 < len(self.starts) else len(self.whole)) - self.starts[u] - 1)
        return (u, n if self.back[u] is None else self.back[u][n - 1] + 1) if n > 0 else None


def read(left: str, text: Text, own: int, state: tuple):  # noqa: ANN201
    """(full text, places, steps) of a chunk: the first `own` characters of `text`, read with what stands before it."""
    s, base = left + text.whole, len(left)
    found, _ = places(s, text.tokens, state, base, base + own)
    blank = not text.tokens and _THAI.search(s)
    marks = [m.end() for m in (_MARK_OR_BLANK if blank else _MARK).finditer(s.replace("\n", " "))]
    steps = []
    for p in found:
        n = bisect_right(marks, p[0]) - 1
        steps.append(_distance(marks[n] if n >= 0 and p[0] - marks[n] <= REACH else None, p[0]))
    return s, found, steps


def unit_ends(units: list, tokens: bool, chain: Chain, cased: bool | None = None) -> list[list[int]]:
    """For each unit the ends in it, without the one that a document's or unmarked unit's end adds, all units read as one.

    units: texts, or lists of token texts if `tokens`. An end is a number of characters, or of tokens.
    """
    text = Text(units, tokens, {})
    s, found, steps = read("", text, len(text.whole), CLOSED)
    cased = any(c.isupper() for c in s) if cased is None else cased
    out: list[list[int]] = [[] for _ in units]
    for p, tag in zip(found, chain.decode(chain.emissions(s, found, tokens, cased), steps)):
        if tag and (end := text.end(p[2])):
            out[end[0]].append(end[1])
    return out


def _bodies(rows: list, tokens: bool) -> tuple[list[int], list]:
    """Places and bodies of a chunk's rows: one a place, in order."""
    best: dict = {}
    for r in rows:
        body = [t or "" for t in r["body"]] if tokens else r["body"]
        if r["rec_pos"] not in best or body > best[r["rec_pos"]]:
            best[r["rec_pos"]] = body
    return sorted(best), [best[p] for p in sorted(best)]


def _maps(text: Text) -> list[int]:
    """What a chunk does to the state, by part: the value it leaves, 3 if it leaves what was, 4 if it turns it round."""
    a, b = (places(text.whole, text.tokens, st)[1] for st in ((0, 0, 0, 0), (2, 2, 1, 1)))
    return [x if x == y else 3 if y > x else 4 for x, y in zip(a, b)]


def _summaries(tokens: bool):  # noqa: ANN202
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms: dict = {}
        for part in parts:
            out = []
            for doc, chunk, rows in zip(part["doc_id"], part["chunk"], part["rows"]):
                where, bodies = _bodies(rows, tokens)
                text = Text(bodies, tokens, forms)
                n = bisect_right(text.starts, REACH)
                out.append((doc, chunk, text.whole[-REACH:], json.dumps(list(zip(where[:n], bodies[:n]))), _maps(text)))
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "tail", "head", "maps"])

    return run


def _carried(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over the summaries of a document in order: the state and the text before each chunk."""
    doc, left, state = None, "", CLOSED
    for part in parts:
        out = []
        for d, chunk, tail, maps in zip(part["doc_id"], part["chunk"], part["tail"], part["maps"]):
            if d != doc:
                doc, left, state = d, "", CLOSED
            out.append((d, chunk, left, list(state)))
            left = (left + tail)[-REACH:]
            state = tuple(x if m == 3 else 1 - x if m == 4 else int(m) for x, m in zip(state, maps))
        yield pd.DataFrame(out, columns=["doc_id", "chunk", "left", "state"])


def _looked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over the summaries of a document backwards: the units after each chunk, up to `REACH` characters."""
    doc, ahead = None, []
    for part in parts:
        out = []
        for d, chunk, head in zip(part["doc_id"], part["chunk"], part["head"]):
            if d != doc:
                doc, ahead = d, []
            out.append((d, chunk, json.dumps(ahead)))
            both, size, ahead = json.loads(head) + ahead, 0, []
            for pos, body in both:
                if size > REACH:
                    break
                ahead.append((pos, body))
                size += 1 + (len(body) if isinstance(body, str) else sum(len(t) + 1 for t in body))
        yield pd.DataFrame(out, columns=["doc_id", "chunk", "ahead"])


def _sampled(tokens: bool, known: frozenset):  # noqa: ANN202
    """Chunks to runs of places with weak tags; a script that ends at blanks once more with its marks stripped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms: dict = {}
        for part in parts:
            out = []
            for rows in part["rows"]:
                bodies = _bodies(rows, tokens)[1]
                stripped = [re.sub(_MARK.pattern + "(?! ?[0-9])", "", b) for b in bodies] if not tokens and any(_THAI.search(b) for b in bodies) else None
                for units in (bodies, stripped) if stripped else (bodies,):
                    text = Text(units, tokens, forms)
                    cased = any(c.isupper() for c in text.whole)
                    s, found, steps = read("", text, len(text.whole), CLOSED)
                    kinds = weak_kinds(s, [p[:3] for p in found], tokens, cased, known)
                    for a in range(0, len(found), 200):
                        out.append(([x for p in found[a : a + 200] for x in [*_slots(features(s, p, tokens, cased, known)), -1]], steps[a : a + 200], [LABEL[k] for k in kinds[a : a + 200]]))
            yield pd.DataFrame(out, columns=["slots", "steps", "tags"])

    return run


def learned_abbreviations(units: DataFrame) -> frozenset:
    """Short words of the corpus (casefolded) that nearly always stand before a full stop which nearly never ends a sentence.

    units: doc_id, rec_pos, body. A stop seems to end one where a word follows with a capital that the corpus has with a
    small letter elsewhere, or nothing follows. Counted over all texts; the most frequent `MOST` reach the driver.
    """
    bare = lambda c: F.lower(F.regexp_replace(c, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    words = F.split(F.trim("body"), r"\s+")
    pairs = units.select(F.explode(F.zip_with(words, F.expr(r"slice(split(trim(body), '\\s+'), 2, 2147483646)"), lambda w, n: F.struct(w.alias("w"), n.alias("n")))).alias("p")).select("p.w", "p.n")
    short = pairs.where(F.col("w").rlike(rf"^[^\p{{L}}\p{{N}}]?\p{{L}}{{2,{SHORT}}}[^\p{{L}}\p{{N}}]*$"))
    stop = F.col("w").endswith(".")
    capital = F.col("n").rlike(r"^[^\p{L}\p{N}]*\p{Lu}")
    counts = short.groupBy(bare("w").alias("word"), stop.alias("stop"), F.when(stop & capital, bare("n")).alias("next"), (stop & F.col("n").isNull()).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    small = pairs.where(F.col("w").rlike(r"^[^\p{L}\p{N}]*\p{Ll}")).select(bare("w").alias("next"), F.lit(True).alias("small")).distinct()
    told = counts.join(small, "next", "left").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n"))).alias("stops"), F.sum(F.when(F.col("small") | F.col("last"), F.col("n")).otherwise(0)).alias("ends"))
    often = told.where((F.col("n") >= OFTEN) & (F.col("stops") >= ALWAYS * F.col("n")) & (F.col("ends") <= (1 - ALWAYS) * F.col("stops"))).orderBy(F.desc("n"), "word").limit(MOST)
    return frozenset(r.word for r in often.collect())


def fit(chunks: DataFrame, tokens: bool, known: frozenset, most: int = SAMPLE_UNITS) -> Chain:
    """A chain trained on about `most` units of the corpus, whole chunks chosen by a hash."""
    size = chunks.select(F.size("rows").alias("n")).agg(F.sum("n").alias("n")).first().n or 0
    share = max(1, -(-size // most))
    part = chunks.where(F.pmod(F.xxhash64("doc_id", "chunk"), F.lit(share)) == 0).select("rows")
    runs = []
    for r in part.mapInPandas(_sampled(tokens, known), "slots array<int>, steps array<int>, tags array<int>").toPandas().itertuples():
        flat = np.asarray(r.slots)
        cuts = np.flatnonzero(flat < 0)
        runs.append(([flat[a + 1 : b] for a, b in pairwise([-1, *cuts.tolist()])], list(r.steps), list(r.tags)))
    return train(runs, known)


def find_ends(units: DataFrame, table: str, tokens: bool, chunk: int = CHUNK, chain: Chain | None = None) -> DataFrame:
    """rec_table, doc_id, rec_pos, end_at: one row for each end of a sentence.

    units: doc_id, rec_pos, body (text, or array of token texts). Repeated rows are one; null bodies and elements count
    as empty; rows with null doc_id or rec_pos are left out. A unit without characters or tokens ends no sentence. A
    document's last sentence ends with its last unit that has any; in a document without any boundary every unit is one.
    Without a `chain` one is trained on the units themselves. The result does not depend on `chunk`.
    """
    body = F.coalesce("body", F.array().cast("array<string>") if tokens else F.lit(""))
    rows = units.where(F.col("doc_id").isNotNull() & F.col("rec_pos").isNotNull()).select("doc_id", "rec_pos", body.alias("body"))
    grouped = rows.groupBy("doc_id", F.floor(F.col("rec_pos") / chunk).cast("int").alias("chunk")).agg(F.collect_set(F.struct("rec_pos", "body")).alias("rows"))
    upper = F.exists("rows", lambda r: F.exists(r["body"], lambda t: t.rlike(r"\p{Lu}"))) if tokens else F.exists("rows", lambda r: r["body"].rlike(r"\p{Lu}"))
    chunks = cut(grouped.withColumn("upper", upper))
    if chain is None:
        chain = fit(chunks, tokens, frozenset() if tokens else learned_abbreviations(rows))
    per_doc = chunks.groupBy("doc_id").agg(F.max("upper").alias("cased"), F.count(F.lit(1)).alias("n"))
    many = per_doc.where("n > 1").select("doc_id")
    summaries = cut(chunks.join(many, "doc_id", "left_semi").mapInPandas(_summaries(tokens), "doc_id string, chunk int, tail string, head string, maps array<int>"))
    ordered = lambda df, c: df.repartition("doc_id").sortWithinPartitions("doc_id", c)
    before = ordered(summaries, "chunk").select("doc_id", "chunk", "tail", "maps").mapInPandas(_carried, "doc_id string, chunk int, left string, state array<int>")
    after = ordered(summaries, F.desc("chunk")).select("doc_id", "chunk", "head").mapInPandas(_looked, "doc_id string, chunk int, ahead string")
    known = chunks.drop("upper").join(per_doc, "doc_id").join(before, ["doc_id", "chunk"], "left").join(after, ["doc_id", "chunk"], "left")

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms: dict = {}
        for part in parts:
            out = []
            for doc, number, rows_, cased, left, state, ahead in zip(*(part[c] for c in ("doc_id", "chunk", "rows", "cased", "left", "state", "ahead"))):
                where, bodies = _bodies(rows_, tokens)
                more = json.loads(ahead) if ahead else []
                text = Text([*bodies, *(b for _, b in more)], tokens, forms)
                where += [p for p, _ in more]
                own = text.starts[len(bodies)] if more else len(text.whole)
                s, found, steps = read(left or "", text, own, CLOSED if state is None else tuple(state))
                ends = [text.end(p[2] - len(left or "")) for p in found]
                scores = chain.emissions(s, found, tokens, cased)
                whole = [len(b) if tokens else len(b.rstrip()) for b in bodies]
                m = chain.over(scores, steps)
                out.append((doc, number, [where[e[0]] if e else -1 for e in ends], [e[1] if e else 0 for e in ends], scores, steps, m[0] + m[1], where[: len(bodies)], whole))
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "pos", "end", "score", "step", "over", "units", "sizes"])

    scored = cut(known.mapInPandas(score, "doc_id string, chunk int, pos array<int>, end array<int>, score array<double>, step array<int>, over array<double>, units array<int>, sizes array<int>"))
    small = scored.join(many, "doc_id", "left_semi").select("doc_id", "chunk", "over")
    best = ordered(small, "chunk").mapInPandas(_best_before, "doc_id string, chunk int, before array<double>")
    rest = ordered(small, F.desc("chunk")).mapInPandas(_best_after, "doc_id string, chunk int, after array<double>")

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, pos, end, scores, steps, first, last, where, sizes in zip(*(part[c] for c in ("doc_id", "pos", "end", "score", "step", "before", "after", "units", "sizes"))):
                tags = chain.decode(list(scores), list(steps), START if first is None else tuple(first), (0.0, 0.0) if last is None else tuple(last))
                out += [(doc, p, e, True) for p, e, t in zip(pos, end, tags) if t and p >= 0]
                out += [(doc, p, n, False) for p, n in zip(where, sizes) if n]
            yield pd.DataFrame(out, columns=["doc_id", "rec_pos", "end_at", "real"])

    told = scored.select("doc_id", "chunk", "pos", "end", "score", "step", "units", "sizes").join(best, ["doc_id", "chunk"], "left").join(rest, ["doc_id", "chunk"], "left")
    found = cut(told.mapInPandas(decode, "doc_id string, rec_pos int, end_at int, real boolean"))
    docs = found.groupBy("doc_id").agg(F.max("rec_pos").alias("last"), F.max("real").alias("marked"))
    kept = found.join(docs, "doc_id").where(F.col("real") | ~F.col("marked") | (F.col("rec_pos") == F.col("last")))
    return kept.select(F.lit(table).alias("rec_table"), "doc_id", "rec_pos", "end_at").distinct()


START = (0.0, -1e9)  # before the first place: inside


def _best_before(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a document's chunks in order: the best score of either tag before each."""
    doc, best = None, START
    for part in parts:
        out = []
        for d, chunk, m in zip(part["doc_id"], part["chunk"], part["over"]):
            if d != doc:
                doc, best = d, START
            out.append((d, chunk, list(best)))
            best = max(best[0] + m[0], best[1] + m[2]), max(best[0] + m[1], best[1] + m[3])
        yield pd.DataFrame(out, columns=["doc_id", "chunk", "before"])


def _best_after(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a document's chunks backwards: the best score from either tag after each up to the document's end."""
    doc, best = None, (0.0, 0.0)
    for part in parts:
        out = []
        for d, chunk, m in zip(part["doc_id"], part["chunk"], part["over"]):
            if d != doc:
                doc, best = d, (0.0, 0.0)
            out.append((d, chunk, list(best)))
            best = max(m[0] + best[0], m[1] + best[1]), max(m[2] + best[0], m[3] + best[1])
        yield pd.DataFrame(out, columns=["doc_id", "chunk", "after"])
