"""Template residue, filler, error pages and script notices in place of content.

An L2-regularised logistic regression over windows of a few tokens: hashed uni-, bi- and trigrams, the shapes of three and
four tokens, repetition, length and title. It is trained on weak labels (response statuses, phrases and forms of
placeholders found in a bounded sample), with hard negatives mined in rounds, and calibrated on sources it was not trained
on. A document whose best window scores over all that is known to be none is residue by the classifier alone, whether
the weak labels know its words or not; in the band below an exact check follows. Scoring is one vectorised projection
without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.runtime import cut

# Names of fields that templates of this kind of edition leave unfilled.
_NAME = r"(?:work|passage|author|chapter|token|page|translator|editor|edition|sigla|verse|book|year|publisher|urnbase|citation|lemma|relationship\d?|title|name|number|text|id|no|urn|date|line|section|url|language)"
_FIELD = rf"(?:{_NAME}(?:[ _.]{_NAME})*|[A-Z]+(?:_[A-Z]+)+)"
_ANY = r"[\p{L}_$#/=&;][\p{L}\p{N}_.$:#/ =-]{0,40}"
PLACEHOLDER = r"(?=[{$#<&%@_\[T])(?:" + "|".join([
    rf"\{{\{{ ?{_ANY} ?\}}\}}", rf"[$#]\{{{_ANY}\}}", rf"\$\[{_ANY}\]", rf"<[%?]=? ?{_ANY} ?[%?]>", rf"&lt;[%?]=? ?{_ANY} ?[%?]&gt;", rf"\{{% ?{_ANY} ?%\}}",
    rf"%\({_ANY}\)[sd]", rf"\{{{_ANY}:[sd]\}}", rf"@@{_ANY}@@", r"<<[A-Z][A-Z0-9_ .]{1,40}>>", r"(?<![\p{L}\p{N}_])__[A-Z][A-Z0-9_]{1,40}__", r"%[A-Z][A-Z0-9_]{2,40}%",
    rf"\[\[? ?(?i:{_FIELD}) ?\]\]?", rf"<insert {_ANY}>", r"\[(?i:insert) [^\]]{1,40}\]", r"\[[^\]\[]{1,40} goes here\]", rf"\bTODO: (?i:{_FIELD})", r"<(?:undefined|null|nil|none)>", r"\[object Object\]",
]) + ")"
# Words and phrases of filler, of error pages and of notices; the phrases in lower case.
_LOREM = r"(?:lorem|ipsum|dolore?|amet|consectetur|adipiscing|eiusmod|incididunt|labore|aliqua|tempor|elit|magna)"
_STATUS = r"(?:Not Found|Forbidden|Unauthorized|Bad Request|Bad Gateway|Gateway Time-?[oO]ut|Service (?:Temporarily )?Unavailable|Internal Server Error|Too Many Requests|Gone|Request Timeout|Method Not Allowed)"
FILLER = r"(?<![\p{L}\p{N}])(?=[ladcietmbxpnfqswjhyzLADCIETMBXPNFQSWJHYZ])(?i:" + "|".join([
    rf"(?:{_LOREM})(?:[ ,.]+(?:{_LOREM}|sit|sed|et|ut|do)\b){{3}}", r"(bla|blah|tbd|xxx+|test|text|textus|passage|blindtext|dummy|foo|n/a|text here|todo|placeholder|null)(?:[ ,.]+\1){3}(?![\p{L}])",
    r"(?:(?:test|asdf|asdfasdf|qwer|qwerty|sdfg|jklö|jkl|hjkl|yxcv|zxcv)(?:\s+|(?![\p{L}]))){4}", r"word ?1 word ?2 word ?3",
]) + r")|(?=[_0?.\[])(?:(?:\[ \] ?){4}|_{5,}(?: _{3,})+|(?<!\d)(?:0000 ?){4}|(?:\?\?\? ?){4}|(?<!\.)(?:\. ){4}\.)"
ERROR = r"(?=[45])(?<!\d)[45]\d\d:? (?:[-–—] )?" + _STATUS + r"\b|\((?<=[a-z] \()[45]\d\d\)(?<=" + _STATUS + r" \(\d{3}\))|(?=[EHFS])\b(?:Error|HTTP|HTTP/1\.[01]|Erreur|Fehler|Errore|Status) [45]\d\d\b|(?<=\p{L})Error: |\b(?:java|org|com)\.[\p{L}.]{1,60}(?:Exception|Error)\b|(?i:try again in \d+ seconds)|(?i:request id nan)"
SCRIPTS = r"(?=[eatsEATS])\b(?i:enable|activate|allow|turn on|switch on|activar|activer|aktivieren sie|active el uso de|abilita|attiva)\b[^.]{0,30}\b(?i:javascript|scripts)\b"
STRUCTURE = f"{PLACEHOLDER}|{FILLER}|{ERROR}|{SCRIPTS}"
PHRASES = [
    "lorem ipsum", "dummy passage", "dummy text", "this is a placeholder", "this is placeholder", "placeholder copy", "placeholder text", "sample text.", "sample passage.", "content coming soon", "not written yet",
    "text to be supplied", "text to be added", "text will follow", "under construction", "replace this text", "replace this passage", "text goes here", "hier folgt text", "hier steht später der text", "le texte viendra", "le texte de ce passage viendra", "il testo seguirà", "el texto vendrá", "passage text to be",
    "access denied.", "you do not have permission", "pagina non inventa est", "page demandée est introuvable", "pagina richiesta non esiste", "seite wurde nicht gefunden", "página no existe", "página no encontrada",
    "could not resolve the urn", "your session has expired", "please log in again", "database connection failed", "rate limit reached", "rate limit exceeded", "the server is busy", "traceback (most recent call last)", "warning: undefined ",
    "fatal error: ", "upstream connect error", "disconnect before headers", "page you are looking for", "could not be found on this server", "temporarily down for maintenance", "did not answer in time", "something went wrong", "segmentation fault",
    "javascript is disabled", "javascript must be", "javascript is required", "scripts must be", "requires javascript", "page needs javascript", "does not run scripts", "does not support javascript", "<noscript>", "checking your browser",
    "reload after changing the setting", "verify you are human", "verifying you are human",
]
# a mention inside quotation marks is no residue; straight quotes only where they hold nothing but the mention
QUOTED = rf"(?=[“„‘«\"])(?:“[^“”„]{{1,150}}”|„[^“”„]{{1,150}}“|‘[^‘’]{{1,100}}’|«[^«»]{{1,150}}»|\"(?:{PLACEHOLDER}|[45]\d\d not found)\")"
INVISIBLE = r"[­​-‍⁠﻿]"

SLOTS = 1 << 18
WINDOW = 10  # tokens that are judged together
PIECE = 40  # tokens of a training row, with the WINDOW - 1 before it
SAMPLE_DOCS = 14_000
SAMPLE_PIECES = 40_000
SEEN = 3  # training rows that a feature must stand in
HELD = 5  # every so many sources are kept for calibration
STRAY = 5e-4  # of unlabelled pieces so many may hold residue that the weak labels do not know: the highest scores are no negatives
DRAWN = 3  # of every so many unlabelled pieces one window is drawn; the others give windows where they score high
MARGIN, SURE_MARGIN = 1.0, 2.0
BAND = (-5.0, -3.0)  # the band of the exact check begins within
TOKENS = r"[^\W\d_]+|\d+|_+|[^\w\s]"
CACHE = 300_000
# Fixed forms of editors' signs: what the weak labels know to be none
SIGNS = regex.compile(r"\{\p{Ll}+\}|\[\[?\p{Ll}+\]\]?|<\p{Ll}+>|[†*]\p{L}+")
WEAK = regex.compile(STRUCTURE + "|(?i:" + "|".join(map(regex.escape, PHRASES)) + ")")


def flattened(text: Column) -> Column:
    """The text without invisible characters, runs of blanks made one, quoted mentions taken out."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), r"(?U)\s+", " "), QUOTED, "")


# what a page puts between the words of a text: line and note numbers, markup, divisions of words
BETWEEN = r"(?<=[\p{L},.;:]) \[?\d{1,4}\]?(?= \p{L})|</?(?:i|b|em|strong|u|p|br|span|div|sup|sub|l|lg|lb|head)\b[^<>]{0,40}>|(?<=\p{L})[-\u2010\u2011\u00AC] (?=\p{Ll})"


def holds_residue(flat: Column) -> Column:
    """Exact check of a flattened text: phrases, or the structure of placeholders, filler and statuses, as it stands or without what stands between its words."""

    def check(flat: Column) -> Column:
        phrase = F.exists(F.array(F.lower(flat)), lambda low: reduce(Column.__or__, [low.contains(p) for p in PHRASES]))
        return phrase | flat.rlike(STRUCTURE)

    bare = F.when(flat.rlike(BETWEEN), F.regexp_replace(flat, BETWEEN, ""))
    # bound once; inlined, they would be computed for every phrase
    return F.exists(F.array(flat), check) | F.coalesce(F.exists(F.array(bare), check), F.lit(False))


def is_residue(text: Column) -> Column:
    """The weak label of a document."""
    return holds_residue(flattened(text))


class _Slots(dict):
    """Token to one number of the slots of its form and of its shape and whether it is a word; digits count by their number."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        form = "#%d" % len(token) if token.isdigit() else token.lower()
        shape = token if not token[0].isalpha() else "A" if token.isupper() else "a" if token.islower() else "Aa" if token[0].isupper() else "x"
        self[token] = packed = _slot(form) | _slot("shape " + ("#" if token.isdigit() else shape)) << 20 | token[0].isalpha() << 40
        return packed


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


_FIND, _FIND_ALL = re.compile(TOKENS).finditer, re.compile(TOKENS).findall
_NONE = SLOTS  # a feature that is not there; its weight is 0
_REACH = np.array([1, 2, 3, 3, 4, 2, 1, 1])  # tokens that each feature spans
_TITLE, _REPEATED, _LENGTHS = _slot("title"), _slot("repeated"), np.array([_slot(f"length {k}") for k in range(11)])


def packed(tokens: list[str], cache: _Slots) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def slots_of(tokens: np.ndarray, place: np.ndarray, length: np.ndarray | int, title: np.ndarray | bool = True) -> np.ndarray:
    """For each token the slots of the features that end at it, by kind: [..., kind, token].

    Kinds: form, two and three forms, three and four shapes (not all of words), repetition, length of the text, title (its
    first token). tokens: packed, -1 after a text's end; place: of each in its text or piece; length: of the text in tokens;
    title: does the text begin at place 0?
    """
    ok = tokens >= 0
    form, shape, word = tokens & (1 << 20) - 1, tokens >> 20 & (1 << 20) - 1, np.where(ok, tokens >> 40, 0)
    n = tokens.shape[-1]
    out = np.full((*tokens.shape[:-1], len(_REACH), n), _NONE, dtype=np.int32)
    out[..., 0, :] = np.where(ok, form, _NONE)

    def join(kind: int, x: np.ndarray, of: int, salt: int, mixed: bool) -> None:
        if n < of:
            return
        total, words, there = salt, 0, ok[..., of - 1 :] & (place[..., of - 1 :] >= of - 1)
        for k, by in enumerate((7919, 31337, 92821, 68917)[:of]):
            total = total + x[..., of - 1 - k : n - k] * by
            words = words + word[..., of - 1 - k : n - k] if mixed else words
        out[..., kind, of - 1 :] = np.where(there & (words < of) if mixed else there, total % SLOTS, _NONE)

    join(1, form, 2, 17, False)
    join(2, form, 3, 29, False)
    join(3, shape, 3, 41, True)
    join(4, shape, 4, 43, True)
    out[..., 5, 1:] = np.where(ok[..., 1:] & (place[..., 1:] > 0) & (form[..., 1:] == form[..., :-1]), _REPEATED, _NONE)
    size = _LENGTHS[np.minimum(len(_LENGTHS) - 1, np.ceil(np.log2(1 + np.asarray(length))).astype(np.int64))]
    out[..., 6, :] = np.where(ok & (place % WINDOW == 0), size, _NONE)
    out[..., 7, :] = np.where(ok & (place == 0) & title, _TITLE, _NONE)
    return out


def features(text: str, cache: _Slots) -> tuple[list[str], np.ndarray]:
    """(tokens, slots [kind, token]) of a whole text."""
    found = _FIND_ALL(text)
    return found, slots_of(packed(found, cache), np.arange(len(found)), len(found))


def window_scores(f: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The summed weights of the features that lie whole within each window of a text; one window if it is short.

    f: slots by kind and token, of one text or of many of the same length.
    """
    each = w[f]
    n = f.shape[-1]
    total = np.cumsum(each.sum(-2, dtype=np.float64), -1)
    if n <= WINDOW:
        return total[..., -1:]
    score = total[..., WINDOW - 1 :].copy()
    score[..., 1:] -= total[..., :-WINDOW]
    for kind, reach in enumerate(_REACH):
        for k in range(reach - 1):  # these end within the window, but begin before it
            score[..., 1:] -= each[..., kind, 1 + k : n - WINDOW + 1 + k]
    return score


def _cut_out(f: np.ndarray, at: int) -> np.ndarray:
    """The slots of the window at a place."""
    g = f[:, at : at + WINDOW].copy()
    if at:
        for kind, reach in enumerate(_REACH):
            g[kind, : reach - 1] = _NONE
    return g[g != _NONE]


def training_rows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """source, h, tokens, length, title, ones, zeros, signs for the pieces of about `sample_docs` documents chosen by a hash of their id.

    h: a hash to choose by; tokens: of the piece, packed; length of its text; title: does it begin it? ones and zeros: places
    of windows that hold what the weak labels know, and of such as hold none of it; signs: are these around editors' signs?
    docs: doc_id, source, flat, there. The corpus is read once for it.
    """
    n = max(1, docs.count() // sample_docs)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == 0).where("there").select("source", "flat", holds_residue(F.col("flat")).alias("any"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Slots()
        for part in parts:
            out = []
            for source, text, some in zip(part["source"], part["flat"], part["any"]):
                found = list(_FIND(text))
                tokens = packed([m.group() for m in found], cache)
                spans = [m.span() for m in WEAK.finditer(text)] if some else []
                signs = [m.span() for m in SIGNS.finditer(text)]
                if some and not spans:
                    continue  # its residue is broken up: no window shows the words together
                for low in range(0, len(found), PIECE):
                    at = max(0, low - WINDOW + 1)
                    high = min(len(found), low + PIECE)
                    ones, zeros, near = _labelled(found, spans, at, high)
                    if near and not ones:
                        continue  # what there is stands whole in the piece before or after
                    h = zlib.crc32(text[found[at].start() : found[high - 1].end()].encode())
                    shown = _labelled(found, signs, at, high)[0] if signs and not ones else []
                    if not ones:
                        zeros = shown or [h % max(1, high - at - WINDOW + 1)]
                    out.append((source, h, tokens[at:high].tobytes(), len(found), at == 0, ones, zeros, bool(shown)))
            yield pd.DataFrame(out, columns=["source", "h", "tokens", "length", "title", "ones", "zeros", "signs"])

    return cut(sample.mapInPandas(run, "source string, h long, tokens binary, length int, title boolean, ones array<int>, zeros array<int>, signs boolean"))


def _labelled(found: list, spans: list, at: int, high: int) -> tuple[list[int], list[int], bool]:
    """Places of the windows of a piece that hold a labelled span whole, or lie mostly in one, and of those that touch none; is any near?"""
    near = [(a, b) for a, b in spans if a < found[high - 1].end() and b > found[at].start()]
    ones, zeros = [], []
    if near:
        for k in range(at, max(at, high - WINDOW) + 1, 2):
            low, top = found[k].start(), found[min(high, k + WINDOW) - 1].end()
            touched = [(a, b) for a, b in near if a < top and b > low]
            if any(a >= low and b <= top or min(b, top) - max(a, low) >= 0.8 * (top - low) for a, b in touched):
                ones.append(k - at)
            elif not touched:
                zeros.append(k - at)
    return ones, zeros, bool(near)


def _train(windows: list[np.ndarray], y: np.ndarray, rounds: int, l2: float) -> np.ndarray:
    """Weights (the last is of no feature, the one before of the constant) by Adam over all windows; both labels weigh the same."""
    row, col = np.repeat(np.arange(len(windows)), [len(x) for x in windows]), np.concatenate(windows)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    w, m, v = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(y)) + w[-1]
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        slope = np.bincount(col, g[row], SLOTS + 1) + l2 * w
        slope[-1] = g.sum()
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


class Model(NamedTuple):
    """Weights by slot (the last, of no feature, is 0), the constant, and the scores from which a text is likely and sure to be residue."""

    weights: np.ndarray
    constant: float
    likely: float
    sure: float


def fit(rows: DataFrame, most: int = SAMPLE_PIECES, rounds: int = 60, mined: int = 2, l2: float = 3e-6) -> Model | None:
    """A model from at most `most` training rows of each label, `HELD` of the sources kept for its calibration.

    The bound keeps what reaches the driver constant; the order is one of all columns, so that the model does not hang on the
    order of the rows. Pieces with editors' signs always give windows: they are too rare to be left to chance, and where they
    score high they would pass for `STRAY`. After each training the windows of unlabelled pieces that score highest are added
    as negatives, `mined` times. sure: over the scores of the kept pieces without a label, but for `STRAY` of them, by `SURE_MARGIN`;
    likely: under the lowest kept label but for one in a hundred, within `BAND`. None where the sample has not both labels.
    """
    part = [rows.where(c).orderBy("h", "source", "length", "title", "tokens").limit(most).toPandas() for c in ("size(ones) > 0", "size(ones) = 0")]
    frame = pd.concat(part, ignore_index=True)
    if not len(part[0]) or not len(part[1]):
        return None
    wide = PIECE + WINDOW - 1
    tokens = np.full((len(frame), wide), -1, dtype=np.int64)
    for k, b in enumerate(frame["tokens"]):
        f = np.frombuffer(b, dtype=np.int64)
        tokens[k, : len(f)] = f
    length, title = frame["length"].to_numpy()[:, None], frame["title"].to_numpy()[:, None]
    some = lambda which: slots_of(tokens[which], np.broadcast_to(np.arange(wide), (len(which), wide)), length[which], title[which])
    parts = lambda which: (which[a : a + 2000] for a in range(0, len(which), 2000))
    label = frame["ones"].map(len).to_numpy() > 0
    kept = np.array([zlib.crc32(x.encode()) % HELD == 0 for x in frame["source"]])
    if min(np.bincount(2 * kept + label, minlength=4)) == 0:  # too few sources to keep some back
        kept[:] = False
    seen = np.zeros(SLOTS + 1, dtype=np.int64)
    for which in parts(np.flatnonzero(~kept)):
        for f in some(which):
            seen[np.unique(f)] += 1
    known = seen >= min(SEEN, 1 + len(frame) // 100)
    known[_NONE] = False

    def window(f: np.ndarray, at: int) -> np.ndarray:
        x = _cut_out(f, at)
        return x[known[x]]

    drawn = label | frame["signs"].to_numpy(dtype=bool) | (np.arange(len(frame)) % DRAWN == 0)
    marked = [(window(f, at), y) for which in parts(np.flatnonzero(~kept & drawn)) for k, f in zip(which, some(which)) for y, places in ((1.0, frame["ones"][k]), (0.0, frame["zeros"][k])) for at in places]
    windows, y = [x for x, _ in marked], np.array([v for _, v in marked])
    plain = np.flatnonzero(~kept & ~label)

    def scores(which: np.ndarray) -> np.ndarray:
        return np.concatenate([window_scores(some(w), weights) for w in parts(which)]) + constant

    for k in range(mined + 1):
        w = _train(windows, y, rounds, l2)
        constant, weights = float(w[-1]), np.where(known, w, 0.0).astype(np.float32)
        if k < mined:
            every = scores(plain)
            top = np.argsort(-every.max(1), kind="stable")[int(STRAY * len(plain)) : len(plain) // 10 + 1]
            windows += [window(f, int(every[i].argmax())) for which in parts(top) for i, f in zip(which, some(plain[which]))]
            y = np.r_[y, np.zeros(len(top))]
    judged = kept if kept.any() else ~kept
    low, high = (scores(np.flatnonzero(judged & m)).max(1) for m in (label, ~label))
    return Model(weights, constant, float(np.clip(np.quantile(low, 0.01) - MARGIN, *BAND)), float(max(0.0, np.quantile(high, 1 - STRAY)) + SURE_MARGIN))


def text_scores(texts: list[str], model: Model, cache: _Slots) -> np.ndarray:
    """The score of the best window of each flattened text, so that a placeholder in a long text is not outweighed; -inf for one without tokens."""
    score = np.full(len(texts), -np.inf)
    at = 0
    while at < len(texts):  # some texts together: as tokens in a row, each with an end after it
        run, sizes = [], []
        while at + len(sizes) < len(texts) and (not sizes or sum(sizes) < TOGETHER):
            tokens = packed(_FIND_ALL(texts[at + len(sizes)]), cache)
            run += [tokens, _END]
            sizes.append(len(tokens))
        n = np.array(sizes)
        first = np.r_[0, np.cumsum(n + WINDOW)[:-1]]
        each = np.repeat(np.arange(len(n)), n + WINDOW)
        whole = np.concatenate(run)
        sums = window_scores(slots_of(whole, np.arange(len(whole)) - first[each], n[each]), model.weights)
        there = np.flatnonzero(n)
        if len(there):
            low = first[there]
            borders = np.stack([low, low + np.maximum(1, n[there] - WINDOW + 1)], 1).ravel()
            score[at + there] = np.maximum.reduceat(np.r_[sums, -np.inf], borders)[::2] + model.constant
        at += len(sizes)
    return score


TOGETHER = 20_000
_END = np.full(WINDOW, -1, dtype=np.int64)


def text_score(text: str, model: Model, cache: _Slots) -> float:
    return float(text_scores([text], model, cache)[0])


def best_score(flat: Column, model: Model) -> Column:
    """The score of each flattened text; the weights (1 MB) go with the function."""

    def score(s: pd.Series) -> pd.Series:
        return pd.Series(text_scores([x or "" for x in s], model, _SHARED), index=s.index, dtype="float64")

    return F.pandas_udf(score, "double")(flat)


_SHARED = _Slots()


def usable(docs: DataFrame) -> DataFrame:
    """doc_id, source, flat (null for null, empty and blank texts), there (is flat not null? told by the text as it is, so that asking it flattens nothing)."""
    there = F.coalesce(F.trim("text") != "", F.lit(False))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.when(there, flattened(F.col("text"))).alias("flat"), there.alias("there"))


def _judged(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, found: by the classifier alone where it is sure, by the exact check as well where it is not."""
    scored = texts.where("there").select("doc_id", "source", "flat", best_score(F.col("flat"), model).alias("score"))
    # the check takes its text through the classifier's verdict: as two filters, the optimiser would turn them round
    unsure = scored.select("doc_id", "source", "flat", "score", F.when((F.col("score") >= model.likely) & (F.col("score") < model.sure), F.col("flat")).alias("candidate"))
    return unsure.select("doc_id", "source", "flat", "score", ((F.col("score") >= model.sure) | F.coalesce(holds_residue(F.col("candidate")), F.lit(False))).alias("found"))


def residue_documents(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id of every document whose text holds residue, distinct.

    docs: doc_id, text, source; other columns are ignored. Null, empty and blank texts are none, nor are short ones as
    such; repeated rows give one result. A text counts with its best window, so length hides nothing. Where the sample
    has no weak label at all, there is no classifier and the exact check is made on every text.
    """
    texts = usable(docs)
    model = fit(training_rows(texts, sample_docs))
    if model is None:
        return texts.where(holds_residue(F.col("flat"))).select("doc_id").distinct()
    return _judged(texts, model).where("found").select("doc_id").distinct()


def validation(docs: DataFrame, share: int = 5) -> DataFrame:
    """The classifier on documents of sources held out of its training and calibration.

    documents, positives (by the weak labels), candidates (likely or sure), right (of these, positive), alone (of a score
    over 0), alone_right, sure, sure_right, found (likely and checked, or sure), found_right.
    """
    texts = usable(docs)
    unseen = F.pmod(F.xxhash64("source"), F.lit(share)) == 0
    model = fit(training_rows(texts.where(~unseen)))
    if model is None:
        model = Model(np.zeros(SLOTS + 1, dtype=np.float32), 0.0, -1.0, 1.0)
    label, z = F.coalesce(holds_residue(F.col("flat")), F.lit(False)), F.col("score")
    judged = _judged(texts.where(unseen), model).select("score", "found", label.alias("label"))
    counts = {"candidates": z >= model.likely, "alone": z >= 0, "sure": z >= model.sure, "found": F.col("found")}
    each = [c for n, hit in counts.items() for c in (F.count_if(hit).alias(n), F.count_if(hit & F.col("label")).alias("right" if n == "candidates" else f"{n}_right"))]
    return judged.agg(F.count(F.lit(1)).alias("documents"), F.count_if("label").alias("positives"), *each)
