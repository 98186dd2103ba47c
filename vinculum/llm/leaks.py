"""Test passages that stand, whole or in part, in training texts.

Seeds are the word trigrams of the test items; a text that holds seeds of an item, and enough of its words, is aligned with it
by Smith-Waterman over words, and the alignments say how long a stretch of the item stands there in order. The corpus is
read once. Items of a proven bound go to every task with their seeds, and nothing is shuffled. More items stay tables: a
bit map of fixed size of all seeds goes to the tasks, which hand on only the regions of texts that the map lets through;
their seeds are joined with those of the items, and the pairs that meet are aligned. Both ways give the same pairs.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vinculum.runtime import cut

N = 3
STRETCH = 12
WINDOW = 17  # of any leak some so many words of the item hold the least number of matched ones
NOTE = 40  # words of the longest note between two words of a stretch
REACH = NOTE + 2 * STRETCH
MOST_ITEMS = 5_000  # items and their characters that go to every task
MOST_CHARS = 20_000_000
MAP_BITS = 1 << 25  # of the bit map of the seeds of more items
TEXT_WINDOW, TEXT_OVER = 4096, WINDOW * (NOTE + 1)  # of texts and items some so many words are aligned at once; any least
ITEM_WINDOW, ITEM_OVER = 1024, 2 * WINDOW  # stretch lies within one window
WORD_CACHE = 500_000
MATCH, MISS, GAP, NOTED = 2, -1, -1, -5

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});")
_BREAK = re.compile(r"<(?:/?(?:p|div|li|tr|td|th|h[1-6]|l|lg|ab|head)|br|lb|pb)\b[^<>]{0,200}>", re.I)
_DIVIDED = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011\u00AC]\s*\n\s*(?=[^\W\d_])|[\u00AD\u200B-\u200F\u2060-\u2064\uFEFF]")
_MARKS = regex.compile(r"\p{M}+")
_WORDS = re.compile(r"[a-z]+").findall
# letters of every script; of scripts without blanks each character is a word
_LETTERS = re.compile(r"[\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF]|[^\W\d_\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF]+").findall
_ALIKE = str.maketrans({"v": "u", "j": "i", "æ": "ae", "œ": "oe", "ſ": "s", "ς": "σ"})


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared: no case, marks, markup, invisible characters or digits; u for v, i for j.

    A word divided at a line's end is one word. Letters of every script count.
    """
    if "<" in text or "&" in text:
        text = _TAG.sub("", _BREAK.sub("\n", text))
    text = _DIVIDED.sub("", text)
    if text.isascii():
        return _WORDS(text.lower().translate(_ALIKE))
    return _LETTERS(_MARKS.sub("", unicodedata.normalize("NFKD", text)).lower().translate(_ALIKE))


class Index:
    """Words and seeds of a block of items as sorted integer arrays. Items of the same words are one, with all their ids.

    Every trigram of an item is a seed, however many items share it; an item too short to hold one whatever stands
    between its words is looked for by its least shared word.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        ids: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for i, t in items:
            ids[tuple(self.words.setdefault(w, len(self.words) + 1) for w in words_of(t))].append(i)
        self.items = [(i, np.array(w, dtype=np.int64)) for w, i in ids.items() if w]
        self.base = len(self.words) + 1
        sharing = Counter(x for _, w in self.items for x in set(w.tolist()))
        where: dict[int, list[int]] = defaultdict(list)
        self.rarest: dict[int, list[int]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            if len(w) < 2 * N:
                self.rarest[min(w.tolist(), key=lambda x: (sharing[x], x))].append(k)
            else:
                for g in set(self.grams(w).tolist()):
                    where[g].append(k)
        self.seeds = np.array(sorted(where), dtype=np.int64)
        self.owners = [where[g] for g in self.seeds.tolist()]
        self.single = np.zeros(self.base, dtype=bool)
        self.single[list(self.rarest)] = True

    def grams(self, w: np.ndarray) -> np.ndarray:
        if len(w) < N:
            return np.array([], dtype=np.int64)
        return (w[:-2] * self.base + w[1:-1]) * self.base + w[2:]

    def seeds_in(self, w: np.ndarray) -> dict[int, list[int]]:
        """Item number to the positions of its seeds in a text."""
        whole = (w[:-2] > 0) & (w[1:-1] > 0) & (w[2:] > 0) if len(w) >= N else np.array([], dtype=bool)
        at = np.flatnonzero(whole)
        found: dict[int, list[int]] = defaultdict(list)
        if len(at) and len(self.seeds):
            g = (w[at] * self.base + w[at + 1]) * self.base + w[at + 2]
            p = np.searchsorted(self.seeds, g)
            p[p == len(self.seeds)] = 0
            for pos, s in zip(at[self.seeds[p] == g].tolist(), p[self.seeds[p] == g].tolist()):
                for k in self.owners[s]:
                    found[k].append(pos)
        if self.rarest:
            for pos in np.flatnonzero(self.single[w]).tolist():
                for k in self.rarest[int(w[pos])]:
                    found[k].append(pos)
        return found


def may_hold(item: np.ndarray, text: np.ndarray, length: int) -> bool:
    """Whether enough words of the item stand in the text at all, in any order, for a stretch (see `best_stretch`)."""
    has = np.concatenate(([0], np.cumsum(np.isin(item, text) & (item != 0))))
    wide = min(WINDOW, len(item))
    return bool((has[wide:] - has[:-wide]).max() >= least(length))


def best_path(same: np.ndarray) -> tuple[int, list[tuple[int, int]], int]:
    """Score, matched (item, text) positions and first text position of the best local alignment over a matrix of equal words.

    Words of the text between two of the item cost GAP each, but NOTED at most: a note is no worse for being long.
    """
    m, n = same.shape
    gain = np.where(same, MATCH, MISS).astype(np.int32)
    h = np.zeros((m + 1, n + 1), dtype=np.int32)
    slope = np.arange(n + 1, dtype=np.int32) * -GAP
    for i in range(1, m + 1):
        row = h[i]
        np.maximum(h[i - 1, :-1] + gain[i - 1], h[i - 1, 1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        h[i] = np.maximum(np.maximum.accumulate(row + slope) - slope, np.maximum.accumulate(row) + NOTED)
    i, j = divmod(int(h.argmax()), n + 1)
    score, path = int(h[i, j]), []
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + gain[i - 1, j - 1]:
            if same[i - 1, j - 1]:
                path.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        elif h[i, j] == h[i, j - 1] + GAP:
            j -= 1
        else:
            j = int(np.flatnonzero(h[i, :j] == h[i, j] - NOTED)[-1])
    return score, path[::-1], j


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: (matched words, first and last matched position in the item, words of the text it spans)."""
    _, path, start = best_path(item[:, None] == text[None, :])
    return (len(path), path[0][0], path[-1][0], path[-1][1] + 1 - start) if path else (0, -1, -1, 0)


def best_stretch(path: list[tuple[int, int]], length: int) -> tuple[int, int]:
    """(matched, span) of the longest part of an alignment that is a leak (see `is_leak`); (0, 0) if none is."""
    best, start = (0, 0), 0
    for e in range(1, len(path) + 1):  # no note is longer than NOTE words
        if e == len(path) or path[e][1] - path[e - 1][1] > NOTE + 1:
            at = [i for i, _ in path[start:e]]
            # a part a..b is dense enough if 10 words matched for 7 words of it: the lowest balance before b tells the first a
            balance = [10 * k - 7 * i for k, i in enumerate(at)]
            lowest = list(accumulate(balance, min))
            for b, i in enumerate(at):
                a = bisect_left(lowest, -(balance[b] + 3), key=lambda x: -x)
                if a <= b and is_leak(b - a + 1, i - at[a] + 1, length):
                    best = max(best, (b - a + 1, i - at[a] + 1))
            start = e
    return best


def _pieces(path: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """An alignment cut where words of the item or the text are left out."""
    out = [path[:1]]
    for before, now in zip(path, path[1:]):
        if now[0] - before[0] > N or now[1] - before[1] > N:
            out.append([])
        out[-1].append(now)
    return out


def leaks_in(item: np.ndarray, text: np.ndarray, length: int | None = None) -> tuple[int, int]:
    """(matched, span) of the longest leak found in the alignments of an item with a text, (0, 0) if there is none.

    After an alignment that holds no leak its largest piece is taken out and the next best is looked at, down to scores
    that no leak has. length: of the whole item, where `item` is a window of it.
    """
    same, length = item[:, None] == text[None, :], length or len(item)
    floor = 2 * least(length) - min(STRETCH, length)
    while True:
        score, path, _ = best_path(same)
        if score < floor or not path:
            return 0, 0
        found = best_stretch(path, length)
        if found[0]:
            return found
        for i, j in max(_pieces(path), key=len):
            same[i, j] = False


def _windows(n: int, wide: int, over: int) -> Iterator[slice]:
    """Windows of `wide` over n places, each sharing `over` with the next."""
    at = 0
    while True:
        yield slice(at, min(n, at + wide))
        if at + wide >= n:
            return
        at += wide - over


def leaks_at(item: np.ndarray, text: np.ndarray, at: list[int]) -> tuple[int, int]:
    """(matched, span) of the longest leak of an item around its seeds `at` in a text; (0, 0) if there is none.

    Seeds that lie far apart are aligned apart. Long items and stretches of text are aligned window by window, so that
    the matrix has a bound; windows share more than the least stretch can take.
    """
    best, start = (0, 0), 0
    for e in range(1, len(at) + 1):
        if e == len(at) or at[e] - at[e - 1] > REACH:
            if len(set(at[start:e])) >= 2 or len(item) <= STRETCH:
                near = text[max(0, at[start] - REACH) : at[e - 1] + N + REACH]
                for part in _windows(len(near), TEXT_WINDOW, TEXT_OVER):
                    for piece in _windows(len(item), ITEM_WINDOW, ITEM_OVER):
                        if may_hold(item[piece], near[part], len(item)):
                            best = max(best, leaks_in(item[piece], near[part], len(item)))
            start = e
    return best


def stretches(index: Index, w: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item number, matched, item span) of the longest leak of each item that a text holds."""
    for k, at in index.seeds_in(w).items():
        best = leaks_at(index.items[k][1], w, at)
        if best[0]:
            yield k, *best


def least(length: int) -> int:
    """The words of a stretch that must be there."""
    need = min(STRETCH, length)
    return need - need // 6


def is_leak(matched: int, span: int, length: int) -> bool:
    """A stretch of `STRETCH` words of the item (or all of a shorter item), a word lost or exchanged here and there."""
    return span >= min(STRETCH, length) and matched >= least(length) and 10 * matched >= 7 * span


def find_leaks(docs: DataFrame, items: DataFrame, detail: bool = False, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """doc_id, item_id for every document that holds a passage of an item (see `is_leak`), distinct.

    docs: doc_id, text; items: item_id, passage; ids of any type, other columns are ignored. Null and empty texts and
    passages give nothing; repeated rows one result; of several copies of a document each is found. detail adds matched
    and span. Up to `most_items` items of `most_chars` characters go to every task; more are joined by their seeds.
    """
    clean = items.where(F.col("passage").isNotNull()).select("item_id", "passage").distinct()
    size = clean.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("chars")).first()
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    if size.n <= most_items and size.chars <= most_chars:
        kinds = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
        block = sorted(((r.item_id, r.passage) for r in clean.collect()), key=str)
        found = texts.mapInArrow(_scanner(block, to_arrow_type(kinds[1])), f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, matched int, span int")
    else:
        found = _joined(texts, clean)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("span").alias("span")) if detail else found.select("doc_id", "item_id").distinct()


def _scanner(block: list, kind: pa.DataType):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block)
        number = index.words.get
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                w = np.fromiter((number(x, 0) for x in words_of(text)), dtype=np.int64)
                out += [(row, i, matched, span) for k, matched, span in stretches(index, w) for i in index.items[k][0]]
            rows, ids, matched, spans = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(ids, kind), pa.array(matched, pa.int32()), pa.array(spans, pa.int32())], names=["doc_id", "item_id", "matched", "span"])

    return run


# --- more items than go to every task: words are their 64-bit hashes, seeds those of three words or of one ---


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) >> 1
        return h


def hashed(text: str, cache: _Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words_of(text)), dtype=np.int64)


def trigrams(w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (w[:-2] * 6364136223846793005 + w[1:-1]) * 2862933555777941757 + w[2:] if len(w) >= N else np.array([], dtype=np.int64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()
    for batch in batches:
        words = [hashed(t, cache) for t in batch.column(1).to_pylist()]
        seeds = [np.unique(trigrams(w)) if len(w) >= 2 * N else [] for w in words]
        keys = [xxhash.xxh3_128_hexdigest(w.tobytes()) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=["item_id", "item", "words", "seeds"])


def _regions(bits):  # noqa: ANN001, ANN202
    """Texts to the regions that hold seeds by the bit map: text (its hash), start, words and (place in the region, seed)."""
    names = ["doc_id", "text", "start", "words", "places", "seeds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, there = _Hashes(), bits.value
        seen = lambda g: (there[(g % MAP_BITS) >> 3] >> (g % MAP_BITS & 7).astype(np.uint8)) & 1 > 0
        for batch in batches:
            out: list[tuple] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                w = hashed(text, cache)
                g = trigrams(w)
                three, one = np.flatnonzero(seen(g)), np.flatnonzero(seen(w))
                places = np.concatenate([three, one])
                seeds = np.concatenate([g[three], w[one]])
                order = np.argsort(places, kind="stable")
                places, seeds = places[order], seeds[order]
                borders = [0, *(np.flatnonzero(np.diff(places) > 2 * REACH + N) + 1).tolist(), len(places)] if len(places) else []
                key = xxhash.xxh3_128_hexdigest(text) if len(places) else ""
                for a, b in zip(borders, borders[1:]):
                    low, high = max(0, int(places[a]) - REACH), int(places[b - 1]) + N + REACH
                    out.append((row, key, low, w[low:high], places[a:b] - low, seeds[a:b]))
            rows, *rest = zip(*out) if out else ((), (), (), (), (), ())
            long = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, k) for c, k in zip(rest, (pa.string(), pa.int64(), long, long, long)))], names=names)

    return run


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, item, words, region, at in zip(*(batch.column(c).to_pylist() for c in ("text", "item", "words", "region", "at"))):
            best = leaks_at(np.array(words, dtype=np.int64), np.array(region, dtype=np.int64), at)
            if best[0]:
                out.append((text, item, *best))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["text", "item", "matched", "span"])


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, span by a join on seeds; equal items and equal texts are aligned once."""
    spark = texts.sparkSession
    named = cut(items.mapInArrow(_item_words, f"item_id {items.schema['item_id'].dataType.simpleString()}, item string, words array<long>, seeds array<long>").where("size(words) > 0"))
    distinct = named.dropDuplicates(["item"]).select("item", "words", "seeds")
    # items too short for trigrams are looked for by their least shared word
    each = distinct.select("item", (F.size("seeds") == 0).alias("short"), F.explode(F.array_distinct("words")).alias("seed"))
    shared = each.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    single = each.where("short").join(shared, "seed").groupBy("item").agg(F.min_by("seed", F.struct("n", "seed")).alias("seed"))
    seeds = cut(distinct.select(F.explode("seeds").alias("seed"), "item").unionByName(single.select("seed", "item")))
    slots = seeds.select(F.pmod("seed", F.lit(MAP_BITS)).alias("slot"))
    octets = slots.groupBy(F.expr("shiftright(slot, 3)").alias("at")).agg(F.expr("bit_or(shiftleft(1, int(slot % 8)))").alias("v")).toPandas()  # at most MAP_BITS / 8 rows
    there = np.zeros(MAP_BITS >> 3, dtype=np.uint8)
    there[octets["at"].to_numpy(dtype=np.int64)] = octets["v"].to_numpy(dtype=np.uint8)
    kind = texts.schema["doc_id"].dataType.simpleString()
    regions = cut(texts.mapInArrow(_regions(spark.sparkContext.broadcast(there)), f"doc_id {kind}, text string, start long, words array<long>, places array<long>, seeds array<long>"))
    once = regions.dropDuplicates(["text", "start"])
    hits = once.select("text", "start", F.explode(F.arrays_zip("places", "seeds")).alias("h")).select("text", "start", F.col("h.places").alias("place"), F.col("h.seeds").alias("seed"))
    met = hits.join(seeds, "seed").groupBy("text", "start", "item").agg(F.sort_array(F.collect_list("place")).alias("at"))
    pairs = met.join(once.select("text", "start", F.col("words").alias("region")), ["text", "start"]).join(distinct.select("item", "words"), "item")
    leaked = cut(pairs.select("text", "item", "words", "region", "at").mapInArrow(_aligned, "text string, item string, matched int, span int").groupBy("text", "item").agg(F.max("matched").alias("matched"), F.max("span").alias("span")))
    return leaked.join(regions.select("doc_id", "text").distinct(), "text").join(named.select("item_id", "item"), "item").select("doc_id", "item_id", "matched", "span")
