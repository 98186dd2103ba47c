"""Byte-level BPE encoding of whole texts with a public vocabulary.

A piece is encoded with a segment tree over its byte positions: a leaf holds the rank of the pair that begins there, an
inner node the leftmost smallest rank below it. A merge changes the leaves of the merged pair and of its live neighbours,
each in logarithmic time, so that one piece of n bytes takes n log n steps however long it is.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

INF = 1 << 62
# Fixed value: how the vocabulary's tokenizer cuts a text into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file: in `folder`, or else where the installed package of public tokenizers keeps it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Token ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    token = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << max(1, (n - 1).bit_length())
    # a node's value is rank * size + position, so that the smallest is the leftmost of the lowest rank
    tree = [INF] * (2 * size)
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] < INF:
        i = tree[1] % size
        j = after[i]
        token[i] += token[j]
        token[j] = b""
        after[i] = k = after[j]
        put(j, INF)
        if k < n:
            before[k] = i
            r = ranks.get(token[i] + token[k])
            put(i, INF if r is None else r * size + i)
        else:
            put(i, INF)
        if (h := before[i]) >= 0:
            r = ranks.get(token[h] + token[i])
            put(h, INF if r is None else r * size + h)
    return tuple(ranks[t] for t in token if t)


class _Pieces(dict):
    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        self[piece] = ids = encode_piece(piece.encode(), self.ranks)
        return ids


_LOADED: dict[str, _Pieces] = {}


def encode_documents(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) for every row of `df` (doc_id, text; other columns are left out).

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text. No shuffle: each
    Arrow batch is encoded where it was read, with a bounded cache of pieces seen before. Repeated rows stay.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces = _LOADED.setdefault(path, _Pieces({}))
        if not pieces.ranks:
            pieces.ranks = load_ranks(path)
        cut = regex.compile(PATTERN).findall
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                if text:
                    flat.extend(itertools.chain.from_iterable(map(pieces.__getitem__, cut(text))))
                ends.append(len(flat))
            if len(pieces) > CACHE:
                pieces.clear()
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.array([], dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")
