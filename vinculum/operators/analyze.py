"""The analyser boundary: any provider of analyses, with a budget and bounded retries, run per sentence."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.operators import budget as B
from vinculum.operators.checks import validate
from vinculum.operators.segment import segment
from vinculum.runtime import cut
from vinculum.schemas import GRAPH

#: An analyser takes (passage, token ids and texts, budget) and gives rows of the graph and how the output finished.
Analyser = Callable[[str, list[tuple[str, str]], int], dict[str, Any]]


class ParseFailure(Exception):
    """An output that could not be parsed; `truncated` says that it was cut off by the budget."""

    def __init__(self, truncated: bool = False):
        super().__init__("unparsable output")
        self.truncated = truncated


def with_retry(analyser: Analyser, passage: str, tokens: list[tuple[str, str]], *, max_retries: int = 1, growth: float = 2.0, margin: float = B.MARGIN, floor: int = B.FLOOR, ceiling: int = B.CEILING, initial: int | None = None, model: dict = B.FALLBACK) -> dict[str, Any]:
    """The analysis, asked for again with a larger budget while it looks truncated: given ids missing, or so reported.

    Result: that of the analyser with missing (sorted ids) and attempts (budgets). A parse failure is raised again unless
    it was a truncation and there is a retry left. What is still incomplete at the end is returned with a warning.
    """
    size = initial if initial is not None else B.estimate(len(tokens), model, margin, floor, ceiling)
    tried = []
    while True:
        tried.append(size)
        more = len(tried) <= max_retries and size < ceiling
        try:
            got = analyser(passage, tokens, size)
        except ParseFailure as e:
            if not (more and e.truncated):
                raise
            warnings.warn(f"analysis truncated at {size} before it could be parsed; asking again", stacklevel=2)
        else:
            missing = sorted({i for i, _ in tokens} - {r["id"] for r in got.get("tokengraph", [])})
            cut_off = bool(missing) or got.get("finish_reason") == "length"
            if not (cut_off and more):
                if cut_off:
                    warnings.warn(f"analysis still looks truncated after {len(tried) - 1} retries; missing: {missing}", stacklevel=2)
                return {**got, "missing": missing, "attempts": tried}
            warnings.warn(f"analysis at {size} misses {len(missing)} token ids; asking again", stacklevel=2)
        size = min(ceiling, math.ceil(size * growth))


_GRAPH_FIELDS = ", ".join(GRAPH.split(", ")[2:])
_UNIT_FIELDS = "id string, syntactic_type string, semantic_type string"
RESULT = f"doc_id string, sent_idx int, reasoning string, tokengraph array<struct<{_GRAPH_FIELDS}>>, verbalunits array<struct<{_UNIT_FIELDS}>>, missing array<string>, attempts array<int>"


def results(tokens: DataFrame, analyser: Analyser, **retry: Any) -> DataFrame:
    """One row a sentence with all that the analyser gave: reasoning, tokengraph, verbalunits, missing ids, budgets tried.

    tokens: doc_id, sent_idx, pos, id, text. The passage given to the analyser is the tokens joined by blanks. Sentences
    are independent of one another, so any document spreads over all tasks.
    """
    sentences = tokens.groupBy("doc_id", "sent_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "text"))).alias("t"))
    names, unit = [c.split()[0] for c in _GRAPH_FIELDS.split(", ")], [c.split()[0] for c in _UNIT_FIELDS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, k, t in zip(part["doc_id"], part["sent_idx"], part["t"]):
                given = [(x["id"], x["text"]) for x in t]
                got = with_retry(analyser, " ".join(x or "" for _, x in given), given, **retry)
                listed = lambda key, fields: [{c: r.get(c) for c in fields} for r in got.get(key) or []]  # noqa: B023, E731
                rows.append((doc, k, got.get("reasoning"), listed("tokengraph", names), listed("verbalunits", unit), got["missing"], got["attempts"]))
            yield pd.DataFrame(rows, columns=["doc_id", "sent_idx", "reasoning", "tokengraph", "verbalunits", "missing", "attempts"])

    return sentences.mapInPandas(run, RESULT)


def analyse(tokens: DataFrame, analyser: Analyser, **retry: Any) -> DataFrame:
    """Token graph rows of all sentences (doc_id, sent_idx, k and the graph's columns; k is the place in its sentence)."""
    return graph_rows(results(tokens, analyser, **retry))


def graph_rows(told: DataFrame) -> DataFrame:
    """The graph rows of `results`: doc_id, sent_idx, k and the graph's columns."""
    return told.select("doc_id", "sent_idx", F.posexplode("tokengraph").alias("k", "t")).select("doc_id", "sent_idx", "k", "t.*")


def unit_rows(told: DataFrame) -> DataFrame:
    """The verbal units of `results`: doc_id, sent_idx, k, id and types."""
    return told.select("doc_id", "sent_idx", F.posexplode("verbalunits").alias("k", "u")).select("doc_id", "sent_idx", "k", "u.*")


class Analysed(NamedTuple):
    """What `analyse_sources` gives: tokens, one row of results a sentence, the graph and the units of whole documents, problems."""

    tokens: DataFrame
    results: DataFrame
    graph: DataFrame
    units: DataFrame
    problems: DataFrame


def analyse_sources(sources: DataFrame, analyser: Analyser, segmented: DataFrame | None = None, **retry: Any) -> Analysed:
    """Cited units to tokens, each sentence analysed with bounded retries, and what is wrong with the analyses as rows.

    sources: doc_id, unit_pos, citation, text. segmented: token rows of another segmenter (`segment_by`). The results are
    written once (the analyser is not asked again for each use).
    """
    tokens = cut(segment(sources) if segmented is None else segmented)
    told = cut(results(tokens, analyser, **retry))
    graph = combined(graph_rows(told))
    units = combined(unit_rows(told)).withColumnRenamed("pos", "vu_pos")
    return Analysed(tokens, told, graph, units, validate(tokens, graph, units))


def combined(graph: DataFrame) -> DataFrame:
    """The graphs of a document's sentences as one, with pos in sentence order."""
    from pyspark.sql import Window

    sizes = graph.groupBy("doc_id", "sent_idx").agg(F.max("k").alias("m"))
    past = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("doc_id", "sent_idx", F.coalesce(F.sum(F.col("m") + 1).over(past), F.lit(0)).alias("start"))
    return graph.join(start, ["doc_id", "sent_idx"]).withColumn("pos", (F.col("start") + F.col("k")).cast("int")).drop("start", "k")


def canned(answers: dict[str, list[dict]]) -> Analyser:
    """The offline default: answers looked up by passage; a passage without one gives each token as lexical, unrelated."""

    def look(passage: str, tokens: list[tuple[str, str]], _: int) -> dict[str, Any]:
        return {"tokengraph": answers.get(passage) or [{"id": i, "tokentype": "lexical", "text": t} for i, t in tokens], "finish_reason": "stop"}

    return look
