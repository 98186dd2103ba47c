"""Cited source units to sentences and tokens by rule, the offline form of the segmentation boundary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.functions.scan import scan

# Abbreviations kept whole, enclitics.
ABBREVIATIONS = set("a.d. kal. non. id. f. cos. cn. c. l. m. p. q. sex. sp. ti. t. a. d. ser. cf. sc. v. a.u.c. app. mam.".split())
ENCLITICS = ("que", "ve", "ne")
_PIECE = re.compile(r"[^\s\W_]+(?:\.[^\s\W_]+)*\.?|[^\w\s]|_+")
SEGMENTED = "doc_id string, sent_idx int, pos int, id string, text string, citation string"

Segmenter = Callable[[list[tuple[str, str]]], list[list[tuple[str, str]]]]


def rule_segments(units: list[tuple[str, str]], split_enclitics: bool = False) -> list[list[tuple[str, str]]]:
    """Sentences as lists of (text, citation) from (citation, text) units; a sentence may go on over units.

    A sentence ends at `.`, `?` or `!` that is no part of an abbreviation or initial. With `split_enclitics`, -que and -ve
    are split off words of six letters and more, -ne only off the first word of a question.
    """
    out: list[list[tuple[str, str]]] = [[]]
    for citation, text in units:
        for m in _PIECE.finditer(text):
            t = m.group()
            whole = t.lower() in ABBREVIATIONS or re.fullmatch(r"[A-Z]\.", t)
            parts = [t] if whole or not t.endswith(".") or len(t) == 1 else [t[:-1], "."]
            for p in parts:
                out[-1].append((p, citation))
                if p in ".?!":
                    out.append([])
    done = [s for s in out if s]
    return [_enclitics(s) for s in done] if split_enclitics else done


def _enclitics(sentence: list[tuple[str, str]]) -> list[tuple[str, str]]:
    asks = sentence[-1][0] == "?"
    out = []
    for k, (t, c) in enumerate(sentence):
        end = next((e for e in ENCLITICS if t.lower().endswith(e) and len(t) >= 6 and (e != "ne" or asks and k == 0)), None)
        out += [(t[: -len(end)], c), (end, c)] if end else [(t, c)]
    return out


PLACES = 1 << 24  # tokens that a unit may have


def _units(sources: DataFrame) -> DataFrame:
    rows = sources.where(F.col("doc_id").isNotNull() & F.col("unit_pos").isNotNull())
    return rows.groupBy("doc_id", "unit_pos").agg(F.min(F.struct("citation", F.coalesce("text", F.lit("")).alias("text"))).alias("u")).select("doc_id", "unit_pos", "u.*")


def segment(sources: DataFrame, split_enclitics: bool = False) -> DataFrame:
    """doc_id, sent_idx, pos, id, text, citation: the tokens of each document by `rule_segments`, ids t0, t1, ... over the document.

    sources: doc_id, unit_pos, citation, text; null texts count as empty, repeated units (same doc_id and unit_pos) once,
    units without doc_id or unit_pos not at all. Units are cut into tokens on their own; sentences and places are running
    counts over chunks of units, so no document is one task.
    """

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, unit, citation, text in part.itertuples(index=False):
                tokens = [t for sentence in rule_segments([(citation, text)]) for t, _ in sentence]
                rows += [(doc, unit * PLACES + k, t, citation) for k, t in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=["doc_id", "at", "text", "citation"])

    each = _units(sources).mapInPandas(pieces, "doc_id string, at long, text string, citation string")
    ends = F.col("text").isin(".", "?", "!").cast("int")
    cut_ = scan(each, sums={"_ended": ends}, pos="at", chunk=64 * PLACES).withColumn("sent_idx", (F.col("_ended") - ends).cast("int")).drop("_ended")
    if split_enclitics:
        about = cut_.groupBy("doc_id", "sent_idx").agg(F.min("at").alias("first_at"), (F.max_by("text", "at") == "?").alias("asks"))
        low, long = F.lower("text"), F.length("text") >= 6
        end = F.when(long & low.rlike("(que|ve)$"), F.regexp_extract(low, "(que|ve)$", 1)).when(long & low.endswith("ne") & F.col("asks") & (F.col("at") == F.col("first_at")), "ne")
        own = F.expr("substring(text, length(text) - length(ending) + 1)")
        parts = F.when(F.col("ending").isNull(), F.array("text")).otherwise(F.array(F.expr("substring(text, 1, length(text) - length(ending))"), F.lower(own)))
        cut_ = cut_.join(about, ["doc_id", "sent_idx"]).withColumn("ending", end).select("doc_id", "sent_idx", "at", "citation", F.posexplode(parts).alias("k", "text")).withColumn("at", F.col("at") * 2 + F.col("k")).drop("k")
    one = F.lit(1)
    placed = scan(cut_, sums={"_n": one}, pos="at", chunk=128 * PLACES).withColumn("pos", (F.col("_n") - 1).cast("int"))
    return placed.select("doc_id", "sent_idx", "pos", F.concat(F.lit("t"), F.col("pos").cast("string")).alias("id"), "text", "citation")


def segment_by(sources: DataFrame, segmenter: Segmenter) -> DataFrame:
    """As `segment`, by any segmenter: it gets one document's units in order, so a document is one call and must fit one task."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("unit_pos")
        rows, n = [], 0
        doc = part["doc_id"].iloc[0]
        for k, sentence in enumerate(segmenter([(c, t or "") for c, t in zip(part["citation"], part["text"])])):
            for text, citation in sentence:
                rows.append((doc, k, n, f"t{n}", text, citation))
                n += 1
        return pd.DataFrame(rows, columns=["doc_id", "sent_idx", "pos", "id", "text", "citation"])

    return _units(sources).select("doc_id", "unit_pos", "citation", "text").groupBy("doc_id").applyInPandas(one, SEGMENTED)


def as_source(spark, passage: str, citation: str = "", doc_id: str = "passage") -> DataFrame:  # noqa: ANN001
    """A bare text as a one-unit source."""
    return spark.createDataFrame([(doc_id, 0, citation, passage)], "doc_id string, unit_pos int, citation string, text string")


def sentence_arrays(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_idx, tokens: the nested form of token rows."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "text", "citation")))
    return tokens.groupBy("doc_id", "sent_idx").agg(F.transform(rows, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["citation"].alias("citation"))).alias("tokens"))


def token_rows(sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx, k, id, text, citation: the flat form of nested sentences; k counts inside the sentence."""
    return sentences.select("doc_id", "sent_idx", F.posexplode("tokens").alias("k", "t")).select("doc_id", "sent_idx", "k", "t.*")
