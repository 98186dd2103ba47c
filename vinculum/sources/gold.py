"""Gold examples: the nested answer as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = {"id": "id", "token": "text", "tokentype": "tokentype", "lemma": "lemma", "verbalunitid": "verbalunit", "relatedtoken1": "related1", "relationship1": "relationship1", "relatedtoken2": "related2", "relationship2": "relationship2"}
ANSWER = "reasoning string, verbalunits array<struct<id string, syntactic_type string, semantic_type string>>, tokengraph array<struct<" + ", ".join(f"{k} string" for k in _TOKEN) + ">>"


def gold_rows(examples: DataFrame, answer: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(graph, units) of gold examples: doc_id (the slug), pos or vu_pos, and the columns of a token graph and of verbal units.

    examples: slug and the answer as JSON, or as the struct it stands for. Keys that are left out, an answer that is null
    and one that is no JSON give NULLs and no rows; extra keys are ignored.
    """
    kind = examples.schema[answer].dataType.typeName()
    told = examples.select(F.col("slug").alias("doc_id"), (F.from_json(answer, ANSWER) if kind == "string" else F.col(answer)).alias("a"))
    tokens = told.select("doc_id", F.posexplode("a.tokengraph").alias("pos", "t"))
    graph = tokens.select("doc_id", "pos", *[F.col("t")[k].alias(c) for k, c in _TOKEN.items()])
    units = told.select("doc_id", F.posexplode("a.verbalunits").alias("vu_pos", "u")).select("doc_id", "vu_pos", "u.id", "u.syntactic_type", "u.semantic_type")
    return graph, units
