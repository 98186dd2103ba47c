"""Queries of the language-model text operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.llm import bpe, leaks, normalise, residue, sentences
from vinculum.runtime import spread, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    passages = table(spark, d, "ctsdata").select(F.lit("ctsdata").alias("rec_table"), F.col("path").alias("rec_doc"), F.col("row_pos").cast("string").alias("rec_id"), "text")
    return passages.unionByName(table(spark, d, "tokens").select(F.lit("tokens").alias("rec_table"), F.col("doc_id").alias("rec_doc"), F.col("id").alias("rec_id"), "text"))


def _documents(spark: SparkSession, d: str, spread_small: bool = True) -> DataFrame:
    """The documents; spread_small: over all cores where the table has fewer splits than there are cores."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return spread(docs) if spread_small else docs


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise.not_in_form(_texts(spark, d)).select("rec_table", "rec_doc", "rec_id").distinct()


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, d).select("rec_table", "rec_doc", "rec_id", normalise.normalised(t).alias("form"), normalise.comparison_key(t).alias("compare_key"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "sources").select("doc_id", F.col("unit_pos").alias("rec_pos"), F.col("text").alias("body"))
    rows = table(spark, d, "sentences").select("doc_id", F.col("sent_idx").alias("rec_pos"), F.col("tokens.text").alias("body"))
    return sentences.find_ends(texts, "sources", False).unionByName(sentences.find_ends(rows, "sentences", True))


def p7_ids(spark: SparkSession, d: str, spread_small: bool = True) -> DataFrame:
    return bpe.encode_documents(_documents(spark, d, spread_small))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_documents(spark, d), table(spark, d, "gold_examples"))


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_documents(spark, d), table(spark, d, "gold_examples"), detail=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(_documents(spark, d))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.join(residue.residue_documents(docs), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


def p9_validation(spark: SparkSession, d: str) -> DataFrame:
    return residue.validation(_documents(spark, d))


QUERIES = {f.__name__: f for f in (p4_found, p4_forms, p6_found, p7_ids, p8_found, p8_stretches, p9_found, p9_kept, p9_validation)}
SQL: dict[str, str] = {}
