"""Declared schemas and fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The closed vocabularies.
RELATIONS = [
    "unit verb", "subordinating conjunction", "relative pronoun", "subject", "direct object", "predicate", "agent", "auxiliary", "object of preposition", "adverbial", "attributive", "adjectival", "genitive", "dative",
    "ablative", "accusative", "vocative", "direct quote", "aside", "indirect statement", "circumstantial participle", "ablative absolute", "coordinating conjunction", "apposition", "complementary infinitive", "praenomen",
]
TOKENTYPES = ["lexical", "enclitic", "punctuation", "numeral", "praenomen", "abbreviation", "implied sum", "continued discourse"]
SYNTACTIC = ["independent", "dependent", "direct quote", "aside", "indirect statement"]
SEMANTIC = ["transitive active", "transitive passive", "intransitive", "linking verb"]
IMPLIED = ["implied sum", "continued discourse"]
ROOT = "root"
# Fill, stroke and text colour of the eight palette slots, and of implied tokens.
PALETTE = [
    ("#82bbff", "#2a78d6", "#000000"), ("#ffa682", "#eb6834", "#000000"), ("#70ffcc", "#1baf7a", "#000000"), ("#ffd170", "#eda100", "#000000"),
    ("#ff94bc", "#e87ba4", "#000000"), ("#7aff7a", "#008300", "#000000"), ("#a494ff", "#4a3aa7", "#000000"), ("#ff9594", "#e34948", "#000000"),
]
IMPLIED_COLOUR = ("#ffc107", "#7a5200", "#000000")

SOURCES = "doc_id string, unit_pos int, citation string, text string"
TOKENS = "doc_id string, sent_idx int, pos int, id string, text string, citation string"
GRAPH = "doc_id string, pos int, id string, tokentype string, text string, lemma string, verbalunit string, related1 string, relationship1 string, related2 string, relationship2 string"
UNITS = "doc_id string, vu_pos int, id string, syntactic_type string, semantic_type string"
PASSAGES = "path string, row_pos int, urnbase string, citation string, text string"


def vocabulary(spark: SparkSession) -> DataFrame:
    """field, value for every allowed value of the closed fields (43 rows)."""
    rows = [(f, v) for f, vs in (("relationship", RELATIONS), ("tokentype", TOKENTYPES), ("syntactic_type", SYNTACTIC), ("semantic_type", SEMANTIC)) for v in vs]
    return spark.createDataFrame(rows, "field string, value string")
