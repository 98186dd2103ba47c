"""Block files and other texts from analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.functions.scan import join_in_order
from vinculum.functions.text import encode_field
from vinculum.operators import checks, render
from vinculum.schemas import IMPLIED
from vinculum.sources.blocks import ANALYSIS


def analysis_lines(tokens: DataFrame, units: DataFrame, graph: DataFrame) -> DataFrame:
    """doc_id, section, ord, line: the lines of each document's analysis file; in that order they are the file.

    tokens: doc_id, sent_idx, pos, id, citation; contexts come from it, and are empty for what it has not.
    """
    f = lambda *cols: F.concat_ws("|", *[encode_field(F.col(c)) for c in cols])
    cite = tokens.groupBy("doc_id", "id").agg(F.max_by("citation", "pos").alias("cited"))
    docs = graph.select("doc_id").union(tokens.select("doc_id")).distinct()
    fixed = [(s, k, x) for s, label in ((0, "#!sentences"), (2, "#!verbal_units"), (4, "#!tokens")) for k, x in enumerate([*([""] if s else []), label, ANALYSIS[label]])]
    heads = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("ord"), F.lit(x).alias("line")) for s, k, x in fixed])).alias("h")).select("doc_id", "h.*")
    sent = checks.sentence_bounds(tokens).select("doc_id", F.lit(1).alias("section"), F.col("sent_idx").alias("ord"), f("begin_context", "first_id", "end_context", "last_id").alias("line"))
    vus = units.join(cite, ["doc_id", "id"], "left").select("doc_id", F.lit(3), F.col("vu_pos"), f("cited", "id", "syntactic_type", "semantic_type"))
    toks = graph.join(cite, ["doc_id", "id"], "left").select("doc_id", F.lit(5), F.col("pos"), f("cited", "id", "tokentype", "text", "lemma", "verbalunit", "related1", "relationship1", "related2", "relationship2"))
    return heads.union(sent).union(vus).union(toks)


def analysis_warnings(tokens: DataFrame, units: DataFrame, graph: DataFrame) -> DataFrame:
    """doc_id, section, ord, code: boundary missing or not contiguous (1), unit (3) or token (5) without a sentence."""
    given = tokens.select("doc_id", "id").distinct()
    implied = graph.where(F.col("tokentype").isin(IMPLIED)).select("doc_id", "id")
    lost_units = units.join(given, ["doc_id", "id"], "left_anti").join(implied, ["doc_id", "id"], "left_anti").select("doc_id", F.lit(3).alias("section"), F.col("vu_pos").alias("ord"), F.lit("unit_without_sentence").alias("code"))
    lost = graph.where(~F.col("tokentype").isin(IMPLIED)).join(given, ["doc_id", "id"], "left_anti").select("doc_id", F.lit(5), F.col("pos"), F.lit("token_without_sentence"))
    return checks.contiguity(tokens, graph).select("doc_id", F.lit(1).alias("section"), F.col("sent_idx").alias("ord"), "code").union(lost_units).union(lost)


def serialise(tokens: DataFrame, units: DataFrame, graph: DataFrame) -> DataFrame:
    """doc_id, content: one file a document. ValueError if a field holds a bar or a line break; nothing is written then."""
    fields = ["id", "tokentype", "text", "lemma", "verbalunit", "related1", "relationship1", "related2", "relationship2"]
    bad = checks.illegal_fields(graph, fields).unionByName(checks.illegal_fields(tokens, ["citation"])).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].field} of row {bad[0].pos} of {bad[0].doc_id!r} holds a bar or a line break: {bad[0].value!r}")
    return analysis_lines(tokens, units, graph).groupBy("doc_id").agg(F.concat(join_in_order(F.col("line"), F.struct("section", "ord"), "\n"), F.lit("\n")).alias("content"))


def write_records(contents: DataFrame, path: str, per_file: int = 100_000) -> None:
    """The texts as records (parquet: doc_id, content) sorted by doc_id, in files of at most `per_file` documents: the form for many documents."""
    contents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", per_file).mode("overwrite").parquet(path)


def save_diagrams(resolved: DataFrame, colours: DataFrame, path: str, orientation: str = "BT", coloured: bool = True) -> DataFrame:
    """Writes the diagram of every document (`write_records`: doc_id, diagram with a line break at its end); returns the warnings of edges left out."""
    drawn = render.mermaid(resolved, colours, orientation, coloured)
    write_records(drawn.withColumn("diagram", F.concat("diagram", F.lit("\n"))), path)
    return render.mermaid_warnings(resolved)


def write_files(contents: DataFrame, path: str, column: str = "content") -> None:
    """One folder a document (doc_id=...) with its text, for a few documents; a trailing line break is written once."""
    contents.select("doc_id", F.rtrim(F.col(column), F.lit("\n")).alias("value")).write.partitionBy("doc_id").mode("overwrite").text(path)


def write_passages(rows: DataFrame, delimiter: str = "|") -> DataFrame:
    """path, content: passage files from rows with path, row_pos, urnbase, citation, text."""
    line = F.concat("urnbase", "citation", F.lit(delimiter), "text")
    body = rows.groupBy("path").agg(join_in_order(line, "row_pos", "\n").alias("body"))
    return body.select("path", F.concat(F.lit(f"#!ctsdata\nurn{delimiter}text\n"), "body", F.lit("\n")).alias("content"))


def harvest(tokens: DataFrame, graph: DataFrame, units: DataFrame, slugs: DataFrame, skip_validation: bool = False) -> DataFrame:
    """slug, passage, tags, answer: analyses as gold examples. ValueError where there is none, or where `validate` finds anything.

    slugs: doc_id, slug, tags and passage (null: the surface text of the graph).
    """
    mine = graph.join(slugs.select("doc_id"), "doc_id", "left_semi")
    if mine.isEmpty():
        raise ValueError("a gold example needs a token graph that is not empty")
    if not skip_validation:
        some = lambda df: df.join(slugs.select("doc_id"), "doc_id", "left_semi")
        checks.raise_first(checks.validate(some(tokens), mine, some(units)))
    texts = render.surface_text(mine)
    return slugs.join(sparse_examples(mine, units), "doc_id").join(texts, "doc_id", "left").select("slug", F.coalesce("passage", "surface").alias("passage"), "tags", "answer")


def sparse_examples(graph: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, answer: a gold example as JSON, optional fields that are null left out, a null text kept."""
    tok = F.struct("id", F.col("text").alias("token"), "tokentype", "lemma", F.col("verbalunit").alias("verbalunitid"), F.col("related1").alias("relatedtoken1"), "relationship1", F.col("related2").alias("relatedtoken2"), "relationship2")
    js = F.when(F.col("text").isNull(), F.regexp_replace(F.to_json(tok), r"^\{", '{"token":null,')).otherwise(F.to_json(tok))
    toks = graph.groupBy("doc_id").agg(join_in_order(js, "pos", ",").alias("t"))
    vus = units.groupBy("doc_id").agg(join_in_order(F.to_json(F.struct("id", "syntactic_type", "semantic_type")), "vu_pos", ",").alias("v"))
    return toks.join(vus, "doc_id", "left").select("doc_id", F.concat(F.lit('{"verbalunits":['), F.coalesce("v", F.lit("")), F.lit('],"tokengraph":['), "t", F.lit("]}")).alias("answer"))
