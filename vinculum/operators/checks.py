"""Checks of analyses: ids, contiguity, contexts, fields; every problem is a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinculum.functions.text import is_illegal, quoted
from vinculum.schemas import IMPLIED, ROOT


def validate(tokens: DataFrame, graph: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, phase, ord, sub, code, message: what is wrong in an analysis of `tokens`; in that order for a document.

    tokens: doc_id, id; graph: a token graph; units: doc_id, vu_pos, id. Not checked: duplicate ids, missing tokens
    (`missing_tokens`), labels without a target.
    """
    known_in = tokens.select("doc_id", "id").distinct()
    implied = F.col("tokentype").isin(IMPLIED)
    known = known_in.unionByName(graph.where(implied).select("doc_id", "id")).distinct()
    g = graph.join(known_in.withColumn("given", F.lit(True)), ["doc_id", "id"], "left")
    given, q = F.col("given").isNotNull(), quoted(F.col("id"))
    problem = lambda k, code, when, *text: F.when(when, F.struct(F.lit(k).alias("sub"), F.lit(code).alias("code"), F.concat(*text).alias("message")))
    entry = F.concat(F.lit("tokengraph entry "), q)
    is_type = F.concat(F.lit(" is tokentype="), quoted(F.col("tokentype")), F.lit(" but "))
    rows = F.array_compact(F.array(
        problem(0, "reused_id", implied & given, entry, is_type, F.lit("reuses an id already in the input `tokens` list -- an implied token must use a new id")),
        problem(1, "implied_text", implied & F.col("text").isNotNull(), entry, is_type, F.lit("has a non-None token value "), quoted(F.col("text")), F.lit(" -- an implied token's text must be left unset")),
        problem(2, "unknown_id", ~implied & ~given, F.lit("tokengraph entry has unknown id "), q),
        problem(3, "no_text", ~implied & F.col("text").isNull(), entry, F.lit(" has token=None but tokentype="), quoted(F.col("tokentype")), F.lit(" -- only 'implied sum'/'continued discourse' may omit surface text")),
    ))
    own = g.select("doc_id", F.lit(1).alias("phase"), F.col("pos").alias("ord"), F.explode(rows).alias("p")).select("doc_id", "phase", "ord", "p.*")
    slots = F.array(*[F.struct(F.lit(3 + k).alias("sub"), F.lit(f"relatedtoken{k}").alias("field"), F.col(f"related{k}").alias("target")) for k in (1, 2)])
    refs = graph.select("doc_id", "pos", "id", F.explode(slots).alias("s")).where((F.col("s.target").isNotNull()) & (F.col("s.target") != ROOT)).select("doc_id", "pos", F.col("id").alias("src"), "s.*")
    lost = refs.join(known.withColumnRenamed("id", "target"), ["doc_id", "target"], "left_anti").select(
        "doc_id", F.lit(1).alias("phase"), F.col("pos").alias("ord"), "sub", F.lit("unknown_target").alias("code"),
        F.concat(F.lit("token "), quoted(F.col("src")), F.lit(" "), "field", F.lit("="), quoted(F.col("target")), F.lit(" is not a known token id")).alias("message"),
    )
    vus = units.join(known, ["doc_id", "id"], "left_anti").select("doc_id", F.lit(2).alias("phase"), F.col("vu_pos").alias("ord"), F.lit(0).alias("sub"), F.lit("unknown_unit").alias("code"), F.concat(F.lit("verbal expression id "), q, F.lit(" is not a known token id")).alias("message"))
    root = known_in.where(F.col("id") == ROOT).select("doc_id", F.lit(0).alias("phase"), F.lit(0).alias("ord"), F.lit(0).alias("sub"), F.lit("root_id").alias("code"), F.lit("token id 'root' is reserved as the sentinel relatedtoken1 value for independent verbs and must not be assigned to an actual token").alias("message"))
    return root.unionByName(own).unionByName(lost).unionByName(vus)


def raise_first(problems: DataFrame) -> None:
    """Strict form of a check: ValueError with the first problem by (doc_id, phase, ord, sub)."""
    first = problems.orderBy("doc_id", "phase", "ord", "sub").limit(1).collect()
    if first:
        raise ValueError(first[0].message)


def missing_tokens(tokens: DataFrame, graph: DataFrame) -> DataFrame:
    """doc_id, id: given tokens that the analysis has not."""
    return tokens.select("doc_id", "id").distinct().join(graph.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def illegal_fields(graph: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, pos, field, value: values that a block file cannot hold (a bar or a line break)."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    return graph.select("doc_id", "pos", F.explode(each).alias("f")).select("doc_id", "pos", "f.*").where(is_illegal(F.col("value")))


def sentence_bounds(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_idx, first_id, last_id, n, begin_context, end_context of each sentence of token rows."""
    first, last = lambda c: F.min_by(c, "pos"), lambda c: F.max_by(c, "pos")
    return tokens.groupBy("doc_id", "sent_idx").agg(first("id").alias("first_id"), last("id").alias("last_id"), F.count(F.lit(1)).alias("n"), first("citation").alias("begin_context"), last("citation").alias("end_context"))


def sentence_spans(bounds: DataFrame, graph: DataFrame) -> DataFrame:
    """The bounds with start_pos and end_pos, the places of the boundary tokens in the graph; null where one is not in it."""
    at = graph.select("doc_id", "id", "pos")
    return bounds.join(at.select("doc_id", F.col("id").alias("first_id"), F.col("pos").alias("start_pos")), ["doc_id", "first_id"], "left").join(
        at.select("doc_id", F.col("id").alias("last_id"), F.col("pos").alias("end_pos")), ["doc_id", "last_id"], "left"
    )


def in_spans(graph: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """Graph rows with the sent_idx of each sentence whose span holds them: a range join, by buckets of positions."""
    cut = spans.where(F.col("start_pos") <= F.col("end_pos")).select("doc_id", "sent_idx", "start_pos", "end_pos", F.explode(F.sequence(F.floor(F.col("start_pos") / bucket), F.floor(F.col("end_pos") / bucket))).alias("_b"))
    return graph.withColumn("_b", F.floor(F.col("pos") / bucket)).join(cut, ["doc_id", "_b"]).where(F.col("pos").between(F.col("start_pos"), F.col("end_pos"))).drop("_b", "start_pos", "end_pos")


def contiguity(tokens: DataFrame, graph: DataFrame) -> DataFrame:
    """doc_id, sent_idx, code: sentences that are no contiguous run of the graph (`boundary_missing`, `not_contiguous`)."""
    spans = sentence_spans(sentence_bounds(tokens), graph)
    real = in_spans(graph.where(~F.col("tokentype").isin(IMPLIED)), spans)
    ids = lambda df: df.groupBy("doc_id", "sent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    want, got = ids(tokens), ids(real).withColumnRenamed("ids", "found")
    both = spans.join(want, ["doc_id", "sent_idx"]).join(got, ["doc_id", "sent_idx"], "left")
    missing = F.col("start_pos").isNull() | F.col("end_pos").isNull()
    return both.select("doc_id", "sent_idx", F.when(missing, "boundary_missing").when(~F.col("ids").eqNullSafe(F.coalesce("found", F.array().cast("array<string>"))), "not_contiguous").alias("code")).where("code is not null")


def split_by_sentence(tokens: DataFrame, graph: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph rows, units) of each sentence: the rows between its boundary tokens, and the units that stand on them."""
    slices = in_spans(graph, sentence_spans(sentence_bounds(tokens), graph))
    return slices, units.join(slices.select("doc_id", "id", "sent_idx"), ["doc_id", "id"])


def context_mismatches(units: DataFrame, graph: DataFrame) -> DataFrame:
    """doc_id, id, declared, actual: units whose declared context is not that of their token (null-safe)."""
    both = units.select("doc_id", "id", F.col("context").alias("declared")).join(graph.select("doc_id", "id", F.col("context").alias("actual")), ["doc_id", "id"])
    return both.where(~F.col("declared").eqNullSafe(F.col("actual")))


def guard_same(given: DataFrame, allowed: DataFrame, column: str, what: str) -> None:
    """RuntimeError if `given` holds values of `column` that `allowed` has not (anti-join guard)."""
    stray = given.select(column).distinct().join(allowed.select(column), column, "left_anti").limit(5).collect()
    if stray:
        raise RuntimeError(f"unknown {what}: {sorted(r[0] for r in stray)}")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
