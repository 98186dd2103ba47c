"""Scores of predicted analyses against gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.functions.scan import join_in_order
from vinculum.functions.text import safe_ratio
from vinculum.operators.graph import edge_triples

WEIGHTS = (0.2, 0.5, 0.3)
GRAPH_FIELDS = ["tokentype", "text", "lemma", "verbalunit", "related1", "relationship1", "related2", "relationship2"]


def _one(df: DataFrame, keys: list[str], order: str, fields: list[str], last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*fields), order).alias("v")).select(*keys, "v.*")


def token_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Full outer join by (doc_id, id): doc_id, id, g, p (structs; null where a side has none).

    Of repeated ids the last gold row and the first predicted row count.
    """
    g = _one(gold, ["doc_id", "id"], "pos", GRAPH_FIELDS, True).select("doc_id", "id", F.struct(*GRAPH_FIELDS).alias("g"))
    p = _one(pred, ["doc_id", "id"], "pos", GRAPH_FIELDS, False).select("doc_id", "id", F.struct(*GRAPH_FIELDS).alias("p"))
    return g.join(p, ["doc_id", "id"], "full_outer")


def triple_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Full outer join of the distinct relation triples: doc_id, src, label, dst, in_gold, in_pred."""
    once = lambda df, last: edge_triples(_one(df, ["doc_id", "id"], "pos", ["pos", *GRAPH_FIELDS], last))
    key = ["doc_id", "src", "label", "dst"]
    both = once(gold, True).withColumn("in_gold", F.lit(True)).join(once(pred, False).withColumn("in_pred", F.lit(True)), key, "full_outer")
    return both.select(*key, F.coalesce("in_gold", F.lit(False)).alias("in_gold"), F.coalesce("in_pred", F.lit(False)).alias("in_pred"))


def unit_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Full outer join of the units by (doc_id, id): doc_id, id, g, p; the last row of repeated ids counts."""
    f = ["syntactic_type", "semantic_type"]
    side = lambda df, n: _one(df, ["doc_id", "id"], "vu_pos", f, True).select("doc_id", "id", F.struct(*f).alias(n))
    return side(gold, "g").join(side(pred, "p"), ["doc_id", "id"], "full_outer")


def scores(gold: DataFrame, pred: DataFrame, gold_units: DataFrame, pred_units: DataFrame) -> DataFrame:
    """doc_id, field_score, relation_score, vu_score, score for each gold document.

    Fields: token type and unit of every gold token, the lemma where gold has one; a missing token costs two. Relations:
    the Jaccard index of the triple sets. Units: two points each; extra units and tokens cost nothing. A part with
    nothing to score is 1.
    """
    t = token_pairs(gold, pred).where("g is not null")
    same = lambda f: F.col(f"g.{f}").eqNullSafe(F.col(f"p.{f}")).cast("int")
    there, lemma = F.col("p").isNotNull(), F.col("g.lemma").isNotNull()
    fields = t.groupBy("doc_id").agg(
        F.sum(F.when(there, F.lit(2) + lemma.cast("int")).otherwise(2)).alias("f_all"),
        F.sum(F.when(there, same("tokentype") + same("verbalunit") + F.when(lemma, same("lemma")).otherwise(0)).otherwise(0)).alias("f_ok"),
    )
    r = triple_pairs(gold, pred).groupBy("doc_id").agg(F.count(F.lit(1)).alias("r_all"), F.count_if(F.col("in_gold") & F.col("in_pred")).alias("r_ok"))
    u = unit_pairs(gold_units, pred_units).where("g is not null")
    points = F.when(F.col("p").isNotNull(), (F.col("g.syntactic_type").eqNullSafe(F.col("p.syntactic_type"))).cast("int") + (F.col("g.semantic_type").eqNullSafe(F.col("p.semantic_type"))).cast("int")).otherwise(0)
    vu = u.groupBy("doc_id").agg((F.count(F.lit(1)) * 2).alias("v_all"), F.sum(points).alias("v_ok"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    parts = fields.join(r, "doc_id", "left").join(vu, "doc_id", "left").select("doc_id", *[safe_ratio(z(f"{k}_ok"), z(f"{k}_all")).alias(n) for k, n in (("f", "field_score"), ("r", "relation_score"), ("v", "vu_score"))])
    return parts.withColumn("score", F.col("field_score") * WEIGHTS[0] + F.col("relation_score") * WEIGHTS[1] + F.col("vu_score") * WEIGHTS[2])


def problems(gold: DataFrame, pred: DataFrame, gold_units: DataFrame, pred_units: DataFrame) -> DataFrame:
    """doc_id, section, ord, code, message: what differs, in the order a report lists it (ids in order inside a section)."""
    show = lambda c: F.coalesce(F.concat(F.lit("'"), F.col(c), F.lit("'")), F.lit("None"))
    t = token_pairs(gold, pred)
    who = F.concat(F.lit("token "), F.col("id"), F.lit(" ("), show("g.text"), F.lit(")"))
    found = [
        pred.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(0).alias("section"), F.col("id").alias("ord"), F.lit("repeated_id").alias("code"), F.concat(F.lit("tokengraph has more than one entry for id '"), "id", F.lit("' (only the first is scored)")).alias("message")),
        t.where("p is null").select("doc_id", F.lit(1), "id", F.lit("missing_token"), F.concat(who, F.lit(" is missing from tokengraph entirely"))),
        t.where("g is null").select("doc_id", F.lit(2), "id", F.lit("extra_token"), F.concat(F.lit("tokengraph has an entry for an id not in the input tokens: "), "id")),
    ]
    for f, name in (("tokentype", "tokentype"), ("verbalunit", "verbalunitid"), ("lemma", "lemma")):
        wrong = t.where(F.col("g").isNotNull() & F.col("p").isNotNull() & ~F.col(f"g.{f}").eqNullSafe(F.col(f"p.{f}")) & (F.col("g.lemma").isNotNull() if f == "lemma" else F.lit(True)))
        found.append(wrong.select("doc_id", F.lit(1), "id", F.lit(f"wrong_{f}"), F.concat(who, F.lit(f": expected {name}="), show(f"g.{f}"), F.lit(", got "), show(f"p.{f}"))))
    r = triple_pairs(gold, pred).where("in_gold <> in_pred")
    texts = t.select("doc_id", F.col("id").alias("src"), F.col("g.text").alias("gtext"), F.col("p.text").alias("ptext"))
    r = r.join(texts, ["doc_id", "src"], "left")
    triple = F.concat_ws("|", "src", "label", "dst")
    found.append(r.where("in_gold").select("doc_id", F.lit(3), triple, F.lit("missing_relation"), F.concat(F.lit("token "), "src", F.lit(" ("), show("gtext"), F.lit(") is missing the relation '"), "label", F.lit("' -> "), "dst")))
    found.append(r.where("in_pred").select("doc_id", F.lit(4), triple, F.lit("extra_relation"), F.concat(F.lit("token "), "src", F.lit(" ("), show("ptext"), F.lit(") has an unexpected relation '"), "label", F.lit("' -> "), "dst", F.lit(" not in the gold answer"))))
    u = unit_pairs(gold_units, pred_units)
    at = F.concat(F.lit("verbal expression at "), F.col("id"))
    found.append(u.where("p is null").select("doc_id", F.lit(5), "id", F.lit("missing_unit"), F.concat(at, F.lit(" is missing from verbalunits entirely"))))
    for f in ("syntactic_type", "semantic_type"):
        found.append(u.where(F.col("g").isNotNull() & F.col("p").isNotNull() & ~F.col(f"g.{f}").eqNullSafe(F.col(f"p.{f}"))).select("doc_id", F.lit(5), "id", F.lit(f"wrong_{f}"), F.concat(at, F.lit(f": expected {f}="), show(f"g.{f}"), F.lit(", got "), show(f"p.{f}"))))
    found.append(u.where("g is null").select("doc_id", F.lit(6), "id", F.lit("extra_unit"), F.concat(at, F.lit(" is not anchored on a gold verbal expression"))))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def feedback(scored: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, feedback: the scores and the list of problems as one text."""
    lists = told.groupBy("doc_id").agg(join_in_order(F.col("message"), F.struct("section", "ord", "code"), "\n- ").alias("list"))
    head = F.concat(F.lit("Score "), F.format_string("%.2f", "score"), F.lit(" (fields "), F.format_string("%.2f", "field_score"), F.lit(", relations "), F.format_string("%.2f", "relation_score"), F.lit(", verbal expressions "), F.format_string("%.2f", "vu_score"), F.lit("). Problems found:\n- "))
    clean = F.lit("Perfect match with the gold analysis: every token's fields, relations, and verbal-expression classification are correct.")
    return scored.join(lists, "doc_id", "left").select("doc_id", F.when(F.col("list").isNull(), clean).otherwise(F.concat(head, "list")).alias("feedback"))


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, mean, min, max, field_mean, relation_mean, vu_mean of scores; a failed example (null score) counts as 0 everywhere."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(z("score")).alias("mean"), F.min(z("score")).alias("min"), F.max(z("score")).alias("max"), F.avg(z("field_score")).alias("field_mean"), F.avg(z("relation_score")).alias("relation_mean"), F.avg(z("vu_score")).alias("vu_mean")
    )
