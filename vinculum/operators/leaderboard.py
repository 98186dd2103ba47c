"""Comparison bookkeeping: splits, gates, usage totals and the keyed upsert of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vinculum.functions.scan import scan
from vinculum.operators.checks import guard_same
from vinculum.operators.metric import summary

KEY = ["label", "provider", "stage"]
# The columns of a board.
COLUMNS = ["label", "provider", "model", "family", "tier", "stage", "n", "mean", "min", "max", "field_mean", "relation_mean", "vu_mean", "elapsed_s", "n_calls", "total_cost", "error"]
# Order of the stages.
STAGES = {"baseline": 0, "gepa": 1, "bootstrap": 2, "skipped": 3}
SCHEMA = "label string, provider string, model string, family string, tier string, stage string, n int, mean double, min double, max double, field_mean double, relation_mean double, vu_mean double, elapsed_s double, n_calls int, total_cost double, error string"


def split(examples: DataFrame, held_out: DataFrame, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """(train, held out) by membership of `key`; RuntimeError for a held-out key that no example has."""
    guard_same(held_out, examples, key, f"held-out {key}")
    return examples.join(held_out.select(key).distinct(), key, "left_anti"), examples.join(held_out.select(key).distinct(), key, "left_semi")


def choose(rows: DataFrame, labels: DataFrame, key: str = "label", limit: int | None = None, order: str = "rank") -> DataFrame:
    """The rows of the chosen labels, the first `limit` of them by `order`; RuntimeError for an unknown label."""
    guard_same(labels, rows, key, key)
    kept = rows.join(labels.select(key).distinct(), key, "left_semi")
    return kept if limit is None else kept.orderBy(order, key).limit(limit)


def pick(rows: DataFrame, chosen: DataFrame, key: str, order: str) -> DataFrame:
    """The chosen rows in the order of their file, with its place among them (`picked`, from 0), whatever order they were chosen in."""
    kept = rows.join(chosen.select(key).distinct(), key, "left_semi")
    return scan(kept, sums={"_n": F.lit(1)}, key="path", pos=order).withColumn("picked", (F.col("_n") - 1).cast("int")).drop("_n")


def run_summary(scored: DataFrame, calls: DataFrame, elapsed_s: float, since: int = 0) -> DataFrame:
    """One row: the summary of scores (slug, error and the scores), the calls after a mark, the time taken, problems by slug, and its line of text.

    problems: a map of slug to error of the examples that failed, which count as 0 everywhere.
    """
    failed = scored.where(F.col("error").isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slug", "error")))).alias("problems"))
    row = summary(scored).crossJoin(usage_totals(calls, since)).crossJoin(failed).withColumn("elapsed_s", F.lit(float(elapsed_s)))  # each is one row
    cost = F.when(F.col("total_cost").isNotNull(), F.format_string(", $%.4f", "total_cost")).otherwise("")
    line = F.format_string("mean=%.3f  min=%.3f  max=%.3f  fields=%.3f  relations=%.3f  verbal-expr=%.3f  (%.1fs, %d calls%s)", "mean", "min", "max", "field_mean", "relation_mean", "vu_mean", "elapsed_s", "n_calls", cost)
    return row.withColumn("line", line)


def upsert(old: DataFrame, new: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of both by (label, provider, stage), new over old, with place: candidates' order, then stage, others last by label.

    candidates: label, rank. Of repeated keys in one input one row is kept, the greatest by its values.
    """
    both = old.select(*COLUMNS, F.lit(0).alias("w")).unionByName(new.select(*COLUMNS, F.lit(1).alias("w")))
    rest = [c for c in COLUMNS if c not in KEY]
    kept = both.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("w", *rest)).alias("v")).select(*KEY, "v.*").select(*COLUMNS)
    rank = F.try_element_at(F.create_map(*[F.lit(x) for p in STAGES.items() for x in p]), F.col("stage"))
    ranked = kept.join(candidates.select("label", "rank"), "label", "left")
    return ranked.withColumn("order_key", F.struct(F.coalesce("rank", F.lit(1 << 30)).alias("candidate"), F.when(F.col("rank").isNull(), F.col("label")).otherwise("").alias("name"), F.coalesce(rank, F.lit(4)).alias("step"))).drop("rank")


def gate(current: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """label, provider, baseline, go: whether the optimising stages run; the stored baseline counts where there is no current one, and without either they run."""
    base = lambda df, n: df.where(F.col("stage") == "baseline").select("label", "provider", F.col("mean").alias(n))
    both = base(current, "now").join(base(stored, "before"), ["label", "provider"], "full_outer").withColumn("baseline", F.coalesce("now", "before"))
    return both.select("label", "provider", "baseline", (F.col("baseline").isNull() | (F.col("baseline") >= threshold)).alias("go"))


def usage_totals(calls: DataFrame, since: int = 0) -> DataFrame:
    """n_calls and total_cost (null if none is reported) of the calls after a mark: seq, cost."""
    return calls.where(F.col("seq") > since).agg(F.count(F.lit(1)).alias("n_calls"), F.sum("cost").alias("total_cost"))


def read_board(spark, path: str) -> DataFrame:  # noqa: ANN001
    """The stored results (CSV with header); empty where there is no file."""
    try:
        return spark.read.csv(path, header=True, schema=SCHEMA, enforceSchema=False)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], SCHEMA)
        raise


def write_board(rows: DataFrame, path: str) -> None:
    """One CSV file in the order of the board; it has a row a candidate and stage."""
    rows.orderBy("order_key").drop("order_key").coalesce(1).write.mode("overwrite").csv(path, header=True)
