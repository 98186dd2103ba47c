"""Running values along a document that do not put a whole document into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, key: str = "doc_id", pos: str = "pos", chunk: int = 4096) -> DataFrame:
    """Adds running sums (the row itself counted) and the last non-null value strictly before each row.

    Values run inside chunks of `chunk` positions, and over one summary row a chunk; so one document with a third of all
    rows is many tasks. Rows of the same key must differ in pos; ties are ordered arbitrarily. Null keys form one group.
    """
    sums, lasts = sums or {}, lasts or {}
    rows = df.withColumn("_c", F.floor(F.col(pos) / chunk)).withColumns({f"_v_{n}": e for n, e in {**sums, **lasts}.items()})
    inside = Window.partitionBy(key, "_c").orderBy(pos)
    to_here, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(to_here) for n in sums} | {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(before) for n in lasts})
    whole = rows.groupBy(key, "_c").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums], *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(pos))).alias(f"_s_{n}") for n in lasts]
    )
    past = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = whole.select(F.col(key).alias("_key"), F.col("_c").alias("_d"), *[F.sum(f"_s_{n}").over(past).alias(f"_p_{n}") for n in sums], *[F.last(f"_s_{n}", ignorenulls=True).over(past).alias(f"_p_{n}") for n in lasts])
    joined = local.join(carry, local[key].eqNullSafe(carry["_key"]) & (local["_c"] == carry["_d"]))
    out = joined.withColumns({n: F.col(f"_l_{n}") + F.coalesce(f"_p_{n}", F.lit(0)) for n in sums} | {n: F.coalesce(f"_l_{n}", f"_p_{n}") for n in lasts})
    return out.select(*df.columns, *sums, *lasts)


def join_in_order(piece: Column, order: Column | str, sep: str) -> Column:
    """Aggregate: the pieces in order of `order`, joined by `sep`."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"), piece.alias("p"))))
    return F.array_join(F.transform(pairs, lambda x: x["p"]), sep)


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """The literal replacements one after another."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
LABEL = [('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")]
