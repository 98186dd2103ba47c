"""Referential integrity over time: references whose target is missing, deleted or not yet loaded.

Every (document, key) is dictionary-encoded to an integer, `bucket` and a dense `code` inside it. For each key range
(64 codes, one word) and period the referenced keys form one bitmap and the keys that are there form another; only
words with a bit set exist, so the bitmaps are compressed by leaving out empty ranges. Orphans are the bits of
``references AND NOT parents``, decoded back to keys. All of it is built-in expressions: no Python, two shuffles of
pre-aggregated keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinculum.runtime import shuffle_width

WORD = 64


def find_orphans(references: DataFrame, parents: DataFrame, period_format: str = "yyyy-MM", buckets: int | None = None) -> DataFrame:
    """References without a parent that is there when the referring record is loaded.

    references: src_table, doc_id, rec_id, field, target, loaded_at; parents: doc_id, id, loaded_at (only live records,
    one row a key). Result: src_table, period, doc_id, rec_id, field, distinct. A null target is no reference and gives
    no row; a null doc_id matches no parent and is reported as an orphan under doc_id null; a reference with null
    loaded_at is in period null and only a missing parent makes it an orphan; a parent with null loaded_at counts as
    always there. Repeated rows and ties change nothing. Other columns are ignored. Empty tables give an empty result.

    buckets: hash ranges of the dictionary, by default 16 for each shuffle partition, so that one range stays small as
    the cluster is sized to its data.
    """
    spark = references.sparkSession
    buckets = buckets or 16 * shuffle_width(spark)
    # null ids are carried as a flag, since null keys never join
    doc = F.coalesce(F.concat(F.lit("d"), F.col("doc_id")), F.lit("n"))
    refs = references.where(F.col("target").isNotNull()).select(
        "src_table", "doc_id", "rec_id", "field", doc.alias("doc_key"), F.col("target").alias("key"),
        F.coalesce(F.date_format("loaded_at", period_format), F.lit("")).alias("period"), "loaded_at",
    )
    wanted = refs.groupBy("doc_key", "key", "period").agg(F.min("loaded_at").alias("first_ref"))
    there = parents.where(F.col("id").isNotNull() & F.col("doc_id").isNotNull()).select(doc.alias("doc_key"), F.col("id").alias("key"), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz").cast(parents.schema["loaded_at"].dataType)).alias("parent_at"))

    events = wanted.select("doc_key", "key", F.struct("period", "first_ref").alias("ref"), F.lit(None).cast(there.schema["parent_at"].dataType).alias("parent_at")).unionByName(
        there.select("doc_key", "key", F.lit(None).cast("struct<period:string,first_ref:" + wanted.schema["first_ref"].dataType.simpleString() + ">").alias("ref"), "parent_at")
    )
    # one row a key: its parent's time and the periods that refer to it (as many as there are periods)
    keys = events.groupBy("doc_key", "key").agg(F.min("parent_at").alias("parent_at"), F.collect_list("ref").alias("refs")).where(F.size("refs") > 0)
    keys = keys.withColumn("bucket", F.pmod(F.xxhash64("doc_key", "key"), F.lit(buckets)).cast("int"))
    coded = keys.withColumn("code", F.row_number().over(Window.partitionBy("bucket").orderBy("doc_key", "key")) - 1)
    coded = coded.withColumn("word", F.floor(F.col("code") / WORD)).withColumn("bit", F.pmod("code", F.lit(WORD)).cast("int"))

    # a parent loaded inside a period covers it from its first reference on (turn 0, before the references' turn 1), or
    # else only the periods after (turn 2)
    events = F.expr(f"""concat(
        transform(refs, r -> struct(r.period AS period, 1 AS turn)),
        if(parent_at IS NULL, array(), array(struct(date_format(parent_at, '{period_format}') AS period,
            if(exists(refs, r -> r.first_ref < parent_at AND r.period = date_format(parent_at, '{period_format}')), 2, 0) AS turn))))""")
    one, zero = F.expr("shiftleft(1L, bit)"), F.lit(0).cast("long")
    line = (
        coded.select("bucket", "word", "bit", F.explode(events).alias("e"))
        .groupBy("bucket", "word", "e.period", "e.turn")
        .agg(F.bit_or(F.when(F.col("e.turn") == 1, one).otherwise(zero)).alias("ref_bits"), F.bit_or(F.when(F.col("e.turn") == 1, zero).otherwise(one)).alias("parent_bits"))
    )
    # running OR over the periods of a range
    seen = F.bit_or("parent_bits").over(Window.partitionBy("bucket", "word").orderBy("period", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.bit_or("parent_bits").over(Window.partitionBy("bucket", "word"))
    left = line.select("bucket", "word", "period", "turn", "ref_bits", seen.alias("seen"), whole.alias("whole")).where("turn = 1")
    left = left.withColumn("bits", F.col("ref_bits").bitwiseAND(F.bitwise_not(F.when(F.col("period") == "", F.col("whole")).otherwise(F.col("seen"))))).where("bits <> 0")
    surviving = left.select("bucket", "word", "period", F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), b -> (shiftrightunsigned(bits, b) & 1L) = 1L)")).alias("bit"))
    decoded = surviving.join(coded.select("bucket", "word", "bit", "doc_key", "key", "parent_at"), ["bucket", "word", "bit"]).select("doc_key", "key", "period", "parent_at")
    # exact check of the bits that survived: a parent of the same period may precede the later of its references
    return (
        refs.join(decoded, ["doc_key", "key", "period"])
        .where(F.col("parent_at").isNull() | F.col("loaded_at").isNull() | (F.col("parent_at") > F.col("loaded_at")))
        .select("src_table", F.when(F.col("period") != "", F.col("period")).alias("period"), "doc_id", "rec_id", "field")
        .distinct()
    )


def token_references(tokengraph: DataFrame, verbal_units: DataFrame, root: str = "root") -> tuple[DataFrame, DataFrame]:
    """(references, parents) of the two analysis tables, in the form `find_orphans` takes.

    Copies of a record are one record: loaded at the earliest loaded_at, deleted if any copy has deleted_at.
    """
    rec = tokengraph.groupBy("doc_id", "id").agg(
        F.min("loaded_at").alias("loaded_at"), F.max(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.collect_set(F.when(F.col("related1") != root, F.col("related1"))).alias("related1"), F.collect_set("verbalunit").alias("verbalunit"),
    ).where(~F.col("deleted"))
    slots = F.array(F.struct(F.lit("related1").alias("field"), F.col("related1").alias("targets")), F.struct(F.lit("verbalunit").alias("field"), F.col("verbalunit").alias("targets")))
    of_tokens = rec.select("doc_id", F.col("id").alias("rec_id"), "loaded_at", F.explode(slots).alias("s")).select(
        F.lit("tokengraph").alias("src_table"), "doc_id", "rec_id", F.col("s.field").alias("field"), F.explode("s.targets").alias("target"), "loaded_at"
    )
    of_units = (
        verbal_units.where(F.col("token").isNotNull())
        .groupBy("doc_id", "token")
        .agg(F.min("loaded_at").alias("loaded_at"))
        .select(F.lit("verbal_units").alias("src_table"), "doc_id", F.col("token").alias("rec_id"), F.lit("token").alias("field"), F.col("token").alias("target"), "loaded_at")
    )
    return of_tokens.unionByName(of_units), rec.select("doc_id", "id", "loaded_at")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted by src_table, period and field."""
    return orphans.groupBy("src_table", "period", "field").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("doc_id").alias("documents"))
