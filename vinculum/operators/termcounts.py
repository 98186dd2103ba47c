"""Occurrences and document counts of every distinct term, kept up to date by signed deltas.

Two levels of state: pairs (field, term, doc_id, occurrences), of which a delta touches only its own, and terms (field,
term, occurrences, documents). A delta is a multiset of records with weight +1 (added) or -1 (deleted); a changed record
is its old version with -1 and the new one with +1. A term's document count moves where a pair's occurrences leave or
reach zero. The persistent form is partitioned by a hash of the term, and a merge reads only the partitions it touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinculum.runtime import ensure_checkpoint_dir, list_dir, put_text, read_text, remove

PAIR_SCHEMA = "field string, term string, doc_id string, n long"
TERM_SCHEMA = "field string, term string, d_occurrences long, d_documents long"


def record_terms(records: DataFrame, fields: list[str], weight: int = 1) -> DataFrame:
    """One weighted row for each non-null term of each record: field, term, doc_id, w. Empty strings are terms."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("term")) for f in fields])
    return records.select("doc_id", F.explode(each).alias("t")).where("t.term is not null").select("t.field", "t.term", "doc_id", F.lit(weight).cast("long").alias("w"))


def net_pairs(weighted: DataFrame) -> DataFrame:
    """The delta of each (field, term, doc_id); pairs whose changes cancel out are left out."""
    return weighted.groupBy("field", "term", "doc_id").agg(F.sum("w").alias("dn")).where("dn <> 0")


def term_delta(touched: DataFrame) -> DataFrame:
    """Signed change of each term: field, term, d_occurrences, d_documents."""
    there = lambda c: (F.col(c) > 0).cast("long")
    return touched.groupBy("field", "term").agg(F.sum(F.col("n") - F.col("before")).alias("d_occurrences"), F.sum(there("n") - there("before")).alias("d_documents"))


def new_store(spark: SparkSession) -> TermCountStore:
    """An empty store in the shared folder of the session."""
    return TermCountStore(spark, f"{ensure_checkpoint_dir(spark)}/termcounts-{uuid.uuid4().hex}")


def count_terms(records: DataFrame, fields: list[str], arrived: str | None = None) -> DataFrame:
    """Counts of a whole table through a store: a first load, then the records that came in the last month as a delta.

    arrived: the column that tells when a record came; without it, all records are the first load. Null terms are none;
    repeated rows count as often as they stand; a null doc_id is one document of its own.
    """
    store = new_store(records.sparkSession)
    if arrived is None:
        store.apply(record_terms(records, fields))
        return store.terms()
    month = records.agg(F.trunc(F.max(arrived), "MM").alias("m")).first().m
    late = F.coalesce(F.col(arrived) >= F.lit(month), F.lit(False)) if month is not None else F.lit(False)
    store.apply(record_terms(records.where(~late), fields))
    store.apply(record_terms(records.where(late), fields))
    return store.terms()


def mark_terms(terms: DataFrame, documents: DataFrame, rare_below: int = 3, common_over: float = 1 / 3) -> DataFrame:
    """Adds mark: `rare` (in fewer than `rare_below` documents), `common` (in more than the share `common_over` of `documents`), else null."""
    total = documents.select(F.countDistinct("doc_id").alias("total")).scalar()
    # compared as whole numbers where the share is a third, so that exactly a third is not common
    over = (F.col("documents") * 3 > total) if common_over == 1 / 3 else (F.col("documents") > total * common_over)
    return terms.select("field", "term", "occurrences", "documents", F.when(F.col("documents") < rare_below, "rare").when(over, "common").alias("mark"))


class TermCountStore:
    """Persistent counts under `path`: layers of signed changes, the pairs partitioned by a hash of the term.

    A layer holds the net change of every touched pair and of every touched term; the state is the sum of the layers, so a
    merge writes what changed and nothing else. The files of a layer are sorted by the term's partition, so a merge reads
    of the pairs before only the row groups of partitions that the delta touches. A pair may stand below zero (a deletion
    that comes before its addition); its document counts while it stands above. After `layers` layers they are added up
    into one. A manifest names the layers that count and is put in place last, so a failed run leaves the earlier state;
    of manifests and layers only the current and those before it are kept. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024, layers: int = 8):
        self.spark, self.path, self.buckets, self.layers = spark, path.rstrip("/"), buckets, layers

    def manifest(self) -> tuple[int, list[str]]:
        """(number, layers) of the current state; (0, []) of an empty store."""
        done = [d for d in list_dir(self.spark, f"{self.path}/manifest") if d.startswith("v")]
        return (int(max(done)[1:]), read_text(self.spark, f"{self.path}/manifest/{max(done)}").split()) if done else (0, [])

    def _commit(self, seq: int, layers: list[str]) -> None:
        put_text(self.spark, f"{self.path}/manifest/v{seq:08d}", "\n".join(layers))
        for d in list_dir(self.spark, f"{self.path}/manifest"):
            if d not in (f"v{seq:08d}", f"v{seq - 1:08d}"):
                remove(self.spark, f"{self.path}/manifest/{d}")

    def _read(self, kind: str, layers: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{x}" for x in layers]) if layers else self.spark.createDataFrame([], schema)

    def _pairs(self, layers: list[str], only: list[int] | None = None) -> DataFrame:
        every = self._read("pairs", layers, f"{PAIR_SCHEMA}, bucket int")
        return (every if only is None else every.where(F.col("bucket").isin(only))).select("field", "term", "doc_id", "n")

    def pairs(self) -> DataFrame:
        """field, term, doc_id, n of the current state; pairs at zero are left out."""
        return self._pairs(self.manifest()[1]).groupBy("field", "term", "doc_id").agg(F.sum("n").alias("n")).where("n <> 0")

    def terms(self) -> DataFrame:
        """field, term, occurrences, documents of the current state; terms that no document holds are left out."""
        summed = self._read("terms", self.manifest()[1], TERM_SCHEMA).groupBy("field", "term").agg(F.sum("d_occurrences").alias("occurrences"), F.sum("d_documents").alias("documents"))
        return summed.where("documents > 0")

    def _write(self, layer: str, pairs: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("field", "term"), F.lit(self.buckets)).cast("int")
        pairs.withColumn("bucket", bucket).sortWithinPartitions("bucket").write.parquet(f"{self.path}/pairs/{layer}")

    def apply(self, weighted: DataFrame) -> DataFrame:
        """Merges weighted terms (see `record_terms`); returns the signed change of each term."""
        seq, layers = self.manifest()
        layer = f"{seq + 1:08d}-{uuid.uuid4().hex[:8]}"
        self._write(layer, net_pairs(weighted).withColumnRenamed("dn", "n"))
        k = ["field", "term", "doc_id"]
        new = self._read("pairs", [layer], f"{PAIR_SCHEMA}, bucket int")
        if layers:
            hit = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
            zero = F.lit(0).cast("long")
            both = self._pairs(layers, hit).select(*k, F.col("n").alias("before"), zero.alias("dn")).unionByName(new.select(*k, zero.alias("before"), F.col("n").alias("dn")))
            summed = both.groupBy(*k).agg(F.sum("before").alias("before"), F.sum("dn").alias("dn")).where("dn <> 0")  # a layer holds no pair without change
            touched = summed.select(*k, "before", (F.col("before") + F.col("dn")).alias("n"))
        else:
            touched = new.select(*k, F.lit(0).cast("long").alias("before"), "n")
        term_delta(touched).write.parquet(f"{self.path}/terms/{layer}")
        self._commit(seq + 1, [*layers, layer])
        if len(layers) + 1 > self.layers:
            self.compact()
        return self._read("terms", [layer], TERM_SCHEMA)

    def compact(self) -> None:
        """Adds all layers up into one; those that neither this state nor the one before names are removed."""
        seq, layers = self.manifest()
        layer = f"{seq + 1:08d}-{uuid.uuid4().hex[:8]}"
        self._write(layer, self.pairs())
        term_delta(self._pairs([layer]).select("field", "term", "doc_id", F.lit(0).cast("long").alias("before"), "n")).write.parquet(f"{self.path}/terms/{layer}")
        self._commit(seq + 1, [layer])
        for kind in ("pairs", "terms"):
            for d in list_dir(self.spark, f"{self.path}/{kind}"):
                if d not in {layer, *layers}:
                    remove(self.spark, f"{self.path}/{kind}/{d}")
