"""Session helpers shared by all operators: table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. A local one is made where none is set and all tasks run in this process.

    On a cluster executors would not see a local folder, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="vinculum-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so it outlives any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, path) of a path, whatever storage it lies on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    fs, p = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = _files(spark, path)
    with_reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    text = "\n".join(iter(with_reader.readLine, None))
    with_reader.close()
    return text


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there, so that it is there whole or not at all."""
    fs, p = _files(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), "_" + p.getName())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a small input has fewer splits than there are cores; larger inputs are not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
