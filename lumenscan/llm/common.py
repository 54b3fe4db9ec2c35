"""Helpers shared by the training-data operators."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one of our own only where none is set and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenscan-"))
    return sc.getCheckpointDir()


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside lets Spark delete its shuffle files as soon as its result is written; nothing reads them later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage in the shared checkpoint folder, so that a lost executor costs a reread."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    with freeing_shuffles(spark):
        return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a compressed Parquet table in the same shared folder, for rows that hold texts; it stays for the result that reads it."""
    place = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/lumenscan-{uuid.uuid4().hex}"
    with freeing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.parquet(place)


class Workspace:
    """Written tables of one run in the shared folder, in a database that is dropped at the end with all that it holds.

    What leaves the run has to be ``cut`` first.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.name = f"lumenscan_{uuid.uuid4().hex}"
        self._numbers = itertools.count()

    def __enter__(self) -> Workspace:
        place = f"{checkpoint_dir(self.spark).rstrip('/')}/{self.name}"
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{place}'")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")

    def table(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """df, written and read again; dealt out by ``key``, joins on it leave these rows where they are."""
        name = f"{self.name}.t{next(self._numbers)}"
        writer = df.write.format("parquet").option("compression", "zstd")
        if key:
            writer = writer.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)
        with freeing_shuffles(self.spark):
            writer.saveAsTable(name)
        return self.spark.table(name)


def different(rows: DataFrame, value: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """rows with a key _t, 64 bits, and each different value once: _t, the value and _k, its rows, dealt out by _t.

    Values that share their 64 bits by chance are told apart by 64 more, and get other keys.
    """
    rows = rows.withColumn("_t", F.xxhash64(value)).withColumn("_u", F.xxhash64(F.lit(1), value))
    for again in itertools.count(1):
        once = work.table(rows.groupBy("_t").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("_k"), F.min("_u").alias("_low"), F.max("_u").alias("_high")), "_t")
        shared = once.where("_low <> _high").select("_t", F.lit(True).alias("_shared"))
        if shared.isEmpty():
            return rows, once.drop("_low", "_high")
        rows = rows.join(work.table(shared), "_t", "left").withColumn("_t", F.when(F.col("_shared"), F.xxhash64("_u", F.lit(again), "_t")).otherwise(F.col("_t"))).drop("_shared")


def words(text) -> "F.Column":
    """Array of words of a text column; null has none."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def kept_rows(df: DataFrame, condition) -> DataFrame:
    """``df.where(condition)`` with the condition kept above the projection that computes its columns.

    Pushed below, it would repeat their expressions, once for each use, inside lambdas too.  Nothing is pushed
    through a projection that holds a non-deterministic column.
    """
    return df.withColumn("_partition", F.spark_partition_id()).where(condition & (F.col("_partition") >= 0))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
