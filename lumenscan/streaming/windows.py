"""Statistics of streams by window: the mergeable ones of the profile, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_profile(df: DataFrame, time: str, value: str, by: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, group, n, mean, std, min, max, zeros, negatives; works on a stream and on a table alike."""
    v, at = F.col(value), F.col(time).cast("timestamp")
    data = df.select(at.alias("_t"), F.col(by).alias("group"), v.alias("v"))
    data = data.withWatermark("_t", late) if df.isStreaming else data
    return data.groupBy(F.window("_t", window).alias("w"), "group").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(F.col("v") == 0).alias("zeros"), F.count_if(F.col("v") < 0).alias("negatives"),
    ).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "group", "n", "mean", "std", "min", "max", "zeros", "negatives")
