"""Transformations and reshaping: encodings, scaling, bins, dates, lags, pivots, joins with diagnostics, rules, export."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from .clean import quantiles, replace_column

MOST_CATEGORIES = 50


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where the frame has such columns."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column for each value, in order; refused beyond 50 values."""
    v = _col(column)
    values = [r[0] for r in df.select(v.alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(MOST_CATEGORIES + 1).collect()]
    if len(values) > MOST_CATEGORIES:
        raise ValueError(f"{column} has more than {MOST_CATEGORIES} values")
    return df.select("*", *[S.yes(v == F.lit(x)).cast("int").alias(f"{column}_{x}") for x in values])


def ordinal(df: DataFrame, column: str, order: Sequence) -> DataFrame:
    code = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(order))):
        code = F.when(_col(column) == F.lit(v), i).otherwise(code)
    return df.withColumn(f"{column}_code", code)


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    (value,) = _free(df, "_v")
    counts = df.groupBy(_col(column).alias(value)).agg(F.count(F.lit(1)).alias(f"{column}_count")).where(F.col(value).isNotNull())
    return df.join(counts, _col(column) == F.col(value), "left").drop(value)


def target_encode(df: DataFrame, column: str, target: str, weight: float = 10.0) -> DataFrame:
    """Mean of the target by value, drawn to the whole mean by ``weight`` rows."""
    (value,) = _free(df, "_v")
    known = df.select(_col(column).alias("v"), _col(target).cast("double").alias("t")).where("t IS NOT NULL")
    whole = known.agg(F.avg("t").alias("m"))
    means = known.where("v IS NOT NULL").groupBy("v").agg(F.sum("t").alias("s"), F.count("t").alias("k")).join(F.broadcast(whole))
    encoded = means.select(F.col("v").alias(value), ((F.col("s") + weight * F.col("m")) / (F.col("k") + weight)).alias(f"{column}_target"))
    return df.join(encoded, _col(column) == F.col(value), "left").drop(value)


def scale(df: DataFrame, column: str, how: str = "standard") -> DataFrame:
    """standard: mean 0 and deviation 1; minmax: 0 to 1; robust: median 0 and interquartile range 1."""
    data = df.select(_col(column).cast("double").alias("v"))
    a, b = _free(df, "_a", "_b")
    if how == "robust":
        q = F.col("q")
        one = quantiles(data, (0.25, 0.5, 0.75)).select(q[1].alias(a), (q[2] - q[0]).alias(b))
    else:
        middle, width = {"standard": (F.avg("v"), F.stddev_samp("v")), "minmax": (F.min("v"), F.max("v") - F.min("v"))}[how]
        one = data.agg(middle.alias(a), width.alias(b))
    scaled = F.try_divide(_col(column).cast("double") - F.col(a), F.nullif(F.col(b), F.lit(0.0)))
    return replace_column(df.join(F.broadcast(one), how="left"), column, scaled).drop(a, b)


def bin_equal_width(df: DataFrame, column: str, bins: int) -> DataFrame:
    v = _col(column).cast("double")
    a, b = _free(df, "_lo", "_hi")
    one = df.agg(F.min(v).alias(a), F.max(v).alias(b))
    low, high = F.col(a), F.col(b)
    which = F.when(v.isNotNull(), F.when(high > low, F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1))).otherwise(F.lit(0)))
    return df.join(F.broadcast(one)).withColumn(f"{column}_bin", which.cast("int")).drop(a, b)


def bin_quantiles(df: DataFrame, column: str, bins: int) -> DataFrame:
    v = _col(column).cast("double")
    (ends,) = _free(df, "_q")
    one = quantiles(df.select(v.alias("v")), [i / bins for i in range(1, bins)]).select(F.col("q").alias(ends))
    which = F.when(v.isNotNull(), F.size(F.filter(ends, lambda q: v > q)))
    return df.join(F.broadcast(one), how="left").withColumn(f"{column}_bin", which).drop(ends)


def extract_datetime(df: DataFrame, column: str, cyclical: bool = False) -> DataFrame:
    t = F.col(column)
    parts = {"year": (F.year(t), None), "month": (F.month(t), 12), "day": (F.dayofmonth(t), None), "weekday": (F.weekday(t), 7), "hour": (F.hour(t), 24)}
    new: dict[str, Column] = {f"{column}_{k}": v for k, (v, _) in parts.items()}
    if cyclical:
        for k, (v, period) in parts.items():
            if period:
                new |= {f"{column}_{k}_sin": F.sin(v * (2 * math.pi / period)), f"{column}_{k}_cos": F.cos(v * (2 * math.pi / period))}
    return df.withColumns(new)


def lagged(df: DataFrame, column: str, order: str, by: Sequence[str], steps: int = 1) -> DataFrame:
    return df.withColumn(f"{column}_lag{steps}", F.lag(column, steps).over(Window.partitionBy(*by).orderBy(order)))


def rolling(df: DataFrame, column: str, order: str, by: Sequence[str], rows: int, how: str = "mean") -> DataFrame:
    f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[how]
    return df.withColumn(f"{column}_{how}{rows}", f(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)))


def pivot(df: DataFrame, index: Sequence[str], columns: str, value: str, values: Sequence, how: str = "sum") -> DataFrame:
    return df.groupBy(*index).pivot(columns, list(values)).agg({"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[how](value))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def merge(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    return a.join(b, list(on), how)


def merge_diagnostics(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows without a partner on either side, rows of the inner join, and the largest fan-out; from counts by key."""
    x = a.groupBy(*on).agg(F.count(F.lit(1)).alias("_x"))
    y = b.groupBy(*on).agg(F.count(F.lit(1)).alias("_y"))
    both = x.join(y, list(on), "full")
    k, m = F.coalesce("_x", F.lit(0)), F.coalesce("_y", F.lit(0))
    zero = F.lit(0)
    return both.agg(F.sum(F.when(m == 0, k).otherwise(zero)).alias("left_only"), F.sum(F.when(k == 0, m).otherwise(zero)).alias("right_only"), F.sum(k * m).alias("joined"), F.max(F.when((k > 0) & (m > 0), F.greatest(k, m)).otherwise(zero)).alias("most_partners"))


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f, allowMissingColumns=True)
    return found


def split(df: DataFrame, keys: Sequence[str], shares: Sequence[float], seed: int = 0) -> list[DataFrame]:
    """Disjoint parts by the hash of the key: the same under any partitioning."""
    at = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    ends = [sum(shares[: i + 1]) / sum(shares) for i in range(len(shares))]
    return [df.where((at >= (ends[i - 1] if i else 0.0)) & (at < (ends[i] if i < len(shares) - 1 else 2.0))) for i in range(len(shares))]


def group_aggregate(df: DataFrame, by: Sequence[str], what: dict[str, Sequence[str]]) -> DataFrame:
    f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median, "nunique": F.count_distinct, "std": F.stddev_samp}
    return df.groupBy(*by).agg(*[f[h](c).alias(f"{c}_{h}") for c, how in what.items() for h in how])


def validate_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, passed, n_violations, n_rows of conditions that all rows should meet, in one pass; missing violates."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~S.yes(c)).alias(f"_{i}") for i, c in enumerate(rules.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), (F.col(f"_{i}") == 0).alias("passed"), F.col(f"_{i}").alias("n_violations"), F.col("n").alias("n_rows")) for i, k in enumerate(rules)]))
    return one.select(rows.alias("r")).select("r.*")


def export(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format(format).mode(mode).options(**options).save(path)
