"""Statistics of columns over all rows, as DataFrames of few rows.

Every function aggregates in the cluster; passes are fused into as few jobs as the statistics allow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as S

# Numbers that often stand for a missing one.
SENTINELS = (-9999, -999, -99, -1, 99, 999, 9999, 99999)
FENCE = 1.5
MODIFIED_Z, MAD_SCALE = 3.5, 0.6745
DOMINANCE, KEY_SHARE, MANY_VALUES = 0.99, 0.99, 50
RARE_SHARE = 0.01
#: Ranks of the sketch are off by at most 1 / SKETCH of the rows; brackets are twice as wide on either side.
SKETCH = 20_000
#: Parts in which the first values of a column are picked before all of it is.
PARTS = 64


def _c(df: DataFrame, name: str) -> Column:
    return S.present(F.col(f"`{name}`"), df.schema[name].dataType)


def _long(df: DataFrame, columns: Sequence[str], value: str = "double") -> DataFrame:
    """column, v: the columns one under another, missing values left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _c(df, c).cast(value).alias("v")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.v").where("v IS NOT NULL")


def quantiles(data: DataFrame, at: Sequence[float], key: str = "column") -> DataFrame:
    """key, q (one number for each of ``at``): exact interpolated quantiles of v, for rows of key, v without missing values.

    A sketch of bounded size brackets every quantile; a second pass counts what lies between brackets and sorts only
    the different values inside them, some 4 / SKETCH of the rows for each quantile.  No task holds a column.
    """
    width = 2.0 / SKETCH
    ends = [(max(0.0, x - width), min(1.0, x + width)) for x in at]
    probes = F.percentile_approx("v", [e for pair in ends for e in pair], SKETCH)
    sketch = data.groupBy(key).agg(F.count("v").alias("_n"), probes.alias("_p"))
    v, first, last = F.col("v"), F.lit(float("-inf")), F.lit(float("inf"))
    # among few rows a bracket's width is no whole rank: all of their values are sorted
    few = F.col("_n") < 4 * SKETCH
    low = [first if a == 0.0 else F.when(few, first).otherwise(F.col("_p")[2 * i]) for i, (a, _) in enumerate(ends)]
    high = [last if b == 1.0 else F.when(few, last).otherwise(F.col("_p")[2 * i + 1]) for i, (_, b) in enumerate(ends)]
    begun = sum(((v >= x).cast("int") for x in low), F.lit(0))
    ended = sum(((v > x).cast("int") for x in high), F.lit(0))
    # zones are in the order of values; outside of brackets a zone is one row
    placed = data.join(F.broadcast(sketch), key).select(key, "_n", (begun + ended).alias("_z"), F.when(begun > ended, v).alias("_v"))
    counts = placed.groupBy(key, "_n", "_z", "_v").agg(F.count(F.lit(1)).alias("_k"))
    upto = counts.withColumn("_u", F.sum("_k").over(Window.partitionBy(key).orderBy("_z", "_v")))
    values = []
    for i, x in enumerate(at):
        rank = F.lit(float(x)) * (F.col("_n") - 1)
        below, above = (F.min(F.when(F.col("_u") > r, F.struct("_u", "_v")))["_v"].alias(f"_{side}{i}") for side, r in (("a", F.floor(rank)), ("b", F.ceil(rank))))
        values += [below, above]
    found = upto.groupBy(key, "_n").agg(*values)
    part = [F.lit(float(x)) * (F.col("_n") - 1) - F.floor(F.lit(float(x)) * (F.col("_n") - 1)) for x in at]
    a, b = (lambda i: F.col(f"_a{i}")), (lambda i: F.col(f"_b{i}"))
    q = [F.when(a(i).isNull() | b(i).isNull(), F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double")).when(a(i) == b(i), a(i)).otherwise(a(i) * (1 - part[i]) + b(i) * part[i]) for i in range(len(at))]
    return found.select(key, F.array(*q).alias("q"))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: the moments, quartiles, zeros, negatives and integrality."""
    v, data = F.col("v"), _long(df, columns)
    stats = data.groupBy("column").agg(
        F.count(v).alias("n"), F.count_distinct(v).alias("n_unique"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"), F.bool_and(v % 1 == 0).alias("integral"),
    )
    return stats.join(F.broadcast(quantiles(data, (0.25, 0.5, 0.75))), "column").select(
        "column", "n", "n_unique", "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max", "zeros", "negatives", "integral"
    )


def corrected_skew(v: Column) -> Column:
    n = F.count(v).cast("double")
    return F.when((n > 2) & (F.max(v) > F.min(v)), F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def corrected_kurtosis(v: Column) -> Column:
    n = F.count(v).cast("double")
    return F.when((n > 3) & (F.max(v) > F.min(v)), (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(v) + 6))


def shape_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    return _long(df, columns).groupBy("column").agg(corrected_skew(F.col("v")).alias("skew"), corrected_kurtosis(F.col("v")).alias("excess_kurtosis"))


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = FENCE) -> DataFrame:
    """Values outside the quartiles by more than k interquartile ranges; none where the range is 0."""
    data = _long(df, columns)
    bounds = quantiles(data, (0.25, 0.75)).select("column", (F.col("q")[0] - k * (F.col("q")[1] - F.col("q")[0])).alias("low"), (F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).alias("high"), (F.col("q")[1] > F.col("q")[0]).alias("spread"))
    outside = F.count_if(F.col("spread") & ((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))))
    return data.join(F.broadcast(bounds), "column").groupBy("column", "low", "high").agg(outside.alias("n_outside"))


def fences(stats, k: float = FENCE) -> tuple[float, float]:
    """Of a row with the quartiles q1 and q3."""
    return stats["q1"] - k * (stats["q3"] - stats["q1"]), stats["q3"] + k * (stats["q3"] - stats["q1"])


def outside_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Values of each column outside its two bounds, none where they are equal; in one pass."""
    v = {c: _c(df, c).cast("double") for c in bounds}
    r = df.agg(*[(F.count_if((v[c] < a) | (v[c] > b)) if a < b else F.lit(0)).alias(f"_{i}") for i, (c, (a, b)) in enumerate(bounds.items())]).first()
    return {c: r[f"_{i}"] for i, c in enumerate(bounds)}


def modified_z_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values with 0.6745 |x - median| / MAD above 3.5; none where MAD is 0."""
    data = _long(df, columns)
    medians = quantiles(data, (0.5,)).select("column", F.col("q")[0].alias("median"))
    apart = data.join(F.broadcast(medians), "column").withColumn("d", F.abs(F.col("v") - F.col("median")))
    mads = quantiles(apart.select("column", F.col("d").alias("v")), (0.5,)).select("column", F.col("q")[0].alias("mad"))
    return apart.join(F.broadcast(mads), "column").groupBy("column", "median", "mad").agg(F.count_if((F.col("mad") > 0) & (MAD_SCALE * F.col("d") > MODIFIED_Z * F.col("mad"))).alias("n_outside"))


def z_outliers(df: DataFrame, columns: Sequence[str], z: float = 3.0) -> DataFrame:
    """Values further than z standard deviations from the mean, and the coefficient of variation."""
    data = _long(df, columns)
    moments = data.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    far = F.count_if(F.abs(F.col("v") - F.col("mean")) > z * F.col("std"))
    return data.join(F.broadcast(moments), "column").groupBy("column", "mean", "std").agg(far.alias("n_outside")).withColumn("cv", F.try_divide("std", F.abs("mean")))


def sentinel_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    each = _long(df, columns).where(F.col("v").isin(*map(float, SENTINELS)))
    return each.groupBy("column", F.col("v").cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def missing_summary(df: DataFrame) -> DataFrame:
    """One row for each column: missing count and per cent, in one pass."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("_n"), *[F.count(_c(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(f"_{i}")).alias("missing"), F.col("_n").alias("n")) for i, c in enumerate(df.columns)]))
    return one.select(rows.alias("r")).select("r.column", "r.missing", F.coalesce(F.try_divide(100.0 * F.col("r.missing"), F.col("r.n")), F.lit(0.0)).alias("missing_pct"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value (as text), n of the present values."""
    return _long(df, columns, "string").groupBy("column", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def kinds(df: DataFrame) -> DataFrame:
    """column, kind, n, n_unique, top_share of every column that can be compared.

    The order of the tests is: empty, constant, boolean, datetime, row counter, numeric, key, text, category.
    """
    able = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    family = {c: _family(df.schema[c].dataType) for c in able}
    rows = F.array(*[F.struct(F.lit(c).alias("column"), _c(df, c).cast("string").alias("v"), (_c(df, c).cast("long") if family[c] == "integer" else F.lit(None).cast("long")).alias("i")) for c in able])
    counts = df.select(F.explode(rows).alias("p")).select("p.*").groupBy("column", "v", "i").agg(F.count(F.lit(1)).alias("k"))
    here = F.col("v").isNotNull()
    each = counts.groupBy("column").agg(
        F.sum(F.when(here, F.col("k")).otherwise(0)).alias("n"), F.count_if(here).alias("n_unique"), F.max(F.when(here, F.col("k"))).alias("top"),
        F.sum(F.when(~here, F.col("k")).otherwise(0)).alias("gaps"), F.min("i").alias("low"), F.max("i").alias("high"),
    )
    of = F.element_at(F.create_map(*[x for c in able for x in (F.lit(c), F.lit(family[c]))]), F.col("column"))
    n, unique = F.col("n"), F.col("n_unique")
    kind = (
        F.when(n == 0, "empty").when(F.col("top") >= DOMINANCE * n, "constant").when(of == "boolean", "boolean").when(of == "datetime", "datetime")
        # an integer column with gaps is no row counter
        .when((of == "integer") & (F.col("gaps") == 0) & (n >= 2) & (F.col("high") - F.col("low") == n - 1) & (unique == n), "identifier")
        .when(of.isin("integer", "number"), "numeric").when(unique >= KEY_SHARE * n, "identifier").when(unique > MANY_VALUES, "text").otherwise("categorical")
    )
    return each.select("column", kind.alias("kind"), "n", "n_unique", F.try_divide(F.col("top").cast("double"), n).alias("top_share"))


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, S.TIME_TYPES):
        return "datetime"
    if isinstance(kind, S.INTEGRAL_TYPES):
        return "integer"
    return "number" if S.is_numeric(kind) else "text"


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Kinds by name; texts that look nearly unique are judged again on distinct rows, so that copied rows do not hide a key."""
    found = {r["column"]: r for r in kinds(df).collect()}
    result = {c: r["kind"] for c, r in found.items()}
    suspects = [c for c, r in found.items() if _family(df.schema[c].dataType) == "text" and (r["kind"] == "text" or r["kind"] == "categorical" and r["n"] <= 2 * MANY_VALUES) and r["n_unique"] >= 0.5 * r["n"]]
    if suspects:
        again = kinds(df.select(*[F.col(f"`{c}`") for c in result]).dropDuplicates().select(*suspects)).collect()
        result |= {r["column"]: r["kind"] for r in again if r["kind"] == "identifier"}
    return result


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """n_rows, n_distinct, n_duplicates: rows equal to an earlier one, nulls equal to nulls."""
    names = list(columns or df.columns)
    counts = df.groupBy(*[_c(df, c).alias(f"_{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("k"))
    return counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def most_frequent(counts: DataFrame, value: str, k: int) -> DataFrame:
    """The first k of ``value`` of each column by n, ties by value, with their rank: of each part first, so no task orders a column."""
    order = (F.desc("n"), F.col(value))
    parted = counts.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(PARTS)))
    few = parted.withColumn("_r", F.row_number().over(Window.partitionBy("column", "_part").orderBy(*order))).where(F.col("_r") <= k).drop("_part", "_r")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("rank") <= k)


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(F.sum("n").alias("all"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column; ties by value."""
    counts = value_counts(df, columns)
    return most_frequent(counts, "value", k).join(F.broadcast(_totals(counts)), "column").select("column", "value", "n", (100.0 * F.col("n") / F.col("all")).alias("share_pct"), "rank")


def rare_categories(df: DataFrame, columns: Sequence[str], share: float = RARE_SHARE) -> DataFrame:
    counts = value_counts(df, columns)
    rare = F.col("n") < share * F.col("all")
    return counts.join(F.broadcast(_totals(counts)), "column").groupBy("column").agg(F.count_if(rare).alias("n_values"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("n_rows"))


def text_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lengths, padding, blanks, placeholders, numbers, dates, words, digits, addresses of text columns, on distinct values weighted by their counts."""
    counts = value_counts(df, columns)
    v, n = F.col("value"), F.col("n")
    with_n = lambda cond: F.coalesce(F.sum(F.when(S.yes(cond), n)), F.lit(0))
    return counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.min(F.length(v)).cast("long").alias("min_length"), F.percentile(F.length(v), F.lit(0.5), n).alias("median_length"),
        F.max(F.length(v)).cast("long").alias("max_length"), with_n((v != S.strip(v)) & (S.strip(v) != "")).alias("padded"), with_n(S.strip(v) == "").alias("blank"),
        with_n(S.is_placeholder(v)).alias("placeholders"), with_n(S.parse_number_with_commas(v).isNotNull()).alias("numeric_like"),
        with_n(v.rlike("[0-9]")).alias("with_digits"), with_n(v.rlike(EMAIL)).alias("emails"), with_n(v.rlike(URL)).alias("urls"),
        F.percentile(F.regexp_count(v, F.lit(r"\S+")), F.lit(0.5), n).alias("median_words"), F.max(F.regexp_count(v, F.lit(r"\S+"))).cast("long").alias("max_words"),
    )


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"https?://"


def date_like(df: DataFrame, columns: Sequence[str], most: int = 5000) -> DataFrame:
    """Share of the most frequent values that read as dates."""
    counts = most_frequent(value_counts(df, columns), "value", most)
    ok = S.parse_date(F.col("value")).isNotNull() & S.parse_number(F.col("value")).isNull()
    return counts.groupBy("column").agg((F.sum(F.when(ok, F.col("n")).otherwise(0)).cast("double") / F.sum("n")).alias("date_share"))


def spelling_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that differ in case, space and punctuation only: one row for each group, its most frequent spelling first."""
    counts = value_counts(df, columns).withColumn("key", S.fold(F.col("value"))).where("key <> ''")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))
    return counts.groupBy("column", "key").agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_rows"), best["v"].alias("spelling")).where("n_spellings > 1")


def key_shapes(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """The k most frequent shapes of keys: digits as 9, letters as A."""
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), r"\p{L}", "A")
    counts = value_counts(df, columns).groupBy("column", shape.alias("shape")).agg(F.sum("n").alias("n"))
    return most_frequent(counts, "shape", k)


def datetime_profile(df: DataFrame, columns: Sequence[str], now: str) -> DataFrame:
    """Range, span, distinct values, days, future and old dates."""
    v = F.col("v")
    data = _long(df, columns, "timestamp_ntz")
    day = F.to_date(v)
    return data.groupBy("column").agg(
        F.count(v).alias("n"), F.count_distinct(v).alias("n_unique"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v > F.lit(now).cast("timestamp_ntz")).alias("future"),
        F.count_if(v < F.lit("1900-01-01").cast("timestamp_ntz")).alias("before_1900"), F.count_distinct(day).alias("n_days"),
    ).withColumns({"span_days": S.days_between(F.col("min"), F.col("max")), "missing_days": (F.date_diff(F.to_date("max"), F.to_date("min")) + 1 - F.col("n_days")).cast("long")})


def datetime_gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median and greatest gap between neighbouring distinct values, in days.

    Neighbours are found within ranges of values and between the ends of ranges, so no task orders them all.
    """
    distinct = _long(df, columns, "timestamp_ntz").distinct().withColumn("day", F.to_date("v"))
    w = Window.partitionBy("column", "day").orderBy("v")
    inside = distinct.select("column", F.lag("v").over(w).alias("a"), F.col("v").alias("b"))
    ends = distinct.groupBy("column", "day").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    across = ends.select("column", F.lag("last").over(Window.partitionBy("column").orderBy("day")).alias("a"), F.col("first").alias("b"))
    gaps = inside.unionByName(across).where("a IS NOT NULL").select("column", S.days_between(F.col("a"), F.col("b")).alias("gap"))
    median = quantiles(gaps.select("column", F.col("gap").alias("v")), (0.5,)).select("column", F.col("q")[0].alias("median_gap_days"))
    return gaps.groupBy("column").agg(F.max("gap").alias("max_gap_days")).join(F.broadcast(median), "column").select("column", "median_gap_days", "max_gap_days")


def calendar_breakdown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows by year, month, weekday (Monday 0) and hour."""
    v = F.col("v")
    parts = F.array(*[F.struct(F.lit(name).alias("unit"), f(v).cast("long").alias("value")) for name, f in (("year", F.year), ("month", F.month), ("weekday", F.weekday), ("hour", F.hour))])
    return _long(df, columns, "timestamp_ntz").select("column", F.explode(parts).alias("p")).groupBy("column", F.col("p.unit").alias("unit"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal bins between the extremes; the last one holds the greatest value."""
    data = _long(df, columns)
    ends = data.groupBy("column").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    which = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)), F.lit(bins - 1))).otherwise(F.lit(0))
    return data.join(F.broadcast(ends), "column").groupBy("column", which.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, columns: Sequence[str], at: Sequence[float] = (0.01, 0.05, 0.95, 0.99)) -> DataFrame:
    return quantiles(_long(df, columns), at).select("column", *[F.col("q")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(at)])


def mode_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The most frequent value and its count; the least one of a tie; nothing if no value repeats."""
    counts = _long(df, columns).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("v").alias("v")))
    return counts.groupBy("column").agg(best.alias("b")).select("column", F.col("b.v").alias("mode"), (-F.col("b.m")).alias("n")).where("n > 1")


def transform_skews(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Skewness as it is and after log1p, square root and square."""
    v = F.col("v")
    return _long(df, columns).groupBy("column").agg(
        corrected_skew(v).alias("skew"), F.when(F.min(v) > -1, corrected_skew(S.log1p(v))).alias("log1p"),
        F.when(F.min(v) >= 0, corrected_skew(S.sqrt(v))).alias("sqrt"), corrected_skew(v * v).alias("square"),
    )


POWERS = {"boxcox": S.boxcox, "yeojohnson": S.yeojohnson}


def power_skews(df: DataFrame, column: str, rounds: int = 3, steps: int = 20) -> dict[str, tuple[float, float]]:
    """Power transformations of a numeric column that can be applied: the exponent of the greatest likelihood and the skewness after it.

    Each round tries a grid of exponents in one pass over all rows and the next a finer one about the best.
    """
    v, data = F.col("v"), _long(df, [column])
    ends = data.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    if ends["low"] is None or ends["low"] == ends["high"]:
        return {}
    at = {name: (0.0, 5.0) for name in POWERS if name != "boxcox" or ends["low"] > 0}
    slope = {"boxcox": F.log(v), "yeojohnson": F.signum(v) * F.log1p(F.abs(v))}
    for _ in range(rounds):
        grid = {name: [middle + width * (2 * i / steps - 1) for i in range(steps + 1)] for name, (middle, width) in at.items()}
        fits = [((x - 1) * F.avg(slope[name]) - F.log(F.var_pop(POWERS[name](v, x))) / 2).alias(f"{name}{i}") for name, xs in grid.items() for i, x in enumerate(xs)]
        r = data.agg(*fits).first()
        for name, xs in grid.items():
            known = [(r[f"{name}{i}"], x) for i, x in enumerate(xs) if r[f"{name}{i}"] is not None and math.isfinite(r[f"{name}{i}"])]
            if known:
                at[name] = (max(known)[1], at[name][1] / (steps / 2))
    r = data.agg(*[corrected_skew(POWERS[name](v, x)).alias(name) for name, (x, _) in at.items()]).first()
    return {name: (x, r[name]) for name, (x, _) in at.items() if r[name] is not None}


def boolean_profile(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """True counts and per cent of conditions."""
    rows = F.array(*[F.struct(F.lit(k).alias("column"), c.alias("v")) for k, c in conditions.items()])
    data = df.select(F.explode(rows).alias("p")).select("p.*").where("v IS NOT NULL")
    return data.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if("v").alias("n_true")).withColumn("true_pct", 100.0 * F.col("n_true") / F.col("n"))


def is_sorted(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Does each column never fall in the order of another?  Ranges of rows are compared within and at their ends."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), _c(df, c).cast("timestamp_ntz").alias("v")) for c in columns])
    data = df.select(F.col(f"`{order}`").alias("o"), F.explode(rows).alias("p")).select("o", "p.column", "p.v").where("v IS NOT NULL").withColumn("part", F.floor(F.col("o") / 65536))
    w = Window.partitionBy("column", "part").orderBy("o")
    inside = data.withColumn("before", F.lag("v").over(w)).groupBy("column", "part").agg(F.bool_and(F.coalesce(F.col("v") >= F.col("before"), F.lit(True))).alias("ok"), F.min_by("v", "o").alias("first"), F.max_by("v", "o").alias("last"))
    across = inside.withColumn("before", F.lag("last").over(Window.partitionBy("column").orderBy("part")))
    return across.groupBy("column").agg(F.bool_and(F.col("ok") & F.coalesce(F.col("first") >= F.col("before"), F.lit(True))).alias("is_sorted"))
