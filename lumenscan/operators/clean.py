"""Cleaning operations as plans.  Each takes and returns a frame; refusals are decided by one aggregate before.

Order-sensitive operations take an ordering column: Spark rows have no order of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from . import profile

# The words that read as true and as false.
TRUE_WORDS = ("true", "yes", "y", "1", "t")
FALSE_WORDS = ("false", "no", "n", "0", "f")
#: Shares above which an operation is refused: rows dropped, cells imputed, information dropped, values lost by a conversion.
MOST_DROPPED, MOST_IMPUTED, MOST_INFORMATION, MOST_LOST = 0.5, 0.6, 0.9, 0.5


class Refused(ValueError):
    """The operation would destroy too much; nothing is changed."""


def _v(df: DataFrame, name: str) -> Column:
    return S.present(F.col(f"`{name}`"), df.schema[name].dataType)


def _refuse(share: float, most: float, what: str) -> None:
    if share > most:
        raise Refused(f"{what}: {share:.0%} is over the limit of {most:.0%}")


def missing_share(df: DataFrame, column: str) -> float:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(_v(df, column)).alias("k")).first()
    return 1 - r["k"] / r["n"] if r["n"] else 0.0


def replace_column(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def flag_name(df: DataFrame, column: str) -> str:
    name, i = f"{column}_was_missing", 2
    while name in df.columns:
        name, i = f"{column}_was_missing_{i}", i + 1
    return name


def flag_missing(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(flag_name(df, column), _v(df, column).isNull().cast("tinyint"))


def fill_value(df: DataFrame, column: str, how: str):
    """The one value that ``how`` (mean, median, mode) fills in; ties of the mode by the value as text."""
    v = _v(df, column)
    if how == "mode":
        counts = df.select(v.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.orderBy(F.desc("n"), F.col("v").cast("string")).first()
        return best["v"] if best else None
    if how == "mean":
        return df.agg(F.avg(v).alias("x")).first()["x"]
    middle = quantiles(df.select(v.cast("double").alias("v")), (0.5,)).first()
    return middle["q"][0] if middle else None


def quantiles(data: DataFrame, at: Sequence[float]) -> DataFrame:
    """One row, q, of a frame of one column v; none if all are missing."""
    return profile.quantiles(data.where("v IS NOT NULL").select(F.lit(0).alias("column"), "v"), at).select("q")


def fill_missing(df: DataFrame, column: str, how: str = "auto", value=None, order: str | None = None, flag: bool = False) -> DataFrame:
    """mean, median, mode, constant, ffill, bfill, interpolate, or auto: the median of numbers, else the mode."""
    numeric = S.is_numeric(df.schema[column].dataType)
    if how not in ("ffill", "bfill", "interpolate", "constant"):
        _refuse(missing_share(df, column), MOST_IMPUTED, f"{column} would be made up")
    if how == "auto":
        how = "median" if numeric else "mode"
    if flag:
        df = flag_missing(df, column)
    v = _v(df, column)
    if how in ("ffill", "bfill", "interpolate"):
        if order is None:
            raise ValueError(f"{how} needs an ordering column")
        return fill_in_order(df, column, order, how)
    x = value if how == "constant" else fill_value(df, column, how)
    kind = "double" if how in ("mean", "median") else df.schema[column].dataType
    return replace_column(df, column, F.coalesce(v.cast(kind), F.lit(x).cast(kind)))


#: Rows of a stretch that one task fills.
STRETCH = 65536


def fill_in_order(df: DataFrame, column: str, order: str, how: str) -> DataFrame:
    """ffill, bfill or linear interpolation by place along an ordering column of numbers, dates or times.

    Rows are filled in stretches of the order, as wide as ``STRETCH`` rows take on average; the last and first values of the stretches, one row each, carry
    over from one to the next, so no task orders all rows.  Interpolation counts places, so rows are numbered
    within stretches first.
    """
    o, v = F.col(f"`{order}`"), _v(df, column)
    at = (o.cast("timestamp") if isinstance(df.schema[order].dataType, S.TIME_TYPES) else o).cast("double")
    n, least, most = df.agg(F.count(at), F.min(at), F.max(at)).first()
    width = ((most - least) * STRETCH / n if n else 0) or 1.0
    data = df.withColumns({"_o": o, "_part": F.floor((at - F.lit(least or 0.0)) / F.lit(width)), "_v": v})
    w = Window.partitionBy("_part").orderBy("_o")
    numbered = data.withColumn("_row", F.row_number().over(w))
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col("_row").alias("r"), F.col("_v").alias("v")))
    placed = numbered.withColumns({
        "_prev": F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        # the same from the other end: a frame that ends with the part would be gone through again for each row
        "_next": F.last(point, ignorenulls=True).over(Window.partitionBy("_part").orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)),
    })
    present = F.col("_v").isNotNull()
    ends = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.max_by(point, F.when(present, F.col("_row"))).alias("_last"), F.min_by(point, F.when(present, F.col("_row"))).alias("_first"))
    across = Window.orderBy("_part")
    base = ends.withColumn("_base", F.coalesce(F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    glob = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col("_base") + F.col(c)["r"]).alias("r"), F.col(c)["v"].alias("v")))
    carried = base.withColumns({"_gl": glob("_last"), "_gf": glob("_first")}).select(
        F.col("_part").alias("_p"), "_base",
        F.last("_gl", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_gf", ignorenulls=True).over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    joined = placed.join(carried, F.col("_part") == F.col("_p"))
    prev, nxt = F.coalesce(glob("_prev"), F.col("_before")), F.coalesce(glob("_next"), F.col("_after"))
    place = F.col("_base") + F.col("_row")
    if how == "interpolate":
        slope = F.try_divide((nxt["v"] - prev["v"]).cast("double"), (nxt["r"] - prev["r"]).cast("double"))
        value = F.coalesce(F.col("_v").cast("double"), F.when(prev.isNotNull() & nxt.isNotNull(), prev["v"] + slope * (place - prev["r"])).otherwise(F.coalesce(prev["v"], nxt["v"])).cast("double"))
    else:
        value = (prev if how == "ffill" else nxt)["v"]
    return joined.select(*[value.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None, how: str = "any", check: bool = True) -> DataFrame:
    gone = [_v(df, c).isNull() for c in columns or df.columns]
    condition = gone[0]
    for g in gone[1:]:
        condition = (condition | g) if how == "any" else (condition & g)
    if check:
        _refuse_rows(df, condition)
    return df.where(~condition)


def _refuse_rows(df: DataFrame, condition: Column) -> None:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(condition).alias("k")).first()
    _refuse(r["k"] / r["n"] if r["n"] else 0.0, MOST_DROPPED, "rows would be dropped")


def drop_rows(df: DataFrame, condition: Column, check: bool = True) -> DataFrame:
    if check:
        _refuse_rows(df, S.yes(condition))
    return df.where(~S.yes(condition))


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first", order: str | None = None) -> DataFrame:
    """Exact duplicates, or one row for each value of the columns: the first or last by the ordering column."""
    if not columns:
        return df.dropDuplicates()
    if order is None:
        raise ValueError("duplicates of some columns need an ordering column")
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in columns]).orderBy(F.asc(order) if keep == "first" else F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def drop_columns(df: DataFrame, columns: Sequence[str], check: bool = True) -> DataFrame:
    if set(columns) >= set(df.columns):
        raise Refused("all columns would be dropped")
    if check:
        r = df.agg(*[F.count(_v(df, c)).alias(f"_{i}") for i, c in enumerate(df.columns)]).first()
        cells = {c: r[f"_{i}"] for i, c in enumerate(df.columns)}
        _refuse(sum(cells[c] for c in columns) / max(1, sum(cells.values())), MOST_INFORMATION, "information would be dropped")
    return df.drop(*columns)


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", k: float | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: low, high.  iqr (k 1.5), zscore (3), modified_zscore (3.5) or percentile."""
    v = _v(df, column).cast("double")
    data = df.select(v.alias("v")).where("v IS NOT NULL")
    if method == "zscore":
        one = data.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
        return one.select((F.col("m") - (k or 3.0) * F.col("s")).alias("low"), (F.col("m") + (k or 3.0) * F.col("s")).alias("high"))
    if method == "modified_zscore":
        one = quantiles(data, (0.5,)).select(F.col("q")[0].alias("m"))
        mad = quantiles(data.join(F.broadcast(one)).select(F.abs(F.col("v") - F.col("m")).alias("v")), (0.5,)).select(F.col("q")[0].alias("s"))
        return one.join(F.broadcast(mad)).select((F.col("m") - (k or 3.5) * F.col("s") / 0.6745).alias("low"), (F.col("m") + (k or 3.5) * F.col("s") / 0.6745).alias("high"))
    at = (0.25, 0.75) if method == "iqr" else (low, high)
    one = quantiles(data, at)
    gap = (F.col("q")[1] - F.col("q")[0]) * (k or 1.5) if method == "iqr" else F.lit(0.0)
    return one.select((F.col("q")[0] - gap).alias("low"), (F.col("q")[1] + gap).alias("high"))


def remove_outliers(df: DataFrame, column: str, method: str = "iqr", action: str = "drop", check: bool = True, **how) -> DataFrame:
    """drop, clip or flag the values outside the bounds; missing values stay."""
    b = df.join(F.broadcast(outlier_bounds(df, column, method, **how).select(F.col("low").alias("_low"), F.col("high").alias("_high"))))
    v = _v(df, column).cast("double")
    outside = S.yes((v < F.col("_low")) | (v > F.col("_high")))
    if action == "clip":
        return b.select(*[F.when(v.isNotNull(), F.greatest(F.least(v, F.col("_high")), F.col("_low"))).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
    if action == "flag":
        return b.withColumn(f"{column}_is_outlier", outside.cast("tinyint")).drop("_low", "_high")
    if check:
        _refuse_rows(b, outside)
    return b.where(~outside).drop("_low", "_high")


def replace_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Values by a mapping; null stands for missing, on both sides."""
    c = F.col(f"`{column}`")
    kind = df.schema[column].dataType
    out = c
    for old, new in mapping.items():
        hit = c.isNull() if old is None else c == F.lit(old).cast(kind)
        out = F.when(S.yes(hit), F.lit(new).cast(kind)).otherwise(out)
    return replace_column(df, column, out)


def merge_variants(df: DataFrame, column: str) -> DataFrame:
    """Spellings that differ in case, space and punctuation become the most frequent one; ties by value."""
    v = F.col(f"`{column}`")
    counts = df.select(v.alias("_v")).where("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", S.fold(F.col("_v"))).where("_k <> ''")
    best = F.min(F.struct((-F.col("_n")).alias("m"), F.col("_v").alias("v")))["v"]
    changed = counts.groupBy("_k").agg(best.alias("_best"), F.count(F.lit(1)).alias("_s")).where("_s > 1")
    lookup = counts.join(changed, "_k").where("_v <> _best").select("_v", "_best")
    return df.join(lookup, v == F.col("_v"), "left").select(*[F.coalesce("_best", v).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns would have one name")
    return df.toDF(*names)


def cast_expression(df: DataFrame, column: str, to: str) -> Column:
    v, text = _v(df, column), F.col(f"`{column}`").cast("string")
    is_text = df.schema[column].dataType.simpleString() == "string"
    if to in ("numeric", "float"):
        return S.parse_number_with_commas(text) if is_text else v.cast("double")
    if to == "int":
        return F.bround(S.parse_number_with_commas(text) if is_text else v.cast("double")).try_cast("long")
    if to == "bool":
        word = F.lower(S.strip(text))
        word = F.regexp_replace(word, r"^([01])\.0$", "$1")
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if to in ("str", "category"):
        return text
    if to == "datetime":
        return S.parse_date(text) if is_text else v.cast("timestamp_ntz")
    raise ValueError(f"no such type: {to}")


def cast_type(df: DataFrame, column: str, to: str, check: bool = True) -> DataFrame:
    new = cast_expression(df, column, to)
    if check:
        r = df.agg(F.count(_v(df, column)).alias("n"), F.count(new).alias("k")).first()
        _refuse(1 - r["k"] / r["n"] if r["n"] else 0.0, MOST_LOST, f"values of {column} would be lost")
    return replace_column(df, column, new)


def strip_whitespace(df: DataFrame, column: str, collapse: bool = False) -> DataFrame:
    v = S.strip(F.col(f"`{column}`"))
    return replace_column(df, column, F.regexp_replace(v, r"(?U)\s+", " ") if collapse else v)


def standardize_case(df: DataFrame, column: str, case: str = "lower") -> DataFrame:
    v = F.col(f"`{column}`")
    return replace_column(df, column, {"lower": F.lower, "upper": F.upper, "title": S.title}[case](v))


def parse_dates(df: DataFrame, column: str, format: str | None = None, check: bool = True) -> DataFrame:
    if format is None:
        return cast_type(df, column, "datetime", check)
    return replace_column(df, column, F.try_to_timestamp(F.col(f"`{column}`"), F.lit(format)).cast("timestamp_ntz"))
