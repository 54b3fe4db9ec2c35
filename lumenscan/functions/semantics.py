"""Value semantics as Column builders: missing is null, comparisons are two-valued, arithmetic never throws.

Nothing here depends on the session's ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Texts that stand for a missing value, and those that readers of CSV files know besides.
MARKERS = ("", " ", "NA", "N/A", "n/a", "na", "NULL", "null", "None", "none", "-", "--", "?", "unknown", "Unknown", "UNKNOWN", "missing", "MISSING", "nan", "NaN", "#N/A", "#NULL!", "<NA>")
NA_VALUES = (*MARKERS, "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN")
#: Those that stand for a missing value in other tables, once stripped and folded.
PLACEHOLDERS = tuple(sorted({x.strip().casefold() for x in MARKERS} - {""}))

NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: Tried in order; month first where both readings are possible.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "dd.MM.yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd", "yyyy-M", "yyyy")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC_TYPES)


def present(c: Column, kind: T.DataType | None = None) -> Column:
    """NaN as null, for floating columns."""
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c


def normalise_missing(df: DataFrame) -> DataFrame:
    """Every NaN of the frame as null."""
    return df.select(*[present(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def yes(c: Column) -> Column:
    """A condition as a mask: missing is false."""
    return F.coalesce(c, F.lit(False))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b; by zero it is an infinity with a's sign, 0 / 0 is missing."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(b.isNull() | a.isNull() | (a == 0), None).when(a > 0, float("inf")).otherwise(float("-inf"))


def floor_divide(a: Column, b: Column) -> Column:
    q = safe_divide(a, b)
    return F.when(F.abs(q) == float("inf"), q).otherwise(_floor(q))


def _floor(x: Column) -> Column:
    # floor() of a double is a bigint, which large doubles overflow
    return F.when(F.abs(x) < 9e15, F.floor(x).cast("double")).otherwise(x)


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; by zero it is missing."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a - _floor(F.try_divide(a, b)) * b)


def ln(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf"))


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x.cast("double"))).when(x == -1, float("-inf"))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x.cast("double")))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """The spelling key: folded case, letters and digits only."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", "")


def title(c: Column) -> Column:
    parts = F.split(F.lower(c), r"(?<=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))), "")


def parse_number(c: Column) -> Column:
    """A text as a number, or missing."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def parse_number_with_commas(c: Column) -> Column:
    return parse_number(F.replace(c, F.lit(","), F.lit("")))


def parse_date(c: Column) -> Column:
    """A text as a timestamp by the first format that reads it, or missing; texts without a digit and bare short numbers are none."""
    plain = F.trim(c)
    return F.when(
        plain.rlike("[0-9]") & ~plain.rlike(r"^[0-9]{1,3}$|^[0-9]{5,7}$|^[0-9]{9,}$|^[0-9]+[.][0-9]+$"),
        F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS]),
    )


def is_placeholder(c: Column) -> Column:
    return yes(F.lower(strip(c)).isin(*PLACEHOLDERS))


def days_between(a: Column, b: Column) -> Column:
    """b - a in days, for timestamps with or without a zone."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400_000_000.0


def boxcox(v: Column, power: float) -> Column:
    """Box and Cox's transformation of positive numbers."""
    return F.log(v) if abs(power) < 1e-9 else F.expm1(power * F.log(v)) / power


def yeojohnson(v: Column, power: float) -> Column:
    """Yeo and Johnson's transformation."""
    return F.when(v >= 0, boxcox(v + 1, power)).otherwise(-boxcox(1 - v, 2 - power))
