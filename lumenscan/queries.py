"""Registered queries of the analysis operators, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import clean, profile, relations, reshape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as bigint: parallel sums differ in their last digits."""
    kind = {f.name: f.dataType for f in df.schema}
    of = lambda c: F.round(c, digits) if isinstance(kind[c], (T.DoubleType, T.FloatType)) else F.col(c).cast("long") if isinstance(kind[c], (T.ByteType, T.ShortType, T.IntegerType)) else F.col(c)
    return df.select(*[of(c).alias(c) for c in df.columns])


def gappy_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with missing values: sizes 11 and 30, and prices of some types."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", F.expr("nullif(nullif(p_size, 11), 30)").alias("p_size"), F.expr("case when p_partkey % 7 = 0 then null else p_retailprice end").alias("p_retailprice")
    )


GAPPY = "(SELECT p_partkey, p_brand, p_type, nullif(nullif(p_size, 11), 30) AS p_size, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)"
LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def each(template: str, columns, source: str) -> str:
    """The template for every column, one under another: {c} is the column, {t} the table."""
    return " UNION ALL ".join(template.format(c=c, t=source) for c in columns)


# --- statistics of columns -------------------------------------------------------------------------------------


@query(each(
    "SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_unique, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, round(min({c}), 5) AS min, round(quantile_cont({c}, 0.25), 5) AS q1, "
    "round(quantile_cont({c}, 0.5), 5) AS median, round(quantile_cont({c}, 0.75), 5) AS q3, round(max({c}), 5) AS max, count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives, bool_and({c} % 1 = 0) AS integral FROM {t}",
    LINE_NUMBERS, "lineitem"))
def numeric_profile(spark, sf_dir):
    return rounded(profile.numeric_profile(table(spark, sf_dir, "lineitem"), LINE_NUMBERS), 5)


@query(each("SELECT '{c}' AS \"column\", round(skewness({c}), 5) AS skew, round(kurtosis({c}), 5) AS excess_kurtosis FROM {t}", LINE_NUMBERS, "lineitem"))
def shape_moments(spark, sf_dir):
    return rounded(profile.shape_moments(table(spark, sf_dir, "lineitem"), LINE_NUMBERS), 5)


@query("WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS z FROM events) SELECT 'value' AS \"column\", round(a - 1.5 * (z - a), 6) AS low, round(z + 1.5 * (z - a), 6) AS high, count(*) FILTER (WHERE z > a AND (value < a - 1.5 * (z - a) OR value > z + 1.5 * (z - a))) AS n_outside FROM events, b GROUP BY a, z")
def iqr_outliers(spark, sf_dir):
    return rounded(profile.iqr_outliers(table(spark, sf_dir, "events"), ["value"]))


@query("WITH m AS (SELECT median(value) AS m, mad(value) AS d FROM events) SELECT 'value' AS \"column\", round(m, 6) AS median, round(d, 6) AS mad, count(*) FILTER (WHERE d > 0 AND 0.6745 * abs(value - m) > 3.5 * d) AS n_outside FROM events, m GROUP BY m, d")
def modified_z_outliers(spark, sf_dir):
    return rounded(profile.modified_z_outliers(table(spark, sf_dir, "events"), ["value"]))


@query("WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT 'value' AS \"column\", round(m, 6) AS mean, round(s, 6) AS std, count(*) FILTER (WHERE abs(value - m) > 3 * s) AS n_outside, round(s / abs(m), 6) AS cv FROM events, m GROUP BY m, s")
def z_outliers(spark, sf_dir):
    return rounded(profile.z_outliers(table(spark, sf_dir, "events"), ["value"]))


@query(each("SELECT '{c}' AS \"column\", {c}::BIGINT AS code, count(*) AS n FROM {t} WHERE {c} IN (-9999, -999, -99, -1, 99, 999, 9999, 99999) GROUP BY {c}", ("p_partkey", "p_size"), "part"))
def sentinel_counts(spark, sf_dir):
    return profile.sentinel_counts(table(spark, sf_dir, "part"), ["p_partkey", "p_size"])


@query(each("SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM {t}", ("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"), GAPPY))
def missing_summary(spark, sf_dir):
    return rounded(profile.missing_summary(gappy_part(spark, sf_dir)))


def _kind_sql(name: str, family: str) -> str:
    counter = "WHEN gaps = 0 AND n >= 2 AND hi - lo = n - 1 AND u = n THEN 'identifier'" if family == "integer" else ""
    rest = {"datetime": "ELSE 'datetime'", "integer": f"{counter} ELSE 'numeric'", "number": "ELSE 'numeric'", "text": "WHEN u >= 0.99 * n THEN 'identifier' WHEN u > 50 THEN 'text' ELSE 'categorical'"}[family]
    span = f"min({name})" if family == "integer" else "0"
    span2 = f"max({name})" if family == "integer" else "0"
    return f"""SELECT '{name}' AS "column", CASE WHEN n = 0 THEN 'empty' WHEN top >= 0.99 * n THEN 'constant' {rest} END AS kind, n, u AS n_unique, round(top::DOUBLE / n, 6) AS top_share FROM
        (SELECT count({name}) AS n, count(DISTINCT {name}) AS u, count(*) - count({name}) AS gaps, {span} AS lo, {span2} AS hi, (SELECT max(k) FROM (SELECT count(*) AS k FROM orders GROUP BY {name})) AS top FROM orders)"""


@query(" UNION ALL ".join(_kind_sql(*x) for x in (("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "datetime"), ("o_orderpriority", "text"))))
def distinct_and_kind(spark, sf_dir):
    return rounded(profile.kinds(table(spark, sf_dir, "orders")))


@query("SELECT count(*) AS n_rows, count(DISTINCT (text, lang)) AS n_distinct, count(*) - count(DISTINCT (text, lang)) AS n_duplicates FROM documents")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "documents"), ["text", "lang"])


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def duplicate_subset(spark, sf_dir):
    return clean.drop_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "first", "doc_id")


@query(each("SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, n, round(100.0 * n / sum(n) OVER (), 6) AS share_pct, row_number() OVER (ORDER BY n DESC, {c}) AS rank FROM (SELECT {c}, count(*) AS n FROM {t} GROUP BY {c})) WHERE rank <= 5", ("p_brand", "p_type"), "part"))
def top_values(spark, sf_dir):
    return rounded(profile.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type"]))


@query(each("SELECT '{c}' AS \"column\", count(*) FILTER (WHERE n < 0.01 * a) AS n_values, coalesce(sum(n) FILTER (WHERE n < 0.01 * a), 0)::BIGINT AS n_rows FROM (SELECT n, sum(n) OVER () AS a FROM (SELECT count(*) AS n FROM {t} GROUP BY {c}))", ("source", "lang", "n_chars"), "documents"))
def rare_categories(spark, sf_dir):
    return profile.rare_categories(table(spark, sf_dir, "documents"), ["source", "lang", "n_chars"])


@query(each(
    "SELECT '{c}' AS \"column\", count(*) AS n, count(DISTINCT {c}) AS n_unique, min(length({c})) AS min_length, round(quantile_cont(length({c}), 0.5), 6) AS median_length, max(length({c})) AS max_length, "
    "count(*) FILTER (WHERE regexp_matches({c}, '^\\s|\\s$') AND regexp_matches({c}, '\\S')) AS padded, count(*) FILTER (WHERE NOT regexp_matches({c}, '\\S')) AS blank, 0::BIGINT AS placeholders, "
    "count(*) FILTER (WHERE regexp_matches(replace({c}, ',', ''), '^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$')) AS numeric_like, count(*) FILTER (WHERE regexp_matches({c}, '[0-9]')) AS with_digits, "
    "count(*) FILTER (WHERE regexp_matches({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}')) AS emails, count(*) FILTER (WHERE regexp_matches({c}, 'https?://')) AS urls, "
    "round(quantile_cont(len(regexp_extract_all({c}, '\\S+')), 0.5), 6) AS median_words, max(len(regexp_extract_all({c}, '\\S+'))) AS max_words FROM {t}",
    ("text", "lang", "source"), "documents"))
def string_checks(spark, sf_dir):
    return rounded(profile.text_checks(table(spark, sf_dir, "documents"), ["text", "lang", "source"]))


MIXED = "CASE WHEN n_nationkey % 3 = 0 THEN upper(r_name) WHEN n_nationkey % 3 = 1 THEN lower(r_name) ELSE concat('  ', r_name, '. ') END"


def mixed_case(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return joined.select("n_nationkey", F.expr(MIXED).alias("region"))


_VARIANTS = f"v AS (SELECT n_nationkey, {MIXED} AS region FROM nation JOIN region ON n_regionkey = r_regionkey), c AS (SELECT region, count(*) AS n, regexp_replace(lower(region), '[^a-z0-9]+', '', 'g') AS key FROM v GROUP BY region)"


@query(f"WITH {_VARIANTS} SELECT 'region' AS \"column\", key, count(*) AS n_spellings, sum(n)::BIGINT AS n_rows, first(region ORDER BY n DESC, region) AS spelling FROM c GROUP BY key HAVING count(*) > 1")
def spelling_variants(spark, sf_dir):
    return profile.spelling_variants(mixed_case(spark, sf_dir), ["region"])


@query(f"WITH {_VARIANTS}, b AS (SELECT key, first(region ORDER BY n DESC, region) AS best FROM c GROUP BY key) SELECT n_nationkey::BIGINT AS n_nationkey, best AS region FROM v JOIN c USING (region) JOIN b USING (key)")
def merge_variants(spark, sf_dir):
    return rounded(clean.merge_variants(mixed_case(spark, sf_dir), "region"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", regexp_replace(regexp_replace({c}, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, count(*) AS n, 1::BIGINT AS rank FROM {t} GROUP BY 2" for c, t in (("c_name", "customer"),)))
def key_shape(spark, sf_dir):
    return rounded(profile.key_shapes(table(spark, sf_dir, "customer"), ["c_name"]))


@query(each(
    "SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_unique, min({c}) AS min, max({c}) AS max, count(*) FILTER (WHERE {c} > TIMESTAMP '1998-01-01') AS future, count(*) FILTER (WHERE {c} < TIMESTAMP '1900-01-01') AS before_1900, count(DISTINCT {c}::DATE) AS n_days, "
    "round(date_diff('microsecond', min({c}), max({c})) / 86400000000.0, 6) AS span_days, date_diff('day', min({c})::DATE, max({c})::DATE) + 1 - count(DISTINCT {c}::DATE) AS missing_days FROM {t}",
    ("o_orderdate",), "orders"))
def datetime_profile(spark, sf_dir):
    return rounded(profile.datetime_profile(table(spark, sf_dir, "orders"), ["o_orderdate"], "1998-01-01"))


@query("WITH d AS (SELECT DISTINCT ts FROM events), g AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) / 86400000000.0 AS gap FROM d) SELECT 'ts' AS \"column\", round(median(gap), 6) AS median_gap_days, round(max(gap), 6) AS max_gap_days FROM g WHERE gap IS NOT NULL")
def datetime_gaps(spark, sf_dir):
    return rounded(profile.datetime_gaps(table(spark, sf_dir, "events"), ["ts"]))


@query(" UNION ALL ".join(f"SELECT 'ts' AS \"column\", '{u}' AS unit, {e}::BIGINT AS value, count(*) AS n FROM events GROUP BY 3" for u, e in (("year", "year(ts)"), ("month", "month(ts)"), ("weekday", "isodow(ts) - 1"), ("hour", "hour(ts)"))))
def calendar_breakdown(spark, sf_dir):
    return profile.calendar_breakdown(table(spark, sf_dir, "events"), ["ts"])


@query("SELECT 'ts' AS \"column\", bool_and(ok) AS is_sorted FROM (SELECT coalesce(ts >= lag(ts) OVER (ORDER BY event_id), true) AS ok FROM events)")
def sorted_check(spark, sf_dir):
    return profile.is_sorted(table(spark, sf_dir, "events"), "event_id", ["ts"])


@query("WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT 'l_extendedprice' AS \"column\", least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin, count(*) AS n FROM lineitem, e GROUP BY 2")
def histogram10(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem"), ["l_extendedprice"])


@query(each("SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.01), 6) AS p1, round(quantile_cont({c}, 0.05), 6) AS p5, round(quantile_cont({c}, 0.95), 6) AS p95, round(quantile_cont({c}, 0.99), 6) AS p99 FROM {t}", LINE_NUMBERS, "lineitem"))
def percentile_detail(spark, sf_dir):
    return rounded(profile.percentiles(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query(each("SELECT * FROM (SELECT '{c}' AS \"column\", round({c}, 6) AS mode, count(*) AS n FROM {t} GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1) WHERE n > 1", LINE_NUMBERS, "lineitem").replace("SELECT * FROM (SELECT", "SELECT * FROM (SELECT"))
def mode_value(spark, sf_dir):
    return rounded(profile.mode_value(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query("SELECT 'value' AS \"column\", round(skewness(value), 5) AS skew, round(skewness(ln(1 + value)), 5) AS log1p, round(skewness(sqrt(value)), 5) AS sqrt, round(skewness(value * value), 5) AS square FROM events")
def transform_skews(spark, sf_dir):
    return rounded(profile.transform_skews(table(spark, sf_dir, "events"), ["value"]), 5)


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"column\", count({e}) AS n, count(*) FILTER (WHERE {e}) AS n_true, round(100.0 * count(*) FILTER (WHERE {e}) / count({e}), 6) AS true_pct FROM orders" for k, e in (("dear", "o_totalprice > 100000"), ("open", "o_orderstatus = 'O'"))))
def boolean_profile(spark, sf_dir):
    return rounded(profile.boolean_profile(table(spark, sf_dir, "orders"), {"dear": F.expr("o_totalprice > 100000"), "open": F.expr("o_orderstatus = 'O'")}))


# --- relations -------------------------------------------------------------------------------------------------


def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _pairs(LINE_NUMBERS)))
def pearson_pairs(spark, sf_dir):
    return rounded(relations.pearson_pairs(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query("WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE_NUMBERS) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM r" for a, b in _pairs(LINE_NUMBERS)))
def spearman_pairs(spark, sf_dir):
    return rounded(relations.spearman_pairs(table(spark, sf_dir, "lineitem"), LINE_NUMBERS))


@query("""WITH c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*)::DOUBLE AS k FROM orders GROUP BY 1, 2), m AS (SELECT k, sum(k) OVER (PARTITION BY x) AS rk, sum(k) OVER (PARTITION BY y) AS ck FROM c),
    s AS (SELECT sum(k) AS n, sum(k * k / (rk * ck)) AS s, (SELECT count(DISTINCT x) FROM c)::DOUBLE AS r, (SELECT count(DISTINCT y) FROM c)::DOUBLE AS c FROM m)
    SELECT n::BIGINT AS n, round(n * (s - 1), 6) AS chi2, round(sqrt(greatest(0, (s - 1) - (c - 1) * (r - 1) / (n - 1)) / least(r - (r - 1) * (r - 1) / (n - 1) - 1, c - (c - 1) * (c - 1) / (n - 1) - 1)), 6) AS v FROM s""")
def cramers_v(spark, sf_dir):
    return rounded(relations.cramers_v(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@query("""WITH g AS (SELECT l_returnflag, count(*)::DOUBLE AS k, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS w FROM lineitem GROUP BY 1), t AS (SELECT sum(k) AS n, count(*) AS g, sum(w) AS w, sum(k * m) / sum(k) AS mm FROM g),
    b AS (SELECT sum(k * (m - mm) * (m - mm)) AS b, n, t.g AS gg, t.w AS ww FROM g, t GROUP BY ALL) SELECT n::BIGINT AS n, gg AS n_groups, round(b / (b + ww), 6) AS eta2, round((b / (gg - 1)) / (ww / (n - gg)), 6) AS f FROM b""")
def eta_squared(spark, sf_dir):
    return rounded(relations.eta_squared(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("""WITH g AS (SELECT l_linestatus AS g, count(*) AS k, avg(l_quantity) AS m, var_samp(l_quantity) AS s FROM lineitem GROUP BY 1), a AS (SELECT sum(k)::BIGINT AS n, arg_min(m, g) AS m0, arg_max(m, g) AS m1, sum((k - 1) * s) AS ss FROM g)
    SELECT n, round(m0, 6) AS m0, round(m1, 6) AS m1, round((m1 - m0) / sqrt(ss / (n - 2)), 6) AS d FROM a""")
def cohens_d(spark, sf_dir):
    return rounded(relations.cohens_d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus"))


@query(f"SELECT 'p_size' AS target, 'p_retailprice' AS \"column\", count(p_retailprice) AS n, round(corr(CASE WHEN p_size IS NULL THEN 1 ELSE 0 END, p_retailprice), 6) AS r FROM {GAPPY} UNION ALL SELECT 'p_retailprice', 'p_partkey', count(*), round(corr(CASE WHEN p_retailprice IS NULL THEN 1 ELSE 0 END, p_partkey), 6) FROM {GAPPY} UNION ALL SELECT 'p_size', 'p_partkey', count(*), round(corr(CASE WHEN p_size IS NULL THEN 1 ELSE 0 END, p_partkey), 6) FROM {GAPPY}")
def missingness_corr(spark, sf_dir):
    return rounded(relations.missingness_corr(gappy_part(spark, sf_dir), ["p_size", "p_retailprice"], ["p_retailprice", "p_partkey"]))


@query(f"""WITH g AS (SELECT p_brand AS g, count(*)::DOUBLE AS k, count(*) FILTER (WHERE p_size IS NULL)::DOUBLE AS m FROM {GAPPY} GROUP BY 1), t AS (SELECT sum(k) AS n, sum(m) AS t, count(*) AS groups FROM g),
    x AS (SELECT n, groups, sum(pow(m - k * t / n, 2) / (k * t / n) + pow(m - k * t / n, 2) / (k - k * t / n)) AS chi2, first(g ORDER BY m / k DESC, g) AS worst, max(m / k) AS share FROM g, t GROUP BY n, groups) SELECT n::BIGINT AS n, groups, round(sqrt(chi2 / n), 6) AS v, worst, round(share, 6) AS worst_share FROM x""")
def missingness_by_group(spark, sf_dir):
    return rounded(relations.missingness_by_group(gappy_part(spark, sf_dir), "p_size", "p_brand"))


@query("SELECT toxic::BIGINT AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY toxic")
def target_balance(spark, sf_dir):
    return rounded(relations.target_balance(table(spark, sf_dir, "labels"), "toxic"))


@query("""WITH c AS (SELECT user_id::VARCHAR AS x, event_type AS y, count(*) AS k FROM events GROUP BY 1, 2), b AS (SELECT x, sum(k) AS m, max(k) AS top FROM c GROUP BY x), n AS (SELECT sum(k)::DOUBLE AS n FROM c), s AS (SELECT y, sum(k) / any_value(n) AS s FROM c, n GROUP BY y),
    big AS (SELECT * FROM b WHERE m >= 5), ch AS (SELECT sum(m * p) AS c FROM (SELECT big.x, any_value(m) AS m, sum(pow(s, m)) AS p FROM big, s GROUP BY big.x))
    SELECT round(sum(CASE WHEN top = m THEN m ELSE 0 END) / sum(m)::DOUBLE, 6) AS observed, round((SELECT c FROM ch) / sum(m), 6) AS chance, round(sum(m) / any_value(n), 6) AS coverage FROM big, n""")
def category_purity(spark, sf_dir):
    return rounded(relations.category_purity(table(spark, sf_dir, "events"), "user_id", "event_type"))


# --- cleaning --------------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey, p_brand, p_type, coalesce(p_size::DOUBLE, (SELECT median(p_size) FROM {GAPPY})) AS p_size, round(p_retailprice, 6) AS p_retailprice, (p_size IS NULL)::BIGINT AS p_size_was_missing FROM {GAPPY}")
def fill_median(spark, sf_dir):
    return rounded(clean.fill_missing(gappy_part(spark, sf_dir), "p_size", "median", flag=True))


@query(f"SELECT p_partkey, coalesce(p_size, (SELECT p_size FROM {GAPPY} WHERE p_size IS NOT NULL GROUP BY p_size ORDER BY count(*) DESC, p_size::VARCHAR LIMIT 1))::BIGINT AS p_size FROM {GAPPY}")
def fill_mode(spark, sf_dir):
    return rounded(clean.fill_missing(gappy_part(spark, sf_dir), "p_size", "mode").select("p_partkey", "p_size"))


@query(f"SELECT p_partkey, last_value(p_size IGNORE NULLS) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS p_size FROM {GAPPY}")
def fill_ffill(spark, sf_dir):
    return rounded(clean.fill_missing(gappy_part(spark, sf_dir), "p_size", "ffill", order="p_partkey").select("p_partkey", "p_size"))


@query(f"SELECT p_partkey, first_value(p_size IGNORE NULLS) OVER (ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS p_size FROM {GAPPY}")
def fill_bfill(spark, sf_dir):
    return rounded(clean.fill_missing(gappy_part(spark, sf_dir), "p_size", "bfill", order="p_partkey").select("p_partkey", "p_size"))


@query(f"""WITH r AS (SELECT p_partkey, p_retailprice AS v, row_number() OVER (ORDER BY p_partkey) AS r FROM {GAPPY}), n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pr,
    last_value(v IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv, first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nr,
    first_value(v IGNORE NULLS) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM r)
    SELECT p_partkey, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) / (nr - pr) * (r - pr) END, 6) AS p_retailprice FROM n""")
def fill_interpolate(spark, sf_dir):
    return rounded(clean.fill_missing(gappy_part(spark, sf_dir), "p_retailprice", "interpolate", order="p_partkey").select("p_partkey", "p_retailprice"))


@query(f"SELECT p_partkey, p_size::BIGINT AS p_size, (p_size IS NULL)::BIGINT AS p_size_was_missing FROM {GAPPY}")
def flag_missing(spark, sf_dir):
    return rounded(clean.flag_missing(gappy_part(spark, sf_dir).select("p_partkey", "p_size"), "p_size"))


@query(f"SELECT p_partkey FROM {GAPPY} WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL")
def drop_missing(spark, sf_dir):
    return clean.drop_missing(gappy_part(spark, sf_dir), ["p_size", "p_retailprice"]).select("p_partkey")


@query(f"SELECT p_partkey FROM {GAPPY} WHERE NOT coalesce(p_size > 30, false)")
def drop_rows_where(spark, sf_dir):
    return clean.drop_rows(gappy_part(spark, sf_dir), F.col("p_size") > 30).select("p_partkey")


_FENCES = "b AS (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)"


@query(f"WITH {_FENCES} SELECT event_id, round(greatest(least(value, hi), lo), 6) AS value FROM events, b")
def clip_outliers(spark, sf_dir):
    return rounded(clean.remove_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", "iqr", "clip"))


@query(f"WITH {_FENCES} SELECT event_id, round(value, 6) AS value, (value < lo OR value > hi)::BIGINT AS value_is_outlier FROM events, b")
def flag_outliers(spark, sf_dir):
    return rounded(clean.remove_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", "iqr", "flag"))


@query("WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id FROM events, m WHERE NOT (value < m - 3 * s OR value > m + 3 * s)")
def drop_outliers(spark, sf_dir):
    return clean.remove_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", "zscore", "drop").select("event_id")


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'promotion' WHEN 'SMALL' THEN NULL ELSE p_type END AS p_type FROM part")
def replace_values(spark, sf_dir):
    return clean.replace_values(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", {"PROMO": "promotion", "SMALL": None})


@query(f"WITH {_VARIANTS} SELECT n_nationkey::BIGINT AS n_nationkey, upper(trim(region)) AS region FROM v")
def strip_case(spark, sf_dir):
    return rounded(clean.standardize_case(clean.strip_whitespace(mixed_case(spark, sf_dir), "region"), "region", "upper"))


@query("SELECT p_partkey, round(try_cast(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE p_retailprice::VARCHAR END AS DOUBLE), 6) AS price FROM part")
def cast_numeric(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr("case when p_size % 5 = 0 then 'n/a' else cast(p_retailprice as string) end").alias("price"))
    return rounded(clean.cast_type(texts, "price", "numeric"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN true WHEN p_size % 4 = 1 THEN false WHEN p_size % 4 = 2 THEN true END AS flag FROM part")
def cast_bool(spark, sf_dir):
    texts = table(spark, sf_dir, "part").select("p_partkey", F.expr("element_at(array(' Yes', 'no', 'T', 'maybe'), p_size % 4 + 1)").alias("flag"))
    return clean.cast_type(texts, "flag", "bool")


@query("SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS day FROM orders")
def parse_dates(spark, sf_dir):
    return clean.cast_type(table(spark, sf_dir, "orders").select("o_orderkey", F.expr("date_format(o_orderdate, 'MM/dd/yyyy')").alias("day")), "day", "datetime")


# --- samples ---------------------------------------------------------------------------------------------------


@query()
def hash_sample(spark, sf_dir):
    """One per cent by the hash of the key: the same rows however the table is partitioned."""
    from .sources.files import hash_sample as sample

    return sample(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 0.01, seed=7)


@query()
def findings(spark, sf_dir):
    """The flagship: every column of orders judged, as ranked findings."""
    from .operators.issues import findings_frame

    return findings_frame(table(spark, sf_dir, "orders"))


# --- the expression language -----------------------------------------------------------------------------------


def _expressions(df: DataFrame, key: str, **texts: str) -> DataFrame:
    from .plans.expressions import column

    return df.select(key, *[column(df, t).alias(k) for k, t in texts.items()])


def _matching(df: DataFrame, text: str, key: str) -> DataFrame:
    from .plans.expressions import condition

    return df.where(condition(df, text)).select(key)


def _evaluated(df: DataFrame, text: str, limit: int = 100) -> DataFrame:
    from .plans.expressions import evaluate

    return evaluate(df, text, limit)


@query(f"SELECT p_partkey FROM {GAPPY} WHERE coalesce(p_size > 30, false) AND NOT coalesce(p_retailprice < 950, false)")
def filter_condition(spark, sf_dir):
    return _matching(gappy_part(spark, sf_dir), "p_size > 30 and not p_retailprice < 950", "p_partkey")


@query(f"SELECT p_partkey FROM {GAPPY} WHERE p_size IS NULL OR coalesce(p_retailprice <> 900, true) AND NOT coalesce(p_size IN (1, 2, 3), false)")
def filter_nulls(spark, sf_dir):
    return _matching(gappy_part(spark, sf_dir), "isnull(p_size) or p_retailprice != 900 and p_size not in [1, 2, 3]", "p_partkey")


@query(f"SELECT p_partkey FROM {GAPPY} WHERE coalesce(10 <= p_size AND p_size < 20, false) OR coalesce(p_retailprice BETWEEN 905 AND 910, false)")
def chained_compare(spark, sf_dir):
    return _matching(gappy_part(spark, sf_dir), "10 <= p_size < 20 or between(p_retailprice, 905, 910)", "p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1996-01-01'")
def in_list(spark, sf_dir):
    return _matching(table(spark, sf_dir, "orders"), "o_orderpriority in ['1-URGENT', '2-HIGH'] and o_orderdate >= '1996-01-01'", "o_orderkey")


@query("SELECT count(*) FILTER (WHERE l_discount > 0.05) AS n_matching, count(*) AS n_rows FROM lineitem")
def count_condition(spark, sf_dir):
    from .plans.expressions import count_matching

    return count_matching(table(spark, sf_dir, "lineitem"), "l_discount > 0.05")


@query("SELECT p_partkey, round(abs(-p_size), 6)::DOUBLE AS a, round(ln(p_size), 6) AS b, round(ln(1 + p_size), 6) AS c, round(sqrt(p_size), 6) AS d, round(exp(p_size / 10.0), 4)::DOUBLE AS e, round(pow(p_size, 2), 6) AS f, round_even(p_retailprice / 8, 0) AS g, round(p_size * 2.0 + 1 - p_size / 4.0, 6)::DOUBLE AS h FROM part")
def scalar_math(spark, sf_dir):
    found = _expressions(table(spark, sf_dir, "part"), "p_partkey", a="abs(-p_size)", b="log(p_size)", c="log1p(p_size)", d="sqrt(p_size)", e="exp(p_size / 10)", f="p_size ** 2", g="round(p_retailprice / 8)", h="p_size * 2 + 1 - p_size / 4")
    return rounded(found).withColumn("e", F.round("e", 4))


@query("SELECT p_partkey, floor((p_size - 25) / 7.0)::DOUBLE AS q, ((p_size - 25) - floor((p_size - 25) / 7.0) * 7)::DOUBLE AS r, ((p_size - 25) - floor((p_size - 25) / -7.0) * -7)::DOUBLE AS s FROM part")
def floor_mod(spark, sf_dir):
    return _expressions(table(spark, sf_dir, "part"), "p_partkey", q="(p_size - 25) // 7", r="(p_size - 25) % 7", s="(p_size - 25) % -7")


@query("SELECT p_partkey, CASE WHEN p_size = 25 THEN CASE WHEN p_partkey > 0 THEN 'inf' END ELSE round(p_partkey::DOUBLE / (p_size - 25), 4)::VARCHAR END IS NOT NULL AS known, p_size = 25 AS infinite FROM part")
def safe_divide(spark, sf_dir):
    found = _expressions(table(spark, sf_dir, "part"), "p_partkey", x="p_partkey / (p_size - 25)")
    return found.select("p_partkey", F.col("x").isNotNull().alias("known"), (F.col("x") == float("inf")).alias("infinite"))


@query("SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b, length(c_name)::BIGINT AS c, contains(c_name, '00') AS d, contains(lower(c_mktsegment), 'build') AS e, starts_with(c_name, 'Customer') AS f, ends_with(c_name, '7') AS g, c_mktsegment || '-' || c_name AS h, trim(' x ' || c_name || ' ') AS i FROM customer")
def scalar_text(spark, sf_dir):
    return rounded(_expressions(table(spark, sf_dir, "customer"), "c_custkey", a="lower(c_name)", b="upper(c_mktsegment)", c="length(c_name)", d="contains(c_name, '00')", e="contains(c_mktsegment, 'BUILD', False)", f="startswith(c_name, 'Customer')", g="endswith(c_name, '7')", h="c_mktsegment + '-' + c_name", i="strip(' x ' + c_name + ' ')"))


@query("SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS d, (isodow(o_orderdate) - 1)::BIGINT AS w, hour(o_orderdate)::BIGINT AS h FROM orders")
def scalar_date(spark, sf_dir):
    return rounded(_expressions(table(spark, sf_dir, "orders"), "o_orderkey", y="year(o_orderdate)", m="month(o_orderdate)", d="day(o_orderdate)", w="weekday(o_orderdate)", h="hour(o_orderdate)"))


@query("SELECT l_returnflag AS key, round(sum(l_quantity), 4) AS sum FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def group_agg(spark, sf_dir):
    return rounded(_evaluated(table(spark, sf_dir, "lineitem"), "sum(l_quantity, where=l_discount > 0.05, by=l_returnflag)"), 4)


@query("SELECT l_returnflag AS key, round(quantile_cont(l_extendedprice, 0.9), 4) AS quantile FROM lineitem GROUP BY 1")
def group_quantile(spark, sf_dir):
    return rounded(_evaluated(table(spark, sf_dir, "lineitem"), "quantile(l_extendedprice, 0.9, by=l_returnflag)"), 4)


@query("SELECT year(o_orderdate)::BIGINT AS key, count(DISTINCT o_custkey) AS nunique FROM orders GROUP BY 1")
def group_nunique(spark, sf_dir):
    return rounded(_evaluated(table(spark, sf_dir, "orders"), "nunique(o_custkey, by=year(o_orderdate))"))


@query(f"SELECT p_brand AS key, round(avg(p_size), 6) AS mean FROM {GAPPY} GROUP BY 1")
def group_mean_gaps(spark, sf_dir):
    return rounded(_evaluated(gappy_part(spark, sf_dir), "mean(p_size, by=p_brand)"))


@query(f"SELECT round(coalesce(median(p_size), 0), 6) AS median FROM {GAPPY} WHERE p_size > 5")
def scalar_median(spark, sf_dir):
    return rounded(_evaluated(gappy_part(spark, sf_dir), "median(p_size, where=p_size > 5)"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def rows_sorted(spark, sf_dir):
    return _evaluated(table(spark, sf_dir, "orders"), "rows(o_orderkey, o_totalprice, where=o_orderstatus == 'F', sort=o_totalprice, desc=True)", 20)


# --- guarded SQL -----------------------------------------------------------------------------------------------

STATEMENTS = {
    "sql_join_agg": "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 10",
    "sql_semi_anti": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000) AND c.c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "sql_window_rank": "SELECT l_orderkey, l_linenumber, r FROM (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS BIGINT) AS r FROM lineitem) t WHERE r <= 3",
    "sql_set_ops": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "sql_cte_left_join": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey) SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN big ON c_custkey = o_custkey",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_right_full_join": "SELECT n_name, r_name, s_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey FULL JOIN (SELECT s_nationkey, s_name FROM supplier WHERE s_suppkey % 2 = 0) s ON s_nationkey = n_nationkey",
    "sql_intersect": "SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 50000",
    "sql_order_limit": "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sql_self_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "sql_having_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING count(*) > 100",
    "sql_case_like": "SELECT CASE WHEN p_type LIKE '%PROMO%' THEN 'promo' WHEN p_size IN (1, 2, 3) THEN 'small' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1",
}


def _statement(name: str, text: str) -> None:
    import re

    from .plans import guard

    used = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if re.search(rf"\b{t}\b", text)]

    def run(spark, sf_dir):
        return rounded(guard.run(spark, text, {t: table(spark, sf_dir, t) for t in used}))

    run.__name__ = name
    query(text.replace("c_nationkey AS k", "c_nationkey::BIGINT AS k"))(run)


for _name, _text in STATEMENTS.items():
    _statement(_name, _text)


# --- transformations -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def scale_standard(spark, sf_dir):
    return rounded(reshape.scale(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice"))


@query("SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS p_type_count FROM part")
def frequency_encode(spark, sf_dir):
    return reshape.frequency_encode(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type")


@query("SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS value_lag1, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value_mean3 FROM events")
def lag_rolling(spark, sf_dir):
    df = reshape.rolling(reshape.lagged(table(spark, sf_dir, "events"), "value", "event_id", ["user_id"]), "value", "event_id", ["user_id"], 3)
    return rounded(df.select("event_id", "value_lag1", "value_mean3"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 4) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY 1")
def pivot_sum(spark, sf_dir):
    return rounded(reshape.pivot(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"]), 4)


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS left_only, 0::BIGINT AS right_only, (SELECT count(*) FROM orders) AS joined, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)) AS most_partners")
def merge_diagnostics(spark, sf_dir):
    return reshape.merge_diagnostics(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT 'cheap' AS rule, count(*) FILTER (WHERE NOT l_discount <= 0.1) = 0 AS passed, count(*) FILTER (WHERE NOT l_discount <= 0.1) AS n_violations, count(*) AS n_rows FROM lineitem UNION ALL SELECT 'few', count(*) FILTER (WHERE NOT l_quantity < 40) = 0, count(*) FILTER (WHERE NOT l_quantity < 40), count(*) FROM lineitem")
def validate_rules(spark, sf_dir):
    return reshape.validate_rules(table(spark, sf_dir, "lineitem"), {"cheap": F.expr("l_discount <= 0.1"), "few": F.expr("l_quantity < 40")})


@query("SELECT date_trunc('day', ts) AS start, event_type AS group, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) FILTER (WHERE value = 0) AS zeros, count(*) FILTER (WHERE value < 0) AS negatives FROM events GROUP BY 1, 2".replace("AS group", 'AS "group"'))
def windowed_profile(spark, sf_dir):
    from .streaming.windows import windowed_profile as f

    return rounded(f(table(spark, sf_dir, "events"), "ts", "value", "event_type"))


@query(f"SELECT count(v) AS n, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(median(v), 6) AS median, round(max(v), 6) AS max FROM (SELECT ln(1 + p_size) AS v FROM {GAPPY})")
def computed_summary(spark, sf_dir):
    from .plans.expressions import summary

    return rounded(summary(gappy_part(spark, sf_dir), "log1p(p_size)"), 6)


@query("SELECT l_returnflag AS key, round(min(l_extendedprice), 4) AS min FROM lineitem GROUP BY l_returnflag")
def aggregate_min(spark, sf_dir):
    return rounded(_evaluated(table(spark, sf_dir, "lineitem"), "min(l_extendedprice, by=l_returnflag)"), 4)


@query("SELECT l_returnflag AS key, round(max(l_extendedprice), 4) AS max FROM lineitem GROUP BY l_returnflag")
def aggregate_max(spark, sf_dir):
    return rounded(_evaluated(table(spark, sf_dir, "lineitem"), "max(l_extendedprice, by=l_returnflag)"), 4)


@query("SELECT l_returnflag AS key, round(stddev_samp(l_quantity), 4) AS std FROM lineitem GROUP BY l_returnflag")
def aggregate_std(spark, sf_dir):
    return rounded(_evaluated(table(spark, sf_dir, "lineitem"), "std(l_quantity, by=l_returnflag)"), 4)


@query("SELECT o_orderstatus || '-' || o_orderpriority AS key, count(DISTINCT o_custkey) AS nunique FROM orders GROUP BY 1")
def text_concatenation(spark, sf_dir):
    return _evaluated(table(spark, sf_dir, "orders"), "nunique(o_custkey, by=o_orderstatus + '-' + o_orderpriority)")


@query(f"SELECT p_brand AS key, count(*) AS count FROM {GAPPY} WHERE p_size IS NOT NULL GROUP BY p_brand")
def present_by_group(spark, sf_dir):
    return _evaluated(gappy_part(spark, sf_dir), "count(where=notnull(p_size), by=p_brand)")


# --- more of cleaning and reshaping ----------------------------------------------------------------------------


@query(f"SELECT p_partkey, round(coalesce(p_size::DOUBLE, (SELECT avg(p_size) FROM {GAPPY})), 6) AS p_size FROM {GAPPY}")
def fill_mean(spark, sf_dir):
    return rounded(clean.fill_missing(gappy_part(spark, sf_dir).select("p_partkey", F.col("p_size").cast("double").alias("p_size")), "p_size", "mean"))


@query(f"SELECT p_partkey, coalesce(p_size, -1)::BIGINT AS p_size FROM {GAPPY}")
def fill_constant(spark, sf_dir):
    return rounded(clean.fill_missing(gappy_part(spark, sf_dir).select("p_partkey", "p_size"), "p_size", "constant", -1))


@query("SELECT p_partkey AS key, p_type AS kind FROM part")
def rename_columns(spark, sf_dir):
    return clean.rename_columns(table(spark, sf_dir, "part").select("p_partkey", "p_type"), {"p_partkey": "key", "p_type": "kind"})


@query("SELECT c_custkey, c_mktsegment FROM customer")
def drop_columns(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return clean.drop_columns(df, ["c_name"])


@query("SELECT event_id FROM events, (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM events) WHERE value BETWEEN a AND b")
def drop_outliers_percentile(spark, sf_dir):
    return clean.remove_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", "percentile", low=0.02, high=0.98).select("event_id")


@query("WITH m AS (SELECT median(value) AS m, mad(value) AS d FROM events) SELECT event_id, (value < m - 3.5 * d / 0.6745 OR value > m + 3.5 * d / 0.6745)::BIGINT AS value_is_outlier FROM events, m")
def flag_outliers_modified(spark, sf_dir):
    return rounded(clean.remove_outliers(table(spark, sf_dir, "events").select("event_id", "value"), "value", "modified_zscore", "flag").select("event_id", "value_is_outlier"))


@query("SELECT p_partkey, round((p_retailprice - (SELECT median(p_retailprice) FROM part)) / (SELECT quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) FROM part), 6) AS p_retailprice FROM part")
def scale_robust(spark, sf_dir):
    return rounded(reshape.scale(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "robust"))


@query("SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part))::DOUBLE / (SELECT max(p_size) - min(p_size) FROM part), 6) AS p_size FROM part")
def scale_minmax(spark, sf_dir):
    return rounded(reshape.scale(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "minmax"))


@query("SELECT event_id, ((value > a)::INT + (value > b)::INT + (value > c)::INT)::BIGINT AS value_bin FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)")
def bin_quantiles(spark, sf_dir):
    return rounded(reshape.bin_quantiles(table(spark, sf_dir, "events").select("event_id", "value"), "value", 4).select("event_id", "value_bin"))


@query("SELECT p_partkey, least(floor((p_size - lo) / ((hi - lo) / 5.0)), 4)::BIGINT AS p_size_bin FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def bin_equal_width(spark, sf_dir):
    return rounded(reshape.bin_equal_width(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 5).select("p_partkey", "p_size_bin"))


@query("SELECT p_partkey, round((s + 10.0 * m) / (k + 10.0), 6) AS p_type_target FROM part JOIN (SELECT p_type, sum(p_retailprice) AS s, count(*) AS k FROM part GROUP BY p_type) USING (p_type), (SELECT avg(p_retailprice) AS m FROM part)")
def target_encode(spark, sf_dir):
    return rounded(reshape.target_encode(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice"), "p_type", "p_retailprice").select("p_partkey", "p_type_target"))


@query("SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS o_orderstatus_F, (o_orderstatus = 'O')::BIGINT AS o_orderstatus_O, (o_orderstatus = 'P')::BIGINT AS o_orderstatus_P FROM orders")
def one_hot(spark, sf_dir):
    return rounded(reshape.one_hot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END::BIGINT AS o_orderstatus_code FROM orders")
def ordinal_encode(spark, sf_dir):
    return rounded(reshape.ordinal(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["O", "P", "F"]).drop("o_orderstatus"))


@query("SELECT o_orderkey, year(o_orderdate)::BIGINT AS o_orderdate_year, month(o_orderdate)::BIGINT AS o_orderdate_month, day(o_orderdate)::BIGINT AS o_orderdate_day, (isodow(o_orderdate) - 1)::BIGINT AS o_orderdate_weekday, hour(o_orderdate)::BIGINT AS o_orderdate_hour FROM orders")
def extract_datetime(spark, sf_dir):
    return rounded(reshape.extract_datetime(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate"))


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def melt(spark, sf_dir):
    return reshape.melt(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name, NULL::BIGINT AS extra FROM nation UNION ALL SELECT r_regionkey::BIGINT, r_name, 1::BIGINT FROM region")
def concat_frames(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    return reshape.concat([nations, table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"), F.lit(1).cast("long").alias("extra"))])


@query("SELECT l_shipmode, round(sum(l_quantity), 4) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, count(DISTINCT l_suppkey) AS l_suppkey_nunique FROM lineitem GROUP BY 1".replace("l_shipmode", "l_returnflag"))
def group_aggregate(spark, sf_dir):
    return rounded(reshape.group_aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"l_quantity": ["sum", "mean"], "l_suppkey": ["nunique"]}))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", l_returnflag AS g, count(*) AS k, round(avg({c}), 6) AS m, round(var_samp({c}), 5) AS s2 FROM lineitem GROUP BY 2" for c in ("l_quantity", "l_discount")))
def group_statistics(spark, sf_dir):
    df = relations.group_statistics(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    return df.select("column", "g", "k", F.round("m", 6).alias("m"), F.round("s2", 5).alias("s2"))


@query(f"SELECT p_partkey FROM {GAPPY} WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL AND NOT p_brand LIKE '%1%'")
def present_and_not(spark, sf_dir):
    return _matching(gappy_part(spark, sf_dir), "notnull(p_size) and p_retailprice == p_retailprice and not contains(p_brand, '1')", "p_partkey")


@query("SELECT 'l_extendedprice' AS \"column\", round(quantile_cont(l_extendedprice, 0.001), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice, 0.999), 6) AS q3 FROM lineitem")
def bracketed_quantiles(spark, sf_dir):
    q = profile.quantiles(table(spark, sf_dir, "lineitem").select(F.lit("l_extendedprice").alias("column"), F.col("l_extendedprice").alias("v")), (0.001, 0.5, 0.999))
    return rounded(q.select("column", *[F.col("q")[i].alias(f"q{i + 1}") for i in range(3)]))
