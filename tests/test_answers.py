"""Answers that a plain reading of the data gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenscan.functions import semantics
from lumenscan.operators import clean, issues
from lumenscan.plans import expressions


def test_groups_without_a_finite_value_come_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("inf")), ("c", 3.0), ("d", None), ("e", float("nan")), ("f", 3.0)], "k string, x double")
    keys = [r["key"] for r in expressions.evaluate(df, "max(x, by=k)").collect()]
    assert keys[:3] == ["c", "f", "a"] and set(keys[3:]) == {"b", "d", "e"}


def test_sorted_rows_keep_the_order_of_ties(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "i long, x long").coalesce(1)
    assert [r["i"] for r in expressions.evaluate(df, "rows(sort=x)", 50).collect()] == list(range(0, 150, 3))


def test_filling_along_times_and_narrow_or_sparse_keys(spark):
    begun = datetime(2024, 1, 1)
    values = [None, 1.0, None, None, 4.0, None]
    for kind, key in (("timestamp", lambda i: begun + timedelta(hours=i)), ("date", lambda i: (begun + timedelta(days=i)).date()), ("double", lambda i: i / 10), ("long", lambda i: i * 10**9)):
        df = spark.createDataFrame([(key(i), v) for i, v in enumerate(values)], f"o {kind}, x double")
        for how, expected in (("ffill", [None, 1.0, 1.0, 1.0, 4.0, 4.0]), ("bfill", [1.0, 1.0, 4.0, 4.0, 4.0, None]), ("interpolate", [1.0, 1.0, 2.0, 3.0, 4.0, 4.0])):
            assert [r["x"] for r in clean.fill_in_order(df, "x", "o", how).orderBy("o").collect()] == expected, (kind, how)


def test_filling_backward_over_many_rows_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(clean, "STRETCH", 1000)
    df = spark.range(60_000).selectExpr("id as o", "if(id % 700 = 0, id, null) as x")
    wrong = clean.fill_in_order(df, "x", "o", "bfill").where("not (x <=> if(o > 59500, null, cast(ceil(o / 700) * 700 as bigint)))")
    assert wrong.count() == 0


def test_dates_after_now_are_in_the_future(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(days=i)) for i in range(40)] + [(99, datetime(2199, 1, 1))], "i long, at timestamp")
    said = " ".join(str(f) for f in issues.find_issues(df))
    assert "future" in said and "future" not in " ".join(str(f) for f in issues.find_issues(df, now="2200-01-01"))


def test_markers_of_missing_values():
    assert {" ", "na", "none", "unknown", "Unknown", "UNKNOWN", "MISSING", "#NULL!"} <= set(semantics.NA_VALUES)
    assert set(semantics.PLACEHOLDERS) == {"na", "n/a", "null", "none", "-", "--", "?", "unknown", "missing", "nan", "#n/a", "#null!", "<na>"}


def test_session_tells_counts_and_summaries(spark, tmp_path):
    from lumenscan.plans.session import Session

    spark.createDataFrame([(1, 2.0), (2, None), (3, 8.0)], "i long, x double").coalesce(1).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    assert Session._whole(frame, "x > 3") == {"n_matching": 1, "n_rows": 3}
    assert Session._whole(frame, "x * 2")["summary"] == {"n": 2, "missing": 1, "mean": 10.0, "min": 4.0, "median": 10.0, "max": 16.0}
    assert Session._whole(frame, "mean(x)") == {}


def test_quantiles_against_all_values(spark, monkeypatch):
    import numpy as np

    from lumenscan.operators import profile

    monkeypatch.setattr(profile, "SKETCH", 200)
    at = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    for n, digits in ((1, 3), (2, 3), (7, 0), (30_000, 3), (30_000, 0)):
        df = spark.range(n).select(F.round(F.sin(F.col("id") * F.col("id")) * 40, digits).alias("x"), F.lit(None).cast("double").alias("y"))
        found = {r["column"]: r["q"] for r in profile.quantiles(profile._long(df, ["x", "y"]), at).collect()}
        assert set(found) == {"x"} and np.allclose(found["x"], np.quantile([r["x"] for r in df.collect()], at)), (n, digits)


def test_power_transformations_where_no_simple_one_helps(spark):
    from lumenscan.operators import profile

    df = spark.range(2000).select(F.exp(F.exp((F.col("id") / 2000) * 2)).alias("x"), (F.exp(F.col("id") / 400) - 20).alias("y"))
    assert set(profile.power_skews(df, "x")) == {"boxcox", "yeojohnson"} and set(profile.power_skews(df, "y")) == {"yeojohnson"}
    assert abs(profile.power_skews(df, "x")["boxcox"][1]) < 0.3
    assert profile.power_skews(df.selectExpr("1.0 as x"), "x") == {}
    body, judged = issues.regression_health(df, "x")
    assert body["skew"] > 1 and "to the right" in judged[0].message


def test_groups_are_compared(spark):
    from lumenscan.operators import relations

    df = spark.range(200).selectExpr("if(id % 2 = 0, 'a', 'b') as g", "id % 10 + if(id % 2 = 0, 0, 5) as x", "cast(null as double) as y")
    rows = relations.group_statistics(df, ["x", "y"], "g").collect()
    found = relations.compare_groups(rows)
    assert found["highest"] == ["b", 10.0] and found["lowest"] == ["a", 4.0] and found["effect"] == "large" and 2.0 < found["d"] < 2.2 and found["p"] < 1e-9
    assert relations.compare_groups(rows[:1]) is None
    assert [relations.effect_word(x) for x in (0.05, 0.06, 0.14)] == ["small", "medium", "large"]


def test_the_most_complete_column_of_a_cluster_stays():
    f = issues.collinear_advice([["a", "b", "c"]], {"a": 5, "b": 9, "c": 9}, ["a", "c", "b"])
    assert f[0].advice == "keep c; drop or combine a, b"


def test_classes_in_several_spellings(spark):
    df = spark.range(120).selectExpr("if(id % 3 = 0, 'Yes', if(id % 3 = 1, 'yes', 'no')) as t", "id % 7 as x")
    said = [f.message for f in issues.analyze_target(df, "t")["findings"]]
    assert any("spellings" in m for m in said)


def test_errors_are_responses(spark):
    from lumenscan.plans.session import Session

    s = Session(spark)
    s.register(spark.range(10).selectExpr("id", "id * 2.0 as x"), "t")
    code = lambda r: (r["ok"], r.get("error", {}).get("code"))
    assert s.call("query", "t", "mean(x)")["ok"]
    assert code(s.call("query", "nothing", "mean(x)")) == (False, "SOURCE_NOT_FOUND")
    assert code(s.call("query", "t", "mean(z)")) == (False, "COLUMN_NOT_FOUND")
    assert code(s.call("nothing")) == (False, "INVALID_OPERATION")
    s.register(spark.range(4).selectExpr("id", "raise_error('secret') as x"), "bad")
    r = s.call("query", "bad", "rows()")
    assert code(r) == (False, "INTERNAL_ERROR") and "secret" not in str(r)
    s.register(spark.range(40_000_000).selectExpr("id", "sha2(repeat(cast(id as string), 50), 512) as x"), "slow")
    assert code(s.call("query", "slow", "nunique(x)", seconds=1.0)) == (False, "QUERY_TIMEOUT")


def test_helper_columns_do_not_clash(spark):
    from lumenscan.operators import reshape

    df = spark.createDataFrame([(1.0, "p", 7), (2.0, "q", 8), (3.0, "q", 9)], "`a b` double, _v string, _a long")
    assert [r["a b"] for r in reshape.scale(df, "a b").orderBy("_a").collect()] == [-1.0, 0.0, 1.0]
    assert [r["_v_target"] for r in reshape.target_encode(df, "_v", "a b", 0.0).orderBy("_a").collect()] == [1.0, 2.5, 2.5]
    assert reshape.frequency_encode(df, "_v").columns == ["a b", "_v", "_a", "_v_count"]
    empty = df.where("false")
    assert reshape.scale(empty, "a b", "robust").count() == 0 and reshape.bin_quantiles(df.withColumn("n", F.lit(None).cast("double")), "n", 3).count() == 3
