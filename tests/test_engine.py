import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscan.functions import special
from lumenscan.operators import clean, issues, profile, relations
from lumenscan.operators import reshape
from lumenscan.plans import expressions, guard, response
from lumenscan.plans.session import Session
from lumenscan.sources import files
from lumenscan.streaming import windows


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, 10.0, " Ann ", "2024-01-02", True), (2, None, "ann", "2024-01-03", False), (3, -999.0, "ANN!", None, None), (4, 30.0, None, "2024-01-09", True), (5, 40.0, "bob", "2024-02-09", True), (6, 100.0, "Bob", "2024-02-10", False)]
    return spark.createDataFrame(rows, "id long, age double, name string, day string, ok boolean").withColumn("when", F.to_timestamp_ntz("day"))


def test_special_functions():
    assert abs(special.f_survival(4.0, 2, 10) - 1.8**-5) < 1e-9
    assert abs(special.t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(special.chi2_survival(3.841459, 1) - 0.05) < 1e-6
    assert abs(special.chi2_survival(30.0, 10) - 0.000857) < 1e-5
    assert special.normality_p(10, 0.0, 3.0) is None and special.normality_p(500, 1e-9, 3.0) > 0.9 and special.normality_p(500, 2.0, 9.0) < 1e-6
    x = np.random.default_rng(1).lognormal(1, 0.7, 4000)
    assert abs(special.boxcox_lambda(x)) < 0.1 and abs(special.yeojohnson_lambda(np.random.default_rng(1).normal(0, 1, 4000)) - 1) < 0.1


@pytest.mark.parametrize(
    "text, ids",
    [
        ("age > 20", [4, 5, 6]), ("not age > 20", [1, 2, 3]), ("age != 10", [2, 3, 4, 5, 6]), ("age not in [10, 30]", [2, 3, 5, 6]), ("isnull(age) or age < 0", [2, 3]), ("10 <= age < 40", [1, 4]),
        ("lower(strip(name)) == 'ann'", [1, 2]), ("name in ['bob', None]", [4, 5]), ("contains(name, 'AN', False)", [1, 2, 3]), ("when >= '2024-02-01'", [5, 6]), ("month(when) == 2 and ok", [5]),
        ("ok & (age > 20) | (id == 1)", [1, 4, 5]), ("age / 0 > 0", [1, 4, 5, 6]), ("log(age - 10) < -1e300", [1]), ("weekday(when) == 4", [5]), ("between(`age`, 30, 40)", [4, 5]),
    ],
)
def test_conditions(frame, text, ids):
    assert [r["id"] for r in frame.where(expressions.condition(frame, text)).orderBy("id").collect()] == ids


@pytest.mark.parametrize(
    "text, code",
    [
        ("__import__('os')", "INVALID_OPERATION"), ("age.real", "OPERATION_REFUSED"), ("age[0]", "OPERATION_REFUSED"), ("(lambda: 1)()", "OPERATION_REFUSED"), ("[x for x in age]", "OPERATION_REFUSED"), ("f'{age}'", "OPERATION_REFUSED"),
        ("(x := 1)", "OPERATION_REFUSED"), ("age if ok else 1", "OPERATION_REFUSED"), ("{1: 2}", "OPERATION_REFUSED"), ("sum(*age)", "OPERATION_REFUSED"), ("agee > 1", "COLUMN_NOT_FOUND"), ("name > 5", "INVALID_OPERATION"), ("name - 'a'", "INVALID_OPERATION"),
        ("age is None", "INVALID_OPERATION"), ("sqrt(name)", "INVALID_OPERATION"), ("1 +", "INVALID_OPERATION"), ("a" * 3000, "INVALID_OPERATION"), ("+".join(["1"] * 300), "INVALID_OPERATION"), ("sum(age) + 1", "INVALID_OPERATION"), ("quantile(age, 2)", "INVALID_OPERATION"), ("open('x')", "INVALID_OPERATION"),
    ],
)
def test_refused_expressions(frame, text, code):
    with pytest.raises(expressions.ExpressionError) as e:
        expressions.evaluate(frame, text)
    assert e.value.code == code


def test_evaluation(frame):
    assert expressions.evaluate(frame, "sum(age, where=age > 0)").first()[0] == 180
    assert [tuple(r) for r in expressions.evaluate(frame, "count(by=ok)").collect()] == [(True, 3), (False, 2)]
    assert [r["id"] for r in expressions.evaluate(frame, "rows(id, sort=age, desc=True)").collect()] == [6, 5, 4, 1, 3, 2]
    assert expressions.evaluate(frame, "1 + 2").first()[0] == 3
    assert expressions.count_matching(frame.limit(0), "age > 1").first()["n_rows"] == 0


GOOD = [
    "SELECT 1", "SELECT * FROM t", "SELECT name, count(*) FROM t GROUP BY name HAVING count(*) > 1", "WITH d AS (SELECT * FROM t) SELECT count(*) FROM d", "SELECT * FROM t WHERE id IN (SELECT id FROM t)", "SELECT id FROM t UNION ALL SELECT id FROM t",
    "SELECT row_number() OVER (PARTITION BY name ORDER BY id) FROM t", "SELECT a.id FROM t a LEFT JOIN t b ON a.id = b.id WHERE b.id IS NULL", "SELECT CASE WHEN age > 1 THEN 'x' ELSE upper(name) END FROM t ORDER BY 1 LIMIT 3", "SELECT id FROM t EXCEPT SELECT id FROM t", "SELECT (SELECT max(age) FROM t) AS m",
]
BAD = [
    "DROP TABLE t", "SELECT 1; DROP TABLE t", "INSERT INTO t SELECT * FROM t", "CREATE TABLE x AS SELECT 1", "SET a = b", "SELECT reflect('java.lang.System', 'getenv', 'PATH')", "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv.`/etc/passwd`", "EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE t",
    "SELECT * FROM other", "SELECT * FROM (SELECT java_method('java.lang.System', 'exit', 0))", "WITH d AS (SELECT reflect('a', 'b')) SELECT * FROM d", "SELECT * FROM t WHERE id IN (SELECT reflect('a', 'b'))", "SELECT (SELECT reflect('a', 'b'))", "SELECT TRANSFORM (id) USING 'cat' FROM t",
    "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'SELECT 1'", "FROM t INSERT INTO a SELECT id INSERT INTO b SELECT id", "CACHE TABLE t", "ADD JAR 'x'", "USE x", "DELETE FROM t", "UPDATE t SET id = 1", "TRUNCATE TABLE t", "SELECT * FROM read_files('/etc')", "SELECT input_file_name() FROM t", "", "SELECT " + "1," * 20000 + "1",
]


@pytest.mark.parametrize("text", GOOD)
def test_guard_admits(spark, frame, text):
    guard.run(spark, text, {"t": frame}).collect()


@pytest.mark.parametrize("text", BAD)
def test_guard_refuses(spark, text):
    with pytest.raises(guard.StatementRejected):
        guard.check(spark, text, ["t"])


def test_kinds(spark):
    n = 100
    rows = [(i, f"k{i}", float(i % 7), "ab"[i % 2], "x", None, bool(i % 2), f"text {i % 60}") for i in range(n)]
    df = spark.createDataFrame(rows, "row_no long, ident string, num double, cat string, const string, empty string, flag boolean, words string")
    assert profile.column_kinds(df) == {"row_no": "identifier", "ident": "identifier", "num": "numeric", "cat": "categorical", "const": "constant", "empty": "empty", "flag": "boolean", "words": "text"}
    copied = df.unionByName(df.limit(40))
    assert profile.column_kinds(copied)["ident"] == "identifier"


def test_cleaning_and_refusals(frame):
    assert clean.merge_variants(clean.strip_whitespace(frame, "name"), "name").select("name").distinct().count() == 3
    assert clean.fill_value(frame, "age", "median") == 30.0
    filled = clean.fill_missing(frame, "age", flag=True)
    assert filled.where("age_was_missing = 1").first()["age"] == 30.0
    assert [r["age"] for r in clean.fill_missing(frame, "age", "interpolate", order="id").orderBy("id").collect()][1] == (10 - 999) / 2
    sparse = frame.withColumn("gap", F.when(F.col("id") == 1, 1.0))
    with pytest.raises(clean.Refused):
        clean.fill_missing(sparse, "gap", "mean")
    with pytest.raises(clean.Refused):
        clean.drop_missing(sparse, ["gap"])
    with pytest.raises(clean.Refused):
        clean.cast_type(frame, "name", "numeric")
    with pytest.raises(clean.Refused):
        clean.drop_columns(frame, frame.columns)
    assert clean.replace_values(frame, "age", {-999: None}).where("age IS NULL").count() == 2
    assert clean.remove_outliers(frame, "age", "percentile", "clip", low=0.2, high=0.8).where("age < -500").count() == 0


def test_session_batches_undo_and_budgets(spark, frame, tmp_path):
    s = Session(spark)
    s.register(frame, "people")
    before = frame.collect()
    done = s.clean_data("people", [{"op": "replace_values", "column": "age", "mapping": {-999: None}}, {"op": "drop_rows", "where": "id < 6"}, {"op": "standardize_case", "column": "name", "case": "title"}])
    assert [o["done"] for o in done["operations"]] == [True, False, True] and len(s.history("people")["history"]) == 1
    s.history("people", "undo")
    assert s.get("people").df.collect() == before
    for bad in ([{"op": "nope"}], [{"op": "drop_rows", "were": "x"}], [{"op": "fill_missing", "column": "nope"}]):
        with pytest.raises(expressions.ExpressionError):
            s.clean_data("people", bad)
    assert s.query("people", "count(by=ok)")["rows"]
    assert response.tokens(s.find_issues("people")) <= 1.15 * response.BUDGETS["find_issues"]
    assert response.tokens(s.profile("people")) <= 1.15 * response.BUDGETS["profile"]
    assert s.analyze_column("people", "age")["kind"] == "numeric" and s.manage_sources()["datasets"]
    db = tmp_path / "shop.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, amount REAL, placed TEXT)")
        c.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(i, i * 1.5, "2024-01-01") for i in range(500)])
    s.connect_database("shop", str(db))
    assert s.explore_schema("shop", "orders")["rows"] == 500
    s.load_dataset("shop.orders")
    assert s.get("orders").df.agg(F.sum("amount")).first()[0] == sum(i * 1.5 for i in range(500))
    assert s.query("shop", "SELECT count(*) AS n FROM orders WHERE amount > 100")["rows"] == [[433]]


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("id;preis;tag;land\n1;1,200.5;2024-01-02;España\n2;N/A;2024-01-03;München\n3;3;2024-02-01;x\n".encode("cp1252"))
    df, report = files.load(spark, str(p), roots=[str(tmp_path)])
    assert (report.encoding, report.delimiter) == ("cp1252", ";") and set(report.coerced) == {"id", "preis", "tag"}
    assert df.agg(F.sum("preis")).first()[0] == 1203.5 and df.where("land = 'España'").count() == 1
    (tmp_path / "e.csv").write_text("a,b\n")
    assert files.load(spark, str(tmp_path / "e.csv"))[0].count() == 0
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.load(spark, str(tmp_path / "j.jsonl"))[0].count() == 2
    for path, code in ((str(tmp_path / "no.csv"), "SOURCE_NOT_FOUND"), ("/etc/passwd", "PATH_NOT_ALLOWED")):
        with pytest.raises(files.SourceError) as e:
            files.load(spark, path, roots=[str(tmp_path)])
        assert e.value.code == code
    with pytest.raises(files.SourceError):
        files.detect_format("x.bin")


def test_findings(spark):
    n = 400
    rows = [(i, float(i % 50) if i % 4 else None, -999.0 if i < 30 else float(i), "Yes" if i % 3 else "yes!", "1,5", i % 4 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, gaps double, coded double, answer string, num string, missing_when boolean").withColumn("copy", F.col("coded"))
    found = {(f.column, f.message.split(" ")[0]) for f in issues.find_issues(df)}
    assert ("coded", "-999") in found and ("answer", "1") in found and {("copy", "the"), ("coded", "the")} & found and ("id", "a") in found
    assert any("more often by" in f.message for f in issues.find_issues(df) if f.column == "gaps")
    report = issues.analyze_target(df.drop("copy"), "missing_when")
    assert report["task"] == "classification"


def test_relations_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = x + rng.normal(size=300)
    rows = [(float(a), float(b) if i % 5 else None, "uvw"[i % 3]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    keep = np.arange(300) % 5 > 0
    assert abs(relations.pearson_pairs(df, ["x", "y"]).first()["r"] - np.corrcoef(x[keep], y[keep])[0, 1]) < 1e-9
    assert relations.pearson_pairs(df.withColumn("c", F.lit(1.0)), ["x", "c"]).first()["r"] is None
    assert relations.collinear_clusters([("a", "b", 0.95), ("b", "c", -0.92), ("d", "e", 0.1)]) == [["a", "b", "c"]]
    vif = relations.variance_inflation(["x", "y"], [("x", "y", 0.8)])
    assert abs(vif["x"] - 1 / (1 - 0.64)) < 1e-9
    assert issues.infer_task("numeric", 3, True) == "classification" and issues.infer_task("text", 3, True) is None


def test_reshape(spark, frame):
    assert reshape.one_hot(frame, "name").columns[-1] == "name_bob"
    assert reshape.bin_quantiles(frame, "age", 2).where("age_bin = 1").count() == 2
    parts = reshape.split(frame, ["id"], [0.5, 0.5])
    assert sum(p.count() for p in parts) == 6 and not {r["id"] for r in parts[0].collect()} & {r["id"] for r in parts[1].collect()}
    assert math.isclose(sum(r["age"] or 0 for r in reshape.scale(frame, "age", "standard").collect()), 0, abs_tol=1e-9)
    assert reshape.melt(frame, ["id"], ["age"]).count() == 6


def test_stream_equals_table(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    stream = windows.read_stream(spark, f"{data}/events*.parquet", events.schema)
    q = windows.windowed_profile(stream, "ts", "value", "event_type").writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    of = lambda d: sorted((str(r["start"]), r["group"], r["n"]) for r in d.collect())
    assert of(spark.sql("SELECT * FROM windowed")) == of(windows.windowed_profile(events, "ts", "value", "event_type"))


def test_responses():
    assert response.compact({"a": "", "b": 0, "c": None, "d": [None], "e": {}}) == {"b": 0, "d": [None]}
    assert response.significant(1234.567) == 1230 and response.significant(float("nan")) is None
    assert response.redact("postgres://u:pw@h/db password=abc") == "postgres://u:***@h/db password=***"
    assert response.error("QUERY_TIMEOUT", "x")["error"]["retryable"] is True
    assert response.fit([{"a": "x" * 400}, {"b": 1}], 10) == ([{"a": "x" * 400}], 1)
