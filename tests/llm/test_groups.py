"""Repeated rows, keys shared by chance, levels of candidates, and hostile pages."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lumenscan.llm import common, edits, grouping, html, lines, minhash

from .conftest import SCHEMA, prose, row
from .test_dedup import brute_classes, near_copies


def test_one_row_is_kept_of_repeated_ones(spark):
    rows = [row(1, prose(1, 60)), row(1, prose(1, 60)), row(2, prose(1, 60)), row(3, prose(9, 40))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in minhash.classes(df).collect())
    assert found == [(1, 1, False), (1, 1, True), (2, 1, False), (3, 3, True)]
    gone = sorted((r["_row"]["doc_id"], r["n_removed"]) for r in lines.dedup(df).collect())
    assert gone == [(1, 0), (1, 1), (2, 1), (3, 0)]


def test_values_that_share_a_key_get_others(spark, monkeypatch):
    whole = F.xxhash64
    # the first hash of a value has two values only, the other ones are whole
    monkeypatch.setattr(common.F, "xxhash64", lambda *c: F.pmod(whole(*c), F.lit(2)) if len(c) == 1 else whole(*c))
    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(21)], "i long, v string")
    with common.Workspace(spark) as work:
        rows, once = common.different(df, "v", work)
        assert sorted((r["v"], r["_k"]) for r in once.collect()) == [(f"text {i}", 3) for i in range(7)]
        assert rows.select("_t", "v").distinct().count() == rows.select("_t").distinct().count() == 7
    assert not [d for d in spark.catalog.listDatabases() if d.name == work.name]


def test_all_levels_find_the_classes_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(grouping, "SMALL", 4)
    base = prose(1, 150)
    rows = [row(i, t) for i, t in enumerate(near_copies(3, base, 60, 14))]
    found = {}
    for r in minhash.classes(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(tuple(sorted(g)) for g in found.values()) == sorted(tuple(sorted(g)) for g in brute_classes(rows))


def test_no_pair_of_a_large_bucket_is_left_out(spark, monkeypatch):
    """All texts in one bucket, larger than SMALL and than a block: its classes are those of comparing all."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    texts = [t for k in range(3) for t in near_copies(k, prose(60 + k, 120), 25, 6)]
    rows = [row(i, t) for i, t in enumerate(dict.fromkeys(texts))]
    with common.Workspace(spark) as work:
        table = work.table(spark.createDataFrame([(r[0], r[1]) for r in rows], "_t long, _text string"), "_t")
        buckets = table.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("_bucket"), "_t")
        of = grouping.groups(buckets, lambda pairs: minhash._verified(pairs, table, work), lambda members: minhash._settled(members, table, work), work)
        found = {r["node"]: r["component"] for r in of.collect()}
    assert sorted((min(g), i) for g in brute_classes(rows) for i in g) == sorted((found.get(i, i), i) for i in range(len(rows)))


def test_no_pair_of_lines_of_a_large_bucket_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_ROWS", 16)
    texts = list(dict.fromkeys(t for k, n in enumerate((12, 25, 70)) for t in near_copies(k, prose(80 + k, n), 25, n // 2)))
    assert min(map(len, texts)) < edits.BATCHED < max(map(len, texts))
    root = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            longer = max(len(a), len(texts[j]))
            if edits.distance(a, texts[j], longer) <= 0.2 * longer + 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    with common.Workspace(spark) as work:
        table = work.table(spark.createDataFrame(list(enumerate(texts)), "_t long, _line string"), "_t")
        sizes = table.select("_t", F.length("_line").alias("_n"))
        buckets = table.select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("_bucket"), "_t")
        of = grouping.groups(buckets, lambda pairs: lines._linked(pairs, sizes, table, work), lambda members: lines._settled(members, table, work), work)
        found = {r["node"]: r["component"] for r in of.collect()}
    assert [found.get(i, i) for i in range(len(texts))] == root and 3 < len(set(root)) < len(texts)


def test_large_buckets_of_lines_need_no_python(spark, capsys):
    texts = near_copies(1, prose(90, 30), 40, 20)
    with common.Workspace(spark) as work:
        table = work.table(spark.createDataFrame(list(enumerate(texts)), "_t long, _line string"), "_t")
        links = lines._settled(work.table(table.select(F.lit(1).cast("long").alias("_bucket"), "_t", F.col("_t").alias("_c"))), table, work)
        assert links.count() > 0
        links.explain()
    assert "Exchange" in (plan := capsys.readouterr().out) and not any(x in plan for x in ("Arrow", "Python", "Pandas"))


def test_lines_of_common_words_meet_near_copies_only(spark, monkeypatch):
    """Words that very many lines hold make no bucket, and a group of near copies, all of whose words are that common, is found whole."""
    monkeypatch.setattr(lines, "FEW_LISTS", 20)
    monkeypatch.setattr(lines, "WORD_LISTS", (12, 5, 10))
    met = []
    linked = lines._linked
    monkeypatch.setattr(lines, "_linked", lambda pairs, *rest: (met.append(pairs.count()), linked(pairs, *rest))[1])
    texts = [f"it was of the {prose(9000 + i, 36)}" for i in range(250)]
    found = lines.fuzzy_groups(lambda: spark.createDataFrame(list(enumerate(texts)), "_t long, _line string")).collect()
    assert not found and sum(met) < len(texts)
    copies = [" ".join([*(w := prose(7, 40).split())[:k], prose(100 + i, 1), *w[k + 1 :]]) for i in range(60) for k in [i % 40]]
    rows = list(enumerate(dict.fromkeys([*copies, *texts[:40]])))
    found = lines.fuzzy_groups(lambda: spark.createDataFrame(rows, "_t long, _line string")).collect()
    assert {r["node"] for r in found} == {i for i, x in rows if x in copies} and {r["component"] for r in found} == {0}


def test_lines_that_share_a_passage_are_not_all_compared(spark, monkeypatch):
    met = []
    linked = lines._linked
    monkeypatch.setattr(lines, "_linked", lambda pairs, *rest: (met.append(pairs.count()), linked(pairs, *rest))[1])
    passage = prose(77, 14)
    texts = [" ".join([*(w := prose(7000 + i, 20).split())[: i % 20], passage, *w[i % 20 :]]) for i in range(90)]
    texts.append(" ".join(["other", *texts[0].split()[1:]]))
    found = lines.fuzzy_groups(lambda: spark.createDataFrame(list(enumerate(texts)), "_t long, _line string")).collect()
    assert {r["node"]: r["component"] for r in found} == {0: 0, 90: 0}
    assert sum(met) < 0.2 * len(texts) ** 2 / 2


def test_tables_go_once_they_are_read(spark, monkeypatch):
    """While lines are grouped no copy of the places' lines and no list of features is left, and afterwards no text of a pair."""
    live = []

    def look() -> None:
        live.extend(set(spark.table(f"{d.name}.{t.name}").columns) for d in spark.catalog.listDatabases() if d.name.startswith("lumenscan_") for t in spark.catalog.listTables(d.name))

    groups = lines.groups
    monkeypatch.setattr(lines, "groups", lambda *of: (look(), groups(*of), look())[1])
    df = spark.createDataFrame([row(i, t) for i, t in enumerate(near_copies(5, prose(3, 40), 12, 4))], SCHEMA)
    assert sum(r["n_removed"] for r in lines.dedup(df).collect()) == 11
    assert live and not [c for c in live if c & {"_least", "_ma", "_la"} or c >= {"_p", "_line"}]


def test_counts_of_characters_rule_no_similar_lines_out(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ethx é\U0001f600") for _ in range(r.choice([1, 4, 9, 20]))) for _ in range(40)]
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    judged = pairs.select(F.levenshtein("a", "b").alias("d"), lines._unlike(lines._counts(F.col("a")), lines._counts(F.col("b"))).alias("u"))
    assert judged.where("u > 2 * d").isEmpty() and not judged.where("u > 0").isEmpty()


def test_no_hash_rules_out_similar_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "DISTANCE", -1)
    words = prose(7, 40).split()
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]])), (3, prose(8, 40))], "_t long, _line string")
    assert {r["node"]: r["component"] for r in lines.fuzzy_groups(lambda: df).collect()} == {1: 1, 2: 1}


def test_distances_of_many_lines_against_single_ones(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abcé\U0001f600") for _ in range(r.choice([1, 5, 63, 64, 65, 127, 128, 130, 200]))) for _ in range(25)]
    table, symbols = edits.codes(texts)
    lengths = [len(t) for t in texts]
    pairs = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    expected = {(p["i"], p["j"]): p["d"] for p in pairs.selectExpr("i", "j", "levenshtein(a, b) as d").collect()}
    for i, a in enumerate(texts):
        for most in (40, 1000):
            many = edits.distances(table[i, : lengths[i]], table, np.array(lengths), symbols, np.full(len(texts), most))
            for j, b in enumerate(texts):
                assert min(many[j], most + 1) == min(edits.distance(a, b, most), most + 1) == min(expected[i, j], most + 1)


def test_recall_of_similar_lines(spark):
    """Pairs with an edit similarity of 0.8 and more among lines of 5 to 200 words with words changed, left out or put in, against all of them."""
    r = random.Random(4)
    texts = []
    for k in range(120):
        a = prose(5000 + k, r.choice([5, 8, 12, 20, 35, 60, 120, 200])).split()
        b = list(a)
        for _ in range(max(1, round(len(a) * r.choice([0.02, 0.05, 0.1])))):
            i = r.randrange(len(b))
            b[i : i + r.choice([0, 1, 1])] = r.choice([[], [prose(r.randint(0, 10**9), 1)], [prose(r.randint(0, 10**9), 1)]])
        texts += [" ".join(a), " ".join(b)]
    pairs = spark.createDataFrame([(i, texts[i], texts[i + 1]) for i in range(0, len(texts), 2)], "a long, x string, y string")
    similar = [p["a"] for p in pairs.where("x <> y and levenshtein(x, y) <= 0.2 * greatest(length(x), length(y))").collect()]
    found = {p["node"]: p["component"] for p in lines.fuzzy_groups(lambda: spark.createDataFrame(list(enumerate(texts)), "_t long, _line string")).collect()}
    assert len(similar) > 90
    assert sum(a in found and found[a] == found.get(a + 1) for a in similar) >= 0.95 * len(similar)


def test_hostile_pages_take_linear_time(spark):
    begun = time.perf_counter()
    for page in ("<b>" * 8000 + "</i>" * 8000, "<i><div>" + "<b>" * 8000 + "</i>" * 8000, "<div>" + "<b>" * 8000 + "<p></p>" * 8000, "<script>" * 8000):
        html.blocks(page)
    assert time.perf_counter() - begun < 5
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
