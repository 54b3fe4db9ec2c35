import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from lumenscan.llm import fmindex, lines, minhash, substring

from .conftest import SCHEMA, prose, row


def lcs(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, d[j] = d[j], before + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def test_banded_alignment_against_full_table():
    r = random.Random(3)
    for _ in range(400):
        a = [r.randint(0, r.choice([2, 60])) for _ in range(r.randint(1, 90))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = [r.randint(0, 60)] * r.randint(0, 1)
        b = b or [1]
        n = lcs(a, b)
        s = n / (len(a) + len(b) - n)
        assert abs(minhash.Aligner(np.array(a, np.uint64)).similarity(np.array(b, np.uint64)) - (s if s >= 0.8 - 1e-12 else 0)) < 1e-9


def near_copies(seed, base, n, edits):
    r, words = random.Random(seed), base.split()
    for _ in range(n):
        w = list(words)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = prose(r.randint(0, 10**9), 1)
        yield " ".join(w)


def brute_classes(rows):
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if (a[1] or "") == (rows[j][1] or "") or minhash.similarity(a[1], rows[j][1]) > 0:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((tuple(sorted(g, key=str)) for g in groups.values()), key=str)


def test_near_dedup_against_brute_force(spark, edges, edge_rows, empty):
    base = [prose(i, 150) for i in range(3)]
    rows = list(edge_rows) + [row(100 + 40 * k + i, t) for k, b in enumerate(base) for i, t in enumerate(near_copies(k, b, 40, 12))]
    df = spark.createDataFrame(rows, SCHEMA)
    found = minhash.classes(df).collect()
    groups = defaultdict(list)
    for r in found:
        groups[r["class_id"], r["_t"] if r["class_id"] is None else 0].append(r["doc_id"])
    assert sorted((tuple(sorted(g, key=str)) for g in groups.values()), key=str) == brute_classes(rows)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert minhash.classes(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_fm_index_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        window, symbols = r.choice([3, 5, 12]), r.choice([2, 4, 30])
        texts = [np.array([r.randint(1, symbols) for _ in range(r.randint(window, 40))]) for _ in range(r.randint(1, 12))]
        texts += [texts[0].copy()] * r.randint(0, 2)
        weights = np.array([r.choice([1, 1, 2]) for _ in texts])
        counts = Counter()
        for s, w in zip(texts, weights, strict=True):
            for i in range(len(s) - window + 1):
                counts[tuple(s[i : i + window])] += w
        index = fmindex.FMIndex(texts, weights)
        found = [set() for _ in texts]
        for k, a, b in fmindex.repeated(index, np.arange(len(texts)), np.array([len(s) for s in texts]), window):
            found[k].update(range(a, b - window + 1))
        assert found == [{i for i in range(len(s) - window + 1) if counts[tuple(s[i : i + window])] >= 2} for s in texts]


def brute_removal(rows, window=35):
    split = [(t or "").encode().split() for _, t, *_ in rows]
    counts = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for (i, *_), w in zip(rows, split, strict=True):
        gone = {k for a in range(len(w) - window + 1) if counts[tuple(w[a : a + window])] > 1 for k in range(a, a + window)}
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


def test_substring_removal_against_brute_force(spark, edge_rows, empty, monkeypatch):
    passage = prose(77, 60)
    rows = list(edge_rows) + [row(200 + i, f"{prose(300 + i, 40)} {passage} {prose(400 + i, 30)}") for i in range(12)] + [row(250, passage), row(251, " ".join(passage.split()[:35])), row(252, " ".join(passage.split()[:34]))]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = sorted(map(str, brute_removal(rows)))
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(str(tuple(r[c] for c in columns)) for r in substring.removal(df).collect()) == expected
    monkeypatch.setattr(substring, "HOT", 2)  # the way of minimizers with very many segments
    assert sorted(str(tuple(r[c] for c in columns)) for r in substring.removal(df).collect()) == expected
    assert substring.removal(empty).count() == 0


def test_line_dedup(spark, edges, edge_rows, empty):
    long_line = prose(5, 90)
    changed = long_line.replace(long_line.split()[40], long_line.split()[40] + "x", 1)
    rows = [
        row(1, "First line of the text, here.\nsecond LINE of the text; here\n\n***"), row(2, "first line of the text here\nsomething else altogether\n***"), row(3, None), row(4, ""),
        row(5, long_line), row(6, changed), row(7, "Second line of the text here\nSecond line of the text here"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["_row"]["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in lines.dedup(df).collect()}
    assert found[1] == (4, 0, rows[0][1])
    assert found[2] == (3, 1, "something else altogether\n***")
    assert found[3] == (1, 0, None) and found[4] == (1, 0, "")
    assert found[7] == (2, 2, "")
    kept = lines.dedup_documents(df)
    assert kept.columns == df.columns and 7 not in {r["doc_id"] for r in kept.collect()}
    assert lines.dedup(edges).count() == len(edge_rows)
    assert lines.dedup(empty).count() == 0 and lines.dedup_documents(empty).count() == 0


def test_fuzzy_lines_against_brute_force(spark):
    base = [prose(i, 60) for i in range(4)]
    texts = sorted({t for k, b in enumerate(base) for t in near_copies(k, b, 25, 3)})
    df = spark.createDataFrame(list(enumerate(texts)), "_t long, _line string")
    sims = {r["_t"]: r["_sim"] for r in lines._simhash(df).collect()}
    edit = {(r["a"], r["b"]): r["d"] for r in df.selectExpr("_t as a", "_line as x").join(df.selectExpr("_t as b", "_line as y")).where("a < b").selectExpr("a", "b", "levenshtein(x, y) as d").collect()}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), d in edit.items():
        if (sims[a] ^ sims[b]).bit_count() <= lines.DISTANCE and d <= (1 - lines.SIMILARITY) * max(len(texts[a]), len(texts[b])) + 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    expected = {i: find(i) for i in range(len(texts))}
    found = {r["node"]: r["component"] for r in lines.fuzzy_groups(lambda: df).collect()}
    assert {i: found.get(i, i) for i in expected} == expected and len(set(expected.values())) < len(texts)


def test_lines_with_few_words_changed_are_linked(spark):
    r = random.Random(8)
    texts, pairs = [], []
    for n in (4, 8, 12, 20, 30, 50):
        for k in range(30):
            a = prose(1000 * n + k, n).split()
            b = list(a)
            for i in r.sample(range(n), max(1, n // 20)):
                b[i] = prose(r.randint(0, 10**9), 1)
            pairs.append((len(texts), len(texts) + 1))
            texts += [" ".join(a), " ".join(b)]
    df = spark.createDataFrame(list(enumerate(texts)), "_t long, _line string")
    both = spark.createDataFrame([(a, b, texts[a], texts[b]) for a, b in pairs], "a long, b long, x string, y string")
    similar = [(p["a"], p["b"]) for p in both.selectExpr("a", "b", "levenshtein(x, y) / greatest(length(x), length(y)) as d").where("d > 0 and d <= 0.2").collect()]
    found = {p["node"]: p["component"] for p in lines.fuzzy_groups(lambda: df).collect()}
    linked = sum(a in found and found[a] == found.get(b) for a, b in similar)
    assert len(similar) > 130 and linked >= 0.97 * len(similar)
    assert all(len({i // 2 for i in found if found[i] == c}) == 1 for c in set(found.values()))


def test_lines_of_digits(spark):
    rows = [
        row(1, "2024-01-02\nTotal: 1234 EUR\n---\n+49 30 1234567"), row(2, " 2024-01-02 \n2024-01-03\nTotal: 9876 EUR\n---\n-49 30 1234567"), row(3, "total 1234 eur\n+49 30 1234567"),
    ]
    found = {r["_row"]["doc_id"]: r["kept_text"] for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: rows[0][1], 2: "2024-01-03\nTotal: 9876 EUR\n---\n-49 30 1234567", 3: ""}
