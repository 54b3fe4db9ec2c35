import math
import re
from collections import Counter

from lumenscan.llm import html, lattice, quality
from lumenscan.llm.common import tokenizer_path


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measurements_against_brute_force(edges, edge_rows, empty):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = sorted(((r["doc_id"], *[r[c] for c in columns], r["base_failed"]) for r in quality.apply_policy(quality.ledger(edges)).collect()), key=str)
    expected = sorted(((i, *(m := brute_quality(t)), m[0] < 50 or 100 * m[4] > 50 * m[0]) for i, t, *_ in edge_rows), key=str)
    assert found == expected
    assert quality.ledger(empty).count() == 0


def test_documents_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in quality.ledger(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(r["text"])
    judged = quality.apply_policy(quality.ledger(docs)).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    good = [r for r in judged.where("quality = 1 AND NOT base_failed").collect()]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)


def test_filter_and_ablations(edges, empty):
    kept = quality.filter_documents(edges)
    assert kept.columns == edges.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 2, 3, 9, 12} <= ids and not ids & {4, 5, 6, 7, 11, 13}
    rows = quality.ledger(edges).collect()
    for r in quality.ablations(quality.ledger(edges)).collect():
        bit = next(1 << x.bit for x in quality.rules() if x.name == r["rule"])
        bits = [x["fail_bits"] & quality.mask(quality.POLICY) for x in rows]
        assert r["n_failed"] == sum(bool(b & bit) for b in bits) and r["n_failed_alone"] == sum(b == bit for b in bits)
        assert r["n_kept_without"] == sum(not b & ~bit for b in bits)
    assert quality.filter_documents(empty).count() == 0


PAGE = """<html><head><title>x</title><script>var a = "<p>no</p>";</script></head><body><header><a href=/>Home</a> Site</header><div class="cookie-notice">We use cookies to improve the site and you accept it by reading on.</div>
<div id="menu"><a href=1>One</a> <a href=2>Two</a></div>{0}<div class="comments"><p>I think that the article is good and that it is the best of all of them, is it not?</p></div>
<aside>Related of the and in to is it that for</aside><form><input>Subscribe to the newsletter of the site <button>Go</button></form><footer>&copy; 2020 the site</footer></body>"""
BODY = """<h1>Title &amp; more</h1><p>The first paragraph of the article is long   enough and has a lot of\nthe stop words in it.<p>Short one.</p><!-- <p>not this</p> --><p>Another paragraph, with a <a href=x>link</a> in the text, that is long enough to be good for all of us.</p>"""
TEXT = "Title & more\n\nThe first paragraph of the article is long enough and has a lot of the stop words in it.\n\nShort one.\n\nAnother paragraph, with a link in the text, that is long enough to be good for all of us."


def test_main_text():
    for around in ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<div>{}</div>"):
        assert html.main_text(PAGE.format(around.format(BODY))) == TEXT
    for page in (None, "", "<p", "<script>x", "<!-- x", "<nav><a href=x>a b c</a></nav>"):
        assert html.main_text(page) == ""
    assert html.main_text("<p>a < b &lt; c") == "a < b < c"
    assert html.main_text("plain text") == "plain text"


def test_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    found = html.extract(pages).collect()
    assert len(found) == pages.count()
    for r in found:
        assert r["n_chars"] == len(r["text"]) and "©" not in r["text"] and "<" not in r["text"].replace("&lt;", "")
    odd = spark.createDataFrame([(1, "u", None, "c"), (1, "u", "<p>x</p>", "c")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html.extract(odd).collect()) == ["", "x"]


def test_lattice_against_all_segmentations(monkeypatch):
    p = {b" ": 0.1, b" a": 0.1, b"a": 0.2, b"b": 0.1, b"ab": 0.2, b"aba": 0.1, b" ab": 0.1, b"ba": 0.1}
    model = lattice.Lattice({k: math.log(v) for k, v in p.items()})

    def segmentations(t):
        if not t:
            yield []
        for k in range(1, len(t) + 1):
            if t[:k] in p:
                for rest in segmentations(t[k:]):
                    yield [t[:k], *rest]

    for word in (b"a", b"ab", b"abab", b"aabba"):
        ways = list(segmentations(b" " + word))
        whole = sum(math.prod(p[x] for x in s) for s in ways)
        assert abs(model.log_p(word) - math.log(whole)) < 1e-12
        for short in (24, 0):
            monkeypatch.setattr(lattice, "SHORT_WORD", short)
            found, expected = {}, Counter()
            model.expect(word, 2.0, found)
            for s in ways:
                for x in s:
                    expected[x] += 2 * math.prod(p[y] for y in s) / whole
            assert all(abs(found.get(k, 0) - expected[k]) < 1e-9 for k in p)


def test_scores_against_brute_force(spark, edges, edge_rows, empty, data):
    path = tokenizer_path("piece_bpe_32k.model")
    for df, rows in ((edges, edge_rows), (spark.read.parquet(f"{data}/documents.parquet"), None)):
        rows = rows or [(r["doc_id"], r["text"]) for r in df.collect()]
        for head in (lattice.HEAD, 50):
            found = {}
            for r in lattice.score(df, path, head=head, rounds=1).collect():
                found.setdefault(r["doc_id"], []).append(r)
            counts = Counter()
            for i, t, *_ in rows:
                if not lattice.held_out(i):
                    counts.update([*lattice.tokens(t), None])
            n, v = sum(counts.values()), len(counts)
            assert sum(map(len, found.values())) == len(rows)
            for i, t, *_ in rows:
                words = [*lattice.tokens(t), None]
                base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
                r = min(found[i], key=lambda r: abs(r["base_score"] - base))
                assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and r["held_out"] == lattice.held_out(i)
                assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n) and r["score"] < 0
    assert lattice.score(empty, path).count() == 0
