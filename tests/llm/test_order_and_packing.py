import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lumenscan.llm import mixing, order, packing, tokens
from lumenscan.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def reference_ids(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_tokens_are_those_of_the_tokenizer(edge_rows):
    texts = [t for _, t, *_ in edge_rows] + ["It's 12,345.67 don't stop!!! <|ENDOFTEXT|> <|endoftext|>", "É́ étude ΣΑΣ İstanbul ﬁn …", "a b c ​"]
    words = tokens.WordTokens(PATH, cache_words=20)
    for _ in range(2):
        assert [words.ids(t).tolist() for t in texts] == reference_ids(texts)


def test_shortest_pack_first():
    rng = np.random.default_rng(1)
    for _ in range(50):
        histogram = Counter(rng.integers(1, 65, rng.integers(1, 300)).tolist())
        packs = packing.shortest_pack_first(histogram, 64)
        got = Counter()
        for n, lengths in packs:
            assert sum(lengths) <= 64 and n > 0
            for x in lengths:
                got[x] += n
        assert got == histogram
        # one by one, longest first, into the pack with the most room
        rooms = []
        for x in sorted(histogram.elements(), reverse=True):
            k = max(range(len(rooms)), key=rooms.__getitem__, default=None)
            if k is None or rooms[k] < x:
                rooms.append(64)
                k = len(rooms) - 1
            rooms[k] -= x
        assert sorted(rooms) == sorted(64 - sum(lengths) for n, lengths in packs for _ in range(n))
    assert packing.shortest_pack_first({}) == []


def check_packed(rows, found, capacity):
    pieces = defaultdict(list)
    for r in found:
        pieces[r["sequence_id"]].append(r)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    expected = Counter()
    for (i, *_), ids in zip(rows, reference_ids([t for _, t, *_ in rows]), strict=True):
        ids = np.array([*ids, 1], "<u4")
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            expected[i, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == expected


def test_packing(edges, edge_rows, empty, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_BUCKET", 5)
    for capacity in (2048, 64):
        check_packed(edge_rows, packing.pack_documents(edges, PATH, capacity=capacity).collect(), capacity)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        f = order.Feistel(n, 5)
        slots = f.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (f.sequence(slots) == np.arange(n)).all()
    assert (order.Feistel(1000, 1).slot(np.arange(1000)) != order.Feistel(1000, 2).slot(np.arange(1000))).any()


def test_training_order_round_trip(edges, edge_rows, empty):
    shards = order.materialise(edges, PATH, length=64, per_shard=4).collect()
    slots, found, n = [], defaultdict(list), 0
    for s in shards:
        rows = order.read_slots(s["data"], s["first_slot"], s["first_slot"], s["n_sequences"], 64)
        for ids, e in zip(rows, s["entries"], strict=True):
            slots.append(e["slot"])
            assert zlib.crc32(ids.tobytes()) == e["crc32"] and (ids[e["n_ids"] :] == order.PAD_ID).all()
            at = 0
            for d in e["docs"]:
                found[d["id"]].append((d["start"], ids[at : at + d["length"]].tolist()))
                at += d["length"]
                n += d["length"]
    assert sorted(slots) == list(range(len(slots)))
    expected = defaultdict(list)
    for (i, *_), ids in zip(edge_rows, reference_ids([t for _, t, *_ in edge_rows]), strict=True):
        expected[i].append([*ids, 1])
    assert n == sum(len(x) for v in expected.values() for x in v)
    for i, texts in expected.items():
        if len(texts) == 1:
            assert [x for _, part in sorted(found[i], key=lambda p: p[0]) for x in part] == texts[0]
    assert order.index(order.materialise(empty, PATH)).count() == 0


def test_mix_plans():
    tokens_of = {"a": 900.0, "b": 90.0, "c": 10.0, "d": 0.0}
    assert mixing.plan_mix(tokens_of).exponent == 1.0
    even = mixing.plan_mix(tokens_of, entropy_share=0.9)
    assert abs(mixing.entropy(even.weights) - 0.9 * np.log(3)) < 1e-6 and even.copies["d"] == 0.0
    few = mixing.plan_mix(tokens_of, most_repeats=2.0, cover=True)
    assert abs(max(few.copies.values()) - 2.0) < 1e-6 and min(v for k, v in few.copies.items() if k != "d") >= 1 - 1e-9
    both = mixing.plan_mix(tokens_of, entropy_share=0.99, most_repeats=4.0)
    assert max(both.copies.values()) <= 4.0 + 1e-6
    assert mixing.plan_mix({}).budget == 0.0


def test_mixing_takes_whole_passes_and_prefixes(spark, edges, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[min(i % 9, 2)]) for i in range(200)], "doc_id long, text string, source string")
    found = mixing.mix(df, entropy_share=0.95, most_repeats=3.0).collect()
    n_words = {i: 1 + i % 7 for i in range(200)}
    source = {i: "abc"[min(i % 9, 2)] for i in range(200)}
    totals = Counter()
    for i in n_words:
        totals[source[i]] += n_words[i]
    plan = mixing.plan_mix(dict(totals), 0.95, 3.0)
    for s in "abc":
        own = [r for r in found if r["source"] == s]
        times = Counter(r["doc_id"] for r in own)
        whole = int(plan.copies[s] + 1e-9)
        assert all(times[i] in (whole, whole + 1) for i in n_words if source[i] == s)
        left = plan.copies[s] * totals[s] - sum(r["n_tokens"] for r in own)
        assert -1e-6 <= left < 8  # the next row of the permutation would not fit
    assert len({(r["doc_id"], r["pass"]) for r in found}) == len(found)
    covered = mixing.mix_documents(edges, most_repeats=2.0, cover=True)
    assert covered.columns == edges.columns
    with_words = {r["doc_id"] for r in edges.where("text rlike '[^\\\\s]'").collect()}
    assert with_words <= {r["doc_id"] for r in covered.collect()}
    assert mixing.mix(empty).count() == 0


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sizes = [docs.count()]
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, data).cache()
        assert out.columns == docs.columns, name
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] <= sizes[4] <= 2 * sizes[3] + 20
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check_packed(rows, corpus_pipeline.STAGES[-1][1](spark, docs, data).collect(), 2048)
