"""Substring dedup: words under a window of text that also starts anywhere else are removed.

Windows are dealt to shards by their minimizer, the least hash of the runs of ``RUN`` words in the window, so
that equal windows meet in one shard and a stretch of consecutive windows travels as one segment.  A window
whose minimizer occurs once in the corpus occurs once itself, so only segments with a repeated minimizer are
shipped.  Each shard builds a compressed FM-index of its segments (``fmindex``); backward search over its
wavelet matrix computes the matching statistics of the segments that are streamed past it and reports the
intervals that occur twice.  These come back to their documents, where they are joined and removed.

Shards are cut between minimizers at ``SHARD_WORDS`` words, so memory is bounded.  A minimizer with more than
``HOT`` segments is split by the hash of its windows before it is shipped; equal segments of a task travel once.

Defined results: a null or empty text has no words and removes none; texts shorter than the window lose
nothing; repeated rows are documents of their own, so their windows are repeats; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex, repeated

WINDOW = 35
RUN = 8
SHARD_WORDS = 400_000
HOT = 20_000
#: Distinct segments that a task holds before it sends them on.
HELD_SEGMENTS = 60_000
#: Words of texts that are hashed at once.
HELD_WORDS = 200_000

_M = np.uint64(0x9E3779B97F4A7C15)
_hash = xxhash.xxh3_64_intdigest


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def segments(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer, is it there twice) of the stretches of windows of one owner with one minimizer.

    hashes: of the words of many texts, one after another; owner: of each word, the text's number.  A minimizer
    that starts at two places of these texts can have equal windows within one stretch.
    """
    run = min(run, window)
    n = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none.astype(bool)
    rolled = hashes[: len(hashes) - run + 1].copy()
    for i in range(1, run):
        rolled = rolled * _M + hashes[i : len(hashes) - run + 1 + i]
    least, width, span = _mix(rolled), 1, window - run + 1
    in_order = np.sort(least)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    valid = owner[:n] == owner[window - 1 :]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, n))
    good = valid[first]
    values = least[first[good]]
    at = np.searchsorted(twice, values)
    again = twice[np.minimum(at, len(twice) - 1)] == values if len(twice) else np.zeros(len(values), bool)
    return first[good], count[good], values.view(np.int64), again


def _minimizers(df: DataFrame, window: int) -> DataFrame:
    """One row for each segment: _a and _b (the row), _start, _windows, _min, _times."""

    def some(a, b, split) -> pa.RecordBatch:
        lengths = np.array([len(w) for w in split], np.int64)
        owner = np.repeat(np.arange(len(split)), lengths)
        first, count, least, again = segments(word_hashes([w for x in split for w in x]), owner, window)
        of = owner[first] if len(first) else np.zeros(0, np.int64)
        start = first - (np.cumsum(lengths) - lengths)[of]
        take = pa.array(of)
        return pa.RecordBatch.from_arrays([a.take(take), b.take(take), *[pa.array(x.astype(np.int32)) for x in (start, count)], pa.array(least), pa.array(1 + again.astype(np.int32))], ["_a", "_b", "_start", "_windows", "_min", "_times"])

    def run(batches):
        for batch in batches:
            split, words, begun = [], 0, 0
            for k, text in enumerate(batch.column(2).to_pylist()):
                split.append((text or "").encode("utf-8", "surrogatepass").split())
                words += len(split[-1])
                if words > HELD_WORDS:
                    yield some(batch.column(0)[begun : k + 1], batch.column(1)[begun : k + 1], split)
                    split, words, begun = [], 0, k + 1
            if split:
                yield some(batch.column(0)[begun:], batch.column(1)[begun:], split)

    return df.mapInArrow(run, "_a long, _b long, _start int, _windows int, _min long, _times int")


def _shipped(df: DataFrame, window: int) -> DataFrame:
    """Segments with their words: _part (what a shard keeps together), _words, _places (rows and starts)."""

    def run(batches):
        held: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            places = list(held.values())
            flat = [p for x in places for p in x]
            inner = pa.StructArray.from_arrays(
                [pa.array([p[0] for p in flat], pa.int64()), pa.array([p[1] for p in flat], pa.int64()), pa.array([p[2] for p in flat], pa.int32())], ["a", "b", "start"]
            )
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in places]))).astype(np.int32)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), inner)],
                ["_part", "_words", "_places"],
            )
            held.clear()
            return batch

        n_places = 0
        for batch in batches:
            for i, h, text, found in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), batch.column("_text").to_pylist(), batch.column("_found").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                for s in found:
                    start, windows, part = s["_start"], s["_windows"], s["_min"]
                    if s["_n"] <= HOT:
                        held.setdefault((part, b" ".join(words[start : start + windows + window - 1])), []).append((i, h, start))
                        n_places += 1
                        continue
                    pieces = 1 + s["_n"] // HOT
                    own = [_hash(b" ".join(words[a : a + window])) % pieces for a in range(start, start + windows)]
                    a = 0
                    while a < windows:
                        b = a
                        while b < windows and own[b] == own[a]:
                            b += 1
                        key = _hash(b"%d %d" % (part, own[a])) - (1 << 63)
                        held.setdefault((key, b" ".join(words[start + a : start + b + window - 1])), []).append((i, h, start + a))
                        n_places += 1
                        a = b
            if len(held) > HELD_SEGMENTS or n_places > 4 * HELD_SEGMENTS:
                yield out()
                n_places = 0
        if held:
            yield out()

    return df.mapInArrow(run, "_part long, _words binary, _places array<struct<a:long,b:long,start:int>>")


def _judge(segments_of: dict[tuple[int, bytes], list[list[tuple]]], window: int) -> Iterator[tuple]:
    """(a, b, start, end) of the repeated intervals of one shard."""
    items = [(words.split(b" "), [p for x in places for p in x]) for (_, words), places in segments_of.items()]
    weights = np.array([len(p) for _, p in items], np.int64)
    single = np.flatnonzero(weights == 1)
    for words, places in items:
        if len(places) > 1:  # the whole segment occurs elsewhere
            for i, h, start in places:
                yield i, h, start, start + len(words)
    if not len(single):
        return
    known: dict[bytes, int] = {}
    sequences = [np.fromiter((known.setdefault(w, len(known) + 1) for w in words), np.int64, len(words)) for words, _ in items]
    index = FMIndex(sequences, weights)
    lengths = np.array([len(sequences[i]) for i in single], np.int64)
    for lane, start, end in repeated(index, single, lengths, window):
        i, h, at = items[single[lane]][1][0]
        yield i, h, at + start, at + end


def _searched(df: DataFrame, window: int) -> DataFrame:
    """df: shipped segments, partitioned and sorted by _part.  Gives _a, _b, _start, _end."""

    def run(batches):
        held: dict[tuple[int, bytes], list] = {}
        words, last = 0, None

        def out() -> pa.RecordBatch:
            rows = list(_judge(held, window))
            held.clear()
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["_a", "_b", "_start", "_end"])

        for batch in batches:
            places = batch.column("_places")
            flat, offsets = places.flatten(), places.offsets.to_numpy() - places.offsets[0].as_py()
            triples = list(zip(*(flat.field(n).to_pylist() for n in ("a", "b", "start")), strict=True))
            for k, (part, data) in enumerate(zip(batch.column("_part").to_pylist(), batch.column("_words").to_pylist(), strict=True)):
                if part != last and words >= SHARD_WORDS:
                    yield out()
                    words = 0
                last = part
                own = held.setdefault((part, data), [])
                if not own:
                    words += data.count(b" ") + 2
                own.append(triples[offsets[k] : offsets[k + 1]])
        if held:
            yield out()

    return df.mapInArrow(run, "_a long, _b long, _start int, _end int")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of df: key, _text, spans (array of the repeated word intervals, unmerged; null if none)."""
    id_, value = F.col(f"`{key}`"), F.col(f"`{text}`")
    # a row is known by 128 bits of its id and text: never null, and equal for equal rows, whose results are equal
    docs = df.select(id_.alias("_id"), F.xxhash64(id_, value).alias("_a"), F.xxhash64(value, F.lit(1), id_).alias("_b"), value.alias("_text"))
    found = _minimizers(docs.select("_a", "_b", "_text"), window)
    often = found.groupBy("_min").agg(F.sum("_times").alias("_n")).where("_n > 1")
    candidates = found.join(often, "_min").groupBy("_a", "_b").agg(F.collect_list(F.struct("_start", "_windows", "_min", "_n")).alias("_found"))
    # of two equal rows each finds the segments of both in _found: it ships them once, so their places count twice
    shipped = _shipped(docs.join(candidates.withColumn("_found", F.array_distinct("_found")), ["_a", "_b"]), window)
    spans = (
        _searched(shipped.repartition("_part").sortWithinPartitions("_part"), window)
        .groupBy("_a", "_b")
        .agg(F.collect_list(F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"))).alias("spans"))
    )
    return docs.join(spans, ["_a", "_b"], "left").select(F.col("_id").alias(key), "_text", "spans")


def removal(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, kept_text: the words that remain, joined by one space."""
    of = repeated_spans(df, key, text, window)

    def run(batches):
        for batch in batches:
            rows = []
            for value, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (value or "").encode("utf-8", "surrogatepass").split()
                n, gone = len(words), 0
                if spans:
                    kept, at = [], 0
                    for start, end in sorted((s["start"], s["end"]) for s in spans):
                        if start > at:
                            kept += words[at:start]
                        gone += max(0, end - max(start, at))
                        at = max(at, end)
                    words = kept + words[at:]
                left = b" ".join(words)
                rows.append((n, gone, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass")))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], [key, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return of.mapInArrow(run, f"`{key}` {dict(of.dtypes)[key]}, n_words long, n_removed long, kept_sha256 string, kept_text string")
