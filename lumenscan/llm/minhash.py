"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with how often it occurred before in the text.  Each
of ``SKETCHES`` random orders picks the ``PICKS`` least labelled shingles and keeps them in the order of the
text: two texts share a sketch only if they share shingles in the same order.  Texts that share a sketch are
candidates.  A candidate is verified by the longest common subsequence of the two shingle sequences within a
band: similarity is common / (all - common), and the band is as wide as any alignment of that similarity needs,
so the threshold is exact.

Two texts with the labelled similarity s share one of k sketches of p picks with a chance of about 1 - (1 - s ** p) ** k:
0.99999 at 0.8.  Candidates are grouped by ``grouping.groups``: leaders of buckets first, small buckets pair by pair.  Of large
buckets every two blocks of texts are compared as a whole: the labelled shingles that two texts share are counted by
an index of the blocks, and those that share enough for the threshold, which no alignment can exceed, are aligned unless links
found before join them.

Texts are written once, dealt out by their key; only pairs travel to them.  A key has 64 bits; texts that share one
by chance are told apart by 64 more and get others.

Defined results: a null text is an empty one; exact copies are one class whatever their length; texts without
words are near to nothing but their copies; a text of fewer than five words is one shingle; very long texts are
sketched whole, in blocks of their orders, and aligned within a band of a fifth of them; repeated rows are
copies; the class is named by its least id (null ids last) and exactly one row of it is kept, one of that id (of repeated
rows any).  Columns of any other names stay out of the plan of ``classes`` and unchanged in ``keep_one``.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, cut, different
from .grouping import blocks, groups

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
PICKS = 3
#: Texts and characters of a block of a large bucket.
BLOCK_ROWS, BLOCK_CHARS = 2048, 1 << 24

_hash = xxhash.xxh3_64_intdigest
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_random = np.random.Generator(np.random.PCG64(20))
_SEEDS = _random.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of k words in order; one for a shorter text with words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    width = min(k, len(h))
    n = len(h) - width + 1
    rolled = h[:n].copy()
    for i in range(1, width):
        rolled = rolled * _M1 + h[i : i + n]
    return _mix(rolled + np.uint64(width))


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, number of its earlier occurrences)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    if not len(s) or not (s[1:] == s[:-1]).any():
        return h
    first = np.append(True, s[1:] != s[:-1])
    at = np.arange(len(s))
    earlier = np.empty(len(s), np.uint64)
    earlier[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return _mix(h + earlier * _M2)


def sketch(h: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """The text's order sketches."""
    lab = labelled(h)
    picks = min(picks, len(h))
    found = np.empty(sketches, np.uint64)
    block = max(1, 2_000_000 // len(h))
    for a in range(0, sketches, block):
        seeds = _SEEDS[a : min(a + block, sketches)]
        g = (lab[None, :] ^ seeds[:, None]) * _M1
        g ^= g >> np.uint64(32)
        g *= _M2
        at = np.argpartition(g, picks - 1, axis=1)[:, :picks] if picks < len(h) else np.tile(np.arange(len(h)), (len(seeds), 1))
        at.sort(axis=1)
        value = np.full(len(seeds), 7, np.uint64) + np.arange(a, a + len(seeds), dtype=np.uint64)
        for p in range(picks):
            value = _mix(value * _M1 + h[at[:, p]])
        found[a : a + len(seeds)] = value
    return found


class Aligner:
    """One sequence of shingles, against which others are aligned."""

    def __init__(self, h: np.ndarray):
        self.h = h
        self._places: dict[int, list[int]] | None = None

    def places(self) -> dict[int, list[int]]:
        if self._places is None:
            self._places = {}
            for i, x in enumerate(self.h.tolist()):
                self._places.setdefault(x, []).append(i)
        return self._places

    def similarity(self, other: np.ndarray, least: float = SIMILARITY) -> float:
        """common / (all - common) by the longest common subsequence within the band; 0.0 once it is below ``least``.

        A similarity of ``least`` leaves at most (1 - least) / (1 + least) of all shingles unmatched, and no
        alignment strays further from the diagonal than that.  One row of the band is one integer: a zero bit
        for each column at which the common length grows.
        """
        a, b = self.h, other
        total = len(a) + len(b)
        if not len(a) or not len(b):
            return 0.0
        unmatched = int(total * (1 - least) / (1 + least) + 1e-9)
        if abs(len(a) - len(b)) > unmatched:
            return 0.0
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        head = int(differ[0]) if len(differ) else short
        differ = np.flatnonzero(a[len(a) - (short - head) :][::-1] != b[len(b) - (short - head) :][::-1])
        tail = int(differ[0]) if len(differ) else short - head
        stop_a, stop_b = len(a) - tail, len(b) - tail
        common = head + tail
        if stop_a > head and stop_b > head:
            common += self._banded(b[head:stop_b].tolist(), head, stop_a, unmatched, (total - unmatched) / 2 - common)
        value = common / (total - common)
        return value if value >= least - 1e-12 else 0.0

    def _banded(self, rows: list[int], start: int, stop: int, band: int, needed: float) -> int:
        places, width = self.places(), 2 * band + 1
        full, top = (1 << width) - 1, 1 << (width - 1)
        v, done, none = full, 0, ()
        n = len(rows)
        for i, x in enumerate(rows):
            m = 0
            low = i - band
            for p in places.get(x, none):
                if start <= p < stop and 0 <= p - start - low < width:
                    m |= 1 << (p - start - low)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
            if not v & 1:
                done += 1
            v = (v >> 1) | top
            if i & 63 == 63 and done + width - v.bit_count() + (n - 1 - i) < needed:
                return 0
        return done + width - v.bit_count()


@lru_cache(maxsize=8)
def _aligner(text: str) -> Aligner:
    return Aligner(shingles(text))


def similarity(x: str | None, y: str | None, least: float = SIMILARITY) -> float:
    return Aligner(shingles(x)).similarity(shingles(y), least)


def _buckets(texts: DataFrame) -> DataFrame:
    """_bucket, _t: the sketches of texts (_t, _text)."""

    def run(batches):
        for batch in batches:
            found = [sketch(h).view(np.int64) if len(h := shingles(text)) else () for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["_t", "_sketches"])

    return texts.select("_t", "_text").mapInArrow(run, "_t long, _sketches array<long>").select(F.explode("_sketches").alias("_bucket"), "_t")


def _verified(pairs: DataFrame, texts: DataFrame, work: Workspace) -> DataFrame:
    """The pairs (a, b) that are similar.  texts: _t and _text, one row for each.

    Only the texts of the first of a pair are dealt out again: so adaptive execution can split the pairs of one that has very many.
    """
    first = work.table(texts.join(pairs.select(F.col("a").alias("_t")).distinct(), "_t", "left_semi").select(F.col("_t").alias("a"), F.col("_text").alias("_ta")))
    both = pairs.join(texts.select(F.col("_t").alias("b"), F.col("_text").alias("_tb")), "b").join(first, "a").select("a", "b", "_ta", "_tb")

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = [i for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if _aligner(x or "").similarity(shingles(y)) > 0]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _links_of_blocks(bucket: int, i: int, j: int, rows: list[tuple[int, int, int, list[int], str]]) -> list[tuple[int, int]]:
    """Links that join what is linked between the blocks i and j of a bucket, or within i.  rows: _t, _c, _x, _all, _text."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    t, c, x, every, texts = zip(*rows, strict=True)
    largest = Counter(c).most_common(1)[0][0]
    sequences = [shingles(text) for text in texts]
    labels = [labelled(h) for h in sequences]
    lengths, sides, ids = np.array([len(h) for h in sequences]), np.array(x), np.array(t)
    outside = np.array([k != largest for k in c])
    tokens, owners = np.concatenate(labels), np.repeat(np.arange(len(rows)), lengths)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    found = []
    for a in np.flatnonzero(outside).tolist():
        low, high = np.searchsorted(tokens, labels[a], "left"), np.searchsorted(tokens, labels[a], "right")
        counts = high - low
        at = np.arange(counts.sum()) + np.repeat(low - np.cumsum(counts) + counts, counts)
        common = np.bincount(owners[at], minlength=len(rows))
        enough = common >= (SIMILARITY - 1e-12) * (lengths + lengths[a] - common)
        # of two outside one order is enough
        enough &= (~outside | (ids < ids[a])) & ((sides != sides[a]) | (i == j))
        aligner, known = None, set(every[a])
        for b in np.flatnonzero(enough).tolist():
            if find(c[a]) == find(c[b]) or min(known.intersection(every[b])) != bucket:
                continue
            aligner = aligner or Aligner(sequences[a])
            if aligner.similarity(sequences[b]) > 0:
                found.append((t[a], t[b]))
                root[find(c[a])] = find(c[b])
    return found


def _settled(members: DataFrame, texts: DataFrame, work: Workspace) -> DataFrame:
    """Links (a, b) that join what is linked in large buckets.  members: _bucket, _t, _c; texts: _t, _text."""
    own = work.table(texts.join(members.select("_t").distinct(), "_t", "left_semi"))
    dealt = work.table(blocks(members, own.select("_t", F.length("_text").alias("_n")), BLOCK_ROWS, BLOCK_CHARS, work))
    met = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    both = met.select("_bucket", F.least("_x", "_y").alias("_i"), F.greatest("_x", "_y").alias("_j"), "_t", "_c", "_x", "_all").join(own, "_t")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = _links_of_blocks(*[k.as_py() for k in key], list(zip(*[rows[n].to_pylist() for n in ("_t", "_c", "_x", "_all", "_text")], strict=True)))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return both.groupBy("_bucket", "_i", "_j").applyInArrow(run, "a long, b long")


def _rows(df: DataFrame, key: str, text: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """_id, _r (a number of its own), _t and _u of each row, and the texts (_t, _text), dealt out by _t; different texts have different _t."""
    docs, texts = different(df.select(F.col(f"`{key}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")), "_text", work)
    return work.table(docs.select("_id", F.monotonically_increasing_id().alias("_r"), "_t", "_u")), texts.select("_t", "_text")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, kept, and _t and _u, 64 bits each of the text: one row for each row of df, in no order."""
    with Workspace(df.sparkSession) as work:
        rows, texts = _rows(df, key, text, work)
        found = groups(_buckets(texts), lambda pairs: _verified(pairs, texts, work), lambda members: _settled(members, texts, work), work)
        least = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("y"), F.col("_r").alias("r"))
        of = rows.groupBy("_t").agg(F.min(least).alias("_least")).join(found.select(F.col("node").alias("_t"), F.col("component").alias("_c")), "_t", "left").withColumn("_c", F.coalesce("_c", "_t"))
        of = work.table(of)
        named = work.table(of.groupBy("_c").agg(F.min("_least").alias("_first")))
        of = work.table(of.join(named, "_c").select("_t", F.col("_first.y").alias("class_id"), F.col("_first.r").alias("_kept")))
        return cut(rows.join(of, "_t").select(F.col("_id").alias(key), "class_id", (F.col("_r") == F.col("_kept")).alias("kept"), "_t", "_u"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df with one row of each class, that of its least id; df's own columns."""
    kept = classes(df, key, text).where("kept").select(F.col(f"`{key}`").alias("_kid"), F.col("_u").alias("_ku"))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{key}`").alias("_id"), F.xxhash64(F.lit(1), F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_u"))
    found = packed.join(kept, (F.col("_u") == F.col("_ku")) & F.col("_id").eqNullSafe(F.col("_kid"))).select("_row", "_id", "_u")
    first = F.row_number().over(Window.partitionBy("_u", "_id").orderBy(F.lit(1)))
    return found.withColumn("_first", first).where("_first = 1").select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
