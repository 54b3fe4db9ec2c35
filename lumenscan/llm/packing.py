"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Every document is cut into pieces of at most ``capacity`` ids.  Only the number of pieces of each length reaches
the driver: at most ``capacity`` counts, whatever the corpus.  Lengths are placed longest first, each into the
pack with the most room, in counts of equal packs; pieces are then dealt to the packs by their rank among those
of their length.

Defined results: a null or empty text is one piece, the end id alone; repeated rows are packed once each; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import word_tokens

CAPACITY = 2048
END_ID = 1
#: Pieces of one length are ranked in so many groups at least; more of them with more pieces.
PIECES_PER_BUCKET = 20_000

PIECES = "length long, ids_crc32 long, doc_tokens long"


def shortest_pack_first(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Packs as (count, lengths), the lengths in the order in which they were placed.

    Lengths go longest first, each piece into the pack that has the most room.  Where not even that pack has
    room, new ones are opened, which the same length fills.  Equal packs are one entry with a count, so each
    length splits one entry at most: the work depends on the number of lengths, not of pieces.
    """
    if any(not 0 < x <= capacity or n < 0 for x, n in histogram.items()):
        raise ValueError(f"lengths must be 1 to {capacity}")
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            room = max(open_packs, default=0)
            if room >= length:
                packs = open_packs[room]
                n, pack = packs.pop()
                if not packs:
                    del open_packs[room]
                used = min(n, left)
                if n > used:
                    open_packs.setdefault(room, []).append((n - used, pack))
                open_packs.setdefault(room - length, []).append((used, (*pack, length)))
                left -= used
            else:
                fit = capacity // length
                for count, size in ((left // fit, fit), (1, left % fit)):
                    if count and size:
                        open_packs.setdefault(capacity - size * length, []).append((count, (length,) * size))
                left = 0
    return [x for room in sorted(open_packs) for x in open_packs[room]]


def assignment(packs: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset): the pieces from that rank on go to the sequences from that one on."""
    next_rank: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rank = next_rank.get(length, 0)
            found.setdefault(length, []).append((rank, sequence, offset))
            next_rank[length] = rank + count
            offset += length
        sequence += count
    return {k: np.array(v, np.int64) for k, v in found.items()}


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens: the ids of each text and the end id, cut every ``capacity`` ids."""

    def run(batches):
        encoder = word_tokens(path)
        for batch in batches:
            keys, starts, lengths, sums, totals = [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoder.ids(value).astype("<u4"), np.array([end_id], "<u4"))
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    keys.append(i)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                    totals.append(len(ids))
            longs = [pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *longs], [key, "start", "length", "ids_crc32", "doc_tokens"])

    of = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    return of.mapInArrow(run, f"`{key}` {dict(of.dtypes)[key]}, start long, {PIECES}")


def pack(cut_pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, which are read more than once: give a stored table.

    The rank of a piece is its place in its bucket of its length, after the counts of the buckets before it, so
    no task ranks all pieces of a length.  Ties of key and start are of equal rows and may go either way.
    """
    spark = cut_pieces.sparkSession
    counts = cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    buckets = 1 + sum(histogram.values()) // PIECES_PER_BUCKET
    placed = assignment(shortest_pack_first(histogram, capacity))
    shared = spark.sparkContext.broadcast(placed)

    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col("start")), F.lit(buckets)).alias("_bucket")
    dealt = cut_pieces.select("*", bucket)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col("length").alias("_length"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    within = Window.partitionBy("length", "_bucket").orderBy(F.col(f"`{key}`"), "start", "ids_crc32")
    ranked = (
        dealt.withColumn("_row", F.row_number().over(within) - 1)
        .join(first, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
        .select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_row")).alias("_rank"))
    )

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                rows = shared.value[int(x)]
                which = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at] = rows[which, 1] + rank[at] - rows[which, 0]
                offset[at] = rows[which, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"`{key}` {dict(ranked.dtypes)[key]}, start long, {PIECES}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenises once, stores the pieces (a few numbers each, no ids) and packs them."""
    return pack(cut(pieces(df, path, key, text, capacity, end_id)), key, capacity)
