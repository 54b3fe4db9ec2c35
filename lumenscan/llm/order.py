"""Training-order materialisation: every sequence of token ids gets a global slot by a keyed permutation.

Texts are tokenised, dealt by the hash of their ids into buckets, and each bucket is one stream of ids that is
cut into sequences of equal length; only a bucket's last one is padded.  The sequences are numbered by bucket, so
their numbers are dense.  A Feistel network over the next even number of bits, walked along its cycle until the
value is small enough, permutes these numbers: slot and sequence are computed from each other, with nothing
stored.  Shards are ranges of slots, each a fixed number of sequences of a fixed number of bytes, so the place
of any slot is known and a reader goes on from any slot.

Defined results: a null or empty text is its end id alone; repeated rows follow one another; an empty table has
no sequences; the last shard may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import word_tokens

LENGTH = 2048
END_ID, PAD_ID = 1, 0
SHARD_SEQUENCES = 1024
ROUNDS = 6
#: Characters of the texts of a bucket, about.
BUCKET_CHARS = 8_000_000


class Feistel:
    """A permutation of 0 to n - 1, keyed."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(self._mix_int(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03)) for r in range(ROUNDS)]

    @staticmethod
    def _mix_int(x: int) -> int:
        x &= (1 << 64) - 1
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
        return x ^ (x >> 31)

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._f(left, key), left
            else:
                left, right = right, left ^ self._f(right, key)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = np.atleast_1d(np.asarray(x, np.uint64)).copy()
        todo = np.arange(len(x))
        while len(todo):
            x[todo] = self._once(x[todo], back)
            todo = todo[x[todo] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def slot(self, sequence) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot) -> np.ndarray:
        return self._walk(slot, True)


def sequences(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """bucket, number (in the bucket), data (ids, little-endian), n_ids (without padding), docs (array of id, start, length in order)."""
    kind = dict(df.dtypes)[key]
    chars = df.agg(F.sum(F.length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = 1 + chars // BUCKET_CHARS

    def encode(batches):
        encoder = word_tokens(path)
        end = np.array([END_ID], encoder.dtype).tobytes()
        for batch in batches:
            data = [encoder.ids(t).tobytes() + end for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["_bucket", "_id", "_data"])

    of = df.select(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).alias("_bucket"), F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    encoded = of.mapInArrow(encode, f"_bucket long, _id {kind}, _data binary")

    def cut_stream(batches) -> Iterator[pa.RecordBatch]:
        dtype = word_tokens(path).dtype
        stride = length * dtype.itemsize
        state: dict = {"bucket": None, "number": 0, "kind": None}
        buffer, docs = bytearray(), []
        rows: list[tuple] = []

        def one(data: bytes, n: int) -> None:
            rows.append((state["bucket"], state["number"], data, n, docs.copy()))
            state["number"] += 1
            docs.clear()

        def finish() -> None:
            if buffer:
                n = len(buffer) // dtype.itemsize
                one(bytes(buffer) + np.full(length - n, PAD_ID, dtype).tobytes(), n)
                buffer.clear()

        def out() -> pa.RecordBatch:
            flat = [d for r in rows for d in r[4]]
            inner = pa.StructArray.from_arrays([pa.array([d[0] for d in flat], state["kind"]), pa.array([d[1] for d in flat], pa.int64()), pa.array([d[2] for d in flat], pa.int64())], ["id", "start", "length"])
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(r[4]) for r in rows]))).astype(np.int32))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))]
            rows.clear()
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, inner)], ["bucket", "number", "data", "n_ids", "docs"])

        for batch in batches:
            state["kind"] = batch.schema.field(1).type
            for bucket, i, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if bucket != state["bucket"]:
                    finish()
                    state |= {"bucket": bucket, "number": 0}
                at = 0
                while at < len(data):
                    take = min(stride - len(buffer), len(data) - at)
                    docs.append((i, at // dtype.itemsize, take // dtype.itemsize))
                    buffer += data[at : at + take]
                    at += take
                    if len(buffer) == stride:
                        one(bytes(buffer), length)
                        buffer.clear()
            if len(rows) >= 256:
                yield out()
        finish()
        if rows:
            yield out()

    in_order = encoded.repartition("_bucket").sortWithinPartitions("_bucket", "_id", "_data")
    return in_order.mapInArrow(cut_stream, f"bucket long, number long, data binary, n_ids long, docs array<struct<id:{kind},start:long,length:long>>")


def with_slots(found: DataFrame, key: int) -> tuple[DataFrame, int]:
    """Adds ``sequence`` (dense) and ``slot`` to a stored table of sequences; also their number."""
    counts = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("_k"))
    # a row of a bucket, of which there is one for some million characters
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_k").over(before), F.lit(0))).select("bucket", "_first")
    n = found.count()
    network = Feistel(max(n, 1), key)

    def run(batches):
        for batch in batches:
            slot = network.slot(batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], [*batch.schema.names, "slot"])

    numbered = found.join(first, "bucket").select("data", "n_ids", "docs", (F.col("_first") + F.col("number")).alias("sequence"))
    return numbered.mapInArrow(run, f"data binary, n_ids long, docs {dict(numbered.dtypes)['docs']}, sequence long, slot long"), n


def shards(slotted: DataFrame, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """shard, first_slot, n_sequences, data (their bytes in the order of slots), entries (slot, sequence, n_ids, crc32, docs)."""
    docs = dict(slotted.dtypes)["docs"]
    dealt = slotted.withColumn("shard", F.floor(F.col("slot") / per_shard)).repartition("shard").sortWithinPartitions("shard", "slot").select("shard", "slot", "sequence", "n_ids", "docs", "data")

    def run(batches):
        held: list[tuple] = []
        kind = None

        def out() -> pa.RecordBatch:
            entries = [{"slot": r[1], "sequence": r[2], "n_ids": r[3], "crc32": zlib.crc32(r[5]), "docs": r[4]} for r in held]
            struct = pa.struct([("slot", pa.int64()), ("sequence", pa.int64()), ("n_ids", pa.int64()), ("crc32", pa.int64()), ("docs", kind)])
            row = [pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([b"".join(r[5] for r in held)], pa.binary()), pa.array([entries], pa.list_(struct))]
            held.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "first_slot", "n_sequences", "data", "entries"])

        for batch in batches:
            kind = batch.schema.field("docs").type
            for r in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if held and held[0][0] != r[0]:
                    yield out()
                held.append(r)
        if held:
            yield out()

    return dealt.mapInArrow(run, f"shard long, first_slot long, n_sequences long, data binary, entries array<struct<slot:long,sequence:long,n_ids:long,crc32:long,docs:{docs}>>")


def materialise(df: DataFrame, path: str, key: int = 1, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = SHARD_SEQUENCES) -> DataFrame:
    """The shards of a table of texts."""
    found = stored(sequences(df, path, id_column, text, length))
    return shards(with_slots(found, key)[0], per_shard)


def index(found: DataFrame, length: int = LENGTH, width: int = 2) -> DataFrame:
    """One row for each sequence: where its bytes are, what they are, and whose."""
    return found.select("shard", "first_slot", F.explode("entries").alias("e")).select(
        F.col("e.slot").alias("slot"), "shard", ((F.col("e.slot") - F.col("first_slot")) * length * width).alias("offset"), F.col("e.sequence").alias("sequence"),
        F.col("e.n_ids").alias("n_ids"), F.col("e.crc32").alias("data_crc32"), F.col("e.docs.id").alias("doc_ids"), F.col("e.docs.start").alias("starts"), F.col("e.docs.length").alias("lengths"),
    )


def read_slots(data: bytes, first_slot: int, slot: int, count: int, length: int = LENGTH, width: int = 2) -> np.ndarray:
    """``count`` sequences from a slot on, out of a shard's bytes."""
    stride = length * width
    at = (slot - first_slot) * stride
    return np.frombuffer(data[at : at + count * stride], f"<u{width}").reshape(-1, length)
