"""Language-model scores by the subword lattice of an existing vocabulary.

A word, with a mark for its start, is written by pieces of the vocabulary in all possible ways; its probability
is the sum over all these segmentations, found by a forward recursion in logarithms.  Pieces that start words
and pieces that do not make this a distribution over words.  The vocabulary comes from a public tokenizer's
file; the probabilities of its pieces are learned from the training documents by expectation maximisation over
the lattices of all distinct training words, one vote for each: what pieces have to spell is words not seen yet,
and these are like the many rare words, not like the frequent ones.

Frequent words need no segmentation to be expected: the word itself is one more edge over the whole lattice,
with its discounted relative frequency.  The discount (n1 / (n1 + 2 n2), from the words seen once and twice)
is what the pieces share out, so known and unknown words together have probability one.

The counts of all words, the model of all distinct words and the scores of all documents are distributed
tables.  Only the pieces (a fixed number) and the ``HEAD`` most frequent words are broadcast; all others are
joined.

Defined results: a null or empty text is its end token alone; a null id counts as the empty text in the fold;
repeated rows give a row each; an empty table gives none; without training words, all mass is the pieces'.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

FOLDS, HELD_OUT = 10, 0
#: Words that are looked up in place; the rest is joined.
HEAD = 200_000
ROUNDS = 2
LONGEST_PIECE = 24
#: Bytes below which a product of piece probabilities stays far from the least float.
SHORT_WORD = 24
HELD_WORDS = 300_000
_LN10 = math.log(10)


def held_out(key) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    """Words with A to Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a sentencepiece file, a space for its mark of a word's start, and all single bytes, which make every text possible."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:] and 0 < len(piece) <= LONGEST_PIECE:
                found.setdefault(piece, None)
    for b in range(256):
        found.setdefault(bytes([b]), None)
    return list(found)


class Lattice:
    """Pieces with natural logarithms of their probabilities."""

    def __init__(self, log_p: dict[bytes, float]):
        self.edges: dict[bytes, float | None] = {}
        for piece, lp in log_p.items():
            for k in range(1, len(piece)):
                self.edges.setdefault(piece[:k], None)  # only the start of longer pieces
            self.edges[piece] = lp
        self.plain = {piece: math.exp(lp) for piece, lp in log_p.items()}

    def forward(self, word: bytes) -> list[float]:
        """Log probability of each prefix of the marked word, over all its segmentations."""
        text, edges = b" " + word, self.edges
        n = len(text)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            if i:
                t = terms[i]
                if not t:
                    continue
                top = max(t)
                alpha[i] = top if len(t) == 1 else top + math.log(sum([math.exp(x - top) for x in t]))
                terms[i] = []
            a = alpha[i]
            for j in range(i + 1, min(n, i + LONGEST_PIECE) + 1):
                piece = text[i:j]
                if piece not in edges:
                    break
                lp = edges[piece]
                if lp is not None:
                    terms[j].append(a + lp)
        top = max(terms[n])
        alpha[n] = top + math.log(sum([math.exp(x - top) for x in terms[n]]))
        return alpha

    def log_p(self, word: bytes) -> float:
        return self.forward(word)[-1]

    def expect(self, word: bytes, weight: float, into: dict[bytes, float]) -> None:
        """Adds the expected number of each piece in ``weight`` occurrences of the word.

        Short words are summed as probabilities, which cannot underflow there, and long ones as logarithms.
        """
        text, edges, plain = b" " + word, self.edges, len(word) < SHORT_WORD
        n = len(text)
        alpha: list[float] = [1.0] + [0.0] * n if plain else self.forward(word)
        used: list[tuple[int, int, bytes, float]] = []
        for i in range(n):
            a = alpha[i]
            if plain and not a or a == -math.inf:
                continue
            for j in range(i + 1, min(n, i + LONGEST_PIECE) + 1):
                piece = text[i:j]
                if piece not in edges:
                    break
                lp = edges[piece]
                if lp is None:
                    continue
                if plain:
                    lp = self.plain[piece]
                    alpha[j] += a * lp
                used.append((i, j, piece, lp))
        if plain:
            beta = [0.0] * n + [weight / alpha[n]]
            for i, j, piece, p in reversed(used):  # all edges from j on come before those that end there
                x = p * beta[j]
                beta[i] += x
                into[piece] = into.get(piece, 0.0) + alpha[i] * x
            return
        log_beta = [-math.inf] * n + [0.0]
        for i, j, piece, lp in reversed(used):
            x = lp + log_beta[j]
            if x > -math.inf:
                b = log_beta[i]
                top = max(b, x)
                log_beta[i] = top + math.log(math.exp(b - top) + math.exp(x - top))
                into[piece] = into.get(piece, 0.0) + weight * math.exp(alpha[i] + x - alpha[n])


def count_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """word (bytes), c (its count in the training documents, 0 for words of the others only)."""

    def out(found: Counter, rest: set) -> pa.RecordBatch:
        words = [*found, *rest.difference(found)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([found.get(w, 0) for w in words], pa.int64())], ["word", "c"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        rest: set = set()
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (rest if held_out(k) else found).update(tokens(value))
                if len(found) + len(rest) > HELD_WORDS:
                    yield out(found, rest)
                    found.clear()
                    rest.clear()
        yield out(found, rest)

    each = df.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text")).mapInArrow(run, "word binary, c long")
    return each.groupBy("word").agg(F.sum("c").alias("c"))


def train(words: DataFrame, pieces: list[bytes], rounds: int = ROUNDS) -> dict[bytes, float]:
    """Log probabilities of the pieces: expectation maximisation over the lattices of all words of a stored table."""
    spark = words.sparkSession
    # the file's order is that of its scores: start from a probability that falls with the rank
    total = sum(1 / (i + 100) for i in range(len(pieces)))
    log_p = {p: math.log(1 / (i + 100) / total) for i, p in enumerate(pieces)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(log_p)

        def run(batches):
            lattice, found = Lattice(shared.value), {}
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    lattice.expect(word, 1.0, found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.float64())], ["piece", "n"])

        each = words.where("c > 0").select("word").mapInArrow(run, "piece binary, n double")
        found = {bytes(r["piece"]): r["n"] for r in each.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        # a little for every piece keeps all texts possible; sorted sums do not depend on the order of the tasks
        counts = {p: found.get(p, 0.0) + 0.01 for p in pieces}
        whole = math.log(math.fsum(counts.values()))
        log_p = {p: math.log(n) - whole for p, n in counts.items()}
    return log_p


def score(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of df."""
    spark = df.sparkSession
    words = stored(count_words(df, key, text))
    ids = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    is_held = F.crc32(ids.cast("binary")) % FOLDS == HELD_OUT
    n_docs = df.where(~is_held).count()
    seen = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n_words, n_types, once, twice = (x or 0 for x in seen)
    n, v = n_words + n_docs, n_types + (n_docs > 0)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    spread = math.log(discount * n_types / n) if n_types else 0.0
    base_of = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))

    pieces = spark.sparkContext.broadcast(train(words, read_pieces(path), rounds))

    def model(batches):
        lattice = Lattice(pieces.value)
        for batch in batches:
            found = []
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lp = spread + lattice.log_p(word)
                if c:
                    whole = math.log((c - discount) / n)
                    lp = max(lp, whole) + math.log1p(math.exp(-abs(lp - whole)))
                found.append(lp / _LN10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["word", "c", "lp"])

    scored = stored(words.mapInArrow(model, "word binary, c long, lp double"))
    frequent = {bytes(r["word"]): (r["c"], base_of(r["c"]), r["lp"]) for r in scored.where("c > 0").orderBy(F.desc("c"), "word").limit(head).collect()}
    known = spark.sparkContext.broadcast(frequent)
    end_base, end_lp = base_of(n_docs), math.log10(n_docs / n) if n_docs else 0.0

    names = ["_a", "_b", "_id", "word", "k", "rows", "n_tokens", "n_known", "base", "lp"]

    def look_up(batches):
        of = known.value
        for batch in batches:
            a, b, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            columns: list[list] = [[] for _ in names]
            for i, value in enumerate(texts):
                n_tokens, n_known, base, lp = 1, int(n_docs > 0), end_base, end_lp
                for word, k in Counter(tokens(value)).items():
                    n_tokens += k
                    x = of.get(word)
                    if x is not None:
                        n_known += k
                        base += k * x[1]
                        lp += k * x[2]
                    else:
                        for column, y in zip(columns, (a[i], b[i], None, word, k, 0, 0, 0, 0.0, 0.0), strict=True):
                            column.append(y)
                # a space is in no word, so these rows meet none, and each its own task
                for column, y in zip(columns, (a[i], b[i], ids[i], b" %d" % a[i], 0, 1, n_tokens, n_known, base, lp), strict=True):
                    column.append(y)
            kinds = (pa.int64(), pa.int64(), batch.schema.field(2).type, pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    id_, value = F.col(f"`{key}`"), F.col(f"`{text}`")
    docs = df.select(F.xxhash64(id_, value).alias("_a"), F.xxhash64(value, F.lit(1), id_).alias("_b"), id_.alias("_id"), value.alias("_text"))
    id_type = dict(docs.dtypes)["_id"]
    parts = docs.mapInArrow(look_up, f"_a long, _b long, _id {id_type}, word binary, k int, rows int, n_tokens long, n_known long, base double, lp double")
    of_word = scored.select(F.col("word").alias("_w"), F.col("c").alias("_c"), F.col("lp").alias("_lp"))
    base_word = F.log10((F.coalesce(F.col("_c"), F.lit(0)) + 0.1) / (n + 0.1 * (v + 1)))
    rare = F.col("rows") == 0
    summed = (
        parts.join(of_word, F.col("word") == F.col("_w"), "left")
        .select(
            "_a", "_b", "_id", "rows", "n_tokens",
            F.when(rare, F.when(F.col("_c") > 0, F.col("k")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"),
            F.when(rare, F.col("k") * base_word).otherwise(F.col("base")).alias("base"),
            F.when(rare, F.col("k") * F.col("_lp")).otherwise(F.col("lp")).alias("lp"),
        )
        .groupBy("_a", "_b")
        .agg(F.max("_id").alias("_id"), F.sum("rows").cast("int").alias("rows"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "lp")])
    )
    # equal rows were summed together: one row for each of them
    each = summed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    share = lambda c: (F.col(c) / F.col("rows"))
    return each.select(
        F.col("_id").alias(key),
        (F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT).alias("held_out"),
        share("n_tokens").cast("long").alias("n_tokens"), share("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), share("base").alias("base_score"), share("lp").alias("score"),
    )
