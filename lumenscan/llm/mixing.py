"""Mixing sources to target weights.

The weight of a source is its share of the tokens to the power of an exponent, normalised: 1 keeps the shares,
0 makes all sources equal.  The exponent is bisected to meet a target: an entropy of the weights, or a greatest
number of times that any source is repeated.  The weights are realised within a budget of tokens.  Each source
is read in whole passes and a part of one; a pass is a keyed permutation of the source's blocks and of the rows
within each, so a part is a prefix of a permutation and every pass is another order.

The number of sources is small enough for the driver; nothing else is collected.  A prefix is cut by the running
sums of whole blocks, then within the one block where the budget ends, so a source with a third of all rows is
never in one task.

Defined results: a null source is a source of its own; a null or empty text has no tokens and takes no budget;
an empty table, or one without tokens, gives no rows; repeated rows are taken as often as their fellows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Rows of a block, about.
BLOCK_ROWS = 512


@dataclass(frozen=True)
class Mix:
    exponent: float
    weights: dict
    copies: dict  # how often each source is read, with fractions
    budget: float


def weights_of(tokens: dict, exponent: float) -> dict:
    """Shares to the power of the exponent, normalised; sources without tokens have none."""
    whole = math.fsum(tokens.values())
    raw = {k: (v / whole) ** exponent if v > 0 else 0.0 for k, v in tokens.items()}
    total = math.fsum(raw.values())
    return {k: v / total for k, v in raw.items()}


def entropy(weights: dict) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(good, rounds: int = 80) -> float:
    """The greatest exponent in [0, 1] of which ``good`` holds; 0 if of none.  good holds below some exponent only."""
    if good(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def plan_mix(tokens: dict, entropy_share: float | None = None, most_repeats: float | None = None, budget: float | None = None, cover: bool = False) -> Mix:
    """The mix of sources with these numbers of tokens.

    entropy_share: the entropy of the weights is at least this share of its maximum, at the exponent nearest to 1.
    most_repeats: the exponent is as low as it can be with no source read more often than this; where both are
    given, the entropy's exponent is raised until the limit holds.  budget: tokens to be taken, all of them if
    None.  cover: the budget is instead the least that takes every source whole.
    """
    alive = {k: v for k, v in tokens.items() if v > 0}
    if not alive:
        return Mix(1.0, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 0.0), 0.0)
    whole = math.fsum(alive.values())

    def budget_at(exponent: float) -> float:
        if cover:
            w = weights_of(alive, exponent)
            return max(alive[k] / w[k] for k in alive)
        return whole if budget is None else float(budget)

    def repeats(exponent: float) -> float:
        w = weights_of(alive, exponent)
        return max(w[k] * budget_at(exponent) / alive[k] for k in alive)

    exponent = 1.0
    if entropy_share is not None:
        target = entropy_share * math.log(len(alive))
        exponent = _bisect(lambda e: entropy(weights_of(alive, e)) >= target - 1e-12)
    if most_repeats is not None and (entropy_share is None or repeats(exponent) > most_repeats):
        exponent = max(exponent if entropy_share is not None else 0.0, 1 - _bisect(lambda e: repeats(1 - e) <= most_repeats + 1e-12))
    w = weights_of(tokens, exponent)
    b = budget_at(exponent)
    return Mix(exponent, w, {k: w[k] * b / v if v > 0 else 0.0 for k, v in tokens.items()}, b)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", *, seed: int = 1, entropy_share: float | None = None,
    most_repeats: float | None = None, budget: float | None = None, cover: bool = False, keep_row: bool = False,
) -> DataFrame:
    """One row for each time that a row of df is taken: key, source, n_tokens, pass, block, position (in the block), weight.

    keep_row: also ``_row``, the row of df as a struct.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_source"), n_words(F.col(f"`{text}`")).alias("_n"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")] if keep_row else []),
    )
    totals = {r["_source"]: (r["t"], r["k"]) for r in rows.groupBy("_source").agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("k")).collect()}
    plan = plan_mix({k: t for k, (t, _) in totals.items()}, entropy_share, most_repeats, budget, cover)
    kind = df.schema[source].dataType.simpleString()
    parts = [
        (k, float(plan.weights[k]), int(plan.copies[k] + 1e-9), float((plan.copies[k] - int(plan.copies[k] + 1e-9)) * t), 1 + n // BLOCK_ROWS)
        for k, (t, n) in totals.items()
        if plan.copies[k] > 0
    ]
    sources = spark.createDataFrame(parts, f"_s {kind}, weight double, _whole int, _part double, _blocks long")
    # as many rows as there are sources
    known = rows.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_s")), "inner").drop("_s")
    mixed = lambda *x: F.xxhash64(F.lit(seed), *x)
    blocked = known.withColumn("_block", F.pmod(mixed(F.lit("block"), "_key", "_n"), F.col("_blocks")))
    carried = ["_key", "_source", "_n", "weight", "_block", *(["_row"] if keep_row else [])]

    def placed(each: DataFrame) -> DataFrame:
        return each.withColumns({"_block_order": mixed(F.lit("order"), "_source", "_pass", "_block"), "_row_order": mixed(F.lit("row"), "_pass", "_key", "_n")})

    full = placed(blocked.where("_whole > 0").select(*carried, F.explode(F.sequence(F.lit(0), F.col("_whole") - 1)).alias("_pass")))
    last = placed(blocked.where("_part >= 1").withColumn("_pass", F.col("_whole"))).drop("_whole")
    sums = last.groupBy("_source", "_block", "_block_order", "_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_block_order", "_block").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where(F.col("_before") + F.col("_sum") > F.col("_part"))
    # one row of a source: the block where its budget ends; those before it in the permutation are taken whole
    edge = cuts.groupBy("_source").agg(F.min(F.struct("_block_order", "_block", "_before")).alias("_edge")).withColumnRenamed("_source", "_s")
    ended = last.join(F.broadcast(edge), F.col("_source").eqNullSafe(F.col("_s")), "left")
    here, there = F.struct("_block_order", "_block"), F.struct(F.col("_edge._block_order"), F.col("_edge._block"))
    out = [*carried, "_pass", "_block_order", "_row_order"]
    whole_blocks = ended.where(F.col("_edge").isNull() | (here < there)).select(*out)
    running = F.sum("_n").over(Window.partitionBy("_source", "_block").orderBy("_row_order", "_key").rowsBetween(Window.unboundedPreceding, 0))
    edge_rows = ended.where(here == there).withColumn("_run", running).where(F.col("_edge._before") + F.col("_run") <= F.col("_part")).select(*out)
    every = full.select(*out).unionByName(whole_blocks).unionByName(edge_rows)
    return every.select(
        F.col("_key").alias(key), F.col("_source").alias(source), F.col("_n").alias("n_tokens"), F.col("_pass").cast("long").alias("pass"),
        F.col("_block").alias("block"), F.col("_block_order").alias("block_order"), F.col("_row_order").alias("row_order"), "weight", *(["_row"] if keep_row else []),
    )


def mix_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows of df as often as the mix takes them, with df's own columns."""
    found = mix(df, key, source, text, keep_row=True, **how)
    return found.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
