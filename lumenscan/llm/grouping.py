"""Groups of similar things from buckets of candidates, at a cost in rows of the buckets.

Each bucket's leader, the member that shares most buckets, first meets the bucket's others.  What is not in the
component of the leader then meets the bucket's members of other components: in buckets of up to ``SMALL`` members pair
by pair, which is at most SMALL times their rows.  Larger buckets are dealt out in blocks of members, and every two blocks of a bucket
meet as a whole: rows grow with the blocks, not with the pairs, and no pair of different components is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import components

SMALL = 16


def _with_components(shared: DataFrame, groups: DataFrame | None, *names: str) -> DataFrame:
    for name in names:
        if groups is None:
            shared = shared.withColumn(f"{name}_c", F.col(name))
        else:
            of = groups.select(F.col("node").alias(name), F.col("component").alias("_of"))
            shared = shared.join(of, name, "left").withColumn(f"{name}_c", F.coalesce("_of", name)).drop("_of")
    return shared


def blocks(members: DataFrame, sizes: DataFrame, most_rows: int, most_chars: int, work: Workspace) -> DataFrame:
    """_t, _c, _bucket, _all (the member's buckets, so that two meet in one of them only), _x (its block) and _of (the number of blocks of the bucket).

    members: _bucket, _t, _c; sizes: _t, _n (characters).
    """
    each = work.table(members.join(sizes, "_t").select("_bucket", "_t", "_c", "_n"))
    of = work.table(each.groupBy("_bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / most_rows), F.ceil(F.sum("_n") / most_chars), F.lit(1)).cast("int").alias("_of")))
    every = each.groupBy("_t").agg(F.array_sort(F.collect_set("_bucket")).alias("_all"))
    return each.join(every, "_t").join(of, "_bucket").select("_t", "_c", "_bucket", "_all", F.pmod(F.xxhash64("_t", F.lit(5)), F.col("_of")).cast("int").alias("_x"), "_of")


def groups(buckets: DataFrame, linked: Callable[[DataFrame], DataFrame], settled: Callable[[DataFrame], DataFrame], work: Workspace) -> DataFrame:
    """(node, component) of all that is linked to others.  buckets: _bucket, _t.

    linked: the links among a written table of pairs (a, b).
    settled: links (a, b) that join what is linked in a written table of the members of large buckets, _bucket, _t and _c (its component so far).
    """
    found: DataFrame | None = None

    def joined(links: DataFrame) -> DataFrame | None:
        """The components with these links: those so far are links that are as good as all before."""
        links = work.table(links)
        if links.isEmpty():
            return found
        return components(links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), work)

    def more(pairs: DataFrame) -> DataFrame | None:
        pairs = work.table(pairs)
        return found if pairs.isEmpty() else joined(linked(pairs))

    buckets = work.table(buckets)
    full = work.table(buckets.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1"))
    if not full.isEmpty():
        # sides that are counted by a bucket are written first, so that adaptive execution can split what they are joined to
        shared = work.table(buckets.join(full, "_bucket").select("_bucket", "_t", "_k"))
        fame = shared.groupBy("_t").agg(F.sum("_k").alias("_fame"))
        leaders = work.table(shared.join(fame, "_t").groupBy("_bucket").agg(F.max(F.struct("_fame", "_t"))["_t"].alias("_leader")))
        shared = work.table(shared.join(leaders, "_bucket"))
        star = shared.where("_t <> _leader").select(F.col("_leader").alias("a"), F.col("_t").alias("b")).distinct()
        found = more(star)
        shared = work.table(_with_components(shared, found, "_t", "_leader"))
        mixed = shared.where("_t_c <> _leader_c")
        settling = mixed.where(F.col("_k") <= SMALL)
        open_ = work.table(settling.select("_bucket").distinct())
        outside = settling.select("_bucket", F.col("_t").alias("a"), F.col("_t_c").alias("ac"))
        inside = shared.join(open_, "_bucket", "left_semi").select("_bucket", F.col("_t").alias("b"), F.col("_t_c").alias("bc"), F.col("_leader").alias("l"), F.col("_leader_c").alias("lc"))
        # of two outside one order is enough; leaders have met all
        found = more(
            outside.join(inside, "_bucket")
            .where((F.col("ac") != F.col("bc")) & (F.col("b") != F.col("l")) & ((F.col("bc") == F.col("lc")) | (F.col("a") < F.col("b"))))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        large = work.table(mixed.where(F.col("_k") > SMALL).select("_bucket").distinct())
        if not large.isEmpty():
            members = work.table(_with_components(shared.join(large, "_bucket", "left_semi").select("_bucket", "_t"), found, "_t").select("_bucket", "_t", F.col("_t_c").alias("_c")))
            several = work.table(members.groupBy("_bucket").agg(F.min("_c").alias("_least"), F.max("_c").alias("_most")).where("_least <> _most").select("_bucket"))
            found = joined(settled(work.table(members.join(several, "_bucket", "left_semi"))))
    return work.table(work.spark.createDataFrame([], "node long, component long")) if found is None else found
