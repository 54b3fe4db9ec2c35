"""Relations between columns: correlations, associations, group differences, missingness, leakage.

The cluster returns sums and contingency tables; tests on those few numbers run on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import special

LEAST_ROWS = 30
COLLINEAR, VIF_LIMIT, STRONG = 0.9, 10.0, 0.5
# Shares of the variance from which an effect is medium and large.
MEDIUM_EFFECT, LARGE_EFFECT = 0.06, 0.14


def _d(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    return F.unix_micros(c.cast("timestamp")) / 86_400_000_000.0 if isinstance(kind, S.TIME_TYPES) else S.present(c, kind).cast("double")


def _corr(x: Column, y: Column) -> Column:
    """Pearson's r over the rows with both; null below 30 of them or without spread."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when((F.count(x) >= LEAST_ROWS) & (spread > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.covar_pop(x, y), spread))))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, r of all pairs, from one pass over the rows."""
    d = df.select(*[_d(df, c).alias(f"_{i}") for i, c in enumerate(columns)])
    pairs = list(combinations(range(len(columns)), 2))
    sums = [x for i, j in pairs for x in (_corr(F.col(f"_{i}"), F.col(f"_{j}")).alias(f"r_{i}_{j}"), F.count_if(F.col(f"_{i}").isNotNull() & F.col(f"_{j}").isNotNull()).alias(f"n_{i}_{j}"))]
    rows = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"n_{i}_{j}").alias("n"), F.col(f"r_{i}_{j}").alias("r")) for i, j in pairs])
    return d.agg(*sums).select(F.explode(rows).alias("p")).select("p.*")


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """value, rank: average ranks of ties, from the value counts.

    Counts are summed within ranges of values first, so no task holds all values in order.
    """
    counts = df.select(_d(df, column).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    ends = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranged = counts.join(F.broadcast(ends)).withColumn("part", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(F.lit(0)))
    sums = ranged.groupBy("part").agg(F.sum("k").alias("s"))
    before = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = F.sum("k").over(Window.partitionBy("part").orderBy("v"))
    return ranged.withColumn("u", upto).join(F.broadcast(before), F.col("part") == F.col("p")).select(F.col("v").alias("value"), (F.col("base") + F.col("u") - (F.col("k") - 1) / 2.0).alias("rank"))


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, r of the ranks; each column is ranked once."""
    ranked = df.select(*[_d(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        ranks = average_ranks(df, c).select(F.col("value").alias(f"w{i}"), F.col("rank").alias(f"r{i}"))
        ranked = ranked.join(ranks, F.col(f"v{i}") == F.col(f"w{i}"), "left").drop(f"w{i}")
    return pearson_pairs(ranked.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(columns)]), columns)


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(f"`{a}`").cast("string"), F.col(f"`{b}`").cast("string")
    return df.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, chi2, v (bias-corrected) of two categorical columns; null with fewer than 30 rows or two values."""
    cells = crosstab(df, a, b)
    rows = cells.groupBy("x").agg(F.sum("k").alias("rk"))
    cols = cells.groupBy("y").agg(F.sum("k").alias("ck"))
    each = cells.join(rows, "x").join(cols, "y")
    one = each.agg(F.sum("k").cast("double").alias("n"), F.sum(F.col("k").cast("double") * F.col("k") / (F.col("rk").cast("double") * F.col("ck"))).alias("s"), F.count_distinct("x").cast("double").alias("r"), F.count_distinct("y").cast("double").alias("c"))
    n, r, c = F.col("n"), F.col("r"), F.col("c")
    chi2 = n * (F.col("s") - 1)
    phi2 = F.greatest(F.lit(0.0), chi2 / n - (c - 1) * (r - 1) / F.nullif(n - 1, F.lit(0.0)))
    rc, cc = r - (r - 1) * (r - 1) / F.nullif(n - 1, F.lit(0.0)), c - (c - 1) * (c - 1) / F.nullif(n - 1, F.lit(0.0))
    low = F.least(rc - 1, cc - 1)
    return one.select(n.cast("long").alias("n"), chi2.alias("chi2"), F.when((n >= LEAST_ROWS) & (r >= 2) & (c >= 2) & (low > 0), F.sqrt(F.try_divide(phi2, low))).alias("v"))


def eta_squared(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way analysis of variance: n, groups, eta2, f."""
    data = df.select(_d(df, value).alias("v"), F.col(f"`{group}`").alias("g")).where("v IS NOT NULL AND g IS NOT NULL")
    # each group's sum and squares about its own mean, then about the whole mean
    groups = data.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("k"), F.avg("v").alias("m"), (F.var_pop("v") * F.count(F.lit(1))).alias("w"))
    whole = groups.agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("m")).alias("t"), F.count(F.lit(1)).cast("double").alias("g"), F.sum("w").alias("within"))
    each = groups.select("k", "m").join(F.broadcast(whole))
    between = each.groupBy("n", "g", "within").agg(F.sum(F.col("k") * F.pow(F.col("m") - F.col("t") / F.col("n"), 2)).alias("between"))
    ok = (F.col("n") >= LEAST_ROWS) & (F.col("g") >= 2)
    total = F.col("between") + F.col("within")
    return between.select(
        F.col("n").cast("long").alias("n"), F.col("g").cast("long").alias("n_groups"), F.when(ok, F.try_divide(F.col("between"), total)).alias("eta2"),
        F.when(ok, F.try_divide(F.col("between") / (F.col("g") - 1), F.try_divide(F.col("within"), F.nullif(F.col("n") - F.col("g"), F.lit(0.0))))).alias("f"),
    )


def group_statistics(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """column, g, k, m, s2: rows, mean and variance of every numeric column in every group, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _d(df, c).alias("v")) for c in columns])
    data = df.select(F.col(f"`{group}`").cast("string").alias("g"), F.explode(pairs).alias("p")).select("g", "p.column", "p.v").where("g IS NOT NULL AND v IS NOT NULL")
    return data.groupBy("column", "g").agg(F.count(F.lit(1)).alias("k"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))


def effect_word(eta2: float) -> str:
    """Cohen's words for shares of the variance."""
    return "large" if eta2 >= LARGE_EFFECT else "medium" if eta2 >= MEDIUM_EFFECT else "small"


def compare_groups(groups: Sequence, least: int = LEAST_ROWS) -> dict | None:
    """One column's rows of ``group_statistics``: eta2, p, the effect in words, Cohen's d of two groups, the highest and the lowest mean among groups of 30 rows and more."""
    known = sorted(groups, key=lambda r: r["g"])
    n, count = sum(r["k"] for r in known), len(known)
    if n < least or count < 2 or n <= count:
        return None
    mean = sum(r["k"] * r["m"] for r in known) / n
    between = sum(r["k"] * (r["m"] - mean) ** 2 for r in known)
    within = sum((r["k"] - 1) * (r["s2"] or 0.0) for r in known)
    if between + within <= 0:
        return None
    eta2 = between / (between + within)
    f = (between / (count - 1)) / (within / (n - count)) if within > 0 else None
    found = {"eta2": eta2, "p": anova_p(n, count, f), "effect": effect_word(eta2)}
    if count == 2 and within > 0 and n > 2:
        found["d"] = (known[1]["m"] - known[0]["m"]) / math.sqrt(within / (n - 2))
    big = [r for r in known if r["k"] >= least]
    if len(big) >= 2:
        top, low = max(big, key=lambda r: r["m"]), min(big, key=lambda r: r["m"])
        found |= {"highest": [top["g"], top["m"]], "lowest": [low["g"], low["m"]]}
    return found


def anova_p(n: int, groups: int, f: float | None) -> float:
    return 0.0 if f is None else special.f_survival(f, groups - 1, n - groups)


def cohens_d(df: DataFrame, value: str, group: str) -> DataFrame:
    """Standardised difference of the means of two groups, the second in order less the first."""
    data = df.select(_d(df, value).alias("v"), F.col(f"`{group}`").alias("g")).where("v IS NOT NULL AND g IS NOT NULL")
    groups = data.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))
    one = groups.agg(F.count(F.lit(1)).alias("groups"), F.min_by("m", "g").alias("m0"), F.max_by("m", "g").alias("m1"), F.sum((F.col("k") - 1) * F.coalesce("s2", F.lit(0.0))).alias("ss"), F.sum("k").alias("n"))
    return one.select("n", "m0", "m1", F.when((F.col("groups") == 2) & (F.col("ss") > 0), (F.col("m1") - F.col("m0")) / F.sqrt(F.try_divide(F.col("ss"), F.col("n") - 2))).alias("d"))


def missingness_corr(df: DataFrame, targets: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Does a column's being missing go with a numeric column?  target, column, n, r (point-biserial), all in one pass."""
    pairs = [(t, c) for t in targets for c in columns if t != c]
    flags = {t: (F.col(f"`{t}`").isNull() | S.yes(F.isnan(F.col(f"`{t}`")) if df.schema[t].dataType.simpleString() in ("double", "float") else F.lit(False))).cast("double") for t in targets}
    d = df.select(*[flags[t].alias(f"t{i}") for i, t in enumerate(targets)], *[_d(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    ti, ci = {t: i for i, t in enumerate(targets)}, {c: i for i, c in enumerate(columns)}
    sums = [x for k, (t, c) in enumerate(pairs) for x in (_corr(F.col(f"t{ti[t]}"), F.col(f"c{ci[c]}")).alias(f"r{k}"), F.count(F.col(f"c{ci[c]}")).alias(f"n{k}"))]
    rows = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("column"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("r")) for k, (t, c) in enumerate(pairs)])
    return d.agg(*sums).select(F.explode(rows).alias("p")).select("p.*")


def correlation_p(r: float, n: int) -> float:
    return special.t_two_sided(r * math.sqrt((n - 2) / max(1 - r * r, 1e-12)), n - 2)


def missingness_by_group(df: DataFrame, target: str, group: str) -> DataFrame:
    """v = sqrt(chi2 / n) of missing or not by group, the number of groups, and the group with most missing."""
    cells = df.where(F.col(f"`{group}`").isNotNull()).groupBy(F.col(f"`{group}`").alias("g")).agg(F.count(F.lit(1)).cast("double").alias("k"), F.count_if(F.col(f"`{target}`").isNull()).cast("double").alias("m"))
    whole = cells.agg(F.sum("k").alias("n"), F.sum("m").alias("t"), F.count(F.lit(1)).alias("groups"))
    each = cells.join(F.broadcast(whole)).where((F.col("t") > 0) & (F.col("t") < F.col("n")))
    e = F.col("k") * F.col("t") / F.col("n")
    e0 = F.col("k") - e
    term = F.pow(F.col("m") - e, 2) * (F.try_divide(F.lit(1.0), e) + F.try_divide(F.lit(1.0), e0))
    worst = F.min(F.struct((-F.col("m") / F.col("k")).alias("s"), F.col("g").alias("g")))
    return each.groupBy("n", "groups").agg(F.sum(term).alias("chi2"), worst.alias("w")).select(F.col("n").cast("long").alias("n"), "groups", F.sqrt(F.col("chi2") / F.col("n")).alias("v"), F.col("w.g").alias("worst"), (-F.col("w.s")).alias("worst_share"))


def target_balance(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def category_purity(df: DataFrame, category: str, target: str, least: int = 5) -> DataFrame:
    """Share of the rows of one-class categories among categories of 5 rows and more, what chance gives, and their coverage."""
    cells = crosstab(df, category, target)
    by = cells.groupBy("x").agg(F.sum("k").alias("m"), F.max("k").alias("top"))
    classes = cells.groupBy("y").agg(F.sum("k").cast("double").alias("ck"))
    shares = classes.agg(F.collect_list("ck").alias("cks"), F.sum("ck").alias("n"))
    big = by.where(F.col("m") >= least).join(F.broadcast(shares))
    chance = F.aggregate("cks", F.lit(0.0), lambda a, x: a + F.pow(x / F.col("n"), F.col("m")))
    return big.agg(
        F.sum(F.when(F.col("top") == F.col("m"), F.col("m")).otherwise(0)).cast("double").alias("pure"), F.sum("m").cast("double").alias("rows"), F.sum(F.col("m") * chance).alias("by_chance"), F.max("n").alias("n")
    ).select((F.col("pure") / F.col("rows")).alias("observed"), (F.col("by_chance") / F.col("rows")).alias("chance"), (F.col("rows") / F.col("n")).alias("coverage"))


def collinear_clusters(pairs: Sequence[tuple[str, str, float]], limit: float = COLLINEAR) -> list[list[str]]:
    """Columns tied by |r| of the limit or more, over chains."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, r in pairs:
        if r is not None and abs(r) >= limit:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    groups: dict[str, list[str]] = {}
    for x in root:
        groups.setdefault(find(x), []).append(x)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def variance_inflation(columns: Sequence[str], pairs: Sequence[tuple[str, str, float | None]]) -> dict[str, float]:
    """Diagonal of the pseudo-inverse of the correlation matrix; unknown correlations count as 0."""
    at = {c: i for i, c in enumerate(columns)}
    m = np.eye(len(columns))
    for a, b, r in pairs:
        m[at[a], at[b]] = m[at[b], at[a]] = r or 0.0
    return dict(zip(columns, np.diag(np.linalg.pinv(m)).tolist(), strict=True))
