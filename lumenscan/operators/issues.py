"""Judgements: findings from statistics.  Facts come from ``profile`` and ``relations``; nothing here reads rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import special
from . import profile, relations

HIGH, MEDIUM, LOW = "high", "medium", "low"
RANK = {HIGH: 0, MEDIUM: 1, LOW: 2}

# Shares at which a finding is made.
MISSING_BANDS = ((0.60, HIGH), (0.20, MEDIUM), (0.05, LOW))
SKEWED, ENOUGH_UNSKEWED = 1.0, 0.5
OUTLIER_SHARE = 0.01
STRAY_NEGATIVES = 0.05
SENTINEL_LEAST, SENTINEL_SHARE = 2, 0.05
LIKE_SHARE = 0.90
RELATED_R, RELATED_P, RELATED_ROWS, RELATED_SIDE = 0.2, 0.01, 60, 30
ONE_HOT_MOST, FREE_TEXT_LENGTH = 15, 30
HIGH_BALANCE, MEDIUM_BALANCE, SMALL_CLASS = 0.90, 0.75, 30
LEAK, PURE, PURE_CHANCE, PURE_COVERAGE = 0.95, 0.9, 0.5, 0.5
FEATURE_LEAST, CLASS_VALUES = 0.05, 10
TRANSFORMS = ("log1p", "sqrt", "square", "boxcox", "yeojohnson")


@dataclass(frozen=True)
class Finding:
    severity: str
    message: str
    column: str | None = None
    advice: str | None = None
    affected_rows: int = 0


def ranked(found: Sequence[Finding]) -> list[Finding]:
    return sorted(found, key=lambda f: (RANK[f.severity], -f.affected_rows, f.column or "", f.message))


def missing_band(share: float) -> str | None:
    return next((s for least, s in MISSING_BANDS if share >= least), None)


def missing_finding(column: str, missing: int, n: int, flagged: bool = False, related: str | None = None) -> Finding | None:
    share = missing / n if n else 0.0
    band = missing_band(share)
    if band is None:
        return None
    if flagged:
        return Finding(LOW, f"{share:.0%} missing, already marked by a flag column", column, None, missing)
    advice = "keep a flag of what is missing" if related or share >= 0.6 else "decide whether to impute or leave out" if share >= 0.2 else "impute the median or the mode"
    return Finding(band, f"{share:.0%} missing" + (f", more often by {related}" if related else ""), column, advice, missing)


def sentinel_findings(column: str, counts: dict[int, int], n: int, low: float | None, high: float | None, negatives: int) -> list[Finding]:
    found = []
    for code, k in sorted(counts.items()):
        if k < SENTINEL_LEAST or code == -1 and negatives != k:
            continue
        outside = low is not None and (code < low or code > high)
        if outside or k >= SENTINEL_SHARE * n:
            found.append(Finding(MEDIUM, f"{code} occurs {k} times and may stand for a missing value", column, f"replace {code} by missing", k))
    return found


def skew_advice(skews: dict[str, float | None]) -> str | None:
    """The simplest transformation that leaves a skewness below 0.5; else the one that leaves the least."""
    known = {k: abs(v) for k, v in skews.items() if v is not None and k in TRANSFORMS}
    for name in TRANSFORMS:
        if known.get(name, 9.0) < ENOUGH_UNSKEWED:
            return name
    return min(known, key=known.get) if known else None


def known_skews(df: DataFrame, column: str, simple) -> dict[str, float | None]:
    """Skewness after each transformation; powers are fitted only where no simple one helps."""
    known = {"log1p": simple["log1p"], "sqrt": simple["sqrt"], "square": simple["square"] if simple["skew"] < 0 else None}
    if any(v is not None and abs(v) < ENOUGH_UNSKEWED for v in known.values()):
        return known
    return known | {name: skew for name, (_, skew) in profile.power_skews(df, column).items()}


def encoding_advice(n_unique: int, median_length: float) -> str:
    if n_unique == 2:
        return "binary"
    if n_unique <= ONE_HOT_MOST:
        return "one-hot"
    return "frequency or target" if median_length <= FREE_TEXT_LENGTH else "free text"


def balance_findings(counts: dict, missing: int, n: int) -> list[Finding]:
    total = sum(counts.values())
    found = []
    if missing:
        found.append(Finding(HIGH, "the target is missing in some rows", None, "leave these rows out", missing))
    top = max(counts.values(), default=0) / total if total else 0.0
    if top >= MEDIUM_BALANCE:
        found.append(Finding(HIGH if top >= HIGH_BALANCE else MEDIUM, f"one class holds {top:.0%} of the rows", None, "weight the classes or judge by recall and precision", total - max(counts.values())))
    small = [str(k) for k, v in counts.items() if v < SMALL_CLASS]
    if small:
        found.append(Finding(MEDIUM, f"classes of fewer than {SMALL_CLASS} rows: {', '.join(sorted(small)[:5])}", None, "join them or leave them out"))
    return found


def infer_task(kind: str, n_unique: int, integral: bool) -> str | None:
    if kind in ("categorical", "boolean") or kind == "numeric" and integral and n_unique <= CLASS_VALUES:
        return "classification"
    return "regression" if kind == "numeric" else None


def is_purity_leak(observed: float | None, chance: float | None, coverage: float | None) -> bool:
    return observed is not None and observed >= PURE and chance <= PURE_CHANCE and coverage >= PURE_COVERAGE


def find_issues(df: DataFrame, now: str | None = None) -> list[Finding]:
    """All findings of a frame, the worst first.  Dates after ``now``, the present if none is given, are in the future.  The number of jobs does not depend on the rows; each returns few."""
    found: list[Finding] = []
    now = now or datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
    missing = {r["column"]: r for r in profile.missing_summary(df).collect()}
    kind = profile.column_kinds(df)
    n = _n_rows(df)
    if not n:
        return [Finding(HIGH, "there are no rows")]
    facts = {r["column"]: r for r in profile.kinds(df).collect()}
    related = related_missingness(df, kind, {c: r["missing"] for c, r in missing.items()}, n)
    for c, r in missing.items():
        f = missing_finding(c, r["missing"], n, f"{c}_was_missing" in df.columns, related.get(c))
        if f and kind.get(c) != "empty":
            found.append(f)
    for c, k in kind.items():
        r = facts[c]
        if k == "empty":
            found.append(Finding(HIGH, "there are no values", c, "drop the column", n))
        elif k == "constant":
            found.append(Finding(MEDIUM, f"one value covers {r['top_share']:.0%}", c, "drop the column", n))
        elif k == "identifier":
            repeats = r["n"] - r["n_unique"]
            found.append(Finding(HIGH, f"a key with {repeats} repeats", c, "drop the repeated rows", repeats) if repeats else Finding(LOW, "a key: no feature", c, "leave it out of models"))
    numbers = [c for c, k in kind.items() if k == "numeric"]
    if numbers:
        found += _numeric_findings(df, numbers)
    texts = [c for c, k in kind.items() if k in ("text", "categorical", "identifier") and df.schema[c].dataType.simpleString() == "string"]
    if texts:
        found += _text_findings(df, texts)
    dates = [c for c, k in kind.items() if k == "datetime"]
    if dates:
        for r in profile.datetime_profile(df, dates, now).collect():
            if r["future"]:
                found.append(Finding(MEDIUM, "dates in the future", r["column"], "check the source", r["future"]))
            if r["before_1900"]:
                found.append(Finding(LOW, "dates before 1900", r["column"], "check for placeholders", r["before_1900"]))
    d = profile.duplicate_rows(df).first()
    if d["n_duplicates"]:
        found.append(Finding(MEDIUM, "rows equal to earlier ones", None, "drop the duplicates", d["n_duplicates"]))
    keys = [c for c, k in kind.items() if k == "identifier"]
    rest = [c for c in df.columns if c not in keys]
    if keys and rest:
        again = profile.duplicate_rows(df, rest).first()["n_duplicates"] - d["n_duplicates"]
        if again > 0:
            found.append(Finding(MEDIUM, "records repeated under other keys", None, "check how the keys are made", again))
    found += [Finding(MEDIUM, f"the same values as {a}", b, "drop one of the two", n) for a, b in identical_columns(df, facts)]
    return ranked(found)


def _n_rows(df: DataFrame) -> int:
    return df.count()


def _numeric_findings(df: DataFrame, columns: list[str]) -> list[Finding]:
    found = []
    stats = {r["column"]: r for r in profile.numeric_profile(df, columns).collect()}
    fences = {c: profile.fences(r) for c, r in stats.items()}
    outside = profile.outside_counts(df, fences) if fences else {}
    skews = {r["column"]: r for r in profile.transform_skews(df, columns).collect()}
    codes: dict[str, dict[int, int]] = {}
    for r in profile.sentinel_counts(df, columns).collect():
        codes.setdefault(r["column"], {})[r["code"]] = r["n"]
    for c, r in stats.items():
        coded = sentinel_findings(c, codes.get(c, {}), r["n"], *fences[c], r["negatives"])
        found += coded
        by_codes = sum(codes[c][k] for k in codes.get(c, {}) if k < 0 and any(str(k) in x.message for x in coded))
        stray = r["negatives"] - by_codes
        if 0 < stray <= STRAY_NEGATIVES * r["n"]:
            found.append(Finding(MEDIUM, "a few negative values", c, "check their sign", stray))
        s = skews[c]
        if s["skew"] is not None and abs(s["skew"]) > SKEWED and r["n_unique"] > 2:
            advice = skew_advice(known_skews(df, c, s))
            found.append(Finding(LOW, f"skewness {s['skew']:.3g}", c, f"transform by {advice}" if advice else None, outside[c]))
        elif outside[c] > OUTLIER_SHARE * r["n"]:
            found.append(Finding(LOW, "values outside the fences", c, "clip them or check the source", outside[c]))
    return found


def _text_findings(df: DataFrame, columns: list[str]) -> list[Finding]:
    found = []
    dates = {r["column"]: r["date_share"] for r in profile.date_like(df, columns).collect()}
    variants: dict[str, list] = {}
    for r in profile.spelling_variants(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.sum("n_rows").alias("n")).collect():
        variants[r["column"]] = [r["k"], r["n"]]
    for r in profile.text_checks(df, columns).collect():
        c, n = r["column"], r["n"]
        if r["placeholders"]:
            found.append(Finding(MEDIUM, "words that stand for missing values", c, "replace them by missing", r["placeholders"]))
        if r["numeric_like"] >= LIKE_SHARE * n:
            found.append(Finding(MEDIUM, "numbers stored as text", c, "cast to numeric", r["numeric_like"]))
        elif (dates.get(c) or 0) >= LIKE_SHARE:
            found.append(Finding(MEDIUM, "dates stored as text", c, "parse the dates", n))
        if c in variants:
            found.append(Finding(MEDIUM, f"{variants[c][0]} values in several spellings", c, "merge the variants", variants[c][1]))
        if r["blank"]:
            found.append(Finding(LOW, "blank texts", c, "replace them by missing", r["blank"]))
        if r["padded"]:
            found.append(Finding(LOW, "white space around texts", c, "strip it", r["padded"]))
    return found


def related_missingness(df: DataFrame, kind: dict[str, str], missing: dict[str, int], n: int) -> dict[str, str]:
    """For columns with 5 per cent missing and more: the column that their gaps go with most."""
    targets = [c for c, k in missing.items() if k >= max(RELATED_SIDE, 0.05 * n) and n - k >= RELATED_SIDE and kind.get(c) not in (None, "empty")]
    numbers = [c for c, k in kind.items() if k in ("numeric", "datetime")]
    groups = [c for c, k in kind.items() if k in ("categorical", "boolean")]
    best: dict[str, tuple[float, str]] = {}
    if targets and [c for c in numbers if c not in targets or len(targets) > 1]:
        for r in relations.missingness_corr(df, targets, numbers).collect():
            if r["r"] is not None and r["n"] >= RELATED_ROWS and abs(r["r"]) >= RELATED_R and relations.correlation_p(r["r"], r["n"]) < RELATED_P:
                best[r["target"]] = max(best.get(r["target"], (0.0, "")), (abs(r["r"]), r["column"]))
    for t in targets:
        for g in groups:
            if g == t:
                continue
            r = relations.missingness_by_group(df, t, g).first()
            if r and r["v"] is not None and r["v"] >= RELATED_R and special.chi2_survival(r["v"] ** 2 * r["n"], r["groups"] - 1) < RELATED_P:
                best[t] = max(best.get(t, (0.0, "")), (r["v"], f"{g} ({r['worst']})"))
    return {t: c for t, (_, c) in best.items()}


def identical_columns(df: DataFrame, facts: dict) -> list[tuple[str, str]]:
    """Pairs of columns with the same values; only those with equal counts are compared, all in one pass."""
    names = list(facts)
    same = lambda a, b: (facts[a]["n"], facts[a]["n_unique"], facts[a]["top_share"]) == (facts[b]["n"], facts[b]["n_unique"], facts[b]["top_share"])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if df.schema[a].dataType == df.schema[b].dataType and facts[a]["n"] and same(a, b)]
    if not pairs:
        return []
    r = df.agg(*[F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [p for i, p in enumerate(pairs) if r[f"_{i}"]]


def findings_frame(df: DataFrame) -> DataFrame:
    rows = [(i + 1, f.severity, f.column, f.message, f.advice, f.affected_rows) for i, f in enumerate(find_issues(df))]
    return df.sparkSession.createDataFrame(rows, "rank long, severity string, column string, message string, advice string, affected_rows long")


def _class_variants(df: DataFrame, target: str) -> list[Finding]:
    spelled = profile.spelling_variants(df, [target])
    r = spelled.agg(F.count(F.lit(1)).alias("k"), F.sum("n_rows").alias("n"), F.max_by("spelling", "n_rows").alias("most")).first()
    return [Finding(HIGH, f"{r['k']} classes in several spellings, as {r['most']}", target, "merge the spellings of each class", r["n"])] if r["k"] else []


def regression_health(df: DataFrame, target: str) -> tuple[dict, list[Finding]]:
    """Moments of a numeric target, and advice where it is skewed."""
    stats = profile.numeric_profile(df, [target]).first()
    skews = profile.transform_skews(df, [target]).first()
    if stats is None:
        return {}, []
    body = {k: stats[k] for k in ("mean", "std", "min", "median", "max")} | {"skew": skews["skew"]}
    if skews["skew"] is None or abs(skews["skew"]) <= SKEWED:
        return body, []
    after = known_skews(df, target, skews)
    best = skew_advice(after)
    advice = f"model {best} of the target and invert predictions (skewness {after[best]:.2f})" if best else "use a loss that outliers do not move"
    side = "right" if skews["skew"] > 0 else "left"
    return body, [Finding(MEDIUM, f"the target is skewed to the {side} ({skews['skew']:.2g})", target, advice)]


def collinear_advice(clusters: Sequence[Sequence[str]], present: dict[str, int], order: Sequence[str]) -> list[Finding]:
    """For each cluster the column to keep: the one with most values, the first in the frame among equals."""
    found = []
    for cluster in clusters:
        keep = max(cluster, key=lambda c: (present[c], -order.index(c)))
        rest = ", ".join(c for c in cluster if c != keep)
        found.append(Finding(MEDIUM, f"{', '.join(cluster)} move together", None, f"keep {keep}; drop or combine {rest}"))
    return found


def analyze_target(df: DataFrame, target: str) -> dict:
    """Task, health of the target, strength of every feature, and features that give the target away."""
    kind = profile.column_kinds(df)
    facts = {r["column"]: r for r in profile.kinds(df).collect()}
    k = kind[target]
    integral = k == "numeric" and profile.numeric_profile(df, [target]).first()["integral"]
    task = infer_task(k, facts[target]["n_unique"], bool(integral))
    if task is None:
        raise ValueError(f"{target} is a {k} column and cannot be predicted")
    n = _n_rows(df)
    found: list[Finding] = []
    body: dict = {}
    if task == "classification":
        found += balance_findings({r["value"]: r["n"] for r in relations.target_balance(df, target).collect()}, n - facts[target]["n"], n)
        if df.schema[target].dataType.simpleString() == "string":
            found += _class_variants(df, target)
    else:
        if n - facts[target]["n"]:
            found.append(Finding(HIGH, "the target is missing in some rows", target, "leave these rows out", n - facts[target]["n"]))
        body, judged = regression_health(df, target)
        found += judged
    strengths = []
    for c, other in kind.items():
        if c == target or other not in ("numeric", "datetime", "categorical", "boolean"):
            continue
        number = other in ("numeric", "datetime")
        if number and task == "regression":
            r = relations.pearson_pairs(df, [c, target]).first()
            s, p = (abs(r["r"]), relations.correlation_p(r["r"], r["n"])) if r["r"] is not None else (None, 1.0)
        elif number or task == "regression":
            r = relations.eta_squared(df, *((c, target) if number else (target, c))).first()
            s, p = (r["eta2"] ** 0.5, relations.anova_p(r["n"], r["n_groups"], r["f"])) if r and r["eta2"] is not None else (None, 1.0)
        else:
            r = relations.cramers_v(df, c, target).first()
            s, p = (r["v"], special.chi2_survival(r["chi2"], max(1, (facts[c]["n_unique"] - 1) * (facts[target]["n_unique"] - 1)))) if r["v"] is not None else (None, 1.0)
        leak = s is not None and s >= LEAK
        if not leak and not number and task == "classification":
            q = relations.category_purity(df, c, target).first()
            leak = is_purity_leak(q["observed"], q["chance"], q["coverage"])
        if leak:
            found.append(Finding(HIGH, "gives the target away", c, "leave it out of models", n))
        elif s is not None and p < RELATED_P and s >= FEATURE_LEAST:
            strengths.append((c, s))
    return {"task": task, "health": body, "findings": ranked(found), "strengths": sorted(strengths, key=lambda x: (-x[1], x[0]))}
