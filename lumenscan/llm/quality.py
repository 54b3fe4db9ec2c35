"""Quality rules as a ledger of failure bits.  Native: DataFrame functions only.

Every rule is measured and judged once.  The ledger keeps the measurements and one bit for each failed rule;
a policy is a versioned mask over the bits, so another policy, or an ablation of one, reads the ledger and
never the texts.

Defined results: a null or empty text has no words and fails ``few_words``; equal texts have equal ledgers;
repeated rows stay; columns of the input other than the key and the text are ignored by ``ledger`` and kept by
``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, kept_rows, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails``: a condition over the measurements."""

    bit: int
    name: str
    fails: Column


def rules() -> list[Rule]:
    c = F.col
    return [
        Rule(0, "few_words", c("n_words") < 50),
        Rule(1, "repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        Rule(2, "symbols", 10 * c("n_symbols") > c("n_words")),
        Rule(3, "repeated_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        Rule(4, "word_length", ~c("word_chars").between(2 * c("n_words"), 14 * c("n_words"))),
        Rule(5, "few_letters", 100 * c("n_letters") < 60 * c("word_chars")),
        Rule(6, "shouting", 2 * c("n_capitals") > c("n_letters")),
        Rule(7, "exclamations", 10 * c("n_exclamations") > 3 * c("n_words")),
    ]


#: Versions of the policy: the rules it applies.  Old versions stay, so that a verdict can be repeated.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
    "web-2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "few_letters", "shouting", "exclamations"),
}
POLICY = "web-2"


def mask(policy: str) -> int:
    return sum(1 << r.bit for r in rules() if r.name in POLICIES[policy])


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measurements(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of df: the key, the measurements, and the columns of ``keep`` as ``_keep_0``, ``_keep_1``...

    ``n_repeat_words`` counts the words that lie in a three-word window found twice or more in the text.  The
    windows are sorted with their places, so equal ones become neighbours: n log n for the longest text.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = df.select(F.col(f"`{key}`").alias("_key"), t.alias("_text"), *[F.col(f"`{k}`").alias(f"_keep_{i}") for i, k in enumerate(keep)])
    kept = [c for c in base.columns if c.startswith("_keep_")]
    split = base.select(
        "_key",
        *kept,
        words(F.col("_text")).alias("_words"),
        F.filter(F.split(F.col("_text"), "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "").alias("_lines"),
        F.length(_without(F.col("_text"), SPACE_CHARS)).cast("long").alias("word_chars"),
        F.length(F.col("_text")).alias("_n"),
        (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(_without(F.col("_text"), "!"))).cast("long").alias("n_exclamations"),
        F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
    )
    n = F.size("_words")
    sized = split.select(
        "_key", *kept, "word_chars", "n_symbols", "n_exclamations", "n_letters", "n_capitals",
        n.cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            n >= 3,
            F.sort_array(
                F.arrays_zip(
                    F.slice("_words", F.lit(1), n - 2).alias("a"), F.slice("_words", F.lit(2), n - 2).alias("b"),
                    F.slice("_words", F.lit(3), n - 2).alias("c"), F.sequence(F.lit(0), n - 3).alias("p"),
                )
            ),
        ).alias("_sorted"),
    )
    at = lambda i: F.get(F.col("_sorted"), i)
    same = lambda x, y: x["a"].eqNullSafe(y["a"]) & x["b"].eqNullSafe(y["b"]) & x["c"].eqNullSafe(y["c"])
    places = sized.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", lambda x, i: same(x, at(i - 1)) | same(x, at(i + 1))), lambda x: x["p"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    return places.select(
        F.col("_key").alias(key), *kept,
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_capitals", "n_exclamations",
        # filters of a ledger are not pushed below a non-deterministic column, where they would repeat all of the above
        (F.coalesce(covered, F.lit(0)) + 0 * F.spark_partition_id()).cast("long").alias("n_repeat_words"),
    )


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measurements and ``fail_bits``, the failed rules of every row."""
    bits = F.lit(0).cast("long")
    for r in rules():
        bits = bits.bitwiseOR(F.when(r.fails, F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measurements(df, key, text, keep).withColumn("fail_bits", bits)


def apply_policy(ledgers: DataFrame, policy: str = POLICY) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to a ledger."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p)).cast("long")) != 0
    return ledgers.withColumns({"base_failed": failed("base-1"), "kept": ~failed("base-1") & ~failed(policy), "policy": F.lit(policy)})


def ablations(ledgers: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that the policy would keep without it.

    The ledger is first counted by its bits, so the rest reads one row for each pattern of failures.
    """
    all_bits = F.lit(mask(policy)).cast("long")
    patterns = ledgers.groupBy(F.col("fail_bits").bitwiseAND(all_bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    of = [r for r in rules() if r.name in POLICIES[policy]]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in of])).alias("r")
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        patterns.select("bits", "n", each)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def filter_documents(df: DataFrame, key: str = "doc_id", text: str = "text", policy: str = POLICY) -> DataFrame:
    """The rows of df that the policy keeps, with df's own columns."""
    judged = apply_policy(ledger(df, key, text, keep=tuple(df.columns)), policy)
    return kept_rows(judged, F.col("kept")).select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(df.columns)])
