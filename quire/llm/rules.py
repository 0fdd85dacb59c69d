"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one long of
failure bits; a policy is a versioned mask over these bits, so that changing a policy or
computing what a rule does alone (an ablation) reads the ledger and never the texts.

Defined results: a null text has no words and counts as empty; an empty text fails ``too_short``;
repeated rows give repeated ledger rows; extra input columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Rule name -> (bit, condition over the measurements under which a document fails).
RULES: dict[str, tuple[int, str]] = {
    "too_short": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "10 * n_symbols > n_words"),
    "repeated_lines": (3, "100 * n_dup_lines > 34 * n_lines"),
    "word_length": (4, "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    "too_long": (5, "n_words > 1000000"),
}

#: Policy version -> the rules whose failure drops a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_short", "repeated_words"),
    "v1": ("too_short", "repeated_words", "symbols", "repeated_lines"),
    "v2": ("too_short", "repeated_words", "symbols", "repeated_lines", "word_length", "too_long"),
}

#: Up to so many different repeated windows are looked up one by one; beyond, windows are sorted.
_FEW = 48


def mask(policy: str) -> int:
    return sum(1 << RULES[name][0] for name in POLICIES[policy])


def measurements(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    A 3-word window is told by the 64-bit hash of its words, which is compared within one document only.
    Nothing is shuffled: repeated windows are found inside each row's array.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(*keep, words(t).alias("_w"), t.alias("_t"))
    spaces = " \t\n\x0b\x0c\r"
    out = out.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", spaces, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, spaces, "")) > 0).alias("_lines"),
        F.when(
            F.size("_w") >= 3,
            F.transform(
                F.arrays_zip(
                    F.slice("_w", 1, F.size("_w") - 2).alias("a"),
                    F.slice("_w", 2, F.size("_w") - 2).alias("b"),
                    F.slice("_w", 3, F.size("_w") - 2).alias("c"),
                ),
                lambda z: F.xxhash64(z["a"], z["b"], z["c"]),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_h"),
    )
    base = [*keep, "n_words", "word_chars", "n_symbols"]
    out = out.select(
        *base,
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_h",
        F.sort_array("_h").alias("_s"),
    )
    base += ["n_lines", "n_dup_lines"]
    none = F.array().cast("array<bigint>")
    out = out.select(
        *base,
        "_h",
        F.when(
            F.size(F.array_distinct("_s")) < F.size("_s"),
            F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (F.get("_s", i - 1) == x))),
        )
        .otherwise(none)
        .alias("_d"),
    )
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.select(*base, "_h", "_d", F.when(F.size("_d") > _FEW, pairs).alias("_p"))
    same = lambda p, i: F.coalesce(F.get("_p", i)["h"] == p["h"], F.lit(False))
    out = out.select(
        *base,
        F.when(F.size("_d") == 0, F.array().cast("array<int>"))
        .when(
            F.size("_d") <= _FEW,
            F.filter(
                F.transform("_h", lambda h, i: F.when(F.array_contains(F.col("_d"), h), i)), lambda i: i.isNotNull()
            ),
        )
        .otherwise(
            F.sort_array(
                F.transform(F.filter("_p", lambda p, i: same(p, i + 1) | ((i > 0) & same(p, i - 1))), lambda p: p["i"])
            )
        )
        .alias("_at"),
    )
    # Windows at rising positions: each adds the words that the one before did not cover.
    new = F.zip_with(
        F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))),
        F.slice("_at", 1, F.greatest(F.size("_at") - 1, F.lit(0))),
        lambda b, a: F.least(F.lit(3), b - a),
    )
    return out.select(
        *base,
        F.when(F.size("_at") == 0, F.lit(0).cast("long"))
        .otherwise(F.aggregate(new, F.lit(3).cast("long"), lambda n, x: n + x))
        .alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """measurements() and ``failed``, the bits of all rules that the document fails."""
    bits: Column = F.lit(0).cast("long")
    for bit, condition in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs, text, keep).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy, from the ledger alone: rule, n_failed, n_only (dropped by nothing else).

    One aggregation with partial sums; its result has a row per rule.
    """
    m = F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long"))
    names = POLICIES[policy]
    sums = [F.count_if(m.bitwiseAND(F.lit(1 << RULES[n][0]).cast("long")) != 0).alias(f"f_{n}") for n in names]
    sums += [F.count_if(m == (1 << RULES[n][0])).alias(f"o_{n}") for n in names]
    one = rows.agg(*sums)
    return one.select(
        F.inline(
            F.array(
                *(F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in names)
            )
        )
    )
