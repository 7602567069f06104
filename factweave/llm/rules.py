"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose bit r
is set if rule r failed; policies are versioned masks over these bits, so a new policy or an ablation
reads the ledger and never the texts.

Defined results: a null or empty text has no words, so the rule on few words fails and no other that
needs words; texts of any length are measured whole, inside their row; equal rows get equal results;
an empty table gives an empty ledger; columns beyond ``id_col`` and ``text_col`` are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``sql`` says when a document fails, over the measurements."""

    name: str
    sql: str


#: The position of a rule is its bit; rules are only ever appended.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("shouting", "n_words > 0 AND 2 * n_upper_words > n_words"),
)


def mask(*names: str) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(RULES)}
    return sum(bits[n] for n in set(names))


BASE = mask("few_words", "repeated_windows")
#: Policies by version: the bits of which none may be set.
POLICIES: Mapping[int, int] = {
    1: BASE,
    2: BASE | mask("symbols", "repeated_lines"),
    3: BASE | mask("symbols", "repeated_lines", "word_length", "shouting"),
}
CURRENT = 3


def repeat_words(ws: Column) -> Column:
    """Words covered by a 5-word window that the text has twice or more.

    Windows are compared by a 64-bit hash of their words' hashes. A text without a repeated window,
    the usual case, costs one hash set; else the windows are sorted once with their positions.
    """

    def windows(h: Column) -> Column:
        return F.when(
            F.size(h) >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    def same(s: Column, i: Column, by: int) -> Column:
        return F.coalesce(F.get(s, i + by)["h"] == F.get(s, i)["h"], F.lit(False))

    def covered(win: Column) -> Column:
        pairs = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, i: F.struct((same(s, i, -1) | same(s, i, 1)).alias("twice"), x["i"].alias("i"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            found,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return let(
        let(hashed, windows),
        lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(covered(win)),
    )


def measure(text: Column) -> Column:
    """A struct of all measurements of a text."""
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(
            F.struct(words(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0).alias("l")),
            lambda s: F.struct(
                F.size(s["w"]).cast("long").alias("n_words"),
                F.length(F.translate(t, WS_CHARS, "")).cast("long").alias("word_chars"),
                (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.size(s["l"]).cast("long").alias("n_lines"),
                (F.size(s["l"]) - F.size(F.array_distinct(s["l"]))).cast("long").alias("n_dup_lines"),
                repeat_words(s["w"]).alias("n_repeat_words"),
                F.size(F.filter(s["w"], lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 1))).cast("long").alias("n_upper_words"),
            ),
        ),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: id, measurements, and the bits of the rules that failed."""
    measured = docs.select(F.col(id_col), F.inline(F.array(measure(F.col(text_col)))))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.sql), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(ledger_rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed and kept under a version of the policy."""
    bits = F.col("failed_bits")
    return ledger_rows.withColumns(
        {
            "base_failed": bits.bitwiseAND(F.lit(BASE)) != 0,
            "kept": bits.bitwiseAND(F.lit(POLICIES[version] | BASE)) == 0,
            "policy": F.lit(version),
        }
    )


def ablations(ledger_rows: DataFrame, version: int = CURRENT, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: documents it fails, those that only it drops, and what would be kept without it.

    One aggregation: the ledger shrinks to one row per pattern of bits, at most 2**rules, before the rules are looked at.
    """
    policy = POLICIES[version]
    patterns = ledger_rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy)).alias("bits")).agg(F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if policy >> i & 1])
    bits, bit = F.col("bits"), F.col("bit")
    return (
        patterns.select("bits", "n", F.inline(rows))
        .groupBy("rule", "bit")
        .agg(
            F.sum(F.when(bits.bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(bits == bit, F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(bits.bitwiseAND(F.lit(policy) - bit) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
            F.bit_or(F.when(bits.bitwiseAND(bit) != 0, bits).otherwise(F.lit(0))).alias("fails_with"),
        )
    )
