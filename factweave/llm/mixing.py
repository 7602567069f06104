"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Each source's target is its weight's share of the total, but at most ``max_epochs`` times its size; the
excess goes to the other sources by weight until none is above. Then a seeded draw takes whole
repetitions of every document and one fractional repetition, so that a source's words meet its target.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents
of size 0 take 0; equal rows are drawn one after the other; an empty table gives an empty result; other
columns are carried through ``materialise`` untouched and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, written

WEIGHTS = (5, 2, 1)
SEED = 20260
#: Documents that share a draw bucket, on average: a bucket is sorted within one task.
PER_BUCKET = 4096


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total_percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """``sizes(source, source_size, n_docs)`` with weight and target.

    Filling in order of size over weight clamps exactly the sources whose limit lies under the water
    level, so the rounds of clamping and resharing come down to two running sums over the sources.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    limit = F.col("source_size") * max_epochs
    w = F.col("weight")
    fill = W.orderBy(limit / w, F.col("rank"))
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights)).cast("double"))
    filled = (
        ranked.withColumns({
            "rest": F.sum("source_size").over(every) * (total_percent / 100.0) - F.coalesce(F.sum(limit).over(before), F.lit(0)),
            "rest_weight": F.sum(w).over(after),
        })
        .withColumn("clamped", limit * F.col("rest_weight") <= F.col("rest") * w)
        .withColumn("level", F.min(F.when(~F.col("clamped"), F.struct(limit / w, "rank", F.col("rest") / F.col("rest_weight"))).otherwise(None)).over(every))
    )
    level = F.col("level").getField("col3")
    return filled.select("source", "source_size", "n_docs", F.when(F.col("clamped"), limit.cast("double")).otherwise(level * w).alias("target"))


def draw(docs: DataFrame, key: Column, seed: int = SEED, weights: Sequence[int] = WEIGHTS, total_percent: int = 150, max_epochs: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: size, source_size, target, taken and the columns of ``carry``.

    Documents are ordered by a seeded hash within their source; those before the fraction's end take one
    repetition more, and the one on the end takes the words that are missing. The order is never made in
    one place: sums of hash buckets say where the end lies, and only a bucket is sorted.
    """
    rows = docs.select(*carry, "source", count_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))).alias("draw"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    plan = written(targets(sizes, weights, total_percent, max_epochs), "mixing").withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
        "buckets": (F.col("n_docs") / PER_BUCKET).cast("long") + 1,
    }).withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")).withColumnRenamed("source", "s")
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "bucket", F.floor(F.conv(F.substring("draw", 1, 12), 16, 10).cast("double") / float(1 << 48) * F.col("buckets"))
    )
    sums = bucket_sums(placed)
    inside = W.partitionBy("source", "bucket").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("start")))
    return (
        placed.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
        .withColumn("start", end)
        .select(*carry, "source", "size", "source_size", "target", "whole", part.cast("long").alias("part"), (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))
    )


def bucket_sums(placed: DataFrame) -> DataFrame:
    """Words before each bucket of a source."""
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return (
        placed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        .select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    )


def materialise(drawn: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: a row per whole repetition, and one with the first words of a document cut by the draw."""
    repeats = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("whole").cast("int") + 1)), lambda i: i)
    # a piece is a word with the separators before it
    cut = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(F.lit(1), F.col("part").cast("int"))), "")
    made = drawn.withColumn("repetition", F.explode(repeats)).where((F.col("repetition") <= F.col("whole")) | (F.col("part") > 0) | ((F.col("size") == 0) & (F.col("repetition") == 1)))
    partial = (F.col("repetition") > F.col("whole")) & (F.col("part") < F.col("size"))
    return made.withColumn("text", F.when(partial, cut).otherwise(F.col("text"))).select(*columns)
