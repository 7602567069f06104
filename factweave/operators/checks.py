"""Data-quality rules: each takes tables and gives rows that break the rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tasks that values and their limits are dealt to; a small file of limits is many rows, and counts held before values meet are as many in each task.
TASKS = 96


def count_mismatch(declared: DataFrame, rows: DataFrame, key: str, stated: str) -> DataFrame:
    """Declared counts that differ from the rows there are; none is 0."""
    found = rows.groupBy(key).agg(F.count("*").alias("found"))
    return declared.join(found, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).where(F.col(stated) != F.col("found")).select(key, F.col(stated).alias("stated"), "found")


def dangling(references: DataFrame, targets: DataFrame, ref: str, target: str) -> DataFrame:
    return references.join(targets.select(F.col(target).alias(ref)), ref, "left_anti")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are stated twice or more."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(rows: DataFrame, keys: Sequence[str], attribute: str) -> DataFrame:
    """Keys with more than one known value of an attribute."""
    return rows.where(F.col(attribute).isNotNull()).groupBy(*keys).agg(F.count_distinct(attribute).alias("n_values"), F.min(attribute).alias("low"), F.max(attribute).alias("high")).where("n_values > 1")


def reversed_intervals(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.where(F.col(start) > F.col(end))


def missing(rows: DataFrame, group: str, fields: Sequence[str]) -> DataFrame:
    """Per group and field, how many rows don't know it."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNull().alias("unknown")) for f in fields]))
    return rows.select(group, cells.alias("c")).where("c.unknown").groupBy(group, F.col("c.field").alias("field")).agg(F.count("*").alias("n"))


def regressions(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is under the last known one before; unknown values are skipped."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("before", F.last(value, ignorenulls=True).over(w)).where(F.col(value) < F.col("before"))


def not_rising(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).where(F.col(value) <= F.col("before"))


def limits(rows: DataFrame, key: str, value: str, lower: Column, upper: Column) -> DataFrame:
    below, above = F.sum((F.col(value) < lower).cast("long")), F.sum((F.col(value) > upper).cast("long"))
    return rows.groupBy(key).agg(below.alias("below"), above.alias("above")).where("below > 0 OR above > 0")


def declared_limits(values: DataFrame, declared: DataFrame) -> DataFrame:
    """Values of ``values(stream, column, value)`` below or above ``declared(stream, column, unit, column_unit, lower, upper)``, counted per limit.

    Only where both units are known and equal; a limit may lack an end; unknown values and NaN are outside of none. Values that
    are inside of all limits of their column, whatever the stream, are left before limits are looked up; both sides are dealt to ``TASKS`` tasks, and neither is broadcast.
    """
    stated = declared.where("unit = column_unit AND (lower IS NOT NULL OR upper IS NOT NULL)").withColumn("limit", F.struct("unit", "lower", "upper"))
    ends = F.broadcast(stated.groupBy("column").agg(F.max("lower").alias("__highest"), F.min("upper").alias("__lowest")))  # a row for a column
    known = values.where("value IS NOT NULL AND NOT isnan(CAST(value AS DOUBLE))").join(ends, "column")
    outside = known.where((F.col("value") < F.col("__highest")) | (F.col("value") > F.col("__lowest"))).select("stream", "column", "value")
    dealt = lambda rows: rows.repartition(TASKS, "stream", "column")
    met = dealt(outside).join(dealt(stated.select("stream", "column", "limit")).hint("merge"), ["stream", "column"])
    below, above = F.count_if(F.col("value") < F.col("limit.lower")), F.count_if(F.col("value") > F.col("limit.upper"))
    out = met.groupBy("stream", "column", "limit").agg(below.alias("below"), above.alias("above")).where("below > 0 OR above > 0")
    return out.select("stream", "column", "limit.*", "below", "above")


def counted(declared: DataFrame, found: DataFrame, exempt: DataFrame) -> DataFrame:
    """Streams of ``declared(stream, stated)`` whose rows in ``found(stream)`` are of another number, none counted as 0.

    Streams of ``exempt(stream)``, which a finding says were skipped or cut, are left out, as are those that state no number.
    """
    n = found.groupBy("stream").agg(F.count("*").alias("found"))
    asked = declared.where("stated IS NOT NULL").join(exempt.select("stream"), "stream", "left_anti")
    return asked.join(n, "stream", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("stated <> found").select("stream", "stated", "found")


def clock_falls(rows: DataFrame, keys: Sequence[str], order: str, value: str, monotonic: Column) -> DataFrame:
    """How often a clock falls per key: a regression where it declares itself ``monotonic``, out of order otherwise."""
    fallen = regressions(rows.withColumn("_monotonic", F.coalesce(monotonic, F.lit(False))), keys, order, value)
    code = F.when(F.col("_monotonic"), "time_regression").otherwise("time_out_of_order")
    return fallen.groupBy(*keys, code.alias("code")).agg(F.count("*").alias("n"), F.max(F.col("before") - F.col(value)).alias("largest"))


def outside_windows(runs: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs after the end of all windows of their key, if all have one, or before the start of all."""
    all_closed, all_begun = F.min(F.col("until").isNotNull().cast("int")) == 1, F.min(F.col("since").isNotNull().cast("int")) == 1
    spans = windows.groupBy(*keys).agg(F.when(all_closed, F.max("until")).alias("last"), F.when(all_begun, F.min("since")).alias("first"))
    return runs.join(spans, list(keys)).where((F.col("start") > F.col("last")) | (F.col("end") < F.col("first")))


def ledger_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """new, changed, unchanged or gone, per key of two listings."""
    a, b = old.select(key, F.col(content).alias("was")), new.select(key, F.col(content).alias("now"))
    joined = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), key, "full_outer")
    status = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "gone").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return joined.select(key, status.alias("status"))
