"""Hypothesis checks over observed time: event rates under a condition, and before and after a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import seconds_between
from ..functions.vocabulary import GAP_SECONDS, MIN_EVENTS, MIN_SHARE, REJECT, SUPPORT
from ..operators.intervals import overlap_join, sessions

def meets(value: Column, op: str, target: str) -> Column:
    """A condition on text; order comparisons need numbers on both sides and fail without."""
    number, other = value.try_cast("double"), F.lit(target).try_cast("double")
    compared = {">": number > other, ">=": number >= other, "<": number < other, "<=": number <= other}
    if op in compared:
        return F.coalesce(compared[op], F.lit(False))
    if op == "in":
        return value.isin(*[x.strip() for x in target.split(",")])
    return {"=": value == target, "!=": value != target}[op]


def observed(seen: DataFrame) -> DataFrame:
    """Periods of site time in which some source reported."""
    return sessions(seen.select(F.lit("site").alias("site"), "t"), ["site"], "t", GAP_SECONDS)


def verdict(with_n: Column, without_n: Column, with_hours: Column, without_hours: Column, expect: str) -> tuple[Column, Column]:
    """Whether a rate moved as expected (``more`` or ``fewer``), and by what ratio; both sides need events and observed time."""
    a, b = F.try_divide(with_n, with_hours), F.try_divide(without_n, without_hours)
    up, down = (a, b) if expect == "more" else (b, a)
    ratio = F.when(down == 0, F.lit(float("inf"))).otherwise(F.try_divide(up, down))
    least = F.least(with_hours, without_hours)
    short = (with_n + without_n < MIN_EVENTS) | (least <= 0) | (least < MIN_SHARE * (with_hours + without_hours))
    told = F.when(short, "inconclusive").when(ratio >= SUPPORT, "supported").when(ratio < REJECT, "rejected").otherwise("inconclusive")
    return told, F.when(~short, ratio)


def rate_when(events: DataFrame, spans: DataFrame, periods: DataFrame, expect: str = "more") -> DataFrame:
    """Events ``subject, t`` inside and outside the condition's intervals ``subject, start, end``, by observed hours, and a verdict.

    An event is inside if an interval that began by then ends later: one walk over both in order of time, and no event is compared with all intervals.
    The walk also carries the seconds of the intervals that were observed, so that these are read once. Periods are more than ``GAP_SECONDS`` apart, so that
    their number hangs on the time and not on the reports: they are broadcast, and intervals are never dealt by the day alone. Intervals of no subject are nobody's.
    """
    p = F.broadcast(periods.select(F.col("start").alias("start2"), F.col("end").alias("end2")))
    parts = overlap_join(spans.select("subject", "start", "end").where("subject IS NOT NULL"), p, [], 86400, "left")
    met = F.when(F.col("start2").isNotNull(), seconds_between(F.greatest("start", "start2"), F.least("end", "end2")))
    marks = events.select("subject", "t", F.lit(None).cast("string").alias("end"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("met")).unionByName(
        parts.select("subject", F.col("start").alias("t"), "end", F.lit(0).alias("side"), met.alias("met"))
    )
    w = W.partitionBy("subject").orderBy("t", "side").rowsBetween(W.unboundedPreceding, 0)
    event = F.col("side") == 1
    inside = F.coalesce(F.col("t") < F.col("until"), F.lit(False))
    counts = (
        marks.withColumn("until", F.max("end").over(w)).groupBy("subject")
        .agg(F.count_if(event & inside).alias("with_n"), F.count_if(event & ~inside).alias("without_n"), (F.sum("met") / 3600.0).alias("hours")).where("with_n + without_n > 0")
    )
    total = periods.agg((F.sum(seconds_between(F.col("start"), F.col("end"))) / 3600.0).alias("all_hours"))  # one row
    out = counts.join(F.broadcast(total)).na.fill(0.0, ["hours", "all_hours"]).withColumn("without_hours", F.col("all_hours") - F.col("hours"))
    told, ratio = verdict(F.col("with_n"), F.col("without_n"), F.col("hours"), F.col("without_hours"), expect)
    return out.select("subject", "with_n", "without_n", "hours", "without_hours", ratio.alias("ratio"), told.alias("verdict"))


def before_after(events: DataFrame, periods: DataFrame, at: str, expect: str = "more") -> DataFrame:
    """Events ``subject, t`` by observed hours after and before ``at``, and whether the rate moved as expected (``more`` or ``fewer``)."""
    late, early = F.greatest("start", F.lit(at)), F.least("end", F.lit(at))
    span = lambda a, b: F.coalesce(F.sum(F.greatest(seconds_between(a, b), F.lit(0))) / 3600.0, F.lit(0.0))
    observed_ = periods.agg(span(late, F.col("end")).alias("hours_after"), span(F.col("start"), early).alias("hours_before"))  # one row
    counts = events.groupBy("subject").agg(F.count_if(F.col("t") >= at).alias("after_n"), F.count_if(F.col("t") < at).alias("before_n"))
    told, ratio = verdict(F.col("after_n"), F.col("before_n"), F.col("hours_after"), F.col("hours_before"), expect)
    return counts.join(F.broadcast(observed_)).select("subject", "after_n", "before_n", "hours_after", "hours_before", ratio.alias("ratio"), told.alias("verdict"))
