"""Histories, islands, sessions, and joins in time. All work by keys: nothing is ordered globally."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import seconds_between
from ..functions.vocabulary import ONE


def begin(c: str = "valid_from") -> Column:
    """A fact without a beginning holds from the start and sorts first."""
    return F.coalesce(F.col(c), F.lit(""))


def history(facts: DataFrame, chain: Sequence[str], obj: str = "object_text") -> DataFrame:
    """Intervals of one-valued predicates, a chain per ``chain`` columns.

    Equal neighbours merge unless the earlier has an end of its own; an interval ends where the next
    different object begins, or earlier by its own end.
    """
    w = W.partitionBy(*chain).orderBy(begin(), "seq")
    prev, prev_end = F.lag(obj).over(w), F.lag("valid_to").over(w)
    numbered = F.row_number().over(w)
    changed = (numbered == 1) | ~F.col(obj).eqNullSafe(prev)
    runs = facts.withColumns({"__new": changed, "__keep": changed | prev_end.isNotNull()}).withColumn("__run", F.sum(F.col("__new").cast("int")).over(w))
    # The next run begins ahead: what a walk from the chain's end saw last. That frame grows by one row at each, so a chain costs its length.
    back = W.partitionBy(*chain).orderBy(begin().desc(), F.col("seq").desc()).rowsBetween(W.unboundedPreceding, -1)
    following = runs.withColumn("__next", F.last(F.when(F.col("__new"), begin()), ignorenulls=True).over(back))
    own = F.col("valid_to")
    end = F.when(own.isNotNull() & (F.col("__next").isNull() | (own < F.col("__next"))), own).otherwise(F.col("__next"))
    return following.where("__keep").withColumn("end", end).withColumnRenamed("valid_from", "start").drop("__new", "__keep", "__run", "__next", "valid_to")


def all_history(facts: DataFrame) -> DataFrame:
    """``history`` of each source's one-valued predicates, by literal, unit and reference; a fact of any other predicate is an interval of its own."""
    said = facts.withColumn("__said", F.struct("object_is_ref", "object_text", "unit"))
    one = history(said.where(F.col("predicate").isin(*ONE)), ["subject", "predicate", "source"], "__said")
    many = said.where(~F.col("predicate").isin(*ONE)).withColumnsRenamed({"valid_from": "start", "valid_to": "end"})
    return one.unionByName(many).drop("__said")


def change_only(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before of the same key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__same", (F.row_number().over(w) > 1) & F.col(value).eqNullSafe(F.lag(value).over(w))).where(~F.col("__same")).drop("__same")


def sessions(rows: DataFrame, keys: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """Periods in which no two neighbours are more than the gap apart: start, end, n.

    Equal times are counted first, then periods found in every day, and only a day's first and last, which alone can go on
    in another one, walk by key. What isn't a time is a period by itself.
    """
    counted = rows.groupBy(*keys, F.col(time).alias("start")).agg(F.count("*").alias("n")).withColumns({"end": F.col("start"), "__day": F.substring("start", 1, 10)})
    daily = _merged(counted, [*keys, "__day"], gap_seconds)
    day = W.partitionBy(*keys, "__day")
    edge = F.min("start").over(day).eqNullSafe(F.col("start")) | F.max("start").over(day).eqNullSafe(F.col("start"))
    marked = daily.withColumn("__edge", edge)
    return _merged(marked.where("__edge"), list(keys), gap_seconds).unionByName(marked.where("NOT __edge").select(*keys, "start", "end", "n"))


def _merged(spans: DataFrame, keys: Sequence[str], gap_seconds: int) -> DataFrame:
    """Neighbours among ``start, end, n`` of a key that are at most the gap apart, as one."""
    w = W.partitionBy(*keys).orderBy("start")
    opened = F.coalesce((seconds_between(F.lag("end").over(w), F.col("start")) > gap_seconds).cast("int"), F.lit(1))
    numbered = spans.withColumn("__open", opened).withColumn("__no", F.sum("__open").over(w))
    return numbered.groupBy(*keys, "__no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("__no")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket_seconds: int, how: str = "inner") -> DataFrame:
    """Pairs of intervals (start, end) and (start2, end2) that overlap, as an equi-join on time buckets.

    Ends must be set. A pair is kept in the first bucket that both lie in, so that it comes once. With ``left``, a left interval
    also comes without a partner, for each of its buckets in which no pair is kept (once, if an end is missing).
    """

    def bucket(t: Column) -> Column:
        return F.floor(F.unix_timestamp(F.to_timestamp(t, "yyyy-MM-dd'T'HH:mm:ss")) / bucket_seconds)

    explode = F.explode_outer if how == "left" else F.explode
    a = left.withColumn("__b", explode(F.sequence(bucket(F.col("start")), bucket(F.col("end")))))
    b = right.withColumn("__c", F.explode(F.sequence(bucket(F.col("start2")), bucket(F.col("end2")))))
    first = F.greatest(bucket(a["start"]), bucket(b["start2"]))
    on = [a[k] == b[k] for k in keys] + [a["__b"] == b["__c"], a["__b"] == first, a["start"] < b["end2"], a["end"] > b["start2"]]
    joined = a.join(b, on, how)
    for k in keys:
        joined = joined.drop(b[k])
    return joined.drop("__b", "__c")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, right_time: str, value: str, name: str) -> DataFrame:
    """``left`` with the latest value of ``right`` at or before its time: one union and one window, no range join."""
    mark = F.lit(None).cast(right.schema[value].dataType)
    both = left.withColumns({"__v": mark, "__side": F.lit(1), "__t": F.col(time)}).unionByName(
        right.select(*keys, F.col(value).alias("__v"), F.lit(0).alias("__side"), F.col(right_time).alias("__t")), allowMissingColumns=True
    )
    w = W.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(name, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side", "__t")
