"""Columnar series: order, budgets, clocks."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_order(rows: DataFrame, clock: str) -> DataFrame:
    """The order of a series: known ticks first, then sequence."""
    return rows.orderBy(F.col(clock).asc_nulls_last(), "seq")


def write_series(rows: DataFrame, path: str, stream: str, clock: str, files: int) -> None:
    """A folder per stream, each file sorted, so that ranges of the clock are skipped by statistics."""
    placed = rows.repartitionByRange(files, stream, F.col(clock).asc_nulls_last())
    placed.sortWithinPartitions(stream, F.col(clock).asc_nulls_last(), "seq").write.partitionBy(stream).option("compression", "zstd").parquet(path)


def media_window(rows: DataFrame, stream: str, clock: str, start: object, end: object, most: int) -> DataFrame:
    """Frames per stream inside [start, end]; streams past the budget, in order of their names, are not covered."""
    counts = rows.where(F.col(clock).between(start, end)).groupBy(stream).agg(F.count("*").alias("frames"))
    total = F.sum("frames").over(W.orderBy(stream).rowsBetween(W.unboundedPreceding, 0))  # one row per stream
    return counts.withColumn("covered", total <= most)


# Fixed values of the producers' message definitions.
#: By rule: the encoding and the message types that carry a receiver's time.
EMBEDDED = {"px4.gps_utc": ("ulog", ("vehicle_gps_position", "sensor_gps")), "ardupilot.gps_time": ("dataflash", ("GPS", "GPS2"))}
WEEK_MS = 604_800_000


def embedded_clock(encoding: Column, kind: Column, fields: Column) -> Column:
    """A struct ``rule, tick`` of the receiver's time in a message's ``fields``, a map of name to long; null where the receiver had none.

    Microseconds since 1970, UTC, where 0 means none; or milliseconds since 1980-01-06 of GPS time, where week 0 means none.
    """
    field = lambda name: F.try_element_at(fields, F.lit(name))
    utc, week, ms = field("time_utc_usec"), field("GWk"), field("GMS")
    tick = {"px4.gps_utc": F.when(utc > 0, utc), "ardupilot.gps_time": F.when((week > 0) & (ms >= 0) & (ms < WEEK_MS), F.try_add(F.try_multiply(week, F.lit(WEEK_MS)), ms))}
    out = F.lit(None).cast("struct<rule:string,tick:bigint>")
    for rule, (form, kinds) in EMBEDDED.items():
        found = (encoding == form) & kind.isin(*kinds) & tick[rule].isNotNull()
        out = F.when(found, F.struct(F.lit(rule).alias("rule"), tick[rule].cast("bigint").alias("tick"))).otherwise(out)
    return out


def clock_anchors(messages: DataFrame) -> DataFrame:
    """Anchors ``stream, rule, tick, embedded`` of ``messages(stream, encoding, kind, tick, fields)``: both clocks' ticks of one instant."""
    x = embedded_clock(F.col("encoding"), F.col("kind"), F.col("fields"))
    return messages.where("tick IS NOT NULL").select("stream", "tick", x.alias("x")).where("x IS NOT NULL").select("stream", "x.rule", "tick", F.col("x.tick").alias("embedded"))


def anchor_report(anchors: DataFrame) -> DataFrame:
    """By stream and rule: anchors, distinct instants, how often the embedded clock falls as the other rises, and whether a line can be fitted."""
    w = W.partitionBy("stream", "rule").orderBy("tick", "embedded")
    steps = anchors.select("stream", "rule", "tick", "embedded", F.lag("embedded").over(w).alias("before"), F.lag("tick").over(w).alias("earlier"))
    falls = F.count_if((F.col("embedded") < F.col("before")) & (F.col("tick") > F.col("earlier")))
    instants = F.count_if(F.col("earlier").isNull() | (F.col("tick") > F.col("earlier")))
    out = steps.groupBy("stream", "rule").agg(F.count("*").alias("anchors"), instants.alias("instants"), falls.alias("falls"))
    return out.withColumn("state", F.when(F.col("instants") < 2, "single_instant").when(F.col("falls") > 0, "runs_backward").otherwise("fits"))


def fit_clock(pairs: DataFrame, x: str, y: str) -> tuple[Fraction, Fraction, int]:
    """Exact least squares y = a + b x over int64 ticks, and the count: sums in Spark, fractions on the driver.

    Ticks are centred on their smallest before squaring, and squares are summed in decimals, which don't overflow.
    """
    low = pairs.agg(F.min(x), F.min(y), F.count("*")).first()
    if not low[2]:
        raise ValueError("no anchors")
    dx, dy = ((F.col(c) - v).cast("decimal(19,0)") for c, v in ((x, low[0]), (y, low[1])))
    halves = lambda a, b: [F.sum(a * F.floor(b / 1_000_000)), F.sum(a * (b % 1_000_000))]
    row = pairs.agg(F.sum(dx), F.sum(dy), *halves(dx, dx), *halves(dx, dy)).first()
    sx, sy = int(row[0]), int(row[1])
    sxx, sxy = int(row[2]) * 1_000_000 + int(row[3]), int(row[4]) * 1_000_000 + int(row[5])
    n = low[2]
    spread = n * sxx - sx * sx
    slope = Fraction(n * sxy - sx * sy, spread) if spread else Fraction(1)
    return Fraction(sy) / n - slope * Fraction(sx) / n + low[1] - slope * low[0], slope, n


def align(ticks: int, offset: Fraction, slope: Fraction) -> int:
    """A tick of one clock on another, to the nearest."""
    return round(offset + slope * ticks)
