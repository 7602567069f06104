"""Reports over a window: value changes, the newest intervals, shift windows, counters at both ends, tallies, capped findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import shifted
from ..functions.vocabulary import CHANGE_SECONDS, RECORD_FILES
from . import intervals


def value_changes(spans: DataFrame, chain: Sequence[str] = ("subject", "predicate"), obj: str = "object_text") -> DataFrame:
    """Intervals that replaced an earlier, different value, with that value; a value that comes back after an end of its own is no change."""
    w = W.partitionBy(*chain).orderBy(intervals.begin("start"), "seq")
    marked = spans.withColumns({"was": F.lag(obj).over(w), "__n": F.row_number().over(w)})
    return marked.where((F.col("__n") > 1) & ~F.col(obj).eqNullSafe(F.col("was"))).drop("__n")


def newest(spans: DataFrame, predicates: Sequence[str], types: Sequence[str], at: str, most: int) -> DataFrame:
    """The ``most`` intervals that began last by ``at``, ends after it left open. Spark keeps only so many rows a task."""
    until = F.when(F.col("end") <= at, F.col("end"))
    shown = spans.where(F.col("predicate").isin(*predicates) & F.substring_index("subject", ":", 1).isin(*types) & (F.col("start") <= at))
    order = (F.col("start").desc(), F.col("subject").desc(), F.col("predicate").desc(), F.col("seq").desc())
    fault = (F.col("predicate") == "health") & F.startswith(F.col("object_text"), F.lit("fault"))
    return shown.select("start", until.alias("end"), "subject", "predicate", "object_text", "seq", fault.alias("fault")).orderBy(*order).limit(most)


def evidence_class(kind: Column, file: Column) -> Column:
    """Where a fact's evidence comes from; a stated fact that cites no table is a document's."""
    table = F.coalesce(F.exists(F.array(*map(F.lit, RECORD_FILES)), lambda end: F.endswith(file, end)), F.lit(False))
    return F.when(kind == "inferred", "inferred").when(kind == "observed", "feed").when(table, "records").otherwise("documents")


def shift_windows(roster: DataFrame, shifts: Sequence[str], clock: str) -> DataFrame:
    """For each shift named, its latest window begun by the clock (the latest of all if none is), and when any shift ended last
    before it: a day before its start if none did. ``roster(shift, valid_from, valid_to)``; windows without both ends don't count.

    One row per name is broadcast to the roster, however long that is.
    """
    held = roster.where("valid_from IS NOT NULL AND valid_to IS NOT NULL")
    window = F.struct("valid_from", "valid_to")
    latest = F.coalesce(F.max(F.when(F.col("valid_from") <= clock, window)), F.max(window))
    asked = held.where(F.col("shift").isin(*shifts)).groupBy("shift").agg(latest.alias("w")).select("shift", F.col("w.valid_from").alias("start"), F.col("w.valid_to").alias("end"))
    starts = F.broadcast(asked.select("shift", "start"))
    before = held.select("valid_to").distinct().join(starts, F.col("valid_to") <= F.col("start")).groupBy("shift").agg(F.max("valid_to").alias("ended"))
    return asked.join(before, "shift", "left").select("shift", "start", "end", F.coalesce("ended", shifted(F.col("start"), -CHANGE_SECONDS)).alias("previous_end"))


def counter_ends(spans: DataFrame, start: str, at: str) -> DataFrame:
    """A counter's interval that held at ``start`` (its first, if it began later) and the one at ``at``, null where that is the same."""
    seen = F.struct(F.col("start").alias("t"), "seq", F.col("object_text").alias("value"))
    rows = spans.where(F.col("start") <= at).groupBy("subject").agg(
        F.coalesce(F.max(F.when(F.col("start") <= start, seen)), F.min(seen)).alias("a"), F.max(seen).alias("b")
    )
    other = F.col("a.seq") != F.col("b.seq")
    return rows.select(
        "subject", F.col("a.t").alias("begun"), F.col("a.value").alias("first"), F.when(other, F.col("b.t")).alias("ended"), F.when(other, F.col("b.value")).alias("last")
    )


#: Verdicts in the order in which they are shown. Fixed values.
VERDICTS = ("supported", "inconclusive", "rejected")


def latest_cards(cards: DataFrame) -> DataFrame:
    """Each hypothesis as its last round left it."""
    rest = [c for c in cards.columns if c not in ("key", "round")]
    return cards.groupBy("key").agg(F.max("round").alias("round"), F.max_by(F.struct(*rest), "round").alias("x")).select("key", "round", "x.*")


def goal_tallies(goals: DataFrame, cards: DataFrame) -> DataFrame:
    """How many latest cards ``(key, verdict, goals)`` stand at each verdict, per goal; a goal that no card names has zeros."""
    named = cards.select("verdict", F.explode(F.array_distinct("goals")).alias("goal"))
    counted = named.groupBy("goal").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return goals.join(counted, "goal", "left").select("goal", *[F.coalesce(v, F.lit(0)).alias(v) for v in VERDICTS])


def capped(findings: DataFrame, key: str, code: str, item: str, most: int) -> DataFrame:
    """Per key the counts of each code, the first ``most`` items, and how many more there are. All rows are counted; only the list is short."""
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(code, "n"))), lambda x: F.concat_ws(":", x[code], x["n"].cast("string"))), ", ")
    counts = findings.groupBy(key, code).agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n"), told.alias("codes"))
    first = findings.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(item))).where(F.col("__n") <= most)
    listed = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.cast("string")), ",").alias("items"))
    return counts.join(listed, key).select(key, "n", "codes", "items", F.greatest(F.col("n") - most, F.lit(0)).alias("omitted"))


def named_time(name: Column) -> Column:
    """The site time in a file's name (``20240115_120000``); null if there is none or it is no time."""
    digits = F.concat(F.regexp_extract(name, r"(?:^|\D)(\d{8})[T_-](\d{6})(?:\D|$)", 1), F.regexp_extract(name, r"(?:^|\D)(\d{8})[T_-](\d{6})(?:\D|$)", 2))
    return F.date_format(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss")


def name_clusters(files: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """Files ``(folder, name)`` whose named times follow each other within the gap: folder, start, end, n different times."""
    times = files.select("folder", named_time(F.col("name")).alias("t")).where("t IS NOT NULL").distinct()
    return intervals.sessions(times, ["folder"], "t", gap_seconds)


def unseen(new: DataFrame, log: DataFrame) -> DataFrame:
    """Facts that the log doesn't hold yet, each once, as first said."""
    first = new.groupBy("fact_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "fact_id"]), "seq").alias("x")).select("fact_id", "x.*")
    return first.join(log.select("fact_id"), "fact_id", "left_anti")
