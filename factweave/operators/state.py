"""State at a time: what each source last said, who wins, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import seconds_between
from ..functions.vocabulary import ONE, STALE_AFTER, TOPOLOGY
from .intervals import begin


def live(facts: DataFrame, confirms: DataFrame) -> DataFrame:
    """Facts that no answer has settled: a confirmed or rejected proposal steps back."""
    return facts.join(confirms.select(F.col("proposal").alias("fact_id")).distinct(), "fact_id", "left_anti")


def first_said(facts: DataFrame) -> DataFrame:
    """One row per fact id, the first of the log."""
    w = W.partitionBy("fact_id").orderBy("seq")
    return facts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def stated_copies(facts: DataFrame, confirms: DataFrame) -> DataFrame:
    """What the latest answer ``yes`` after a proposal makes of it: a stated fact of the source ``confirm``."""
    asked = facts.alias("f").join(confirms.alias("c"), (F.col("f.fact_id") == F.col("c.proposal")) & (F.col("c.seq") > F.col("f.seq")))
    last = asked.groupBy("f.fact_id").agg(F.max_by("c.answer", "c.seq").alias("answer"), F.max("c.seq").alias("seq"))
    copies = facts.drop("seq").join(last.where("answer = 'yes'"), "fact_id")
    intent = F.when(F.col("predicate") == "proposed_action", F.lit("intent")).otherwise(F.col("predicate"))
    return copies.withColumns({"kind": F.lit("stated"), "source": F.lit("confirm"), "predicate": intent}).drop("answer")


def holds_at(at: str) -> Column:
    """Begun by then, and not over."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def freshness(seen: DataFrame, at: str) -> DataFrame:
    """The last time up to ``at`` that each source key reported; null for keys that only report later."""
    return seen.groupBy("source").agg(F.max(F.when(F.col("t") <= at, F.col("t"))).alias("last_seen"))


def with_freshness(rows: DataFrame, seen: DataFrame, at: str, device: Column) -> DataFrame:
    """``last_seen`` of a device's own key if that key exists at all, else of its source."""
    fresh = freshness(seen, at)
    own = fresh.select(F.col("source").alias("__k"), F.col("last_seen").alias("__own"), F.lit(True).alias("__has"))
    return (
        rows.withColumn("__key", F.concat_ws("/", "source", device)).join(own, F.col("__key") == F.col("__k"), "left")
        .join(fresh, "source", "left").withColumn("last_seen", F.when(F.col("__has"), F.col("__own")).otherwise(F.col("last_seen")))
        .drop("__key", "__k", "__own", "__has")
    )


def readings(facts: DataFrame, seen: DataFrame, at: str, stale_seconds: int) -> DataFrame:
    """Current readings of one-valued predicates.

    Per source the latest facts, ties included; inferred ones give way to others. Different objects left
    over are ambiguous, one row each; else the latest wins, and is stale if its source has been silent.
    """
    cur = facts.where(holds_at(at)).withColumn("__kr", F.when(F.col("kind") == "inferred", 0).otherwise(1))
    by_source = W.partitionBy("subject", "predicate", "source")
    by_reading = W.partitionBy("subject", "predicate")
    top = (
        cur.withColumns({"__rk": F.rank().over(by_source.orderBy(begin().desc())), "__pos": F.min("seq").over(by_source)})
        .where("__rk = 1").withColumn("__top", F.max("__kr").over(by_reading)).where("__kr = __top")
        .withColumn("__n", F.size(F.collect_set(F.struct("object_is_ref", "object_text", F.coalesce("unit", F.lit("")))).over(by_reading)))
    )
    each = W.partitionBy("subject", "predicate", "object_is_ref", "object_text", F.coalesce("unit", F.lit(""))).orderBy("__pos", "seq")
    ranked = top.withColumns({"__each": F.row_number().over(each), "__win": F.row_number().over(by_reading.orderBy(begin().desc(), F.col("seq").desc()))})
    chosen = ranked.where(((F.col("__n") > 1) & (F.col("__each") == 1)) | ((F.col("__n") == 1) & (F.col("__win") == 1)))
    fresh = chosen.join(freshness(seen, at), "source", "left")
    silent = F.coalesce(seconds_between(F.col("last_seen"), F.lit(at)) > stale_seconds, F.lit(True))
    state = (
        F.when(F.col("__n") > 1, "ambiguous").when((F.col("kind") == "inferred") & (F.col("predicate") == "same_as"), "pending")
        .when(silent, "stale").otherwise("known")
    )
    return fresh.select("subject", "predicate", "object_text", "source", "kind", "seq", state.alias("state"))


def all_readings(facts: DataFrame, seen: DataFrame, at: str, pace: DataFrame) -> DataFrame:
    """Readings at a time, of one-valued predicates as ``readings`` tells them and of every fact of others.

    ``pace(source, interval_seconds)`` says how often a source reports: one that has been silent for longer than
    three times that makes what it knows stale, and one without a pace is never stale. A device's own reports count before its source's.
    """
    cur = facts.where(holds_at(at)).withColumn("__kr", F.when(F.col("kind") == "inferred", 0).otherwise(1))
    one, said = F.col("predicate").isin(*ONE), F.struct("object_is_ref", "object_text", "unit")
    by_source, by_reading = W.partitionBy("subject", "predicate", "source"), W.partitionBy("subject", "predicate")
    top = (
        cur.where(one).withColumns({"__rk": F.rank().over(by_source.orderBy(begin().desc())), "__pos": F.min("seq").over(by_source)}).where("__rk = 1")
        .withColumn("__top", F.max("__kr").over(by_reading)).where("__kr = __top").withColumn("__n", F.size(F.collect_set(said).over(by_reading)))
    )
    each = W.partitionBy("subject", "predicate", "object_is_ref", "object_text", "unit").orderBy("__pos", "seq")
    ranked = top.withColumns({"__each": F.row_number().over(each), "__win": F.row_number().over(by_reading.orderBy(begin().desc(), F.col("seq").desc()))})
    chosen = ranked.where("(__n > 1 AND __each = 1) OR (__n = 1 AND __win = 1)").select(*facts.columns, "__n")
    every = chosen.unionByName(cur.where(~one).select(*facts.columns, F.lit(1).alias("__n")))
    fresh = with_freshness(every, seen, at, F.regexp_replace("subject", "^[^:]*:", "")).join(pace, "source", "left")
    silent = F.coalesce(seconds_between(F.col("last_seen"), F.lit(at)) > STALE_AFTER * F.col("interval_seconds"), F.lit(False))
    state = F.when(F.col("__n") > 1, "ambiguous").when((F.col("kind") == "inferred") & (F.col("predicate") == "same_as"), "pending").when(silent, "stale").otherwise("known")
    return fresh.select("subject", "predicate", "object_is_ref", "object_text", "unit", "source", "kind", "seq", F.col("valid_from").alias("since"), "last_seen", state.alias("state"))


def topology(facts: DataFrame, at: str | None = None) -> DataFrame:
    """The edges of the topology that hold at a time, or all. An order that was handed to a robot counts only while it is the
    robot's current task, if the robot ever says which task is its own: fleets never say that an order is over."""
    cur = facts if at is None else facts.where(holds_at(at))
    edges = cur.where(F.col("predicate").isin(*TOPOLOGY))
    tasks = facts.where("predicate = 'current_task'")
    own = W.partitionBy("subject", "source").orderBy(begin().desc())
    top = (tasks if at is None else tasks.where(holds_at(at))).withColumn("__rk", F.rank().over(own)).where("__rk = 1")
    rank = F.when(F.col("kind") == "inferred", 0).otherwise(1)
    top = top.withColumn("__kr", rank).withColumn("__top", F.max("__kr").over(W.partitionBy("subject"))).where("__kr = __top")
    doing = top.select(F.col("subject").alias("__robot"), F.col("object_text").alias("__task")).distinct()
    handed = F.col("predicate") == "assigned_to"
    told = edges.where(handed).join(tasks.select(F.col("subject").alias("object_text")).distinct().withColumn("__tells", F.lit(True)), "object_text", "left")
    kept = told.where("__tells IS NULL").drop("__tells").unionByName(
        told.where("__tells").drop("__tells").join(doing, (F.col("object_text") == F.col("__robot")) & (F.col("subject") == F.col("__task")), "left_semi")
    )
    return edges.where(~handed).unionByName(kept.select(*edges.columns))


def expected_unknown(found: DataFrame, entities: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows for predicates that a type of entity should have and has no reading of."""
    wanted = entities.join(F.broadcast(expected), "type").select("subject", "predicate")  # a fixed vocabulary
    return wanted.join(found.select("subject", "predicate").distinct(), ["subject", "predicate"], "left_anti").withColumn("state", F.lit("unknown"))
