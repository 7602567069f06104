"""The driver's tables read as the engine's model: feed facts, reports, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import fact_id, shifted, site_time

LOG = "seq bigint, type string, fact struct<subject:string,predicate:string,object:struct<ref:string,value:string,unit:string>,valid_from:string,valid_to:string,kind:string,source:string,citations:array<struct<file:string,locator:string,quote:string>>,model:string>, seen struct<source:string,t:string>, confirm struct<proposal:string,answer:string,by:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed messages of robots, told by four sources."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), site_time(F.col("ts")).alias("t"), F.concat(F.lit("robot:"), F.col("user_id")).alias("subject"),
        F.concat(F.lit("src"), F.col("event_id") % 4).alias("source"), F.col("event_type").alias("mode"), "value", "props",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode facts with ids; every fifth is inferred."""
    rows = messages(spark, sf_dir).select(
        "seq", "subject", F.lit("mode").alias("predicate"), F.lit(False).alias("object_is_ref"), F.col("mode").alias("object_text"), F.lit(None).cast("string").alias("unit"),
        F.col("t").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.when(F.col("seq") % 5 == 0, "inferred").otherwise("observed").alias("kind"), "source",
    )
    return rows.withColumn("fact_id", fact_id(rows))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("source", "t")


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions feed nations, nations feed suppliers; customers are part of nations."""
    ref = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, s, p, o: df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object_text"))
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    every = (
        edge(nation, ref("region", "n_regionkey"), "feeds", ref("nation", "n_nationkey"))
        .unionByName(edge(supplier, ref("nation", "s_nationkey"), "feeds", ref("supplier", "s_suppkey")))
        .unionByName(edge(customer, ref("customer", "c_custkey"), "part_of", ref("nation", "c_nationkey")))
    )
    return every.withColumn("seq", F.lit(0).cast("long"))


def site_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of several predicates from the events: modes and batteries with units, some with ends of their own; zones and current tasks as
    references; orders handed to robots, and names, of which a thing has many. Every seventh is inferred."""
    m = messages(spark, sf_dir).withColumns({"n": F.col("seq"), "robot": F.col("subject"), "task": F.concat(F.lit("task:"), F.col("seq") % 7)})
    text = lambda c: c.cast("string")
    until = F.when(F.col("n") % 3 == 0, shifted(F.col("t"), 5400))
    kinds = (
        ("n % 2 = 0", "robot", "mode", False, F.col("mode"), None, until),
        ("n % 5 = 1", "robot", "battery", False, text(F.floor("value") % 4 * 25), "%", None),
        ("n % 5 = 2", "robot", "in_zone", True, F.concat(F.lit("zone:"), F.col("n") % 3), None, until),
        ("n % 11 = 3", "robot", "current_task", True, F.col("task"), None, None),
        ("n % 11 IN (3, 4)", "task", "assigned_to", True, F.col("robot"), None, None),
        ("n % 17 = 5", "robot", "name", False, F.concat(F.lit("unit "), F.col("n") % 4), None, F.when(F.col("n") % 2 == 0, shifted(F.col("t"), 86400))),
    )
    out = None
    for k, (which, who, predicate, is_ref, target, unit, end) in enumerate(kinds):
        rows = m.where(which).select(
            (F.col("n") * 10 + k).alias("seq"), F.col(who).alias("subject"), F.lit(predicate).alias("predicate"), F.lit(is_ref).alias("object_is_ref"), target.alias("object_text"),
            F.lit(unit).cast("string").alias("unit"), F.col("t").alias("valid_from"), (F.lit(None) if end is None else end).cast("string").alias("valid_to"),
            F.when(F.col("n") % 7 == 0, "inferred").otherwise("observed").alias("kind"), "source",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def site_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the sources, and of some robots' own devices."""
    m = messages(spark, sf_dir)
    device = m.where("seq % 3 = 0").select(F.concat_ws("/", "source", F.split_part("subject", F.lit(":"), F.lit(2))).alias("source"), "t")
    return m.select("source", "t").unionByName(device)


def site_pace(spark: SparkSession) -> DataFrame:
    """Seconds between reports; the last source states none."""
    return spark.createDataFrame([("src0", 900), ("src1", 3600), ("src2", 7200)], "source string, interval_seconds long")
