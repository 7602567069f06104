"""The append-only fact log: JSON segments of entries with dense sequence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import LOG


def read_log(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """Entries, as known at ``as_of``."""
    log = spark.read.schema(LOG).json(path)
    return log if as_of is None else log.where(F.col("seq") <= as_of)


def tail(spark: SparkSession, path: str, after: int) -> DataFrame:
    return spark.read.schema(LOG).json(path).where(F.col("seq") > after)


def append(entries: DataFrame, path: str, order: list[str]) -> int:
    """Numbers new entries after the last one and writes them as segments; one writer at a time.

    Rows are numbered by sorted ranges: counts per range are summed on the driver, one number per range.
    Returns the last sequence number.
    """
    spark = entries.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    last = spark.read.schema(LOG).json(path).agg(F.max("seq")).first()[0] if there else None
    from ..functions.shared import written

    ranged = written(entries.drop("seq").repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "append")
    counts = dict(ranged.groupBy("__part").count().collect())
    base, start = {}, -1 if last is None else last
    for part in sorted(counts):
        base[part] = start + 1
        start += counts[part]
    if not counts:
        return start
    offsets = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    number = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1 + F.element_at(offsets, F.col("__part"))
    ranged.withColumn("seq", number.cast("long")).drop("__part").write.mode("append").json(path)
    return start


def facts_of(log: DataFrame) -> DataFrame:
    """The facts of a log as flat rows."""
    f = log.where("type = 'fact'").select("seq", "fact.*")
    return f.select(
        "seq", "subject", "predicate", F.col("object.ref").isNotNull().alias("object_is_ref"), F.coalesce("object.ref", "object.value").alias("object_text"), F.col("object.unit").alias("unit"),
        "valid_from", "valid_to", "kind", "source", "model", "citations",
    )
