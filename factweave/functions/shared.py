"""Expressions and the shared folder that every part of the engine uses."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[tempfile.TemporaryDirectory] = []
#: Folders made in the shared one, with the thread that made them.
_MADE: dict[str, int] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which the driver and all executors share.

    Only a local master, whose tasks run in the driver's process, may fall back on a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="factweave-"))
        base = f"file://{_LOCAL[0].name}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = threading.get_ident()
    return path


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read again: cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in a new folder of the shared one."""
    return stored(df, scratch(df.sparkSession, name))


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing will read again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _MADE.pop(path, None)


def made() -> set[str]:
    """The folders that this thread of the driver has made in the shared one and not yet removed."""
    return {path for path, by in _MADE.items() if by == threading.get_ident()}


def sweep(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Removes the folders that this thread has made, but those of ``keep``: for the end of a run, when no table made on the way is read any more."""
    remove(spark, *(made() - keep))


def site_time(ts: Column) -> Column:
    """Site time is text and compared as text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds between two site times; null if either isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(end, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))) - F.unix_timestamp(
        F.try_to_timestamp(F.substring(start, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    )


def shifted(t: Column, seconds: int) -> Column:
    at = F.to_timestamp(F.substring(t, 1, 19), "yyyy-MM-dd'T'HH:mm:ss")
    return site_time(F.timestamp_seconds(F.unix_timestamp(at) + seconds))


def slug(text: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, most)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def fact_id(df: DataFrame) -> Column:
    """``fact:`` and the first 16 digits of the SHA-256 of the fact's canonical JSON: keys in order, nulls kept."""
    literal = F.struct(F.col("unit"), F.col("object_text").alias("value"))
    reference = F.struct(F.col("object_text").alias("ref"))
    options = {"ignoreNullFields": "false"}
    body = lambda target: F.to_json(F.struct("kind", target.alias("object"), "predicate", "source", "subject", "valid_from", "valid_to"), options)
    return F.concat(F.lit("fact:"), F.substring(F.sha2(F.when(F.col("object_is_ref"), body(reference)).otherwise(body(literal)), 256), 1, 16))
