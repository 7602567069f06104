"""Streaming twins of batch operators: change detection, sessions, staleness, and the fold into tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "subject string, predicate string, source string, seq long, object_text string"


def changes(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Rows whose object differs from the last of their (subject, predicate, source); the state is one object a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        had = state.exists
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for row in rows.itertuples():
            if not had or row.object_text != last:
                out.append((*key, row.seq, row.object_text))
            had, last = True, row.object_text
        state.update((last,))
        yield pd.DataFrame(out, columns=["subject", "predicate", "source", "seq", "object_text"])

    return stream.groupBy("subject", "predicate", "source").applyInPandasWithState(step, CHANGES, "last string", "append", "NoTimeout")


def periods(stream: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    """Sessions by event time; an end is the last event, not the end of the gap."""
    window = F.session_window(time, gap)
    return stream.withWatermark(time, gap).groupBy(*keys, window).agg(F.count("*").alias("n"), F.max(time).alias("end")).select(*keys, F.col("session_window.start").alias("start"), "end", "n")


def last_seen(stream: DataFrame) -> DataFrame:
    return stream.groupBy("source").agg(F.max("t").alias("last_seen"))


def fold(stream: DataFrame, into: str, apply: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Runs a batch function on every micro-batch and appends its rows; a batch that is run again replaces its folder."""

    def each(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Envelopes appended to a folder as JSON lines."""
    return spark.readStream.schema(schema).json(path)
