"""Timers on event time: silent sources and outcomes of actions; and feeds that are recorded, read again and replayed."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import STALE_AFTER

SILENT = "source string, silent_since timestamp, stale_from timestamp"
OUTCOME = "subject string, action string, outcome string, t timestamp"
#: Seconds in which an action must show. A fixed value.
DEADLINE = 120


def silent(stream: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Of ``stream(source, t, interval_seconds)``, sources that said nothing for three intervals after a report.

    A row comes once the watermark has passed that time, or with the next report if that is later than the time; the state is one
    report a source. A source without an interval never turns stale. Reports later than the watermark are left out by Spark.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        out = []
        last, interval = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            out.append((key[0], last, last + STALE_AFTER * interval * 1000))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("t")
            for t, pace in zip(rows["t"].astype("datetime64[ms]").astype("int64"), rows["interval_seconds"], strict=True):
                if last is not None and interval is not None and t > last + STALE_AFTER * interval * 1000:
                    out.append((key[0], last, last + STALE_AFTER * interval * 1000))
                if last is None or t >= last:
                    last, interval = int(t), None if pd.isna(pace) else int(pace)
            due = None if interval is None else last + STALE_AFTER * interval * 1000
            if due is not None and due < state.getCurrentWatermarkMs():
                out.append((key[0], last, due))
                state.remove()
            else:
                state.update((last, interval))
                if due is not None:
                    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["source", "silent_since", "stale_from"])
        for c in ("silent_since", "stale_from"):
            frame[c] = pd.to_datetime(frame[c], unit="ms")
        yield frame

    rows = stream.select("source", "t", F.col("interval_seconds").cast("double")).withWatermark("t", watermark)
    return rows.groupBy("source").applyInPandasWithState(step, SILENT, "last long, interval long", "append", "EventTimeTimeout")


def outcomes(stream: DataFrame, watermark: str = "10 seconds", deadline: int = DEADLINE) -> DataFrame:
    """Of ``stream(subject, t, action, predicate, value)``, how each action ended.

    A row with an ``action`` asks that its thing's predicate become the value; one without reports it. An action is ``done`` with the first such report
    from its time to the deadline, and ``no effect`` once the watermark has passed that. A report that arrives before the action in
    the stream is found if both are in one micro-batch. The state is the open actions of a thing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        waiting = json.loads(state.get[0]) if state.exists else []
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            rows = rows.assign(ms=rows["t"].astype("datetime64[ms]").astype("int64"), told=rows["action"].isna()).sort_values(["ms", "told"])
            for ms, action, predicate, value in zip(rows["ms"], rows["action"], rows["predicate"], rows["value"], strict=True):
                if not pd.isna(action):
                    waiting.append([int(ms), action, predicate, value])
                    continue
                met = [w for w in waiting if w[2:] == [predicate, value] and w[0] <= ms <= w[0] + deadline * 1000]
                out += [(key[0], w[1], "done", int(ms)) for w in met]
                waiting = [w for w in waiting if w not in met]
        now = state.getCurrentWatermarkMs()
        out += [(key[0], w[1], "no effect", w[0] + deadline * 1000) for w in waiting if w[0] + deadline * 1000 < now]
        waiting = [w for w in waiting if w[0] + deadline * 1000 >= now]
        if waiting:
            state.update((json.dumps(waiting),))
            state.setTimeoutTimestamp(max(min(w[0] for w in waiting) + deadline * 1000 + 1, now + 1))
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=["subject", "action", "outcome", "t"])
        frame["t"] = pd.to_datetime(frame["t"], unit="ms")
        yield frame

    rows = stream.select("subject", "t", "action", "predicate", "value").withWatermark("t", watermark)
    return rows.groupBy("subject").applyInPandasWithState(step, OUTCOME, "waiting string", "append", "EventTimeTimeout")


ENVELOPE = "t string, source string, topic string, payload string"


def record(stream: DataFrame, into: str, checkpoint: str):
    """Envelopes written as they arrive, as JSON lines that ``captured`` reads."""
    return stream.writeStream.format("json").option("checkpointLocation", checkpoint).option("path", into).trigger(availableNow=True).start()


def captured(spark: SparkSession, path: str) -> DataFrame:
    """Recorded envelopes with their file and their place in it; sort by both for the order of arrival."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), F.from_json("value", ENVELOPE).alias("x"))
    return lines.select("file", "at", "n", "x.*").where("t IS NOT NULL OR payload IS NOT NULL")


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A recording as a stream, so many files a micro-batch; the pace is the trigger's."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(path)
