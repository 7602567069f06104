"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import remove, scratch, stored, written
from ..operators.graph import components

__all__ = ["components", "count_words", "give_back", "groups", "let", "meet", "mix", "pieces", "remove", "scratch", "small_batches", "stored", "table", "tidy", "utf8", "word_hashes", "word_spans", "words", "written"]

#: Separators of words: ASCII blank, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once for each row however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WS), lambda w: w != "")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session held to a size that long texts cannot blow up."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 512), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = re.fullmatch(r"(\d+)b?", conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(key, str(most))
    return df


def meet(rows: DataFrame, keyed: DataFrame, on: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per value of ``on`` and in ``n`` how many of ``rows`` have it.

    A value is hot if it holds more than a quarter of a task's share of all rows. So hot values are at most a few
    per shuffle partition, whatever the input, and are broadcast; only the others are dealt out by their hash.
    ``rows`` is read twice and should be a written table.
    """
    share = max(1, rows.count() // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot, cool = keyed.where(F.col("n") > share).drop("n"), keyed.where(F.col("n") <= share).drop("n")
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cool, on)
    return rest.unionByName(rows.join(F.broadcast(hot), on))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most about ``most`` bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two rounds of multiply and shift)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_R, _R_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, r, np.uint64)]) for r in (_R, _R_INV)]
    return _POWERS[0], _POWERS[1]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, in order, A-Z in lower case; where each document's words begin (with the
    end); and the first byte and the end of each word."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, solid[:-1]]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~np.r_[solid[1:], False] | edge[1:])) + 1
    up, down = _powers(len(raw))
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[low] * up[: len(raw)])]
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_spans(raw, offsets)[:2]


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The allocator's function that gives memory back, if it has one: looked up once a worker."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system, which a worker that waits for its next task would keep else."""
    pa.default_memory_pool().release_unused()
    _POWERS.clear()
    if (trim := _trim()) is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving its memory back at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def _taken(held: list[pa.RecordBatch]) -> pa.Table:
    """The batches as a table; the list lets go of them, so that the reader of the table decides how long they live."""
    out = pa.Table.from_batches(held)
    held.clear()
    return out


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_pandas().to_numpy() for k in keys]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[i] for c in columns)
            if key != now and held:
                yield now, _taken(held)
            now = key
            held.append(batch.slice(i, j - i))
    if held:
        yield now, _taken(held)
