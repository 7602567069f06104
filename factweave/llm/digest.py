"""Document fingerprints by improbable features.

Every 64-byte window of a text has an entropy. How rare an entropy is, over all windows of all documents,
ranks the windows; a window that is the rarest of its neighbourhood often enough becomes a feature. Features go
into a chain of Bloom filters of 2,048 bits, a new one after every 160 features. Two chains are compared
filter by filter: the shared bits, less those that chance would share, over the most that could be shared.

The rarity table is the only thing gathered from the corpus: one count per entropy, of all windows.

Defined results: a null text is an empty one; an empty text has the fingerprint without filters, which is
like another such one (1) and unlike all others (0); a text under 64 bytes has one window, itself filled up
with zero bytes; windows under a tenth of the largest entropy are features only where a text has no others;
rows are ordered by descending id, null last, rows with equal ids by text; the only row is followed by
itself; equal texts have equal fingerprints; an empty table gives an empty result; extra columns are ignored, whatever
their names. Work is done on runs of about half a megabyte, so memory follows the longest text only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, small_batches, utf8

WINDOW, NEAR, OFTEN = 64, 64, 16
LEVELS, LOWEST = 1000, 100
BITS, HASHES, PER_FILTER = 2048, 5, 160
_FIX = 1 << 20
#: What the m-th equal byte of a window adds to the sum of count * log2(count), in fixed point.
_ADDS = np.array([0, *(round((m * np.log2(m) - (m - 1) * np.log2(max(m - 1, 1))) * _FIX) for m in range(1, WINDOW + 1))], np.int64)
_FULL = round(WINDOW * np.log2(WINDOW) * _FIX)


def levels(raw: np.ndarray) -> np.ndarray:
    """Entropy of the window that begins at each byte, in 0 to 1000."""
    n = len(raw) - WINDOW + 1
    ahead, back = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)
    for k in range(1, WINDOW):
        same = (raw[:-k] == raw[k:]).view(np.uint8)
        ahead[:-k] += same
        back[k:] += same
    first = _ADDS[back[:WINDOW] + 1].sum()
    change = _ADDS[back[WINDOW:] + 1] - _ADDS[ahead[: n - 1] + 1]
    total = first + np.r_[np.int64(0), np.cumsum(change)]
    return ((_FULL - total) * LEVELS // _FULL).clip(0, LEVELS).astype(np.int32)


def _runs(raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: bytes with short texts filled up to a window, starts, and windows of each."""
    for i, j in pieces(offsets, most):
        sizes = np.diff(offsets[i : j + 1])
        room = np.where(sizes > 0, np.maximum(sizes, WINDOW), 0)
        starts = np.r_[0, np.cumsum(room)]
        filled = np.zeros(starts[-1], np.uint8)
        part = raw[offsets[i] : offsets[j]]
        filled[np.arange(len(part)) + np.repeat(starts[:-1] - (offsets[i:j] - offsets[i]), sizes)] = part
        yield i, j, filled, starts[:-1], np.maximum(room - WINDOW + 1, 0) * (room > 0)


def _inside(starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Marks the windows that lie inside one document."""
    edge = np.zeros(n + 1, np.int32)
    some = counts > 0
    np.add.at(edge, starts[some], 1)
    np.add.at(edge, (starts + counts)[some], -1)
    return np.cumsum(edge[:-1]) > 0


def count_levels(docs: DataFrame) -> dict[int, int]:
    """Windows by entropy, over all texts; at most 1,001 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for _, _, raw, starts, counts in _runs(*utf8(batch.column("text"))):
                if len(raw):
                    found = levels(raw)
                    total += np.bincount(found[_inside(starts, counts, len(found))], minlength=LEVELS + 1)
        yield pa.RecordBatch.from_pydict({"level": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]})

    return {r[0]: r[1] for r in docs.select("text").mapInArrow(run, "level int, n bigint").groupBy("level").agg(F.sum("n")).collect()}


def rarity(counts: dict[int, int]) -> np.ndarray:
    """Rank of each entropy, the rarest first; low entropies come last."""
    order = sorted(range(LEVELS + 1), key=lambda e: (e < LOWEST, counts.get(e, 0), e))
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    return ranks


def features(raw: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """Distinct feature hashes of each document, in the order of the text."""
    out: list[np.ndarray] = []
    for i, j, filled, starts, counts in _runs(raw, offsets):
        if not len(filled):
            out += [np.zeros(0, np.uint64)] * (j - i)
            continue
        found = levels(filled)
        n, inside = len(found), _inside(starts, counts, len(found))
        key = np.full(n + NEAR, np.iinfo(np.int64).max)
        key[:n][inside] = (ranks[found[inside]] << 40) | np.flatnonzero(inside)
        step = 1
        while step < NEAR:  # minima of 2, 4, .. 64 neighbours
            key[:-step] = np.minimum(key[:-step], key[step:])
            step *= 2
        wins = np.bincount(key[:n][inside] & ((1 << 40) - 1), minlength=n)
        low = ranks[found] > LEVELS - LOWEST
        chosen = np.flatnonzero((wins >= OFTEN) & ~low)
        at = np.searchsorted(chosen, np.r_[starts, n])
        parts = []
        for k in range(j - i):
            mine = chosen[at[k] : at[k + 1]]
            if not len(mine) and counts[k]:
                some = wins[starts[k] : starts[k] + counts[k]]
                mine = np.array([starts[k] + int(np.argmax(some))])
            parts.append(mine)
        picked = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        bytes_of = np.ascontiguousarray(filled[picked[:, None] + np.arange(WINDOW)]).view(np.uint64)
        hashed = np.zeros(len(picked), np.uint64)
        for c in range(bytes_of.shape[1]):
            hashed = mix(hashed + bytes_of[:, c])
        ends = np.cumsum([len(p) for p in parts])
        for k, e in enumerate(ends):
            mine = hashed[e - len(parts[k]) : e]
            _, first = np.unique(mine, return_index=True)
            out.append(mine[np.sort(first)])
    return out


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters as rows of bytes."""
    n = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((n, BITS), bool)
    rows = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[rows, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chains, 0 to 1: each filter of the shorter against its best match in the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = a.view(np.uint64), b.view(np.uint64)
    nx, ny = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x, y))
    total = 0.0
    for row, count in zip(x, nx, strict=True):
        shared = np.bitwise_count(y & row).sum(axis=1, dtype=np.int64)
        chance, most = count * ny / BITS, np.minimum(count, ny)
        total += float(count) * float(np.max(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)))
    return round(total / float(nx.sum()), 9)


def text_form(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_texts(texts: Sequence[str], ranks: np.ndarray) -> list[np.ndarray]:
    return [chain(h) for h in features(*utf8(pa.array(texts, pa.large_string())), ranks)]


def with_next(docs: DataFrame, parts: int, tasks: int) -> DataFrame:
    """The documents dealt into parts by ranges of the id; the first of the next part is copied to the end of each.

    The limits are ids that exist, taken from a summary of the ids: as many numbers as parts.
    """
    smallest = -(1 << 63)
    ids = F.coalesce(F.col("doc_id"), F.lit(smallest))
    shares = [k / parts for k in range(1, parts)]
    row = docs.select(F.percentile_approx(ids, shares or [0.5], 10 * parts + 1000), F.max(ids)).first()
    limits = np.array(sorted({v for v in row[0] or [] if v < row[1]} if shares else ()), np.int64)
    top = row[1] if row[1] is not None else smallest

    @F.pandas_udf("array<struct<part:int,copy:boolean>>")
    def places(d: pd.Series) -> pd.Series:
        v = d.to_numpy(np.int64)
        at = np.searchsorted(limits, v, "left")
        last = (at < len(limits)) & (limits[np.minimum(at, len(limits) - 1)] == v) if len(limits) else np.zeros(len(v), bool)
        out = [[{"part": int(k), "copy": False}] for k in at]
        for k in np.flatnonzero(last):
            out[k].append({"part": int(at[k]) + 1, "copy": True})
        for k in np.flatnonzero(v == top):
            out[k].append({"part": 0, "copy": True})
        return pd.Series(out)

    return (
        docs.withColumn("p", F.explode(places(ids))).select("doc_id", "text", "p.part", "p.copy")
        .repartition(tasks, "part").sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "text")
    )


def _fingerprints(ranks: np.ndarray, most: int = 1 << 19):
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((k, pa.string()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """``rows`` follow one another; the last is there as the next of the one before, or of a part that is over."""
        pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[2] == b[2] and not a[3]]
        changed = [edited(a[1], b[1]) for a, b in pairs]
        own = {id(r): f for r, f in zip(rows, fingerprint_texts([r[1] for r in rows], ranks), strict=True)}
        out = []
        for (a, b), text, other in zip(pairs, changed, fingerprint_texts(changed, ranks), strict=True):
            mine = own[id(a)]
            out.append((a[0], len(a[1]), hashlib.sha256(text.encode()).hexdigest(), text_form(mine), text_form(other), likeness(mine, other), likeness(mine, own[id(b)])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "part", "copy")), strict=True):
                if row[3] and held and held[-1][3] and held[-1][2] == row[2]:
                    continue  # rows that share the copied id: the first is the next one
                held.append((row[0], row[1] or "", row[2], row[3]))
                size += len(held[-1][1])
                if size > most:
                    yield finish(held)
                    held, size = held[-1:], len(held[-1][1])
        if held:
            yield finish(held)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited form, and their likenesses."""
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranks = rarity(count_levels(docs))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Several parts a task: parts go to tasks by a hash, and differ in size.
    return with_next(docs, 8 * tasks, tasks).mapInArrow(
        _fingerprints(ranks),
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
