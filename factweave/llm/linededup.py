"""Line dedup by pairwise alignment: common blocks go from the later document.

1. A block is a run of neighbouring lines with at least ``min_block_words`` words; lines of fewer than
   ``min_line_words`` words, which are common by nature, don't count and don't part neighbours. Documents are
   hashed by their smallest blocks: those that hold enough words no more without their first or without their
   last line. Every line of a longer block lies in a smallest one of it, and a smallest one has at most
   ``min_block_words / min_line_words`` lines, so the hashes are linear in the lines. A hash over several lines
   is rare where its single lines are frequent, so no line has to be left out for being frequent.
2. A document is paired with the earliest holder of each of its blocks: a block in n documents makes n - 1
   pairs, never n * n. No block is lost by that, since a later holder has nothing that the earliest lacks.
3. A pair is aligned by patience diff over the blocks that it shares: those that occur once in either
   document are anchors, matched along a longest rising run, and repeated ones are matched in the gaps.
   Blocks that stand in another order in the two documents are aligned by themselves, in as few rising
   runs as there can be.
4. The lines of aligned blocks are deleted from the later document. So what goes is exactly every line in a
   block that any earlier document holds, anywhere and however often, and the earliest holder keeps it.

Documents are ordered by id (null last), then by a hash of the text.

Defined results: null texts stay null and have no lines; empty texts and texts without a long enough
line are left alone; rows that are equal in id and text are one document, are treated alike and never
deduplicated against each other; an empty table gives an empty result; lines repeated inside one
document only are left alone; texts of any length are handled as narrow rows, one per block, and only a pair's
shared blocks are held by a task; extra columns are carried through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_words, groups, let, meet, small_batches, tidy, written

MIN_LINE_WORDS, MIN_BLOCK_WORDS = 3, 10


def row_key(id_col: str, text_col: str) -> Column:
    """Orders documents, and tells those with the same id apart."""
    return F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"),
    )


def longest_run(values: list[int]) -> list[int]:
    """Positions of a longest subsequence that never falls."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_right(tails, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(rows: list[tuple[int, int, bool]]) -> list[int]:
    """Positions of the aligned rows among ``rows`` (place in a, place in b, unique in both), which rise in b.

    The unique ones are the anchors: a longest run of them that never falls in a. Others are aligned within the gaps.
    """
    sure = [k for k, r in enumerate(rows) if r[2]]
    anchors = [sure[k] for k in longest_run([rows[k][0] for k in sure])]
    out: list[int] = []
    before, low = -1, -1
    for anchor in [*anchors, len(rows)]:
        high = rows[anchor][0] if anchor < len(rows) else 1 << 60
        gap = [k for k in range(before + 1, anchor) if not rows[k][2] and low <= rows[k][0] <= high]
        out += [gap[i] for i in longest_run([rows[k][0] for k in gap])]
        if anchor < len(rows):
            out.append(anchor)
        before, low = anchor, high
    return out


def rising(values: list[int]) -> list[list[int]]:
    """Positions dealt into as few subsequences that never fall as there can be (the piles of patience sorting)."""
    tails: list[int] = []
    piles: list[list[int]] = []
    for i, v in enumerate(values):
        k = bisect_right(tails, v) - 1
        if k < 0:
            tails.insert(0, v)
            piles.insert(0, [i])
        else:
            tails[k] = v
            piles[k].append(i)
    return piles


def align(rows: list[tuple[int, int, bool]]) -> Iterator[tuple[bool, list[int]]]:
    """The patience alignment of a pair, then the alignments of what stands in another order: moved or not, positions in ``rows``."""
    main = patience(rows)
    yield False, main
    done = set(main)
    rest = [k for k in range(len(rows)) if k not in done]
    for pile in rising([rows[k][0] for k in rest]):
        yield True, [rest[i] for i in pile]


_SPANS = pa.schema([("b", pa.string()), ("a", pa.string()), ("b_rank", pa.int32()), ("a_rank", pa.int32()), ("n", pa.int32()), ("moved", pa.bool_()), ("lines", pa.list_(pa.int32()))])
_SPANS_DDL = "b string, a string, b_rank int, a_rank int, n int, moved boolean, lines array<int>"


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for (b, a), pair in groups(batches, ["b", "a"]):
        at_a, at_b, size, name, sole, lines = (pair.column(k).to_pylist() for k in ("a_rank", "b_rank", "k", "name", "sole", "lines"))
        seen: dict[int, int] = {}
        for x in name:
            seen[x] = seen.get(x, 0) + 1
        rows = [(x, y, s and seen[z] == 1) for x, y, s, z in zip(at_a, at_b, sole, name, strict=True)]
        for moved, run in align(rows):
            span: dict | None = None
            for k in run:  # blocks that overlap or touch, at one distance, are one span
                if span is None or at_b[k] - at_a[k] != span["b_rank"] - span["a_rank"] or at_b[k] > span["b_rank"] + span["n"]:
                    span = {"b": b, "a": a, "b_rank": at_b[k], "a_rank": at_a[k], "n": 0, "moved": moved, "lines": []}
                    held.append(span)
                new = at_b[k] + size[k] - span["b_rank"] - span["n"]
                if new > 0:
                    span["lines"] += lines[k][-new:]
                    span["n"] += new
        if sum(s["n"] for s in held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, _SPANS)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _SPANS)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line_words: int = MIN_LINE_WORDS, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """Aligned common blocks: the later document b and the earlier a (``key_text``), where the block begins among the counted
    lines of either (from 1), its lines, whether it stands out of order, and the line numbers of b (from 0)."""
    least = max(1, min_line_words)
    most = max(1, -(-min_block_words // least))
    long_enough = F.filter(
        F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), count_words(x).cast("int").alias("w"))),
        lambda x: x["w"] >= least,
    )

    def block(rows: Column, i: Column, k: Column) -> Column:
        total = F.aggregate(F.slice(rows, i, k), F.lit(0).cast("long"), lambda n, x: n + x["w"])
        spare = total - F.greatest(F.get(rows, i - 1)["w"], F.get(rows, i + k - 2)["w"])
        return F.struct(i.alias("i"), k.alias("k"), ((total >= min_block_words) & (spare < min_block_words)).alias("smallest"))

    def smallest(rows: Column) -> Column:
        lengths = lambda i: F.sequence(F.lit(1), F.least(F.lit(most), F.size(rows) - i + 1))
        found = F.flatten(F.transform(F.sequence(F.lit(1), F.size(rows)), lambda i: F.filter(F.transform(lengths(i), lambda k: block(rows, i, k)), lambda b: b["smallest"])))
        return F.transform(found, lambda b: let(F.slice(rows, b["i"], b["k"]), lambda x: F.struct(F.xxhash64(x["h"]).alias("name"), b["i"].alias("i"), x["line"].alias("lines"))))

    found = written(
        docs.where(F.col(text_col).isNotNull()).select(row_key(id_col, text_col).alias("key"), long_enough.alias("rows")).where(F.size("rows") > 0)
        .select("key", F.inline(let(F.col("rows"), smallest))),
        "blocks",
    )
    # The first and the last place of a block in its earliest holder: it is the only one there if they are the same.
    owners = written(
        found.groupBy("name").agg(F.min(F.struct("key", "i")).alias("first"), F.min(F.struct("key", (-F.col("i")).alias("i"))).alias("final"), F.max("key").alias("last"), F.count("*").alias("n"))
        .where("first.key <> last")
        .select("name", F.col("first.key").alias("owner"), F.col("first.i").alias("a_rank"), (F.col("first.i") == -F.col("final.i")).alias("sole"), "n"),
        "owners",
    )
    met = meet(found, owners, "name").where("key <> owner").select(
        key_text(F.col("key")).alias("b"), key_text(F.col("owner")).alias("a"), "a_rank", F.col("i").alias("b_rank"), F.size("lines").alias("k"), "name", "sole", "lines",
    )
    return small_batches(met).repartition("b").sortWithinPartitions("b", "a", "b_rank", "k").mapInArrow(tidy(_aligned), _SPANS_DDL)


def key_text(key: Column) -> Column:
    return F.concat_ws(":", F.when(key["none"], "-").otherwise(key["id"].cast("string")), key["h"].cast("string"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """``docs`` without the lines of aligned blocks, and n_lines and n_deleted (of the text as it was)."""
    found = spans(docs, id_col, text_col, **sizes)
    gone = found.groupBy(F.col("b").alias("__b")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("__gone"))
    split, last = F.split(text_col, "\n"), F.col("__gone")
    # The deleted lines are sorted: only the runs of kept lines between them are cut out.
    begin = lambda i: F.coalesce(F.get(last, i - 1) + 1, F.lit(0))
    kept = let(split, lambda rows: F.flatten(
        F.transform(F.concat(last, F.array(F.size(rows))), lambda x, i: F.slice(rows, begin(i) + 1, x - begin(i)))
    ))
    joined = docs.withColumn("__key", key_text(row_key(id_col, text_col))).join(gone, F.col("__key") == F.col("__b"), "left")
    n_deleted = F.coalesce(F.size("__gone"), F.lit(0))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted")],
        F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.greatest(n_deleted, F.lit(0)).cast("long").alias("n_deleted"),
    )
