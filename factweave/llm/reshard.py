"""Minimum-cost-flow resharding under the law of equal bytes.

The sizes of the old shards and the capacities of the new ones make a flow network in which bytes that
stay cost nothing and bytes that move cost one each. Its solution, one number per pair of shards, is cut
into stretches of each old shard's row order; rows in the stretch that stays are not touched, and only
shards that lose rows are rewritten, while shards that only gain get new files.

The driver sees one row per old shard and one per stretch. Row order and slots come from running sums in
two steps, over blocks of an old shard and inside a block, so no task holds a shard.

Defined results: a null text has no bytes; a row's size is its text's UTF-8 bytes plus 1; equal rows are
interchangeable; rows with a null id have a place like any other; an empty table gives no rows and no
files; extra columns are carried into the files unless their name is one of the columns made here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, written

#: Rows that share a block of an old shard's order, on average: a block is sorted within one task.
PER_BLOCK = 4096


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, moving the fewest: successive shortest augmenting paths.

    Shard i may keep its bytes (i to i) at no cost; any other arc costs one per byte.
    """
    m, n = len(supply), len(capacity)
    s, t = m + n, m + n + 1
    arcs: list[list] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(m + n + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, r, c])

    for i, v in enumerate(supply):
        arc(s, i, v, 0)
        for j in range(n):
            arc(i, m + j, v, int(i != j))
    for j, v in enumerate(capacity):
        arc(m + j, t, v, 0)
    while True:
        far, came, queue = {s: 0}, {}, [s]
        while queue:
            x = queue.pop(0)
            for k in out[x]:
                y, room, cost = arcs[k]
                if room > 0 and far[x] + cost < far.get(y, 1 << 60):
                    far[y], came[y] = far[x] + cost, k
                    queue.append(y)
        if t not in far:
            break
        path, x = [], t
        while x != s:
            path.append(came[x])
            x = arcs[came[x] ^ 1][0]
        least = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= least
            arcs[k ^ 1][1] += least
    return {(i, arcs[k][0] - m): arcs[k ^ 1][1] for i in range(m) for k in out[i] if k % 2 == 0 and arcs[k ^ 1][1] > 0}


def equal_capacities(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def positions(rows: DataFrame, ids: Sequence[str], blocks: int) -> DataFrame:
    """Adds ``at``, the bytes, and ``nth``, the rows before each row in its old shard's order, over so many ``blocks``."""
    blocked = rows.withColumn("block", F.pmod(F.xxhash64(*ids), F.lit(blocks)).cast("long"))
    ahead = W.partitionBy("old_shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = blocked.groupBy("old_shard", "block").agg(F.sum("size").alias("b"), F.count("*").alias("c")).select(
        F.col("old_shard").alias("o"), F.col("block").alias("k"),
        F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("rows_before"),
    )
    inside = W.partitionBy("old_shard", "block").orderBy(*ids, "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        blocked.withColumns({"at": F.coalesce(F.sum("size").over(inside), F.lit(0)), "nth": F.count("*").over(inside)})
        .join(before, (F.col("old_shard") == F.col("o")) & (F.col("block") == F.col("k")))
        .withColumns({"at": F.col("at") + F.col("bytes_before"), "nth": F.col("nth") + F.col("rows_before")})
        .drop("o", "k", "bytes_before", "rows_before")
    )


def stretches(flow: dict[tuple[int, int], int], old: int) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, first byte, end) of every flow; what stays comes first."""
    out = []
    for i in range(old):
        at = 0
        for j, v in sorted(((j, v) for (a, j), v in flow.items() if a == i), key=lambda x: (x[0] != i, x[0])):
            out.append((i, j, at, at + v))
            at += v
    return out


def reshard(docs: DataFrame, old_shard: Column, old: int, new: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with size, text_crc32, old_shard, shard and slot.

    With ``out``, affected files are written to ``out/shard=j`` with the texts, and what was written is
    read back from there; rows that stay in a shard that loses none keep the file they are in.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = ("size", "text_crc32", "old_shard", "block", "at", "nth", "shard", "slot", "stretch")
    keep = [c for c in docs.columns if c not in (*made, id_col, text_col)] if out else []
    rows = docs.select(
        id_col, text_col, *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard"),
    )
    # As many blocks as rows ask for. Equal ids share a block, so the text's checksum deals them out, too.
    order = [id_col, "text_crc32"]
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("old_shard").agg(F.sum("size"), F.count("*")).collect()}  # one row per old shard
    sizes, blocks = {k: v[0] for k, v in found.items()}, 1 + max((v[1] for v in found.values()), default=0) // PER_BLOCK
    narrow = written(positions(rows.drop(text_col, *keep), order, blocks), "reshard")
    supply = [sizes.get(i, 0) for i in range(old)]
    flow = min_cost_flow(supply, equal_capacities(sum(supply), new))
    cuts = stretches(flow, old)

    def placed(df: DataFrame) -> DataFrame:
        number = F.lit(None).cast("int")
        for k, (i, _, lo, hi) in reversed(list(enumerate(cuts))):
            number = F.when((F.col("old_shard") == i) & (F.col("at") >= lo) & (F.col("at") < hi), F.lit(k)).otherwise(number)
        return df.withColumn("stretch", number)

    seen = {r[0]: (r[1], r[2]) for r in placed(narrow).groupBy("stretch").agg(F.min("nth"), F.count("*")).collect()}  # one row per stretch
    base, filled = {}, [0] * new
    for k, (_, j, _, _) in enumerate(cuts):
        if k in seen:
            base[k] = filled[j] - seen[k][0]
            filled[j] += seen[k][1]
    look = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values] or [F.lit(0).cast("long")]), F.col("stretch") + 1)

    def numbered(df: DataFrame) -> DataFrame:
        return placed(df).withColumns({"shard": look([c[1] for c in cuts]).cast("int"), "slot": F.col("nth") + look([base.get(k, 0) for k in range(len(cuts))])}).drop("block", "at", "nth", "stretch")

    if out is None:
        return numbered(narrow)
    # Rows leave losing shards only, whose files are rewritten; of all other shards no text is read or sent.
    moved = F.col("old_shard").isin([i for i in range(old) if any(a == i and j != i for a, j in flow)])
    full = numbered(positions(rows.where(moved), order, blocks))
    full.write.partitionBy("shard").parquet(out)
    again = docs.sparkSession.read.schema(full.schema).parquet(out).select(id_col, "size", "text_crc32", "old_shard", "shard", "slot")
    return again.unionByName(numbered(narrow).where(~moved).select(*again.columns))


def reshard_to_files(docs: DataFrame, old_shard: Column, old: int, new: int, **names: str) -> DataFrame:
    return reshard(docs, old_shard, old, new, out=scratch(docs.sparkSession, "shards"), **names)
