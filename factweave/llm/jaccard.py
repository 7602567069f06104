"""Exact Jaccard self-join of word shingle sets with a count-vector R-tree, down to connected components.

1. Every text becomes its set of hashed shingles. Equal sets form a class; the smallest id stands for it.
2. Sets that can reach the threshold differ in at most d shingles, d following from their sizes. Hashed
   into more than d groups, they agree in at least one whole group. So every class names each of its groups
   by a hash of the group's content, and only classes that share a name can be linked. Where their count
   vectors allow a link, too, they are tied, and fall into blocks: mostly families of near copies.
3. Inside a block, the counts of shingles in ``GROUPS`` hash groups are points in an R-tree. The overlap of
   two sets is at most the sum of the coordinates' minima, for a tree node of the minima with the largest
   counts below it. Pairs that survive the bound and aren't connected yet are verified on the sets themselves.
   Of a long text a small vector bounds little, since its counts hardly differ from those of any other; so blocks that
   would fill a tile are parted first by vectors whose length follows the size of the set.
4. Blocks that are still large are cut into tiles by a hash, so that no task holds or sorts a block. First every tile is searched
   by itself; then one class of each component that a tile has found is compared with those of other tiles;
   and only what these two rounds leave apart is compared between tiles, pair by pair of tiles. A family of near copies is
   one component after the first rounds, however large it is, and costs no pairs of tiles.
   Tasks emit a spanning forest of links, never all pairs, and the forests' components are the result.

No step drops a candidate: group names, bounds and tiles only skip pairs that cannot reach the threshold
or are connected already.

Defined results: texts without words (null, empty or blank) have 0 shingles and are linked with nothing;
fewer words than a shingle make one shingle of them all; rows that share an id are one document, linked with
each other if they have words, each with its own count; rows with a null id get a null component and link nothing; equal sets
are linked at any size; an empty table gives an empty result; extra columns are ignored, whatever their
names. A text is held whole by one task, several times over while it is shingled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, groups, meet, mix, pieces, remove, scratch, small_batches, stored, tidy, utf8, word_hashes, written

SHINGLE = 5
#: Shingles of a tile; a smaller document counts as LEAST.
TILE, LEAST = 1 << 21, 512
GROUPS = 256
#: Groups of the smaller count vectors that are compared where classes meet; classes of a name that a task compares at once.
SKETCH, MEET = 128, 1024
#: Shingles to a group of the longer vectors; bytes of such vectors that a task compares at once.
FINE, HELD = 8, 8 << 20
ONE, TWO, THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

#: Lower ends of bands of set sizes, each half as large again as the one before.
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, -(-BANDS[-1] * 3 // 2)))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words, at = word_hashes(raw, offsets)
    rolled = words.copy()
    for k in range(1, size):
        rolled[:-k] = mix(rolled[:-k] * ONE + words[k:]) if len(words) > k else rolled[:-k]
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for k in range(a + 1, b):
                whole = mix(whole * TWO + words[k : k + 1])
            out.append(mix(whole * THREE + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def apart(most: int, num: int, den: int) -> int:
    """Shingles in which two sets of at most ``most`` can differ, at a Jaccard similarity of num/den or more."""
    return 2 * most * (den - num) // (den + num)


@lru_cache(maxsize=None)
def group_count(band: int, num: int, den: int) -> int:
    """Groups for a band: enough that even its smallest sets fill more groups than those in which they may differ."""
    d, low = apart(BANDS[band + 1] - 1, num, den), -(-num * BANDS[band] // den)
    m = d + 1
    while m * (1 - math.exp(-low / m)) < d + 1 + 2 * math.sqrt(m * math.exp(-low / m)) and m < 4 * low:
        m += max(1, m // 50)
    return m


def names(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the groups' contents, for each band in which a partner of at least this size can lie.

    Partners differ in at most d groups, so a set that fills more than d groups shares a filled one with
    each; a set that fills fewer names its empty groups, too.
    """
    n = len(tokens)
    band = int(np.searchsorted(BANDS, n, "right")) - 1
    out = []
    mixed = mix(tokens + TWO)
    while den * n >= num * BANDS[band]:
        d = apart(BANDS[band + 1] - 1, num, den)
        if d:  # else only equal sets match
            m = group_count(band, num, den)
            group = (mix(tokens ^ THREE) % np.uint64(m)).astype(np.int64)
            content = np.zeros(m, np.uint64)
            np.add.at(content, group, mixed)
            where = np.flatnonzero(np.bincount(group, minlength=m))
            if len(where) <= d:
                where = np.arange(m)
            out.append(mix(content[where] ^ mix(np.uint64(band << 32) + where.astype(np.uint64) + ONE)))
        band += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _counts(tokens: np.ndarray, groups_: int) -> np.ndarray:
    return np.bincount((tokens >> np.uint64(40)).astype(np.int64) % groups_, minlength=groups_)


def fine_groups(size: float, least: int, most: int) -> int:
    """A power of two of groups for sets of a size, so that a longer vector is folded to a shorter one by adding halves."""
    return min(most, max(least, 1 << max(0, math.ceil(math.log2(max(size, 1) / FINE)))))


def fine_vector(tokens: np.ndarray) -> bytes | None:
    """Counts, 255 for any larger, in as many groups as the set's size asks for; none if the small vector has as many."""
    g = fine_groups(len(tokens), SKETCH, 1 << 20)
    return _counts(tokens, g).clip(0, 255).astype(np.uint8).tobytes() if g > SKETCH else None


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _signatures(num: int, den: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for i, j in pieces(offsets):
                sets = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                keys = [names(s, num, den) for s in sets]
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(_signed([mix(s ^ salt).sum(dtype=np.uint64) for s in sets]), pa.int64()) for salt in (ONE, TWO)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(keys)))),
                        pa.array([_counts(s, SKETCH).clip(0, 255).astype(np.uint8).tobytes() for s in sets], pa.binary()),
                        pa.array([fine_vector(s) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "names", "sketch", "fine"],
                )

    return run


class CountTree:
    """R-tree of count vectors, packed by size and then by the weight of the first half of the groups."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, num: int, den: int, fan: int = 16) -> None:
        self.num, self.den, self.sizes = num, den, sizes
        slab = np.argsort(sizes, kind="stable")
        side = max(fan, int(np.sqrt(len(sizes) / fan)) * fan)
        half = counts[:, : counts.shape[1] // 2].sum(axis=1, dtype=np.int64)
        self.order = np.concatenate([s[np.argsort(half[s], kind="stable")] for s in (slab[k : k + side] for k in range(0, len(slab), side))])
        #: From the points up: largest counts, smallest and largest size of each node.
        self.levels = [(counts[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > fan:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))
        self.fan = fan

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose bound lets them reach the threshold with the given one."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[at] for x in self.levels[level])
            fits = (self.num * low <= self.den * size) & (self.den * high >= self.num * size)
            at, top, low = at[fits], top[fits], low[fits]
            bound = np.minimum(top, point).sum(axis=1, dtype=np.int64)
            at = at[(self.num + self.den) * bound >= self.num * (size + low)]
            if level:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]


def forest(ids: np.ndarray, sets: list[np.ndarray], roots: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what is linked; rows with one root are connected already."""
    sizes = np.array([len(s) for s in sets])
    groups_ = fine_groups(float(np.median(sizes)), GROUPS, 16 * GROUPS)
    counts = np.zeros((len(sets), groups_), np.int32)
    for k, s in enumerate(sets):
        counts[k] = _counts(s, groups_)
    tree = CountTree(counts, sizes, num, den)
    label = np.unique(roots, return_inverse=True)[1].copy()
    left = len(np.unique(label))
    out = []
    for q in range(len(sets)):
        if left == 1:
            break
        near = tree.search(counts[q], int(sizes[q]))
        for k in near[label[near] != label[q]].tolist():
            if label[k] == label[q]:
                continue
            shared = len(np.intersect1d(sets[q], sets[k], assume_unique=True))
            if den * shared >= num * (len(sets[q]) + len(sets[k]) - shared):
                out.append((int(ids[q]), int(ids[k])))
                label[label == label[k]] = label[q]
                left -= 1
    return out


def _meetings(num: int, den: int):
    """Of classes that share a name, those whose count vectors allow a link: a forest that connects them.

    Takes names of at most ``MEET`` classes. A count of 255 stands for any larger one, so such counts bound nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, rows in groups(batches, ["name"]):
            ids, sizes = rows.column("rep").to_numpy(), rows.column("n_shingles").to_numpy()
            if len(ids) > 1:
                counts = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int64)
                counts[counts == 255] = 1 << 30
                label = np.arange(len(ids))
                for q in range(len(ids) - 1):
                    near = np.flatnonzero(label[q + 1 :] != label[q]) + q + 1
                    bound = np.minimum(np.minimum(counts[near], counts[q]).sum(axis=1), np.minimum(sizes[near], sizes[q]))
                    near = near[((num + den) * bound >= num * (sizes[near] + sizes[q])) & (den * np.minimum(sizes[near], sizes[q]) >= num * np.maximum(sizes[near], sizes[q]))]
                    for k in near.tolist():
                        if label[k] != label[q]:
                            out.append((int(ids[q]), int(ids[k])))
                            label[label == label[k]] = label[q]
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def parted(sizes: np.ndarray, vectors: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of places, in order of size, whose vectors allow a link: a forest that connects all such.

    Vectors have powers of two of counts that don't fall along the sizes; the longer of a pair is folded.
    """
    length = np.array([len(v) for v in vectors])
    level = {g: (np.flatnonzero(length == g), None) for g in np.unique(length)}
    for g, (at, _) in level.items():
        rows = np.frombuffer(b"".join(vectors[k] for k in at), np.uint8).reshape(len(at), g).astype(np.int32)
        rows[rows == 255] = 1 << 20  # a count of 255 stands for any larger one, so it bounds nothing
        level[g] = (at, {g: rows})
    label, out = np.arange(len(sizes)), []
    for q in range(len(sizes) - 1):
        g = length[q]
        own = level[g][1][g][np.searchsorted(level[g][0], q)]
        for at, folded in (level[x] for x in level if x >= g):
            first = np.searchsorted(at, q, "right")
            last = np.searchsorted(sizes[at], den * sizes[q] // num, "right")
            near = np.arange(first, max(first, last))
            near = near[label[at[near]] != label[q]]
            if not len(near):
                continue
            if g not in folded:
                rows = folded[max(folded)]
                folded[g] = rows.reshape(len(rows), -1, g).sum(axis=1)
            bound = np.minimum(np.minimum(folded[g][near], own).sum(axis=1, dtype=np.int64), sizes[q])
            for k in at[near[(num + den) * bound >= num * (sizes[at[near]] + sizes[q])]].tolist():
                if label[k] != label[q]:
                    out.append((q, k))
                    label[label == label[k]] = label[q]
    return out


def _partings(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, ["cell"]):
            ids = rows.column("doc_id").to_numpy()
            pairs = parted(rows.column("n_shingles").to_numpy(), rows.column("vector").to_pylist(), num, den)
            if pairs:
                yield _batch([(int(ids[a]), int(ids[b])) for a, b in pairs])

    return run


def _blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """``block, doc_id, n_shingles`` of ``members``, which have ``vector``, too: blocks that would fill a tile are parted by the vectors.

    A block's classes lie in bands of sizes, of which only neighbours can hold linked ones; so every class is compared
    in the cell of its own band and in that of the next one.
    """
    weights = members.groupBy("block").agg(F.sum(F.greatest("n_shingles", F.lit(LEAST))).alias("total"), F.count("*").alias("n"))
    sized = written(meet(members, weights, "block"), "weighed")
    large = sized.where(F.col("total") > TILE)
    small = sized.where(F.col("total") <= TILE).select("block", "doc_id", "n_shingles")
    if large.isEmpty():
        return small
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(1.001 * den / num))
    cells = written(large.select("doc_id", "n_shingles", "vector", F.explode(F.array(F.xxhash64("block", band), F.xxhash64("block", band + 1))).alias("cell")), "cells")
    totals = cells.groupBy("cell").agg(F.sum(F.octet_length("vector")).alias("bytes"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    held = meet(cells, totals, "cell")
    compared = held.where(F.col("bytes") <= HELD).select("cell", "doc_id", "n_shingles", "vector").repartition("cell").sortWithinPartitions("cell", "n_shingles", "doc_id")
    # Cells of more than a task should hold stay together.
    whole = held.where(F.col("bytes") > HELD).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    found = components(compared.mapInArrow(tidy(_partings(num, den)), "a bigint, b bigint").unionByName(whole), "parted")
    # Who is tied to nobody any more is linked with nobody.
    return small.unionByName(large.drop("block").join(found.select(F.col("id").alias("doc_id"), F.col("root").alias("block")), "doc_id").select("block", "doc_id", "n_shingles"))


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=_LINKS)


def _links(num: int, den: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []
        for _, rows in groups(batches, ["task"]):
            ids, roots, want = (rows.column(k).to_numpy() for k in ("doc_id", "root", "n_shingles"))
            sets = []
            for text in rows.column("text").chunks:  # as they came, without a copy of the group's texts
                raw, offsets = utf8(text)
                sets += [s for i, j in pieces(offsets) for s in shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)]
            rows = text = raw = None  # the sets are all that the rest needs
            # Rows that share an id meet every text of it, and keep those of their own size.
            some = [k for k, s in enumerate(sets) if len(s) and len(s) == want[k]]
            if len(some) > 1:
                held += forest(ids[some], [sets[k] for k in some], roots[some], num, den)
            if len(held) >= 10_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return run


def _tiled(rows: DataFrame) -> DataFrame:
    """``rows(block, part, doc_id, n_shingles, root)`` dealt into ``tile``s of about ``TILE`` shingles, by a hash inside each part of a block.

    Written; a part that needs one tile has the tile 0.
    """
    rows = written(rows.withColumns({"weight": F.greatest("n_shingles", F.lit(LEAST)), "place": F.xxhash64("block", "part")}), "members")
    sums = rows.groupBy("place").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    many = F.ceil(F.col("total") / TILE)
    return written(meet(rows, sums, "place").withColumn("tile", F.xxhash64("place", F.pmod(F.xxhash64("doc_id", "n_shingles"), many))).drop("place", "total"), "tiles")


def _searched(tasks: DataFrame, docs: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """Links among the rows ``task, doc_id, n_shingles, root`` of each task."""
    dealt = tasks.join(docs, "doc_id").select("task", "doc_id", "n_shingles", "root", "text")
    return written(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(tidy(_links(num, den, size)), "a bigint, b bigint"), "found")


def _links_of_blocks(members: DataFrame, docs: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """Links a, b that connect what is linked inside the blocks of ``members(block, doc_id, n_shingles)``."""
    weights = members.groupBy("block").agg(F.sum(F.greatest("n_shingles", F.lit(LEAST))).alias("total"), F.count("*").alias("n"))
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(1.1))
    part = F.when(F.col("total") > TILE, band).otherwise(F.lit(-1)).cast("long").alias("part")
    tiles = _tiled(meet(members, weights, "block").select("block", part, "doc_id", "n_shingles", F.col("doc_id").alias("root")))
    links = _searched(tiles.withColumn("task", F.col("tile")), docs, num, den, size)
    shared = tiles.where("part >= 0")
    if shared.isEmpty():
        return links

    def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
        joined = rows.drop("root").join(found.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left")
        return joined.withColumn("root", F.coalesce("root", "doc_id"))

    known = written(rooted(shared, components(links, "links")), "rooted")
    # One class of each component of a tile, the middle one by size, stands for it.
    middle = known.groupBy("block", "tile", "root").agg(F.percentile_approx("n_shingles", 0.5, 100).alias("m"))
    chosen = known.join(middle, ["block", "tile", "root"]).where("n_shingles = m").groupBy("block", "tile", "root").agg(F.min(F.struct("n_shingles", "doc_id")).alias("x"))
    spokes = _tiled(chosen.select("block", F.lit(0).cast("long").alias("part"), "x.doc_id", "x.n_shingles", "root"))
    links = links.unionByName(_searched(spokes.withColumn("task", F.col("tile")), docs, num, den, size))
    known = written(rooted(shared, components(links, "links")), "rooted")
    # A component that fills tiles gets its own; the others of a block share tiles by their sizes. No component lies in two blocks.
    roots = known.groupBy("root").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    part = F.when(F.col("total") >= TILE, F.xxhash64("root")).otherwise(F.col("part")).alias("part")
    tiles = _tiled(meet(known, roots, "root").select("block", part, "doc_id", "n_shingles", "root"))
    ends = tiles.groupBy("block", "tile").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.min("root").alias("r"), F.max("root").alias("s"))
    ends = written(ends.withColumn("sole", F.when(F.col("r") == F.col("s"), F.col("r"))).drop("r", "s"), "tile-ends")
    other = ends.select("block", F.col("tile").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.col("sole").alias("sole_j"))
    # Tiles meet where their sizes allow a link and where they aren't of one component.
    apart_ = F.coalesce(F.col("sole") != F.col("sole_j"), F.lit(True))
    tasks = ends.withColumnRenamed("tile", "i").join(other, "block").where(
        (F.col("i") <= F.col("j")) & apart_ & (F.col("low") * num <= F.col("high_j") * den) & (F.col("low_j") * num <= F.col("high") * den)
    ).select("block", F.xxhash64("i", "j").alias("task"), F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    return links.unionByName(_searched(tiles.join(tasks, ["block", "tile"]), docs, num, den, size))


def _ties(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs a, b of classes that share a name and whose count vectors allow a link: enough to connect all such."""
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = classes.select("rep", F.explode("names").alias("name"))
    # Names that hold more than about a task's share of all are told by every 64th class, since all that hangs on it is where rows go.
    # They are at most a few per task, and are counted and tied without being dealt out by their hash.
    some = written(classes.where(F.pmod(F.xxhash64("rep"), F.lit(64)) == 0).select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "names")
    share = max(MEET // 64, (some.agg(F.sum("n")).first()[0] or 0) // (4 * tasks))
    hot = some.where(F.col("n") > share).select("name")
    counted = named.join(F.broadcast(hot), "name").groupBy("name").agg(F.count("*").alias("n"), F.min("rep").alias("first"))
    counted = written(counted.where(F.col("n") > MEET), "hot-names")
    tied = named.join(F.broadcast(counted), "name").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    # Names of one class only are dropped before anything is sent along with them.
    by_name = W.partitionBy("name")
    met = named.join(F.broadcast(counted.select("name")), "name", "left_anti").withColumns({"n": F.count("*").over(by_name), "first": F.min("rep").over(by_name)}).where("n > 1")
    vectors = classes.select("rep", "n_shingles", "sketch")
    meetings = met.where(F.col("n") <= MEET).select("rep", "name").join(vectors, "rep").repartition("name").sortWithinPartitions("name", "n_shingles", "rep")
    # Classes of a longer name are tied together without being compared, which may only make a block larger.
    longer = met.where(F.col("n") > MEET).select(F.col("first").alias("a"), F.col("rep").alias("b"))
    return meetings.mapInArrow(tidy(_meetings(num, den)), "a bigint, b bigint").unionByName(tied.unionByName(longer).where("a <> b"))


def join(docs: DataFrame, percent: int = 80, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs``: linked at ``percent`` of shingles of ``size`` words."""
    spark, num, den = docs.sparkSession, percent, 100
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path, at = scratch(spark, "signatures"), scratch(spark, "classes")
    every = stored(docs.mapInArrow(tidy(_signatures(num, den, size)), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, names array<bigint>, sketch binary, fine binary"), path)
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    same = F.struct("n_shingles", "s1", "s2")
    rows = written(every.select("doc_id", "n_shingles", F.when(linkable, same).alias("same")), "rows")
    every = every.where(linkable).groupBy(same.alias("same")).agg(F.min(F.struct("doc_id", "names", "sketch", "fine")).alias("x"), F.count("*").alias("n"))
    full = stored(every.select("same", "n", F.col("x.doc_id").alias("rep"), F.col("same.n_shingles").alias("n_shingles"), "x.names", "x.sketch", "x.fine"), at)
    remove(spark, path)
    classes = written(full.select("same", "n", "rep"), "classes")
    vectors = written(full.select("rep", "n_shingles", F.coalesce("fine", "sketch").alias("vector")), "vectors")
    blocks = components(_ties(full, num, den), "blocks").select(F.col("id").alias("doc_id"), F.col("root").alias("block"))
    remove(spark, at)
    # Only class representatives are compared, each class by its own size; several classes may have the same one if rows share an id.
    some = rows.where("same IS NOT NULL")
    members = written(vectors.withColumnRenamed("rep", "doc_id").join(blocks, "doc_id").select("block", "doc_id", "n_shingles", "vector"), "in-blocks")
    links = _links_of_blocks(written(_blocks(members, num, den).distinct(), "parted"), docs, num, den, size)
    # Rows that share an id are one document.
    several = some.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select("doc_id")
    reps = some.join(several, "doc_id").select("doc_id", "same").join(classes, "same").withColumn("first", F.min("rep").over(W.partitionBy("doc_id")))
    found = components(links.unionByName(reps.select(F.col("first").alias("a"), F.col("rep").alias("b"))), "links").select(F.col("id").alias("rep"), "root")
    rooted = written(classes.join(found, "rep", "left").select("same", "n", F.coalesce("root", "rep").alias("component_id")), "roots")
    alone = rows.where("same IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return meet(some, rooted, "same").select(*alone.columns).unionByName(alone)
