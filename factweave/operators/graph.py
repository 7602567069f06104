"""Graphs as edge tables: components, downstream walks, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, root)`` per vertex of an edge between
    two different vertices, where root is the smallest id of its component.

    Every round hooks each vertex to its smallest neighbour, follows the hooks to their ends by
    pointer jumping, and contracts the edges, so the rounds follow the logarithm of the component's size.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    found: DataFrame | None = None
    while not left.isEmpty():
        ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("p")), F.struct(F.col("b").alias("id"), F.col("a").alias("p")))
        hook = written(left.select(F.inline(ends)).groupBy("id").agg(F.least("id", F.min("p")).alias("p")), name)
        while True:
            # Only pointers that are followed are asked; of a large star, that is one row, which no hub's rows have to be dealt out for.
            end = hook.select(F.col("id").alias("p"), F.col("p").alias("q")).join(hook.select("p").distinct(), "p", "left_semi")
            hook = written(hook.join(end, "p").select("id", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), name)
            if hook.where("moved").isEmpty():
                break
            hook = hook.drop("moved")
        hook = hook.select("id", "p")
        to = hook.select(F.col("id").alias("root"), "p")
        if found is None:
            found = hook.withColumnRenamed("p", "root")
        else:
            found = written(found.join(to, "root", "left").select("id", F.coalesce("p", "root").alias("root")), name)
        a, b = hook.select(F.col("id").alias("a"), F.col("p").alias("x")), hook.select(F.col("id").alias("b"), F.col("p").alias("y"))
        joined = left.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = written(joined.where("a < b").distinct(), name)
    return found if found is not None else left.select(F.col("a").alias("id"), F.col("b").alias("root"))


def directed(edges: DataFrame) -> DataFrame:
    """Topology facts as edges that point downstream: ``feeds`` as said, any other predicate reversed."""
    forward = F.col("predicate") == "feeds"
    return edges.select(
        F.when(forward, F.col("subject")).otherwise(F.col("object_text")).alias("a"),
        F.when(forward, F.col("object_text")).otherwise(F.col("subject")).alias("b"), "subject", "predicate", "seq",
    )


def downstream(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Every entity within ``depth`` steps of a root, once per root, with the first edge that reached it.

    One join per step: first means by the parent's place in the step before, then by subject, predicate, seq.
    Places are compared as (parent's key path), so that no step needs a global order.
    """
    key = F.struct("subject", "predicate", "seq")
    seen = roots.select(F.col("root"), F.col("root").alias("id"), F.lit(0).alias("d"), F.array().cast("array<struct<subject:string,predicate:string,seq:bigint>>").alias("path"))
    front = seen
    for d in range(1, depth + 1):
        step = edges.join(front.select("root", F.col("id").alias("a"), "path"), "a").select("root", F.col("b").alias("id"), F.concat("path", F.array(key)).alias("path"))
        front = written(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").groupBy("root", "id").agg(F.min("path").alias("path")).select("root", "id", F.lit(d).alias("d"), "path"), "downstream")
        seen = seen.unionByName(front)
    return seen.where("d > 0")


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("subject", "object_text")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge per (subject, object, predicate): the first of the log."""
    w = W.partitionBy("subject", "object_text", "predicate").orderBy("seq")
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def several_parents(frames: DataFrame) -> DataFrame:
    """Children of ``frames(child, parent)`` that have more than one parent."""
    return frames.groupBy("child").agg(F.count_distinct("parent").alias("n_parents")).where("n_parents > 1")


def loops(frames: DataFrame) -> DataFrame:
    """Frames on a loop of ``frames(child, parent)``, or on a way from one loop to another.

    Each round drops edges that lead nowhere further and edges that nothing leads to, so a tree of depth d takes about d / 2 rounds.
    """
    left = written(frames.select("child", "parent").distinct(), "loops")
    n = left.count()
    while n:
        down = left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        both = written(down.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("child", "parent"), "loops")
        # A frame that is its own parent leads to itself, so it stays.
        was, n, left = n, both.count(), both
        if n == was:
            break
    return left.select(F.explode(F.array("child", "parent")).alias("frame")).distinct()
