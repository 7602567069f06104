"""Rules over records that belong together: sources, tables, frames, calibrations, software, bindings.

Each takes tables and gives rows that break the rule. Unknown (null) values are never compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tasks that bindings are dealt to; fewer, which Spark would choose by compressed bytes, held too many rows each.
TASKS = 96


def incomplete_sources(findings: DataFrame, records: DataFrame, category: str = "corrupt") -> DataFrame:
    """Counts per code, in order of the codes, of the sources with findings of a category that some record cites."""
    counts = findings.where(F.col("category") == category).groupBy("source", "code").agg(F.count("*").alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat_ws(":", x["code"], x["n"].cast("string"))), ", ")
    return counts.join(records.select("source"), "source", "left_semi").groupBy("source").agg(told.alias("codes"))


def schema_conflicts(streams: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields of which the streams of one key state several known values."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    known = streams.select(*keys, cells.alias("c")).where("c.value IS NOT NULL")
    return known.groupBy(*keys, F.col("c.field").alias("field")).agg(F.count_distinct("c.value").alias("n_values")).where("n_values > 1")


def row_shapes(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Per ``tables(table, width)``, how many of ``rows(table, row, id, cells)`` have another width, and the first of them."""
    wrong = rows.join(tables.where(F.col("width").isNotNull()), "table").where(F.col("cells") != F.col("width"))
    first = F.min(F.struct("row", "id"))
    return wrong.groupBy("table").agg(F.count("*").alias("n"), first["row"].alias("first_row"), first["id"].alias("first_id"))


def unresolved_frames(uses: DataFrame, graphs: DataFrame) -> DataFrame:
    """Frames of ``uses(graph, frame, id, declares)`` whose graph is missing, or which nothing declares."""
    frames = uses.groupBy("graph", "frame").agg(F.max("declares").alias("declared"), F.count_distinct("id").alias("n"), F.min("id").alias("first_id"))
    held = frames.join(graphs.select("graph").distinct().withColumn("held", F.lit(True)), "graph", "left")
    reason = F.when(F.col("held").isNull(), "graph_missing").when(~F.col("declared"), "frame_undeclared")
    return held.select("graph", "frame", reason.alias("reason"), "n", "first_id").where("reason IS NOT NULL")


def revision_mismatches(stated: DataFrame, declared: DataFrame, owner: str, revision: str) -> DataFrame:
    """Rows whose revision their owner doesn't declare; owners that declare none are left out."""
    known = declared.where(F.col(revision).isNotNull())
    asked = stated.where(F.col(revision).isNotNull()).join(known.select(owner), owner, "left_semi")
    return asked.join(known.select(owner, revision), [owner, revision], "left_anti")


def software_conflicts(rows: DataFrame, name: str = "name", pairs: Sequence[tuple[str, str]] = (("release", "commit"), ("build", "digest"), ("commit", "build"))) -> DataFrame:
    """Names of software of which one value of a pair's first field stands with several of the second: one pass over the rows."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(f"{a}>{b}").alias("pair"), F.col(a).cast("string").alias("key"), F.col(b).cast("string").alias("value")) for a, b in pairs
    ]))
    known = rows.select(name, cells.alias("c")).where("c.key IS NOT NULL AND c.value IS NOT NULL")
    return known.groupBy(name, F.col("c.pair").alias("pair"), F.col("c.key").alias("key")).agg(F.count_distinct("c.value").alias("n_values")).where("n_values > 1")


def superseded(revisions: DataFrame) -> DataFrame:
    """Held revisions ``(record, document, revision, supersedes)`` that another held one of the document says it replaces, and by which.

    Revisions that replace one are counted and told once per document and replaced revision; records only look their text up. A record
    that is held several times has each newer revision as often.
    """
    newer = revisions.select("document", F.explode(F.array_distinct("supersedes")).alias("revision"), F.col("revision").alias("newer"))
    told = newer.groupBy("document", "revision", "newer").agg(F.count("newer").alias("n"))
    lists = told.groupBy("document", "revision").agg(F.array_sort(F.collect_list(F.struct("newer", "n"))).alias("newer"))
    held = revisions.groupBy("record", "document", "revision").agg(F.count("*").alias("times"))
    times = held.select("document", "revision", "times").distinct()
    text = F.array_join(F.flatten(F.transform("newer", lambda x: F.array_repeat(x["newer"], (x["n"] * F.col("times")).cast("int")))), ",")
    texts = lists.join(times, ["document", "revision"]).select("document", "revision", "times", text.alias("superseded_by"))
    return held.join(texts, ["document", "revision", "times"]).select("record", "document", "revision", "superseded_by")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Each different row with a number of its own, the same in every run: its place among those of its hash, in steps of 1,024."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(1024))
    return rows.distinct().withColumn(name, F.row_number().over(W.partitionBy(part).orderBy(*rows.columns)) * 1024 + part)


def run_software_conflicts(bindings: DataFrame, software: DataFrame, fields: Sequence[str] = ("commit", "release")) -> DataFrame:
    """Runs ``(run, configuration)`` bound to configurations that state different values for one software on one device.

    ``software(configuration, name, device, commit, release)``; a software without a name is left out, one without a device has the empty one.
    Names and values are replaced by numbers, so that no text goes with a run, and runs are dealt to ``TASKS`` tasks.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f).cast("string").alias("value")) for k, f in enumerate(fields)]))
    stated = software.where("name IS NOT NULL AND configuration IS NOT NULL").select("configuration", "name", F.coalesce("device", F.lit("")).alias("device"), cells.alias("c")).where("c.value IS NOT NULL")
    stated = stated.select("configuration", "name", "device", "c.*")
    who, told = numbered(stated.select("name", "device"), "who"), numbered(stated.select("field", "value"), "code")
    codes = stated.join(who, ["name", "device"]).join(told, ["field", "value"]).select("configuration", "who", "field", "code")
    bound = bindings.select("run", "configuration").repartition(TASKS, "configuration").join(codes.repartition(TASKS, "configuration"), "configuration")
    n = bound.select("run", "who", "field", "code").repartition(TASKS, "run").groupBy("run", "who", "field").agg(F.count_distinct("code").alias("n_values")).where("n_values > 1")
    field = F.element_at(F.array(*map(F.lit, fields)), F.col("field") + 1)
    return n.join(who, "who").select("run", "name", "device", field.alias("field"), "n_values")


def best_guess(guesses: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """The value with the best score per key; several best values are ambiguous, and none is given."""
    w = W.partitionBy(key).orderBy(F.col(score).desc())
    best = guesses.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.max(score).alias(score)).withColumn("__rank", F.rank().over(w)).where("__rank = 1")
    n = F.count("*")
    return best.groupBy(key).agg(F.when(n == 1, F.min(value)).alias(value), F.max(score).alias(score), F.when(n == 1, "known").otherwise("ambiguous").alias("state"))


def folders(path: Column) -> Column:
    """Every folder above a file, with its depth; the top one is the empty text at depth 0."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("folder")))


def nearest_bindings(runs: DataFrame, items: DataFrame) -> DataFrame:
    """For ``runs(run, unit, path)``, the item of ``items(item, unit, slot, path)`` of its unit that shares the deepest folder.

    One row per run and slot; items tied for nearest are a conflict. Folders are summed up before they are joined, so
    that a folder with many items costs a run one row.
    """
    inside = items.select("item", "unit", "slot", F.explode(folders(F.col("path"))).alias("f")).select("item", "unit", "slot", "f.*")
    summary = inside.groupBy("unit", "slot", "folder").agg(F.count_distinct("item").alias("n"), F.min("item").alias("item"))
    above = runs.select("run", "unit", F.explode(folders(F.col("path"))).alias("f")).select("run", "unit", "f.*")
    nearest = above.join(summary, ["unit", "folder"]).groupBy("run", "slot").agg(F.max_by(F.struct("n", "item"), "depth").alias("x"), F.max("depth").cast("long").alias("depth"))
    conflict = F.col("x.n") > 1
    return nearest.select("run", "slot", F.when(~conflict, F.col("x.item")).alias("item"), "depth", F.when(conflict, "conflict").otherwise("bound").alias("state"))


def noisy_or(evidence: DataFrame, key: str, weight: str, against: str, base: float = 0.0, floor: float = 0.01) -> DataFrame:
    """1 - (1 - base) * product of (1 - weight) over evidence for, times the product over evidence ``against``; four decimals.

    Rounded to twelve first, so that the order of the sums cannot show in a tie.
    """
    product = lambda chosen: F.exp(F.coalesce(F.sum(F.when(chosen & (F.col(weight) < 1), F.log(1 - F.col(weight)))), F.lit(0.0))) * F.when(
        F.max(F.when(chosen, F.col(weight))) >= 1, 0.0
    ).otherwise(1.0)
    total = (1 - (1 - base) * product(~F.col(against))) * product(F.col(against))
    return evidence.groupBy(key).agg((F.floor(F.round(F.greatest(total, F.lit(floor)), 12) * 10000 + 0.5) / 10000).alias("score"))
