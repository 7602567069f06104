"""Declarative mappings from tables and feeds to facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.template import compile_template


@dataclass(frozen=True)
class FactSpec:
    """One fact per row, or per item of a split cell. ``once``: only the first row that has the value."""

    subject: str
    predicate: str
    column: str
    ref: str | None = None
    unit: str | None = None
    split: str | None = None
    values: Mapping[str, str] | None = None
    once: bool = False


def map_table(rows: DataFrame, specs: Sequence[FactSpec], order: str, source: str, time: Column, types: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Unpivots rows into facts; blank cells make none."""
    made = []
    for spec in specs:
        data = rows
        if spec.once:
            w = W.partitionBy(F.lower(F.col(spec.column))).orderBy(order)
            data = data.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        cell = F.col(spec.column).cast("string")
        if spec.split:
            data = data.withColumn(spec.column, F.explode(F.split(cell, spec.split)))
        cell = F.nullif(F.trim(F.col(spec.column).cast("string")), F.lit(""))
        if spec.values:
            pairs = [x for kv in spec.values.items() for x in kv]
            cell = F.coalesce(F.element_at(F.create_map(*map(F.lit, pairs)), cell), cell)
        target = compile_template(spec.ref, types) if spec.ref else cell
        made.append(
            data.select(
                F.col(order).alias("row"), compile_template(spec.subject, types).alias("subject"), F.lit(spec.predicate).alias("predicate"),
                F.lit(bool(spec.ref)).alias("object_is_ref"), target.alias("object_text"), F.lit(spec.unit).alias("unit"), time.alias("valid_from"), F.lit(source).alias("source"),
            ).where("subject IS NOT NULL AND object_text IS NOT NULL")
        )
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def unmapped(rows: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Rows of which no mapped column has a value."""
    empty = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in columns]
    return rows.where(F.forall(F.array(*empty), lambda x: x)).select(order)


#: Paths of the fields of each decoder's payload. Fixed values of the formats.
LISTS = {"sparkplug": ("metrics", "name", "value"), "opcua": ("nodes", "name", "value"), "ros2_diagnostics": ("status", "name", "message")}


def decode(messages: DataFrame, decoder: str, fields: Mapping[str, str] | None = None) -> DataFrame:
    """name and value pairs of envelopes ``t, source, topic, payload`` (JSON text)."""
    if decoder in LISTS:
        items, name, value = LISTS[decoder]
        kind = f"array<struct<{name}:string,{value}:string>>"
        return messages.select("t", "source", "topic", F.explode(F.from_json(F.get_json_object("payload", f"$.{items}"), kind)).alias("x")).select(
            "t", "source", "topic", F.col(f"x.{name}").alias("name"), F.col(f"x.{value}").alias("value")
        )
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.get_json_object("payload", f"$.{p}").alias("value")) for n, p in (fields or {}).items()]))
    return messages.select("t", "source", "topic", pairs.alias("x")).select("t", "source", "topic", "x.name", "x.value").where("value IS NOT NULL")


def first_match(rows: DataFrame, column: str, rules: Sequence[tuple[str, str]]) -> Column:
    """The result of the first glob that fits."""
    import re

    out = F.lit(None).cast("string")
    for glob, result in reversed(rules):
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
        out = F.when(rows[column].rlike(f"^(?s:{pattern})$"), F.lit(result)).otherwise(out)
    return out
