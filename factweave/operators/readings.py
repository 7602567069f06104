"""What a decoded message says of a thing: health, tasks, references and plain values."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that say nothing is there. Fixed values of the formats.
NONE = ("", "0", "0.0", "false", "null", "[]")
READING = "array<struct<subject:string,predicate:string,object_is_ref:boolean,object_text:string,unit:string>>"


@dataclass(frozen=True)
class Field:
    """What a field of a message means. ``subject``: instead of the feed's; ``state``: the payload's path to the state of a task."""

    predicate: str
    subject: str | None = None
    ref: str | None = None
    unit: str | None = None
    state: str | None = None


def rendered(template: str) -> Column:
    """A feed's template over ``source``, ``topic``, ``topic[N]`` (from the end if negative) and ``payload.a.b``; null if a part is missing."""

    def value(name: str) -> Column:
        part = re.fullmatch(r"topic\[(-?\d+)\]", name)
        if part:
            n = int(part[1])
            return F.try_element_at(F.split(F.rtrim("topic", F.lit("/")), "/"), F.lit(n + 1 if n >= 0 else n))
        return F.get_json_object("payload", "$." + name.removeprefix("payload.")) if name.startswith("payload.") else F.col(name)

    parts = re.findall(r"([^{}]+)|\{([^{}]+)\}", template)
    return F.concat(*[F.lit(text) if text else value(name) for text, name in parts])


def fault_code(value: Column) -> Column:
    """The code of a fault: the text, or the first ``errorType`` of a list; the empty text for none."""
    listed = F.try_element_at(F.from_json(value, "array<struct<errorType:string>>"), F.lit(1))
    is_list = F.startswith(F.ltrim(value), F.lit("["))
    none = F.coalesce(F.lower(F.trim(value)).isin(*NONE), F.lit(True))
    return F.when(none, "").when(is_list, F.when(listed.isNull(), "").otherwise(F.coalesce(listed["errorType"], F.lit("error")))).otherwise(value)


def readings(pairs: DataFrame, subject: str, fields: Mapping[str, Field]) -> DataFrame:
    """Readings of ``pairs(t, source, topic, payload, name, value[, unit])``: one pass, and one row or up to three for each pair.

    Names that no field maps give none, as do subjects that can't be rendered. A value without text gives none, but an empty health is ``ok``
    and an empty task is ``none``.
    """
    sent = F.col("unit") if "unit" in pairs.columns else F.lit(None)
    out = None
    for name, spec in fields.items():
        who, value = rendered(spec.subject or subject), F.col("value")

        def row(s: Column, predicate: str, is_ref: bool, text: Column, unit: Column | None = None) -> Column:
            return F.struct(
                s.alias("subject"), F.lit(predicate).alias("predicate"), F.lit(is_ref).alias("object_is_ref"), text.alias("object_text"),
                (F.lit(None) if unit is None else unit).cast("string").alias("unit"),
            )

        if spec.predicate == "health":
            code = fault_code(value)
            made = F.array(row(who, "health", False, F.when(code == "", "ok").otherwise(F.concat(F.lit("fault:"), code))))
        elif spec.predicate == "current_task":
            task = F.concat(F.lit("task:"), value)
            state = F.get_json_object("payload", f"$.{spec.state}") if spec.state else F.lit(None).cast("string")
            all_three = F.array(row(who, "current_task", True, task), row(task, "assigned_to", True, who), row(task, "task_state", False, F.nullif(state, F.lit(""))))
            none = F.coalesce(F.lower(F.trim(value)).isin(*NONE), F.lit(True))
            made = F.when(none, F.array(row(who, "current_task", False, F.lit("none")))).otherwise(all_three)
        elif spec.ref:
            prefix = F.lit(f"{spec.ref}:")
            made = F.array(row(who, spec.predicate, True, F.when(F.startswith(value, prefix), value).otherwise(F.concat(prefix, value))))
        else:
            made = F.array(row(who, spec.predicate, False, value, F.lit(spec.unit) if spec.unit else sent))
        made = made.cast(READING)
        out = F.when(F.col("name") == name, made) if out is None else out.when(F.col("name") == name, made)
    return pairs.select("t", "source", F.inline(out)).where("subject IS NOT NULL AND object_text IS NOT NULL")


def device_reports(messages: DataFrame, subject: str) -> DataFrame:
    """Reports ``(source, t)`` of sources, and of the devices that a feed's subject names by message, as ``source/device``."""
    plain = messages.select("source", "t")
    if "{" not in subject:
        return plain
    who = rendered(subject)
    device = F.when(F.contains(who, F.lit(":")), F.regexp_replace(who, "^[^:]*:", "")).otherwise(who)
    both = F.filter(F.array(F.col("source"), F.concat_ws("/", "source", F.when(device.isNotNull(), device))), lambda x: x.isNotNull())
    return messages.select(F.explode(F.array_distinct(both)).alias("source"), "t")
