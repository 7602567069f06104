"""Templates of the mapping language: ``{column|filter|filter:argument}`` compiled to one column expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import slug


def _type_of(rules: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
    """The type of the first rule whose word the text contains."""

    def of(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for word, kind in reversed(rules):
            out = F.when(F.contains(F.lower(c), F.lit(word.lower())), F.lit(kind)).otherwise(out)
        return out

    return of


def compile_template(template: str, types: Sequence[tuple[str, str]] = (), tags: Mapping[str, str] | None = None) -> Column:
    """A column; null if any column that the template names is null or blank."""

    def step(c: Column, name: str, argument: str) -> Column:
        match name:
            case "lower":
                return F.lower(c)
            case "slug":
                return slug(c)
            case "until":
                return F.substring_index(c, argument, 1)
            case "strip":
                return F.regexp_replace(c, f"^{re.escape(argument)}", "")
            case "dash":
                return F.replace(c, F.lit(" "), F.lit("-"))
            case "type":
                return _type_of(types)(c)
            case "tag":
                pairs = [x for kv in (tags or {}).items() for x in kv]
                return F.coalesce(F.element_at(F.create_map(*map(F.lit, pairs)), F.lower(c)), c) if pairs else c
            case _:
                raise ValueError(f"unknown filter {name}")

    parts: list[Column] = []
    for text, field in re.findall(r"([^{}]+)|\{([^{}]+)\}", template):
        if text:
            parts.append(F.lit(text))
            continue
        column, *filters = field.split("|")
        value = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
        for f in filters:
            name, _, argument = f.partition(":")
            value = step(value, name, argument)
        parts.append(value)
    return F.concat(*parts)
