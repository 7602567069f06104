"""Files as tables: delimited text, JSON leaves, spreadsheets, text and Markdown blocks, footers, signatures."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of formats, as hexadecimal digits from the given offset. Fixed values.
SIGNATURES = (
    ("parquet", 0, "50415231"), ("zip", 0, "504B0304"), ("gzip", 0, "1F8B"), ("pdf", 0, "255044462D"), ("png", 0, "89504E470D0A1A0A"),
    ("jpeg", 0, "FFD8FF"), ("mcap", 0, "894D434150300D0A"), ("rosbag1", 0, "23524F53424147"), ("ulog", 0, "554C6F67011235"), ("sqlite", 0, "53514C69746520666F726D6174203300"), ("tar", 257, "7573746172"),
)


def sniff_delimiter(sample: str) -> str:
    """The delimiter that splits the first lines into most columns, the same number in each; a comma if none does."""
    lines = [x for x in sample.splitlines() if x][:20]
    scored = []
    for d in (",", "\t", ";"):
        counts = [len(re.sub(r'"[^"]*"', "", x).split(d)) for x in lines]
        scored.append((min(counts, default=0) if len(set(counts)) == 1 else 0, d))
    best = max(scored, key=lambda x: x[0])
    return best[1] if best[0] > 1 else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Cells as text, blank ones null; the header gives the names."""
    if delimiter is None:
        delimiter = sniff_delimiter("\n".join(r[0] for r in spark.read.text(path).limit(20).collect()))
    return spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def leaves(value: Any, at: str = "") -> Iterator[tuple[str, str | None]]:
    """JSON pointers of all leaves and their text."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, f"{at}/" + k.replace("~", "~0").replace("/", "~1"))
    elif isinstance(value, list) and value:
        for k, v in enumerate(value):
            yield from leaves(v, f"{at}/{k}")
    else:
        yield at, None if value is None else value if isinstance(value, str) else json.dumps(value)


def json_leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, pointer, value of every leaf of a JSON column; text that isn't JSON gives none."""

    @F.pandas_udf("array<struct<pointer:string,value:string>>")
    def split(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append([{"pointer": p, "value": v} for p, v in leaves(json.loads(t))])
            except (TypeError, ValueError):
                out.append([])
        return pd.Series(out)

    return df.select(key, F.inline(split(column)))


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(sheet, row, cells by column letters) of a workbook, with the values it has cached."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            target = targets[sheet.get(link)].lstrip("/")
            tree = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in tree.iter(f"{main}row"):
                cells = {}
                for c in row.iter(f"{main}c"):
                    v = c.find(f"{main}v")
                    text = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    if text is not None:
                        cells[re.match(r"[A-Z]+", c.get("r", "A"))[0]] = shared[int(text)] if c.get("t") == "s" else text
                yield sheet.get("name", ""), int(row.get("r", 0)), cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells of every workbook under a path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(p, *r) for r in sheet_rows(content)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row int, cells map<string,string>")


def text_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """Paragraphs: runs of lines between blank ones, in order."""
    blocks = F.filter(F.transform(F.split(column, r"\n[ \t]*(?:\n[ \t]*)+"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(key, F.posexplode(blocks).alias("position", "block"))


def markdown_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """Blocks with their role: heading, list, quote, code, table, rule or paragraph."""
    b = F.col("block")
    role = (
        F.when(b.rlike(r"^#{1,6}\s"), "heading").when(b.rlike(r"^(```|~~~)"), "code").when(b.rlike(r"^>"), "quote").when(b.rlike(r"^([-*+]|\d+[.)])\s"), "list")
        .when(b.rlike(r"(?m)^\|?[ :|-]*-{3,}[ :|-]*$") & F.contains(b, F.lit("|")), "table").when(b.rlike(r"^([-*_]\s*){3,}$"), "rule").otherwise("paragraph")
    )
    return text_blocks(df, key, column).withColumn("role", role)


def sniffed(files: DataFrame) -> DataFrame:
    """``path, format`` of a binary listing: the longest signature that fits."""
    fits = [F.struct(F.lit(len(h)).alias("n"), F.lit(name).alias("format"), (F.hex(F.substring("content", at + 1, len(h) // 2)) == h).alias("ok")) for name, at, h in SIGNATURES]
    found = F.filter(F.array(*fits), lambda x: x["ok"])
    return files.select("path", F.array_max(found)["format"].alias("format"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """Row groups of Parquet files, from their footers."""
    import pyarrow.parquet as pq

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                meta = pq.read_metadata(io.BytesIO(content))
                yield pd.DataFrame([(p, g, meta.row_group(g).num_rows, meta.row_group(g).num_columns) for g in range(meta.num_row_groups)], columns=["path", "row_group", "rows", "columns"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row_group int, rows long, columns int")
