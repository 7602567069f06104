"""Configuration files, GeoJSON and robot descriptions as tables. A file that can't be read gives one row with what is wrong with it."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import leaves


def listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", "content")


def each_file(files: DataFrame, parse: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """``parse`` over the files, one at a time."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame(list(parse(path, bytes(content))), columns=names, dtype=object)

    return files.mapInPandas(run, schema)


def documents_of(text: str) -> tuple[str, list[Any]]:
    """The format that the text is in and its documents: JSON, then TOML, then YAML, which needs the yaml library."""
    try:
        return "json", [json.loads(text)]
    except ValueError:
        pass
    try:
        return "toml", [tomllib.loads(text)]
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ValueError("neither JSON nor TOML, and there is no YAML library") from e
    try:
        # Scalars stay as they are written; the loader resolves nothing and builds no objects.
        if any(isinstance(t, yaml.AliasToken) for t in yaml.scan(text, Loader=yaml.SafeLoader)):
            raise ValueError("aliases are not followed")
        return "yaml", list(yaml.load_all(text, Loader=yaml.BaseLoader))
    except yaml.YAMLError as e:
        raise ValueError(f"neither JSON, TOML nor YAML: {str(e).splitlines()[0]}") from e


CONFIG = "path string, format string, document int, pointer string, value string, problem string"


def configuration(spark: SparkSession, path: str, glob: str = "*.{json,toml,yaml,yml}") -> DataFrame:
    """Every leaf of every document of configuration files: its JSON pointer and its text. YAML keeps the text as written."""

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        try:
            kind, found = documents_of(content.decode("utf-8-sig"))
            rows = [(name, kind, k, at, value, None) for k, one in enumerate(found) for at, value in leaves(json.loads(json.dumps(one, default=str)))]
        except (ValueError, RecursionError) as e:
            rows = [(name, None, None, None, None, str(e) or "nested too deeply")]
        yield from rows

    return each_file(listed(spark, path, glob), parse, CONFIG)


def positions(at: Any) -> Iterator[list]:
    """Positions of a geometry's coordinates, however deep."""
    if isinstance(at, list) and at and isinstance(at[0], (int, float)):
        yield at
    elif isinstance(at, list):
        for inner in at:
            yield from positions(inner)


def rings(geometry: dict) -> list[list]:
    kind, at = geometry.get("type"), geometry.get("coordinates")
    return list(at or []) if kind == "Polygon" else [r for p in at or [] for r in p] if kind == "MultiPolygon" else []


def area2(ring: list) -> float:
    """Twice the signed area; above zero if the ring turns to the left."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))


def crs_of(root: dict) -> str | None:
    """The reference system as the file names it; the format's default if it names none; null if it can't be read."""
    if "crs" not in root:
        return "OGC:CRS84"
    named = root["crs"]
    stated = named.get("properties", {}).get("name") if isinstance(named, dict) and named.get("type") == "name" and isinstance(named.get("properties"), dict) else None
    return stated if isinstance(stated, str) else None


FEATURES = (
    "path string, feature int, id string, site_id string, asset_id string, geometry string, n_positions int, min_x double, min_y double, max_x double, max_y double, crs string, properties string, problem string"
)


def features(spark: SparkSession, path: str, glob: str = "*.{geojson,json}") -> DataFrame:
    """Features of GeoJSON files, with plain bounds; coordinates are checked and never changed.

    Problems: rings that aren't closed, outer rings that turn right, positions outside longitude and latitude under the default reference system,
    which then counts as unknown. ``properties`` is JSON for ``files.json_leaves``.
    """

    def parts(geometry: Any) -> Iterator[dict]:
        if isinstance(geometry, dict):
            yield geometry
            for inner in geometry.get("geometries") or []:
                yield from parts(inner)

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        nothing = (None,) * 12
        try:
            root = json.loads(content.decode("utf-8-sig"))
            if not isinstance(root, dict) or not isinstance(root.get("type"), str):
                raise ValueError("no GeoJSON object")
            found = root.get("features") if root["type"] == "FeatureCollection" else [root] if root["type"] == "Feature" else [{"geometry": root}]
            crs, rows = crs_of(root), []
            for k, one in enumerate(found if isinstance(found, list) else []):
                if not isinstance(one, dict):
                    rows.append((name, k, *nothing[1:], "no feature"))
                    continue
                shapes = list(parts(one.get("geometry")))
                at = [p for s in shapes for p in positions(s.get("coordinates")) if len(p) >= 2]
                bad = []
                for s in shapes:
                    for i, ring in enumerate(rings(s)):
                        if len(ring) < 4 or ring[0] != ring[-1]:
                            bad.append("ring not closed")
                        elif s.get("type") == "Polygon" and (area2(ring) < 0) == (i == 0) and area2(ring) != 0:
                            bad.append("ring winds the wrong way")
                outside = crs == "OGC:CRS84" and any(abs(p[0]) > 180 or abs(p[1]) > 90 for p in at)
                props = one.get("properties") if isinstance(one.get("properties"), dict) else {}
                text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
                bounds = [float(f(p[i] for p in at)) for f, i in ((min, 0), (min, 1), (max, 0), (max, 1))] if at else [None] * 4
                problem = "; ".join(dict.fromkeys(bad + ["outside longitude and latitude"] * outside)) or None
                shape = shapes[0].get("type") if shapes else None
                rows.append((name, k, text(one.get("id")), text(props.get("site_id")), text(props.get("asset_id")), shape, len(at), *bounds, None if outside else crs, json.dumps(props), problem))
        except (ValueError, TypeError, RecursionError) as e:
            rows = [(name, *nothing, str(e) or "nested too deeply")]
        yield from rows

    return each_file(listed(spark, path, glob), parse, FEATURES)


ROBOT = "path string, robot string, kind string, name string, type string, parent string, child string, xyz string, rpy string, lower double, upper double, problem string"


def descriptions(spark: SparkSession, path: str, glob: str = "*.urdf") -> DataFrame:
    """Links and joints of robot descriptions. Joints are edges of frames, ``child`` to ``parent``, for the rules on frames. Macros are not expanded."""

    def number(text: str | None) -> float | None:
        try:
            return None if text is None else float(text)
        except ValueError:
            return None

    def parse(name: str, content: bytes) -> Iterator[tuple]:
        try:
            if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
                raise ValueError("entities are not expanded")
            root = ElementTree.fromstring(content)
            if root.tag != "robot":
                raise ValueError("no robot")
            links, rows = {x.get("name") for x in root.findall("link")}, []
            for x in root.findall("link"):
                rows.append((name, root.get("name"), "link", x.get("name"), None, None, None, None, None, None, None, None))
            for x in root.findall("joint"):
                ends = [None if (e := x.find(tag)) is None else e.get("link") for tag in ("parent", "child")]
                origin, limit = x.find("origin"), x.find("limit")
                place = [None if origin is None else origin.get(a) for a in ("xyz", "rpy")]
                limits = [None if limit is None else number(limit.get(a)) for a in ("lower", "upper")]
                missing = [str(e) for e in ends if e not in links]
                rows.append((name, root.get("name"), "joint", x.get("name"), x.get("type"), *ends, *place, *limits, f"no link {', '.join(missing)}" if missing else None))
        except (ValueError, ElementTree.ParseError) as e:
            rows = [(name, *(None,) * 10, str(e))]
        yield from rows

    return each_file(listed(spark, path, glob), parse, ROBOT)


def frames(described: DataFrame) -> DataFrame:
    """Edges of the frames of ``descriptions``, named by their file."""
    named = lambda c: F.concat_ws("#", "path", c)
    return described.where("kind = 'joint' AND parent IS NOT NULL AND child IS NOT NULL").select(named("child").alias("child"), named("parent").alias("parent"))
