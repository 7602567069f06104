"""Configuration, GeoJSON and robot descriptions as files, and timers on streams of files."""

import json

from factweave.operators import graph
from factweave.sources import files, structured
from factweave.streaming import timers


def test_configuration(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":[1,{"b/c":null}],"d":"x"}')
    (tmp_path / "b.toml").write_text('[x]\nday = 2024-01-02\nn = 1.50\n')
    (tmp_path / "c.yaml").write_text("on: yes\nlist:\n  - 007\n---\n- z\n")
    (tmp_path / "d.yaml").write_text("a: &x 1\nb: *x\n")
    (tmp_path / "e.yml").write_text("a: [1\n")
    (tmp_path / "f.json").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "g.json").write_text("[" * 5000 + "]" * 5000)
    got = {}
    for r in structured.configuration(spark, str(tmp_path)).collect():
        got.setdefault(r.path[-6:], []).append((r.format, r.document, r.pointer, r.value) if r.problem is None else r.problem)
    assert got["a.json"] == [("json", 0, "/a/0", "1"), ("json", 0, "/a/1/b~1c", None), ("json", 0, "/d", "x")]
    assert got["b.toml"] == [("toml", 0, "/x/day", "2024-01-02"), ("toml", 0, "/x/n", "1.5")]
    assert got["c.yaml"] == [("yaml", 0, "/on", "yes"), ("yaml", 0, "/list/0", "007"), ("yaml", 1, "/0", "z")]
    assert got["d.yaml"] == ["aliases are not followed"] and all(isinstance(got[k][0], str) and len(got[k]) == 1 for k in ("/e.yml", "f.json", "g.json"))


def test_features(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    shapes = [
        {"type": "Feature", "id": 7, "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"site_id": "s1", "deep": {"k": [1, 2]}}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring[::-1]]}, "properties": None},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring[:3]]}}, {"type": "Feature", "geometry": None}, 5,
        {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [500, 1]}, {"type": "Point", "coordinates": [1, 2, 3]}]}},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": shapes}))
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "Point", "coordinates": [500, 1], "crs": {"type": "name", "properties": {"name": "EPSG:32632"}}}))
    (tmp_path / "c.geojson").write_text('{"type": "Feature", ')
    rows = structured.features(spark, str(tmp_path))
    got = {(r.path[-9], r.feature): r for r in rows.collect()}
    first = got["a", 0]
    assert (first.id, first.site_id, first.geometry, first.n_positions, first.min_x, first.max_x, first.max_y, first.crs, first.problem) == ("7", "s1", "Polygon", 4, 0.0, 2.0, 1.0, "OGC:CRS84", None)
    assert got["a", 1].problem == "ring winds the wrong way" and got["a", 2].problem == "ring not closed" and got["a", 3].n_positions == 0 and got["a", 4].problem == "no feature"
    assert (got["a", 5].max_x, got["a", 5].crs, got["a", 5].problem) == (500.0, None, "outside longitude and latitude")
    assert (got["b", 0].crs, got["b", 0].problem) == ("EPSG:32632", None) and got["c", None].problem
    leaves = files.json_leaves(rows.where("feature = 0 AND path LIKE '%a.geojson'"), "feature", "properties").collect()
    assert [(r.pointer, r.value) for r in leaves] == [("/site_id", "s1"), ("/deep/k/0", "1"), ("/deep/k/1", "2")]


def test_descriptions(spark, tmp_path):
    joint = '<joint name="{0}{1}" type="revolute"><parent link="{0}"/><child link="{1}"/><origin xyz="0 0 1"/><limit lower="-1.5" upper="x"/></joint>'.format
    links = "".join(f'<link name="{x}"/>' for x in "abc")
    (tmp_path / "r.urdf").write_text(f'<robot name="arm">{links}{joint("a", "b")}{joint("b", "c")}{joint("c", "b")}{joint("c", "z")}</robot>')
    (tmp_path / "s.urdf").write_text("<robot")
    (tmp_path / "t.urdf").write_text('<!DOCTYPE x [<!ENTITY e "1">]><robot/>')
    got = structured.descriptions(spark, str(tmp_path))
    rows = {(r.path[-6], r.name): r for r in got.collect()}
    assert (rows["r", "ab"].type, rows["r", "ab"].xyz, rows["r", "ab"].lower, rows["r", "ab"].upper, rows["r", "ab"].problem) == ("revolute", "0 0 1", -1.5, None, None)
    assert rows["r", "cz"].problem == "no link z" and rows["s", None].problem and rows["t", None].problem == "entities are not expanded"
    edges = structured.frames(got)
    assert [r.child[-2:] for r in graph.several_parents(edges).collect()] == ["#b"] and sorted(r.frame[-2:] for r in graph.loops(edges).collect()) == ["#b", "#c"]


def run(spark, tmp_path, batches, schema, apply, out="out"):
    """One micro-batch a file; files are dated, since a stream takes the oldest first."""
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(batches):
        path = folder / f"{k}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (1700000000 + k, 1700000000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    to = str(tmp_path / out)
    apply(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", to).trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(str(v) for v in r) for r in spark.read.parquet(to).collect()))


def at(minute, second=0):
    return f"2024-01-01T00:{minute:02d}:{second:02d}"


def test_silent_sources(spark, tmp_path):
    said = lambda s, t, pace=60: {"source": s, "t": t, "interval_seconds": pace}
    batches = [[said("a", at(0)), said("b", at(0)), said("n", at(0), None), said("g", at(0))], [said("b", at(2)), said("g", at(4))], [said("b", at(10))], [said("b", at(11))]]
    got = run(spark, tmp_path, batches, "source string, t timestamp, interval_seconds long", timers.silent)
    assert [(s, a[11:], b[11:]) for s, a, b in got] == [("a", "00:00:00", "00:03:00"), ("b", "00:02:00", "00:05:00"), ("g", "00:00:00", "00:03:00"), ("g", "00:04:00", "00:07:00")]


def test_outcomes(spark, tmp_path):
    act = lambda s, t, a, v: {"subject": s, "t": t, "action": a, "predicate": "mode", "value": v}
    batches = [
        [act("r1", at(0), "a1", "paused"), act("r2", at(0), "a2", "paused"), act("r3", at(0, 5), None, "paused"), act("r3", at(0), "a3", "paused")], [act("r1", at(1), None, "paused"), act("r2", at(1), None, "auto")],
        [act("r2", at(3), None, "paused")], [act("r9", at(9), None, "x")], [act("r9", at(9), None, "x")],
    ]
    got = run(spark, tmp_path, batches, "subject string, t timestamp, action string, predicate string, value string", timers.outcomes)
    assert [(s, a, o, t[11:]) for s, a, o, t in got] == [("r1", "a1", "done", "00:01:00"), ("r2", "a2", "no effect", "00:02:00"), ("r3", "a3", "done", "00:00:05")]


def test_record_and_read_again(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a.json").write_text("".join(json.dumps({"t": str(k), "source": "s", "topic": "x", "payload": "{}"}) + "\n" for k in (3, 1, 2)) + "{\n")
    timers.record(timers.replay(spark, str(folder)).where("t IS NOT NULL"), str(tmp_path / "kept"), str(tmp_path / "cp2")).awaitTermination()
    got = timers.captured(spark, str(tmp_path / "kept")).orderBy("file", "at", "n").collect()
    assert [r.t for r in got] == ["3", "1", "2"]
