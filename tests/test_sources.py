"""Files, log, site surface and streams."""

import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from factweave.operators import intervals, series
from factweave.plans.site import Site
from factweave.sources import files, log
from factweave.sources.tables import LOG
from factweave.streaming import fold


def fact(subject, predicate, value=None, ref=None, at=None, kind="observed", source="plc", quote=None):
    cite = [{"file": "f.csv", "locator": "row 1", "quote": quote}]
    return {"type": "fact", "fact": {"subject": subject, "predicate": predicate, "object": {"ref": ref, "value": value, "unit": None}, "valid_from": at, "valid_to": None, "kind": kind, "source": source, "citations": cite, "model": None}}


ENTRIES = [
    fact("machine:m1", "name", "Filler", kind="stated", source="csv", quote="Filler line one"), fact("machine:m1", "mode", "run", at="2024-01-01T10:00:00"), fact("machine:m1", "mode", "stop", at="2024-01-01T11:00:00"),
    fact("machine:m1", "mode", "stop", at="2024-01-01T11:00:00"), fact("machine:m1", "feeds", ref="machine:m2", kind="stated"), fact("machine:m2", "mode", "idle", at="2024-01-01T11:01:00", source="fleet"),
    fact("machine:m1", "same_as", ref="asset:9", kind="stated"), {"type": "seen", "seen": {"source": "plc", "t": "2024-01-01T11:02:00"}}, {"type": "seen", "seen": {"source": "fleet", "t": "2024-01-01T10:00:00"}},
]


def entries(spark, rows):
    text = [json.dumps({"k": k} | r) for k, r in enumerate(rows)]
    return spark.createDataFrame([(t,) for t in text], "t string").select(F.from_json("t", "k int, " + LOG).alias("x")).select("x.*")


def test_log_appends_dense_numbers_and_travels_in_time(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = entries(spark, ENTRIES)
    assert log.append(rows.where("k < 5"), path, ["k"]) == 4
    assert log.append(rows.where("k >= 5"), path, ["k"]) == 8
    assert [r["seq"] for r in log.read_log(spark, path).orderBy("seq").collect()] == list(range(9))
    assert log.read_log(spark, path, 3).count() == 4 and log.tail(spark, path, 6).count() == 2
    site = Site(spark, path)
    assert site.clock() == "2024-01-01T11:02:00"
    said = {(r[0], r[1]): (r[3], r[7], r[-1]) for r in site.status().rows}  # no source states a pace, so none is stale
    assert said == {("machine:m1", "mode"): ("stop", 2, "known"), ("machine:m2", "mode"): ("idle", 5, "known"), ("machine:m1", "health"): (None, None, "unknown"), ("machine:m2", "health"): (None, None, "unknown")}
    assert site.group("asset:9") == ["asset:9", "machine:m1"] or sorted(site.group("asset:9")) == ["asset:9", "machine:m1"]
    assert any(r[3] == "stop" for r in site.state_at("asset:9").rows)
    assert [r[1] for r in site.impact("machine:m1").rows] == ["machine:m2"]
    assert [r[3] for r in site.search("filler line").rows] == ["Filler"]
    assert [r[:2] for r in site.why("machine:m1", "mode").rows] == [("2024-01-01T10:00:00", "run"), ("2024-01-01T11:00:00", "stop")]
    assert site.resolve("filler").rows[0][0] == "machine:m1" and site.gaps().rows and site.diff("2024-01-01T10:30:00", "2024-01-01T12:00:00").rows
    assert len(Site(spark, path, as_of=1).changes(-1).rows) == 2
    assert site.timeline("machine:m1", "2024-01-01T10:00:00", "2024-01-01T10:59:00", ["mode"]).rows[0][3] == "run"
    assert site.sql("SELECT count(*) AS n FROM facts").rows == [(6,)]
    assert site.sql("DROP VIEW facts").gaps and site.sql("SELEC 1").gaps and site.sql("SELECT id FROM entities ORDER BY id").rows[0] == ("asset:9",)
    assert "machine:m1" in site.status().render()


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>Fil</t></r><r><t>ler</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>4.5</v></c><c r="D3"/></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('id\tnote\n1\t"x, ""y"""\n2\t\n')
    got = files.read_delimited(spark, str(tmp_path / "a.tsv")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", 'x, "y"'), ("2", None)]
    assert files.sniff_delimiter("a;b\n1;2\n") == ";" and files.sniff_delimiter("a\n") == ","
    (tmp_path / "b.xlsx").write_bytes(workbook())
    assert [(r["sheet"], r["row"], dict(r["cells"])) for r in files.read_workbooks(spark, str(tmp_path)).orderBy("row").collect()] == [("S", 1, {"A": "Name"}), ("S", 3, {"A": "Filler", "C": "4.5"})]
    df = spark.createDataFrame([(1, '{"a":{"b/c":[1,null]},"d":"x"}'), (2, "bad")], "k int, j string")
    assert sorted((r["pointer"], r["value"]) for r in files.json_leaves(df, "k", "j").collect()) == [("/a/b~1c/0", "1"), ("/a/b~1c/1", None), ("/d", "x")]
    text = spark.createDataFrame([(1, "# Title\n\nOne\ntwo\n \n- item\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")], "k int, t string")
    assert [(r["role"], r["position"]) for r in files.markdown_blocks(text, "k", "t").orderBy("position").collect()] == [("heading", 0), ("paragraph", 1), ("list", 2), ("table", 3)]
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    listed = {r["path"].rsplit(".", 1)[-1]: r["format"] for r in files.sniffed(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))).collect()}
    assert listed["xlsx"] == "zip" and listed["parquet"] == "parquet" and listed["tsv"] is None
    assert files.row_groups(spark, str(tmp_path / "p") + "/*.parquet").agg(F.sum("rows")).first()[0] == 10
    assert files.listing(spark, str(tmp_path)).where("length(sha256) = 64").count() >= 3


def test_series_are_sorted_and_prunable(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 0), ("a", 5, 1), ("b", 1, 2), ("a", 2, 3)], "stream string, `time/0` long, seq long")
    assert [r["seq"] for r in series.in_order(rows.where("stream = 'a'"), "`time/0`").collect()] == [3, 1, 0]
    series.write_series(rows, str(tmp_path / "s"), "stream", "`time/0`", 2)
    assert spark.read.parquet(str(tmp_path / "s")).where("stream = 'a' AND `time/0` > 3").count() == 1


def test_streamed_changes_equal_the_batch(spark, tmp_path):
    rows = [(k, f"r{k % 3}", "mode", "s", "ab"[(k * 7 // 5) % 2]) for k in range(60)]
    schema = "seq long, subject string, predicate string, source string, object_text string"
    feed = tmp_path / "feed"
    feed.mkdir()
    for part in range(3):
        (feed / f"{part}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "subject", "predicate", "source", "object_text"), r, strict=True))) for r in rows[part * 20 : part * 20 + 20]))
        os.utime(feed / f"{part}.json", (1_700_000_000 + part, 1_700_000_000 + part))  # files arrive in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(feed))
    query = fold.changes(stream).writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = intervals.change_only(spark.createDataFrame(rows, schema), ["subject", "predicate", "source"], ["seq"], "object_text")
    assert sorted(r["seq"] for r in spark.table("changes").collect()) == sorted(r["seq"] for r in batch.collect())
    done = fold.fold(spark.readStream.schema(schema).json(str(feed)), str(tmp_path / "out"), lambda b: b.where("object_text = 'a'"), str(tmp_path / "c2"))
    done.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == sum(r[4] == "a" for r in rows)
