"""Questions to a site over a log written by hand."""

import pytest

from factweave.plans.site import ACTIONS, Site
from factweave.sources.tables import LOG

DAY = "2024-03-04T"


def cite(quote):
    return [{"file": "f.csv", "locator": "row 1", "quote": quote}]


def fact(subject, predicate, value, since=None, until=None, kind="observed", source="plc", quote="", ref=False, unit=None):
    return {
        "type": "fact",
        "fact": {
            "subject": subject, "predicate": predicate, "object": {"ref": value if ref else None, "value": None if ref else value, "unit": unit}, "valid_from": since and DAY + since,
            "valid_to": until and DAY + until, "kind": kind, "source": source, "citations": cite(quote), "model": None,
        },
    }


def seen(source, t):
    return {"type": "seen", "seen": {"source": source, "t": DAY + t}}


LINES = [
    fact("machine:c1", "mode", "run", "08:00:00"), fact("machine:c1", "mode", "stopped", "10:05:00"), fact("machine:c1", "health", "ok", "08:00:00"), fact("machine:c1", "health", "fault:jam", "10:05:00"),
    fact("machine:c1", "health", "ok", "10:25:00"), fact("machine:c1", "feeds", "machine:c2", None, None, "stated", ref=True), fact("machine:c2", "mode", "starving", "10:06:00"), fact("machine:c2", "mode", "run", "10:30:00"),
    fact("machine:c2", "mode", "paused", "10:31:00"), fact("machine:c1", "name", "Conveyor One", None, None, "stated"), fact("asset:9", "same_as", "machine:c1", None, None, "stated", ref=True),
    fact("asset:9", "setpoint", "3", "07:00:00", None, "stated", "changes"), fact("asset:9", "setpoint", "5", "09:00:00", None, "stated", "changes"),
    fact("asset:9", "work_order", "wo:1", "10:10:00", None, "stated", "cmms", ref=True), fact("wo:1", "wo_cause", "belt", None, None, "stated", "cmms"),
    fact("document:d1", "requires_qualification", "qualification:loto", None, None, "stated", "docs", "Only trained staff open Conveyor One.", ref=True),
    fact("rule:r2", "covers_zone", "zone:z1", None, None, "stated", "docs", ref=True), fact("rule:r2", "requires_qualification", "qualification:weld", None, None, "stated", "docs", ref=True),
    fact("machine:c1", "located_in", "zone:z1", None, None, "stated", ref=True),
    fact("person:ann", "holds_qualification", "qualification:loto", None, None, "stated", "hr", ref=True), fact("person:bob", "holds_qualification", "qualification:loto", None, None, "stated", "hr", ref=True),
    fact("person:ann", "on_shift", "shift:a", "06:00:00", "14:00:00", "stated", "hr", ref=True), fact("person:ann", "on_break", "yes", "10:00:00", "10:20:00", "stated", "hr"),
    fact("robot:7", "mode", "auto", "08:00:00", None, "observed", "fleet"), fact("robot:7", "current_task", "task:2", "09:00:00", None, "observed", "fleet", ref=True),
    fact("task:1", "assigned_to", "robot:7", "08:00:00", None, "observed", "fleet", ref=True), fact("task:2", "assigned_to", "robot:7", "09:00:00", None, "observed", "fleet", ref=True),
    fact("source:fleet", "report_interval", "600", None, None, "stated"), fact("source:plc", "report_interval", "600", None, None, "stated"),
    fact("robot:7", "finding", "made up", "09:00:00", None, "inferred"), fact("robot:8", "same_as", "robot:7", None, None, "inferred", ref=True),
    *[seen("fleet", t) for t in ("08:00:00", "08:10:00", "08:20:00", "10:50:00")], *[seen("plc", t) for t in ("08:00:00", "08:10:00", "09:30:00", "10:30:00", "10:50:00")],
]


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('log')}/log"
    rows = [{"seq": k, "fact": None, "seen": None, "confirm": None} | x for k, x in enumerate(LINES)]
    spark.createDataFrame([{**{"seq": 0, "type": None}, **r} for r in rows], LOG).coalesce(1).write.json(path)
    return Site(spark, path)


def test_readings_and_topology(site):
    assert site.clock() == DAY + "10:50:00"
    got = {(r[0], r[1], r[3]): r[-1] for r in site.state_at("robot:7").rows}
    assert got["robot:7", "mode", "auto"] == "known" and got["robot:7", "health", None] == "unknown" and got["robot:7", "finding", "made up"] == "known"
    early = {(r[0], r[1], r[3]): r[-1] for r in site.state_at("robot:7", DAY + "09:40:00").rows}
    assert early["robot:7", "mode", "auto"] == "stale"
    edges = {(r["subject"], r["object_text"]) for r in site.topology(DAY + "10:00:00").where("predicate = 'assigned_to'").collect()}
    assert edges == {("task:2", "robot:7")}  # it moved on from task 1
    assert [r[1] for r in site.impact("machine:c1").rows] == ["machine:c2"]
    assert [r[1:3] for r in site.pending().rows] == [("robot:8", "same_as")]  # a finding is no proposal


def test_findings_are_cited(site):
    got = {(r["rule"], r["subject"]): r for r in site.findings().collect()}
    assert {r for r, _ in got} == {"starvation", "change before fault", "stale source"}
    ids = {r["fact_id"] for r in site.facts.select("fact_id").collect()}
    assert all(r["because"] and set(r["because"]) <= ids for r in got.values())
    assert "machine:c2 starving at" in got["starvation", "machine:c1"]["text"]
    assert got["change before fault", "machine:c1"]["text"] == "setpoint became 5 before fault:jam"  # on another name of it
    assert got["stale source", "source:fleet"]["valid_from"] == DAY + "08:50:00"
    now = site.insights(DAY + "10:50:00")
    assert {r[0] for r in now.rows} == {"starvation", "change before fault", "stale source"} and len(site.insights(DAY + "10:50:00", DAY + "10:06:00").rows) == 0


def test_who_can(site):
    at = lambda t: {(r[0], r[2]): r[3] for r in site.who_can("machine:c1", DAY + t).rows}
    assert at("09:00:00") == {("qualification:loto", "person:ann"): "free", ("qualification:loto", "person:bob"): "not on shift", ("qualification:weld", None): "nobody holds it"}
    assert at("10:10:00")["qualification:loto", "person:ann"] == "on break"
    assert "no holder of qualification:loto is on shift and off break" in site.who_can("machine:c1", DAY + "10:10:00").gaps
    assert site.who_can("robot:7").gaps == ["no rule or document names robot:7 or its zone"]


def test_tables_and_sql(site):
    down = {(r["subject"], r["start"]): r for r in site.downtime().collect()}
    assert set(down) == {("machine:c1", DAY + "10:05:00"), ("machine:c2", DAY + "10:06:00")}  # paused is not down
    mine = down["machine:c1", DAY + "10:05:00"]
    assert (mine["end"], mine["seconds"], mine["cause"], mine["work_order"]) == (None, 2700, "belt", "wo:1")
    assert [tuple(r) for r in site.utilisation().collect()] == [("robot:7", "auto", 1200)]  # silent from 08:20 to 10:50
    assert site.sql("SELECT fault, seconds FROM fault_clear_time").rows == [("fault:jam", 1200)]
    assert site.sql("DROP TABLE facts").gaps == ["only queries are answered"]


def test_shift_report(site):
    got = site.shift_report(DAY + "06:00:00", DAY + "14:00:00")
    assert {r[0] for r in got["on shift"].rows} == {"person:ann"} and len(got["on shift"].rows) == 2
    assert [(r[0], r[2]) for r in got["what happened"].rows] == [("machine:c1", "fault:jam"), ("machine:c1", "stopped"), ("machine:c2", "starving")]
    assert [len(got[k].rows) for k in ("chains", "stale sources", "changes before faults")][0::2] == [1, 1] and got["stale sources"].rows
    assert any(k.startswith("changes since 2024-03-03") for k in got) and got["unknown"].gaps == [f"the log ends at {DAY}10:50:00, before {DAY}14:00:00"]


def test_actions(site, spark):
    cites = [site.facts.where("subject = 'robot:7' AND predicate = 'mode'").first()["fact_id"]]
    for bad in (("fly", "robot:7", "r", cites), ("pause", "robot:99", "r", cites), ("send_to", "robot:7", "r", cites), ("pause", "robot:7", "r", cites, "zone:z1"), ("pause", "robot:7", " ", cites), ("pause", "robot:7", "r", ["fact:0"])):
        with pytest.raises(ValueError):
            site.propose(*bad)
    first, second = site.propose("pause", "robot:7", "it waits", cites), site.propose("send_to", "robot:7", "make room", cites, "zone:z1")
    now = Site(spark, site.path)
    assert [(r[0], r[2], r[3]) for r in now.actions().rows] == [(first, "pause", "pending"), (second, "send_to zone:z1", "pending")]
    now.approve(first, "ann")
    now.reject(second, "bob")
    now = Site(spark, site.path)
    assert [(r[0], r[3], r[4]) for r in now.actions().rows] == [(first, "approved", "ann"), (second, "rejected", "bob")]
    assert [r["object_text"] for r in now.facts.where("predicate = 'intent'").collect()] == ["pause"] and now.facts.where(f"source = '{ACTIONS}'").count() == 0
    with pytest.raises(ValueError):
        now.approve(second, "ann")
