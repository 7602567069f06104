"""Steps whose disk, time or memory must not grow with pairs, and the ties and odd rows that they must still get right."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

from factweave.operators import checks, documents, intervals, records
from factweave.plans import catalogue, report_catalogue, research  # noqa: F401 (report_catalogue adds its plans)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def before(df, node):
    """The physical plan above the first such node."""
    return df._jdf.queryExecution().executedPlan().toString().split(node)[0]


def test_pairs_of_documents_and_entities_are_not_exchanged(spark):
    said = [(f"d{k}", f"{'Pump One, ' if k % 2 else ''}text {k} --- pump two" if k % 3 else "pump  one") for k in range(12)] + [("d1", "Arm"), ("d0", None)]
    texts = spark.createDataFrame(said, "document string, text string")
    names = [(f"e{k}", "PUMP one") for k in range(5)] + [("e4", "arm"), ("e5", "arm"), ("e5", "---"), ("e6", "p"), ("e7", "pump two more"), ("e8", None)]
    covers = [(f"d{k}", z) for k in range(12) for z in ("y", "z") if k % 4 < 2] + [("d0", "y"), ("d1", None)]
    places = [(f"e{k}", z) for k in range(4) for z in ("y", "z", "x")] + [("e6", "z"), ("e9", "x"), ("e7", None)]
    named, where = spark.createDataFrame(names, "entity string, name string"), spark.createDataFrame(places, "entity string, zone string")
    got = documents.applies_to(texts, spark.createDataFrame(covers, "document string, zone string"), named, where)
    plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split(" ")
    has = lambda t, n: n in t.lower() and (not n[0].isalpha() or any(plain(t)[i : i + len(n.split(" "))] == n.split(" ") for i in range(len(plain(t)))))
    want = {(d, e) for d, t in said for e, n in names if t and n and len(n) > 2 and has(t, n.lower())} | {(d, e) for d, z in covers for e, p in places if z is not None and z == p}
    assert rows(got) == sorted(want) and any(e == "e5" for _, e in want)
    assert "Exchange" not in before(got, "Union")


def test_superseding_revisions_are_told_once_per_revision(spark):
    # 300 records hold "a" of d, 200 say that they replace it; record 0 is held twice, and so told each of them twice.
    held = [(k, "d", "a", None) for k in (0, *range(300))] + [(1000 + k, "d", "bc"[k % 2], ["a", "a"]) for k in range(200)] + [(5000, "e", "a", ["a"]), (5001, "f", "a", []), (5002, "f", None, ["a"])]
    got = records.superseded(spark.createDataFrame(held, "record int, document string, revision string, supersedes array<string>"))
    once = ",".join(["b"] * 100 + ["c"] * 100)
    want = [(0, "d", "a", ",".join(["b"] * 200 + ["c"] * 200))] + [(k, "d", "a", once) for k in range(1, 300)] + [(5000, "e", "a", "a"), (5001, "f", "a", "")]
    assert sorted(map(tuple, got.collect())) == want
    # Texts meet records last: no exchange or aggregate holds a text for each record.
    assert "Aggregate" not in before(got, "Join")


def test_a_change_in_the_second_of_the_fault_is_not_before_it(spark, tmp_path):
    said = [("08:00:00", "view"), ("09:00:00", "click"), ("09:00:00", "error"), ("09:00:00", "signup"), ("09:00:00", "error"), ("10:00:00", "error"), ("10:00:00", "view"), ("10:00:00", "error")]
    events = [(k, f"2024-01-01 {t}", 7, mode) for k, (t, mode) in enumerate(said)] + [(20, "2024-01-01 08:00:00", 8, "view"), (21, "2024-01-01 08:00:00", 8, "error")]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string").selectExpr(
        "event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "1D AS value", "'' AS props"
    ).write.parquet(f"{tmp_path}/events.parquet")
    got = catalogue.QUERIES["change_before_fault"](spark, str(tmp_path)).select("seq", "change").collect()
    # The fault of 09:00 goes on at 10:00, until the view of that second.
    assert sorted(map(tuple, got)) == [(2, "view"), (4, "view"), (7, "signup"), (21, None)]


def test_sessions_of_one_key_do_not_sort_its_rows_in_one_task(spark):
    rng = random.Random(4)
    at = lambda s: (datetime(2024, 1, 1) + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S")
    said = [(k, at(int(rng.choice((200, 400, 100000)) * rng.random()) * 60)) for k in "ab" for _ in range(150)] + [("a", at(86400 - 1)), ("a", at(86400 + 899)), ("c", None), ("c", None), ("c", at(5)), ("d", "?"), ("d", "?")]
    said += [("b", "2024-01-02Tlate"), ("b", "2024-01-02Tlate"), ("e", at(0)), ("e", at(86400 * 9)), ("f", at(86400 - 900)), ("f", at(86400)), ("f", at(86400 + 900))]
    want = []
    seconds = lambda t: datetime.strptime(t, "%Y-%m-%dT%H:%M:%S").timestamp() if t and "l" not in t and "?" not in t else None
    for k in sorted({k for k, _ in said}):
        last = None
        for t in sorted((t for q, t in said if q == k), key=lambda t: t or ""):
            if want and want[-1][0] == k and (t == want[-1][2] or last is not None and seconds(t) is not None and seconds(t) - last <= 900):
                want[-1] = (k, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((k, t, t, 1))
            last = seconds(t)
    got = intervals.sessions(spark.createDataFrame(said, "k string, t string"), ["k"], "t", 900)
    assert rows(got.select("k", "start", "end", "n")) == sorted(want, key=str)
    # What is sent first is counted by time; a walk by key alone comes after that.
    assert len(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString())[-1].split(",")) > 2


def test_conflicts_of_runs_send_no_names(spark):
    rng = random.Random(7)
    some = lambda *v: rng.choice(v)
    software = [(some(k, k, k, None), some("nav", "arm", None), some("", None, "d"), some("1", "2", "3", None), some("1", "r", None)) for k in range(40) for _ in range(2)]
    bound = [(rng.randrange(12), some(rng.randrange(45), None)) for _ in range(120)]
    got = records.run_software_conflicts(spark.createDataFrame(bound, "run int, configuration int"), spark.createDataFrame(software, "configuration int, name string, device string, commit string, release string"))
    values = {}
    for run, b in bound:
        for c, name, device, *told in software:
            for field, v in zip(("commit", "release"), told):
                if b is not None and b == c and name is not None and v is not None:
                    values.setdefault((run, name, device or "", field), set()).add(v)
    assert rows(got) == sorted(((*k, len(v)) for k, v in values.items() if len(v) > 1), key=str)
    assert not re.search(r"hashpartitioning\(run#\d+L?, name#", got._jdf.queryExecution().executedPlan().toString())


def test_limits_are_dealt_out_and_not_broadcast(spark, sf_dir):
    plan = catalogue.QUERIES["declared_limits"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1  # with the ends, a row for a column
    rng = random.Random(5)
    number = lambda: rng.choice([None, float("nan"), *map(float, range(8))])
    values = [(rng.choice("stu"), rng.choice("abc"), number()) for _ in range(300)]
    limits = [(s, c, "m", rng.choice(["m", "m", None]), rng.choice([None, 2.0, 4.0]), rng.choice([None, 3.0, 5.0])) for s in "stv" for c in "ab" for _ in range(2)]
    got = checks.declared_limits(
        spark.createDataFrame(values, "stream string, column string, value double"), spark.createDataFrame(limits, "stream string, column string, unit string, column_unit string, lower double, upper double")
    )
    found = {}
    for s, c, unit, other, low, high in limits:
        held = [v for t, x, v in values if (t, x) == (s, c) and v is not None and v == v]
        n = (sum(low is not None and v < low for v in held), sum(high is not None and v > high for v in held))
        if unit == other and any(n):
            key = (s, c, unit, low, high)
            found[key] = tuple(map(sum, zip(found.get(key, (0, 0)), n)))
    assert found and rows(got) == sorted(((*k, *n) for k, n in found.items()), key=str)


def test_observed_hours_meet_at_midnight_without_sorting_all_reports(spark):
    stamps = [f"2024-01-0{d}T{h:02}:{m:02}:00" for d, h in ((1, 23), (2, 0)) for m in range(0, 60, 10)] * 3 + ["2024-01-04T00:00:00"]
    periods = research.observed(spark.createDataFrame([("x" if k % 2 else "y", t) for k, t in enumerate(stamps)], "source string, t string"))
    assert len(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", periods._jdf.queryExecution().executedPlan().toString())[-1].split(",")) > 2
    spans = spark.createDataFrame([("r", "2024-01-01T23:30:00", "2024-01-02T00:30:00")], "subject string, start string, end string")
    events = spark.createDataFrame([("r", t) for t in ("2024-01-01T23:40:00", "2024-01-02T00:10:00", "2024-01-02T00:20:00", "2024-01-02T00:40:00")], "subject string, t string")
    got = research.rate_when(events, spans, periods).first()
    assert (got["with_n"], got["without_n"], got["hours"], round(got["without_hours"], 6), got["verdict"]) == (3, 1, 1.0, round(50 / 60, 6), "supported")


def test_observed_hours_do_not_gather_a_days_intervals_in_one_task(spark):
    rng = random.Random(6)
    at = lambda s: (datetime(2024, 1, 1) + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S")
    periods = [(k * 9000, k * 9000 + rng.choice((0, 60, 4000, 8000))) for k in range(0, 60) if k % 9] + [(6 * 86400 - 50, 8 * 86400 + 50)]
    spans, events = [], []
    for who in ("a", "b", "c"):
        t = rng.randrange(9000)
        while t < 9 * 86400:
            spans.append((who, t, t := t + rng.choice((1, 3600, 100000))))
            t += rng.choice((0, 5000, 90000))
        events += [(who, rng.choice([x for s in spans for x in s[1:]]) + rng.choice((-1, 0, 1))) for _ in range(40)]
    spans += [(None, 0, 86400), ("d", None, 40), ("d", 8 * 86400 + 60, 9 * 86400), ("e", 0, 86400)]
    events += [(None, 5), ("d", 39), ("d", 40), ("d", 8 * 86400 + 70), ("f", 5)]
    text = lambda rows_: [(k, *(None if t is None else at(t) for t in ts)) for k, *ts in rows_]
    want = []
    for who in {k for k, _ in events}:
        own = [(a, b) for k, a, b in spans if k == who and who is not None]
        inside = [any((a is None or a <= t) and t < b for a, b in own) for k, t in events if k == who]
        met = sum(min(b, q) - max(a, p) for a, b in own if a is not None for p, q in periods if a < q and b > p)
        want.append((who, sum(inside), len(inside) - sum(inside), met, sum(q - p for p, q in periods) - met))
    got = research.rate_when(
        spark.createDataFrame(text(events), "subject string, t string"), spark.createDataFrame(text(spans), "subject string, start string, end string"),
        spark.createDataFrame([(at(p), at(q)) for p, q in periods], "start string, end string"),
    )
    assert rows(got.selectExpr("subject", "with_n", "without_n", "round(hours * 3600)", "round(without_hours * 3600)")) == sorted(want, key=str)
    # Events and intervals are sent by subject, once; nothing is sent by day.
    sent = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1])
    assert [x.split("#")[0] for x in sent] == ["subject"]


def test_reported_intervals_are_not_dealt_by_source_and_day(spark, sf_dir):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = catalogue.QUERIES["utilisation_reported"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, was)
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning\([^)]*__[bc]#", plan)
