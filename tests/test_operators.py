"""Operators against plain Python statements of their rules."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factweave.functions.shared import fact_id, slug
from factweave.functions.template import compile_template
from factweave.operators import checks, clocks, graph, intervals, mapping, records, series, state
from factweave.plans import insights, research

FACTS = "seq long, subject string, predicate string, object_is_ref boolean, object_text string, unit string, valid_from string, valid_to string, kind string, source string"


def stamp(n):
    return f"2024-01-01T{n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}"


def some_facts(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        begin = None if rng.random() < 0.1 else stamp(rng.randint(0, 40))
        until = stamp(rng.randint(20, 60)) if rng.random() < 0.2 else None
        rows.append((seq, f"robot:{rng.randint(0, 6)}", "mode", False, rng.choice("abc"), rng.choice((None, "s")), begin, until, rng.choice(("observed", "stated", "inferred")), rng.choice("xyz")))
    return rows


def plain_history(rows):
    out = []
    chains = {}
    for r in rows:
        chains.setdefault((r[1], r[9]), []).append(r)
    for key, chain in chains.items():
        chain.sort(key=lambda r: (r[6] or "", r[0]))
        run, runs = -1, []
        for i, r in enumerate(chain):
            run += i == 0 or chain[i - 1][4] != r[4]
            runs.append(run)
        for i, r in enumerate(chain):
            if i and chain[i - 1][4] == r[4] and chain[i - 1][7] is None:
                continue
            following = next((chain[k][6] or "" for k in range(i + 1, len(chain)) if runs[k] == runs[i] + 1), None)
            end = r[7] if r[7] is not None and (following is None or r[7] < following) else following
            out.append((*key, r[4], r[6], end, r[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_history(spark, seed):
    rows = some_facts(seed)
    got = intervals.history(spark.createDataFrame(rows, FACTS), ["subject", "source"]).select("subject", "source", "object_text", "start", "end", "seq").collect()
    assert sorted(map(tuple, got), key=str) == plain_history(rows)


def plain_readings(rows, at):
    now = [r for r in rows if (r[6] is None or r[6] <= at) and (r[7] is None or r[7] > at)]
    out = []
    for subject in {r[1] for r in now}:
        mine = [r for r in now if r[1] == subject]
        first = {s: min(r[0] for r in mine if r[9] == s) for s in {r[9] for r in mine}}
        last = [r for r in mine if (r[6] or "") == max((q[6] or "") for q in mine if q[9] == r[9])]
        rank = lambda r: 0 if r[8] == "inferred" else 1
        last = [r for r in last if rank(r) == max(map(rank, last))]
        objects = {}
        for r in sorted(last, key=lambda r: (first[r[9]], r[0])):
            objects.setdefault((r[4], r[5]), r)
        chosen = list(objects.values()) if len(objects) > 1 else [max(last, key=lambda r: (r[6] or "", r[0]))]
        out += [(subject, r[4], r[0], "ambiguous" if len(objects) > 1 else "known") for r in chosen]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_readings(spark, seed):
    rows = some_facts(seed)
    seen = spark.createDataFrame([(s, stamp(30)) for s in "xyz"], "source string, t string")
    got = state.readings(spark.createDataFrame(rows, FACTS), seen, stamp(30), 90).select("subject", "object_text", "seq", "state").collect()
    assert sorted(map(tuple, got)) == plain_readings(rows, stamp(30))


def test_freshness_falls_back_by_the_key_not_the_value(spark):
    seen = spark.createDataFrame([("fleet", stamp(5)), ("fleet/r2", stamp(50))], "source string, t string")
    rows = spark.createDataFrame([("fleet", "r1"), ("fleet", "r2")], "source string, device string")
    got = {r["device"]: r["last_seen"] for r in state.with_freshness(rows, seen, stamp(10), F.col("device")).collect()}
    assert got == {"r1": stamp(5), "r2": None}


def test_components_and_downstream(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {v: v for p in pairs for v in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in pairs if a != b for v in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    edges = spark.createDataFrame([("a", "feeds", "b", 1), ("c", "part_of", "b", 2), ("c", "feeds", "a", 3), ("d", "in", "c", 4)], "subject string, predicate string, object_text string, seq long")
    walk = graph.downstream(graph.directed(edges), spark.createDataFrame([("a",)], "root string"), 3)
    assert sorted((r["id"], r["d"]) for r in walk.collect()) == [("b", 1), ("c", 2), ("d", 3)]


def test_overlaps_sessions_and_asof(spark):
    rng = random.Random(9)
    left = [(rng.choice("ab"), stamp(s := rng.randint(0, 9000)), stamp(s + rng.randint(1, 900))) for _ in range(60)]
    right = [(rng.choice("ab"), stamp(s := rng.randint(0, 9000)), stamp(s + rng.randint(1, 3000))) for _ in range(60)]
    got = intervals.overlap_join(spark.createDataFrame(left, "k string, start string, end string"), spark.createDataFrame(right, "k string, start2 string, end2 string"), ["k"], 600)
    want = sorted((a[0], *a[1:], *b[1:]) for a in left for b in right if a[0] == b[0] and a[1] < b[2] and a[2] > b[1])
    assert sorted(map(tuple, got.select("k", "start", "end", "start2", "end2").collect())) == want
    seen = spark.createDataFrame([("s", stamp(t)) for t in (0, 900, 1801, 1900)], "source string, t string")
    assert sorted((r["start"], r["end"], r["n"]) for r in intervals.sessions(seen, ["source"], "t", 900).collect()) == [(stamp(0), stamp(900), 2), (stamp(1801), stamp(1900), 2)]
    joined = intervals.asof_join(spark.createDataFrame([("k", 5), ("k", 1)], "k string, t int"), spark.createDataFrame([("k", 2, "x"), ("k", 5, "y")], "k string, u int, v string"), ["k"], "t", "u", "v", "last")
    assert sorted((r["t"], r["last"]) for r in joined.collect()) == [(1, None), (5, "y")]


def test_answers_first_and_latest(spark):
    rows = spark.createDataFrame([(1, "r", "proposed_action", False, "go", None, None, None, "inferred", "m")], FACTS)
    rows = rows.withColumn("fact_id", fact_id(rows))
    key = rows.first()["fact_id"]
    answers = lambda *a: spark.createDataFrame([(s, key, v, "me") for s, v in a], "seq long, proposal string, answer string, by string")
    assert state.stated_copies(rows, answers((0, "yes"))).count() == 0
    copy = state.stated_copies(rows, answers((2, "no"), (3, "yes"))).first()
    assert (copy["kind"], copy["source"], copy["predicate"]) == ("stated", "confirm", "intent")
    assert state.live(rows, answers((3, "no"))).count() == 0


def test_fact_id_is_canonical_json(spark):
    import hashlib
    import json

    rows = spark.createDataFrame([(1, "a:é", "name", False, 'x"y', "m", None, "t", "stated", "s"), (2, "a:1", "in", True, "b:2", None, "t", None, "observed", "s")], FACTS)
    got = [r[0] for r in rows.orderBy("seq").select(fact_id(rows)).collect()]
    for r, have in zip(rows.orderBy("seq").collect(), got, strict=True):
        obj = {"ref": r["object_text"]} if r["object_is_ref"] else {"unit": r["unit"], "value": r["object_text"]}
        body = {"kind": r["kind"], "object": obj, "predicate": r["predicate"], "source": r["source"], "subject": r["subject"], "valid_from": r["valid_from"], "valid_to": r["valid_to"]}
        assert have == "fact:" + hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def test_templates_and_mapping(spark):
    df = spark.createDataFrame([(1, "Conveyor Belt #2", "A; B", "yes"), (2, " ", "C", ""), (3, "belt", "A", "yes")], "n int, name string, parts string, ok string")
    got = [tuple(r) for r in df.orderBy("n").select(compile_template("{name|type}:{name|slug}", [("conveyor", "machine"), ("belt", "part")]), slug(F.col("name"))).collect()]
    assert got == [("machine:conveyor-belt-2", "conveyor-belt-2"), (None, ""), ("part:belt", "belt")]
    specs = [mapping.FactSpec("asset:{n}", "has", "parts", split=";"), mapping.FactSpec("asset:{n}", "ok", "ok", values={"yes": "true"}), mapping.FactSpec("asset:{n}", "first", "parts", once=True)]
    facts = mapping.map_table(df, specs, "n", "file", F.lit("t")).collect()
    assert sorted((r["row"], r["predicate"], r["object_text"]) for r in facts) == [(1, "first", "A; B"), (1, "has", "A"), (1, "has", "B"), (1, "ok", "true"), (2, "first", "C"), (2, "has", "C"), (3, "first", "A"), (3, "has", "A"), (3, "ok", "true")]
    feed = spark.createDataFrame([("t", "s", "x", '{"metrics":[{"name":"state","value":"run"},{"name":"n","value":3}]}')], "t string, source string, topic string, payload string")
    assert sorted((r["name"], r["value"]) for r in mapping.decode(feed, "sparkplug").collect()) == [("n", "3"), ("state", "run")]
    assert [r["value"] for r in mapping.decode(feed, "json", {"first": "metrics[0].name", "none": "nothing"}).collect()] == ["state"]


def test_clock_fits_are_exact(spark):
    base = 10**18
    rows = [(base + k, 3 * base + 7 * k + 5) for k in range(0, 10**9, 10**7)]
    offset, slope, n = series.fit_clock(spark.createDataFrame(rows, "x long, y long"), "x", "y")
    assert slope == 7 and n == 100 and series.align(base + 123, offset, slope) == 3 * base + 7 * 123 + 5
    links = [clocks.Link("a", "b", Fraction(5), Fraction(2), Fraction(1)), clocks.Link("c", "b", Fraction(1), Fraction(4))]
    there = clocks.path(links, "a", "c")
    assert (there.offset, there.rate, there.bound) == (Fraction(1), Fraction(1, 2), Fraction(1, 4))
    assert clocks.path(links, "a", "z") is None
    assert spark.range(1, 4).select(clocks.aligned(F.col("id"), links[0])).collect()[2][0] == 11
    assert clocks.comparable([("w", "m")], "w", "t") is None and clocks.comparable([("w", "m")], "w", "t", [("m", "t")]) == ["w", "m", "t"]


def test_checks(spark):
    runs = spark.createDataFrame([("m", 5, 9), ("n", 0, 1)], "k string, start int, end int")
    windows = spark.createDataFrame([("m", 0, 4), ("n", None, 3)], "k string, since int, until int")
    assert [r["k"] for r in checks.outside_windows(runs, windows, ["k"]).collect()] == ["m"]
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "p string, h string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "p string, h string")
    assert dict(map(tuple, checks.ledger_diff(old, new, "p", "h").collect())) == {"a": "unchanged", "b": "changed", "c": "gone", "d": "new"}


def test_findings(spark):
    rows = [(1, "machine:a", "health", False, "fault:jam", None, stamp(10), None, "observed", "s"), (2, "machine:b", "mode", False, "starved", None, stamp(40), None, "observed", "s"), (3, "machine:b", "mode", False, "idle", None, stamp(400), None, "observed", "s"), (4, "machine:a", "setpoint", False, "7", None, stamp(5), None, "stated", "s")]
    facts = spark.createDataFrame(rows, FACTS)
    facts = facts.withColumn("fact_id", fact_id(facts))
    spans = insights.spans(facts)
    edges = spark.createDataFrame([("machine:a", "feeds", "machine:b", 1)], "subject string, predicate string, object_text string, seq long")
    chain = insights.starvation(spans, edges).collect()
    assert [(r["subject"], r["text"], len(r["because"])) for r in chain] == [("machine:a", f"fault:jam → machine:b starved at {stamp(40)}", 2)]
    change = insights.change_before_fault(spans, spans.where("predicate = 'setpoint'")).collect()
    assert [r["text"] for r in change] == ["setpoint became 7 before fault:jam"]
    seen = spark.createDataFrame([("x", stamp(0)), ("x", stamp(4000)), ("y", stamp(100)), ("z", stamp(0)), ("z", stamp(1000))], "source string, t string")
    expected = spark.createDataFrame([("x", 60, "f1"), ("y", 60, "f2")], "source string, interval_seconds int, fact_id string")
    quiet = insights.stale_sources(seen, expected, stamp(4100)).collect()
    # Others than x must report once its silence is a silence, as z does here at 1000; y's silence began at 280.
    assert sorted((r["subject"], r["valid_from"], r["text"], r["because"]) for r in quiet) == [
        ("source:x", stamp(180), f"silent since {stamp(0)} until {stamp(4000)}", ["f1"]), ("source:y", stamp(280), f"silent since {stamp(100)} until now", ["f2"]),
    ]
    needs = spark.createDataFrame([("task:1", "weld", "n1")], "subject string, qualification string, fact_id string")
    holders = spark.createDataFrame([("weld", "p", stamp(10), stamp(20), "h1"), ("weld", "q", stamp(15), stamp(30), "h2")], "qualification string, person string, since string, until string, fact_id string")
    gap = insights.qualification_gap(needs, holders, stamp(0), stamp(60)).collect()
    assert {tuple(r["because"]) for r in gap} == {("n1", "h1", "h2")}
    assert sorted((r["valid_from"], r["text"]) for r in gap) == [(stamp(0), f"no free holder of weld until {stamp(10)}"), (stamp(30), f"no free holder of weld until {stamp(60)}")]
    orders = spark.createDataFrame([("wo:1", "conveyor motor", stamp(0), "replaced jammed motor", "no", "w1")], "subject string, asset string, valid_from string, problem string, lockout string, fact_id string")
    clauses = spark.createDataFrame([("4.2", "Lockout the conveyor before motors are replaced", "c1")], "clause string, text string, fact_id string")
    told = insights.regulation_check(orders, clauses)
    assert [(r["text"], r["because"]) for r in insights.all_findings(told, told).collect()] == [("4.2: no lockout recorded", ["w1", "c1"])]


def test_long_histories_cost_their_length(spark):
    rows = spark.range(400_000).selectExpr("id AS seq", "'robot:1' AS subject", "CASE WHEN id < 100000 THEN 'a' WHEN id < 300000 THEN 'b' ELSE 'a' END AS object_text", "format_string('%08d', id) AS valid_from", "CAST(NULL AS string) AS valid_to")
    got = sorted((r["start"], r["end"], r["object_text"]) for r in intervals.history(rows, ["subject"]).collect())
    assert got == [("00000000", "00100000", "a"), ("00100000", "00300000", "b"), ("00300000", None, "a")]


def test_rates_count_observed_time(spark):
    seen = spark.createDataFrame([("s", stamp(t)) for t in range(0, 36001, 600)], "source string, t string")
    spans = spark.createDataFrame([("r", stamp(0), stamp(7200))], "subject string, start string, end string")
    events = spark.createDataFrame([("r", stamp(t)) for t in (10, 20, 30, 40, 9000)], "subject string, t string")
    got = research.rate_when(events, spans, research.observed(seen)).first()
    assert (got["with_n"], got["without_n"], got["hours"], got["without_hours"], got["verdict"]) == (4, 1, 2.0, 8.0, "supported")
    df = spark.createDataFrame([("5",), ("x",), (None,)], "v string")
    assert [df.where(research.meets(F.col("v"), op, t)).count() for op, t in ((">", "4"), ("<=", "x"), ("in", "x, 5"), ("!=", "x"))] == [1, 0, 2, 1]


def test_records(spark):
    uses = spark.createDataFrame([("g", "base", 1, True), ("g", "tool", 2, False), ("h", "cam", 3, True)], "graph string, frame string, id long, declares boolean")
    bad = records.unresolved_frames(uses, spark.createDataFrame([("g",)], "graph string")).collect()
    assert {(r["frame"], r["reason"]) for r in bad} == {("tool", "frame_undeclared"), ("cam", "graph_missing")}
    stated = spark.createDataFrame([("m", "r1"), ("m", "r9"), ("n", "r9"), ("m", None)], "machine string, revision string")
    declared = spark.createDataFrame([("m", "r1"), ("n", None)], "machine string, revision string")
    assert [tuple(r) for r in records.revision_mismatches(stated, declared, "machine", "revision").collect()] == [("m", "r9")]
    soft = spark.createDataFrame([("nav", "1.0", "a", None, "x"), ("nav", "1.0", "b", "7", "y"), ("nav", None, "b", "7", "y")], 'name string, release string, commit string, build string, digest string')
    assert [(r["pair"], r["key"], r["n_values"]) for r in records.software_conflicts(soft).collect()] == [("release>commit", "1.0", 2)]


def test_nearest_bindings(spark):
    runs = spark.createDataFrame([(1, "u", "a/b/run.mcap"), (2, "u", "c/run.mcap"), (3, "v", "run.mcap")], "run long, unit string, path string")
    items = spark.createDataFrame([(10, "u", "hw", "a/b/hw.yaml"), (11, "u", "hw", "a/hw.yaml"), (12, "u", "sw", "a/b/sw.yaml"), (13, "u", "sw", "a/b/x/../sw.yaml")], "item long, unit string, slot string, path string")
    got = {(r["run"], r["slot"]): (r["item"], r["depth"], r["state"]) for r in records.nearest_bindings(runs, items).collect()}
    assert got == {(1, "hw"): (10, 2, "bound"), (1, "sw"): (None, 2, "conflict"), (2, "hw"): (None, 0, "conflict"), (2, "sw"): (None, 0, "conflict")}
    assert records.nearest_bindings(runs, items.limit(0)).count() == 0


def test_noisy_or(spark):
    rows = spark.createDataFrame([("a", 0.5, False), ("a", 0.5, False), ("a", 0.2, True), ("b", 1.0, False), ("c", 1.0, True), ("d", 1.0, False), ("d", 1.0, True)], "k string, w double, against boolean")
    assert dict(map(tuple, records.noisy_or(rows, "k", "w", "against").collect())) == {"a": 0.6, "b": 1.0, "c": 0.01, "d": 0.01}
