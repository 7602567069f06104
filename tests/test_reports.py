"""Reports, documents, decoded readings and record rules on rows written by hand."""

from factweave.operators import checks, documents, graph, readings, records, series, shifts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_value_that_comes_back_is_no_change(spark):
    spans = spark.createDataFrame([("a", "mode", "x", "1", 1), ("a", "mode", "x", "2", 2), ("a", "mode", "y", "3", 3), ("b", "mode", "x", None, 4), ("b", "mode", None, "1", 5)], "subject string, predicate string, object_text string, start string, seq long")
    assert [(r.subject, r.was, r.object_text) for r in shifts.value_changes(spans).orderBy("subject").collect()] == [("a", "x", "y"), ("b", "x", None)]


def test_shift_windows(spark):
    t = "2024-01-0{}T0{}:00:00".format
    held = [("a", t(1, 6), t(1, 8)), ("a", t(2, 6), t(2, 8)), ("b", t(9, 1), t(9, 2)), ("b", t(1, 1), None), ("c", None, None)]
    roster = spark.createDataFrame(held, "shift string, valid_from string, valid_to string")
    got = rows(shifts.shift_windows(roster, ["a", "b", "c", "d"], t(3, 0)))
    # The only whole window of b has not begun, so it is taken; nothing ends before a's first day.
    assert got == [("a", t(2, 6), t(2, 8), t(1, 8)), ("b", t(9, 1), t(9, 2), t(2, 8))]
    assert rows(shifts.shift_windows(roster, ["a"], t(1, 7))) == [("a", t(1, 6), t(1, 8), "2023-12-31T06:00:00")]
    assert rows(shifts.shift_windows(roster.limit(0), ["a"], t(1, 7))) == []


def test_counters_at_both_ends(spark):
    spans = spark.createDataFrame([("late", "5", "1", "7"), ("one", "1", "2", "4"), ("two", "1", "3", "1"), ("two", "4", "4", "9"), ("never", "9", "5", "1")], "subject string, start string, seq string, object_text string")
    assert rows(shifts.counter_ends(spans, "3", "6")) == [("late", "5", "7", None, None), ("one", "1", "4", None, None), ("two", "1", "1", "4", "9")]


def test_evidence_goals_caps_and_names(spark):
    f = spark.createDataFrame([("stated", "a.csv"), ("stated", "a.pdf"), ("stated", None), ("observed", "a.csv"), ("inferred", "a.csv")], "kind string, file string")
    assert [r[0] for r in f.select(shifts.evidence_class(f.kind, f.file)).collect()] == ["records", "documents", "documents", "feed", "inferred"]
    cards = spark.createDataFrame([("h", 1, "rejected", ["g"]), ("h", 2, "supported", ["g", "g"]), ("k", 1, "other", ["g"])], "key string, round int, verdict string, goals array<string>")
    goals = spark.createDataFrame([("g",), ("empty",)], "goal string")
    assert rows(shifts.goal_tallies(goals, shifts.latest_cards(cards))) == [("empty", 0, 0, 0), ("g", 1, 0, 0)]
    found = spark.createDataFrame([("s", "x", 3), ("s", "y", 1), ("s", "x", 2)], "k string, code string, item int")
    assert rows(shifts.capped(found, "k", "code", "item", 2)) == [("s", 3, "x:2, y:1", "1,2", 1)]
    files = spark.createDataFrame([("d", "a_20240101_000000.x"), ("d", "b20240101T000100"), ("d", "20240101_000201"), ("d", "20241301_000000"), ("d", "120240101_000000"), ("d", None)], "folder string, name string")
    assert [r[1:] for r in rows(shifts.name_clusters(files))] == [("2024-01-01T00:00:00", "2024-01-01T00:01:00", 2), ("2024-01-01T00:02:01", "2024-01-01T00:02:01", 1)]


def test_unseen_facts_come_once(spark):
    new = spark.createDataFrame([("f1", 1), ("f2", 2), ("f2", 1)], "fact_id string, seq int")
    assert rows(shifts.unseen(new, new.where("fact_id = 'f1'"))) == [("f2", 1)]


def test_readings(spark):
    said = [("health", v) for v in ("jam", "", None, "[]", '[{"errorType":"e1"},{"errorType":"e2"}]', '[{"a":1}]')] + [("task", "7"), ("task", None), ("zone", "zone:1"), ("zone", "1"), ("zone", None), ("odd", "1"), ("cell", "4")]
    pairs = spark.createDataFrame([("t", "s", "a/b/", '{"p":{"c":"c1"},"st":"run"}', *x, "m") for x in said], "t string, source string, topic string, payload string, name string, value string, unit string")
    fields = {
        "health": readings.Field("health"), "task": readings.Field("current_task", state="st"), "zone": readings.Field("in_zone", ref="zone"), "cell": readings.Field("n", subject="cell:{payload.p.c}"),
    }
    got = [tuple(r)[2:] for r in readings.readings(pairs, "r:{topic[-1]}", fields).collect()]
    assert [g[3] for g in got[:6]] == ["fault:jam", "ok", "ok", "ok", "fault:e1", "fault:error"]
    assert got[6:] == [
        ("r:b", "current_task", True, "task:7", None), ("task:7", "assigned_to", True, "r:b", None), ("task:7", "task_state", False, "run", None), ("r:b", "current_task", False, "none", None),
        ("r:b", "in_zone", True, "zone:1", None), ("r:b", "in_zone", True, "zone:1", None), ("cell:c1", "n", False, "4", "m"),
    ]
    assert readings.readings(pairs, "r:{payload.none}", {"health": fields["health"]}).count() == 0
    assert {r[0] for r in readings.device_reports(pairs, "r:{topic[0]}").collect()} == {"s", "s/a"} and {r[0] for r in readings.device_reports(pairs, "robot:1").collect()} == {"s"}


def test_documents(spark):
    blocks = spark.createDataFrame([("document:d", 0, " Safety "), ("document:d", 1, "4.2 Wear gloves, see LOTO and loto."), ("document:d", 2, None)], "document string, position int, block string")
    assert [r.object_text for r in documents.names(blocks).collect()] == ["Safety"]
    lifts = [documents.Lift("requires", "(?i)loto", 0, "q", True), documents.Lift("word", "gl(ov)es", 1)]
    got = [tuple(r)[2:] for r in documents.lifted(blocks, r"([0-9.]+) (.*)", lifts).collect()]
    rule = "rule:d-4.2"
    assert got == [(rule, "rule_text", "Wear gloves, see LOTO and loto."), (rule, "requires", "q:LOTO"), (rule, "requires", "q:loto"), ("document:d", "word", "ov")]


def test_long_vocabularies_take_several_passes(spark, monkeypatch):
    blocks = spark.createDataFrame([("d", 0, "Belt Guard and hook"), ("d", 1, None)], "document string, position int, block string")
    words = spark.createDataFrame([("belt-guard",), ("HOOK",), (" ",), ("none",), ("hook ",), (None,)], "term string")
    want = ["t:HOOK", "t:belt-guard", "t:hook"]
    assert sorted(r.object_text for r in documents.terms_in(blocks, words, "p", "t").collect()) == want
    monkeypatch.setattr(documents, "TERMS", 1)
    assert sorted(r.object_text for r in documents.terms_in(blocks, words, "p", "t").collect()) == want
    assert documents.terms_in(blocks, words.limit(0), "p").count() == 0


def test_mentions_are_whole_words(spark):
    texts = spark.createDataFrame([("d1", "The Conveyor One, and c-1."), ("d2", "conveyor ones; xc-1; Éa +++ b"), ("d3", None), ("d4", "a\\Eb")], "document string, text string")
    named = spark.createDataFrame([("m1", "conveyor one"), ("m2", "C-1"), ("m3", "+++"), ("m4", "éa +"), ("m5", "b"), ("m6", "A\\Eb")], "entity string, name string")
    assert rows(documents.mentions(texts, named)) == [("d1", "m1"), ("d1", "m2"), ("d2", "m3"), ("d2", "m4"), ("d4", "m6")]
    covers, places = spark.createDataFrame([("d3", "z"), ("d1", "z")], "document string, zone string"), spark.createDataFrame([("m1", "z")], "entity string, zone string")
    assert rows(documents.applies_to(texts, covers, named.where("entity = 'm1'"), places)) == [("d1", "m1"), ("d3", "m1")]


def test_regions_and_tags(spark):
    register = spark.createDataFrame([(2, "belt CV-2", "late"), (1, "CV-2 drive", "conveyor")], "row int, name string, type string")
    said = '{"model":"m","prompt_sha256":"0123456789abcdef","image":"i/x.png","regions":[{"text":"CV-2 : worn","box":["1","2","3","4"]},{"text":"Z: a"},{"text":"rust"},{}]}'
    got = documents.extractions(spark.createDataFrame([(said,), ("{",), (None,)], "j string"), "j", register).orderBy("region").collect()
    assert [(r.subject, r.object_text, r.model) for r in got] == [("conveyor:cv-2", "CV-2 : worn", "m@0123456789ab"), ("machine:z", "Z: a", "m@0123456789ab"), ("document:x", "rust", "m@0123456789ab")]
    assert got[0].locator == "region 1,2,3,4"


def test_record_rules_and_frames(spark):
    held = spark.createDataFrame([(1, "d", "a", []), (2, "d", "b", ["a", "a", "z"]), (3, "e", "a", None), (4, "d", "c", ["a"])], "record int, document string, revision string, supersedes array<string>")
    assert rows(records.superseded(held)) == [(1, "d", "a", "b,c")]
    software = spark.createDataFrame([("x", "nav", None, "1", None), ("y", "nav", None, "2", "r"), ("z", None, None, "3", "r"), ("w", "nav", "arm", "4", None)], "configuration string, name string, device string, commit string, release string")
    bound = spark.createDataFrame([("r", c) for c in "xyzwx"] + [("q", "x")], "run string, configuration string")
    assert rows(records.run_software_conflicts(bound, software)) == [("r", "nav", "", "commit", 2)]
    frames = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("x", "y"), ("y", "x"), ("w", "x"), ("s", "s"), ("x", "v"), ("v", "u")], "child string, parent string")
    assert rows(graph.several_parents(frames)) == [("d", 2), ("x", 2)]
    assert [r[0] for r in rows(graph.loops(frames))] == ["s", "x", "y"]
    assert graph.loops(frames.where("child = 'b'")).count() == 0 and graph.loops(frames.limit(0)).count() == 0


def test_anchors_leave_out_rows_without_time_and_other_types(spark):
    m = [
        ("p", "ulog", "sensor_gps", 1, {"time_utc_usec": 10}), ("p", "ulog", "sensor_gps", 2, {"time_utc_usec": 0}), ("p", "ulog", "sensor_gps", 3, {"time_utc_usec": 9}),
        ("p", "ulog", "sensor_baro", 4, {"time_utc_usec": 9}), ("p", "dataflash", "sensor_gps", 4, {"time_utc_usec": 9}), ("p", None, None, 4, None), ("p", "ulog", "sensor_gps", None, {"time_utc_usec": 9}),
        ("a", "dataflash", "GPS2", 1, {"GWk": 2, "GMS": 5}), ("a", "dataflash", "GPS2", 2, {"GWk": 0, "GMS": 5}), ("a", "dataflash", "GPS", 3, {"GWk": 2, "GMS": series.WEEK_MS}),
        ("a", "dataflash", "GPS", 4, {"GWk": 2}), ("a", "dataflash", "GPS", 5, {"GWk": 2**62, "GMS": 1}), ("a", "dataflash", "GPS", 6, {"GWk": 2, "GMS": None}),
    ]
    anchors = series.clock_anchors(spark.createDataFrame(m, "stream string, encoding string, kind string, tick long, fields map<string,long>"))
    assert rows(anchors) == sorted([("p", "px4.gps_utc", 1, 10), ("p", "px4.gps_utc", 3, 9), ("a", "ardupilot.gps_time", 1, 2 * series.WEEK_MS + 5)], key=str)
    assert rows(series.anchor_report(anchors)) == [("a", "ardupilot.gps_time", 1, 1, 0, "single_instant"), ("p", "px4.gps_utc", 2, 2, 1, "runs_backward")]
    assert rows(series.anchor_report(anchors.where("false"))) == []


def test_limits_need_equal_units_and_numbers(spark):
    values = spark.createDataFrame([("s", "a", v) for v in (1.0, 5.0, 9.0, None, float("nan"))] + [("s", "b", 1.0), ("t", "a", 1.0)], "stream string, column string, value double")
    limit = lambda *rows_: checks.declared_limits(values, spark.createDataFrame(list(rows_), "stream string, column string, unit string, column_unit string, lower double, upper double"))
    assert rows(limit(("s", "a", "m", "m", 5.0, 5.0), ("s", "b", "m", None, 5.0, None), ("t", "a", "m", "ft", 5.0, None))) == [("s", "a", "m", 5.0, 5.0, 1, 1)]
    assert rows(limit(("s", "a", "m", "m", None, 8.0), ("s", "b", None, None, 5.0, None), ("t", "a", "m", "m", 1.0, 1.0), ("u", "a", "m", "m", 9.0, None))) == [("s", "a", "m", None, 8.0, 0, 1)]


def test_counts_leave_out_the_exempt(spark):
    stated = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3), ("d", 0), ("e", None)], "stream string, stated long")
    found = spark.createDataFrame([("a",), ("a",), ("c",), ("d",)], "stream string")
    assert rows(checks.counted(stated, found, spark.createDataFrame([("c",)], "stream string"))) == [("b", 1, 0), ("d", 0, 1)]


def test_a_fall_is_named_by_what_the_clock_declares(spark):
    r = spark.createDataFrame([("a", 1, 5, True), ("a", 2, None, True), ("a", 3, 4, True), ("a", 4, 4, True), ("b", 1, 9, None), ("b", 2, 2, None), ("b", 3, 1, None), ("c", 1, 1, False)], "s string, n int, t long, steady boolean")
    from pyspark.sql import functions as F

    assert rows(checks.clock_falls(r, ["s"], "n", "t", F.col("steady"))) == [("a", "time_regression", 1, 1), ("b", "time_out_of_order", 2, 7)]
