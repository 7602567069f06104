"""Plans that must not leave out rows, on small cases."""

from factweave.plans import catalogue


def events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr(
        "event_id", "CAST(ts AS timestamp) AS ts", "user_id", "event_type", "value", "props"
    ).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_every_change_in_the_day_before_a_fault(spark, tmp_path):
    said = [("01-01 09:00:00", "signup"), ("01-01 10:00:00", "view"), ("01-01 23:00:00", "click"), ("01-02 09:30:00", "purchase"), ("01-02 10:00:00", "error")]
    d = events(spark, tmp_path, [(k, f"2024-{t}", 7, mode, 1.0, None) for k, (t, mode) in enumerate(said)])
    got = catalogue.QUERIES["changes_before_fault"](spark, d).collect()
    assert sorted(r["text"].split()[2] for r in got) == ["click", "purchase", "view"]
    assert {r["valid_from"] for r in got} == {"2024-01-02T10:00:00"} and len({r["change_id"] for r in got}) == 3


def test_every_copy_in_another_source(spark, tmp_path):
    said = [(1, "x", "a"), (2, "x", "a"), (3, "x", "b"), (4, "y", "a"), (5, "y", "a"), (6, "x", "c"), (7, None, "a"), (8, None, "b"), (9, "x", "c")]
    spark.createDataFrame(said, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.QUERIES["identity_links"](spark, str(tmp_path)).collect()
    stands = {k: {k} for r in rows for k in (r["first_id"], r["doc_id"]) if r["link"] == "pair"}
    for r in rows:
        if r["link"] == "member":
            stands[r["first_id"]].add(r["doc_id"])
    pairs = [frozenset((a, b)) for r in rows if r["link"] == "pair" for a in stands[r["first_id"]] for b in stands[r["doc_id"]]]
    want = {frozenset((a, b)) for a, s, x in said for b, t, y in said if s is not None and s == t and x != y}
    assert set(pairs) == want and len(pairs) == len(want)


def test_open_intervals_count_to_the_clock_while_the_source_reports(spark, tmp_path):
    # Source 1 reports at 0:00, 0:30 and 5:00, 5:20; robot 7 is in view until 5:20, the clock; silence from 0:30 to 5:00 is no used time.
    said = [(1, "00:00", 7, "view"), (5, "00:30", 8, "error"), (9, "05:00", 8, "error"), (13, "05:20", 8, "error")]
    d = events(spark, tmp_path, [(k, f"2024-01-01 {t}:00", who, mode, 1.0, None) for k, t, who, mode in said])
    used = {(r["subject"], r["mode"]): r["seconds"] for r in catalogue.QUERIES["utilisation_reported"](spark, d).collect()}
    assert used == {("robot:7", "view"): 3000, ("robot:8", "error"): 1200}
    down = [(r["subject"], r["start"], r["end"], r["seconds"]) for r in catalogue.QUERIES["downtime_to_clock"](spark, d).collect()]
    assert down == [("robot:8", "2024-01-01T00:30:00", None, 17400)]


def test_before_after_compares_rates_over_observed_time(spark):
    from factweave.plans import research

    p = spark.createDataFrame([("2024-01-01T00:00:00", "2024-01-01T08:00:00"), ("2024-01-02T00:00:00", "2024-01-02T02:00:00")], "start string, end string")
    rows = [("x", f"2024-01-01T0{k}:00:00") for k in range(4)] + [("x", f"2024-01-02T0{k}:00:00") for k in (0, 1)] + [("y", "2024-01-01T01:00:00")]
    e = spark.createDataFrame(rows, "subject string, t string")
    said = lambda at, expect: {r["subject"]: (r["verdict"], r["ratio"]) for r in research.before_after(e, p, at, expect).collect()}
    # Fewer events after, but in two hours and not eight.
    assert said("2024-01-02T00:00:00", "more") == {"x": ("supported", 2.0), "y": ("inconclusive", None)}
    assert said("2024-01-02T00:00:00", "fewer")["x"] == ("rejected", 0.5)
    assert said("2024-01-02T01:50:00", "more")["x"] == ("inconclusive", None)
