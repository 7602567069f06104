"""Named plans over the driver's tables, each with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import seconds_between, shifted, tokens
from ..functions.template import compile_template
from ..operators import checks, graph, intervals, mapping, records, series, state
from ..sources import files, tables
from ..sources.tables import table
from . import insights

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The moment and the windows that the production plans ask about.
AT, SINCE, DAY = "2024-01-15T12:00:00", "2024-01-14T12:00:00", 86400
STALE = 3 * 900
WAITING = ("error", "signup")

MSGS = """msgs AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, 'robot:' || user_id AS subject, 'src' || (event_id % 4) AS source,
  event_type AS mode, value, props FROM events)"""
FACTS = (
    MSGS
    + """, raw AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'inferred' ELSE 'observed' END AS kind FROM msgs),
facts AS (SELECT seq, subject, 'mode' AS predicate, mode AS object_text, t AS valid_from, kind, source,
  'fact:' || substr(sha256('{"kind":"' || kind || '","object":{"unit":null,"value":"' || mode || '"},"predicate":"mode","source":"' || source || '","subject":"' || subject || '","valid_from":"' || t || '","valid_to":null}'), 1, 16) AS fact_id FROM raw)"""
)
CONFIRMS = FACTS + """, confirms AS (SELECT l.doc_id + 1000000 AS seq, f.fact_id AS proposal, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS answer FROM labels l JOIN facts f ON f.seq = l.doc_id)"""
SPANS_ONLY = """marked AS (SELECT *, CASE WHEN lag(object_text) OVER w IS DISTINCT FROM object_text THEN 1 ELSE 0 END AS new FROM facts WINDOW w AS (PARTITION BY subject ORDER BY valid_from, seq)),
spans AS (SELECT subject, object_text, valid_from AS start, lead(valid_from) OVER (PARTITION BY subject ORDER BY valid_from, seq) AS "end", seq FROM marked WHERE new = 1)"""
RUNS = FACTS + ", " + SPANS_ONLY
SECONDS = "epoch(strptime({1}, '%Y-%m-%dT%H:%M:%S')) - epoch(strptime({0}, '%Y-%m-%dT%H:%M:%S'))"


def plan(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def seconds(a: str, b: str) -> str:
    return "CAST(" + SECONDS.format(a, b) + " AS BIGINT)"


def confirms_of(spark: SparkSession, d: str) -> DataFrame:
    """Answers to proposals: the labels of the documents with the facts' numbers."""
    f = tables.facts(spark, d).select(F.col("seq").alias("doc_id"), F.col("fact_id").alias("proposal"))
    return table(spark, d, "labels").join(f, "doc_id").select((F.col("doc_id") + 1000000).alias("seq"), "proposal", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("answer"))


def spans_of(spark: SparkSession, d: str) -> DataFrame:
    """The robots' mode intervals over all sources."""
    return intervals.history(tables.facts(spark, d), ["subject"]).select("subject", "object_text", "start", "end", "seq")


@plan(f"WITH {FACTS} SELECT fact_id, min(seq) AS seq FROM facts GROUP BY fact_id")
def log_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return state.first_said(tables.facts(spark, d)).select("fact_id", "seq")


@plan(f"WITH {CONFIRMS} SELECT fact_id, seq FROM facts WHERE fact_id NOT IN (SELECT proposal FROM confirms)")
def live_facts(spark: SparkSession, d: str) -> DataFrame:
    return state.live(tables.facts(spark, d), confirms_of(spark, d)).select("fact_id", "seq")


@plan(f"""WITH {CONFIRMS}, c AS (SELECT f.fact_id, f.subject, f.object_text, arg_max(c.answer, c.seq) AS answer, max(c.seq) AS seq FROM facts f JOIN confirms c ON f.fact_id = c.proposal AND c.seq > f.seq GROUP BY ALL)
SELECT fact_id, subject, object_text, 'stated' AS kind, 'confirm' AS source, seq FROM c WHERE answer = 'yes'""")
def stated_copies(spark: SparkSession, d: str) -> DataFrame:
    return state.stated_copies(tables.facts(spark, d), confirms_of(spark, d)).select("fact_id", "subject", "object_text", "kind", "source", "seq")


@plan(f"WITH {CONFIRMS} SELECT proposal, arg_min(answer, seq) AS first_answer, arg_max(answer, seq) AS latest_answer FROM confirms GROUP BY proposal")
def confirm_answers(spark: SparkSession, d: str) -> DataFrame:
    return confirms_of(spark, d).groupBy("proposal").agg(F.min_by("answer", "seq").alias("first_answer"), F.max_by("answer", "seq").alias("latest_answer"))


@plan(f"WITH {FACTS} SELECT kind, count(*) AS n, max(valid_from) AS latest FROM facts WHERE seq <= (SELECT max(seq) / 2 FROM facts) GROUP BY kind")
def as_of_seq(spark: SparkSession, d: str) -> DataFrame:
    f = tables.facts(spark, d)
    half = f.agg((F.max("seq") / 2).alias("half"))
    return f.join(F.broadcast(half), F.col("seq") <= F.col("half")).groupBy("kind").agg(F.count("*").alias("n"), F.max("valid_from").alias("latest"))  # one row


STATE = FACTS + f""", cur AS (SELECT *, CASE WHEN kind = 'inferred' THEN 0 ELSE 1 END AS kr FROM facts WHERE valid_from <= '{AT}'),
a AS (SELECT *, rank() OVER (PARTITION BY subject, predicate, source ORDER BY valid_from DESC) AS rk, min(seq) OVER (PARTITION BY subject, predicate, source) AS pos FROM cur),
b AS (SELECT *, max(kr) OVER (PARTITION BY subject, predicate) AS top FROM a WHERE rk = 1),
c AS (SELECT * FROM b WHERE kr = top), n AS (SELECT subject, predicate, count(DISTINCT object_text) AS n FROM c GROUP BY ALL),
e AS (SELECT c.*, n.n, row_number() OVER (PARTITION BY subject, predicate, object_text ORDER BY pos, seq) AS each, row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, seq DESC) AS win FROM c JOIN n USING (subject, predicate)),
fresh AS (SELECT source, max(t) FILTER (t <= '{AT}') AS last_seen FROM msgs GROUP BY source),
readings AS (SELECT e.subject, e.predicate, e.object_text, e.source, e.kind, e.seq, CASE WHEN n > 1 THEN 'ambiguous' WHEN coalesce({seconds('last_seen', f"'{AT}'")} > {STALE}, true) THEN 'stale' ELSE 'known' END AS state
  FROM e LEFT JOIN fresh USING (source) WHERE (n > 1 AND each = 1) OR (n = 1 AND win = 1))"""


def readings_of(spark: SparkSession, d: str) -> DataFrame:
    return state.readings(tables.facts(spark, d), tables.seen(spark, d), AT, STALE)


@plan(f"WITH {STATE} SELECT * FROM readings")
def state_at(spark: SparkSession, d: str) -> DataFrame:
    return readings_of(spark, d)


@plan(f"WITH {STATE} SELECT state, count(*) AS n, count(DISTINCT subject) AS subjects FROM readings GROUP BY state")
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return readings_of(spark, d).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


@plan(f"WITH {STATE} SELECT subject, string_agg(object_text, '; ' ORDER BY seq) AS candidates FROM readings WHERE state = 'ambiguous' GROUP BY subject")
def state_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "object_text"))), lambda x: x["object_text"]), "; ")
    return readings_of(spark, d).where("state = 'ambiguous'").groupBy("subject").agg(told.alias("candidates"))


@plan(f"WITH {STATE} SELECT subject, object_text, state FROM readings WHERE object_text = 'error'")
def find(spark: SparkSession, d: str) -> DataFrame:
    return readings_of(spark, d).where("object_text = 'error'").select("subject", "object_text", "state")


@plan(f"WITH {STATE}, x AS (SELECT DISTINCT r.subject, p.predicate FROM raw r, (VALUES ('mode'), ('health'), ('battery')) AS p(predicate)) SELECT subject, predicate, 'unknown' AS state FROM x WHERE (subject, predicate) NOT IN (SELECT subject, predicate FROM readings)")
def expected_unknown(spark: SparkSession, d: str) -> DataFrame:
    entities = tables.facts(spark, d).select("subject", F.split_part("subject", F.lit(":"), F.lit(1)).alias("type")).distinct()
    expected = spark.createDataFrame([("robot", p) for p in ("mode", "health", "battery")], "type string, predicate string")
    return state.expected_unknown(readings_of(spark, d), entities, expected)


@plan(f"WITH {MSGS} SELECT source, max(t) FILTER (t <= '{AT}') AS last_seen FROM msgs GROUP BY source")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return state.freshness(tables.seen(spark, d), AT)


@plan(f"WITH {MSGS}, g AS (SELECT source, t, lead(t) OVER (PARTITION BY source ORDER BY t) AS resumed FROM msgs) SELECT source, t AS silent_from, resumed, {seconds('t', 'resumed')} AS seconds FROM g WHERE {seconds('t', 'resumed')} > {STALE}")
def stale_gaps(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("source").orderBy("t")
    gaps = tables.seen(spark, d).withColumn("resumed", F.lead("t").over(w))
    return gaps.withColumn("seconds", seconds_between(F.col("t"), F.col("resumed"))).where(F.col("seconds") > STALE).withColumnRenamed("t", "silent_from")


@plan(f"""WITH {FACTS}, m AS (SELECT *, CASE WHEN lag(object_text) OVER w IS DISTINCT FROM object_text THEN 1 ELSE 0 END AS new FROM facts WINDOW w AS (PARTITION BY subject, source ORDER BY valid_from, seq))
SELECT subject, source, object_text, valid_from AS start, lead(valid_from) OVER (PARTITION BY subject, source ORDER BY valid_from, seq) AS "end", seq FROM m WHERE new = 1""")
def history_intervals(spark: SparkSession, d: str) -> DataFrame:
    return intervals.history(tables.facts(spark, d), ["subject", "source"]).select("subject", "source", "object_text", "start", "end", "seq")


@plan(f"""WITH {MSGS}, m AS (SELECT *, row_number() OVER w AS n, lag(mode) OVER w AS before FROM msgs WINDOW w AS (PARTITION BY subject, source ORDER BY t, seq)) SELECT subject, source, seq, mode FROM m WHERE n = 1 OR mode IS DISTINCT FROM before""")
def change_only_feed(spark: SparkSession, d: str) -> DataFrame:
    return intervals.change_only(tables.messages(spark, d), ["subject", "source"], ["t", "seq"], "mode").select("subject", "source", "seq", "mode")


@plan(f"WITH {MSGS} SELECT subject, mode, min(seq) AS first_seq FROM msgs GROUP BY subject, mode")
def first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).groupBy("subject", "mode").agg(F.min("seq").alias("first_seq"))


@plan(f"""WITH {RUNS} SELECT * FROM spans WHERE start <= '{AT}' AND ("end" IS NULL OR "end" > '{SINCE}')""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return spans_of(spark, d).where((F.col("start") <= AT) & (F.col("end").isNull() | (F.col("end") > SINCE)))


@plan(f"""WITH {RUNS} SELECT * FROM spans WHERE start > '{SINCE}' AND start <= '{AT}'""")
def diff_window(spark: SparkSession, d: str) -> DataFrame:
    return spans_of(spark, d).where((F.col("start") > SINCE) & (F.col("start") <= AT))


@plan(f"""WITH {RUNS} SELECT subject, seq, object_text, lag(object_text) OVER w AS replaced, lead(object_text) OVER w AS replaced_by FROM spans WINDOW w AS (PARTITION BY subject ORDER BY start, seq)""")
def why_neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("subject").orderBy("start", "seq")
    return spans_of(spark, d).select("subject", "seq", "object_text", F.lag("object_text").over(w).alias("replaced"), F.lead("object_text").over(w).alias("replaced_by"))


@plan(f"""WITH {RUNS}, x AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n, row_number() OVER (PARTITION BY subject ORDER BY start, seq) AS up, row_number() OVER (PARTITION BY subject ORDER BY start DESC, seq DESC) AS down FROM spans)
SELECT subject, n, seq, start, object_text FROM x WHERE n <= 3 OR up = 1 OR down = 1""")
def series_ends(spark: SparkSession, d: str) -> DataFrame:
    up, down = W.partitionBy("subject").orderBy("start", "seq"), W.partitionBy("subject").orderBy(F.desc("start"), F.desc("seq"))
    numbered = spans_of(spark, d).withColumns({"n": F.count("*").over(W.partitionBy("subject")), "up": F.row_number().over(up), "down": F.row_number().over(down)})
    return numbered.where("n <= 3 OR up = 1 OR down = 1").select("subject", "n", "seq", "start", "object_text")


@plan(f"""WITH {FACTS} SELECT seq, subject, object_text, kind FROM facts WHERE seq > 500 ORDER BY seq LIMIT 200""")
def changes_since(spark: SparkSession, d: str) -> DataFrame:
    return tables.facts(spark, d).where("seq > 500").orderBy("seq").limit(200).select("seq", "subject", "object_text", "kind")


@plan(f"WITH {CONFIRMS} SELECT kind, count(*) AS n FROM facts WHERE kind = 'inferred' AND fact_id NOT IN (SELECT proposal FROM confirms) GROUP BY kind")
def pending(spark: SparkSession, d: str) -> DataFrame:
    return state.live(tables.facts(spark, d), confirms_of(spark, d)).where("kind = 'inferred'").groupBy("kind").agg(F.count("*").alias("n"))


@plan(f"WITH {MSGS} SELECT max(t) AS clock FROM msgs")
def site_clock(spark: SparkSession, d: str) -> DataFrame:
    return tables.seen(spark, d).agg(F.max("t").alias("clock"))


@plan(f"""WITH {RUNS}, ends AS (SELECT subject, start, "end", object_text FROM spans WHERE object_text IN ('error', 'signup') AND "end" IS NOT NULL)
SELECT subject, start, "end", object_text AS cause, {seconds('start', '"end"')} AS seconds FROM ends""")
def downtime(spark: SparkSession, d: str) -> DataFrame:
    down = spans_of(spark, d).where(F.arrays_overlap(tokens(F.col("object_text")), F.array(*map(F.lit, WAITING))) & F.col("end").isNotNull())
    return down.select("subject", "start", "end", F.col("object_text").alias("cause"), seconds_between(F.col("start"), F.col("end")).alias("seconds"))


@plan(f"""WITH {RUNS} SELECT subject, object_text AS mode, CAST(sum({seconds('start', '"end"')}) AS BIGINT) AS seconds, count(*) AS n FROM spans WHERE "end" IS NOT NULL GROUP BY ALL""")
def utilisation(spark: SparkSession, d: str) -> DataFrame:
    ended = spans_of(spark, d).where(F.col("end").isNotNull())
    return ended.groupBy("subject", F.col("object_text").alias("mode")).agg(F.sum(seconds_between(F.col("start"), F.col("end"))).alias("seconds"), F.count("*").alias("n"))


CLOCKED = f"""WITH {RUNS}, s AS (SELECT spans.subject, spans.object_text AS mode, spans.start, spans."end", coalesce(spans."end", (SELECT max(t) FROM msgs)) AS until, facts.source FROM spans JOIN facts ON facts.seq = spans.seq)"""


def clocked_spans(spark: SparkSession, d: str) -> DataFrame:
    """The robots' mode intervals with their sources; ``until`` is the site's clock where an interval is open."""
    clock = tables.seen(spark, d).agg(F.max("t").alias("clock"))  # one row
    spans = intervals.history(tables.facts(spark, d), ["subject"]).join(F.broadcast(clock))
    return spans.select("subject", F.col("object_text").alias("mode"), "start", "end", F.coalesce("end", "clock").alias("until"), "source")


@plan(f"""{CLOCKED} SELECT subject, start, "end", mode, {seconds('start', 'until')} AS seconds FROM s WHERE mode IN ('error', 'signup')""")
def downtime_to_clock(spark: SparkSession, d: str) -> DataFrame:
    """Downtime with the current interval, which has no end and counts up to the clock."""
    down = clocked_spans(spark, d).where(F.arrays_overlap(tokens(F.col("mode")), F.array(*map(F.lit, WAITING))))
    return down.select("subject", "start", "end", "mode", seconds_between(F.col("start"), F.col("until")).alias("seconds"))


@plan(f"""{CLOCKED}, o AS (SELECT source, t, CASE WHEN coalesce({seconds('lag(t) OVER w', 't')} > {STALE}, true) THEN 1 ELSE 0 END AS opened FROM msgs WINDOW w AS (PARTITION BY source ORDER BY t)),
n AS (SELECT source, t, sum(opened) OVER (PARTITION BY source ORDER BY t) AS no FROM o), p AS (SELECT source, min(t) AS a, max(t) AS b FROM n GROUP BY source, no)
SELECT s.subject, s.mode, CAST(sum(CASE WHEN p.a IS NULL THEN 0 ELSE {seconds('greatest(s.start, p.a)', 'least(s.until, p.b)')} END) AS BIGINT) AS seconds FROM s LEFT JOIN p ON p.source = s.source AND p.a < s.until AND p.b > s.start GROUP BY ALL""")
def utilisation_reported(spark: SparkSession, d: str) -> DataFrame:
    """Seconds by mode up to the clock in which the interval's source kept reporting."""
    spans = clocked_spans(spark, d).select("subject", "mode", "start", F.col("until").alias("end"), "source")
    periods = intervals.sessions(tables.seen(spark, d), ["source"], "t", STALE).select("source", F.col("start").alias("start2"), F.col("end").alias("end2"))
    both = intervals.overlap_join(spans, F.broadcast(periods), ["source"], DAY).select("subject", "mode", seconds_between(F.greatest("start", "start2"), F.least("end", "end2")).alias("seconds"))
    none = spans.select("subject", "mode", F.lit(0).cast("long").alias("seconds"))
    return both.unionByName(none).groupBy("subject", "mode").agg(F.sum("seconds").alias("seconds"))


HEALTH_ONLY = """h AS (SELECT seq, subject, t, CASE WHEN mode = 'error' THEN 'fault:error' ELSE 'ok' END AS health FROM msgs),
hm AS (SELECT *, CASE WHEN lag(health) OVER (PARTITION BY subject ORDER BY t, seq) IS DISTINCT FROM health THEN 1 ELSE 0 END AS new FROM h),
hs AS (SELECT subject, health, t AS start, lead(t) OVER (PARTITION BY subject ORDER BY t, seq) AS "end", seq FROM hm WHERE new = 1)"""
HEALTH = MSGS + ", " + HEALTH_ONLY


def health_of(spark: SparkSession, d: str) -> DataFrame:
    health = F.when(F.col("mode") == "error", "fault:error").otherwise("ok")
    rows = tables.messages(spark, d).select("seq", "subject", F.col("t").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), health.alias("health"))
    return intervals.history(rows, ["subject"], "health")


@plan(f"""WITH {HEALTH} SELECT subject, start, "end" AS cleared, {seconds('start', '"end"')} AS seconds FROM hs WHERE health LIKE 'fault:%'""")
def fault_clear_time(spark: SparkSession, d: str) -> DataFrame:
    return health_of(spark, d).where("health LIKE 'fault:%'").select("subject", "start", F.col("end").alias("cleared"), seconds_between(F.col("start"), F.col("end")).alias("seconds"))


@plan(f"""WITH {RUNS} SELECT object_text, min(start) AS first_start, arg_min(seq, (start, seq)) AS seq FROM spans GROUP BY object_text""")
def sql_bare_column(spark: SparkSession, d: str) -> DataFrame:
    return spans_of(spark, d).groupBy("object_text").agg(F.min("start").alias("first_start"), F.min_by("seq", F.struct("start", "seq")).alias("seq"))


@plan(f"""WITH {MSGS}, o AS (SELECT source, t, CASE WHEN coalesce({seconds('lag(t) OVER w', 't')} > 900, true) THEN 1 ELSE 0 END AS opened FROM msgs WINDOW w AS (PARTITION BY source ORDER BY t)),
n AS (SELECT source, t, sum(opened) OVER (PARTITION BY source ORDER BY t) AS no FROM o) SELECT source, min(t) AS start, max(t) AS "end", count(*) AS n FROM n GROUP BY source, no""")
def observed_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.sessions(tables.seen(spark, d), ["source"], "t", 900)


@plan(f"""WITH {MSGS}, g AS (SELECT subject, sum(CASE WHEN mode = 'error' AND value > 50 THEN 1 ELSE 0 END) AS with_n, sum(CASE WHEN mode = 'error' AND value <= 50 THEN 1 ELSE 0 END) AS without_n,
  sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS with_all, sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS without_all FROM msgs GROUP BY subject)
SELECT subject, CAST(with_n AS BIGINT) AS with_n, CAST(without_n AS BIGINT) AS without_n, CASE WHEN with_all = 0 OR without_all = 0 OR without_n = 0 THEN NULL ELSE round((with_n / with_all) / (without_n / without_all), 6) END AS ratio,
  CASE WHEN with_n + without_n < 5 THEN 'too few' WHEN with_all = 0 OR without_all = 0 OR without_n = 0 THEN 'undecided' WHEN (with_n / with_all) >= 1.5 * (without_n / without_all) THEN 'supported' ELSE 'not supported' END AS verdict FROM g""")
def rate_when(spark: SparkSession, d: str) -> DataFrame:
    fault, high = F.col("mode") == "error", F.col("value") > 50
    n = lambda c: F.sum(c.cast("long"))
    g = tables.messages(spark, d).groupBy("subject").agg(n(fault & high).alias("with_n"), n(fault & ~high).alias("without_n"), n(high).alias("with_all"), n(~high).alias("without_all"))
    a, b = F.col("with_n") / F.col("with_all"), F.col("without_n") / F.col("without_all")
    none = F.expr("with_all = 0 OR without_all = 0 OR without_n = 0")
    verdict = F.when(F.col("with_n") + F.col("without_n") < 5, "too few").when(none, "undecided").when(a >= 1.5 * b, "supported").otherwise("not supported")
    return g.select("subject", "with_n", "without_n", F.when(~none, F.round(a / b, 6)).alias("ratio"), verdict.alias("verdict"))


@plan(f"""WITH {MSGS}, g AS (SELECT subject, sum(CASE WHEN t < '{AT}' AND mode = 'error' THEN 1 ELSE 0 END) AS before_n, sum(CASE WHEN t >= '{AT}' AND mode = 'error' THEN 1 ELSE 0 END) AS after_n FROM msgs GROUP BY subject)
SELECT CASE WHEN after_n < before_n THEN 'fewer' WHEN after_n > before_n THEN 'more' ELSE 'same' END AS verdict, count(*) AS n FROM g GROUP BY ALL""")
def before_after(spark: SparkSession, d: str) -> DataFrame:
    fault, early = F.col("mode") == "error", F.col("t") < AT
    g = tables.messages(spark, d).groupBy("subject").agg(F.sum((fault & early).cast("long")).alias("b"), F.sum((fault & ~early).cast("long")).alias("a"))
    return g.groupBy(F.when(F.col("a") < F.col("b"), "fewer").when(F.col("a") > F.col("b"), "more").otherwise("same").alias("verdict")).agg(F.count("*").alias("n"))


@plan(f"""WITH {RUNS}, f AS (SELECT seq, subject, start FROM spans WHERE object_text = 'error'), c AS (SELECT seq, subject, start, object_text FROM spans WHERE object_text <> 'error')
SELECT f.seq, f.subject, f.start, (SELECT arg_max(c.object_text, (c.start, c.seq)) FROM c WHERE c.subject = f.subject AND c.start < f.start AND c.start >= strftime(strptime(f.start, '%Y-%m-%dT%H:%M:%S') - INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%S')) AS change FROM f""")
def change_before_fault(spark: SparkSession, d: str) -> DataFrame:
    spans = spans_of(spark, d)
    w = W.partitionBy("subject").orderBy("start", "seq").rowsBetween(W.unboundedPreceding, -1)
    other = F.when(F.col("object_text") != "error", F.struct("start", "object_text"))
    # Changes of the same second are not before the fault: the first row of a second has seen only earlier ones.
    second = W.partitionBy("subject", "start").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    last = spans.withColumn("last", F.last(other, ignorenulls=True).over(w)).withColumn("last", F.first("last").over(second)).where("object_text = 'error'")
    recent = (F.col("last.start") < F.col("start")) & (F.col("last.start") >= shifted(F.col("start"), -DAY))
    return last.select("seq", "subject", "start", F.when(recent, F.col("last.object_text")).alias("change"))


@plan(f"""WITH {RUNS}, s AS (SELECT spans.subject, spans.start, spans.object_text, facts.fact_id FROM spans JOIN facts ON facts.seq = spans.seq)
SELECT f.subject, f.start AS valid_from, 'mode became ' || c.object_text || ' before fault:error' AS text, c.fact_id AS change_id, f.fact_id AS fault_id
FROM s f JOIN s c ON c.subject = f.subject AND c.start < f.start AND c.start >= strftime(strptime(f.start, '%Y-%m-%dT%H:%M:%S') - INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%S') WHERE f.object_text = 'error' AND c.object_text <> 'error'""")
def changes_before_fault(spark: SparkSession, d: str) -> DataFrame:
    """Every change in the day before a fault; ``change_before_fault`` gives the latest one only."""
    spans, fault = intervals.history(tables.facts(spark, d), ["subject"]), F.col("object_text") == "error"
    faults = spans.where(fault).withColumns({"predicate": F.lit("health"), "object_text": F.lit("fault:error")})
    found = insights.change_before_fault(faults, spans.where(~fault))
    return found.select("subject", "valid_from", "text", F.col("because")[0].alias("change_id"), F.col("because")[1].alias("fault_id"))


@plan(f"""WITH {RUNS}, b AS (SELECT subject, start, "end" FROM spans WHERE object_text = 'view' AND "end" IS NOT NULL), {HEALTH_ONLY}, k AS (SELECT subject, start, "end" FROM hs WHERE health = 'ok' AND "end" IS NOT NULL)
SELECT b.subject, count(*) AS pairs, CAST(sum({seconds('greatest(b.start, k.start)', 'least(b."end", k."end")')}) AS BIGINT) AS seconds FROM b JOIN k ON b.subject = k.subject AND b.start < k."end" AND b."end" > k.start GROUP BY b.subject""")
def mode_while_healthy(spark: SparkSession, d: str) -> DataFrame:
    ended = F.col("end").isNotNull()
    busy = spans_of(spark, d).where((F.col("object_text") == "view") & ended).select("subject", "start", "end")
    ok = health_of(spark, d).where((F.col("health") == "ok") & ended).select("subject", F.col("start").alias("start2"), F.col("end").alias("end2"))
    pairs = intervals.overlap_join(busy, ok, ["subject"], DAY)
    return pairs.groupBy("subject").agg(F.count("*").alias("pairs"), F.sum(seconds_between(F.greatest("start", "start2"), F.least("end", "end2"))).alias("seconds"))


@plan(f"""WITH {MSGS} SELECT p.seq, p.subject, (SELECT arg_max(e.value, (e.t, e.seq)) FROM msgs e WHERE e.mode = 'view' AND e.subject = p.subject AND e.t <= p.t) AS last_view FROM msgs p WHERE p.mode = 'purchase'""")
def asof_join(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    views = m.where("mode = 'view'").groupBy("subject", "t").agg(F.max_by("value", "seq").alias("v"))
    return intervals.asof_join(m.where("mode = 'purchase'").select("seq", "subject", "t"), views, ["subject"], "t", "t", "v", "last_view").select("seq", "subject", "last_view")


@plan(f"""WITH {MSGS}, x AS (SELECT seq, subject, t, mode, lead(t) OVER w AS nt, lead(mode) OVER w AS nm FROM msgs WINDOW w AS (PARTITION BY subject ORDER BY t, seq))
SELECT seq, subject, CASE WHEN nt IS NOT NULL AND {seconds('t', 'nt')} <= 7200 THEN nm ELSE 'not observed' END AS outcome FROM x WHERE mode = 'purchase'""")
def outcome(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("subject").orderBy("t", "seq")
    following = tables.messages(spark, d).withColumns({"nt": F.lead("t").over(w), "nm": F.lead("mode").over(w)}).where("mode = 'purchase'")
    return following.select("seq", "subject", F.when(seconds_between(F.col("t"), F.col("nt")) <= 7200, F.col("nm")).otherwise("not observed").alias("outcome"))


@plan(f"""WITH {FACTS} SELECT subject, count(*) FILTER (kind = 'inferred') AS inferred, count(*) FILTER (kind = 'observed') AS observed FROM facts GROUP BY subject""")
def coverage_by_class(spark: SparkSession, d: str) -> DataFrame:
    return tables.facts(spark, d).groupBy("subject").pivot("kind", ["inferred", "observed"]).agg(F.count("seq")).na.fill(0)


@plan(f"""WITH {FACTS} SELECT source, count(*) AS n, count(*) FILTER (kind = 'inferred') AS n_inferred, count(DISTINCT subject) AS subjects, max(valid_from) AS latest FROM facts GROUP BY source""")
def source_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tables.facts(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "inferred").alias("n_inferred"), F.count_distinct("subject").alias("subjects"), F.max("valid_from").alias("latest"))


@plan("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def listagg_names(spark: SparkSession, d: str) -> DataFrame:
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "; ")
    return table(spark, d, "nation").groupBy("n_regionkey").agg(told.alias("names"))


@plan(f"""WITH {MSGS} SELECT seq, CASE WHEN mode = 'error' THEN 'fault' WHEN regexp_matches(mode, 'sign') THEN 'warn' WHEN mode IN ('view', 'click') THEN 'idle' ELSE 'ok' END AS status FROM msgs""")
def status_class(spark: SparkSession, d: str) -> DataFrame:
    mode = F.col("mode")
    status = F.when(mode.rlike("^error$"), "fault").when(mode.rlike("sign"), "warn").when(mode.isin("view", "click"), "idle").otherwise("ok")
    return tables.messages(spark, d).select("seq", status.alias("status"))


@plan(f"""WITH {MSGS}, n AS (SELECT substr(t, 1, 10) AS run, mode, count(*) AS n FROM msgs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC, mode) AS rank FROM n),
l AS (SELECT *, lag(rank) OVER (PARTITION BY mode ORDER BY run) AS before FROM r)
SELECT run, mode, CAST(rank AS INTEGER) AS rank, CASE WHEN before IS NULL THEN 'new' WHEN before > rank THEN 'up ' || (before - rank) WHEN before < rank THEN 'down ' || (rank - before) ELSE 'same' END AS moved FROM l""")
def rank_movement(spark: SparkSession, d: str) -> DataFrame:
    n = tables.messages(spark, d).groupBy(F.substring("t", 1, 10).alias("run"), "mode").agg(F.count("*").alias("n"))
    ranked = n.withColumn("rank", F.row_number().over(W.partitionBy("run").orderBy(F.desc("n"), "mode"))).withColumn("before", F.lag("rank").over(W.partitionBy("mode").orderBy("run")))
    by = F.col("before") - F.col("rank")
    moved = F.when(F.col("before").isNull(), "new").when(by > 0, F.concat(F.lit("up "), by)).when(by < 0, F.concat(F.lit("down "), -by)).otherwise("same")
    return ranked.select("run", "mode", "rank", moved.alias("moved"))


@plan("SELECT event_id, '/k' AS pointer, json_extract_string(props, '$.k') AS value FROM events")
def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    return files.json_leaves(table(spark, d, "events"), "event_id", "props")


@plan("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events")
def feed_decode(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d).select("t", F.col("seq").alias("source"), F.lit("").alias("topic"), F.col("props").alias("payload"))
    return mapping.decode(m, "json", {"k": "k"}).select(F.col("source").alias("event_id"), "t", "name", "value")


@plan("SELECT c_custkey, 'customer:' || lower(replace(replace(c_name, '#', '-'), ' ', '-')) AS subject, CASE WHEN lower(c_mktsegment) LIKE '%machin%' THEN 'machine' WHEN lower(c_mktsegment) LIKE '%house%' THEN 'place' END || ':' || lower(c_mktsegment) AS segment FROM customer")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    kinds = [("machin", "machine"), ("house", "place")]
    return table(spark, d, "customer").select("c_custkey", compile_template("customer:{c_name|slug}").alias("subject"), compile_template("{c_mktsegment|type}:{c_mktsegment|lower}", kinds).alias("segment"))


@plan("SELECT p_partkey AS \"row\", 'part:' || p_partkey AS subject, w AS object_text FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE trim(w) <> ''")
def split_items(spark: SparkSession, d: str) -> DataFrame:
    spec = mapping.FactSpec("part:{p_partkey}", "named", "p_name", split=" ")
    return mapping.map_table(table(spark, d, "part"), [spec], "p_partkey", "parts", F.lit(None).cast("string")).select("row", "subject", "object_text")


@plan("SELECT o_orderkey AS \"row\", 'customer:' || o_custkey AS subject, 'priority' AS predicate, o_orderpriority AS object_text FROM orders UNION ALL SELECT o_orderkey, 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey FROM orders")
def table_facts(spark: SparkSession, d: str) -> DataFrame:
    specs = [mapping.FactSpec("customer:{o_custkey}", "priority", "o_orderpriority"), mapping.FactSpec("order:{o_orderkey}", "placed_by", "o_custkey", ref="customer:{o_custkey}")]
    return mapping.map_table(table(spark, d, "orders"), specs, "o_orderkey", "orders", F.lit(None).cast("string")).select("row", "subject", "predicate", "object_text")


@plan("SELECT lower(p_type) AS value, min(p_partkey) AS \"row\" FROM part GROUP BY 1")
def once_first(spark: SparkSession, d: str) -> DataFrame:
    spec = mapping.FactSpec("part:{p_partkey}", "kind", "p_type", once=True)
    return mapping.map_table(table(spark, d, "part"), [spec], "p_partkey", "parts", F.lit(None).cast("string")).select(F.lower("object_text").alias("value"), "row")


@plan("SELECT p.page_id FROM pages p WHERE trim(coalesce(url, '')) = '' AND trim(coalesce(html, '')) = ''")
def unmapped_rows(spark: SparkSession, d: str) -> DataFrame:
    return mapping.unmapped(table(spark, d, "pages"), ["url", "html"], "page_id")


@plan("SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'english' WHEN url LIKE '%/fr/%' THEN 'french' WHEN url LIKE 'http%' THEN 'web' END AS topic FROM pages")
def glob_rules(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", mapping.first_match(pages, "url", [("*/en/*", "english"), ("*/fr/*", "french"), ("http*", "web")]).alias("topic"))


EDGES = """edges AS (SELECT 'region:' || n_regionkey AS subject, 'feeds' AS predicate, 'nation:' || n_nationkey AS object_text FROM nation UNION ALL
SELECT 'nation:' || s_nationkey, 'feeds', 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'part_of', 'nation:' || c_nationkey FROM customer)"""


@plan(f"""WITH RECURSIVE {EDGES}, dir AS (SELECT CASE WHEN predicate = 'feeds' THEN subject ELSE object_text END AS a, CASE WHEN predicate = 'feeds' THEN object_text ELSE subject END AS b FROM edges),
w AS (SELECT 'region:' || r_regionkey AS root, 'region:' || r_regionkey AS id, 0 AS d FROM region UNION SELECT w.root, dir.b, w.d + 1 FROM w JOIN dir ON dir.a = w.id WHERE w.d < 3)
SELECT root, id, min(d) AS d FROM w WHERE d > 0 GROUP BY root, id""")
def topology_downstream(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("root"))
    return graph.downstream(graph.directed(tables.topology(spark, d)), roots, 3).select("root", "id", "d")


@plan(f"""WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM edges UNION ALL SELECT object_text FROM edges) GROUP BY id""")
def graph_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree(tables.topology(spark, d))


@plan(f"""WITH {EDGES}, s AS (SELECT e.object_text AS nation, split_part(x.object_text, ':', 1) AS kind FROM edges e JOIN edges x ON x.subject = e.object_text WHERE e.predicate = 'feeds' AND e.subject LIKE 'region:%'),
c AS (SELECT e.object_text AS nation, 'customer' AS kind FROM edges e WHERE predicate = 'part_of') SELECT nation, kind, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT * FROM c) GROUP BY ALL""")
def impact(spark: SparkSession, d: str) -> DataFrame:
    e = graph.directed(tables.topology(spark, d)).select("a", "b")
    return e.where("a LIKE 'nation:%'").groupBy(F.col("a").alias("nation"), F.split_part("b", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


COPIES = """d AS (SELECT doc_id, source, md5(text) AS h, md5(string_split(text, chr(10))[1]) AS l FROM documents)"""


@plan(f"""WITH RECURSIVE {COPIES}, e AS (SELECT doc_id AS b, min(doc_id) OVER (PARTITION BY h) AS a FROM d UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY l) FROM d),
two AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT DISTINCT a AS id, a AS root FROM two UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.id)
SELECT id, min(root) AS root FROM r GROUP BY id""")
def components_same_as(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), F.md5(F.split("text", "\n")[0]).alias("l"))
    star = lambda key: docs.join(docs.groupBy(key).agg(F.min("doc_id").alias("a")), key).select("a", F.col("doc_id").alias("b"))
    return graph.components(star("h").unionByName(star("l")), "same-as")


@plan(f"""WITH {COPIES}, f AS (SELECT h, min(doc_id) AS first_id, arg_min(source, doc_id) AS first_source FROM d GROUP BY h) SELECT f.first_id, d.doc_id FROM d JOIN f USING (h) WHERE d.doc_id > f.first_id AND d.source <> f.first_source""")
def identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min(F.struct("doc_id", "source")).alias("f"))
    return docs.join(first, "h").where((F.col("doc_id") > F.col("f.doc_id")) & (F.col("source") != F.col("f.source"))).select(F.col("f.doc_id").alias("first_id"), "doc_id")


@plan(f"""WITH {COPIES}, r AS (SELECT h, source, min(doc_id) AS first_id FROM d GROUP BY h, source)
SELECT a.first_id, b.first_id AS doc_id, 'pair' AS link FROM r a JOIN r b ON a.h = b.h AND a.source <> b.source AND a.first_id < b.first_id
UNION ALL SELECT r.first_id, d.doc_id, 'member' FROM d JOIN r ON d.h = r.h AND d.source = r.source WHERE d.doc_id <> r.first_id AND EXISTS (SELECT 1 FROM r o WHERE o.h = r.h AND o.source <> r.source)""")
def identity_links(spark: SparkSession, d: str) -> DataFrame:
    """Copies in different sources: pairs of the first document of each source, and which documents each of these stands for."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    first = docs.groupBy("h", "source").agg(F.min("doc_id").alias("first_id")).where("h IS NOT NULL AND source IS NOT NULL")
    other = first.select("h", F.col("source").alias("source2"), F.col("first_id").alias("doc_id"))
    both = first.join(other, "h").where("source <> source2")
    crossing = both.select("h", "source", "first_id").distinct()
    members = docs.join(crossing, ["h", "source"]).where("doc_id <> first_id")
    return both.where("first_id < doc_id").select("first_id", "doc_id", F.lit("pair").alias("link")).unionByName(members.select("first_id", "doc_id", F.lit("member").alias("link")))


@plan("""WITH x AS (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7 AS score FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version'))
SELECT doc_id, CAST(score AS INTEGER) AS score FROM x ORDER BY score DESC, doc_id LIMIT 20""")
def search_evidence(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    hits = table(spark, d, "documents").where(F.forall(F.array(F.lit("license"), F.lit("version")), lambda w: F.contains(low, w)))
    score = ((F.length(low) - F.length(F.replace(low, F.lit("license"), F.lit("")))) / 7).cast("int")
    return hits.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@plan("SELECT doc_id, source FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])(mit license|apache license)([^a-z0-9_]|$)')")
def word_mention(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").rlike(r"(?:^|[^a-z0-9_])(?:mit license|apache license)(?:[^a-z0-9_]|$)")).select("doc_id", "source")


@plan("SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, md5(l[i]) AS hash FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "l")).select("doc_id", "position", F.md5("l").alias("hash"))


@plan("SELECT c_nationkey, c_mktsegment AS stem, count(*) AS n FROM customer GROUP BY ALL")
def shared_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("stem")).agg(F.count("*").alias("n"))


@plan("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def dangling_reference(spark: SparkSession, d: str) -> DataFrame:
    return checks.dangling(table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), table(spark, d, "orders"), "l_orderkey", "o_orderkey")


@plan("WITH s AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS stated FROM orders), f AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, stated, coalesce(n, 0) AS found FROM s LEFT JOIN f ON o_orderkey = l_orderkey WHERE stated <> coalesce(n, 0)")
def count_mismatch(spark: SparkSession, d: str) -> DataFrame:
    declared = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("stated"))
    return checks.count_mismatch(declared, table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "stated")


@plan("SELECT source, md5(text) AS h, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_id(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(table(spark, d, "documents").select("source", F.md5("text").alias("h")), ["source", "h"])


@plan("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_values, min(c_mktsegment) AS low, max(c_mktsegment) AS high FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def id_conflict(spark: SparkSession, d: str) -> DataFrame:
    return checks.conflicts(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment")


@plan("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate")
def interval_reversed(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return checks.reversed_intervals(both, "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "l_partkey")


@plan("WITH x AS (SELECT source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT source, 'quality' AS field, count(*) AS n FROM x WHERE quality IS NULL GROUP BY 1 UNION ALL SELECT source, 'toxic', count(*) FROM x WHERE toxic IS NULL GROUP BY 1")
def missing_metadata(spark: SparkSession, d: str) -> DataFrame:
    return checks.missing(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "source", ["quality", "toxic"])


@plan("SELECT user_id, event_id, value, before FROM (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) WHERE value < before")
def time_regression(spark: SparkSession, d: str) -> DataFrame:
    return checks.regressions(table(spark, d, "events"), ["user_id"], "event_id", "value").select("user_id", "event_id", "value", "before")


@plan("SELECT event_id FROM (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE ts <= before")
def series_order_check(spark: SparkSession, d: str) -> DataFrame:
    return checks.not_rising(table(spark, d, "events"), ["user_id"], "event_id", "ts").select("event_id")


@plan("SELECT l_returnflag, CAST(count(*) FILTER (l_quantity < 3) AS BIGINT) AS below, CAST(count(*) FILTER (l_quantity > 48) AS BIGINT) AS above FROM lineitem GROUP BY 1 HAVING below > 0 OR above > 0")
def limit_exceeded(spark: SparkSession, d: str) -> DataFrame:
    return checks.limits(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", F.lit(3), F.lit(48))


@plan(f"""WITH {MSGS}, r AS (SELECT subject, min(t) AS start, max(t) AS "end" FROM msgs WHERE mode = 'click' GROUP BY 1), w AS (SELECT subject, min(t) AS first, max(t) AS last FROM msgs WHERE mode = 'view' GROUP BY 1)
SELECT r.subject, start, "end" FROM r JOIN w USING (subject) WHERE start > last OR "end" < first""")
def calibration_window(spark: SparkSession, d: str) -> DataFrame:
    m = tables.messages(spark, d)
    runs = m.where("mode = 'click'").groupBy("subject").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    windows = m.where("mode = 'view'").groupBy("subject").agg(F.min("t").alias("since"), F.max("t").alias("until"))
    return checks.outside_windows(runs, windows, ["subject"]).select("subject", "start", "end")


@plan("WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS was FROM orders), b AS (SELECT l_orderkey AS k, min(l_linestatus) AS now FROM lineitem GROUP BY 1) SELECT k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN was = now THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b USING (k)")
def ledger_diff(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_linestatus").alias("s"))
    return checks.ledger_diff(old, new, "k", "s")


@plan(f"""WITH {MSGS}, c AS (SELECT source, count(*) AS frames FROM msgs WHERE t BETWEEN '{SINCE}' AND '{AT}' GROUP BY 1) SELECT source, frames, sum(frames) OVER (ORDER BY source) <= 200 AS covered FROM c""")
def media_window(spark: SparkSession, d: str) -> DataFrame:
    return series.media_window(tables.messages(spark, d), "source", "t", SINCE, AT, 200)


@plan("SELECT round(regr_slope(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events), event_id) / 1e6, 3) AS slope, count(*) AS n FROM events")
def clock_fit(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    _, slope, n = series.fit_clock(pairs, "event_id", "us")
    return spark.createDataFrame([(round(float(slope) / 1e6, 3), n)], "slope double, n long")


@plan("SELECT r_name, n_name, count(s_suppkey) AS suppliers, CASE WHEN count(s_suppkey) > 1 THEN 'ambiguous' WHEN count(s_suppkey) = 1 THEN 'known' ELSE 'unknown' END AS state FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def run_contents(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    n = F.count("s_suppkey")
    return joined.groupBy("r_name", "n_name").agg(n.alias("suppliers"), F.when(n > 1, "ambiguous").when(n == 1, "known").otherwise("unknown").alias("state"))


@plan("""WITH c AS (SELECT p_partkey, unnest([{'s': 'ring', 'w': CASE WHEN p_name LIKE '%ring' THEN 9 ELSE 0 END}, {'s': 'widget', 'w': CASE WHEN p_name LIKE '%widget' THEN 9 ELSE 0 END}, {'s': 'small', 'w': CASE WHEN p_name LIKE 'small%' THEN 8 ELSE 0 END}, {'s': 'red', 'w': CASE WHEN p_name LIKE 'red%' THEN 9 ELSE 0 END}]) AS c FROM part),
m AS (SELECT p_partkey, max(c.w) AS w FROM c WHERE c.w > 0 GROUP BY 1)
SELECT m.p_partkey, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE min(c.s) END AS semantic FROM m JOIN (SELECT p_partkey, c FROM c) c ON c.p_partkey = m.p_partkey AND c.c.w = m.w GROUP BY 1""".replace("min(c.s)", "min(c.c.s)"))
def semantic_pick(spark: SparkSession, d: str) -> DataFrame:
    rules = [("ring", "%ring", 9), ("widget", "%widget", 9), ("small", "small%", 8), ("red", "red%", 9)]
    fits = F.filter(F.array(*[F.struct(F.when(F.col("p_name").like(p), w).otherwise(0).alias("w"), F.lit(s).alias("s")) for s, p, w in rules]), lambda x: x["w"] > 0)
    best = F.filter("c", lambda x: x["w"] == F.array_max("c")["w"])
    return table(spark, d, "part").withColumn("c", fits).where(F.size("c") > 0).select("p_partkey", F.when(F.size(best) > 1, "ambiguous").otherwise(best[0]["s"]).alias("semantic"))


@plan("SELECT o_custkey, round(greatest(0.01, round(1 - exp(sum(ln(1 - 0.1 * (1 + o_orderkey % 5)))) + 1e-9, 4)), 4) AS score FROM orders GROUP BY 1")
def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    weight = 0.1 * (1 + F.col("o_orderkey") % 5)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.greatest(F.lit(0.01), F.round(1 - F.exp(F.sum(F.ln(1 - weight))) + 1e-9, 4)), 4).alias("score"))


@plan("""WITH m AS (SELECT c_nationkey AS k, c_custkey AS pos, 1 AS open FROM customer UNION ALL SELECT s_nationkey, s_suppkey, -1 FROM supplier), g AS (SELECT k, pos, sum(open) AS open FROM m GROUP BY k, pos)
SELECT k, pos AS start, lead(pos) OVER (PARTITION BY k ORDER BY pos) AS "end", CAST(sum(open) OVER (PARTITION BY k ORDER BY pos) AS BIGINT) AS free FROM g""")
def sweep_line(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("at"), F.lit(1).alias("open")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("at"), F.lit(-1).alias("open")))
    w = W.partitionBy("k").orderBy("at")
    cut = marks.groupBy("k", "at").agg(F.sum("open").alias("open"))
    return cut.select("k", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("open").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("free"))


@plan("""WITH h AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT h.p AS p_partkey, count(*) AS holders, min(s_name) AS first_holder FROM h JOIN supplier ON s = s_suppkey GROUP BY 1""")
def who_can(spark: SparkSession, d: str) -> DataFrame:
    holders = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    return holders.join(table(spark, d, "supplier"), "s_suppkey").groupBy("p_partkey").agg(F.count("*").alias("holders"), F.min("s_name").alias("first_holder"))


@plan(f"""WITH {STATE}, {SPANS_ONLY} SELECT 1 AS section_no, 'what happened' AS section, count(*) AS n FROM spans WHERE start > '{SINCE}' AND start <= '{AT}'
UNION ALL SELECT 2, 'faults', count(*) FROM spans WHERE object_text = 'error' AND start > '{SINCE}' AND start <= '{AT}' UNION ALL SELECT 3, 'unknown', count(*) FROM readings WHERE state <> 'known'""")
def shift_report_sections(spark: SparkSession, d: str) -> DataFrame:
    recent = spans_of(spark, d).where((F.col("start") > SINCE) & (F.col("start") <= AT))
    section = lambda no, name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(no).alias("section_no"), F.lit(name).alias("section"), "n")
    return section(1, "what happened", recent).unionByName(section(2, "faults", recent.where("object_text = 'error'"))).unionByName(section(3, "unknown", readings_of(spark, d).where("state <> 'known'")))


@plan("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 20")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(20)


@plan("SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    c, s, o = (table(spark, d, t) for t in ("customer", "supplier", "orders"))
    a, b = c.select("c_nationkey"), s.select("s_nationkey")
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return count("both", a.intersect(b)).unionByName(count("customers only", c.select("c_custkey").subtract(o.select("o_custkey")))).unionByName(count("either", a.union(b).distinct()))


@plan("""SELECT 'left' AS kind, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'inner', count(*) FROM customer JOIN orders ON c_custkey = o_custkey UNION ALL
SELECT 'full', count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'semi', count(*) FROM customer SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT 'anti', count(*) FROM customer ANTI JOIN orders ON c_custkey = o_custkey""")
def join_types(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    out = None
    for name, how in (("left", "left"), ("inner", "inner"), ("full", "full_outer"), ("semi", "left_semi"), ("anti", "left_anti")):
        one = c.join(o, c.c_custkey == o.o_custkey, how).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@plan("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@plan("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'2001-06-01 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@plan("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def local_revenue(spark: SparkSession, d: str) -> DataFrame:
    c, o, li, s, n = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, (li.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@plan("SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS mean_square FROM embeddings GROUP BY label")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(square), 4).alias("mean_square"))


@plan("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def conversation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_distinct("conv_id").alias("conversations"))


@plan("SELECT source, count(*) AS n, count(DISTINCT md5(text)) AS different, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def document_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("different"), F.sum("n_chars").alias("chars"))


@plan("""WITH n AS (SELECT source, lang AS code, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY ALL)
SELECT source, string_agg(code || ':' || n, ', ' ORDER BY code) AS codes FROM n WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY source""")
def source_incomplete(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    findings = both.select("source", F.col("lang").alias("code"), F.when(F.col("quality") == 0, "corrupt").alias("category"))
    return records.incomplete_sources(findings, both.where("toxic = 1"))


@plan("SELECT conv_id, max(turn) AS stated, count(*) AS found FROM conversations GROUP BY conv_id HAVING max(turn) <> count(*)")
def snapshot_incomplete(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return checks.count_mismatch(turns.groupBy("conv_id").agg(F.max("turn").alias("stated")), turns, "conv_id", "stated")


@plan("""WITH x AS (SELECT user_id, event_type, props, CASE WHEN value > 50 THEN event_id % 3 END AS kind FROM events),
c AS (SELECT user_id, event_type, 'props' AS field, CAST(props AS VARCHAR) AS v FROM x UNION ALL SELECT user_id, event_type, 'kind', CAST(kind AS VARCHAR) FROM x)
SELECT user_id, event_type, field, count(DISTINCT v) AS n_values FROM c GROUP BY ALL HAVING count(DISTINCT v) > 1""")
def schema_conflict(spark: SparkSession, d: str) -> DataFrame:
    streams = table(spark, d, "events").withColumn("kind", F.when(F.col("value") > 50, F.col("event_id") % 3))
    return records.schema_conflicts(streams, ["user_id", "event_type"], ["props", "kind"])


@plan("""WITH t AS (SELECT source, max(len(string_split(text, ' '))) AS width FROM documents GROUP BY source),
r AS (SELECT source, lang, doc_id, len(string_split(text, ' ')) AS cells FROM documents)
SELECT source AS "table", count(*) AS n, CAST(min(n_lang) AS INT) AS first_row, arg_min(doc_id, n_lang * 10000000000 + doc_id) AS first_id
FROM (SELECT r.*, length(lang) AS n_lang, width FROM r JOIN t USING (source)) WHERE cells <> width GROUP BY source""")
def row_shape_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("source").alias("table"), F.length("lang").alias("row"), F.col("doc_id").alias("id"), F.size(F.split("text", " ")).alias("cells"))
    return records.row_shapes(rows.groupBy("table").agg(F.max("cells").alias("width")), rows)


@plan("SELECT n_regionkey, n_name[1] AS zone, count(*) AS n FROM nation GROUP BY ALL HAVING count(*) > 1")
def civil_zone_repeated(spark: SparkSession, d: str) -> DataFrame:
    return checks.duplicates(table(spark, d, "nation").select("n_regionkey", F.substring("n_name", 1, 1).alias("zone")), ["n_regionkey", "zone"])


@plan("""WITH u AS (SELECT l_suppkey AS graph, l_partkey AS frame, l_orderkey AS id, l_linenumber = 1 AS declares FROM lineitem),
f AS (SELECT graph, frame, max(declares) AS declared, count(DISTINCT id) AS n, min(id) AS first_id FROM u GROUP BY ALL),
j AS (SELECT f.*, CASE WHEN s_suppkey IS NULL THEN 'graph_missing' WHEN NOT declared THEN 'frame_undeclared' END AS reason FROM f LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON graph = s_suppkey)
SELECT graph, frame, reason, n, first_id FROM j WHERE reason IS NOT NULL""")
def frame_unresolved(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("graph"), F.col("l_partkey").alias("frame"), F.col("l_orderkey").alias("id"), (F.col("l_linenumber") == 1).alias("declares"))
    return records.unresolved_frames(uses, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("graph")))


@plan("""WITH d AS (SELECT DISTINCT o_custkey AS owner, o_orderpriority AS revision FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT o_orderkey, o_custkey AS owner, o_orderpriority AS revision FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, owner, revision FROM s WHERE owner IN (SELECT owner FROM d) AND NOT EXISTS (SELECT 1 FROM d WHERE d.owner = s.owner AND d.revision = s.revision)""")
def calibration_revision_mismatch(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnsRenamed({"o_custkey": "owner", "o_orderpriority": "revision"})
    return records.revision_mismatches(orders.where("o_orderstatus <> 'F'"), orders.where("o_orderstatus = 'F'"), "owner", "revision").select("o_orderkey", "owner", "revision")


@plan("""WITH c AS (SELECT p_brand AS name, 'release>commit' AS pair, CAST(p_size AS VARCHAR) AS key, p_type AS v FROM part UNION ALL SELECT p_brand, 'commit>build', p_type, CAST(p_size AS VARCHAR) FROM part)
SELECT name, pair, key, count(DISTINCT v) AS n_values FROM c GROUP BY ALL HAVING count(DISTINCT v) > 1""")
def software_conflict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("release"), F.col("p_type").alias("commit"), F.col("p_size").alias("build"))
    return records.software_conflicts(rows, pairs=(("release", "commit"), ("commit", "build")))


@plan("""WITH g AS (SELECT l_orderkey, l_shipdate, l_returnflag AS v, max(l_quantity) AS score FROM lineitem GROUP BY l_orderkey, l_shipdate, v), b AS (SELECT l_orderkey, v, max(score) AS score FROM g GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY score DESC) AS k FROM b)
SELECT l_orderkey, CASE WHEN count(*) = 1 THEN min(v) END AS l_returnflag, max(score) AS l_quantity, CASE WHEN count(*) = 1 THEN 'known' ELSE 'ambiguous' END AS state FROM r WHERE k = 1 GROUP BY l_orderkey""")
def stream_semantics(spark: SparkSession, d: str) -> DataFrame:
    return records.best_guess(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity")


@plan("""WITH f AS (SELECT page_id, string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages), r AS (SELECT page_id AS run, p FROM f WHERE page_id % 2 = 0), i AS (SELECT page_id AS item, p FROM f WHERE page_id % 2 = 1),
m AS (SELECT run, item, len(list_filter(range(1, least(len(r.p), len(i.p))), lambda k: r.p[1:k] = i.p[1:k])) AS depth FROM r, i), k AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY depth DESC) AS n FROM m)
SELECT run, 'page' AS slot, CASE WHEN count(*) = 1 THEN min(item) END AS item, max(depth) AS depth, CASE WHEN count(*) = 1 THEN 'bound' ELSE 'conflict' END AS state FROM k WHERE n = 1 GROUP BY run""")
def snapshot_bindings(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"), F.lit("all").alias("unit"))
    runs, items = pages.where("page_id % 2 = 0").withColumnRenamed("page_id", "run"), pages.where("page_id % 2 = 1").withColumnRenamed("page_id", "item")
    return records.nearest_bindings(runs, items.withColumn("slot", F.lit("page")))


@plan("""SELECT l_orderkey, floor(round(greatest((1 - 0.9 * coalesce(product(1 - l_discount) FILTER (l_returnflag <> 'R'), 1)) * coalesce(product(1 - l_discount) FILTER (l_returnflag = 'R'), 1), 0.01), 12) * 10000 + 0.5) / 10000 AS score
FROM lineitem GROUP BY l_orderkey""")
def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_discount", (F.col("l_returnflag") == "R").alias("against"))
    return records.noisy_or(rows, "l_orderkey", "l_discount", "against", base=0.1)
