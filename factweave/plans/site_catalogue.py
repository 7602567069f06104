"""Named plans over a site's facts with ends of their own, units, references and several values at once, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import seconds_between
from ..functions.vocabulary import DOWN, GAP_SECONDS, MIN_EVENTS, MIN_SHARE, REJECT, STALE_AFTER, STATUS, SUPPORT
from ..operators import graph, intervals, state
from ..sources import tables
from . import insights, research
from .catalogue import AT, MSGS, RUNS, SINCE, clocked_spans, plan, seconds

SITE = (
    MSGS
    + """, sf AS (
  SELECT seq * 10 AS seq, subject, 'mode' AS predicate, false AS object_is_ref, mode AS object_text, NULL AS unit, t AS valid_from,
    CASE WHEN seq % 3 = 0 THEN strftime(strptime(t, '%Y-%m-%dT%H:%M:%S') + INTERVAL 5400 SECOND, '%Y-%m-%dT%H:%M:%S') END AS valid_to, seq AS n, source FROM msgs WHERE seq % 2 = 0
  UNION ALL SELECT seq * 10 + 1, subject, 'battery', false, CAST(CAST(floor(value) AS BIGINT) % 4 * 25 AS VARCHAR), '%', t, NULL, seq, source FROM msgs WHERE seq % 5 = 1
  UNION ALL SELECT seq * 10 + 2, subject, 'in_zone', true, 'zone:' || (seq % 3), NULL, t, CASE WHEN seq % 3 = 0 THEN strftime(strptime(t, '%Y-%m-%dT%H:%M:%S') + INTERVAL 5400 SECOND, '%Y-%m-%dT%H:%M:%S') END, seq, source FROM msgs WHERE seq % 5 = 2
  UNION ALL SELECT seq * 10 + 3, subject, 'current_task', true, 'task:' || (seq % 7), NULL, t, NULL, seq, source FROM msgs WHERE seq % 11 = 3
  UNION ALL SELECT seq * 10 + 4, 'task:' || (seq % 7), 'assigned_to', true, subject, NULL, t, NULL, seq, source FROM msgs WHERE seq % 11 IN (3, 4)
  UNION ALL SELECT seq * 10 + 5, subject, 'name', false, 'unit ' || (seq % 4), NULL, t, CASE WHEN seq % 2 = 0 THEN strftime(strptime(t, '%Y-%m-%dT%H:%M:%S') + INTERVAL 86400 SECOND, '%Y-%m-%dT%H:%M:%S') END, seq, source FROM msgs WHERE seq % 17 = 5
), site AS (SELECT * EXCLUDE (n), object_text || '|' || coalesce(unit, '') AS said, CASE WHEN n % 7 = 0 THEN 'inferred' ELSE 'observed' END AS kind, predicate IN ('mode', 'battery', 'in_zone', 'current_task') AS one FROM sf)"""
)
HOLDS = f"valid_from <= '{AT}' AND (valid_to IS NULL OR valid_to > '{AT}')"
READINGS = (
    SITE
    + f""", cur AS (SELECT *, CASE kind WHEN 'inferred' THEN 0 ELSE 1 END AS kr FROM site WHERE {HOLDS}),
late AS (SELECT c.*, (SELECT min(x.seq) FROM cur x WHERE x.subject = c.subject AND x.predicate = c.predicate AND x.source = c.source) AS pos FROM cur c
  WHERE one AND valid_from = (SELECT max(x.valid_from) FROM cur x WHERE x.subject = c.subject AND x.predicate = c.predicate AND x.source = c.source)),
best AS (SELECT l.* FROM late l WHERE kr = (SELECT max(x.kr) FROM late x WHERE x.subject = l.subject AND x.predicate = l.predicate)),
counted AS (SELECT b.*, (SELECT count(DISTINCT x.said) FROM best x WHERE x.subject = b.subject AND x.predicate = b.predicate) AS n FROM best b),
picked AS (SELECT * FROM counted QUALIFY (n > 1 AND row_number() OVER (PARTITION BY subject, predicate, said ORDER BY pos, seq) = 1) OR (n = 1 AND row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, seq DESC) = 1)),
every AS (SELECT subject, predicate, object_is_ref, object_text, unit, source, kind, seq, valid_from, n FROM picked UNION ALL SELECT subject, predicate, object_is_ref, object_text, unit, source, kind, seq, valid_from, 1 FROM cur WHERE NOT one),
seen AS (SELECT source, t FROM msgs UNION ALL SELECT source || '/' || split_part(subject, ':', 2), t FROM msgs WHERE seq % 3 = 0),
fresh AS (SELECT source AS key, max(t) FILTER (t <= '{AT}') AS last FROM seen GROUP BY source),
pace(source, pace) AS (VALUES ('src0', 900), ('src1', 3600), ('src2', 7200)),
seen_at AS (SELECT e.*, CASE WHEN d.key IS NOT NULL THEN d.last ELSE s.last END AS last_seen FROM every e LEFT JOIN fresh d ON d.key = e.source || '/' || split_part(e.subject, ':', 2) LEFT JOIN fresh s ON s.key = e.source),
site_readings AS (SELECT subject, predicate, object_is_ref, object_text, unit, source, kind, seq, valid_from AS since, last_seen,
  CASE WHEN n > 1 THEN 'ambiguous' WHEN coalesce({seconds('last_seen', f"'{AT}'")} > {STALE_AFTER} * pace, false) THEN 'stale' ELSE 'known' END AS state FROM seen_at LEFT JOIN pace USING (source))"""
)


def readings_of(spark: SparkSession, d: str) -> DataFrame:
    return state.all_readings(tables.site_facts(spark, d), tables.site_seen(spark, d), AT, tables.site_pace(spark))


@plan(f"WITH {READINGS} SELECT * FROM site_readings")
def site_state(spark: SparkSession, d: str) -> DataFrame:
    return readings_of(spark, d)


@plan(f"WITH {READINGS} SELECT subject, predicate, object_text, state FROM site_readings WHERE predicate IN ({', '.join(repr(p) for p in STATUS)})")
def site_status(spark: SparkSession, d: str) -> DataFrame:
    return readings_of(spark, d).where(F.col("predicate").isin(*STATUS)).select("subject", "predicate", "object_text", "state")


@plan(f"""WITH {SITE}, prior AS (SELECT *, lag(said) OVER w AS was, lag(valid_to) OVER w AS was_to, row_number() OVER w AS no FROM site WHERE one WINDOW w AS (PARTITION BY subject, predicate, source ORDER BY valid_from, seq)),
after AS (SELECT p.*, (SELECT min(x.valid_from) FROM site x WHERE x.subject = p.subject AND x.predicate = p.predicate AND x.source = p.source AND (x.valid_from > p.valid_from OR (x.valid_from = p.valid_from AND x.seq > p.seq)) AND x.said <> p.said) AS next FROM prior p
  WHERE no = 1 OR was <> said OR was_to IS NOT NULL)
SELECT subject, predicate, source, object_text, unit, seq, valid_from AS start, CASE WHEN valid_to IS NOT NULL AND (next IS NULL OR valid_to < next) THEN valid_to ELSE next END AS "end" FROM after
UNION ALL SELECT subject, predicate, source, object_text, unit, seq, valid_from, valid_to FROM site WHERE NOT one""")
def site_history(spark: SparkSession, d: str) -> DataFrame:
    return intervals.all_history(tables.site_facts(spark, d)).select("subject", "predicate", "source", "object_text", "unit", "seq", "start", "end")


EDGES_AT = f"""{READINGS}, tells AS (SELECT DISTINCT subject FROM site WHERE predicate = 'current_task'), doing AS (SELECT DISTINCT subject, object_text FROM site_readings WHERE predicate = 'current_task'),
edges AS (SELECT subject, predicate, object_text, seq FROM cur WHERE predicate = 'assigned_to' AND (object_text NOT IN (SELECT subject FROM tells) OR EXISTS (SELECT 1 FROM doing WHERE doing.subject = cur.object_text AND doing.object_text = cur.subject)))"""


@plan(f"WITH {EDGES_AT} SELECT * FROM edges")
def topology_at(spark: SparkSession, d: str) -> DataFrame:
    return state.topology(tables.site_facts(spark, d), AT).select("subject", "predicate", "object_text", "seq")


@plan(f"""WITH RECURSIVE {EDGES_AT}, w AS (SELECT DISTINCT object_text AS root, object_text AS id, 0 AS d FROM edges UNION SELECT w.root, e.subject, w.d + 1 FROM w JOIN edges e ON e.object_text = w.id WHERE w.d < 3)
SELECT root, id, min(d) AS d FROM w WHERE d > 0 GROUP BY root, id""")
def impact_at(spark: SparkSession, d: str) -> DataFrame:
    """What hangs on each robot by the topology that held at the time."""
    edges = state.topology(tables.site_facts(spark, d), AT)
    return graph.downstream(graph.directed(edges), edges.select(F.col("object_text").alias("root")).distinct(), 3).select("root", "id", "d")


VERDICT = f"""CASE WHEN a_n + b_n < {MIN_EVENTS} OR least(a_h, b_h) <= 0 OR least(a_h, b_h) < {MIN_SHARE} * (a_h + b_h) THEN 'inconclusive'
  WHEN b_n = 0 OR (a_n / a_h) / (b_n / b_h) >= {SUPPORT} THEN 'supported' WHEN (a_n / a_h) / (b_n / b_h) < {REJECT} THEN 'rejected' ELSE 'inconclusive' END"""
PERIODS = f"""ticks AS (SELECT DISTINCT t FROM msgs), gone AS (SELECT t, CASE WHEN coalesce({seconds('lag(t) OVER (ORDER BY t)', 't')} > {GAP_SECONDS}, true) THEN 1 ELSE 0 END AS opened FROM ticks),
numbered AS (SELECT t, sum(opened) OVER (ORDER BY t) AS no FROM gone), periods AS (SELECT min(t) AS a, max(t) AS b FROM numbered GROUP BY no)"""


def faults_of(spark: SparkSession, d: str) -> DataFrame:
    return tables.messages(spark, d).where("mode = 'error'").select("subject", "t")


@plan(f"""WITH {RUNS}, {PERIODS}, held AS (SELECT subject, start, coalesce("end", (SELECT max(t) FROM msgs)) AS "end" FROM spans WHERE object_text = 'view'),
e AS (SELECT m.subject, count(*) FILTER (EXISTS (SELECT 1 FROM held h WHERE h.subject = m.subject AND h.start <= m.t AND m.t < h."end")) AS a_n, count(*) AS n FROM msgs m WHERE mode = 'error' GROUP BY m.subject),
h AS (SELECT subject, sum({seconds('greatest(start, a)', 'least("end", b)')}) / 3600.0 AS a_h FROM held JOIN periods ON a < "end" AND b > start GROUP BY subject),
x AS (SELECT e.subject, a_n, n - a_n AS b_n, coalesce(a_h, 0) AS a_h, (SELECT sum({seconds('a', 'b')}) / 3600.0 FROM periods) - coalesce(a_h, 0) AS b_h FROM e LEFT JOIN h USING (subject))
SELECT subject, a_n AS with_n, b_n AS without_n, round(a_h, 6) AS hours, round(b_h, 6) AS without_hours, {VERDICT} AS verdict FROM x""")
def rate_when_observed(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a robot while it is in view, against faults otherwise, by hours in which the site was observed."""
    spans = clocked_spans(spark, d).where("mode = 'view'").select("subject", "start", F.col("until").alias("end"))
    got = research.rate_when(faults_of(spark, d), spans, research.observed(tables.seen(spark, d)))
    return got.select("subject", "with_n", "without_n", F.round("hours", 6).alias("hours"), F.round("without_hours", 6).alias("without_hours"), "verdict")


@plan(f"""WITH {MSGS}, {PERIODS}, e AS (SELECT subject, count(*) FILTER (t >= '{AT}') AS a_n, count(*) FILTER (t < '{AT}') AS b_n FROM msgs WHERE mode = 'error' GROUP BY subject),
h AS (SELECT sum(greatest({seconds(f"greatest(a, '{AT}')", 'b')}, 0)) / 3600.0 AS a_h, sum(greatest({seconds('a', f"least(b, '{AT}')")}, 0)) / 3600.0 AS b_h FROM periods), x AS (SELECT * FROM e, h)
SELECT subject, a_n AS after_n, b_n AS before_n, {VERDICT} AS verdict FROM x""")
def before_after_observed(spark: SparkSession, d: str) -> DataFrame:
    """Faults of a robot after a moment, against faults before it, by hours in which the site was observed."""
    got = research.before_after(faults_of(spark, d), research.observed(tables.seen(spark, d)), AT)
    return got.select("subject", "after_n", "before_n", "verdict")


PACE = 900


@plan(f"""WITH {MSGS}, g AS (SELECT source, t, lead(t) OVER (PARTITION BY source ORDER BY t) AS resumed FROM (SELECT DISTINCT source, t FROM msgs WHERE t <= '{AT}')),
l AS (SELECT *, strftime(strptime(t, '%Y-%m-%dT%H:%M:%S') + INTERVAL {STALE_AFTER * PACE} SECOND, '%Y-%m-%dT%H:%M:%S') AS stale_from FROM g WHERE {seconds('t', f"coalesce(resumed, '{AT}')")} > {STALE_AFTER * PACE})
SELECT 'source:' || source AS subject, stale_from AS valid_from, 'silent since ' || t || ' until ' || coalesce(resumed, 'now') AS text FROM l
WHERE EXISTS (SELECT 1 FROM msgs m WHERE m.source <> l.source AND m.t > l.stale_from AND (m.t < coalesce(l.resumed, '{AT}') OR (l.resumed IS NULL AND m.t = '{AT}')))""")
def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    """Silences of a source while another one kept reporting; a quiet site makes none."""
    expected = spark.createDataFrame([(f"src{k}", PACE, f"pace{k}") for k in range(4)], "source string, interval_seconds long, fact_id string")
    return insights.stale_sources(tables.seen(spark, d).distinct(), expected, AT).select("subject", "valid_from", "text")


@plan(f"""WITH {RUNS}, x AS (SELECT subject, object_text, start, "end", coalesce("end", (SELECT max(t) FROM msgs)) AS until FROM spans WHERE object_text IN ({', '.join(repr(w) for w in DOWN)}))
SELECT subject, object_text AS mode, start, "end", {seconds('start', 'until')} AS seconds FROM x""")
def downtime_of_site(spark: SparkSession, d: str) -> DataFrame:
    """Time in modes that mean down, the current one up to the clock."""
    down = clocked_spans(spark, d).where(insights.says(F.col("mode"), DOWN))
    return down.select("subject", "mode", "start", "end", seconds_between(F.col("start"), F.col("until")).alias("seconds"))


@plan(f"""WITH {READINGS}
SELECT 'stale' AS section, count(*) AS n FROM site_readings WHERE state = 'stale' UNION ALL SELECT 'ambiguous', count(*) FROM site_readings WHERE state = 'ambiguous'
UNION ALL SELECT 'changed', count(*) FROM site WHERE valid_from > '{SINCE}' AND valid_from <= '{AT}'""")
def site_brief(spark: SparkSession, d: str) -> DataFrame:
    """How much is stale, how much is ambiguous, and how much was said in the last day."""
    r, f = readings_of(spark, d), tables.site_facts(spark, d)
    part = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
    return part("stale", r.where("state = 'stale'")).unionByName(part("ambiguous", r.where("state = 'ambiguous'"))).unionByName(part("changed", f.where((F.col("valid_from") > SINCE) & (F.col("valid_from") <= AT))))
