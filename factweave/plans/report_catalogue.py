"""Named plans of reports, documents, decoded readings and record rules, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..functions.shared import shifted, site_time
from ..functions.vocabulary import ASSETS, TIMELINE, TIMELINE_ROWS
from ..operators import checks, documents, graph, intervals, readings, records, series, shifts
from ..sources import tables
from ..sources.tables import table
from .catalogue import AT, FACTS, MSGS, SINCE, SQL, plan
from .site_catalogue import SITE

HISTORY = f"h AS ({SQL['site_history']})"


def history_of(spark: SparkSession, d: str) -> DataFrame:
    return intervals.all_history(tables.site_facts(spark, d))


@plan(f"""WITH {HISTORY}, x AS (SELECT *, lag(object_text) OVER w AS was, row_number() OVER w AS no FROM h WHERE predicate IN ('mode', 'in_zone') WINDOW w AS (PARTITION BY subject, predicate, source ORDER BY start, seq))
SELECT subject, predicate, source, was, object_text, start, seq FROM x WHERE no > 1 AND was IS DISTINCT FROM object_text""")
def value_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed to what, of modes and zones as each source tells them."""
    spans = history_of(spark, d).where(F.col("predicate").isin("mode", "in_zone"))
    return shifts.value_changes(spans, ("subject", "predicate", "source")).select("subject", "predicate", "source", "was", "object_text", "start", "seq")


@plan(f"""WITH {HISTORY} SELECT start, CASE WHEN "end" <= '{AT}' THEN "end" END AS "end", subject, predicate, object_text, seq, predicate = 'health' AND starts_with(object_text, 'fault') AS fault
FROM h WHERE predicate IN ('mode', 'health', 'in_zone') AND split_part(subject, ':', 1) IN ('robot', 'machine', 'cell') AND start <= '{AT}'
ORDER BY start DESC, subject DESC, predicate DESC, seq DESC LIMIT {TIMELINE_ROWS}""")
def newest_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The newest changes up to a moment; so many is what the timeline shows."""
    return shifts.newest(history_of(spark, d), TIMELINE, ASSETS, AT, TIMELINE_ROWS)


FILES = ("feed.bin", "plan.csv", "manual.pdf", "site.yaml", None)


@plan(f"""WITH {SITE}, f AS (SELECT subject, CASE WHEN seq % 3 = 0 THEN 'stated' ELSE kind END AS kind, ['feed.bin', 'plan.csv', 'manual.pdf', 'site.yaml', NULL][(seq % 5)::INT + 1] AS file FROM site),
c AS (SELECT subject, CASE WHEN kind = 'inferred' THEN 'inferred' WHEN kind = 'observed' THEN 'feed' WHEN regexp_matches(coalesce(file, ''), '\\.(csv|tsv|xlsx|json|jsonl|yaml)$') THEN 'records' ELSE 'documents' END AS class FROM f)
SELECT subject, class, count(*) AS n FROM c GROUP BY ALL""")
def evidence_classes(spark: SparkSession, d: str) -> DataFrame:
    """How many facts of each thing rest on feeds, tables, documents or inference."""
    f = tables.site_facts(spark, d).withColumn("kind", F.when(F.col("seq") % 3 == 0, "stated").otherwise(F.col("kind")))
    file = F.element_at(F.array(*map(F.lit, FILES)), (F.col("seq") % 5).cast("int") + 1)
    return f.groupBy("subject", shifts.evidence_class(F.col("kind"), file).alias("class")).agg(F.count("*").alias("n"))


CLOCK, SHIFTS = "1996-06-15T12:00:00", ("shift:1", "shift:2", "shift:4", "shift:9")


def roster(spark: SparkSession, d: str) -> DataFrame:
    """Orders read as turns of eight hours of the customers' people."""
    turn = F.substring("o_orderpriority", 1, 1)
    start = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T0"), turn, F.lit(":00:00"))
    return table(spark, d, "orders").select(F.concat(F.lit("shift:"), turn).alias("shift"), start.alias("valid_from"), shifted(start, 28800).alias("valid_to"))


@plan(f"""WITH r AS (SELECT 'shift:' || substr(o_orderpriority, 1, 1) AS shift, strftime(o_orderdate, '%Y-%m-%d') || 'T0' || substr(o_orderpriority, 1, 1) || ':00:00' AS a FROM orders),
k AS (SELECT shift, a, strftime(strptime(a, '%Y-%m-%dT%H:%M:%S') + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') AS b FROM r),
w AS (SELECT shift, coalesce(max(a) FILTER (a <= '{CLOCK}'), max(a)) AS a FROM k WHERE shift IN ({', '.join(repr(s) for s in SHIFTS)}) GROUP BY shift)
SELECT w.shift, w.a AS start, (SELECT max(b) FROM k WHERE k.shift = w.shift AND k.a = w.a) AS "end",
  coalesce((SELECT max(b) FROM k WHERE b <= w.a), strftime(strptime(w.a, '%Y-%m-%dT%H:%M:%S') - INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S')) AS previous_end FROM w""")
def shift_windows(spark: SparkSession, d: str) -> DataFrame:
    return shifts.shift_windows(roster(spark, d), SHIFTS, CLOCK)


@plan(f"""WITH {HISTORY}, c AS (SELECT subject, start AS t, seq, object_text AS value FROM h WHERE predicate = 'battery' AND start <= '{AT}'),
f AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t, seq) AS up, row_number() OVER (PARTITION BY subject ORDER BY t DESC, seq DESC) AS down,
  row_number() OVER (PARTITION BY subject, t <= '{SINCE}' ORDER BY t DESC, seq DESC) AS before, min(t) OVER (PARTITION BY subject) <= '{SINCE}' AS early FROM c),
a AS (SELECT * FROM f WHERE CASE WHEN early THEN t <= '{SINCE}' AND before = 1 ELSE up = 1 END), b AS (SELECT * FROM f WHERE down = 1)
SELECT a.subject, a.t AS begun, a.value AS first, CASE WHEN a.seq <> b.seq THEN b.t END AS ended, CASE WHEN a.seq <> b.seq THEN b.value END AS last FROM a JOIN b USING (subject)""")
def counter_ends(spark: SparkSession, d: str) -> DataFrame:
    return shifts.counter_ends(history_of(spark, d).where("predicate = 'battery'"), SINCE, AT)


CARDS = """cards AS (SELECT 'hypothesis:' || user_id AS key, event_id AS round, CASE event_type WHEN 'view' THEN 'supported' WHEN 'click' THEN 'rejected' ELSE 'inconclusive' END AS verdict,
  ['goal:' || (user_id % 7), 'goal:' || (user_id % 3)] AS goals FROM events),
latest AS (SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY key ORDER BY round DESC) = 1)"""


def cards_of(spark: SparkSession, d: str) -> DataFrame:
    goal = lambda n: F.concat(F.lit("goal:"), F.col("user_id") % n)
    verdict = F.when(F.col("event_type") == "view", "supported").when(F.col("event_type") == "click", "rejected").otherwise("inconclusive")
    return table(spark, d, "events").select(
        F.concat(F.lit("hypothesis:"), "user_id").alias("key"), F.col("event_id").alias("round"), verdict.alias("verdict"), F.array(goal(7), goal(3)).alias("goals")
    )


@plan(f"WITH {CARDS} SELECT key, round, verdict FROM latest")
def latest_cards(spark: SparkSession, d: str) -> DataFrame:
    return shifts.latest_cards(cards_of(spark, d)).select("key", "round", "verdict")


@plan(f"""WITH {CARDS}, n AS (SELECT DISTINCT key, verdict, unnest(goals) AS goal FROM latest)
SELECT 'goal:' || g AS goal, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'inconclusive') AS inconclusive, count(*) FILTER (verdict = 'rejected') AS rejected
FROM range(9) r(g) LEFT JOIN n ON n.goal = 'goal:' || g GROUP BY g""")
def goal_tallies(spark: SparkSession, d: str) -> DataFrame:
    goals = spark.range(9).select(F.concat(F.lit("goal:"), "id").alias("goal"))
    return shifts.goal_tallies(goals, shifts.latest_cards(cards_of(spark, d)))


@plan(f"""WITH {MSGS}, f AS (SELECT subject, mode, seq FROM msgs WHERE mode IN ('error', 'signup')), c AS (SELECT subject, mode, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT subject, CAST(sum(n) AS BIGINT) AS n, string_agg(mode || ':' || n, ', ' ORDER BY mode) AS codes FROM c GROUP BY subject),
l AS (SELECT subject, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS items FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY subject ORDER BY seq) <= 5) GROUP BY subject)
SELECT subject, n, codes, items, greatest(n - 5, 0) AS omitted FROM t JOIN l USING (subject)""")
def findings_capped(spark: SparkSession, d: str) -> DataFrame:
    """Errors and sign-ups of a robot by code, the first five listed, the others counted."""
    return shifts.capped(tables.messages(spark, d).where("mode IN ('error', 'signup')"), "subject", "mode", "seq", 5)


@plan("""WITH f AS (SELECT DISTINCT 'src' || (event_id % 4) || '/' || strftime(ts, '%Y-%m-%d') AS folder, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events WHERE event_id % 9 <> 4),
g AS (SELECT *, CASE WHEN coalesce(epoch(strptime(t, '%Y-%m-%dT%H:%M:%S')) - epoch(strptime(lag(t) OVER (PARTITION BY folder ORDER BY t), '%Y-%m-%dT%H:%M:%S')) > 900, true) THEN 1 ELSE 0 END AS opened FROM f),
n AS (SELECT *, sum(opened) OVER (PARTITION BY folder ORDER BY t) AS no FROM g) SELECT folder, min(t) AS start, max(t) AS "end", count(*) AS n FROM n GROUP BY folder, no""")
def name_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that follow each other by the times in their names; names without a time belong to none."""
    stamp = F.when(F.col("event_id") % 9 == 4, F.lit("20241399_996199")).otherwise(F.date_format("ts", "yyyyMMdd_HHmmss"))
    folder = F.concat_ws("/", F.concat(F.lit("src"), F.col("event_id") % 4), F.date_format("ts", "yyyy-MM-dd"))
    return shifts.name_clusters(table(spark, d, "events").select(folder.alias("folder"), F.concat(F.lit("run_"), stamp, F.lit(".bag")).alias("name")), 900)


@plan(f"""WITH {FACTS}, n AS (SELECT * FROM facts WHERE t > '{SINCE}' QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY seq) = 1)
SELECT fact_id, subject, seq FROM n WHERE fact_id NOT IN (SELECT fact_id FROM facts WHERE seq % 3 = 0)""".replace("WHERE t >", "WHERE valid_from >"))
def unseen_facts(spark: SparkSession, d: str) -> DataFrame:
    """What reading the files again would append to the log."""
    f = tables.facts(spark, d)
    return shifts.unseen(f.where(F.col("valid_from") > SINCE), f.where("seq % 3 = 0")).select("fact_id", "subject", "seq")


REVISIONS = "r AS (SELECT p_partkey AS record, p_brand AS document, CAST(p_partkey % 40 AS VARCHAR) AS revision, [CAST((p_partkey + 13) % 40 AS VARCHAR), CAST((p_partkey + 7) % 40 AS VARCHAR)] AS supersedes FROM part)"


@plan(f"""WITH {REVISIONS}, s AS (SELECT document, unnest(supersedes) AS old, revision AS newer FROM r)
SELECT r.record, r.document, r.revision, string_agg(s.newer, ',' ORDER BY s.newer) AS superseded_by FROM r JOIN s ON s.document = r.document AND s.old = r.revision GROUP BY ALL""")
def stale_document_revision(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: (c % 40).cast("string")
    return records.superseded(table(spark, d, "part").select(k.alias("record"), F.col("p_brand").alias("document"), text(k).alias("revision"), F.array(text(k + 13), text(k + 7)).alias("supersedes")))


@plan("""WITH s AS (SELECT p_partkey AS configuration, CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS device, CAST(p_size % 5 AS VARCHAR) AS "commit", CASE WHEN p_partkey % 3 = 0 THEN p_name END AS release FROM part),
b AS (SELECT DISTINCT l_orderkey AS run, l_partkey AS configuration FROM lineitem),
c AS (SELECT run, name, coalesce(device, '') AS device, unnest(['commit', 'release']) AS field, unnest(["commit", release]) AS value FROM b JOIN s USING (configuration) WHERE name IS NOT NULL)
SELECT run, name, device, field, count(DISTINCT value) AS n_values FROM c GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def run_software_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs and parts as configurations that state a commit and a release."""
    k = F.col("p_partkey")
    software = table(spark, d, "part").select(
        k.alias("configuration"), F.when(k % 11 != 0, F.col("p_type")).alias("name"), F.when(k % 2 == 0, F.col("p_brand")).alias("device"), (F.col("p_size") % 5).cast("string").alias("commit"),
        F.when(k % 3 == 0, F.col("p_name")).alias("release"),
    )
    return records.run_software_conflicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("configuration")), software)


FRAMES = """frames AS (SELECT 'f' || c_custkey AS child, 'f' || (c_custkey // 3) AS parent FROM customer WHERE c_custkey > 0
  UNION ALL SELECT 'f' || c_custkey, 'f' || (c_custkey + 1) FROM customer WHERE c_custkey % 40 = 1 UNION ALL SELECT 'f' || (c_custkey // 3), 'f' || c_custkey FROM customer WHERE c_custkey % 101 = 5)"""


def frames_of(spark: SparkSession, d: str) -> DataFrame:
    """A tree of frames with second parents, and edges back from a parent to its child."""
    c, f = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), lambda x: F.concat(F.lit("f"), x.cast("long").cast("string"))
    k = F.col("k")
    edge = lambda rows, a, b: rows.select(f(a).alias("child"), f(b).alias("parent"))
    return edge(c.where("k > 0"), k, F.floor(k / 3)).unionByName(edge(c.where("k % 40 = 1"), k, k + 1)).unionByName(edge(c.where("k % 101 = 5"), F.floor(k / 3), k))


@plan(f"WITH {FRAMES} SELECT child, count(DISTINCT parent) AS n_parents FROM frames GROUP BY child HAVING count(DISTINCT parent) > 1")
def frames_with_two_parents(spark: SparkSession, d: str) -> DataFrame:
    return graph.several_parents(frames_of(spark, d))


@plan(f"""WITH RECURSIVE {FRAMES}, r AS (SELECT child AS a, parent AS b FROM frames UNION SELECT r.a, f.parent FROM r JOIN frames f ON f.child = r.b), c AS (SELECT a FROM r WHERE a = b)
SELECT DISTINCT frame FROM (SELECT a AS frame FROM c UNION SELECT x.a FROM r x JOIN r y ON y.b = x.a WHERE x.b IN (FROM c) AND y.a IN (FROM c))""")
def frame_loops(spark: SparkSession, d: str) -> DataFrame:
    return graph.loops(frames_of(spark, d))


FEED = {
    "mode": readings.Field("mode"), "err": readings.Field("health"), "task": readings.Field("current_task", state="job.state"), "zone": readings.Field("in_zone", ref="zone"),
    "bat": readings.Field("battery", unit="%"), "cell": readings.Field("parts_out", subject="cell:{payload.job.cell}"),
}


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages of a fleet: mode, faults as a list or as a code, tasks with a state, zones with and without their prefix."""
    n = F.col("event_id")
    fault = F.when(n % 5 == 0, '[{"errorType":"jam"},{"errorType":"late"}]').when(n % 5 == 1, "[]").when(n % 5 == 2, '"estop"').when(n % 5 == 3, '[{"level":2}]').otherwise('""')
    task = F.when(n % 4 == 0, '""').otherwise(F.concat(F.lit('"t'), n % 9, F.lit('"')))
    payload = F.concat(
        F.lit('{"mode":"'), "event_type", F.lit('","err":'), fault, F.lit(',"task":'), task, F.lit(',"job":{"state":"'), F.when(n % 3 == 0, "").otherwise("running"), F.lit('","cell":'), n % 6,
        F.lit('},"zone":"'), F.when(n % 2 == 0, "zone:").otherwise(""), F.lit("z"), n % 8, F.lit('","bat":'), F.floor("value"), F.lit(',"cell":'), n, F.lit("}"),
    )
    topic = F.concat(F.lit("site/fleet/"), F.col("user_id"), F.lit("/state/"))
    return table(spark, d, "events").select(site_time(F.col("ts")).alias("t"), F.lit("fleet").alias("source"), topic.alias("topic"), payload.alias("payload"))


@plan(f"""WITH {MSGS}, m AS (SELECT t, 'fleet' AS source, seq AS n, 'robot:' || split_part(subject, ':', 2) AS who, mode, 'task:t' || (seq % 9) AS task, value FROM msgs)
SELECT t, source, who AS subject, 'mode' AS predicate, false AS object_is_ref, mode AS object_text, CAST(NULL AS VARCHAR) AS unit FROM m
UNION ALL SELECT t, source, who, 'health', false, CASE n % 5 WHEN 0 THEN 'fault:jam' WHEN 2 THEN 'fault:estop' WHEN 3 THEN 'fault:error' ELSE 'ok' END, NULL FROM m
UNION ALL SELECT t, source, who, 'current_task', n % 4 <> 0, CASE WHEN n % 4 = 0 THEN 'none' ELSE task END, NULL FROM m
UNION ALL SELECT t, source, task, 'assigned_to', true, who, NULL FROM m WHERE n % 4 <> 0 UNION ALL SELECT t, source, task, 'task_state', false, 'running', NULL FROM m WHERE n % 4 <> 0 AND n % 3 <> 0
UNION ALL SELECT t, source, who, 'in_zone', true, 'zone:z' || (n % 8), NULL FROM m UNION ALL SELECT t, source, who, 'battery', false, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '%' FROM m
UNION ALL SELECT t, source, 'cell:' || (n % 6), 'parts_out', false, CAST(n AS VARCHAR), NULL FROM m""")
def feed_readings(spark: SparkSession, d: str) -> DataFrame:
    """Everything that the fleet's messages say, as facts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.get_json_object("payload", f"$.{n}").alias("value")) for n in FEED]))
    return readings.readings(envelopes(spark, d).withColumn("x", pairs).select("*", "x.*"), "robot:{topic[-2]}", FEED)


@plan(f"WITH {MSGS}, r AS (SELECT 'fleet' AS source, t FROM msgs UNION ALL SELECT 'fleet/' || split_part(subject, ':', 2), t FROM msgs) SELECT source, max(t) AS last_seen, count(*) AS n FROM r GROUP BY source")
def device_reports(spark: SparkSession, d: str) -> DataFrame:
    """When each device of the fleet, and the fleet, reported last."""
    return readings.device_reports(envelopes(spark, d), "robot:{topic[-2]}").groupBy("source").agg(F.max("t").alias("last_seen"), F.count("*").alias("n"))


RULE = "([A-Z][a-z]{1,3}) (.*)"
LIFTS = (documents.Lift("word", ", ([a-z]{3})[ .]", 1), documents.Lift("requires", "([a-z]+tion)[ .,]", 1, "qualification", True))
BLOCKS = """b AS (SELECT 'document:' || doc_id AS document, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS position, trim(x) AS block
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(x) <> '')"""


def blocks_of(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "documents").select(F.concat(F.lit("document:"), "doc_id").alias("document"), F.posexplode(lines).alias("position", "block"))


@plan(f"""WITH {BLOCKS}, r AS (SELECT *, CASE WHEN regexp_matches(block, '(?s)^(?:{RULE})') THEN 'rule:' || split_part(document, ':', 2) || '-' || lower(regexp_extract(block, '(?s)^(?:{RULE})', 1)) END AS rule FROM b),
f AS (SELECT document, position, rule AS subject, 'rule_text' AS predicate, trim(regexp_extract(block, '(?s)^(?:{RULE})', 2)) AS object_text FROM r WHERE rule IS NOT NULL
UNION ALL SELECT document, position, document, 'word', unnest(regexp_extract_all(block, '{LIFTS[0].pattern}', 1)) FROM r
UNION ALL SELECT document, position, coalesce(rule, document), 'requires', 'qualification:' || unnest(regexp_extract_all(block, '{LIFTS[1].pattern}', 1)) FROM r
UNION ALL SELECT document, position, document, 'name', block FROM r WHERE position = 0)
SELECT * FROM f""")
def document_facts(spark: SparkSession, d: str) -> DataFrame:
    """Names, rules and lifted words of every line of every document."""
    blocks = blocks_of(spark, d)
    return documents.lifted(blocks, RULE, LIFTS).unionByName(documents.names(blocks))


@plan(f"""WITH {BLOCKS}, v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part UNION SELECT 'The-and' UNION SELECT 'On-the')
SELECT document, position, document AS subject, 'speaks_of' AS predicate, 'term:' || term AS object_text FROM b JOIN v ON contains(lower(block), lower(term)) OR contains(lower(block), replace(lower(term), '-', ' '))""")
def document_terms(spark: SparkSession, d: str) -> DataFrame:
    """Which words of the parts' names, and which dashed terms, a line has."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return documents.terms_in(blocks_of(spark, d), words.unionByName(spark.createDataFrame([("The-and",), ("On-the",)], "term string")), "speaks_of", "term")


@plan("""WITH t AS (SELECT 'document:' || doc_id AS document, doc_id, text FROM documents), e AS (SELECT 'machine:' || doc_id AS entity, doc_id, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS name FROM documents WHERE doc_id % 50 = 0)
SELECT DISTINCT document, entity FROM t JOIN e ON length(name) >= 3 AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || regexp_escape(lower(name)) || '($|[^\\p{L}\\p{N}_])')
UNION SELECT document, entity FROM t JOIN e ON t.doc_id % 5 = 0 AND t.doc_id % 40 = e.doc_id % 40""")
def document_applies_to(spark: SparkSession, d: str) -> DataFrame:
    """Documents that mention a machine, by a name that another document begins with, or cover its zone."""
    docs = table(spark, d, "documents")
    key = lambda kind, c: F.concat(F.lit(kind + ":"), c.cast("string"))
    n, some = F.col("doc_id"), docs.where("doc_id % 50 = 0")
    named = some.select(key("machine", n).alias("entity"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("name"))
    covers = docs.where("doc_id % 5 = 0").select(key("document", n).alias("document"), key("zone", n % 40).alias("zone"))
    return documents.applies_to(docs.select(key("document", n).alias("document"), "text"), covers, named, some.select(key("machine", n).alias("entity"), key("zone", n % 40).alias("zone")))


@plan("""WITH p AS (SELECT page_id AS n, 'images/shot-' || page_id || '.v2.png' AS image, sha256(url) AS h FROM pages),
r AS (SELECT n, image, 'm1@' || substr(h, 1, 12) AS model, 0 AS region, 'Tag' || (n % 30) || ': worn' AS object_text, 'region 1,2,3,' || n AS locator FROM p UNION ALL SELECT n, image, 'm1@' || substr(h, 1, 12), 1, 'loose bolt', 'region 0,0,9,9' FROM p)
SELECT image, region, CASE WHEN region = 1 THEN 'document:shot-' || n || '.v2' WHEN n % 30 < 25 AND n % 30 % 2 = 0 THEN 'robot:tag' || (n % 30) WHEN n % 30 < 25 THEN 'conveyor:tag' || (n % 30) ELSE 'machine:tag' || (n % 30) END AS subject,
  object_text, CAST(NULL AS VARCHAR) AS taken, 'inferred' AS kind, locator, model FROM r""")
def region_notes(spark: SparkSession, d: str) -> DataFrame:
    """Recorded readings of images, tags looked up in a register of the nations."""
    n = F.col("page_id")
    said = F.concat(
        F.lit('{"model":"m1","prompt_sha256":"'), F.sha2("url", 256), F.lit('","image":"images/shot-'), n, F.lit('.v2.png","regions":[{"text":"Tag'), n % 30,
        F.lit(': worn","box":[1,2,3,'), n, F.lit(']},{"text":"loose bolt","box":[0,0,9,9]}]}'),
    )
    k = F.col("n_nationkey")
    register = table(spark, d, "nation").select(k.alias("row"), F.concat(F.lit("unit Tag"), k, F.lit(" hall")).alias("name"), F.when(k % 2 == 0, "robot").otherwise("conveyor").alias("type"))
    return documents.extractions(table(spark, d, "pages").select(said.alias("said")), "said", register)


UNITS = ("degC", "degF", "kPa", "deg/s", "km/h", "parsec")


@plan("""WITH e AS (SELECT event_id, value, CAST(event_id % 7 AS INT) AS k FROM events), f(k, unit, scale, zero, base) AS (VALUES
  (0, 'degC', 1.0::DOUBLE, 273.15::DOUBLE, 'K'), (1, 'degF', 5.0::DOUBLE / 9, 459.67::DOUBLE * 5 / 9, 'K'), (2, 'kPa', 1000.0::DOUBLE, 0::DOUBLE, 'kg m^-1 s^-2'),
  (3, 'deg/s', pi() / 180, 0::DOUBLE, 'rad s^-1'), (4, 'km/h', 1.0::DOUBLE / 3.6, 0::DOUBLE, 'm s^-1'), (5, 'parsec', NULL, NULL, NULL))
SELECT event_id, unit, round(value * scale + zero, 6) AS in_base, base FROM e LEFT JOIN f USING (k)""")
def values_in_base(spark: SparkSession, d: str) -> DataFrame:
    """Values of messages in base units; null where the unit isn't known or isn't stated."""
    unit = F.try_element_at(F.array(*map(F.lit, UNITS)), (F.col("event_id") % 7 + 1).cast("int"))
    x = units.in_base(F.col("value"), unit, [u for u in UNITS if u != "parsec"])
    return table(spark, d, "events").select("event_id", unit.alias("unit"), F.round(x["value"], 6).alias("in_base"), x["unit"].alias("base"))


ANCHORS = """a AS (SELECT user_id AS stream, CASE WHEN user_id % 2 = 0 THEN 'px4.gps_utc' ELSE 'ardupilot.gps_time' END AS rule, event_id AS tick,
  CASE WHEN user_id % 2 = 0 THEN epoch_us(ts) ELSE (event_id % 3) * 604800000 + event_id END AS embedded FROM events
  WHERE CASE WHEN user_id % 2 = 0 THEN event_id % 5 <> 0 ELSE event_id % 3 > 0 END)"""


def clocked(spark: SparkSession, d: str) -> DataFrame:
    """Events as messages of receivers: even users write one format, odd ones the other; some have no time yet."""
    n, us = F.col("event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    even = F.col("user_id") % 2 == 0
    one = F.create_map(F.lit("time_utc_usec"), F.when(n % 5 == 0, F.lit(0)).otherwise(us).cast("bigint"))
    other = F.create_map(F.lit("GWk"), (n % 3).cast("bigint"), F.lit("GMS"), n.cast("bigint"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("stream"), F.when(even, "ulog").otherwise("dataflash").alias("encoding"), F.when(even, "sensor_gps").otherwise("GPS").alias("kind"),
        n.alias("tick"), F.when(even, one).otherwise(other).alias("fields"),
    )


@plan(f"WITH {ANCHORS} SELECT * FROM a")
def clock_anchors(spark: SparkSession, d: str) -> DataFrame:
    return series.clock_anchors(clocked(spark, d))


@plan(f"""WITH {ANCHORS}, s AS (SELECT *, lag(embedded) OVER w AS before, lag(tick) OVER w AS earlier FROM a WINDOW w AS (PARTITION BY stream, rule ORDER BY tick, embedded)),
c AS (SELECT stream, rule, count(*) AS anchors, count(DISTINCT tick) AS instants, count(*) FILTER (embedded < before AND tick > earlier) AS falls FROM s GROUP BY ALL)
SELECT *, CASE WHEN instants < 2 THEN 'single_instant' WHEN falls > 0 THEN 'runs_backward' ELSE 'fits' END AS state FROM c""")
def clock_anchor_report(spark: SparkSession, d: str) -> DataFrame:
    """Which receivers' clocks can be fitted, and why others can't."""
    return series.anchor_report(series.clock_anchors(clocked(spark, d)))


@plan("""WITH v AS (SELECT 'part:' || l_partkey AS stream, c, CASE c WHEN 'l_quantity' THEN CAST(l_quantity AS DOUBLE) ELSE CAST(l_discount AS DOUBLE) END AS value FROM lineitem, (VALUES ('l_quantity'), ('l_discount')) n(c)),
l AS (SELECT 'part:' || p_partkey AS stream, c, CASE WHEN p_partkey % 5 = 0 THEN 'lb' ELSE 'kg' END AS unit, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'kg' END AS column_unit,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN c = 'l_quantity' THEN 5.0::DOUBLE ELSE 0.01::DOUBLE END AS lower, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN c = 'l_quantity' THEN 45.0::DOUBLE ELSE 0.09::DOUBLE END AS upper
  FROM part, (VALUES ('l_quantity'), ('l_discount')) n(c))
SELECT stream, c AS "column", any_value(unit) AS unit, any_value(lower) AS lower, any_value(upper) AS upper, count(*) FILTER (value < lower) AS below, count(*) FILTER (value > upper) AS above
FROM v JOIN l USING (stream, c) WHERE unit = column_unit GROUP BY stream, c HAVING below > 0 OR above > 0""")
def declared_limits(spark: SparkSession, d: str) -> DataFrame:
    """Columns of lines against limits that parts declare, some of them in another or an unknown unit."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in ("l_quantity", "l_discount")]))
    values = table(spark, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("stream"), cells.alias("x")).select("stream", "x.*")
    k = F.col("p_partkey")

    def limit(column: str, low: float, high: float):
        return F.struct(F.lit(column).alias("column"), F.when(k % 3 != 0, F.lit(low)).alias("lower"), F.when(k % 4 != 0, F.lit(high)).alias("upper"))

    both = F.explode(F.array(limit("l_quantity", 5.0, 45.0), limit("l_discount", 0.01, 0.09)))
    unit, column_unit = F.when(k % 5 == 0, "lb").otherwise("kg"), F.when(k % 7 != 0, "kg")
    stated = table(spark, d, "part").select(F.concat(F.lit("part:"), k).alias("stream"), unit.alias("unit"), column_unit.alias("column_unit"), both.alias("x"))
    return checks.declared_limits(values, stated.select("stream", "unit", "column_unit", "x.*"))


@plan("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <> 6 GROUP BY 1)
SELECT o_orderkey AS stream, max(s) AS stated, coalesce(max(n), 0) AS found FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) END AS s, o_orderstatus FROM orders)
LEFT JOIN n ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' AND s IS NOT NULL GROUP BY 1 HAVING max(s) <> coalesce(max(n), 0)""")
def counts_not_exempt(spark: SparkSession, d: str) -> DataFrame:
    """Orders that state another number of lines than were read, pending ones exempt; every sixth line was lost."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    told = lines.groupBy(F.col("l_orderkey").alias("stream")).agg(F.count("*").alias("told"))
    number = F.when(F.col("stream") % 11 != 0, F.coalesce("told", F.lit(0)))
    stated = orders.select(F.col("o_orderkey").alias("stream")).join(told, "stream", "left").select("stream", number.alias("stated"))
    return checks.counted(stated, lines.where("l_linenumber <> 6").select(F.col("l_orderkey").alias("stream")), orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("stream")))


@plan("""WITH r AS (SELECT user_id AS stream, event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id * 10 - (event_id % 4) * 3000 END AS tick FROM events),
p AS (SELECT *, last_value(tick IGNORE NULLS) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT stream, CASE WHEN stream % 3 = 0 THEN 'time_regression' ELSE 'time_out_of_order' END AS code, count(*) AS n, max(before - tick) AS largest FROM p WHERE tick < before GROUP BY ALL""")
def clock_falls(spark: SparkSession, d: str) -> DataFrame:
    """Clocks of users that fall; those of every third say that they never do, of every other third nothing."""
    n, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, d, "events").select(u.alias("stream"), n, F.when(n % 13 != 0, n * 10 - (n % 4) * 3000).alias("tick"), F.when(u % 3 == 0, True).when(u % 3 == 1, False).alias("steady"))
    return checks.clock_falls(rows, ["stream"], "event_id", "tick", F.col("steady"))
