"""Rules that turn facts into inferred findings: each is a function from tables to rows
``rule, subject, valid_from, text, because`` where because lists the fact ids it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import seconds_between, shifted, site_time, tokens
from ..functions.vocabulary import CHANGE_SECONDS, DEPTH, LOCKOUT, STALE_AFTER, STARVE_SECONDS, STOP_WORDS, WAIT, YES
from ..operators import graph, intervals

def says(c: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens(c), F.array(*map(F.lit, words)))


def finding(rows: DataFrame, rule: str, text: Column, because: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), "subject", "valid_from", text.alias("text"), F.array_distinct(because).alias("because"))


def starvation(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """Faults after whose start something downstream waited within two minutes."""
    faults = spans.where("predicate = 'health' AND object_text LIKE 'fault:%'").select("subject", F.col("start").alias("valid_from"), F.col("object_text").alias("fault"), "fact_id")
    walks = graph.downstream(graph.directed(edges), faults.select(F.col("subject").alias("root")).distinct(), DEPTH).select(F.col("root").alias("subject"), F.col("id").alias("who"), "d")
    waits = spans.where(F.col("predicate").isin("mode", "state") & says(F.col("object_text"), WAIT)).select(F.col("subject").alias("who"), F.col("start").alias("t"), F.col("object_text").alias("what"), F.col("fact_id").alias("wait_id"))
    hits = faults.join(walks, "subject").join(waits, "who").where((F.col("t") >= F.col("valid_from")) & (F.col("t") <= shifted(F.col("valid_from"), STARVE_SECONDS)))
    chains = hits.groupBy("subject", "valid_from", "fault", "fact_id").agg(F.sort_array(F.collect_set(F.struct("t", "who", "what", "wait_id"))).alias("steps"))
    steps = F.array_join(F.transform("steps", lambda x: F.concat(x["who"], F.lit(" "), x["what"], F.lit(" at "), x["t"])), " → ")
    return finding(chains, "starvation", F.concat("fault", F.lit(" → "), steps), F.concat(F.array("fact_id"), F.transform("steps", lambda x: x["wait_id"])))


def change_before_fault(spans: DataFrame, changes: DataFrame) -> DataFrame:
    """True value changes on a thing in the day before its fault: ``changes(subject, start, predicate, object_text, fact_id)``."""
    faults = spans.where("predicate = 'health' AND object_text LIKE 'fault:%'").select("subject", F.col("start").alias("valid_from"), F.col("object_text").alias("fault"), "fact_id")
    day = lambda c: F.substring(c, 1, 10)
    c = changes.select("subject", F.col("start").alias("t"), "predicate", F.col("object_text").alias("to"), F.col("fact_id").alias("change_id"), day(F.col("start")).alias("day"))
    # The day before a fault lies on two dates, a change on one; so pairs meet once and by thing and date.
    dated = faults.withColumn("day", F.explode(F.array(day(shifted(F.col("valid_from"), -CHANGE_SECONDS)), day(F.col("valid_from")))))
    near = dated.join(c, ["subject", "day"]).where((F.col("t") < F.col("valid_from")) & (F.col("t") >= shifted(F.col("valid_from"), -CHANGE_SECONDS)))
    return finding(near, "change before fault", F.concat("predicate", F.lit(" became "), "to", F.lit(" before "), "fault"), F.array("change_id", "fact_id"))


def stale_sources(seen: DataFrame, expected: DataFrame, at: str) -> DataFrame:
    """Sources silent for more than three of their intervals while another reported: ``expected(source, interval_seconds, fact_id)``,
    the fact that states the interval. A finding begins when the silence has lasted that long."""
    w = W.partitionBy("source").orderBy("t")
    gaps = seen.where(F.col("t") <= at).withColumn("resumed", F.lead("t").over(w)).join(expected, "source")
    long_ = gaps.withColumn("until", F.coalesce("resumed", F.lit(at))).where(seconds_between(F.col("t"), F.col("until")) > STALE_AFTER * F.col("interval_seconds"))
    long_ = long_.withColumn("stale_from", site_time(F.timestamp_seconds(F.unix_timestamp(F.to_timestamp("t", "yyyy-MM-dd'T'HH:mm:ss")) + STALE_AFTER * F.col("interval_seconds"))))
    # Reports meet gaps by the hour; inside an hour, sources' own times are compared.
    hour = lambda c: F.to_timestamp(F.concat(F.substring(c, 1, 13), F.lit(":00:00")), "yyyy-MM-dd'T'HH:mm:ss")
    reports = seen.select(hour(F.col("t")).alias("hour"), F.col("t").alias("at"), F.col("source").alias("other"))
    hours = long_.withColumn("hour", F.explode(F.sequence(hour(F.col("stale_from")), hour(F.col("until")), F.expr("INTERVAL 1 HOUR"))))
    found = hours.alias("g").join(
        reports.alias("r"), (F.col("g.hour") == F.col("r.hour")) & (F.col("r.other") != F.col("g.source")) & (F.col("r.at") > F.col("g.stale_from")) & ((F.col("r.at") < F.col("g.until")) | (F.col("g.resumed").isNull() & (F.col("r.at") == F.col("g.until")))), "left_semi"
    ).select("source", "t", "stale_from", "resumed", "fact_id").distinct()
    rows = found.select(F.concat(F.lit("source:"), F.col("source")).alias("subject"), F.col("stale_from").alias("valid_from"), "t", "resumed", "fact_id")
    return finding(rows, "stale source", F.concat(F.lit("silent since "), "t", F.lit(" until "), F.coalesce("resumed", F.lit("now"))), F.array("fact_id"))


def qualification_gap(needs: DataFrame, holders: DataFrame, start: str, end: str) -> DataFrame:
    """Stretches of [start, end] without a free holder: ``needs(subject, qualification, fact_id)``, ``holders(qualification, person, since, until, fact_id)``
    where an interval is time on shift and not on break, and the facts say what is required and held. Cut at every beginning and end; empty neighbours merge."""
    h = holders.select("qualification", F.greatest("since", F.lit(start)).alias("since"), F.least(F.coalesce("until", F.lit(end)), F.lit(end)).alias("until")).where("since < until")
    marks = (
        h.select("qualification", F.col("since").alias("t"), F.lit(1).alias("by")).unionByName(h.select("qualification", F.col("until").alias("t"), F.lit(-1).alias("by")))
        .unionByName(needs.select("qualification").distinct().select("qualification", F.explode(F.array(F.lit(start), F.lit(end))).alias("t"), F.lit(0).alias("by")))
        .groupBy("qualification", "t").agg(F.sum("by").alias("by"))
    )
    w = W.partitionBy("qualification").orderBy("t")
    cut = marks.select("qualification", F.col("t").alias("valid_from"), F.lead("t").over(w).alias("until"), F.sum("by").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("free")).where("until IS NOT NULL AND free <= 0")
    merged = cut.withColumn("opens", F.coalesce((F.lag("until").over(W.partitionBy("qualification").orderBy("valid_from")) != F.col("valid_from")).cast("int"), F.lit(1)))
    islands = merged.withColumn("no", F.sum("opens").over(W.partitionBy("qualification").orderBy("valid_from"))).groupBy("qualification", "no").agg(F.min("valid_from").alias("valid_from"), F.max("until").alias("until"))
    held = holders.groupBy("qualification").agg(F.sort_array(F.collect_set("fact_id")).alias("held"))
    required = needs.groupBy("subject", "qualification").agg(F.sort_array(F.collect_set("fact_id")).alias("required"))
    rows = required.join(islands, "qualification").join(held, "qualification", "left")
    because = F.concat("required", F.coalesce("held", F.array().cast("array<string>")))
    return finding(rows, "qualification gap", F.concat(F.lit("no free holder of "), "qualification", F.lit(" until "), "until"), because)


def regulation_check(orders: DataFrame, clauses: DataFrame, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Work orders under a clause that they share words with, one of their own and two with their asset's:
    ``orders(subject, asset, valid_from, problem, lockout, fact_id)``, ``clauses(clause, text, fact_id)``; whether a clause on lockout was kept."""
    stem = lambda w: F.regexp_replace(w, "(?<=...)(?:ing|ed|s)$", "")
    stems = lambda c: F.filter(F.array_distinct(F.transform(tokens(c), stem)), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))
    own = orders.select("subject", F.explode(stems(F.col("problem"))).alias("stem"), F.lit(1).alias("own"))
    asset = orders.select("subject", F.explode(stems(F.col("asset"))).alias("stem"), F.lit(0).alias("own"))
    words = own.unionByName(asset).groupBy("subject", "stem").agg(F.max("own").alias("own"))
    matched = words.join(clauses.select("clause", F.explode(stems(F.col("text"))).alias("stem")), "stem").groupBy("subject", "clause").agg(F.sum("own").alias("n_own"), F.count("*").alias("n")).where("n_own >= 1 AND n >= 2")
    asks = clauses.select("clause", F.col("fact_id").alias("clause_id"), says(F.col("text"), LOCKOUT).alias("asks"))
    rows = orders.join(matched, "subject").join(asks, "clause")
    told = F.when(~F.col("asks"), "applies").when(F.col("lockout") == "yes", "lockout recorded").otherwise("no lockout recorded")
    return finding(rows, "regulation", F.concat("clause", F.lit(": "), told), F.array("fact_id", "clause_id"))


def all_findings(*rules: DataFrame) -> DataFrame:
    """Findings without repetitions; the same content counts once."""
    out = rules[0]
    for more in rules[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["rule", "subject", "valid_from", "text"])


def spans(facts: DataFrame) -> DataFrame:
    """Interval history, as the rules read it."""
    return intervals.all_history(facts)
