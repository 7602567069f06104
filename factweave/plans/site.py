"""The query surface of a site: named questions over its log, each with a cited answer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import fact_id, seconds_between, shifted
from ..functions.vocabulary import CHANGE_SECONDS, CHANGES, DOWN, EXPECTED, PROPOSALS, STALE_AFTER, STATUS, VERBS
from ..operators import graph, intervals, state
from ..sources.log import append, facts_of, read_log
from . import insights

ITEMS, ROWS = 200, 50
#: Findings that began so long before the moment asked about are shown, and those still open; the source of actions.
RECENT_SECONDS, ACTIONS = 7200, "factweave.actions"
MOVING = ("robot", "machine", "cell")


@dataclass
class Answer:
    """Rows for people: at most ``ITEMS`` of them, how many were left out, and what is missing."""

    columns: list[str]
    rows: list[tuple]
    omitted: int = 0
    gaps: list[str] = field(default_factory=list)

    def render(self) -> str:
        lines = [" | ".join(self.columns)] + [" | ".join("" if v is None else str(v) for v in r) for r in self.rows]
        return "\n".join(lines + ([f"({self.omitted} more)"] if self.omitted else []) + [f"gap: {g}" for g in self.gaps])


def answer(rows: DataFrame, *order: str, most: int = ITEMS) -> Answer:
    """The first rows in order; one row too many is asked for, and only then is the rest counted."""
    found = rows.orderBy(*order).limit(most + 1).collect()
    omitted = rows.count() - most if len(found) > most else 0
    return Answer(rows.columns, [tuple(r) for r in found[:most]], omitted)


class Site:
    """A site's log as tables, as known at ``as_of``."""

    def __init__(self, spark: SparkSession, log: DataFrame | str, as_of: int | None = None) -> None:
        self.spark, self.path = spark, log if isinstance(log, str) else None
        self.log = read_log(spark, log, as_of) if isinstance(log, str) else log if as_of is None else log.where(F.col("seq") <= as_of)
        flat = facts_of(self.log)
        self.confirms = self.log.where("type = 'confirm'").select("seq", "confirm.*")
        self.seen = self.log.where("type = 'seen'").select("seen.source", "seen.t")
        said = state.first_said(flat.withColumn("fact_id", fact_id(flat)))
        self.said = said
        self.facts = state.live(said, self.confirms).unionByName(state.stated_copies(said, self.confirms))
        paced = self.facts.where("predicate = 'report_interval'").select(F.regexp_replace("subject", "^source:", "").alias("source"), F.col("object_text").try_cast("double").alias("interval_seconds"), "fact_id", "seq")
        #: What each source last stated of the seconds between its reports.
        self.pace = paced.where("interval_seconds IS NOT NULL").groupBy("source").agg(F.max_by(F.struct("interval_seconds", "fact_id"), "seq").alias("x")).select("source", "x.interval_seconds", "x.fact_id")

    def clock(self) -> str | None:
        """The last report, or without any the last observation."""
        t = self.seen.agg(F.max("t")).first()[0]
        return t or self.facts.where("kind = 'observed'").agg(F.max("valid_from")).first()[0]

    def same_as(self) -> DataFrame:
        e = self.facts.where("predicate = 'same_as' AND kind <> 'inferred'")
        numbered = e.select(F.col("subject").alias("a"), F.col("object_text").alias("b"))
        return graph.components(numbered, "same-as")

    def group(self, entity: str) -> list[str]:
        """The names that are stated to be the same thing; a site's own count, not the corpus's."""
        c = self.same_as()
        root = c.where(F.col("id") == entity).select("root")
        return [r[0] for r in c.join(root, "root", "left_semi").select("id").collect()] or [entity]

    def resolve(self, name: str) -> Answer:
        low = name.lower()
        named = self.facts.where(F.col("predicate").isin("name", "serial", "same_as"))
        hits = named.where((F.lower("subject") == low) | (F.substring_index(F.lower("subject"), ":", -1) == low) | F.contains(F.lower("object_text"), F.lit(low)))
        return answer(hits.select("subject", "predicate", "object_text", "kind").distinct(), "subject", "predicate", "object_text")

    def readings(self, at: str | None = None) -> DataFrame:
        """Readings at a time, the clock's unless one is given, with a row for what should be known of a thing and isn't."""
        found = state.all_readings(self.facts, self.seen, at or self.clock() or "", self.pace.select("source", "interval_seconds"))
        ids = self.entities().select(F.col("id").alias("subject"), "type")
        expected = self.spark.createDataFrame([(t, p) for t, ps in EXPECTED.items() for p in ps], "type string, predicate string")
        return found.unionByName(state.expected_unknown(found, ids, expected), allowMissingColumns=True)

    def state_at(self, entity: str, at: str | None = None) -> Answer:
        return answer(self.readings(at).where(F.col("subject").isin(self.group(entity))), "subject", "predicate", "object_text")

    def status(self, at: str | None = None) -> Answer:
        return answer(self.readings(at).where(F.col("predicate").isin(*STATUS)), "subject", "predicate", "object_text")

    def find(self, predicate: str, value: str, at: str | None = None) -> Answer:
        return answer(self.readings(at).where((F.col("predicate") == predicate) & (F.col("object_text") == value)), "subject")

    def intervals(self) -> DataFrame:
        return intervals.all_history(self.facts)

    def timeline(self, entity: str, start: str, end: str, predicates: Sequence[str] | None = None) -> Answer:
        rows = self.intervals().where((F.col("subject") == entity) & (F.col("start") <= end) & (F.col("end").isNull() | (F.col("end") > start)))
        if predicates:
            rows = rows.where(F.col("predicate").isin(*predicates))
        return answer(rows.select("start", "end", "predicate", "object_text", "source", "kind"), "start", "predicate")

    def diff(self, start: str, end: str) -> Answer:
        rows = self.intervals().where((F.col("start") > start) & (F.col("start") <= end))
        return answer(rows.select("start", "subject", "predicate", "object_text", "source"), "start", "subject", "predicate")

    def why(self, entity: str, predicate: str) -> Answer:
        """What was said, what it replaced, and where it is written."""
        from pyspark.sql import Window as W

        w = W.partitionBy("source").orderBy("start", "seq")
        rows = self.intervals().where((F.col("subject") == entity) & (F.col("predicate") == predicate))
        out = rows.select("start", "object_text", F.lag("object_text").over(w).alias("replaced"), F.lead("object_text").over(w).alias("replaced_by"), "source", "kind", F.transform("citations", lambda c: F.concat_ws("#", c["file"], c["locator"])).alias("cited"))
        return answer(out, "start", "source")

    def gaps(self, at: str | None = None) -> Answer:
        """What isn't known, what waits for an answer, and rows that no mapping reads."""
        rows = self.readings(at).where("state <> 'known'").select("subject", "predicate", "object_text", "state")
        asked = self.proposals().where("predicate <> 'same_as'").select("subject", "predicate", "object_text", F.lit("pending").alias("state"))
        unread = self.facts.where("predicate = 'unmapped'").select("subject", "predicate", "object_text", F.lit("unmapped").alias("state"))
        return answer(rows.unionByName(asked).unionByName(unread), "subject", "predicate", "object_text")

    def topology(self, at: str | None = None) -> DataFrame:
        return state.topology(self.facts, at)

    def impact(self, entity: str, depth: int = 3, at: str | None = None) -> Answer:
        """What hangs on a thing, by the topology of a moment, the clock's unless one is given."""
        edges = graph.directed(self.topology(at or self.clock()))
        roots = self.spark.createDataFrame([(entity,)], "root string")
        out = graph.downstream(edges, roots, depth)
        return answer(out.select("d", "id", F.transform("path", lambda e: F.concat_ws(" ", e["subject"], e["predicate"])).alias("path")), "d", "id")

    def search(self, text: str, most: int = 20) -> Answer:
        """Facts whose quotes, files or value have all words; most mentions of the first word first."""
        words = [w for w in text.lower().split() if w]
        hay = F.lower(F.concat_ws(" ", "object_text", F.array_join(F.transform("citations", lambda c: F.concat_ws(" ", c["quote"], c["file"])), " ")))
        hits = self.facts.withColumn("hay", hay)
        for w in words:
            hits = hits.where(F.contains("hay", F.lit(w)))
        score = (F.length("hay") - F.length(F.replace("hay", F.lit(words[0]), F.lit("")))) / len(words[0]) if words else F.lit(0)
        top = hits.select("seq", "subject", "predicate", "object_text", score.cast("int").alias("score")).orderBy(F.desc("score"), "seq").limit(most)
        return Answer(top.columns, [tuple(r) for r in top.collect()])

    def changes(self, after: int) -> Answer:
        return answer(self.facts.where(F.col("seq") > after).select("seq", "subject", "predicate", "object_text", "kind"), "seq")

    def proposals(self) -> DataFrame:
        return self.facts.where((F.col("kind") == "inferred") & F.col("predicate").isin(*PROPOSALS))

    def pending(self) -> Answer:
        """Proposals that nobody has answered."""
        return answer(self.proposals().select("fact_id", "subject", "predicate", "object_text"), "fact_id")

    # Findings, people and reports.

    def findings(self, at: str | None = None) -> DataFrame:
        """What the rules on chains, changes and silent sources infer of all that began by a moment."""
        at = at or self.clock() or ""
        spans = insights.spans(self.facts).where(F.col("start") <= at)
        by = insights.W.partitionBy("subject", "predicate", "source").orderBy("start", "seq")
        one = spans.where(F.col("predicate").isin("setpoint", "firmware"))
        replaced = one.withColumn("__was", F.lag("object_text").over(by)).where("__was IS NOT NULL AND __was <> object_text").drop("__was")
        changes = spans.where(F.col("predicate").isin(*CHANGES) & ~F.col("predicate").isin("setpoint", "firmware")).unionByName(replaced)
        # A change on anything that is stated to be the same counts for all of its names.
        roots = self.same_as().select(F.col("id").alias("subject"), F.col("root").alias("__root"))
        named = changes.join(roots, "subject", "left").withColumn("__root", F.coalesce("__root", "subject")).drop("subject")
        alias = roots.unionByName(changes.select("subject", F.col("subject").alias("__root")).join(roots, "subject", "left_anti").distinct())
        return insights.all_findings(
            insights.starvation(spans, self.topology(at)), insights.change_before_fault(spans, named.join(alias, "__root").drop("__root")), insights.stale_sources(self.seen.distinct(), self.pace, at),
        )

    def insights(self, at: str | None = None, since: str | None = None) -> Answer:
        """Findings that began since a moment, two hours ago unless one is given, and silences that last; earlier ones are counted."""
        now = at or self.clock() or ""
        since = since if since is not None else self.spark.range(1).select(shifted(F.lit(now), -RECENT_SECONDS)).first()[0] if at else ""
        found = self.findings(now)
        current = (F.col("valid_from") >= since) | F.col("text").endswith(" until now")
        out = answer(found.where(current).select("rule", "subject", "valid_from", "text", F.array_join("because", ", ").alias("because")), "valid_from", "subject", "rule")
        if earlier := found.where(~current).count():
            out.gaps.append(f"{earlier} earlier findings, before {since}")
        out.gaps.append("findings are inferred by rules: they say what came together, not what caused what")
        return out

    def requirements(self, entity: str, at: str) -> DataFrame:
        """``required_by, qualification, fact_id``: what a document or rule asks for that names the thing, by a whole word of three letters
        or more, or covers the zone in which it is."""
        group = self.group(entity)
        mine = self.facts.where(F.col("subject").isin(group))
        names = [r[0] for r in mine.where("predicate = 'name'").select("object_text").distinct().collect() if len(r[0]) >= 3]  # of one thing
        zones = mine.where(F.col("predicate").isin("located_in", "in_zone") & state.holds_at(at)).select("object_text").distinct()
        told = self.facts.where(F.col("predicate").isin("name", "rule_text")).groupBy("subject").agg(F.array_join(F.collect_list("object_text"), " ").alias("told"))
        covers = self.facts.where("predicate = 'covers_zone'").join(zones, "object_text", "left_semi").select("subject", F.lit(True).alias("covers")).distinct()
        quotes = F.array_join(F.transform("citations", lambda c: F.coalesce(c["quote"], F.lit(""))), " ")
        text = F.lower(F.concat_ws(" ", "told", quotes))
        word = r"[\p{L}\p{N}_]"
        named = text.rlike("|".join(rf"(?<!{word})\Q{n.lower()}\E(?!{word})" for n in names)) if names else F.lit(False)
        asked = self.facts.where("predicate = 'requires_qualification'").join(told, "subject", "left").join(covers, "subject", "left")
        return asked.where(F.coalesce(named, F.lit(False)) | F.col("covers").isNotNull()).select(F.col("subject").alias("required_by"), F.col("object_text").alias("qualification"), "fact_id")

    def who_can(self, entity: str, at: str | None = None) -> Answer:
        """Who holds what is required to work on a thing, and whether they are free: on shift and not on break."""
        at = at or self.clock() or ""
        asked = self.requirements(entity, at)
        held = self.facts.where((F.col("predicate") == "holds_qualification") & (F.col("valid_from").isNull() | (F.substring("valid_from", 1, 19) <= at)))
        there = lambda p, name: self.facts.where((F.col("predicate") == p) & state.holds_at(at)).select(F.col("subject").alias("person"), F.lit(True).alias(name)).distinct()
        people = held.select(F.col("object_text").alias("qualification"), F.col("subject").alias("person")).distinct()
        rows = asked.join(people, "qualification", "left").join(there("on_shift", "shift"), "person", "left").join(there("on_break", "pause"), "person", "left")
        status = F.when(F.col("person").isNull(), "nobody holds it").when(F.col("pause"), "on break").when(F.col("shift"), "free").otherwise("not on shift")
        status = F.when(F.col("pause").isNotNull() & F.col("shift").isNull(), "on break").otherwise(status)
        out = answer(rows.select("qualification", "required_by", "person", status.alias("status")), "qualification", "person", "required_by")
        if not out.rows:
            out.gaps.append(f"no rule or document names {entity} or its zone")
        for q in sorted({r[0] for r in out.rows}):
            if not any(r[0] == q and r[3] == "free" for r in out.rows):
                out.gaps.append(f"no holder of {q} is on shift and off break" if any(r[0] == q and r[2] for r in out.rows) else f"nobody holds {q}")
        return out

    def shift_report(self, start: str, end: str) -> dict[str, Answer]:
        """Sections of a stretch of time: who was on, what went down, findings by rule, what changed since the day before, what waits and is unknown."""
        clock = self.clock() or end
        at = min(clock, end)
        spans = self.intervals().where((F.col("start") <= at) & (F.col("end").isNull() | (F.col("end") > start)))
        told = lambda rows: answer(rows.select("subject", "predicate", "object_text", "start", "end"), "start", "subject", "predicate")
        kind = F.substring_index("subject", ":", 1)
        down = kind.isin(*MOVING) & F.col("predicate").isin("health", "mode") & (F.col("object_text").startswith("fault:") | insights.says(F.col("object_text"), DOWN))
        found = self.findings(at).where((F.col("valid_from") <= end) & (F.col("valid_from") > shifted(F.lit(start), -CHANGE_SECONDS)))
        rule = lambda name: answer(found.where(F.col("rule") == name).select("subject", "valid_from", "text"), "valid_from", "subject")
        shifts = self.facts.where("predicate = 'on_shift'").where(F.col("valid_to") <= start).agg(F.max("valid_to")).first()[0]
        since = shifts or self.spark.range(1).select(shifted(F.lit(start), -CHANGE_SECONDS)).first()[0]
        out = {
            "on shift": told(spans.where(F.col("predicate").isin("on_shift", "on_break"))), "what happened": told(spans.where(down)), "chains": rule("starvation"), "stale sources": rule("stale source"),
            "changes before faults": rule("change before fault"), f"changes since {since}": told(self.intervals().where(F.col("predicate").isin(*CHANGES) & (F.col("start") > since) & (F.col("start") <= at))),
            "pending": self.pending(), "unknown": answer(self.readings(at).where("state IN ('unknown', 'ambiguous')").select("subject", "predicate", "object_text", "state"), "subject", "predicate", "object_text"),
        }
        if clock < end:
            out["unknown"].gaps.append(f"the log ends at {clock}, before {end}")
        return out

    # Actions: a proposal, a person's answer, and what became of it.

    def actions(self) -> Answer:
        """Every proposed action with its status: pending, rejected, logged (a page), approved, dispatched, done or not observed."""
        asked = self.said.where("predicate = 'proposed_action'").where(F.col("source") == ACTIONS)
        last = self.confirms.groupBy("proposal").agg(F.max_by("answer", "seq").alias("answer"), F.max_by("by", "seq").alias("by"))
        after = lambda p: self.said.where(F.col("predicate") == p).select(F.regexp_extract("object_text", "^(fact:[0-9a-f]+):", 1).alias("fact_id"), F.col("object_text").alias(p)).groupBy("fact_id").agg(F.min(p).alias(p))
        rows = asked.join(last, asked["fact_id"] == last["proposal"], "left").join(after("dispatched"), "fact_id", "left").join(after("outcome"), "fact_id", "left")
        status = (
            F.when(F.col("answer").isNull(), "pending").when(F.col("answer") == "no", "rejected").when(F.contains("outcome", F.lit(": done")), "done").when(F.col("outcome").isNotNull(), "not observed")
            .when(F.col("dispatched").isNotNull(), "dispatched").when(F.substring_index("object_text", " ", 1) == "page", "logged").otherwise("approved")
        )
        return answer(rows.select("fact_id", "subject", "object_text", status.alias("status"), "by", "seq"), "seq")

    def _log(self, **entry: object) -> int:
        if self.path is None:
            raise ValueError("a site that was read from a table cannot be written to")
        row = {"type": None, "fact": None, "seen": None, "confirm": None} | entry
        return append(self.spark.createDataFrame([row], self.log.drop("seq").schema).withColumn("__at", F.lit(0)), self.path, ["__at"])

    def propose(self, action: str, target: str, reason: str, cites: Sequence[str], zone: str | None = None) -> str:
        """Logs an inferred action on a thing, which cites the facts that speak for it; returns its id."""
        ids = self.entities()
        known = lambda x, kind: x is not None and x.startswith(f"{kind}:") and not ids.where(F.col("id") == x).isEmpty()
        if action not in VERBS or not known(target, VERBS[action]):
            raise ValueError(f"{action} needs a known {VERBS.get(action, 'action')}, not {target}")
        if (action == "send_to") != (zone is not None) or (zone is not None and not known(zone, "zone")):
            raise ValueError(f"send_to, and nothing else, needs a known zone, not {zone}")
        support = {r[0]: r[1] for r in self.said.where(F.col("fact_id").isin(list(cites))).select("fact_id", "citations").collect()}  # the ids given
        if not reason.strip() or not cites or set(cites) - set(support):
            raise ValueError("an action needs a reason and facts that are in the log")
        cited = [{"file": "actions", "locator": action, "quote": reason}] + [c.asDict() for i in cites for c in support[i] or []]
        text = action if zone is None else f"{action} {zone}"
        fact = {"subject": target, "predicate": "proposed_action", "object": {"ref": None, "value": text, "unit": None}, "valid_from": self.clock(), "valid_to": None, "kind": "inferred", "source": ACTIONS, "citations": cited, "model": None}
        seq = self._log(type="fact", fact=fact)
        return Site(self.spark, self.path).said.where(F.col("seq") == seq).select("fact_id").first()[0]

    def _answer(self, proposal: str, answer_: str, by: str) -> int:
        if self.proposals().where(F.col("fact_id") == proposal).isEmpty():
            raise ValueError(f"{proposal} is no open proposal")
        return self._log(type="confirm", confirm={"proposal": proposal, "answer": answer_, "by": by})

    def approve(self, proposal: str, by: str) -> int:
        """A person's yes: the proposal steps back and its stated copy holds. Nothing is sent."""
        return self._answer(proposal, "yes", by)

    def reject(self, proposal: str, by: str) -> int:
        return self._answer(proposal, "no", by)

    def sql(self, text: str) -> Answer:
        """A read-only query over facts, intervals, seen and entities; errors become gaps.

        The text is parsed before it is run, since commands would run at once.
        """
        try:
            parsed = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
            kinds = [parsed.getClass().getSimpleName()] + [parsed.collectLeaves().apply(i).getClass().getSimpleName() for i in range(parsed.collectLeaves().size())]
            if any("Command" in k or k.startswith(("Create", "Drop", "Insert", "Alter", "Set", "Replace", "Delete", "Merge", "Truncate", "Cache", "Uncache", "Describe", "Show", "Add", "Refresh", "Load")) for k in kinds):
                return Answer([], [], gaps=["only queries are answered"])
            for name, rows in self.tables().items():
                rows.createOrReplaceTempView(name)
            out = self.spark.sql(text)
            found = out.limit(ROWS + 1).collect()
        except Exception as e:  # any error of the query is the asker's to see
            return Answer([], [], gaps=[str(e).splitlines()[0]])
        return Answer(out.columns, [tuple(r) for r in found[:ROWS]], gaps=[f"only the first {ROWS} rows"] if len(found) > ROWS else [])

    def entities(self) -> DataFrame:
        both = F.explode(F.array_distinct(F.when(F.col("object_is_ref"), F.array("subject", "object_text")).otherwise(F.array("subject"))))
        ids = self.facts.select(both.alias("id")).distinct()
        names = self.facts.where("predicate = 'name'").groupBy(F.col("subject").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "object_text"))), lambda x: x["object_text"]), "; ").alias("names"))
        return ids.join(names, "id", "left").withColumn("type", F.substring_index("id", ":", 1))

    def tables(self) -> dict[str, DataFrame]:
        return {"facts": self.facts, "intervals": self.intervals(), "seen": self.seen, "entities": self.entities(), "downtime": self.downtime(), "utilisation": self.utilisation(), "fault_clear_time": self.fault_clear_time()}

    def clocked(self) -> DataFrame:
        """Intervals that began by the clock; ``until`` is the clock where one is open."""
        clock = self.clock() or ""
        return self.intervals().where(F.col("start") <= clock).withColumn("until", F.coalesce("end", F.lit(clock)))

    def downtime(self) -> DataFrame:
        """Modes that mean down, with the first work order that was opened on the thing meanwhile and its cause."""
        down = self.clocked().where((F.col("predicate") == "mode") & F.substring_index("subject", ":", 1).isin(*MOVING) & insights.says(F.col("object_text"), DOWN))
        roots = self.same_as().select(F.col("id").alias("subject"), "root")
        orders = self.facts.where("predicate = 'work_order'").select("subject", F.col("object_text").alias("work_order"), F.col("valid_from").alias("opened"))
        causes = self.facts.where("predicate = 'wo_cause'").groupBy(F.col("subject").alias("work_order")).agg(F.min_by("object_text", "seq").alias("cause"))
        rooted = lambda rows: rows.join(roots, "subject", "left").withColumn("root", F.coalesce("root", "subject"))
        asked = rooted(orders).drop("subject").join(causes, "work_order", "left")
        met = rooted(down).select("root", "fact_id", "start", "until").join(asked, "root").where((F.col("opened") >= F.col("start")) & (F.col("opened") <= F.col("until")))
        first = met.groupBy("fact_id").agg(F.min(F.struct("opened", "work_order", "cause")).alias("wo"))
        return down.join(first, "fact_id", "left").select("subject", F.col("object_text").alias("mode"), "start", "end", seconds_between(F.col("start"), F.col("until")).alias("seconds"), "wo.cause", "wo.work_order", "fact_id")

    def utilisation(self) -> DataFrame:
        """Seconds by robot and mode in which the device, or without reports of its own the source, kept reporting."""
        spans = self.clocked().where("predicate = 'mode' AND subject LIKE 'robot:%'")
        keys = self.seen.select(F.col("source").alias("key")).distinct()
        own = spans.withColumn("key", F.concat_ws("/", "source", F.regexp_replace("subject", "^[^:]*:", "")))
        keyed = own.join(keys.withColumn("has", F.lit(True)), "key", "left").withColumn("key", F.when(F.col("has"), F.col("key")).otherwise(F.col("source"))).drop("has")
        w = insights.W.partitionBy("source").orderBy("t")
        steps = self.seen.distinct().withColumn("next", F.lead("t").over(w)).where("next IS NOT NULL").withColumnRenamed("source", "key")
        paced = steps.join(self.pace.select(F.col("source").alias("p"), "interval_seconds"), F.substring_index("key", "/", 1) == F.col("p"), "left")
        kept = paced.where(seconds_between(F.col("t"), F.col("next")) <= STALE_AFTER * F.coalesce("interval_seconds", F.lit(0))).select("key", F.col("t").alias("start2"), F.col("next").alias("end2"))
        spans = keyed.select("key", "subject", F.col("object_text").alias("mode"), "start", F.col("until").alias("end"))
        met = intervals.overlap_join(spans, kept, ["key"], 86400).select("subject", "mode", seconds_between(F.greatest("start", "start2"), F.least("end", "end2")).alias("seconds"))
        every = met.unionByName(spans.select("subject", "mode", F.lit(0).cast("long").alias("seconds")))
        return every.groupBy("subject", "mode").agg(F.sum("seconds").alias("seconds"))

    def fault_clear_time(self) -> DataFrame:
        faults = self.clocked().where("predicate = 'health' AND object_text LIKE 'fault:%'")
        return faults.select("subject", F.col("object_text").alias("fault"), "start", F.col("end").alias("cleared"), seconds_between(F.col("start"), F.col("end")).alias("seconds"), "fact_id")
