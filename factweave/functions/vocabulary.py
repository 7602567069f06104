"""The vocabulary of a site. All of these are fixed values: answers rest on exactly these words and numbers."""

from __future__ import annotations

# Fixed values.

#: Predicates of which a thing has one value at a time, by each source; it may have many of any other at once.
ONE = (
    "part_of", "located_in", "serial", "mode", "health", "current_task", "in_zone", "battery", "setpoint", "belt_tension", "temperature", "cycle", "firmware",
    "parts_out", "task_state", "rule_text", "wo_action", "wo_cause", "wo_by", "wo_loto", "wo_opened", "wo_closed", "wo_problem", "wo_note", "change_from",
    "change_to", "change_by", "change_reason", "report_interval", "metric", "target", "unmapped",
)
#: Predicates that the topology walks.
TOPOLOGY = ("feeds", "depends_on", "located_in", "part_of", "assigned_to", "covers_zone")
#: Predicates that are reported as unknown where no source states them, by type.
EXPECTED = {"robot": ("mode", "health", "battery"), "machine": ("mode", "health", "belt_tension"), "cell": ("parts_out",)}
#: Predicates of proposals, which an answer settles.
PROPOSALS = ("same_as", "proposed_action")
#: Predicates of the status question.
STATUS = ("mode", "health", "task_state", "battery", "current_task", "in_zone", "parts_out", "setpoint")
#: Report intervals after which a silent source is stale.
STALE_AFTER = 3

#: Words of states.
WAIT = ("idle", "starved", "starving", "starve", "waiting", "wait", "blocked")
DOWN = ("starved", "starving", "starve", "waiting", "wait", "blocked", "stopped", "stop", "fault", "faulted", "error", "estop", "down")
LOCKOUT = ("lockout", "loto", "lock")
YES = ("yes", "y", "true", "1")
STOP_WORDS = (
    "the", "and", "only", "under", "for", "per", "with", "person", "are", "shall", "after", "must", "when", "who", "this", "that", "than", "from", "into", "each", "any", "all", "not",
)
#: Predicates of changes that may precede a fault.
CHANGES = ("change", "work_order", "setpoint", "firmware")
#: Seconds from a fault to a wait of its chain, and from a change to a fault; steps of a chain.
STARVE_SECONDS, CHANGE_SECONDS, DEPTH = 120, 86400, 3

#: Of hypothesis checks: ratios that support and reject, fewest events, smallest share of observed time on a side, seconds of silence that end it.
SUPPORT, REJECT, MIN_EVENTS, MIN_SHARE, GAP_SECONDS = 2.0, 1.25, 3, 0.05, 900

#: Actions and the type of thing that each needs.
VERBS = {"pause": "robot", "resume": "robot", "send_to": "robot", "cancel_task": "robot", "page": "person"}

#: Endings of files whose citations count as records; any other file is a document.
RECORD_FILES = (".csv", ".tsv", ".xlsx", ".json", ".jsonl", ".yaml")
#: Predicates, types and length of the timeline.
TIMELINE, ASSETS, TIMELINE_ROWS = ("mode", "health", "in_zone"), ("robot", "machine", "cell"), 120
