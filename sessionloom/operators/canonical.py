"""The canonical session: its schema, rendering, deduplication text and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.text import strip

#: Names of roles and of event types.
ROLES = ("system", "user", "assistant", "tool", "environment")
TYPES = ("message", "tool_call", "tool_result", "observation", "artifact", "state_change", "decision", "action_summary")

EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "role", "type", "content", "name", "arguments", "status", "timestamp", "metadata")]
)
EVENTS = T.ArrayType(EVENT)
ATOM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "type", "value", "key", "metadata")]
    + [T.StructField("evidence_event_ids", T.ArrayType(T.StringType()))]
)
PROBE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "prompt", "probe_type", "reference", "split", "metadata")]
    + [T.StructField("answerable", T.BooleanType()), T.StructField("evidence_event_ids", T.ArrayType(T.StringType()))]
)
SESSION = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("events", EVENTS),
        T.StructField("memory_atoms", T.ArrayType(ATOM)),
        T.StructField("probes", T.ArrayType(PROBE)),
        T.StructField("provenance", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)


def parse_events(col: Column) -> Column:
    """Canonical events of an ``events_json`` text: trimmed, nulls empty, type ``message`` by default; null stays null."""
    return F.transform(F.from_json(col, EVENTS), clean_event)


def clean_event(e: Column) -> Column:
    kind = strip(e["type"])
    fields = [strip(e[n]).alias(n) for n in ("id", "role", "content", "name", "status", "timestamp")]
    return F.struct(
        *fields[:2],
        F.when(kind == "", "message").otherwise(kind).alias("type"),
        *fields[2:4],
        e["arguments"].alias("arguments"),
        *fields[4:],
        e["metadata"].alias("metadata"),
    )


def render(session_id: Column, source: Column, domain: Column, events: Column) -> Column:
    """The text of a session: a header line, then a label line and the content of each event."""
    header = F.concat(
        F.lit("[Session | id="), strip(session_id), F.lit(" | source="), strip(source), F.lit(" | domain="), strip(domain), F.lit("]")
    )
    lines = F.flatten(F.transform(events, _event_lines))
    return F.regexp_replace(F.array_join(F.concat(F.array(header), lines), "\n"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


#: Labels of the roles' messages and of the other event types.
MESSAGE_LABELS = {r: f"{r.capitalize()} Message" for r in ROLES}
TYPE_LABELS = {
    "tool_call": "Tool Call",
    "tool_result": "Tool Result",
    "observation": "Observation",
    "artifact": "Artifact Observation",
    "state_change": "State Change",
    "decision": "Decision",
    "action_summary": "Action Summary",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _event_lines(e: Column) -> Column:
    is_call, is_result = e["type"] == "tool_call", e["type"] == "tool_result"
    label = F.when(e["type"] == "message", _lookup(MESSAGE_LABELS, e["role"])).otherwise(_lookup(TYPE_LABELS, e["type"]))
    name = F.when(is_call | (is_result & (e["name"] != "")), F.concat(F.lit(" | name="), e["name"])).otherwise("")
    status = F.when(is_result & (e["status"] != ""), F.concat(F.lit(" | status="), e["status"])).otherwise("")
    head = F.concat(F.lit("["), label, F.lit(" | id="), e["id"], name, status, F.lit("]"))
    call = F.concat(
        F.array(head, F.coalesce(e["arguments"], F.lit("{}"))),
        F.when(e["content"] != "", F.array(e["content"])).otherwise(F.array().cast("array<string>")),
    )
    return F.when(is_call, call).otherwise(F.array(head, e["content"]))


def dedup_text(events: Column) -> Column:
    """What a session says without its ids: role, type, name, content, status and arguments of each event."""
    parts = F.transform(
        events,
        lambda e: F.array(e["role"], e["type"], e["name"], e["content"], e["status"], F.coalesce(e["arguments"], F.lit(""))),
    )
    return F.array_join(F.filter(F.flatten(parts), lambda x: x != ""), "\n")


def first_error(session_id: Column, events: Column, probes: Column | None = None, atoms: Column | None = None, references: bool = True) -> Column:
    """The first rule that a session breaks, or null. Rules are tried in a fixed order.

    Nonempty id and events; unique event ids; known roles and types; a name for calls and content for all
    else; unique atom and probe ids; evidence among the events; answerable if and only if there is evidence;
    a reference for each answerable probe where ``references`` is set.
    """
    ids = F.transform(events, lambda e: e["id"])
    rules = [
        (F.coalesce(strip(session_id), F.lit("")) == "", "session_id"),
        (events.isNull() | (F.size(events) == 0), "events"),
        (F.exists(ids, lambda i: i == ""), "event_id"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_event_id"),
        (F.exists(events, lambda e: ~e["role"].isin(*ROLES)), "role"),
        (F.exists(events, lambda e: ~e["type"].isin(*TYPES)), "type"),
        (F.exists(events, lambda e: (e["type"] == "tool_call") & (e["name"] == "")), "tool_call_name"),
        (F.exists(events, lambda e: (e["type"] != "tool_call") & (e["content"] == "")), "content"),
    ]
    for items, what in ((atoms, "atom"), (probes, "probe")):
        if items is None:
            continue
        own = F.transform(items, lambda x: x["id"])
        rules += [
            (F.size(F.array_distinct(own)) < F.size(own), f"duplicate_{what}_id"),
            (F.exists(items, lambda x: F.size(F.array_except(x["evidence_event_ids"], ids)) > 0), f"{what}_evidence"),
        ]
    if probes is not None:
        rules.append((F.exists(probes, lambda p: p["answerable"] != (F.size(p["evidence_event_ids"]) > 0)), "answerable"))
        if references:
            rules.append((F.exists(probes, lambda p: p["answerable"] & (strip(p["reference"]) == "")), "reference"))
    out = None
    for broken, reason in rules:
        out = F.when(broken, reason) if out is None else out.when(broken, reason)
    return out


def sessions_with_events(sessions: DataFrame) -> DataFrame:
    """One row for each session_id (its first row by session_index), with parsed ``events``."""
    return first_rows(sessions, ["session_id"], ["session_index", "events_json"]).withColumn("events", parse_events(F.col("events_json")))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, nulls first, as a combinable aggregate instead of a window.

    ``order`` must tell rows apart that differ; a hot key is combined before it moves.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def content_digest(fields: tuple[str, ...]) -> Column:
    """SHA-256 of the named columns with their names, in order; nulls differ from empty texts."""
    return F.sha2(F.concat_ws("\0", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("~"))) for c in fields]), 256)
