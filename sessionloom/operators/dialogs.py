"""Service dialogs and coding trajectories, whose records nest differently from row to row, read from their JSON.

What a record holds may be a list of records, lists by field, or one record, so that no one schema fits; each record is
read alone in an Arrow batch, and comes out under the canonical schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sessionloom.operators.canonical import ATOM, EVENTS, PROBE

#: The questions about states, calls and results of services.
STATE_QUESTION = "What value is stored for {slot} in {service}?"
CALL_QUESTION = "Which service method was called for {service}?"
RESULT_QUESTION = "What value did {service} return for {slot}?"


def compact(value: object) -> str:
    """JSON with sorted keys and without blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def listed(value: object) -> list:
    """A list as it is, nothing as none, anything else as one."""
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def records(value: object) -> list[dict]:
    """The records of a list, of lists by field (shorter ones are filled with null), or of one record."""
    if isinstance(value, (list, tuple)):
        return [r for r in value if isinstance(r, dict)]
    if not isinstance(value, dict):
        return []
    if not value or not all(isinstance(own, list) for own in value.values()):
        return [value]
    rows = max(map(len, value.values()))
    return [{k: own[i] if i < len(own) else None for k, own in value.items()} for i in range(rows)]


def named(value: object, names: str, values: str) -> list[tuple[str, object]]:
    """Names and values that stand in two parallel lists of a record, or else its fields."""
    if not isinstance(value, dict):
        return []
    if names in value or values in value:
        return [(str(n), v) for n, v in zip(listed(value.get(names)), listed(value.get(values)))]
    return [(str(n), v) for n, v in value.items()]


def _said(value: object) -> str:
    return "" if value is None else str(value).strip()


class Canonical:
    """A session under construction: events with dense ids, and facts, each with a probe."""

    def __init__(self):
        self.events: list[dict] = []
        self.atoms: list[dict] = []
        self.probes: list[dict] = []

    def event(self, role: str, kind: str, content: str = "", **more: str) -> str:
        own = {"id": f"e{len(self.events)}", "role": role, "type": kind, "content": content, "name": "", "status": "", "timestamp": ""}
        self.events.append(own | more)
        return own["id"]

    def fact(self, kind: str, key: str, value: str, event: str, question: str) -> None:
        if value := value.strip():
            shared = {"evidence_event_ids": [event]}
            self.atoms.append({"id": f"m{len(self.atoms)}", "type": kind, "key": key, "value": value} | shared)
            self.probes.append({"id": f"p{len(self.probes)}", "prompt": question, "probe_type": kind, "reference": value, "split": "", "answerable": True} | shared)


def service_dialog(turns: object) -> Canonical:
    """Each turn's text, then of each frame the states, calls and results, each with its facts."""
    out = Canonical()
    for turn in records(turns):
        speaker = "user" if _said(turn.get("speaker")).upper() == "USER" else "assistant"
        if text := _said(turn.get("utterance")):
            out.event(speaker, "message", text)
        for frame in records(turn.get("frames")):
            service = _said(frame.get("service", "service")) or "service"
            for state in records(frame.get("state")):
                _state(out, service, state)
            for call in records(frame.get("service_call")):
                _call(out, service, call)
            for result in records(frame.get("service_results")):
                _result(out, service, result)
    return out


def _state(out: Canonical, service: str, state: dict) -> None:
    slots = state.get("slot_values", {})
    pairs = named(slots, "slot_name", "slot_value_list")
    if not pairs and not _said(state.get("active_intent")):
        return
    event = out.event("environment", "state_change", compact({"service": service, "active_intent": state.get("active_intent", ""), "slot_values": slots}))
    for slot, value in pairs:
        out.fact("task_state", f"{service}.{slot}", ", ".join(map(str, listed(value))), event, STATE_QUESTION.format(slot=slot, service=service))


def _call(out: Canonical, service: str, call: dict) -> None:
    if not (method := _said(call.get("method"))):
        return
    arguments = dict(named(call.get("parameters", {}), "parameter_slot_name", "parameter_canonical_value"))
    event = out.event("assistant", "tool_call", name=f"{service}.{method}", arguments=compact(arguments))
    out.fact("tool_call", f"{service}.method", method, event, CALL_QUESTION.format(service=service))


def _result(out: Canonical, service: str, result: dict) -> None:
    pairs = named(result, "service_slot_name", "service_canonical_value")
    if not pairs and isinstance(result.get("service_results_list"), list):
        pairs = [(str(k), v) for entity in records(result["service_results_list"]) for k, v in entity.items()]
    if not pairs:
        return
    event = out.event("tool", "tool_result", compact(dict(pairs)), name=service, status="success")
    for slot, value in pairs:
        out.fact("tool_outcome", f"{service}.{slot}", str(value), event, RESULT_QUESTION.format(slot=slot, service=service))


def _as_json(df: DataFrame, column: str):
    return F.col(column) if isinstance(df.schema[column].dataType, StringType) else F.to_json(column, {"ignoreNullFields": "false"})


def adapt_dialogs(df: DataFrame, column: str = "turns") -> DataFrame:
    """``events, memory_atoms, probes, reject`` from a column of dialogs, nested or as JSON text, in either layout.

    Text that is no JSON rejects the record with ``bad_json``, a dialog without events with ``no_events``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, bad = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    made.append(service_dialog(json.loads(text) if text else None))
                    bad.append(False)
                except ValueError:
                    made.append(Canonical())
                    bad.append(True)
            parts = [pa.array([json.dumps(getattr(s, n)) for s in made], pa.string()) for n in ("events", "atoms", "probes")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *parts, pa.array(bad)], names=[*batch.schema.names[:-1], "_e", "_a", "_p", "_bad"])

    rest = [c for c in df.columns if c not in ("events", "memory_atoms", "probes", "reject", "_json", "_e", "_a", "_p", "_bad")]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    out = df.select(*rest, _as_json(df, column).alias("_json")).mapInArrow(run, f"{fields}, _e string, _a string, _p string, _bad boolean")
    return out.select(
        *rest,
        F.from_json("_e", EVENTS).alias("events"),
        F.from_json("_a", ArrayType(ATOM)).alias("memory_atoms"),
        F.from_json("_p", ArrayType(PROBE)).alias("probes"),
        F.when(F.col("_bad"), "bad_json").when(F.col("_e") == "[]", "no_events").alias("reject"),
    )


TRAJECTORY = "array<struct<role:string,content:string,name:string,tool_call_id:string,tool_calls:array<struct<id:string,name:string,arguments:string>>>>"


def plain_messages(text: str | None) -> str | None:
    """A trajectory as JSON of messages whose calls are flat; calls may stand in a JSON text and under ``function``.

    None where the text is no list.
    """
    try:
        rows = json.loads(text) if text else None
        rows = json.loads(rows) if isinstance(rows, str) else rows
        if not isinstance(rows, list):
            return None
        return json.dumps([_plain(m) for m in rows if isinstance(m, dict)])
    except ValueError:
        return None


def _plain(message: dict) -> dict:
    calls = message.get("tool_calls") or message.get("tool_calls_json")
    calls = json.loads(calls) if isinstance(calls, str) else calls
    if not calls and message.get("function_call"):
        calls = [{"function": message["function_call"]}]
    flat = []
    for call in listed(calls):
        own = call if isinstance(call, dict) else {}
        function = own.get("function", own)
        arguments = function.get("arguments", {}) if isinstance(function, dict) else {}
        flat.append({"id": _said(own.get("id")), "name": _said(function.get("name")) if isinstance(function, dict) else "", "arguments": arguments if isinstance(arguments, str) else compact(arguments)})
    keep = {k: _said(message.get(k)) or None for k in ("role", "name", "tool_call_id")}
    return keep | {"content": _said(message.get("content")), "tool_calls": flat or None}
