"""Question probes of sessions: seeding from turns, fallbacks, selection, and repair of generated payloads."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import strip
from sessionloom.operators.canonical import first_rows
from sessionloom.operators.indexing import group_index

#: Characters of a prompt or reference that is taken from the session.
TEXT_CHARS = 512
#: The questions that are asked of an event when nothing better is found, as probes must read alike.
TEMPLATES = (
    "What information was recorded at session step {step}?",
    "What occurred at session step {step}?",
    "What should be remembered from session step {step}?",
    "Summarize the recorded content at session step {step}.",
    "What detail did session step {step} establish?",
    "What does the record say at session step {step}?",
    "What content was communicated at session step {step}?",
    "Which result or statement appears at session step {step}?",
    "What is the key recorded outcome of session step {step}?",
    "What can be recalled directly from session step {step}?",
)
#: The question for a tool's result, and what a call without content and arguments says.
TOOL_QUESTION = "What result did the {name} tool return at step {step}?"
CALLED = "Called {name}."


def folded(col: Column) -> Column:
    """Case folding by built-ins: capitals first, as some small letters share one; sharp s is ss."""
    return F.lower(F.upper(F.replace(col, F.lit("ß"), F.lit("ss"))))


def signature(prompt: Column, reference: Column) -> Column:
    """What makes two probes the same: prompt and reference without case and outer blanks."""
    return F.concat_ws("\0", folded(strip(prompt)), folded(strip(reference)))


def _cut(col: Column) -> Column:
    return strip(F.substring(strip(col), 1, TEXT_CHARS))


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def steps(events: DataFrame) -> DataFrame:
    """Events with ``step`` (1 for a session's first) and the columns of the event before it as ``prev_...``; no window."""
    own = group_index(events, ["session_id"], ["event_index", "event_id"], "_i").withColumn("step", F.col("_i") + 1)
    before = own.select("session_id", (F.col("_i") + 1).alias("_i"), *[F.col(c).alias(f"prev_{c}") for c in ("event_id", "role", "event_type", "content", "tool_name")])
    return own.join(before, ["session_id", "_i"], "left").drop("_i")


def _counted(existing: DataFrame) -> DataFrame:
    return existing.groupBy("session_id").agg(F.count("*").alias("_have"))


def _new(candidates: DataFrame, existing: DataFrame, order: list[str], prefix: str, target: int, limit: int | None) -> DataFrame:
    """The first candidates by ``order`` that are no probes yet, up to ``target`` probes of a session and ``limit`` new
    ones, with the smallest numbers after ``prefix`` that the session's ids leave free.
    """
    known = existing.select("session_id", signature(F.col("prompt"), F.col("reference")).alias("_s")).distinct()
    marked = candidates.where("prompt != '' and reference != ''").withColumn("_s", signature(F.col("prompt"), F.col("reference")))
    fresh = first_rows(marked.join(known, ["session_id", "_s"], "left_anti"), ["session_id", "_s"], order).drop("_s")
    ranked = group_index(fresh.join(_counted(existing), "session_id", "left"), ["session_id"], order, "_r")
    room = F.lit(target) - F.coalesce("_have", F.lit(0))
    kept = ranked.where(F.col("_r") < (F.least(room, F.lit(limit)) if limit is not None else room))
    # the n-th free number: at most target numbers are taken, so the first 2 * target hold enough free ones
    pattern = f"^{prefix}(0|[1-9][0-9]*)$"
    taken = existing.where(F.col("probe_id").rlike(pattern)).select("session_id", F.regexp_extract("probe_id", pattern, 1).cast("decimal(38,0)").alias("n"))
    used = taken.where(F.col("n") < 2 * target).groupBy("session_id").agg(F.collect_set(F.col("n").cast("bigint")).alias("_used"))
    free = F.array_sort(F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(2 * target - 1).cast("bigint")), F.coalesce("_used", F.array().cast("array<bigint>"))))
    numbered = kept.join(used, "session_id", "left").withColumn("probe_id", F.concat(F.lit(prefix), F.element_at(free, (F.col("_r") + 1).cast("int")).cast("string")))
    return numbered.select("session_id", "probe_id", "prompt", "probe_type", "reference", "evidence_event_ids", (F.col("_r") + 1).alias("rank"))


def distinct_probes(df: DataFrame, session: str, order: str) -> DataFrame:
    """The first probe by ``order`` of each signature within a session."""
    sig = signature(F.col("prompt"), F.coalesce("reference", F.lit("")))
    rest = [c for c in df.columns if c != session]
    return df.withColumn("_s", sig).groupBy(session, "_s").agg(F.min_by(F.struct(*rest), order).alias("_r")).select(session, "_r.*")


def seed(events: DataFrame, existing: DataFrame, target: int, limit: int = 4) -> DataFrame:
    """New probes that sessions themselves answer: an assistant's event right after a user's, and a tool's result right
    after a call; at most ``limit`` for a session and ``target`` with its existing ones; texts cut to TEXT_CHARS.

    ``events``: session_id, event_id, event_index, role, event_type, content, tool_name; ``existing``: session_id,
    probe_id, prompt, reference. Null and blank texts give no probe; a session with ``target`` probes gets none; a
    missing tool name is that of the call, else "tool". Returns ``session_id, probe_id, prompt, probe_type, reference,
    evidence_event_ids, rank``.
    """
    told = steps(events)
    turn = (F.col("role") == "assistant") & (F.col("prev_role") == "user")
    result = (F.col("event_type") == "tool_result") & (F.col("prev_event_type") == "tool_call")
    name = F.coalesce(F.nullif(strip(F.col("tool_name")), F.lit("")), F.nullif(strip(F.col("prev_tool_name")), F.lit("")), F.lit("tool"))
    prompt = F.when(turn, _cut(F.col("prev_content"))).otherwise(_cut(_filled(TOOL_QUESTION, name=name, step=F.col("step"))))
    found = told.where(turn | result).select(
        "session_id", "step", prompt.alias("prompt"), _cut(F.col("content")).alias("reference"),
        F.when(turn, "source_turn_response").otherwise("source_tool_result").alias("probe_type"), F.array("prev_event_id", "event_id").alias("evidence_event_ids"),
    )
    return _new(found, existing, ["step"], "s_p", target, limit)


def fallback(events: DataFrame, existing: DataFrame, target: int) -> DataFrame:
    """New probes for sessions that still lack some: turns first, then template by template all events with a text, up
    to ``target`` with the existing ones. Columns as of :func:`seed`, and ``arguments_json``.

    Steps count all events; events without content say their arguments, and calls without these their name. Among the
    first 3 * target events with a text as many new probes are found as can be needed, as fewer than target are there
    already and fewer than target come from turns.
    """
    told = steps(events)
    turn = (F.col("role") == "assistant") & (F.col("prev_role") == "user")
    head = strip(F.substring(F.coalesce("prev_content", F.lit("")), 1, TEXT_CHARS))
    turns = told.where(turn).select("session_id", F.lit(-1).alias("template"), "step", head.alias("prompt"), _cut(F.col("content")).alias("reference"), F.lit("fallback_turn_response").alias("probe_type"), F.array("prev_event_id", "event_id").alias("evidence_event_ids"))
    call = F.when(F.col("event_type") == "tool_call", _filled(CALLED, name=F.coalesce("tool_name", F.lit(""))))
    text = F.coalesce(F.nullif(strip(F.col("content")), F.lit("")), F.nullif(strip(F.col("arguments_json")), F.lit("")), call)
    first = group_index(told.withColumn("_t", text).where("_t is not null"), ["session_id"], ["step"], "_p").where(F.col("_p") < 3 * target)
    questions = F.posexplode(F.array(*[F.lit(t) for t in TEMPLATES])).alias("template", "question")
    asked = first.select("session_id", "step", "event_id", "_t", questions)
    recalled = asked.select("session_id", "template", "step", F.replace(F.col("question"), F.lit("{step}"), F.col("step").cast("string")).alias("prompt"), _cut(F.col("_t")).alias("reference"), F.lit("fallback_event_recall").alias("probe_type"), F.array("event_id").alias("evidence_event_ids"))
    return _new(turns.unionByName(recalled), existing, ["template", "step"], "g_p", target, None)


def select_target(probes: DataFrame, target: int) -> DataFrame:
    """``target`` probes of each session: the best-ranked of each type, types in order, then the best-ranked of the rest.

    The rank is the SHA-256 of session and probe id.
    """
    key = F.sha2(F.concat_ws("\0", "session_id", "probe_id"), 256)
    by_type = Window.partitionBy("session_id", "probe_type").orderBy("_k")
    ranked = probes.withColumn("_k", key).withColumn("_first", F.row_number().over(by_type) == 1)
    order = Window.partitionBy("session_id").orderBy(F.desc("_first"), F.when(F.col("_first"), F.col("probe_type")), "_k")
    return ranked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= target).drop("_k", "_first", "_r")


def generation_prompt(have: Column, target: int, text: Column) -> Column:
    """The instruction for a generator: how many probes are missing, and the session."""
    missing = F.greatest(F.lit(target) - have, F.lit(0))
    return F.concat(F.lit("Write "), missing.cast("string"), F.lit(" grounded questions with answers about this session.\n"), text)


def token_ladder(attempt: Column) -> Column:
    """Token budget of an attempt: 640, 512, 384, then 256."""
    return F.when(attempt <= 0, 640).when(attempt == 1, 512).when(attempt == 2, 384).otherwise(256)


def repair_json(text: str | None):
    """The value of a nearly valid JSON text: fences removed, trailing commas and lone backslashes mended, and of a
    list that breaks off its complete items; None where nothing can be read.
    """
    if not text:
        return None
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    body = re.sub(r"\\(?![\"\\/bfnrtu])", r"\\\\", body)
    for attempt in (body, re.sub(r",\s*([}\]])", r"\1", body)):
        try:
            return json.JSONDecoder().raw_decode(attempt)[0]
        except ValueError:
            continue
    items, at, decoder = [], body.find("[") + 1, json.JSONDecoder()
    while at > 0:
        nxt = re.compile(r"[\s,]*").match(body, at).end()
        try:
            item, at = decoder.raw_decode(body, nxt)
        except ValueError:
            break
        items.append(item)
    return items or None


def merge_payload(existing: list[dict], payload: str | None, events: set[str], prefix: str = "g_p") -> list[dict]:
    """Probes with those of a generated payload: evidence that doesn't exist is dropped, and with it probes without
    any; known signatures are skipped; new ones are numbered with the smallest free numbers.
    """
    data = repair_json(payload)
    rows = data.get("probes", []) if isinstance(data, dict) else data or []
    used = {p["id"] for p in existing}
    known = {(p["prompt"].strip().casefold(), (p.get("reference") or "").strip().casefold()) for p in existing}
    out, n = list(existing), 0
    for row in rows:
        if isinstance(row, list):  # the compact form: prompt, reference, evidence
            row = dict(zip(("prompt", "reference", "evidence_event_ids"), row))
        if not isinstance(row, dict) or not row.get("prompt"):
            continue
        evidence = [e for e in row.get("evidence_event_ids") or [] if e in events]
        key = (str(row["prompt"]).strip().casefold(), str(row.get("reference") or "").strip().casefold())
        if not evidence or key in known:
            continue
        while f"{prefix}{n}" in used:
            n += 1
        used.add(f"{prefix}{n}")
        known.add(key)
        out.append({"id": f"{prefix}{n}", "prompt": str(row["prompt"]).strip(), "reference": str(row.get("reference") or "").strip(), "evidence_event_ids": evidence})
    return out
