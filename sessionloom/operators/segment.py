"""Segmentation of sessions under a token limit, and lossless splitting of long texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import tokens
from sessionloom.operators.canonical import MESSAGE_LABELS, TYPE_LABELS

OVERLAP = 1
MARK = " [truncated]"
_WORD = re.compile(r"\w+")


def count_words(text: str) -> int:
    """The offline token counter."""
    return len(_WORD.findall(text))


def _event_text(e: dict) -> str:
    label = MESSAGE_LABELS.get(e["role"]) if e["type"] == "message" else TYPE_LABELS.get(e["type"])
    head = f"[{label} | id={e['id']}"
    if e["type"] == "tool_call" or e["type"] == "tool_result" and e["name"]:
        head += f" | name={e['name']}"
    if e["type"] == "tool_result" and e["status"]:
        head += f" | status={e['status']}"
    lines = [head + "]"]
    if e["type"] == "tool_call":
        lines.append(e["arguments"] or "{}")
    if e["content"] or e["type"] != "tool_call":
        lines.append(e["content"])
    return "\n".join(lines)


def truncate(event: dict, room: Callable[[dict], bool]) -> dict:
    """The event cut to fit: arguments of a call without content become empty, else the longest prefix with a mark."""
    if event["type"] == "tool_call" and not event["content"]:
        return event | {"arguments": "{}"}
    low, high = 0, len(event["content"])
    while low < high:
        middle = (low + high + 1) // 2
        if room(event | {"content": event["content"][:middle].rstrip() + MARK}):
            low = middle
        else:
            high = middle - 1
    return event | {"content": (event["content"][:low].rstrip() + MARK).strip()}


def segments_of(header: str, events: list[dict], limit: int, overlap: int = OVERLAP, count: Callable[[str], int] = count_words, additive: bool | None = None) -> list[tuple[list[dict], int]]:
    """Groups of events and their tokens. Greedy: an event that no longer fits opens the next group, which
    begins with the last ``overlap`` events as far as they fit; an event that fits nowhere is cut.

    Where counts of lines add up (``additive``, as words do), each event is counted once and groups are sums; else each
    group is counted as a whole.
    """
    additive = count is count_words if additive is None else additive
    head, own = count(header), {}

    def weight(event: dict) -> int:
        if id(event) not in own:
            own[id(event)] = (count(_event_text(event)), event)
        return own[id(event)][0]

    def size(group: list[dict]) -> int:
        return head + sum(map(weight, group)) if additive else count("\n".join([header, *map(_event_text, group)]))

    if limit <= 0:
        return [(events, size(events))] if events else []
    done: list[tuple[list[dict], int]] = []
    group: list[dict] = []
    fresh, held = 0, head
    for event in events:
        grown = held + weight(event) if additive else size([*group, event])
        if grown <= limit:
            group.append(event)
            fresh, held = fresh + 1, grown
            continue
        if fresh:
            done.append((group, held))
        seed = group[len(group) - overlap :] if overlap and fresh else []
        while seed and size([*seed, event]) > limit:
            seed = seed[1:]
        if not seed and size([event]) > limit:
            event = truncate(event, lambda e: (head + count(_event_text(e)) if additive else size([e])) <= limit)
        group, fresh = [*seed, event], 1
        held = size(group)
    if fresh:
        done.append((group, held))
    return done


def segment_sessions(sessions: DataFrame, limit: int, overlap: int = OVERLAP, count: Callable[[str], int] = count_words) -> DataFrame:
    """``session_id, segment_id, segment_index, segment_count, event_ids, tokens`` of sessions with ``events``.

    A session that needs one segment keeps its bare id. A session is one row, so each is cut in its own
    task; null and empty events give no segment.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, source, domain, events in zip(*(c.to_pylist() for c in batch.columns)):
                header = f"[Session | id={sid}:segment-000 | source={source or ''} | domain={domain or ''}]"
                parts = segments_of(header, events or [], limit, overlap, count)
                for i, (group, n) in enumerate(parts):
                    name = sid if len(parts) == 1 else f"{sid}:segment-{i:03d}"
                    rows.append((sid, name, i, len(parts), [e["id"] for e in group], n))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()]
            names = ["session_id", "segment_id", "segment_index", "segment_count", "event_ids", "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    ddl = "session_id string, segment_id string, segment_index bigint, segment_count bigint, event_ids array<string>, tokens bigint"
    return sessions.select("session_id", "source", "domain", "events").mapInArrow(run, ddl)


def local_items(items: Column, event_ids: Column) -> Column:
    """Atoms or probes whose evidence lies within a segment; those without evidence are dropped."""
    return F.filter(items, lambda x: (F.size(x["evidence_event_ids"]) > 0) & (F.size(F.array_except(x["evidence_event_ids"], event_ids)) == 0))


def split_words(df: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """``id_col, part, text, words``: the words of a text in parts of at most ``limit``, in order, none lost."""
    words = tokens(F.col(text_col))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size("_w") / limit) - 1, F.lit(0)).cast("int")),
        lambda p: F.struct(p.alias("part"), F.slice("_w", p * limit + 1, limit).alias("w")),
    )
    cut = df.select(id_col, words.alias("_w")).where(F.size("_w") > 0).select(id_col, F.explode(parts).alias("p"))
    return cut.select(id_col, F.col("p.part").alias("part"), F.array_join("p.w", " ").alias("text"), F.size("p.w").cast("bigint").alias("words"))


def coverage(sessions: DataFrame, segments: DataFrame) -> DataFrame:
    """``session_id, events, covered``: how many events of each session its segments hold, counted from both sides."""
    own = sessions.select("session_id", F.explode(F.transform("events", lambda e: e["id"])).alias("event_id"))
    held = segments.select("session_id", F.explode("event_ids").alias("event_id")).distinct().withColumn("_held", F.lit(1))
    joined = own.join(held, ["session_id", "event_id"], "left")
    return joined.groupBy("session_id").agg(F.count("*").alias("events"), F.count("_held").alias("covered"))
