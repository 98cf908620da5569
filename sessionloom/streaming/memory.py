"""The memory fold over a stream of latents: one gated state for each user, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionloom.operators.memory import INIT_GATE

OUTPUT = "user_id string, updates bigint, state array<double>"
STATE = "updates bigint, seen bigint, state array<double>"


def fold_stream(latents: DataFrame, user: str = "user_id", order: str = "position", vector: str = "latent", gate: float = INIT_GATE) -> DataFrame:
    """``user_id, updates, state`` after each batch that has new latents of a user.

    h' = gate h + (1 - gate) q in the order of ``order``; the first latent of a user is taken as it is. A
    latent at or before a position that was folded already is skipped, so a batch that is delivered again
    changes nothing. Rows with a null vector are skipped. The latents of
    one user in one micro-batch are sorted in memory, so the source's limit on a micro-batch bounds them; between
    micro-batches only the state is kept.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        updates, seen, h = state.get if state.exists else (0, -(2**62), None)
        h = list(h) if h is not None else None
        rows = pd.concat(list(frames)).sort_values("o")
        for position, q in zip(rows["o"].tolist(), rows["v"].tolist()):
            if position <= seen or q is None:
                continue
            h = [float(x) for x in q] if h is None else [gate * a + (1.0 - gate) * float(b) for a, b in zip(h, q)]
            updates, seen = updates + 1, position
        if h is None:
            return
        state.update((updates, seen, h))
        yield pd.DataFrame({"user_id": [str(key[0])], "updates": [updates], "state": [h]})

    rows = latents.select(latents[user].cast("string").alias("user_id"), latents[order].cast("bigint").alias("o"), latents[vector].cast("array<double>").alias("v"))
    return rows.groupBy("user_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def user_rates(events: DataFrame, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream ``ts, event_type, value`` by time window; what comes later than the watermark is dropped."""
    from pyspark.sql import functions as F

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    grouped = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")
