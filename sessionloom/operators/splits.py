"""Train and validation splits, held-out probes, and positions in the output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.text import stable_fraction, stable_hex

SEED, FRACTION, HELD_OUT = 42, 0.01, 2


def session_split(df: DataFrame, seed: int = SEED, fraction: float = FRACTION, id_col: str = "session_id") -> DataFrame:
    """Adds ``split``: validation where the stable fraction of the id lies below ``fraction``, else train."""
    return df.withColumn("split", F.when(stable_fraction(seed, F.col(id_col)) < fraction, "validation").otherwise("train"))


def held_out_probes(probes: DataFrame, seed: int = SEED, held_out: int = HELD_OUT) -> DataFrame:
    """Adds ``held_out``: the min(q, n - 1) probes of each session with the smallest stable fractions.

    Probes of a session are ranked by a window; a session has a bounded number of probes by construction
    (its probe_count). Ties are broken by probe_index.
    """
    w = Window.partitionBy("session_id")
    rank = F.row_number().over(w.orderBy(stable_hex(seed, F.col("session_id"), F.col("probe_id")), "probe_index"))
    keep = F.least(F.lit(held_out), F.greatest(F.count("*").over(w) - 1, F.lit(0)))
    return probes.withColumn("held_out", rank <= keep)


def probe_splits(probes: DataFrame, seed: int = SEED, fraction: float = FRACTION, held_out: int = HELD_OUT) -> DataFrame:
    """Adds ``split``: a validation session takes all its probes along; else held-out ones go to query_validation."""
    rows = session_split(held_out_probes(probes, seed, held_out), seed, fraction)
    split = F.when(F.col("split") == "validation", "validation").when(F.col("held_out"), "query_validation").otherwise("train")
    return rows.withColumn("split", split)


def split_index(rows: DataFrame) -> DataFrame:
    """``split, session_id, probe_indices`` with ascending indices; empty selections write no row."""
    return rows.groupBy("split", "session_id").agg(F.array_sort(F.collect_list("probe_index")).alias("probe_indices"))
