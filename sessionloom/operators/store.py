"""The three-table read join and its audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import strip


def read_samples(index: DataFrame, sessions: DataFrame, probes: DataFrame) -> DataFrame:
    """Index joined with sessions and probes: parallel arrays of prompts and references in the order of the index.

    Returns ``session_index, session_id, context, prompts, references, errors``. Empty selections give empty
    arrays and the error ``empty_selection``; others: ``id_mismatch``, ``missing_probe``, ``foreign_probe``,
    ``duplicate_probe``, ``blank_reference``. Repeated rows of sessions and probes count once.
    """
    chosen = index.select("session_index", "session_id", F.posexplode_outer("probe_indices").alias("pos", "probe_index"))
    one_probe = probes.groupBy("probe_index").agg(
        F.min(F.struct("session_id", "prompt", "reference", "answerable")).alias("p")
    )
    matched = chosen.join(one_probe, "probe_index", "left")
    items = F.collect_list(
        F.when(F.col("probe_index").isNotNull(), F.struct("pos", "probe_index", F.col("p.session_id").alias("owner"), "p.prompt", "p.reference", "p.answerable"))
    )
    gathered = matched.groupBy("session_index", "session_id").agg(F.array_sort(items).alias("items"))
    one_session = sessions.groupBy("session_index").agg(F.min(F.struct(F.col("session_id").alias("id"), "context")).alias("s"))
    joined = gathered.join(one_session, "session_index", "left")
    found = F.col("items.probe_index")
    errors = F.filter(
        F.array(
            F.when(F.size("items") == 0, "empty_selection"),
            F.when(F.col("s").isNull() | (F.col("s.id") != F.col("session_id")), "id_mismatch"),
            F.when(F.exists("items", lambda i: i["prompt"].isNull()), "missing_probe"),
            F.when(F.exists("items", lambda i: i["owner"] != F.col("session_id")), "foreign_probe"),
            F.when(F.size(F.array_distinct(found)) < F.size(found), "duplicate_probe"),
            F.when(F.exists("items", lambda i: i["answerable"] & (strip(i["reference"]) == "")), "blank_reference"),
        ),
        lambda e: e.isNotNull(),
    )
    return joined.select(
        "session_index",
        "session_id",
        F.col("s.context").alias("context"),
        F.col("items.prompt").alias("prompts"),
        F.col("items.reference").alias("references"),
        errors.alias("errors"),
    )


def range_audit(sessions: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes whose index lies outside of their session's range [probe_start, probe_start + probe_count)."""
    s = sessions.groupBy("session_id").agg(F.min(F.struct("session_index", "probe_start", "probe_count")).alias("s"))
    p = probes.select("session_id", "probe_index").distinct()
    inside = (F.col("probe_index") >= F.col("s.probe_start")) & (F.col("probe_index") < F.col("s.probe_start") + F.col("s.probe_count"))
    return p.join(s, "session_id", "left").where(~F.coalesce(inside, F.lit(False))).select("session_id", "probe_index")


def order_audit(sessions: DataFrame) -> DataFrame:
    """Sessions whose probe_start is not the end of the session before, by session_index."""
    rows = sessions.groupBy("session_index").agg(F.min(F.struct("session_id", "probe_start", "probe_count")).alias("s"))
    nxt = rows.select((F.col("session_index") + 1).alias("session_index"), (F.col("s.probe_start") + F.col("s.probe_count")).alias("end"))
    joined = rows.join(nxt, "session_index")
    return joined.where(F.col("end") != F.col("s.probe_start")).select("session_index", F.col("s.session_id").alias("session_id"))


def coverage(left: DataFrame, right: DataFrame, keys: list[str], digest: str | None = None) -> DataFrame:
    """Full outer comparison of two keyed tables: ``keys, status`` for each key that is not simply in both.

    Statuses: duplicate_left, duplicate_right, missing, unexpected, and changed where ``digest`` differs.
    """
    def side(df: DataFrame, s: str) -> DataFrame:
        d = F.min(digest) if digest else F.lit(None).cast("string")
        return df.groupBy(*keys).agg(F.count("*").alias(f"n{s}"), d.alias(f"d{s}"))

    both = side(left, "l").join(side(right, "r"), keys, "full_outer")
    status = (
        F.when(F.col("nl") > 1, "duplicate_left")
        .when(F.col("nr") > 1, "duplicate_right")
        .when(F.col("nr").isNull(), "missing")
        .when(F.col("nl").isNull(), "unexpected")
        .when(~F.col("dl").eqNullSafe(F.col("dr")), "changed")
    )
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select(*keys, "status")


def split_overlaps(index_a: DataFrame, index_b: DataFrame) -> DataFrame:
    """Sessions that both index tables have, and how many probes they share there."""
    a = index_a.select("session_id", F.col("probe_indices").alias("pa"))
    b = index_b.select("session_id", F.col("probe_indices").alias("pb"))
    return a.join(b, "session_id").select("session_id", F.size(F.array_intersect("pa", "pb")).cast("bigint").alias("shared_probes"))


def composite(stores: dict[str, DataFrame], order: str) -> DataFrame:
    """Stores concatenated under one global index: position within the store plus the sizes of those before."""
    from sessionloom.operators.indexing import dense_index

    parts = None
    for k, (name, df) in enumerate(stores.items()):
        own = df.withColumn("store", F.lit(name)).withColumn("_store", F.lit(k))
        parts = own if parts is None else parts.unionByName(own)
    return dense_index(parts, ["_store", order], "global_index").drop("_store")


def adjacent(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Rows with ``prev_*``, the columns of the row right before them within the key; the first of a key has none.

    ``order`` is dense within the key, so an equi-join on its predecessor does what a window would, but
    spreads a hot key over all tasks.
    """
    before = df.select(key, (F.col(order) + 1).alias(order), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return df.join(before, [key, order], "left")
