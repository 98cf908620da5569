"""Token budgets by domain: caps, greedy acceptance with skipping, and its interplay with deduplication."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators import dedup
from sessionloom.operators.indexing import running_sum
from sessionloom.plans.runtime import cut


def caps(target: int, shares: dict[str, float]) -> dict[str, int]:
    """Absolute caps: domains in order, each the floor of its share, the last what remains."""
    names = sorted(shares)
    out = {d: math.floor(target * shares[d]) for d in names[:-1]}
    if names:
        out[names[-1]] = target - sum(out.values())
    return out


def greedy(rows: DataFrame, limits: dict[str, int], domain: str, order: str, tokens: str) -> DataFrame:
    """Rows that a scan by ``order`` accepts: each that still fits its domain's cap; others are skipped.

    Later, smaller rows may fit after a skip, so a cumulative sum alone is wrong. Rounds: the rows before a
    domain's first overflow are accepted by a prefix sum; of the rows after it only those that fit the
    remainder are left for the next round, whose cap is the remainder. Each round at least removes the row
    that overflowed; no row is looked at one by one. ``order`` is unique; domains without a cap accept nothing.
    """
    spark = rows.sparkSession
    left = cut(rows.where(F.col(domain).isin(*limits)).select(domain, order, F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("_t")))
    room = {d: int(c) for d, c in limits.items()}
    parts: list[DataFrame] = []
    while True:
        table = F.broadcast(spark.createDataFrame(list(room.items()), f"`{domain}` string, _room bigint"))  # a row for each domain
        fits = left.join(table, domain).where("_t <= _room")
        if fits.isEmpty():
            return reduce(DataFrame.unionByName, parts) if parts else left.select(order).limit(0)
        summed = running_sum(fits, [domain, order], F.col("_t"), "_before")
        start = summed.groupBy(domain).agg(F.min("_before").alias("_start"))
        upto = cut(summed.join(F.broadcast(start), domain).withColumn("_upto", F.col("_before") - F.col("_start") + F.col("_t")))
        over = upto.where("_upto > _room").groupBy(domain).agg(F.min(order).alias("_over"))
        marked = upto.join(F.broadcast(over), domain, "left")
        first = cut(marked.where(F.col("_over").isNull() | (F.col(order) < F.col("_over"))))
        parts.append(first.select(order))
        used = {r[0]: r[1] for r in first.groupBy(domain).agg(F.sum("_t")).collect()}  # a row for each domain
        room = {d: c - used.get(d, 0) for d, c in room.items()}
        left = cut(marked.where(F.col(order) > F.col("_over")).select(domain, order, "_t"))


def accept(rows: DataFrame, limits: dict[str, int], order: str, domain: str, tokens: str, hash_col: str, simhash_col: str, words: str) -> DataFrame:
    """``order, reason``: the outcome of a scan that tests the budget, then duplicates, and charges accepted rows only.

    A rejected row neither counts against the budget nor as the original of a duplicate, so both tests
    depend on the accepted set. It is computed over all rows at once, from the duplicates of the last
    accepted set, until it stays the same; that set is the scan's, as by induction over the order no first
    difference can exist. Reasons: accepted, domain_token_budget, exact_duplicate, near_duplicate.
    """
    rows = cut(rows.select(order, domain, tokens, hash_col, simhash_col, words))
    close = cut(dedup.class_pairs(rows.where(F.col(words) >= dedup.MIN_TOKENS), simhash_col))
    accepted, found, old = rows, None, None
    while True:  # each pass settles at least one more row of the order
        found = cut(dedup.duplicates_of(accepted, rows, close, order, hash_col, simhash_col, words))
        kept = greedy(rows.join(found, order, "left_anti"), limits, domain, order, tokens)
        if old is not None and kept.count() == old.count() and kept.exceptAll(old).isEmpty():
            break
        old, accepted = kept, rows.join(kept, order, "left_semi")
    # the budget test comes first: a duplicate that would not have fitted either is over budget
    verdicts = rows.join(found, order, "left").join(kept.withColumn("_in", F.lit(True)), order, "left")
    spent = running_sum(verdicts, [domain, order], F.when(F.col("_in"), F.col(tokens)), "_spent")
    start = F.broadcast(spent.groupBy(domain).agg(F.min("_spent").alias("_start")))  # a row for each domain
    table = F.broadcast(rows.sparkSession.createDataFrame(list(limits.items()), f"`{domain}` string, _cap bigint"))
    placed = spent.join(start, domain, "left").join(table, domain, "left")
    fits = F.col("_spent") - F.col("_start") + F.col(tokens) <= F.col("_cap")
    reason = F.when(F.col("_in"), "accepted").when(F.coalesce(fits, F.lit(False)), F.col("verdict")).otherwise("domain_token_budget")
    return placed.select(order, reason.alias("reason"))
