"""Dense positions and running sums over a total order, without gathering the rows in one task.

Rows are range-partitioned by the order; each partition counts (or sums) its rows, and the partition
totals, one row for each, become offsets. The order must be total, so that the range partitioning is
repeatable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.plans.runtime import cut


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("_sl_part", F.spark_partition_id()))


def dense_index(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """A 0-based dense position by ``order``. Empty input gives an empty result."""
    return running_sum(df, order, F.lit(1).cast("bigint"), name)


def running_sum(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over all rows before this one by ``order`` (exclusive prefix sum)."""
    rows = _ranged(df.withColumn("_sl_v", F.coalesce(value, F.lit(0)).cast("bigint")), order)
    totals = rows.groupBy("_sl_part").agg(F.sum("_sl_v").alias("_sl_total"))
    every = Window.orderBy("_sl_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_sl_part", F.coalesce(F.sum("_sl_total").over(every), F.lit(0)).alias("_sl_offset"))  # a row for each partition
    within = Window.partitionBy("_sl_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_sl_before", F.coalesce(F.sum("_sl_v").over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_sl_part")
        .withColumn(name, F.col("_sl_offset") + F.col("_sl_before"))
        .drop("_sl_part", "_sl_v", "_sl_before", "_sl_offset")
    )


def group_index(df: DataFrame, group: list[str], order: list[Column | str], name: str = "index") -> DataFrame:
    """A 0-based dense position by ``order`` within each group, without a window over a group: a global position less
    that of the group's first row, so that a hot group is spread over as many tasks as its rows need.
    """
    placed = dense_index(df, [*group, *order], "_sl_g")
    first = placed.groupBy(*group).agg(F.min("_sl_g").alias("_sl_first"))
    renamed = first.select(*[F.col(c).alias(f"_sl_{i}") for i, c in enumerate(group)], "_sl_first")
    same = [F.col(c).eqNullSafe(F.col(f"_sl_{i}")) for i, c in enumerate(group)]
    joined = placed.join(renamed, same)
    return joined.withColumn(name, F.col("_sl_g") - F.col("_sl_first")).drop("_sl_g", "_sl_first", *[f"_sl_{i}" for i in range(len(group))])


def longest(df: DataFrame, group: list[str], size: str, index: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the largest ``size`` (ties by ``index``, nulls last), with their ``rank`` from 1.

    Positions come from a global order, so that no group is gathered.
    """
    ranked = group_index(df.withColumn("_sl_n", F.coalesce(-F.col(size), F.lit(2**62))), group, ["_sl_n", index], "_sl_k").where(F.col("_sl_k") < n)
    return ranked.withColumn("rank", F.col("_sl_k") + 1).drop("_sl_n", "_sl_k")


#: Digests that are joined and hashed at once.
DIGEST_BLOCK = 4096


def ordered_digest(df: DataFrame, order: list[str], digest: str) -> DataFrame:
    """One row ``digest`` over the rows' digests in order: blocks of consecutive digests are hashed, then the
    blocks' digests in the same way, until one is left. Empty input gives the digest of the empty string.
    """
    rows = dense_index(df, order, "_i").select("_i", F.col(digest).alias("_h"))
    n = rows.count()
    while True:
        grouped = rows.groupBy(F.expr(f"_i div {DIGEST_BLOCK}").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", "_h"))).alias("g"))
        rows = grouped.select(F.col("_b").alias("_i"), F.sha2(F.array_join(F.transform("g", lambda r: r["_h"]), ""), 256).alias("_h"))
        n = -(-n // DIGEST_BLOCK)
        if n <= 1:
            return rows.agg(F.coalesce(F.max("_h"), F.sha2(F.lit(""), 256)).alias("digest"))
