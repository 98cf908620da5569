"""The recurrent memory of a user: each new latent is folded into the state through a gate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.indexing import group_index

INIT_BIAS = -2.0
#: The gate at its initial weights, which are zero: the sigmoid of the bias.
INIT_GATE = 1.0 / (1.0 + math.exp(-INIT_BIAS))


def fold(states: Column, gate: float = INIT_GATE, zero_state: bool = False) -> Column:
    """h' = z h + (1 - z) q over an array of latents in order; ``direct`` takes the first as it is, else h0 = 0."""
    first = F.transform(states[0], lambda x: F.lit(0.0)) if zero_state else states[0]
    rest = states if zero_state else F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0)))
    return F.aggregate(rest, first, lambda h, q: F.zip_with(h, q, lambda a, b: gate * a + (1.0 - gate) * b))


def fold_by_user(latents: DataFrame, user: str, order: str, vector: str, gate: float = INIT_GATE, zero_state: bool = False) -> DataFrame:
    """``user, updates, i, h``: the state of each user after all of its latents, one row for each dimension.

    With a constant gate the fold is a weighted sum whose weights depend only on the rank from the end, so it is computed
    by a combinable sum; ranks come from positions in a global order, so that no user's latents are gathered or sorted in
    one task. Ties of ``order`` are taken in the order of the vectors.
    """
    ranked = group_index(latents.select(user, order, vector), [user], [order, vector], "_rank")
    counts = ranked.groupBy(F.col(user).alias("_u")).agg(F.count("*").alias("_n"))
    ranked = ranked.join(counts, F.col(user).eqNullSafe(F.col("_u")))
    back = F.col("_n") - 1 - F.col("_rank")
    weight = F.lit(1.0 - gate) * F.pow(F.lit(gate), back)
    if not zero_state:
        weight = F.when(F.col("_rank") == 0, F.pow(F.lit(gate), back)).otherwise(weight)
    terms = ranked.select(user, "_n", F.posexplode(F.transform(F.col(vector).cast("array<double>"), lambda x: x * weight)).alias("i", "t"))
    return terms.groupBy(user, "i").agg((F.max("_n") - (0 if zero_state else 1)).alias("updates"), F.sum("t").alias("h"))
