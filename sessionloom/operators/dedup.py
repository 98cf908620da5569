"""Exact and near duplicates of sessions: first row wins, and greedy SimHash rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.text import bands, hamming
from sessionloom.plans.runtime import cut

#: Rows with fewer tokens take no part in the near-duplicate test.
MIN_TOKENS = 20
MAX_DISTANCE = 3


def exact_duplicates(df: DataFrame, hash_col: str, order: str) -> DataFrame:
    """Adds ``is_first``: whether the row is the first by ``order`` among those of its hash. Null hashes are all first."""
    first = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(order).alias("_first"))
    return df.join(first, hash_col, "left").withColumn("is_first", F.coalesce(F.col(order) == F.col("_first"), F.lit(True))).drop("_first")


def class_pairs(df: DataFrame, hash_col: str, distance: int = MAX_DISTANCE, count: int = 4, width: int = 16) -> DataFrame:
    """Pairs ``ha, hb, distance`` (ha < hb) of distinct hashes that share a band and differ in at most ``distance`` bits.

    Copies never meet in a band: a hash that a third of all rows have costs as much as any other.
    """
    classes = df.where(F.col(hash_col).isNotNull()).select(F.col(hash_col).alias("h")).distinct()
    banded = classes.select("h", F.posexplode(bands(F.col("h"), count, width)).alias("band", "value"))
    a, b = banded.alias("a"), banded.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.h") < F.col("b.h"))
    gap = hamming(F.col("a.h"), F.col("b.h"))
    # a pair that shares several bands is made by the first of them alone
    earlier = F.lit(False)
    for k in range(count - 1):
        mask = ((1 << width) - 1) << (width * k)
        shared = F.col("a.h").bitwiseXOR(F.col("b.h")).bitwiseAND(F.lit(mask if mask < 2**63 else mask - 2**64)) == 0
        earlier = earlier | ((F.col("a.band") > k) & shared)
    return a.join(b, same).where((gap <= distance) & ~earlier).select(F.col("a.h").alias("ha"), F.col("b.h").alias("hb"), gap.alias("distance"))


def candidate_pairs(df: DataFrame, id_col: str, hash_col: str, distance: int = MAX_DISTANCE, count: int = 4, width: int = 16) -> DataFrame:
    """Pairs ``a, b, distance`` (a < b) of the first rows of close hashes."""
    first = df.where(F.col(hash_col).isNotNull()).groupBy(F.col(hash_col).alias("h")).agg(F.min(id_col).alias("i"))
    pairs = class_pairs(df, hash_col, distance, count, width)
    named = pairs.join(first.select(F.col("h").alias("ha"), F.col("i").alias("x")), "ha").join(first.select(F.col("h").alias("hb"), F.col("i").alias("y")), "hb")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def greedy_rejections(edges: DataFrame) -> DataFrame:
    """Ids rejected when rows are accepted in ascending order unless an accepted earlier row is their neighbour.

    ``edges`` has ``a < b``. Round by round: a row without undecided earlier neighbours is accepted, its
    later neighbours are rejected, and both leave the graph, so that a round sees only rows that are undecided. Exact, not
    the components of the graph; the smallest row left is decided in each round, and rounds go on until none is left. Returns ``id, because_of``.
    """
    left = cut(edges.select("a", "b").distinct())
    out = None
    while not left.isEmpty():
        later = left.select(F.col("b").alias("a")).distinct()
        accepted = left.select("a").distinct().join(later, "a", "left_anti")
        struck = cut(left.join(accepted, "a").groupBy("b").agg(F.min("a").alias("because_of")))
        new = struck.select(F.col("b").alias("id"), "because_of")
        out = new if out is None else out.unionByName(new)
        gone = struck.select(F.col("b").alias("x"))
        left = left.join(accepted, "a", "left_anti")
        left = cut(left.join(gone, left.a == gone.x, "left_anti").join(gone, left.b == gone.x, "left_anti"))
    return out if out is not None else edges.select(F.col("b").alias("id"), F.col("a").alias("because_of")).limit(0)


def duplicates_of(accepted: DataFrame, rows: DataFrame, close: DataFrame, order: str, hash_col: str, simhash_col: str, words: str, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``order, verdict`` of rows with an earlier accepted row of equal text, or of close SimHash among long rows.

    ``close`` has the pairs of :func:`class_pairs` of the rows; accepted rows are reduced to the first of each
    hash before they are joined.
    """
    exact = accepted.groupBy(hash_col).agg(F.min(order).alias("_e"))
    first = accepted.where(F.col(words) >= min_tokens).groupBy(F.col(simhash_col).alias("h")).agg(F.min(order).alias("_o"))
    both = close.select(F.col("ha").alias("h"), F.col("hb").alias("to")).unionByName(close.select(F.col("hb").alias("h"), F.col("ha").alias("to")))
    reach = first.select(F.col("h").alias("to"), "_o").unionByName(first.join(both, "h").select("to", "_o")).groupBy(F.col("to").alias(simhash_col)).agg(F.min("_o").alias("_n"))
    judged = rows.join(exact, hash_col, "left").join(reach, simhash_col, "left")
    verdict = F.when(F.col("_e") < F.col(order), "exact_duplicate").when((F.col(words) >= min_tokens) & (F.col("_n") < F.col(order)), "near_duplicate")
    return judged.select(order, verdict.alias("verdict")).where("verdict is not null")


def classify(df: DataFrame, id_col: str, hash_col: str, simhash_col: str, tokens_col: str, distance: int = MAX_DISTANCE, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Adds ``verdict``: accepted, exact_duplicate or near_duplicate, as a scan in the order of ``id_col`` would.

    A rejected row is no original for later ones. Long rows of one SimHash share the fate of the first of them: if it is
    accepted, the others are duplicates of it, and if an earlier row rejects it, that row rejects them as well. So only
    these first rows and the pairs of close SimHashes are decided, by :func:`greedy_rejections`; rows are joined to them
    at the end. Short rows are compared by their hash alone. ``id_col`` is unique; rows with a null hash or SimHash are
    accepted unless the other test rejects them.
    """
    rows = cut(df.select(id_col, hash_col, simhash_col, tokens_col))
    long = F.coalesce(F.col(tokens_col) >= min_tokens, F.lit(False)) & F.col(simhash_col).isNotNull()
    leaders = cut(rows.where(long).groupBy(F.col(simhash_col).alias("_s")).agg(F.min(F.struct(id_col, hash_col)).alias("_l")).select("_s", F.col(f"_l.{id_col}").alias("_i"), F.col(f"_l.{hash_col}").alias("_h")))
    close = class_pairs(rows.where(long), simhash_col, distance)
    side = lambda c: leaders.select(F.col("_s").alias(c), F.col("_i").alias(f"i{c}"))
    edges = close.join(side("ha"), "ha").join(side("hb"), "hb").select(F.least("iha", "ihb").alias("a"), F.greatest("iha", "ihb").alias("b"))
    struck = greedy_rejections(edges).select(F.col("id").alias("_i"), F.lit(True).alias("_out"))
    fate = leaders.join(struck, "_i", "left").withColumnRenamed("_s", simhash_col)
    first = rows.where(~long & F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias("_first"))
    judged = rows.join(fate, simhash_col, "left").join(first, hash_col, "left")
    of_long = F.when(F.col("_out"), "near_duplicate").when(F.col(id_col) == F.col("_i"), "accepted").when(F.col(hash_col).eqNullSafe(F.col("_h")), "exact_duplicate").otherwise("near_duplicate")
    verdict = F.when(long, of_long).when(F.col("_first") < F.col(id_col), "exact_duplicate").otherwise("accepted")
    return df.join(judged.select(id_col, verdict.alias("verdict")), id_col, "left")


def excluded_by(text_col: Column, patterns: list[str]) -> Column:
    """The first of a configured list of normalized patterns that a normalized text contains, or null."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(F.contains(text_col, F.lit(p)), F.lit(p)).otherwise(out)
    return out
