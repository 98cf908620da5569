"""Answer quality: exact match, token F1, ROUGE-L, and statistics that merge."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sessionloom.functions.text import exact_quality


def _pairwise(kernel, kind: str):
    """An Arrow UDF of a function of two lists of words; null texts have no words."""

    def column(a: Column, b: Column) -> Column:
        @pandas_udf(kind)
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([kernel(exact_quality(p).split(), exact_quality(q).split()) for p, q in zip(x, y)], dtype="int64" if kind == "bigint" else "float64")

        return run(a, b)

    column.__doc__ = kernel.__doc__
    return column


def f1_of(x: list[str], y: list[str]) -> float:
    """F1 of the multisets of words; both empty 1, one empty 0."""
    n = len(x) + len(y)
    return 2.0 * (Counter(x) & Counter(y)).total() / n if n else 1.0


def lcs_of(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one number for each word of the first list."""
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(x)) - 1
    left = every
    for w in y:
        met = left & places.get(w, 0)
        left = ((left + met) | (left - met)) & every
    return len(x) - left.bit_count()


def rouge_of(x: list[str], y: list[str]) -> float:
    """F1 of the longest common subsequence of words; both empty 1, one empty 0."""
    n = len(x) + len(y)
    return 2.0 * lcs_of(x, y) / n if n else 1.0


token_f1 = _pairwise(f1_of, "double")
lcs_length = _pairwise(lcs_of, "bigint")
rouge_l = _pairwise(rouge_of, "double")


def summarize(scored: DataFrame, by: list[str], f1: str = "f1", exact: str = "exact", empty: str = "empty") -> DataFrame:
    """Sums that merge, and their ratios: ``n, exact_match, token_f1, empty_rate`` by group."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.sum(F.col(exact).cast("bigint")) / F.count("*")).alias("exact_match"),
        (F.sum(f1) / F.count("*")).alias("token_f1"),
        (F.sum(F.col(empty).cast("bigint")) / F.count("*")).alias("empty_rate"),
    )


def mean_of_means(losses: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Average over the last level, then over the one before, and so on: the mean of means by the first."""
    df, col = losses, value
    for depth in range(len(levels), 0, -1):
        df = df.groupBy(*levels[:depth]).agg(F.avg(col).alias("_mean"))
        col = "_mean"
    return df.withColumnRenamed("_mean", "mean_loss")
