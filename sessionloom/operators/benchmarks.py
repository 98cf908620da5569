"""Benchmark preparation: option order, prefix expansion, splits, folds, and result summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.plans.runtime import cut


def shuffled_options(instance: Column, options: Column, seed: int) -> Column:
    """Options in the order of the SHA-256 of seed, instance and position, and where the first one (gold) went."""
    keyed = F.transform(
        options,
        lambda o, i: F.struct(
            F.sha2(F.concat_ws("\0", F.lit(str(seed)), instance, i.cast("string")), 256).alias("k"), i.alias("i"), o.alias("o")
        ),
    )
    ordered = F.array_sort(keyed)
    gold = F.array_position(F.transform(ordered, lambda x: x["i"]), 0) - 1
    return F.struct(F.transform(ordered, lambda x: x["o"]).alias("options"), gold.alias("gold"))


def prefixes(examples: DataFrame, noise: DataFrame, turns: tuple[int, ...], position: str) -> DataFrame:
    """Each example with the first n noise rows, for each n of ``turns`` (a few numbers).

    The prefixes don't depend on the example, so they are made once, one row for each n, and every example
    gets a reference to each of them by a join on n: no pair of example and noise row is made.
    """
    wanted = F.explode(F.array(*[F.lit(t) for t in turns])).alias("turns")
    sizes = noise.where(F.col(position) < max(turns)).select(wanted, F.col(position).alias("_p")).where("_p < turns")
    made = sizes.groupBy("turns").agg(F.count("*").alias("available"))
    return examples.select("*", wanted).join(F.broadcast(made), "turns", "left").withColumn("available", F.coalesce("available", F.lit(0)))


def folds(rows: DataFrame, user: str) -> DataFrame:
    """Leave-one-user-out: each row once for every fold, as test in its user's fold and as train in the others.

    The folds are the distinct users, a handful by the benchmark's design, and each row carries as many copies as there
    are folds, as the result lists them; the table of folds is broadcast only up to 1000 users, else it is shuffled.
    """
    users = rows.select(F.col(user).alias("fold")).where(F.col(user).isNotNull()).distinct()
    users = cut(users)
    table = F.broadcast(users) if users.count() <= 1000 else users
    one = F.lit(1)
    return rows.withColumn("_k", one).join(table.withColumn("_k", one), "_k").drop("_k").withColumn("part", F.when(F.col(user) == F.col("fold"), "test").otherwise("train"))


def macro_summary(results: DataFrame, user: str, variant: str, correct: str) -> DataFrame:
    """``variant, users, macro_mean, macro_std``: the mean and population deviation of the users' accuracies."""
    per_user = results.groupBy(variant, user).agg(F.avg(F.col(correct).cast("double")).alias("a"))
    return per_user.groupBy(variant).agg(F.count("*").alias("users"), F.avg("a").alias("macro_mean"), F.stddev_pop("a").alias("macro_std"))


def linear_percentiles(df: DataFrame, key: str, value: str, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Percentiles by linear interpolation, one column p50, p95, … each."""
    return df.groupBy(key).agg(*[F.percentile(value, q).alias(f"p{round(q * 100)}") for q in at])


def nearest_rank(df: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """Percentile by nearest rank, position q (n - 1) rounded half to even.

    Values are counted before they are ranked, so a key with a third of all rows is ranked by its distinct values.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    place = F.bround(F.lit(q) * (F.sum("_n").over(w) - 1), 0)
    ranked = counts.select(key, value, upto.alias("_upto"), place.alias("_place"))
    return ranked.where("_upto > _place").groupBy(key).agg(F.min(value).alias(name))


def normalize_persona(rows: DataFrame, held_out: DataFrame | None, pinned: dict[int, str], query: str = "user_query") -> DataFrame:
    """Benchmark rows with ``options`` (gold first), ``repairs`` (answers that were null) and ``reject``.

    ``rows`` has ``source_row, persona_id, correct_answer, incorrect_answers`` (array). Reasons in their order:
    benchmark_persona_overlap, the pinned reason of a row, missing_incorrect_answers, duplicate_answers,
    correct_answer_in_distractors. ``pinned`` is a short stated list.
    """
    clean = F.filter(F.coalesce("incorrect_answers", F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit(""))) != "")
    df = rows.withColumn("_clean", clean).withColumn("repairs", F.coalesce(F.size("incorrect_answers") - F.size("_clean"), F.lit(0)))
    if held_out is not None:
        keys = held_out.where("persona_id is not null").select("persona_id").distinct().withColumn("_hit", F.lit(True))
        df = df.join(keys, "persona_id", "left")
    else:
        df = df.withColumn("_hit", F.lit(None).cast("boolean"))
    known = F.lit(None).cast("string")
    for row, reason in pinned.items():
        known = F.when(F.col("source_row") == row, reason).otherwise(known)
    reject = F.coalesce(
        F.when(F.col("_hit"), "benchmark_persona_overlap"),
        known,
        F.when(F.size("_clean") == 0, "missing_incorrect_answers"),
        F.when(F.size(F.array_distinct("_clean")) < F.size("_clean"), "duplicate_answers"),
        F.when(F.array_contains("_clean", F.col("correct_answer")), "correct_answer_in_distractors"),
    )
    return df.withColumn("options", F.concat(F.array("correct_answer"), "_clean")).withColumn("reject", reject).drop("_clean", "_hit")


def canonical_messages(messages: Column) -> Column:
    """Messages as events whose ids are their first positions, four digits; empty ones go and leave gaps."""
    placed = F.transform(messages, lambda m, i: F.struct(F.concat(F.lit("e"), F.lpad(i.cast("string"), 4, "0")).alias("id"), m["role"].alias("role"), F.trim(m["content"]).alias("content")))
    return F.filter(placed, lambda e: e["content"] != "")


def runtime_contract(manifest: dict, max_context: int, teacher_context: int, max_sequence: int, teacher_sequence: int) -> list[str]:
    """What of a run's limits contradicts a corpus manifest; empty where all holds."""
    limit = int(manifest.get("max_context_tokens") or 0)
    broken = {
        "no_corpus_limit": limit <= 0,
        "context_limit": max_context != limit,
        "teacher_context_limit": teacher_context != limit,
        "teacher_sequence": teacher_sequence < teacher_context + max_sequence + 64,
    }
    return [name for name, bad in broken.items() if bad]


def tail_config(sources: dict[str, str], domain_caps: dict[str, int], remaining: list[str]) -> dict:
    """Configuration for the remaining sources (name to domain): their domains keep the absolute caps; gates are off."""
    unknown = set(remaining) - set(sources)
    if unknown or len(set(remaining)) < len(remaining):
        raise ValueError(f"remaining sources are unknown or repeated: {sorted(unknown) or remaining}")
    kept = {d: domain_caps[d] for d in dict.fromkeys(sources[s] for s in remaining)}
    total = sum(kept.values())
    return {"sources": list(remaining), "target_tokens": total, "shares": {d: c / total for d, c in kept.items()}, "gates": False}


def first_session_rule(*places: dict) -> str:
    """The one rule that several places record; without any the zero state; two different ones are an error."""
    rules = {p["first_session_rule"] for p in places if p.get("first_session_rule")}
    if len(rules) > 1 or not rules <= {"direct", "gate_zero_state"}:
        raise ValueError(f"conflicting or unknown rules: {sorted(rules)}")
    return rules.pop() if rules else "gate_zero_state"


def sorted_results(results: DataFrame, key: str = "instance_id", position: str = "position") -> DataFrame:
    """Results with a dense ``position`` by their id, whatever order the runs wrote them in; repeated ids keep all rows."""
    from sessionloom.operators.indexing import dense_index

    rest = [c for c in results.columns if c != key]
    return dense_index(results, [key, *rest], position)


def topic_split(rows: DataFrame, topic: str, seed: int, held_out: int) -> DataFrame:
    """``part`` by topic: the ``held_out`` topics that come first by the SHA-256 of seed and topic are test, the rest train.

    Topics are a few names; null topics are train. A topic is never in both parts.
    """
    names = rows.where(F.col(topic).isNotNull()).select(topic).distinct().withColumn("_k", F.sha2(F.concat_ws("\0", F.lit(str(seed)), topic), 256))
    test = names.orderBy("_k", topic).limit(held_out).select(topic, F.lit("test").alias("part"))
    return rows.join(test, topic, "left").withColumn("part", F.coalesce("part", F.lit("train")))
