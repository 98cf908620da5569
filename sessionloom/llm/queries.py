"""The pN_ queries of the training-data problems, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import abuse, encoding, leaks, neardup, pairs, pii, tokens
from sessionloom.llm.sql import ORACLE as ORACLE
from sessionloom.plans.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.find_defects(table(spark, sf, "probes")).select("probe_index", "defect")


def _p2_scored(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score_events(table(spark, sf, "session_events"), table(spark, sf, "moderation_labels"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p2_scored(spark, sf).where("offending").select("session_id", "event_id")


def p2_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _p2_scored(spark, sf)


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(_p2_scored(spark, sf), table(spark, sf, "sessions"), table(spark, sf, "source_catalog"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_mentions(table(spark, sf, "session_events")).select("session_id", "event_id", "kind", "start_pos")


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "session_events")
    return pii.replace_mentions(events, pii.find_mentions(events))


def p4_token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_budget(
        table(spark, sf, "session_events"), table(spark, sf, "sessions"), table(spark, sf, "source_catalog")
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.similar_sessions(table(spark, sf, "session_events")).select("session_id_a", "session_id_b")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf, "session_events"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.select("doc_id", "item_id")


def p7_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("containment").alias("max_containment"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.find_garbled(table(spark, sf, "documents")).select("doc_id").distinct()


def p8_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.find_garbled(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_scores": p2_scores,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_token_budget": p4_token_budget,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p8_found": p8_found,
    "p8_restored": p8_restored,
}
