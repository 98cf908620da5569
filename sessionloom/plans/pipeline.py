"""The corpus build end to end: adapt, validate, exclude, budget and deduplicate, split, index, write, audit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions import text
from sessionloom.operators import budget, canonical, dedup, indexing, splits
from sessionloom.plans.runtime import cut
from sessionloom.sources import writers


@dataclass
class BuildConfig:
    """Settings of a build; the defaults are those of the interface."""

    target_tokens: int
    shares: dict[str, float]
    seed: int = 42
    validation_fraction: float = 0.01
    query_validation_probes: int = 2
    max_context_tokens: int = 2048
    shard_rows: int = 4096
    require_references: bool = True
    excluded_texts: list[str] = field(default_factory=list)


def build(sessions: DataFrame, config: BuildConfig) -> dict[str, DataFrame]:
    """Tables ``sessions``, ``probes``, ``split_index`` and ``rejections`` of canonical sessions.

    ``sessions`` has ``position`` (the order of acceptance), ``session_id, source, domain, events, probes``.
    Reasons in their precedence: schema_error, excluded_text, context_too_long, unexpected_domain, then the
    budget and the duplicates. Texts and probes are carried once; the budget and duplicate tests run on
    narrow rows.
    """
    limits = budget.caps(config.target_tokens, config.shares)
    rendered = canonical.render(F.col("session_id"), F.col("source"), F.col("domain"), F.col("events"))
    rows = sessions.withColumn("context", rendered).withColumn("_t", text.normalize_exact(canonical.dedup_text(F.col("events"))))
    error = canonical.first_error(F.col("session_id"), F.col("events"), F.col("probes"), references=config.require_references)
    tokens = text.word_count(F.col("context"))
    early = F.coalesce(
        F.when(error.isNotNull(), F.concat(F.lit("schema_error:"), error)),
        F.when(dedup.excluded_by(F.col("_t"), config.excluded_texts).isNotNull(), "excluded_text"),
        F.when(F.col("context_tokens") > config.max_context_tokens, "context_too_long"),
        F.when(~F.coalesce(F.col("domain").isin(*limits), F.lit(False)), "unexpected_domain"),
    )
    judged = cut(
        rows.withColumn("context_tokens", tokens)
        .withColumn("context_hash", F.sha2("_t", 256))
        .withColumn("simhash", text.simhash64()(F.col("_t")))
        .withColumn("_w", F.size(F.filter(F.split("_t", " "), lambda w: w != "")))
        .withColumn("_early", early)
        .drop("_t")
    )
    narrow = judged.where(F.col("_early").isNull()).select("position", "domain", "context_tokens", "context_hash", "simhash", "_w")
    outcome = budget.accept(narrow, limits, "position", "domain", "context_tokens", "context_hash", "simhash", "_w")
    reasons = judged.select("position", "source", "session_id", "_early").join(outcome, "position", "left")
    rejected = reasons.select(F.coalesce("_early", "reason").alias("reason"), "source", F.col("session_id").alias("source_record_id"), F.lit(None).cast("string").alias("detail"))
    accepted = judged.join(outcome.where("reason = 'accepted'").select("position"), "position", "left_semi")
    counted = accepted.withColumn("probe_count", F.size("probes"))
    indexed = indexing.running_sum(indexing.dense_index(counted, ["position"], "session_index"), ["session_index"], F.col("probe_count"), "probe_start")
    kept = cut(indexed)
    probes = kept.select("session_index", "session_id", "probe_start", F.posexplode("probes").alias("i", "p")).select(
        (F.col("probe_start") + F.col("i")).alias("probe_index"), "session_index", "session_id", F.col("p.id").alias("probe_id"),
        "p.prompt", "p.probe_type", "p.answerable", "p.reference", "p.evidence_event_ids",
    )
    marked = splits.probe_splits(probes, config.seed, config.validation_fraction, config.query_validation_probes)
    return {
        "sessions": kept.select("session_index", "session_id", "probe_start", "probe_count", "source", "domain", "context", "context_tokens", "context_hash", "simhash", F.to_json("events").alias("events_json")),
        "probes": marked.drop("held_out"),
        "split_index": splits.split_index(marked),
        "rejections": rejected.where("reason != 'accepted'"),
    }


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, config: BuildConfig) -> dict:
    """Write the tables as shards and a manifest; the manifest comes last, so that a folder with one is whole."""
    order = {"sessions": "session_index", "probes": "probe_index", "split_index": "session_id", "rejections": "source_record_id"}
    for name, df in tables.items():
        writers.write_shards(df, f"{folder}/{name}", order[name], config.shard_rows)
    return writers.write_manifest(spark, {n: f"{folder}/{n}" for n in tables}, f"{folder}/manifest.json", {"seed": config.seed})
