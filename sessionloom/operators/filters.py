"""Source filters and gates. Every filter gives a reason; rejected rows go to a log, never away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.names import source_key


def language_reason(language: Column, allowed: list[str]) -> Column:
    """``language`` where an allow-list is set and the language is missing or not in it, whatever its case."""
    if not allowed:
        return F.lit(None).cast("string")
    known = F.lower(F.trim(F.coalesce(language, F.lit("")))).isin(*[a.casefold() for a in allowed])
    return F.when(~known, "language")


def flagged(json: Column) -> Column:
    """Whether a moderation record says anywhere ``"flagged": true`` or has a list under it that holds true."""
    return F.coalesce(json.rlike(r'"flagged"\s*:\s*(?:true\b|\[[^\]]*\btrue\b)'), F.lit(False))


def repository_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(col), r"^/+|/+$", ""))


def excluded(df: DataFrame, key: Column, barred: DataFrame, column: str, reason: str) -> DataFrame:
    """Adds ``reject``: ``reason`` for rows whose key is in ``barred``. A hash join either way; sizes decide."""
    keys = barred.select(repository_key(F.col(column)).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    joined = df.withColumn("_key", repository_key(key)).join(keys, "_key", "left")
    return joined.withColumn("reject", F.when(F.col("_hit"), reason)).drop("_key", "_hit")


def too_long(counts: Column, limit: int) -> Column:
    """``name=count`` of every tokenizer over the limit, by name, or null."""
    over = F.filter(F.map_entries(counts), lambda kv: kv["value"] > limit)
    text = F.array_join(F.array_sort(F.transform(over, lambda kv: F.concat(kv["key"], F.lit("="), kv["value"].cast("string")))), ", ")
    return F.when(F.size(over) > 0, text)


def unexpected_domain(df: DataFrame, caps: DataFrame) -> DataFrame:
    """Adds ``reject`` for domains without a cap; caps is a table of a few domains."""
    known = caps.select("domain").distinct().withColumn("_known", F.lit(True))
    return df.join(known, "domain", "left").withColumn("reject", F.when(F.col("_known").isNull(), "unexpected_domain")).drop("_known")


def leaked_groups(rows: DataFrame, held_out: DataFrame, group: str) -> DataFrame:
    """Rows with ``reject`` = leakage where their group occurs in the held-out rows; null groups never do."""
    keys = held_out.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_hit", F.lit(True))
    return rows.join(keys, group, "left").withColumn("reject", F.when(F.col("_hit"), "leakage")).drop("_hit")


def external_allowed(provenance: Column, provider: str) -> Column:
    """Whether a session may go to a provider: to an external one only where its provenance allows it.

    Anything but a true value of ``external_api_allowed`` denies: a missing, null, false, zero or empty one, and
    provenance that is null or no JSON object.
    """
    if provider not in ("openai", "openai_compatible"):
        return F.lit(True)
    said = F.get_json_object(provenance, "$.external_api_allowed")
    return F.coalesce(~F.lower(said).isin("false", "null", "", "0", "0.0", "[]", "{}"), F.lit(False))


def excluded_source(source: Column, barred: list[str]) -> Column:
    """``excluded_source`` for names on a deny-list, whatever their case and separators; null names never are."""
    keys = [k.strip().casefold().replace("-", "_").replace(" ", "_") for k in barred]
    return F.when(F.coalesce(source_key(source).isin(*keys), F.lit(False)), "excluded_source") if keys else F.lit(None).cast("string")


def gates(stats: DataFrame, minimum: dict[str, float], shares: dict[str, float], tolerance: float) -> DataFrame:
    """Failures ``gate, value, bound`` of a table ``domain, sessions, tokens, probes`` against launch gates."""
    totals = stats.agg(F.sum("sessions").alias("sessions"), F.sum("tokens").alias("tokens"), F.sum("probes").alias("probes"))
    values = totals.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(g).alias("gate"), v.cast("double").alias("value"), F.lit(float(minimum[g])).alias("bound"))
                    for g, v in (("sessions", F.col("sessions")), ("tokens", F.col("tokens")), ("mean_probes", F.col("probes") / F.col("sessions")))
                    if g in minimum
                ]
            )
        ).alias("g")
    ).select("g.*")
    low = values.where("value < bound")
    share = stats.join(F.broadcast(totals.select(F.col("tokens").alias("_all"))))  # one row
    target = F.try_element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("domain"))
    off = share.select(F.concat(F.lit("share:"), F.col("domain")).alias("gate"), F.abs(F.col("tokens") / F.col("_all") - target).alias("value"), F.lit(tolerance).alias("bound"))
    return low.unionByName(off.where("value > bound"))


def first_reason(*reasons: Column) -> Column:
    """The first reason that applies, in the order of precedence."""
    return F.coalesce(*reasons)
