"""Proper names of sources and languages, which tables spell in several ways. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of languages in their own spelling and in English, with their codes.
LANGUAGE_NAMES = {
    "english": "en",
    "deutsch": "de",
    "german": "de",
    "français": "fr",
    "francais": "fr",
    "french": "fr",
    "español": "es",
    "espanol": "es",
    "spanish": "es",
    "русский": "ru",
    "russian": "ru",
    "中文": "zh",
    "chinese": "zh",
}
UNKNOWN_LANGUAGE = "und"


def source_key(col: Column) -> Column:
    """A spelling of a source name without case, outer blanks and kind of separator; null stays null."""
    trimmed = F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.regexp_replace(F.lower(trimmed), r"[\s\p{Z}_-]+", "_")


def proper_names(df: DataFrame, catalog: DataFrame, source: str = "source", domain: str | None = "domain") -> DataFrame:
    """Replace ``source`` by its proper name of the catalog and ``domain`` by the catalog's domain.

    The catalog is a fixed table of a few rows, one for each adapter that exists; it is joined with a
    hash join whose build side the session's broadcast threshold governs. A source that the catalog
    lacks keeps its cleaned spelling, and its domain (null if it has none).
    """
    names = catalog.groupBy(source_key(F.col("source")).alias("_key")).agg(
        F.min("source").alias("_proper"), F.min("domain").alias("_domain")
    )
    joined = df.withColumn("_key", source_key(F.col(source))).join(names, "_key", "left")
    out = joined.withColumn(source, F.coalesce("_proper", "_key"))
    if domain:
        out = out.withColumn(domain, F.coalesce("_domain", F.col(domain)))
    return out.drop("_key", "_proper", "_domain")


def language_code(col: Column) -> Column:
    """Code of a language in any of its spellings; ``und`` where it is null, blank or unknown."""
    key = F.lower(F.regexp_replace(col, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    code = F.regexp_extract(key, r"^([a-z]{2,3})(?:[-_][a-z0-9]+)*$", 1)
    return F.coalesce(F.try_element_at(table, key), F.when(code != "", code), F.lit(UNKNOWN_LANGUAGE))
