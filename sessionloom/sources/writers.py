"""Writers: indexed shards, rejection logs, manifests with digests, resumable appends and subsets."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.plans.runtime import path_exists

SHARD_ROWS = 4096


def write_shards(df: DataFrame, path: str, index: str, rows: int = SHARD_ROWS, fmt: str = "parquet") -> None:
    """Rows in ranges of ``index``, sorted within each file, at most ``rows`` in a file; published by the commit protocol."""
    writer = df.repartitionByRange(F.col(index)).sortWithinPartitions(index).write.mode("overwrite").option("maxRecordsPerFile", rows)
    if fmt == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_json_atomic(value: object, path: str, spark: SparkSession | None = None) -> None:
    """A JSON file with sorted keys that appears whole or not at all; with ``spark`` on the file system of ``path``."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n"
    part = f"{path}.incomplete"
    if spark is None:
        Path(part).write_text(text, encoding="utf-8")
        os.replace(part, path)
        return
    name = spark._jvm.org.apache.hadoop.fs.Path
    fs = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(name(part), True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(name(path), False)
    if not fs.rename(name(part), name(path)):
        raise OSError(f"{path} can't be published")


def split_rejections(df: DataFrame, reason: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Accepted rows without the reason, and the log ``reason, source, source_record_id, detail`` of all others."""
    accepted = df.where(F.col(reason).isNull()).drop(reason)
    column = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    log = df.where(F.col(reason).isNotNull()).select(F.col(reason).alias("reason"), *[column(c).alias(c) for c in ("source", "source_record_id", "detail")])
    return accepted, log


def inventory(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """``file, bytes, sha256`` of the files of a folder, hashed where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, tables: dict[str, str], path: str, extra: dict | None = None) -> dict:
    """A manifest of written tables: rows, files, and the digest of the files' digests in their order."""
    out: dict = dict(extra or {})
    for name, where in sorted(tables.items()):
        files = inventory(spark, where).orderBy("file")
        total = files.agg(
            F.count("*").alias("files"),
            F.sum("bytes").alias("bytes"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "sha256"))), lambda f: f["sha256"]), ""), 256).alias("digest"),
        ).first()  # one entry for each file of a table
        out[name] = {"path": where, "rows": spark.read.parquet(where).count(), "files": total["files"], "bytes": total["bytes"], "sha256": total["digest"]}
    write_json_atomic(out, path, spark)
    return out


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at ``path`` lacks; returns how many rows the table has then.

    A stopped run is resumed by calling it again: what was written is skipped, on any file system that Spark reads.
    """
    spark = df.sparkSession
    if path_exists(spark, path):
        done = spark.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    df.dropDuplicates([key]).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).count()


def export_subset(df: DataFrame, path: str, selection: str, n: int, tokens: str, index: str) -> None:
    """The first or the longest ``n`` samples as JSON lines: a top-k by design."""
    if selection == "first":
        top = df.orderBy(index).limit(n)
    elif selection == "longest_context":
        top = df.orderBy(F.desc_nulls_last(tokens), index).limit(n)
    else:
        raise ValueError(f"unknown selection {selection}")
    top.write.mode("overwrite").json(path)


def overwrite_sources(df: DataFrame, path: str) -> None:
    """Replace the partitions of the sources that ``df`` holds and leave all others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
