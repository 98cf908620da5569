"""Readers: record files, benchmark files, sample stores and their path lists."""

from __future__ import annotations

import glob
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def expand_paths(patterns: list[str], base: str = ".", spark: SparkSession | None = None) -> list[str]:
    """Files of recursive patterns, each pattern's sorted; a pattern without files and a repeated file are errors.

    With ``spark`` files are listed by the file system that ``base`` names, else on this machine.
    """
    out: list[str] = []
    for p in patterns:
        found = _listed(spark, base, p) if spark is not None else sorted(f for f in glob.glob(os.path.join(base, p), recursive=True) if os.path.isfile(f))
        if not found:
            raise FileNotFoundError(f"no files match {p}")
        out += found
    if len(set(out)) < len(out):
        raise ValueError("a file is matched twice")
    return out


def _listed(spark: SparkSession, base: str, pattern: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(where).toString().rstrip("/") + "/"
    parts = [re.escape(x) for x in re.split(r"(\*\*/|\*|\?)", pattern)]
    wild = {re.escape("**/"): "(?:[^/]+/)*", re.escape("*"): "[^/]*", re.escape("?"): "[^/]"}
    match = re.compile("".join(wild.get(x, x) for x in parts))
    files, out = fs.listFiles(where, True), []
    while files.hasNext():
        path = files.next().getPath().toString()
        if match.fullmatch(path.removeprefix(root)):
            out.append(path)
    return sorted(out)


def read_records(spark: SparkSession, paths: list[str], schema: StructType | str | None = None) -> DataFrame:
    """Records of JSON lines, JSON arrays (.json) or Parquet, told by the suffix, with ``_file`` for their origin.

    Malformed JSON fails the read. All paths have one format.
    """
    kinds = {Path(p).suffix for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"paths of one format are needed, not {sorted(kinds)}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    kind = kinds.pop()
    if kind == ".parquet":
        df = reader.parquet(*paths)
    elif kind in (".jsonl", ".ndjson"):
        df = reader.option("mode", "FAILFAST").json(paths)
    elif kind == ".json":
        df = reader.option("mode", "FAILFAST").option("multiLine", True).json(paths)
    else:
        raise ValueError(f"unknown format {kind}")
    return df.withColumn("_file", F.col("_metadata.file_path"))


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV file with a header and quoted cells of several lines; lacking columns are an error."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return df


HISTORY = "metadata struct<persona_id:string,total_messages:bigint>, chat_history array<struct<role:string,content:string>>"


def read_histories(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One object a file: ``_file, persona_id, messages`` without empty ones, ``dropped``, and ``error``
    (bad_json, role, count) where the file breaks a rule.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", HISTORY).alias("h"))
    kept = F.filter("h.chat_history", lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) != "")
    error = (
        F.when(F.col("h.chat_history").isNull(), "bad_json")
        .when(F.exists("h.chat_history", lambda m: ~m["role"].isin("system", "user", "assistant")), "role")
        .when(F.col("h.metadata.total_messages") != F.size("h.chat_history"), "count")
    )
    return raw.select(
        "_file", F.col("h.metadata.persona_id").alias("persona_id"), kept.alias("messages"), (F.size("h.chat_history") - F.size(kept)).alias("dropped"), error.alias("error")
    )


def read_aligned_lists(spark: SparkSession, paths: dict[str, str], column: str) -> DataFrame:
    """JSON arrays of equal length joined by position: ``position`` and a column for each name.

    Lists of unequal length are an error when rows are read, as their rows would not belong together.
    """
    out: DataFrame | None = None
    for name, path in paths.items():
        whole = spark.read.text(path, wholetext=True)
        items = whole.select(F.posexplode(F.from_json("value", f"array<{column}>")).alias("position", name)).withColumn(f"_has_{name}", F.lit(True))
        out = items if out is None else out.join(items, "position", "full_outer")
    if out is None:
        raise ValueError("no lists are named")
    marks = [F.col(f"_has_{n}") for n in paths]
    aligned = F.when(F.size(F.array_compact(F.array(*marks))) == len(marks), F.col("position")).otherwise(F.raise_error(F.lit("lists are of unequal length")).cast("int"))
    return out.select(aligned.alias("position"), *paths)


def read_tasks(tasks: DataFrame, meta: DataFrame) -> DataFrame:
    """Tasks with their metadata by user, task and type; those without are left out, as :func:`missing_meta` tells."""
    return tasks.join(meta, ["user_id", "task_id", "task_type"])


def missing_meta(tasks: DataFrame, meta: DataFrame) -> DataFrame:
    return tasks.join(meta, ["user_id", "task_id", "task_type"], "left_anti")


def samples(df: DataFrame) -> DataFrame:
    """Training samples with ``prompts`` and ``responses``; a single prompt or response becomes an array of one."""
    for many, one in (("prompts", "prompt"), ("responses", "response")):
        single = F.when(F.col(one).isNotNull(), F.array(one)) if one in df.columns else F.lit(None).cast("array<string>")
        df = df.withColumn(many, F.coalesce(F.col(many), single) if many in df.columns else single).drop(one)
    return df


def rows_at(df: DataFrame, index: str, positions: list[int]) -> DataFrame:
    """Random access: the samples at stated positions; the filter reaches the row groups' statistics. A position that the
    store lacks gives no row.
    """
    return df.where(F.col(index).isin(list(positions))) if positions else df.limit(0)


def sample_paths(paths: list[str]) -> list[str]:
    """Data files of a list that may hold .manifest and .txt lists, relative to themselves; # begins a comment.

    Repeated files, and lists that hold themselves, are errors.
    """
    out: list[str] = []

    def add(path: str, above: tuple[str, ...]) -> None:
        real = os.path.abspath(path)
        if real in above:
            raise ValueError(f"{path} holds itself")
        if path.endswith((".manifest", ".txt")):
            for line in Path(path).read_text().splitlines():
                name = line.split("#", 1)[0].strip()
                if name:
                    add(os.path.join(os.path.dirname(real), name), (*above, real))
        else:
            out.append(real)

    for p in paths:
        add(p, ())
    if len(set(out)) < len(out):
        raise ValueError("a data file is listed twice")
    return out


#: Keys of a build's configuration that don't change what it makes.
OPERATIONAL = ("workers", "output_dir", "overwrite", "log_every", "shard_rows", "row_group_rows")


def load_config(path: str) -> tuple[dict, str]:
    """A JSON (or, where the library is installed, YAML) configuration and the SHA-256 of its logical part."""
    import hashlib

    text = Path(path).read_text()
    try:
        config = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path} is no JSON, and YAML can't be read here") from e
        config = yaml.safe_load(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no object")
    logical = {k: v for k, v in config.items() if k not in OPERATIONAL}
    return config, hashlib.sha256(json.dumps(logical, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
