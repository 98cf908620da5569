"""Problem 6, encoding of the whole corpus, and problem 4, the token budget of every slice."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.names import language_code, proper_names
from sessionloom.llm import bpe, unigram
from sessionloom.plans.runtime import arrow_map


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = bpe.BYTE_BPE,
    tokenizer_dir: str = bpe.TOKENIZER_DIR,
) -> DataFrame:
    """Token ids of every text by exact byte-level BPE, as ``(id_col, ids array<int>)``.

    One narrow map over the two columns that are needed; no shuffle. Null, and empty, text gives an
    empty list; blank text is encoded as it is; a row with a null id is kept; repeated rows give
    repeated rows; other columns of ``docs`` are not read. Any length of text is encoded whole.
    """
    path = os.path.join(tokenizer_dir, vocabulary)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = bpe.load(path).parts
        flat: list[tuple[int, ...]] = []
        ends = np.zeros(batch.num_rows + 1, np.int32)
        total = 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text:
                own = parts(text)
                flat += own
                total += sum(map(len, own))
            ends[i + 1] = total
        values = np.fromiter(chain.from_iterable(flat), np.int32, total)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), kernel, f"`{id_col}` {kind}, ids array<int>")


def token_budget(
    events: DataFrame,
    sessions: DataFrame,
    catalog: DataFrame,
    vocabulary: str = bpe.BYTE_BPE,
    tokenizer_dir: str = bpe.TOKENIZER_DIR,
) -> DataFrame:
    """Tokens of the distinct events by proper source, proper domain and language of the session.

    Returns ``source, domain, language, n_sessions, n_events, n_tokens``. An event that was delivered
    again counts once; null and empty content count as 0 tokens; a session row that is repeated counts
    once; events whose session is not in ``sessions`` are listed with null source and domain and the
    language ``und``. Counting comes before any shuffle, so that only keys and a number are moved; the
    sums per session are combined before they move, so a session with a third of all events costs no
    more than another. A vocabulary file whose model is a unigram model (``.json`` with pieces and
    scores) is counted by count-only Viterbi over a double-array trie, a byte-level BPE vocabulary by
    exact backtracking.
    """
    path = os.path.join(tokenizer_dir, vocabulary)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = unigram.load(path).count if unigram.is_unigram(path) else bpe.load(path).count
        n = np.fromiter((count(t) if t else 0 for t in batch.column(2).to_pylist()), np.int64, batch.num_rows)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n)], names=["session_id", "event_id", "n"]
        )

    counted = arrow_map(
        events.select("session_id", "event_id", "content"), kernel, "session_id string, event_id string, n bigint"
    )
    distinct = counted.groupBy("session_id", "event_id").agg(F.max("n").alias("n"))
    per_session = distinct.groupBy("session_id").agg(F.count("*").alias("n_events"), F.sum("n").alias("n_tokens"))
    facts = session_facts(sessions, catalog)
    return (
        per_session.join(facts, "session_id", "left")
        .groupBy("source", "domain", F.coalesce("language", F.lit("und")).alias("language"))
        .agg(
            F.count("*").alias("n_sessions"),
            F.sum("n_events").alias("n_events"),
            F.sum("n_tokens").alias("n_tokens"),
        )
    )


def session_facts(sessions: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row ``session_id, source, domain, language`` for each session, under proper names."""
    one = sessions.groupBy("session_id").agg(
        F.min(F.struct("source", "domain", F.get_json_object("metadata_json", "$.language").alias("language"))).alias("f")
    )
    flat = one.select("session_id", "f.source", "f.domain", language_code(F.col("f.language")).alias("language"))
    return proper_names(flat, catalog)
