"""Functions whose results a seeded generator or exact JSON text decides, so that they need Arrow UDFs."""

from __future__ import annotations

import ast
import hashlib
import json
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Fixed values of the 64-bit mix.
GOLDEN, MULTIPLIER, MASK = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1
#: Fixed value: the stride between the seeds of two epochs.
EPOCH_STRIDE = 1_000_003


def _rows(returns: str, each: Callable) -> Callable[..., Column]:
    """A column function that applies ``each`` to the values of a row; nulls reach it as None."""

    def call(*cols: Column) -> Column:
        @pandas_udf(returns)
        def run(*series: pd.Series) -> pd.Series:
            clean = [s.astype(object).where(s.notna(), None) if s.dtype != object else s for s in series]
            return pd.Series([each(*values) for values in zip(*clean)])

        return run(*cols)

    return call


def digest_seed(text: str) -> int:
    """The first 8 bytes of a text's SHA-256 as a number."""
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def order_of(instance: str, n: int) -> list[int]:
    """Positions 0..n-1 shuffled by the standard generator under the instance's digest."""
    places = list(range(n))
    random.Random(digest_seed(instance)).shuffle(places)
    return places


def epoch_order(names: list[str], sizes: dict[str, int], seed: int, epoch: int) -> list[tuple[str, list[int]]]:
    """Groups and the rows within them in the order of one epoch: groups by the epoch's seed, rows by the group's."""
    groups = sorted(names)
    random.Random(seed + EPOCH_STRIDE * epoch).shuffle(groups)
    out = []
    for g in groups:
        rows = list(range(sizes[g]))
        random.Random(digest_seed(f"{seed}:{epoch}:{g}")).shuffle(rows)
        out.append((g, rows))
    return out


def mixed_seed(base: int, *parts: int) -> int:
    """A 63-bit seed of a base and whole numbers: each is added, multiplied in and folded, in 64-bit arithmetic."""
    state = base & MASK
    for part in parts:
        state = ((state ^ ((part + GOLDEN) & MASK)) * MULTIPLIER) & MASK
        state ^= state >> 30
    return state & (MASK >> 1)


def json_text(value: object) -> str:
    """JSON with sorted keys, without blanks, other letters kept."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(text: str | None) -> str | None:
    """The canonical form of a JSON text; null for null, and the text itself where it is none."""
    if text is None:
        return None
    try:
        return json_text(json.loads(text))
    except ValueError:
        return text.strip()


def literal(text: str | None) -> str | None:
    """A JSON or Python literal as canonical JSON; null where it is neither."""
    if text is None or not text.strip():
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            return json_text(read(text.strip()))
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


option_order = _rows("array<int>", lambda i, n: order_of(i, int(n)) if i is not None and n is not None else None)
rollout_seed = _rows("bigint", lambda b, p, s, v: mixed_seed(int(b), int(p), int(s), int(bool(v))))
canonical_json_col = _rows("string", canonical_json)
canonical_arguments = _rows("string", lambda a: "{}" if a is None else canonical_json(a))
literal_col = _rows("string", literal)


def contract_id(payload: dict, length: int = 16) -> str:
    """Name of a contract: the first digits of the SHA-256 of its canonical JSON."""
    return hashlib.sha256(json_text(payload).encode()).hexdigest()[:length]
