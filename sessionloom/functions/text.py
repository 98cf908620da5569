"""Text functions of the corpus pipeline. Native expressions unless bit-exact Unicode work needs Arrow UDFs."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Blanks of Unicode at either end, which plain trim leaves.
STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(col: Column) -> Column:
    """Without Unicode white space at its ends; null becomes the empty string."""
    return F.coalesce(F.regexp_replace(col, STRIP, ""), F.lit(""))


def string_list(col: Column) -> Column:
    """Entries without outer blanks, blank ones dropped; null gives an empty array."""
    return F.coalesce(F.filter(F.transform(col, strip), lambda x: x != ""), F.array().cast("array<string>"))


def tokens(col: Column) -> Column:
    """Word tokens of small letters (native; sharp s folded, no compatibility forms)."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(col, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit(r"[\p{L}\p{N}_]+"), 0)


def normalize(col: Column) -> Column:
    """Tokens joined by one space: the native form of the deduplication text."""
    return F.array_join(tokens(col), " ")


def word_count(col: Column) -> Column:
    """Number of tokens: the offline token counter."""
    return F.size(tokens(col)).cast("bigint")


_WORD = re.compile(r"\w+")


def exact_normalize(text: str | None) -> str:
    """NFKC, case folding, and word runs joined by one space; null gives the empty string."""
    return " ".join(_WORD.findall(unicodedata.normalize("NFKC", text or "").casefold()))


def normalize_exact(col: Column) -> Column:
    """:func:`exact_normalize` for a column, by an Arrow UDF."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(exact_normalize)

    return run(col)


def text_hash(col: Column) -> Column:
    """SHA-256 of the normalized text (NFKC, case folding, words), in hexadecimal digits."""
    return F.sha2(normalize_exact(col), 256)


def normalized_words(col: Column) -> Column:
    """Number of words of a text that is normalized already."""
    return F.when(col == "", 0).otherwise(F.size(F.split(col, " "))).cast("bigint")


def simhash_of(words: list[str], width: int = 3, digest: str = "blake2b") -> int:
    """64-bit SimHash of the word shingles, which count as often as they occur; ties set the bit; signed.

    Fewer words than ``width`` make one shingle; no words give 0.
    """
    if not words:
        return 0
    grams = ["\0".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    if digest == "blake2b":
        raw = b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in grams)
    else:
        raw = b"".join(hashlib.md5(g.encode()).digest()[:8] for g in grams)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    on = 2 * bits.sum(axis=0, dtype=np.int64) >= len(grams)
    return int.from_bytes(np.packbits(on).tobytes(), "big", signed=True)


def simhash64(width: int = 3, digest: str = "blake2b"):
    """Arrow UDF: SimHash of a normalized text, as a signed bigint."""

    @pandas_udf("bigint")
    def run(col: pd.Series) -> pd.Series:
        return col.map(lambda t: simhash_of((t or "").split(), width, digest))

    return run


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def wrapped_product(col: Column, factor: int, addend: int) -> Column:
    """The lowest 64 bits of ``col * factor + addend`` as a signed bigint, for any bigint and factors of up to 18 digits.

    It is computed in decimals, as a bigint product that overflows is an error.
    """
    low = F.pmod(col.cast("decimal(19,0)") * F.lit(Decimal(factor)) + F.lit(Decimal(addend)), F.lit(Decimal(1 << 64)))
    return F.when(low >= F.lit(Decimal(1 << 63)), low - F.lit(Decimal(1 << 64))).otherwise(low).cast("bigint")


def bands(col: Column, count: int = 4, width: int = 16) -> Column:
    """The hash cut into ``count`` bands of ``width`` bits, from the lowest."""
    return F.array(*[F.shiftrightunsigned(col, width * b).bitwiseAND(F.lit((1 << width) - 1)) for b in range(count)])


def stable_hex(seed: int, *parts: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of seed and parts, joined by NUL: sorts as the fraction does."""
    joined = F.concat_ws("\0", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def stable_fraction(seed: int, *parts: Column) -> Column:
    """A stable pseudo-random number in [0, 1) of seed and parts."""
    number = F.conv(stable_hex(seed, *parts), 16, 10).cast("decimal(20,0)")
    return number.cast("double") / F.lit(2.0**64)


def exact_quality(text: str | None) -> str:
    """NFKC, case folding and single blanks; null gives the empty string."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def quality_normalize(col: Column) -> Column:
    """:func:`exact_quality` for a column, by an Arrow UDF, for answer comparison."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(exact_quality)

    return run(col)


def canonical_role(col: Column) -> Column:
    """Role names of other conventions in the canonical ones; unknown roles become null."""
    table = {"human": "user", "user": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "assistant": "assistant",
             "model": "assistant", "system": "system", "tool": "tool", "function": "tool", "environment": "environment"}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(col)))


def clean_prompt(col: Column) -> Column:
    """Instruction markers removed and white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"\[/?INST\]|</?s>", " "), r"[ \t\n\x0B\f\r]+", " "))


def safe_history_path(col: Column, prefix: str) -> Column:
    """The reason why a relative path is not acceptable, or null."""
    return (
        F.when(col.isNull() | (F.trim(col) == ""), "blank")
        .when(col.startswith("/"), "absolute")
        .when(col.rlike(r"(^|/)\.\.(/|$)"), "parent")
        .when(~col.startswith(prefix), "prefix")
    )


def options_from_text(col: Column) -> Column:
    """``A: text`` lines as an array of texts; a text without markers is one option."""
    parts = F.split(F.coalesce(col, F.lit("")), r"(?:^|\n)[A-Z]:\s")
    return F.filter(F.transform(parts, F.trim), lambda x: x != "")


def option_lines(options: Column) -> Column:
    """Options as ``A. text`` lines."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def asset_key(length: int, *parts: Column) -> Column:
    """First digits of the SHA-256 of parts joined by NUL: the key of a cached asset."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)
