"""SQL of exact text normalization (NFKC and case folding), which DuckDB lacks: characters are mapped by tables that a
rule builds from the Unicode data of Python, then composed by NFC.
"""

from __future__ import annotations

import unicodedata
from functools import cache

#: Where characters with compatibility forms or capitals lie: the first plane, mathematical and enclosed signs, and the
#: capitals of the scripts beyond it.
_RANGES = ((0x80, 0xD800), (0xE000, 0x10000), (0x10400, 0x10600), (0x10C80, 0x10CC0), (0x118A0, 0x118C0), (0x16E40, 0x16E60), (0x1D400, 0x1D800), (0x1E900, 0x1E930), (0x1EE00, 0x1EF00), (0x1F100, 0x1F300))


def _table(name: str, pairs: list[tuple[str, str]]) -> str:
    lists = ("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in own) + "]" for own in zip(*pairs))
    return f"{name} as (select " + ", ".join(f"unnest({x}) as {c}" for x, c in zip(lists, "cd")) + ")"


@cache
def tables() -> str:
    """The tables ``compat`` and ``fold`` of characters and what they become."""
    chars = [chr(c) for a, b in _RANGES for c in range(a, b)]
    compat = [(c, n) for c in chars if (n := unicodedata.normalize("NFKC", c)) != unicodedata.normalize("NFC", c)]
    fold = [(c, c.casefold()) for c in chars if c.casefold() != c]
    return _table("compat", compat) + ", " + _table("fold", fold)


def normalized(name: str, source: str, key: str, col: str) -> str:
    """CTEs that end in ``name(key, t)``: NFKC and case folding of each row's text; null gives the empty string."""
    mapped = lambda out, src, table, done: f"""{out}_c as (select {key}, unnest(cs) as c, generate_subscripts(cs, 1) as i from (select {key}, regexp_extract_all(t, '(?s).') as cs from {src} where regexp_matches(t, '[^\\x00-\\x7f]'))),
{out} as (select {key}, {done.format("string_agg(coalesce(d, c), '' order by i)")} as t from {out}_c left join {table} using (c) group by 1)"""  # noqa: E731
    return f"""{name}_0 as (select {key}, coalesce({col}, '') as t from {source}), {mapped(name + "_1", name + "_0", "compat", "nfc_normalize({})")},
{name}_2 as (select a.{key}, coalesce(b.t, a.t) as t from {name}_0 a left join {name}_1 b on b.{key} is not distinct from a.{key}), {mapped(name + "_3", name + "_2", "fold", "{}")},
{name} as (select a.{key}, lower(coalesce(b.t, a.t)) as t from {name}_2 a left join {name}_3 b on b.{key} is not distinct from a.{key})"""


def words(col: str) -> str:
    """The list of words of a normalized text."""
    return f"regexp_extract_all({col}, '[\\pL\\pN_]+')"


def joined(col: str) -> str:
    return f"array_to_string({words(col)}, ' ')"
