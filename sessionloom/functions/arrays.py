"""Array functions of the training reader: windows, masks, truncation, padding, alignment. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotating_rows(n: Column, sample: Column, passes: Column, queries: int) -> Column:
    """Positions of a circular window of min(n, queries) rows that moves on with each pass; empty for n = 0."""
    size = F.least(n, F.lit(queries))
    offset = F.pmod(sample + passes * size, F.greatest(n, F.lit(1)))
    moved = F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), lambda j: F.pmod(offset + j, F.greatest(n, F.lit(1))))
    return F.when(size > 0, moved).otherwise(F.array().cast("array<bigint>"))


def through_first(ids: Column, stops: list[int]) -> Column:
    """Length of the prefix that ends with the first stop id, or of the whole array where there is none."""
    places = [F.array_position(ids, s) for s in stops]
    first = F.least(*[F.when(p > 0, p) for p in places]) if len(places) > 1 else F.when(places[0] > 0, places[0])
    return F.coalesce(first, F.size(ids).cast("bigint"))


def response_mask(ids: Column, stops: list[int]) -> Column:
    """1 through the first stop id inclusive, 0 after it."""
    upto = through_first(ids, stops)
    return F.transform(ids, lambda x, i: (i < upto).cast("int"))


def trim_row(ids: Column, stops: list[int], specials: list[int]) -> Column:
    """Ids before the first stop, without special ids."""
    end = F.least(*[F.when(F.array_position(ids, s) > 0, F.array_position(ids, s)) for s in stops], F.size(ids) + 1)
    return F.filter(F.slice(ids, 1, (end - 1).cast("int")), lambda x: ~x.isin(*specials))


def position_ids(mask: Column) -> Column:
    """Running count of mask bits less one; 0 before the first."""
    sums = F.aggregate(
        mask, F.array().cast("array<int>"), lambda a, m: F.concat(a, F.array(F.coalesce(F.element_at(F.slice(F.concat(F.array(F.lit(0)), a), -1, 1), 1), F.lit(0)) + m))
    )
    return F.transform(sums, lambda s: F.greatest(s - 1, F.lit(0)))


def truncate_keep_span(ids: Column, start: Column, end: Column, limit: int) -> Column:
    """At most ``limit`` ids that keep the span [start, end) and, after it, as much of the tail before it as fits.

    A span longer than the limit keeps its end.
    """
    size = F.size(ids)
    stop = F.when(size <= limit, size).otherwise(F.greatest(F.least(end, size), F.lit(limit)))
    first = F.greatest(stop - limit, F.lit(0))
    return F.slice(ids, (first + 1).cast("int"), (stop - first).cast("int"))


def find_sub(haystack: Column, needle: Column) -> Column:
    """0-based start of the first occurrence of an array within another, -1 if there is none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(haystack) - F.size(needle) + 1, F.lit(1)))
    hits = F.filter(starts, lambda s: F.slice(haystack, s, F.size(needle)) == needle)
    fits = (F.size(needle) > 0) & (F.size(needle) <= F.size(haystack))
    return F.when(fits & (F.size(hits) > 0), F.element_at(hits, 1) - 1).otherwise(-1)


def pad_right(ids: Column, size: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), (size - F.size(ids)).cast("int")))


def pad_left(ids: Column, size: Column, value: int) -> Column:
    return F.concat(F.array_repeat(F.lit(value), (size - F.size(ids)).cast("int")), ids)


def zip_shorter(a: Column, b: Column) -> Column:
    """Pairs up to the shorter array, without those that have a null."""
    n = F.least(F.size(a), F.size(b))
    zipped = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.filter(zipped, lambda p: p["a"].isNotNull() & p["b"].isNotNull())


def evenly_spaced(total: int, target: int) -> Column:
    """``int(i * total / target)`` for each i."""
    return F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.floor(i * total / target))
