"""Problem 7: passages of evaluation items inside corpus texts.

Size-partitioned MinHash containment search. An item is the set of its shingles of SHINGLE consecutive words, of its
passage and of its query. A leak is a window of twelve words, so a text that leaks an item has at least ``needed``
of its shingles (twelve words hold eight, fewer only where words repeat). Items are put into partitions by their
number of shingles, each as wide as eight; the items of a partition are sketched with the same number of MinHash
samples, k = bound - needed + 1 smallest hashes, bound being the partition's largest size: fewer
than ``needed`` shingles are then no samples, so that every leaked window has one and is found, while an item of
twelve words needs a single sample. A text is streamed against the samples; candidates are verified by exact containment: the
words of the windows themselves, not hashes, are looked up in the item.

Items are a stated query set that is held against all rows, in blocks of at most BLOCK_WINDOWS windows (more only
where a single item has more): the bound of what is sent to the executors. No shuffle of texts.

Defined results: null and empty texts, and items whose texts have fewer than twelve words, never match;
a null item_id is left out; an item or a document that is repeated counts once; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans.runtime import arrow_map

WINDOW = 12
SHINGLE = 5
#: Windows of items that are held against the corpus at once.
BLOCK_WINDOWS = 500_000

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[0-9a-z]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFKC and case folding."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of word numbers; 0 in a window marks a word that no item has."""
    x = ids.astype(np.uint64)
    out = np.zeros(len(x) - width + 1, np.uint64)
    for i in range(width):
        out = out * _BASE + x[i : len(x) - width + 1 + i]
    return out ^ (out >> np.uint64(31))


class ContainmentIndex:
    """MinHash samples of one block of items by size partition, and the windows behind them."""

    def __init__(self, items: list[tuple[str, list[str | None]]], width: int = WINDOW):
        self.width, self.shingle, self.number = width, min(SHINGLE, width), {}
        span = width - self.shingle + 1
        #: Items of each window, and the number of windows of each item.
        self.items_of: dict[tuple[int, ...], list[str]] = {}
        self.sizes: dict[str, int] = {}
        partitions: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, texts in items:
            own: dict[tuple[int, ...], None] = {}
            hashes: list[np.ndarray] = []
            needed = span
            for text in texts:
                ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text or "")]
                if len(ids) < width:
                    continue
                own.update((tuple(ids[i : i + width]), None) for i in range(len(ids) - width + 1))
                h = window_hashes(np.array(ids, np.int64), self.shingle)
                hashes.append(h)
                needed = min(needed, *(len(set(h[i : i + span].tolist())) for i in range(len(h) - span + 1)))
            self.sizes[item] = len(own)
            for w in own:
                self.items_of.setdefault(w, []).append(item)
            if hashes:
                every = np.unique(np.concatenate(hashes))
                partitions.setdefault(-(-len(every) // span), []).append((every, needed))
        #: Sorted samples of each partition, by the bound of its items' sizes.
        self.samples: dict[int, np.ndarray] = {}
        self.shingles = 0
        for part, members in sorted(partitions.items()):
            bound = part * span
            self.samples[bound] = np.unique(np.concatenate([every[: bound - needed + 1] for every, needed in members]))
            self.shingles += sum(len(every) for every, _ in members)
        self.any = np.unique(np.concatenate(list(self.samples.values()))) if self.samples else np.zeros(0, np.uint64)

    def search(self, texts: list[str | None]) -> list[tuple[int, str, int]]:
        """(number of the text, item, distinct windows of the item that the text has)."""
        width, get = self.width, self.number.get
        ids: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(ids))
            if text:
                ids += [get(w, 0) for w in words(text)]
            ids.append(0)
        array = np.array(ids, np.int64)
        if len(array) < width or not len(self.any):
            return []
        # windows without a word that no item has, and shingles within such windows
        zeros = np.concatenate([[0], np.cumsum(array == 0)])
        whole = np.flatnonzero(zeros[width:] == zeros[:-width])
        if not len(whole):
            return []
        inside = np.zeros(len(array) + 1, np.int64)
        np.add.at(inside, whole, 1)
        np.add.at(inside, whole + width - self.shingle + 1, -1)
        at = np.flatnonzero(np.cumsum(inside)[: len(array) - self.shingle + 1])
        hashes = window_hashes(array, self.shingle)[at]
        place = np.minimum(np.searchsorted(self.any, hashes), len(self.any) - 1)
        sampled = np.zeros(len(array) + 1, np.int64)
        sampled[at[self.any[place] == hashes]] = 1
        # a window is a candidate where one of its shingles is a sample
        before = np.concatenate([[0], np.cumsum(sampled)])
        likely = whole[before[whole + width - self.shingle + 1] > before[whole]]
        found: dict[tuple[int, str], set] = {}
        rows = np.searchsorted(np.array(starts), likely, side="right") - 1
        for row, p in zip(rows.tolist(), likely.tolist()):
            window = tuple(ids[p : p + width])
            for item in self.items_of.get(window, ()):
                found.setdefault((row, item), set()).add(window)
        return [(row, item, len(own)) for (row, item), own in found.items()]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_texts: tuple[str, ...] = ("passage", "user_query"),
    width: int = WINDOW,
) -> DataFrame:
    """Documents that contain a window of an item, as ``id_col, item_col, windows, containment``.

    ``windows`` is the number of distinct windows of the item in the document, ``containment`` its share
    of the item's windows.
    """
    stated = items.select(item_col, *item_texts).where(F.col(item_col).isNotNull()).distinct()
    merged: dict[str, list[str | None]] = {}
    blocks: list[list[tuple[str, list[str | None]]]] = [[]]
    for row in stated.toLocalIterator():  # the stated query set, not the corpus
        merged.setdefault(row[0], []).extend(row[1:])
    size = 0
    for item, texts in sorted(merged.items()):
        n = sum(max(0, len(words(t or "")) - width + 1) for t in texts)
        if size + n > BLOCK_WINDOWS and blocks[-1]:
            blocks.append([])
            size = 0
        size += n
        blocks[-1].append((item, texts))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{item_col}` string, windows int, containment double"
    narrow = docs.select(id_col, text_col)

    def search(block: list[tuple[str, list[str | None]]]) -> DataFrame:
        index = docs.sparkSession.sparkContext.broadcast(ContainmentIndex(block, width))

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            model = index.value
            hits = model.search(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r for r, _, _ in hits], pa.int64())),
                    pa.array([i for _, i, _ in hits], pa.string()),
                    pa.array([n for _, _, n in hits], pa.int32()),
                    pa.array([n / model.sizes[i] for _, i, n in hits], pa.float64()),
                ],
                names=[id_col, item_col, "windows", "containment"],
            )

        return arrow_map(narrow, kernel, schema)

    found = reduce(DataFrame.unionByName, [search(b) for b in blocks])
    return found.groupBy(id_col, item_col).agg(F.max("windows").alias("windows"), F.max("containment").alias("containment"))
