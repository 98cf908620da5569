"""Problem 5: sessions that tell almost the same.

MinHash with odd sketches. The words of a session's distinct events, in their order, give a set of
shingles of three words. K MinHash samples of the set make BANDS band keys of ROWS samples each, which
find candidates by an equi-join, and are folded into an odd sketch: a bitmap in which each (sample
number, sample) toggles one bit. The population count of the XOR of two sketches estimates the share
of samples in which the sets differ, most precisely at high similarity; candidates whose estimate lies
well below the threshold are dropped, all others are verified by the exact similarity of their sets.

Scale. Texts are shuffled once, by session. Sessions with equal sets are one class from then on, so
copies never meet in a band; pairs are made between classes and expanded by their members at the end,
as the required result lists them. A session with more events than BLOCK_EVENTS is cut into blocks of
consecutive events, counted and not judged by their index: blocks are read apart, shingles across their borders are made from the two words on
either side, its samples are the minima of its blocks' samples, and it is verified by joins on single
shingles instead of arrays, so that it is never gathered in one task.

Defined results: null and empty contents add nothing; events delivered again count once; of several
contents under one (session_id, event_id) the first by event index and content counts; sessions with
fewer than three words have no shingles and are in no pair; rows with a null session_id are left out;
null event indexes come first. Similarity is exact, up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.indexing import dense_index, running_sum
from sessionloom.plans.runtime import cut

SHINGLE = 3
THRESHOLD = 0.7
BANDS, ROWS = 28, 4
K = BANDS * ROWS
#: Bits of an odd sketch, and how far below the threshold an estimate may lie (over five deviations).
SKETCH_BITS = 512
SLACK = 0.22
#: Events of a session that are read in one group; longer sessions are cut into blocks.
BLOCK_EVENTS = 1024
#: Characters that weigh as much as BLOCK_EVENTS events.
BLOCK_CHARS = 4_000_000
#: Up to so many ids are broadcast (after they are counted); beyond, they are shuffled.
BROADCAST_IDS = 1_000_000
WORD_CACHE = 500_000

_WORD = re.compile(r"\w+")
_ASCII_WORD = re.compile(r"[0-9a-z_]+")
_MULT = np.random.default_rng(20240501).integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20240502).integers(0, 2**63, K, dtype=np.uint64)
_HASH: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Maximal runs of letters, digits and underscores after NFKC and case folding."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def _word_hash(word: str) -> int:
    known = _HASH.get(word)
    if known is None:
        if len(_HASH) > WORD_CACHE:
            _HASH.clear()
        known = _HASH[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return known


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(tokens: list[str]) -> np.ndarray:
    """Distinct 64-bit hashes of the sequences of three consecutive words, in ascending order."""
    get = _HASH.get
    h = np.array([get(w) or _word_hash(w) for w in tokens], np.uint64)
    if len(h) < SHINGLE:
        return np.zeros(0, np.uint64)
    out = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    return np.unique(_mix(out))


def samples(hashes: np.ndarray) -> np.ndarray:
    """K MinHash samples of a nonempty set."""
    best = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * _MULT + _ADD
        np.minimum(best, part.min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each band, which holds the band's number."""
    x = sig.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, i])
    return key


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """Parity bitmap of (sample number, sample), as 64-bit words."""
    place = _mix(sig + np.arange(K, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH_BITS)
    bits = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def most_differing_bits(threshold: float = THRESHOLD - SLACK) -> int:
    """Population count of the XOR that belongs to a similarity: sketches beyond it are dropped."""
    differing = 2 * K * (1 - threshold)
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)))


_SCHEMA = pa.schema(
    [
        ("session_id", pa.string()),
        ("block", pa.int64()),
        ("long", pa.bool_()),
        ("head", pa.list_(pa.string())),
        ("tail", pa.list_(pa.string())),
        ("n", pa.int32()),
        ("x", pa.int64()),
        ("shingles", pa.list_(pa.int64())),
        ("bands", pa.list_(pa.int64())),
        ("sketch", pa.list_(pa.int64())),
        ("sig", pa.list_(pa.int64())),
    ]
)
_DDL = (
    "session_id string, block bigint, long boolean, head array<string>, tail array<string>, n int, x bigint, "
    "shingles array<bigint>, bands array<bigint>, sketch array<bigint>, sig array<bigint>"
)


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _describe(groups: list[tuple[str, int, bool, list[str]]], sets: bool) -> pa.RecordBatch:
    """Rows for groups (session, block, long, words); sets: only the shingles, for the verification."""
    none = np.zeros(0, np.uint64)
    rows = []
    for session, block, is_long, tokens in groups:
        own = shingles(tokens)
        x = int(np.bitwise_xor.reduce(own).astype(np.int64)) if len(own) else 0
        sig = samples(own) if len(own) and not sets else none
        done = len(sig) and not is_long
        edge = (tokens[:2], tokens[-2:]) if is_long else (None, None)
        rows.append(
            (session, block, is_long, *edge, len(own), x, own if is_long or sets else none)
            + ((band_keys(sig), odd_sketch(sig), none) if done else (none, none, sig))
        )
    columns = list(zip(*rows)) if rows else [[] for _ in _SCHEMA]
    arrays = [pa.array(c, f.type) for c, f in zip(columns[:7], _SCHEMA)] + [_list(list(c)) for c in columns[7:]]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _kernel(batches: Iterator[pa.RecordBatch], sets: bool = False) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by (session, block, event index, event) and describes each group."""
    groups: list[tuple[str, int, bool, list[str]]] = []
    current, tokens, seen, is_long, size = None, [], set(), False, 0
    for batch in batches:
        for session, block, flag, event, content in zip(*(c.to_pylist() for c in batch.columns)):
            if (session, block) != current:
                if current and (len(tokens) >= SHINGLE or is_long and tokens):
                    groups.append((*current, is_long, tokens))
                    size += len(tokens)
                    if size > 200_000:
                        yield _describe(groups, sets)
                        groups, size = [], 0
                current, tokens, seen, is_long = (session, block), [], set(), flag
            if event not in seen:
                seen.add(event)
                tokens += words(content)
    if current and (len(tokens) >= SHINGLE or is_long and tokens):
        groups.append((*current, is_long, tokens))
    if groups:
        yield _describe(groups, sets)


def _boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that end in a block and begin before it, and their samples."""
    for batch in batches:
        ids, hashes, sigs = [], [], []
        for session, before, head in zip(*(c.to_pylist() for c in batch.columns)):
            own = shingles([*before[-2:], *head])
            if len(own):
                ids.append(session)
                hashes.append(own)
                sigs.append(samples(own))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), _list(hashes), _list(sigs)], names=["session_id", "shingles", "sig"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band keys and sketches of long sessions from their samples."""
    for batch in batches:
        sigs = [np.array(s, np.int64).view(np.uint64) for s in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], _list([band_keys(s) for s in sigs]), _list([odd_sketch(s) for s in sigs])],
            names=["session_id", "n", "x", "bands", "sketch"],
        )


def _few(ids: DataFrame) -> bool:
    """Whether a table of ids, which is written already, may be broadcast."""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def _described(rows: DataFrame, sets: bool = False) -> DataFrame:
    """One row for each (session, block), from rows ``session_id, block, long, at, event_id, content``."""
    return (
        rows.repartition("session_id", "block")
        .sortWithinPartitions("session_id", "block", "at", "event_id", "content")
        .select("session_id", "block", "long", "event_id", "content")
        .mapInArrow(lambda batches: _kernel(batches, sets), _DDL)
    )


def similar_sessions(events: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs ``session_id_a, session_id_b, similarity`` of different sessions at or above the threshold."""
    return _expand(*similar_classes(events, threshold))


def similar_classes(events: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs ``na, xa, nb, xb, similarity`` of classes of sessions with equal sets, and the members ``n, x, session_id``."""
    order = F.coalesce(F.col("event_index").cast("bigint"), F.lit(-1))
    rows = events.where("session_id is not null and content is not null and content != ''").select(
        "session_id", "event_id", order.alias("at"), "content"
    )
    # long sessions by the number and size of their rows, whatever their indexes say
    weight = F.lit(1) + F.length("content") / BLOCK_CHARS * BLOCK_EVENTS
    long_ids = cut(rows.groupBy("session_id").agg(F.sum(weight).alias("w")).where(F.col("w") > BLOCK_EVENTS).select("session_id"))
    flags = long_ids.withColumn("long", F.lit(True))
    marked = (
        rows.join(F.broadcast(flags) if _few(long_ids) else flags, "session_id", "left")
        .withColumn("long", F.coalesce("long", F.lit(False)))
        .withColumn("block", F.lit(0).cast("bigint"))
    )
    # blocks are cut by a running sum over all rows of long sessions, one row for each event; a block may begin with
    # the session before it, as blocks are told apart by session and number
    of_long = marked.where("long").groupBy("session_id", "event_id").agg(F.min(F.struct("at", "content")).alias("r")).select("session_id", "event_id", "r.*")
    placed = running_sum(of_long, ["session_id", "at", "event_id"], F.ceil(F.lit(1) + F.length("content") / BLOCK_CHARS * BLOCK_EVENTS), "_before")
    cut_long = placed.select("session_id", "event_id", "at", "content", F.lit(True).alias("long"), F.expr(f"_before div {BLOCK_EVENTS}").alias("block"))
    marked = marked.where("not long").unionByName(cut_long)
    parts = cut(_described(marked))
    long_rows, long_done = _long_sessions(parts.where("long"))
    short = parts.where("not long").select("session_id", "n", "x", "bands", "sketch", "long")
    described = short.unionByName(long_done.withColumn("long", F.lit(True)))
    likely = _candidates(described, threshold)
    verified = _verify(likely, marked.where("not long"), long_rows, threshold)
    return verified, described.select("n", "x", "session_id")


def _long_sessions(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single shingles ``session_id, h`` of the long sessions, and their sizes, band keys and sketches."""
    # the two blocks before each, by a dense number instead of a window over a session's blocks
    placed = cut(dense_index(parts.select("session_id", "block", "head", "tail"), ["session_id", "block"], "i"))
    back = lambda k: placed.select("session_id", (F.col("i") + k).alias("i"), F.col("tail").alias(f"tail{k}"))
    nothing = F.array().cast("array<string>")
    edges = (
        placed.join(back(1), ["session_id", "i"], "left").join(back(2), ["session_id", "i"], "left")
        .select("session_id", F.concat(F.coalesce("tail2", nothing), F.col("tail1")).alias("before"), "head")
    )
    borders = edges.where("before is not null").mapInArrow(
        _boundary, "session_id string, shingles array<bigint>, sig array<bigint>"
    )
    pieces = cut(parts.select("session_id", "shingles", "sig").unionByName(borders))
    rows = pieces.select("session_id", F.explode("shingles").alias("h")).distinct()
    sizes = rows.groupBy("session_id").agg(F.count("*").cast("int").alias("n"), F.expr("bit_xor(h)").alias("x"))
    # samples are unsigned: their order is that of the signed numbers with the first bit flipped
    flip = F.lit(-(2**63))
    minima = (
        pieces.select("session_id", F.posexplode("sig").alias("i", "s"))
        .groupBy("session_id", "i")
        .agg(F.min(F.col("s").bitwiseXOR(flip)).bitwiseXOR(flip).alias("s"))
        .groupBy("session_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda r: r["s"]).alias("sig"))
    )
    done = sizes.join(minima, "session_id").select("session_id", "n", "x", "sig")
    return rows, cut(
        done.mapInArrow(_finish, "session_id string, n int, x bigint, bands array<bigint>, sketch array<bigint>")
    )


def _candidates(described: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes that share a band and whose sketches are close; a class is named by (n, x)."""
    classes = described.groupBy("n", "x").agg(
        F.min_by(F.struct("bands", "sketch"), "session_id").alias("d"),
        F.min("session_id").alias("session_id"),
        F.max("long").alias("long"),
    )
    banded = classes.select("n", "x", F.explode("d.bands").alias("key"))
    a, b = banded.alias("a"), banded.alias("b")
    close = (F.col("a.n") >= F.col("b.n") * threshold) & (F.col("b.n") >= F.col("a.n") * threshold)
    first = F.struct("a.n", "a.x") < F.struct("b.n", "b.x")
    met = cut(
        a.join(b, (F.col("a.key") == F.col("b.key")) & first & close)
        .select(F.col("a.n").alias("na"), F.col("a.x").alias("xa"), F.col("b.n").alias("nb"), F.col("b.x").alias("xb"))
        .distinct()
    )
    facts = classes.select("n", "x", "session_id", "long", F.col("d.sketch").alias("sketch"))
    side = lambda s: facts.select(*[F.col(c).alias(f"{c}{s}") for c in ("n", "x", "session_id", "long", "sketch")])
    differing = F.aggregate(
        F.zip_with("sketcha", "sketchb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v
    )
    return cut(
        met.join(side("a"), ["na", "xa"])
        .join(side("b"), ["nb", "xb"])
        .where(differing <= most_differing_bits(threshold - SLACK))
        .select("na", "xa", "session_ida", "longa", "nb", "xb", "session_idb", "longb")
    )


def _verify(likely: DataFrame, short_rows: DataFrame, long_rows: DataFrame, threshold: float) -> DataFrame:
    """Exact similarity: arrays meet for short sessions, single shingles where a long one takes part.

    Only the candidates' texts are read again and shuffled.
    """
    ids = cut(likely.select(F.explode(F.array("session_ida", "session_idb")).alias("session_id")).distinct())
    again = short_rows.join(F.broadcast(ids) if _few(ids) else ids, "session_id", "left_semi")
    sets = cut(_described(again, sets=True).select("session_id", "shingles"))
    left = sets.select(F.col("session_id").alias("session_ida"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("session_id").alias("session_idb"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    columns = ["na", "xa", "nb", "xb", "common"]
    by_array = likely.where("not longa and not longb")
    short = by_array.join(left, "session_ida").join(right, "session_idb").withColumn("common", common).select(columns)

    by_row = cut(likely.where("longa or longb"))
    pairs = short
    if not by_row.isEmpty():
        asked = by_row.select(F.explode(F.array("session_ida", "session_idb")).alias("session_id")).distinct()
        rows = long_rows.unionByName(
            sets.join(asked, "session_id", "left_semi").select("session_id", F.explode("shingles").alias("h"))
        )
        one = by_row.join(rows.withColumnRenamed("session_id", "session_ida"), "session_ida")
        met = one.join(rows.withColumnRenamed("session_id", "session_idb"), ["session_idb", "h"])
        counted = met.groupBy("na", "xa", "nb", "xb").agg(F.count("*").cast("int").alias("common"))
        pairs = short.unionByName(counted.select(columns))
    similarity = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return pairs.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)


def _expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of sessions from pairs of classes and the members of each class."""
    copied = members.groupBy("n", "x").count().where("count > 1").select("n", "x")
    own = members.join(copied, ["n", "x"], "left_semi")
    within = (
        own.withColumnRenamed("session_id", "p")
        .join(own.withColumnRenamed("session_id", "q"), ["n", "x"])
        .where("p < q")
        .select("p", "q", F.lit(1.0).alias("similarity"))
    )
    a = members.select(F.col("n").alias("na"), F.col("x").alias("xa"), F.col("session_id").alias("p"))
    b = members.select(F.col("n").alias("nb"), F.col("x").alias("xb"), F.col("session_id").alias("q"))
    across = pairs.join(a, ["na", "xa"]).join(b, ["nb", "xb"]).select("p", "q", "similarity")
    both = within.unionByName(across)
    return both.select(
        F.least("p", "q").alias("session_id_a"), F.greatest("p", "q").alias("session_id_b"), "similarity"
    )


def similar_groups(events: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Groups of similar sessions as ``session_id, group_id, links``; group_id is the smallest member.

    ``links`` is the number of sessions at or above the threshold. The groups are those of the classes; copies are
    counted and joined as members at the end, never made into pairs.
    """
    pairs, members = similar_classes(events, threshold)
    classes = members.groupBy("n", "x").agg(F.count("*").alias("size"), F.min("session_id").alias("name"))
    side = lambda s: classes.select(F.col("n").alias(f"n{s}"), F.col("x").alias(f"x{s}"), F.col("size").alias(f"size{s}"), F.col("name").alias(f"session_id_{s}"))
    named = cut(pairs.join(side("a"), ["na", "xa"]).join(side("b"), ["nb", "xb"]).select("session_id_a", "session_id_b", "sizea", "sizeb"))
    met = named.select(F.col("session_id_a").alias("name"), F.col("sizeb").alias("k")).unionByName(named.select(F.col("session_id_b").alias("name"), F.col("sizea").alias("k")))
    others = met.groupBy("name").agg(F.sum("k").alias("k"))
    found = groups(named).select(F.col("session_id").alias("name"), "group_id")
    # a group is named by its smallest member, which is the smallest of the classes' smallest ones
    linked = classes.join(others, "name", "left").join(found, "name", "left")
    own = linked.select("n", "x", F.coalesce("group_id", "name").alias("group_id"), (F.col("size") - 1 + F.coalesce("k", F.lit(0))).alias("links")).where("links > 0")
    return members.join(own, ["n", "x"]).select("session_id", "group_id", "links")


def groups(pairs: DataFrame) -> DataFrame:
    """Connected groups of sessions as ``session_id, group_id, links``; group_id is the smallest member.

    Alternates the large-star and the small-star step, which halve the height of the forest each time, until
    nothing changes; every round is cut by a reliable checkpoint and nothing but a count reaches the driver.
    """
    edges = cut(pairs.select(F.col("session_id_a").alias("u"), F.col("session_id_b").alias("v")))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = both.groupBy("u").agg(F.count("*").alias("links"))
    stars = edges
    while True:
        around = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u != v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("m", F.explode(F.array("u", "v")).alias("v")).where("m != v")
        new = cut(small.select(F.col("m").alias("u"), "v").distinct())
        same = new.count() == stars.count() and new.exceptAll(stars).isEmpty()
        stars = new
        if same:
            break
    centre = stars.select(F.col("v").alias("u"), F.col("u").alias("group_id"))
    return links.join(centre, "u", "left").select(
        F.col("u").alias("session_id"), F.coalesce("group_id", "u").alias("group_id"), "links"
    )
