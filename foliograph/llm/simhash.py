"""SimHash near-duplicates by tiled exact comparison.

A text's words (A-Z lowered) give shingles of ``SHINGLE`` words, repeats included; a bit of the
fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42). Fingerprints link at
``RADIUS`` or fewer differing bits.

Each distinct fingerprint is compared once. Of any number of parts of a fingerprint, linked ones share
all but ``RADIUS`` at least: fingerprints that agree on such a set of parts form a block, and no link
crosses all blocks. More parts mean smaller blocks and more of them, so their number follows from that
of the distinct fingerprints (see ``parts_for``; the links are the same for any). A block is sorted by
population count and cut into tiles of ``TILE``. Two tiles are compared by exclusive-or and bit counts, all rows against all,
unless their population counts differ beyond the radius. A block of one tile is compared where it is
sorted; the tiles of a larger block become rows of a written table, and their pairs are dealt to all
tasks. From a tile pair only a spanning forest of its links goes on, so a group of any size yields no
more links than members. Components are found over those (see ``components``).

Null, empty and blank texts have fingerprint 0, linked like any other; rows with a null doc_id link
like any other too, but name no component (one of such rows only has a null component). Repeated rows
share a fingerprint. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import chunks, utf8, written
from foliograph.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
TILE = 4096
#: What sending and sorting a row costs, in comparisons.
ROW_COST = 2000
_BITS = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=len(words) - shingle + 1)
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _BITS):
        ones += np.unpackbits(hashes[at : at + _BITS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * ones > n).astype(object)).sum()) if (2 * ones > n).any() else 0


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, hash (``text_hash``) and fp (the fingerprint as a signed long) of every document."""
    df = docs.select(F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 8 << 20):
                fps = np.array([fingerprint(t, shingle) for t in utf8(part.column("text"))], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array(fps.view(np.int64))], names=["doc_id", "hash", "fp"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, hash bigint, fp bigint")


def parts_for(distinct: int, radius: int = RADIUS) -> int:
    """The number of parts of least cost for so many fingerprints: rows to send, and pairs to compare if the parts' bits
    were evenly spread."""
    cost = lambda p: math.comb(p, radius) * (ROW_COST + distinct / 2 ** (64 * (p - radius) / p + 1))
    return min(range(radius + 1, 2 * radius + 3), key=cost)


def block_keys(fp: Column, parts: int, radius: int = RADIUS) -> Column:
    """One key for each choice of the parts that linked fingerprints may share: the masked bits, told
    apart by the number of the choice."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    keys = []
    for chosen in combinations(range(parts), parts - radius):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
        keys.append(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return F.posexplode(F.array(*keys)).alias("choice", "key")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of a spanning forest of the links within ``a`` and ``b`` together; a row of ``b``
    is numbered from len(a). ``b`` may be ``a`` itself. Only links between the two are looked for."""
    same = b is a
    base = 0 if same else len(a)
    label = np.arange(base + len(b))
    step = max(1, (1 << 18) // max(1, len(b)))
    pairs_a, pairs_b = [], []
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + base
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        # Keep the links that still join two trees, one for each tree and round.
        while True:
            x, y = _root(label, i), _root(label, j)
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            high, low = np.maximum(x, y), np.minimum(x, y)
            _, first = np.unique(high, return_index=True)
            label[high[first]] = low[first]
            pairs_a.append(i[first])
            pairs_b.append(j[first])
    if not pairs_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(pairs_a), np.concatenate(pairs_b)


def _root(label: np.ndarray, i: np.ndarray) -> np.ndarray:
    x = label[i]
    while not np.array_equal(y := label[x], x):
        x = y
    label[i] = x
    return x


def _blocks(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[tuple[int, int, np.ndarray, bool]]:
    """(choice, key, fps, last) for each block of rows that come sorted by choice, key and population
    count; a block larger than ``tile`` comes in several tiles, of which the final one is marked last."""
    held: list[tuple[np.ndarray, ...]] = []

    def tiles(c, k, f, more):
        while len(f) > tile:
            yield c, k, f[:tile], False
            f = f[tile:]
        if not more:
            yield c, k, f, True
        else:
            held.append((np.full(len(f), c), np.full(len(f), k), f))

    for batch in batches:
        own = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("choice", "key", "fp"))
        if not len(own[0]):
            continue
        if going_on := bool(held):
            own = tuple(np.concatenate(x) for x in zip(*held, own, strict=True))
            held.clear()
        c, k, f = own
        edge = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1
        starts = np.concatenate([[0], edge])
        ends = np.concatenate([edge, [len(c)]])
        # Single rows have no partner, unless tiles of their block went before; the last block may go on.
        worth = (ends - starts) > 1
        worth[0] |= going_on
        worth[-1] = False
        for s, e in zip(starts[worth], ends[worth], strict=True):
            yield from tiles(c[s], k[s], f[s:e], False)
        s = starts[-1]
        yield from tiles(c[s], k[s], f[s:], True)
    for c, k, f in held:
        if len(f):
            yield c[0], k[0], f, True


_TILE_ROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("choice", pa.int32()), ("key", pa.int64()), ("tile", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("fps", pa.binary())])
_TILE_DDL = "a bigint, b bigint, choice int, key bigint, tile int, low int, high int, fps binary"


def _compare_blocks(batches: Iterator[pa.RecordBatch], tile: int = TILE) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the blocks of one tile; the tiles of larger blocks as they are."""
    links_a: list[np.ndarray] = []
    links_b: list[np.ndarray] = []
    now: tuple | None = None
    number = 0

    def out() -> pa.RecordBatch:
        a, b = np.concatenate(links_a), np.concatenate(links_b)
        links_a.clear()
        links_b.clear()
        empty = [pa.nulls(len(a), f.type) for f in _TILE_ROW][2:]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], schema=_TILE_ROW)

    for c, k, f, last in _blocks(batches, tile):
        number = number + 1 if now == (c, k) else 0
        now = (c, k)
        fps = f.view(np.uint64)
        if last and number == 0:
            i, j = forest(fps, fps, RADIUS)
            if len(i):
                links_a.append(f[i])
                links_b.append(f[j])
                if len(links_a) > 2000:
                    yield out()
        elif len(f):
            counts = np.bitwise_count(fps)
            yield pa.RecordBatch.from_pylist([{"choice": int(c), "key": int(k), "tile": number, "low": int(counts.min()), "high": int(counts.max()), "fps": fps.tobytes()}], schema=_TILE_ROW)
    if links_a:
        yield out()


def _compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["fps"], np.uint64)
            y = x if r["other"] is None else np.frombuffer(r["other"], np.uint64)
            i, j = forest(x, y, RADIUS)
            ends = x[i], y[j if y is x else j - len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in ends], names=["a", "b"])


def links(distinct: DataFrame, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """A spanning set of the links (a, b) between distinct fingerprints (fp)."""
    keyed = distinct.select("fp", block_keys(F.col("fp"), parts or parts_for(distinct.count())))
    spread = keyed.repartition("choice", "key").sortWithinPartitions("choice", "key", F.bit_count("fp"), "fp")
    found = written(spread.select("choice", "key", "fp").mapInArrow(partial(_compare_blocks, tile=tile), _TILE_DDL), "simhash-blocks")
    tiles = found.where("fps is not null")
    other = tiles.select("choice", "key", F.col("tile").alias("t2"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.col("fps").alias("other"))
    near = (F.col("tile") < F.col("t2")) & (F.col("l2") - F.col("high") <= RADIUS) & (F.col("low") - F.col("h2") <= RADIUS)
    pairs = tiles.join(other, ["choice", "key"]).where(near).select("fps", "other")
    alone = tiles.select("fps", F.lit(None).cast("binary").alias("other"))
    within = pairs.unionByName(alone).repartition(F.xxhash64("fps", "other")).mapInArrow(_compare_tiles, "a bigint, b bigint")
    return found.where("a is not null").select("a", "b").unionByName(within)


def _grouped(docs: DataFrame, text: str, doc_id: str, tile: int) -> DataFrame:
    """doc_id, its text's hash, fp, component (its smallest fingerprint) and component_id of every row."""
    fps = written(fingerprints(docs, text, doc_id), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    joined = components(links(distinct.select("fp"), tile), "a", "b", name="simhash")
    placed = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    named = placed.join(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("fp", "component", "component_id")
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _grouped(docs, text, doc_id, tile).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each group: that of the smallest doc_id, of several with this doc_id the text of least hash.
    Rows are told apart by doc_id and text, so one that shares its doc_id with another text is judged for itself, and of
    rows alike in both one stays. Rows without a doc_id stay."""
    found = written(_grouped(docs, text, doc_id, TILE).where("doc_id is not null").select("doc_id", "hash", "component", "component_id"), "groups")
    first = found.where("doc_id = component_id").groupBy("component").agg(F.first("doc_id").alias("doc_id"), F.min("hash").alias("hash"), F.count("*").alias("_n"))
    gone = found.join(first, ["component", "doc_id", "hash"], "left_anti").select(F.col("doc_id").alias("_simhash_id"), F.col("hash").alias("_simhash_hash")).distinct()
    kept = docs.join(gone, (docs[doc_id] == F.col("_simhash_id")) & (text_hash(docs[text]) == F.col("_simhash_hash")), "left_anti")
    # Repeated rows are few or none: only their ids are looked for again.
    twice = first.where("_n > 1").select(F.col("doc_id").alias("_simhash_twice")).distinct()
    if twice.isEmpty():
        return kept
    again = kept.join(twice, F.col(doc_id) == F.col("_simhash_twice"), "left_semi").withColumn("_simhash_text", text_hash(F.col(text)))
    return kept.join(twice, F.col(doc_id) == F.col("_simhash_twice"), "left_anti").unionByName(again.dropDuplicates([doc_id, "_simhash_text"]).drop("_simhash_text"))
