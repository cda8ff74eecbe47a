"""Substring dedup by hashing stretches of at least ``RUN_WORDS`` words between cuts that the words choose.

Words are the runs between ASCII white space, normalised: ASCII letters lowered, ASCII punctuation dropped.
Text without spaces is cut by characters: Han, kana and full-width characters always, any other word of
more than ``MOST_BYTES`` bytes too; such a piece weighs its bytes, of which ``WORD_BYTES`` are a word. A cut
lies where the hash of the two words beside it is the least in some ``WINDOW`` boundaries in a row, so it
depends on the words around it only and a passage is cut alike wherever it stands, its first and last
``WINDOW`` words aside. From each cut a stretch runs to the first cut at least ``RUN_WORDS`` words on, and
its digest is that of all its words. (Units of a few words do not do: each can be common while the text they
make is unique.) Digests are grouped over all documents; the document with the smallest doc_id (of those that share
one, the text of least hash) owns a digest and keeps its first occurrence. A stretch is a repeat if another document owns its digest or its own document
has it before, without overlap; all words in repeats are removed, and no others. A passage of ``RUN_WORDS`` +
3 * ``WINDOW`` - 1 = 50 words or more therefore always loses its repeats, but for up to ``WINDOW`` words at its
start and twice as many at its end, where these are not the text's. Runs are reported with their character offsets in the original text.

Among the two thousand million 64-bit digests of some 30 GB, two different ones agree with a probability of about a tenth.

A document sends each digest once, and the owner is a minimum combined before it is dealt out, so
neither a frequent line nor a repeated one within a long text gathers in a task. Texts are hashed again
only where something of theirs was found twice.

Null text stays null, empty text empty. Rows alike in doc_id and text are one occurrence: each keeps
what the other has. Rows with a null doc_id are compared only within themselves. Empty tables give no
rows. Extra columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import BLANKS, chunks, written

RUN_WORDS, WINDOW, MOST_BYTES, WORD_BYTES = 30, 7, 48, 6
#: In place of a digest: the document repeats something of its own.
OWN = 0
_GAP = re.compile(r"\s*")
_BLANK, _KEPT = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
_KEPT[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True
#: Bytes that start a character of a script without spaces: U+3000-U+9FFF, U+F000-U+FFFF and above.
_SPACELESS = np.zeros(256, bool)
_SPACELESS[[*range(0xE3, 0xEA), *range(0xEF, 0xF5)]] = True
_RANDOM = np.random.RandomState(8)
#: A number for each byte, upper and lower case alike; odd factors for places in a word, pairs and words in a stretch.
_BYTE = _RANDOM.randint(0, 1 << 63, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _RANDOM.randint(0, 1 << 63, MOST_BYTES + 1, np.uint64) | np.uint64(1)
_LEFT, _MIX, _BASE = (int(x) | 1 for x in _RANDOM.randint(0, 1 << 63, 3, np.uint64))
_BACK = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_LEFT)
    return x ^ (x >> np.uint64(32))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            line = np.full(2 * n, base, np.uint64)
            line[0] = 1
            _powers[i] = np.multiply.accumulate(line)
    return _powers[0][:n], _powers[1][:n]


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word starts in the bytes (with the punctuation before it), its hash and its weight in bytes."""
    blank = _BLANK[raw]
    at = np.flatnonzero(_KEPT[raw])
    if not len(at):
        return at, np.zeros(0, np.uint64), at
    kept = raw[at]
    token = np.cumsum(blank, dtype=np.int64)[at]
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(token[1:], token[:-1], out=new[1:])
    piece = None
    first = np.flatnonzero(new)
    sizes = np.diff(first, append=len(at))
    spaceless = _SPACELESS[kept]
    if spaceless.any() or sizes.max() > MOST_BYTES:
        starts = (kept & 0xC0) != 0x80
        starts[0] = True
        alone = spaceless[np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))]
        piece = alone | np.repeat(sizes > MOST_BYTES, sizes)
        new |= starts & (piece | np.concatenate(([False], piece[:-1])))
        first = np.flatnonzero(new)
        sizes = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, sizes)
    hashes = _mixed(np.add.reduceat(_BYTE[kept] * _PLACE[place], first))
    weights = np.full(len(first), WORD_BYTES, np.int64) if piece is None else np.where(piece[first], sizes, WORD_BYTES)
    gaps = np.flatnonzero(blank)
    before = np.searchsorted(gaps, at[first])
    after_gap = np.concatenate(([0], gaps + 1))[before]
    return np.maximum(after_gap, np.where(first > 0, at[first - 1] + 1, 0)), hashes, weights


def _cuts(hashes: np.ndarray) -> np.ndarray:
    """Word numbers of the cuts, with 0 and the number of words."""
    n = len(hashes)
    if n <= WINDOW:
        return np.array([0, n] if n else [0])
    pairs = _mixed(hashes[:-1] * np.uint64(_LEFT) + hashes[1:])
    k = len(pairs) - WINDOW + 1
    least = pairs[:k].copy()
    for i in range(1, WINDOW):
        np.minimum(least, pairs[i : i + k], out=least)
    most = np.zeros(len(pairs), np.uint64)
    for i in range(WINDOW):
        np.maximum(most[i : i + k], least, out=most[i : i + k])
    return np.concatenate(([0], np.flatnonzero(pairs <= most) + 1, [n]))


def _edges(raw: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a unit after each cut but the last starts and one before each cut but the first ends, in characters."""
    solid = np.flatnonzero(~_BLANK[raw])
    left = starts[cuts[:-1]]
    left[0] = solid[0]
    right = np.concatenate((solid[np.searchsorted(solid, left[1:]) - 1], solid[-1:])) + 1
    if len(raw) and raw.max() > 127:
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        left, right = chars[left], chars[right]
    return left, right


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) between neighbouring cuts; together with the white space between them they make the text."""
    raw = _raw(text)
    starts, hashes, _ = _words(raw)
    if not len(starts):
        solid = np.flatnonzero(~_BLANK[raw])
        return [(len(text) - len(text.lstrip(BLANKS)), len(text.rstrip(BLANKS)))] if len(solid) else []
    left, right = _edges(raw, starts, _cuts(hashes))
    return list(zip(left.tolist(), right.tolist(), strict=True))


def _stretches(raw: np.ndarray, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of words, cuts, first and last cut of each stretch, its digest and its words."""
    starts, hashes, weights = _words(raw)
    cuts = _cuts(hashes)
    total = np.concatenate(([0], np.cumsum(weights)))[cuts]
    if total[-1] < run_words * WORD_BYTES:
        none = np.zeros(0, np.int64)
        return starts, cuts, none, none, none, none
    to = np.searchsorted(total, total + run_words * WORD_BYTES)
    a = np.flatnonzero(to < len(cuts))
    b = to[a]
    if b[-1] < len(cuts) - 1:  # the text's end
        a, b = np.append(a, a[-1]), np.append(b, len(cuts) - 1)
    up, down = _powers_to(len(hashes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))[cuts]
    keys = _mixed((sums[b] - sums[a]) * down[cuts[a]] + (cuts[b] - cuts[a]).astype(np.uint64)).view(np.int64)
    return starts, cuts, a, b, np.where(keys == 0, 1, keys), (total[b] - total[a]) // WORD_BYTES


def keys_of(text: str, run_words: int = RUN_WORDS) -> np.ndarray:
    """The distinct digests of a text, and ``OWN`` if one occurs again without overlap."""
    _, _, a, b, keys, _ = _stretches(_raw(text), run_words)
    found, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return np.append(found, OWN) if len(found) < len(keys) and (a >= b[first][which]).any() else found


def digests(text: str, run_words: int = RUN_WORDS) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Stretches (they overlap), their words and their signed digests."""
    raw = _raw(text)
    starts, cuts, a, b, keys, counts = _stretches(raw, run_words)
    if not len(keys):
        return [], [], []
    left, right = _edges(raw, starts, cuts)
    return list(zip(left[a].tolist(), right[b - 1].tolist(), strict=True)), counts.tolist(), keys.tolist()


def removals(text: str, owned_elsewhere: set[int], run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """The spans to remove from a text, given the digests that other documents own."""
    raw = _raw(text)
    starts, cuts, a, b, keys, _ = _stretches(raw, run_words)
    if not len(keys):
        return []
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    repeat = a >= b[first][which]
    if owned_elsewhere:
        repeat |= np.isin(keys, np.fromiter(owned_elsewhere, np.int64, len(owned_elsewhere)))
    found = np.flatnonzero(repeat)
    if not len(found):
        return []
    left, right = _edges(raw, starts, cuts)
    out: list[tuple[int, int]] = []
    last = -1  # the cut up to which words are removed
    for i, j in zip(a[found].tolist(), b[found].tolist(), strict=True):
        if i <= last:
            out[-1] = (out[-1][0], int(right[j - 1]))
        else:
            out.append((int(left[i]), int(right[j - 1])))
        last = j
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans and without the white space that followed each."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = _GAP.match(text, b).end()
    return "".join([*out, text[at:]]) if spans else text


def rank_of(docs: DataFrame, text: str, doc_id: str) -> Column:
    """What puts documents in order: doc_id and, where any doc_id stands in several rows, the text's hash."""
    most = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().agg(F.max("count")).first()[0]
    return F.col(doc_id) if (most or 0) < 2 else F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))


def shared_digests(docs: DataFrame, rank: Column, text: str = "text", doc_id: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """_rank and ``_elsewhere``: the digests in the document that one of smaller rank owns, and ``OWN`` if it has repeats
    itself. Documents without either have no row."""
    df = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(rank.alias("_rank"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                own = [keys_of(t, run_words) for t in part.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(own)), [len(k) for k in own])
                yield pa.RecordBatch.from_arrays([part.column("_rank").take(pa.array(rows, pa.int64())), pa.array(np.concatenate(own))], names=["_rank", "digest"])

    sent = written(df.mapInArrow(run, f"_rank {df.schema['_rank'].dataType.simpleString()}, digest bigint"), "digests")
    owners = sent.where(F.col("digest") != OWN).groupBy("digest").agg(F.min("_rank").alias("owner"), F.max("_rank").alias("last")).where("owner < last").select("digest", "owner")
    told = sent.join(owners, "digest").where("owner < _rank").select("_rank", "digest").unionByName(sent.where(F.col("digest") == OWN).distinct())
    return told.groupBy("_rank").agg(F.collect_set("digest").alias("_elsewhere"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """The columns of ``docs`` with the repeats cut from its text, and ``removed`` (in place of an extra column of
    that name): the spans (start, end) that were cut, as characters of the original text."""
    rank = rank_of(docs, text, doc_id)
    marks = shared_digests(docs, rank, text, doc_id, run_words)
    clear = [c for c in docs.columns if c not in (text, "removed")]
    rows = docs.select(F.struct(*[docs[c] for c in clear]).alias("_row"), rank.alias("_id"), docs[doc_id].isNull().alias("_alone"), docs[text].alias("_text"))
    # A document without marks has nothing to lose; one without a doc_id wasn't looked at.
    own = F.when(F.col("_alone"), F.array(F.lit(OWN).cast("long")))
    joined = rows.join(marks, F.col("_id") == F.col("_rank"), "left").select("_row", "_text", F.coalesce("_elsewhere", own).alias("_elsewhere"))
    ddl = f"_row {joined.schema['_row'].dataType.simpleString()}, _text string, removed array<struct<start:bigint,end:bigint>>"
    removed_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text", 4 << 20):
                texts, spans = [], []
                for t, marked in zip(part.column("_text").to_pylist(), part.column("_elsewhere").to_pylist(), strict=True):
                    gone = removals(t, set(marked), run_words) if t and marked else []
                    texts.append(cut_out(t, gone) if t else t)
                    spans.append([{"start": a, "end": b} for a, b in gone])
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(texts, pa.string()), pa.array(spans, removed_type)], names=["_row", "_text", "removed"])

    done = joined.mapInArrow(run, ddl)
    kept = [F.col("_text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns if c != "removed"]
    return done.select(*kept, "removed")
