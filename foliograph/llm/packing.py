"""Harmonic packing of tokenized documents into sequences.

A document's ids (its text by ``byte_bpe_50k``, then the separator) are cut into whole sequences of
``capacity`` ids, then into the descending powers of two of what is left down to ``capacity / 16``,
and a tail below that. A piece of length n is of reciprocal class ``capacity // n``, and a bin of
class k takes exactly k pieces: bins of the powers of two are full to the last id, and a bin of a
tail's class is over 15/16 full. Each task packs its own partition and holds no more than one open
bin a class; bins still open at its end are dealt by first fit, so a task pads a few sequences.
No row is shuffled, and a lost task is packed again from the same rows to the same sequences.

Null text counts as empty: one piece that holds the separator. Repeated rows and ids are packed
each for itself. An empty table gives no piece. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliograph.llm.common import chunks

CAPACITY, SEPARATOR = 1024, 0
#: Text without these is cut into words alike by both libraries; other text goes to ``tokenizers``.
_UNUSUAL = re.compile("[^\n\x20-\x7e¡-¬®-ſ]|<\\|endoftext\\|>")
_LONGEST_WORD = 400
_encoders: dict[str, ByteBpe] = {}


class ByteBpe:
    """Ids as ``tokenizers`` gives them with add_special_tokens=False. Plain text takes the faster
    ``tiktoken`` with the ranks of the same file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        as_byte = _byte_letters()
        ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if _UNUSUAL.search(text) or max(map(len, text.split()), default=0) > _LONGEST_WORD:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.plain.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for U+0100 onward in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    left, size = n % capacity, capacity // 2
    while size >= capacity // 16:
        if left & size:
            out.append(size)
            left -= size
        size //= 2
    return out + [left] * (left > 0)


class Packer:
    """Sequences of one task. A piece is any tuple that starts with its length."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.next, self.capacity = first_id, capacity
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield (*p, self.next, at)
            at += p[0]
        self.next += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Takes a piece; gives the pieces of the bin that it fills, each with sequence and offset."""
        k = self.capacity // piece[0]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            del self.open[k]
            yield from self._close(bin_)

    def finish(self) -> Iterator[tuple]:
        """First fit, longest first, for what is left: fewer pieces than one bin a class."""
        bins: list[tuple[int, list[tuple]]] = []
        for p in sorted((p for b in self.open.values() for p in b), key=lambda p: -p[0]):
            for i, (room, held) in enumerate(bins):
                if p[0] <= room:
                    bins[i] = (room - p[0], [*held, p])
                    break
            else:
                bins.append((self.capacity - p[0], [p]))
        self.open = {}
        for _, held in bins:
            yield from self._close(held)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if
    asked for, its ids. ``tokenizer`` is the vocabulary file's path, present on every executor."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    fields += [("sequence_id", pa.int64()), ("offset", pa.int64())]
    names = ["length", *[n for n, _ in fields if n not in ("length", "sequence_id", "offset")], "sequence_id", "offset"]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 36, capacity)

        def rows(done: list[tuple]) -> pa.RecordBatch:
            columns = dict(zip(names, zip(*done, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in fields], schema=schema)

        done: list[tuple] = []
        for batch in batches:
            for part in chunks(batch, text, 8 << 20):
                for key, words in zip(part.column(doc_id).to_pylist(), part.column(text).to_pylist(), strict=True):
                    ids = np.append(bpe.encode(words or ""), np.uint32(SEPARATOR)).astype("<u4")
                    start = 0
                    for n in cuts(len(ids), capacity):
                        own = ids[start : start + n]
                        done += packer.add((n, key, start, zlib.crc32(own.tobytes()), len(ids), *([own.astype(np.int32)] * with_ids)))
                        start += n
                    if len(done) > 20_000:
                        yield rows(done)
                        done = []
        done += packer.finish()
        if done:
            yield rows(done)

    ddl = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'bigint'}" for n, _ in fields)
    return docs.select(doc_id, text).mapInArrow(run, ddl)
