"""Media columns: payloads as progressive JPEG files, and files as full-resolution RGB tensors.

``store`` turns a text column into files, ``tensors`` any column of progressive JPEG files into RGB
rows; ``digests`` does both for each text and reports on the bytes read back. A payload is the text in
UTF-8 with zero bytes up to a positive multiple of 64, a byte a luma sample, 64 samples a row; payloads of
more than 65,528 rows take several images, one behind the other. Rows are worked in groups of about
a megabyte of payload, so memory follows the longest single text, not the batch.

Null and empty texts are 64 zero bytes. Repeated rows give equal files. A file that isn't a progressive
image fails its task with the marker named; null files give a null tensor. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliograph.llm import progressive_jpeg as jpeg
from foliograph.llm.common import chunks, utf8

UNIT, GROUP = 64, 1 << 20


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def to_files(payloads: list[bytes]) -> list[bytes]:
    most = jpeg.MOST_ROWS * jpeg.WIDTH
    parts = [p[i : i + most] for p in payloads for i in range(0, len(p), most)]
    images = iter(jpeg.encode(parts))
    return [b"".join(next(images) for _ in range(0, len(p), most)) for p in payloads]


def from_files(files: list[bytes]) -> list[np.ndarray]:
    """One tensor for each file, its images below one another."""
    return [own[0] if len(own) == 1 else np.concatenate(own) for own in jpeg.decode(files)]


def feature(tensor: np.ndarray) -> str:
    """Size, mean, variance, mean horizontal step and used levels, from exact sums over the first channel."""
    y = tensor[:, :, 0]
    n = y.size
    levels = np.bincount(y.ravel(), minlength=256)
    value = np.arange(256)
    first, second = int((levels * value).sum()), int((levels * value * value).sum())
    steps = int(np.abs(np.diff(y.astype(np.int16), axis=1)).sum())
    return f"{tensor.shape[0]}x{tensor.shape[1]}x{tensor.shape[2]} mean={first / n:.4f} var={second / n - (first / n) ** 2:.4f} step={steps / n:.4f} levels={int((levels > 0).sum())}"


def store(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and media (the file) of every text."""
    df = docs.select(doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, GROUP):
                files = to_files([payload(t) for t in utf8(part.column(text))])
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(files, pa.binary())], names=[doc_id, "media"])

    return df.mapInArrow(run, f"{doc_id} {df.schema[doc_id].dataType.simpleString()}, media binary")


def tensors(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key, height, width and rgb (height * width * 3 bytes, row by row) of every file."""
    df = files.select(key, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, media, GROUP):
                held = part.column(media).to_pylist()
                found = iter(from_files([f for f in held if f is not None]))
                rgb = [None if f is None else next(found) for f in held]
                columns = [pa.array([None if t is None else t.shape[i] for t in rgb], pa.int32()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns, pa.array([None if t is None else t.tobytes() for t in rgb], pa.binary())], names=[key, "height", "width", "rgb"])

    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, height int, width int, rgb binary")


_FIELDS = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def digest(text: bytes, file: bytes, tensor: np.ndarray) -> tuple:
    """The digest columns of one text from its file and the tensor that was read from it."""
    back = tensor[:, :, 0].tobytes()
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(tensor)


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stores each text, reads its file back and digests what came back: see ``digest``."""
    df = docs.select(doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, GROUP):
                texts = utf8(part.column(text))
                files = to_files([payload(t) for t in texts])
                rows = [digest(*x) for x in zip(texts, files, from_files(files), strict=True)]
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(doc_id), *columns], names=[doc_id, *[n for n, _ in _FIELDS]])

    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    return df.mapInArrow(run, f"{doc_id} {df.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"{n} {kinds[t]}" for n, t in _FIELDS))
