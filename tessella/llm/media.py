"""Media columns: payloads stored as lossless WebP images and read back to pixel arrays with features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import webp

#: Bytes a row of pixels, and an image; a longer payload is several images, one file after another.
ROW = 64
IMAGE = ROW * webp.MOST_SIDE
#: Bytes of media and pixels that a task gathers before it hands them on.
HANDED = 8_000_000


def to_media(payload: bytes, image: int = IMAGE) -> bytes:
    """A payload of a positive multiple of 64 bytes as lossless WebP files of rows of 64 samples, one for each ``image`` bytes."""
    parts = (np.frombuffer(payload[at : at + image], np.uint8).reshape(-1, ROW) for at in range(0, len(payload), image))
    return b"".join(webp.encode_gray(x) for x in parts)


def from_media(data: bytes) -> np.ndarray:
    """The samples of WebP files, as rows of 64."""
    return np.concatenate([webp.samples_of(webp.decode_webp(x)) for x in webp.files(data)])


def features(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, their share of edges, and 64 bits of a coarse picture."""
    flat = samples.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    share = counts[counts > 0] / len(flat)
    mean = float((counts * np.arange(256)).sum() / len(flat))
    spread = float(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / len(flat)))
    edges = float((np.abs(np.diff(samples.astype(np.int16), axis=1)) > 32).mean())
    cuts = np.linspace(0, len(flat), 65).astype(np.int64)[:-1]
    sums = np.add.reduceat(flat.astype(np.int64), cuts) / np.diff(np.append(cuts, len(flat)))
    coarse = np.packbits(sums > mean).tobytes().hex()
    return f"mean={mean:.6f};sd={spread:.6f};entropy={float(-(share * np.log2(share)).sum()):.6f};edges={edges:.6f};hash={coarse}"


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples; ``size`` is the place of the bytes that bound a batch."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += len(row[size] or b"") + 200
        if total > HANDED:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def write_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A media column: ``doc_id``, ``n_bytes`` (of the UTF-8 text), ``payload_bytes`` and ``media``, a lossless WebP file.

    The payload is the text's bytes and zeros up to a positive multiple of 64; null counts as empty. Payloads beyond 1 MiB
    are several files, one after another, so texts of any length fit. Equal texts give equal media. Rows stay as they
    are, repeated ones too; null keys stay null; nothing is shuffled. An empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                payload = raw + b"\0" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))
                yield k, len(raw), len(payload), to_media(payload)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), schema, 3)

    names = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return names.mapInArrow(write, "doc_id long, n_bytes long, payload_bytes long, media binary")


def read_media(media: DataFrame, pixels: bool = True) -> DataFrame:
    """Decode the ``media`` column: adds ``pixels`` (the payload as read back, where asked for), digests and ``feature``.

    A row whose media is null keeps its key and has nulls for all that is read from it; its ``payload_bytes`` is null too.
    Media that aren't lossless WebP, or end early, are errors. Rows stay as they are, repeated ones too, and an empty
    table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pixels", pa.binary())]
    schema = pa.schema(fields)

    def rows(batches):
        for b in batches:
            for k, n, size, m in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                if not m.is_valid:
                    yield k, n, *[None] * (len(fields) - 2)
                    continue
                data = m.as_buffer().to_pybytes()
                samples = from_media(data)
                payload = samples.reshape(-1)[:size].tobytes()
                yield (k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(samples), payload if pixels else b"")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), schema, 8)

    out = media.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pixels binary")
    return out if pixels else out.drop("pixels")
