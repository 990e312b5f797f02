"""Token-ID / binary output: fixed-width bit packing.

A shard file holds the ids of consecutive documents at the fewest bits that fit the vocabulary. Layout, little-endian
64-bit words throughout:

    magic, bits an id, ids a block, documents, ids, blocks      6 words
    document ids; 1 where the id is not null; first id of each document and the end    n, n, n + 1 words
    first payload word of each block and the end                blocks + 1 words
    payload: blocks of packed ids

Any document or range of ids is read by unpacking only the blocks that hold it; a block unpacks in ``bits`` vectorised
steps whatever its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.bits import gather, pack, unpack, width_of
from tessella.llm.tokens import encoder, portions

MAGIC = int.from_bytes(b"TESSBIT1", "little")
#: Ids a block, a multiple of 64, and ids a shard, which bounds a task's memory.
BLOCK, SHARD = 1 << 16, 1 << 22
#: Tasks that read shards back before a task gets several shards.
READERS = 4096

MANIFEST = "part int, shard int, path string, docs long, tokens long, bytes long"


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], largest: int, block: int = BLOCK) -> list[bytes]:
    """A shard file's contents for documents in order."""
    width = width_of(largest)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.uint64)
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    blocks = [pack(flat[i : i + block], width) for i in range(0, len(flat), block)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.uint64)
    head = np.array([MAGIC, width, block, len(ids), len(flat), len(blocks)], np.uint64)
    keys = np.array([x or 0 for x in doc_ids], np.int64).view(np.uint64)
    present = np.array([x is not None for x in doc_ids], np.uint64)
    return [x.tobytes() for x in (head, keys, present, starts, offsets, *blocks)]


class Shard:
    """A shard file opened for reading; ``memory`` is mapped or in memory."""

    def __init__(self, memory: memoryview):
        words = np.frombuffer(memory, np.uint64)
        magic, self.width, self.block, self.docs, self.tokens, blocks = (int(x) for x in words[:6])
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = 6 + 2 * self.docs
        self.keys = words[6 : 6 + self.docs].view(np.int64)
        self.present = words[6 + self.docs : at]
        self.starts = words[at : at + self.docs + 1].astype(np.int64)
        at += self.docs + 1
        self.offsets = words[at : at + blocks + 1].astype(np.int64)
        self.payload = words[at + blocks + 1 :]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi`` of the shard, as uint32."""
        if lo >= hi:
            return np.zeros(0, "<u4")
        first, last = lo // self.block, (hi - 1) // self.block
        found = [unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], self.width, min(self.block, self.tokens - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(found)[lo - first * self.block : hi - first * self.block].astype("<u4")

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Single ids anywhere, each from the one or two words that hold it."""
        positions = np.asarray(positions, np.int64)
        out = np.zeros(len(positions), "<u4")
        block = positions // self.block
        for b in np.unique(block):
            own = block == b
            out[own] = gather(self.payload[self.offsets[b] : self.offsets[b + 1]], self.width, positions[own] - b * self.block)
        return out


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, text: str = "text", key: str = "doc_id", shard_tokens: int = SHARD) -> DataFrame:
    """Encode ``docs[text]``, append ``end_id`` to each, and write shards to ``path`` in ascending order of ``key``.

    One range shuffle orders the documents (by key, then by a hash of the text, so that repeated keys spread too); each
    task then encodes its range and writes shards of at most ``shard_tokens`` ids, or one longer document. Null texts
    count as empty, null keys come first, repeated rows are all written. The manifest, one row a shard, is written as a
    table and returned; ``(part, shard)`` is the order.
    """
    names = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ordered = names.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        keys, ids, held = [], [], 0

        def flush():
            nonlocal keys, ids, held, shard
            uri = f"{path}/part-{part:06d}-{shard:06d}.tok"
            size = store.write_shard(uri, shard_bytes(keys, ids, max(enc.largest, end_id)))
            row = store.batch(schema, part=[part], shard=[shard], path=[uri], docs=[len(keys)], tokens=[held], bytes=[size])
            keys, ids, held, shard = [], [], 0, shard + 1
            return row

        for b in batches:
            own, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in portions(texts):
                for k, x in zip(own[lo:hi], enc.encode(texts[lo:hi], end_id), strict=True):
                    if held and held + len(x) > shard_tokens:
                        yield flush()
                    keys.append(k)
                    ids.append(x)
                    held += len(x)
        if keys:
            yield flush()

    return store.materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the shards: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (uint32 bytes).

    The manifest, a row a shard, says how many tasks read: one a shard up to ``READERS``, beyond that some shards each.
    Documents come back with the keys they were written with, null ones and repeated rows too; an empty manifest, that of
    an empty table, gives an empty result.
    """
    tasks = manifest.count()
    tasks = max(1, min(tasks, max(READERS, tasks // 16)))
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    first = manifest.withColumn("first", F.coalesce(F.sum("tokens").over(order), F.lit(0).cast("long")))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist(), strict=True):
                shard = Shard(store.read_shard(uri))
                ids, starts = shard.ids(0, shard.tokens), shard.starts
                for lo in range(0, shard.docs, 1000):
                    hi = min(lo + 1000, shard.docs)
                    keys = pa.array(shard.keys[lo:hi], mask=shard.present[lo:hi] == 0)
                    own = [ids[starts[i] : starts[i + 1]].tobytes() for i in range(lo, hi)]
                    yield store.batch(schema, doc_id=keys, start=starts[lo:hi] + first, n_tokens=np.diff(starts[lo : hi + 1]), ids=own)

    return first.select("path", "first").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by its unsigned crc32."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian uint32."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
