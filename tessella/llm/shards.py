"""Sorted keys in Elias-Fano shards that tasks map into memory and search.

A sorted set is cut into shards by range. Each task of a range shuffle writes its keys, less the first, as an Elias-Fano
sequence with packed columns beside it, and reports a row; those rows, one a shard, tell a reader where each key lies.
A lookup touches a few words of one shard.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessella.llm import store
from tessella.llm.bits import EliasFano, gather, pack, width_of

#: Keys a shard; opened shards that a worker keeps, and bytes of those among them that it couldn't map.
SHARD, MOST_OPEN, MOST_READ = 1 << 21, 1 << 13, 1 << 28

_opened: OrderedDict[str, tuple[object, int]] = OrderedDict()
_read = 0


def opened(path: str, load: Callable[[np.ndarray], object]) -> object:
    """What ``load`` makes of a shard's words; kept by path for the worker's later batches."""
    global _read
    if path in _opened:
        _opened.move_to_end(path)
        return _opened[path][0]
    data = store.read_shard(path)
    held = 0 if isinstance(data.obj, np.memmap) else len(data)
    found = load(np.frombuffer(data, np.uint64))
    _opened[path] = found, held
    _read += held
    while len(_opened) > MOST_OPEN or (_read > MOST_READ and len(_opened) > 1):
        _read -= _opened.popitem(last=False)[1][1]
    return found


def packed(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers at their largest one's width, with a head."""
    width = width_of(int(values.max()) if len(values) else 0)
    words = pack(values, width)
    return [np.array([width, len(words)], np.uint64), words]


def load_packed(words: np.ndarray, at: int) -> tuple[tuple[np.ndarray, int], int]:
    """A packed column as (words, width), and the word after it."""
    width, n = int(words[at]), int(words[at + 1])
    return (words[at + 2 : at + 2 + n], width), at + 2 + n


@dataclass
class SortedShards:
    """A written set: first key, path and rank of the first key of each shard, in order; ``n`` keys, and their columns' sums."""

    firsts: np.ndarray
    paths: list[str]
    ranks: np.ndarray
    n: int
    total: int

    def find(self, keys: np.ndarray, columns: bool = False) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
        """Ranks of keys in the set, -1 where absent; with ``columns`` also the values kept beside them, 0 where absent."""
        keys = np.asarray(keys, np.int64)
        rank, value = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.firsts, keys, side="right") - 1
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.paths) + 1))
        for i, path in enumerate(self.paths):
            own = order[cuts[i] : cuts[i + 1]]
            if len(own):
                sequence, (words, width) = opened(path, load_set)
                at = sequence.find(keys[own] - self.firsts[i])
                hit = at >= 0
                rank[own] = np.where(hit, at + self.ranks[i], -1)
                if columns:
                    value[own[hit]] = gather(words, width, at[hit])
        return (rank, value) if columns else rank


def load_set(words: np.ndarray):
    sequence, at = EliasFano.load(words, 0)
    return sequence, load_packed(words, at)[0]


MANIFEST = "part int, first long, n long, total long, path string"


def sets_of(arrays: Iterator[tuple[np.ndarray, np.ndarray]], path: str, shard: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Write a task's keys and values, which come in order of the keys, as shards; a manifest row each."""
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("path", pa.string())])
    part, number, waiting, held = TaskContext.get().partitionId(), 0, [], 0

    def flush(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        uri = f"{path}/part-{part:06d}-{number:06d}.set"
        store.write_shard(uri, [x.tobytes() for x in (*EliasFano.build(k - k[0]).parts(), *packed(v))])
        return store.batch(schema, part=[part], first=[int(k[0])], n=[len(k)], total=[int(v.sum())], path=[uri])

    for k, v in arrays:
        waiting.append((k, v))
        held += len(k)
        if held >= shard:
            k, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
            for at in range(0, held - shard + 1, shard):
                yield flush(k[at : at + shard], v[at : at + shard])
                number += 1
            waiting = [(k[held - held % shard :], v[held - held % shard :])]
            held %= shard
    if held:
        yield flush(*(np.concatenate(x) for x in zip(*waiting, strict=True)))


def sorted_shards(manifest: DataFrame) -> SortedShards:
    """The set of the shards of a manifest; the driver gathers its rows, one a shard."""
    found = sorted(manifest.collect(), key=lambda r: r["first"])
    counts = np.array([r["n"] for r in found], np.int64)
    return SortedShards(np.array([r["first"] for r in found], np.int64), [r["path"] for r in found], np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64), int(counts.sum()), sum(r["total"] for r in found))


def write_sorted(table: DataFrame, path: str, key: str, value: str | None = None, shard: int = SHARD) -> SortedShards:
    """Write distinct non-negative keys with a non-negative value each. The driver gathers a row a shard."""
    rows = table.select(key, *([value] if value else []))
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = ((b.column(0).to_numpy(), b.column(1).to_numpy() if value else np.zeros(b.num_rows, np.int64)) for b in batches if b.num_rows)
        yield from sets_of(arrays, path, shard)

    return sorted_shards(ordered.mapInArrow(write, MANIFEST))
