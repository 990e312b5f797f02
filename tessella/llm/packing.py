"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so the packing is planned on counts of pieces by length, a table whose size
the capacity bounds: lengths above a share of the capacity are rounded up within groups of equal cardinality, the few
rounded sizes are packed by configurations (a linear programme solved by column generation, rounded down, the rest by best
fit), actual lengths take the places of rounded ones, and small lengths go best-fit into what is left. The plan is a list
of runs, each a number of sequences with the same lengths. Every piece then finds its place from its rank among the pieces
of its length, which comes from distributed counts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.token_files import crc32
from tessella.llm.tokens import encoder, portions

CAPACITY = 1024
#: Groups of large lengths, and the shares of the capacity above which a length is large: the plan with the fewest sequences counts.
GROUPS, LARGE = 32, (1 / 2, 1 / 3, 1 / 8)


def configurations(sizes: list[int], demand: list[int], capacity: int, most_rounds: int = 400) -> list[tuple[float, list[int]]]:
    """Fractional use of configurations that covers ``demand`` with the fewest bins: ``(bins, count by size)``.

    A revised simplex over configurations; each round prices a new one by dynamic programming over the capacity.
    """
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need, use = np.array(demand, float), np.zeros(n)
    for _ in range(most_rounds):
        use = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(n))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        size_of = np.array(sizes)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            fits = np.flatnonzero(size_of <= c)
            if len(fits):
                values = best[c - size_of[fits]] + price[fits]
                k = int(np.argmax(values))
                if values[k] > best[c] + 1e-12:
                    best[c], last[c] = values[k], fits[k]
        if best[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(n), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        step = np.linalg.solve(basis, column)
        up = step > 1e-9
        ratio = np.where(up, use / np.where(up, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return [(float(u), [int(round(x)) for x in basis[:, i]]) for i, u in enumerate(use) if u > 1e-9]


@dataclass
class Open:
    """Runs of sequences by what is left in them; sequences of a run hold the same lengths."""

    by_left: dict[int, dict[tuple[int, ...], int]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(int)))
    lefts: list[int] = field(default_factory=list)

    def add(self, left: int, held: tuple[int, ...], n: int) -> None:
        if n:
            if not self.by_left[left]:
                insort(self.lefts, left)
            self.by_left[left][held] += n

    def take(self, least: int, n: int) -> tuple[int, tuple[int, ...], int] | None:
        """Up to ``n`` sequences of the run with the least room of at least ``least``."""
        at = bisect_left(self.lefts, least)
        if at == len(self.lefts):
            return None
        left = self.lefts[at]
        runs = self.by_left[left]
        held, has = next(iter(runs.items()))
        if has > n:
            runs[held] -= n
            return left, held, n
        del runs[held]
        if not runs:
            self.lefts.pop(at)
        return left, held, has


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> list[tuple[int, tuple[int, ...]]]:
    """The plan with the fewest sequences over the bounds in ``large``; see :func:`plan_from`."""
    return min((plan_from(counts, capacity, groups, share) for share in large), key=lambda runs: sum(n for n, _ in runs))


def plan_from(counts: dict[int, int], capacity: int, groups: int, large: float) -> list[tuple[int, tuple[int, ...]]]:
    """Runs ``(sequences, lengths in each)`` that pack ``counts`` pieces by length; no piece is split or left out."""
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    runs = [(counts.pop(capacity), (capacity,))] if capacity in counts else []
    big = sorted((s for s in counts if s > large * capacity), reverse=True)
    room = Open()
    if big:
        total = sum(counts[s] for s in big)
        each = -(-total // groups)
        # Linear grouping: places of equal cardinality, each as long as its longest piece.
        sizes, demand, filled = [], [], 0
        for s in big:
            n = counts[s]
            while n:
                if filled % each == 0:
                    sizes.append(s)
                    demand.append(0)
                k = min(n, each - filled % each)
                demand[-1] += k
                filled += k
                n -= k
        merged: dict[int, int] = defaultdict(int)
        for s, n in zip(sizes, demand, strict=True):
            merged[s] += n
        sizes, demand = list(merged), list(merged.values())
        bins: list[tuple[int, list[int]]] = []
        left = dict(zip(sizes, demand, strict=True))
        for use, pattern in sorted(configurations(sizes, demand, capacity), reverse=True):
            places = [(s, k) for s, k in zip(sizes, pattern, strict=True) if k]
            n = min([int(use + 1e-9), *(left[s] // k for s, k in places)])
            if n > 0:
                bins.append((n, [s for s, k in places for _ in range(k)]))
                for s, k in places:
                    left[s] -= n * k
        rest = Open()
        for s in sorted(left, reverse=True):
            while left[s]:
                found = rest.take(s, left[s])
                room_left, held, n = found or (capacity, (), max(1, left[s] // (capacity // s)))
                n = min(n, left[s])
                rest.add(room_left - s, (*held, s), n)
                left[s] -= n
        for runs_held in rest.by_left.values():
            bins.extend((n, list(held)) for held, n in runs_held.items())
        # Actual pieces take the places of their group, the longest first; a run is cut where the length changes.
        queue: dict[int, list[list[int]]] = defaultdict(list)
        order = sorted(sizes, reverse=True)
        at, free = 0, dict(zip(sizes, demand, strict=True))
        for s in big:
            n = counts.pop(s)
            while n:
                k = min(n, free[order[at]])
                if k:
                    queue[order[at]].append([s, k])
                    free[order[at]] -= k
                    n -= k
                if not free[order[at]]:
                    at += 1
        for n, places in bins:
            wanted: dict[int, int] = defaultdict(int)
            for p in places:
                wanted[p] += 1
            while n:
                # As many sequences as get the same lengths in all places; one where a group's next length begins inside it.
                k = max(1, min(n, *(queue[p][0][1] // times for p, times in wanted.items())))
                held: list[int] = []
                for p, times in wanted.items():
                    need = times * k
                    while need:
                        head = queue[p][0]
                        m = min(head[1], need)
                        held.extend([head[0]] * (m // k))
                        head[1] -= m
                        need -= m
                        if not head[1]:
                            queue[p].pop(0)
                room.add(capacity - sum(held), tuple(held), k)
                n -= k
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            found = room.take(s, n)
            if found:
                room_left, held, k = found
                room.add(room_left - s, (*held, s), k)
                n -= k
            else:
                fits = capacity // s
                k = n // fits
                if k:
                    room.add(capacity - fits * s, (s,) * fits, k)
                    n -= k * fits
                else:
                    room.add(capacity - n * s, (s,) * n, 1)
                    n = 0
    return runs + [(n, held) for runs_held in room.by_left.values() for held, n in runs_held.items()]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of the tokenised documents, written as a table: ``doc_id, piece, start, length, ids_crc32, part, rank``.

    A document of more than ``capacity`` ids is cut so that all pieces but the first are full. ``rank`` counts the pieces
    of a length within the part of the table that one task wrote. Null texts are empty and have the end id alone.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in portions(texts):
                rows = []
                for k, ids in zip(keys[lo:hi], enc.encode(texts[lo:hi], end_id), strict=True):
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((k, i, a, z - a, crc32(ids[a:z]), part, int(seen[z - a])))
                        seen[z - a] += 1
                columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
                yield store.batch(schema, **dict(zip(schema.names, map(list, columns), strict=True)))

    names = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return store.materialize(names.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``: where each piece lies.

    The driver holds counts by length, at most ``capacity`` of them, and the plan made from those; a piece's rank among
    all of its length is its rank in its part and the counts of earlier parts. Pieces that agree in all columns are
    pieces of their own. No piece of an empty table gives an empty result.
    """
    spark = cut.sparkSession
    sums = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    sums = store.materialize(sums, "piece-counts")
    counts = {r["of_length"]: r["n"] for r in sums.groupBy("of_length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    # Places by length in the order of ranks: rank of the first, sequence of the first, sequences, offset.
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, held in runs:
        offset = 0
        for s in held:
            places[s].append((used[s], sequence, offset))
            used[s] += n
            offset += s
        sequence += n
    tables = spark.sparkContext.broadcast({s: tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for s, own in places.items()})
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = pa.schema(fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("first").to_numpy()
            sequence_id, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for s in np.unique(length):
                own = length == s
                ranks, sequences, offsets = tables.value[int(s)]
                at = np.searchsorted(ranks, rank[own], side="right") - 1
                sequence_id[own], offset[own] = sequences[at] + rank[own] - ranks[at], offsets[at]
            columns = {n: b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield store.batch(schema, **columns, sequence_id=sequence_id, offset=offset)

    joined = cut.join(sums.drop("n"), (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    return joined.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack all documents: a row a piece, see :func:`pieces` and :func:`pack`.

    Null and empty texts are their end id alone; long ones are several pieces; ties of length, repeated rows and rows with a
    null key are pieces of their own. An empty table gives an empty result.
    """
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity)
