"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles, with numpy exclusive-or and bit counts. A tile holds fingerprints whose segments have
the same population counts; two fingerprints within ``radius`` bits differ by at most ``radius`` in the sum over segments,
so all other pairs of tiles are skipped. Tiles of more than ``tile`` fingerprints are split, and each task gets one tile
and the tiles near it, a bounded number of rows. Inside a task rows are in order of their population counts, and blocks
whose counts differ by more than the radius are skipped again.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.names import free
from tessella.llm.components import Labels, components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fingerprints a tile; a task compares one tile with as many from each tile near it. A fingerprint is sent once for each
#: tile near its own, so larger tiles move less.
TILE = 1 << 15
#: Pairs whose bits are counted in one step, which bounds what a task holds where all of them are near.
AREA = 1 << 18
#: Bits added to the radius of a similarity, as ties of bits are frequent in texts of few shingles.
EXTRA = 6
#: Shingles a tile, where their sets are compared too.
SHINGLES = 8_000_000
#: Counts of shingles by part of their hash that bound what two sets share, and the sets too large for them.
BUCKETS, UNCOUNTED = 256, 1 << 15
#: Shingles counted in one step.
COUNTED = 500_000


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, A-Z lower-cased, joined by spaces; a shorter text is one run."""
    found = WORDS.findall(text.encode().lower()) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    pairs = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        own = np.ascontiguousarray(hashes[lo : lo + (1 << 16)])
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64, key: str = "doc_id", text: str = "text", short: int = 0) -> DataFrame:
    """``doc_id``, ``size`` (shingles) and ``fp0``, ``fp1`` ... (64 bits each, as long) of each row's whole text.

    A text without words, or null, has size 0 and fingerprint zero. The second and later 64 bits hash the first ones'
    hashes again. With ``short`` each shingle counts once, and ``shingles`` has so many bits of each (16 or 64), sorted.
    """
    n = bits // 64
    more = [("shingles", pa.binary())] if short else []
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), *((f"fp{i}", pa.int64()) for i in range(n)), *more])
    factor = np.uint64(0x9E3779B97F4A7C15)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found, sets = [], [], []
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, words)
                if short:
                    h = np.unique(h)
                    sets.append(short_hashes(h, short).tobytes())
                sizes.append(len(h))
                row = [majority(h)]
                for _ in range(1, n):
                    h = (h ^ (h >> np.uint64(29))) * factor
                    h ^= h >> np.uint64(32)
                    row.append(majority(h))
                found.append(row)
            table = np.array(found, np.uint64).reshape(-1, n).view(np.int64)
            yield store.batch(schema, doc_id=b.column(0), size=sizes, **{f"fp{i}": table[:, i] for i in range(n)}, **({"shingles": sets} if more else {}))

    names = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return names.mapInArrow(each, ", ".join(["doc_id long", "size long", *(f"fp{i} long" for i in range(n)), *(["shingles binary"] if more else [])]))


def short_hashes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Sorted hashes, or the leading 16 bits of them."""
    return np.sort(hashes) if bits == 64 else np.sort((hashes >> np.uint64(48)).astype(np.uint16))


def _compare(own: np.ndarray, guests: np.ndarray, own_size: np.ndarray, guest_size: np.ndarray, radius: int, ratio: float, inside: bool):
    """Pairs of positions within ``radius`` bits and ``ratio`` of sizes, at most ``AREA`` of them at a time.

    Both sides are in order of their bits set; a block of rows meets only guests whose number of them is within the radius.
    """
    step = max(1, AREA // max(1, len(guests)))
    own_bits, guest_bits = population(own), population(guests)
    for lo in range(0, len(own), step):
        rows = own[lo : lo + step]
        begin = lo if inside else int(np.searchsorted(guest_bits, own_bits[lo] - radius, side="left"))
        end = int(np.searchsorted(guest_bits, own_bits[lo + len(rows) - 1] + radius, side="right"))
        if end <= begin:
            continue
        other = guests[begin:end]
        apart = np.zeros((len(rows), len(other)), np.uint8)
        for w in range(own.shape[1]):
            apart += np.bitwise_count(rows[:, w][:, None] ^ other[:, w][None, :])
        i, j = np.nonzero(apart <= radius)
        i, j = i + lo, j + begin
        if ratio:
            a, b = own_size[i], guest_size[j]
            near = np.minimum(a, b) >= ratio * np.maximum(a, b)
            i, j = i[near], j[near]
        if inside:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def population(fingerprints: np.ndarray) -> np.ndarray:
    """The bits set in each row of words."""
    return np.bitwise_count(fingerprints).sum(axis=1, dtype=np.int64)


class Sets:
    """Sets of shingles of a task's rows, by 16 or 64 bits of each, as one array."""

    def __init__(self, sets: np.ndarray, size: np.ndarray, least: float):
        packed = b"".join(sets.tolist())
        self.whole = len(packed) == 8 * int(size.sum())
        self.flat = np.frombuffer(packed, np.uint64 if self.whole else np.uint16)
        self.size, self.least = size, least
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.lead = (self.flat >> np.uint64(48)).astype(np.uint16) if self.whole else self.flat
        self.counts = np.zeros((len(size), BUCKETS), np.uint16)
        edges = np.searchsorted(self.start, np.arange(0, self.start[-1] + COUNTED, COUNTED))
        for lo, hi in zip(edges[:-1].tolist(), np.minimum(edges[1:], len(size)).tolist()):
            if hi > lo:
                part = self.lead[self.start[lo] : self.start[hi]] & np.uint16(BUCKETS - 1)
                owner = np.repeat(np.arange(hi - lo) * BUCKETS, size[lo:hi])
                self.counts[lo:hi] = np.bincount(owner + part, minlength=BUCKETS * (hi - lo)).reshape(-1, BUCKETS)
        self.marks = np.zeros(1 << 16, np.uint8)

    def _least(self, i: int, j: np.ndarray) -> np.ndarray:
        """How many shingles row ``i`` must share with each row ``j``."""
        return np.ceil(self.least / (1 + self.least) * (self.size[i] + self.size[j]) - 1e-6).astype(np.int64)

    def near(self, i: int, j: np.ndarray) -> np.ndarray:
        """The rows ``j`` whose similarity with row ``i`` may reach ``least``, by ever closer bounds of what they share.

        The first are minima of counts, then shingles that agree in 16 bits, so that no row is missed; whole hashes decide.
        """
        need = self._least(i, j)
        if self.size[i] < UNCOUNTED:
            step = max(1, AREA * 16 // BUCKETS)
            bound = [np.minimum(self.counts[i], self.counts[j[lo : lo + step]]).sum(axis=1, dtype=np.int64) for lo in range(0, len(j), step)]
            near = (np.concatenate(bound) >= need) | (self.size[j] >= UNCOUNTED)
            j, need = j[near], need[near]
        if not len(j):
            return j
        at = [slice(a, b) for a, b in zip(self.start[j].tolist(), self.start[j + 1].tolist())]
        own = slice(self.start[i], self.start[i + 1])
        self.marks[self.lead[own]] = 1
        near = np.fromiter((np.count_nonzero(self.marks[self.lead[x]]) for x in at), np.int64, len(j)) >= need
        self.marks[self.lead[own]] = 0
        if self.whole:
            near[near] = [self._shared(self.flat[own], self.flat[x]) >= n for x, n, ok in zip(at, need.tolist(), near) if ok]
        return j[near]

    @staticmethod
    def _shared(own: np.ndarray, other: np.ndarray) -> int:
        both = np.sort(np.concatenate([own, other]))
        return int(np.count_nonzero(both[1:] == both[:-1]))


def link(rows: DataFrame, radius: int, size_ratio: float = 0.0, tile: int = TILE, similarity: float = 0.0) -> DataFrame:
    """Links ``a, b`` among rows of ``node``, ``size`` and distinct fingerprints ``fp0`` ...: a spanning set of all that are near.

    Near are fingerprints that differ in at most ``radius`` bits and, with ``size_ratio``, whose sizes' ratio is at least
    that. From each comparison of tiles only the links that join its rows are returned, so their number follows the rows
    even where all are near to all; no two near rows stay unjoined.

    With ``similarity``, near are those besides whose sets, in a column ``shingles``, may have that Jaccard similarity, or have
    it where whole hashes are given. A link is then a pair that is near itself.
    """
    words = [c for c in rows.columns if re.fullmatch(r"fp\d+", c)]
    if size_ratio:
        # Sizes of a ratio of at least size_ratio lie in one class or in neighbouring ones.
        coordinates = [F.when(F.col("size") <= 0, F.lit(0)).otherwise(F.floor(F.ln(F.greatest("size", F.lit(1))) / F.lit(-math.log(size_ratio))) + 2)]
        offsets = [(0,), (1,)]
    else:
        coordinates = [F.bit_count(F.shiftrightunsigned(w, s).bitwiseAND(F.lit(0xFFFF))) for w in words for s in (0, 16, 32, 48)]
        coordinates = coordinates[:4] if len(words) == 1 else [sum(coordinates[i :: 4], F.lit(0)) for i in range(4)]
        steps = itertools.product(range(-radius, radius + 1), repeat=4)
        offsets = [o for o in steps if sum(map(abs, o)) <= radius and o >= (0, 0, 0, 0)]
    extra = ["shingles"] if similarity else []
    base = 1 << 12
    cell = sum(((c + F.lit(radius)).cast("long") * F.lit(base ** (len(coordinates) - 1 - i)) for i, c in enumerate(coordinates)), F.lit(0).cast("long"))
    steps = [sum(o * base ** (len(offset) - 1 - i) for i, o in enumerate(offset)) for offset in offsets]
    placed = rows.withColumn("cell", cell)
    parts = F.ceil(F.count("*") / F.lit(tile))
    parts = F.greatest(parts, F.ceil(F.sum("size") / F.lit(SHINGLES))) if similarity else parts
    cells = store.materialize(placed.groupBy("cell").agg(parts.cast("int").alias("subs")), "simhash-cells")
    # For each cell: its own parts, and the cells to which its rows go as guests.
    near = cells.withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in steps]))).select(F.col("cell").alias("host"), F.col("subs").alias("host_subs"), (F.col("cell") + F.col("step")).alias("near_cell"))
    near = near.join(cells.select(F.col("cell").alias("c"), F.col("subs").alias("near_subs")), F.col("near_cell") == F.col("c"))
    hosts = near.groupBy("host").agg(F.max("near_subs").alias("bundles"))
    guests = near.where("host <> near_cell").groupBy("near_cell").agg(F.collect_list(F.struct("host", "host_subs")).alias("hosts"))
    plan = cells.join(hosts, F.col("cell") == F.col("host")).drop("host").join(guests, F.col("cell") == F.col("near_cell"), "left").drop("near_cell")
    plan = store.materialize(plan.withColumnRenamed("cell", "at"), "simhash-plan")
    # With a ratio of sizes there are fewer cells than steps of it up to the largest size: a few hundred.
    dealt = placed.join(F.broadcast(plan) if size_ratio else plan.hint("merge"), F.col("cell") == F.col("at")).withColumn("sub", F.pmod(F.xxhash64("node", F.lit(7)), F.col("subs")).cast("int"))
    # A group is a part of a cell (cell, sub) and a bundle: of each near cell the part with the bundle's number.
    own = F.transform(F.sequence(F.lit(0), F.col("bundles") - 1), lambda g: F.struct(F.col("cell").alias("cell"), F.col("sub").alias("sub"), g.alias("bundle"), F.lit(True).alias("own")))
    same = F.when(F.col("sub") > 0, F.transform(F.sequence(F.lit(0), F.col("sub") - 1), lambda s: F.struct(F.col("cell").alias("cell"), s.alias("sub"), F.col("sub").alias("bundle"), F.lit(False).alias("own"))))
    other = F.flatten(F.transform("hosts", lambda h: F.transform(F.sequence(F.lit(0), h["host_subs"] - 1), lambda s: F.struct(h["host"].alias("cell"), s.alias("sub"), F.col("sub").alias("bundle"), F.lit(False).alias("own")))))
    kind = "array<struct<cell:bigint,sub:int,bundle:int,own:boolean>>"
    sent = dealt.withColumn("to", F.explode(F.concat(own.cast(kind), F.coalesce(same.cast(kind), F.array().cast(kind)), F.coalesce(other.cast(kind), F.array().cast(kind)))))
    sent = sent.select(F.col("to.cell").alias("cell"), F.col("to.sub").alias("sub"), F.col("to.bundle").alias("bundle"), F.col("to.own").alias("own"), "node", "size", *words, *extra)
    grouped = sent.repartition("cell", "sub", "bundle").sortWithinPartitions("cell", "sub", "bundle")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        is_own = group["own"]
        fp = np.stack([group[w].view(np.uint64) for w in words], axis=1)
        order = np.lexsort((population(fp), ~is_own))
        n, fp, size, node = int(is_own.sum()), fp[order], group["size"][order], group["node"][order]
        labels = Labels(len(node))
        if similarity:
            sets, links = Sets(group["shingles"][order], size, similarity), []

            def join(i: np.ndarray, j: np.ndarray) -> None:
                for lo, hi in zip(starts := [0, *(np.flatnonzero(np.diff(i)) + 1).tolist()], [*starts[1:], len(i)]):
                    k, others = int(i[lo]), j[lo:hi]
                    others = others[labels.label[others] != labels.label[k]]
                    if len(others) and len(near := sets.near(k, others)):
                        # One link for each of the groups that row k joins.
                        near = near[np.unique(labels.label[near], return_index=True)[1]]
                        labels.join(np.full(len(near), k), near)
                        links.append((node[np.full(len(near), k)], node[near]))
        else:
            join = labels.join
        if group["sub"][0] == group["bundle"][0]:
            for i, j in _compare(fp[:n], fp[:n], size[:n], size[:n], radius, size_ratio, True):
                join(i, j)
        for lo in range(n, len(fp), 1 << 14):
            for i, j in _compare(fp[:n], fp[lo : lo + (1 << 14)], size[:n], size[lo : lo + (1 << 14)], radius, size_ratio, False):
                join(i, j + lo)
        if similarity:
            return tuple(np.concatenate([np.zeros(0, np.int64), *(x[side] for x in links)]) for side in range(2))
        moved = labels.label != np.arange(len(node))
        return node[moved], node[labels.label[moved]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in store.groups(batches, ("cell", "sub", "bundle", "own", "node", "size", *words, *extra), 3):
            if group["own"].any() and len(group["own"]) > 1:
                a, b = compare(group)
                if len(a):
                    yield store.batch(schema, a=a, b=b)

    return grouped.mapInArrow(each, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 64, radius: int = 2, size_ratio: float = 0.0, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, the fingerprint's words ``fp0`` ..., ``size``, and ``component_id``.

    ``component_id`` is the smallest key reachable over links of fingerprints, itself included. Equal fingerprints are
    compared once, whatever the number of their documents; with ``size_ratio`` so are equal ones of equal sizes. Rows
    with one key are one document. Rows with a null key join no group through it: their component is that of their
    fingerprint, null where no other document has it. An empty table gives an empty result.
    """
    found = store.materialize(fingerprints(docs, words, bits, key, text), "simhash-fingerprints")
    kinds = [c for c in found.columns if c.startswith("fp")] + (["size"] if size_ratio else [])
    rows = found.groupBy(*kinds).agg(F.min("doc_id").alias("node"), *([] if size_ratio else [F.max("size").alias("size")]))
    rows = store.materialize(rows.where("node IS NOT NULL"), "simhash-distinct")
    links = link(rows, radius, size_ratio, tile)
    joined = components(links)
    label = rows.join(joined, "node", "left").select(*[F.col(k).alias(f"of_{k}") for k in kinds], F.coalesce("component", "node").alias("component_id"))
    label = store.materialize(label, "simhash-labels")
    on = [F.col(k) == F.col(f"of_{k}") for k in kinds]
    return found.join(label, on, "left").select("doc_id", *[c for c in found.columns if c.startswith("fp")], "size", "component_id")


def bit_radius(similarity: float, bits: int) -> int:
    """Bits within which the fingerprints of two sets of a Jaccard similarity lie, with four deviations of their spread."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def jaccard(docs: DataFrame, pairs: DataFrame, words: int, least: float, key: str, text: str) -> DataFrame:
    """The pairs ``a, b`` of keys whose sets of shingles have a Jaccard similarity of at least ``least``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("text")).join(nodes, "node", "left_semi").dropDuplicates(["node", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t, words)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "own"])

    found = store.materialize(rows.mapInArrow(sets, "node long, own binary"), "simhash-sets")
    more = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(found.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").select("x", "y", "a", "b", *more)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column(0), b.column(1), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                joint = np.sort(np.concatenate([x, y]))
                shared = int((joint[1:] == joint[:-1]).sum())
                near.append(shared >= least * (len(joint) - shared))
            yield b.select(["a", "b", *more]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(verify, ", ".join(f"{n} long" for n in ("a", "b", *more)))


def similar(docs: DataFrame, words: int, bits: int, similarity: float, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``doc_id`` and ``component_id`` of each row with a key, over links of an exact Jaccard similarity of at least ``similarity``.

    Candidates are near fingerprints of the sets of shingles. The task that finds them bounds what their sets share, by 16
    bits a shingle at last, joins rows whose bound allows the similarity, and hands on the pairs that did so, fewer than its
    rows. These are verified by whole hashes. A pair that fails might have hidden another one of its group, so the
    rows of such groups are compared once more, by whole hashes.

    Texts without words, null ones among them, are alike; rows of equal fingerprints and as many shingles, repeated rows among
    them, are taken as one; rows with one key are one document. An empty table gives an empty result.
    """
    found = store.materialize(fingerprints(docs, words, bits, key, text, 16), "simhash-fingerprints")
    kinds = [c for c in found.columns if c.startswith("fp")] + ["size"]
    distinct = store.materialize(found.groupBy(*kinds).agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "simhash-distinct")
    radius = bit_radius(similarity, bits) + EXTRA

    def linked(sets: DataFrame) -> DataFrame:
        # The row of the smallest key brings its set along; others of equal fingerprints and sizes have the same.
        rows = sets.where("doc_id IS NOT NULL").groupBy(*kinds).agg(F.min("doc_id").alias("node"), F.min_by("shingles", "doc_id").alias("shingles"))
        return store.materialize(link(rows, radius, similarity, tile, similarity).where("a <> b").distinct(), "simhash-links")

    links = linked(found)
    verified = store.materialize(jaccard(docs, links, words, similarity, key, text), "simhash-verified")
    if verified.count() < links.count():
        groups = components(links)
        groups = store.materialize(groups.unionByName(groups.select(F.col("component").alias("node"), "component")).distinct(), "simhash-groups")
        failed = links.join(verified, ["a", "b"], "left_anti").select(F.col("a").alias("node"))
        again = groups.join(groups.join(failed, "node", "left_semi").select("component").distinct(), "component", "left_semi").select(F.col("node").alias("again"))
        rest = docs.join(again.distinct(), F.col(key).cast("long") == F.col("again"), "left_semi")
        verified = verified.unionByName(linked(fingerprints(rest, words, bits, key, text, 64)))
    label = distinct.join(components(verified), "node", "left")
    label = label.select(*[F.col(k).alias(f"of_{k}") for k in kinds], F.coalesce("component", "node").alias("component_id"))
    return found.join(label, [F.col(k) == F.col(f"of_{k}") for k in kinds]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, bits: int = 128, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest key.

    Documents are linked where the Jaccard similarity of their sets of shingles is at least ``similarity``, which the
    ratio of the sets' sizes can't be below; candidates come from fingerprints (see ``similar``). Rows with a null key
    stay. Of rows with one key one stays.
    """
    found = similar(docs, words, bits, similarity, key, text)
    gone, again, of, row = (free(docs, n) for n in ("dropped", "twice", "of_key", "whole_row"))
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    dropped = store.materialize(dropped, "simhash-dropped")
    kept = docs.join(dropped, F.col(key) == F.col(gone), "left_anti")
    twice = docs.groupBy(F.col(key).alias(again)).agg(F.count("*").alias(of)).where((F.col(of) > 1) & F.col(again).isNotNull())
    twice = store.materialize(twice.select(again), "simhash-repeated")
    single = kept.join(twice, F.col(key) == F.col(again), "left_anti")
    repeated = kept.join(twice, F.col(key) == F.col(again), "left_semi")
    # Which of the rows with one key stays must not depend on how they are dealt out.
    order = [F.xxhash64(F.col(text)), *(F.xxhash64(F.col(c)) for c, kind in docs.dtypes if c != text and "map<" not in kind)]
    least = repeated.groupBy(F.col(key).alias(of)).agg(F.min_by(F.struct(*docs.columns), F.struct(*order)).alias(row)).select(f"{row}.*")
    return single.unionByName(least)
