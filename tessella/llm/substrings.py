"""Substring dedup by relative Lempel-Ziv parsing.

Equal texts are parsed once. A window of ``length`` words that occurs twice holds, in both places, the same
smallest-hashed run of ``anchor`` words (its minimizer). Texts are cut around those anchors into segments that hold every
window with that anchor; the segments with one anchor form a reference block, indexed by the ``length`` words that begin
at each place. Every segment is factored greedily against its block: at each place its next ``length`` words are looked
up, and the factor that began before goes on with its reference while the words agree. Factors are confirmed word by word
and checked against the ends of both texts at their boundaries. All windows inside a factor are duplicate spans.

Blocks hold at most ``most`` segments. A hot anchor, one that occurs more often, has no block: the factors of its windows
are counted where they are, by 95 bits of hash over all their words, which leaves no large group. The spans return to the
texts as a sorted set of their windows' hashes, with 32 more bits to confirm each, in Elias-Fano shards; a last pass over
the texts marks the words that they cover.

Words are told apart by hashes of 63 bits, in runs of ``length`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import shards, store
from tessella.llm.tokens import portions
from tessella.llm.words import mixed, runs, sliding, word_hashes

#: Words a window and an anchor; segments a block.
LENGTH, ANCHOR, MOST = 35, 12, 1 << 14
#: Characters hashed at once, which bounds a task's arrays.
PORTION = 1_000_000


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the words of all texts in order, and the bounds of the texts among them."""
    flat, counts = word_hashes([(t or "").encode() for t in texts], fold=False)
    return flat.astype(np.uint64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def window_keys(flat: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all runs of ``length`` words along the last axis: a key of 63 bits and 32 bits that confirm it."""
    return runs(flat, length).astype(np.int64), (runs(mixed(~flat), length) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def windows(flat: np.ndarray, bounds: np.ndarray, length: int, anchor: int):
    """Of all windows that lie within one text: their starts, anchors' hashes, and the places that are such anchors.

    Returns ``(starts, smallest, grams, places)``: ``smallest[i]`` is the least gram hash in the window at ``starts[i]``;
    ``places`` are the positions whose gram is that of some window that holds it.
    """
    inside = np.zeros(max(0, len(flat) - length + 1), bool)
    for a, z in zip(bounds.tolist(), bounds[1:].tolist()):
        if z - a >= length:
            inside[a : z - length + 1] = True
    grams = runs(flat, anchor)
    if not inside.any():
        return np.zeros(0, np.int64), grams[:0], grams, np.zeros(0, np.int64)
    reach = length - anchor + 1
    smallest = sliding(grams, reach, np.minimum)
    counted = np.where(inside, smallest, np.uint64(0))
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), counted, np.zeros(reach - 1, np.uint64)])
    places = np.flatnonzero((sliding(padded, reach, np.maximum) == grams) & (grams > 0))
    starts = np.flatnonzero(inside)
    return starts, smallest[starts], grams, places


def repeated_factors(group: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """Which windows of each segment lie in a factor against another segment of its block.

    ``rows`` are segments as hashes of words with the anchor in the middle, ``left`` and ``right`` tell how many words
    beside it belong to the text, ``group`` names their blocks. The reference of a place is the first segment of the block
    with the same ``length`` words from there on. A factor whose reference stays the same goes on by one compared word;
    one that changes its reference is compared whole, so equal hashes of different words never make a factor.
    """
    reach, column = length - anchor + 1, np.arange(length - anchor + 1)
    # A window at a column lies within the text where it starts at or after its first word and ends by its last one.
    fits = (column[None, :] >= (length - anchor - left)[:, None]) & (column[None, :] <= right[:, None])
    marked = np.zeros((len(rows), reach), bool)
    starts, block = runs(rows, length), mixed(group.astype(np.uint64))
    reference, agreed = np.full(len(rows), -1, np.int64), np.zeros(len(rows), bool)
    for c in range(reach):
        own, last = np.flatnonzero(fits[:, c]), agreed
        agreed = np.zeros(len(rows), bool)
        while len(own):
            key = starts[own, c] ^ block[own]
            order = np.argsort(key, kind="stable")
            own, key = own[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(first, len(own)))
            head = np.repeat(own[first], sizes)
            same = (group[own] == group[head]) & (rows[own, c + length - 1] == rows[head, c + length - 1])
            fresh = np.flatnonzero(same & (own != head) & ~(last[own] & (reference[own] == head)))
            for lo in range(0, len(fresh), 1 << 15):
                at = fresh[lo : lo + (1 << 15)]
                same[at] = (rows[own[at], c : c + length] == rows[head[at], c : c + length]).all(axis=1)
            reference[own], agreed[own] = head, same
            found = same & np.repeat(np.add.reduceat(same.astype(np.int64), first) > 1, sizes)
            marked[own[found], c] = True
            own = np.sort(own[~same])
    return marked


def _count(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of columns, sorted, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return *(c[first] for c in columns), np.diff(np.append(first, len(order)))


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The different texts, each with 128 bits of hash ``k1``, ``k2`` and how many rows have it; null counts as empty.

    Copies are put together within tasks before the shuffle, so a text that a third of all rows have is one row a task.
    """
    rows = docs.select(*text_key(text), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("n"))


def text_key(text: str) -> tuple[Column, Column]:
    """128 bits of a text's hash, as two columns."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(own).alias("k1"), F.xxhash64(F.lit("second"), own).alias("k2")


def duplicate_windows(texts: DataFrame, path: str, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST):
    """Sets of the anchors that occur twice or more and of the windows inside factors: ``(few, many, found)``.

    ``texts`` has different texts in the column ``text``. Null, empty and short texts have no window; a passage that a text
    repeats counts; without any repeated anchor, as in an empty table, the sets are empty.
    """
    texts, side = texts.select("text"), length - anchor
    counts = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, found = b.column(0).to_pylist(), []
            for lo, hi in portions(own, PORTION):
                _, _, grams, places = windows(*hashed(own[lo:hi]), length, anchor)
                found.append(grams[places])
            if found:
                h, n = _count(np.concatenate(found).astype(np.int64))
                yield store.batch(counts, h=h, n=n)

    repeated = texts.mapInArrow(anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = store.materialize(repeated, "substring-anchors")
    few = shards.write_sorted(repeated.where(F.col("n") <= most), f"{path}/few", "h")
    many = shards.write_sorted(repeated.where(F.col("n") > most), f"{path}/many", "h")
    kind = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("left", pa.int32()), ("right", pa.int32())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            for lo, hi in portions(own, PORTION):
                flat, bounds = hashed(own[lo:hi])
                starts, smallest, grams, places = windows(flat, bounds, length, anchor)
                if not len(starts):
                    continue
                hashes, where = np.unique(grams[places], return_inverse=True)
                places = places[(few.find(hashes.astype(np.int64)) >= 0)[where]]
                if len(places):
                    text_of = np.searchsorted(bounds, places, side="right") - 1
                    left = np.minimum(places - bounds[text_of], side)
                    right = np.minimum(bounds[text_of + 1] - places - anchor, side)
                    padded = np.concatenate([np.zeros(side, np.uint64), flat, np.zeros(side, np.uint64)])
                    for at in range(0, len(places), 4096):
                        p = places[at : at + 4096]
                        rows = np.ascontiguousarray(padded[p[:, None] + np.arange(2 * side + anchor)[None, :]])
                        size = rows.shape[1] * 8
                        data = pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer((np.arange(len(p) + 1, dtype=np.int32) * size).tobytes()), pa.py_buffer(rows.tobytes())])
                        yield store.batch(kind, h=grams[p].astype(np.int64), n=np.ones(len(p), np.int64), words=data, left=left[at : at + 4096], right=right[at : at + 4096])
                if not many.n:
                    continue
                hashes, where = np.unique(smallest, return_inverse=True)
                hot = starts[(many.find(hashes.astype(np.int64)) >= 0)[where]]
                if len(hot):
                    key, check = window_keys(flat, length)
                    # A hot window's check travels in the two columns that it doesn't need.
                    h, check, n = _count(key[hot], check[hot])
                    yield store.batch(kind, h=h, n=n, words=pa.nulls(len(h), pa.binary()), left=(check >> 16).astype(np.int32), right=(check & 0xFFFF).astype(np.int32))

    sent = texts.mapInArrow(segments, "h long, n long, words binary, left int, right int")
    grouped = sent.repartition("h").sortWithinPartitions("h")
    window = pa.schema([("h", pa.int64()), ("check", pa.int64())])

    def parse(rows: pa.Table) -> pa.RecordBatch:
        """Keys of the windows inside the factors of whole blocks."""
        h = rows.column("h").to_numpy()
        words = np.frombuffer(b"".join(rows.column("words").to_pylist()), np.uint64).reshape(len(rows), -1)
        marked = repeated_factors(h, words, rows.column("left").to_numpy().astype(np.int64), rows.column("right").to_numpy().astype(np.int64), length, anchor)
        some = marked.any(axis=1)
        key, check, _ = _count(*(x[marked[some]] for x in window_keys(words[some], length)))
        return store.batch(window, h=key, check=check)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[pa.RecordBatch] = []
        # Counts of hot windows of the last key so far, by check; a few numbers whatever the number of rows.
        hot_key, hot = None, {}
        for b in batches:
            is_block = b.column("words").is_valid()
            rest = b.filter(pa.compute.invert(is_block))
            if rest.num_rows:
                checks = (rest.column("left").to_numpy().astype(np.int64) << 16) + rest.column("right").to_numpy()
                h, n = rest.column("h").to_numpy(), rest.column("n").to_numpy()
                order = np.lexsort((checks, h))
                first = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (checks[order][1:] != checks[order][:-1])]))
                sums = np.add.reduceat(n[order], first)
                out: list[tuple[int, int]] = []
                for key, check, times in zip(h[order][first].tolist(), checks[order][first].tolist(), sums.tolist()):
                    if key != hot_key:
                        out += [(hot_key, c) for c, t in hot.items() if t > 1]
                        hot_key, hot = key, {}
                    hot[check] = hot.get(check, 0) + times
                if out:
                    yield store.batch(window, h=[x for x, _ in out], check=[x for _, x in out])
            b = b.filter(is_block)
            if not b.num_rows:
                continue
            h = b.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], side="left"))
            if cut or (blocks and blocks[-1].column("h")[0].as_py() != h[0]):
                whole = pa.Table.from_batches([*blocks, b.slice(0, cut)])
                blocks = []
                if len(whole):
                    yield parse(whole)
            blocks.append(b.slice(cut))
        if blocks:
            yield parse(pa.Table.from_batches(blocks))
        if last := [c for c, t in hot.items() if t > 1]:
            yield store.batch(window, h=[hot_key] * len(last), check=last)

    keys = grouped.mapInArrow(found, "h long, check long").groupBy("h").agg(F.min("check").alias("check"))
    return few, many, shards.write_sorted(keys, f"{path}/found", "h", "check")


def remove(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_words, n_removed``, and ``kept`` (the words left, joined by one space)
    and ``spans`` (first and last + 1 of each run of removed words), or with ``digest`` only ``kept_sha256``.

    A word goes where a window of ``length`` words that covers it starts at two or more places of the input, in one
    document or several; repeated rows count as documents, so copies of ``length`` words or more lose all. Null and empty
    texts have no words, and shorter texts than ``length`` lose none. Null keys stay null. An empty table gives an empty
    result.
    """
    texts = store.materialize(distinct_texts(docs, text), "substring-texts")
    few, many, dup = duplicate_windows(texts, store.fresh_path(docs.sparkSession, "substrings"), length, anchor, most)
    fields = [("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    fields += [("kept_sha256", pa.string())] if digest else [("kept", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]
    schema = pa.schema(fields)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, copies, own = [b.column(i).to_pylist() for i in (0, 1)], b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi in portions(own, PORTION):
                flat, bounds = hashed(own[lo:hi])
                starts, smallest, _, _ = windows(flat, bounds, length, anchor)
                covered = np.zeros(len(flat) + 1, np.int64)
                if len(starts):
                    hashes, where = np.unique(smallest, return_inverse=True)
                    hashes = hashes.astype(np.int64)
                    starts = starts[((few.find(hashes) >= 0) | (many.find(hashes) >= 0))[where]]
                if len(starts):
                    at, check = window_keys(flat, length)
                    rank, confirmed = dup.find(at[starts], columns=True)
                    starts = starts[(rank >= 0) & (confirmed == check[starts])]
                    np.add.at(covered, starts, 1)
                    np.add.at(covered, starts + length, -1)
                gone = np.cumsum(covered)[:-1] > 0
                rows: dict[str, list] = {f.name: [] for f in schema}
                for i in range(lo, hi):
                    a, z = bounds[i - lo], bounds[i - lo + 1]
                    lost = gone[a:z] if copies[i] == 1 or z - a < length else np.ones(z - a, bool)
                    n, words = int(lost.sum()), own[i].encode().split()
                    joined = b" ".join([words[k] for k in np.flatnonzero(~lost)] if n else words)
                    rows["k1"].append(keys[0][i])
                    rows["k2"].append(keys[1][i])
                    rows["n_words"].append(len(words))
                    rows["n_removed"].append(n)
                    if digest:
                        rows["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                    else:
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
                        rows["kept"].append(joined.decode())
                        rows["spans"].append(edges.reshape(-1, 2).tolist())
                yield store.batch(schema, **rows)

    kind = "k1 long, k2 long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept string, spans array<array<long>>")
    cleaned = texts.select("k1", "k2", "n", "text").mapInArrow(clean, kind)
    return docs.select(F.col(key).cast("long").alias("doc_id"), *text_key(text)).join(cleaned, ["k1", "k2"]).drop("k1", "k2")
