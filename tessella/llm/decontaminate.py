"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of letters, digits and whatever lies beyond ASCII. Every run of ``words``
words of a benchmark item is a window; an item of fewer words is one window. The hashes of all windows go to every
task, which slides over the words of its texts, looks all hashes of a batch up at once, and compares the words of each
hit with those of the window. The windows are broadcast only up to ``most`` bytes; beyond that hashes of both sides
meet by a shuffle, with the same results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.names import free, quoted
from tessella.llm.tokens import portions
from tessella.llm.words import MARKS, runs, word_hashes

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of windows, with their items' ids, up to which they are broadcast.
MOST = 64 << 20
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS = "n_words:bigint,spans:array<struct<first:bigint,last:bigint>>,items:array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased."""
    return WORDS.findall(text.encode().lower()) if text else []


def windows(benchmark: DataFrame, words: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """The different windows of each item: ``window`` (its words, joined by spaces), ``length`` in words, ``item`` as text.

    Texts that are null or have no words have no window; equal windows of one item, and of repeated rows, are one row. A
    null id stays null. An empty table gives an empty result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = words_of(text)
                size = min(words, len(found))
                for lo in range(0, len(found) - size + 1 if found else 0, 1 << 16):
                    made = {b" ".join(found[i : i + size]) for i in range(lo, min(lo + (1 << 16), len(found) - size + 1))}
                    yield pa.RecordBatch.from_pydict({"window": sorted(made), "length": [size] * len(made), "item": [name] * len(made)}, schema)

    schema = pa.schema([("window", pa.binary()), ("length", pa.int32()), ("item", pa.string())])
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "window binary, length int, item string").distinct()


class Windows:
    """Windows of a benchmark as a task sees them: words, and sorted hashes by length."""

    def __init__(self, rows: list[tuple[bytes, str | None]]):
        self.items: dict[bytes, list[str | None]] = {}
        for window, item in rows:
            self.items.setdefault(window, []).append(item)
        by: dict[int, list[bytes]] = {}
        for window in self.items:
            by.setdefault(window.count(b" ") + 1, []).append(window)
        self.keys = {n: np.unique(runs(word_hashes(found, False, MARKS)[0].reshape(-1, n), n).ravel()) for n, found in by.items()}

    def candidates(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of words by text; text, first word and length of all windows whose hash is known."""
        flat, counts = word_hashes(texts, True, MARKS)
        ends = np.cumsum(counts)
        owner = np.repeat(np.arange(len(texts)), counts)
        found = []
        for n, keys in self.keys.items():
            hashes = runs(flat, n)
            if len(hashes):
                place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                at = np.flatnonzero(keys[place] == hashes)
                at = at[at + n <= ends[owner[at]]]
                found.append(np.stack([owner[at], at - (ends - counts)[owner[at]], np.full(len(at), n)]))
        text, first, length = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        return counts, text, first, length


def merged(first: np.ndarray, last: np.ndarray) -> list[dict]:
    """Spans of words, ends included, with those that touch or overlap put together."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > reach[:-1] + 1]) if len(first) else np.zeros(0, bool)
    ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)] if len(first) else reach
    return [{"first": int(a), "last": int(b)} for a, b in zip(first[new], ends)]


def scan(docs: DataFrame, benchmark: DataFrame, words: int = 10, text: str = "text", item: str = "item_id", most: int = MOST) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (first and last hit word, from 0) and ``items`` (ids, as sorted text, of what was hit).

    Each row stays, repeated rows too. A null text, and one without words, has 0 words and no spans. Items with a null id
    hit words but aren't named; items that share an id are one. Columns called like the new ones are replaced; others of
    any name stay. Empty tables, of documents or of items, give no rows or no hits.
    """
    docs = docs.drop("n_words", "spans", "items")
    found = store.materialize(windows(benchmark, words, item), "windows")
    size = found.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 64)).first()[0] or 0
    return _broadcast(docs, found, text) if size <= most else _joined(docs, found, text)


def _broadcast(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in found.select("window", "item").collect()]))

    @F.arrow_udf(f"struct<{_SPANS}>")
    def slide(column: pa.Array) -> pa.Array:
        known, words, spans, items, texts = sent.value, [], [], [], column.to_pylist()
        for lo, hi in portions(texts):
            counts, owner, first, length = known.candidates([(t or "").encode() for t in texts[lo:hi]])
            words.append(counts)
            order = np.argsort(owner, kind="stable")
            edges = np.searchsorted(owner[order], np.arange(hi - lo + 1)).tolist()
            for i in range(hi - lo):
                own = order[edges[i] : edges[i + 1]]
                has = words_of(texts[lo + i]) if len(own) else []
                hits = [(f, f + n - 1, x) for f, n in zip(first[own].tolist(), length[own].tolist()) if (x := known.items.get(b" ".join(has[f : f + n])))]
                spans.append(merged(*np.array([h[:2] for h in hits], np.int64).reshape(-1, 2).T))
                items.append(sorted({x for h in hits for x in h[2] if x is not None}))
        counts = np.concatenate(words) if words else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    name = free(docs, "scanned")
    rows = docs.withColumn(name, slide(F.col(text).cast("string")))
    return rows.select(*quoted(docs), *[F.col(name)[c].alias(c) for c in ("n_words", "spans", "items")])


def _joined(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The same by a shuffle: windows of the different texts meet those of the benchmark by hash, then by their words."""
    lengths = [r[0] for r in found.select("length").distinct().orderBy("length").collect()]

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True):
                has = words_of(t)
                flat = word_hashes([t.encode()], True, MARKS)[0]
                for n in lengths:
                    hashes = runs(flat, n).astype(np.int64)
                    for lo in range(0, len(hashes), 1 << 14):
                        part = hashes[lo : lo + (1 << 14)]
                        yield store.batch(of, k=[k] * len(part), first=np.arange(lo, lo + len(part)), last=np.arange(lo, lo + len(part)) + n - 1, h=part, has=[b" ".join(has[i : i + n]) for i in range(lo, lo + len(part))])

    @F.arrow_udf("bigint")
    def count(column: pa.Array) -> pa.Array:
        return pa.array([len(words_of(t)) for t in column.to_pylist()], pa.int64())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [int(runs(word_hashes([w], False, MARKS)[0], n)[0]) for w, n in zip(b.column("window").to_pylist(), b.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(each, pa.int64())], names=[*b.schema.names, "g"])

    of = pa.schema([("k", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("h", pa.int64()), ("has", pa.binary())])
    key = lambda c: F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)
    different = docs.select(key(F.col(text)).alias("k"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL").groupBy("k").agg(F.first("t").alias("t"))
    known = found.mapInArrow(hashed, "window binary, length int, item string, g long")
    hits = different.mapInArrow(slide, "k string, first long, last long, h long, has binary").join(known, (F.col("h") == F.col("g")) & (F.col("has") == F.col("window")))
    hits = store.materialize(hits.select("k", "first", "last", "item"), "window_hits")
    spans = hits.select("k", "first", "last").distinct().groupBy("k").agg(_spans(F.sort_array(F.collect_list(F.struct("first", "last")))).alias("spans"))
    named = hits.where("item IS NOT NULL").select("k", "item").distinct().groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("items"))
    both = spans.join(named, "k", "left").select(F.col("k").alias("of"), "spans", "items")
    none = [F.array().cast(t) for t in ("array<struct<first:bigint,last:bigint>>", "array<string>")]
    rows = docs.join(both, key(docs[text]) == both["of"], "left")
    return rows.select(
        *[docs[c] for c in quoted(docs)], count(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("n_words"), F.coalesce(both["spans"], none[0]).alias("spans"), F.coalesce(both["items"], none[1]).alias("items")
    )


def _spans(ordered: Column) -> Column:
    """Spans in order of their first words, with those that touch or overlap put together."""
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def add(done: Column, span: Column) -> Column:
        top = F.element_at(done, -1)
        wider = F.struct(top["first"].alias("first"), F.greatest(top["last"], span["last"]).alias("last"))
        joins = (F.size(done) > 0) & (span["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(ordered, none, add)


def n_hit(spans: str = "spans") -> Column:
    """Words that spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", words: int = 10, text: str = "text", item: str = "item_id", most: int = MOST) -> DataFrame:
    """``docs`` without benchmark passages: ``remove="spans"`` takes hit words out of the texts, ``"documents"`` drops hit rows.

    A span goes from the first byte of its first word to the last of its last; a space takes its place. What isn't hit stays
    byte by byte, and clean rows are left as they are; a null text stays null. The columns are those of ``docs``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    found = scan(docs, benchmark, words, text, item, most)
    if remove == "documents":
        return found.where(F.size("spans") == 0).select(*quoted(docs))

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, _without)

    clean = F.when(F.size("spans") > 0, cut(F.col(text).cast("string"), "spans")).otherwise(F.col(text))
    return found.withColumn(text, clean).select(*quoted(docs))


def _without(text: str | None, spans) -> str | None:
    if text is None or not len(spans):
        return text
    raw = text.encode()
    places, out, done = [m.span() for m in WORDS.finditer(raw.lower())], [], 0
    for s in spans:
        out += [raw[done : places[s["first"]][0]], b" "]
        done = places[s["last"]][1]
    return b"".join([*out, raw[done:]]).decode()
