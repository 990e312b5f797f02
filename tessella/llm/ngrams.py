"""Language-model scoring with an Elias-Fano n-gram trie of order three.

Level 1 holds the words by hash, with counts. Levels 2 and 3 hold, for each context in order, its successors in order:
contexts and successors are Elias-Fano sequences, and so are the monotone pointers from a context to its successors. A
context of level 2 is a word, one of level 3 the position of a pair in level 2. A successor in level 3 isn't stored as a
word but as its rank among the successors of the context's last word in level 2, which is a smaller number; a search for
it is a successor search relative to that context. Beside each entry lie its count and its quantised probability.

Probabilities are interpolated with absolute discounting: an entry has (count - D) / count of its context, rounded down to
a step of the quantiser, and what a context's entries leave of 1 weighs the next shorter context; level 1 is the additive
estimate of a word. So probabilities over all words add up to 1, quantised or not.

A level is counted in one shuffle: tasks count their texts' keys in order and hand on blocks of them by range, with bounds
from a sample of the keys; the tasks of the ranges add them up and write shards, which the tasks that score map into
memory. Every lookup of a lot of texts passes all shards, so lots are of millions of tokens: each distinct word, pair and
triple of a lot is looked up once, and what tokens hold is which of these they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.bits import EliasFano, gather
from tessella.llm.shards import MANIFEST, SortedShards, load_packed, load_set, opened, packed, sets_of, sorted_shards
from tessella.llm.words import word_hashes

#: The token that ends each text: no word holds a line end.
END = xxhash.xxh64_intdigest(b"\n") >> 1
#: Discount, and the quantiser: bits, and log10 a step.
DISCOUNT, BITS, STEP = 0.75, 12, 0.002
#: Entries of a level's shard, which bounds what a task that writes it holds.
LEVEL_SHARD = 1 << 21
#: Characters hashed at once, which bounds a task's arrays.
PORTION = 3_000_000
#: Tokens that a task counts or looks up at once, entries that one adds up at once, and keys that the driver samples.
COUNTED, HELD, SAMPLED = 1 << 21, 1 << 21, 1 << 17
#: Queries that a level answers at once: as a lot's are in order, those of a slice lie in few shards.
SLICE = 1 << 19


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down; the least code stands for all that are smaller."""
    return np.minimum(np.ceil(-np.log10(p) / STEP - 1e-9), (1 << BITS) - 1).astype(np.int64)


_PROBABILITIES = np.power(10.0, -STEP * np.arange(1 << BITS))


def probability(codes: np.ndarray) -> np.ndarray:
    """The probabilities of codes."""
    return _PROBABILITIES[codes]


def slices(n: int) -> list[slice]:
    """Parts of ``n`` queries."""
    return [slice(at, min(at + SLICE, n)) for at in range(0, n, SLICE)]


@dataclass
class LevelShard:
    """One range of a level: contexts, pointers, successors, codes, counts, and each context's sum of probabilities here."""

    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    span: int
    codes: tuple[np.ndarray, int]
    counts: tuple[np.ndarray, int]
    masses: np.ndarray

    @classmethod
    def build(cls, context: np.ndarray, symbol: np.ndarray, count: np.ndarray, codes: np.ndarray) -> list[np.ndarray]:
        """The words to store for entries in order of context and symbol; ``count`` may be empty where nothing extends them."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        own = context[first]
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        span = int(symbol.max()) + 1
        masses = np.add.reduceat(probability(codes), first)
        parts = [np.array([span, len(first)], np.uint64), masses.view(np.uint64)]
        parts += EliasFano.build(own - own[0]).parts() + EliasFano.build(np.append(first, len(context))).parts()
        parts += EliasFano.build(rank * span + symbol).parts()
        return parts + packed(codes) + packed(count)

    @classmethod
    def load(cls, words: np.ndarray) -> LevelShard:
        span, n = int(words[0]), int(words[1])
        masses, at = words[2 : 2 + n].view(np.float64), 2 + n
        found = []
        for read in (EliasFano.load, EliasFano.load, EliasFano.load, load_packed, load_packed):
            x, at = read(words, at)
            found.append(x)
        return cls(*found[:3], span, *found[3:], masses)


@dataclass
class Level:
    """A level's shards in order, by the first context and symbol of each.

    A context whose successors span shards is listed in ``split`` (in order), with its first position and whole mass.
    """

    contexts_at: np.ndarray
    symbols_at: np.ndarray
    paths: list[str]
    ranks: np.ndarray
    n: int
    split: np.ndarray
    split_start: np.ndarray
    split_mass: np.ndarray

    def _deal(self, context: np.ndarray, symbol: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Which queries each shard answers; shards without a query cost nothing."""
        lead = self.contexts_at
        at = np.searchsorted(lead, context, side="right") - 1
        # Within contexts that begin a shard the symbol decides.
        some = np.flatnonzero((at >= 0) & (lead[np.maximum(at, 0)] == context))
        some = some[np.argsort(context[some], kind="stable")]
        for own in np.split(some, np.flatnonzero(np.diff(context[some])) + 1) if len(some) else ():
            lo, hi = np.searchsorted(lead, context[own[0]], side="left"), np.searchsorted(lead, context[own[0]], side="right")
            at[own] = lo - 1 + np.searchsorted(self.symbols_at[lo:hi], symbol[own], side="right")
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], 0) :]
        for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else ():
            yield int(at[own[0]]), own

    def find(self, context: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of entries (-1 where absent) and their probabilities (0 where absent)."""
        at, p = np.full(len(context), -1, np.int64), np.zeros(len(context))
        for some in slices(len(context)):
            self._find(context[some], symbol[some], at[some], p[some])
        return at, p

    def _find(self, context: np.ndarray, symbol: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
        known = np.flatnonzero((context >= 0) & (symbol >= 0) & (self.n > 0))
        for i, own in self._deal(context[known], symbol[known]):
            own = known[own]
            shard = opened(self.paths[i], LevelShard.load)
            # Neighbouring queries often have one context: it is looked up once.
            asked = context[own] - self.contexts_at[i]
            first = np.flatnonzero(np.diff(asked, prepend=-1))
            c = np.repeat(shard.contexts.find(asked[first]), np.diff(np.append(first, len(asked))))
            ok = (c >= 0) & (symbol[own] < shard.span)
            own, c = own[ok], c[ok]
            place = shard.successors.find(c * shard.span + symbol[own])
            hit = place >= 0
            own, place = own[hit], place[hit]
            at[own] = place + self.ranks[i]
            p[own] = _PROBABILITIES[gather(*shard.codes, place)]

    def contexts(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each context's first successor, and the sum of its successors' probabilities; (-1, 0) where it has none."""
        start, mass = np.full(len(context), -1, np.int64), np.zeros(len(context))
        for some in slices(len(context)):
            self._contexts(context[some], start[some], mass[some])
        return start, mass

    def _contexts(self, context: np.ndarray, start: np.ndarray, mass: np.ndarray) -> None:
        known = np.flatnonzero((context >= 0) & (self.n > 0))
        for i, own in self._deal(context[known], np.full(len(known), 1 << 62)):
            own = known[own]
            shard = opened(self.paths[i], LevelShard.load)
            c = shard.contexts.find(context[own] - self.contexts_at[i])
            own, c = own[c >= 0], c[c >= 0]
            start[own] = shard.pointers.get(c).astype(np.int64) + self.ranks[i]
            mass[own] = shard.masses[c]
        if len(self.split):
            place = np.minimum(np.searchsorted(self.split, context), len(self.split) - 1)
            own = self.split[place] == context
            start[own], mass[own] = self.split_start[place[own]], self.split_mass[place[own]]


def _block(c: np.ndarray, s: np.ndarray, n: np.ndarray) -> bytes:
    """Counts by key, in order of the keys, in the fewest bytes a column."""
    columns = []
    for x in (np.diff(c, prepend=c[0]), s, n):
        kind = next(t for t in ("<u1", "<u2", "<u4", "<i8") if int(x.max()) <= np.iinfo(t).max)
        columns.append(x.astype(kind))
    return b"".join([np.array([len(c), c[0], *(x.itemsize for x in columns)], "<i8").tobytes(), *(x.tobytes() for x in columns)])


def _unblock(data: bytes) -> list[np.ndarray]:
    n, first, *sizes = np.frombuffer(data, "<i8", 5).tolist()
    columns, at = [], 40
    for size in sizes:
        columns.append(np.frombuffer(data, "<i8" if size == 8 else f"<u{size}", n, at).astype(np.int64))
        at += size * n
    return [np.cumsum(columns[0]) + first, *columns[1:]]


def _added(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Counts of several blocks by key, in order, equal keys added up."""
    c, s, n = (np.concatenate(x) for x in zip(*blocks, strict=True))
    width = int(s.max()) + 1
    least = int(c.min())
    order = in_order((c - least) * width + s) if int(c.max()) - least < (1 << 62) // width else np.lexsort((s, c))
    c, s = c[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])]))
    return [c[first], s[first], np.add.reduceat(n[order], first)]


@dataclass
class Lot:
    """Texts whose tokens are looked up at once: distinct tokens in order, which of them each token is, and the texts' bounds.

    ``rows`` are the texts' other columns.
    """

    rows: list[pa.RecordBatch]
    distinct: np.ndarray
    where: np.ndarray
    bounds: np.ndarray


def in_order(key: np.ndarray) -> np.ndarray:
    """The positions of whole numbers from 0 on in order of these, equal ones in order of position.

    Numbers with their positions below them are sorted several times as fast as positions by them; where both don't fit
    in 63 bits the last bits of the numbers are left out, which seldom matters, and is seen.
    """
    bits = len(key).bit_length()
    drop = max(0, int(key.max(initial=0)).bit_length() + bits - 63)
    order = key >> drop
    order <<= bits
    order |= np.arange(len(key))
    order.sort()
    order &= (1 << bits) - 1
    if drop:
        found = key[order]
        if (found[1:] < found[:-1]).any():
            return np.argsort(key, kind="stable")
    return order


def distinct_keys(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of some in order, which of them each is, and the first position of each, in few bytes."""
    order = in_order(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    where, number = np.empty(len(key), np.int32), np.cumsum(new, dtype=np.int32)
    number -= 1
    where[order] = number
    return key[new], where, order[new].astype(np.int32)


def lots(batches: Iterator[pa.RecordBatch], most: int, text: str = "text") -> Iterator[Lot]:
    """The tokens of all texts, in lots that end with the portion of texts that brings them to ``most`` tokens."""
    rows, tokens, sizes = [], [], []

    def lot() -> Lot:
        distinct, where, _ = distinct_keys(np.concatenate(tokens))
        found = Lot([*rows], distinct, where, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
        for held in (rows, tokens, sizes):
            held.clear()
        return found

    for b in batches:
        others = [n for n in b.schema.names if n != text]
        chars = np.cumsum(pc.fill_null(pc.utf8_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(chars)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]) if b.num_rows else ():
            hashes, bounds = tokens_of(b.column(text).slice(lo, hi - lo).to_pylist())
            tokens.append(hashes)
            sizes.append(np.diff(bounds))
            if others:
                # Rows are copied, as a slice would hold the whole batch.
                rows.append(b.select(others).take(pa.array(np.arange(lo, hi))))
            if sum(map(len, tokens)) >= most:
                yield lot()
    if tokens:
        yield lot()


class Counting:
    """Counts keys ``c, s`` of all texts by range: ``keys_of`` gives those of a lot, each once and in order, and their counts."""

    def __init__(self, texts: DataFrame):
        self.texts, self.sample = texts, None
        chars, docs = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
        self.docs, self.tokens = docs, chars // 6 + docs + 1
        self.parts = max(1, -(-self.tokens // HELD), min(64, self.tokens // (1 << 15)))

    def bounds(self, keys_of) -> tuple[np.ndarray, np.ndarray]:
        """Keys that cut all into ranges of about equal sizes, from a sample whose size doesn't grow."""
        share = min(1.0, max(SAMPLED / self.tokens, 200 / max(1, self.docs)))
        step, most = max(1, int(share * self.tokens) // SAMPLED), COUNTED
        if self.sample is None:
            # Few texts: written once and read by few tasks, as each looks its words up in all shards.
            self.sample = store.materialize(self.texts.sample(share, seed=1).repartition(8), "ngrams-sample")

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lot in lots(batches, most):
                c, s, n = keys_of(lot)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)[::step]) for x in (c, s)], names=["c", "s"])

        found = self.sample.mapInArrow(some, "c long, s long").toArrow()
        c, s = (found.column(i).to_numpy() for i in (0, 1))
        order = np.lexsort((s, c))[np.linspace(0, len(c), self.parts, endpoint=False, dtype=np.int64)[1:]] if len(c) else np.zeros(0, np.int64)
        c, s, _, _ = distinct_pairs(c[order], s[order])
        return c, s

    def counts(self, keys_of, bounds: tuple[np.ndarray, np.ndarray], write, kind: str) -> DataFrame:
        """What ``write`` makes of each range's keys and counts, which it gets as sorted arrays."""

        most = COUNTED

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lot in lots(batches, most):
                c, s, n = keys_of(lot)
                at = np.searchsorted(c, bounds[0], side="left")
                to = np.searchsorted(c, bounds[0], side="right")
                cuts = [0, *(a + int(np.searchsorted(s[a:b], v)) if b > a else a for a, b, v in zip(at.tolist(), to.tolist(), bounds[1].tolist())), len(c)]
                rows = [(i, _block(c[a:b], s[a:b], n[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                del lot, c, s, n
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["range", "block"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, held, least = [], 0, HELD
            for b in batches:
                for x in b.column(0):
                    waiting.append(_unblock(x.as_py()))
                    held += len(waiting[-1][0])
                    if held >= least:
                        waiting = [_added(waiting)]
                        held = len(waiting[0][0])
                        least = max(HELD, 2 * held)
            if waiting:
                yield from write(*_added(waiting))

        sent = self.texts.mapInArrow(count, "range int, block binary")
        return sent.repartitionById(len(bounds[0]) + 1, "range").select("block").mapInArrow(add, kind)


def _write_level(counting: Counting, keys_of, path: str, context_counts, shard: int = LEVEL_SHARD, counted: bool = True) -> Level:
    """Count and write a level's entries, contexts and symbols; counts are stored where ``counted``. The driver gathers a row a shard."""
    kind = "part int, n long, c0 long, s0 long, c1 long, mass0 double, mass1 double, path string"
    schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("c0", pa.int64()), ("s0", pa.int64()), ("c1", pa.int64()), ("mass0", pa.float64()), ("mass1", pa.float64()), ("path", pa.string())])

    def write(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, at in enumerate(range(0, len(columns[0]), shard)):
            context, symbol, n = (x[at : at + shard] for x in columns)
            codes = quantise((n - DISCOUNT) / context_counts(context))
            uri = f"{path}/part-{part:06d}-{number:06d}.lvl"
            parts = LevelShard.build(context, symbol, n if counted else n[:0], codes)
            masses = parts[1].view(np.float64)
            store.write_shard(uri, [np.ascontiguousarray(x).tobytes() for x in parts])
            yield store.batch(schema, part=[part], n=[len(n)], c0=[int(context[0])], s0=[int(symbol[0])], c1=[int(context[-1])], mass0=[float(masses[0])], mass1=[float(masses[-1])], path=[uri])

    found = sorted(counting.counts(keys_of, counting.bounds(keys_of), write, kind).collect(), key=lambda r: (r["c0"], r["s0"]))
    counts = np.array([r["n"] for r in found], np.int64)
    ranks = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    start: dict[int, int] = {}
    mass: dict[int, float] = {}
    for i, (a, b) in enumerate(zip(found, found[1:])):
        if a["c1"] == b["c0"]:
            c = a["c1"]
            if c not in mass:
                own = opened(a["path"], LevelShard.load)
                start[c], mass[c] = int(own.pointers.get(np.array([own.contexts.n - 1]))[0]) + int(ranks[i]), a["mass1"]
            mass[c] += b["mass0"]
    split = sorted(start)
    lead = (np.array([r[x] for r in found], np.int64) for x in ("c0", "s0"))
    return Level(*lead, [r["path"] for r in found], ranks, int(counts.sum()), np.array(split, np.int64), np.array([start[c] for c in split], np.int64), np.array([mass[c] for c in split]))


@dataclass
class Trie:
    """The three levels; ``tokens`` counts all training tokens, words and ends."""

    words: SortedShards
    pairs: Level | None
    triples: Level | None

    @property
    def tokens(self) -> int:
        return self.words.total

    def base(self, count: np.ndarray) -> np.ndarray:
        """The additive estimate of tokens by their counts."""
        return (count + 0.5) / (self.tokens + 0.5 * (self.words.n + 1))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends among them, and where each text begins, and the end."""
    hashes, counts = word_hashes([(t or "").encode() for t in texts])
    return np.insert(hashes, np.cumsum(counts), END), np.concatenate([[0], np.cumsum(counts + 1)])


@dataclass
class Tokens:
    """A lot's tokens looked up in a trie: distinct words, then distinct pairs, then distinct triples, each once and in order.

    A token's pair is the word before it and its own, its triple the pair of the token before it and its own. Words before
    are numbers among the lot's distinct words, as pairs before are among its pairs; -1 where a text begins. Words have
    their ids in order of their hashes, so the numbers are in the trie's order.
    """

    trie: Trie
    where: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, trie: Trie, lot: Lot) -> Tokens:
        """Ids (-1 where unknown) and counts of the distinct words; ``first`` are the tokens that begin a text."""
        return cls(trie, lot.where, lot.bounds[:-1], *trie.words.find(lot.distinct, columns=True))

    def _key(self, before: np.ndarray) -> np.ndarray:
        """Each token's word and what the token before has, in one; 0 stands for none before."""
        key = np.zeros(len(before), np.int64)
        key[1:] = before[:-1]
        key[1:] += 1
        key[self.first] = 0
        key *= len(self.ids)
        key += self.where
        return key

    def _ids(self, number: np.ndarray) -> np.ndarray:
        return np.where(number >= 0, self.ids[number], -1)

    def pairs(self) -> None:
        """The distinct pairs: the word before and the word as numbers, and which of them each token has."""
        key, self.pair, _ = distinct_keys(self._key(self.where))
        self.before = (key // len(self.ids) - 1).astype(np.int32)
        self.word = (key % len(self.ids)).astype(np.int32)

    def find_pairs(self) -> np.ndarray:
        """Position of each pair in level 2 and its probability, which is returned, and the start and mass of each word as a context."""
        self.at, p = self.trie.pairs.find(self._ids(self.before), self._ids(self.word))
        self.start, self.mass = self.trie.pairs.contexts(self.ids)
        return p

    def triples(self) -> None:
        """The distinct triples: the pair before and the pair as numbers, and which of them each token has."""
        # A pair before and a word tell the word's pair.
        key, self.triple, at = distinct_keys(self._key(self.pair))
        self.pair_before, self.own_pair = (key // len(self.ids) - 1).astype(np.int32), self.pair[at]

    def triple_keys(self, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Triples' pairs before by position in level 2, and own pairs as ranks among their contexts' successors; -1 where either is missing."""
        before, pair = self.pair_before[some], self.own_pair[some]
        context, relative = self.at[before], self.at[pair]
        missing = (before < 0) | (context < 0) | (relative < 0)
        relative -= self.start[self.before[pair]]
        context[missing] = relative[missing] = -1
        return context, relative

    def probabilities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base probabilities of the distinct words, the model's of pairs or triples, and which of these each token has."""
        base = self.trie.base(self.counts)
        if not (self.trie.pairs and self.trie.pairs.n):
            return base, base, self.where
        self.pairs()
        p = self.find_pairs()
        p = p + (1.0 - np.where(self.before >= 0, self.mass[self.before], 0.0)) * base[self.word]
        if not (self.trie.triples and self.trie.triples.n):
            return base, p, self.pair
        self.triples()
        mass, out = self.trie.triples.contexts(self.at)[1], np.empty(len(self.own_pair))
        for some in slices(len(out)):
            before, own = self.pair_before[some], self.trie.triples.find(*self.triple_keys(some))[1]
            out[some] = own + (1.0 - np.where(before >= 0, mass[before], 0.0)) * p[self.own_pair[some]]
        return base, out, self.triple


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of whole numbers from -1 on in order, which of them each pair is, and how often each occurs."""
    width = int(b.max(initial=0)) + 2
    if int(a.max(initial=0)) + 2 < (1 << 62) // width:
        key, where, n = np.unique((a + 1) * width + b + 1, return_inverse=True, return_counts=True)
        return key // width - 1, key % width - 1, where, n
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
    where = np.empty(len(a), np.int64)
    where[order] = np.cumsum(new) - 1
    return a[order][new], b[order][new], where, np.bincount(where)


def train(docs: DataFrame, path: str, text: str = "text") -> Trie:
    """A trie of all texts: every word, pair and triple, counted whole.

    Three passes count words, then pairs of words, then triples as a pair and a successor of its last word; each counts
    within its tasks before the shuffle, and a key is two longs, so no number of words or pairs is too large. Null and
    empty texts are an end alone; repeated rows count each; an empty table gives levels without entries.
    """
    counting = Counting(docs.select(F.col(text).cast("string").alias("text")))
    # Words' hashes are even, so no sample is needed.
    even = np.arange(1, counting.parts, dtype=object) * (1 << 63) // counting.parts
    even = (even.astype(np.int64), np.zeros(len(even), np.int64))
    words = sorted_shards(counting.counts(lambda lot: (lot.distinct, np.zeros(len(lot.distinct), np.int64), np.bincount(lot.where)), even, lambda c, s, n: sets_of(iter([(c, n)]), f"{path}/words"), MANIFEST))
    trie = Trie(words, None, None)

    def pair_keys(lot: Lot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = Tokens.of(trie, lot)
        found.pairs()
        some = np.flatnonzero(found.before >= 0)
        return found.ids[found.before[some]], found.ids[found.word[some]], np.bincount(found.pair)[some]

    def word_counts(ids: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(ids, return_inverse=True)
        return _column_at(words, distinct)[where]

    trie.pairs = _write_level(counting, pair_keys, f"{path}/pairs", word_counts)

    def triple_keys(lot: Lot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = Tokens.of(trie, lot)
        found.pairs()
        found.find_pairs()
        found.triples()
        (context, relative), n = found.triple_keys(), np.bincount(found.triple)
        del found
        some = context >= 0
        return context[some], relative[some], n[some]

    def pair_counts(positions: np.ndarray) -> np.ndarray:
        distinct, where = np.unique(positions, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        shard = np.searchsorted(trie.pairs.ranks, distinct, side="right") - 1
        for i in np.unique(shard):
            own = shard == i
            out[own] = gather(*opened(trie.pairs.paths[i], LevelShard.load).counts, distinct[own] - trie.pairs.ranks[i])
        return out[where]

    trie.triples = _write_level(counting, triple_keys, f"{path}/triples", pair_counts, counted=False)
    return trie


def _column_at(words: SortedShards, ranks: np.ndarray) -> np.ndarray:
    """The counts of words by id."""
    out = np.zeros(len(ranks), np.int64)
    shard = np.searchsorted(words.ranks, ranks, side="right") - 1
    for i in np.unique(shard):
        own = shard == i
        _, column = opened(words.paths[i], load_set)
        out[own] = gather(*column, ranks[own] - words.ranks[i])
    return out


def token_probabilities(trie: Trie, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base probabilities and model probabilities of tokens of texts."""
    found = Tokens.of(trie, Lot([], *distinct_keys(tokens)[:2], bounds))
    base, p, which = found.probabilities()
    return found.counts[found.where], base[found.where], p[which]


def score(docs: DataFrame, trie: Trie, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, the columns of ``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Scores are log10 probabilities of the whole text and its end, by the words alone and by the trie. Null and empty
    texts have one token, the end. With a trie of no text every token has the probability of an unknown one. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *keep)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # Kept columns may have any name, also these.
    numbered = ["0", "text", *(str(2 + i) for i in range(len(keep)))]

    most = COUNTED

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in lots((pa.RecordBatch.from_arrays(b.columns, names=numbered) for b in batches), most):
            found = Tokens.of(trie, lot)
            base, p, which = found.probabilities()
            sums = [np.add.reduceat(x[at], lot.bounds[:-1]) for x, at in (((found.counts > 0).astype(np.int64), found.where), (np.log10(base), found.where), (np.log10(p), which))]
            rows = pa.concat_batches(lot.rows)
            columns = [*rows.columns, pa.array(np.diff(lot.bounds)), pa.array(sums[0]), pa.array(np.full(rows.num_rows, trie.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            del lot, found, base, p, which
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *keep, *(n for n, _ in fields[1:])])

    kind = ", ".join(["doc_id long", *(f"`{k}` {types[k]}" for k in keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    return rows.mapInArrow(each, kind)
