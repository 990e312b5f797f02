"""Spelling variant grouping by errata-trie merging.

Words that differ by one inserted, deleted or replaced character share what stands before and after it. So words are dealt
by a stretch of places where that character may be: a block holds words of one length, or one more, that agree
before and behind the stretch. The blocks of a length's stretches cover all its places, and a pair is found in the
block of the first place where it differs, once. A block of too many characters has its stretch halved, again
and again if need be; one of a single place is as small as the alphabet, so no block is unbounded.

In a block the words' middles form a trie. At each node of its heavy paths the subtrees of the light children are merged,
with the node's character replaced or skipped, into one errata trie, which is walked along the heavy child and the
node itself, and each light child along the heavy one's children: the smaller subtrees are visited, never the
larger. Terminals that coincide are pairs of one edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import store

RUNS = re.compile("[a-zÀ-ÿ]+")
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Characters of all middles of a block above which its stretch of places is halved.
BLOCK = 100_000


def planted(doc: str, run: str) -> str:
    """``run`` without one code point if 97 divides the crc32 of ``doc:run``."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    return run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, text: str = "text", doc: str = "doc_id", change: Callable[[str, str], str] | None = None) -> DataFrame:
    """The different words of whole texts and how often each occurs: ``word, n``.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, of at least ``least_length`` code points and
    ``least_count`` occurrences in all rows; repeated rows count again. A null text has none. ``change`` may replace a run by
    another, given the document's id as text (null: empty) and the lower-cased run. An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([*found]), pa.array([*found.values()], pa.int64())], names=["word", "n"])
            found.clear()
            return made

        for b in batches:
            for name, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                if text:
                    for run, n in Counter(RUNS.findall(text.encode().lower().decode())).items():
                        if len(run) >= least_length:
                            word = change(name, run) if change else run
                            if len(word) >= least_length:
                                found[word] += n
                if len(found) > COUNTED:
                    yield full()
        if found:
            yield full()

    rows = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A trie as arrays: children, number of words below and the word that ends, by node; children follow their parents."""

    def __init__(self) -> None:
        self.kids: list[dict[str, int]] = [{}]
        self.size = [0]
        self.ends: list[list[int]] = [[]]

    def step(self, node: int, char: str) -> int:
        """The child by a character, made if need be."""
        kid = self.kids[node].get(char)
        if kid is None:
            kid = self.kids[node][char] = len(self.kids)
            self.kids.append({})
            self.size.append(0)
            self.ends.append([])
        return kid

    def add(self, word: str, name: int) -> None:
        """A word, with its number."""
        node = 0
        self.size[0] += 1
        for char in word:
            node = self.step(node, char)
            self.size[node] += 1
        self.ends[node].append(name)

    def merge(self, other: Trie, node: int) -> None:
        """The subtree of another trie's node, laid onto this trie from its root."""
        todo = [(node, 0)]
        while todo:
            theirs, own = todo.pop()
            self.ends[own] += other.ends[theirs]
            todo += [(kid, self.step(own, char)) for char, kid in other.kids[theirs].items()]


def coinciding(small: Trie, at: int, large: Trie, there: int) -> Iterator[tuple[list[int], list[int]]]:
    """Words that end at the same place of two subtrees; visits no more than the first has."""
    todo = [(at, there)]
    while todo:
        a, b = todo.pop()
        if small.ends[a] and large.ends[b]:
            yield small.ends[a], large.ends[b]
        kids = large.kids[b]
        todo += [(kid, kids[char]) for char, kid in small.kids[a].items() if char in kids]


def one_edit_pairs(middles: list[str], places: int) -> Iterator[tuple[int, int, int]]:
    """Pairs of different words, by number, with one character skipped or replaced where they first differ, and that place.

    Places from ``places`` on don't count. A pair with a skipped character names the longer word first.
    """
    trie = Trie()
    for i, word in enumerate(middles):
        trie.add(word, i)
    level = [(0, 0)]
    while level:
        node, depth = level.pop()
        kids = trie.kids[node]
        if depth >= places or not kids:
            continue
        level += [(kid, depth + 1) for kid in kids.values()]
        heavy_char, heavy = max(kids.items(), key=lambda x: trie.size[x[1]]) if len(kids) > 1 else next(iter(kids.items()))
        # The heavy child's character skipped, against what ends here and against each light child.
        yield from ((x, y, depth) for x in trie.ends[heavy] for y in trie.ends[node])
        if len(kids) == 1:
            continue
        light = [(char, kid) for char, kid in kids.items() if kid != heavy]
        for char, kid in light:
            if char in trie.kids[heavy]:
                yield from ((x, y, depth) for ys, xs in coinciding(trie, kid, trie, trie.kids[heavy][char]) for x in xs for y in ys)
        errata = Trie()
        for _, kid in light:
            errata.merge(trie, kid)
        # Replaced: light ones against each other, and against the heavy child.
        if len(light) > 1:
            for ends in errata.ends:
                yield from ((x, y, depth) for i, x in enumerate(ends) for y in ends[i + 1 :])
        yield from ((x, y, depth) for xs, ys in coinciding(errata, 0, trie, heavy) for x in xs for y in ys)
        # Skipped: light ones against what begins at this node by another character.
        yield from ((x, y, depth) for xs, ys in coinciding(errata, 0, trie, node) for x in xs for y in ys if middles[x][depth : depth + 1] != middles[y][depth : depth + 1])


def block_pairs(words: list[str], shorter: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Pairs of a block's words, by number, that first differ at a place from ``low`` on before ``high``, with one edit.

    At least one of a pair has ``shorter`` characters. Words that only share the block's hash are kept apart.
    """
    behind, apart = max(0, shorter - high), {}
    for i, w in enumerate(words):
        apart.setdefault((w[:low], w[len(w) - behind :]), []).append(i)
    for own in apart.values():
        for x, y, depth in one_edit_pairs([words[i][low : len(words[i]) - behind] for i in own], high - low) if len(own) > 1 else ():
            a, b, place = words[own[x]], words[own[y]], low + depth
            # A middle that ends says nothing of what follows: such a pair may differ later, and belongs there.
            if min(len(a), len(b)) == shorter and a[place : place + 1] != b[place : place + 1]:
                yield own[x], own[y]


def near_pairs(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """All pairs of words with one inserted, deleted or replaced code point, once each: ``a, a_n, b, b_n``.

    ``words`` has different words and their counts, ``word, n``; null words have no partner. An empty table gives an
    empty result.
    """
    size = F.col("shorter")
    half = F.floor((size + 1) / 2).cast("int")
    stretch = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    rows = words.where("word <> ''").withColumn("shorter", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    rows = rows.withColumn("part", F.explode(F.array(stretch(F.lit(0), half), stretch(half, size + 1)))).select("word", "n", "shorter", "part.low", "part.high")
    found = None
    while True:
        behind = F.greatest(F.lit(0), size - F.col("high"))
        key = F.xxhash64(F.expr("substring(word, 1, low)"), F.when(behind > 0, F.expr("right(word, greatest(0, shorter - high))")).otherwise(""))
        rows = rows.where("high > low").withColumn("key", key)
        names = ["shorter", "low", "high", "key"]
        each = rows.groupBy(*names).agg(F.sum(F.length("word") - F.col("low") - behind).alias("chars"), F.count("*").alias("rows"))
        large = store.materialize(each.where((F.col("chars") > most) & (F.col("high") - F.col("low") > 1)).select(*names), "large_blocks")
        split = not large.isEmpty()
        fits = rows.join(large, names, "left_anti") if split else rows
        blocks = fits.groupBy(*names).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1)
        pairs = blocks.select("shorter", "low", "high", "words").mapInArrow(_pairs, "a string, a_n long, b string, b_n long")
        found = pairs if found is None else found.unionByName(pairs)
        if not split:
            return found
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        rows = rows.join(large, names).withColumn("part", F.explode(F.array(stretch(F.col("low"), middle), stretch(middle, F.col("high")))))
        rows = store.materialize(rows.select("word", "n", "shorter", "part.low", "part.high"), "halved_blocks")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])
    for batch in batches:
        out: list[list] = [[], [], [], []]
        column = batch.column("words")
        words, counts, edges = column.values.field("word").to_pylist(), column.values.field("n").to_pylist(), column.offsets.to_pylist()
        for shorter, low, high, first, last in zip(*(batch.column(c).to_pylist() for c in ("shorter", "low", "high")), edges[:-1], edges[1:], strict=True):
            for x, y in block_pairs(words[first:last], shorter, low, high):
                for to, value in zip(out, (words[first + x], counts[first + x], words[first + y], counts[first + y])):
                    to.append(value)
            if len(out[0]) > 50_000:
                yield store.batch(schema, **dict(zip(schema.names, out)))
                out = [[], [], [], []]
        if out[0]:
            yield store.batch(schema, **dict(zip(schema.names, out)))


def group_variants(words: DataFrame, ratio: int = 2, most: int = BLOCK) -> DataFrame:
    """Each word's form and root: ``word, form, root, n, n_near, form_n``.

    Of the words one edit away, ``n_near`` of them, the one of largest count, ties by code points, is the form if it occurs
    at least ``ratio`` times as often as the word (over 1, so that forms never run in a circle). The root is where
    forms lead to in the end, the word itself if it has none. ``words`` are different words and their counts. An
    empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1")
    words = store.materialize(words.select("word", "n"), "words")
    pairs = store.materialize(near_pairs(words, most), "near_words")
    both = pairs.select(F.col("a").alias("of"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("of").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    holds = -F.col("best.less") >= F.col("n") * ratio
    formed = words.join(best, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")
    )
    formed = store.materialize(formed, "forms")
    roots = roots_of(formed.where("form IS NOT NULL").select("word", "form")).select(F.col("word").alias("of"), "root")
    return formed.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots_of(links: DataFrame) -> DataFrame:
    """Where links from ``word`` to ``form`` lead to in the end: ``word, root``. Each round doubles the steps taken."""
    now = links.select("word", F.col("form").alias("root"))
    while True:
        now = store.materialize(now, "roots")
        then = now.select(F.col("word").alias("of"), F.col("root").alias("further"))
        if now.join(then, F.col("root") == F.col("of"), "left_semi").isEmpty():
            return now
        now = now.join(then, F.col("root") == F.col("of"), "left").select("word", F.coalesce("further", "root").alias("root"))
