"""Language identification by word-first backoff.

A known word scores its relative log frequency in each language. An unseen word falls back to its character n-grams,
the longest first: the first length at which any of them is known gives the mean of their scores. A document's
language is the one with the largest sum over its words. Words and n-grams are found by hash in sorted arrays, the
distinct words of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.names import free, quoted
from tessella.llm.words import mixed

UNKNOWN = "und"
#: Characters looked at once, which bounds a task's arrays; longer texts are scored in parts and added up.
PORTION = 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: whether it is a letter, as ``str.isalpha`` says."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """A text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _spans(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words, which are runs of letters."""
    edge = np.flatnonzero(np.diff(_letters()[points].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2] - edge[::2]


def words_of(text: str) -> list[str]:
    """The words of a text: runs of letters, lower-cased."""
    lower = text.lower()
    starts, lengths = _spans(code_points(lower))
    return [lower[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist())]


def _values(points: np.ndarray) -> np.ndarray:
    return mixed((points.astype(np.uint64) + np.uint64(1)) * _FACTOR)


def _hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """63-bit hashes of runs of characters by their values."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _FACTOR))
    return mixed(np.add.reduceat(values[np.repeat(starts, lengths) + place] * powers[place], first))


def _hashes_of(strings: list[str]) -> np.ndarray:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    return _hashes(_values(code_points("".join(strings))), np.cumsum(lengths) - lengths, lengths)


@dataclass(frozen=True)
class Table:
    """Known strings of one kind by sorted hash, and of each the languages that have it, with what it adds to their floors."""

    keys: np.ndarray
    bounds: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, strings: list[str], language: np.ndarray, count: np.ndarray, languages: int) -> Table:
        """From counts by string and language. A string that a language lacks counts a tenth of an occurrence."""
        total = np.maximum(np.bincount(language, count, languages), 1.0)
        keys = _hashes_of(strings)
        order = np.lexsort((language, keys))
        keys, language, count = keys[order], language[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        # log10(count / total) less the floor log10(0.1 / total).
        return cls(keys[first], np.append(first, len(keys)), language.astype(np.int32), np.log10(count * 10.0), np.log10(0.1 / total))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, scores: np.ndarray, row: np.ndarray, place: np.ndarray, weight: np.ndarray) -> None:
        """Add the gains of strings, weighted, to rows of ``scores``."""
        sizes = self.bounds[place + 1] - self.bounds[place]
        at = np.repeat(self.bounds[place] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        np.add.at(scores, (np.repeat(row, sizes), self.language[at]), np.repeat(weight, sizes) * self.gain[at])


@dataclass(frozen=True)
class Model:
    """Languages, and what is known: words in ``tables[0]``, n-grams of n characters in ``tables[n]``."""

    languages: list[str]
    tables: list[Table]

    def score_words(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores by word and language; zeros where nothing of a word is known."""
        scores = np.zeros((len(starts), len(self.languages)))
        values = _values(points)
        place = self.tables[0].find(_hashes(values, starts, lengths))
        known = np.flatnonzero(place >= 0)
        scores[known] = self.tables[0].floor
        self.tables[0].add(scores, known, place[known], np.ones(len(known)))
        rest = np.flatnonzero(place < 0)
        # Unseen words between spaces, one after another.
        sizes = lengths[rest] + 2
        begin = np.cumsum(sizes) - sizes
        padded = np.full(int(sizes.sum()), _values(np.array([32]))[0])
        inner = np.repeat(begin + 1 - np.cumsum(lengths[rest]) + lengths[rest], lengths[rest]) + np.arange(int(lengths[rest].sum()))
        padded[inner] = values[np.repeat(starts[rest] - np.cumsum(lengths[rest]) + lengths[rest], lengths[rest]) + np.arange(len(inner))]
        for n in range(len(self.tables) - 1, 0, -1):
            some = sizes >= n
            each = sizes[some] - n + 1
            row = np.repeat(np.flatnonzero(some), each)
            at = np.repeat(begin[some] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            total, power = np.zeros(len(at), np.uint64), _FACTOR
            for j in range(n):
                total += padded[at + j] * power
                power = np.uint64(int(power) * int(_FACTOR) & 0xFFFFFFFFFFFFFFFF)
            place = self.tables[n].find(mixed(total))
            row, place = row[place >= 0], place[place >= 0]
            times = np.bincount(row, minlength=len(rest))
            hit = np.flatnonzero(times)
            scores[rest[hit]] = self.tables[n].floor
            self.tables[n].add(scores, rest[row], place, 1.0 / times[row])
            left = times == 0
            rest, begin, sizes = rest[left], begin[left], sizes[left]
        return scores

    def score(self, word: str) -> np.ndarray:
        """One word's scores."""
        return self.score_words(code_points(word), np.array([0]), np.array([len(word)]))[0]

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the sum of its words' scores by language, and its number of words."""
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        points = code_points("\n".join(texts))
        starts, lengths = _spans(points)
        if len(starts):
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
            owner = np.searchsorted(ends, starts, side="right")
            _, first, where = np.unique(_hashes(_values(points), starts, lengths), return_index=True, return_inverse=True)
            scores = self.score_words(points, starts[first], lengths[first])[where]
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sums[owner[begin]] = np.add.reduceat(scores, begin, axis=0)
            counts = np.bincount(owner, minlength=len(texts))
        return sums, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        sums, counts = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for owner, parts in _parts(texts):
            own, n = self.totals(parts)
            np.add.at(sums, owner, own)
            np.add.at(counts, owner, n)
        odds = np.where(counts > 0, 1.0 / np.power(10.0, sums - sums.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(sums.argmax(axis=1).tolist(), counts.tolist())]
        return names, odds.tolist()


def _parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-cased texts, a bounded number of characters at a time, and whose they are; long ones are cut at what isn't a letter."""
    owner, parts, held = [], [], 0
    for i, text in enumerate(texts):
        lower, at = (text or "").lower(), 0
        while at < len(lower):
            end = min(at + PORTION, len(lower))
            cut = end
            while end < len(lower) and cut > at and lower[cut - 1].isalpha() and lower[cut].isalpha():
                cut -= 1
            cut = cut if cut > at else end
            owner.append(i)
            parts.append(lower[at:cut])
            held, at = held + cut - at, cut
            if held >= PORTION:
                yield owner, parts
                owner, parts, held = [], [], 0
    if parts:
        yield owner, parts


def _grams(longest: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("count", pa.int64())])
        for b in batches:
            counts: Counter[tuple[str, int, str]] = Counter()
            for lang, word, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                padded = f" {word} "
                for n in range(1, longest + 1):
                    for i in range(len(padded) - n + 1):
                        counts[lang, n, padded[i : i + n]] += c
            if counts:
                keys = list(counts)
                yield store.batch(schema, lang=[k[0] for k in keys], n=[k[1] for k in keys], gram=[k[2] for k in keys], count=list(counts.values()))

    return each


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("count", pa.int64())])
    for b in batches:
        counts: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in words_of(text))
        if counts:
            yield store.batch(schema, lang=[k[0] for k in counts], word=[k[1] for k in counts], count=list(counts.values()))


def fit(labelled: DataFrame, rows_a_language: int = 2500, longest: int = 5, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows.

    The sample is bounded: of each language about ``rows_a_language`` rows, drawn by a hash of the key, and all of a
    language that has fewer; their whole texts are counted. The model keeps all words and n-grams of the sample, so what
    the driver gathers and tasks receive is bounded by the sample. Rows without text or language are left out; without
    any row the model knows no language.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.abs(F.xxhash64(F.col(key))) % 1_000_000 / 1e6).toDF("lang", "text", "draw").where("lang IS NOT NULL AND text IS NOT NULL")
    share = {r["lang"]: min(1.0, rows_a_language / r["count"]) for r in rows.groupBy("lang").count().collect()}
    languages = sorted(share)
    if not languages:
        return Model([], [])
    chosen = F.lit(False)
    for name, p in share.items():
        chosen = chosen | ((F.col("lang") == name) & (F.col("draw") < p))
    words = rows.where(chosen).select("lang", "text").mapInArrow(_words, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))
    words = store.materialize(words, "langid-words")
    grams = words.mapInArrow(_grams(longest), "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    kinds = store.materialize(words.select("lang", F.lit(0).alias("n"), F.col("word").alias("gram"), "count").unionByName(grams), "langid-counts")
    tables = []
    for n in range(longest + 1):
        own = kinds.where(F.col("n") == n).select("lang", "gram", "count").toArrow()
        number = {name: i for i, name in enumerate(languages)}
        language = np.array([number[x] for x in own.column("lang").to_pylist()], np.int64)
        tables.append(Table.of(own.column("gram").to_pylist(), language, own.column("count").to_numpy().astype(np.float64), len(languages)))
    return Model(languages, tables)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, each row by its whole text alone; nothing is shuffled.

    ``lang_pred`` is ``und`` with score 0 where the text is null, empty or has no letter, or the model knows no
    language; a text of letters of which nothing is known gets the first language and an even score. The two columns
    replace any of their names.
    """
    guess = free(docs, "guess")
    names = [q for c, q in zip(docs.columns, quoted(docs)) if c.lower() not in ("lang_pred", "score")]
    return docs.withColumn(guess, _guessed(docs, model, text)).select(*names, F.col(guess)["lang_pred"].alias("lang_pred"), F.col(guess)["score"].alias("score"))


def _guessed(docs: DataFrame, model: Model, text: str) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def guess(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            names, odds = shared.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(odds, dtype=float)})

    return F.pandas_udf(guess, "lang_pred string, score double")(F.col(text).cast("string"))


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.5, text: str = "text") -> DataFrame:
    """Documents whose language is known with at least ``least_score``; the columns of ``docs``, of any name.

    Null, empty and letterless texts go; repeated rows all stay or all go; an empty table stays empty.
    """
    guess = free(docs, "guess")
    scored = docs.withColumn(guess, _guessed(docs, model, text))
    return scored.where((F.col(guess)["lang_pred"] != UNKNOWN) & (F.col(guess)["score"] >= least_score)).select(*quoted(docs))
