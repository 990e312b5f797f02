"""Tokenizing whole texts quickly: white-space chunks are encoded once a worker, and their ids joined.

No token of the two public tokenizers used here spans the place between a character that isn't white space and an ASCII
white-space character, so a text's ids are those of its chunks in order. Texts with other white space, for which that
doesn't hold in general, are encoded whole, and so are texts that hold the string of an added token, such as
``<|endoftext|>``, which the file turns into that token's id wherever it stands. Vocabulary files are named by path and
never copied.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: A run of ASCII white space and what follows it up to the next such run.
CHUNK = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
WORDS = re.compile(r"[^\t-\r ]+")
#: A chunk that keeps its ids beside the separator.
PLAIN = re.compile(r"[\t\x0b-\r ]?[^\t-\r \x01]+").fullmatch
#: White space beyond ASCII, as Python or the tokenizers' regular expressions know it.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
#: Bounds of what a worker remembers between batches: chunks and their characters.
MOST_CHUNKS, MOST_CHARS = 1_000_000, 16_000_000


class _Numbers(dict):
    """Chunk to number; an unseen chunk gets the next number and waits in ``new`` to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, chunk: str) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        self.chars += len(chunk)
        return number


class ChunkEncoder:
    """Encodes texts as a tokenizer file does. ``drops_space``: the tokenizer ignores white space, so chunks leave it out."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # Added tokens that are looked for in the normalised text can come from other strings, so every text counts as odd.
        self.whole = any(t.normalized for t in added)
        self.largest = self.tokenizer.get_vocab_size(with_added_tokens=True) - 1
        spaced = [self._ids(x) for x in ("a b", " a\n b", "a")]
        self.drops_space = spaced[0] == spaced[1] == spaced[2] + self._ids("b")
        self.split = (WORDS if self.drops_space else CHUNK).findall
        self.between = " \x01 " if self.drops_space else "\n"
        self.mark = self._ids(self.between)
        self._forget()

    def _odd(self, text: str) -> bool:
        """Whether a text's ids may differ from those of its chunks."""
        return self.whole or any(x in text for x in self.added) or ODD_SPACE.search(text) is not None

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one after another, and of each chunk their place there and number. Chunks are encoded joined by a separator where that is sure, which costs half as much."""
        ids, start, length, used = [], np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), 0
        plain = [i for i, x in enumerate(chunks) if PLAIN(x)] if len(self.mark) == 1 else []
        rest = sorted({*range(len(chunks))}.difference(plain))
        for lo in range(0, len(plain), 1000):
            part = plain[lo : lo + 1000]
            text = self.between.join([chunks[i] for i in part])
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.concatenate([[-1], np.flatnonzero(found == self.mark[0]), [len(found)]])
            if len(cuts) == len(part) + 1:
                start[part], length[part] = cuts[:-1] + 1 + used, np.diff(cuts) - 1
                ids.append(found)
                used += len(found)
            else:
                rest += part
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            start[i], length[i] = used, len(x.ids)
            ids.append(np.array(x.ids, "<u4"))
            used += len(x.ids)
        return np.concatenate(ids), start, length

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if new:
            ids, start, length = self._encode_chunks(new)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(self.flat), len(ids)), "<u4")])
            self.flat[self.used : self.used + len(ids)] = ids
            self.starts, self.lengths = np.concatenate([self.starts, start + self.used]), np.concatenate([self.lengths, length])
            self.used += len(ids)

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """Each text's ids and the end id, as little-endian uint32; a null text is empty."""
        if len(self.numbers) > MOST_CHUNKS or self.numbers.chars > MOST_CHARS:
            self._forget()
        number, get, counts, odd = [], self.numbers.__getitem__, [], {}
        for i, text in enumerate(texts):
            text = text or ""
            if self._odd(text):
                odd[i], own = np.array([*self._ids(text), end], "<u4"), []
            else:
                own = self.split(text)
            number.extend(map(get, own))
            counts.append(len(own))
        self._learn()
        number = np.array(number, np.int64)
        lengths = self.lengths[number]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[number] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
        last = np.array([end], "<u4")
        return [odd[i] if i in odd else np.concatenate([ids[a:b], last]) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file and Python worker."""
    return ChunkEncoder(path)


def portions(texts: list[str | None], most_chars: int = 4_000_000):
    """Index ranges of texts with about ``most_chars`` characters each, so that a batch's working memory is bounded."""
    at, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= most_chars:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
