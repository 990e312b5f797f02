"""Words of whole texts as numbers: hashes by word, and rolling hashes of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 63-bit values of 64-bit ones."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _FACTOR
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


#: By byte: whether it is white space; below, the value that stands for it, and the same for both cases of A to Z.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: By byte: whether it is ASCII but neither a letter nor a digit.
MARKS = np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _FACTOR)
_FOLDED = _VALUES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
#: Bytes beyond which a word gets its XXH64: polynomials modulo 2**64 are weak on long patterns.
LONG = 1000


def word_hashes(texts: list[bytes], fold: bool = True, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of the words of all texts in order, with ``fold`` A-Z as a-z, and each text's number of words.

    ``breaks`` tells by byte what stands between words, the line feed among it.
    A word's hash is a polynomial of its bytes' values modulo 2**64, mixed, so that whole batches are hashed at once.
    """
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    inside = ~breaks[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    text_starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
    counts = np.diff(np.searchsorted(starts, text_starts))
    if not len(starts):
        return np.zeros(0, np.int64), counts
    first = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _FACTOR))
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        found = mixed(np.add.reduceat((_FOLDED if fold else _VALUES)[raw[inside]] * powers[place], first)).astype(np.int64)
    for i in np.flatnonzero(lengths > LONG):
        word = joined[starts[i] : starts[i] + lengths[i]]
        found[i] = xxhash.xxh64_intdigest(word.lower() if fold else word) >> 1
    return found, counts


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` values along the last axis, put together from runs of powers of two."""
    n = values.shape[-1]
    if n < length:
        return np.zeros((*values.shape[:-1], 0), np.uint64)
    power, size = values.astype(np.uint64), 1
    power = (power ^ (power >> np.uint64(15))) * _MIX
    out, done, rest = None, 0, length
    factor = _FACTOR
    while rest:
        if rest & 1:
            # ``out`` covers the first ``done`` values of a run; ``power`` continues it.
            tail = power[..., done:]
            out = power if out is None else out[..., : tail.shape[-1]] * factor + tail[..., : out.shape[-1]]
            done += size
        rest >>= 1
        if rest:
            power = power[..., :-size] * factor + power[..., size:]
            size *= 2
            factor = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return mixed(out[..., : n - length + 1])


def sliding(values: np.ndarray, length: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over all windows of ``length`` values."""
    n = len(values) - length + 1
    if n <= 0:
        return values[:0]
    power, size = values, 1
    while size * 2 <= length:
        power = pick(power[:-size], power[size:])
        size *= 2
    return pick(power[:n], power[length - size : length - size + n])
