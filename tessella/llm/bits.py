"""Fixed-width bit packing and Elias-Fano sequences, both vectorised with numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def width_of(largest: int) -> int:
    """Bits that hold every value up to ``largest``; 1 at least."""
    return max(1, int(largest).bit_length())


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits (1 to 57) in little-endian bit order, as uint64 words; 64 values fill ``width`` words."""
    n = len(values)
    blocks = -(-n // 64)
    lanes = np.zeros(blocks * 64, U64)
    lanes[:n] = values
    lanes = np.ascontiguousarray(lanes.reshape(blocks, 64).T)
    out = np.zeros((width, blocks), U64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        out[word] |= lanes[lane] << U64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[lane] >> U64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)


def unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` values of packed words."""
    blocks = -(-n // 64)
    rows = np.ascontiguousarray(words[: blocks * width].reshape(blocks, width).T)
    out, mask = np.empty((64, blocks), U64), U64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = rows[word] >> U64(shift)
        if shift + width > 64:
            value = value | (rows[word + 1] << U64(64 - shift))
        out[lane] = value & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def gather(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """The values at any positions, without unpacking the others."""
    bit = at.astype(np.int64) * width
    word, shift = bit >> 6, bit & 63
    out = words[word] >> shift.view(U64)
    over = np.flatnonzero(shift > 64 - width)
    if len(over):
        out[over] |= words[word[over] + 1] << (64 - shift[over]).view(U64)
    out &= U64((1 << width) - 1)
    return out


def _bytes_of(byte: int) -> np.uint64:
    """A word of eight equal bytes."""
    return U64(byte * 0x0101010101010101)


_ONES, _ODD, _PAIRS, _LOW, _TOP = (_bytes_of(b) for b in (0x01, 0x55, 0x33, 0x0F, 0x80))
_ALL = U64(0xFFFFFFFFFFFFFFFF)
#: By rank and byte, the position of the byte's set bit number ``rank``.
_SELECT = np.zeros((8, 256), np.uint8)
for _byte in range(256):
    for _rank, _at in enumerate(i for i in range(8) if _byte >> i & 1):
        _SELECT[_rank, _byte] = _at


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The position of the set bit number ``rank`` (from 0) of each word: running bit counts of its bytes tell the byte, a table the rest."""
    rank = rank.astype(U64)
    sums = word - ((word >> U64(1)) & _ODD)
    sums = (sums & _PAIRS) + ((sums >> U64(2)) & _PAIRS)
    sums = ((sums + (sums >> U64(4))) & _LOW) * _ONES
    full = (((rank * _ONES) | _TOP) - sums) & _TOP
    at = np.bitwise_count(full).astype(U64) << U64(3)
    left = rank - (((sums << U64(8)) >> at) & U64(0xFF))
    return at.view(np.int64) + _SELECT[left.view(np.int64), ((word >> at) & U64(0xFF)).view(np.int64)]


class EliasFano:
    """A non-decreasing sequence of integers below ``2**63`` in about 2 + log2(universe / n) bits a value.

    The low bits are packed; the high bits are written in unary, a 1 for each value and a 0 for each step of the high
    part. ``search`` finds successors by selecting the two zeros that bound a high part and halving within its few values.
    ``zeros`` counts the zeros before every second word, and all; it is stored too, so that loading touches no other word.
    The high bits are fewer than 2**32.
    """

    def __init__(self, n: int, low_width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_width, self.low, self.high, self.zeros = n, low_width, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = np.asarray(values, U64)
        top = int(values[-1]) if n else 0
        low_width = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        low = pack(values & U64((1 << low_width) - 1), low_width) if low_width and n else np.zeros(1, U64)
        at = (values >> U64(low_width)).astype(np.int64) + np.arange(n, dtype=np.int64)
        bits = np.zeros((((int(at[-1]) if n else 0) // 64 + 2) // 2 + 1) * 128, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        return cls(n, low_width, low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(~high).astype(np.int64).reshape(-1, 2).sum(axis=1))]).astype(np.uint32))

    def _select(self, before: np.ndarray, flip: np.uint64, rank: np.ndarray) -> np.ndarray:
        """Where the bit number ``rank`` lies, by the counts of such bits before every second word; ``flip`` makes them ones."""
        block = np.searchsorted(before, rank.astype(np.uint32), side="right") - 1
        word, rest = block << 1, rank - before[block]
        bits = self.high[word] ^ flip
        here = np.bitwise_count(bits)
        on = np.flatnonzero(rest >= here)
        if len(on):
            word[on] += 1
            rest[on] -= here[on]
            bits[on] = self.high[word[on]] ^ flip
        return (word << 6) + _select_in_word(bits, rest)

    def _entries(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry and end of the entries with each high part: the ones between the zeros that bound it."""
        top = int(self.zeros[-1])
        rank = np.minimum(part, top) - 1
        begin = np.where(rank >= 0, self._select(self.zeros, _ALL, np.maximum(rank, 0)) + 1, 0)
        first = begin - rank - 1
        # The entries of one part are few: the next zero mostly lies in the same word.
        word = begin >> 6
        outside = word >= len(self.high)
        rest = ~self.high[np.minimum(word, len(self.high) - 1)] >> (begin & 63).view(U64)
        rest[outside] = 0
        last = first + np.bitwise_count((rest & (~rest + U64(1))) - U64(1))
        far = np.flatnonzero(rest == 0)
        if len(far):
            last[far] = self.n
            far = far[part[far] < top]
            rank = part[far]
            last[far] = self._select(self.zeros, _ALL, rank) - rank
        beyond = part > top
        if beyond.any():
            first[beyond] = last[beyond] = self.n
        return first, last

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at positions ``at``."""
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, U64)
        ones = (np.arange(len(self.zeros), dtype=np.uint32) << np.uint32(7)) - self.zeros
        high = (self._select(ones, U64(0), at) - at).astype(U64)
        return high << U64(self.low_width) | (gather(self.low, self.low_width, at) if self.low_width else U64(0))

    def _bounds(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The position of each value's successor, the ends of its high part's entries, and its low bits."""
        part = (values >> U64(self.low_width)).astype(np.int64)
        first, last = self._entries(part)
        rest = values & U64((1 << self.low_width) - 1)
        lo, hi = first.copy(), last.copy()
        left = np.flatnonzero(lo < hi) if self.low_width else np.zeros(0, np.int64)
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            below = gather(self.low, self.low_width, mid) < rest[left]
            lo[left] = np.where(below, mid + 1, lo[left])
            hi[left] = np.where(below, hi[left], mid)
            left = left[lo[left] < hi[left]]
        return lo, first, last, rest

    def search(self, values: np.ndarray) -> np.ndarray:
        """For each value, the number of entries below it: the position of its successor."""
        values = np.asarray(values, U64)
        if not self.n or not len(values):
            return np.zeros(len(values), np.int64)
        return self._bounds(values)[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """A position of each value, -1 where it is absent."""
        values = np.asarray(values, U64)
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        lo, hi = self._entries((values >> U64(self.low_width)).astype(np.int64))
        if not self.low_width:
            return np.where(lo < hi, lo, -1)
        at = np.full(len(values), -1, np.int64)
        # Halving, with those that are found or ruled out left behind.
        left = np.flatnonzero(lo < hi)
        lo, hi, rest = lo[left], hi[left], values[left] & U64((1 << self.low_width) - 1)
        while len(left):
            mid = (lo + hi) >> 1
            low = gather(self.low, self.low_width, mid)
            hit = low == rest
            at[left[hit]] = mid[hit]
            below = low < rest
            lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
            on = np.flatnonzero((lo < hi) & ~hit)
            left, lo, hi, rest = left[on], lo[on], hi[on], rest[on]
        return at

    def parts(self) -> list[np.ndarray]:
        """The arrays to store; ``load`` takes them back."""
        zeros = np.append(self.zeros, np.zeros(len(self.zeros) % 2, np.uint32)).view(U64)
        return [np.array([self.n, self.low_width, len(self.low), len(self.high)], U64), self.low, self.high, zeros]

    @classmethod
    def load(cls, words: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence stored from word ``at`` on, and the word after it."""
        n, low_width, lows, highs = (int(x) for x in words[at : at + 4])
        low, high = at + 4 + lows, at + 4 + lows + highs
        end = high + (highs // 2 + 2) // 2
        return cls(n, low_width, words[at + 4 : low], words[low:high], words[high:end].view(np.uint32)[: highs // 2 + 1]), end
