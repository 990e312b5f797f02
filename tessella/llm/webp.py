"""Lossless WebP for media columns: a reader of the whole VP8L format, and a writer of 8-bit samples.

The reader follows RFC 9649: prefix codes in groups, back-references, the colour cache, and the inverse of the predictor,
cross-colour, subtract-green and palette transforms. An image with one group of codes is parsed at every bit position at
once: what would be read there and where the next symbol would begin; following those jumps from the first bit, sixteen
symbols a step, gives the symbols of the image. Images with several groups are read symbol by symbol.

The writer stores samples in the green channel with prefix codes of their frequencies and back-references to earlier
pixels, and samples of at most 16 values as a palette with several pixels in one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
LENGTHS, DISTANCES, CACHE_FACTOR, MOST_SIDE = 24, 40, 0x1E35A7BD, 16384
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Reads a byte string's bits from the lowest of each byte on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > 8 * len(self.data):
            raise ValueError("the image ends early")
        value = self.peek(n)
        self.at += n
        return value

    def peek(self, n: int) -> int:
        """The next ``n`` bits, zeros beyond the end."""
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + (n + 14 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")


def reversed_bits(code: int, n: int) -> int:
    """The ``n`` lowest bits of ``code``, the other way round."""
    return int(format(code, f"0{n}b")[::-1], 2) if n else 0


@lru_cache(maxsize=16)
def _backwards(n: int) -> np.ndarray:
    """All codes of ``n`` bits, each the other way round."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


class Prefix:
    """A canonical prefix code by the lengths of its symbols' codes."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.symbols = used[np.argsort(lengths[used], kind="stable")]
        self.lengths = lengths[self.symbols]
        self.only = int(used[0]) if len(used) == 1 else None
        self.bits = 0 if self.only is not None else int(self.lengths[-1])
        if self.only is None and int((1 << (self.bits - self.lengths)).sum()) != 1 << self.bits:
            raise ValueError("a prefix code that isn't complete")
        self._table: list[int] | None = None

    def table(self) -> np.ndarray:
        """By the next ``bits`` bits, the symbol that they begin with, times 16, and its length."""
        if self.only is not None:
            return np.array([self.only << 4], np.int32)
        ordered = np.repeat((self.symbols << 4 | self.lengths).astype(np.int32), 1 << (self.bits - self.lengths))
        return ordered[_backwards(self.bits)]

    def codes(self, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """By symbol, its code as written and the code's length."""
        code, size = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
        if self.only is None:
            first = np.cumsum(1 << (self.bits - self.lengths)) - (1 << (self.bits - self.lengths))
            code[self.symbols], size[self.symbols] = _backwards(self.bits)[first], self.lengths
        return code, size

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self._table is None:
            self._table = self.table().tolist()
        found = self._table[bits.peek(self.bits)]
        bits.skip(found & 15)
        return found >> 4


@lru_cache(maxsize=512)
def _single(symbol: int) -> Prefix:
    """The code of one symbol."""
    return Prefix(np.arange(symbol + 1) == symbol)


def _read_prefix(bits: Bits, symbols: int) -> Prefix:
    lengths = [0] * symbols
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return _single(first)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    of_lengths = [0] * 19
    for i in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[i] = bits.read(3)
    code = Prefix(of_lengths)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    at, last = 0, 8
    if len(code.symbols) == 16 and code.bits == 4 and code.symbols[-1] == 15:
        # All lengths have codes of four bits: they are read at once.
        most = min(most, symbols)
        nibbles = np.frombuffer(bits.read(4 * most).to_bytes(most // 2 + 1, "little"), np.uint8)
        lengths = np.zeros(symbols, np.int64)
        lengths[:most] = _backwards(4)[np.stack([nibbles & 15, nibbles >> 4], axis=1).reshape(-1)[:most]]
        return Prefix(lengths)
    while at < symbols and most > 0:
        most -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            at += 1
            last = n or last
        else:
            times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
            for _ in range(times):
                if at >= symbols:
                    raise ValueError("code lengths beyond the alphabet")
                lengths[at] = last if n == 16 else 0
                at += 1
    return Prefix(lengths)


def _long_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


#: Bytes whose bit positions are parsed at once.
PARSED = 1 << 16


@lru_cache(maxsize=4)
def _near_distances(width: int) -> np.ndarray:
    """By distance code less 1, the distance in pixels of the near ones."""
    near = np.array(NEAR, np.int64)
    return np.maximum(1, near[:, 0] + near[:, 1] * width)


def _long_values(symbol: np.ndarray, window: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distance codes of their symbols, whose further bits begin at ``at``, and where those end."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    more = window[at].astype(np.int64) & ((1 << extra) - 1)
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + more) + 1, at + extra


def _symbols(bits: Bits, group: list[Prefix], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The symbols that make ``n`` pixels, in runs: green symbols, pixels of literals, lengths and distance codes, places in the image."""
    green, red, blue, alpha, distance = ((x.table(), (1 << x.bits) - 1) for x in group)
    data = np.concatenate([np.frombuffer(bits.data, np.uint8), np.zeros(32, np.uint8)]).astype(np.uint32)
    at = 0
    while at < n:
        if bits.at >= 8 * len(bits.data):
            raise ValueError("the image ends early")
        byte = bits.at >> 3
        raw = data[byte : byte + PARSED + 19]
        words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        # 25 bits from every bit on; a symbol with all its further bits takes less than 12 bytes.
        window = (words[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)
        end = 8 * (len(words) - 15)
        found = green[0][window[:end] & green[1]]
        symbol, after = found >> 4, np.arange(end) + (found & 15)
        constant, plain, several = 0, None, []
        for (table, mask), shift in ((red, 16), (blue, 0), (alpha, 24)):
            if mask:
                plain = np.flatnonzero(symbol < 256) if plain is None else plain
                channel = np.zeros(end, np.int32)
                channel[plain] = table[window[after[plain]] & mask]
                after[plain] += channel[plain] & 15
                several.append((channel, shift))
            else:
                constant |= (int(table[0]) >> 4) << shift

        def copy_of(own: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
            """Lengths, distance codes and ends of back-references from the place after their length symbols on."""
            length, to = _long_values(symbol[own] - 256, window, begin)
            code = distance[0][window[to] & distance[1]]
            return length, *_long_values(code >> 4, window, to + (code & 15))

        copies = np.flatnonzero((symbol >= 256) & (symbol < 256 + LENGTHS))
        if len(copies):
            after[copies] = copy_of(copies, after[copies])[2]
        # Sixteen symbols a step from the first one, then all between them side by side.
        jump = np.append(np.minimum(after, end), end)
        one = jump
        for _ in range(4):
            jump = jump[jump]
        heads, place, view = [], bits.at & 7, memoryview(jump)
        while place < end:
            heads.append(place)
            place = view[place]
        rows = np.empty((16, len(heads)), np.int64)
        rows[0] = heads
        for k in range(1, 16):
            rows[k] = one[rows[k - 1]]
        own = rows.T.reshape(-1)
        own = own[: np.searchsorted(own, end)]
        kind = symbol[own]
        length, back = np.ones(len(own), np.int64), np.zeros(len(own), np.int64)
        copies = np.flatnonzero((kind >= 256) & (kind < 256 + LENGTHS))
        if len(copies):
            length[copies], back[copies], _ = copy_of(own[copies], own[copies] + (found[own[copies]] & 15))
        ends = np.cumsum(length) + at
        last = int(np.searchsorted(ends, n))
        own, kind, length, back, ends = (x[: last + 1] for x in (own, kind, length, back, ends))
        pixel = kind.astype(np.uint32) << np.uint32(8) | np.uint32(constant)
        for channel, shift in several:
            pixel |= (channel[own] >> 4).astype(np.uint32) << np.uint32(shift)
        bits.at = 8 * byte + int(after[own[-1]])
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends early")
        yield kind, pixel, length, back, ends - length
        at = int(ends[-1])
    if at > n:
        raise ValueError("a back-reference outside the image")


def _cache_slot(pixels: np.ndarray, cache_bits: int) -> np.ndarray:
    return (pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)


def _one_group(bits: Bits, group: list[Prefix], width: int, n: int, cache_bits: int) -> np.ndarray:
    """The pixels of an image with one group of codes: literals of a run at once, back-references and cached colours in order."""
    if group[0].only is not None and all(c.only is not None for c in group[1:4]):
        if group[0].only >= 256:
            raise ValueError("an image without literals")
        red, blue, alpha = (c.only for c in group[1:4])
        return np.full(n, alpha << 24 | red << 16 | group[0].only << 8 | blue, np.uint32)
    out, near = np.zeros(n, np.uint32), _near_distances(width)
    cache, cached_to = np.zeros(1 << cache_bits, np.uint32), 0
    for symbol, pixel, length, back, place in _symbols(bits, group, n):
        literal = symbol < 256
        out[place[literal]] = pixel[literal]
        distance = np.where(back > len(NEAR), back - len(NEAR), near[np.clip(back, 1, len(NEAR)) - 1])
        events = np.flatnonzero(~literal)
        for s, m, d, p in zip(*(x[events].tolist() for x in (symbol, length, distance, place)), strict=True):
            if s < 256 + LENGTHS:
                if d > p or p + m > n:
                    raise ValueError("a back-reference outside the image")
                out[p : p + m] = out[p - d : p - d + m] if d >= m else np.resize(out[p - d : p], m)
            else:
                # The cache holds the last pixel of each slot so far.
                cache[_cache_slot(out[cached_to:p], cache_bits)] = out[cached_to:p]
                cached_to = p
                out[p] = cache[s - 256 - LENGTHS]
    return out


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB in uint32, in scan order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    tiles, tile_bits, groups = None, 0, 1
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        across = -(-width >> tile_bits)
        tiles = _image(bits, across, -(-height >> tile_bits), False) >> 8 & 0xFFFF
        groups = int(tiles.max()) + 1
        tiles = tiles.tolist()
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[_read_prefix(bits, n) for n in (256 + LENGTHS + cached, 256, 256, 256, DISTANCES)] for _ in range(groups)]
    n = width * height
    if groups == 1 and (codes[0][0].bits or all(c.only is not None for c in codes[0][:4])):
        return _one_group(bits, codes[0], width, n, cache_bits)
    out, at, cache = [0] * n, 0, [0] * cached
    while at < n:
        group = codes[tiles[(at // width >> tile_bits) * across + (at % width >> tile_bits)] if tiles else 0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTHS:
            length = _long_value(bits, s - 256)
            code = _long_value(bits, group[4].read(bits))
            if code > len(NEAR):
                distance = code - len(NEAR)
            else:
                distance = max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
            if distance > at or at + length > n:
                raise ValueError("a back-reference outside the image")
            own = out[at - distance : at]
            new = (own * (-(-length // len(own))))[:length]
        else:
            new = [cache[s - 256 - LENGTHS]]
        out[at : at + len(new)] = new
        at += len(new)
        if cache_bits:
            for x in new:
                cache[(CACHE_FACTOR * x & 0xFFFFFFFF) >> (32 - cache_bits)] = x
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue as columns."""
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _half(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def _nearer(left, top, corner):
    """Of left and top, the one nearer to left + top - corner."""
    to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
    to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
    return left if to_left < to_top else top


def _clip(x):
    return 0 if x < 0 else 255 if x > 255 else x


def _predict(mode: int, left, top, right, corner):
    """The predicted pixel from its neighbours: left, top, top right and top left, for the modes that need the left one."""
    match mode:
        case 5:
            return _half(_half(left, right), top)
        case 6:
            return _half(left, corner)
        case 7:
            return _half(left, top)
        case 10:
            return _half(_half(left, corner), _half(top, right))
        case 11:
            return _nearer(left, top, corner)
        case 12:
            return [_clip(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
        case 13:
            mean = _half(left, top)
            return [_clip(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]
    raise ValueError("a mode that needs no pixel to the left")


#: Modes that need no pixel of their own row, by the neighbours that they average.
_ABOVE = {2: "t", 3: "r", 4: "c", 8: "ct", 9: "tr"}


def _add_predicted(argb: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """Rows from the top on; stretches of a row that need only the row above, or sums from the left, are added at once."""
    rest, across = _channels(argb).reshape(height, width, 4), -(-width >> bits)
    modes = (modes >> 8 & 15).reshape(-1, across).tolist()
    rest[0, 0] += (255, 0, 0, 0)
    rest[0] = np.cumsum(rest[0], axis=0) & 0xFF
    for y in range(1, height):
        above, row = rest[y - 1], rest[y]
        # The pixel to the top right of a row's last one is the row's first one, which follows in scan order.
        row[0] = (row[0] + above[0]) & 0xFF
        right = np.concatenate([above[1:], row[:1]])
        for tile in range(across):
            lo, hi, mode = max(1, tile << bits), min(width, (tile + 1) << bits), modes[y >> bits][tile]
            if lo >= hi:
                continue
            sides = {"t": above[lo:hi], "r": right[lo:hi], "c": above[lo - 1 : hi - 1]}
            if mode == 1:
                row[lo:hi] = (np.cumsum(row[lo:hi], axis=0) + row[lo - 1]) & 0xFF
            elif mode in _ABOVE:
                own = [sides[k] for k in _ABOVE[mode]]
                row[lo:hi] = (row[lo:hi] + (sum(own) >> (len(own) - 1))) & 0xFF
            elif mode in (0, 14, 15):
                row[lo:hi, 0] = (row[lo:hi, 0] + 255) & 0xFF
            else:
                left = row[lo - 1].tolist()
                for x, t, r, c in zip(range(lo, hi), *(sides[k].tolist() for k in "trc"), strict=True):
                    guess = _predict(mode, left, t, r, c)
                    left = [(a + b) & 0xFF for a, b in zip(row[x].tolist(), guess, strict=True)]
                    row[x] = left
    return _join(rest.reshape(-1, 4))


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int32) ^ 128) - 128


def _cross(argb: np.ndarray, width: int, height: int, factors: np.ndarray, bits: int) -> np.ndarray:
    across = -(-width >> bits)
    y, x = np.divmod(np.arange(width * height), width)
    own = _channels(factors)[(y >> bits) * across + (x >> bits)]
    red_to_blue, green_to_blue, green_to_red = _signed(own[:, 1]), _signed(own[:, 2]), _signed(own[:, 3])
    c = _channels(argb)
    green = _signed(c[:, 2])
    c[:, 1] = (c[:, 1] + (green_to_red * green >> 5)) & 0xFF
    c[:, 3] = (c[:, 3] + (green_to_blue * green >> 5) + (red_to_blue * _signed(c[:, 1]) >> 5)) & 0xFF
    return _join(c)


def _look_up(argb: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    down = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    index = argb >> 8 & 0xFF
    if down:
        each = 8 >> down
        shifts = np.arange(1 << down, dtype=np.uint32) * each
        index = (index[:, None] >> shifts & ((1 << each) - 1)).reshape(height, -1)[:, :width].reshape(-1)
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """Pixels of a VP8L stream, as (height, width) ARGB in uint32."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless WebP stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, own_width, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            side = _image(bits, -(-own_width >> size), -(-height >> size), False)
            undo.append((_add_predicted if kind == PREDICTOR else _cross, (own_width, height, side, size)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_add_green, ()))
        else:
            n = bits.read(8) + 1
            table = _join(np.cumsum(_channels(_image(bits, n, 1, False)), axis=0))
            undo.append((_look_up, (own_width, height, table)))
            down = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            own_width = -(-own_width >> down)
    argb = _image(bits, own_width, height, True)
    for step, more in reversed(undo):
        argb = step(argb, *more)
    return argb.reshape(height, width)


def _add_green(argb: np.ndarray) -> np.ndarray:
    c = _channels(argb)
    c[:, 1] += c[:, 2]
    c[:, 3] += c[:, 2]
    return _join(c)


def decode_webp(data: bytes) -> np.ndarray:
    """Pixels of a WebP file whose image is lossless, as (height, width) ARGB in uint32."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            return decode_vp8l(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def files(data: bytes) -> list[bytes]:
    """WebP files that follow one another."""
    found, at = [], 0
    while at < len(data):
        size = 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        found.append(data[at : at + size + (size & 1)])
        at += len(found[-1])
    return found


class BitWriter:
    """Writes bits from the lowest of each byte on."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def array(self) -> np.ndarray:
        size = -(-self.n // 8)
        return np.unpackbits(np.frombuffer(self.value.to_bytes(size, "little"), np.uint8), bitorder="little")[: self.n]


def container(stream: bytes) -> bytes:
    """The WebP file of a VP8L stream."""
    pad = len(stream) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + pad) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * pad


#: Longest code that the writer makes; pixels that it compares to find matches, and the shortest and longest match written.
MOST_BITS, MATCH, LEAST_LENGTH, MOST_LENGTH = 12, 8, 16, 4096
#: Largest distance that a symbol can tell.
MOST_DISTANCE = (1 << 20) - len(NEAR)


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of a complete prefix code near the symbols' information: rounded up, then shortened while there is room, the frequent ones first."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    own = counts[used]
    n = np.clip(np.ceil(np.log2(own.sum() / own) - 1e-9), 1, most).astype(np.int64)
    order = np.argsort(-own, kind="stable")
    sizes, room = n[order].tolist(), (1 << most) - int((1 << (most - n)).sum())
    at = len(sizes) - 1
    while room < 0:  # rounding the longest codes down to ``most`` took too much
        at = at if sizes[at] < most else next(i for i in range(len(sizes) - 1, -1, -1) if sizes[i] < most)
        room += 1 << (most - sizes[at] - 1)
        sizes[at] += 1
    for rounds in range(most):
        if not room:
            break
        for i, size in enumerate(sizes):
            if size > 1 and 1 << (most - size) <= room:
                room -= 1 << (most - size)
                sizes[i] = size - 1
    n[order] = sizes
    lengths[used] = n
    return lengths


def _split_value(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of further bits and those bits of lengths or distance codes from 1 on."""
    x = value - 1
    extra = np.where(x < 4, 0, np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 2)
    return np.where(x < 4, x, 2 * extra + (x >> extra)), extra, x & ((1 << extra) - 1)


def matches(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of pixels that repeat earlier ones: the longest stretches of one distance, from the left."""
    none = (np.zeros(0, np.int64),) * 3
    n = len(flat) - MATCH + 1
    if n < 2:
        return none
    words, size = flat.astype(np.uint64), 1
    while size < MATCH:
        words = words[:-size] | words[size:] << np.uint64(8 * size)
        size *= 2
    # Keys of 16 bits sort fastest and are enough for few places.
    wide = n > 1 << 15
    key = ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32 if wide else 48)).astype(np.uint32 if wide else np.uint16)
    order = np.argsort(key, kind="stable")
    before = np.full(n, -1)
    before[order[1:]] = np.where(words[order[1:]] == words[order[:-1]], order[:-1], -1)
    distance = np.where((before >= 0) & (np.arange(n) - before <= MOST_DISTANCE), np.arange(n) - before, 0)
    first = np.flatnonzero(np.diff(distance, prepend=0))
    runs = np.diff(np.append(first, n))
    some = (distance[first] > 0) & (runs > LEAST_LENGTH - MATCH)
    first, runs = first[some], runs[some]
    place, length, end = [], [], 0
    for a, r in zip(first.tolist(), runs.tolist()):
        stop = a + r + MATCH - 1
        a = max(a, end)
        while stop - a >= LEAST_LENGTH:
            m = min(stop - a, MOST_LENGTH)
            place.append(a)
            length.append(m)
            a = end = a + m
    at = np.array(place, np.int64)
    return at, np.array(length, np.int64), distance[np.minimum(at, n - 1)] if len(at) else none[2]


def _joined_bits(head: np.ndarray, value: np.ndarray, size: np.ndarray) -> bytes:
    """Bits of a head, then values of up to 57 bits each, one after another."""
    value, size = np.concatenate([head.astype(np.uint64), value.astype(np.uint64)]), np.concatenate([np.ones(len(head), np.int64), size])
    value, size = value[size > 0], size[size > 0]
    end = np.cumsum(size)
    word, shift = (end - size) >> 6, ((end - size) & 63).astype(np.uint64)
    out = np.zeros((int(end[-1]) >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    over = np.flatnonzero(shift.astype(np.int64) + size > 64)
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    return out.tobytes()[: -(-int(end[-1]) // 8)]


def _put_single(out: BitWriter, symbol: int) -> None:
    """Write the code of one symbol below 256, which takes no bits."""
    wide = int(symbol > 1)
    out.put(1 | wide << 2 | symbol << 3, 11 if wide else 4)


def _put_code(out: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for counts by symbol; its codes and their lengths by symbol."""
    used = np.flatnonzero(counts)
    if len(used) < 2:
        _put_single(out, int(used[0]) if len(used) else 0)
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    lengths = code_lengths(counts)
    out.put(0, 1)  # code lengths follow, each in a code of four bits
    out.put(15, 4)
    for i in CODE_LENGTH_ORDER:
        out.put(4 if i < 16 else 0, 3)
    most = max(2, int(used[-1]) + 1)
    if most < len(counts):
        out.put(1, 1)  # no code lengths beyond the last symbol that has one
        out.put(4, 3)
        out.put(most - 2, 10)
    else:
        out.put(0, 1)
    nibbles = _backwards(4)[np.append(lengths[:most], 0)]
    packed = (nibbles[: most + most % 2 : 2] | nibbles[1 : most + 1 : 2] << 4).astype(np.uint8) if most % 2 == 0 else np.append(nibbles[: most - 1 : 2] | nibbles[1:most:2] << 4, nibbles[most - 1]).astype(np.uint8)
    out.put(int.from_bytes(packed.tobytes(), "little"), 4 * most)
    return Prefix(lengths).codes(len(counts))


def encode_gray(samples: np.ndarray) -> bytes:
    """A lossless WebP file of (height, width) 8-bit samples, in the green channel of opaque pixels.

    At most 16 different samples become a palette, several to a pixel. Pixels that repeat earlier ones are
    back-references; the codes follow the frequencies of the image's own symbols.
    """
    height, width = samples.shape
    pixels = np.ascontiguousarray(samples, np.uint8)
    values = np.flatnonzero(np.bincount(pixels.reshape(-1), minlength=256))
    out = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(value, n)
    if len(values) <= 16:
        for value, n in ((1, 1), (PALETTE, 2), (len(values) - 1, 8), (0, 1)):
            out.put(value, n)
        # The palette itself: an image of one row, each colour less the one before; only the green differs.
        green = np.diff(values, prepend=0)
        code, size = _put_code(out, np.bincount(green, minlength=256 + LENGTHS))
        _put_single(out, 0)
        _put_single(out, 0)
        opaque, opaque_size = _put_code(out, np.bincount([255, *[0] * (len(values) - 1)], minlength=256))
        _put_single(out, 0)
        for g, a in zip(green.tolist(), [255, *[0] * (len(values) - 1)]):
            out.put(int(code[g]), int(size[g]))
            out.put(int(opaque[a]), int(opaque_size[a]))
        down = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        index = np.searchsorted(values, pixels)
        padded = np.zeros((height, -(-width >> down) << down), np.int64)
        padded[:, :width] = index
        pixels = (padded.reshape(height, -1, 1 << down) << (np.arange(1 << down) * (8 >> down))).sum(axis=2).astype(np.uint8)
    out.put(0, 1)  # no more transforms
    flat = pixels.reshape(-1)
    place, length, distance = matches(flat)
    copied = np.zeros(len(flat) + 1, np.int64)
    np.add.at(copied, place, 1)
    np.add.at(copied, place + length, -1)
    literal = np.flatnonzero(np.cumsum(copied)[:-1] == 0)
    symbol, extra, more = _split_value(length)
    far, far_extra, far_more = _split_value(distance + len(NEAR))
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one group of codes
    code, size = _put_code(out, np.bincount(np.concatenate([flat[literal], 256 + symbol]), minlength=256 + LENGTHS))
    for only in (0, 0, 255):  # red, blue and alpha
        _put_single(out, only)
    far_code, far_size = _put_code(out, np.bincount(far, minlength=DISTANCES))
    value, n = code[256 + symbol], size[256 + symbol]
    for v, k in ((more, extra), (far_code[far], far_size[far]), (far_more, far_extra)):
        value, n = value | v << n, n + k
    order = np.argsort(np.concatenate([literal, place]), kind="stable")
    value = np.concatenate([code[flat[literal]], value])[order]
    n = np.concatenate([size[flat[literal]], n])[order]
    return container(_joined_bits(out.array(), value, n))


def samples_of(argb: np.ndarray) -> np.ndarray:
    """The 8-bit samples of an image written by :func:`encode_gray`."""
    return (argb >> 8 & 0xFF).astype(np.uint8)
