"""Lossless WebP: streams that use every part of the format, and media columns."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import prose

from tessella.llm import media, webp
from tessella.llm.queries import op10_media_columns


class Writer(webp.BitWriter):
    """Writes streams with all parts of the format; prefix codes are given by their lengths."""

    def code(self, lengths):
        """A normal prefix code; returns what writes its symbols."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) == 1 and used[0] < 256:
            for v, n in ((1, 1), (0, 1), (1, 1), (used[0], 8)):
                self.put(v, n)
            return {used[0]: (0, 0)}
        self.put(0, 1)
        self.put(15, 4)
        for _ in webp.CODE_LENGTH_ORDER:
            self.put(4 if _ < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(webp.reversed_bits(n, 4), 4)
        table, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
            code <<= n - last
            last = n
            table[s] = (webp.reversed_bits(code, n), n)
            code += 1
        return table

    def start(self, width, height):
        for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
            self.put(v, n)

    def image(self, argb, main, cache_bits=0):
        """Literals, back-references to the pixel before, and colour cache hits where there is a cache."""
        self.put(int(cache_bits > 0), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        size = 280 + ((1 << cache_bits) if cache_bits else 0)
        even = lambda n, k: [k + (i >= 2 * (1 << k) - n) for i in range(n)]
        k = int(np.floor(np.log2(size)))
        greens = self.code([k if i < (1 << (k + 1)) - size else k + 1 for i in range(size)])
        others = [self.code([8] * 256) for _ in range(3)]
        distances = self.code([5] * 24 + [6] * 16)
        assert even
        cache, i, flat = [0] * (1 << cache_bits), 0, argb.tolist()

        def keep(x):
            if cache_bits:
                cache[(webp.CACHE_FACTOR * x & 0xFFFFFFFF) >> (32 - cache_bits)] = x

        while i < len(flat):
            n = 0
            while i and i + n < len(flat) and flat[i + n] == flat[i - 1] and n < 4:
                n += 1
            hit = (webp.CACHE_FACTOR * flat[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            if n >= 2:
                self.put(*greens[256 + n - 1])
                self.put(*distances[1])  # the pixel to the left
                for x in flat[i : i + n]:
                    keep(x)
                i += n
            elif hit is not None and cache[hit] == flat[i]:
                self.put(*greens[280 + hit])
                i += 1
            else:
                self.put(*greens[flat[i] >> 8 & 255])
                for table, shift in zip(others, (16, 0, 24), strict=True):
                    self.put(*table[flat[i] >> shift & 255])
                keep(flat[i])
                i += 1

    def bytes(self):
        return webp.container(self.value.to_bytes(-(-self.n // 8), "little"))


def picture(seed, width, height, colours=None):
    rng = np.random.default_rng(seed)
    pixels = rng.integers(0, 1 << 32, colours or width * height, dtype=np.uint32)
    flat = pixels[rng.integers(0, len(pixels), width * height)] if colours else pixels
    return np.repeat(flat, 3)[: width * height]


@pytest.mark.parametrize("cache_bits", [0, 1, 6])
def test_literals_references_and_cache(cache_bits):
    own = picture(0, 13, 9, 20)
    w = Writer()
    w.start(13, 9)
    w.put(0, 1)
    w.image(own, True, cache_bits)
    assert (webp.decode_webp(w.bytes()).reshape(-1) == own).all()


def test_subtract_green():
    own = picture(1, 8, 8)
    c = webp._channels(own)
    c[:, 1] -= c[:, 2]
    c[:, 3] -= c[:, 2]
    w = Writer()
    w.start(8, 8)
    for v, n in ((1, 1), (2, 2), (0, 1)):
        w.put(v, n)
    w.image(webp._join(c), True)
    assert (webp.decode_webp(w.bytes()).reshape(-1) == own).all()


@pytest.mark.parametrize("colours", [2, 3, 16, 40])
def test_palette(colours):
    width, height = 11, 5
    table = picture(2, colours, 1)[:colours]
    table = np.random.default_rng(3).integers(0, 1 << 32, colours, dtype=np.uint32)
    index = np.random.default_rng(4).integers(0, colours, (height, width))
    down = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, packed = 8 >> down, []
    for row in index:
        padded = np.concatenate([row, np.zeros(-len(row) % (1 << down), int)]).reshape(-1, 1 << down)
        packed.append((padded << (np.arange(1 << down) * each)).sum(axis=1))
    w = Writer()
    w.start(width, height)
    for v, n in ((1, 1), (3, 2), (colours - 1, 8)):
        w.put(v, n)
    c = webp._channels(table)
    w.image(webp._join(np.diff(c, axis=0, prepend=np.zeros((1, 4), int))), False)
    w.put(0, 1)
    w.image(np.concatenate(packed).astype(np.uint32) << 8 | np.uint32(0xFF000000), True)
    assert (webp.decode_webp(w.bytes()) == table[index]).all()


def guess(mode, at, width, pixels):
    """The predictor of a pixel, written out channel by channel."""
    left, top, corner, right = pixels[at - 1], pixels[at - width], pixels[at - width - 1], pixels[at - width + 1]
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    table = {0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top), 8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}
    if mode in table:
        return table[mode]
    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        a = sum(abs(x - y) for x, y in zip(p, left, strict=True))
        b = sum(abs(x - y) for x, y in zip(p, top, strict=True))
        return left if a < b else top
    clip = lambda x: min(255, max(0, x))
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(left, top, corner, strict=True)]
    return [clip(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner, strict=True)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height = 9, 7
    pixels = webp._channels(np.random.default_rng(mode).integers(0, 1 << 32, width * height, dtype=np.uint32)).tolist()
    rest = []
    for at in range(width * height):
        y, x = divmod(at, width)
        p = [255, 0, 0, 0] if not at else pixels[at - 1] if not y else pixels[at - width] if not x else guess(mode, at, width, pixels)
        rest.append([(a - b) & 255 for a, b in zip(pixels[at], p, strict=True)])
    w = Writer()
    w.start(width, height)
    for v, n in ((1, 1), (0, 2), (0, 3)):
        w.put(v, n)
    w.image(np.full(3 * 2, 0xFF000000 | mode << 8, np.uint32), False)
    w.put(0, 1)
    w.image(webp._join(np.array(rest)), True)
    assert (webp.decode_webp(w.bytes()).reshape(-1) == webp._join(np.array(pixels))).all()


def test_cross_colour():
    width, height = 6, 5
    signed = lambda x: (x ^ 128) - 128
    g2r, g2b, r2b = 30, 200, 129
    pixels = webp._channels(np.random.default_rng(9).integers(0, 1 << 32, width * height, dtype=np.uint32)).tolist()
    sent = [[a, (r - (signed(g2r) * signed(g) >> 5)) & 255, g, (b - (signed(g2b) * signed(g) >> 5) - (signed(r2b) * signed(r) >> 5)) & 255] for a, r, g, b in pixels]
    w = Writer()
    w.start(width, height)
    for v, n in ((1, 1), (1, 2), (1, 3)):
        w.put(v, n)
    w.image(np.full(1, 0xFF000000 | r2b << 16 | g2b << 8 | g2r, np.uint32), False)
    w.put(0, 1)
    w.image(webp._join(np.array(sent)), True)
    assert (webp.decode_webp(w.bytes()).reshape(-1) == webp._join(np.array(pixels))).all()


def test_prefix_groups():
    """Two tiles with codes of their own."""
    w = Writer()
    w.start(8, 4)
    w.put(0, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(0, 3)
    w.image(np.array([0xFF000000, 0xFF000100], np.uint32), False)
    for green in (7, 9):
        for symbol in (green, 1, 2, 255, 0):
            w.code([int(i == symbol) for i in range(256)])
    out = webp.decode_webp(w.bytes())
    assert set(out[:, :4].reshape(-1)) == {0xFF010702} and set(out[:, 4:].reshape(-1)) == {0xFF010902}


def test_near_distances_are_the_formats():
    assert len(webp.NEAR) == len(set(webp.NEAR)) == 120


def padded(data):
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=700), st.lists(st.sampled_from([b"", b"a", b"the same words again ", b"\xff" * 40, b"0123456789abcdef"]), max_size=60).map(b"".join)))
def test_round_trip(data):
    assert media.from_media(media.to_media(padded(data))).tobytes() == padded(data)


@pytest.mark.parametrize("kind", ["random", "words", "zeros", "two", "far", "steps"])
def test_round_trip_of_long_payloads(kind, monkeypatch):
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 123, 7, dtype=np.uint8)) for _ in range(300)]
    block = rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    data = {"random": block * 1, "words": b" ".join(words[i] for i in rng.integers(0, 300, 30_000)), "zeros": b"", "two": bytes(rng.integers(0, 2, 90_000, dtype=np.uint8)), "far": block + bytes(rng.integers(0, 256, 300_000, dtype=np.uint8)) + block, "steps": bytes(range(256)) * 400}[kind]
    for parsed in (1 << 16, 700):
        monkeypatch.setattr(webp, "PARSED", parsed)
        stored = media.to_media(padded(data))
        assert media.from_media(stored).tobytes() == padded(data)
    assert len(stored) < {"random": 1.05, "words": 0.7, "zeros": 2, "two": 0.2, "far": 0.95, "steps": 0.1}[kind] * len(padded(data))


def test_payloads_of_several_images():
    payload = np.random.default_rng(0).integers(0, 9, 64 * 100, dtype=np.uint8).tobytes()
    stored = media.to_media(payload, image=64 * 30)
    assert len(webp.files(stored)) == 4 and media.from_media(stored).tobytes() == payload
    long = np.random.default_rng(1).integers(0, 200, media.IMAGE + 64, dtype=np.uint8).tobytes()
    assert len(webp.files(media.to_media(long))) == 2 and media.from_media(media.to_media(long)).tobytes() == long


@pytest.mark.parametrize("counts", [[5], [1, 1], [1] * 300, [2**k for k in range(40)], [1000000] + [1] * 270, [3, 0, 0, 9, 1]])
def test_code_lengths_are_complete(counts):
    lengths = webp.code_lengths(np.array(counts))
    assert ((lengths > 0) == (np.array(counts) > 0)).all() and lengths.max() <= webp.MOST_BITS
    assert len([c for c in counts if c]) == 1 or (2.0 ** -lengths[lengths > 0]).sum() == 1


def test_the_query_reads_codes_references_and_palettes(spark, monkeypatch):
    """What the writer's files hold: codes of several lengths, back-references, palettes."""
    text = (prose(3, 400) + " " + prose(3, 400)).encode()
    codes, kinds = [], []
    read, symbols, look = webp._read_prefix, webp._symbols, webp._look_up
    monkeypatch.setattr(webp, "_read_prefix", lambda *a: codes.append(read(*a)) or codes[-1])
    monkeypatch.setattr(webp, "_symbols", lambda *a: (kinds.append(x[0]) or x for x in symbols(*a)))
    monkeypatch.setattr(webp, "_look_up", lambda *a: kinds.append("palette") or look(*a))
    assert media.from_media(media.to_media(padded(text))).tobytes() == padded(text)
    assert len(set(codes[0].lengths.tolist())) > 3 and (kinds[0] >= 256).any() and (kinds[0] < 256).any()
    assert media.from_media(media.to_media(padded(b"abab" * 50))).tobytes() == padded(b"abab" * 50) and isinstance(kinds[-1], str)


def test_query(spark, messy, tmp_path):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    out = op10_media_columns(spark, str(tmp_path)).collect()
    key = lambda r: repr(r)
    want = []
    for r in messy.collect():
        raw = (r["text"] or "").encode()
        p = padded(raw)
        want.append((r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    got = [(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_null_media(spark):
    df = spark.createDataFrame([(1, 3, 64, None)], "doc_id long, n_bytes long, payload_bytes long, media binary")
    assert [tuple(r) for r in media.read_media(df).collect()] == [(1, 3, *[None] * 7)]


@pytest.mark.parametrize("data", [b"", b"RIFF\0\0\0\0WEBP", b"RIFF\4\0\0\0WEBPVP8L\5\0\0\0\x2f\0\0\0\0"])
def test_broken_files_are_errors(data):
    with pytest.raises(ValueError):
        webp.decode_webp(data)


def test_media_columns(spark, messy, empty):
    out = media.read_media(media.write_media(messy)).collect()
    rows = messy.collect()
    assert len(out) == len(rows)
    want = sorted((r["text"] or "").encode() for r in rows)
    assert sorted(bytes(r["pixels"])[: r["n_bytes"]] for r in out) == want
    for r in out:
        p = bytes(r["pixels"])
        assert len(p) == r["payload_bytes"] == max(64, -(-r["n_bytes"] // 64) * 64) and not p[r["n_bytes"] :].strip(b"\0")
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:]) and r["feature"]
    same = [r for r in out if r["doc_id"] in (1, 2)]
    assert same[0]["media_sha256"] == same[1]["media_sha256"] and same[0]["feature"] == same[1]["feature"]
    assert media.read_media(media.write_media(empty)).count() == 0
