"""The n-gram trie against dictionaries of counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import prose

from tessella.llm import ngrams, shards, store
from tessella.llm.queries import op3_lm_scoring


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b"\n"]


def plain(train, rows):
    c, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        w = tokens(t)
        c.update(w)
        c2.update(zip(w, w[1:]))
        c3.update(zip(w, w[1:], w[2:]))
    total, distinct = sum(c.values()), len(c)
    q = lambda p: 10 ** (-ngrams.STEP * math.ceil(-math.log10(p) / ngrams.STEP - 1e-9))
    a2 = {k: q((n - 0.75) / c[k[0]]) for k, n in c2.items()}
    a3 = {k: q((n - 0.75) / c2[k[:2]]) for k, n in c3.items()}
    m2, m3 = Counter(), Counter()
    for k, a in a2.items():
        m2[k[0]] += a
    for k, a in a3.items():
        m3[k[:2]] += a
    out = []
    for i, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for j, x in enumerate(w):
            p = (c[x] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            if j:
                p = a2.get((w[j - 1], x), 0) + (1 - m2[w[j - 1]]) * p
            if j > 1 and (w[j - 2], w[j - 1]) in c2:
                p = a3.get((w[j - 2], w[j - 1], x), 0) + (1 - m3[w[j - 2], w[j - 1]]) * p
            score += math.log10(p)
        out.append((i, len(w), sum(c[x] > 0 for x in w), total, base, score))
    return out


def check(got, want):
    key = lambda r: repr((r[0], r[1], round(r[4], 4)))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g)[:4] == w[:4] and tuple(g)[4:] == pytest.approx(w[4:], rel=1e-9)


def test_scores(spark, messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    train = messy.where("doc_id % 2 = 0")
    trie = ngrams.train(train, store.fresh_path(spark, "test-ngrams"))
    check(ngrams.score(messy, trie).collect(), plain([t for i, t in rows if i is not None and i % 2 == 0], rows))
    assert ngrams.score(messy, trie, keep=("lang",)).columns[:2] == ["doc_id", "lang"]


def test_contexts_that_span_shards(spark, monkeypatch):
    texts = [" ".join(f"the w{(i * 7 + k) % 40} the x{k % 3}" for k in range(60)) for i in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    write = ngrams._write_level
    monkeypatch.setattr(ngrams, "_write_level", lambda *a, **more: write(*a, shard=5, **more))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        trie = ngrams.train(df, store.fresh_path(spark, "test-split"))
        assert len(trie.pairs.paths) > 8 and len(trie.pairs.split)
        check(ngrams.score(df, trie).collect(), plain(texts, list(enumerate(texts))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_probabilities_add_up(spark):
    texts = [prose(i % 3, 60) for i in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trie = ngrams.train(df, store.fresh_path(spark, "test-sum"))
    words = sorted({w for t in texts for w in tokens(t)} | {b"never-seen"})
    first, second = tokens(texts[0])[:2]
    for context in ([first], [first, second], [b"never-seen"]):
        own = np.array([[ngrams.word_hashes([*context, w])[0] if w != b"\n" else np.append(ngrams.word_hashes(context)[0], ngrams.END)] for w in words]).reshape(len(words), -1)
        bounds = np.arange(len(words) + 1) * own.shape[1]
        _, _, p = ngrams.token_probabilities(trie, own.reshape(-1), bounds)
        assert p.reshape(len(words), -1)[:, -1].sum() == pytest.approx(1.0, abs=1e-9)


def test_ranges_and_blocks(spark, messy, monkeypatch):
    """Many ranges, blocks handed on often and added up often."""
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    monkeypatch.setattr(ngrams, "HELD", 300)
    monkeypatch.setattr(ngrams, "COUNTED", 200)
    monkeypatch.setattr(ngrams, "PORTION", 1000)
    trie = ngrams.train(messy, store.fresh_path(spark, "test-ranges"))
    assert len(trie.pairs.paths) > 20 and len(trie.words.paths) > 20
    check(ngrams.score(messy, trie).collect(), plain([t for _, t in rows], rows))
    for top in (3, 1 << 10, 1 << 40):
        rng = np.random.default_rng(0)
        block = ngrams._added([[rng.integers(0, top, 50), rng.integers(0, top, 50), rng.integers(1, top, 50)] for _ in range(3)])
        assert all((x == y).all() for x, y in zip(block, ngrams._unblock(ngrams._block(*block)), strict=True))


@pytest.mark.parametrize("largest", [9, 1 << 40])
def test_distinct_pairs_of_any_size(largest):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-1, 5, 500) * (largest // 9), rng.integers(-1, 5, 500) * (largest // 9)
    a, b = np.maximum(a, -1), np.maximum(b, -1)
    x, y, where, n = ngrams.distinct_pairs(a, b)
    assert Counter(zip(a.tolist(), b.tolist())) == dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) and sorted(zip(x, y)) == list(zip(x, y))
    assert (x[where] == a).all() and (y[where] == b).all() and len(ngrams.distinct_pairs(a[:0], b[:0])[0]) == 0


def test_query(spark, messy, tmp_path):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    out = op3_lm_scoring(spark, str(tmp_path)).drop("held_out").where("doc_id IS NOT NULL").collect()
    check(out, plain(train, [r for r in rows if r[0] is not None]))


def test_nothing_to_learn(spark, empty):
    trie = ngrams.train(empty, store.fresh_path(spark, "test-empty"))
    df = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in ngrams.score(df, trie).collect()}
    assert out[1]["n_tokens"] == 1 and out[2]["n_tokens"] == 3 and out[2]["n_known"] == 0 and out[2]["score"] == out[2]["base_score"] == 0.0
    assert ngrams.score(empty, trie).count() == 0


def test_sorted_shards(spark):
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 5000))
    df = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "k long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        found = shards.write_sorted(df, store.fresh_path(spark, "test-set"), "k", "v", shard=300)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found.paths) > 8 and found.n == len(keys) and found.total == sum(range(len(keys)))
    asked = np.concatenate([keys, keys + 1, [0, (1 << 62) + 5]])
    rank, value = found.find(asked, columns=True)
    want = np.where(np.isin(asked, keys), np.searchsorted(keys, asked), -1)
    assert (rank == want).all() and (value == np.maximum(want, 0)).all()
