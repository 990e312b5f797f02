"""SimHash groups against all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, prose

from tessella.llm import simhash
from tessella.llm.components import Labels, components


def plain_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in near:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("tile", [4096, 3])
def test_groups(spark, messy, tile):
    out = simhash.near_duplicates(messy, tile=tile).collect()
    rows = [(r["doc_id"], plain_fingerprint(r["text"], 3)) for r in messy.collect()]
    assert sorted(map(repr, [(r["doc_id"], r["fp0"] & (1 << 64) - 1) for r in out])) == sorted(map(repr, rows))
    known = [r for r in rows if r[0] is not None]
    want = plain_components({i for i, _ in known}, [(a, b) for a, f in known for b, g in known if (f ^ g).bit_count() <= 2])
    assert all(r["component_id"] == want[r["doc_id"]] for r in out if r["doc_id"] is not None)


@pytest.mark.parametrize("tile, ratio", [(64, 0.0), (16, 0.0), (64, 0.8), (16, 0.8)])
def test_links_join_all_near_fingerprints(spark, tile, ratio):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    flips = [int(b) ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))) for b in base for _ in range(5)]
    values = sorted({*map(int, base), *flips})
    rows = [(i, int(rng.integers(0, 40)), v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "node long, size long, fp0 long")
    near = [(i, j) for i, s, v in rows for j, t, w in rows if i < j and (v ^ w).bit_count() <= 2 and (not ratio or min(s, t) >= ratio * max(s, t))]
    want = plain_components(range(len(rows)), near)
    got = {r["node"]: r["component"] for r in components(simhash.link(df, 2, ratio, tile)).collect()}
    assert {i: got.get(i, i) for i in range(len(rows))} == want


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1200)] + [(1100, 3), (5, 5), (None, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 3 for i in [7, *range(1000, 1200)]}


def test_labels():
    labels = Labels(8)
    labels.join(np.array([1, 2, 6]), np.array([2, 3, 5]))
    labels.join(np.array([3]), np.array([6]))
    assert labels.label.tolist() == [0, 1, 1, 1, 4, 1, 1, 7]


def test_keep_one(spark, messy, empty):
    base = [prose(50 + i, 200) for i in range(12)]
    near = [t.replace(t.split()[90], "other", 1) for t in base]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(base)] + [(100 + i, t, "en", "a", 1) for i, t in enumerate(near)] + [(200 + i, base[0], "en", "a", 1) for i in range(20)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(12))
    out = simhash.keep_one(messy)
    assert out.columns == messy.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 1 and 2 not in ids and {1, 6, 10, 11, 12, 13, 14} <= set(ids)
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_clean_texts_stay(spark):
    rows = [(i, prose(1000 + i, 60 + i), "en", "a", 1) for i in range(150)]
    assert simhash.keep_one(spark.createDataFrame(rows, DOCS)).count() == 150


def test_wide_fingerprints(spark):
    df = simhash.fingerprints(spark.createDataFrame([(1, prose(1, 500))], "doc_id long, text string"), 5, 128)
    r = df.select("fp0", "fp1", "size").first()
    assert r["size"] == 496 and r["fp0"] != r["fp1"]
    assert df.select(F.bit_count("fp1")).first()[0] in range(16, 49)
