"""Near-duplicates of the pipeline against exact Jaccard similarities of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, prose
from tests.llm.test_simhash import plain_components

from tessella.llm import simhash


@pytest.mark.parametrize("tile, shingles", [(simhash.TILE, simhash.SHINGLES), (16, simhash.SHINGLES), (simhash.TILE, 1500)])
def test_groups_are_those_of_exact_jaccard(spark, monkeypatch, tile, shingles):
    monkeypatch.setattr(simhash, "SHINGLES", shingles)
    rng = np.random.default_rng(5)
    texts = [prose(70, 120), prose(70, 120) + " " + prose(70, 120)]
    for k in range(8):
        base = prose(100 + k, 150 + 10 * k).split()
        for changes in (0, 1, 2, 3, 4, 5, 6, 7, 8, 12):
            own = list(base)
            for at in rng.integers(0, len(own), changes):
                own[at] = f"changed{at}"
            texts.append(" ".join(own))
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    share = lambda a, b: len(a & b) / len(a | b)
    near = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if share(sets[i], sets[j]) >= 0.8]
    want = plain_components(range(len(texts)), near)
    assert want[1] == 0 and len(set(want.values())) > 9
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df, 5, 128, 0.8, tile=tile).collect()}
    assert got == want
    if (tile, shingles) == (simhash.TILE, simhash.SHINGLES):
        assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted(set(want.values()))


def test_pairs_that_agree_in_short_hashes_alone_are_told_apart(spark, monkeypatch):
    """Where all shingles agree in 16 bits, links fail, and their groups are compared by whole hashes."""
    plain, original, calls = simhash.fingerprints, simhash.link, []

    def coarse(docs, words, bits, key, text, short):
        found = plain(docs, words, bits, key, text, short)
        return found.withColumn("shingles", F.expr("cast(repeat('00', cast(size AS int)) AS binary)")) if short == 16 else found

    def link(rows, *args):
        calls.append(rows.count())
        return original(rows, *args)

    monkeypatch.setattr(simhash, "fingerprints", coarse)
    monkeypatch.setattr(simhash, "link", link)
    monkeypatch.setattr(simhash, "bit_radius", lambda *_: 122)
    texts = [prose(1, 60), prose(2, 60), prose(1, 60) + " end", prose(3, 60), prose(4, 2000), None, "", prose(2, 60) + " end"]
    df = spark.createDataFrame([(i + 1, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(df, 5, 128, 0.8).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 2}
    assert calls == [7, 5]


@pytest.mark.parametrize("bits", [16, 64])
def test_bounds_never_miss(bits):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < share], rng.integers(0, 1 << 64, int(extra), dtype=np.uint64)])) for share in (1, 0.99, 0.95, 0.9, 0.85, 0.8, 0.5) for extra in (0, 5, 40, 90)]
    found = simhash.Sets(np.array([simhash.short_hashes(s, bits).tobytes() for s in sets], object), np.array([len(s) for s in sets]), 0.8)
    everyone = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        others = np.array([j for j in range(len(sets)) if j != i])
        want = [j for j in others.tolist() if len(everyone[i] & everyone[j]) >= 0.8 * len(everyone[i] | everyone[j])]
        got = found.near(i, others).tolist()
        assert got == want if bits == 64 else set(got) >= set(want) and len(got) <= len(want) + 2
