"""Packing: plans hold every piece once within the capacity, near the lower bound; pieces are the tokenizer's ids."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import packing
from tessella.llm.queries import BYTE_TOKENIZER, tokenizer_path


def used(runs):
    got = Counter()
    for n, held in runs:
        assert n > 0 and sum(held) <= 1024
        for s in held:
            got[s] += n
    return got


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 50), max_size=40))
def test_every_piece_once(counts):
    assert used(packing.plan(counts)) == Counter(counts)


@pytest.mark.parametrize("kind", ["uniform", "skewed", "small", "few"])
def test_near_the_lower_bound(kind):
    rng = np.random.default_rng(0)
    sizes = {"uniform": rng.integers(1, 1025, 20000), "skewed": np.exp(rng.normal(6, 1, 20000)).astype(int) % 1024 + 1, "small": rng.integers(1, 60, 5000), "few": np.repeat([341, 342], [3000, 3])}[kind]
    counts = Counter(sizes.tolist())
    runs = packing.plan(counts)
    assert used(runs) == counts
    bound = max(math.ceil(sizes.sum() / 1024), int((sizes > 512).sum()))
    assert sum(n for n, _ in runs) <= 1.01 * bound + 2


@pytest.mark.parametrize("large", [0.5, 0.25, 0.1])
def test_grouped_plans(large):
    counts = Counter(np.random.default_rng(1).integers(1, 1025, 3000).tolist())
    assert used(packing.plan_from(dict(counts), 1024, 16, large)) == counts


def test_configurations_cover_demand():
    found = packing.configurations([700, 330, 300], [10, 25, 7], 1024)
    assert all(sum(s * k for s, k in zip([700, 330, 300], c, strict=True)) <= 1024 for _, c in found)
    for i, need in enumerate([10, 25, 7]):
        assert sum(u * c[i] for u, c in found) == pytest.approx(need)


def test_pack(spark, messy, empty):
    path = tokenizer_path(BYTE_TOKENIZER)
    messy = messy.union(messy.limit(2).selectExpr("doc_id + 500", "'foo <|endoftext|>bar'", *messy.columns[2:]))
    rows = messy.collect()
    out = [r.asDict() for r in packing.best_fit_pack(messy, path, 2).collect()]
    tok, want = Tokenizer.from_file(path), Counter()
    for r in rows:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], i, a, z - a, zlib.crc32(ids[a:z].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.best_fit_pack(empty, path, 2).count() == 0
