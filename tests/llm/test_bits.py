"""Bit packing and Elias-Fano sequences against plain numpy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.bits import EliasFano, gather, pack, unpack, width_of


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 57), st.integers(0, 300), st.integers(0, 1 << 30))
def test_pack_round_trip(width, n, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << width, n, dtype=np.uint64)
    words = pack(values, width)
    assert (unpack(words, width, n) == values).all()
    if n:
        at = rng.integers(0, n, 50)
        assert (gather(words, width, at) == values[at]).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 62) - 1), max_size=200), st.lists(st.integers(0, (1 << 62) - 1), max_size=50))
def test_elias_fano_finds_successors(values, queries):
    values = np.sort(np.array(values, np.uint64))
    sequence, _ = EliasFano.load(np.concatenate(EliasFano.build(values).parts()), 0)
    assert (sequence.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, np.array(queries, np.uint64)])
    assert (sequence.search(asked) == np.searchsorted(values, asked)).all()
    hit = sequence.find(asked)
    assert (np.isin(asked, values) == (hit >= 0)).all()


@pytest.mark.parametrize("largest, width", [(0, 1), (1, 1), (255, 8), (256, 9), (49407, 16)])
def test_width(largest, width):
    assert width_of(largest) == width


def test_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 100_000, dtype=np.uint64))
    bits = 64 * sum(len(p) for p in EliasFano.build(values).parts()) / len(values)
    assert bits < 2.2 + np.log2((1 << 40) / len(values)) + 0.5
