"""Sign flips of small and large groups."""

import itertools

import numpy as np
import pytest

from tessella.operators import resampling


def test_no_group_vanishes(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(0.5, 1, 8), "b": rng.normal(0.3, 1, 17), "c": rng.normal(0.25, 1, 40)}
    rows = [(g, i, float(v)) for g, own in groups.items() for i, v in enumerate(own)]
    out = {r["g"]: r for r in resampling.sign_flips(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "i", "v").collect()}
    assert {g: r["n"] for g, r in out.items()} == {"a": 8, "b": 17, "c": 40}
    for g in "ab":
        signs = np.array(list(itertools.product((1, -1), repeat=len(groups[g]))), np.int8)
        assert out[g]["p_value"] == pytest.approx((np.abs(signs @ groups[g]) >= abs(groups[g].sum()) - 1e-9).mean())
    signs = rng.integers(0, 2, (200_000, 40)) * 2 - 1
    assert out["c"]["p_value"] == pytest.approx((np.abs(signs @ groups["c"]) >= abs(groups["c"].sum())).mean(), abs=0.01)
