import numpy as np
import pandas as pd
import pytest

from tessella.operators import fits, models


def test_all_specifications_are_fitted_in_the_same_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 240
    x = rng.normal(size=(n, 3))
    df = spark.createDataFrame(pd.DataFrame({"grp": np.arange(n) % 2, "t": np.ceil(rng.exponential(6, n) * np.exp(-0.5 * x[:, 0])), "e": rng.integers(0, 2, n), **{f"x{i}": x[:, i] for i in range(3)}}))
    specs = {"plain": [], "one": ["x1"], "both": ["x1", "x2"]}
    alone = {(r["grp"], r["model"]): r for s, more in specs.items() for r in models.adjusted_models(df, "grp", "t", "e", "x0", {s: more}).collect()}
    written, cut = [], fits.cut
    monkeypatch.setattr(fits, "cut", lambda d: (written.append(1), cut(d))[1])
    found = models.adjusted_models(df, "grp", "t", "e", "x0", specs).collect()
    # One table of the fits and one of the concordances, not one of each a specification.
    assert len(written) == 2
    assert len(found) == len(alone) == 6
    for r in found:
        for c in ("coef", "se", "c_index"):
            assert r[c] == pytest.approx(alone[r["grp"], r["model"]][c], rel=1e-9)


def test_dominance_counts_pairs():
    rng = np.random.default_rng(9)
    for n, span in ((1, 3), (60, 5), (200, 1000)):
        key, risk, deaths, count = (rng.integers(0, span, n) for _ in range(4))
        later = key[None, :] > key[:, None]
        weight = deaths[:, None] * count[None, :] * later
        want = weight.sum(), (weight * (risk[None, :] < risk[:, None])).sum(), (weight * (risk[None, :] == risk[:, None])).sum()
        assert fits.dominance(key, risk.astype(float), deaths, count) == tuple(map(int, want))
