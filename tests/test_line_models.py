import numpy as np
import pandas as pd
import pytest

from tessella.operators.riskblocks import RiskBlocks, Spec

from tests.test_riskblocks import plain


@pytest.mark.parametrize("block", [1000, 50, 7])
def test_models_of_one_feature_are_columns_of_two_passes(spark, monkeypatch, block):
    rng = np.random.default_rng(6)
    n = 150
    x = rng.normal(size=(n, 3)) * [1, 3, 0.5] + [0, 50, 0]
    t = np.ceil(rng.exponential(8, n))
    t[:30] = 4.0
    e, w = rng.integers(0, 2, n), np.stack([np.ones(n), (np.arange(n) % 3 > 0).astype(float), rng.poisson(1, n).astype(float)], axis=1)
    rows = spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "x": x.tolist(), "w": w.tolist()})).repartition(3)
    blocks = RiskBlocks(rows, "t", "e", "x", "w", block)
    # A time that fits in a block is no range of its own.
    assert any(p % 2 for p in blocks.parts) == (block == 7)
    passes = []
    monkeypatch.setattr(blocks, "_each", lambda *a, own=blocks._each: (passes.append(1), own(*a))[1])
    monkeypatch.setattr(blocks, "_summed", lambda *a, own=blocks._summed: (passes.append(1), own(*a))[1])
    models = {g: (Spec(u, (f,)), np.array([b])) for g, (u, f, b) in enumerate([(0, 0, 0.3), (0, 1, -0.1), (1, 2, 0.7), (2, 1, 0.05), (2, 0, 0.0)])}
    for g, (ll, grad, info) in blocks.evaluate(models).items():
        spec, beta = models[g]
        want = plain(t, e, x[:, list(spec.features)], w[:, spec.use], beta)
        assert ll == pytest.approx(want[0], rel=1e-9) and np.allclose(grad, want[1], atol=1e-6) and np.allclose(info, want[2], rtol=1e-7, atol=1e-6)
    assert len(passes) == (1 if block == 1000 else 2)
