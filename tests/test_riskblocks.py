"""Cox models over blocks against plain numpy: likelihood, gradient, information, elastic nets with their zeros."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators.riskblocks import RiskBlocks, Spec


def plain(t, e, x, w, beta):
    """Efron's log-likelihood, gradient and information, a death at a time."""
    r, k = w * np.exp(x @ beta), x.shape[1]
    ll, grad, info = 0.0, np.zeros(k), np.zeros((k, k))
    for at in np.unique(t[(e == 1) & (w > 0)]):
        risk, dead = t >= at, (t == at) & (e == 1) & (w > 0)
        d = int(w[dead].sum())
        ll += (w[dead] * (x[dead] @ beta)).sum()
        grad += w[dead] @ x[dead]
        for share in np.arange(d) / d:
            weight = r * risk - share * r * dead
            mean = weight @ x / weight.sum()
            ll -= np.log(weight.sum())
            grad -= mean
            info += (x * weight[:, None]).T @ x / weight.sum() - np.outer(mean, mean)
    return ll, grad, info


def plain_net(t, e, x, w, penalty, l1_ratio):
    """Elastic-net coefficients of z-scored features by proximal gradient steps with backtracking."""
    n = w.sum()
    mean = w @ x / n
    z = (x - mean) / np.sqrt(w @ (x - mean) ** 2 / (n - 1))
    b, step = np.zeros(x.shape[1]), 1.0
    for _ in range(3000):
        ll, grad, _ = plain(t, e, z, w, b)
        grad = grad / n - penalty * (1 - l1_ratio) * b
        smooth = ll / n - penalty * (1 - l1_ratio) * b @ b / 2
        while True:
            new = b + step * grad
            new = np.sign(new) * np.maximum(np.abs(new) - step * penalty * l1_ratio, 0)
            gap = new - b
            if plain(t, e, z, w, new)[0] / n - penalty * (1 - l1_ratio) * new @ new / 2 >= smooth + grad @ gap - gap @ gap / (2 * step) - 1e-14:
                break
            step /= 2
        if np.abs(gap).max() < 1e-9:
            return new
        b, step = new, step * 1.5
    return b


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n, k = 160, 5
    x = rng.normal(size=(n, k)) * [1, 3, 0.5, 1, 2] + [0, 5, 0, 1, 0]
    t = np.ceil(rng.exponential(8 * np.exp(-0.6 * x[:, 0])))
    t[:40] = 4.0
    w = np.stack([np.ones(n), (np.arange(n) % 3 > 0).astype(float), rng.poisson(1, n).astype(float)], axis=1)
    return t, rng.integers(0, 2, n), x, w


def table(spark, data):
    t, e, x, w = data
    return spark.createDataFrame(pd.DataFrame({"t": t, "e": e, "x": x.tolist(), "w": w.tolist()})).repartition(3)


@pytest.mark.parametrize("block", [1000, 40, 7])
def test_sums_of_blocks(spark, data, block):
    blocks = RiskBlocks(table(spark, data), "t", "e", "x", "w", block)
    assert (len(blocks.parts) == 1) == (block == 1000) and (block == 1000 or any(p % 2 for p in blocks.parts))
    t, e, x, w = data
    models = {0: (Spec(0, (0, 1, 2, 3, 4)), np.array([0.3, -0.1, 0.2, 0.0, 0.1])), 1: (Spec(1, (2, 0)), np.array([0.4, -0.2])), 2: (Spec(2, (0, 4)), np.zeros(2))}
    for g, (ll, grad, info) in blocks.evaluate(models).items():
        spec, beta = models[g]
        want = plain(t, e, x[:, list(spec.features)], w[:, spec.use], beta)
        assert ll == pytest.approx(want[0], rel=1e-9) and np.allclose(grad, want[1], atol=1e-7) and np.allclose(info, want[2], atol=1e-6)


@pytest.mark.parametrize("block", [1000, 40])
def test_elastic_nets_with_their_zeros(spark, data, block):
    t, e, x, w = data
    blocks = RiskBlocks(table(spark, data), "t", "e", "x", "w", block)
    specs = [Spec(u, (0, 1, 2, 3, 4), p, l) for u in (0, 1, 2) for p, l in ((0.01, 0.5), (0.1, 0.9), (0.05, 1.0), (0.5, 1.0), (0.05, 0.0))]
    zeros = 0
    for fit in blocks.fit(specs):
        want = plain_net(t, e, x, w[:, fit.spec.use], fit.spec.penalty, fit.spec.l1_ratio)
        assert fit.settled and np.allclose(fit.beta, want, atol=2e-6)
        assert ((fit.beta == 0) == (want == 0)).all()
        zeros += int((want == 0).sum())
    assert zeros > 5
    again = blocks.fit(specs[1:2], starts={0: np.ones(5)})[0]
    assert np.allclose(again.beta, blocks.fit(specs[1:2])[0].beta, atol=1e-6)


def test_errors_and_unsettled_fits(spark, data):
    odd = table(spark, data).withColumn("x", F.concat("x", F.array(F.lit(7.0)))).withColumn("w", F.concat("w", F.array(F.lit(0.0))))
    extra = spark.createDataFrame([(None, 1, [0.0] * 6, [1.0] * 4), (1.0, 1, [float("nan")] * 6, [1.0] * 4), (1.0, 1, None, [1.0] * 4)], odd.schema)
    blocks = RiskBlocks(odd.unionByName(extra), "t", "e", "x", "w")
    assert blocks.n == 160
    few, none, part, slow = blocks.fit([Spec(3, (0,)), Spec(0, (5,)), Spec(0, (0, 5)), Spec(0, (0,))], least=30, rounds=100)
    assert few.error == "too_few_samples" and none.error == "no_features" and part.settled and part.beta[1] == 0
    assert np.allclose(part.beta[0], slow.beta[0], atol=1e-7) and slow.se[0] > 0
    assert not blocks.fit([Spec(0, (0,))], rounds=1)[0].settled
    assert RiskBlocks(odd.where("false"), "t", "e", "x", "w").fit([Spec(0, (0,))])[0].error == "too_few_samples"
    risks = blocks.risks({3: (slow, 1)}).collect()
    assert len(risks) == int((data[3][:, 1] > 0).sum()) and {r["g"] for r in risks} == {3}
