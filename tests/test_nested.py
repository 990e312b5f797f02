"""Nested cross-validation against plain numpy on the same folds."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from tessella.operators import kernels, nested
from tests.test_riskblocks import plain, plain_net

GRID = ((0.02, 0.5), (0.1, 1.0), (0.4, 1.0))


def draw(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16)


def plain_folds(keys, labels, k, seed):
    out = {}
    for label in sorted(set(labels)):
        own = sorted((k_ for k_, l in zip(keys, labels) if l == label), key=lambda x: (draw(seed, x), x))
        out |= {key: i % k for i, key in enumerate(own)}
    return out


def ridge(t, e, z, penalty):
    """Newton's method on z-scored features."""
    b, n = np.zeros(z.shape[1]), len(t)
    for _ in range(40):
        _, grad, info = plain(t, e, z, np.ones(n), b)
        b = b + np.linalg.solve(info + penalty * n * np.eye(len(b)), grad - penalty * n * b)
    return b, np.sqrt(np.diag(np.linalg.inv(info + penalty * n * np.eye(len(b)))))


def scored(x, rows):
    return (x - x[rows].mean(axis=0)) / x[rows].std(axis=0, ddof=1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n = 120
    x = rng.normal(size=(n, 6))
    x[:, 5] = rng.integers(0, 2, n)
    t = np.ceil(rng.exponential(20 * np.exp(-0.9 * x[:, 0] + 0.5 * x[:, 2])) * 3)
    return np.arange(n), t, rng.integers(0, 5, n).clip(0, 1), x


@pytest.fixture(scope="module")
def tested(spark, data):
    keys, t, e, x = data
    df = spark.createDataFrame(pd.DataFrame({"id": keys, "t": t, "e": e, "x": x.tolist()}))
    more = spark.createDataFrame([(None, 1.0, 1, [0.0] * 6), (500, None, 1, [0.0] * 6)], df.schema)
    return nested.nested_folds(df.unionByName(more), "id", "t", "e", "x", 2, 3, "s", block=50, plain=(5,))


def folds_of(data):
    keys, _, e, _ = data
    outer = plain_folds(keys, e, 2, "s|outer")
    inner = {}
    for f in (0, 1):
        ids = [k for k in keys if outer[k] != f]
        dealt = plain_folds([f"{f}|{k}" for k in ids], [f"{f}|{e[k]}" for k in ids], 3, "s|inner")
        inner[f] = {k: dealt[f"{f}|{k}"] for k in ids}
    return np.array([outer[k] for k in keys]), inner


def test_elastic_nets(data, tested):
    keys, t, e, x = data
    outer, inner = folds_of(data)
    found = nested.elastic_nets(tested, [(0, 1, 2, 3, 4)] * 2, GRID)
    tables = nested.tune(tested, [(0, 1, 2, 3, 4)] * 2, GRID)
    c = nested.held_out(tested, {f: (fit, tested.test(f)) for f, (_, fit, _, _) in enumerate(found)})
    for f in (0, 1):
        means = []
        for penalty, share in GRID:
            own = []
            for part in range(3):
                fit = np.array([outer[k] != f and inner[f][k] != part for k in keys])
                held = np.array([outer[k] != f and inner[f][k] == part for k in keys])
                b = plain_net(t[fit], e[fit], x[fit][:, :5], np.ones(fit.sum()), penalty, share)
                own.append(kernels.concordance(t[held], e[held], scored(x[:, :5], fit)[held] @ b))
            means.append(np.mean(own))
        assert np.allclose([r["mean_inner_c"] for r in tables[f]], means, atol=2e-3)
        chosen, fit, features, note = found[f]
        assert (chosen["penalizer"], chosen["l1_ratio"]) == GRID[int(np.argmax(means))] and not note
        own = outer != f
        b = plain_net(t[own], e[own], x[own][:, :5], np.ones(own.sum()), chosen["penalizer"], chosen["l1_ratio"])
        assert np.allclose(fit.beta, b, atol=1e-5) and set(features) == set(np.flatnonzero(b).tolist())
        assert c[f] == pytest.approx(kernels.concordance(t[~own], e[~own], scored(x[:, :5], own)[~own] @ b), abs=2e-3)


def test_benchmark(data, tested):
    keys, t, e, x = data
    outer, _ = folds_of(data)
    rows = nested.benchmark(tested, 4, (4, 5), repeats=3, seed="b", grid=GRID)
    assert len(rows) == 2 * 8 and all(r["error"] == "" for r in rows)
    for f in (0, 1):
        own = outer != f
        by = {r["method"]: r for r in rows if r["fold"] == f}
        z = scored(x, own)
        z[:, 5] = x[:, 5]  # a category isn't scaled

        def c_of(features):
            b, _ = ridge(t[own], e[own], z[own][:, features], 0.05)
            return kernels.concordance(t[~own], e[~own], z[~own][:, features] @ b)

        p = []
        for i in range(4):
            b, se = ridge(t[own], e[own], z[own][:, [i]], 0.0)
            p.append((kernels.normal_p(b[0] / se[0]), i))
        ranked = [i for _, i in sorted(p)]
        assert by["univariate_top10"]["selected"] == ranked
        chosen = []
        while len(chosen) < 4:
            rest = []
            for i in set(range(4)) - set(chosen):
                b, se = ridge(t[own], e[own], z[own][:, [*chosen, i]], 0.05)
                rest.append((kernels.normal_p(b[-1] / se[-1]), i))
            if min(rest)[0] >= 0.01:
                break
            chosen.append(min(rest)[1])
        assert by["conditional_cox_mb"]["selected"] == chosen and 0 in chosen
        r = np.corrcoef(np.column_stack([x[own][:, ranked], np.log1p(t[own])]), rowvar=False)
        from tessella.operators import selection

        assert by["iamb_alpha0.10"]["selected"] == [ranked[i] for i in selection.iamb(r, int(own.sum()), 4, 0.1)]
        assert by["gsmb_alpha0.10"]["selected"] == [ranked[i] for i in selection.grow_shrink(r, int(own.sum()), 4, 0.1)]
        for name, features in (("clinical_only", [4, 5]), ("univariate_top10", ranked), ("conditional_cox_mb", chosen), ("conditional_cox_mb_plus_clinical", [*chosen, 4, 5])):
            assert by[name]["c_index"] == pytest.approx(c_of(features), abs=2e-3)
        sets = [nested.random_set(ranked, 10, "b", f, k) for k in (1, 2, 3)]
        assert by["random_top10_mean3"]["c_index"] == pytest.approx(np.mean([c_of(s) for s in sets]), abs=2e-3)


def test_few_rows(spark, data):
    keys, t, e, x = data
    df = spark.createDataFrame(pd.DataFrame({"id": keys[:20], "t": t[:20], "e": e[:20], "x": x[:20].tolist()}))
    few = nested.nested_folds(df, "id", "t", "e", "x", 2, 3)
    assert {r["error"] for r in nested.benchmark(few, 4, (4,), repeats=1, grid=GRID[:1])} == {"too_few_samples", ""}
    assert all(r["c_index"] is None for r in nested.benchmark(few, 4, (4,), repeats=1, grid=GRID[:1]))
