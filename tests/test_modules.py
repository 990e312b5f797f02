"""Module stability and preservation against plain loops."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from tessella.operators import kernels, models, modules


def ranks(x):
    return pd.DataFrame(x).rank().to_numpy()


def plain_modules(x, least=3, p=0.01):
    good = np.flatnonzero(x.std(axis=0) > 0)
    r = np.corrcoef(ranks(x[:, good]), rowvar=False)
    n = len(x)
    t = next(t for t in np.arange(0, 60, 1e-4) if models.t_p(t, n - 2) <= p)
    labels = kernels.average_linkage(1 - r, 1 - t / math.sqrt(n - 2 + t * t))
    found = [set(good[labels == m].tolist()) for m in np.unique(labels)]
    return sorted((m for m in found if len(m) >= least), key=lambda m: (-len(m), min(m)))


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(2)
    n = 50
    base = rng.normal(size=(n, 3))
    x = np.column_stack([base[:, [0]] + 0.5 * rng.normal(size=(n, 5)), base[:, [1]] + 1.6 * rng.normal(size=(n, 4)), rng.normal(size=(n, 4)), np.round(base[:, [2]] * 2) + 0.7 * np.round(rng.normal(size=(n, 3)))])
    return np.column_stack([x, np.where(np.arange(n) < 2, 1.0, 0.0)])


def test_stability(spark, table):
    n, k = table.shape
    df = spark.createDataFrame([(i, f"f{j:02d}", float(table[i, j])) for i in range(n) for j in range(k)], "id long, feature string, value double").repartition(4)
    got = modules.subsample_stability(df, "id", "feature", "value", reps=6, share=0.8, seed="s", least=3)
    full = plain_modules(table)
    assert [r["n_features"] for r in got] == [len(m) for m in full] and len(full) >= 2
    assert [r["features"] for r in got] == [sorted(f"f{j:02d}" for j in m) for m in full]
    for row, own in zip(got, full):
        jaccard, clustered = [], []
        for rep in range(1, 7):
            order = sorted(range(n), key=lambda i: (int(hashlib.md5(f"s|{rep}|{i}".encode()).hexdigest()[:8], 16), i))
            sub = table[sorted(order[:40])]
            clustered.append(int((sub.std(axis=0) > 0).sum()))
            best = max(((2 * len(own & m) / (len(own) + len(m)), len(own & m), len(own & m) / len(own | m)) for m in plain_modules(sub)), default=(0, 0, 0))
            jaccard.append(best[2] if best[0] else 0.0)
        assert row["median_jaccard"] == pytest.approx(np.median(jaccard)) and row["q05_jaccard"] == pytest.approx(np.quantile(jaccard, 0.05))
        assert row["median_clusterable"] == np.median(clustered) and row["share_jaccard_half"] == np.mean(np.array(jaccard) >= 0.5)
    assert modules.subsample_stability(df.where("false"), "id", "feature", "value", reps=2) == []


def test_preservation(spark):
    rng = np.random.default_rng(5)

    def cohort(n):
        z = rng.normal(size=(n, 3))
        w = np.linspace(0.4, 1.5, 8)
        return np.column_stack([z[:, [0]] * w + rng.normal(size=(n, 8)), rng.normal(size=(n, 8)), z[:, [2]] * w + rng.normal(size=(n, 8)), rng.normal(size=(n, 16))])

    a, b = cohort(120), cohort(90)
    ref, test = np.corrcoef(a, rowvar=False), np.corrcoef(b, rowvar=False)
    own = {"kept": list(range(8)), "noise": list(range(8, 16)), "two": [0, 1]}
    got = {r["module"]: r for r in modules.module_preservation(spark, ref, test, own, 60, "s", 6.0)}

    def plain(m, put):
        """From the rows: components, connectivities and correlations of standardised columns."""
        zr, zt = ((x[:, c] - x[:, c].mean(axis=0)) / x[:, c].std(axis=0, ddof=1) for x, c in ((a, m), (b, put)))
        kme, kim, cor = [], [], []
        for z in (zr, zt):
            u = np.linalg.svd(z, full_matrices=False)[0][:, 0]
            c = np.array([np.corrcoef(z[:, i], u)[0, 1] for i in range(z.shape[1])])
            kme.append(c * (1 if c.sum() >= 0 else -1))
            r = np.corrcoef(z, rowvar=False)
            adj = ((1 + r) / 2) ** 6.0
            kim.append(adj.sum(axis=1) - 1)
            cor.append(r[np.triu_indices(len(r), 1)])
        adjacency = ((1 + cor[1]) / 2) ** 6.0
        return [(kme[1] ** 2).mean(), (np.sign(kme[0]) * kme[1]).mean(), (np.sign(cor[0]) * cor[1]).mean(), adjacency.mean(), np.corrcoef(*kim)[0, 1], np.corrcoef(*kme)[0, 1], np.corrcoef(*cor)[0, 1]]

    for m in ("kept", "noise"):
        null = np.array([plain(own[m], modules.drawn(40, 8, "s", m, i)) for i in range(1, 61)])
        seen = np.array(plain(own[m], own[m]))
        z = (seen - null.mean(axis=0)) / null.std(axis=0, ddof=1)
        assert np.allclose([got[m][c] for c in (*modules.DENSITY, *modules.CONNECTIVITY)], seen, atol=1e-8)
        assert got[m]["z_density"] == pytest.approx(np.median(z[:4])) and got[m]["z_connectivity"] == pytest.approx(np.median(z[4:]))
        assert got[m]["z_summary"] == pytest.approx((np.median(z[:4]) + np.median(z[4:])) / 2)
    assert got["kept"]["z_summary"] > 5 > 2 > got["noise"]["z_summary"] and got["kept"]["median_rank"] < got["noise"]["median_rank"]
    assert got["two"]["z_summary"] is None and modules.module_preservation(spark, ref, test, {}, 2) == []
    assert modules.critical_correlation(30) == pytest.approx(0.4629, abs=1e-4) and modules.critical_correlation(2) == 1.0
