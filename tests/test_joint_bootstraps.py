"""Bootstraps of one table as columns of the same passes: draws, models of the same features and concordances, against plain numpy."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import fits, kernels, models, resampling, riskblocks
from tessella.operators.riskblocks import RiskBlocks, Spec
from tests.test_riskblocks import plain


def drawn(rng, n, times, risks):
    """Rows with ties of times and risks, a frequent time, and three columns of counts."""
    t = rng.integers(1, times, n).astype(float)
    t[: n // 3] = 5.0
    x = np.column_stack([rng.integers(0, risks, n) / 7 + 100, rng.normal(size=n)])
    w = np.column_stack([np.ones(n, int), rng.poisson(1, n), np.zeros(n, int)])
    return pd.DataFrame({"t": t, "e": rng.integers(0, 2, n), "x": x.tolist(), "w": w.tolist()}), t, x, w


def packed(spark, rows, block, small=True):
    df = spark.createDataFrame(rows, "t double, e int, x array<double>, w array<int>")
    if small:
        bytes_ = F.udf(lambda v: bytearray(v), "binary")
        df = df.withColumn("w", bytes_("w"))
    return RiskBlocks(df, "t", "e", "x", "w", block)


def test_draws_by_many_hashes():
    keys = [*map(str, range(95, 1205)), "", "é|x", "x" * 49, "y" * 50, "z" * 200]
    texts = [k.encode() for k in keys]
    sizes = np.array([len(v) for v in texts])
    got = resampling.md5_heads(b"s|17|", np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [int(hashlib.md5(f"s|17|{k}".encode()).hexdigest()[:8], 16) for k in keys]


def test_counts_are_those_of_the_column(spark):
    df = spark.range(700).select(F.col("id") * 37, F.col("id").alias("v")).toDF("id", "v")
    got = {r["v"]: list(r["w"]) for r in resampling.poisson_counts(df, "id", 12, "s").collect()}
    want = df.select("v", F.array(F.lit(1).cast("long"), *[resampling.poisson("s", F.lit(r), F.col("id")) for r in range(1, 13)]).alias("w")).collect()
    assert got == {r["v"]: r["w"] for r in want}
    assert resampling.poisson_counts(df.where("false"), "id", 2, "s").count() == 0


@pytest.mark.parametrize("block, times, own", [(1000, 12, 1 << 18), (25, 12, 1 << 18), (25, 12, 0), (60, 100_000, 0)])
def test_models_of_the_same_features(spark, monkeypatch, block, times, own):
    monkeypatch.setattr(riskblocks, "OWN", own)
    rows, t, x, w = drawn(np.random.default_rng(4), 300, times, 40)
    blocks = packed(spark, rows, block)
    assert blocks.single == (block == 1000)
    beta = [np.array([0.3, -0.2]), np.array([-0.1, 0.4])]
    found = blocks.evaluate({u: (Spec(u, (0, 1)), beta[u]) for u in range(2)})
    for u in range(2):
        # Less a mean, so that the plain sums don't lose digits.
        ll, grad, info = plain(t, rows["e"].to_numpy(), x - x.mean(axis=0), w[:, u].astype(float), beta[u])
        assert found[u][0] == pytest.approx(ll, rel=1e-9)
        assert np.allclose(found[u][1], grad, atol=1e-7) and np.allclose(found[u][2], info, rtol=1e-8, atol=1e-7)


@pytest.mark.parametrize("block, times, risks, band, small", [(1000, 12, 30, 1000, True), (25, 12, 30, 20, True), (25, 12, 2, 20, False), (20, 100_000, 100_000, 30, True)])
def test_concordances_of_columns(spark, monkeypatch, block, times, risks, band, small):
    monkeypatch.setattr(riskblocks, "BAND", band)
    monkeypatch.setattr(riskblocks, "DEALT", 40)
    rows, t, x, w = drawn(np.random.default_rng(7), 240, times, risks)
    got = packed(spark, rows, block, small).concordances(0, [0, 1, 2])
    for u in (0, 1):
        again = np.repeat(np.arange(len(t)), w[:, u])
        assert got[u] == pytest.approx(kernels.concordance(t[again], rows["e"].to_numpy()[again], x[again, 0]), abs=1e-12)
    assert got[2] is None


def test_pairs_of_many_columns(monkeypatch):
    rng = np.random.default_rng(2)
    key, risk, dead, n = rng.integers(0, 9, 80), rng.integers(0, 12, 80) / 3, rng.integers(0, 2, 80), rng.integers(0, 300, (80, 5))
    later = (key[:, None] < key) & (dead[:, None] > 0)
    both = np.einsum("iu,ju->uij", n, n)
    want = [(both * (later & test)).sum(axis=(1, 2)) for test in (risk[:, None] > risk, risk[:, None] == risk)]
    for cells in (1 << 18, 8):
        monkeypatch.setattr(riskblocks, "CELLS", cells)
        assert np.array_equal(riskblocks.pairs(key, risk, dead, n), want)


def test_bootstraps_write_no_row_by_replicate(spark, monkeypatch):
    written = []
    for module in (riskblocks, fits):
        cut = module.cut
        monkeypatch.setattr(module, "cut", lambda df, cut=cut: written.append(cut(df)) or written[-1])
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"id": np.arange(300), "t": rng.integers(1, 50, 300).astype(float), "e": rng.integers(0, 2, 300), "a": rng.normal(size=300)})
    found = models.bootstrap_cox(spark.createDataFrame(rows), "id", "t", "e", "a", [], 10, "s")
    assert found["c_valid"] == 10 and sum(df.count() for df in written) < 2 * len(rows)
