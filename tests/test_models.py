"""Models, tests and resampling by Spark sums against plain numpy versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import kernels, models, statistics


@pytest.fixture(scope="module")
def patients(spark):
    rng = np.random.default_rng(0)
    n = 160
    x = rng.normal(size=(n, 4))
    t = np.ceil(rng.exponential(np.exp(-0.9 * x[:, 0] + 0.6 * x[:, 1])) * 40)
    frame = pd.DataFrame({"id": np.arange(n), "grp": np.where(np.arange(n) % 2, "a", "b"), "t": t, "e": rng.integers(0, 4, n).clip(0, 1), **{f"x{i}": x[:, i] for i in range(4)}})
    return frame, spark.createDataFrame(frame)


def z(x):
    return (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)


def test_adjusted_models(patients):
    frame, df = patients
    got = {(r["grp"], r["model"]): r for r in models.adjusted_models(df, "grp", "t", "e", "x0", {"plain": [], "both": ["x1", "x2"]}, 0.05).collect()}
    for grp, own in frame.groupby("grp"):
        for name, xs in (("plain", ["x0"]), ("both", ["x0", "x1", "x2"])):
            x = z(own[xs].to_numpy())
            beta, se = kernels.cox_fit(own["t"].to_numpy(), own["e"].to_numpy(), x, 0.05)
            r = got[grp, name]
            assert (r["coef"], r["se"]) == pytest.approx((beta[0], se[0]), abs=1e-6) and r["hazard_ratio_low"] == pytest.approx(math.exp(beta[0] - models.Z95 * se[0]), abs=1e-5)
            assert r["c_index"] == pytest.approx(kernels.concordance(own["t"].to_numpy(), own["e"].to_numpy(), x @ beta), abs=1e-6)


def test_conditional_cox(patients):
    frame, df = patients
    got = models.conditional_cox(df, "t", "e", ["x0", "x1", "x2", "x3"], 0.01, 0.05, 3)
    assert [c for c, _, _ in got] == ["x0", "x1"]
    beta, se = kernels.cox_fit(frame["t"].to_numpy(), frame["e"].to_numpy(), z(frame[["x0", "x1"]].to_numpy()))
    assert [b for _, b, _ in got] == pytest.approx(beta, abs=1e-6) and all(p < 1e-3 for _, _, p in got)
    assert models.conditional_cox(df.where("false"), "t", "e", ["x0"]) == []


def test_proportional_hazards(patients):
    frame, df = patients
    got = {r["grp"]: r for r in models.proportional_hazards(df, "grp", "t", "e", "x0").collect()}
    for grp, own in frame.groupby("grp"):
        t, e, x = own["t"].to_numpy(), own["e"].to_numpy(), z(own[["x0"]].to_numpy())[:, 0]
        beta, se = kernels.cox_fit(t, e, x[:, None])
        dead = np.flatnonzero(e == 1)
        w = np.exp(beta[0] * x)
        rest = np.array([x[i] - (w * x)[t >= t[i]].sum() / w[t >= t[i]].sum() for i in dead])
        rank = np.array([(t[dead] < t[i]).sum() + ((t[dead] == t[i]).sum() + 1) / 2 for i in dead])
        rank = rank - rank.mean()
        assert got[grp]["chi2"] == pytest.approx((rank @ rest) ** 2 * len(dead) * se[0] ** 2 / (rank @ rank), rel=1e-5)
        assert 0 < got[grp]["p_value"] <= 1


def test_logrank_of_groups(spark, patients):
    frame, df = patients
    two = models.logrank_groups(df, "t", F.col("e"), "grp").collect()
    one = statistics.logrank(df, "t", F.col("e"), F.col("grp") == "a").first()
    assert two[0]["chi2"] == pytest.approx(one["chi2"]) and two[0]["observed"] == one["observed"] and two[0]["expected"] == pytest.approx(one["expected"])
    three = models.logrank_groups(df.withColumn("k", F.col("id") % 3), "t", F.col("e"), "k").collect()
    t, e, g = frame["t"].to_numpy(), frame["e"].to_numpy(), frame["id"].to_numpy() % 3
    gap, spread = np.zeros(3), np.zeros((3, 3))
    for at in np.unique(t[e == 1]):
        r = np.array([((t >= at) & (g == k)).sum() for k in range(3)], float)
        d = np.array([((t == at) & (e == 1) & (g == k)).sum() for k in range(3)], float)
        gap += d - d.sum() * r / r.sum()
        if r.sum() > 1:
            spread += d.sum() * (r.sum() - d.sum()) / (r.sum() - 1) * (np.diag(r) / r.sum() - np.outer(r, r) / r.sum() ** 2)
    chi2 = gap[:2] @ np.linalg.solve(spread[:2, :2], gap[:2])
    assert three[0]["chi2"] == pytest.approx(chi2) and three[0]["df"] == 2 and three[0]["p_value"] == pytest.approx(math.exp(-chi2 / 2))


def test_tails(spark):
    # Published critical points of the 5 % level.
    for df, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (5, 11.0705), (10, 18.30704), (15, 24.99579)):
        assert spark.range(1).select(models.chi2_tail(F.lit(x), F.lit(df)).alias("p")).first()["p"] == pytest.approx(0.05, abs=2e-6)
    for df, t in ((1, 12.7062), (5, 2.570582), (30, 2.042272)):
        assert models.t_p(t, df) == pytest.approx(0.05, abs=1e-6)
    for a, b, f in ((2, 10, 4.102821), (4, 20, 2.866081), (1, 5, 6.607891)):
        assert models.f_p(f, a, b) == pytest.approx(0.05, abs=1e-6)
    from statistics import NormalDist

    for p in (1e-6, 0.01, 0.024, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6):
        assert spark.range(1).select(statistics.inverse_normal(F.lit(p)).alias("z")).first()["z"] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-8)


def test_straight_lines_and_u(spark, patients):
    frame, df = patients
    for r in models.straight_lines(df, "grp", "t", "x0").collect():
        own = frame[frame["grp"] == r["grp"]]
        x, y = own["x0"].to_numpy(), own["t"].to_numpy()
        slope, at = np.polyfit(x, y, 1)
        se = math.sqrt(((y - at - slope * x) ** 2).sum() / (len(x) - 2) / ((x - x.mean()) ** 2).sum())
        assert (r["slope"], r["se"], r["p_value"]) == pytest.approx((slope, se, models.t_p(slope / se, len(x) - 2)))
    r = models.mann_whitney_p(df.withColumn("one", F.lit(1)), "e", "t", ["one"]).first()
    a, b = frame["t"][frame["e"] == 1].to_numpy(), frame["t"][frame["e"] == 0].to_numpy()
    assert r["u"] == pytest.approx(sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b)))


def test_permuted_outcomes_move_together(spark):
    df = spark.createDataFrame([(i, i * 10, i * 100, -i) for i in range(40)], "id long, t long, e long, x long")
    out = models.permute_outcomes(df, "id", ["t", "e"], 3, "s").collect()
    for rep in (1, 2, 3):
        own = [r for r in out if r["rep"] == rep]
        assert sorted(r["t"] for r in own) == [i * 10 for i in range(40)] and all(r["e"] == 10 * r["t"] and r["x"] == -r["id"] for r in own)
        assert any(r["t"] != 10 * r["id"] for r in own)


def test_components_and_their_signs(spark):
    """Leading components against a singular value decomposition, oriented to a reference."""
    from pyspark.sql import functions as F

    from tessella.operators import kernels

    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 1))
    x = -base * [1, 2, 0.5, 1] + 0.4 * rng.normal(size=(60, 4)) + 3
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(99, None)], "id int, x array<double>").repartition(3)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    u, s, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    score = u[:, 0] * np.sqrt(59)
    for sign in (1, -1):
        out, share, loadings = kernels.oriented_component(df, "x", sign * F.get("x", F.lit(1)))
        got = {r["id"]: r["pc1"] for r in out.collect()}
        want = score * np.sign(np.corrcoef(score, sign * x[:, 1])[0, 1])
        assert got[99] is None and np.allclose([got[i] for i in range(60)], want, atol=1e-8)
        assert share == pytest.approx(s[0] ** 2 / (s**2).sum()) and np.allclose(np.abs(loadings), np.abs(vt[0]), atol=1e-8) and np.sign(loadings[1]) == sign
    _, axes, ratio = kernels.principal_components(df.where("id < 60"), "x", 2)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(ratio, s[:2] ** 2 / (s**2).sum()) and np.allclose(np.abs(axes.T), np.abs(vt[:2]), atol=1e-8)


def test_unique_pivots(spark):
    from tessella.operators import relational

    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 1, 7), ("b", 9, 8), ("a", None, 1)], "k string, c int, v int")
    assert sorted(map(tuple, relational.pivot_unique(df, "k", "c", "v", [1, 2]).collect()), key=str) == [("a", 5, 6), (None, 7, None)]
    with pytest.raises(ValueError):
        relational.pivot_unique(df.unionByName(df), "k", "c", "v", [1, 2])
