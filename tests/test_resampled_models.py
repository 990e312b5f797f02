"""Residuals on several covariates, bootstrapped models and permuted concordance against plain numpy on the same draws."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import kernels, models, statistics
from tests.test_riskblocks import plain

STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def count_of(seed, rep, key):
    u = (int(hashlib.md5(f"{seed}|{rep}|{key}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    return sum(u > s for s in STEPS)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    n = 90
    x = rng.normal(size=(n, 2)) * [2, 1] + [3, 0]
    t = np.ceil(rng.exponential(9, n) * np.exp(-0.4 * x[:, 0] + 1))
    return pd.DataFrame({"id": np.arange(n), "t": t, "e": rng.integers(0, 2, n), "a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] + rng.normal(size=n) > 3).astype(int)})


def test_residuals(spark):
    rng = np.random.default_rng(1)
    n = 80
    x = rng.normal(size=(n, 3))
    df = pd.DataFrame({"g": np.arange(n) % 3, "y": x @ [1, -2, 0.5] + rng.normal(size=n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "twice": 2 * x[:, 0] - x[:, 1], "train": np.arange(n) % 4 > 0})
    df["g"] = df["g"].astype("Int64").mask(df["g"] == 2)
    sdf = spark.createDataFrame([tuple(None if pd.isna(v) else getattr(v, "item", lambda: v)() for v in r) for r in df.itertuples(index=False)], "g long, y double, a double, b double, c double, twice double, train boolean")
    odd = spark.createDataFrame([(0, 1.0, None, 1.0, 1.0, 1.0, True), (0, float("inf"), 1.0, 1.0, 1.0, 1.0, True), (0, 1.0, float("nan"), 1.0, 1.0, 1.0, True), (7, 1.0, 1.0, 1.0, 1.0, 1.0, True)], sdf.schema)
    for xs in (["a"], ["a", "b", "c"], ["a", "b", "twice", "c"]):
        out = statistics.residuals(sdf.unionByName(odd), "y", xs, ["g"], F.col("train"), "z", scaled=True, least=5).toPandas()
        assert len(out) == n + 4 and out["z"].isna().sum() == 4 and list(out.columns) == [*df.columns, "z"]
        for g in (0, 1, None):
            own = df["g"].isna() if g is None else (df["g"] == g).fillna(False)
            own = own.to_numpy(bool)
            fit = own & df["train"].to_numpy()
            design = np.column_stack([np.ones(n), df[xs]])
            beta = np.linalg.lstsq(design[fit], df["y"][fit], rcond=None)[0]
            res = df["y"] - design @ beta
            got = out[(out["g"].isna() if g is None else out["g"] == g) & out["z"].notna()]
            assert np.allclose(np.sort(got["z"]), np.sort((res / res[fit].std(ddof=1))[own]), atol=1e-8)
    flat = statistics.residuals(sdf, "a", ["a"], [], out="z", scaled=True)
    assert flat.where("z IS NOT NULL").count() == 0
    assert statistics.residuals(sdf, "a", ["a"], [], out="z").agg(F.max(F.abs("z"))).first()[0] < 1e-9
    assert statistics.residuals(sdf.where("false"), "y", ["a", "b"], ["g"]).count() == 0


def test_bootstrapped_cox(spark, rows):
    found = models.bootstrap_cox(spark.createDataFrame(rows), "id", "t", "e", "a", ["b"], 6, "s")
    t, e = rows["t"].to_numpy(), rows["e"].to_numpy()
    z = ((rows[["a", "b"]] - rows[["a", "b"]].mean()) / rows[["a", "b"]].std()).to_numpy()
    coefs, cs = [], []
    for rep in range(7):
        w = np.array([1.0 if not rep else count_of("s", rep, i) for i in rows["id"]])
        b = np.zeros(2)
        for _ in range(40):
            _, grad, info = plain(t, e, z, w, b)
            b = b + np.linalg.solve(info + 0.05 * w.sum() * np.eye(2), grad - 0.05 * w.sum() * b)
        again = np.repeat(np.arange(len(w)), w.astype(int))
        coefs.append(b[0])
        cs.append(kernels.concordance(t[again], e[again], rows["a"].to_numpy()[again]))
    assert found["coef"] == pytest.approx(coefs[0], abs=1e-6) and found["c_index"] == pytest.approx(cs[0])
    assert (found["low"], found["high"]) == pytest.approx(tuple(np.exp(np.quantile(coefs[1:], [0.025, 0.975]))), abs=1e-6)
    assert (found["c_low"], found["c_high"]) == pytest.approx(tuple(np.quantile(cs[1:], [0.025, 0.975])))
    assert found["probability_positive"] == np.mean(np.array(coefs[1:]) > 0) and found["valid"] == found["c_valid"] == 6 and found["n"] == 90
    none = models.bootstrap_cox(spark.createDataFrame(rows).where("false"), "id", "t", "e", "a", [], 2, "s")
    assert none["coef"] is None and none["valid"] == 0


def test_bootstrapped_logistic(spark, rows):
    found = models.bootstrap_logistic(spark.createDataFrame(rows), "id", "y", "a", ["b"], 5, "s")
    y = rows["y"].to_numpy()
    z = np.column_stack([np.ones(90), ((rows[["a", "b"]] - rows[["a", "b"]].mean()) / rows[["a", "b"]].std()).to_numpy()])
    coefs = []
    for rep in range(6):
        w = np.array([1.0 if not rep else count_of("s", rep, i) for i in rows["id"]])
        b = np.zeros(3)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ b))
            b = b + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(3), z.T @ (w * (y - p)) - 1e-6 * b)
        coefs.append(b[1])
    assert found["coef"] == pytest.approx(coefs[0], abs=1e-6)
    assert (found["low"], found["high"]) == pytest.approx(tuple(np.exp(np.quantile(coefs[1:], [0.025, 0.975]))), rel=1e-6)
    assert found["valid"] == 5 and found["probability_positive"] == 1.0


def test_permuted_concordance_and_kruskal_of_odd_tables(spark, rows):
    df = spark.createDataFrame(rows)
    one = models.permutation_concordance(df, "id", "t", "e", "a", 4, "s").first()
    assert one["c_index"] == pytest.approx(kernels.concordance(rows["t"].to_numpy(), rows["e"].to_numpy(), rows["a"].to_numpy()))
    assert one["reps"] == 4 and one["p_one_sided"] == 0.2
    lost = models.permutation_concordance(df.withColumn("e", F.lit(0)), "id", "t", "e", "a", 2, "s").first()
    assert lost["c_index"] is None and lost["p_one_sided"] is None
    none = models.permutation_kruskal(df.where("false"), "id", "y", "a", 2, "s").first()
    assert none["h"] is None and none["p_one_sided"] is None


@pytest.mark.parametrize("most", [12, 3])
def test_split_halves(spark, most):
    from itertools import combinations

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6)) + rng.normal(size=(40, 1))
    x[:, 1] *= -1
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(6)] + [(99, 0, 1.0)], "id int, f int, v double")
    members = spark.createDataFrame([("m", 0, 1.0), ("m", 1, -2.0), ("m", 2, 0.0), ("m", 3, 1.0), ("m", 4, 3.0), ("pair", 0, 1.0), ("pair", 5, 1.0), ("one", 2, 1.0)], "module string, feature int, weight double")
    got = {r["module"]: r for r in statistics.split_half(long, "id", "f", "v", members, "s", most, 7).collect()}
    assert set(got) == {"m", "pair"}
    own = x[:, :5] * [1, -1, 1, 1, 1]
    if most == 12:
        firsts = list(combinations(range(5), 2))
    else:
        firsts = [sorted(range(5), key=lambda i: hashlib.md5(f"s|m|{k}|{i}".encode()).hexdigest())[:2] for k in range(1, 8)]
    r = [np.corrcoef(own[:, list(f)].mean(axis=1), own[:, [i for i in range(5) if i not in f]].mean(axis=1))[0, 1] for f in firsts]
    assert got["m"]["splits"] == len(r) and got["m"]["mean_r"] == pytest.approx(np.mean(r), abs=1e-8)
    assert [got["m"][c] for c in ("q05", "median_r", "q95")] == pytest.approx(np.quantile(r, [0.05, 0.5, 0.95]).tolist(), abs=1e-8)
    assert got["m"]["share_above"] == np.mean(np.array(r) > 0.3) and got["m"]["method"].startswith("all" if most == 12 else "drawn")
    assert got["pair"]["mean_r"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 5])[0, 1], abs=1e-8)


def test_screens_and_their_permutations(spark):
    rng = np.random.default_rng(11)
    n = 70
    x = rng.normal(size=(n, 3))
    t = np.ceil(rng.exponential(10, n) * np.exp(-0.9 * x[:, 0]))
    e = (rng.random(n) < 0.8).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "t": t, "e": e, "x": x.tolist()}))

    def fit(v, tt, ee):
        z = ((v - v.mean()) / v.std(ddof=1))[:, None]
        b = np.zeros(1)
        for _ in range(40):
            _, grad, info = plain(tt, ee, z, np.ones(len(v)), b)
            b = b + grad / info[0]
        return b[0], kernels.normal_p(b[0] * np.sqrt(info[0, 0]))

    with_holes = df.withColumn("x", F.when(F.col("id") < 5, F.array(F.get("x", F.lit(0)), F.lit(None).cast("double"), F.get("x", F.lit(2)))).otherwise(F.col("x")))
    got = {r["feature"]: r for r in models.cox_screen(with_holes, "t", "e", "x").collect()}
    for i in range(3):
        own = np.arange(n) >= (5 if i == 1 else 0)
        b, p = fit(x[own, i], t[own], e[own])
        assert got[i]["n"] == own.sum() and got[i]["coef"] == pytest.approx(b, abs=1e-6) and got[i]["p_value"] == pytest.approx(p, rel=1e-5) and got[i]["error"] is None
    assert models.cox_screen(df.withColumn("x", F.array(F.lit(1.0))), "t", "e", "x").first()["error"] == "no_features"
    assert models.cox_screen(df.where("false"), "t", "e", "x").count() == 0
    null = {r["rep"]: r for r in models.permutation_screen(df, "id", "t", "e", "x", 2, "s").collect()}
    for rep in range(3):
        order = list(range(n)) if not rep else sorted(range(n), key=lambda i: (int(hashlib.md5(f"s|{rep}|{i}".encode()).hexdigest()[:8], 16), i))
        p = [fit(x[:, i], t[order], e[order])[1] for i in range(3)]
        assert null[rep]["tested"] == 3 and null[rep]["least_p"] == pytest.approx(min(p), rel=1e-4) and null[rep]["n_p05"] == sum(v < 0.05 for v in p)
