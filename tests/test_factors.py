"""The multigroup factor model on planted factors; activity classes and subspaces."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators import factors


def planted(seed=0):
    """Three groups: two shared factors, one of two groups, one of one group; sparse weights, noise by feature and group."""
    rng = np.random.default_rng(seed)
    d, k = 120, 4
    w = rng.normal(size=(d, k)) * (rng.random((d, k)) < 0.25) * 1.5
    on = np.array([[1, 1, 1, 0], [1, 1, 1, 0], [1, 1, 0, 1]], float)
    rows = []
    for g in range(3):
        z = rng.normal(size=(150 + 40 * g, k)) * on[g]
        x = z @ w.T + rng.normal(size=(len(z), d)) * rng.uniform(0.4, 0.8, d) + 3 * g
        rows += [(f"g{g}", v.tolist()) for v in x]
    return w, on, rows


@pytest.fixture(scope="module")
def fitted(spark):
    w, on, rows = planted()
    df = spark.createDataFrame([*rows, ("g0", None), ("g0", [float("nan")] * 120)], "grp string, x array<double>").repartition(5)
    return w, on, df, factors.fit(df, "grp", "x", 8, least_r2=0.005)


def test_planted_factors_are_recovered(fitted):
    w, on, df, model = fitted
    assert model.settled and model.weights.shape == (120, 4) and model.dropped == 4
    found = model.weights / np.linalg.norm(model.weights, axis=0)
    cosine = np.abs((w / np.linalg.norm(w, axis=0)).T @ found)
    match = cosine.argmax(axis=1)
    assert sorted(match) == [0, 1, 2, 3] and cosine.max(axis=1).min() > 0.99
    # Relevance by group: a factor that a group lacks explains nothing there.
    share = model.r2[:, match]
    assert (share[on == 0] < 0.005).all() and (share[on == 1] > 0.02).all()
    # Zeros of the weights.
    gamma = model.inclusion[:, match]
    assert (gamma[np.abs(w) > 0.5] > 0.9).all() and np.mean(gamma[w == 0] < 0.5) > 0.95
    assert (model.total > 0.6).all() and np.all(np.abs(model.total - model.r2.sum(axis=1)) < 0.05)


def test_scores(fitted):
    _, _, df, model = fitted
    out = model.scores(df, "grp", "x").toPandas()
    lost = out["factors"].isna()
    assert lost.sum() == 2
    own = out[~lost & (out["grp"] == "g1")]
    want = (np.stack(own["x"]) - model.means[1]) @ model.projections[1].T
    assert np.allclose(np.stack(own["factors"]), want, atol=1e-9)


def test_odd_tables(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), (None, [2.0, 1.0]), ("a", [1.0, 2.0])], "grp string, x array<double>")
    assert factors.fit(df, "grp", "x", 3, rounds=3).groups == ["a", None]
    assert factors.fit(df.where("false"), "grp", "x", 3).groups == []
    with pytest.raises(ValueError):
        factors.fit(df.unionByName(spark.createDataFrame([("a", [1.0])], df.schema)), "grp", "x", 2)


def test_activity_and_subspaces(spark):
    rows = [("F1", "a", 3.0), ("F1", "b", 0.6), ("F1", "c", 1.0), ("F2", "a", 2.0), ("F2", "b", 2.5), ("F3", "c", 0.7), ("F3", "c", 0.4), ("F4", "b", None), ("F4", "z", 9.0), ("F5", "b", 1.0), ("F5", "c", 1.5)]
    out = factors.activity(spark.createDataFrame(rows, "factor string, `group` string, r2 double"), ["a", "b", "c"]).toPandas().set_index(["factor", "threshold"])
    assert out.loc[("F1", 0.5), "activity_class"] == "ubiquitous_shared" and out.loc[("F1", 1.0), "active_groups"] == "a;c"
    assert out.loc[("F2", 2.0), "activity_class"] == "partially_shared" and out.loc[("F3", 1.0), "activity_class"] == "group_specific"
    assert out.loc[("F4", 0.5), "activity_class"] == "inactive" and out.loc[("F1", 2.0), "mean_r2"] == pytest.approx(4.6 / 3)
    one = factors.activity(spark.createDataFrame(rows, "factor string, `group` string, r2 double"), ["a", "b", "c"]).where("threshold = 1.0")
    spans = {}
    for r in factors.subspaces(one, ["a", "b", "c"], "c").orderBy("subspace", "place").collect():
        spans.setdefault(r["subspace"], []).append(r["factor"])
    assert spans == {
        "all_retained": ["F1", "F2", "F3", "F4", "F5"], "shared_two_or_more": ["F1", "F2", "F5"], "partially_shared": ["F1", "F2", "F5"],
        "shared_without_c": ["F2"], "shared_with_c": ["F1", "F5"], "c_specific": ["F3"],
    }


def test_digamma():
    assert np.allclose(factors.digamma(np.array([0.5, 1.0, 10.0])), [-1.9635100260214235, -0.5772156649015329, 2.251752589066721], atol=1e-10)
