"""Fits by group and placements of draws without a task or window that holds a group."""

import numpy as np
import pandas as pd
import pytest

from tessella.operators import kernels, resampling


@pytest.fixture
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=240).round(2)
    return pd.DataFrame({"id": np.arange(240), "g": np.where(np.arange(240) % 3 == 0, "b", "a"), "x": x, "y": (x + rng.normal(size=240) > 0).astype(int), "t": rng.integers(1, 40, 240).astype(float)})


def test_fits_by_group(spark, rows, monkeypatch):
    monkeypatch.setattr(kernels, "by_group", lambda *a: pytest.fail("a group in one task"))
    df = spark.createDataFrame(rows)
    cox = {r["g"]: r for r in kernels.cox_by_feature(df, "g", "t", "y", "x").collect()}
    logistic = {r["g"]: r for r in kernels.logistic_by_group(df, "g", "y", "x", 1e-3).collect()}
    for g, own in rows.groupby("g"):
        z = ((own["x"] - own["x"].mean()) / own["x"].std()).to_numpy()
        beta, se = kernels.cox_fit(own["t"].to_numpy(), own["y"].to_numpy(), z[:, None])
        assert (cox[g]["n"], cox[g]["coef"], cox[g]["se"]) == pytest.approx((len(own), beta[0], se[0]), abs=1e-7)
        beta, se = kernels.logistic_fit(own["y"].to_numpy(float), own[["x"]].to_numpy(), 1e-3)
        assert (logistic[g]["n"], logistic[g]["coef"], logistic[g]["se"]) == pytest.approx((len(own), beta[1], se[1]), abs=1e-7)


def test_windows_hold_ranges(spark, rows):
    df = spark.createDataFrame(rows)
    for found in (resampling.folds(df, "id", "y", 5, "s"), resampling.permutation_auc(df, "id", "y", "x", 3, "s")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
        assert windows and all("__cell" in line for line in windows)
