"""Fits by Spark sums, and concordance, against numpy over all rows."""

import os

import numpy as np
import pandas as pd
import pytest

from tessella.operators import fits, kernels
from tessella.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("ranges", [2, 7])
def test_concordance_of_continuous_risks(spark, ranges):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"g": np.repeat(np.arange(2, dtype=np.int32), 150), "t": rng.integers(0, 12, 300).astype(float), "e": rng.integers(0, 2, 300), "r": np.round(rng.normal(size=300), 1), "n": 1})
    rows.loc[:80, "t"] = 5.0
    rows.loc[100:200, "r"] = 0.3
    got = {r["g"]: r["c_index"] for r in fits.concordance(spark.createDataFrame(rows), "t", "e", "r", ranges).collect()}
    for g, own in rows.groupby("g"):
        assert got[g] == pytest.approx(kernels.concordance(own["t"].to_numpy(), own["e"].to_numpy(), own["r"].to_numpy()), abs=1e-12)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_held_out_concordance_keeps_every_order(spark):
    got = {r["grp"]: r for r in catalog.queries()["held_out_concordance"](spark, SF).collect()}
    o = pd.read_parquet(f"{SF}/orders.parquet", columns=["o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    days = np.abs((pd.to_datetime(o["o_orderdate"]) - pd.Timestamp("1995-01-01")).dt.days.to_numpy(float))
    price, event, held = o["o_totalprice"].to_numpy(float), (o["o_orderstatus"] == "F").to_numpy(int), o["o_orderkey"].to_numpy() % 5 == 0
    x = np.column_stack([np.log1p(price), price % 97])
    assert set(got) == set(o["o_orderpriority"])
    for grp, r in got.items():
        own = (o["o_orderpriority"] == grp).to_numpy()
        a, b = own & ~held, own & held
        z = (x - x[a].mean(axis=0)) / x[a].std(axis=0, ddof=1)
        beta, _ = kernels.cox_fit(days[a], event[a], z[a], ridge=0.05)
        assert (r["train"], r["test"], r["error"]) == (a.sum(), b.sum(), None)
        assert [r["beta1"], r["beta2"]] == pytest.approx(beta, abs=1e-7)
        assert r["c_index"] == pytest.approx(kernels.concordance(days[b], event[b], z[b] @ beta), abs=1e-6)
