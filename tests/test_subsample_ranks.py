import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import modules
from tessella.operators.resampling import draw


@pytest.mark.parametrize("size", [1 << 16, 40])
def test_subsamples_are_ranked_without_repeating_rows(spark, monkeypatch, size):
    rng = np.random.default_rng(3)
    n, k, reps = 300, 4, 5
    x = rng.normal(size=(n, k))
    x[:, 1] = np.round(x[:, 0])
    x[rng.random(n) < 0.6, 2] = 0.5
    x[:, 3] += x[:, 0]
    long = spark.createDataFrame(pd.DataFrame([(i, f"f{j}", x[i, j]) for i in range(n) for j in range(k)], columns=["id", "feature", "value"])).where("NOT (id = 7 AND feature = 'f1')").repartition(3)
    written, found, cut, signed = [], [], modules.cut, modules.signed_modules

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    def kept(rows, r, *more):
        found.append((rows, r))
        return signed(rows, r, *more)

    monkeypatch.setattr(modules, "cut", counted)
    monkeypatch.setattr(modules, "signed_modules", kept)
    monkeypatch.setattr(modules, "RANGE", size, raising=False)
    modules.subsample_stability(long, "id", "feature", "value", reps=reps, share=0.5, seed="s")
    assert max(written) <= n * k

    ids = spark.range(n)
    frame = pd.DataFrame(x, columns=[f"f{j}" for j in range(k)])
    frame.loc[7, "f1"] = np.nan
    for rep, (rows, r) in enumerate(found):
        own = [a["id"] for a in ids.orderBy(draw("s", F.lit(rep), F.col("id")), "id").limit(150).collect()] if rep else list(range(n))
        ranks = frame.loc[own].rank()
        ranks = ranks[ranks.notna().all(axis=1)]
        assert rows == len(ranks)
        assert np.allclose(r, np.corrcoef(ranks.to_numpy(), rowvar=False))
    assert len(found) == 1 + reps
