import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.operators.riskblocks import Fit, RiskBlocks, Spec


def test_blocks_of_wide_rows_are_bounded_and_whole_weights_take_a_byte(spark):
    rng = np.random.default_rng(1)
    n, k = 3000, 1200
    rows = spark.createDataFrame(pd.DataFrame({"t": rng.random(n), "e": rng.integers(0, 2, n), "w": rng.integers(0, 4, n)})).select("t", "e", F.array_repeat(F.col("t"), k).alias("x"), F.array(F.col("w").cast("double")).alias("w"))
    blocks = RiskBlocks(rows, "t", "e", "x", "w")
    sizes = blocks.blocks.select("rows", F.length("x").alias("x"), F.length("w").alias("w")).collect()
    assert max(r["x"] for r in sizes) < 16 << 20 and len(sizes) > 2
    assert all(r["w"] == r["rows"] for r in sizes)
    risks = blocks.risks({7: (Fit(Spec(0, (3,)), beta=np.ones(1), scale=np.ones(1)), 0)})
    found = risks.agg(F.sum("n"), F.count_if(F.abs(F.col("risk") - F.col("t")) < 1e-12), F.count("*"), F.max("g")).first()
    want = rows.agg(F.sum(F.col("w")[0]), F.count_if(F.col("w")[0] > 0)).first()
    assert tuple(found) == (want[0], want[1], want[1], 7)
