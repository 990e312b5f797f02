"""Nearest rows of a stated query set by correlation, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows a block of queries or of candidates.
BLOCK = 1024


def _packed(df: DataFrame, key: str, vector: str, side: str) -> DataFrame:
    """Rows gathered into blocks of about ``BLOCK`` by a hash of the key: ``{side}_ids`` and ``{side}_vectors``."""
    n = max(1, -(-df.count() // BLOCK))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("block"))
    return rows.groupBy("block").agg(F.collect_list(F.struct("k", "v")).alias("rows")).select(F.col("rows.k").alias(f"{side}_ids"), F.col("rows.v").alias(f"{side}_vectors"))


def _standard(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    x = x - x.mean(axis=1, keepdims=True)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The ``k`` rows of the highest Pearson correlation with each query, itself left out: ``query, neighbor, r, place``.

    Each block of queries meets each block of rows once and keeps its best ``k``; ties go to the smaller key. Vectors have
    one length; one without spread correlates with nothing.
    """
    pairs = _packed(queries, key, vector, "query").crossJoin(_packed(rows, key, vector, "row"))  # blocks of a stated query set

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_ids, q, r_ids, r in zip(b["query_ids"], b["query_vectors"], b["row_ids"], b["row_vectors"], strict=True):
                q_ids, r_ids = np.asarray(q_ids), np.asarray(r_ids)
                order = np.argsort(r_ids)
                r_ids = r_ids[order]
                c = np.round(_standard(q) @ _standard(r)[order].T, 12)
                c[q_ids[:, None] == r_ids[None, :]] = -np.inf
                top = np.argsort(-c, axis=1, kind="stable")[:, :k]
                found = pd.DataFrame({"query": np.repeat(q_ids, top.shape[1]), "neighbor": r_ids[top].reshape(-1), "r": np.take_along_axis(c, top, 1).reshape(-1)})
                yield found[np.isfinite(found["r"])]

    found = pairs.mapInPandas(best, "query long, neighbor long, r double")
    order = Window.partitionBy("query").orderBy(F.desc("r"), "neighbor")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
