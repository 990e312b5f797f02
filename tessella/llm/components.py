"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import store


def components(links: DataFrame) -> DataFrame:
    """Each linked node and the smallest node that it reaches: ``node, component``.

    ``links`` has the long columns ``a`` and ``b``; nulls and loops are ignored, and nodes that are the smallest of their
    component, as those without links, are left out. Each step replaces a node's links by links to its smallest
    neighbour and is written to the shared folder; no node's neighbours are gathered. Ends when a step changes nothing.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    last = None
    while True:
        edges = store.materialize(edges, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = edges.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        moved = large.join(lowest, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = moved.unionByName(lowest.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()


class Labels:
    """Union-find over positions, in vectorised steps; a label is the smallest position joined so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join positions pairwise."""
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while len(i) and (label[label] != label).any():
                label[:] = label[label]
