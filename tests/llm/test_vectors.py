"""Embedding links against all pairs."""

import numpy as np
import pytest
from tests.llm.test_simhash import plain_components

from tessella.llm import vectors
from tessella.llm.queries import op7_embedding_near_dedup


def plain(rows, cosine):
    def ok(r):
        return r[2] is not None and r[1] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    near, links = [], {i: 0 for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if ok(a) and ok(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    near.append((i, j))
                    links[i] += 1
                    links[j] += 1
    root = plain_components(range(len(rows)), near)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], least[root[i]], least[root[i]] == rows[i][0]) for i in range(len(rows))]


def found(df, **more):
    return [tuple(r) for r in vectors.near_duplicates(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()]


@pytest.mark.parametrize("block", [256, 16])
def test_links(spark, block):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 12 % 3)))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(found(df, block=block)) == sorted(plain(rows, 0.98))


@pytest.mark.parametrize("most", [1, 5, 2048])
def test_blocks_meet_once_and_all(spark, most):
    rng = np.random.default_rng(2)
    boxes = []
    for i in range(150):
        lo = rng.uniform(-1, 1, 6)
        boxes.append((i, "x" if i % 4 else "y", 6, lo.tolist(), (lo + rng.choice([0.05, 0.3], 6)).tolist()))
    df = spark.createDataFrame(boxes, "block long, label string, dim int, lo array<double>, hi array<double>")
    gap = lambda a, b: sum(max(0, x - w, y - v) ** 2 for x, v, y, w in zip(a[3], a[4], b[3], b[4], strict=True))
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] <= b[0] and a[1] == b[1] and gap(a, b) <= 0.25 * (1 + 1e-6) + 1e-6)
    assert sorted(map(tuple, vectors._near_blocks(df, 0.5, most).collect())) == want and len(want) > 200


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)], int(i % 2)) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, op7_embedding_near_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())) == sorted(plain(rows, 0.98))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.001], 1), (12, [1.0, 0.001], 1), (13, [1e-30, 0.0], 1), (14, [3e38, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n", "2 AS dim", "3 AS class_id", "4 AS vector", "5 AS links")
    assert sorted(found(df)) == sorted(plain(rows, 0.98))
    assert found(df.where("false")) == []


def test_intervals_join_all_pairs():
    rng = np.random.default_rng(1)
    x = vectors._unit(np.repeat(rng.normal(size=(40, 8)), 8, axis=0) + rng.normal(size=(320, 8)) * 0.05)
    axes = np.linalg.qr(rng.normal(size=(8, 3)))[0]
    x = x[np.lexsort(np.floor(x @ axes / 0.2).T[::-1])]
    p = x @ axes
    got = {(min(a, b), max(a, b)) for i, j in vectors.join_intervals(x, p, x, p, 0.98, True) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert got == set(zip(i.tolist(), j.tolist(), strict=True)) and len(got) > 500
