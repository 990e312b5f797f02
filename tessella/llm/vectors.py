"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors of cosine ``c`` lie ``sqrt(2 - 2 c)`` apart, and no farther in any orthonormal projection. Vectors are sorted
by their grid cells on leading principal dimensions (epsilon grid order) and cut into blocks. Blocks whose boxes on these
dimensions lie farther apart than epsilon are skipped; the others are joined by halving their sequence intervals, skipping
distant halves, down to intervals that are compared exactly in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.components import Labels, components

#: Principal dimensions of the grid, vectors a block, and those an interval is compared at.
DIMENSIONS, BLOCK, LEAF = 6, 256, 64
#: Blocks that meet in one task.
MEETING = 2048
#: What rounding may add to distances.
SLACK = 1e-6


def valid(embedding: str = "embedding", label: str = "label"):
    """Whether a row can link: label and vector are there, all components finite, the length above zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~bad & some, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def principal_axes(classes: DataFrame, size: int, dimensions: int) -> np.ndarray:
    """The leading eigenvectors of the unit vectors' covariance, over all vectors of length ``size``; sums alone are gathered."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + size * size)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    rows = classes.where(F.col("dim") == size).select("vector").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(1 + size + size * size)
    for r in rows:
        total[r["i"]] = r["v"]
    n = max(total[0], 1.0)
    mean = total[1 : 1 + size] / n
    values, axes = np.linalg.eigh(total[1 + size :].reshape(size, size) / n - np.outer(mean, mean))
    return axes[:, np.argsort(-values)[:dimensions]]


def _apart(a: np.ndarray, b: np.ndarray) -> float:
    """The least squared distance of two intervals' boxes."""
    gap = np.maximum(0.0, np.maximum(b.min(axis=0) - a.max(axis=0), a.min(axis=0) - b.max(axis=0)))
    return float((gap * gap).sum())


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, cosine: float, same: bool, at: int = 0, to: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs of two sequence intervals; ``x, y`` are unit vectors, ``px, py`` their projections.

    Distant intervals are skipped, large ones halved. With ``same`` both are one interval and each pair comes once.
    """
    if not same and _apart(px, py) > (2 - 2 * cosine) * (1 + SLACK) + SLACK:
        return
    if max(len(x), len(y)) <= LEAF:
        i, j = np.nonzero(x @ y.T >= cosine)
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i + at, j + to
        return
    if same:
        h = len(x) // 2
        yield from join_intervals(x[:h], px[:h], x[:h], px[:h], cosine, True, at, to)
        yield from join_intervals(x[:h], px[:h], x[h:], px[h:], cosine, False, at, to + h)
        yield from join_intervals(x[h:], px[h:], x[h:], px[h:], cosine, True, at + h, to + h)
    elif len(x) >= len(y):
        h = len(x) // 2
        yield from join_intervals(x[:h], px[:h], y, py, cosine, False, at, to)
        yield from join_intervals(x[h:], px[h:], y, py, cosine, False, at + h, to)
    else:
        h = len(y) // 2
        yield from join_intervals(x, px, y[:h], py[:h], cosine, False, at, to)
        yield from join_intervals(x, px, y[h:], py[h:], cosine, False, at, to + h)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], epsilon: float, block: int) -> DataFrame:
    """The classes in epsilon grid order, cut into blocks of one label and length, written as a table."""
    place = pa.schema([("class_id", pa.int64()), ("n", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("vector", pa.list_(pa.float64())), *((f"c{i}", pa.int32()) for i in range(DIMENSIONS))])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for size in np.unique(dims):
                own = b.filter(pa.array(dims == size))
                x = _unit(_matrix(own.column("vector")))
                cell = np.zeros((len(x), DIMENSIONS), np.int32)
                projected = np.floor(x @ axes[int(size)] / epsilon).astype(np.int32)
                cell[:, : projected.shape[1]] = projected
                yield store.batch(place, class_id=own.column("class_id"), n=own.column("n"), label=own.column("label"), dim=own.column("dim"), vector=own.column("vector"), **{f"c{i}": cell[:, i] for i in range(DIMENSIONS)})

    keys = ["label", "dim", *(f"c{i}" for i in range(DIMENSIONS)), "class_id"]
    kind = "class_id long, n long, label string, dim int, vector array<double>, " + ", ".join(f"c{i} int" for i in range(DIMENSIONS))
    order = classes.select("class_id", "n", "label", "dim", "vector").mapInArrow(cells, kind).repartitionByRange(*keys).sortWithinPartitions(*keys)
    made = pa.schema([("block", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, waiting = TaskContext.get().partitionId(), 0, None

        def make(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            size = rows.column("dim")[0].as_py()
            vectors = np.concatenate([_matrix(c) for c in rows.column("vector").chunks])
            p = _unit(vectors) @ axes[size]
            row = store.batch(made, block=[part << 32 | number], label=[rows.column("label")[0].as_py()], dim=[size], lo=[p.min(axis=0).tolist()], hi=[p.max(axis=0).tolist()], ids=[rows.column("class_id").to_numpy().astype("<i8").tobytes()], counts=[rows.column("n").to_numpy().astype("<i8").tobytes()], vectors=[vectors.astype("<f8").tobytes()])
            number += 1
            return row

        for b in batches:
            table = pa.Table.from_batches([b])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            labels, dims = waiting.column("label").to_pylist(), waiting.column("dim").to_pylist()
            at = 0
            for i in range(1, len(labels) + 1):
                if i == len(labels) or (labels[i], dims[i]) != (labels[at], dims[at]) or i - at == block:
                    if i < len(labels):
                        yield make(waiting.slice(at, i - at))
                        at = i
            waiting = waiting.slice(at)
        if waiting is not None and waiting.num_rows:
            yield make(waiting)

    return store.materialize(order.mapInArrow(cut, "block long, label string, dim int, lo array<double>, hi array<double>, ids binary, counts binary, vectors binary"), "ego-blocks")


def _near_blocks(blocks: DataFrame, epsilon: float, most: int = MEETING) -> DataFrame:
    """Pairs of blocks ``a <= b`` of one label and length whose boxes are within epsilon.

    Blocks meet by the stripes of epsilon's width that they touch on leading dimensions, each pair in one meeting. A label
    with more blocks uses more dimensions, one for each power of ten, so that meetings stay small where its vectors spread;
    a meeting of more than ``most`` blocks is dealt to several tasks: one side in parts, the other to each of them.
    """
    boxes = blocks.select("block", "label", "dim", "lo", "hi")
    depth = boxes.groupBy("label", "dim").agg(F.greatest(F.lit(1), F.ceil(F.log10(F.count("*")))).alias("depth")).select(F.col("label").alias("of_label"), F.col("dim").alias("of_dim"), "depth")
    touched = boxes.join(depth, (F.col("label") == F.col("of_label")) & (F.col("dim") == F.col("of_dim"))).drop("of_label", "of_dim")
    stripe = lambda bound, i: F.coalesce(F.floor(F.try_element_at(bound, F.lit(i + 1)) / F.lit(epsilon * (1 + SLACK))), F.lit(0)).cast("int")
    places = range(DIMENSIONS)
    for i in places:
        used = F.lit(i) < F.col("depth")
        touched = touched.withColumn(f"s{i}", F.when(used, stripe(F.col("lo"), i)).otherwise(0))
        touched = touched.withColumn(f"t{i}", F.explode(F.when(used, F.sequence(stripe(F.col("lo"), i), stripe(F.col("hi"), i) + 1)).otherwise(F.array(F.lit(0)))))
    keys = ["label", "dim", *(f"t{i}" for i in places)]
    meeting = F.xxhash64(*keys)
    touched = store.materialize(touched.withColumn("meeting", meeting), "ego-stripes")
    parts = touched.groupBy("meeting").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")).withColumnRenamed("meeting", "of")
    touched = touched.join(parts, F.col("meeting") == F.col("of")).drop("of")
    a = touched.withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int")).alias("a")
    b = touched.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("meeting", "part")]
    on += [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.block") <= F.col("b.block")]
    on += [F.col(f"a.t{i}") == F.greatest(F.col(f"a.s{i}"), F.col(f"b.s{i}")) for i in places]
    gaps = F.zip_with(
        F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)
    )
    far = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    return a.join(b, on).where(far <= epsilon * epsilon * (1 + SLACK) + SLACK).select(F.col("a.block").alias("a"), F.col("b.block").alias("b"))


def near_duplicates(rows: DataFrame, cosine: float = 0.98, key: str = "vec_id", embedding: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """A row for each row: ``vec_id, n_links, component_id, kept``.

    Vectors link where labels and lengths are equal and the cosine is at least ``cosine``. ``n_links`` counts the rows
    linked directly, equal vectors among them; ``component_id`` is the smallest key reachable; ``kept`` tells whether
    that is the row's own. Rows that can't link (see :func:`valid`) have no links and their own key. Equal vectors of a
    label are one class and compared once, whatever their number. A null key is larger than all others, so a component
    of null keys alone has a null ``component_id`` and is not kept. An empty table gives an empty result.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine)) or 1e-6
    own = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vector"))
    own = own.withColumn("ok", valid("vector", "label"))
    classes = own.where("ok").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = store.materialize(classes.withColumn("class_id", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")), "vector-classes")
    axes = {r["dim"]: principal_axes(classes, r["dim"], min(DIMENSIONS, r["dim"])) for r in classes.select("dim").distinct().collect()}
    blocks = _blocks(classes, axes, epsilon, block)
    pairs = store.materialize(_near_blocks(blocks, epsilon), "ego-pairs")
    payload = lambda side: blocks.select(F.col("block").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("ids", "counts", "vectors")], *([F.col("dim")] if side == "a" else []))
    joined = pairs.join(payload("a"), "a").join(payload("b"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                value = {n: rows.column(n)[i].as_py() for n in rows.schema.names}
                size = value["dim"]
                ids, counts, x = ([np.frombuffer(value[f"{n}_{s}"], t) for s in "ab"] for n, t in (("ids", "<i8"), ("counts", "<i8"), ("vectors", "<f8")))
                x = [_unit(v.reshape(-1, size)) for v in x]
                p = [v @ axes[size] for v in x]
                same = value["a"] == value["b"]
                n = len(ids[0])
                links = [np.zeros(len(c), np.int64) for c in ids]
                labels = Labels(n + (0 if same else len(ids[1])))
                for k, m in join_intervals(x[0], p[0], x[1], p[1], cosine, same):
                    np.add.at(links[0], k, counts[1][m])
                    np.add.at(links[0 if same else 1], m, counts[0][k])
                    labels.join(k, m if same else m + n)
                node = ids[0] if same else np.concatenate(ids)
                link = links[0] if same else np.concatenate(links)
                some = link > 0
                if some.any():
                    yield store.batch(schema, a=node[some], b=node[labels.label[some]], links=link[some])

    found = store.materialize(joined.mapInArrow(compare, "a long, b long, links long"), "ego-links")
    counted = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "counted")
    joined = components(found.select("a", "b"))
    labelled = classes.join(counted, F.col("class_id") == F.col("counted"), "left").join(joined, F.col("class_id") == F.col("node"), "left")
    labelled = store.materialize(labelled.select("label", "vector", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class_id").alias("component")), "vector-labels")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "of")
    known = labelled.join(least, F.col("component") == F.col("of")).select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id")
    known = store.materialize(known, "vector-known")
    linked = own.where("ok").join(known, (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector")), "left")
    linked = linked.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    alone = own.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
