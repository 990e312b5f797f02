"""Modules of correlated features: how stable they are under subsamples of rows, and how well another cohort preserves them.

Correlations are sums over rows, for all subsamples at once. What is worked out on the driver, or in a task, is of the size of
the features, of which ``MOST`` are allowed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import models
from tessella.operators.cuts import cut
from tessella.operators.kernels import average_linkage
from tessella.operators.resampling import RANGE_BITS, draw, replicates

#: Features of one correlation matrix: 128 MB.
MOST = 4096
#: Values of a feature put in order at once, and bytes aimed at in a task and in the rows that a task has in memory at once.
RANGE, TASK, BUCKET = 1 << 16, 64 << 20, 4 << 20


def critical_correlation(n: int, p: float = 0.01) -> float:
    """The least correlation of ``n`` rows whose two-sided p by Student's t is below ``p``; 1 for fewer than three rows."""
    if n < 3:
        return 1.0
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if models.t_p(mid, n - 2) > p else (low, mid)
    return low / math.sqrt(n - 2 + low * low)


def rank_correlations(long: DataFrame, row: str, feature: str, value: str, by: str) -> tuple[list, dict]:
    """Spearman's correlations of all features by group: the features, and by group ``(rows, matrix)``.

    Ranks are taken within groups and features. Features without spread in a group correlate with nothing there, and their
    diagonal is 0; rows that lack a feature are left out of its group.
    """
    names, found = _correlations(long.select(F.col(by).cast("long").alias("g"), F.col(row).alias("row"), F.col(feature).alias("feature"), F.col(value).alias("value"), F.lit("1").alias("m")))
    return names, {g: r for (g, _), r in found.items()}


def _correlations(rows: DataFrame) -> tuple[list, dict[tuple[int, int], tuple[int, np.ndarray]]]:
    """The features of ``g, row, feature, value, m`` and, by group and place in ``m``, the rows and their rank correlations.

    ``m`` has a 1 for each subset of the group that the row is in. A feature's values are put in order once for all subsets,
    inside ranges of at most about ``RANGE`` rows; a frequent value is a range of its own, which needs no order. Tasks grow in
    number with the rows, so that none grows.
    """
    names = sorted(r[0] for r in rows.select("feature").distinct().limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} features")
    k, at = len(names), F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else F.create_map().cast("map<string,int>")
    known = cut(rows.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("g").isNotNull()).select("g", "row", at[F.col("feature")].alias("i"), F.col("value").cast("double").alias("v"), "m"))
    sizes = known.groupBy("g", "i").agg(F.count("*").alias("n"), F.max(F.length("m")).alias("s")).collect()  # a row a group and feature
    if not sizes:
        return names, {}
    most, total, s = max(r["n"] for r in sizes), sum(r["n"] for r in sizes), max(r["s"] for r in sizes)
    ranges, kind = -(-most // RANGE), known.schema["row"].dataType.simpleString()
    bounds: dict[tuple, np.ndarray] = {}
    if ranges > 1:
        cuts = F.percentile_approx("v", [j / ranges for j in range(1, ranges)], 8 * ranges)
        bounds = {(g, i): np.unique(np.array(q, float)) for g, i, q in known.groupBy("g", "i").agg(cuts).collect()}  # a row a group and feature

    def flags(m: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer("".join(m.to_pylist()).encode(), np.uint8).reshape(-1, s) - ord("0")

    def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(keys[::-1])
        moved = np.any([a[order][1:] != a[order][:-1] for a in keys], axis=0) if len(order) > 1 else np.zeros(0, bool)
        return order, np.flatnonzero(np.concatenate([[True], moved])) if len(order) else np.zeros(0, int)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, i, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "v"))
            cell = np.zeros(len(v), np.int32)
            order, first = runs(g, i)
            for own in np.split(order, first[1:]):
                if len(own):
                    to = bounds[g[own[0]], i[own[0]]]
                    near = np.searchsorted(to, v[own])
                    cell[own] = 2 * near + (to[np.minimum(near, len(to) - 1)] == v[own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, np.ndarray] = {}
        for b in batches:
            g, i, cell = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "cell"))
            order, first = runs(g, i, cell)
            if len(order):
                for at_, v in zip(order[first], np.add.reduceat(flags(b.column("m"))[order].astype(np.int64), first, axis=0)):
                    key = int(g[at_]), int(i[at_]), int(cell[at_])
                    seen[key] = seen.get(key, 0) + v
        if seen:
            yield pa.RecordBatch.from_arrays([*[pa.array([key[j] for key in seen], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], pa.array([v.tolist() for v in seen.values()], pa.list_(pa.int64()))], names=["g", "i", "cell", "c"])

    placed = known.mapInArrow(place, f"g long, row {kind}, i int, v double, m string, cell int") if ranges > 1 else known.withColumn("cell", F.lit(0))
    starts: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    if ranges > 1:
        cells = placed.mapInArrow(count, "g long, i int, cell int, c array<long>").groupBy("g", "i", "cell").agg(*[F.sum(F.get("c", F.lit(j))) for j in range(s)])
        so_far: dict[tuple, np.ndarray] = {}
        for r in sorted(cells.collect(), key=lambda r: r[:3]):  # a row a range
            before = so_far.get((r[0], r[1]), np.zeros(s, np.int64))
            starts[tuple(r[:3])] = before, np.array(r[3:], np.int64)
            so_far[r[0], r[1]] = before + starts[tuple(r[:3])][1]
    whole = np.int32 if most < 1 << 30 else np.int64

    def rank(t: pa.Table) -> pa.Table:
        m = flags(t.column("m")).astype(np.int64)
        g, i, cell = (t.column(c)[0].as_py() for c in ("g", "i", "cell"))
        start, all_of = starts.get((g, i, cell), (np.zeros(s, np.int64), None))
        if cell % 2:
            double = np.broadcast_to(2 * start + all_of + 1, m.shape)
        else:
            order, first = runs(t.column("v").to_numpy())
            own = np.add.reduceat(m[order], first, axis=0)
            double = np.empty_like(m)
            double[order] = np.repeat(2 * (start + own.cumsum(axis=0) - own) + own + 1, np.diff([*first, len(m)]), axis=0)
        packed = np.ascontiguousarray(double.astype(whole))
        ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * (s * packed.itemsize))
        return pa.table([t.column("g"), t.column("row"), t.column("i"), t.column("m"), pa.Array.from_buffers(pa.binary(), len(m), [None, ends.buffers()[1], pa.py_buffer(packed)])], names=["g", "row", "i", "m", "r"])

    def parts(size: int) -> int:
        return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * size // TASK))

    keys = ["g", "i", "cell", "chunk"]
    dealt = placed.withColumn("chunk", F.when(F.col("cell") % 2 == 1, F.pmod(F.xxhash64("row"), F.lit(ranges))).otherwise(0))
    ranked = dealt.repartition(parts(48 + s), *keys).groupBy(*keys).applyInArrow(rank, f"g long, row {kind}, i int, m string, r binary")
    buckets = max(1, -(-total * (48 + 5 * s) // BUCKET))

    def gather(t: pa.Table) -> pa.Table:
        """A row's ranks in order of features, where it has all."""
        code = t.column("row").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.lexsort((t.column("i").to_numpy(), code))
        own = code[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        full = first[np.diff([*first, len(own)]) == k]
        x = np.frombuffer(b"".join(t.column("r").to_pylist()), whole).reshape(-1, s)[order[(full[:, None] + np.arange(k)).ravel()]].reshape(len(full), k * s)
        return pa.table([t.column("g").take(order[full]), t.column("m").take(order[full]), pa.array([v.tobytes() for v in x], pa.binary())], names=["g", "m", "x"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, np.ndarray] = {}
        for b in batches:
            g = b.column("g").to_numpy()
            if not len(g):
                continue
            m, x = flags(b.column("m")), np.frombuffer(b"".join(b.column("x").to_pylist()), whole).reshape(-1, k, s)
            for own in np.unique(g):
                for j in range(s):
                    at_ = (g == own) & (m[:, j] == 1)
                    z = np.column_stack([np.ones(int(at_.sum())), x[at_, :, j] / 2])
                    seen[own, j] = seen.get((own, j), 0) + z.T @ z
        for (own, j), v in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([own] * (k + 1), pa.int64()), pa.array([j] * (k + 1), pa.int32()), pa.array(range(k + 1), pa.int32()), pa.array([line.tobytes() for line in v], pa.binary())], names=["g", "j", "line", "v"])

    def add(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [key[0]], "j": [key[1]], "line": [key[2]], "v": [sum(np.frombuffer(v) for v in lines["v"]).tobytes()]})

    met = ranked.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))).repartition(parts(48 + 5 * s), "g", "bucket").groupBy("g", "bucket").applyInArrow(gather, "g long, m string, x binary")
    lines = met.mapInArrow(sums, "g long, j int, line int, v binary").groupBy("g", "j", "line").applyInPandas(add, "g long, j int, line int, v binary").collect()  # a row a feature, group and subset
    squares: dict[tuple, np.ndarray] = {}
    for g, j, line, packed in lines:
        squares.setdefault((g, j), np.zeros((k + 1, k + 1)))[line] = np.frombuffer(bytes(packed))
    out = {}
    for own in sorted(squares):
        n = squares[own][0, 0]
        if n:
            cov = squares[own][1:, 1:] - np.outer(squares[own][0, 1:], squares[own][0, 1:]) / n
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            safe = np.where(sd > 1e-9, sd, np.inf)
            out[own] = int(n), cov / np.outer(safe, safe)
    return names, out


def signed_modules(n: int, r: np.ndarray, p: float = 0.01, least: int = 5) -> list[list[int]]:
    """Modules by average linkage of signed correlations up to the critical one, of at least ``least`` features, largest first.

    Features without spread aren't clustered.
    """
    good = np.flatnonzero(np.diag(r) > 0.5)
    if not len(good):
        return []
    labels = average_linkage(1 - r[np.ix_(good, good)], 1 - critical_correlation(n, p))
    found = [[int(good[i]) for i in np.flatnonzero(labels == m)] for m in np.unique(labels)]
    return sorted((m for m in found if len(m) >= least), key=lambda m: (-len(m), m[0]))


def best_match(own: set, others: list[set]) -> tuple[int, int, float, float]:
    """The most alike set by F1, ties by overlap, then the first: its place (-1 for none), overlap, Jaccard and F1."""
    best = (-1, 0, 0.0, 0.0)
    for i, other in enumerate(others):
        shared = len(own & other)
        f1 = 2 * shared / (len(own) + len(other))
        if f1 > best[3] + 1e-12 or (abs(f1 - best[3]) <= 1e-12 and shared > best[1]):
            best = i, shared, shared / len(own | other), f1
    return best


def subsamples(df: DataFrame, key: str, reps: int, share: float, seed: str) -> DataFrame:
    """The rows and, as a text ``m``, a 1 for each subsample that a row is in, else a 0; the first one has all rows.

    A subsample is the ``share`` of least draws; ``df`` has a row a key, and nulls are left out. Ranges of draws are counted,
    and only the range in which a subsample ends is put in order, so rows needn't be repeated for their subsamples.
    """
    own = cut(df.where(F.col(key).isNotNull()))
    most = max(10, round(share * own.count()))
    drawn = replicates(own.select(key), reps).withColumn("__u", draw(seed, F.col("rep"), F.col(key))).withColumn("__cell", F.shiftright("__u", RANGE_BITS))
    before = Window.partitionBy("rep").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    cells = drawn.groupBy("rep", "__cell").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    edge = cut(cells.where((F.col("__before") < most) & (F.col("__before") + F.col("__n") >= most)).select("rep", "__cell", (most - F.col("__before")).alias("__need")))
    last = drawn.join(F.broadcast(edge), ["rep", "__cell"]).withColumn("__place", F.row_number().over(Window.partitionBy("rep").orderBy("__u", key)))  # a row a replicate
    ends = last.where(F.col("__place") == F.col("__need")).agg(F.sort_array(F.collect_list(F.struct("rep", F.col("__u").alias("u"), F.col(key).alias("k")))).alias("__ends"))
    # Without an end a subsample has all rows.
    inside = lambda e: F.struct(draw(seed, e["rep"], F.col(key)).alias("u"), F.col(key).alias("k")) <= F.struct(e["u"].alias("u"), e["k"].alias("k"))
    flags = F.when(F.size("__ends") == 0, F.lit("1" * reps)).otherwise(F.array_join(F.transform("__ends", lambda e: F.when(inside(e), F.lit("1")).otherwise(F.lit("0"))), ""))
    return own.crossJoin(F.broadcast(cut(ends))).select(*df.columns, F.concat(F.lit("1"), flags).alias("m"))  # one row


def subsample_stability(long: DataFrame, row: str, feature: str, value: str, reps: int = 20, share: float = 0.8, seed: str = "stability", p: float = 0.01, least: int = 5) -> list[dict]:
    """How well modules of all rows are found again in subsamples: a row a module.

    ``module, n_features, reps, median_clusterable, median_jaccard, q05_jaccard, median_f1, share_jaccard_half, share_f1_half``.
    """
    chosen = subsamples(long.select(F.col(row).alias("key")).distinct(), "key", reps, share, seed)
    rows = long.join(chosen.hint("shuffle_hash"), F.col(row) == F.col("key")).select(F.lit(0).cast("long").alias("g"), F.col(row).alias("row"), F.col(feature).alias("feature"), F.col(value).alias("value"), "m")
    names, every = _correlations(rows)
    found = {rep: r for (_, rep), r in every.items()}
    modules = {rep: [set(m) for m in signed_modules(n, r, p, least)] for rep, (n, r) in found.items()}
    out = []
    for i, own in enumerate(modules.get(0, [])):
        match = [best_match(own, modules[rep]) for rep in sorted(modules) if rep]
        jaccard, f1 = np.array([m[2] for m in match]), np.array([m[3] for m in match])
        clustered = [int((np.diag(found[rep][1]) > 0.5).sum()) for rep in sorted(modules) if rep]
        out.append({
            "module": i + 1, "n_features": len(own), "features": sorted(names[j] for j in own), "reps": len(match), "median_clusterable": float(np.median(clustered)) if clustered else None,
            "median_jaccard": float(np.median(jaccard)) if match else None, "q05_jaccard": float(np.quantile(jaccard, 0.05)) if match else None, "median_f1": float(np.median(f1)) if match else None,
            "share_jaccard_half": float((jaccard >= 0.5).mean()) if match else None, "share_f1_half": float((f1 >= 0.5).mean()) if match else None,
        })
    return out


DENSITY, CONNECTIVITY = ("prop_var", "mean_kme", "mean_cor", "mean_adj"), ("cor_kim", "cor_kme", "cor_cor")


def preservation_statistics(reference: np.ndarray, test: np.ndarray, power: float) -> np.ndarray:
    """Density and connectivity of a module's correlations in a test network, features in the same order.

    Networks are signed: an adjacency is ((1 + r) / 2) ** power. Density: the share of variance of the first component, its
    correlations and the pairs' ones with the reference's signs, and adjacency, as means. Connectivity: correlations with the
    reference of summed adjacencies, of the component's correlations, and of the pairs' ones.
    """
    upper = np.triu_indices(len(test), 1)

    def network(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, vectors = np.linalg.eigh(r)
        kme = vectors[:, -1] * math.sqrt(max(values[-1], 0.0))
        adjacency = ((1 + np.clip(r, -1, 1)) / 2) ** power
        return kme * (1 if kme.sum() >= 0 else -1), adjacency[upper], adjacency.sum(axis=1) - np.diag(adjacency)

    def correlated(a: np.ndarray, b: np.ndarray) -> float:
        a, b = a - a.mean(), b - b.mean()
        size = math.sqrt((a @ a) * (b @ b))
        return float(a @ b / size) if size > 1e-15 else float("nan")

    (kme_r, _, kim_r), (kme_t, adj_t, kim_t) = network(reference), network(test)
    return np.array([
        (kme_t**2).mean(), (np.sign(kme_r) * kme_t).mean(), (np.sign(reference[upper]) * test[upper]).mean(), adj_t.mean(),
        correlated(kim_r, kim_t), correlated(kme_r, kme_t), correlated(reference[upper], test[upper]),
    ])


def drawn(features: int, size: int, *seed: object) -> list[int]:
    """``size`` features of the least draws by md5."""
    return sorted(range(features), key=lambda i: hashlib.md5("|".join(map(str, (*seed, i))).encode()).hexdigest())[:size]


def module_preservation(spark, reference: np.ndarray, test: np.ndarray, modules: dict[str, list[int]], permutations: int = 200, seed: str = "preservation", power: float = 12.0) -> list[dict]:
    """Z summaries of modules of a reference network in a test network, against drawn features of the test one: a row a module.

    Each permutation puts as many drawn features in the module's place; permutations of all modules are rows of one table. A
    statistic's Z is its distance from their mean by their deviation; ``z_density`` and ``z_connectivity`` are medians, and
    ``z_summary`` their mean. ``median_rank`` is the mean of the modules' median ranks in both kinds. Modules need three
    features; others have nulls.
    """
    if len(reference) > MOST:
        raise ValueError(f"more than {MOST} features")
    sent = spark.sparkContext.broadcast((reference, test))
    names = [m for m, own in modules.items() if len(own) >= 3]
    rows = spark.createDataFrame([(m, i) for m in names for i in range(permutations + 1)], "module string, permutation int").repartition(8)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, t = sent.value
        for b in batches:
            out = []
            for m, i in zip(b["module"], b["permutation"]):
                own = modules[m]
                put = own if not i else drawn(len(t), len(own), seed, m, i)
                out.append((m, i, *preservation_statistics(r[np.ix_(own, own)], t[np.ix_(put, put)], power)))
            yield pd.DataFrame(out, columns=["module", "permutation", *DENSITY, *CONNECTIVITY])

    kind = "module string, permutation int, " + ", ".join(f"{c} double" for c in (*DENSITY, *CONNECTIVITY))
    found = rows.mapInPandas(each, kind).toPandas() if names else pd.DataFrame(columns=["module", "permutation", *DENSITY, *CONNECTIVITY])  # a row a permutation
    observed = found[found["permutation"] == 0].set_index("module").reindex(names)
    null = found[found["permutation"] > 0].groupby("module")
    z = (observed[[*DENSITY, *CONNECTIVITY]] - null[[*DENSITY, *CONNECTIVITY]].mean().reindex(names)) / null[[*DENSITY, *CONNECTIVITY]].std().reindex(names)
    ranks = observed[[*DENSITY, *CONNECTIVITY]].rank(ascending=False)
    out = []
    for m, own in modules.items():
        row: dict = {"module": m, "n_features": len(own)} | dict.fromkeys(("z_summary", "z_density", "z_connectivity", "median_rank", *DENSITY, *CONNECTIVITY))
        if m in names:
            row |= {c: float(observed.loc[m, c]) for c in (*DENSITY, *CONNECTIVITY)}
            density, connectivity = float(z.loc[m, list(DENSITY)].median()), float(z.loc[m, list(CONNECTIVITY)].median())
            rank = float((ranks.loc[m, list(DENSITY)].median() + ranks.loc[m, list(CONNECTIVITY)].median()) / 2)
            row |= {"z_density": density, "z_connectivity": connectivity, "z_summary": (density + connectivity) / 2, "median_rank": rank}
        out.append(row)
    return out
