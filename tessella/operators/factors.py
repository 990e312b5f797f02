"""A multigroup factor model: Gaussian, with spike-and-slab weights and automatic relevance of factors by group.

Rows of several groups share sparse weights; each group has its own noise by feature and its own relevance of factors.
Mean-field updates need, of each group, only sums over rows: of products of expected factors, and of factors and features. They
are one pass a round, factors times features large, whatever the number of rows; no matrix of features by features is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.cuts import cut

#: Shapes and rates of the Gamma priors, and of the Beta prior of how many weights of a factor aren't zero.
GAMMA, BETA = (1e-3, 1e-3), (1.0, 1.0)
#: Passes that find the leading subspace to begin with.
POWER = 6


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma, by its recurrence and asymptotic series."""
    x, out = np.array(x, float), 0.0
    for _ in range(8):
        out, x = out - 1 / x, x + 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252))


def varimax(loadings: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The rotation that makes the squares of loadings vary most within factors."""
    d, k = loadings.shape
    turn, last = np.eye(k), 0.0
    for _ in range(rounds):
        turned = loadings @ turn
        u, s, vt = np.linalg.svd(loadings.T @ (turned**3 - turned * (turned**2).mean(axis=0)))
        turn = u @ vt
        if s.sum() <= last * (1 + 1e-9):
            break
        last = s.sum()
    return turn


@dataclass
class FactorModel:
    """``weights`` (features by factors, expected values), ``inclusion`` (probabilities that they aren't zero), ``r2`` and
    ``total`` (by group: each factor's and all factors' share of variance), ``projections`` (by group: how rows, less
    ``means``, become factors), ``noise``, rounds and whether the fit settled."""

    groups: list
    means: np.ndarray
    weights: np.ndarray
    inclusion: np.ndarray
    r2: np.ndarray
    total: np.ndarray
    projections: list[np.ndarray]
    noise: np.ndarray
    rounds: int
    settled: bool
    dropped: int = 0
    history: list[float] = field(default_factory=list)

    def scores(self, df: DataFrame, group: str, vector: str, out: str = "factors") -> DataFrame:
        """``df`` with the expected factors of each row; null for rows of other groups or with incomplete vectors."""
        spark, k = df.sparkSession, self.weights.shape[1]
        rows = [(g, m.tolist(), p.ravel().tolist()) for g, m, p in zip(self.groups, self.means, self.projections)]
        kind = df.schema[group].dataType.simpleString()
        sent = F.broadcast(spark.createDataFrame(rows, f"__g {kind}, __mean array<double>, __p array<double>"))  # a row a group
        centred = F.zip_with(F.col(vector), F.col("__mean"), lambda a, b: a.cast("double") - b)
        d = len(self.means[0]) if len(self.means) else 0
        one = lambda i: F.aggregate(F.zip_with(centred, F.slice("__p", i * d + 1, d), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        value = F.when(_whole(vector) & F.col("__p").isNotNull(), F.array(*[one(i) for i in range(k)]))
        return df.join(sent, F.col(group).eqNullSafe(F.col("__g")), "left").withColumn(out, value).drop("__g", "__mean", "__p")


def _whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


class _Rows:
    """Rows with a group's number and a vector, and sums over them."""

    def __init__(self, df: DataFrame, group: str, vector: str):
        rows = df.select(F.col(group).alias("key"), F.col(vector).cast("array<double>").alias("x")).where(_whole("x") & (F.size("x") > 0))
        self.groups = sorted((r[0] for r in rows.select("key").distinct().collect()), key=lambda v: (v is None, v))  # a row a group
        ids = df.sparkSession.createDataFrame([(v, g) for g, v in enumerate(self.groups)], f"of {df.schema[group].dataType.simpleString()}, g int")
        self.rows = cut(rows.join(F.broadcast(ids), F.col("key").eqNullSafe(F.col("of"))).select("g", "x"))
        sizes = self.rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
        if sizes[0] != sizes[1]:
            raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components")
        self.width = sizes[0] or 0

    def sums(self, size: int, work) -> np.ndarray:
        """Sums by group of vectors of ``size`` that ``work(g, matrix)`` gives: within tasks, then over them."""
        width, groups = self.width, len(self.groups)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((groups, size))
            for b in batches:
                g = b.column(0).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for own in np.unique(g):
                    total[own] += work(own, x[g == own])
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()])], names=["k", "v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((groups, size))
            for b in batches:
                for v in b.column(1).to_pylist():
                    total += np.frombuffer(v).reshape(groups, size)
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()])], names=["k", "v"])

        found = self.rows.mapInArrow(run, "k long, v binary")
        if len(self.rows.inputFiles()) > 64:
            found = found.repartition(16).mapInArrow(add, "k long, v binary")
        return sum((np.frombuffer(bytes(r[1])).reshape(groups, size) for r in found.collect()), np.zeros((groups, size)))


def fit(df: DataFrame, group: str, vector: str, factors: int, seed: int = 1, rounds: int = 200, tolerance: float = 1e-5, least_r2: float = 0.001) -> FactorModel:
    """The model of rows by group, centred within groups, from the leading subspace of all rows.

    Each round updates weights one factor after another, then noise, relevances and shares, then the factors of all rows in one
    pass. Factors that hold less than ``least_r2`` of the variance of every group go, one a round. It ends when no
    expected share of variance moves by ``tolerance``, unless rounds run out, which ``settled`` tells. Incomplete vectors are
    left out; null is a group of its own; vectors of different lengths are an error. An empty table gives a model without
    groups.
    """
    rows = _Rows(df, group, vector)
    d, many = rows.width, len(rows.groups)
    if not many:
        return FactorModel([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), [], np.zeros((0, 0)), 0, True)
    first = rows.sums(1 + d, lambda g, x: np.concatenate([[len(x)], x.sum(axis=0)]))
    n, mean = first[:, 0], first[:, 1:] / first[:, :1]
    square = rows.sums(d, lambda g, x: ((x - mean[g]) ** 2).sum(axis=0))
    k = min(factors, d)
    axes = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, k)))[0]
    for _ in range(POWER):
        sent = axes
        axes = np.linalg.qr(rows.sums(d * k, lambda g, x: ((x - mean[g]).T @ ((x - mean[g]) @ sent)).ravel()).sum(axis=0).reshape(d, k))[0]
    spread = [np.zeros((k, k)) for _ in range(many)]
    # Weights are sparse, so factors begin turned to where their loadings are far from even.
    turned = varimax(axes * np.sqrt(np.maximum(rows.sums(k, lambda g, x: (((x - mean[g]) @ axes) ** 2).sum(axis=0)).sum(axis=0), 0)))
    axes = axes @ turned
    projections = [axes.T.copy() for _ in range(many)]
    # They have unit variance over all rows.
    moments, cross = _expected(rows, mean, projections)
    scale = np.sqrt(np.maximum(sum(np.diag(m) for m in moments) / n.sum(), 1e-12))
    projections = [p / scale[:, None] for p in projections]
    moments, cross = [m / np.outer(scale, scale) for m in moments], [c / scale for c in cross]
    noise = n[:, None] / np.maximum(square, 1e-12) * 2
    slab, share = np.ones(k), np.full((2, k), math.log(0.5))
    relevance = np.ones((many, k))
    w, v, gamma = np.zeros((d, k)), np.zeros((d, k)), np.ones((d, k))
    last, settled, dropped, history, turn = None, False, 0, [], 0
    for turn in range(1, rounds + 1):
        second = [m + n[g] * spread[g] for g, m in enumerate(moments)]
        for j in range(k):
            precise = sum(noise[g] * second[g][j, j] for g in range(many)) + slab[j]
            pull = sum(noise[g] * (cross[g][:, j] - w @ second[g][:, j] + w[:, j] * second[g][j, j]) for g in range(many))
            m = pull / precise
            odds = share[0, j] - share[1, j] + 0.5 * np.log(slab[j]) - 0.5 * np.log(precise) + 0.5 * precise * m * m
            gamma[:, j] = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            w[:, j] = gamma[:, j] * m
            v[:, j] = gamma[:, j] * (m * m + 1 / precise)
        free = v + (1 - gamma) / slab
        slab = (GAMMA[0] + d / 2) / (GAMMA[1] + free.sum(axis=0) / 2)
        on = gamma.sum(axis=0)
        share = np.array([digamma(BETA[0] + on), digamma(BETA[1] + d - on)])
        for g in range(many):
            off = second[g] - np.diag(np.diag(second[g]))
            left = square[g] - 2 * (cross[g] * w).sum(axis=1) + ((w @ off) * w).sum(axis=1) + v @ np.diag(second[g])
            noise[g] = (GAMMA[0] + n[g] / 2) / (GAMMA[1] + np.maximum(left, 0) / 2)
            relevance[g] = (GAMMA[0] + n[g] / 2) / (GAMMA[1] + np.diag(second[g]) / 2)
            seen = w.T @ (w * noise[g][:, None]) + np.diag(((v - w * w) * noise[g][:, None]).sum(axis=0))
            spread[g] = np.linalg.inv(np.diag(relevance[g]) + seen)
            projections[g] = spread[g] @ (w * noise[g][:, None]).T
        moments, cross = _expected(rows, mean, projections)
        r2 = np.array([(2 * (c * w).sum(axis=0) - np.diag(m) * (w * w).sum(axis=0)) / max(s.sum(), 1e-300) for m, c, s in zip(moments, cross, square)])
        history.append(float(r2.sum()))
        if last is not None and last.shape == r2.shape and np.abs(r2 - last).max() < tolerance:
            weak = int(np.argmin(r2.max(axis=0)))
            if k <= 1 or r2[:, weak].max() >= least_r2:
                settled = True
                break
        last = r2
        weak = int(np.argmin(r2.max(axis=0)))
        if turn > 5 and k > 1 and r2[:, weak].max() < least_r2:
            rest = [j for j in range(k) if j != weak]
            w, v, gamma, slab, share, relevance = w[:, rest], v[:, rest], gamma[:, rest], slab[rest], share[:, rest], relevance[:, rest]
            moments, cross = [m[np.ix_(rest, rest)] for m in moments], [c[:, rest] for c in cross]
            spread, projections = [s[np.ix_(rest, rest)] for s in spread], [p[rest] for p in projections]
            k, dropped, last = k - 1, dropped + 1, None
    total = np.array([(2 * (c * w).sum() - np.trace(m @ (w.T @ w))) / max(s.sum(), 1e-300) for m, c, s in zip(moments, cross, square)])
    r2 = np.array([(2 * (c * w).sum(axis=0) - np.diag(m) * (w * w).sum(axis=0)) / max(s.sum(), 1e-300) for m, c, s in zip(moments, cross, square)])
    order = np.argsort(-r2.sum(axis=0), kind="stable")
    return FactorModel(rows.groups, mean, w[:, order], gamma[:, order], r2[:, order], total, [p[order] for p in projections], noise, turn, settled, dropped, history)


def _expected(rows: _Rows, mean: np.ndarray, projections: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By group: sums of products of the rows' expected factors, and of features and factors."""
    k, d = projections[0].shape

    def work(g: int, x: np.ndarray) -> np.ndarray:
        x = x - mean[g]
        z = x @ projections[g].T
        return np.concatenate([(z.T @ z).ravel(), (x.T @ z).ravel()])

    found = rows.sums(k * k + d * k, work)
    return [f[: k * k].reshape(k, k) for f in found], [f[k * k :].reshape(d, k) for f in found]


def activity(r2: DataFrame, groups: list[str], thresholds: tuple[float, ...] = (0.5, 1.0, 2.0), factor: str = "factor", group: str = "group", value: str = "r2") -> DataFrame:
    """Factors by where they are active: a row a factor and threshold, from long shares of variance in percent.

    A factor is active in the ``groups`` whose share, repeated rows added up and absent ones 0, reaches the threshold:
    ``ubiquitous_shared`` in all, ``partially_shared`` in two or more, ``group_specific`` in one, else ``inactive``. Other groups
    are ignored; nulls count as 0.
    """
    share = [F.coalesce(F.sum(F.when(F.col(group) == g, F.col(value))), F.lit(0.0)) for g in groups]
    wide = r2.groupBy(factor).agg(F.array(*share).alias("shares")).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    active = F.filter(F.array(*[F.when(F.get("shares", F.lit(i)) >= F.col("threshold"), F.lit(g)) for i, g in enumerate(groups)]), lambda x: x.isNotNull())
    n = F.size("active_groups")
    kind = F.when(n == len(groups), "ubiquitous_shared").when(n >= 2, "partially_shared").when(n == 1, "group_specific").otherwise("inactive")
    mean = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x) / len(groups)
    return wide.withColumn("active_groups", active).select(
        factor, "threshold", n.alias("active_count"), F.array_join("active_groups", ";").alias("active_groups"), kind.alias("activity_class"),
        F.array_min("shares").alias("least_r2"), F.array_max("shares").alias("largest_r2"), mean.alias("mean_r2"), (F.array_max("shares") - F.array_min("shares")).alias("r2_range"),
    )


def subspaces(active: DataFrame, groups: list[str], special: str, factor: str = "factor") -> DataFrame:
    """Which factors span each named subspace, from their activity at one threshold: ``subspace, factor, place``.

    All retained ones; those shared by two groups or more; by all; by two but not all; shared without the special group;
    shared with it; and active in it alone. A subspace without factors has no row.
    """
    own = F.filter(F.split("active_groups", ";"), lambda x: x != "")
    n, has = F.size("own"), F.array_contains("own", special)
    rules = {
        "all_retained": F.lit(True), "shared_two_or_more": n >= 2, "ubiquitous_all_groups": n == len(groups), "partially_shared": (n >= 2) & (n < len(groups)),
        f"shared_without_{special}": (n >= 2) & ~has, f"shared_with_{special}": (n >= 2) & has, f"{special}_specific": (n == 1) & has,
    }
    named = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    rows = active.withColumn("own", own).select(factor, F.explode(named).alias("subspace"))
    place = F.row_number().over(Window.partitionBy("subspace").orderBy(factor))  # a row a factor
    return rows.select("subspace", factor, (place - 1).alias("place"))
