"""Iterative estimators as numpy kernels over groups: Spark deals the groups, a kernel sees one of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import fits


def normal_p(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2))


def cox_fit(time: np.ndarray, event: np.ndarray, x: np.ndarray, ridge: float = 0.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Cox coefficients and standard errors by Newton's method with Efron's ties; ``ridge`` is scaled by the rows."""
    order = np.lexsort((-event, -time))
    time, event, x = time[order], event[order].astype(bool), x[order]
    n, k = x.shape
    beta = np.zeros(k)
    ends = np.searchsorted(-time, -time, side="right")
    deaths = np.unique(time[event])
    for _ in range(rounds):
        w = np.exp(np.clip(x @ beta, -500, 500))
        s0, s1 = np.cumsum(w), np.cumsum(w[:, None] * x, axis=0)
        s2 = np.cumsum(w[:, None, None] * x[:, :, None] * x[:, None, :], axis=0)
        score, info = -ridge * n * beta, ridge * n * np.eye(k)
        for t in deaths:
            at = np.searchsorted(-time, -t, side="left")
            end = ends[at] - 1
            rows = at + np.flatnonzero(event[at : end + 1])
            d = len(rows)
            t0, t1, t2 = w[rows].sum(), (w[rows, None] * x[rows]).sum(axis=0), (w[rows, None, None] * x[rows, :, None] * x[rows, None, :]).sum(axis=0)
            score += x[rows].sum(axis=0)
            for j in range(d):
                a0, a1, a2 = s0[end] - j / d * t0, s1[end] - j / d * t1, s2[end] - j / d * t2
                mean = a1 / a0
                score -= mean
                info += a2 / a0 - np.outer(mean, mean)
        step = np.linalg.solve(info + 1e-12 * np.eye(k), score)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(info + 1e-12 * np.eye(k))))


def logistic_fit(y: np.ndarray, x: np.ndarray, ridge: float = 1e-8, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Logistic coefficients (the intercept first) and standard errors by reweighted least squares."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        info = x.T @ ((p * (1 - p))[:, None] * x) + ridge * np.eye(len(beta))
        step = np.linalg.solve(info, x.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta, np.sqrt(np.diag(np.linalg.inv(info)))


def signed_rank(d: np.ndarray) -> tuple[float, float]:
    """Wilcoxon's signed-rank W+ and its two-sided p: exact up to 20 differences without ties, else normal."""
    d = d[d != 0]
    if not len(d):
        return 0.0, 1.0
    size = np.abs(d)
    values, inverse, counts = np.unique(size, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    w, n = float(ranks[d > 0].sum()), len(d)
    if n <= 20 and counts.max() == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        low = min(w, n * (n + 1) / 2 - w)
        return w, float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ((counts**3 - counts).sum()) / 48)
    return w, normal_p((w - n * (n + 1) / 4) / spread)


def sign_test(d: np.ndarray) -> tuple[int, int, float]:
    """Positive differences, those that aren't zero, and the two-sided binomial p."""
    d = d[(d != 0) & ~np.isnan(d)]
    k, n = int((d > 0).sum()), len(d)
    low = min(k, n - k)
    return k, n, min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n) if n else 1.0


def concordance(time: np.ndarray, event: np.ndarray, risk: np.ndarray) -> float:
    """Harrell's C of a group of bounded size; risks that tie count half."""
    later = (time[None, :] > time[:, None]) | ((time[None, :] == time[:, None]) & (event[None, :] == 0))
    pairs = later & (event[:, None] == 1)
    good = (risk[:, None] > risk[None, :]) + 0.5 * (risk[:, None] == risk[None, :])
    return float((good * pairs).sum() / pairs.sum())


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers of items joined by average linkage up to a distance."""
    n = len(distance)
    d, size, member = distance.astype(float).copy(), np.ones(n), np.arange(n)
    np.fill_diagonal(d, np.inf)
    while n > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i], d[i, i] = d[i], np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]


def by_group(df: DataFrame, keys: list[str], schema: str, kernel: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    """A kernel's rows for each group; a failed fit keeps its group with the error named in ``error``.

    A group must fit in one task: callers give groups of units such as nations, not of rows of the table.
    """
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    own = len(keys)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            found = [(*key, *r, None) for r in kernel(rows)]
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError) as e:
            found = [(*key, *([None] * (len(names) - own - 1)), type(e).__name__)]
        return pd.DataFrame(found, columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)


def cox_by_feature(df: DataFrame, feature: str, time: str, event: str, value: str, least: int = 30) -> DataFrame:
    """Univariate Cox models of z-scored values by feature."""

    number = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    known = number(time) & number(event) & number(value)
    keys, sizes, numbered = fits.grouped(df.select(feature, time, event, F.col(value).cast("double").alias(value)), feature, [value], known)
    fit = {g: s for g, s in sizes.items() if s[0] >= least and s[2][0] > 0}
    found = {}
    if fit:
        scored = fits.with_values(numbered.where(known), {g: [s[1][0], s[2][0]] for g, s in fit.items()}, ["__mean", "__sd"])
        cells = scored.select("g", time, event, ((F.col(value) - F.col("__mean")) / F.col("__sd")).alias("__z")).groupBy("g", time, event, "__z").agg(F.count("*").alias("n"))
        found = fits.cox(cells, {g: s[0] for g, s in fit.items()}, time, event, ["__z"])
    return coefficients(df, feature, keys, sizes, found, 0, "hazard_ratio", lambda g: "LinAlgError" if g in fit else "ValueError")


def logistic_by_group(df: DataFrame, by: str, label: str, value: str, ridge: float) -> DataFrame:
    """Logistic models of a label by group, on the rows that have the label and the value."""
    known = F.col(label).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value)
    keys, sizes, numbered = fits.grouped(df.select(by, label, value), by, [value], known)
    cells = numbered.where(known).groupBy("g", label, value).agg(F.count("*").alias("n"))
    fit = [g for g, s in sizes.items() if s[0]]
    found = fits.logistic(cells, fit, label, [value], ridge, rounds=40) if fit else {}
    return coefficients(df, by, keys, sizes, found, 1, "odds_ratio", lambda g: "LinAlgError" if g in fit else "ValueError")


def coefficients(df: DataFrame, by: str, keys: list, sizes: dict, found: dict, at: int, ratio: str, error: Callable[[int], str]) -> DataFrame:
    """A row for each group: one coefficient of its fit, or the error that it met."""
    rows = []
    for g, key in enumerate(keys):
        if g in found and np.isfinite(found[g][0]).all():
            beta, se = float(found[g][0][at]), float(found[g][1][at])
            rows.append((key, sizes[g][0], beta, float(np.exp(beta)), se, normal_p(beta / se), None))
        else:
            rows.append((key, None, None, None, None, None, error(g)))
    return df.sparkSession.createDataFrame(rows, f"{by} {df.schema[by].dataType.simpleString()}, n long, coef double, {ratio} double, se double, p_value double, error string")


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of a vector column, from sums by pair of components.

    Rows whose vector is null or empty, or holds null, NaN or infinity, are left out of all sums, so every row counts
    whole or not at all; vectors of different lengths are an error.
    """
    least, most = df.select(F.size(vector).alias("n")).where("n > 0").agg(F.min("n"), F.max("n")).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components")
    size = most or 0
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    df = df.where((F.size(vector) > 0) & whole)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + size * size)
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    found = df.select(F.col(vector).cast("array<double>")).mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(1 + size + size * size)
    for r in found:
        total[r["i"]] = r["v"]
    n = int(total[0])
    mean = total[1 : 1 + size] / max(n, 1)
    return n, mean, (total[1 + size :].reshape(size, size) - n * np.outer(mean, mean)) / max(n - 1, 1)


def principal_components(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the ``k`` leading axes as columns (their largest loading positive), and shares of variance."""
    _, mean, cov = moments(df, vector)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = axes[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return mean, axes, values[order] / max(values.sum(), 1e-300)


def oriented_component(df: DataFrame, vector: str, reference: Column, out: str = "pc1") -> tuple[DataFrame, float, np.ndarray]:
    """``df`` with the z-scored first component of a vector of z-scored components, its share of variance and its loadings.

    The sign is the one that correlates with ``reference``, positive where it doesn't; rows with incomplete vectors have null.
    """
    n, mean, cov = moments(df, vector)
    sd = np.sqrt(np.diag(cov))
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    values, axes = np.linalg.eigh(cov * np.outer(scale, scale))
    axis = axes[:, -1] * (1 if axes[np.abs(axes[:, -1]).argmax(), -1] > 0 else -1)
    weights = axis * scale / np.sqrt(max(values[-1], 1e-300))
    whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (F.size(vector) > 0)
    line = F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(float(-mean @ weights)), lambda s, v: s + v)
    scored = df.withColumn(out, F.when(whole, line)).withColumn("__reference", reference)
    r = scored.agg(F.corr(out, "__reference")).first()[0]
    sign = -1.0 if r is not None and r < 0 else 1.0
    return scored.withColumn(out, sign * F.col(out)).drop("__reference"), float(values[-1] / max(values.sum(), 1e-300)), sign * axis
