"""Feature selection from a correlation matrix: Markov blankets by conditional independence tests.

Selection asks for the correlations of the target and of chosen features with all others, a row of the matrix each. ``Rows``
works one out in a pass over the table when it is first asked for, so the driver holds chosen features times features; a
whole matrix may be given instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.cuts import cut
from tessella.operators.kernels import moments, normal_p

#: Added to the diagonal of the conditioning features' correlations.
RIDGE = 1e-6


def correlations(df: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """Rows and correlation matrix of a vector column; a component without spread correlates with nothing."""
    n, _, cov = moments(df, vector)
    sd = np.sqrt(np.diag(cov))
    safe = np.where(sd > 0, sd, np.inf)
    r = cov / np.outer(safe, safe)
    np.fill_diagonal(r, 1.0)
    return n, r


class Rows:
    """Rows of the correlation matrix of a vector column, each from a pass over its table, written once, when first asked for.

    Vectors that hold null, NaN or infinity are left out; a component without spread correlates with nothing.
    """

    def __init__(self, df: DataFrame, vector: str):
        whole = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        self.table = cut(df.where((F.size(vector) > 0) & whole).select(F.col(vector).cast("array<double>").alias("x")))
        least, most = self.table.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
        if least != most:
            raise ValueError(f"vectors of {least} to {most} components")
        self.size = most or 0
        first = self._sums(lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), 1 + self.size)
        self.n, self.mean = int(first[0]), first[1:] / max(first[0], 1)
        mean = self.mean
        sd = np.sqrt(self._sums(lambda x: ((x - mean) ** 2).sum(axis=0), self.size))
        self.sd = np.where(sd > 0, sd, np.inf)
        self.known: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return self.size

    def _sums(self, work, size: int) -> np.ndarray:
        width = self.size

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                total += work(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

        return sum((np.frombuffer(bytes(r[0])) for r in self.table.mapInArrow(sums, "v binary").collect()), np.zeros(size))  # a row a task

    def rows(self, of: list[int]) -> np.ndarray:
        """Correlations of some components with all."""
        new, mean, size = [i for i in of if i not in self.known], self.mean, self.size
        if new:
            found = self._sums(lambda x: ((x[:, new] - mean[new]).T @ (x - mean)).ravel(), len(new) * size).reshape(-1, size)
            for i, row in zip(new, found):
                self.known[i] = row / (self.sd[i] * self.sd)
                self.known[i][i] = 1.0
        return np.stack([self.known[i] for i in of]) if of else np.zeros((0, size))


def _rows(r: np.ndarray | Rows, of: list[int]) -> np.ndarray:
    return r.rows(of) if isinstance(r, Rows) else r[of]


def partial_correlations(r: np.ndarray | Rows, target: int, given: list[int]) -> np.ndarray:
    """Partial correlation of the target with every feature given some of them."""
    own = _rows(r, [target])[0]
    if not given:
        return own.copy()
    rows = _rows(r, given)
    a = np.linalg.solve(rows[:, given] + RIDGE * np.eye(len(given)), rows)
    left = own - own[given] @ a
    spread = np.clip(1 - (rows * a).sum(axis=0), 1e-8, None)
    return np.clip(left / np.sqrt(spread * spread[target]), -0.999999, 0.999999)


def fisher_p(partial: float, n: int, given: int) -> float:
    """Two-sided p-value of a partial correlation by Fisher's z."""
    free = n - given - 3
    return 1.0 if free <= 0 else normal_p(math.atanh(partial) * math.sqrt(free))


def _shrink(r: np.ndarray | Rows, n: int, target: int, blanket: list[int], alpha: float) -> list[int]:
    while blanket:
        p = {x: fisher_p(partial_correlations(r, target, [y for y in blanket if y != x])[x], n, len(blanket) - 1) for x in blanket}
        worst = max(blanket, key=lambda x: (p[x], x))
        if p[worst] <= alpha:
            break
        blanket = [x for x in blanket if x != worst]
    return blanket


def iamb(r: np.ndarray | Rows, n: int, target: int, alpha: float) -> list[int]:
    """Incremental association: the most associated feature given the blanket joins while it is significant, then weak ones leave."""
    blanket: list[int] = []
    while len(blanket) < len(r) - 1:
        partial = np.abs(partial_correlations(r, target, blanket))
        partial[[target, *blanket]] = -1
        best = int(np.argmax(partial))
        if fisher_p(partial[best], n, len(blanket)) >= alpha:
            break
        blanket.append(best)
    return _shrink(r, n, target, blanket, alpha)


def grow_shrink(r: np.ndarray | Rows, n: int, target: int, alpha: float) -> list[int]:
    """Grow-shrink: features in the order of their plain correlation join when significant given the blanket, then weak ones leave."""
    order = [int(x) for x in np.argsort(-np.abs(_rows(r, [target])[0]), kind="stable") if x != target]
    blanket: list[int] = []
    for x in order:
        if fisher_p(abs(partial_correlations(r, target, blanket)[x]), n, len(blanket)) < alpha:
            blanket.append(x)
    return _shrink(r, n, target, blanket, alpha)


def effective_rank(cov: np.ndarray) -> float:
    """The exponential of the entropy of the shares of variance."""
    values = np.clip(np.linalg.eigvalsh(cov), 0, None)
    share = values[values > 0] / values.sum()
    return float(np.exp(-(share * np.log(share)).sum()))


def orthonormal(basis: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Orthonormal columns that span a basis, by QR, without dependent ones."""
    q, r = np.linalg.qr(basis)
    return q[:, np.abs(np.diag(r)) > tolerance * max(1.0, np.abs(r).max())]


def subspace_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared canonical cosine of two subspaces."""
    s = np.linalg.svd(orthonormal(a).T @ orthonormal(b), compute_uv=False)
    return float((s**2).mean())


def capture(vector: np.ndarray, basis: np.ndarray) -> float:
    """The share of a vector's square that a subspace holds."""
    q = orthonormal(basis)
    return float(((q.T @ vector) ** 2).sum() / (vector @ vector))
