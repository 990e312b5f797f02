"""Many Cox models of one table at once, by Spark sums over blocks of rows in order of time.

Rows are dealt once by ranges of times and packed into blocks; a time of more rows than a block is a range of its own, in as
many blocks as it needs. A model is a column of whole weights (a fold's training rows, a bootstrap's counts), some of the features, and
a penalty. Each evaluation is a few jobs without a shuffle, for all models together: sums by block for the risk sets of
earlier blocks, then gradients, then Hessians. Models of one feature, and models of the same few, are columns, worked out together in two jobs. Newton steps are proximal (coordinate descent with soft thresholds on the
quadratic model), and a step that worsens the penalised likelihood is halved.

The driver gets a row of sums a block and model, and matrices of the size of a model's features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.cuts import cut

#: Rows of a block, and bytes of its features, which keep it smaller where there are many.
BLOCK, BYTES = 50_000, 8 << 20
#: Deaths of one time that are added up in a step.
STEP = 1 << 20
#: Numbers of a step over rows and models of one feature.
CELLS = 1 << 18
#: Features of models that are worked out together, if all have the same, and deaths of times of their own that the driver adds up itself.
FEW, OWN = 8, 1 << 18
#: Rows of a range of risks aimed at, the most ranges, and rows that a task sorts before it deals them.
BAND, BANDS, DEALT = 100_000, 512, 1 << 19


@dataclass(frozen=True)
class Spec:
    """A model: its column of weights, its features by place, and its penalty, which is scaled by the sum of the weights."""

    use: int
    features: tuple[int, ...]
    penalty: float = 0.0
    l1_ratio: float = 0.0


@dataclass
class Fit:
    """A fitted model. ``beta`` and ``se`` are of z-scored features; ``settled`` is false where rounds ran out.

    Features without spread have coefficient 0. ``error`` says why there is no fit: ``too_few_samples``, ``no_features``,
    ``singular``.
    """

    spec: Spec
    n: float = 0.0
    events: float = 0.0
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    se: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loglik: float = float("nan")
    settled: bool = False
    error: str = ""

    @property
    def raw(self) -> np.ndarray:
        """Coefficients of the features as they are."""
        return np.divide(self.beta, self.scale, out=np.zeros(len(self.beta)), where=self.scale > 0)


def shares(total: np.ndarray, dead: np.ndarray, deaths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Efron's sums by time: of 1/phi, of 1/phi squared and of log phi, phi being the risk set less a share of the dead."""
    out = np.zeros((3, len(total)))
    ends = np.cumsum(deaths.astype(np.int64))
    for lo in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        one = np.arange(lo, min(lo + STEP, int(ends[-1])))
        at = np.searchsorted(ends, one, side="right")
        phi = total[at] - (one - ends[at] + deaths[at]) / deaths[at] * dead[at]
        for row, value in zip(out, (1 / phi, 1 / phi**2, np.log(phi))):
            row += np.bincount(at, value, minlength=len(total))
    return out[0], out[1], out[2]


def tied(total0, total1, dead0, dead1, deaths):
    """What death times give: log of phi, the gradient's part, the Hessian's second part, sums of 1/phi, and what the dead lack of them."""
    h, h2, logs = shares(total0, dead0, deaths)
    a = dead1 / dead0[:, None]
    b = total1 - total0[:, None] * a
    cross = (a * h[:, None]).T @ b
    second = (a * deaths[:, None]).T @ a + cross + cross.T + (b * h2[:, None]).T @ b
    return logs.sum(), (deaths[:, None] * a + h[:, None] * b).sum(axis=0), second, h, (total0 * h - deaths) / dead0


def efron_lines(risk: np.ndarray, dead: np.ndarray, deaths: np.ndarray) -> np.ndarray:
    """What the risk sets of death times take from log-likelihoods and gradients, and less what they give to the information, by model.

    ``risk`` and ``dead`` are sums of weights, of features and of their squares by time and model, ``deaths`` counts by time and
    model, or by time where all models have the same.
    """
    out = np.zeros((3, risk.shape[2]))
    most = deaths.max(axis=1).astype(np.int64)
    ends = np.cumsum(most)
    step = max(1, CELLS // risk.shape[2])
    for lo in range(0, int(ends[-1]), step):
        one = np.arange(lo, min(lo + step, int(ends[-1])))
        row = np.searchsorted(ends, one, side="right")
        place, d = (one - ends[row] + most[row])[:, None], deaths[row]
        there = place < d
        phi, first, second = risk[:, row] - np.where(there, place / np.where(there, d, 1), 0.0) * dead[:, row]
        # A model without this death may have nobody at risk.
        phi = phi if there.all() else np.where(there, phi, 1.0)
        mean = first / phi
        for total, v in zip(out, (np.log(phi), mean, mean * mean - second / phi)):
            total += v.sum(axis=0) if there.all() else np.where(there, v, 0.0).sum(axis=0)
    return out


def efron_sums(risk: np.ndarray, dead: np.ndarray, deaths: np.ndarray, k: int) -> np.ndarray:
    """By model: what the risk sets of death times take from the log-likelihood and the gradient, and less what they give to the information.

    ``risk`` and ``dead`` are sums of weights, of ``k`` features and of their products by time and model, ``deaths`` counts by time and model.
    """
    out = np.zeros((risk.shape[0], risk.shape[2]))
    row, m = np.nonzero(deaths)
    if not len(row):
        return out
    # A sum over deaths of (s - share t) / phi is t / t0 for each and what is left of s times the sum of 1 / phi.
    s, t, d = risk[:, row, m], dead[:, row, m], deaths[row, m]
    h, h2, logs = np.zeros(len(row)), np.zeros(len(row)), np.zeros(len(row))
    ends = np.cumsum(d.astype(np.int64))
    for lo in range(0, int(ends[-1]), STEP):
        hi = min(lo + STEP, int(ends[-1]))
        a, b = np.searchsorted(ends, [lo, hi - 1], side="right")
        own = slice(a, b + 1)
        upto = np.clip(ends[own], lo, hi) - lo
        first = np.concatenate([[0], upto[:-1]])
        many = upto - first
        place = np.arange(lo, hi) - np.repeat(ends[own] - d[own].astype(np.int64), many)
        phi = np.repeat(s[0, own], many) - place * np.repeat(t[0, own] / d[own], many)
        inverse = 1 / phi
        h[own] += np.add.reduceat(inverse, first)
        h2[own] += np.add.reduceat(inverse * inverse, first)
        logs[own] += np.add.reduceat(np.log(phi), first)
    a = t[1:] / t[0]
    b = s[1:] - s[0] * a
    both = d * a + h * b
    add = lambda v: np.bincount(m, v, minlength=risk.shape[2])
    out[0] = add(logs)
    for i in range(k):
        out[1 + i] = add(both[i])
    for q, (i, j) in enumerate(zip(*np.triu_indices(k))):
        out[1 + k + q] = add(d * a[i] * a[j] + h * (a[i] * b[j] + b[i] * a[j]) + h2 * b[i] * b[j] - both[k + q])
    return out


def pairs(key: np.ndarray, risk: np.ndarray, dead: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pairs of a death and a row of a later key by column of the counts ``n``: those of a smaller risk, and those of an equal one.

    Rows are put in order of risk once, for all columns; from the highest bit of the keys on, each half goes on by itself.
    """
    out = np.zeros((2, n.shape[1]), np.int64)
    if not len(key):
        return out
    k, r = (np.unique(v, return_inverse=True)[1].astype(np.int64) for v in (key, risk))
    row = np.lexsort((k, r))
    k, r = k[row], r[row]
    died = np.asarray(dead)[row] > 0
    places = np.arange(len(k))
    fresh = lambda *by: np.concatenate([[True], np.any([v[1:] != v[:-1] for v in by], axis=0)])
    since = lambda new: np.maximum.accumulate(np.where(new, places, 0))
    upto = lambda new: np.append(np.flatnonzero(new)[1:], len(k))[np.cumsum(new) - 1]
    # Columns at a time, which bound the running sums.
    for lo in range(0, n.shape[1], width := max(1, (16 * CELLS) // len(k))):
        cut_ = slice(lo, lo + width)
        run, same = upto(fresh(r)), upto(fresh(r, k))
        a = np.flatnonzero(died & (run > same))
        if len(a):
            total = np.concatenate([np.zeros((1, n[:1, cut_].shape[1]), np.int64), np.cumsum(n[row][:, cut_], axis=0, dtype=np.int64)])
            out[1, cut_] = (n[row[a], cut_] * (total[run[a]] - total[same[a]])).sum(axis=0)
    own = k, r, died, row
    for b in reversed(range(int(k.max()).bit_length())):
        k, r, died, row = own
        late = (k >> b & 1) == 1
        before = np.concatenate([[0], np.cumsum(late)])
        group = fresh(k >> (b + 1))
        a = np.flatnonzero(died & ~late)
        start, end = before[since(group)[a]], before[since(group | fresh(r))[a]]
        some = end > start
        a, start, end = row[a[some]], start[some], end[some]
        later = row[late]
        for lo in range(0, n.shape[1], width):
            cut_ = slice(lo, lo + width)
            if len(a):
                total = np.concatenate([np.zeros((1, n[:1, cut_].shape[1]), np.int64), np.cumsum(n[later, cut_], axis=0, dtype=np.int64)])
                out[0, cut_] += np.einsum("ij,ij->j", n[a, cut_].astype(np.int64), total[end] - total[start])
        if b:
            half = k >> b
            order = np.argsort(half.astype(np.uint16) if int(half.max()) < 1 << 16 else half, kind="stable")
            own = tuple(v[order] for v in own)
    return out


def later_pairs(dead: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By column: deaths of each place times the counts of all later places."""
    after = n[::-1].cumsum(axis=0)[::-1] - n
    return (dead * after).sum(axis=0)


class RiskBlocks:
    """Rows of a table with a time, an event, an array of features and one of weights, packed for many Cox models.

    Whole weights below 256 may be given as the bytes of a binary column instead.

    Rows with a null time, event or feature, and those with features that aren't finite, are left out. Features in
    ``plain``, as those of categories, aren't scaled.
    """

    def __init__(self, df: DataFrame, time: str, event: str, features: str, weights: str, block: int = BLOCK, plain: tuple[int, ...] = ()):
        small = df.schema[weights].dataType.simpleString() == "binary"
        w = F.col(weights) if small else F.col(weights).cast("array<double>")
        rows = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(features).cast("array<double>").alias("x"), w.alias("w"))
        odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        rows = cut(rows.where(F.col("t").isNotNull() & F.col("e").isNotNull() & F.col("x").isNotNull() & ~odd))
        one = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("k"), F.max((F.length if small else F.size)("w")).alias("u")).first()
        self.n, self.k, self.uses = one["n"], max(one["k"] or 0, 0), max(one["u"] or 0, 0)
        block = min(block, max(1, BYTES // (8 * max(self.k, 1))))
        ranges = max(1, -(-self.n // block))
        bounds = sorted(set(rows.approxQuantile("t", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
        # A time that fits in a block stays with the range that it ends.
        often = {r["t"]: r["count"] for r in rows.where(F.col("t").isin(bounds)).groupBy("t").count().where(F.col("count") > block).collect()} if bounds else {}
        alone, chunks = sorted(often), {2 * int(np.searchsorted(bounds, t)) + 1: -(-c // block) for t, c in often.items()}
        width = self.k, self.uses

        @F.pandas_udf("long")
        def part(t: pd.Series) -> pd.Series:
            return pd.Series(2 * np.searchsorted(bounds, t.to_numpy(float)) + np.isin(t.to_numpy(float), alone))

        placed = rows.withColumn("part", part("t")) if bounds else rows.withColumn("part", F.lit(0).cast("long"))
        chunk = F.lit(0)
        if chunks:
            sizes = df.sparkSession.createDataFrame(sorted(chunks.items()), "part long, chunks int")
            placed = placed.join(F.broadcast(sizes), "part", "left")  # a row a range
            chunk = F.coalesce(F.pmod(F.xxhash64("x", "e"), F.col("chunks")), F.lit(0))
        dealt = placed.withColumn("chunk", chunk.cast("long"))

        def pack(b: pa.Table) -> pa.Table:
            order = np.argsort(b["t"].to_numpy(), kind="stable")
            x, w = (wide(b[c].combine_chunks(), size) for c, size in zip("xw", width))
            arrays = [b["t"].to_numpy().astype(float), b["e"].to_numpy().astype(float), x, w]
            # Whole weights of a byte are kept as such; see ``unpack``.
            if w.dtype != np.uint8 and w.size and ((w >= 0) & (w < 256) & (w % 1 == 0)).all():
                arrays[3] = w.astype(np.uint8)
            return pa.table({"part": [b["part"][0].as_py()], "rows": [len(order)], **{c: [a[order].tobytes()] for c, a in zip("texw", arrays)}})

        # Tasks of about 64 MB, however many rows there are.
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.n * (self.k + self.uses) // (BYTES)))
        packed = dealt.select("part", "chunk", "t", "e", "x", "w").repartition(tasks, "part", "chunk").groupBy("part", "chunk").applyInArrow(pack, "part long, rows long, t binary, e binary, x binary, w binary")
        self.blocks, self.plain, self.rows = cut(packed), np.array(plain, int), rows
        self.spark = df.sparkSession
        self.parts = sorted(r[0] for r in self.blocks.select("part").distinct().collect())  # a row a range
        self.single = len(self.parts) == 1 and self.parts[0] % 2 == 0
        found = self._summed(lambda b: np.concatenate([b.w.sum(axis=0), (b.w * b.e[:, None]).sum(axis=0), (b.w.T @ b.x).ravel()])) if self.n else np.zeros(0)
        u, k = self.uses, self.k
        self.total, self.events, first = found[:u], found[u : 2 * u], found[2 * u :].reshape(-1, k) if self.n else np.zeros((0, k))
        with np.errstate(all="ignore"):
            self.mean = first / self.total[:, None]
            mean = self.mean
            spread = self._summed(lambda b: np.concatenate([b.w[:, i] @ (b.x - np.nan_to_num(mean[i])) ** 2 for i in range(u)])).reshape(-1, k) if self.n else np.zeros((0, k))
            self.scale = np.sqrt(spread / np.maximum(self.total - 1, 0)[:, None])

    def _each(self, work: Callable[[Block], Iterator[tuple | pd.DataFrame]], kind: str) -> DataFrame:
        names, k, u = [c.split()[0] for c in kind.split(", ")], self.k, self.uses

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    for found in work(unpack(r, k, u)):
                        yield found if isinstance(found, pd.DataFrame) else pd.DataFrame([found], columns=names)

        return self.blocks.mapInPandas(run, kind)

    def _summed(self, work: Callable[[Block], np.ndarray]) -> np.ndarray:
        """Sums of vectors over all blocks: within tasks, then within some tasks of their rows, then here."""
        k, u = self.k, self.uses

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                for r in b.itertuples(index=False):
                    own = work(unpack(r, k, u))
                    total = own if total is None else total + own
            if total is not None:
                yield pd.DataFrame({"v": [total.tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                for v in b["v"]:
                    total = np.frombuffer(v) if total is None else total + np.frombuffer(v)
            if total is not None:
                yield pd.DataFrame({"v": [total.tobytes()]})

        found = self.blocks.mapInPandas(run, "v binary")
        if len(self.parts) > 64:
            found = found.repartition(16).mapInPandas(add, "v binary")
        return sum(np.frombuffer(bytes(r[0])) for r in found.collect())

    def evaluate(self, models: dict[int, tuple[Spec, np.ndarray]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Log-likelihood, gradient and information of each model at coefficients of the features as they are."""
        sent = [(g, spec.use, np.array(spec.features, int), beta) for g, (spec, beta) in models.items()]
        sizes = [len(f) for _, _, f, _ in sent]
        if sent and max(sizes) == min(sizes) == 1:
            return self._evaluate_lines(sent)
        if len(sent) > 1 and sizes[0] <= FEW and all(np.array_equal(f, sent[0][2]) for _, _, f, _ in sent):
            return self._evaluate_few(sent)
        out = {g: [0.0, np.zeros(k), np.zeros((k, k))] for (g, *_), k in zip(sent, sizes)}
        start = {p: None for p in self.parts}
        own: dict[int, list[tuple]] = {}
        if not self.single:
            start, own = self._starts(sent, sizes)
        # Times of their own: what they give follows from their sums.
        given: dict[int, list[tuple[float, float]]] = {}
        hs = {p: np.zeros(len(sent)) for p in self.parts}
        for p, sums in own.items():
            given[p] = []
            for i, (s, (g, *_)) in enumerate(zip(sums, sent)):
                h = lack = 0.0
                if s["d"] > 0:
                    logs, part, second, hh, ll = tied(np.array([s["S0"]]), s["S1"][None], np.array([s["T0"]]), s["T1"][None], np.array([s["d"]]))
                    h, lack = float(hh[0]), float(ll[0])
                    out[g][0] += s["eta"] - logs
                    out[g][1] += s["x"] - part
                    out[g][2] -= second
                given[p].append((h, lack))
                hs[p][i] = h
        single = self.single

        def gradients(b: Block) -> Iterator[tuple]:
            if b.part % 2 == 0:
                rows = [b.ties(use, f, beta, start[b.part][i] if start[b.part] else None, 0.0, single) for i, (_, use, f, beta) in enumerate(sent)]
                yield b.part, np.concatenate([np.concatenate([[r[0], r[3]], r[1], r[2].ravel()]) for r in rows]).tobytes()

        for part, packed in self._each(gradients, "part long, v binary").collect():
            at, v = 0, np.frombuffer(bytes(packed))
            for i, ((g, *_), k) in enumerate(zip(sent, sizes)):
                out[g][0] += v[at]
                hs[part][i] += v[at + 1]
                out[g][1] += v[at + 2 : at + 2 + k]
                at += 2 + k
                if single:
                    out[g][2] += v[at : at + k * k].reshape(k, k)
                    at += k * k
        if not single:
            before, so_far = {}, np.zeros(len(sent))
            for p in self.parts:
                before[p], so_far = so_far, so_far + hs[p]

            def hessians(b: Block) -> np.ndarray:
                done = []
                for i, (_, use, f, beta) in enumerate(sent):
                    if b.part % 2:
                        h, lack = given[b.part][i]
                        done.append(b.gram(use, f, beta, before[b.part][i] + h - b.e * lack).ravel())
                    else:
                        done.append(b.ties(use, f, beta, start[b.part][i], before[b.part][i], True)[2].ravel())
                return np.concatenate(done)

            at, v = 0, self._summed(hessians)
            for (g, *_), k in zip(sent, sizes):
                out[g][2] += v[at : at + k * k].reshape(k, k)
                at += k * k
        return {g: tuple(v) for g, v in out.items()}

    def _evaluate_lines(self, sent: list[tuple]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """``evaluate`` for models of one feature each; features are taken less their means, which changes nothing."""
        m = len(sent)
        use, at, beta = np.array([u for _, u, _, _ in sent]), np.array([f[0] for _, _, f, _ in sent]), np.array([b[0] for *_, b in sent], float)
        mean = np.nan_to_num(self.mean[use, at])
        out, start = np.zeros((3, m)), {}
        if not self.single:
            sums = {p: np.zeros((9 if p % 2 else 3, m)) for p in self.parts}
            for part, packed in self._each(lambda b: iter([(b.part, b.line_totals(use, at, beta, mean).tobytes())]), "part long, v binary").collect():
                sums[part] += np.frombuffer(bytes(packed)).reshape(-1, m)
            later = np.zeros((3, m))
            for p in reversed(self.parts):
                start[p] = later
                later = later + sums[p][:3]
                if p % 2:
                    # Times of their own: what they give follows from their sums.
                    out += sums[p][[7, 8, 8]] * [[1], [1], [0]] - efron_lines(later[:, None], sums[p][3:6, None], sums[p][6:7])
        single = self.single

        def each(b: Block) -> np.ndarray:
            return np.zeros(3 * m) if b.part % 2 else b.lines(use, at, beta, mean, None if single else start[b.part]).ravel()

        out += self._summed(each).reshape(3, m)
        return {g: (float(out[0, i]), out[1:2, i], out[2:3, i].reshape(1, 1)) for i, (g, *_) in enumerate(sent)}

    def _evaluate_few(self, sent: list[tuple]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """``evaluate`` for models of the same few features, which are taken less a mean; their products are summed with the risk sets."""
        m, f = len(sent), sent[0][2]
        use, beta, k = np.array([u for _, u, _, _ in sent]), np.array([b for *_, b in sent], float), len(f)
        mean = np.nan_to_num(self.mean[use[0], f])
        q = 1 + k + k * (k + 1) // 2
        out, start = np.zeros((q, m)), {}
        if not self.single:
            sums = {p: np.zeros((2 * q + 2 + k if p % 2 else q, m)) for p in self.parts}
            for part, packed in self._each(lambda b: iter([(b.part, b.few_totals(use, f, beta, mean).tobytes())]), "part long, v binary").collect():
                sums[part] += np.frombuffer(bytes(packed)).reshape(-1, m)
            later, own = np.zeros((q, m)), []
            for p in reversed(self.parts):
                start[p] = later
                later = later + sums[p][:q]
                if p % 2:
                    # Times of their own: what they give follows from their sums.
                    out[: 1 + k] += sums[p][2 * q + 1 :]
                    own.append((later[:, None], sums[p][q : 2 * q, None], sums[p][2 * q : 2 * q + 1]))
            out -= self._own_times(own, k) if own else 0.0
        single = self.single

        def each(b: Block) -> np.ndarray:
            return np.zeros(q * m) if b.part % 2 else b.few(use, f, beta, mean, None if single else start[b.part]).ravel()

        out += self._summed(each).reshape(q, m)
        found, (i, j) = {}, np.triu_indices(k)
        for at, (g, *_) in enumerate(sent):
            info = np.zeros((k, k))
            info[i, j] = info[j, i] = out[1 + k :, at]
            found[g] = float(out[0, at]), out[1 : 1 + k, at], info
        return found

    def _own_times(self, own: list[tuple], k: int) -> np.ndarray:
        """``efron_sums`` of times of their own; many deaths are added up in tasks."""
        if sum(d.sum() for *_, d in own) <= OWN:
            return sum(efron_sums(*o, k) for o in own)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"v": [efron_sums(*own[i], k).tobytes() for i in b["id"]]})

        tasks = min(len(own), 4 * self.spark.sparkContext.defaultParallelism)
        found = self.spark.range(0, len(own), 1, tasks).mapInPandas(run, "v binary").collect()  # a row a range
        return sum(np.frombuffer(bytes(r[0])) for r in found).reshape(-1, own[0][0].shape[2])

    def concordances(self, feature: int, uses: list[int]) -> dict[int, float | None]:
        """Harrell's C by column of whole weights, larger values of a feature dying earlier; equal ones count half, none is without pairs.

        Columns are counted together. Pairs of a block are counted in it, pairs of two blocks and one range of risks in
        that range, the others from a grid of counts; a time of its own is two places, its deaths and then its other rows.
        """
        use = np.array(uses, int)
        if not self.n:
            return dict.fromkeys(uses)

        def place(b: Block) -> np.ndarray:
            return 2 * b.part + (1 - b.e.astype(np.int64) if b.part % 2 else np.zeros(len(b.t), np.int64))

        def inside(b: Block) -> np.ndarray:
            if b.part % 2:
                return np.zeros(3 * len(use))
            n = whole(b.w[:, use])
            # In order of time, at one time the dead first.
            key = 2 * np.cumsum(np.concatenate([[0], b.t[1:] != b.t[:-1]])).astype(np.int64) + (b.e == 0)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            all_ = np.add.reduceat(n[order], first, axis=0, dtype=np.int64)
            dead = np.where((key[order][first] % 2 == 0)[:, None], all_, 0)
            return np.concatenate([later_pairs(dead, all_), pairs(key, b.x[:, feature], b.e, n).ravel()]).astype(float)

        total = self._summed(inside).reshape(3, -1)
        places = np.unique([p for part in self.parts for p in ((2 * part, 2 * part + 1) if part % 2 else (2 * part,))])
        if len(places) > 1:
            total = total + self._between(feature, use, place, places)
        return {u: (float((c + t / 2) / n) if n else None) for u, (n, c, t) in zip(uses, total.T)}

    def _between(self, feature: int, use: np.ndarray, place: Callable[[Block], np.ndarray], places: np.ndarray) -> np.ndarray:
        """Pairs of rows of different places: all, those of smaller and of equal risks, by column of weights."""
        k, u, m = self.k, self.uses, len(use)
        ranges = min(BANDS, max(1, -(-self.n // BAND)))
        risk = self.rows.select(F.get("x", F.lit(feature)).alias("r"))
        bounds = np.array(sorted(set(risk.approxQuantile("r", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else [])

        def dealt(found: list[tuple]) -> pd.DataFrame:
            at, r, e, n = (np.concatenate(v) for v in zip(*found))
            order = np.lexsort((e, at, r))
            at, r, e, n = at[order], r[order], e[order], n[order]
            first = np.concatenate([[True], (at[1:] != at[:-1]) | (r[1:] != r[:-1]) | (e[1:] != e[:-1])])
            if not first.all():
                n = whole(np.add.reduceat(n, np.flatnonzero(first), axis=0, dtype=np.int64))
                at, r, e = at[first], r[first], e[first]
            band = np.searchsorted(bounds, r)
            cuts = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), len(band)]
            return pd.DataFrame([(int(band[a]), *(v[a:b].tobytes() for v in (at, r, e, n))) for a, b in zip(cuts, cuts[1:])], columns=["band", "at", "r", "e", "n"])

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found, size = [], 0
            for batch in batches:
                for row in batch.itertuples(index=False):
                    b = unpack(row, k, u)
                    n = whole(b.w[:, use])
                    own = np.flatnonzero(n.any(axis=1))
                    if not len(own):
                        continue
                    found.append((np.searchsorted(places, place(b)[own]).astype(np.int32), b.x[own, feature] + 0.0, b.e[own].astype(np.uint8), n[own]))
                    size += len(own)
                    if size >= DEALT:
                        yield dealt(found)
                        found, size = [], 0
            if found:
                yield dealt(found)

        def count(b: pa.Table) -> pa.Table:
            at, r, e = (np.concatenate([np.frombuffer(v.as_py(), kind) for v in b[c]]) for c, kind in (("at", np.int32), ("r", float), ("e", np.uint8)))
            sizes = [len(v.as_py()) for v in b["e"]]
            n = np.concatenate([np.frombuffer(v.as_py(), np.uint8 if len(v.as_py()) == size * m else np.int64).reshape(size, m) for v, size in zip(b["n"], sizes)])
            own = pairs(at, r, e, n)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
            sums = np.zeros((2, len(places), m), np.int64)
            sums[0, at[order][first]] = np.add.reduceat(n[order] * (e[order] > 0)[:, None], first, axis=0, dtype=np.int64)
            sums[1, at[order][first]] = np.add.reduceat(n[order], first, axis=0, dtype=np.int64)
            return pa.table({"use": pa.array(range(m), pa.int32()), "band": pa.array([b["band"][0].as_py()] * m, pa.int32()), "v": [np.ascontiguousarray(sums[:, :, i]).tobytes() for i in range(m)], "smaller": own[0], "equal": own[1]})

        def grid(b: pa.Table) -> pa.Table:
            order = np.argsort(b["band"].to_numpy())
            dead, n = np.stack([np.frombuffer(b["v"][int(i)].as_py(), np.int64).reshape(2, -1) for i in order], axis=2)
            after = n[::-1].cumsum(axis=0)[::-1] - n
            below = after.cumsum(axis=1) - after
            smaller, equal = (int(b[c].to_numpy().sum()) for c in ("smaller", "equal"))
            return pa.table({"use": pa.array([b["use"][0].as_py()], pa.int32()), "all": [int((dead.sum(axis=1) * after.sum(axis=1)).sum())], "smaller": [int((dead * below).sum()) + smaller], "equal": [equal]})

        pieces = self.blocks.mapInPandas(deal, "band int, at binary, r binary, e binary, n binary").repartition(len(bounds) + 1, "band")
        bands = pieces.groupBy("band").applyInArrow(count, "use int, band int, v binary, smaller long, equal long")
        out = np.zeros((3, m))
        for row in bands.repartition(m, "use").groupBy("use").applyInArrow(grid, "use int, all long, smaller long, equal long").collect():  # a row a column
            out[:, row["use"]] = row["all"], row["smaller"], row["equal"]
        return out

    def _starts(self, sent: list[tuple], sizes: list[int]) -> tuple[dict, dict]:
        """By range: the risk sets of all later ranges, by model; and the sums of times that are ranges of their own."""

        def totals(b: Block) -> Iterator[tuple]:
            yield b.part, np.concatenate([b.totals(use, f, beta) for _, use, f, beta in sent]).tobytes()

        sums = {p: 0.0 for p in self.parts}
        for part, packed in self._each(totals, "part long, v binary").collect():
            sums[part] = sums[part] + np.frombuffer(bytes(packed))
        cuts = np.cumsum([0, *(4 + 3 * k for k in sizes)])
        start, own, later = {}, {}, [np.zeros(1 + k) for k in sizes]
        for p in reversed(self.parts):
            start[p] = [x.copy() for x in later]
            pieces = [sums[p][a:b] for a, b in zip(cuts, cuts[1:])]
            if p % 2:
                own[p] = [
                    {"S0": v[0] + s[0], "S1": v[1 : 1 + k] + s[1:], "T0": v[1 + k], "T1": v[2 + k : 2 + 2 * k], "d": v[2 + 2 * k], "eta": v[3 + 2 * k], "x": v[4 + 2 * k :]}
                    for v, s, k in zip(pieces, start[p], sizes)
                ]
            for x, v, k in zip(later, pieces, sizes):
                x += v[: 1 + k]
        return start, own

    def fit(self, specs: list[Spec], rounds: int = 100, tolerance: float = 1e-8, least: int = 2, starts: dict[int, np.ndarray] | None = None) -> list[Fit]:
        """All models. One with fewer than ``least`` rows or no feature with spread has an error and coefficients 0.

        ``starts`` has coefficients of z-scored features to begin with.
        """
        fits, work = [], {}
        for g, spec in enumerate(specs):
            f = np.array(spec.features, int)
            fit = Fit(spec, float(self.total[spec.use]) if self.n else 0.0, float(self.events[spec.use]) if self.n else 0.0, np.zeros(len(f)), np.full(len(f), np.nan))
            fits.append(fit)
            if fit.n < least:
                fit.error = "too_few_samples"
                continue
            fit.mean, fit.scale = self.mean[spec.use][f], np.nan_to_num(self.scale[spec.use][f])
            # Spread that is only rounding is none.
            fit.scale[fit.scale <= 1e-12 * np.maximum(1.0, np.abs(fit.mean))] = 0.0
            fit.scale[np.isin(f, self.plain) & (fit.scale > 0)] = 1.0
            good = np.flatnonzero(fit.scale > 0)
            if not len(good):
                fit.error = "no_features"
                continue
            first = np.zeros(len(good)) if starts is None or g not in starts else np.asarray(starts[g], float)[good]
            work[g] = {"good": good, "scale": fit.scale[good], "beta": first, "spec": Spec(spec.use, tuple(f[good].tolist())), "pen": spec.penalty * fit.n, "l1": spec.l1_ratio}

        def evaluated(at: dict[int, np.ndarray]) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
            found = self.evaluate({g: (work[g]["spec"], b / work[g]["scale"]) for g, b in at.items()})
            out = {}
            for g, (ll, grad, info) in found.items():
                w, b = work[g], at[g]
                worth = ll - w["pen"] * (0.5 * (1 - w["l1"]) * b @ b + w["l1"] * np.abs(b).sum())
                out[g] = worth, ll, grad / w["scale"], info / np.outer(w["scale"], w["scale"])
            return out

        state = evaluated({g: w["beta"] for g, w in work.items()}) if work else {}
        active = set(work)
        steps: dict[int, np.ndarray] = {}
        for _ in range(rounds):
            tried = {}
            for g in sorted(active):
                w = work[g]
                if g not in steps:
                    try:
                        steps[g] = proximal_step(w["beta"], state[g][2], state[g][3], w["pen"] * w["l1"], w["pen"] * (1 - w["l1"])) - w["beta"]
                    except np.linalg.LinAlgError:
                        fits[g].error = "singular"
                        active.discard(g)
                        continue
                if not np.abs(steps[g]).max() > tolerance:
                    fits[g].settled = bool(np.isfinite(steps[g]).all())
                    active.discard(g)
                    continue
                tried[g] = w["beta"] + steps[g]
            if not tried:
                break
            for g, new in evaluated(tried).items():
                if np.isfinite(new[0]) and new[0] >= state[g][0] - 1e-10 * max(1.0, abs(state[g][0])):
                    work[g]["beta"], state[g] = tried[g], new
                    del steps[g]
                else:
                    steps[g] = steps[g] / 2
        for g, w in work.items():
            fit, ridge = fits[g], w["pen"] * (1 - w["l1"])
            fit.beta[w["good"]], fit.loglik = w["beta"], state[g][1]
            if not w["l1"] or not w["pen"]:
                try:
                    fit.se[w["good"]] = np.sqrt(np.maximum(np.diag(np.linalg.inv(state[g][3] + ridge * np.eye(len(w["beta"])))), 0))
                except np.linalg.LinAlgError:
                    fit.error = "singular"
        return fits

    def correlations(self, models: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, np.ndarray]]:
        """For each column of weights and features: the rows, and the correlations of the features and, last, of log(1 + time)."""
        sent = [(use, np.array(f, int), np.nan_to_num(self.mean[use][list(f)])) for use, f in models]

        def products(b: Block) -> np.ndarray:
            done = []
            for use, f, mean in sent:
                z = np.column_stack([np.ones(len(b.t)), b.x[:, f] - mean, np.log1p(b.t)])
                done.append(((z * b.w[:, use, None]).T @ z).ravel())
            return np.concatenate(done)

        out, at, v = [], 0, self._summed(products)
        for use, f, _ in sent:
            k = len(f) + 2
            m = v[at : at + k * k].reshape(k, k)
            at += k * k
            cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / max(m[0, 0], 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            sd = np.where(sd > 1e-12 * np.sqrt(np.diag(m)[1:] + 1e-300), sd, np.inf)
            r = cov / np.outer(sd, sd)
            np.fill_diagonal(r, 1.0)
            out.append((int(m[0, 0]), r))
        return out

    def risks(self, models: dict[int, tuple[Fit, int]]) -> DataFrame:
        """``g, t, e, n, risk`` of the rows that each model's column of test weights has."""
        sent = [(g, use, np.array(fit.spec.features, int), fit.raw) for g, (fit, use) in models.items()]

        def each(b: Block) -> Iterator[pd.DataFrame]:
            for g, use, f, beta in sent:
                own = np.flatnonzero(b.w[:, use] > 0)
                if len(own):
                    yield pd.DataFrame({"g": g, "t": b.t[own], "e": b.e[own].astype(int), "n": b.w[own, use].astype(int), "risk": b.x[np.ix_(own, f)] @ beta})

        return self._each(each, "g int, t double, e int, n long, risk double")


@dataclass
class Block:
    """Rows of a range of times, in order of time."""

    part: int
    t: np.ndarray
    e: np.ndarray
    x: np.ndarray
    w: np.ndarray

    def _weighed(self, use: int, features: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = self.x[:, features]
        eta = np.clip(x @ beta, -500, 500)
        return x, eta, self.w[:, use], self.w[:, use] * np.exp(eta)

    def totals(self, use: int, features: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Sums over all rows and over the dead."""
        x, eta, n, w = self._weighed(use, features, beta)
        dead, gone = w * self.e, n * self.e
        return np.concatenate([[w.sum()], w @ x, [dead.sum()], dead @ x, [gone.sum(), gone @ eta], gone @ x])

    def _columns(self, use: np.ndarray, at: np.ndarray, beta: np.ndarray, mean: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some models at a time: their places, and features, risks, counts and weights of the rows by model."""
        width = max(1, CELLS // max(len(self.t), 1))
        for lo in range(0, len(at), width):
            own = slice(lo, lo + width)
            x = self.x[:, at[own]] - mean[own]
            eta = np.clip(x * beta[own], -500, 500)
            n = self.w[:, use[own][:1]] if (use[own] == use[lo]).all() else self.w[:, use[own]]
            yield own, x, eta, n, n * np.exp(eta)

    def line_totals(self, use: np.ndarray, at: np.ndarray, beta: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Sums of weights, of features and of their squares by model; for a time of its own also those of the dead, their count, risks and features."""
        out = np.zeros((9 if self.part % 2 else 3, len(at)))
        for own, x, eta, n, w in self._columns(use, at, beta, mean):
            wx = w * x
            out[:3, own] = w.sum(axis=0), wx.sum(axis=0), np.einsum("ij,ij->j", wx, x)
            if self.part % 2:
                e = self.e[:, None]
                gone = n * e
                out[3:, own] = (w * e).sum(axis=0), (wx * e).sum(axis=0), (wx * x * e).sum(axis=0), gone.sum(axis=0), (gone * eta).sum(axis=0), (gone * x).sum(axis=0)
        return out

    def lines(self, use: np.ndarray, at: np.ndarray, beta: np.ndarray, mean: np.ndarray, start: np.ndarray | None) -> np.ndarray:
        """Log-likelihoods, gradients and information of models of one feature, given the later risk sets."""
        out = np.zeros((3, len(at)))
        gone = np.flatnonzero(self.e)
        if not len(gone):
            return out
        fresh = np.concatenate([[True], self.t[1:] != self.t[:-1]])
        first, which = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        died = np.flatnonzero(np.concatenate([[True], self.t[gone][1:] != self.t[gone][:-1]]))
        when = which[gone][died]
        for own, x, eta, n, w in self._columns(use, at, beta, mean):
            terms = np.stack([w, w * x, w * x * x])
            risk = np.add.reduceat(terms, first, axis=1)[:, ::-1].cumsum(axis=1)[:, ::-1][:, when]
            if start is not None:
                risk = risk + start[:, None, own]
            out[0, own], out[1, own] = (n[gone] * eta[gone]).sum(axis=0), (n[gone] * x[gone]).sum(axis=0)
            out[:, own] -= efron_lines(risk, np.add.reduceat(terms[:, gone], died, axis=1), np.add.reduceat(n[gone], died, axis=0))
        return out

    def _few(self, use: np.ndarray, features: np.ndarray, beta: np.ndarray, mean: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some models at a time: their places, ones, features and products, and risks, counts and weights of the rows by model."""
        x = self.x[:, features] - mean
        i, j = np.triu_indices(len(features))
        z = np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])
        width = max(1, 8 * CELLS // max(len(x), 1))
        for lo in range(0, len(use), width):
            own = slice(lo, lo + width)
            eta = np.clip(x @ beta[own].T, -500, 500)
            n = self.w[:, use[own]]
            yield own, z, eta, n, n * np.exp(eta)

    def few_totals(self, use: np.ndarray, features: np.ndarray, beta: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Sums of weights, features and products by model; for a time of its own also those of the dead, their count, risks and features."""
        k, found = len(features), []
        for _, z, eta, n, w in self._few(use, features, beta, mean):
            sums = [z.T @ w]
            if self.part % 2:
                died = np.flatnonzero(self.e)
                gone = n[died]
                sums += [z[died].T @ w[died], gone.sum(axis=0)[None], (gone * eta[died]).sum(axis=0)[None], z[died, 1 : 1 + k].T @ gone]
            found.append(np.concatenate(sums))
        return np.concatenate(found, axis=1)

    def few(self, use: np.ndarray, features: np.ndarray, beta: np.ndarray, mean: np.ndarray, start: np.ndarray | None) -> np.ndarray:
        """Log-likelihoods, gradients and information of models of the same few features, given the later risk sets."""
        k = len(features)
        out = np.zeros((1 + k + k * (k + 1) // 2, len(use)))
        died = np.flatnonzero(self.e)
        if not len(died):
            return out
        fresh = np.concatenate([[True], self.t[1:] != self.t[:-1]])
        first, which = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        starts = np.flatnonzero(np.concatenate([[True], self.t[died][1:] != self.t[died][:-1]]))
        when = which[died][starts]

        def by_time(z: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
            if len(at) <= 64:
                return np.stack([z[a:b].T @ w[a:b] for a, b in zip(at, [*at[1:], len(w)])], axis=1)
            return np.stack([np.add.reduceat(w * c[:, None], at, axis=0) for c in z.T])

        for own, z, eta, n, w in self._few(use, features, beta, mean):
            risk = by_time(z, w, first)[:, ::-1].cumsum(axis=1)[:, ::-1][:, when]
            if start is not None:
                risk = risk + start[:, None, own]
            gone = n[died]
            out[0, own], out[1 : 1 + k, own] = (gone * eta[died]).sum(axis=0), z[died, 1 : 1 + k].T @ gone
            out[:, own] -= efron_sums(risk, by_time(z[died], w[died], starts), np.add.reduceat(gone, starts, axis=0), k)
        return out

    def gram(self, use: int, features: np.ndarray, beta: np.ndarray, hazard: np.ndarray | float) -> np.ndarray:
        """Sums of products of features, by the rows' weights and hazards."""
        x, _, _, w = self._weighed(use, features, beta)
        return (x * (w * hazard)[:, None]).T @ x

    def ties(self, use: int, features: np.ndarray, beta: np.ndarray, start: np.ndarray | None, before: float, hessian: bool) -> tuple[float, np.ndarray, np.ndarray, float]:
        """Log-likelihood, gradient, information and sum of 1/phi of these times, given the later risk sets and the earlier sums."""
        x, eta, n, w = self._weighed(use, features, beta)
        k = len(features)
        first = np.flatnonzero(np.concatenate([[True], self.t[1:] != self.t[:-1]]))
        which = np.cumsum(np.concatenate([[0], self.t[1:] != self.t[:-1]])).astype(int)
        add = lambda v: np.add.reduceat(v, first, axis=0)
        dead, gone = w * self.e, n * self.e
        deaths = add(gone)
        at = np.flatnonzero(deaths > 0)
        if not len(at):
            none = self.gram(use, features, beta, before) if hessian else np.zeros(0)
            return 0.0, np.zeros(k), none, 0.0
        s0, s1 = add(w)[::-1].cumsum()[::-1], add(w[:, None] * x)[::-1].cumsum(axis=0)[::-1]
        if start is not None:
            s0, s1 = s0 + start[0], s1 + start[1:]
        logs, part, second, h, lack = tied(s0[at], s1[at], add(dead)[at], add(dead[:, None] * x)[at], deaths[at])
        info = np.zeros(0)
        if hessian:
            by_time, less = np.zeros(len(first)), np.zeros(len(first))
            by_time[at], less[at] = h, lack
            info = self.gram(use, features, beta, before + by_time.cumsum()[which] - self.e * less[which]) - second
        return float(gone @ eta - logs), gone @ x - part, info, float(h.sum())


def unpack(row, k: int, u: int) -> Block:
    """The block of a packed row of ``k`` features and ``u`` weights, which are of 8 bytes or of one."""
    t, e, x = (np.frombuffer(v).reshape(s) for v, s in zip((row.t, row.e, row.x), (-1, -1, (-1, k))))
    w = np.frombuffer(row.w, np.uint8).astype(float) if len(row.w) == len(t) * u else np.frombuffer(row.w)
    return Block(int(row.part), t, e, x, w.reshape(-1, u))


def wide(column: pa.Array, size: int) -> np.ndarray:
    """Rows of arrays of ``size`` numbers, or of as many bytes."""
    sizes = column.value_lengths() if isinstance(column, pa.ListArray) else pa.compute.binary_length(column)
    if (sizes.to_numpy(zero_copy_only=False) != size).any():
        raise ValueError(f"arrays of other sizes than {size}")
    if isinstance(column, pa.ListArray):
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size)


def whole(n: np.ndarray) -> np.ndarray:
    """Whole counts in a byte each where they fit."""
    return n.astype(np.uint8 if n.size and n.max() < 256 else np.int64)


def proximal_step(beta: np.ndarray, grad: np.ndarray, info: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The coefficients that maximise the quadratic model less ``l1`` times their sizes and ``l2`` times half their squares."""
    info = info + 1e-10 * np.eye(len(beta))
    if not l1:
        return beta + np.linalg.solve(info + l2 * np.eye(len(beta)), grad - l2 * beta)
    new, moved = beta.copy(), np.zeros(len(beta))
    for _ in range(10_000):
        most = 0.0
        for j in range(len(beta)):
            pull = grad[j] - moved[j] + info[j, j] * new[j]
            value = np.sign(pull) * max(abs(pull) - l1, 0.0) / (info[j, j] + l2)
            if value != new[j]:
                most = max(most, abs(value - new[j]))
                moved += info[:, j] * (value - new[j])
                new[j] = value
        if most < 1e-11:
            break
    return new
