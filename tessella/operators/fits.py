"""Cox and logistic fits by group whose gradients and Hessians are Spark sums, and concordance of continuous risks.

Rows are first counted by exact values. A round of Newton's method is one job that returns a row a group; the driver solves
it. Risk sets are running sums over a row a time, inside ranges of times. Pairs of a concordance are counted in strips of a
range of times or of risks and in a grid of ranges, never listed; no task holds a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.cuts import cut
from tessella.operators.ranking import RANGES, bucket

#: Deaths, with their shares of ties, that a task adds up in one step.
STEP = 1 << 16
#: Rows of a strip aimed at, and the most ranges.
STRIP, MOST = 100_000, 256


def with_values(cells: DataFrame, values: dict[int, np.ndarray], names: list[str]) -> DataFrame:
    """``cells`` of the groups ``g`` in ``values`` with their values as columns."""
    rows = [(g, *map(float, v)) for g, v in values.items()]
    return cells.join(F.broadcast(cells.sparkSession.createDataFrame(rows, "g int, " + ", ".join(f"{n} double" for n in names))), "g")  # a row a group


def grouped(df: DataFrame, by: str, xs: list[str], train: Column | None = None) -> tuple[list, dict[int, tuple[int, np.ndarray, np.ndarray]], DataFrame]:
    """Group keys, rows, means and deviations of each (of the training rows where given), and ``df`` with the number ``g`` in place of the key."""
    keep = train if train is not None else F.lit(True)
    stats = [f(F.when(keep, F.col(x))) for x in xs for f in (F.avg, F.stddev_samp)]
    found = df.groupBy(by).agg(F.count_if(keep).alias("__n"), *[s.alias(f"__s{i}") for i, s in enumerate(stats)]).orderBy(by).collect()
    number = lambda v: float("nan") if v is None else float(v)
    size = {g: (r["__n"], np.array([number(r[f"__s{2 * i}"]) for i in range(len(xs))]), np.array([number(r[f"__s{2 * i + 1}"]) for i in range(len(xs))])) for g, r in enumerate(found)}
    keys = [r[by] for r in found]
    kind = df.schema[by].dataType.simpleString()
    ids = df.sparkSession.createDataFrame([(k, g) for g, k in enumerate(keys)], f"__key {kind}, g int")
    return keys, size, df.withColumnRenamed(by, "__by").join(F.broadcast(ids), F.col("__by").eqNullSafe(F.col("__key"))).drop("__by", "__key")  # a row a group


def newton(sizes: dict, sums: Callable[[dict], dict], ridge: dict, rounds: int, tolerance: float, most: float) -> dict:
    """Coefficients and standard errors by group, of ``sizes`` coefficients; groups that have settled leave the later rounds.

    Groups that haven't after all rounds are left out, as singular ones are.
    """
    beta, done = {g: np.zeros(k) for g, k in sizes.items()}, {}
    for _ in range(rounds):
        if not beta:
            break
        found = sums(beta)
        for g in list(beta):
            k = sizes[g]
            score, info = found.get(g, (np.zeros(k), np.zeros((k, k))))
            score, info = score - ridge[g] * beta[g], info + (ridge[g] + 1e-12) * np.eye(k)
            try:
                step, spread = np.linalg.solve(info, score), np.linalg.inv(info)
            except np.linalg.LinAlgError:
                del beta[g]
                done.pop(g, None)
                continue
            beta[g] = beta[g] + np.clip(step, -most, most)
            done[g] = beta[g], np.sqrt(np.diag(spread))
            if not np.abs(step).max() >= tolerance:
                del beta[g]
    return {g: fit for g, fit in done.items() if g not in beta}


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(values: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(_pairs(k), values, strict=True):
        out[i, j] = out[j, i] = v
    return out


def cox(cells: DataFrame, groups: dict[int, int], time: str, event: str, xs: list[str], ridge: float = 0.0, rounds: int = 50) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Cox coefficients and standard errors of ``groups`` (number: rows) with Efron's ties; ``cells`` are ``g``, time, event, ``xs`` and counts ``n``.

    ``ridge`` is scaled by the rows.
    """
    return cox_models(cells, groups, time, event, [xs], ridge, rounds)[0]


def cox_models(cells: DataFrame, groups: dict[int, int], time: str, event: str, specs: list[list[str]], ridge: float = 0.0, rounds: int = 50) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """``cox`` for several lists of columns: a round is one pass for all that haven't settled."""
    xs = list(dict.fromkeys(x for spec in specs for x in spec))
    own = [[xs.index(x) for x in spec] for spec in specs]
    cells = cells.select("g", F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), "n", *[F.col(x).alias(f"z{i}") for i, x in enumerate(xs)])
    bounds = sorted(set(cells.approxQuantile("t", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES)) or []))
    cells = cut(cells.withColumn("at", bucket(F.col("t"), bounds) if bounds else F.lit(0)))
    tasks = cells.sparkSession.sparkContext.defaultParallelism

    def terms(m: int) -> list[str]:
        k = len(own[m])
        return [f"{m}_0", *[f"{m}_1_{i}" for i in range(k)], *[f"{m}_2_{i}_{j}" for i, j in _pairs(k)]]

    def efron(active: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                deaths = b["d"].to_numpy(np.int64)
                ends = np.cumsum(deaths)
                g, which = np.unique(b["g"].to_numpy(), return_inverse=True)
                out = {"g": g}
                for m in active:
                    k = len(own[m])
                    s, t = (b[[f"{c}{n}" for n in terms(m)]].to_numpy(float) for c in "st")
                    # A sum over deaths of (s - share t) / phi is t / t0 for each and what is left of s times the sum of 1 / phi.
                    h, h2 = np.zeros(len(b)), np.zeros(len(b))
                    for lo in range(0, int(ends[-1]), STEP):
                        one = np.arange(lo, min(lo + STEP, int(ends[-1])))
                        row = np.searchsorted(ends, one, side="right")
                        phi = s[row, 0] - (one - ends[row] + deaths[row]) / deaths[row] * t[row, 0]
                        h += np.bincount(row, 1 / phi, minlength=len(b))
                        h2 += np.bincount(row, 1 / phi**2, minlength=len(b))
                    a = t[:, 1:] / t[:, :1]
                    rest = s[:, 1:] - s[:, :1] * a
                    both = deaths[:, None] * a + h[:, None] * rest
                    squares = np.stack([deaths * a[:, i] * a[:, j] + h * (a[:, i] * rest[:, j] + rest[:, i] * a[:, j]) + h2 * rest[:, i] * rest[:, j] for i, j in _pairs(k)], axis=1)
                    found = np.hstack([b[[f"x{m}_{i}" for i in range(k)]].to_numpy(float) - both[:, :k], both[:, k:] - squares])
                    out |= {f"v{m}_{i}": np.bincount(which, v, minlength=len(g)) for i, v in enumerate(found.T)}
                yield pd.DataFrame(out)

        return run

    def sums(beta: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        active, going = sorted({m for m, _ in beta}), sorted({g for _, g in beta})
        # A model that has settled goes on as zeros beside the others of its group.
        values = {g: np.concatenate([beta.get((m, g), np.zeros(len(own[m]))) for m in active]) for g in going}
        rows = with_values(cells, values, [f"b{m}_{i}" for m in active for i in range(len(own[m]))])
        dead = F.col("n") * F.col("e")
        for m in active:
            line = sum((F.col(f"b{m}_{i}") * F.col(f"z{c}") for i, c in enumerate(own[m])), F.lit(0.0))
            rows = rows.withColumn(f"w{m}", F.col("n") * F.exp(F.greatest(F.least(line, F.lit(500.0)), F.lit(-500.0))))
        made = {}
        for m in active:
            z, w = [F.col(f"z{c}") for c in own[m]], F.col(f"w{m}")
            made |= dict(zip(terms(m), [w, *[w * x for x in z], *[w * z[i] * z[j] for i, j in _pairs(len(z))]], strict=True))
        gone = [f"x{m}_{i}" for m in active for i in range(len(own[m]))]
        per = rows.groupBy("g", "at", "t").agg(
            *[F.sum(x).alias(f"s{n}") for n, x in made.items()], *[F.sum(x * F.col("e")).alias(f"t{n}") for n, x in made.items()],
            F.sum(dead).alias("d"), *[F.sum(dead * F.col(f"z{c}")).alias(f"x{m}_{i}") for m in active for i, c in enumerate(own[m])],
        )
        later = Window.partitionBy("g").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        inside = Window.partitionBy("g", "at").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        start = per.groupBy("g", "at").agg(*[F.sum(f"s{n}").alias(f"r{n}") for n in made]).select("g", "at", *[F.coalesce(F.sum(f"r{n}").over(later), F.lit(0.0)).alias(f"r{n}") for n in made])
        risk = per.select("g", "at", "d", *gone, *[f"t{n}" for n in made], *[F.sum(f"s{n}").over(inside).alias(f"s{n}") for n in made]).where("d > 0")
        risk = risk.join(start, ["g", "at"]).select("g", "at", "d", *gone, *[f"t{n}" for n in made], *[(F.col(f"s{n}") + F.col(f"r{n}")).alias(f"s{n}") for n in made])
        width = {m: len(own[m]) + len(_pairs(len(own[m]))) for m in active}
        names = [f"v{m}_{i}" for m in active for i in range(width[m])]
        # Few rows may stand for many deaths, so they are dealt over tasks.
        dealt = risk.repartition(tasks, "g", "at").mapInPandas(efron(active), "g int, " + ", ".join(f"{v} double" for v in names))
        found = {r["g"]: r for r in dealt.groupBy("g").agg(*[F.sum(v).alias(v) for v in names]).collect()}  # a row a group
        out = {}
        for m, g in beta:
            if g in found:
                v = [found[g][f"v{m}_{i}"] for i in range(width[m])]
                out[m, g] = np.array(v[: len(own[m])]), _square(v[len(own[m]) :], len(own[m]))
        return out

    keys = [(m, g) for m in range(len(specs)) for g in groups]
    done = newton({(m, g): len(own[m]) for m, g in keys}, sums, {(m, g): ridge * groups[g] for m, g in keys}, rounds, 1e-9, 5.0)
    return [{g: done[m, g] for g in groups if (m, g) in done} for m in range(len(specs))]


def logistic(cells: DataFrame, groups: list[int], label: str, xs: list[str], ridge: float = 1e-8, rounds: int = 100) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Logistic coefficients (the intercept first) and standard errors of ``groups``; ``cells`` are ``g``, label, ``xs`` and counts ``n``."""
    k = 1 + len(xs)
    cells = cut(cells.select("g", F.col(label).cast("double").alias("y"), "n", *[F.col(x).alias(f"z{i + 1}") for i, x in enumerate(xs)]))
    z = [F.lit(1.0), *[F.col(f"z{i}") for i in range(1, k)]]

    def sums(beta: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = with_values(cells, beta, [f"b{i}" for i in range(k)])
        line = sum((F.col(f"b{i}") * z[i] for i in range(k)), F.lit(0.0))
        rows = rows.withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(500.0)), F.lit(-500.0)))))
        gap, weight = F.col("n") * (F.col("y") - F.col("p")), F.col("n") * F.col("p") * (1 - F.col("p"))
        terms = [*[gap * x for x in z], *[weight * z[i] * z[j] for i, j in _pairs(k)]]
        found = rows.groupBy("g").agg(*[F.sum(x).alias(f"v{i}") for i, x in enumerate(terms)]).collect()
        return {r["g"]: (np.array(r[1 : 1 + k]), _square(r[1 + k :], k)) for r in found}

    return newton({g: k for g in groups}, sums, {g: ridge for g in groups}, rounds, 1e-10, float("inf"))


def dominance(key: np.ndarray, risk: np.ndarray, deaths: np.ndarray, count: np.ndarray) -> tuple[int, int, int]:
    """Pairs of a death and a row of a later key: all, those of a smaller risk, those of an equal one."""

    def later(order_prefix: np.ndarray, at: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of earlier rows of a prefix with another key, and where the prefix starts; rows are in order of prefix and key."""
        own = np.arange(len(at))
        fresh = np.concatenate([[True], order_prefix[1:] != order_prefix[:-1]])
        moved = fresh | np.concatenate([[True], at[1:] != at[:-1]])
        upto, start = np.concatenate([[0], np.cumsum(counted)]), np.maximum.accumulate(np.where(fresh, own, 0))
        return upto[np.maximum.accumulate(np.where(moved, own, 0))] - upto[start], start

    if not len(key):
        return 0, 0, 0
    order = np.argsort(-key, kind="stable")
    rank, at, d, n = np.unique(risk, return_inverse=True)[1].astype(np.int64)[order], key[order], deaths[order], count[order]
    comparable = int((d * later(np.zeros_like(rank), at, n)[0]).sum())
    smaller, own = 0, np.arange(len(key))
    # From the highest bit on, rows of each prefix are parted by the next one and stay in order of keys: nothing is sorted again.
    for b in reversed(range(int(rank.max()).bit_length())):
        low = (rank >> b & 1) == 0
        prefix = rank >> (b + 1)
        found, start = later(prefix, at, np.where(low, n, 0))
        smaller += int(np.where(low, 0, d * found).sum())
        lows = np.concatenate([[0], np.cumsum(low)])
        ends = np.concatenate([np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(key)]])
        end = ends[np.searchsorted(ends, start, side="right")]
        before = lows[own] - lows[start]
        to = np.where(low, start + before, start + lows[end] - lows[start] + own - start - before)
        moved = [np.empty_like(v) for v in (rank, at, d, n)]
        for new, v in zip(moved, (rank, at, d, n), strict=True):
            new[to] = v
        rank, at, d, n = moved
    return comparable, smaller, int((d * later(rank, at, n)[0]).sum())


def concordance(df: DataFrame, time: str, event: str, risk: str, ranges: int = 0) -> DataFrame:
    """Harrell's C by ``g`` of rows with counts ``n``: ``comparable``, ``concordant``, ``tied`` and ``c_index``; equal risks count half.

    Pairs of two ranges of times and two of risks come from a grid of counts, those within a range of times or only within
    one of risks from strips. A frequent time or risk is a range of its own, within which nothing needs sorting.
    """
    cells = cut(df.select("g", F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(risk).cast("double").alias("r"), F.col("n").cast("long").alias("n")))
    ranges = ranges or min(MOST, max(16, -(-cells.count() // STRIP)))
    at = [sorted(set(q or [])) for q in cells.approxQuantile(["t", "r"], [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))]

    def placed(column: str, bounds: list[float]) -> tuple[Column, Column]:
        if not bounds:
            return F.lit(0), F.lit(False)
        place = bucket(F.col(column), bounds)
        return place, F.coalesce(F.get(F.array(*map(F.lit, bounds)), place) == F.col(column), F.lit(False))

    (ti, t_is), (ri, r_is) = placed("t", at[0]), placed("r", at[1])
    # In order of time: those between two bounds, then deaths at the bound, then the others at it.
    cells = cells.withColumn("tr", 3 * ti + F.when(t_is, F.lit(2) - F.col("e")).otherwise(0)).withColumn("rr", 2 * ri + r_is.cast("int"))
    n, d = F.sum("n").alias("n"), F.sum(F.col("n") * F.col("e")).alias("d")
    kind = "g int, comparable long, concordant long, tied long"

    def counted(rows: DataFrame, keys: list[str], use: tuple[int, int, int]) -> DataFrame:
        def run(b: pd.DataFrame) -> pd.DataFrame:
            moment = np.unique(b["t"].to_numpy(), return_inverse=True)[1].astype(np.int64)
            found = dominance(2 * moment + b["last"].to_numpy(np.int64), b["r"].to_numpy(), b["d"].to_numpy(np.int64), b["n"].to_numpy(np.int64))
            return pd.DataFrame([[b["g"].iloc[0], *(x * u for x, u in zip(found, use, strict=True))]], columns=["g", "comparable", "concordant", "tied"])

        return rows.groupBy(*keys).applyInPandas(run, kind)

    strips = cells.where("tr % 3 = 0").groupBy("g", "tr", "t", (1 - F.col("e")).alias("last"), "r").agg(n, d)
    bands = cells.groupBy("g", "rr", F.col("tr").alias("t"), F.lit(0).alias("last"), "r").agg(n, d)
    grid = cells.groupBy("g", F.col("tr").alias("t"), F.lit(0).alias("last"), F.col("rr").alias("r")).agg(n, d)
    found = counted(strips, ["g", "tr"], (1, 1, 1)).unionByName(counted(bands, ["g", "rr"], (0, 1, 1))).unionByName(counted(grid, ["g"], (1, 1, 0)))
    sums = found.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("comparable", "concordant", "tied")])
    return sums.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("comparable")))
