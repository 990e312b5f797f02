"""Nested cross-validation of Cox models: folds inside folds as columns of weights, selection on training rows, held-out concordance.

Rows are packed once an endpoint (see ``riskblocks``). Outer folds, inner folds, penalties and methods are models of the
same passes; nothing is fitted a fold at a time.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import fits, selection
from tessella.operators.kernels import normal_p
from tessella.operators.resampling import folds
from tessella.operators.riskblocks import BLOCK, Fit, RiskBlocks, Spec

# Fixed values.
#: Penalties and shares of the absolute part that an elastic net is tuned over.
GRID = tuple((penalty, share) for share in (0.5, 0.9, 1.0) for penalty in (0.01, 0.05, 0.1, 0.5))
#: The ridge of scored models, and the least rows to train and to test on, and deaths to screen with.
RIDGE, LEAST_TRAIN, LEAST_TEST, LEAST_DEATHS = 0.05, 30, 5, 5
#: Features that a training set's variance, its screen and its elastic net go on with.
VARIED, SCREENED, NETTED = 5000, 500, 250
#: Coefficients beyond which a feature is selected by an elastic net, and the most that are.
NONZERO, MOST = 1e-6, 25


@dataclass
class Nested:
    """Packed rows with the columns of weights of all folds."""

    blocks: RiskBlocks
    outer: int
    inner: int

    def _at(self, fold: int) -> int:
        return fold * (2 + 2 * self.inner)

    def train(self, fold: int) -> int:
        """The rows outside an outer fold."""
        return self._at(fold)

    def test(self, fold: int) -> int:
        """The rows of an outer fold."""
        return self._at(fold) + 1

    def inner_train(self, fold: int, part: int) -> int:
        """The training rows of an outer fold outside an inner one."""
        return self._at(fold) + 2 + 2 * part

    def inner_test(self, fold: int, part: int) -> int:
        """The training rows of an outer fold inside an inner one."""
        return self._at(fold) + 3 + 2 * part


def nested_folds(df: DataFrame, key: str, time: str, event: str, features: str, outer: int = 5, inner: int = 3, seed: str = "nested-1", block: int = BLOCK, plain: tuple[int, ...] = ()) -> Nested:
    """Rows with stratified outer folds and, in the training rows of each, stratified inner ones, by draws of the key.

    Rows with a null key, time or event are left out, and so are those with incomplete features. Rows that share a key
    share their folds.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(event).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"), F.col(features).cast("array<double>").alias("x"))
    keys = rows.groupBy("key").agg(F.max("event").alias("event"))
    dealt = folds(keys, "key", "event", outer, f"{seed}|outer", "outer")
    each = dealt.withColumn("of", F.explode(F.array(*map(F.lit, range(outer))))).where("of <> outer")
    each = each.select("key", "outer", "of", F.concat_ws("|", "of", "key").alias("id"), F.concat_ws("|", "of", "event").alias("label"))
    parts = folds(each, "id", "label", inner, f"{seed}|inner", "part").groupBy("key", "outer").agg(*[F.max(F.when(F.col("of") == f, F.col("part"))).alias(f"p{f}") for f in range(outer)])
    weights = []
    for f in range(outer):
        out, part = F.col("outer") == f, F.coalesce(F.col(f"p{f}"), F.lit(-1))
        weights += [~out, out] + [w for i in range(inner) for w in (~out & (part != i), ~out & (part == i))]
    full = rows.join(parts.withColumnRenamed("key", "of_key"), F.col("key") == F.col("of_key"))
    return Nested(RiskBlocks(full.withColumn("w", F.array(*[w.cast("double") for w in weights])), "time", "event", "x", "w", block, plain), outer, inner)


def held_out(nested: Nested, models: dict[object, tuple[Fit, int]]) -> dict[object, float | None]:
    """Harrell's C of each model's risk on the rows of its column of test weights; none where the model has an error or few rows to test."""
    names = [m for m, (fit, use) in models.items() if not fit.error and nested.blocks.total[use] >= LEAST_TEST]
    if not names:
        return dict.fromkeys(models)
    risks = nested.blocks.risks({g: models[m] for g, m in enumerate(names)})
    found = {names[r["g"]]: r["c_index"] for r in fits.concordance(risks, "t", "e", "risk").collect()}  # a row a model
    return {m: found.get(m) for m in models}


def tune(nested: Nested, features: list[tuple[int, ...]], grid: tuple[tuple[float, float], ...] = GRID) -> list[list[dict]]:
    """By outer fold, for each penalty and share: the mean of Harrell's C on the inner folds, each fitted on the others."""
    tried = [(f, i, g) for f in range(nested.outer) for i in range(nested.inner) for g in range(len(grid))]
    found = nested.blocks.fit([Spec(nested.inner_train(f, i), features[f], *grid[g]) for f, i, g in tried], least=LEAST_TRAIN)
    c = held_out(nested, {m: (fit, nested.inner_test(m[0], m[1])) for m, fit in zip(tried, found)})
    out = []
    for f in range(nested.outer):
        rows = []
        for g, (penalty, share) in enumerate(grid):
            own = [c[f, i, g] for i in range(nested.inner) if c[f, i, g] is not None]
            starts = [fit.beta for m, fit in zip(tried, found) if (m[0], m[2]) == (f, g)]
            rows.append({"penalizer": penalty, "l1_ratio": share, "mean_inner_c": sum(own) / len(own) if own else None, "start": np.mean(starts, axis=0)})
        out.append(rows)
    return out


def best(rows: list[dict]) -> dict:
    """The penalty of the largest mean C, the first of equal ones; the first of all where none has any."""
    return max(rows, key=lambda r: -math.inf if r["mean_inner_c"] is None else r["mean_inner_c"])


def elastic_nets(nested: Nested, features: list[tuple[int, ...]], grid: tuple[tuple[float, float], ...] = GRID) -> list[tuple[dict, Fit, list[int], str]]:
    """By outer fold: the tuned penalty, the model of all training rows, its features by size of coefficient, and a note.

    Features are those whose coefficients aren't zero, at most ``MOST``; where all are, the ten largest of all. The last fits
    begin where the inner ones of their penalty ended.
    """
    chosen = [best(rows) for rows in tune(nested, features, grid)]
    found = nested.blocks.fit([Spec(nested.train(f), features[f], c["penalizer"], c["l1_ratio"]) for f, c in enumerate(chosen)], least=LEAST_TRAIN, starts={f: c["start"] for f, c in enumerate(chosen)})
    out = []
    for c, fit in zip(chosen, found):
        order = np.argsort(-np.abs(fit.beta), kind="stable").tolist()
        nonzero = [i for i in order if abs(fit.beta[i]) > NONZERO]
        note = fit.error or ("" if nonzero else "no_nonzero_coefficients_used_top10_abs_coef")
        out.append((c, fit, [] if fit.error else [fit.spec.features[i] for i in (nonzero[:MOST] or order[:10])], note))
    return out


def wald(fit: Fit, i: int) -> float:
    """The p-value of a coefficient, 1 where it has none."""
    se = fit.se[i] if not fit.error else float("nan")
    return normal_p(float(fit.beta[i] / se)) if np.isfinite(se) and se > 0 and np.isfinite(fit.beta[i]) else 1.0


def screen(blocks: RiskBlocks, uses: list[int], most_varied: int = VARIED) -> list[list[tuple[float, int]]]:
    """By column of weights: p-values of univariate Cox models of the most varied features, the least first; features without one are left out."""
    tried = []
    for u in uses:
        if blocks.total[u] >= LEAST_TRAIN and blocks.events[u] >= LEAST_DEATHS:
            varied = np.argsort(-np.nan_to_num(blocks.scale[u]), kind="stable")[:most_varied]
            tried += [(u, int(i)) for i in sorted(varied.tolist())]
    found = blocks.fit([Spec(u, (i,)) for u, i in tried]) if tried else []
    out: dict[int, list[tuple[float, int]]] = {u: [] for u in uses}
    for (u, i), fit in zip(tried, found):
        if not fit.error and fit.settled:
            out[u].append((wald(fit, 0), i))
    return [sorted(out[u]) for u in uses]


def conditional(blocks: RiskBlocks, uses: list[int], candidates: list[list[int]], enter: float = 0.01, leave: float = 0.05, most: int = 10, penalty: float = RIDGE) -> list[list[int]]:
    """Forward-backward selection by conditional Cox models, for several columns of weights side by side.

    A round fits every candidate beside the chosen ones; the one with the least p below ``enter`` joins, then chosen ones
    with a p above ``leave`` go, the weakest first. It ends when none joins, after ``most`` rounds, or when a choice would
    come back.
    """
    chosen: list[list[int]] = [[] for _ in uses]
    seen: list[set] = [{()} for _ in uses]
    going = {a for a, c in enumerate(candidates) if c}
    for _ in range(most):
        tried = [(a, i) for a in sorted(going) for i in candidates[a] if i not in chosen[a]]
        if not tried:
            break
        found = blocks.fit([Spec(uses[a], (*chosen[a], i), penalty) for a, i in tried], least=LEAST_TRAIN)
        for a in sorted(going):
            p, i = min(((wald(fit, len(chosen[a])), i) for (b, i), fit in zip(tried, found) if b == a and fit.settled), default=(1.0, -1))
            if p >= enter:
                going.discard(a)
            else:
                chosen[a].append(i)
        shrinking = {a for a in going if len(chosen[a]) > 1}
        while shrinking:
            order = sorted(shrinking)
            for a, fit in zip(order, blocks.fit([Spec(uses[a], tuple(chosen[a]), penalty) for a in order], least=LEAST_TRAIN)):
                worst, k = max((wald(fit, k), k) for k in range(len(chosen[a])))
                if worst <= leave:
                    shrinking.discard(a)
                else:
                    chosen[a].pop(k)
                    shrinking -= {a} if len(chosen[a]) < 2 else set()
        for a in list(going):
            if tuple(sorted(chosen[a])) in seen[a]:
                going.discard(a)
            seen[a].add(tuple(sorted(chosen[a])))
    return chosen


def random_set(candidates: list[int], size: int, *seed: object) -> list[int]:
    """Candidates of the least draws by md5."""
    return sorted(candidates, key=lambda i: hashlib.md5("|".join(map(str, (*seed, i))).encode()).hexdigest())[:size]


def benchmark(nested: Nested, genes: int, clinical: tuple[int, ...], alpha: float = 0.1, repeats: int = 20, seed: str = "benchmark-1", grid: tuple[tuple[float, float], ...] = GRID) -> list[dict]:
    """Methods of selection compared on outer folds: ``fold, method, selected, c_index, error, penalizer, l1_ratio``.

    The first ``genes`` features are chosen from on the training rows alone, by their variance and a univariate screen;
    ``clinical`` are others. What is chosen is scored by a ridge Cox model of the training rows on the fold. Methods:
    ``clinical_only``, ``univariate_top10``, ``conditional_cox_mb`` and with ``_plus_clinical``, ``iamb`` and ``gsmb`` on
    correlations with log time, ``elastic_net_cox`` tuned on inner folds, and the mean of random sets of ten.
    """
    outer = range(nested.outer)
    train = [nested.train(f) for f in outer]
    ranked = [[i for _, i in rows if i < genes] for rows in screen(nested.blocks, train)]
    candidates = [r[:SCREENED] for r in ranked]
    conditioned = conditional(nested.blocks, train, candidates)
    tables = nested.blocks.correlations([(u, tuple(c)) for u, c in zip(train, candidates)])
    nets = elastic_nets(nested, [tuple(r[:NETTED]) for r in ranked], grid)
    chosen: dict[tuple[int, str], tuple[list[int], list[int], str, dict]] = {}
    for f in outer:
        own = candidates[f]
        n, r = tables[f]
        tuned, _, net, note = nets[f]
        chosen[f, "clinical_only"] = [], list(clinical), "", {}
        chosen[f, "univariate_top10"] = own[:10], [], "", {}
        chosen[f, "conditional_cox_mb"] = conditioned[f], [], "", {}
        chosen[f, "conditional_cox_mb_plus_clinical"] = conditioned[f], list(clinical), "", {}
        chosen[f, f"iamb_alpha{alpha:.2f}"] = [own[i] for i in selection.iamb(r, n, len(own), alpha)], [], "", {}
        chosen[f, f"gsmb_alpha{alpha:.2f}"] = [own[i] for i in selection.grow_shrink(r, n, len(own), alpha)], [], "", {}
        chosen[f, "elastic_net_cox"] = net, [], note, {"penalizer": tuned["penalizer"], "l1_ratio": tuned["l1_ratio"]}
    sets = {(f, k): random_set(candidates[f], 10, seed, f, k) for f in outer for k in range(1, repeats + 1)}
    names = [*chosen, *sets]
    features = [tuple(dict.fromkeys([*chosen[m][0], *chosen[m][1]])) for m in chosen] + [tuple(s) for s in sets.values()]
    found = dict(zip(names, nested.blocks.fit([Spec(train[m[0]], own, RIDGE) for m, own in zip(names, features)], least=LEAST_TRAIN)))
    c = held_out(nested, {m: (fit, nested.test(m[0])) for m, fit in found.items()})
    rows = []
    for m, (own, _, note, more) in chosen.items():
        few = "too_few_samples" if nested.blocks.total[nested.test(m[0])] < LEAST_TEST else ""
        rows.append({"fold": m[0], "method": m[1], "selected": own, "c_index": c[m], "error": note or found[m].error or few} | more)
    for f in outer:
        own = [c[f, k] for k in range(1, repeats + 1) if c[f, k] is not None]
        rows.append({"fold": f, "method": f"random_top10_mean{repeats}", "selected": [], "c_index": sum(own) / len(own) if own else None, "error": ""})
    return rows
