"""Survival models, tests and resampling over Spark sums: adjusted models, conditional selection, k-group tests, tails, permuted outcomes, bootstraps.

Groups and candidates are keys of one table of counts; the driver solves systems whose size is the number of covariates.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import fits, nested
from tessella.operators.cuts import cut
from tessella.operators.kernels import normal_p
from tessella.operators.ranking import GROUP, RANGES, average_rank, bh_adjust, bucket, range_bounds, running
from tessella.operators.resampling import RANGE_BITS, draw, poisson, poisson_counts, replicates
from tessella.operators.riskblocks import RiskBlocks, Spec
from tessella.operators.statistics import normal_tail

#: The normal quantile of 0.975.
Z95 = 1.959963984540054


def chi2_tail(x: Column, df: Column) -> Column:
    """The upper tail of chi-square with a whole number of degrees of freedom, as a finite sum."""
    half = F.greatest(x, F.lit(0.0)) / 2
    odd = df % 2 == 1
    first = F.when(odd, normal_tail(F.sqrt(F.greatest(x, F.lit(0.0))))).otherwise(F.exp(-half))
    # Terms (x/2)^a exp(-x/2) / Gamma(a + 1) for a = 1/2, 3/2 ... or 1, 2 ..., each from the one before.
    start = F.when(odd, 2 * F.sqrt(half / math.pi) * F.exp(-half)).otherwise(half * F.exp(-half))
    steps = F.sequence(F.lit(1), F.greatest(F.floor((df - 1) / 2), F.lit(1)).cast("int"))
    terms = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("sum"), start.alias("term")),
        lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * half / (i + F.when(odd, F.lit(0.5)).otherwise(F.lit(1.0)))).alias("term")),
    )
    return F.least(F.lit(1.0), F.when(df <= 2, first).otherwise(first + terms["sum"]))


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    """Upper p-value of Fisher's F."""
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def straight_lines(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Slope of a straight line by group with its standard error, t and two-sided p; groups are few and their sums are gathered."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    kind = df.schema[by].dataType.simpleString()
    sums = known.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_sxx(y, x).alias("xx"), F.regr_syy(y, x).alias("yy"), F.regr_sxy(y, x).alias("xy")).collect()
    rows = []
    for r in sums:
        if r["n"] < 3 or not r["xx"]:
            rows.append((r[by], r["n"], None, None, None, None))
            continue
        rest = max(r["yy"] - r["b"] * r["xy"], 0.0)
        se = math.sqrt(rest / (r["n"] - 2) / r["xx"])
        t = r["b"] / se if se else math.inf
        rows.append((r[by], r["n"], r["b"], se, t, t_p(t, r["n"] - 2) if se else 0.0))
    return df.sparkSession.createDataFrame(rows, f"{by} {kind}, n long, slope double, se double, t_value double, p_value double")


def anova_p(found: DataFrame) -> DataFrame:
    """A few rows of ``n, groups, f_value`` with the p-value of F."""
    rows = [(*r, f_p(r["f_value"], r["groups"] - 1, r["n"] - r["groups"]) if r["f_value"] is not None else None) for r in found.collect()]
    return found.sparkSession.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in found.dtypes) + ", p_value double")


def mann_whitney_p(df: DataFrame, label: str, value: str, by: list[str]) -> DataFrame:
    """U of the rows labelled 1 by group, and its two-sided normal p-value with corrections for ties and continuity."""
    rows = df.where(F.col(label).isNotNull() & F.col(value).isNotNull())
    ranked = average_rank(rows, by, value)
    sums = ranked.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"), F.sum(F.when(F.col(label) == 1, F.col("avg_rank")).otherwise(0.0)).alias("__r"))
    ties = rows.groupBy(*by, value).agg(F.count("*").cast("double").alias("__t")).groupBy(*by).agg(F.sum(F.expr("__t * __t * __t - __t")).alias("__ties"))
    one = sums.join(ties, by)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    u, n = F.col("__r") - n1 * (n1 + 1) / 2, n1 + n0
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.col("__ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n0 / 2) - 0.5, F.lit(0.0)) / spread
    return one.select(*by, "n1", "n0", u.alias("u"), normal_tail(z).alias("p_value"))


def logrank_groups(df: DataFrame, time: str, event: Column, group: str) -> DataFrame:
    """The log-rank test of k groups: observed and expected deaths by group, chi-square on k - 1 and its p-value.

    Rows at risk are running sums over times inside ranges, by group; the matrix of k groups is a sum over times.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), (-F.col(time)).cast("double").alias("back"), event.cast("int").alias("e"))
    names = [r["grp"] for r in rows.select("grp").distinct().orderBy("grp").collect()]
    k = len(names)
    cells = cut(rows.groupBy("back").agg(*[F.sum(F.when(F.col("grp") == g, F.col("e")).otherwise(0)).alias(f"d{i}") for i, g in enumerate(names)], *[F.count_if(F.col("grp") == g).alias(f"n{i}") for i, g in enumerate(names)]))
    bounds = range_bounds(cells, "back")
    for i in range(k):
        cells = running(cells, [], "back", f"n{i}", f"r{i}", bounds=bounds).withColumn(f"r{i}", (F.col(f"r{i}") + F.col(f"n{i}")).cast("double"))
    d, r = sum((F.col(f"d{i}") for i in range(k)), F.lit(0)), sum((F.col(f"r{i}") for i in range(k)), F.lit(0.0))
    shared = F.when(r > 1, d * (r - d) / (r - 1)).otherwise(0.0)
    share = [F.col(f"r{i}") / r for i in range(k)]
    terms = [F.sum(F.col(f"d{i}")) for i in range(k)] + [F.sum(d * share[i]) for i in range(k)] + [F.sum(shared * share[i] * ((1.0 if i == j else 0.0) - share[j])) for i in range(k) for j in range(k)]
    one = cells.where(d > 0).agg(*[t.alias(f"v{i}") for i, t in enumerate(terms)]).first()
    values = np.array([float(v or 0) for v in one])
    observed, expected, spread = values[:k], values[k : 2 * k], values[2 * k :].reshape(k, k)
    gap = (observed - expected)[: k - 1]
    chi2 = float(gap @ np.linalg.lstsq(spread[: k - 1, : k - 1], gap, rcond=None)[0]) if k > 1 else 0.0
    found = df.sparkSession.createDataFrame([(g, int(o), float(x), chi2, k - 1) for g, o, x in zip(names, observed, expected, strict=True)], "grp string, observed long, expected double, chi2 double, df int")
    return found.withColumn("p_value", chi2_tail(F.col("chi2"), F.col("df")))


def intervals(rows: DataFrame, ratio: str) -> DataFrame:
    """``coef`` and ``se`` with the bounds of a 95 % interval of their exponential: ``{ratio}_low`` and ``{ratio}_high``."""
    return rows.withColumns({f"{ratio}_low": F.exp(F.col("coef") - Z95 * F.col("se")), f"{ratio}_high": F.exp(F.col("coef") + Z95 * F.col("se"))})


def standardised(df: DataFrame, by: str, columns: list[str], least: int = 30) -> tuple[list, dict, DataFrame]:
    """Complete rows with z-scored columns by group ``g``; groups with few rows or without spread are left out."""
    keys, sizes, numbered = fits.grouped(df, by, columns)
    fit = {g: s for g, s in sizes.items() if s[0] >= least and (s[2] > 0).all()}
    if not fit:
        return keys, {}, numbered.where("false")
    scored = fits.with_values(numbered, {g: [*s[1], *s[2]] for g, s in fit.items()}, [f"__{k}{i}" for k in "ms" for i in range(len(columns))])
    z = {c: (F.col(c) - F.col(f"__m{i}")) / F.col(f"__s{i}") for i, c in enumerate(columns)}
    return keys, fit, scored.select("g", *[c for c in df.columns if c not in (by, *columns)], *[v.alias(c) for c, v in z.items()])


def adjusted_models(df: DataFrame, by: str, time: str, event: str, main: str, specs: dict[str, list[str]], penalty: float = 0.05) -> DataFrame:
    """Ridge Cox models by group of one variable with each named list of covariates: a row a group and specification.

    ``coef, hazard_ratio, se, p_value``, the ratio's 95 % interval and Harrell's C of the model's own risk.
    """
    columns = list(dict.fromkeys([main, *[c for s in specs.values() for c in s]]))
    keys, fit, z = standardised(df.select(by, time, event, *columns).dropna(), by, columns)
    cells = cut(z.groupBy("g", time, event, *columns).agg(F.count("*").alias("n")))
    lists = [[main, *more] for more in specs.values()]
    found = fits.cox_models(cells, {g: s[0] for g, s in fit.items()}, time, event, lists, penalty)
    # A group's concordance with each model is a group of one count of pairs.
    risks = []
    for m, xs in enumerate(lists):
        if found[m]:
            valued = fits.with_values(cells, {g: b for g, (b, _) in found[m].items()}, [f"__b{i}" for i in range(len(xs))])
            risks.append(valued.select((F.col("g") * len(lists) + m).alias("g"), time, event, "n", sum((F.col(f"__b{i}") * F.col(x) for i, x in enumerate(xs)), F.lit(0.0)).alias("risk")))
    c = {r["g"]: r["c_index"] for r in fits.concordance(reduce(DataFrame.unionByName, risks), time, event, "risk").collect()} if risks else {}
    rows = []
    for m, name in enumerate(specs):
        for g, (beta, se) in found[m].items():
            rows.append((keys[g], name, fit[g][0], float(beta[0]), float(np.exp(beta[0])), float(se[0]), normal_p(float(beta[0] / se[0])), c.get(g * len(lists) + m)))
    kind = df.schema[by].dataType.simpleString()
    made = df.sparkSession.createDataFrame(rows, f"{by} {kind}, model string, n long, coef double, hazard_ratio double, se double, p_value double, c_index double")
    return intervals(made, "hazard_ratio")


def conditional_cox(df: DataFrame, time: str, event: str, candidates: list[str], enter: float = 0.01, leave: float = 0.05, most: int = 25, penalty: float = 0.0) -> list[tuple[str, float, float]]:
    """Forward-backward selection by conditional Cox models: ``(column, coefficient, p)`` of those chosen.

    A round fits every candidate beside the chosen ones at once; the candidate with the least p below ``enter`` joins, then
    chosen ones with a p above ``leave`` go, the weakest first. Ends when none joins, after ``most`` rounds, or when a
    choice would come back. Candidates without spread never join, and neither do models that don't settle.
    """
    complete = df.select(time, event, *candidates).dropna()
    blocks = RiskBlocks(complete.select(F.col(time).alias("t"), F.col(event).alias("e"), F.array(*candidates).alias("x"), F.array(F.lit(1.0)).alias("w")), "t", "e", "x", "w")
    if not blocks.n:
        return []
    chosen = nested.conditional(blocks, [0], [[*range(len(candidates))]], enter, leave, most, penalty)[0]
    if not chosen:
        return []
    last = blocks.fit([Spec(0, tuple(chosen), penalty)])[0]
    return [(candidates[i], float(last.beta[k]), nested.wald(last, k)) for k, i in enumerate(chosen)]


def proportional_hazards(df: DataFrame, by: str, time: str, event: str, x: str, penalty: float = 0.0) -> DataFrame:
    """The test of proportional hazards by group: Schoenfeld residuals of a univariate Cox model against ranked times.

    ``n, coef, chi2`` on one degree of freedom and ``p_value``. Residuals are deaths' covariates less the mean of the rows at
    risk, from running sums over times; a tied time takes the average rank of its deaths.
    """
    keys, fit, z = standardised(df.select(by, time, event, x).dropna(), by, [x])
    cells = cut(z.groupBy("g", F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(x).alias("z")).agg(F.count("*").alias("n")))
    found = fits.cox(cells, {g: s[0] for g, s in fit.items()}, "t", "e", ["z"], penalty)
    kind = f"{by} {df.schema[by].dataType.simpleString()}, n long, coef double, chi2 double"
    if not found:
        return df.sparkSession.createDataFrame([], kind + ", p_value double")
    rows = fits.with_values(cells, {g: [b[0]] for g, (b, _) in found.items()}, ["b"]).withColumn("w", F.col("n") * F.exp(F.col("b") * F.col("z")))
    per = rows.groupBy("g", (-F.col("t")).alias("back")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("z")).alias("wz"), F.sum(F.col("n") * F.col("e")).alias("d"), F.sum(F.col("n") * F.col("e") * F.col("z")).alias("dz"))
    per = cut(per)
    bounds = range_bounds(per, "back", by=["g"])
    for c in ("w", "wz", "d"):
        per = running(per, ["g"], "back", c, f"{c}_before", bounds=bounds)
    at = per.where("d > 0").withColumn("r", F.col("dz") - F.col("d") * (F.col("wz") + F.col("wz_before")) / (F.col("w") + F.col("w_before")))
    # Later deaths come first, so the rank from the earliest one is what they leave.
    total = at.groupBy("g").agg(F.sum("d").alias("deaths"))
    rank = F.col("deaths") - F.col("d_before") - F.col("d") + (F.col("d") + 1) / 2
    centred = rank - (F.col("deaths") + 1) / 2
    sums = at.join(total, "g").groupBy("g").agg(F.sum(centred * F.col("r")).alias("tr"), F.sum(F.col("d") * centred * centred).alias("tt"), F.max("deaths").alias("deaths")).collect()
    made = []
    for s in sums:
        beta, se = found[s["g"]]
        chi2 = float(s["tr"] ** 2 * s["deaths"] * se[0] ** 2 / s["tt"]) if s["tt"] else None
        made.append((keys[s["g"]], fit[s["g"]][0], float(beta[0]), chi2))
    return df.sparkSession.createDataFrame(made, kind).withColumn("p_value", chi2_tail(F.col("chi2"), F.lit(1)))


def permute_outcomes(df: DataFrame, key: str, outcomes: list[str], reps: int, seed: str) -> DataFrame:
    """For each replicate, the rows with another row's outcomes, all of one row together; features stay.

    Rows are numbered by key and by each replicate's draws, both inside ranges, and meet by number.
    """
    own = cut(df.where(F.col(key).isNotNull()))
    order = F.col(key).cast("double")
    bounds = range_bounds(own.select(order.alias("__order")), "__order", max(RANGES, min(fits.MOST, own.count() // GROUP)))
    plain = _placed(own, [], order, key, bucket(order, bounds) if bounds else F.lit(0))
    drawn = placed_draws(replicates(own.select(key, *outcomes), reps), seed, key)
    moved = drawn.select("rep", F.col("place").alias("__at"), *[F.col(c).alias(f"__{c}") for c in outcomes])
    # The rows of all replicates needn't be put in order: a partition of the rows themselves is looked up by number.
    joined = moved.join(plain.hint("shuffle_hash"), F.col("place") == F.col("__at"))
    return joined.select("rep", *[F.col(f"__{c}").alias(c) if c in outcomes else F.col(c) for c in df.columns])


def placed_draws(rows: DataFrame, seed: str, key: str) -> DataFrame:
    """Rows with a replicate ``rep`` and their ``place`` in it, from 1 by draw and key."""
    u = draw(seed, F.col("rep"), F.col(key))
    return _placed(rows, ["rep"], u, key, F.shiftright(F.col("__order"), RANGE_BITS))


def _placed(rows: DataFrame, by: list[str], order: Column, key: str, cell: Column) -> DataFrame:
    """Rows with ``place``, from 1 by ``order`` and key within ``by``; ``cell`` is a range of the order, which may use it as ``__order``.

    Places are counted inside ranges and after the ranges before; ranges are written, so that their size is known and they go to the rows.
    """
    marked = rows.withColumn("__order", order).withColumn("__cell", cell)
    of = [f"__of_{c}" for c in by]
    counts = marked.groupBy(*[F.col(c).alias(o) for c, o in zip(by, of, strict=True)], F.col("__cell").alias("__of")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*of).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = cut(counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    same = F.col("__cell") == F.col("__of")
    for c, o in zip(by, of, strict=True):
        same = same & (F.col(c) == F.col(o))
    inside = marked.withColumn("__inside", F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__order", key)))
    return inside.join(starts, same).withColumn("place", F.col("__start") + F.col("__inside")).select(*rows.columns, "place")


def bootstrap_auc(df: DataFrame, key: str, label: str, value: str, reps: int, seed: str) -> DataFrame:
    """Percentile interval of an AUC over Poisson bootstraps within each label, and the share of replicates above one half.

    A replicate's AUC comes from weights summed by distinct value and label and running sums over values.
    """
    weight = poisson(seed, F.col("rep"), F.col(key))
    rows = replicates(df.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(key, label, F.col(value).cast("double").alias("v")), reps).withColumn("w", weight)
    cells = cut(rows.groupBy("rep", "v").agg(F.sum(F.when(F.col(label) == 1, F.col("w")).otherwise(0)).alias("a"), F.sum(F.when(F.col(label) == 0, F.col("w")).otherwise(0)).alias("b")))
    below = running(cells, ["rep"], "v", "b", "under", bounds=range_bounds(cells, "v", by=["rep"]))
    sums = below.groupBy("rep").agg(F.sum(F.col("a") * (F.col("under") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n1"), F.sum("b").alias("n0"))
    auc = sums.select("rep", F.round(F.try_divide(F.col("u"), F.col("n1") * F.col("n0")), 9).alias("auc"))
    q = lambda at: F.percentile("auc", F.lit(at))  # noqa: E731  # a value a replicate
    return auc.agg(F.count("auc").alias("reps"), q(0.025).alias("low"), q(0.5).alias("mid"), q(0.975).alias("high"), F.avg((F.col("auc") > 0.5).cast("double")).alias("share_above"))


def _interval(values: list[float]) -> tuple[float | None, float | None]:
    """The 2.5 and 97.5 percentiles by linear interpolation."""
    return (float(np.quantile(values, 0.025)), float(np.quantile(values, 0.975))) if values else (None, None)


def bootstrap_cox(df: DataFrame, key: str, time: str, event: str, score: str, covariates: list[str], reps: int, seed: str, penalty: float = 0.05, least_deaths: int = 5, most: float = 20.0) -> dict:
    """A score's hazard and its concordance, with percentile intervals over bootstraps and the share of coefficients above 0.

    Each replicate takes every row, dead and censored ones alike, a Poisson number of times by md5 of seed, replicate and
    key; all replicates are columns of weights of one table. Scores and covariates are z-scored over all rows. The concordance has
    a fixed direction: that larger scores die earlier. Replicates with few deaths, that don't settle, or whose coefficient
    exceeds ``most``, aren't counted. Incomplete rows are left out; without enough rows everything is null.
    """
    xs = [score, *covariates]
    rows = df.select(F.col(key).alias("id"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)]).dropna()
    one = rows.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(xs)) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = F.array(*[F.coalesce(F.try_divide(F.col(f"x{i}") - F.lit(one[f"m{i}"]), F.lit(one[f"s{i}"])), F.lit(0.0)) for i in range(len(xs))])
    blocks = RiskBlocks(poisson_counts(rows.select("id", "t", "e", z.alias("x")), "id", reps, seed), "t", "e", "x", "w", plain=tuple(range(len(xs))))
    out = dict.fromkeys(("coef", "hazard_ratio", "low", "high", "probability_positive", "c_index", "c_low", "c_high"))
    fits_ = blocks.fit([Spec(u, tuple(range(len(xs))), penalty) for u in range(reps + 1)], least=30) if blocks.n else []
    good = [f for f in fits_ if not f.error and f.settled and f.events >= least_deaths]
    if not good or good[0].spec.use:
        return out | {"n": int(blocks.n), "valid": 0, "c_valid": 0}
    coefs = [float(f.beta[0]) for f in good[1:] if abs(f.beta[0]) <= most]
    # The score itself is the risk.
    c = {u: v for u, v in blocks.concordances(0, list(range(reps + 1))).items() if v is not None}
    own = [v for u, v in c.items() if u]
    low, high = (None if v is None else math.exp(v) for v in _interval(coefs))
    c_low, c_high = _interval(own)
    coef = float(good[0].beta[0])
    return out | {
        "n": int(blocks.n), "coef": coef, "hazard_ratio": math.exp(coef), "low": low, "high": high, "probability_positive": sum(b > 0 for b in coefs) / len(coefs) if coefs else None,
        "valid": len(coefs), "c_index": c.get(0), "c_low": c_low, "c_high": c_high, "c_valid": len(own),
    }


def bootstrap_logistic(df: DataFrame, key: str, label: str, score: str, covariates: list[str], reps: int, seed: str, ridge: float = 1e-6, most: float = 20.0) -> dict:
    """A score's odds ratio with percentile intervals over bootstraps and the share of coefficients above 0.

    Replicates are drawn as in ``bootstrap_cox`` and are groups of one fit of counts. Replicates of one label alone, or whose
    coefficient exceeds ``most``, aren't counted.
    """
    xs = [score, *covariates]
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(xs)]).dropna()
    one = rows.agg(F.count("*").alias("n"), *[f(f"x{i}").alias(f"{n}{i}") for i in range(len(xs)) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    z = [F.coalesce(F.try_divide(F.col(f"x{i}") - F.lit(one[f"m{i}"]), F.lit(one[f"s{i}"])), F.lit(0.0)).alias(f"z{i}") for i in range(len(xs))]
    every = rows.select("id", "y", *z).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    drawn = every.withColumn("n", F.when(F.col("g") == 0, F.lit(1).cast("long")).otherwise(poisson(seed, F.col("g"), F.col("id"))))
    names = [f"z{i}" for i in range(len(xs))]
    cells = cut(drawn.where("n > 0").groupBy("g", "y", *names).agg(F.sum("n").alias("n")))
    both = [r[0] for r in cells.groupBy("g").agg(F.countDistinct("y").alias("k")).where("k > 1").select("g").orderBy("g").collect()]  # a row a replicate
    found = fits.logistic(cells, both, "y", names, ridge)
    coefs = [float(b[1]) for g, (b, _) in sorted(found.items()) if g and np.isfinite(b).all() and abs(b[1]) <= most]
    low, high = (None if v is None else math.exp(v) for v in _interval(coefs))
    coef = float(found[0][0][1]) if 0 in found else None
    return {"n": one["n"], "coef": coef, "odds_ratio": None if coef is None else math.exp(coef), "low": low, "high": high, "probability_positive": sum(b > 0 for b in coefs) / len(coefs) if coefs else None, "valid": len(coefs)}


def permutation_concordance(df: DataFrame, key: str, time: str, event: str, score: str, reps: int, seed: str) -> DataFrame:
    """Harrell's C of a score, larger ones dying earlier, and its p-values over permutations of time and event together.

    One row: ``n, c_index, reps, null_mean, p_one_sided, p_two_sided``; p is (1 + those at least as far) / (1 + all). Every
    permutation is a group of one count of pairs.
    """
    rows = df.select(F.col(key).alias("id"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(score).cast("double").alias("r")).dropna()
    null = permute_outcomes(rows, "id", ["t", "e"], reps, seed).select(F.col("rep").cast("int").alias("g"), "t", "e", "r")
    every = rows.select(F.lit(0).alias("g"), "t", "e", "r").unionByName(null)
    found = fits.concordance(every.groupBy("g", "t", "e", "r").agg(F.count("*").alias("n")), "t", "e", "r")
    one = found.agg(F.max(F.when(F.col("g") == 0, F.col("c_index"))).alias("c_index"), F.collect_list(F.when(F.col("g") > 0, F.col("c_index"))).alias("null"))  # a value a permutation
    return one.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n")))).select("n", "c_index", *_null_columns("c_index", lambda x: x - 0.5))


def permutation_kruskal(df: DataFrame, key: str, group: str, value: str, reps: int, seed: str) -> DataFrame:
    """Kruskal and Wallis' H and its p-value over permutations of the groups: ``n, h, reps, null_mean, p_one_sided``.

    Ranks don't change, so they are worked out once; a permutation is a sum of ranks by group.
    """
    ranked = average_rank(df.select(F.col(key).alias("id"), F.col(group).alias("grp"), F.col(value).alias("v")).dropna(), [], "v", "rank")
    ranked = cut(ranked.select("id", "grp", "rank"))
    null = permute_outcomes(ranked, "id", ["grp"], reps, seed).select("rep", "grp", "rank")
    sums = ranked.select(F.lit(0).alias("rep"), "grp", "rank").unionByName(null).groupBy("rep", "grp").agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    tie = ranked.groupBy("rank").agg(F.count("*").alias("c")).agg(F.sum(F.expr("cast(c AS double) * c * c - c")).alias("ties"), F.sum("c").alias("n"))
    n = F.col("n").cast("double")
    h = sums.groupBy("rep").agg(F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s")).crossJoin(F.broadcast(tie))  # one row
    h = h.select("rep", "n", F.round(F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n)), 9).alias("h"))
    one = h.agg(F.max("n").alias("n"), F.max(F.when(F.col("rep") == 0, F.col("h"))).alias("h"), F.collect_list(F.when(F.col("rep") > 0, F.col("h"))).alias("null"))  # a value a permutation
    return one.select("n", "h", *_null_columns("h")[:3])


def _null_columns(observed: str, centred=None) -> list[Column]:
    """What the values of permutations in the array ``null`` say of the observed one."""
    count = F.size("null")
    mean = F.try_divide(F.aggregate("null", F.lit(0.0), lambda a, x: a + x), count)
    share = lambda test: F.when(F.col(observed).isNotNull(), (1 + F.size(F.filter("null", test))) / (1 + count))
    out = [count.cast("long").alias("reps"), mean.alias("null_mean"), share(lambda x: x >= F.col(observed)).alias("p_one_sided")]
    return out + ([share(lambda x: F.abs(centred(x)) >= F.abs(centred(F.col(observed)))).alias("p_two_sided")] if centred else [])


def cox_screen(df: DataFrame, time: str, event: str, vector: str, least: int = 30) -> DataFrame:
    """Univariate Cox models of every component of a vector, z-scored: ``feature, n, coef, hazard_ratio, se, p_value, error``.

    All are models of the same passes over blocks of rows. A missing or infinite component leaves its row out of that model
    alone; rows without a time, an event or a vector are left out of all. A component with fewer than ``least`` rows, without
    spread, or whose model doesn't settle has an error and nulls; an empty table has no row.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(time).alias("t"), F.col(event).alias("e"), F.col(vector).cast("array<double>").alias("x"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    size, lost = rows.agg(F.max(F.size("x")), F.count_if(F.exists("x", odd))).first()
    return _screen(rows, size or 0, bool(lost), least)


def _screen(rows: DataFrame, size: int, lost: bool, least: int = 30) -> DataFrame:
    """``cox_screen`` of ``t, e, x`` with vectors of ``size`` components, of which some are missing or infinite where ``lost``."""
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    weights = F.transform("x", lambda v: F.when(odd(v), 0.0).otherwise(1.0)) if lost else F.array(F.lit(1.0))
    blocks = RiskBlocks(rows.select("t", "e", F.transform("x", lambda v: F.when(odd(v), 0.0).otherwise(v)).alias("x"), weights.alias("w")), "t", "e", "x", "w")
    found = blocks.fit([Spec(i if lost else 0, (i,)) for i in range(size)], least=least) if blocks.n else []
    made = []
    for i, f in enumerate(found):
        error = f.error or ("" if f.settled else "unsettled")
        good = not error and np.isfinite(f.se[0]) and f.se[0] > 0
        made.append((i, int(f.n), *((float(f.beta[0]), math.exp(f.beta[0]), float(f.se[0]), nested.wald(f, 0), None) if good else (None, None, None, None, error or "singular"))))
    return rows.sparkSession.createDataFrame(made, "feature int, n long, coef double, hazard_ratio double, se double, p_value double, error string")


def permutation_screen(df: DataFrame, key: str, time: str, event: str, vector: str, reps: int, seed: str) -> DataFrame:
    """How many univariate Cox models are significant, observed (``rep`` 0) and with time and event permuted together over the rows.

    A row a replicate: ``rep, tested, least_p, n_p05, n_q10`` (by Benjamini and Hochberg within the replicate). The vectors that
    permutations put beside an outcome become components of its row, so all models are of the same passes. Rows with a null
    key are left out.
    """
    rows = cut(df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(vector).cast("array<double>").alias("x")).dropna())
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    size, lost = rows.agg(F.max(F.size("x")), F.count_if(F.exists("x", odd))).first()
    size = size or 0
    moved = permute_outcomes(rows.withColumn("own", F.col("id")), "id", ["t", "e", "own"], reps, seed).select("own", "rep", "x")
    sides = moved.groupBy("own").agg(F.sort_array(F.collect_list(F.struct("rep", "x"))).alias("all"))  # a vector a replicate
    wide = rows.join(sides, F.col("id") == F.col("own")).select("t", "e", F.concat("x", F.flatten(F.transform("all", lambda a: a["x"]))).alias("x"))
    # Permuted vectors are those of the rows, so what is known of these needs no pass over the wide ones.
    found = _screen(wide, size * (1 + reps), bool(lost)).select((F.col("feature") / F.lit(max(size, 1))).cast("int").alias("rep"), "p_value").where("p_value IS NOT NULL")
    adjusted = bh_adjust(found, "p_value", ["rep"])
    return adjusted.groupBy("rep").agg(F.count("*").alias("tested"), F.min("p_value").alias("least_p"), F.count_if(F.col("p_value") < 0.05).alias("n_p05"), F.count_if(F.col("q_value") < 0.1).alias("n_q10"))
