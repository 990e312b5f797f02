"""Statistics over long tables, as SQL expressions: transforms, scores, tests, survival and discrimination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import fits
from tessella.operators.cuts import cut
from tessella.operators.ranking import average_rank, bounded, exact_quantiles, range_bounds, running, value_ranks, window_rank


def finite(x: str | Column) -> Column:
    """A double, or null where it is missing, not a number or infinite."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value by the Abramowitz-Stegun formula 7.1.26, to 1.5e-7."""
    # Fixed values of the formula.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1.0 / (1.0 + F.lit(p) * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + F.lit(c)) * t
    return poly * F.exp(-x * x)


# The coefficients of Acklam's rational approximation to the inverse normal distribution, to 1.15e-9.
INVERSE_NORMAL = {
    "a1": -3.969683028665376e01, "a2": 2.209460984245205e02, "a3": -2.759285104469687e02, "a4": 1.383577518672690e02, "a5": -3.066479806614716e01, "a6": 2.506628277459239e00,
    "b1": -5.447609879822406e01, "b2": 1.615858368580409e02, "b3": -1.556989798598866e02, "b4": 6.680131188771972e01, "b5": -1.328068155288572e01,
    "c1": -7.784894002430293e-03, "c2": -3.223964580411365e-01, "c3": -2.400758277161838e00, "c4": -2.549732539343734e00, "c5": 4.374664141464968e00, "c6": 2.938163982698783e00,
    "d1": 7.784695709041462e-03, "d2": 3.224671290700398e-01, "d3": 2.445134137142996e00, "d4": 3.754408661907416e00,
}


def inverse_normal(p: Column) -> Column:
    """The normal quantile of a share between 0 and 1, by a rational approximation in the middle and one in the tails."""

    def horner(letter: str, n: int, x: Column, last: float | None = None) -> Column:
        out = F.lit(INVERSE_NORMAL[f"{letter}1"])
        for i in range(2, n + 1):
            out = out * x + F.lit(INVERSE_NORMAL[f"{letter}{i}"])
        return out if last is None else out * x + F.lit(last)

    q, r = F.sqrt(-2 * F.ln(F.least(p, 1 - p))), (p - 0.5) * (p - 0.5)
    tail = horner("c", 6, q) / horner("d", 4, q, 1.0)
    middle = horner("a", 6, r) * (p - 0.5) / horner("b", 5, r, 1.0)
    return F.when(p < 0.02425, tail).when(p > 1 - 0.02425, -tail).otherwise(middle)


def unpivot_vector(df: DataFrame, key: list[str], vector: str) -> DataFrame:
    """A row for each component: ``feature`` from 0 and ``value``."""
    return df.select(*key, F.posexplode(vector).alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def zscore(df: DataFrame, by: list[str], value: str, out: str = "z", ddof: int = 1) -> DataFrame:
    """z-scores within groups: missing and infinite values get the median first; groups without spread are dropped.

    Medians are worked out only where a value is missing, and of its groups alone.
    """
    sd = F.stddev_samp if ddof else F.stddev_pop
    clean = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    rows = df.withColumn(value, clean)
    lost = rows.where(F.col(value).isNull()).select(*by).distinct()
    if by and not lost.isEmpty():
        lost = cut(lost)
        same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by]
        own = lost.select(*[F.col(c).alias(f"__of_{c}") for c in by])
        median = exact_quantiles(rows.join(own, same, "left_semi"), by, value, {"__median": 0.5}).select(*[F.col(c).alias(f"__of_{c}") for c in by], "__median")
        rows = rows.join(median, same, "left").withColumn(value, F.coalesce(value, "__median")).drop("__median", *[f"__of_{c}" for c in by])
    elif not by and not lost.isEmpty():
        rows = rows.crossJoin(F.broadcast(exact_quantiles(rows, [], value, {"__median": 0.5}))).withColumn(value, F.coalesce(value, "__median")).drop("__median")  # one row
    stats = rows.groupBy(*by).agg(F.avg(value).alias("__mean"), sd(value).alias("__sd")).where("__sd > 0")
    joined = rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn(out, (F.col(value) - F.col("__mean")) / F.col("__sd")).drop("__mean", "__sd")


def zscore_from_train(df: DataFrame, train: Column, by: list[str], value: str, out: str = "z") -> DataFrame:
    """z-scores of all rows by the mean and deviation of the training rows."""
    stats = df.where(train).groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd")).where("__sd > 0")
    return df.join(stats, by).withColumn(out, (F.col(value) - F.col("__mean")) / F.col("__sd")).drop("__mean", "__sd")


def log_cpm(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Counts per million of each sample's total, and log2 of that plus one."""
    totals = df.groupBy(sample).agg(F.sum(value).alias("library_size"))
    joined = df.join(totals, sample)
    cpm = F.col(value) * 1e6 / F.col("library_size")
    return joined.withColumn("cpm", cpm).withColumn("log_cpm", F.log2(F.col("cpm") + 1))


def module_scores(z: DataFrame, weights: DataFrame, sample: str, feature: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """Signed-mean and weighted scores by sample and module, of modules with enough features."""
    sizes = weights.groupBy("module").agg(F.count("*").alias("__size"))
    sign = F.when(F.col("weight") < 0, -1.0).otherwise(1.0)
    joined = z.join(weights, feature)
    sums = joined.groupBy(sample, "module").agg(
        F.count("z").alias("n_features"), F.avg(sign * F.col("z")).alias("signed_mean"),
        (F.sum(F.col("z") * F.col("weight")) / F.sum(F.abs("weight"))).alias("weighted"),
    )
    enough = (F.col("n_features") >= least) & (F.col("n_features") >= share * F.col("__size"))
    return sums.join(sizes, "module").where(enough).drop("__size")


def residuals(df: DataFrame, y: str, x: str | list[str], by: list[str], train: Column | None = None, out: str = "residual", scaled: bool = False, least: int = 2) -> DataFrame:
    """Residuals of ``y`` on one or more covariates, fitted by least squares within groups, on the training rows where given.

    One aggregate gives the covariances of all groups; each group's normal equations are solved in columns, without the
    driver. Covariates that others determine add nothing. ``scaled`` divides by the deviation of the training rows' residuals,
    as a z-score. Residuals are null for rows with a null or infinite value, in groups with fewer than ``least`` complete
    training rows, and, where scaled, in groups without spread.
    """
    xs, used = [x] if isinstance(x, str) else list(x), df.columns
    number = [F.col(c).cast("double") for c in [y, *xs]]
    complete = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in number])
    fitted = complete & train if train is not None else complete
    v = [F.when(fitted, c) for c in number]
    k = len(xs)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    fits = df.groupBy(*by).agg(F.count_if(fitted).alias("__n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(v)], *[F.covar_samp(v[i], v[j]).alias(f"__c{i}_{j}") for i, j in pairs])
    # The symmetric factorisation L D L', the covariates' one after another, then the coefficients from the last to the first.
    for i in range(1, k + 1):
        gone = [F.col(f"__l{i}_{h}") * F.col(f"__l{i}_{h}") * F.col(f"__d{h}") for h in range(1, i)]
        fits = fits.withColumn(f"__d{i}", sum((-g for g in gone), F.col(f"__c{i}_{i}")))
        fits = fits.withColumn(f"__d{i}", F.when(F.col(f"__d{i}") > 1e-10 * F.col(f"__c{i}_{i}"), F.col(f"__d{i}")))
        for j in range(i + 1, k + 1):
            rest = sum((-F.col(f"__l{j}_{h}") * F.col(f"__l{i}_{h}") * F.col(f"__d{h}") for h in range(1, i)), F.col(f"__c{i}_{j}"))
            fits = fits.withColumn(f"__l{j}_{i}", F.coalesce(rest / F.col(f"__d{i}"), F.lit(0.0)))
        fits = fits.withColumn(f"__z{i}", sum((-F.col(f"__l{i}_{h}") * F.col(f"__z{h}") * F.col(f"__d{h}") for h in range(1, i)), F.col(f"__c0_{i}")))
        fits = fits.withColumn(f"__z{i}", F.coalesce(F.col(f"__z{i}") / F.col(f"__d{i}"), F.lit(0.0))).withColumn(f"__d{i}", F.coalesce(f"__d{i}", F.lit(0.0)))
    for i in range(k, 0, -1):
        fits = fits.withColumn(f"__b{i}", sum((-F.col(f"__l{j}_{i}") * F.col(f"__b{j}") for j in range(i + 1, k + 1)), F.col(f"__z{i}")))
    left = sum((-F.col(f"__z{i}") * F.col(f"__z{i}") * F.col(f"__d{i}") for i in range(1, k + 1)), F.col("__c0_0"))
    spread = F.when(left > 1e-12 * F.col("__c0_0"), F.sqrt(left)) if scaled else F.lit(1.0)
    fits = fits.select(*[F.col(c).alias(f"__of_{c}") for c in by], *[f"__m{i}" for i in range(k + 1)], *[f"__b{i}" for i in range(1, k + 1)], F.when(F.col("__n") >= least, spread).alias("__spread"))
    # Written, so that their size is known: a few groups go to the rows, which would meet in as many tasks otherwise.
    fits = cut(fits)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.lit(True))
    line = sum((F.col(f"__b{i + 1}") * (number[i + 1] - F.col(f"__m{i + 1}")) for i in range(k)), F.lit(0.0))
    joined = df.join(fits, same) if by else df.crossJoin(F.broadcast(fits))  # one row
    return joined.withColumn(out, F.when(complete, (number[0] - F.col("__m0") - line) / F.col("__spread"))).select(*[c for c in used if c != out], out)


def robust_spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median absolute deviation, else IQR/1.349, else the population deviation: the first that is positive."""
    first = exact_quantiles(df, by, value, {"median": 0.5, "__q1": 0.25, "__q3": 0.75}).join(df.groupBy(*by).agg(F.stddev_pop(value).alias("__sd")), by)
    away = df.join(first.select(*by, "median"), by).withColumn("__away", F.abs(F.col(value) - F.col("median")))
    mad = exact_quantiles(away, by, "__away", {"__mad": 0.5}).withColumn("__mad", 1.4826 * F.col("__mad"))
    iqr = (F.col("__q3") - F.col("__q1")) / 1.349
    spread = F.when(F.col("__mad") > 0, F.col("__mad")).when(iqr > 0, iqr).otherwise(F.col("__sd"))
    return first.join(mad, by).select(*by, "median", spread.alias("spread"))


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Rank correlation within groups: ``n``, ``rho`` (null without spread or with few rows) and a normal p-value."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if bounded(rows, by):
        ranked = rows.withColumns({"__rx": window_rank(by, x), "__ry": window_rank(by, y)})
    else:
        ranked = average_rank(average_rank(rows, by, x, "__rx"), by, y, "__ry")
    spread = (F.stddev_pop("__rx") > 0) & (F.stddev_pop("__ry") > 0) & (F.count("*") >= least)
    rho = (F.avg(F.col("__rx") * F.col("__ry")) - F.avg("__rx") * F.avg("__ry")) / (F.stddev_pop("__rx") * F.stddev_pop("__ry"))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(spread, rho).alias("rho"))
    return out.withColumn("p_value", normal_tail(F.col("rho") * F.sqrt(F.col("n") - 1)))


def kruskal(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction, and its effect size epsilon squared."""
    by = by or []
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    ranks = value_ranks(rows, by, value)
    ties = ranks.groupBy(*by).agg(F.sum(F.expr("cast(n AS double) * n * n - n")).alias("__ties"))
    sums = average_rank(rows, by, value).groupBy(*by, group).agg(F.count("*").alias("__n"), F.sum("avg_rank").alias("__r"))
    one = sums.groupBy(*by).agg(F.sum("__n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("__r") * F.col("__r") / F.col("__n")).alias("__s"))
    one = one.join(ties, by) if by else one.crossJoin(ties)  # one row each
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("__s") - 3 * (n + 1)) / (1 - F.col("__ties") / (n * n * n - n))
    one = one.withColumn("h", h)
    return one.select(*by, "n", "groups", "h", F.greatest(F.lit(0.0), (F.col("h") - F.col("groups") + 1) / (F.col("n") - F.col("groups"))).alias("epsilon2"))


def anova(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """One-way analysis of variance: F and eta squared, from sums by group."""
    by = by or []
    sums = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("__n"), F.avg(value).alias("__m"), F.var_pop(value).alias("__v"))
    whole = sums.groupBy(*by).agg(
        F.sum("__n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("__n") * F.col("__v")).alias("within"),
        F.sum(F.col("__n") * F.col("__m") * F.col("__m")).alias("__q"), F.sum(F.col("__n") * F.col("__m")).alias("__s"),
    )
    between = F.col("__q") - F.col("__s") * F.col("__s") / F.col("n")
    whole = whole.withColumn("between", between)
    f = (F.col("between") / (F.col("groups") - 1)) / (F.col("within") / (F.col("n") - F.col("groups")))
    return whole.select(*by, "n", "groups", f.alias("f_value"), (F.col("between") / (F.col("between") + F.col("within"))).alias("eta2"))


def mann_whitney(df: DataFrame, label: Column, value: str, by: list[str] | None = None) -> DataFrame:
    """U of the rows labelled 1 against those labelled 0, the area under the ROC curve, and Cliff's delta."""
    by = by or []
    rows = df.withColumn("__label", label).where(F.col("__label").isNotNull() & F.col(value).isNotNull())
    ranked = average_rank(rows, by, value)
    n1, n0 = F.count_if(F.col("__label") == 1), F.count_if(F.col("__label") == 0)
    sums = ranked.groupBy(*by).agg(n1.alias("n1"), n0.alias("n0"), F.sum(F.when(F.col("__label") == 1, F.col("avg_rank")).otherwise(0.0)).alias("__r"))
    u = F.col("__r") - F.col("n1") * (F.col("n1") + 1) / 2
    auc = F.try_divide(u, F.col("n1") * F.col("n0"))
    return sums.select(*by, "n1", "n0", u.alias("u"), auc.alias("auc"), (2 * auc - 1).alias("cliffs_delta"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision over descending distinct scores, from counts by score."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy((-F.col(score)).alias("__order")).agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count("*").alias("n"))
    counts = cut(counts)
    bounds = range_bounds(counts, "__order")
    placed = running(running(counts, [], "__order", "hits", "__hits", bounds=bounds), [], "__order", "n", "__n", bounds=bounds)
    precision = (F.col("__hits") + F.col("hits")) / (F.col("__n") + F.col("n"))
    return placed.agg(F.sum("n").alias("n"), F.sum("hits").alias("positives"), F.try_divide(F.sum(precision * F.col("hits")), F.sum("hits")).alias("average_precision"))


def life_table(df: DataFrame, time: str, event: Column, by: list[str]) -> DataFrame:
    """Deaths and rows at risk at each distinct time."""
    cells = df.withColumn("__event", event).where(F.col(time).isNotNull()).groupBy(*by, time).agg(F.sum("__event").cast("long").alias("deaths"), F.count("*").alias("leaving"))
    left = Window.partitionBy(*by).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cells.withColumn("at_risk", F.sum("leaving").over(left))


def kaplan_meier(df: DataFrame, time: str, event: Column, by: list[str]) -> DataFrame:
    """Survival after each time with deaths; 0 from where all at risk die."""
    table = life_table(df, time, event, by).where("deaths > 0")
    upto = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("deaths") < F.col("at_risk"), F.ln(1.0 - F.col("deaths") / F.col("at_risk")))
    ended = F.max((F.col("deaths") >= F.col("at_risk")).cast("int")).over(upto)
    survival = F.when(ended == 1, F.lit(0.0)).otherwise(F.exp(F.sum(step).over(upto)))
    return table.withColumn("survival", survival).select(*by, time, "at_risk", "deaths", "survival")


def logrank(df: DataFrame, time: str, event: Column, group: Column) -> DataFrame:
    """Two-group log-rank statistic; ``group`` is true for the rows whose deaths are observed."""
    cells = df.withColumn("__e", event).withColumn("__g", group.cast("int")).where(F.col(time).isNotNull())
    cells = cells.groupBy((-F.col(time)).alias("__back")).agg(F.sum("__e").alias("d"), F.sum(F.col("__e") * F.col("__g")).alias("d1"), F.count("*").alias("n"), F.sum("__g").alias("n1"))
    cells = cut(cells)
    bounds = range_bounds(cells, "__back")
    left = running(running(cells, [], "__back", "n", "__r", bounds=bounds), [], "__back", "n1", "__r1", bounds=bounds)
    risk = left.select("d", "d1", (F.col("__r") + F.col("n")).cast("double").alias("r"), (F.col("__r1") + F.col("n1")).cast("double").alias("r1")).where("d > 0")
    expected = F.col("d") * F.col("r1") / F.col("r")
    variance = F.when(F.col("r") > 1, F.col("d") * F.col("r1") / F.col("r") * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    one = risk.agg(F.sum("d1").cast("long").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
    gap = F.col("observed") - F.col("expected")
    return one.withColumn("chi2", F.try_divide(gap * gap, F.col("variance")))


def concordance(df: DataFrame, time: str, event: Column, risk: str) -> DataFrame:
    """Harrell's C of any risk, from counts of equal rows: pairs are counted by ranges of times and risks, never listed.

    A pair compares a death with a row of a later time, or of the same time without a death; equal risks count half.
    """
    cells = df.select(F.lit(0).alias("g"), F.col(time).alias("t"), event.cast("int").alias("e"), F.col(risk).alias("r")).where("t IS NOT NULL AND r IS NOT NULL AND e IS NOT NULL")
    return fits.concordance(cells.groupBy("g", "t", "e", "r").agg(F.count("*").alias("n")), "t", "e", "r").drop("g")


def split_half(long: DataFrame, row: str, feature: str, value: str, members: DataFrame, seed: str = "split", most: int = 12, reps: int = 200) -> DataFrame:
    """How alike the signed mean scores of two halves of a module are: a row a module, over splits of its features.

    ``members`` are ``module, feature, weight``; a weight's sign turns its feature, 0 as +1. Modules of up to ``most`` features are
    split in all ways with half of them, rounded down, on one side; larger ones ``reps`` times, by md5. Correlations of the
    halves come from the module's covariances, so rows are read once. Rows that lack a feature of a module aren't counted
    there; modules of one feature have no split and no row; a split without spread counts for nothing.
    """
    own = members.groupBy("module", "feature").agg(F.first("weight").alias("weight"))
    known = long.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(row).alias("row"), F.col(feature).alias("of"), F.col(value).cast("double").alias("v"))
    place = F.row_number().over(Window.partitionBy("module").orderBy("feature")) - 1  # a module's features
    sizes = own.groupBy(F.col("module").alias("m")).agg(F.count("*").cast("int").alias("size")).where("size > 1")
    own = cut(own.join(sizes, F.col("module") == F.col("m")).select("module", "feature", F.when(F.col("weight") < 0, -1.0).otherwise(1.0).alias("sign"), place.cast("int").alias("i"), "size"))
    wide = known.join(F.broadcast(own), F.col("of") == F.col("feature")).groupBy("module", "row").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("i", (F.col("v") * F.col("sign")).alias("v")))).alias("x"))
    wide = wide.where(F.size("x") == F.col("size")).select("module", F.transform("x", lambda e: e["v"]).alias("x"))
    pairs = wide.select("module", F.posexplode("x").alias("i", "a"), "x").select("module", "i", "a", F.posexplode("x").alias("j", "b"))
    cov = cut(pairs.groupBy("module", "i", "j").agg(F.covar_samp("a", "b").alias("c")))
    few = own.where((F.col("size") <= most) & (F.col("i") == 0)).select("module", "size", F.explode(F.expr("sequence(0, shiftleft(1, size) - 1)")).alias("split")).where(F.bit_count("split") == F.floor(F.col("size") / 2))
    few = few.select("module", "split", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i")).withColumn("first", F.expr("shiftright(split, i) & 1") == 1)
    drawn = own.where(F.col("size") > most).withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = Window.partitionBy("module", "split").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("module").cast("string"), "split", "i")))  # a module's features
    many = drawn.select("module", "split", "i", (F.row_number().over(order) <= F.floor(F.col("size") / 2)).alias("first"))
    splits = few.unionByName(many)
    a, b = splits.alias("a"), splits.alias("b")
    both = cov.alias("c").join(a, (F.col("c.module") == F.col("a.module")) & (F.col("c.i") == F.col("a.i")))
    both = both.join(b, (F.col("c.module") == F.col("b.module")) & (F.col("c.j") == F.col("b.i")) & (F.col("a.split") == F.col("b.split")))
    one, two = F.col("a.first"), F.col("b.first")
    sums = both.groupBy(F.col("c.module").alias("module"), F.col("a.split").alias("split")).agg(*[F.sum(F.when(test, F.col("c.c")).otherwise(0.0)).alias(n) for n, test in (("aa", one & two), ("bb", ~one & ~two), ("ab", one & ~two))])
    r = sums.select("module", "split", F.round(F.when((F.col("aa") > 1e-12) & (F.col("bb") > 1e-12), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))), 9).alias("r"))
    share = lambda test: F.avg(F.when(F.col("r").isNotNull(), test.cast("double")))
    found = r.groupBy("module").agg(
        F.count("r").alias("splits"), F.avg("r").alias("mean_r"), *[F.percentile("r", F.lit(q)).alias(n) for n, q in (("q05", 0.05), ("median_r", 0.5), ("q95", 0.95))],
        share(F.col("r") > 0).alias("share_positive"), share(F.col("r") > 0.3).alias("share_above"),
    )
    kind = F.when(F.col("size") <= most, "all_balanced_splits").otherwise("drawn_balanced_splits")
    return found.join(sizes, F.col("module") == F.col("m")).select("module", "size", kind.alias("method"), *[c for c in found.columns if c != "module"])
