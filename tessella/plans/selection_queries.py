"""Feature selection, latent structure and module queries over the driver's tables, with their SQL where it can be written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import fits, kernels, neighbors, selection, statistics
from tessella.operators.ranking import average_rank
from tessella.plans.relational_queries import table
from tessella.plans.statistics_queries import LONG_SQL, components, survival

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _blanket(spark, d, select, alpha):
    """Features selected for the log of a time, the last component of the vector."""
    time = survival(spark, d).select(F.col("o_orderkey").alias("vec_id"), F.log1p("days").alias("y"))
    rows = table(spark, d, "embeddings").join(time, "vec_id").select(F.concat(F.col("embedding").cast("array<double>"), F.array("y")).alias("x"))
    r = selection.Rows(rows, "x")
    n, target = r.n, len(r) - 1
    chosen = select(r, n, target, alpha)
    partial = [float(selection.partial_correlations(r, target, [c for c in chosen if c != x])[x]) for x in chosen]
    p = [selection.fisher_p(v, n, len(chosen) - 1) for v in partial]
    found = pd.DataFrame({"feature": np.array(chosen, np.int64), "partial_r": np.array(partial, float), "p_value": np.array(p, float), "n": np.full(len(chosen), n, np.int64)})
    return spark.createDataFrame(found, "feature long, partial_r double, p_value double, n long")


@query()
def iamb_selection(spark, d):
    return _blanket(spark, d, selection.iamb, 0.2)


@query()
def grow_shrink_selection(spark, d):
    return _blanket(spark, d, selection.grow_shrink, 0.2)


@query(f"""WITH l AS ({LONG_SQL}), a AS (SELECT vec_id, avg(value) AS anchor FROM l WHERE feature < 4 GROUP BY 1),
c AS (SELECT feature, corr(value, anchor) AS r FROM l JOIN a ON l.vec_id = a.vec_id WHERE feature >= 4 GROUP BY 1)
SELECT feature, round(r, 6) AS r FROM (SELECT *, row_number() OVER (ORDER BY r DESC, feature) AS p FROM c WHERE r > 0) WHERE p <= 10""")
def anchor_expansion(spark, d):
    rows = components(spark, d)
    anchor = rows.where("feature < 4").groupBy("vec_id").agg(F.avg("value").alias("anchor"))
    found = rows.where("feature >= 4").join(anchor, "vec_id").groupBy("feature").agg(F.corr("value", "anchor").alias("r"))
    return found.where("r > 0").orderBy(F.desc("r"), "feature").limit(10).select("feature", F.round("r", 6).alias("r"))


@query(f"""WITH l AS ({LONG_SQL}), p AS (SELECT a.feature % 8 AS module, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r
  FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.feature < b.feature AND a.feature % 8 = b.feature % 8 GROUP BY 1, 2, 3)
SELECT module, count(*) AS edges, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.5), 6) AS median_r, round(avg((r > 0)::INT::DOUBLE), 6) AS positive FROM p GROUP BY 1""")
def module_cohesion(spark, d):
    n, r = selection.correlations(table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x")), "x")
    i, j = np.triu_indices(len(r), 1)
    own = i % 8 == j % 8
    edges = spark.createDataFrame(pd.DataFrame({"module": (i[own] % 8).astype(np.int32), "r": r[i[own], j[own]]}), "module int, r double")
    return edges.groupBy("module").agg(
        F.count("*").alias("edges"), F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.percentile("r", F.lit(0.5)), 6).alias("median_r"),
        F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("positive"),
    )


@query("""WITH f AS (SELECT p_partkey % 10 AS rep, p_partkey % 5 AS fold, avg(p_retailprice) FILTER (p_size > 25) - avg(p_retailprice) FILTER (p_size <= 25) AS diff FROM part GROUP BY 1, 2),
s AS (SELECT count(*) AS j, avg(diff) AS m, var_samp(diff) AS v FROM f WHERE diff IS NOT NULL)
SELECT j, round(m, 6) AS mean, round(m / sqrt((1 / j::DOUBLE + 1 / 4.0::DOUBLE) * v), 6) AS t_value FROM s""")
def corrected_resampled_t(spark, d):
    # Nadeau and Bengio's variance for repeated folds of five: 1/J + 1/(k - 1).
    side = lambda c: F.avg(F.when(c, F.col("p_retailprice")))
    diffs = table(spark, d, "part").groupBy((F.col("p_partkey") % 10).alias("rep"), (F.col("p_partkey") % 5).alias("fold")).agg((side(F.col("p_size") > 25) - side(F.col("p_size") <= 25)).alias("diff"))
    one = diffs.where("diff IS NOT NULL").agg(F.count("*").alias("j"), F.avg("diff").alias("m"), F.var_samp("diff").alias("v"))
    return one.select("j", F.round("m", 6).alias("mean"), F.round(F.col("m") / F.sqrt((1 / F.col("j") + 0.25) * F.col("v")), 6).alias("t_value"))


@query(f"""WITH l AS ({LONG_SQL}), z AS (SELECT vec_id, feature, (value - avg(value) OVER (PARTITION BY feature)) / stddev_samp(value) OVER (PARTITION BY feature) AS z FROM l)
SELECT vec_id, round(sum(z) FILTER (feature % 3 <> 0) / count(*) FILTER (feature % 3 <> 0), 6) AS positive, round(sum(z) FILTER (feature % 3 = 0) / count(*) FILTER (feature % 3 = 0), 6) AS negative FROM z GROUP BY 1""")
def component_scores(spark, d):
    z = statistics.zscore(components(spark, d), ["feature"], "value")
    part = lambda c: F.round(F.avg(F.when(c, F.col("z"))), 6)
    return z.groupBy("vec_id").agg(part(F.col("feature") % 3 != 0).alias("positive"), part(F.col("feature") % 3 == 0).alias("negative"))


@query()
def cohort_subspaces(spark, d):
    """Similarity of the leading subspaces of label cohorts, and the effective rank of each."""
    rows = table(spark, d, "embeddings").select((F.col("label") % 3).alias("cohort"), F.col("embedding").cast("array<double>").alias("x"))
    bases, ranks = {}, {}
    for cohort in (0, 1, 2):
        _, _, cov = kernels.moments(rows.where(F.col("cohort") == cohort), "x")
        values, axes = np.linalg.eigh(cov)
        bases[cohort], ranks[cohort] = axes[:, np.argsort(-values)[:5]], selection.effective_rank(cov)
    found = [(a, b, selection.subspace_similarity(bases[a], bases[b]), ranks[a], ranks[b]) for a in bases for b in bases if a < b]
    return spark.createDataFrame(found, "cohort_a int, cohort_b int, similarity double, rank_a double, rank_b double")


_INVERSE = """CASE WHEN p < 0.02425 THEN (((((c1*q+c2)*q+c3)*q+c4)*q+c5)*q+c6) / ((((d1*q+d2)*q+d3)*q+d4)*q+1)
  WHEN p > 1 - 0.02425::DOUBLE THEN -(((((c1*q+c2)*q+c3)*q+c4)*q+c5)*q+c6) / ((((d1*q+d2)*q+d3)*q+d4)*q+1)
  ELSE (((((a1*r+a2)*r+a3)*r+a4)*r+a5)*r+a6)*(p-0.5) / (((((b1*r+b2)*r+b3)*r+b4)*r+b5)*r+1) END"""
for _name, _value in statistics.INVERSE_NORMAL.items():
    _INVERSE = _INVERSE.replace(_name, f"({_value!r}::DOUBLE)")


@query(f"""WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding)))::INT AS feature FROM embeddings),
s AS (SELECT vec_id, feature, (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY feature) AS share FROM l),
p AS (SELECT vec_id, feature, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, share)) AS p FROM s), q AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS q, (p - 0.5) * (p - 0.5) AS r FROM p),
g AS (SELECT vec_id, feature, {_INVERSE} AS g FROM q)
SELECT vec_id, feature, round((g - avg(g) OVER (PARTITION BY feature)) / stddev_samp(g) OVER (PARTITION BY feature), 6) AS z FROM g""")
def rank_gaussian(spark, d):
    """Inverse normal of average ranks, clipped at 1e-6, standardised again."""
    ranked = average_rank(components(spark, d).select("vec_id", "feature", "value"), ["feature"], "value")
    sizes = ranked.groupBy("feature").agg(F.count("*").alias("n"))
    share = (F.col("avg_rank") - 0.5) / F.col("n")
    rows = ranked.join(sizes, "feature").select("vec_id", "feature", statistics.inverse_normal(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), share))).alias("g"))
    sums = rows.groupBy("feature").agg(F.avg("g").alias("m"), F.stddev_samp("g").alias("s"))
    return rows.join(sums, "feature").select("vec_id", "feature", F.round(F.try_divide(F.col("g") - F.col("m"), F.col("s")), 6).alias("z"))


@query("""WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding)))::INT AS feature FROM embeddings),
c AS (SELECT q.vec_id AS query, r.vec_id AS neighbor, corr(q.value, r.value) AS r FROM l q JOIN l r ON q.feature = r.feature AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query, neighbor, round(r, 6) AS r, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(r, 12) DESC, neighbor) AS place FROM c) WHERE place <= 2""")
def nearest_by_correlation(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = neighbors.nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 2)
    return found.select("query", "neighbor", F.round("r", 6).alias("r"), "place")


@query("""WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding)))::INT AS feature FROM embeddings),
c AS (SELECT q.vec_id AS query, r.vec_id AS neighbor, corr(q.value, r.value) AS r FROM l q JOIN l r ON q.feature = r.feature AND q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
b AS (SELECT query, max(round(r, 12)) AS r FROM c GROUP BY 1), t(threshold) AS (VALUES (0.995::DOUBLE), (0.985), (0.98), (0.9))
SELECT count(*) AS queries, threshold, count(*) FILTER (r >= threshold) AS found FROM b, t GROUP BY threshold""")
def overlap_fingerprint(spark, d):
    """How many of the queries have a row at each threshold of correlation, which would show shared samples."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    best = neighbors.nearest(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 1)
    # Thresholds of the survey.
    at = (0.995, 0.985, 0.98, 0.9)
    one = best.agg(F.count("*").alias("queries"), *[F.count_if(F.col("r") >= t).alias(f"at{i}") for i, t in enumerate(at)])
    return one.selectExpr("queries", f"stack({len(at)}, " + ", ".join(f"{t}D, at{i}" for i, t in enumerate(at)) + ") AS (threshold, found)")


@query("""WITH c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, avg(s_acctbal) AS b FROM supplier GROUP BY 1),
d AS (SELECT n_regionkey, a - b AS diff FROM nation JOIN c ON n_nationkey = c.k JOIN s ON n_nationkey = s.k),
g AS (SELECT n_regionkey, count(*) FILTER (diff > 0) AS positive, count(*) FILTER (diff <> 0) AS n FROM d GROUP BY 1)
SELECT n_regionkey, positive, n, least(1.0::DOUBLE, 2 * list_sum([factorial(n::INT)::DOUBLE / (factorial(i::INT) * factorial((n - i)::INT)) FOR i IN range(0, least(positive, n - positive) + 1)]) / pow(2, n)) AS p_value, NULL::VARCHAR AS error FROM g""")
def paired_sign_test(spark, d):
    """Two-sided binomial sign test of customers' against suppliers' mean balance by region of nations."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), "n_regionkey")
    mean = lambda t, k, b: table(spark, d, t).groupBy(F.col(k).alias("unit")).agg(F.avg(b).alias(b))
    pairs = nations.join(mean("customer", "c_nationkey", "c_acctbal"), "unit").join(mean("supplier", "s_nationkey", "s_acctbal"), "unit")

    def kernel(own):
        return [kernels.sign_test((own["c_acctbal"] - own["s_acctbal"]).to_numpy(float))]

    return kernels.by_group(pairs, ["n_regionkey"], "n_regionkey int, positive long, n long, p_value double, error string", kernel)


HELD_OUT = "grp string, train long, test long, beta1 double, beta2 double, c_index double, error string"


@query()
def held_out_concordance(spark, d):
    """Ridge Cox models of all orders of four folds by order priority, their concordance on those of the fifth."""
    columns = ["days", "dead", "x1", "x2"]
    rows = survival(spark, d).select("grp", (F.col("o_orderkey") % 5 == 0).alias("held"), F.col("days").cast("double").alias("days"), F.col("dead").cast("int").alias("dead"), F.log1p("price").alias("x1"), (F.col("price") % 97).cast("double").alias("x2")).dropna(subset=["held", *columns])
    keys, sizes, numbered = fits.grouped(rows, "grp", ["x1", "x2"], ~F.col("held"))
    # Equal orders are counted, none is rounded.
    cells = fits.cut(numbered.groupBy("g", "held", *columns).agg(F.count("*").alias("n")))
    fit = {g: s for g, s in sizes.items() if s[0] and (s[2] > 0).all()}
    if not fit:
        return spark.createDataFrame([(k, sizes[g][0], 0, None, None, None, "ValueError") for g, k in enumerate(keys)], HELD_OUT)
    cells = fits.with_values(cells, {g: [*s[1], *s[2]] for g, s in fit.items()}, ["m1", "m2", "s1", "s2"])
    z = cells.select("g", "held", "days", "dead", "n", *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"x{i}") for i in (1, 2)])
    betas = fits.cox(z.where("NOT held"), {g: s[0] for g, s in fit.items()}, "days", "dead", ["x1", "x2"], 0.05)
    test = fits.with_values(z.where("held"), {g: b for g, (b, _) in betas.items()}, ["b1", "b2"])
    test = test.withColumn("risk", F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2"))
    c = {r["g"]: r["c_index"] for r in fits.concordance(test, "days", "dead", "risk").collect()}
    held = {r["g"]: r["tests"] for r in cells.where("held").groupBy("g").agg(F.sum("n").alias("tests")).collect()}
    found = [(k, sizes[g][0], held.get(g, 0), *(map(float, betas[g][0]) if g in betas else (None, None)), c.get(g), None if g in betas else "LinAlgError" if g in fit else "ValueError") for g, k in enumerate(keys)]
    return spark.createDataFrame(found, HELD_OUT)
