"""Queries of models, tests, resampling and structure over the driver's tables, with their SQL where it can be written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import factors, kernels, models, modules, nested, ranking, relational, resampling, selection, statistics
from tessella.operators.cuts import cut
from tessella.plans.relational_queries import table
from tessella.plans.statistics_queries import LONG_SQL, TAIL_SQL, components, survival

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


def _orders(spark, d):
    """Orders with a time, an event and covariates."""
    return survival(spark, d).select("o_orderkey", "grp", F.col("days").cast("double").alias("days"), F.col("dead").cast("int").alias("dead"), F.log1p("price").alias("price"), (F.col("price") % 97).alias("age"), (F.col("price") % 13).alias("rate"))


@query()
def cox_with_intervals(spark, d):
    """Univariate Cox models of every component with 95 % intervals, Harrell's C and q-values."""
    joined = components(spark, d).join(_orders(spark, d).select(F.col("o_orderkey").alias("vec_id"), "days", "dead"), "vec_id")
    found = models.adjusted_models(joined, "feature", "days", "dead", "value", {"univariate": []}, 0.0)
    return ranking.bh_adjust(found.drop("model"), "p_value")


@query()
def adjusted_cox_models(spark, d):
    """The price's hazard by order priority: alone, with each of two covariates, and with both, under a ridge."""
    specs = {"unadjusted": [], "age": ["age"], "rate": ["rate"], "age_rate": ["age", "rate"]}
    return models.adjusted_models(_orders(spark, d), "grp", "days", "dead", "price", specs)


@query()
def conditional_cox_selection(spark, d):
    """Components that enter and stay in conditional Cox models of the orders with the same number."""
    rows = _profiles(spark, d)
    most = rows.agg(F.max(F.size("x"))).first()[0] or 0
    wide = rows.select("days", "dead", *[F.get("x", F.lit(i)).alias(f"f{i}") for i in range(most)])
    chosen = models.conditional_cox(wide, "days", "dead", [f"f{i}" for i in range(most)], 0.1, 0.2, 10)
    return spark.createDataFrame([(i, *c) for i, c in enumerate(chosen)], "place int, feature string, coef double, p_value double")


@query()
def proportional_hazards_test(spark, d):
    """Whether the price's hazard changes over time, by order priority."""
    return models.proportional_hazards(_orders(spark, d), "grp", "days", "dead", "price")


@query()
def logrank_by_priority(spark, d):
    """The log-rank test of all order priorities at once."""
    found = models.logrank_groups(survival(spark, d), "days", F.col("dead").cast("int"), "grp")
    return found.select("grp", "observed", F.round("expected", 6).alias("expected"), F.round("chi2", 6).alias("chi2"), "df", F.round("p_value", 6).alias("p_value"))


@query("""WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM events),
t AS (SELECT sum(c::DOUBLE * c * c - c) AS t FROM (SELECT count(*) AS c FROM events GROUP BY value)),
g AS (SELECT sum(s * s / n) AS q, sum(n)::BIGINT AS n, count(*) AS k FROM (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY event_type)),
h AS (SELECT n, k, (12 / (n::DOUBLE * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n::DOUBLE * n * n - n)) AS h FROM g, t),
f AS (SELECT *, exp(-h / 2) AS e FROM h)
SELECT k AS groups, round(h, 6) AS h, round(CASE k WHEN 3 THEN e WHEN 5 THEN e * (1 + h / 2) WHEN 7 THEN e * (1 + h / 2 + h * h / 8) END, 6) AS p_value FROM f""")
def kruskal_p(spark, d):
    found = statistics.kruskal(table(spark, d, "events"), "event_type", "value")
    return found.select("groups", F.round("h", 6).alias("h"), F.round(models.chi2_tail(F.col("h"), F.col("groups") - 1), 6).alias("p_value"))


@query(f"""WITH x AS (SELECT user_id % 8 AS unit, (event_type = 'error')::INT AS y, value FROM events WHERE event_type IN ('error', 'click')),
r AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY value) + (count(*) OVER (PARTITION BY unit, value) - 1) / 2.0::DOUBLE AS r FROM x),
t AS (SELECT unit, sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT unit, value, count(*) AS c FROM x GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT r.unit, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(r) FILTER (y = 1) AS rs FROM r GROUP BY 1),
u AS (SELECT s.unit, n1, n0, rs - n1 * (n1 + 1) / 2 AS u, sqrt(n1::DOUBLE * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1.0::DOUBLE)))) AS sd FROM s JOIN t ON s.unit = t.unit WHERE n1 > 0 AND n0 > 0),
z AS (SELECT *, greatest(abs(u - n1 * n0 / 2.0::DOUBLE) - 0.5, 0.0::DOUBLE) / sd / sqrt(2.0::DOUBLE) AS x FROM u), p AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM z)
SELECT unit, n1, n0, round(u, 3) AS u, round({TAIL_SQL}, 6) AS p_value FROM p""")
def targeted_contrasts(spark, d):
    """Planned pairs of groups compared by unit: U and its two-sided p-value."""
    rows = table(spark, d, "events").where("event_type IN ('error', 'click')").select((F.col("user_id") % 8).alias("unit"), (F.col("event_type") == "error").cast("int").alias("y"), "value")
    found = models.mann_whitney_p(rows, "y", "value", ["unit"]).where("n1 > 0 AND n0 > 0")
    return found.select("unit", "n1", "n0", F.round("u", 3).alias("u"), F.round("p_value", 6).alias("p_value"))


@query()
def anova_p_value(spark, d):
    """One-way analysis of variance with its p-value."""
    return models.anova_p(statistics.anova(table(spark, d, "events"), "event_type", "value"))


@query()
def slopes_by_flag(spark, d):
    """Straight lines of price on quantity by return flag, with t and p."""
    return models.straight_lines(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")


@query("""WITH r AS (SELECT event_id, value AS time, event_type, user_id, row_number() OVER (ORDER BY event_id) AS at FROM events),
p AS (SELECT rep, event_id AS from_id, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('outcome|' || rep || '|' || event_id), 1, 8))::BIGINT, event_id) AS at FROM events, (SELECT unnest(range(1, 21)) AS rep)),
m AS (SELECT p.rep, r.user_id, o.time, o.event_type FROM p JOIN r ON p.at = r.at JOIN events e ON e.event_id = p.from_id JOIN r o ON o.event_id = p.from_id),
c AS (SELECT rep, corr(user_id, time) FILTER (event_type = 'error') AS r FROM m GROUP BY 1), o AS (SELECT corr(user_id, value) FILTER (event_type = 'error') AS r FROM events)
SELECT count(*) AS reps, round(any_value(o.r), 6) AS observed, round(avg(c.r), 6) AS null_mean, round((1 + count(*) FILTER (abs(c.r) >= abs(o.r))) / (1 + count(*))::DOUBLE, 6) AS p_value FROM c, o""")
def outcome_permutation(spark, d):
    """Time and event permuted together while features stay: a negative control of a correlation among the events."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("value").alias("time"), "event_type")
    r = F.corr(F.when(F.col("event_type") == "error", F.col("user_id")).cast("double"), F.when(F.col("event_type") == "error", F.col("time")))
    null = models.permute_outcomes(events, "event_id", ["time", "event_type"], 20, "outcome").groupBy("rep").agg(r.alias("r"))
    one = null.crossJoin(F.broadcast(events.agg(r.alias("o"))))  # one row
    return one.agg(F.count("*").alias("reps"), F.round(F.first("o"), 6).alias("observed"), F.round(F.avg("r"), 6).alias("null_mean"), F.round((1 + F.count_if(F.abs("r") >= F.abs("o"))) / (1 + F.count("*")), 6).alias("p_value"))


@query("""WITH x AS (SELECT documents.doc_id, quality AS y, n_chars::DOUBLE AS v FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
w AS (SELECT rep, y, v, list_sum([(u > s)::INT FOR s IN [0.36787944117144233::DOUBLE, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]])::BIGINT AS w
  FROM (SELECT *, (('0x' || substr(md5('auc|' || rep || '|' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM x, (SELECT unnest(range(1, 21)) AS rep))),
c AS (SELECT rep, v, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS a, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS b FROM w GROUP BY 1, 2),
s AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY rep ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM c),
q AS (SELECT rep, round(sum(a * (under + b / 2))::DOUBLE / (sum(a) * sum(b)), 9) AS auc FROM s GROUP BY 1)
SELECT count(auc) AS reps, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.5), 6) AS mid, round(quantile_cont(auc, 0.975), 6) AS high, round(avg((auc > 0.5)::INT::DOUBLE), 6) AS share_above FROM q""")
def bootstrap_auc_interval(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    found = models.bootstrap_auc(rows, "doc_id", "quality", "n_chars", 20, "auc")
    return found.select("reps", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high", "share_above")])


@query()
def bootstrap_cox_interval(spark, d):
    """The price's hazard among orders beside a covariate, its interval over bootstraps, how often it is positive, and Harrell's C alike."""
    found = models.bootstrap_cox(_orders(spark, d), "o_orderkey", "days", "dead", "price", ["age"], 20, "cox")
    return spark.createDataFrame([tuple(found[c.split()[0]] for c in _BOOTSTRAP.split(", "))], _BOOTSTRAP)


_BOOTSTRAP = "n long, coef double, hazard_ratio double, low double, high double, probability_positive double, valid int, c_index double, c_low double, c_high double, c_valid int"
_ODDS = "n long, coef double, odds_ratio double, low double, high double, probability_positive double, valid int"


@query()
def bootstrap_logistic_interval(spark, d):
    """The odds of quality by length and toxicity, their interval over bootstraps, and how often they are positive."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("length", F.log1p("n_chars"))
    found = models.bootstrap_logistic(rows, "doc_id", "quality", "length", ["toxic"], 20, "odds")
    return spark.createDataFrame([tuple(found[c.split()[0]] for c in _ODDS.split(", "))], _ODDS)


@query("""WITH x AS (SELECT user_id AS id, max(value) AS t, max((event_type = 'error')::INT) AS e, count(*)::DOUBLE AS r FROM events WHERE user_id % 5 = 0 GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY id) AS at FROM x),
p AS (SELECT rep, t, e, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('order|' || rep || '|' || id), 1, 8))::BIGINT, id) AS at FROM x, (SELECT unnest(range(1, 21)) AS rep)),
m AS (SELECT 0 AS rep, t, e, r FROM x UNION ALL SELECT p.rep, p.t, p.e, n.r FROM p JOIN n ON p.at = n.at),
c AS (SELECT a.rep, sum(CASE WHEN a.r > b.r THEN 1.0::DOUBLE WHEN a.r = b.r THEN 0.5 ELSE 0 END) / count(*) AS c FROM m a JOIN m b ON a.rep = b.rep AND a.e = 1 AND (a.t < b.t OR (a.t = b.t AND b.e = 0)) GROUP BY 1),
o AS (SELECT c AS o FROM c WHERE rep = 0)
SELECT (SELECT count(*) FROM x) AS n, round(any_value(o), 6) AS c_index, count(*) AS reps, round(avg(c), 6) AS null_mean, round((1 + count(*) FILTER (c >= o)) / (1 + count(*))::DOUBLE, 6) AS p_one_sided,
       round((1 + count(*) FILTER (abs(c - 0.5) >= abs(o - 0.5))) / (1 + count(*))::DOUBLE, 6) AS p_two_sided FROM c, o WHERE rep > 0""")
def permutation_c_index(spark, d):
    """Whether users with more events have an early error, by Harrell's C and permutations of its outcome."""
    users = table(spark, d, "events").where("user_id % 5 = 0").groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("t"), F.max((F.col("event_type") == "error").cast("int")).alias("e"), F.count("*").cast("double").alias("r"))
    found = models.permutation_concordance(users, "id", "t", "e", "r", 20, "order")
    return found.select("n", F.round("c_index", 6).alias("c_index"), "reps", *[F.round(c, 6).alias(c) for c in ("null_mean", "p_one_sided", "p_two_sided")])


@query("""WITH x AS (SELECT event_id AS id, event_type AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM events),
n AS (SELECT *, row_number() OVER (ORDER BY id) AS at FROM x),
p AS (SELECT rep, g, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('kruskal|' || rep || '|' || id), 1, 8))::BIGINT, id) AS at FROM x, (SELECT unnest(range(1, 21)) AS rep)),
m AS (SELECT 0 AS rep, g, r FROM x UNION ALL SELECT p.rep, p.g, n.r FROM p JOIN n ON p.at = n.at),
t AS (SELECT sum(c::DOUBLE * c * c - c) AS ties, sum(c)::DOUBLE AS n FROM (SELECT count(*) AS c FROM x GROUP BY r)),
h AS (SELECT rep, round((12 / (any_value(n) * (any_value(n) + 1)) * sum(q) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (any_value(n) * any_value(n) * any_value(n) - any_value(n))), 9) AS h
  FROM (SELECT rep, g, sum(r) * sum(r) / count(*) AS q FROM m GROUP BY 1, 2), t GROUP BY 1),
o AS (SELECT h AS o FROM h WHERE rep = 0)
SELECT (SELECT count(*) FROM x) AS n, round(any_value(o), 6) AS h, count(*) AS reps, round(avg(h), 6) AS null_mean, round((1 + count(*) FILTER (h >= o)) / (1 + count(*))::DOUBLE, 6) AS p_one_sided FROM h, o WHERE rep > 0""")
def permutation_kruskal_h(spark, d):
    """Whether the events' values differ by type, by permutations of the types over ranks that stay."""
    found = models.permutation_kruskal(table(spark, d, "events"), "event_id", "event_type", "value", 20, "kruskal")
    return found.select("n", F.round("h", 6).alias("h"), "reps", *[F.round(c, 6).alias(c) for c in ("null_mean", "p_one_sided")])


@query("""WITH s AS (SELECT p_retailprice, rep, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('null|' || rep || '|' || p_partkey), 1, 8))::BIGINT, p_partkey) AS p FROM part, (SELECT unnest(range(1, 41)) AS rep)),
nul AS (SELECT avg(p_retailprice) AS m FROM s WHERE p <= 50 GROUP BY rep), o AS (SELECT avg(p_retailprice) AS m FROM part WHERE p_brand = 'Brand#2')
SELECT round(avg(nul.m), 6) AS mean, round(quantile_cont(nul.m, 0.5), 6) AS median, round(quantile_cont(nul.m, 0.9), 6) AS q90, round(quantile_cont(nul.m, 0.95), 6) AS q95, round(max(nul.m), 6) AS most, round(avg((nul.m <= o.m)::INT::DOUBLE), 6) AS observed_percentile FROM nul, o""")
def null_summary(spark, d):
    """Where an observed mean lies among those of random panels of one size."""
    part = table(spark, d, "part")
    null = resampling.random_panels(part, [], "p_partkey", 50, 40, "null").groupBy("rep").agg(F.avg("p_retailprice").alias("m"))
    one = null.crossJoin(F.broadcast(part.where("p_brand = 'Brand#2'").agg(F.avg("p_retailprice").alias("o"))))  # one row
    q = lambda at: F.round(F.percentile("m", F.lit(at)), 6)  # noqa: E731  # a value a replicate
    return one.agg(F.round(F.avg("m"), 6).alias("mean"), q(0.5).alias("median"), q(0.9).alias("q90"), q(0.95).alias("q95"), F.round(F.max("m"), 6).alias("most"), F.round(F.avg((F.col("m") <= F.col("o")).cast("double")), 6).alias("observed_percentile"))


_Z = f"""WITH l AS ({LONG_SQL}), z AS (SELECT vec_id, label, feature, (value - avg(value) OVER (PARTITION BY feature)) / stddev_samp(value) OVER (PARTITION BY feature) AS z FROM l)"""


@query(f"""{_Z},
k AS (SELECT rep, f AS feature, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('subset|' || rep || '|' || f), 1, 8))::BIGINT, f) AS p FROM (SELECT unnest(range(20)) AS f), (SELECT unnest(range(1, 11)) AS rep)),
w AS (SELECT vec_id, avg(z) AS whole FROM z WHERE feature < 20 GROUP BY 1),
s AS (SELECT rep, vec_id, avg(z) AS part FROM z JOIN k ON z.feature = k.feature WHERE p <= 16 GROUP BY 1, 2)
SELECT rep::INT AS rep, round(corr(part, whole), 6) AS r FROM s JOIN w ON s.vec_id = w.vec_id GROUP BY 1""")
def subset_reliability(spark, d):
    """Correlation of a module's score with that of random subsets of 80 % of its features."""
    z = statistics.zscore(components(spark, d), ["feature"], "value").where("feature < 20").select("vec_id", "feature", "z")
    kept = resampling.random_panels(spark.range(20).select(F.col("id").cast("int").alias("feature")), [], "feature", 16, 10, "subset")
    part = z.join(F.broadcast(kept), "feature").groupBy("rep", "vec_id").agg(F.avg("z").alias("part"))  # features by replicates
    whole = z.groupBy("vec_id").agg(F.avg("z").alias("whole"))
    return part.join(whole, "vec_id").groupBy("rep").agg(F.round(F.corr("part", "whole"), 6).alias("r"))


@query(f"""{_Z},
k AS (SELECT rep, f AS feature, CASE WHEN ('0x' || substr(md5('sign|' || rep || '|' || f), 1, 8))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END AS s FROM (SELECT unnest(range(20)) AS f), (SELECT unnest(range(1, 11)) AS rep)),
v AS (SELECT rep, vec_id, avg(z * s) AS score FROM z JOIN k ON z.feature = k.feature GROUP BY 1, 2), n AS (SELECT rep, var_samp(score) AS v FROM v GROUP BY 1),
o AS (SELECT var_samp(score) AS v FROM (SELECT avg(z) AS score FROM z WHERE feature < 20 GROUP BY vec_id))
SELECT count(*) AS reps, round(any_value(o.v), 6) AS observed, round(avg(n.v), 6) AS null_mean, round((1 + count(*) FILTER (n.v >= o.v)) / (1 + count(*))::DOUBLE, 6) AS p_value FROM n, o""")
def sign_permuted_control(spark, d):
    """The variance of a module's score against scores with random signs."""
    z = statistics.zscore(components(spark, d), ["feature"], "value").where("feature < 20").select("vec_id", "feature", "z")
    features = resampling.replicates(spark.range(20).select(F.col("id").cast("int").alias("feature")), 10)
    signs = features.withColumn("s", F.when(resampling.draw("sign", F.col("rep"), F.col("feature")) % 2 == 0, 1.0).otherwise(-1.0))
    null = z.join(F.broadcast(signs), "feature").groupBy("rep", "vec_id").agg(F.avg(F.col("z") * F.col("s")).alias("score")).groupBy("rep").agg(F.var_samp("score").alias("v"))  # features by replicates
    seen = z.groupBy("vec_id").agg(F.avg("z").alias("score")).agg(F.var_samp("score").alias("o"))
    one = null.crossJoin(F.broadcast(seen))  # one row
    return one.agg(F.count("*").alias("reps"), F.round(F.first("o"), 6).alias("observed"), F.round(F.avg("v"), 6).alias("null_mean"), F.round((1 + F.count_if(F.col("v") >= F.col("o"))) / (1 + F.count("*")), 6).alias("p_value"))


@query(f"""{_Z}, w AS (SELECT f::INT AS feature, 'M' || (f % 4) AS module, CASE WHEN f % 3 = 0 THEN -1.0::DOUBLE ELSE 0.5::DOUBLE END * (1 + f % 5) AS weight FROM (SELECT unnest(range(64)) AS f)),
o AS (SELECT feature FROM w WHERE feature % 6 = 0), k AS (SELECT * FROM w WHERE feature NOT IN (SELECT feature FROM o)),
s AS (SELECT vec_id, module, avg(CASE WHEN weight < 0 THEN -z ELSE z END) AS signed_mean, sum(z * weight) / sum(abs(weight)) AS weighted FROM z JOIN k ON z.feature = k.feature GROUP BY 1, 2),
v AS (SELECT vec_id, module, 'signed_mean' AS variant, signed_mean AS x FROM s UNION ALL SELECT vec_id, module, 'weighted', weighted FROM s)
SELECT vec_id, module, variant, round((x - avg(x) OVER (PARTITION BY module, variant)) / stddev_samp(x) OVER (PARTITION BY module, variant), 6) AS z FROM v""")
def score_variants(spark, d):
    """Scores of modules without the features of another set, each variant standardised again, one below the other."""
    z = statistics.zscore(components(spark, d), ["feature"], "value").select("vec_id", "feature", "z")
    f = F.col("id").cast("int")
    weights = spark.range(64).select(f.alias("feature"), F.concat(F.lit("M"), (f % 4).cast("string")).alias("module"), (F.when(f % 3 == 0, -1.0).otherwise(0.5) * (1 + f % 5)).alias("weight"))
    disjoint = weights.join(weights.where("feature % 6 = 0").select("feature"), "feature", "left_anti")
    scores = statistics.module_scores(z, disjoint, "vec_id", "feature")
    long = scores.select("vec_id", "module", "signed_mean", "weighted").unpivot(["vec_id", "module"], ["signed_mean", "weighted"], "variant", "x")
    return statistics.zscore(cut(long), ["module", "variant"], "x").select("vec_id", "module", "variant", F.round("z", 6).alias("z"))


@query(f"""{_Z}, s AS (SELECT vec_id, label % 2 AS cohort, avg(z) AS score FROM z WHERE feature < 12 GROUP BY 1, 2),
c AS (SELECT s.cohort, feature, corr(z, score) AS loading FROM z JOIN s ON z.vec_id = s.vec_id WHERE feature < 12 GROUP BY 1, 2),
p AS (SELECT a.loading AS a, b.loading AS b, rank() OVER (ORDER BY a.loading) AS ra, rank() OVER (ORDER BY b.loading) AS rb FROM c a JOIN c b ON a.feature = b.feature AND a.cohort = 0 AND b.cohort = 1)
SELECT count(*) AS features, round(corr(ra, rb), 6) AS rho, round(avg((sign(a) = sign(b))::INT::DOUBLE), 6) AS sign_concordance FROM p""")
def loading_preservation(spark, d):
    """Whether a module's loadings keep their order and signs between two cohorts."""
    z = statistics.zscore(components(spark, d), ["feature"], "value").where("feature < 12").select("vec_id", (F.col("label") % 2).alias("cohort"), "feature", "z")
    scored = z.join(z.groupBy("vec_id").agg(F.avg("z").alias("score")), "vec_id")
    loadings = scored.groupBy("feature").agg(*[F.corr(F.when(F.col("cohort") == c, F.col("z")), F.when(F.col("cohort") == c, F.col("score"))).alias(f"l{c}") for c in (0, 1)])
    loadings = cut(loadings.withColumn("one", F.lit(1)))  # a row a feature
    rho = statistics.spearman(loadings, ["one"], "l0", "l1").select("one", F.round("rho", 6).alias("rho"))
    same = loadings.groupBy("one").agg(F.count("*").alias("features"), F.round(F.avg((F.signum("l0") == F.signum("l1")).cast("double")), 6).alias("sign_concordance"))
    return same.join(rho, "one").select("features", "rho", "sign_concordance")


@query("""WITH m AS (SELECT DISTINCT p_brand AS g, p_size AS i FROM part), t AS (SELECT DISTINCT p_type AS g, p_size AS i FROM part WHERE p_retailprice > 950), i AS (SELECT DISTINCT p_size AS i FROM part),
ns AS (SELECT g, count(*) AS n FROM m GROUP BY 1), nt AS (SELECT g, count(*) AS n FROM t GROUP BY 1),
o AS (SELECT max(round(2.0::DOUBLE * c / (ns.n + nt.n), 9)) AS f1 FROM (SELECT m.g AS a, t.g AS b, count(*) AS c FROM m JOIN t ON m.i = t.i GROUP BY 1, 2) x JOIN ns ON ns.g = a JOIN nt ON nt.g = b),
r AS (SELECT rep, nt.g, i, row_number() OVER (PARTITION BY rep, nt.g ORDER BY ('0x' || substr(md5('find|' || rep || '|' || nt.g || '|' || i), 1, 8))::BIGINT, i) AS p, nt.n FROM nt, i, (SELECT unnest(range(1, 21)) AS rep)),
n AS (SELECT rep, max(round(2.0::DOUBLE * c / (ns.n + k), 9)) AS f1 FROM (SELECT rep, m.g AS a, r.g AS b, any_value(n) AS k, count(*) AS c FROM r JOIN m ON m.i = r.i WHERE p <= n GROUP BY 1, 2, 3) x JOIN ns ON ns.g = a GROUP BY 1)
SELECT round(any_value(o.f1), 6) AS observed, count(*) AS reps, round(avg(n.f1), 6) AS null_mean, round((1 + count(*) FILTER (n.f1 >= o.f1)) / (1 + count(*))::DOUBLE, 6) AS p_value FROM n, o""")
def rediscovery(spark, d):
    """The best match of found sets with known ones against that of random sets of the same sizes."""
    part = table(spark, d, "part")
    known = part.select(F.col("p_brand").alias("a"), F.col("p_size").alias("i")).distinct()
    own = part.where("p_retailprice > 950").select(F.col("p_type").alias("b"), F.col("p_size").alias("i")).distinct()
    items = part.select(F.col("p_size").alias("i")).distinct()
    sizes = own.groupBy("b").agg(F.count("*").alias("n"))
    # Sets and items are few, and so are the random ones: sets by items by replicates.
    rows = resampling.replicates(sizes.join(items, F.lit(True)), 20).withColumn("u", resampling.draw("find", F.col("rep"), F.col("b"), F.col("i")))
    place = F.row_number().over(relational.Window.partitionBy("rep", "b").orderBy("u", "i"))
    random = rows.withColumn("p", place).where("p <= n").select("rep", "b", "i", "n")
    real = own.join(sizes, "b").select(F.lit(0).alias("rep"), "b", "i", "n")
    both = random.unionByName(real).join(known, "i").groupBy("rep", "a", "b").agg(F.first("n").alias("n"), F.count("*").alias("c"))
    f1 = both.join(known.groupBy("a").agg(F.count("*").alias("m")), "a").groupBy("rep").agg(F.max(F.round(2.0 * F.col("c") / (F.col("m") + F.col("n")), 9)).alias("f1"))
    seen = f1.where("rep = 0").select(F.col("f1").alias("o"))
    one = f1.where("rep > 0").crossJoin(F.broadcast(seen))  # one row
    return one.agg(F.round(F.first("o"), 6).alias("observed"), F.count("*").alias("reps"), F.round(F.avg("f1"), 6).alias("null_mean"), F.round((1 + F.count_if(F.col("f1") >= F.col("o"))) / (1 + F.count("*")), 6).alias("p_value"))


@query(f"""WITH l AS ({LONG_SQL}), p AS (SELECT a.label % 2 AS cohort, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY 1, 2, 3)
SELECT round(sqrt(2 * sum((x.r - y.r) * (x.r - y.r))) / 64, 6) AS frobenius FROM p x JOIN p y ON x.i = y.i AND x.j = y.j AND x.cohort = 0 AND y.cohort = 1""")
def correlation_distance(spark, d):
    """The Frobenius distance of two cohorts' correlation matrices by their size."""
    rows = table(spark, d, "embeddings").select((F.col("label") % 2).alias("cohort"), F.col("embedding").cast("array<double>").alias("x"))
    a, b = (selection.correlations(rows.where(F.col("cohort") == c), "x")[1] for c in (0, 1))
    return spark.createDataFrame([(round(float(np.linalg.norm(a - b)) / len(a), 6),)], "frobenius double")


def _spearman_matrix(spark, d):
    """Rows and rank correlations of all components."""
    _, found = modules.rank_correlations(components(spark, d).withColumn("all", F.lit(0)), "vec_id", "feature", "value", "all")
    return found.get(0, (0, np.zeros((0, 0))))


@query()
def spearman_modules(spark, d):
    """Modules of components by average linkage of absolute rank correlations, cut at 0.70, of at least four."""
    _, r = _spearman_matrix(spark, d)
    found = kernels.average_linkage(1 - np.abs(r), 0.70)
    return spark.createDataFrame(_modules(found, 4), "feature long, module long, size long")


@query()
def blind_modules(spark, d):
    """Modules by signed rank correlations, cut at the critical one of p = 0.01 by Student's t, of at least five, numbered by size."""
    n, r = _spearman_matrix(spark, d)
    found = kernels.average_linkage(1 - r, 1 - modules.critical_correlation(n))
    return spark.createDataFrame(_modules(found, 5), "feature long, module long, size long")


@query()
def subsample_stability(spark, d):
    """How well modules of components, at p = 0.1 and of three or more, are found again in 80 % of the rows."""
    found = modules.subsample_stability(components(spark, d), "vec_id", "feature", "value", reps=10, share=0.8, seed="stability", p=0.1, least=3)
    names = "module int, n_features int, reps int, median_clusterable double, median_jaccard double, q05_jaccard double, median_f1 double, share_jaccard_half double, share_f1_half double"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in names.split(", ")) for r in found], names)


@query()
def module_preservation(spark, d):
    """Z summaries of four sets of components of even labels among those of odd labels, over 200 permutations."""
    rows = table(spark, d, "embeddings").select((F.col("label") % 2).alias("cohort"), F.col("embedding").cast("array<double>").alias("x"))
    (_, reference), (_, test) = (selection.correlations(rows.where(F.col("cohort") == c), "x") for c in (0, 1))
    own = {f"M{m}": [i for i in range(len(test)) if i % 4 == m and i < 48] for m in range(4)}
    found = modules.module_preservation(spark, reference, test, own)
    names = ["module string", "n_features int", *[f"{c} double" for c in ("z_summary", "z_density", "z_connectivity", "median_rank", *modules.DENSITY, *modules.CONNECTIVITY)]]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in names) for r in found], ", ".join(names))


def _modules(found: np.ndarray, least: int) -> pd.DataFrame:
    """Modules of at least ``least`` features, numbered from 1 by size and first feature; 0 for the others."""
    sizes = np.bincount(found)
    first = {m: int(np.flatnonzero(found == m)[0]) for m in np.unique(found)}
    order = sorted((m for m in first if sizes[m] >= least), key=lambda m: (-sizes[m], first[m]))
    number = {m: i + 1 for i, m in enumerate(order)}
    return pd.DataFrame({"feature": np.arange(len(found)), "module": [number.get(m, 0) for m in found], "size": sizes[found]})


@query()
def stacked_components(spark, d):
    """How much of each cohort's variance the leading components of all cohorts together hold."""
    rows = table(spark, d, "embeddings").select((F.col("label") % 3).alias("cohort"), F.col("embedding").cast("array<double>").alias("x"))
    _, axes, share = kernels.principal_components(rows, "x", 5)
    found = []
    for cohort in (0, 1, 2):
        n, _, cov = kernels.moments(rows.where(F.col("cohort") == cohort), "x")
        found.append((cohort, n, float(np.trace(axes.T @ cov @ axes) / np.trace(cov)), float(share.sum())))
    return spark.createDataFrame(found, "cohort int, n long, r2 double, stacked_share double")


@query()
def module_capture(spark, d):
    """Module vectors placed among all components, absent ones 0, at unit length: what the leading subspace holds of each, and the nearest axis."""
    rows = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    _, axes, _ = kernels.principal_components(rows, "x", 5)
    weights = spark.range(64).where("id % 4 < 3").select(F.col("id").cast("int").alias("feature"), (F.col("id") % 4).cast("int").alias("module"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(0.5).alias("weight"))
    placed = weights.groupBy("module").agg(F.collect_list(F.struct("feature", "weight")).alias("own")).orderBy("module").collect()  # modules by their features
    found = []
    for r in placed:
        v = np.zeros(len(axes))
        v[[f for f, _ in r["own"]]] = [w for _, w in r["own"]]
        v /= np.linalg.norm(v)
        found.append((r["module"], float(v @ v), selection.capture(v, axes), float(np.abs(axes.T @ v).max())))
    return spark.createDataFrame(found, "module int, length double, captured double, max_cosine double")


def _profiles(spark, d):
    """Embeddings with the times, events and covariates of the orders of the same number."""
    orders = survival(spark, d).select(
        F.col("o_orderkey").alias("vec_id"), F.col("days").cast("double").alias("days"), F.col("dead").cast("int").alias("dead"), "grp", F.log1p("price").alias("price"), (F.col("price") % 97).alias("age"), (F.col("price") % 13).alias("rate")
    )
    return table(spark, d, "embeddings").join(orders, "vec_id").withColumn("x", F.col("embedding").cast("array<double>"))


@query()
def elastic_net_cox(spark, d):
    """Elastic-net Cox models of all components by outer fold, tuned on three inner folds over twelve penalties; a row a fold and selected component."""
    rows = _profiles(spark, d)
    most = rows.agg(F.max(F.size("x"))).first()[0] or 0
    tested = nested.nested_folds(rows, "vec_id", "days", "dead", "x")
    found = nested.elastic_nets(tested, [tuple(range(most))] * tested.outer)
    c = nested.held_out(tested, {f: (fit, tested.test(f)) for f, (_, fit, _, _) in enumerate(found)})
    out = []
    for f, (tuned, fit, chosen, note) in enumerate(found):
        beta = dict(zip(fit.spec.features, fit.beta.tolist()))
        for place, feature in enumerate(chosen or [None]):
            out.append((f, tuned["penalizer"], tuned["l1_ratio"], tuned["mean_inner_c"], place, feature, beta.get(feature), len(chosen), c[f], fit.settled, note))
    return spark.createDataFrame(out, "fold int, penalizer double, l1_ratio double, mean_inner_c double, place int, feature int, coef double, selected int, c_index double, settled boolean, note string")


@query()
def method_benchmark(spark, d):
    """Eight ways of selecting components compared on five held-out folds and two endpoints, selection and tuning inside the training rows."""
    rows = _profiles(spark, d)
    priorities = sorted(r[0] for r in rows.select("grp").where("grp IS NOT NULL").distinct().collect())  # a row a priority
    most = rows.agg(F.max(F.size("x"))).first()[0] or 0
    clinical = [F.col("price"), F.col("age"), F.col("rate"), *[F.coalesce(F.col("grp") == g, F.lit(False)).cast("double") for g in priorities[1:]]]
    rows = rows.withColumn("x", F.concat("x", F.array(*clinical))).withColumn("late", (F.col("dead") == 1) & (F.col("days") > 365))
    places = tuple(range(most, most + len(clinical)))
    out = []
    for endpoint, event in (("dead", "dead"), ("dead_late", "late")):
        tested = nested.nested_folds(rows, "vec_id", "days", event, "x", seed=f"nested-{endpoint}", plain=places[3:])
        for r in nested.benchmark(tested, most, places):
            out.append((endpoint, r["fold"], r["method"], len(r["selected"]), ";".join(map(str, r["selected"])), r["c_index"], r["error"], r.get("penalizer"), r.get("l1_ratio")))
    return spark.createDataFrame(out, "endpoint string, fold int, method string, n_selected int, selected string, c_index double, error string, penalizer double, l1_ratio double")


@query()
def group_factor_model(spark, d):
    """A sparse factor model of the components with three cohorts as groups: each factor's share of each cohort's variance, and its activity at 1 %."""
    rows = table(spark, d, "embeddings").select((F.col("label") % 3).alias("cohort"), F.col("embedding").cast("array<double>").alias("x")).where("cohort IS NOT NULL")
    model = factors.fit(rows, "cohort", "x", 8, rounds=60, tolerance=1e-4)
    shares = [(j, int(g), 100 * float(model.r2[i, j]), float(model.inclusion[:, j].mean()), model.settled) for i, g in enumerate(model.groups) for j in range(model.weights.shape[1])]
    long = spark.createDataFrame(shares, "factor int, cohort int, r2 double, included double, settled boolean")
    active = factors.activity(long, model.groups, (1.0,), group="cohort").select(F.col("factor").alias("of"), "activity_class", "active_count")
    return long.join(active, F.col("factor") == F.col("of")).drop("of")


_SHARES = """SELECT feature AS factor, (label % 3)::INT AS cohort, 100.0::DOUBLE * v / sum(v) OVER (PARTITION BY label % 3) AS r2
FROM (SELECT feature, label % 3 AS label, var_pop(value) AS v FROM l GROUP BY 1, 2)"""
_ACTIVE = f"""s AS ({_SHARES}), w AS (SELECT factor, threshold, list_filter([CASE WHEN max(r2) FILTER (cohort = 0) >= threshold THEN 0 END, CASE WHEN max(r2) FILTER (cohort = 1) >= threshold THEN 1 END,
  CASE WHEN max(r2) FILTER (cohort = 2) >= threshold THEN 2 END], lambda x: x IS NOT NULL) AS own, min(r2) AS lo, max(r2) AS hi, avg(r2) AS mid FROM s, (SELECT unnest([1.4, 1.55, 1.7]::DOUBLE[]) AS threshold) GROUP BY 1, 2)"""


def _shares(spark, d):
    """Each component's share of its cohort's variance, in percent."""
    long = components(spark, d).withColumn("cohort", (F.col("label") % 3).cast("int"))
    each = long.groupBy("feature", "cohort").agg(F.var_pop("value").alias("v"))
    total = each.groupBy(F.col("cohort").alias("of")).agg(F.sum("v").alias("total"))
    return each.join(total, F.col("cohort") == F.col("of")).select(F.col("feature").alias("factor"), "cohort", (100 * F.col("v") / F.col("total")).alias("r2"))


@query(f"""WITH l AS ({LONG_SQL}), {_ACTIVE}
SELECT factor, threshold, len(own) AS active_count, array_to_string(own, ';') AS active_groups,
       CASE WHEN len(own) = 3 THEN 'ubiquitous_shared' WHEN len(own) = 2 THEN 'partially_shared' WHEN len(own) = 1 THEN 'group_specific' ELSE 'inactive' END AS activity_class,
       round(lo, 6) AS least_r2, round(hi, 6) AS largest_r2, round(mid, 6) AS mean_r2, round(hi - lo, 6) AS r2_range FROM w""")
def factor_activity(spark, d):
    """Where each component is active, by its share of each cohort's variance at three thresholds."""
    found = factors.activity(_shares(spark, d), [0, 1, 2], (1.4, 1.55, 1.7), group="cohort")
    rounded = [F.round(c, 6).alias(c) for c in ("least_r2", "largest_r2", "mean_r2", "r2_range")]
    return found.select("factor", "threshold", F.col("active_count").cast("long").alias("active_count"), "active_groups", "activity_class", *rounded)


@query(f"""WITH l AS ({LONG_SQL}), {_ACTIVE}, a AS (SELECT factor, len(own) AS n, list_contains(own, 2) AS has FROM w WHERE threshold = 1.55),
r AS (SELECT factor, unnest(list_filter(['all_retained', CASE WHEN n >= 2 THEN 'shared_two_or_more' END, CASE WHEN n = 3 THEN 'ubiquitous_all_groups' END, CASE WHEN n = 2 THEN 'partially_shared' END,
  CASE WHEN n >= 2 AND NOT has THEN 'shared_without_2' END, CASE WHEN n >= 2 AND has THEN 'shared_with_2' END, CASE WHEN n = 1 AND has THEN '2_specific' END], lambda x: x IS NOT NULL)) AS subspace FROM a)
SELECT subspace, factor, (row_number() OVER (PARTITION BY subspace ORDER BY factor) - 1)::INT AS place FROM r""")
def factor_subspaces(spark, d):
    """Which components span the shared, partly shared and specific subspaces, the last cohort being the special one."""
    active = factors.activity(_shares(spark, d), [0, 1, 2], (1.55,), group="cohort")
    return factors.subspaces(active, [0, 1, 2], "2")
