"""Statistical queries over the driver's tables, with their SQL where it can be written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import kernels, models, ranking, relational, resampling, statistics
from tessella.plans.relational_queries import table
from tessella.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Components of the embeddings as a long table; used by several queries.
LONG_SQL = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, unnest(range(len(embedding)))::INT AS feature FROM embeddings"
TAIL_SQL = "((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x)"


def query(sql: str | None = None):
    """Register a query by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def components(spark, d):
    """The embeddings as a long table: ``vec_id, label, feature, value``."""
    return statistics.unpivot_vector(table(spark, d, "embeddings"), ["vec_id", "label"], "embedding")


@query(f"""WITH l AS ({LONG_SQL}),
r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY feature ORDER BY label) + (count(*) OVER (PARTITION BY feature, label) - 1) / 2.0::DOUBLE AS ry FROM l),
c AS (SELECT feature, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1),
z AS (SELECT *, abs(rho * sqrt(n - 1)) / sqrt(2.0::DOUBLE) AS x FROM c), p AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM z),
q AS (SELECT feature, n, rho, {TAIL_SQL} AS p_value FROM p),
k AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS k, count(*) OVER () AS m FROM q)
SELECT feature, n, round(rho, 6) AS rho, round(p_value, 6) AS p_value, round(least(1.0::DOUBLE, min(p_value * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM k""")
def feature_association_fdr(spark, d):
    found = statistics.spearman(components(spark, d), ["feature"], "value", "label")
    adjusted = ranking.bh_adjust(found, "p_value", id_column="feature")
    return adjusted.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("rho", "p_value", "q_value")])


@query(f"""WITH l AS ({LONG_SQL}),
r AS (SELECT label % 2 AS family, feature, rank() OVER (PARTITION BY label % 2, feature ORDER BY value) + (count(*) OVER (PARTITION BY label % 2, feature, value) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY label % 2, feature ORDER BY label) + (count(*) OVER (PARTITION BY label % 2, feature, label) - 1) / 2.0::DOUBLE AS ry FROM l),
c AS (SELECT family, feature, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1, 2),
z AS (SELECT *, abs(rho * sqrt(n - 1)) / sqrt(2.0::DOUBLE) AS x FROM c), p AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM z),
q AS (SELECT family, feature, {TAIL_SQL} AS p_value FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, feature) AS k, count(*) OVER (PARTITION BY family) AS m FROM q)
SELECT family, feature, round(p_value, 6) AS p_value, round(least(1.0::DOUBLE, min(p_value * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM k""")
def bh_within_families(spark, d):
    rows = components(spark, d).withColumn("family", F.col("label") % 2)
    found = statistics.spearman(rows, ["family", "feature"], "value", "label")
    adjusted = ranking.bh_adjust(found, "p_value", ["family"], id_column="feature")
    return adjusted.select("family", "feature", F.round("p_value", 6).alias("p_value"), F.round("q_value", 6).alias("q_value"))


@query("""SELECT p_partkey, round(r, 6) AS avg_rank, round(r / count(*) OVER (), 6) AS pct_rank FROM (
  SELECT p_partkey, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS r FROM part)""")
def average_and_percent_rank(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    n = part.agg(F.count("*").alias("n"))
    ranked = ranking.average_rank(part, [], "p_retailprice").crossJoin(F.broadcast(n))  # one row
    return ranked.select("p_partkey", F.round("avg_rank", 6).alias("avg_rank"), F.round(F.col("avg_rank") / F.col("n"), 6).alias("pct_rank"))


@query("""WITH b AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM part)
SELECT p_partkey, len(list_filter(q, lambda x: x < p_retailprice))::INT AS bin FROM part, b""")
def quantile_bins(spark, d):
    return ranking.qcut(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 5).select("p_partkey", "bin")


@query("""WITH b AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q, quantile_cont(p_size, [0.25, 0.5, 0.75]) AS s FROM part),
x AS (SELECT p_partkey, p_brand, len(list_filter(q, lambda x: x < p_retailprice))::VARCHAR || '_' || len(list_filter(s, lambda x: x < p_size))::VARCHAR AS bin FROM part, b),
want AS (SELECT bin, count(*) AS n FROM x WHERE p_brand = 'Brand#3' GROUP BY bin),
pool AS (SELECT x.bin, p_partkey, rep, n, row_number() OVER (PARTITION BY x.bin, rep ORDER BY ('0x' || substr(md5('panel|' || rep || '|' || p_partkey), 1, 8))::BIGINT, p_partkey) AS p
  FROM x JOIN want ON x.bin = want.bin, (SELECT unnest(range(1, 6)) AS rep) WHERE p_brand <> 'Brand#3')
SELECT rep::INT AS rep, bin, p_partkey FROM pool WHERE p <= n""")
def matched_random_panels(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    binned = ranking.qcut(ranking.qcut(part, "p_retailprice", 4, "a"), "p_size", 4, "b").withColumn("bin", F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string")))
    want = binned.where("p_brand = 'Brand#3'").groupBy("bin").agg(F.count("*").alias("n"))
    pool = binned.where("p_brand <> 'Brand#3'").join(want, "bin")
    return resampling.random_panels(pool, ["bin"], "p_partkey", "n", 5, "panel").select("rep", "bin", "p_partkey")


@query("""WITH c AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, round(v * 1e6::DOUBLE / t, 4) AS cpm, round(log2(v * 1e6::DOUBLE / t + 1), 6) AS log_cpm
FROM (SELECT *, sum(v) OVER (PARTITION BY l_orderkey) AS t FROM c)""")
def sample_cpm_log(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return statistics.log_cpm(counts, "l_orderkey", "v").select("l_orderkey", "l_suppkey", F.round("cpm", 4).alias("cpm"), F.round("log_cpm", 6).alias("log_cpm"))


@query(f"""WITH l AS ({LONG_SQL}) SELECT vec_id, feature, round((value - m) / s, 6) AS z FROM (
  SELECT *, avg(value) OVER (PARTITION BY feature) AS m, stddev_samp(value) OVER (PARTITION BY feature) AS s FROM l) WHERE s > 0""")
def feature_zscore(spark, d):
    return statistics.zscore(components(spark, d), ["feature"], "value").select("vec_id", "feature", F.round("z", 6).alias("z"))


@query(f"""WITH l AS ({LONG_SQL}), t AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM l WHERE vec_id % 5 <> 0 GROUP BY 1 HAVING stddev_samp(value) > 0)
SELECT vec_id, l.feature, round((value - m) / s, 6) AS z FROM l JOIN t ON l.feature = t.feature""")
def train_test_zscore(spark, d):
    return statistics.zscore_from_train(components(spark, d), F.col("vec_id") % 5 != 0, ["feature"], "value").select("vec_id", "feature", F.round("z", 6).alias("z"))


@query(f"""WITH l AS ({LONG_SQL}), z AS (SELECT vec_id, feature, (value - avg(value) OVER (PARTITION BY feature)) / stddev_samp(value) OVER (PARTITION BY feature) AS z FROM l),
w AS (SELECT f::INT AS feature, 'M' || (f % 4) AS module, CASE WHEN f % 3 = 0 THEN -1.0::DOUBLE ELSE 0.5::DOUBLE END * (1 + f % 5) AS weight FROM (SELECT unnest(range(64)) AS f))
SELECT vec_id, module, count(z) AS n_features, round(avg(CASE WHEN weight < 0 THEN -z ELSE z END), 6) AS signed_mean, round(sum(z * weight) / sum(abs(weight)), 6) AS weighted
FROM z JOIN w ON z.feature = w.feature GROUP BY 1, 2""")
def signed_and_weighted_score(spark, d):
    z = statistics.zscore(components(spark, d), ["feature"], "value").select("vec_id", "feature", "z")
    f = F.col("id").cast("int")
    weights = spark.range(64).select(f.alias("feature"), F.concat(F.lit("M"), (f % 4).cast("string")).alias("module"), (F.when(f % 3 == 0, -1.0).otherwise(0.5) * (1 + f % 5)).alias("weight"))
    scores = statistics.module_scores(z, weights, "vec_id", "feature")
    return scores.select("vec_id", "module", "n_features", F.round("signed_mean", 6).alias("signed_mean"), F.round("weighted", 6).alias("weighted"))


@query("""WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - a - b * l_quantity, 3) AS residual FROM lineitem JOIN f ON lineitem.l_returnflag = f.l_returnflag""")
def residualize_from_train(spark, d):
    rows = statistics.residuals(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"], F.col("l_orderkey") % 4 != 0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("residual", 3).alias("residual"))


_TWO = """f AS (SELECT *, sxx * szz - sxz * sxz AS det FROM s),
b AS (SELECT *, (sxy * szz - szy * sxz) / det AS bx, (szy * sxx - sxy * sxz) / det AS bz FROM f)"""


@query(f"""WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS my, avg(l_quantity) AS mx, avg(l_discount) AS mz, var_samp(l_quantity) AS sxx, var_samp(l_discount) AS szz, covar_samp(l_quantity, l_discount) AS sxz,
  covar_samp(l_quantity, l_extendedprice) AS sxy, covar_samp(l_discount, l_extendedprice) AS szy, var_samp(l_extendedprice) AS syy FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1),
{_TWO}
SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 4 <> 0 AS trained, round((l_extendedprice - my - bx * (l_quantity - mx) - bz * (l_discount - mz)) / sqrt(syy - bx * sxy - bz * szy), 6) AS z
FROM lineitem JOIN b ON lineitem.l_returnflag = b.l_returnflag""")
def crossfit_residuals(spark, d):
    """Prices less what quantity and discount say of them, fitted and scaled on the training rows of a return flag."""
    rows = statistics.residuals(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"], F.col("l_orderkey") % 4 != 0, "z", scaled=True, least=30)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") % 4 != 0).alias("trained"), F.round("z", 6).alias("z"))


@query(f"""WITH l AS ({LONG_SQL}), w AS (SELECT l.vec_id, l.feature, l.value, l.label::DOUBLE AS x, k.value AS z FROM l JOIN l k ON l.vec_id = k.vec_id AND k.feature = 0 WHERE l.feature > 0),
s AS (SELECT feature, avg(value) AS my, avg(x) AS mx, avg(z) AS mz, var_samp(x) AS sxx, var_samp(z) AS szz, covar_samp(x, z) AS sxz, covar_samp(x, value) AS sxy, covar_samp(z, value) AS szy, var_samp(value) AS syy FROM w GROUP BY 1),
{_TWO}
SELECT vec_id, w.feature, round((value - my - bx * (x - mx) - bz * (z - mz)) / sqrt(syy - bx * sxy - bz * szy), 6) AS z FROM w JOIN b ON w.feature = b.feature""")
def feature_residuals(spark, d):
    """Every component less what the label and the first component say of it, as z-scores, all components in one aggregate."""
    long = components(spark, d)
    first = table(spark, d, "embeddings").select(F.col("vec_id").alias("of"), F.get("embedding", F.lit(0)).cast("double").alias("first"))
    rows = long.where("feature > 0").join(first, F.col("vec_id") == F.col("of"))
    return statistics.residuals(rows, "value", ["label", "first"], ["feature"], out="z", scaled=True, least=10).select("vec_id", "feature", F.round("z", 6).alias("z"))


@query(f"""WITH l AS ({LONG_SQL}), a AS (SELECT feature, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, stddev_pop(value) AS s FROM l GROUP BY 1),
m AS (SELECT l.feature, 1.4826::DOUBLE * quantile_cont(abs(value - med), 0.5) AS mad FROM l JOIN a ON l.feature = a.feature GROUP BY 1)
SELECT a.feature, round(med, 6) AS median, round(CASE WHEN mad > 0 THEN mad WHEN (q3 - q1) / 1.349 > 0 THEN (q3 - q1) / 1.349 ELSE s END, 6) AS spread FROM a JOIN m ON a.feature = m.feature""")
def robust_variability(spark, d):
    return statistics.robust_spread(components(spark, d), ["feature"], "value").select("feature", F.round("median", 6).alias("median"), F.round("spread", 6).alias("spread"))


@query("""WITH r AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM events),
t AS (SELECT sum(c::DOUBLE * c * c - c) AS t FROM (SELECT count(*) AS c FROM events GROUP BY value)),
g AS (SELECT sum(s * s / n) AS q, sum(n)::BIGINT AS n, count(*) AS k FROM (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY event_type)),
h AS (SELECT n, k, (12 / (n::DOUBLE * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n::DOUBLE * n * n - n)) AS h FROM g, t)
SELECT n, k AS groups, round(h, 6) AS h, round(greatest(0.0::DOUBLE, (h - k + 1) / (n - k)), 6) AS epsilon2 FROM h""")
def kruskal_wallis(spark, d):
    return statistics.kruskal(table(spark, d, "events"), "event_type", "value").select("n", "groups", F.round("h", 6).alias("h"), F.round("epsilon2", 6).alias("epsilon2"))


@query("""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1),
s AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, sum(n * v) AS w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM g)
SELECT n, k AS groups, round((b / (k - 1)) / (w / (n - k)), 6) AS f_value, round(b / (b + w), 6) AS eta2 FROM s""")
def anova_eta2(spark, d):
    return statistics.anova(table(spark, d, "events"), "event_type", "value").select("n", "groups", F.round("f_value", 6).alias("f_value"), F.round("eta2", 6).alias("eta2"))


@query("""WITH p AS (SELECT a.t AS type_a, b.t AS type_b FROM (SELECT DISTINCT event_type AS t FROM events) a JOIN (SELECT DISTINCT event_type AS t FROM events) b ON a.t < b.t),
x AS (SELECT type_a, type_b, event_type, value FROM events JOIN p ON event_type = type_a OR event_type = type_b),
r AS (SELECT *, rank() OVER (PARTITION BY type_a, type_b ORDER BY value) + (count(*) OVER (PARTITION BY type_a, type_b, value) - 1) / 2.0::DOUBLE AS r FROM x),
s AS (SELECT type_a, type_b, count(*) FILTER (event_type = type_a) AS n1, count(*) FILTER (event_type = type_b) AS n0, sum(r) FILTER (event_type = type_a) AS r FROM r GROUP BY 1, 2)
SELECT type_a, type_b, n1, n0, round(r - n1 * (n1 + 1) / 2, 3) AS u, round(2 * (r - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 6) AS cliffs_delta FROM s""")
def pair_contrasts(spark, d):
    # The event types are few; each row goes to the pairs that its type is in.
    kinds = table(spark, d, "events").select("event_type").distinct()
    pairs = kinds.select(F.col("event_type").alias("type_a")).join(kinds.select(F.col("event_type").alias("type_b")), F.col("type_a") < F.col("type_b"))
    sides = pairs.select("type_a", "type_b", F.explode(F.array(F.struct(F.col("type_a").alias("t"), F.lit(1).alias("y")), F.struct(F.col("type_b").alias("t"), F.lit(0).alias("y")))).alias("s"))
    rows = table(spark, d, "events").join(sides.select("type_a", "type_b", F.col("s.t").alias("event_type"), F.col("s.y").alias("y")), "event_type")
    found = statistics.mann_whitney(rows, F.col("y"), "value", ["type_a", "type_b"])
    return found.select("type_a", "type_b", "n1", "n0", F.round("u", 3).alias("u"), F.round("cliffs_delta", 6).alias("cliffs_delta"))


_SURVIVAL = "SELECT o_orderkey, abs(date_diff('day', DATE '1995-01-01', o_orderdate::DATE)) AS days, o_orderstatus = 'F' AS dead, o_orderpriority AS grp, o_totalprice AS price FROM orders"


def survival(spark, d):
    """Orders as survival data: days from a date, event where finished."""
    days = F.expr("cast(abs(datediff(cast(o_orderdate AS date), date'1995-01-01')) AS bigint)")
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), (F.col("o_orderstatus") == "F").alias("dead"), F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("price"))


@query(f"""WITH o AS ({_SURVIVAL}), c AS (SELECT grp, days, sum(dead::INT)::BIGINT AS deaths, count(*) AS n FROM o GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY days DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS at_risk FROM c)
SELECT grp, days, at_risk, deaths, round(CASE WHEN max((deaths >= at_risk)::INT) OVER w = 1 THEN 0.0::DOUBLE ELSE exp(sum(CASE WHEN deaths < at_risk THEN ln(1.0::DOUBLE - deaths / at_risk::DOUBLE) END) OVER w) END, 6) AS survival
FROM r WHERE deaths > 0 WINDOW w AS (PARTITION BY grp ORDER BY days ROWS UNBOUNDED PRECEDING)""")
def kaplan_meier_curve(spark, d):
    return statistics.kaplan_meier(survival(spark, d), "days", F.col("dead").cast("int"), ["grp"]).withColumn("survival", F.round("survival", 6))


@query(f"""WITH o AS ({_SURVIVAL}), c AS (SELECT days, sum(dead::INT) AS d, sum((dead AND price > 250000)::INT) AS d1, count(*) AS n, sum((price > 250000)::INT) AS n1 FROM o GROUP BY 1),
r AS (SELECT d, d1, (sum(n) OVER w)::DOUBLE AS r, (sum(n1) OVER w)::DOUBLE AS r1 FROM c WINDOW w AS (ORDER BY days DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT sum(d1)::BIGINT AS observed, sum(d * r1 / r) AS expected, sum(CASE WHEN r > 1 THEN d * r1 / r * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS variance FROM r WHERE d > 0)
SELECT observed, round(expected, 6) AS expected, round(variance, 6) AS variance, round((observed - expected) * (observed - expected) / variance, 6) AS chi2 FROM s""")
def logrank_test(spark, d):
    found = statistics.logrank(survival(spark, d), "days", F.col("dead").cast("int"), F.col("price") > 250000)
    return found.select("observed", *[F.round(c, 6).alias(c) for c in ("expected", "variance", "chi2")])


@query(f"""WITH o AS (SELECT days AS t, dead AS e, substr(grp, 1, 1)::INT AS r FROM ({_SURVIVAL})), c AS (SELECT t, e, r, count(*) AS n FROM o GROUP BY 1, 2, 3)
SELECT sum(a.n * b.n)::BIGINT AS comparable, sum(CASE WHEN a.r > b.r THEN a.n * b.n ELSE 0 END)::BIGINT AS concordant, sum(CASE WHEN a.r = b.r THEN a.n * b.n ELSE 0 END)::BIGINT AS tied,
  round((sum(CASE WHEN a.r > b.r THEN a.n * b.n ELSE 0 END) + sum(CASE WHEN a.r = b.r THEN a.n * b.n ELSE 0 END) / 2)::DOUBLE / sum(a.n * b.n), 6) AS c_index
FROM c a JOIN c b ON a.e AND (b.t > a.t OR (b.t = a.t AND NOT b.e))""")
def concordance_index(spark, d):
    rows = survival(spark, d).withColumn("risk", F.substring("grp", 1, 1).cast("int"))
    return statistics.concordance(rows, "days", F.col("dead"), "risk").withColumn("c_index", F.round("c_index", 6))


@query("""WITH x AS (SELECT quality AS y, n_chars AS v FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
r AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM x),
s AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(r) FILTER (y = 1) AS r FROM r)
SELECT n1, n0, round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM s""")
def roc_auc(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return statistics.mann_whitney(rows, F.col("quality"), "n_chars").select("n1", "n0", F.round("auc", 6).alias("auc"))


@query("""WITH x AS (SELECT quality AS y, n_chars AS v FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
c AS (SELECT v, sum(y) AS h, count(*) AS n FROM x GROUP BY v), r AS (SELECT h, sum(h) OVER w AS ch, sum(n) OVER w AS cn FROM c WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING))
SELECT (SELECT count(*) FROM x) AS n, sum(h)::BIGINT AS positives, round(sum(ch / cn::DOUBLE * h) / sum(h), 6) AS average_precision FROM r""")
def average_precision(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return statistics.average_precision(rows, "quality", "n_chars").withColumn("average_precision", F.round("average_precision", 6))


@query("""WITH x AS (SELECT labels.doc_id, quality AS y, n_chars AS v FROM documents JOIN labels ON documents.doc_id = labels.doc_id),
r AS (SELECT doc_id, y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM x),
o AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(r) FILTER (y = 1) AS s FROM r),
m AS (SELECT rep, r, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('perm|' || rep || '|' || doc_id), 1, 8))::BIGINT, doc_id) AS p FROM r, (SELECT unnest(range(1, 101)) AS rep)),
u AS (SELECT rep, round((sum(CASE WHEN p <= n1 THEN r ELSE 0.0::DOUBLE END) - any_value(n1) * (any_value(n1) + 1) / 2) / (any_value(n1) * any_value(n0)), 9) AS a FROM m, o GROUP BY rep),
w AS (SELECT n1, n0, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS a FROM o)
SELECT w.n1, w.n0, round(w.a, 6) AS auc, round((count(*) FILTER (abs(u.a - 0.5) >= abs(w.a - 0.5)) + 1) / (count(*) + 1)::DOUBLE, 6) AS p_value, round(avg(u.a), 6) AS null_mean FROM u, w GROUP BY w.n1, w.n0, w.a""")
def permutation_auc(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    found = resampling.permutation_auc(rows, "doc_id", "quality", "n_chars", 100, "perm")
    return found.select("n1", "n0", *[F.round(c, 6).alias(c) for c in ("auc", "p_value", "null_mean")])


@query("""WITH u AS (SELECT event_type, rep, value, (('0x' || substr(md5('boot|' || rep || '|' || event_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM events, (SELECT unnest(range(1, 41)) AS rep)),
w AS (SELECT event_type, rep, value, (u > 0.36787944117144232::DOUBLE)::INT + (u > 0.7357588823428847::DOUBLE)::INT + (u > 0.9196986029286058::DOUBLE)::INT + (u > 0.9810118431238462::DOUBLE)::INT + (u > 0.9963401531726563::DOUBLE)::INT + (u > 0.9994058151824183::DOUBLE)::INT + (u > 0.9999167588507119::DOUBLE)::INT AS w FROM u),
m AS (SELECT event_type, rep, sum(w * value) / sum(w) AS m FROM w GROUP BY 1, 2)
SELECT event_type, count(m) AS reps, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS mid, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY 1""")
def bootstrap_mean_interval(spark, d):
    found = resampling.bootstrap_mean(table(spark, d, "events"), ["event_type"], "event_id", "value", 40, "boot")
    return found.select("event_type", "reps", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


@query("""SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5('fold|' || doc_id), 1, 8))::BIGINT, doc_id) - 1) % 5)::INT AS fold FROM labels""")
def stratified_folds(spark, d):
    return resampling.folds(table(spark, d, "labels"), "doc_id", "quality", 5, "fold").select("doc_id", "quality", F.col("fold").cast("int").alias("fold"))


@query(f"""WITH l AS ({LONG_SQL}), h AS (SELECT feature, label, avg(value) FILTER (('0x' || substr(md5('half|' || vec_id), 1, 8))::BIGINT % 2 = 0) AS a, avg(value) FILTER (('0x' || substr(md5('half|' || vec_id), 1, 8))::BIGINT % 2 = 1) AS b FROM l GROUP BY 1, 2),
c AS (SELECT label, count(*) AS n, corr(a, b) AS r FROM h GROUP BY 1) SELECT label, n, round(r, 6) AS r, round(2 * r / (1 + r), 6) AS reliability FROM c""")
def split_half_reliability(spark, d):
    half = resampling.draw("half", F.col("vec_id")) % 2
    means = components(spark, d).groupBy("feature", "label").agg(F.avg(F.when(half == 0, F.col("value"))).alias("a"), F.avg(F.when(half == 1, F.col("value"))).alias("b"))
    found = means.groupBy("label").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    return found.select("label", "n", F.round("r", 6).alias("r"), F.round(2 * F.col("r") / (1 + F.col("r")), 6).alias("reliability"))


@query("""WITH s AS (SELECT s_nationkey AS unit, sum(s_acctbal) AS s, count(*) AS n FROM supplier GROUP BY 1), t AS (SELECT sum(s) AS ts, sum(n) AS tn FROM s), m AS (SELECT (ts - s) / (tn - n) AS m FROM s, t)
SELECT count(*) AS units, round(min(m), 4) AS least, round(quantile_cont(m, 0.5), 4) AS middle, round(max(m), 4) AS most, round(avg((m > 4500)::INT::DOUBLE), 6) AS above FROM m""")
def leave_one_out_summary(spark, d):
    means = resampling.leave_one_out(table(spark, d, "supplier"), "s_nationkey", "s_acctbal")
    m = F.col("mean_without")
    return means.agg(F.count("*").alias("units"), F.round(F.min(m), 4).alias("least"), F.round(F.percentile(m, F.lit(0.5)), 4).alias("middle"), F.round(F.max(m), 4).alias("most"), F.round(F.avg((m > 4500).cast("double")), 6).alias("above"))


@query(f"""WITH l AS ({LONG_SQL}), p AS (SELECT a.label % 2 AS cohort, a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY 1, 2, 3),
e AS (SELECT x.i, x.j, x.r AS r0, y.r AS r1 FROM p x JOIN p y ON x.i = y.i AND x.j = y.j AND x.cohort = 0 AND y.cohort = 1)
SELECT count(*) AS edges, round(corr(r0, r1), 6) AS edge_correlation, round(avg((sign(r0) = sign(r1))::INT::DOUBLE), 6) AS sign_concordance, round(sum(r0 * r1) / sqrt(sum(r0 * r0) * sum(r1 * r1)), 6) AS rv FROM e""")
def edge_preservation(spark, d):
    rows = table(spark, d, "embeddings").select((F.col("label") % 2).alias("cohort"), F.col("embedding").cast("array<double>").alias("x"))
    edges = []
    for cohort in (0, 1):
        n, _, cov = kernels.moments(rows.where(F.col("cohort") == cohort), "x")
        sd = np.sqrt(np.diag(cov))
        i, j = np.triu_indices(len(sd), 1)
        r = cov[i, j] / (sd[i] * sd[j])
        edges.append(spark.createDataFrame(pd.DataFrame({"i": i, "j": j, f"r{cohort}": r})))
    joined = edges[0].join(edges[1], ["i", "j"])
    rv = F.sum(F.col("r0") * F.col("r1")) / F.sqrt(F.sum(F.col("r0") * F.col("r0")) * F.sum(F.col("r1") * F.col("r1")))
    return joined.agg(F.count("*").alias("edges"), F.round(F.corr("r0", "r1"), 6).alias("edge_correlation"), F.round(F.avg((F.signum("r0") == F.signum("r1")).cast("double")), 6).alias("sign_concordance"), F.round(rv, 6).alias("rv"))


@query("""WITH m AS (SELECT s_nationkey % 5 AS region, s_nationkey AS unit, avg(s_acctbal) FILTER (s_suppkey % 2 = 0) - avg(s_acctbal) FILTER (s_suppkey % 2 = 1) AS diff FROM supplier GROUP BY 1, 2),
r AS (SELECT region, diff, row_number() OVER (PARTITION BY region ORDER BY unit) - 1 AS bit FROM m WHERE diff IS NOT NULL),
g AS (SELECT region, count(*) AS n, sum(diff) AS total FROM r GROUP BY 1),
f AS (SELECT g.region, n, total, mask, sum(CASE WHEN (mask >> r.bit) & 1 = 1 THEN -diff ELSE diff END) AS s FROM g JOIN r ON g.region = r.region, LATERAL (SELECT unnest(range(0, (1 << n::INT)::BIGINT)) AS mask) k GROUP BY 1, 2, 3, 4)
SELECT region, n, round(any_value(total) / n, 4) AS mean, round(avg((abs(s) >= abs(total) - 1e-9)::INT::DOUBLE), 6) AS p_value FROM f GROUP BY 1, 2""")
def sign_flip_exact(spark, d):
    even = F.avg(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")))
    odd = F.avg(F.when(F.col("s_suppkey") % 2 == 1, F.col("s_acctbal")))
    pairs = table(spark, d, "supplier").groupBy((F.col("s_nationkey") % 5).alias("region"), F.col("s_nationkey").alias("unit")).agg((even - odd).alias("diff"))
    found = resampling.sign_flips(pairs, ["region"], "unit", "diff")
    return found.select("region", "n", F.round("mean", 4).alias("mean"), F.round("p_value", 6).alias("p_value"))


@query("""WITH s AS (SELECT p_brand, rep, p_retailprice, row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5('size|' || rep || '|' || p_partkey), 1, 8))::BIGINT, p_partkey) AS p FROM part, (SELECT unnest(range(1, 51)) AS rep)),
nul AS (SELECT rep, avg(p_retailprice) AS m FROM s WHERE p <= 100 GROUP BY rep), o AS (SELECT avg(p_retailprice) AS m FROM part WHERE p_brand = 'Brand#3')
SELECT round(any_value(o.m), 4) AS observed, round(avg(nul.m), 4) AS null_mean, round(quantile_cont(nul.m, 0.95), 4) AS null_q95, round((1 + count(*) FILTER (nul.m >= o.m)) / (1 + count(*))::DOUBLE, 6) AS p_value FROM nul, o""")
def empirical_null(spark, d):
    part = table(spark, d, "part")
    null = resampling.random_panels(part, [], "p_partkey", 100, 50, "size").groupBy("rep").agg(F.avg("p_retailprice").alias("m"))
    observed = part.where("p_brand = 'Brand#3'").agg(F.avg("p_retailprice").alias("o"))
    one = null.crossJoin(F.broadcast(observed))  # one row
    return one.agg(F.round(F.first("o"), 4).alias("observed"), F.round(F.avg("m"), 4).alias("null_mean"), F.round(F.percentile("m", F.lit(0.95)), 4).alias("null_q95"), F.round((1 + F.count_if(F.col("m") >= F.col("o"))) / (1 + F.count("*")), 6).alias("p_value"))


@query("""WITH m AS (SELECT s_nationkey AS unit, s_suppkey % 4 AS item, avg(s_acctbal) AS v FROM supplier GROUP BY 1, 2),
l AS (SELECT o.unit AS left_out, item, avg(v) AS v FROM m, (SELECT DISTINCT unit FROM m) o WHERE m.unit <> o.unit GROUP BY 1, 2),
r AS (SELECT left_out, item, row_number() OVER (PARTITION BY left_out ORDER BY v DESC, item) AS place FROM l)
SELECT item, min(place) AS best, max(place) AS worst, round(avg((place = 1)::INT::DOUBLE), 6) AS first_share FROM r GROUP BY 1""")
def rank_stability(spark, d):
    # A unit's own mean is taken from the item's sums: no row is repeated for each unit left out.
    means = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("unit"), (F.col("s_suppkey") % 4).alias("item")).agg(F.avg("s_acctbal").alias("v"))
    sums = means.groupBy("item").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    grid = means.select(F.col("unit").alias("left_out")).distinct().crossJoin(sums)  # units by items
    left = grid.join(means.select(F.col("unit").alias("left_out"), "item", "v"), ["left_out", "item"], "left")
    without = F.try_divide(F.col("s") - F.coalesce("v", F.lit(0.0)), F.col("n") - F.when(F.col("v").isNull(), 0).otherwise(1))
    ranked = left.withColumn("w", without).where("w IS NOT NULL").withColumn("place", F.row_number().over(Window.partitionBy("left_out").orderBy(F.desc("w"), "item")).cast("long"))
    return ranked.groupBy("item").agg(F.min("place").alias("best"), F.max("place").alias("worst"), F.round(F.avg((F.col("place") == 1).cast("double")), 6).alias("first_share"))


def _timed_vectors(spark, d):
    times = survival(spark, d).select(F.col("o_orderkey").alias("vec_id"), F.col("days").cast("double").alias("days"), F.col("dead").cast("int").alias("dead"))
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).join(times, "vec_id")


@query()
def cox_per_feature(spark, d):
    return ranking.bh_adjust(models.cox_screen(_timed_vectors(spark, d), "days", "dead", "x"), "p_value")


@query()
def permutation_screen(spark, d):
    """Significant univariate Cox models of the components, observed and in ten permutations of the outcomes."""
    return models.permutation_screen(_timed_vectors(spark, d), "vec_id", "days", "dead", "x", 10, "screen")


@query()
def logistic_by_source(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", "quality", F.log1p("n_chars").alias("x"))
    return models.intervals(kernels.logistic_by_group(rows, "source", "quality", "x", 1e-8), "odds_ratio")


@query()
def signed_rank_by_region(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), "n_regionkey")
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.avg("c_acctbal").alias("a"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("unit")).agg(F.avg("s_acctbal").alias("b"))
    pairs = nations.join(a, "unit").join(b, "unit").select("n_regionkey", (F.col("a") - F.col("b")).alias("diff"))

    def kernel(own):
        w, p = kernels.signed_rank(own["diff"].to_numpy(float))
        return [(len(own), w, p)]

    return kernels.by_group(pairs, ["n_regionkey"], "n_regionkey int, n long, w_plus double, p_value double, error string", kernel)


@query()
def principal_component_scores(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mean, axes, _ = kernels.principal_components(rows, "x", 3)
    score = lambda k: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in axes[:, k]]), lambda a, b: a * b), F.lit(float(-mean @ axes[:, k])), lambda s, v: s + v)
    return rows.select("vec_id", *[F.round(score(k), 6).alias(f"pc{k + 1}") for k in range(3)])


@query()
def correlation_modules(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    _, _, cov = kernels.moments(rows, "x")
    sd = np.sqrt(np.diag(cov))
    modules = kernels.average_linkage(1 - np.abs(cov / np.outer(sd, sd)), 0.7)
    sizes = np.bincount(modules)
    return spark.createDataFrame(pd.DataFrame({"feature": np.arange(len(modules)), "module": modules, "size": sizes[modules]}))


@query(f"""WITH l AS ({LONG_SQL}), z AS (SELECT vec_id, feature, (value - avg(value) OVER (PARTITION BY feature)) / stddev_samp(value) OVER (PARTITION BY feature) AS z FROM l),
w AS (SELECT f::INT AS feature, 'M' || (f % 6) AS module, CASE WHEN f % 3 = 0 THEN -1 ELSE 1 END AS sign, (f // 6)::INT AS i, CASE WHEN f % 6 < 4 THEN 11 ELSE 10 END AS size FROM (SELECT unnest(range(64)) AS f)),
s AS (SELECT vec_id, module, i, z * sign AS v FROM z JOIN w ON z.feature = w.feature),
c AS (SELECT a.module, a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.module = b.module GROUP BY 1, 2, 3),
k AS (SELECT module, size, split FROM (SELECT DISTINCT module, size FROM w), (SELECT unnest(range(2048)) AS split) WHERE split < (1 << size) AND bit_count(split::BIGINT) = size // 2),
t AS (SELECT c.module, any_value(k.size) AS size, split, sum(CASE WHEN (split >> i) & 1 = 1 AND (split >> j) & 1 = 1 THEN c.c ELSE 0 END) AS aa, sum(CASE WHEN (split >> i) & 1 = 0 AND (split >> j) & 1 = 0 THEN c.c ELSE 0 END) AS bb,
  sum(CASE WHEN (split >> i) & 1 = 1 AND (split >> j) & 1 = 0 THEN c.c ELSE 0 END) AS ab FROM c JOIN k ON c.module = k.module GROUP BY 1, 3),
r AS (SELECT module, size, round(ab / sqrt(aa * bb), 9) AS r FROM t)
SELECT module, size::INT AS size, 'all_balanced_splits' AS method, count(*) AS splits, round(avg(r), 6) AS mean_r, round(quantile_cont(r, 0.05), 6) AS q05, round(quantile_cont(r, 0.5), 6) AS median_r, round(quantile_cont(r, 0.95), 6) AS q95,
       round(avg((r > 0)::INT::DOUBLE), 6) AS share_positive, round(avg((r > 0.3)::INT::DOUBLE), 6) AS share_above FROM r GROUP BY 1, 2""")
def balanced_split_reliability(spark, d):
    """How alike the scores of two halves of six modules of components are, over all balanced splits."""
    z = statistics.zscore(components(spark, d), ["feature"], "value").select("vec_id", "feature", "z")
    f = F.col("id").cast("int")
    weights = spark.range(64).select(F.concat(F.lit("M"), (f % 6).cast("string")).alias("module"), f.alias("feature"), F.when(f % 3 == 0, -1.0).otherwise(1.0).alias("weight"))
    found = statistics.split_half(z, "vec_id", "feature", "z", weights)
    return found.select("module", "size", "method", "splits", *[F.round(c, 6).alias(c) for c in ("mean_r", "q05", "median_r", "q95", "share_positive", "share_above")])


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, count(*) OVER () AS total, p_size FROM part),
e AS (SELECT id, unnest([id * 2 % total, (id * 3 + 1) % total]) AS child FROM n WHERE p_size > 20),
walk AS (SELECT 1 AS id UNION SELECT e.child FROM walk JOIN e ON walk.id = e.id JOIN n ON e.child = n.id)
SELECT n.id::VARCHAR AS name, 'part ' || n.id AS label FROM walk JOIN n ON walk.id = n.id WHERE p_size <= 20""")
def dataset_tree_leaves(spark, d):
    """The leaves of a listing of datasets that lead to one another, and in circles, from the first one."""
    part = table(spark, d, "part")
    total = part.agg(F.count("*").alias("total"))
    listing = part.crossJoin(F.broadcast(total))  # one row
    ids = F.array((F.col("p_partkey") * 2) % F.col("total"), (F.col("p_partkey") * 3 + 1) % F.col("total"))
    children = F.when(F.col("p_size") > 20, F.transform(ids, lambda x: x.cast("string")))
    listing = listing.select(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("part "), "p_partkey").alias("label"), children.alias("children"))
    return tables.leaves(listing, "1").select("name", "label")


@query("""SELECT doc_id, quality, rep, ((row_number() OVER (PARTITION BY rep, quality ORDER BY ('0x' || substr(md5('repeat|' || rep || '|' || doc_id), 1, 8))::BIGINT, doc_id) - 1) % 5)::INT AS fold
FROM labels, (SELECT unnest(range(1, 4))::INT AS rep)""")
def repeated_stratified_folds(spark, d):
    """Three repeats of five stratified folds."""
    found = resampling.repeated_folds(table(spark, d, "labels"), "doc_id", "quality", 5, 3, "repeat")
    return found.select("doc_id", "quality", "rep", F.col("fold").cast("int").alias("fold"))


@query(f"""WITH l AS ({LONG_SQL}),
r AS (SELECT label % 2 AS family, feature, rank() OVER (PARTITION BY label % 2, feature ORDER BY value) + (count(*) OVER (PARTITION BY label % 2, feature, value) - 1) / 2.0::DOUBLE AS rx,
             rank() OVER (PARTITION BY label % 2, feature ORDER BY label) + (count(*) OVER (PARTITION BY label % 2, feature, label) - 1) / 2.0::DOUBLE AS ry FROM l),
c AS (SELECT family, feature, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1, 2),
z AS (SELECT *, abs(rho * sqrt(n - 1)) / sqrt(2.0::DOUBLE) AS x FROM c), p AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM z),
q AS (SELECT family, feature, {TAIL_SQL} AS p_value FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, feature) AS k, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (ORDER BY p_value, family, feature) AS gk, count(*) OVER () AS gm FROM q)
SELECT family, feature, round(least(1.0::DOUBLE, min(p_value * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_family,
       round(least(1.0::DOUBLE, min(p_value * gm / gk) OVER (ORDER BY gk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_global FROM k""")
def bh_families_and_global(spark, d):
    """q-values within families beside those over all tests."""
    rows = components(spark, d).withColumn("family", F.col("label") % 2)
    found = ranking.bh_adjust(statistics.spearman(rows, ["family", "feature"], "value", "label"), "p_value", ["family"], "q_family")
    both = ranking.bh_adjust(found, "p_value", out="q_global")
    return both.select("family", "feature", F.round("q_family", 6).alias("q_family"), F.round("q_global", 6).alias("q_global"))


@query("""SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS line_1, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS line_2, max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS line_3
FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1""")
def pivot_unique_lines(spark, d):
    """The quantities of an order's first three lines side by side; lines are unique, which is checked."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    wide = relational.pivot_unique(lines, "l_orderkey", "l_linenumber", "l_quantity", [1, 2, 3])
    return wide.select("l_orderkey", *[F.col(str(i)).alias(f"line_{i}") for i in (1, 2, 3)])


@query()
def oriented_module_component(spark, d):
    """The first component of twelve components as a z-score that rises with their mean."""
    rows = table(spark, d, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 12).alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    scored, share, _ = kernels.oriented_component(rows, "x", mean)
    return scored.select("vec_id", F.round("pc1", 6).alias("pc1"), F.round(F.lit(share), 6).alias("explained"))


@query()
def component_loadings(spark, d):
    """Shares of variance and loadings of the five leading components."""
    rows = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    _, axes, share = kernels.principal_components(rows, "x", 5)
    found = [(k + 1, float(share[k]), i, float(axes[i, k])) for k in range(axes.shape[1]) for i in range(len(axes))]
    return spark.createDataFrame(found, "component int, explained double, feature int, loading double")
