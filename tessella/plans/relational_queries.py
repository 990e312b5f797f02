"""Relational queries over the driver's tables: joins, de-duplication, aggregates, sets and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.operators import relational
from tessella.operators.ranking import exact_quantiles

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS p FROM orders) WHERE p = 1""")
def keep_best_order(spark, d):
    best = relational.keep_best(table(spark, d, "orders"), ["o_custkey"], [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (
  SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) = 1)""")
def keep_unique_keys(spark, d):
    return relational.keep_unique(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@query("""SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders, (n IS NOT NULL) AS has_orders, round(coalesce(spent, 0.0::DOUBLE), 2) AS spent
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def left_enrich_with_flags(spark, d):
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("spent"))
    joined = table(spark, d, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.col("n").isNotNull().alias("has_orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("""SELECT coalesce(a.k, b.k) AS nationkey, a.n AS cust_n, round(a.bal, 2) AS cust_balance, b.n AS supp_n, round(b.bal, 2) AS supp_balance,
  CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'customers' ELSE 'suppliers' END AS side
FROM (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS bal FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n, sum(s_acctbal) AS bal FROM supplier GROUP BY 1) b ON a.k = b.k""")
def full_outer_synthesis(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    both = relational.full_outer(a, b, "nationkey", "cust_", "supp_")
    return both.withColumn("side", rules.first_match([(F.col("cust_n").isNotNull() & F.col("supp_n").isNotNull(), "both"), (F.col("cust_n").isNotNull(), "customers")], "suppliers"))


@query("""SELECT c_mktsegment, count(*) AS requested, count(o) AS available, round(count(o) / count(*)::DOUBLE, 6) AS fraction
FROM (SELECT DISTINCT c_mktsegment, c_custkey FROM customer) LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_totalprice > 300000) ON c_custkey = o GROUP BY 1""")
def key_coverage(spark, d):
    have = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return relational.coverage(table(spark, d, "customer"), have, "c_custkey", "c_mktsegment").withColumn("fraction", F.round("fraction", 6))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
  AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_and_anti_join(spark, d):
    orders, key = table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")
    done = table(spark, d, "customer").join(orders.where("o_orderstatus = 'F'"), key, "left_semi")
    return done.join(orders.where("o_orderstatus = 'P'"), key, "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT p_partkey, p_size, (SELECT s FROM (VALUES (5), (10), (20), (35), (50)) t(s) ORDER BY abs(p_size - s), s LIMIT 1) AS nearest FROM part""")
def nearest_size_join(spark, d):
    return relational.nearest_join(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", [5, 10, 20, 35, 50])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price, round(stddev_samp(l_extendedprice), 4) AS sd_price,
  round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95,
  min(l_quantity) AS low, max(l_quantity) AS high, round(avg((l_discount > 0.05)::INT::DOUBLE), 6) AS discounted, count(DISTINCT l_suppkey) AS suppliers
FROM lineitem GROUP BY 1, 2""")
def group_summary_quantiles(spark, d):
    keys = ["l_returnflag", "l_linestatus"]
    q = exact_quantiles(table(spark, d, "lineitem"), keys, "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    sums = table(spark, d, "lineitem").groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("sd_price"),
        F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg((F.col("l_discount") > 0.05).cast("double")), 6).alias("discounted"), F.countDistinct("l_suppkey").alias("suppliers"),
    )
    return sums.join(q.select(*keys, *[F.round(c, 4).alias(c) for c in ("q05", "q50", "q95")]), keys)


@query("""SELECT l_linestatus, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS mean_a, round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS mean_n,
  round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS mean_r, round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS delta FROM lineitem GROUP BY 1""")
def pivot_mean_and_delta(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return wide.select("l_linestatus", *[F.round(c, 6).alias(f"mean_{c.lower()}") for c in "ANR"], F.round(F.col("R") - F.col("A"), 6).alias("delta"))


@query("""WITH p AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer),
a AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM p GROUP BY c_custkey)), b AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM p GROUP BY c_nationkey))
SELECT a.m AS right_per_left, b.m AS left_per_right,
  CASE WHEN a.m = 1 AND b.m = 1 THEN 'one_to_one' WHEN a.m = 1 THEN 'left_nested_in_right' WHEN b.m = 1 THEN 'right_nested_in_left' ELSE 'many_to_many' END AS relationship FROM a, b""")
def relationship_cardinality(spark, d):
    return relational.cardinality(table(spark, d, "customer"), "c_custkey", "c_nationkey")


@query("""SELECT 'c_custkey' AS column_name, count(c_custkey) AS non_null, count(*) - count(c_custkey) AS nulls, count(DISTINCT c_custkey) AS distinct_values FROM customer
UNION ALL SELECT 'c_name', count(c_name), count(*) - count(c_name), count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey), count(*) - count(c_nationkey), count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', count(c_acctbal), count(*) - count(c_acctbal), count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment) FROM customer""")
def column_profile(spark, d):
    return relational.profile(table(spark, d, "customer"))


@query("""WITH m AS (SELECT DISTINCT p_brand AS g, p_size AS i FROM part), s AS (SELECT g, count(*) AS n FROM m GROUP BY g)
SELECT a.g AS a, b.g AS b, count(*) AS overlap, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE, 6) AS jaccard, round(2 * count(*) / (any_value(x.n) + any_value(y.n))::DOUBLE, 6) AS f1
FROM m a JOIN m b ON a.i = b.i AND a.g < b.g JOIN s x ON x.g = a.g JOIN s y ON y.g = b.g GROUP BY 1, 2""")
def set_jaccard_f1(spark, d):
    scores = relational.set_scores(table(spark, d, "part"), "p_brand", "p_size")
    return scores.select("a", "b", "overlap", F.round("jaccard", 6).alias("jaccard"), F.round("f1", 6).alias("f1"))


@query("""WITH m AS (SELECT DISTINCT p_brand AS g, p_size AS i FROM part), s AS (SELECT g, count(*) AS n FROM m GROUP BY g),
x AS (SELECT a.g AS a, b.g AS b, count(*) AS overlap, round(2 * count(*) / (any_value(x.n) + any_value(y.n))::DOUBLE, 6) AS f1
  FROM m a JOIN m b ON a.i = b.i AND a.g < b.g JOIN s x ON x.g = a.g JOIN s y ON y.g = b.g GROUP BY 1, 2)
SELECT a, b, overlap, f1 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY f1 DESC, overlap DESC, b) AS p FROM x) WHERE p = 1""")
def best_set_match(spark, d):
    scores = relational.set_scores(table(spark, d, "part"), "p_brand", "p_size").withColumn("f1", F.round("f1", 6))
    return relational.best_match(scores, "a", [F.desc("f1"), F.desc("overlap"), F.asc("b")]).select("a", "b", "overlap", "f1")


@query("""WITH a AS (SELECT l_suppkey AS k, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_suppkey) AS p FROM lineitem GROUP BY 1),
b AS (SELECT l_suppkey AS k, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS p FROM lineitem GROUP BY 1)
SELECT k.k::INT AS k, count(*) FILTER (greatest(a.p, b.p) <= k.k) AS overlap, round(count(*) FILTER (greatest(a.p, b.p) <= k.k) / k.k::DOUBLE, 6) AS fraction
FROM a JOIN b ON a.k = b.k, (VALUES (5), (10), (25), (50)) k(k) GROUP BY k.k""")
def overlap_at_k(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))

    def place(column):
        order = [F.desc(column), F.asc("l_suppkey")]
        return items.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("l_suppkey", "place")  # 50 rows

    return relational.overlap_at(place("q"), place("n"), "l_suppkey", [5, 10, 25, 50]).withColumn("fraction", F.round("fraction", 6))


@query("""WITH t AS (SELECT p_partkey, p_retailprice, p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 20 AS is_top, p_brand = 'Brand#7' AS is_forced FROM part)
SELECT * FROM t WHERE is_top OR is_forced""")
def top_k_with_forced(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_brand")
    return relational.top_with_forced(part, 20, [F.desc("p_retailprice"), F.asc("p_partkey")], F.col("p_brand") == "Brand#7")


@query("""WITH u AS (SELECT s_nationkey AS nationkey, s_name AS name, 1 AS source_rank FROM supplier WHERE s_acctbal > 8000
  UNION ALL SELECT c_nationkey, c_name, 2 FROM customer WHERE c_acctbal > 9500)
SELECT nationkey, name, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY nationkey ORDER BY source_rank, name) AS p FROM u) WHERE p = 1""")
def union_first_wins(spark, d):
    a = table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"))
    b = table(spark, d, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"))
    return relational.union_first([a, b], ["nationkey"], [F.col("name")]).select("nationkey", "name", "source_rank")


@query("""SELECT 'intersect' AS operation, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity >= 49 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)
UNION ALL SELECT 'except', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity >= 49 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)""")
def set_operations(spark, d):
    items = table(spark, d, "lineitem")
    a, b = items.where("l_quantity >= 49").select(F.col("l_partkey").alias("k")), items.where("l_discount >= 0.1").select(F.col("l_partkey").alias("k"))
    named = lambda name, df: df.select(F.lit(name).alias("operation"), "k")
    return named("intersect", a.intersect(b)).unionByName(named("except", a.subtract(b)))


@query("""SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS dearest, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest FROM part GROUP BY 1""")
def argmax_rows(spark, d):
    by = F.struct("p_retailprice", (-F.col("p_partkey")).alias("k"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", by).alias("dearest"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"))


@query("""SELECT event_type, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def value_counts_share(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row a type


@query("""SELECT event_type, count(*) FILTER (value < 5) AS below_5, count(*) FILTER (value < 50) AS below_50, round(min(value), 6) AS least, round(avg((value > 20)::INT::DOUBLE), 6) AS above_20 FROM events GROUP BY 1""")
def conditional_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") < 5).alias("below_5"), F.count_if(F.col("value") < 50).alias("below_50"), F.round(F.min("value"), 6).alias("least"),
        F.round(F.avg((F.col("value") > 20).cast("double")), 6).alias("above_20"),
    )


@query("""SELECT s_nationkey, string_agg(DISTINCT s_name, ';' ORDER BY s_name) AS names, count(*) AS n FROM supplier GROUP BY 1""")
def delimited_aggregate(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_set("s_name")), ";").alias("names"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, round(least(l_quantity, l_tax * 100, l_discount * 100), 6) AS row_min, round((l_quantity + l_tax * 100 + l_discount * 100) / 3, 6) AS row_mean FROM lineitem""")
def row_statistics(spark, d):
    cols = [F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.least(*cols), 6).alias("row_min"), F.round((cols[0] + cols[1] + cols[2]) / 3, 6).alias("row_mean"))


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 80""")
def minimum_group_size(spark, d):
    return relational.at_least(table(spark, d, "part"), ["p_brand"], 80).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""SELECT l_suppkey, round(avg((l_discount > 0)::INT::DOUBLE), 6) AS detected FROM lineitem GROUP BY 1 HAVING avg((l_discount > 0)::INT::DOUBLE) >= 0.9""")
def detection_filter(spark, d):
    shares = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg((F.col("l_discount") > 0).cast("double")).alias("detected"))
    return shares.where("detected >= 0.9").select("l_suppkey", F.round("detected", 6).alias("detected"))


@query("""WITH t AS (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1), m AS (SELECT quantile_cont(total, 0.5) AS mid FROM t)
SELECT l_orderkey, total, total < 0.1 * mid AS low_depth FROM t, m""")
def low_depth_flag(spark, d):
    totals = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    mid = exact_quantiles(totals, [], "total", {"mid": 0.5})
    return totals.crossJoin(F.broadcast(mid)).select("l_orderkey", "total", (F.col("total") < 0.1 * F.col("mid")).alias("low_depth"))  # one row


@query("""SELECT o_orderkey, days, CASE WHEN dead AND days <= 365 THEN 1 WHEN days >= 365 THEN 0 END AS by_year, CASE WHEN o_totalprice - 200000 < 0 THEN -1 ELSE 1 END AS side
FROM (SELECT o_orderkey, o_totalprice, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 1500 AS days, o_orderstatus = 'F' AS dead FROM orders)""")
def horizon_labels(spark, d):
    days = F.expr("cast(datediff(cast(o_orderdate AS date), date'1995-01-01') % 1500 AS bigint)")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", days.alias("days"), (F.col("o_orderstatus") == "F").alias("dead"))
    return rows.select("o_orderkey", "days", rules.within(F.col("days"), F.col("dead"), 365).alias("by_year"), rules.sign(F.col("o_totalprice") - 200000).alias("side"))


@query("""SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS segment_BUILDING, (c_mktsegment = 'FURNITURE')::INT AS segment_FURNITURE, (c_mktsegment = 'HOUSEHOLD')::INT AS segment_HOUSEHOLD, (c_mktsegment = 'MACHINERY')::INT AS segment_MACHINERY FROM customer""")
def one_hot_levels(spark, d):
    # Levels of the training vocabulary; AUTOMOBILE is the one left out.
    train = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return table(spark, d, "customer").select("c_custkey", *rules.levels(F.col("c_mktsegment"), train, "segment"))


@query("""SELECT p_brand, points, CASE WHEN points >= 5 THEN 'strong' WHEN points >= 3 THEN 'partial' WHEN points >= 1 THEN 'weak' ELSE 'none' END AS tier FROM (
  SELECT p_brand, (CASE WHEN avg(p_retailprice) > 1000 THEN 3 ELSE 0 END + CASE WHEN count(*) > 80 THEN 2 ELSE 0 END + CASE WHEN min(p_size) = 1 THEN 1 ELSE 0 END)::INT AS points FROM part GROUP BY 1)""")
def evidence_tiers(spark, d):
    sums = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"), F.count("*").alias("n"), F.min("p_size").alias("least"))
    scored = sums.withColumn("points", rules.points([(F.col("price") > 1000, 3), (F.col("n") > 80, 2), (F.col("least") == 1, 1)]))
    tier = rules.first_match([(F.col("points") >= 5, "strong"), (F.col("points") >= 3, "partial"), (F.col("points") >= 1, "weak")], "none")
    return scored.select("p_brand", "points", tier.alias("tier"))


@query("""WITH f AS (SELECT p_partkey, p_brand, p_partkey % 5 AS fold, p_retailprice FROM part),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p_retailprice DESC, p_partkey) AS p FROM f) WHERE p <= 40)
SELECT p_brand, count(DISTINCT fold) AS folds, round(count(DISTINCT fold) / 5.0::DOUBLE, 6) AS frequency, round(avg(p), 6) AS mean_rank FROM t GROUP BY 1""")
def selection_frequency(spark, d):
    rows = table(spark, d, "part").withColumn("fold", F.col("p_partkey") % 5)
    top = rows.withColumn("p", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("p <= 40")
    return top.groupBy("p_brand").agg(F.countDistinct("fold").alias("folds"), F.round(F.countDistinct("fold") / 5.0, 6).alias("frequency"), F.round(F.avg("p"), 6).alias("mean_rank"))


@query("""SELECT c_custkey, coalesce(n.b, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS b FROM orders WHERE o_totalprice > 450000 GROUP BY 1) n ON c_custkey = o_custkey""")
def upsert_columns(spark, d):
    news = table(spark, d, "orders").where("o_totalprice > 450000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return relational.upsert(table(spark, d, "customer").select("c_custkey", "c_acctbal"), news, "c_custkey", ["c_acctbal"])


@query("""SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1""")
def collapse_duplicates(spark, d):
    return relational.collapse(table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity")), ["l_orderkey"], "quantity", "sum")
