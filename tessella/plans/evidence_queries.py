"""Queries that build evidence tables from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import rules, text
from tessella.operators import evidence, relational
from tessella.operators.ranking import exact_quantiles
from tessella.plans.relational_queries import table

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


@query("""WITH t AS (SELECT DISTINCT p_size // 5 AS bin FROM part WHERE p_brand = 'Brand#13'),
p AS (SELECT p_size // 5 AS pool_bin, count(*) AS pool_size FROM part WHERE p_brand <> 'Brand#13' AND p_type = 'ECONOMY' GROUP BY 1 HAVING count(*) >= 5),
r AS (SELECT bin, pool_bin, pool_size, row_number() OVER (PARTITION BY bin ORDER BY abs(pool_bin - bin), pool_bin) AS place FROM t LEFT JOIN p ON true)
SELECT bin::INT AS bin, pool_bin::INT AS pool_bin, pool_size FROM r WHERE place = 1""")
def nearest_bin_pool(spark, d):
    part = table(spark, d, "part").withColumn("bin", F.expr("cast(p_size div 5 AS int)"))
    return evidence.fallback_bins(part.where("p_brand = 'Brand#13'"), part.where("p_brand <> 'Brand#13' AND p_type = 'ECONOMY'"), "bin", 5)


@query("""WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 48), c AS (SELECT l_partkey, count(*) AS n FROM m GROUP BY 1)
SELECT p_partkey, m.l_suppkey, coalesce(c.n, 0)::BIGINT AS n_mapped, CASE WHEN c.n = 1 THEN 'one_to_one' WHEN c.n > 1 THEN 'one_to_many' ELSE 'not_found' END AS status
FROM part LEFT JOIN m ON p_partkey = m.l_partkey LEFT JOIN c ON p_partkey = c.l_partkey""")
def mapping_join_status(spark, d):
    mapping = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return evidence.map_with_status(table(spark, d, "part").select("p_partkey"), mapping, "p_partkey", "l_suppkey")


@query("""WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 48), c AS (SELECT l_partkey, count(*) AS n FROM m GROUP BY 1),
g AS (SELECT p_brand AS module, count(*) AS requested, count(c.n) AS mapped, count(*) FILTER (c.n = 1) AS one_to_one FROM part LEFT JOIN c ON p_partkey = l_partkey GROUP BY 1)
SELECT module, requested, mapped, one_to_one, round(mapped / requested::DOUBLE, 6) AS fraction,
  CASE WHEN mapped >= 3 AND mapped / requested::DOUBLE >= 0.8 THEN 'primary' WHEN mapped >= 3 AND mapped / requested::DOUBLE >= 0.5 THEN 'secondary' ELSE 'not_transferable' END AS tier FROM g""")
def transfer_rollup(spark, d):
    mapping = table(spark, d, "lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n"))
    joined = table(spark, d, "part").join(mapping, "p_partkey", "left")
    g = joined.groupBy(F.col("p_brand").alias("module")).agg(F.count("*").alias("requested"), F.count("n").alias("mapped"), F.count_if(F.col("n") == 1).alias("one_to_one"))
    share, enough = F.col("mapped") / F.col("requested"), F.col("mapped") >= 3
    tier = rules.first_match([(enough & (share >= 0.8), "primary"), (enough & (share >= 0.5), "secondary")], "not_transferable")
    return g.select("module", "requested", "mapped", "one_to_one", F.round(share, 6).alias("fraction"), tier.alias("tier"))


@query("""SELECT user_id % 20 AS unit, event_type AS kind, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1, 2 HAVING count(*) >= 5""")
def pseudobulk_units(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("unit"), F.col("event_type").alias("kind"), "value")
    sums = rows.groupBy("unit", "kind").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).where("n >= 5")
    return sums.join(exact_quantiles(rows, ["unit", "kind"], "value", {"median": 0.5}), ["unit", "kind"]).withColumn("median", F.round("median", 6))


@query("""SELECT p_partkey, least(floor(row_number() OVER (ORDER BY p_retailprice, p_partkey) / (count(*) OVER ())::DOUBLE * 10), 9)::INT AS bin FROM part""")
def variance_bins(spark, d):
    return evidence.first_rank_bins(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 10).select("p_partkey", "bin")


@query("""WITH o(status, place) AS (VALUES ('P', 1), ('O', 2), ('F', 3))
SELECT place, o_orderstatus AS status, count(*) AS n FROM orders JOIN o ON o_orderstatus = status GROUP BY 1, 2 ORDER BY place""")
def custom_category_order(spark, d):
    order = spark.createDataFrame([("P", 1), ("O", 2), ("F", 3)], "status string, place int")
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(order), "status").select("place", "status", "n").orderBy("place")  # three rows


@query("""SELECT c_nationkey, count(*) AS complete FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS most, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS pending FROM orders GROUP BY 1) o ON c_custkey = o_custkey
WHERE most IS NOT NULL AND pending IS NOT NULL GROUP BY 1""")
def complete_case_counts(spark, d):
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("pending"))
    joined = table(spark, d, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return evidence.complete_cases(joined, ["most", "pending"]).groupBy("c_nationkey").agg(F.count("*").alias("complete"))


@query("""SELECT * FROM (SELECT 'c_mktsegment' AS column_name, count(c_mktsegment) AS n, round(avg((c_mktsegment IN ('FURNITURE', 'BUILDING'))::INT::DOUBLE), 6) AS score FROM customer
UNION ALL SELECT 'c_name', count(c_name), round(avg((c_name IN ('FURNITURE', 'BUILDING'))::INT::DOUBLE), 6) FROM customer)""")
def column_by_contents(spark, d):
    found = evidence.column_scores(table(spark, d, "customer"), ["c_name", "c_mktsegment"], known=["FURNITURE", "BUILDING"])
    return found.withColumn("score", F.round("score", 6))


@query("""SELECT o_orderkey, o_orderpriority, 'none' AS comment, 1.0::DOUBLE AS weight FROM orders""")
def defaults_for_missing_columns(spark, d):
    orders = table(spark, d, "orders")
    priority = evidence.resolve_column(orders.columns, ["order priority", "priority"])
    return evidence.with_defaults(orders.select("o_orderkey", F.col(priority).alias("o_orderpriority")), {"comment": "none", "weight": 1.0})


@query(r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ENSG000' || p_partkey || '.' || p_size WHEN 1 THEN ' ' || lower(p_type) || ' ' ELSE p_name || ' / ' || p_brand END AS t FROM part),
y AS (SELECT *, regexp_extract(t, '^\s*(ENS[A-Z]*[GTP][0-9]+)(?:\.[0-9]+)?\s*$', 1) AS e, regexp_extract(t, '^\s*([A-Za-z][A-Za-z0-9.-]*)\s*$', 1) AS s FROM x)
SELECT p_partkey, CASE WHEN e <> '' THEN 'ensembl' WHEN s <> '' THEN 'symbol' ELSE 'raw' END AS kind, CASE WHEN e <> '' THEN e WHEN s <> '' THEN upper(s) ELSE t END AS id,
  regexp_matches(t, '^(?:LOC|ENS|CFA)') AS placeholder, regexp_replace(nullif(regexp_extract(t, '([0-9]+)[^0-9]*$', 1), ''), '^0+([0-9])', '\1') AS last_number FROM y""")
def identifier_schemes(spark, d):
    t = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('ENSG000', p_partkey, '.', p_size) WHEN 1 THEN concat(' ', lower(p_type), ' ') ELSE concat(p_name, ' / ', p_brand) END")
    own = text.identifier(t)
    return table(spark, d, "part").select("p_partkey", own["kind"].alias("kind"), own["id"].alias("id"), text.is_placeholder(t).alias("placeholder"), text.last_number(t).alias("last_number"))


@query(r"""WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'time: ' || event_id ELSE 'Event: ' || (event_type = 'error')::INT || '; TIME = ' || event_id || '.5' END AS t FROM events)
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id + 0.5::DOUBLE END AS time, CASE WHEN event_id % 5 <> 0 THEN regexp_extract(lower(t), 'event\s*[:=]\s*([01])', 1)::INT END AS event FROM x""")
def time_event_extraction(spark, d):
    said = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("time: "), "event_id")).otherwise(F.concat(F.lit("Event: "), (F.col("event_type") == "error").cast("int"), F.lit("; TIME = "), "event_id", F.lit(".5")))
    own = text.time_and_event(said)
    return table(spark, d, "events").select("event_id", own["time"].alias("time"), own["event"].alias("event"))


@query("""SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal AS balance, s_name AS first_filled, greatest(s_nationkey, s_suppkey)::DOUBLE AS largest,
  s_suppkey || ' | nan | ' || s_name AS row_text, CASE s_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 9 END AS priority FROM supplier""")
def list_parsing(spark, d):
    s = table(spark, d, "supplier")
    said = text.pairs(F.concat_ws("; ", F.concat(F.lit("nation: "), "s_nationkey"), F.concat(F.lit("balance:"), "s_acctbal"), F.lit("none:x")))
    names = F.array(F.lit("NA"), F.lit(None).cast("string"), F.lit(" "), F.col("s_name"))
    numbers = F.array(F.col("s_nationkey").cast("string"), F.lit("x"), F.col("s_suppkey").cast("string"))
    order = F.create_map(F.lit(0), F.lit(1), F.lit(1), F.lit(2))
    return s.select(
        "s_suppkey", said["nation"].alias("nation"), said["balance"].alias("balance"), text.first_filled(names).alias("first_filled"), text.largest_number(numbers).alias("largest"),
        text.row_text([F.col("s_suppkey"), F.lit(None), F.col("s_name")]).alias("row_text"), F.coalesce(F.try_element_at(order, F.col("s_nationkey") % 3), F.lit(9)).alias("priority"),
    )


@query("""WITH s AS (SELECT min(value) AS a, max(value) AS z, quantile_cont(value, 0.5) AS m FROM events)
SELECT event_id, round(CASE WHEN a >= 0 AND (z > 50 OR m > 10) THEN log2(value + 1) ELSE value END, 6) AS scaled FROM events, s""")
def automatic_log_transform(spark, d):
    events = table(spark, d, "events")
    a, z = events.agg(F.min("value"), F.max("value")).first()
    m = exact_quantiles(events, [], "value", {"m": 0.5}).first()
    return evidence.automatic_log(events.select("event_id", "value"), "value", "scaled", m["m"] if m else None, a, z).select("event_id", F.round("scaled", 6).alias("scaled"))


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus = 'F' AS a, o_orderpriority LIKE '1%' AS b, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days FROM orders)
SELECT o_orderkey, (a OR b) AS event, CASE WHEN a THEN days WHEN b THEN days + 60 ELSE days + 60 END AS time FROM c""")
def nested_vital_endpoint(spark, d):
    """Cases as nested JSON documents, parsed to an event and a time: the day of death, else the last follow-up."""
    days = F.expr("cast(datediff(cast(o_orderdate AS date), date'1992-01-01') AS int)")
    visit = lambda vital, day: F.struct(vital.alias("vital"), day.alias("days"))
    later = F.when(F.col("o_orderpriority").startswith("1"), "F").otherwise("P")
    cases = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.array(visit(F.col("o_orderstatus"), days), visit(F.lit("O"), days - 30), visit(later, days + 60)).alias("visits"))).alias("case"))
    return cases.select("o_orderkey", *text.vital_endpoint(F.from_json("case", "visits array<struct<vital: string, days: int>>")["visits"], "F"))


@query("""SELECT event_id, array_to_string(list_sort(list_distinct([event_type, CASE WHEN event_id % 2 = 0 THEN 'tumor' ELSE event_type END, CASE WHEN event_id % 3 = 0 THEN 'normal' ELSE event_type END])), ';') AS kinds,
  event_id % 2 = 0 AS has_tumor, 3 AS samples FROM events""")
def file_hit_metadata(spark, d):
    """Nested hits flattened: the sorted distinct kinds of their samples and whether one is a tumor."""
    kind = lambda by, name: F.struct(F.when(F.col("event_id") % by == 0, name).otherwise(F.col("event_type")).alias("type"))
    hits = table(spark, d, "events").select("event_id", F.to_json(F.array(F.struct(F.col("event_type").alias("type")), kind(2, "tumor"), kind(3, "normal"))).alias("hit"))
    kinds = F.transform(F.from_json("hit", "array<struct<type: string>>"), lambda h: h["type"])
    return hits.select("event_id", F.array_join(F.array_sort(F.array_distinct(kinds)), ";").alias("kinds"), F.exists(kinds, lambda k: k == "tumor").alias("has_tumor"), F.size(kinds).alias("samples"))


@query("""WITH v AS (SELECT l_partkey, l_suppkey, count(*) AS n, coalesce(var_samp(l_extendedprice), -1.0::DOUBLE) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY round(v, 4) DESC, l_suppkey) AS p FROM v) WHERE p = 1""")
def max_variance_pick(spark, d):
    stats = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.coalesce(F.var_samp("l_extendedprice"), F.lit(-1.0)).alias("v"))
    return evidence.pick(stats, "l_partkey", "l_suppkey", [-F.round("v", 4)]).select("l_partkey", "l_suppkey", "n")


@query("""WITH s AS (SELECT l_partkey AS gene, l_suppkey AS probe, count(*) AS n, avg((l_quantity > 10)::INT::DOUBLE) AS detected, round(coalesce(var_samp(l_extendedprice), -1.0::DOUBLE), 4) AS v FROM lineitem GROUP BY 1, 2),
k(strategy, least) AS (VALUES ('max_variance', 0.0), ('detected_50', 0.5), ('detected_80', 0.8)),
a AS (SELECT strategy, gene, probe, row_number() OVER (PARTITION BY strategy, gene ORDER BY v DESC, probe) AS p FROM s JOIN k ON detected >= least),
b AS (SELECT 'best_detected' AS strategy, gene, probe, row_number() OVER (PARTITION BY gene ORDER BY detected DESC, v DESC, probe) AS p FROM s)
SELECT strategy, count(*) AS genes, sum(probe)::BIGINT AS probes FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE p = 1 GROUP BY 1""")
def probe_strategies(spark, d):
    stats = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("probe")).agg(F.avg((F.col("l_quantity") > 10).cast("double")).alias("detected"), F.round(F.coalesce(F.var_samp("l_extendedprice"), F.lit(-1.0)), 4).alias("v"))
    by = [-F.col("v")]
    found = [evidence.pick(stats.where(F.col("detected") >= least), "gene", "probe", by).withColumn("strategy", F.lit(name)) for name, least in (("max_variance", 0.0), ("detected_50", 0.5), ("detected_80", 0.8))]
    found.append(evidence.pick(stats, "gene", "probe", [-F.col("detected"), *by]).withColumn("strategy", F.lit("best_detected")))
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    return both.groupBy("strategy").agg(F.count("*").alias("genes"), F.sum("probe").alias("probes"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(list_sort([l_discount, l_tax, l_quantity / 100])[2], 6) AS median FROM lineitem""")
def row_median(spark, d):
    values = F.array_sort(F.array("l_discount", "l_tax", F.col("l_quantity") / 100))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.get(values, F.lit(1)), 6).alias("median"))


@query("""SELECT * FROM (SELECT 's_suppkey' AS column_name, min(s_suppkey::VARCHAR) AS least, max(s_suppkey::VARCHAR) AS greatest, count(DISTINCT s_suppkey) = count(s_suppkey) AS is_key, count(DISTINCT s_suppkey) <= 10 AS is_category, true AS is_number FROM supplier
UNION ALL SELECT 's_name', min(s_name), max(s_name), count(DISTINCT s_name) = count(s_name), count(DISTINCT s_name) <= 10, false FROM supplier
UNION ALL SELECT 's_nationkey', min(s_nationkey::VARCHAR), max(s_nationkey::VARCHAR), count(DISTINCT s_nationkey) = count(s_nationkey), count(DISTINCT s_nationkey) <= 10, true FROM supplier)""")
def column_roles(spark, d):
    return evidence.roles(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query("""WITH m AS (SELECT DISTINCT p_brand AS g, p_size AS i FROM part), s AS (SELECT g, count(*) AS n FROM m GROUP BY 1),
o AS (SELECT a.g AS a, b.g AS b, count(*) AS overlap FROM m a JOIN m b ON a.i = b.i AND a.g < b.g GROUP BY 1, 2)
SELECT a, b, overlap, round(overlap / x.n::DOUBLE, 6) AS recall, round(overlap / y.n::DOUBLE, 6) AS precision FROM o JOIN s x ON a = x.g JOIN s y ON b = y.g""")
def set_recall_precision(spark, d):
    scores = relational.set_scores(table(spark, d, "part").select("p_brand", "p_size"), "p_brand", "p_size")
    return scores.select("a", "b", "overlap", F.round(F.col("overlap") / F.col("size_a"), 6).alias("recall"), F.round(F.col("overlap") / F.col("size_b"), 6).alias("precision"))


@query("""WITH s AS (SELECT l_partkey AS k, round(avg(l_discount) - 0.05, 9) AS x, round(avg(l_tax) - 0.04, 9) AS y FROM lineitem GROUP BY 1),
r AS (SELECT k, x, y, row_number() OVER (ORDER BY abs(x) DESC, k) AS a, row_number() OVER (ORDER BY abs(y) DESC, k) AS b FROM s),
t AS (SELECT unnest([20, 50, 100]) AS top)
SELECT top, count(*) FILTER (a <= top AND b <= top) AS overlap, count(*) FILTER (a <= top AND b <= top AND (x < 0) = (y < 0)) AS same_direction FROM r, t GROUP BY 1""")
def overlap_direction(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.round(F.avg("l_discount") - 0.05, 9).alias("x"), F.round(F.avg("l_tax") - 0.04, 9).alias("y"))
    ks = (20, 50, 100)
    top = lambda c: s.orderBy(F.desc(F.abs(F.col(c))), "k").limit(ks[-1])
    place = lambda c, out: top(c).groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.abs(F.col(c))).alias("o"), "k", c))).alias("l")).select(F.posexplode("l").alias("p", "e")).select(F.col("e.k").alias("k"), (F.col("p") + 1).alias(out), F.col(f"e.{c}").alias(c))  # noqa: E731  # at most the largest k
    both = place("x", "a").join(place("y", "b"), "k")
    inside = lambda k: (F.col("a") <= k) & (F.col("b") <= k)
    same = (F.col("x") < 0) == (F.col("y") < 0)
    one = both.agg(*[f for k in ks for f in (F.count_if(inside(k)).alias(f"o{k}"), F.count_if(inside(k) & same).alias(f"s{k}"))])
    return one.selectExpr(f"stack({len(ks)}, " + ", ".join(f"{k}, o{k}, s{k}" for k in ks) + ") AS (top, overlap, same_direction)")


@query("""WITH k AS (SELECT n_nationkey AS nation FROM nation), s AS (SELECT s_nationkey AS nation, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY 1)
SELECT k.nation, coalesce(n, 0)::BIGINT AS n, coalesce(balance, 0.0::DOUBLE) AS balance FROM k LEFT JOIN s ON k.nation = s.nation""")
def reindexed_balances(spark, d):
    sums = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
    return evidence.reindex(sums, table(spark, d, "nation").select(F.col("n_nationkey").alias("nation")), "nation", {"n": 0, "balance": 0.0})


@query("""SELECT coalesce(a.k, b.k, c.k)::BIGINT AS part, a.n AS small, b.n AS large, c.n AS returned FROM (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity < 3 GROUP BY 1) a
FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) b ON a.k = b.k FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 5 GROUP BY 1) c ON c.k = coalesce(a.k, b.k)""")
def concat_on_keys(spark, d):
    rows = table(spark, d, "lineitem")
    count = lambda where: rows.where(where).groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return evidence.concat_on_key({"small": count("l_quantity < 3"), "large": count("l_quantity > 48"), "returned": count("l_returnflag = 'R' AND l_quantity < 5")}, "part", "n")


@query("""WITH g AS (SELECT source, count(*) AS n, avg(n_chars) AS m, stddev_samp(n_chars) AS sd, avg((lang = 'en')::INT::DOUBLE) AS en FROM documents GROUP BY 1),
c AS (SELECT *, CASE WHEN sd IS NULL THEN 'not_estimable' WHEN sd < 0.5 * m THEN 'stable' WHEN sd < m THEN 'intermediate' ELSE 'unstable' END AS stability, CASE WHEN en >= 0.75 THEN 'uniform' WHEN en >= 0.4 THEN 'mixed' ELSE 'diverse' END AS structure FROM g)
SELECT source, stability, structure, CASE WHEN stability = 'stable' AND structure = 'uniform' THEN 'preserved' WHEN stability = 'unstable' AND structure = 'diverse' THEN 'lost' ELSE 'partial' END AS joint,
  CASE WHEN n >= 50 AND stability <> 'unstable' THEN 'A' WHEN n >= 10 THEN 'B' ELSE 'C' END AS grade FROM c""")
def structure_typology(spark, d):
    """Stability, structure, their joint class and an evidence grade, each by ordered rules."""
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"), F.stddev_samp("n_chars").alias("sd"), F.avg((F.col("lang") == "en").cast("double")).alias("en"))
    c, x = F.col, F.col("sd")
    g = g.withColumn("stability", rules.first_match([(x.isNull(), "not_estimable"), (x < 0.5 * c("m"), "stable"), (x < c("m"), "intermediate")], "unstable"))
    g = g.withColumn("structure", rules.first_match([(c("en") >= 0.75, "uniform"), (c("en") >= 0.4, "mixed")], "diverse"))
    joint = rules.first_match([((c("stability") == "stable") & (c("structure") == "uniform"), "preserved"), ((c("stability") == "unstable") & (c("structure") == "diverse"), "lost")], "partial")
    grade = rules.first_match([((c("n") >= 50) & (c("stability") != "unstable"), "A"), (c("n") >= 10, "B")], "C")
    return g.select("source", "stability", "structure", joint.alias("joint"), grade.alias("grade"))


@query("""WITH a AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1), e(status, least, most) AS (VALUES ('F', 1, 1000000000), ('O', 1, 1000000000), ('P', 1, 1000000000), ('X', 0, 0))
SELECT e.status, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) BETWEEN least AND most AS holds FROM e LEFT JOIN a ON a.status = e.status""")
def expected_results(spark, d):
    """Whether counts lie where a fixed account says they do; a caller stops where one doesn't hold."""
    expected = spark.createDataFrame([("F", 1, 10**9), ("O", 1, 10**9), ("P", 1, 10**9), ("X", 0, 0)], "status string, least long, most long")
    found = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    joined = expected.join(found, "status", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return joined.select("status", "n", F.col("n").between(F.col("least"), F.col("most")).alias("holds"))


@query("""WITH x AS (SELECT o_orderpriority AS grp, o_totalprice AS age, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'Male' ELSE 'female' END AS sex, o_orderkey FROM orders),
g AS (SELECT grp, count(age) >= 50 AND count(DISTINCT age) >= 5 AS has_age, avg(age) AS m, stddev_samp(age) AS sd, count(sex) >= 50 AND count(DISTINCT lower(sex)) = 2 AS has_sex FROM x GROUP BY 1)
SELECT o_orderkey, CASE WHEN has_age THEN round((age - m) / sd, 6) END AS age_z, CASE WHEN has_sex THEN CASE lower(sex) WHEN 'male' THEN 1 WHEN 'female' THEN 0 END END AS male FROM x JOIN g ON x.grp = g.grp""")
def covariate_preparation(spark, d):
    """Standardised ages and a map of sexes, each omitted where a group has too few of them."""
    sex = F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 3 == 1, "Male").otherwise("female")
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("age"), sex.alias("sex"))
    g = x.groupBy("grp").agg(((F.count("age") >= 50) & (F.countDistinct("age") >= 5)).alias("has_age"), F.avg("age").alias("m"), F.stddev_samp("age").alias("sd"), ((F.count("sex") >= 50) & (F.countDistinct(F.lower("sex")) == 2)).alias("has_sex"))
    male = F.when(F.lower("sex") == "male", 1).when(F.lower("sex") == "female", 0)
    return x.join(g, "grp").select("o_orderkey", F.when(F.col("has_age"), F.round(F.try_divide(F.col("age") - F.col("m"), F.col("sd")), 6)).alias("age_z"), F.when(F.col("has_sex"), male).alias("male"))
