"""Queries that clean, classify and parse text and nested values, and check provenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import rules, text
from tessella.operators import relational
from tessella.plans.relational_queries import table
from tessella.sources import tables

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


@query(r"""SELECT c_custkey, regexp_replace(replace(c_name, '#', '_'), '_[0-9]+$', '') AS without_suffix, upper(regexp_replace(c_name || ' [x]', '[\s\[\]]', '', 'g')) AS normal_id,
  regexp_replace(nullif(regexp_extract(c_name, '([0-9]+)', 1), ''), '^0+([0-9])', '\1') AS number, trim(coalesce(nullif(regexp_extract('gene [' || c_mktsegment || ']', '\[([^\]]+)\]', 1), ''), c_mktsegment)) AS bracketed FROM customer""")
def identifier_cleaning(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select(
        "c_custkey", text.without_suffix(F.replace(name, F.lit("#"), F.lit("_"))).alias("without_suffix"), text.normal_id(F.concat(name, F.lit(" [x]"))).alias("normal_id"),
        text.first_number(name).alias("number"), text.bracketed(F.concat(F.lit("gene ["), "c_mktsegment", F.lit("]"))).alias("bracketed"),
    )


@query(r"""WITH p AS (SELECT p_partkey, list_distinct(list_filter(list_transform(string_split_regex(p_brand || CASE WHEN p_size % 2 = 0 THEN ' /// ' || p_type ELSE ' ; ' || p_brand END, '///|//|;|,'), lambda x: trim(x)), lambda x: x <> '')) AS parts FROM part)
SELECT p_partkey, CASE WHEN len(parts) = 1 AND NOT contains(parts[1], ' ') THEN parts[1] END AS symbol FROM p""")
def unambiguous_symbol(spark, d):
    both = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" /// "), "p_type")).otherwise(F.concat(F.lit(" ; "), "p_brand")))
    return table(spark, d, "part").select("p_partkey", text.only_symbol(both).alias("symbol"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(url), 'example\.org') THEN 'org' WHEN regexp_matches(lower(url), '/(en|fr)/') THEN 'western' WHEN regexp_matches(lower(url), '[?&]page=') THEN 'paged' ELSE 'other' END AS class,
  (contains(html, '<script') OR contains(html, '<style')) AS has_code FROM pages""")
def regex_classification(spark, d):
    patterns = [(r"example\.org", "org"), ("/(en|fr)/", "western"), ("[?&]page=", "paged")]
    return table(spark, d, "pages").select("page_id", text.classify(F.col("url"), patterns, "other").alias("class"), (F.contains("html", F.lit("<script")) | F.contains("html", F.lit("<style"))).alias("has_code"))


@query(r"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN l_discount::VARCHAR WHEN 1 THEN (l_quantity::INT)::VARCHAR || '%' WHEN 2 THEN (l_quantity::INT)::VARCHAR || ' - ' || (l_quantity::INT + 10)::VARCHAR ELSE 'n/a' END AS t FROM lineitem),
v AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '^\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS lo, TRY_CAST(nullif(regexp_extract(t, '^\s*[0-9]+(?:\.[0-9]+)?\s*-\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS hi FROM x),
w AS (SELECT *, CASE WHEN hi IS NOT NULL THEN (lo + hi) / 2 ELSE lo END AS m FROM v),
s AS (SELECT *, CASE WHEN m <= 1 AND NOT contains(t, '%') THEN m * 100 ELSE m END AS k FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN k >= 0 AND k <= 100 THEN k END, 6) AS percent FROM s""")
def percent_parsing(spark, d):
    q = F.col("l_quantity").cast("int")
    said = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'p' WHEN 2 THEN 'r' ELSE 'n' END")
    t = F.when(said == "d", F.col("l_discount").cast("string")).when(said == "p", F.concat(q.cast("string"), F.lit("%"))).when(said == "r", F.concat(q.cast("string"), F.lit(" - "), (q + 10).cast("string"))).otherwise("n/a")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(text.percent(t), 6).alias("percent"))


@query(r"""SELECT event_type, count(*) AS n, min(k) AS least, max(k) AS most, round(avg(k), 6) AS mean, count(*) FILTER (k IS NULL) AS missing FROM (SELECT event_type, (props::JSON ->> '$.k')::BIGINT AS k FROM events) GROUP BY 1""")
def json_property_summary(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    rows = table(spark, d, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"), F.count_if(F.col("k").isNull()).alias("missing"))


@query(r"""SELECT user_id, max(ts_days) AS last_day, min(v) AS least, max(v) AS most, count(*) AS n, bool_or(event_type = 'error') AS any_error
FROM (SELECT user_id, event_type, value AS v, date_diff('day', DATE '2024-01-01', ts::DATE) AS ts_days FROM events) GROUP BY 1""")
def nested_case_endpoint(spark, d):
    # A case's nested records reduced as they are read: sums by user meet in the shuffle, no user's events are gathered.
    day = F.expr("cast(datediff(cast(ts AS date), date'2024-01-01') AS bigint)")
    return table(spark, d, "events").groupBy("user_id").agg(
        F.max(day).alias("last_day"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("any_error"),
    )


@query(r"""SELECT role, count(*) AS n, round(avg(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))), 6) AS mean_words, max(length(text)) AS longest FROM conversations GROUP BY 1""")
def conversation_profile(spark, d):
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(words), 6).alias("mean_words"), F.max(F.length("text")).cast("long").alias("longest"))


@query(r"""SELECT event_id, round(log2(value + 1), 6) AS log2_value, round(ln(value + 1), 6) AS log_value, round(sqrt(value), 6) AS root, round(greatest(least(value, 50.0::DOUBLE), 1.0::DOUBLE), 6) AS clipped, round(value * 30.4375, 6) AS days, round(value / 365.25, 6) AS years FROM events""")
def scalar_mathematics(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select(
        "event_id", F.round(F.log2(v + 1), 6).alias("log2_value"), F.round(F.log1p(v), 6).alias("log_value"), F.round(F.sqrt(v), 6).alias("root"),
        F.round(F.greatest(F.least(v, F.lit(50.0)), F.lit(1.0)), 6).alias("clipped"), F.round(v * 30.4375, 6).alias("days"), F.round(v / 365.25, 6).alias("years"),
    )


@query(r"""SELECT item_id, sha256(text) AS sha256, md5(text) AS md5, length(text) AS n_chars FROM benchmark""")
def content_hashes(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.length("text").cast("long").alias("n_chars"))


@query(r"""SELECT b.item_id, CASE WHEN b.item_id % 11 = 0 THEN 'missing' WHEN b.item_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS status FROM benchmark b""")
def manifest_verification(spark, d):
    rows = table(spark, d, "benchmark")
    expected = rows.select("item_id", F.sha2("text", 256).alias("sha256"))
    found = rows.where("item_id % 11 <> 0").select(F.col("item_id").alias("name"), F.sha2(F.concat("text", F.when(F.col("item_id") % 7 == 0, "!").otherwise("")), 256).alias("sha256"))
    return tables.verify(found, expected.select(F.col("item_id").alias("name"), "sha256")).select(F.col("name").alias("item_id"), "status")


@query(r"""SELECT o_orderpriority AS unit, count(*) AS n, count(DISTINCT o_orderstatus) AS statuses, count(*) > 0 AND count(DISTINCT o_orderstatus) = 3 AS passed FROM orders GROUP BY 1""")
def cardinality_checks(spark, d):
    orders = relational.require_columns(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"])
    found = orders.groupBy(F.col("o_orderpriority").alias("unit")).agg(F.count("*").alias("n"), F.countDistinct("o_orderstatus").alias("statuses"))
    return found.withColumn("passed", (F.col("n") > 0) & (F.col("statuses") == 3))


@query(r"""WITH g AS (SELECT source, count(*) AS n, stddev_samp(n_chars) AS sd FROM documents GROUP BY 1)
SELECT source, n, CASE WHEN n < 30 THEN 'too_few_rows' WHEN sd IS NULL OR sd = 0 THEN 'no_spread' ELSE 'estimable' END AS status, CASE WHEN n >= 30 AND sd > 0 THEN round(sd, 4) END AS sd FROM g""")
def estimability_gate(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.stddev_samp("n_chars").alias("s"))
    status = rules.first_match([(F.col("n") < 30, "too_few_rows"), (F.col("s").isNull() | (F.col("s") == 0), "no_spread")], "estimable")
    return g.select("source", "n", status.alias("status"), F.when((F.col("n") >= 30) & (F.col("s") > 0), F.round("s", 4)).alias("sd"))


@query(r"""SELECT p_partkey, CASE WHEN p < 0.001 THEN printf('%.2e', p) ELSE printf('%.3f', p) END AS p_text FROM (SELECT p_partkey, exp(-p_size::DOUBLE / 4) AS p FROM part)""")
def p_value_text(spark, d):
    p = F.exp(-F.col("p_size").cast("double") / 4)
    return table(spark, d, "part").select("p_partkey", text.p_text(p).alias("p_text"))
