"""Mixing against a plain version, line dedup against a plain version, both against SQL on the driver's tables."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import lines, mixing, queries

SF = "/root/testdata/sf0.001"


def targets(sizes: dict, weights=(5.0, 2.0, 1.0), most=3.0) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: share.get(s, most * sizes[s]) for s in names}
        capped |= over


@pytest.mark.parametrize("ranges", [1, 4096])
def test_mix(spark, messy, ranges):
    out = mixing.mix(messy, range_rows=ranges).collect()
    rows = messy.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want = targets(dict(sizes))
    taken, by = Counter(), defaultdict(list)
    for r in out:
        taken[r["source"]] += r["taken"]
        by[r["source"]].append(r)
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert len(out) == len(rows)
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9)
        full = taken[s] // sizes[s] if sizes[s] else 0
        assert sum(r["taken"] not in (full * r["size"], (full + 1) * r["size"]) for r in by[s]) <= 1  # the one at the cut
    again = mixing.mix(messy.repartition(5), range_rows=ranges).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_applied_mix_takes_what_the_plan_says(spark, messy):
    plan = mixing.mix(messy)
    out = mixing.apply_mix(messy, plan)
    assert out.columns == messy.columns
    words = out.select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    want = {r["source"]: r["t"] for r in plan.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    got = {r["source"]: r["n"] for r in words.collect()}
    for s, n in want.items():
        assert abs(got.get(s, 0) - n) <= 1  # equal rows share an odd word


def test_mix_of_nothing(spark, empty):
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty, mixing.mix(empty)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(blank).collect()] == [0, 0]


def plain_lines(rows, ratio):
    pages, on = Counter(), Counter()
    for _, text, host in rows:
        pages[host] += 1
        if text is not None:
            on.update((host, x) for x in set(text.split("\n")) if x.strip(" "))
    bad = {k for k, n in on.items() if n > 1 and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for i, t, h in rows]


def test_line_dedup(spark, messy):
    rows = [(i, f"menu\nown {i}\n\nfooter\nrare", "h" if i % 3 else None) for i in range(40)] + [(100, None, "h"), (101, "", "h"), (102, "menu", "other"), (103, "menu\nmenu", "h"), (103, "menu\nmenu", "h"), (104, " \n", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1)).withColumn("n_lines", F.lit("x"))
    for hot in (0.0, 0.1, 1.0):
        out = lines.drop_boilerplate(df, 0.5, hot=hot)
        assert sorted(map(repr, [(r["doc_id"], r["text"]) for r in out.collect()])) == sorted(map(repr, plain_lines(rows, 0.5)))
    assert out.where("doc_id = 103").first()["n_dropped"] == 2
    assert lines.drop_boilerplate(messy).count() == messy.count() and lines.drop_boilerplate(messy.where("false")).count() == 0


def test_lines_of_small_hosts(spark):
    rows = [(i, f"menu\nown {i}\n\nfooter {i % 2}", "four") for i in range(4)] + [(9, "menu\nown", "one"), (10, "menu\nx\nx", "two"), (11, "menu\ny", "two")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(df).collect()}
    assert out == {0: "own 0\n", 1: "own 1\n", 2: "own 2\n", 3: "own 3\n", 9: "menu\nown", 10: "x\nx", 11: "y"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(rows) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_digest_of_lost_text(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
