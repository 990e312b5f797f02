"""Benchmark windows in documents against a plain scan, and against SQL on the driver's tables."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, prose

from tessella.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, size=10):
    wins = [(i, w[k : k + min(size, len(w))]) for i, t in items for w in [words_of(t)] if w for k in range(len(w) - min(size, len(w)) + 1)]
    out = []
    for i, t in rows:
        has, hit, named = words_of(t), set(), set()
        for name, win in wins:
            for k in range(len(has) - len(win) + 1):
                if has[k : k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    named.add(name)
        out.append((i, len(has), len(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_words"], r["n"], r["items"]) for r in df.withColumn("n", decontaminate.n_hit()).collect()), key=repr)


@pytest.fixture
def items(spark):
    rows = [(1, prose(50, 25)), (2, "Short, ITEM!"), (3, None), (4, "..."), (5, prose(51, 10)), (5, prose(51, 10)), (None, prose(52, 12)), (6, "x"), (7, prose(50, 25).upper()), (8, "Ärger über-Öl")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("most", [decontaminate.MOST, 0])
def test_hits(spark, messy, items, most):
    a = prose(50, 25).split()
    more = [(20, "say " + " ".join(a[3:20]).replace(" ", "\n- ") + " end"), (21, " ".join(a[:9])), (22, "short item"), (23, "a SHORT  item, shortitem"), (24, prose(52, 12) + " x " + prose(51, 10)), (25, "... !"), (26, "ärger über Öl"), (27, "Ärger über öl ärger")]
    docs = messy.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in more], DOCS), allowMissingColumns=True)
    docs = docs.withColumns({"items": F.lit(1), "scanned": F.lit(2), "k": F.lit(3), "of": F.lit(4), "has": F.lit(5), "g": F.lit(6), "a b.`c": F.lit(7)})
    out = decontaminate.scan(docs, items, most=most)
    assert set(docs.columns) - set(out.columns) == set() and out.where("k <> 3 OR of <> 4").count() == 0
    assert found(out) == plain(docs.select("doc_id", "text").collect(), items.collect())


@pytest.mark.parametrize("most", [decontaminate.MOST, 0])
def test_empty_tables(messy, empty, items, most):
    assert decontaminate.scan(empty, items, most=most).count() == 0
    assert decontaminate.scan(messy, items.where("false"), most=most).where("size(spans) > 0 OR size(items) > 0 OR n_words IS NULL").count() == 0


def test_spans_and_documents_go(spark, items):
    rows = [(1, f"Keep this, {prose(51, 10)}; and THIS."), (2, "clean  text"), (3, None), (4, prose(51, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, items).collect()} == {1: "Keep this,  ; and THIS.", 2: "clean  text", 3: None, 4: " "}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items, "documents").collect()} == {2, 3}
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, items, "pages")


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.op12_benchmark_decontamination(spark, SF)
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.LEAKS_SQL})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want) and any(r[-1] for r in want)
    ids = plain([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert sorted((r["doc_id"], r["items_sha256"]) for r in out.collect()) == sorted((i, hashlib.sha256(",".join(x).encode()).hexdigest()) for i, _, _, x in ids)
