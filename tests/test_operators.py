"""Operators on small tables with known results, nulls and ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import rules, text
from tessella.operators import kernels, ranking, relational, resampling, statistics
from tessella.sources import tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_keep_best_and_unique(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, v int, w string")
    assert rows(relational.keep_best(df, ["k"], [F.desc_nulls_last("v")]), "k") == [("a", 2, "y"), ("b", None, "z")]
    assert rows(relational.keep_unique(df, ["k"]), "k") == [("b", None, "z")]


def test_validated_join_refuses_repeated_keys(spark):
    one = spark.createDataFrame([(1, "a")], "k int, x string")
    two = spark.createDataFrame([(1, "b"), (1, "c")], "k int, y string")
    with pytest.raises(ValueError):
        relational.validated_join(one, two, ["k"])
    assert relational.validated_join(one, two.limit(1), ["k"]).count() == 1
    with pytest.raises(ValueError, match="null"):
        relational.validated_join(one, spark.createDataFrame([(None, "b")], "k int, y string"), ["k"])


def test_nearest_join_takes_the_smaller_on_ties(spark):
    df = spark.createDataFrame([(1.5,), (None,), (9.0,)], "v double")
    assert sorted([r["nearest"] for r in relational.nearest_join(df, "v", [1.0, 2.0]).collect()], key=str) == [1.0, 2.0, None]


def test_cardinality(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 3)], "a int, b int")
    assert relational.cardinality(df, "a", "b").first()["relationship"] == "right_nested_in_left"


def test_average_rank_over_a_whole_table_and_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0), ("b", None), ("b", 2.0)], "g string, v double")
    assert rows(ranking.average_rank(df, [], "v").select("v", "avg_rank"), F.asc_nulls_last("v")) == [(1.0, 1.5), (1.0, 1.5), (2.0, 3.0), (3.0, 4.0), (None, None)]
    assert rows(ranking.average_rank(df, ["g"], "v").where("g = 'b'").select("v", "avg_rank"), F.asc_nulls_last("v")) == [(2.0, 1.0), (3.0, 2.0), (None, None)]


def test_running_sums_cross_ranges(spark):
    df = spark.range(1000).withColumn("n", F.lit(1).cast("long"))
    out = ranking.running(df, [], "id", "n", "before", ranges=7)
    assert out.where("id <> before").count() == 0


def test_bh_skips_missing_p(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    q = dict(rows(ranking.bh_adjust(df, "p", id_column="i").select("i", "q_value"), "i"))
    assert q[1] == pytest.approx(0.03) and q[2] == pytest.approx(0.04) and q[3] == pytest.approx(0.04) and q[4] is None


def test_qcut_merges_equal_bounds(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 2, 3, 4, 5, 6, 7, 8)], "v double")
    sizes = [r["count"] for r in ranking.qcut(df, "v", 4).groupBy("bin").count().orderBy("bin").collect()]
    assert sizes == [3, 2, 2, 3]


def test_zscore_fills_the_median_and_drops_constants(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    z = rows(statistics.zscore(df, ["g"], "v").select("g", "z"), "z")
    assert z == [("a", -1.0), ("a", 0.0), ("a", 1.0)]


def test_normal_tail(spark):
    df = spark.createDataFrame([(0.0,), (1.96,), (-3.0,)], "z double")
    for z, p in df.select("z", statistics.normal_tail(F.col("z"))).collect():
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-7)


def test_kaplan_meier_ends_at_zero(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "t int, e int").withColumn("g", F.lit("x"))
    out = rows(statistics.kaplan_meier(df, "t", F.col("e"), ["g"]).select("t", "survival"), "t")
    assert out[0][1] == pytest.approx(2 / 3) and out[1] == (3, 0.0)


def test_concordance_matches_pairs(spark):
    rng = np.random.default_rng(0)
    data = [(int(rng.integers(1, 20)), bool(rng.integers(0, 2)), int(rng.integers(0, 4))) for _ in range(80)]
    comparable = concordant = tied = 0
    for t, e, r in data:
        for u, f, s in data:
            if e and (u > t or (u == t and not f)):
                comparable += 1
                concordant += r > s
                tied += r == s
    out = statistics.concordance(spark.createDataFrame(data, "t int, e boolean, r int"), "t", F.col("e"), "r").first()
    assert (out["comparable"], out["concordant"], out["tied"]) == (comparable, concordant, tied)


def test_cox_and_logistic_recover_an_effect():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 1))
    time = np.ceil(rng.exponential(np.exp(-0.8 * x[:, 0])) * 10)
    beta, se = kernels.cox_fit(time, np.ones(400, int), x)
    assert abs(beta[0] - 0.8) < 4 * se[0]
    y = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    beta, se = kernels.logistic_fit(y, x)
    assert abs(beta[1] - 1) < 4 * se[1]


def test_signed_rank_exact():
    w, p = kernels.signed_rank(np.array([1.0, 2.0, 3.0, 4.0, 5.0]))
    assert (w, p) == (15.0, 0.0625)
    assert kernels.signed_rank(np.zeros(3)) == (0.0, 1.0)


def test_average_linkage():
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    assert kernels.average_linkage(d, 0.5).tolist() == [0, 0, 1]


def test_sign_flips(spark):
    df = spark.createDataFrame([("g", i, 1.0) for i in range(4)], "g string, i int, v double")
    out = resampling.sign_flips(df, ["g"], "i", "v").first()
    assert (out["n"], out["mean"], out["p_value"]) == (4, 1.0, 2 / 16)


def test_draws_do_not_depend_on_partitions(spark):
    a = resampling.folds(spark.range(100).withColumn("y", F.col("id") % 2), "id", "y", 5, "s")
    b = resampling.folds(spark.range(100).repartition(7).withColumn("y", F.col("id") % 2), "id", "y", 5, "s")
    assert rows(a, "id") == rows(b, "id")


def test_text_functions(spark):
    df = spark.createDataFrame([("10-20",), ("0.5",), ("50%",), ("120",), (None,)], "x string")
    assert [r[0] for r in df.select(text.percent(F.col("x"))).collect()] == [15.0, 50.0, 50.0, None, None]
    df = spark.createDataFrame([("a /// a",), ("a;b",), ("",)], "x string")
    assert [r[0] for r in df.select(text.only_symbol(F.col("x"))).collect()] == ["a", None, None]
    df = spark.createDataFrame([("age: 5; sex: M: x",)], "x string")
    assert df.select(text.key_value(F.col("x"), "sex")).first()[0] == "M: x"
    assert text.snake(" Tumour Size (mm)") == "tumour_size_mm"


def test_rules(spark):
    df = spark.createDataFrame([(5.0, True), (20.0, False), (5.0, False)], "t double, e boolean")
    assert [r[0] for r in df.select(rules.within(F.col("t"), F.col("e"), 10)).collect()] == [1, 0, None]


def test_sources(spark, tmp_path):
    folder = f"file://{tmp_path}/csv"
    df = spark.createDataFrame([("s1", 1.5, 2.0), ("s2", None, 3.0)], "id string, a double, b double")
    tables.write_csv(df, folder)
    back = tables.read_csv(spark, folder, "id string, a double, b double")
    assert rows(back, "id") == rows(df, "id")
    assert tables.read_csv(spark, f"file://{tmp_path}/none", "id string", optional=True).count() == 0
    long = tables.melt(back, ["id"])
    assert long.count() == 4 and long.where("value IS NULL").count() == 1
    own = tables.manifest(spark, folder + "/*.csv")
    changed = own.withColumn("sha256", F.lit("0"))
    assert {r["status"] for r in tables.verify(own, own).collect()} == {"ok"}
    assert {r["status"] for r in tables.verify(own, changed).collect()} == {"changed"}


def test_markov_blankets_find_the_parents():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 8))
    x[:, 5] = x[:, 0] + 0.1 * rng.normal(size=2000)
    y = x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=2000)
    r = np.corrcoef(np.column_stack([x, y]).T)
    from tessella.operators import selection

    assert set(selection.iamb(r, 2000, 8, 1e-4)) == {0, 1} and set(selection.grow_shrink(r, 2000, 8, 1e-4)) == {0, 1}
    given = [1, 2]
    a, b = (np.column_stack([x[:, given], np.ones(2000)]) @ np.linalg.lstsq(np.column_stack([x[:, given], np.ones(2000)]), v, rcond=None)[0] for v in (x[:, 0], y))
    assert selection.partial_correlations(r, 8, given)[0] == pytest.approx(np.corrcoef(x[:, 0] - a, y - b)[0, 1], abs=1e-4)


def test_subspaces():
    from tessella.operators import selection

    q = np.linalg.qr(np.random.default_rng(0).normal(size=(6, 6)))[0]
    assert selection.subspace_similarity(q[:, :2], q[:, :2] @ np.array([[1, 2], [3, 4]])) == pytest.approx(1)
    assert selection.subspace_similarity(q[:, :2], q[:, 2:4]) == pytest.approx(0, abs=1e-12)
    assert selection.capture(q[:, 0] + q[:, 5], q[:, :2]) == pytest.approx(0.5)
    assert selection.effective_rank(np.eye(4)) == pytest.approx(4)


def test_sign_test_and_concordance():
    assert kernels.sign_test(np.array([1.0, 1, 1, 1, 0, np.nan])) == (4, 4, 0.125)
    assert kernels.sign_test(np.zeros(2)) == (0, 0, 1.0)
    assert kernels.concordance(np.array([1.0, 2, 3]), np.array([1, 1, 0]), np.array([3.0, 1, 1])) == pytest.approx(2.5 / 3)


def test_nearest_in_blocks(spark, monkeypatch):
    from tessella.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK", 7)
    x = np.random.default_rng(0).normal(size=(40, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    c = np.corrcoef(x)
    np.fill_diagonal(c, -np.inf)
    got = {(r["query"], r["place"]): r["neighbor"] for r in neighbors.nearest(df.where("k % 10 = 0"), df, "k", "v", 3).collect()}
    assert got == {(q, p + 1): int(np.argsort(-c[q])[p]) for q in (0, 10, 20, 30) for p in range(3)}


def test_running_sums_and_extremes_within_keys(spark):
    data = [(k, i, (i * 7919) % 101) for k in ("a", "b", None) for i in range(300 if k == "a" else 5)]
    df = spark.createDataFrame(data, "k string, i int, n long")
    sums = {(r["k"], r["i"]): r["s"] for r in ranking.running(df, ["k"], "i", "n", "s", ranges=9).collect()}
    least = {(r["k"], r["i"]): r["s"] for r in ranking.running(df, ["k"], "i", "n", "s", ranges=9, pick=F.min).collect()}
    for k, i, _ in data:
        assert sums[k, i] == sum(n for q, j, n in data if q == k and j < i)
        assert least[k, i] == min(n for q, j, n in data if q == k and j >= i)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    data = [("a", float(x)) for x in rng.integers(0, 40, 200)] + [("b", 3.0), ("b", None), ("c", None)]
    df = spark.createDataFrame(data, "g string, v double")
    found = {r["g"]: r for r in ranking.exact_quantiles(df, ["g"], "v", {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()}
    own = [v for g, v in data if g == "a"]
    assert [found["a"][c] for c in ("low", "mid", "top")] == pytest.approx(list(np.quantile(own, [0.05, 0.5, 1.0]))) and found["b"]["mid"] == 3.0 and "c" not in found
    whole = ranking.exact_quantiles(df, [], "v", {"mid": 0.3}).first()["mid"]
    assert whole == pytest.approx(np.quantile([v for _, v in data if v is not None], 0.3))


def test_bh_with_ties_and_families(spark):
    rng = np.random.default_rng(1)
    data = [(i, i % 3, float(np.round(rng.uniform(), 1))) for i in range(60)] + [(99, 0, None)]
    got = {r["i"]: r["q_value"] for r in ranking.bh_adjust(spark.createDataFrame(data, "i int, f int, p double"), "p", ["f"]).collect()}
    assert got[99] is None and len(got) == 61
    for f in range(3):
        own = sorted((p, i) for i, g, p in data if g == f and p is not None)
        q, low = {}, 1.0
        for rank in range(len(own), 0, -1):
            low = min(low, own[rank - 1][0] * len(own) / rank)
            q[own[rank - 1][1]] = low
        for p, i in own:
            assert got[i] == pytest.approx(min(q[j] for r, j in own if r == p))


def test_top_with_forced_keeps_equal_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 5), (2, 4), (3, 1)], "k int, v int")
    out = relational.top_with_forced(df, 2, [F.desc("v")], F.col("k").isin(1, 3))
    assert rows(out.select("k", "v", "is_top", "is_forced"), "k", F.desc("is_top")) == [(1, 5, True, True), (1, 5, True, True), (1, 5, False, True), (3, 1, False, True)]


def test_set_scores_with_an_item_of_all_groups(spark, monkeypatch):
    monkeypatch.setattr(relational, "MEETING", 3)
    sets = {g: {0, g, g + 1} for g in range(10)}
    df = spark.createDataFrame([(g, i) for g, s in sets.items() for i in s] * 2, "g int, i int")
    got = {(r["a"], r["b"]): r["overlap"] for r in relational.set_scores(df, "g", "i").collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}


def test_moments_count_rows_whole_or_not(spark):
    df = spark.createDataFrame([([2.0, 1.0],), ([None, 1.0],), ([1.0, float("nan")],), (None,), ([],), ([4.0, 3.0],)], "x array<double>")
    n, mean, cov = kernels.moments(df, "x")
    assert n == 2 and mean.tolist() == [3.0, 2.0] and cov.tolist() == [[2.0, 2.0], [2.0, 2.0]]
    with pytest.raises(ValueError):
        kernels.moments(df.unionByName(spark.createDataFrame([([1.0],)], "x array<double>")), "x")


def test_concordance_of_continuous_risks(spark):
    rng = np.random.default_rng(2)
    t, e, r = rng.integers(1, 40, 300), rng.integers(0, 2, 300), rng.normal(size=300).round(1)
    df = spark.createDataFrame([(int(a), bool(b), float(c)) for a, b, c in zip(t, e, r)] + [(None, True, 1.0)], "t int, e boolean, r double")
    assert statistics.concordance(df, "t", F.col("e"), "r").first()["c_index"] == pytest.approx(kernels.concordance(t, e, r))


def test_percent_spellings(spark):
    said = {"95": 95, "0,5": 50, "12,5%": 12.5, "90-100": 95, "90\u2013100%": 95, "90 to 100": 95, "0.5%": 0.5, "-5": None, "120": None, "n/a": None, None: None, "10 %": 10, "1": 100}
    df = spark.createDataFrame([(k,) for k in said], "x string")
    assert {r["x"]: r["p"] for r in df.select("x", text.percent(F.col("x")).alias("p")).collect()} == said


def test_identifiers_and_lists(spark):
    df = spark.createDataFrame([("ENSG0001.7", "AB007x012", "b:2; a:1;a:3;:4;c:x", ["NA", "", "7", "12"], "Event: 1, time=3.5"), (" tp53 ", "none", None, None, "time 3"), ("12-x y", None, "", [None, "x"], None)], "i string, p string, l string, a array<string>, t string")
    out = df.select(
        text.identifier(F.col("i")).alias("i"), text.first_number(F.col("p")).alias("f"), text.last_number(F.col("p")).alias("n"), text.head(F.col("p")).alias("h"), text.pairs(F.col("l")).alias("l"),
        text.first_filled(F.col("a")).alias("a"), text.largest_number(F.col("a")).alias("m"), text.time_and_event(F.col("t")).alias("t"), text.row_text([F.col("p"), F.col("l")]).alias("r"), text.is_placeholder(F.col("i")).alias("b"),
    ).collect()
    assert tuple(out[0]["i"]) == ("ensembl", "ENSG0001") and tuple(out[1]["i"]) == ("symbol", "TP53") and tuple(out[2]["i"]) == ("raw", "12-x y")
    assert [r["f"] for r in out] == ["7", None, None] and [r["n"] for r in out] == ["12", None, None] and out[0]["h"] == "AB7"
    assert out[0]["l"] == {"b": 2.0, "a": 3.0} and out[1]["l"] is None and out[2]["l"] == {}
    assert [r["a"] for r in out] == ["7", None, "x"] and [r["m"] for r in out] == [12.0, None, None]
    assert tuple(out[0]["t"]) == (3.5, 1) and out[1]["t"] is None and [r["b"] for r in out] == [True, False, False]
    assert out[2]["r"] == "nan | " and out[1]["r"] == "none | nan"


def test_random_panels_take_the_smallest_draws(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 3 if i % 3 else None, 2 + (i % 3)) for i in range(90)], "i long, g int, n int")
    for bits in (20, 29):
        monkeypatch.setattr(resampling, "RANGE_BITS", bits)
        drawn = {(r["rep"], r["i"]): r["u"] for r in resampling.replicates(df, 4).select("rep", "i", resampling.draw("s", F.col("rep"), F.col("i")).alias("u")).collect()}
        got = sorted((r["rep"], r["g"] or 0, r["i"]) for r in resampling.random_panels(df, ["g"], "i", "n", 4, "s").collect())
        want = sorted((rep, g, i) for rep in range(1, 5) for g in range(3) for i in sorted((i for i in range(90) if i % 3 == g), key=lambda i: (drawn[rep, i], i))[: 2 + g])
        assert got == want
    assert resampling.random_panels(df, [], "i", 5, 2, "s").count() == 10


def test_ranks_of_large_groups_are_those_of_small_ones(spark, monkeypatch):
    import math
    import random

    from tessella.operators import ranking, statistics

    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, float("nan") if i % 50 == 0 else 1.0, round(rng.random(), 1), rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    some = df.where("v IS NOT NULL AND NOT isnan(v)")
    clean = lambda out: sorted([tuple("nan" if isinstance(x, float) and math.isnan(x) else round(x, 12) if isinstance(x, float) else x for x in r) for r in out.collect()], key=str)

    def results():
        yield clean(ranking.average_rank(some, ["g"], "v"))
        yield clean(ranking.average_rank(some, [], "v"))
        yield clean(ranking.exact_quantiles(some, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}))
        yield clean(ranking.exact_quantiles(some, [], "v", {"a": 0.33}))
        yield clean(ranking.bh_adjust(df, "v", ["g"]))
        yield clean(ranking.bh_adjust(df, "v"))
        distinct = some.groupBy("g", "v").count()
        yield clean(ranking.running(distinct, ["g"], "v", "count", "before"))
        yield clean(ranking.running(distinct, ["g"], "v", "count", "least", pick=ranking.F.min))
        yield clean(statistics.spearman(some.withColumn("w", ranking.F.col("id") % 7), ["g"], "v", "w"))

    small = list(results())
    monkeypatch.setattr(ranking, "GROUP", 10)
    for one, other in zip(small, results(), strict=True):
        assert one == other and one


def test_z_scores_fill_missing_and_infinite_values(spark):
    from tessella.operators import statistics

    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("a", None), ("a", float("inf")), ("b", 1.0), ("b", 1.0), (None, 0.0), (None, 2.0), (None, float("nan"))], "g string, v double")
    out = sorted(((r["g"] or "", round(r["v"], 6)) for r in statistics.zscore(df, ["g"], "v").collect()))
    assert [x for x in out if x[0] == "a"] == [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 2.0), ("a", 6.0)] and not any(x[0] == "b" for x in out)
    assert statistics.zscore(df.where("g = 'a'"), [], "v").count() == 5


def test_the_best_of_a_frequent_key_is_found_before_the_shuffle(spark):
    from tessella.operators import relational

    best = relational.keep_best(spark.range(100).selectExpr("id", "id % 2 AS k", "id % 7 AS v"), ["k"], [F.desc("v"), F.asc("id")])
    assert sorted(r["id"] for r in best.collect()) == [6, 13]
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_blankets_from_rows_of_correlations(spark):
    import numpy as np

    from tessella.operators import selection

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 9))
    x[:, 8] = x[:, 0] - 0.8 * x[:, 1] + 0.5 * x[:, 4] + rng.normal(size=400)
    x[:, 5] = 3.0
    df = spark.createDataFrame([(v,) for v in x.tolist()] + [([float("nan")] * 9,), (None,)], "x array<double>").repartition(3)
    rows = selection.Rows(df, "x")
    n, r = selection.correlations(df, "x")
    assert rows.n == n == 400 and np.allclose(rows.rows([8, 2, 5]), r[[8, 2, 5]], atol=1e-12)
    for select in (selection.iamb, selection.grow_shrink):
        assert select(rows, n, 8, 0.01) == select(r, n, 8, 0.01) and {0, 1, 4} <= set(select(rows, n, 8, 0.01))
    assert len(rows.known) < 9
    with pytest.raises(ValueError):
        selection.Rows(df.unionByName(spark.createDataFrame([([1.0],)], df.schema)), "x")
