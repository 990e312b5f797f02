"""Language identification: backoff, edge cases, and held-out accuracy on the driver's tables."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import langid
from tessella.llm.queries import fold, op1_language_id

SF = "/root/testdata/sf0.001"


def model_of(spark, rows):
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def plain_model(rows, longest=5):
    """Counts by language, of words under 0 and n-grams under their length."""
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        for w in plain_words(text):
            counts[lang, 0][w] += 1
            for n in range(1, longest + 1):
                for i in range(len(w) + 2 - n + 1):
                    counts[lang, n][f" {w} "[i : i + n]] += 1
    return sorted({lang for lang, _ in counts}), counts


def plain_words(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def plain_score(word, languages, counts, longest=5):
    each = lambda n, x: np.array([math.log10(max(counts[g, n][x], 0.1) / max(1, sum(counts[g, n].values()))) for g in languages])
    if any(counts[g, 0][word] for g in languages):
        return each(0, word)
    padded = f" {word} "
    for n in range(longest, 0, -1):
        known = [x for x in (padded[i : i + n] for i in range(len(padded) - n + 1)) if any(counts[g, n][x] for g in languages)]
        if known:
            return sum(each(n, x) for x in known) / len(known)
    return np.zeros(len(languages))


def plain_predict(text, languages, counts):
    total = sum((plain_score(w, languages, counts) for w in plain_words(text)), np.zeros(len(languages)))
    if not plain_words(text):
        return "und", 0.0
    return languages[int(total.argmax())], 1 / sum(10 ** (x - total.max()) for x in total)


def test_backs_off_from_words_to_shorter_grams(spark):
    rows = [(1, "the thing there", "en"), (2, "der die das", "de")]
    model = model_of(spark, rows)
    assert model.languages == ["de", "en"]
    known = model.score("the")
    assert known[1] == pytest.approx(np.log10(1 / 3)) and known[0] == pytest.approx(np.log10(0.1 / 3))
    for word in ("the", "thinq", "日本", "dasda", "x", "ed"):
        assert model.score(word) == pytest.approx(plain_score(word, *plain_model(rows))), word


def test_predictions_equal_a_plain_version(spark, messy, monkeypatch):
    rows = [(i, f"{w} {w[::-1]} Straße {w}e über", ["en", "de", "fr"][i % 3]) for i, w in enumerate("the of and der und die le la les ein this that zoé été".split())]
    model, (languages, counts) = model_of(spark, rows), plain_model(rows)
    texts = [r["text"] for r in messy.collect()] + [t for _, t, _ in rows] + ["²½ Ⅷ", "a²b", "٣٤ ①", "Ünder dié it's\tvon-der", "i̇ İ", "x" * 900]
    for size in (1_000_000, 50):
        monkeypatch.setattr(langid, "PORTION", size)
        own, odds = model.predict(texts)
        for text, name, p in zip(texts, own, odds, strict=True):
            if size > 100 or len(text or "") < 100:
                want = plain_predict(text, languages, counts)
                assert p == pytest.approx(want[1]) and (name == want[0] or p < 0.51), (text, want)


def test_numbers_are_no_letters(spark):
    model = model_of(spark, [(1, "the thing there", "en"), (2, "der die das", "de")])
    assert model.predict(["²½ Ⅷ", "①②", "", None, "12 _ !"]) == (["und"] * 5, [0.0] * 5)


def test_long_texts_in_parts(spark, monkeypatch):
    model = model_of(spark, [(1, "the thing there", "en"), (2, "der die das", "de")])
    text = "die thing, das there " * 400
    whole = model.totals([text.lower()])
    monkeypatch.setattr(langid, "PORTION", 101)
    sums = sum(model.totals(parts)[0].sum(axis=0) for _, parts in langid._parts([text]))
    assert sums == pytest.approx(whole[0][0]) and "".join(p for _, parts in langid._parts([text]) for p in parts) == text


def test_edge_cases(spark, messy):
    model = langid.fit(messy.where("lang IS NOT NULL"))
    out = langid.predict(messy, model).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(out) == messy.count()
    for r in out:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1
    kept = langid.keep_known(messy.withColumn("score", F.lit("own")), model)
    assert kept.columns == messy.columns and {r["score"] for r in kept.select("score").distinct().collect()} == {"own"}


def test_empty_tables(spark, messy, empty):
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(messy, nothing).select("lang_pred").collect()} == {"und"}
    assert langid.predict(empty, nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_query(spark):
    out = op1_language_id(spark, SF).collect()
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(rows) and {r["held_out"] for r in out} == {True, False}
    held = [r for r in out if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in held) > 0.97 * len(held)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(fold() != 0))
    held = langid.predict(docs.where(fold() == 0), model)
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
