"""Substring dedup against counting every window."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import DOCS, prose

from tessella.llm import substrings
from tessella.llm.queries import op8_substring_dedup
from tessella.llm.words import runs, sliding, word_hashes


def plain(rows, length=35):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def found(df, **more):
    return sorted(repr(tuple(r)) for r in substrings.remove(df, digest=True, **more).collect())


@pytest.mark.parametrize("most", [1 << 14, 2])
def test_planted_passages(spark, most):
    passage, other = prose(1, 60), prose(2, 37)
    rows = [(i, f"{prose(100 + i, 50)} {passage} {prose(200 + i, 30)}") for i in range(12)]
    rows += [(20, f"{prose(300, 10)} {other} {prose(301, 10)} {other}"), (21, " ".join(passage.split()[5:41])), (22, " ".join(passage.split()[7:41]))]
    rows += [(23, "a " * 90), (24, "a b " * 40), (25, prose(400, 36)), (26, "x " + prose(400, 36)[2:]), (27, other + " " + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, most=most) == plain(rows)


@pytest.mark.parametrize("most", [1 << 14, 1])
def test_passages_that_differ_in_one_word_stay(spark, most):
    # The two ids agree in the low 32 bits of their XXH64.
    a, b = prose(7, 35).split(), prose(7, 35).split()
    a[18], b[18] = "id24909", "id65039"
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, "other " + " ".join(a[:34]) + " end"), (4, " ".join(a[1:]) + " id65039")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), most=most) == plain(rows) and "True" not in str(plain(rows))
    assert all(r["n_removed"] == 0 for r in substrings.remove(spark.createDataFrame(rows[:2], "doc_id long, text string"), most=most).collect())


def test_templates_with_many_ids(spark):
    words = prose(8, 60).split()
    rows = [(i, " ".join([*words[:20], f"id{i}", *words[20:40], f"no{i % 7}", *words[40:]])) for i in range(150)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_equal_hashes_of_different_words_make_no_factor(monkeypatch):
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 1 << 60, (6, 58)).astype(np.uint64)
    rows[1], rows[3], rows[4] = rows[0], rows[2], rows[0]
    rows[4, 40:] = rows[5, 40:]
    monkeypatch.setattr(substrings, "runs", lambda x, n: np.zeros((len(x), x.shape[1] - n + 1), np.uint64))
    full = np.full(6, 23)
    marked = substrings.repeated_factors(np.array([1, 1, 1, 1, 1, 2]), rows, full, full, 35, 12)
    want = np.zeros((6, 24), bool)
    want[:4], want[4, :6] = True, True
    assert (marked == want).all()


def test_query(spark, messy, tmp_path):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert sorted(repr(tuple(r)) for r in op8_substring_dedup(spark, str(tmp_path)).collect()) == plain(rows)


def test_long_words_are_told_apart():
    pattern = [b"a"]
    for _ in range(12):
        pattern = [pattern[0] + pattern[0].translate(bytes.maketrans(b"ab", b"ba"))]
    one, other = pattern[0], pattern[0].translate(bytes.maketrans(b"ab", b"ba"))
    h, counts = word_hashes([one + b" x " + other, b"A a"])
    assert h[0] != h[2] and h[3] == h[4] and counts.tolist() == [3, 2]
    assert len(set(word_hashes([b"A a"], fold=False)[0].tolist())) == 2


def test_messy(spark, messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(messy) == plain(rows)
    assert substrings.remove(empty).count() == 0


def test_texts_and_spans(spark):
    text = prose(5, 40)
    rows = [(1, "start " + text + " end"), (2, text), (3, None)]
    out = {r["doc_id"]: r for r in substrings.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["kept"] == "start end" and out[1]["spans"] == [[1, 41]]
    assert out[2]["kept"] == "" and out[3]["kept"] == "" and out[3]["spans"] == []


def test_runs_and_sliding():
    x = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for n in (1, 2, 12, 35):
        h = runs(x, n)
        keys = {}
        for i, v in enumerate(h.tolist()):
            assert keys.setdefault(tuple(x[i : i + n].tolist()), v) == v
        assert len(set(keys.values())) == len(keys) and len(h) == 200 - n + 1
        assert (sliding(x, n, np.minimum) == [x[i : i + n].min() for i in range(200 - n + 1)]).all()
    assert len(runs(x[:3], 5)) == 0 and (runs(np.stack([x, x]), 7)[1] == runs(x, 7)).all()


def test_many_documents(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3)]
    rows = [(i, " ".join(vocabulary[k] for k in rng.integers(0, 3, 120))) for i in range(30)] + [(100, prose(9, 500)), (101, prose(9, 500))]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    assert found(df) == plain(rows)
