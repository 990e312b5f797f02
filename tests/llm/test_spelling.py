"""Spelling variants against all pairs and a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest
from tests.llm.conftest import DOCS

from tessella.llm import spelling
from tessella.llm.queries import op13_spelling_variants

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(n):
    """Results by word, from counts; neighbours by words with one character left out."""
    near, by = {w: set() for w in n}, {}
    for w in n:
        for i in range(len(w)):
            by.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    for (_, short), words in by.items():
        for a in words:
            near[a] |= words - {a}
            if short in n:
                near[a].add(short)
                near[short].add(a)
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def plain_counts(rows, change=True):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if change and h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


@pytest.mark.parametrize("most", [spelling.BLOCK, 3])
def test_near_pairs_are_all_pairs(spark, most):
    rng = random.Random(1)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(500)} | {"aaaaa", "aaaaaa", "aaaaaaa", "", "x" * 3000, "x" * 3001, "x" * 2999 + "y"}
    df = spark.createDataFrame([(w, len(w)) for w in sorted(words)] + [(None, 1)], "word string, n long")
    out = [tuple(sorted([r["a"], r["b"]])) for r in spelling.near_pairs(df, most).collect()]
    words = sorted(words - {""})
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    assert len(out) == len(set(out)) and set(out) == want


def test_vocabulary(spark, messy, empty):
    out = {r["word"]: r["n"] for r in spelling.vocabulary(messy).collect()}
    assert out == plain_counts([(r["doc_id"], r["text"]) for r in messy.collect()], change=False)
    assert spelling.group_variants(spelling.vocabulary(empty)).count() == 0
    df = spark.createDataFrame([(i, "Àbcde ABCDE×x abcde1abcde abĀcdefgh", "", "", 0) for i in range(3)], DOCS)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()} == {"Àbcde": 3, "abcde×x": 3, "abcde": 6, "cdefgh": 3}


@pytest.mark.parametrize("most", [spelling.BLOCK, 20])
def test_forms_and_roots(spark, most):
    rng = random.Random(2)
    n = {"".join(rng.choice("abcd") for _ in range(rng.randint(5, 6))): rng.choice([3, 3, 7, 7, 14, 30, 100, 1000]) for _ in range(700)}
    out = {r[0]: tuple(r[1:]) for r in spelling.group_variants(spark.createDataFrame([*n.items()], "word string, n long"), most=most).collect()}
    assert out == plain_forms(n) and len({r[1] for r in out.values()}) < len(out)
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([*n.items()], "word string, n long"), ratio=1)


def test_long_chains(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")], "word string, form string")
    assert {r["root"] for r in spelling.roots_of(links).collect()} == {"w37"}


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = op13_spelling_variants(spark, SF)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == plain_forms(plain_counts(rows))
