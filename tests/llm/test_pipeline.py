"""Each stage of the pipeline against a plain version on its own input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.llm.conftest import DOCS, prose
from tests.llm.test_mixing_lines import plain_lines, targets
from tests.llm.test_simhash import plain_components

import corpus_pipeline
from tessella.llm import store
from tessella.llm.queries import BYTE_TOKENIZER, tokenizer_path
from tokenizers import Tokenizer


def near(rows):
    """Groups of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by all pairs."""
    sets = {}
    for i, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    pairs = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return plain_components(sets, pairs)


@pytest.fixture(scope="module")
def results(spark):
    """Documents before the first stage and after each."""
    menu = "home about contact"
    rows = []
    for i in range(60):
        text = f"{menu}\n{prose(i, 120 + i)}" if i % 2 else prose(i, 120 + i)
        rows.append((i, text, "en" if i % 5 else None, f"s{i % 3}" if i % 7 else None, len(text)))
    for i in range(8):
        words = rows[i][1].split(" ")
        words[60] = "altered"
        rows.append((100 + i, " ".join(words), "en", "s0", 1))
    rows += [(200, rows[3][1], "en", "s1", 1), (201, "123 456", "en", "s1", 1), (202, None, "en", "s1", 1), (203, "", "en", None, 0), (204, prose(900, 3000), None, "s2", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store.materialize(stage(spark, out[-1], "none"), f"test-{name}"))
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_names_and_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]
    assert all(r.columns == results[0].columns for r in results[:-1]) and corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_clean_documents(results):
    want = [r for r in pairs(results[0]) if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert sorted(pairs(results[1])) == sorted(want)


def test_line_stage(results):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in results[1].collect()]
    want = plain_lines(rows, 0.1)
    assert sorted(pairs(results[2])) == sorted(want) and any("home" in t for _, t, _ in rows)
    assert not any("home" in r["text"] for r in results[2].collect())
    assert all(r["n_chars"] == len(r["text"]) for r in results[2].collect())


def test_near_duplicate_stage(results):
    rows = pairs(results[2])
    groups = near(rows)
    assert sorted(pairs(results[3])) == sorted((i, t) for i, t in rows if groups[i] == i)
    assert not [i for i, _ in pairs(results[3]) if i in range(100, 201)]


def test_mixing_stage(results):
    sizes, taken = Counter(), Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in results[3].collect():
        sizes[r["source"]] += words(r["text"])
    texts = {(r["doc_id"], r["source"]): r["text"] for r in results[3].collect()}
    cut = Counter()
    for r in results[4].collect():
        taken[r["source"]] += words(r["text"])
        whole = texts[r["doc_id"], r["source"]]
        if r["text"] != whole:
            cut[r["source"]] += 1
            assert whole.split()[: words(r["text"])] == r["text"].split()
    want = targets(dict(sizes))
    assert {s: taken[s] for s in sizes} == {s: int(want[s] + 1e-9) for s in sizes} and max(cut.values()) <= 1


def test_packing_stage(results):
    enc, want = Tokenizer.from_file(tokenizer_path(BYTE_TOKENIZER)), Counter()
    for i, t in pairs(results[4]):
        n = len(enc.encode(t or "", add_special_tokens=False).ids) + 1
        first = n % 1024 or 1024
        for k, length in enumerate([first, *[1024] * ((n - first) // 1024)]):
            want[i, k, length] += 1
    held = defaultdict(list)
    got = Counter()
    for r in results[5].collect():
        got[r["doc_id"], r["piece"], r["length"]] += 1
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024


def test_all_stages_take_an_empty_table(spark, results):
    docs = results[0].where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "none")
        assert docs.count() == 0


def test_all_stages_take_messy_tables(spark, messy):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, messy, "none")
        assert out.count() >= 1, name
        if name != "best_fit_packing":
            assert out.columns == messy.columns


def test_run_keeps_its_result_alone(spark, messy, tmp_path, monkeypatch):
    messy.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    shared = tmp_path / "shared"
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{shared}")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 3 and len([p for p in shared.iterdir()]) == 1
