"""The scoring query stores pairs and triples that occur once."""

from collections import Counter

from tests.llm.conftest import DOCS, prose
from tests.llm.test_ngrams import tokens

from tessella.llm import ngrams, queries


def test_query_stores_all_pairs_and_triples(spark, monkeypatch):
    texts = [prose(i, 50) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    monkeypatch.setattr(queries, "documents", lambda spark, d: docs)
    train, found = ngrams.train, []
    monkeypatch.setattr(ngrams, "train", lambda *a, **b: found.append(train(*a, **b)) or found[0])
    out = queries.op3_lm_scoring(spark, "").collect()
    assert len(out) == 30
    own = [tokens(texts[r["doc_id"]]) for r in out if not r["held_out"]]
    pairs, triples = Counter(x for w in own for x in zip(w, w[1:])), Counter(x for w in own for x in zip(w, w[1:], w[2:]))
    assert min(triples.values()) == 1 and (found[0].pairs.n, found[0].triples.n) == (len(pairs), len(triples))
