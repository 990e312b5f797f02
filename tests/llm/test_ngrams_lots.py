"""Lookups in a model of many shards: opened once, passed once a lot of texts."""

from tests.llm.conftest import prose
from tests.llm.test_ngrams import check, plain

from tessella.llm import ngrams, shards, store


def test_many_shards_are_opened_once_and_searched_once_a_lot(spark, monkeypatch):
    texts = [prose(i, 300) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    monkeypatch.setattr(ngrams, "HELD", 20)
    write = ngrams._write_level
    monkeypatch.setattr(ngrams, "_write_level", lambda *a, **more: write(*a, shard=20, **more))
    trie = ngrams.train(df, store.fresh_path(spark, "test-lots"))
    assert len(trie.pairs.paths) + len(trie.triples.paths) > 256
    read, searched, find = [], [], ngrams.Level.find
    of = store.read_shard
    monkeypatch.setattr(shards.store, "read_shard", lambda uri: read.append(uri) or of(uri))
    monkeypatch.setattr(ngrams.Level, "find", lambda self, *a: searched.append(self) or find(self, *a))
    for _ in range(2):
        ngrams.token_probabilities(trie, *ngrams.tokens_of(texts))
    assert len(read) == len(set(read))

    # A task's function, run here on batches of two texts each: one lot.
    seen = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, each, kind: seen.append(each))
    ngrams.score(df, trie)
    monkeypatch.undo()
    monkeypatch.setattr(ngrams.Level, "find", lambda self, *a: searched.append(self) or find(self, *a))
    searched.clear()
    batches = df.toArrow().to_batches(max_chunksize=2)
    rows = [tuple(r.values()) for b in seen[0](iter(batches)) for r in b.to_pylist()]
    assert len(batches) == 6 and len(searched) == 2
    check(rows, plain(texts, list(enumerate(texts))))
