"""Chunked tokenizing equals the tokenizer; token files read back whole and at random."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import store, token_files
from tessella.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, op2_token_files, tokenizer_path
from tessella.llm.tokens import encoder

HARD = ["", " a  b\n\n c ", "a b c　 d", "́ x ́y", "<|endoftext|> it's we're 's x'll", " \t\r\n", "x" * 5000, "ΑΣ ΣΑ Σ.", "é é \x1f a", "\U0001f600  \U0001f600", "don't  'S 'ſ", "a\x00b \x00", "a \x01 b", "\x01", "a\n\nb", "\n", "1 22 333", "a\x85b", "a​b"]
#: Strings of added tokens inside, at the edges, glued to words, doubled, in other case and broken.
SPECIAL = [y for x in ("<|endoftext|>", "<|startoftext|>") for y in (x, f"foo {x} bar", f"{x}foo", f"foo{x}", f"foo{x}bar", f" {x} ", f"a\n{x}{x}\tb", x.upper(), x[:-1], f"<{x}>", f"a　{x} b")]


def fresh(name):
    """The tokenizer as its file is, apart from the encoder's."""
    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("name", [WORD_TOKENIZER, BYTE_TOKENIZER])
def test_chunks_give_the_tokenizers_ids(name):
    enc, own = encoder(tokenizer_path(name)), fresh(name)
    for _ in range(2):
        for text, ids in zip(HARD + SPECIAL, enc.encode(HARD + SPECIAL, 7), strict=True):
            assert ids.tolist() == [*own.encode(text, add_special_tokens=False).ids, 7], text
    assert 50256 in fresh(BYTE_TOKENIZER).encode("foo <|endoftext|> bar", add_special_tokens=False).ids


def test_forgets_when_full(monkeypatch):
    from tessella.llm import tokens

    monkeypatch.setattr(tokens, "MOST_CHUNKS", 3)
    enc = tokens.ChunkEncoder(tokenizer_path(WORD_TOKENIZER))
    for text in ("a b c d e", "f g h", "a b x"):
        assert enc.encode([text], 1)[0].tolist() == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def expected(rows):
    tok = fresh(WORD_TOKENIZER)
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in rows]


def test_files_in_order(spark, messy):
    messy = messy.union(messy.limit(2).selectExpr("doc_id + 500", "'foo <|endoftext|>bar <|startoftext|>'", *messy.columns[2:]))
    path = store.fresh_path(spark, "test-tokens")
    manifest = token_files.write_token_files(messy, tokenizer_path(WORD_TOKENIZER), 1, path, shard_tokens=5000)
    assert manifest.count() > 3
    found = token_files.with_crc32(token_files.read_token_files(manifest)).orderBy("start").collect()
    rows = messy.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    key = lambda x: (x is not None, x or 0)
    assert [key(r["doc_id"]) for r in found] == sorted(key(r["doc_id"]) for r in rows)
    by = {}
    for r, ids in zip(rows, expected([r["text"] for r in rows]), strict=True):
        by.setdefault(r["doc_id"], set()).add((len(ids), zlib.crc32(ids.tobytes())))
    start = 0
    for r in found:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in by[r["doc_id"]]
        start += r["n_tokens"]


def test_shards_are_read_by_a_task_each(spark, messy):
    manifest = token_files.write_token_files(messy, tokenizer_path(WORD_TOKENIZER), 1, store.fresh_path(spark, "test-tokens"), shard_tokens=2000)
    assert token_files.read_token_files(manifest).rdd.getNumPartitions() == manifest.count() > 3


def test_query(spark, messy, tmp_path):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in op2_token_files(spark, str(tmp_path)).collect())
    rows = messy.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())) for r, ids in zip(rows, expected([r["text"] for r in rows]), strict=True))
    assert found == want


def test_empty_table(spark, empty):
    manifest = token_files.write_token_files(empty, tokenizer_path(WORD_TOKENIZER), 1, store.fresh_path(spark, "none"))
    assert token_files.read_token_files(manifest).count() == 0


def test_random_access():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 49408, n).astype("<u4") for n in (0, 5, 1000, 3)]
    shard = token_files.Shard(memoryview(b"".join(token_files.shard_bytes([3, None, 5, 6], ids, 49407, block=64))))
    flat = np.concatenate(ids)
    assert shard.width == 16 and shard.present.tolist() == [1, 0, 1, 1]
    assert (shard.ids(0, shard.tokens) == flat).all() and (shard.ids(70, 200) == flat[70:200]).all()
    at = rng.integers(0, len(flat), 99)
    assert (shard.at(at) == flat[at]).all()
    assert (shard.ids(int(shard.starts[2]), int(shard.starts[3])) == ids[2]).all()
