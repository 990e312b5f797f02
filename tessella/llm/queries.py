"""Thin queries of the numbered operators over the driver's tables, and their SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import conversations, decontaminate, langid, lines, media, mixing, ngrams, packing, simhash, spelling, store, substrings, token_files, vectors

#: Names of tokenizer files in the installed package of public tokenizers.
WORD_TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """Where an installed tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(key: str = "doc_id") -> Column:
    """The fold of a document: crc32 of its id as text, modulo 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds that aren't 0."""
    docs = documents(spark, sf_dir).withColumn("held_out", fold() == 0)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to packed files and read back."""
    path = store.fresh_path(spark, "tokens")
    manifest = token_files.write_token_files(documents(spark, sf_dir), tokenizer_path(WORD_TOKENIZER), 1, path)
    return token_files.with_crc32(token_files.read_token_files(manifest))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and trie scores of every document, learned from the folds that aren't 1."""
    docs = documents(spark, sf_dir).withColumn("held_out", fold() == 1)
    trie = ngrams.train(docs.where(~F.col("held_out")), store.fresh_path(spark, "ngrams"))
    return ngrams.score(docs, trie, keep=("held_out",))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document that it reaches over near ones."""
    found = simhash.near_duplicates(documents(spark, sf_dir), words=3, bits=64, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as boilerplate of its source, and a digest of the text left."""
    found = lines.drop_boilerplate(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of cosine 0.98 or more within a label."""
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 35 words found elsewhere too cover, and a digest of the rest."""
    return substrings.remove(documents(spark, sf_dir), length=35, digest=True)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return packing.best_fit_pack(documents(spark, sf_dir), tokenizer_path(BYTE_TOKENIZER), 2, 1024)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a lossless WebP image, read back with features."""
    return media.read_media(media.write_media(documents(spark, sf_dir)), pixels=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted faults: their faults, the cheapest repair, its cost and a digest of what it gives."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversations.repair(conversations.damage(rows))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    kept, digest = found.report.withColumnRenamed("conv_id", "of"), conversations.digests(found.blocks).withColumnRenamed("conv_id", "repaired")
    every = rows.select("conv_id").distinct().join(kept, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(digest, F.col("conv_id").eqNullSafe(F.col("repaired")), "left")
    return every.select("conv_id", *[c.alias(n) for n, c in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in windows of 10 words of the benchmark, and the items that they come from."""
    found = decontaminate.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=10)
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with planted slips, and the words one edit away that they may stand for."""
    words = spelling.vocabulary(documents(spark, sf_dir), least_length=5, least_count=3, change=spelling.planted)
    return spelling.group_variants(words, ratio=2)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS random
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[1 + (place - 1) % 3] AS weight, source_size * 3.0::DOUBLE AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources)),
spread AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER w, 0.0::DOUBLE) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS rest
  FROM weighed WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (
  SELECT capped, rest FROM spread WHERE (total - capped) * weight <= cap * rest ORDER BY cap / weight, place LIMIT 1),
targets AS (
  SELECT s.source, s.source_size, CASE WHEN stop.rest IS NULL THEN s.cap ELSE least(s.cap, (s.total - stop.capped) * s.weight / stop.rest) END AS target
  FROM spread s LEFT JOIN stop ON TRUE),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.random, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size
             + greatest(0, least(size, budget - budget // source_size * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM placed
"""


LINES_SQL = r"""
WITH pages AS (SELECT *, row_number() OVER () AS page FROM documents),
parts AS (
  SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM pages WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
often AS (
  SELECT c.source, c.line FROM (
    SELECT source, line, count(DISTINCT page) AS on_pages FROM parts WHERE trim(line) <> '' GROUP BY source, line) c
  JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.on_pages > 1 AND c.on_pages > 0.1::DOUBLE * t.n),
kept AS (
  SELECT p.page, count(*) AS n_lines, count(*) FILTER (o.line IS NOT NULL) AS n_dropped,
         coalesce(string_agg(p.line, chr(10) ORDER BY p.place) FILTER (o.line IS NULL), '') AS text
  FROM parts p LEFT JOIN often o ON p.source IS NOT DISTINCT FROM o.source AND p.line = o.line
  GROUP BY p.page)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM pages d LEFT JOIN kept k ON d.page = k.page
"""


LEAKS_SQL = r"""
WITH cut AS (
  SELECT r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)),
places AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM cut),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL),
starts AS (
  SELECT item_id, words, least(10, len(words)) AS n, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS i
  FROM items WHERE len(words) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win FROM starts),
sizes AS (SELECT DISTINCT n FROM wins),
runs AS (
  SELECT p.r, p.i, s.n, array_to_string(c.words[p.i:p.i + s.n - 1], ' ') AS win
  FROM places p JOIN cut c ON p.r = c.r JOIN sizes s ON p.i + s.n - 1 <= len(c.words)
  WHERE p.word IN (SELECT split_part(win, ' ', 1) FROM wins)),
hits AS (SELECT u.r, u.i, u.n, w.item_id FROM runs u JOIN wins w ON u.n = w.n AND u.win = w.win),
marks AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS place FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT c.doc_id, len(c.words)::BIGINT AS n_words, coalesce(m.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM cut c LEFT JOIN marks m ON c.r = m.r LEFT JOIN named k ON c.r = k.r
"""


VECTORS_SQL = r"""
WITH RECURSIVE vecs AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND coalesce(list_max(list_transform(embedding, lambda v: abs(v))), 0) > 0 AS good
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.good AND b.good AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM vecs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degrees AS (SELECT a, count(DISTINCT b) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n_links, 0)::BIGINT AS n_links, p.component_id, v.vec_id = p.component_id AS kept
FROM vecs v JOIN parts p ON v.vec_id = p.a LEFT JOIN degrees d ON v.vec_id = d.a
"""


SUBSTRINGS_SQL = r"""
WITH cut AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
starts AS (SELECT r, unnest(range(1, len(words) - 33)) AS i FROM cut WHERE len(words) >= 35),
wins AS (SELECT s.r, s.i, md5(array_to_string(c.words[s.i:s.i + 34], ' ')) AS win FROM starts s JOIN cut c ON s.r = c.r),
twice AS (SELECT r, i FROM wins WHERE win IN (SELECT win FROM wins GROUP BY win HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM twice),
lists AS (SELECT r, list(i) AS own FROM gone GROUP BY r)
SELECT c.doc_id, len(c.words)::BIGINT AS n_words, coalesce(len(g.own), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN g.own IS NULL THEN c.words ELSE list_filter(c.words, lambda w, k: NOT list_contains(g.own, k)) END, ' ')) AS kept_sha256
FROM cut c LEFT JOIN lists g ON c.r = g.r
"""


def queries() -> dict:
    """Queries by name."""
    return {
        "op1_language_id": op1_language_id,
        "op2_token_files": op2_token_files,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_mix_sources": op6_mix_sources,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_media_columns": op10_media_columns,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_benchmark_decontamination": op12_benchmark_decontamination,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express."""
    return {"op5_line_dedup": LINES_SQL, "op6_mix_sources": MIX_SQL, "op7_embedding_near_dedup": VECTORS_SQL, "op8_substring_dedup": SUBSTRINGS_SQL, "op12_benchmark_decontamination": LEAKS_SQL}
