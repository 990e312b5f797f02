"""A training corpus from ``documents``: five stages, each on all that the one before it kept.

Each stage takes the session, its documents and the tables' folder, and returns a DataFrame that is written as Parquet and
read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, lines, mixing, packing, simhash, store
from tessella.llm.queries import BYTE_TOKENIZER, documents, fold, tokenizer_path

#: SimHash groups and token ids have no form in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def _recount(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``, with ``n_chars`` counted again where it is one of them."""
    return docs.select(*[F.length("text").cast("long").alias(n) if n == "n_chars" else F.col(n) for n in names])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, or of an uncertain language, go.

    Null, empty and blank texts go. Texts are judged whole, whatever their length; repeated rows are judged alike and all
    stay or go; nulls in other columns, and extra columns of any name, stay as they are. Without a labelled row no language
    is known and none stays; an empty table stays empty.
    """
    return langid.keep_known(docs, langid.fit(docs.where(fold() != 0)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source; every document stays.

    A null text stays null, and one that loses all its lines is empty; a null source is a source of its own; repeated rows
    count as pages. ``n_chars`` follows the text; extra columns of any name stay; an empty table stays empty.
    """
    return _recount(lines.drop_boilerplate(docs), docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id: five-word shingles, a similarity of 0.8 or more.

    Null, empty and blank texts have no shingle and are one group. Of rows with one id one stays, the same in every run;
    rows without an id all stay. Extra columns of any name stay; an empty table stays empty.
    """
    return simhash.keep_one(docs, words=5, bits=128, similarity=0.8)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, the one at a source's budget cut to the words that fit.

    Documents without words, null texts among them, weigh nothing and stay once; a null source is the last one; ties and
    repeated rows are told apart by hash. Extra columns of any name stay; an empty table stays empty.
    """
    return _recount(mixing.apply_mix(docs, mixing.mix(docs)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences of 1024: the columns of :func:`packing.pack`.

    A null or empty text is its end id alone; long texts are several pieces; repeated rows and rows without an id are
    documents of their own; an empty table gives no piece.
    """
    return packing.best_fit_pack(docs, tokenizer_path(BYTE_TOKENIZER), 2, 1024)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("mix_sources", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; what a stage wrote on its way is deleted once its result is written."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with store.temporary() as kept:
            docs = kept(store.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if last is not None:
            store.forget(last)
        last = docs
    return docs
