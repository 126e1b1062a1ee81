"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``, whole rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordmill.llm import exact_dedup, language_id, mixing, sentencepiece_codec, setsketch_dedup
from wordmill.llm.durable import durable, remove
from wordmill.llm.names import column, unused
from wordmill.llm.queries import tokenizer_path

#: SQL has no counterpart of language identification or of a forward pass over pieces.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; the classifier is fitted on the labelled ones.

    Null, empty and letterless texts go, and so do all where no language label is to learn
    from. Rows that repeat an id or a text are judged alike. No rows in, no rows out.
    """
    return language_id.accepted(docs, language_id.train(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; a null id only where all are null.

    Null and empty text are equal. Of rows that repeat the id too, one stays (by a hash of the
    row). No rows in, no rows out.
    """
    return exact_dedup.keep_one_of_each(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) the one with the smallest id stays.

    Null, empty and blank texts and null ids are like nothing and stay; rows that repeat a
    kept id all stay. No rows in, no rows out.
    """
    return setsketch_dedup.keep_one_of_each(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in training order.

    Null sources are one source. A text without words is taken at most once. Rows that
    repeat an id are each taken as often as all of them together. No rows in, no rows out.
    """
    (position,) = unused(docs, "position")
    return mixing.in_training_order(docs, mixing.mix(docs), position_col=position).select(*map(column, docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and the digest of what the ids decode to, a row for each row.

    Null and empty text have no ids. No rows in, no rows out.
    """
    return sentencepiece_codec.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder; a stage's input goes once it was read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read = None
    for name, stage in STAGES:
        docs, before = durable(stage(spark, docs, sf_dir), f"stage-{name}"), read
        read = docs.inputFiles()[0].rpartition("/")[0] if docs.inputFiles() else None
        if before:
            remove(spark, before)
    return docs
