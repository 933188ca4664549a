"""A training corpus from raw documents: languages, near-duplicates, repeated passages, mixing, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, langid, mixing, simhash, substring
from tidemark.llm._common import durable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts, those without a letter and those the network takes for random bytes go.

    All columns stay, whatever their names; repeated rows and null ids are judged by their text alone; a long text is judged
    by all its windows; an empty table stays empty, and one without labels only loses texts without a letter.
    """
    return langid.reject(docs, langid.fit(docs, noise=True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group that links of 0.8 Jaccard similarity of five-word shingles connect.

    Null and wordless texts are one group; rows that repeat an id are one document; rows without an id stay; ties don't
    occur as ids differ; long texts are compared whole; an empty table stays empty; all columns stay.
    """
    return simhash.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document with a smaller id holds; one of which nothing is left goes.

    Null texts and rows without an id stay as they are; passages of a text itself don't count; texts are read whole; an
    empty table stays empty; all columns stay, ``n_chars`` becomes the new length where something was cut.
    """
    return substring.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: sources weigh 5, 2, 1 in turn and share 150% of all words.

    A null source is one of its own; null and wordless texts take nothing and go; rows that repeat an id are rounded alike;
    an empty table stays empty; all columns stay.
    """
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and digests of the ids and of what they decode to.

    One row a row, repeats included; null and empty texts have no tokens; null ids stay; long texts are encoded whole; no other
    column comes along; an empty table gives no rows.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, ranks=ranks, decoded=False).withColumnRenamed("raw", "ids")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Languages, similarity groups and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` one after another, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
