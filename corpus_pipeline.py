"""Corpus pipeline over ``documents``: drop toxic documents, drop repeated lines,
keep one document of every near-duplicate group, mix the sources to their
target sizes, pack the mix into training sequences.

A stage is (name, function); the function takes (spark, docs, sf_dir) and gives
the documents it keeps, which are written as Parquet and read again by the next
one.  All but the last stage return the columns of ``documents``; the last one
returns a row per packed piece.

Defined cases, for every stage: documents with null or empty texts are clean, have
no lines and link with nothing, and the mix leaves them out; null ids and sources
are kept like others; repeated rows are copies, of which one stays; an empty
table gives an empty one; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexkit.llm import line_dedup, mixing, ngram_join, packing, toxicity
from lexkit.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line; a document left
    without any word is dropped."""
    return line_dedup.without_matches(docs)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate component."""
    return ngram_join.one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated or cut as it takes them."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences with their token ids (little-endian, 32 bits):
    the mix repeats and cuts documents, so only the ids tell what was packed."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_per_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The label model, the cube method and the tokenizer have no SQL form;
#: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
