"""Cleaning and packing of a text corpus: each stage reads what the one before it kept.

Toxic documents go, then exact copies, then near copies, then repeated passages;
what is left is packed into token sequences. Every stage's result is written as
Parquet and read again as the next one's documents.

Rows are told apart by id and text: a repeated or missing id never takes another
text with it, and rows that repeat as a whole stay or go together. Null texts count
as empty; an empty document stays one of the sequences' documents, and of equal
empty ones one is kept. Of equal texts the largest id stays, of near ones the
smallest. Further columns are carried along unread, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from urbanframe.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from urbanframe.llm.common import read_table, shared


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose fingerprints of three-word shingles differ by three bits or fewer the smallest doc_id stays."""
    return simhash.keep_one(docs, words=3, max_bits=3)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of passages of 100 bytes or more the first one stays; every document stays, shortened."""
    return suffix_dedup.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("simhash_near_dedup", near_copies_out),
    ("suffix_array_dedup", passages_out),
    ("best_fit_packing", packed),
]

# A classifier, fingerprints and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
