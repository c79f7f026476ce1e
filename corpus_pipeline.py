"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Defined results: no stage fails on nulls, empty or very long texts, repeated rows, empty
tables or further columns. A null text counts as empty, so the quality rules drop it;
later stages keep one (near-dedup one of all empty texts, packing its end id only). Rows
that repeat are judged one by one, and near-dedup leaves one of them. Ties (documents that
are alike) go to the smallest id; a null id counts as the largest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import jaccard, packing, quality, secrets, toxicity
from cotejo.llm.common import drop_tables, read_table, show_code, tables_written, write_and_read
from cotejo.llm.queries import held_out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the document rules and whose host is not refused."""
    show_code(spark)
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, by a model of this stage's own labelled documents."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, ~held_out(F.col("doc_id")))
    return toxicity.score_documents(docs, model).filter("score < 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of texts alike to 0.8 in five-word shingles.

    Operator 1's covering tables and, for the pairs beyond their reach, bands; each link is exact.
    """
    show_code(spark)
    return jaccard.drop_near_duplicates(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: doc_id, start, ids, doc_tokens, sequence_id, offset."""
    show_code(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Tokens cannot be had in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_table(spark, sf_dir, "documents"), tables_written()
    for _, stage in STAGES[:-1]:
        first = last
        docs = write_and_read(stage(spark, docs, sf_dir))
        last = tables_written() - 1  # the stage's result; what came before it has been read
        drop_tables(spark, first, last)
    return STAGES[-1][1](spark, docs, sf_dir)
