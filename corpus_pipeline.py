"""From raw documents to token ids: quality, near copies, test passages, personal data, byte-level BPE.

A document without a doc_id takes part like any other; see the operators for null texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, pii, quality_knn, simhash
from gridloom.llm._shared import staged, table, unused
from gridloom.llm.token_store import tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the votes of labelled neighbours don't reject."""
    model = quality_knn.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality_knn.rejecting(docs, model, score).filter(F.col(score) >= quality_knn.THRESHOLD).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that cover no test item."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.masked(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every document, and digests of the ids and of the text that they decode to."""
    return bpe.digests(docs, tokenizer_file("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_copies), ("benchmark decontamination", test_passages), ("pii", personal_data), ("bpe encoding and decoding", tokens)]

#: SQL can express neither the classifier nor the tokenizer; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
