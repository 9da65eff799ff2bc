"""A training-data pipeline over ``documents``: toxicity, near copies, repeated passages, benchmark
leaks, tokens. Each stage works on all rows its predecessor kept; all but the last return the columns of
``documents``."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tastegrid.llm import byte_bpe, decontam, simhash, suffix_dedup, toxicity
from tastegrid.session import stage

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose SimHash fingerprints of 4-word shingles are linked, at 4 or fewer differing bits, that of
    least doc_id stays."""
    return simhash.one_of_each(docs, radius=4, width=4)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that stand earlier in the corpus are cut from the text."""
    return suffix_dedup.drop_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontam.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    return byte_bpe.with_tokens(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("suffix-array dedup", cut_repeats),
          ("benchmark decontamination", drop_leaks), ("byte-level BPE", tokenise)]

# SQL expresses neither the learned stage nor the suffix and fingerprint stages; tests/llm/test_pipeline.py holds
# the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
