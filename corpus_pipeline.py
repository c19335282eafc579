"""A corpus from documents to token files: each stage works on all that its predecessor kept and is written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lutework.llm import decontam, mixing, nearcopies, tokens, toxicity
from lutework.llm.common import MADE, discard, table, written
from lutework.llm.queries import END_ID, TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels of these documents, scores below 0.5."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more), the one with the smallest id: the links of the
    SimHash index and, since it can't see so far, those that counts of all shingles find."""
    return nearcopies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target shares: a document comes as often as the mix takes it."""
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, and what they hold of each document."""
    return tokens.encoded(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_ids", token_ids),
]

#: The stages run trained models and hashes that SQL lacks; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage and its operators wrote is deleted when the next stage's output is there."""
    docs, before = table(spark, sf_dir, "documents"), len(MADE)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(spark, MADE[before:-1])
        del MADE[before:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
