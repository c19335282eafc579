"""The registered corpus queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, htmlcrf, importance, licenses, linededup, mixing, pii, quality, simhash, spelling, tokens, toxicity
from .common import table

TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: A conversation whose texts are control strings of other templates.
CONTROL_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, rows.schema)
    paths = chat.best_paths(chat.linear_messages(rows.unionByName(more)))
    return chat.digest(chat.formatted(paths))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_licenses": op4_licenses,
    "op5_html_text": op5_html_text,
    "op6_simhash": op6_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_token_ids": op8_token_ids,
    "op9_toxicity": op9_toxicity,
    "op10_chat": op10_chat,
    "op11_spelling": op11_spelling,
    "op12_importance": op12_importance,
    "op13_pii": op13_pii,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE_SQL,
    "op2_quality": quality.ORACLE_SQL,
    "op3_line_dedup": linededup.ORACLE_SQL,
    "op7_decontamination": decontam.ORACLE_SQL,
    "op10_chat": chat.ORACLE_SQL,
    "op11_spelling": spelling.ORACLE_SQL,
    "op12_importance": importance.ORACLE_SQL,
}
