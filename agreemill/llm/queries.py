"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agreemill.llm import chat, chroma, decontam, htmltext, langid, licenses, negatives, packing, quality, simhash, spelling, tokencount, toxicity
from agreemill.llm.common import table


def op1_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.tune_classes(table(spark, sf_dir, "embeddings"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.page_texts(table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_blocks(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(table(spark, sf_dir, "conversations"))


def op8_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.edited_documents(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicate_components(table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(spark, sf_dir)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.documents(spark, sf_dir)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chroma": op1_chroma,
        "op2_langid": op2_langid,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_htmltext": op5_htmltext,
        "op6_licenses": op6_licenses,
        "op7_chat": op7_chat,
        "op8_tokencount": op8_tokencount,
        "op9_simhash": op9_simhash,
        "op10_decontam": op10_decontam,
        "op11_negatives": op11_negatives,
        "op12_quality": op12_quality,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_chat": chat.ORACLE_SQL,
        "op10_decontam": decontam.ORACLE_SQL,
        "op11_negatives": negatives.ORACLE_SQL,
        "op12_quality": quality.ORACLE_SQL,
        "op13_spelling": spelling.ORACLE_SQL,
    }
