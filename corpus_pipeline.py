"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept. All but the last return the columns of documents, extra ones
and ones with names that the operators use themselves included; empty tables
give empty tables, and texts are read whole at any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agreemill.llm import decontam, langid, packing, simhash, toxicity
from agreemill.llm.common import forget, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, trained on ``labels``, calls toxic.

    Null and empty texts are scored as texts without words. Repeated rows and
    equal texts share their fate. Without labels of both kinds all rows stay.
    """
    return toxicity.harmless(docs, table(spark, sf_dir, "labels"))


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts far from every language that ``lang``
    names. Without any named language all texts with letters stay. Repeated rows
    and equal texts share their fate; a text as far as the floor stays, and of
    languages equally near the first by name counts."""
    return langid.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles,
    similarity 0.8 or more): the one of least doc_id.

    Null, empty and blank texts are copies of each other. Rows without an id stay.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of ``benchmark``. Null texts hold none;
    null and wordless items are held by none. Repeated rows share their fate,
    repeated items count as one; exactly the threshold's share is a hit."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents; a null or empty text is the end token alone. Repeated
    rows are packed as often as they stand; a tie between bins changes no length."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained scores, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, a written table between them,
    deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if i:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
