"""A corpus in five stages: quality, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.llm.common import table, written
from harrow.llm.language import keep_known
from harrow.llm.ngram_join import keep_one
from harrow.llm.packing import pack
from harrow.llm.quality import keep_good
from harrow.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject.

    Null and empty texts are judged by the score of no words; nulls in other columns and repeated rows change nothing for a row. Of an empty table nothing is left.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language.

    Null and empty texts, and those without a letter, go. Null languages aren't learned from, and their rows are judged like others. Of an empty table nothing is left.
    """
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: that with the smallest doc_id.

    Null and empty texts are near nothing and stay; rows with a null doc_id stay; rows that repeat a doc_id stay or go together. Of an empty table nothing is left.
    """
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and the number of characters put right. Null texts stay null, and an empty table empty."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in windows. Null and empty texts are one piece, the end id; repeated rows are packed each; an empty table gives no rows."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Classifiers, decoding and packing are not expressible in SQL; tests/llm/ holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every other stage is written to the shared folder once and read from there by the next one, which may read it several times."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
