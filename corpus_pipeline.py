"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import jaccard, langid, mixing, packing, suffix
from faultline.scale import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones show; texts without a letter go.

    Null and empty texts have no letter, and where nothing is labelled all go; repeated rows stay
    repeated, a tie goes to the language first by code point, and columns stay as they came.
    """
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest doc_id of a group stays. Rows that share that id all stay, as do rows without an
    id, and texts without words, which link with nothing.
    """
    return jaccard.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that occur more than once.

    Every copy goes, the first too: such passages are boilerplate, and which copy comes first is
    an accident of numbering. A text that loses all its words is dropped, one that had none stays,
    null or empty; repeated rows with texts of over 50 words are copies of each other and lose them.
    """
    return suffix.without_repeats(docs, suffix.Words(suffix.PASSAGE))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null texts have no words; a source without words has target 0, so its documents go; a null
    source is a source of its own; rows alike in source, id and size are taken together.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in training sequences.

    A null or empty text is a piece of the closing id alone; repeated rows are packed each; an
    empty table gives no rows. Columns other than doc_id and text are not returned.
    """
    return packing.pack(packing.tokenised(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates),
          ("repeated_strings", repeated_strings), ("mixture", mixture), ("packed", packed)]

#: Shingle components, byte strings and packing have no SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
