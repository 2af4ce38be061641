"""A pipeline over ``documents``: toxicity, exact dedup, near-dedup, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next stage's
``docs``.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm.common import documents, shared_folder
from quillwork.llm.exact_dedup import exact_dedup
from quillwork.llm.mixing import mixed
from quillwork.llm.sentencepiece_bpe import encode
from quillwork.llm.simhash_dedup import without_near_copies
from quillwork.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the induced lexicon rejects go, each by its own text; null and empty ones stay, repeated rows fare alike.

    Labels come from ``labels``; of an empty table, or without labels of both classes, all rows stay.
    """
    return without_toxic(docs, documents(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space apart, the one with the smallest id stays; null and empty texts are equal, a null id comes last.

    Of repeated rows one stays; an empty table stays empty; other columns are passed on.
    """
    return exact_dedup(docs).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one with the smallest id stays; texts without words, null ones too, are one class.

    Very long texts are compared whole; of rows that repeat id and text one stays; an empty table stays empty.
    """
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them; a null source is one of its own, ties go by the hash of the id.

    Null and blank texts have no words, so nothing is taken of them; the document at the end of a budget comes in part; an empty
    table stays empty.
    """
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each document, every row for itself; null and empty texts have none, long ones are encoded whole."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixing), ("sentencepiece", encoding)]
#: The near-dedup, the lexicon and the merges can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        if before:  # its successor is written
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before), True)
        docs, before = spark.read.parquet(out), out
    return docs
