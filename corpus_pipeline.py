"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of `documents`;
what a stage decides takes effect: rejected documents and all but one of a group of copies are gone, secrets are
replaced in the text. run() writes each stage's result as Parquet to the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparcase.llm import common, exact_dedup, near_dedup, packing, quality_model, secret_scan
from sparcase.workers import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of `documents`, whatever others there are."""
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores under 0.7. Labels come from the labels table.

    Null texts are scored as empty ones, null ids have no label; every repeated row is judged alike. Without any usable
    label all scores are equal, 0.5 without labels. An empty table gives an empty one; columns beyond those of `documents`
    are left behind."""
    return quality_model.accepted(_documents(docs), common.read_table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, empty and null ones being equal, the document with the largest doc_id stays; null ids count as the
    smallest. Of rows alike in doc_id and text one stays. An empty table gives an empty one."""
    return exact_dedup.keep_one(_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays; null ids count as the largest. Of rows
    alike in doc_id and text one stays. Texts without words are duplicates of equal texts only; null counts as empty."""
    return near_dedup.keep_one(_documents(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by [SECRET]; n_chars follows. Documents without secrets stay as they are, null texts null; repeated
    rows and null ids stay."""
    clean = secret_scan.redact_documents(_documents(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 4096 tokens. A null or empty text is its end token; repeated rows and
    null ids are packed each; an empty table has no pieces."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packed", packed)]

#: None of the first stages can be written in SQL; tests/llm holds the pipeline against brute-force versions.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. A stage's result is removed once the next one's is written."""
    docs = common.read_table(spark, sf_dir, "documents")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _remove(spark, last)
        last = path
    return docs
