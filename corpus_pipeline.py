"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage works on all that the one before has kept. All but the last give whole rows with the columns of
``documents``; the last gives the tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from daypanel.llm import bpe, decontaminate, exact_dedup, near_join, toxicity
from daypanel.llm.common import read, shared_folder
from daypanel.llm.queries import vocabulary_path
from daypanel.sources import sinks


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of their language."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="_toxicity", flag="_is_toxic")
    return scored.filter("NOT _is_toxic").drop("_toxicity", "_is_toxic")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of equal text the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of connected near copies the document with the smallest id."""
    return near_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document."""
    return bpe.encode(docs, vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_join", near_join_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]
#: Trained models, alignments and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage before it is written to the shared folder and its input removed, so one
    table of documents stays there while the result is in use; it goes with the session."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    sinks.remove_at_end(spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
