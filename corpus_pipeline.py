"""Corpus pipeline: toxicity, quality, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; the result is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifspark.llm import minhash, packing, quality, suffix_dedup, toxicity
from motifspark.llm.common import read, shared_folder
from motifspark.llm.queries import tokenizer


def _aside(docs: DataFrame, new: list[str], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(docs) with the columns of docs alone; those named, in any case, like columns that f adds are set aside meanwhile."""
    names = {c: f"__own_{c}" for c in docs.columns if c.lower() in new}
    return f(docs.withColumnsRenamed(names)).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity the ordinal model does not reject, with all their columns, whatever their names.

    Null and empty texts have no words, so they stay; very long texts are read whole. Repeated rows, and rows whose id is
    null, are rows like any other. Without labels nothing is rejected. An empty table gives one.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return _aside(docs, ["severity", "p_toxic", "rejected"], lambda d: toxicity.score(d, model).filter("not rejected"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours vote good, with all their columns, whatever their names.

    For a null or empty text all labelled texts vote alike; very long texts are read whole; of neighbours that tie, all
    vote. Repeated rows, and rows whose id is null, are rows like any other. Without labels all stay. An empty table gives one.
    """
    voters = quality.fit(docs, read(spark, sf_dir, "labels"))
    return _aside(docs, ["score", "predicted"], lambda d: quality.score(d, voters).filter("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates (five words, similarity 0.8), with all its columns.

    Null ids come last, ties go by a hash of the text. Null texts and texts without words are near to none: all stay. Of
    repeated rows one stays. Very long texts are read whole. An empty table gives one.
    """
    return minhash.keep_one(docs, words=5, percent=80).select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that occur in more than one place; n_chars is what is left.

    Null texts become empty; texts under 200 bytes stay as they are. Repeated rows repeat each other, so both lose their
    text. Very long texts are read whole. Other columns stay, whatever their names. An empty table gives one.
    """
    cut = _aside(docs, ["n_bytes", "n_removed", "n_spans", "kept_sha256"], suffix_dedup.dedup)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; every id of every row, null and empty texts and repeated rows included, is in one piece."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_filter), ("quality", quality_filter), ("near_dedup", near_dedup), ("suffix_dedup", passage_dedup), ("packing", pack)]

#: No stage can be said in SQL; tests/llm/test_pipeline.py holds each against a plain version on that stage's own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
