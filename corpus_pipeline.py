"""A corpus pipeline of five stages, each over all rows that the one before it kept.

Language ID drops documents that it rejects; the n-gram Jaccard join keeps the first document of each component (by doc_id,
rows without one last; of repeated rows one); decontamination drops documents that hold a benchmark item; the secret scan
puts a mark in place of secrets; packing gives the windows. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard_join, langid, packing, secrets
from millrace.llm.shared import scratch, shared_dir


def written(docs: DataFrame) -> DataFrame:
    """docs with a written number of each row, _row: an id may be null or stand in several rows."""
    return scratch(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the training rows have; n_chars and all other columns as they were."""
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~langid.held_out()))
    return langid.predict(docs, model).where("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with the smallest doc_id. Rows without words link to none and stay."""
    rows = written(docs)
    found = jaccard_join.numbered_components(rows.select(F.col("_row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone = found.where("row <> first_row").select(F.col("row").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = written(docs)
    hit = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(hit, "_row", "left_anti").select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets marked; n_chars is that of the new text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secret_redaction),
    ("packing", windows),
]

#: Language ID is a trained model: SQL can't express the stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
