"""The corpus pipeline: stages over ``documents``, each written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept;
``labels`` and ``benchmark`` are read from ``sf_dir``.  All but the last return
the columns of ``documents``.  Null and empty texts pass every filter that they
give no reason to fail; rows without an id are never taken for copies by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontaminate, neardup, pii, quality
from tallyspark.llm.queries import table, tokenizer_file
from tallyspark.llm.shared import written


def _free(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from those with labels, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "_quality")
    return model.score(docs, into=score).where(F.col(score) >= 0.3).select(*docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; of equal rows one."""
    groups = neardup.near_duplicates(docs)
    others = groups.where("component_id < id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(others, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    found = _free(docs, "_overlaps")
    return decontaminate.marked(docs, table(spark, sf_dir, "benchmark"), into=found).where(
        F.col(found).isNull() | (F.size(found) == 0)).select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` counts the new text."""
    out = pii.redacted(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
        F.char_length("text").cast("long"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and of the decoded text of every document."""
    return bpe.digests(docs, tokenizer_file()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", good), ("near_duplicates", single), ("decontamination", clean), ("personal_data", private), ("tokens", tokens)]
#: SQL has neither the trained models nor the tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
