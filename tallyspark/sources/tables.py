"""Reading tables and texts, and writing slices out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import clean_names
from tallyspark.model import Dataset
from tallyspark.sources import versions


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header.  Types are inferred unless a schema is given; give one
    for large inputs, since inference reads the files twice."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.toDF(*clean_names(df.columns))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.toDF(*clean_names(df.columns))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text or Markdown file: ``source``, ``locator``, ``text``.
    Bytes that are not UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.lit("document").alias("locator"),
                        F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def create_table(df: DataFrame, path: str, batch_id: str) -> DataFrame:
    """First load of a table: clean names, a provenance column, and at least one row."""
    versions.create(df, path, batch_id)
    return versions.rows_of(df.sparkSession, path)


def write_csv(ds: Dataset, path: str) -> None:
    """The reader's rows of a slice, without the provenance column."""
    ds.frame.select(*ds.user_columns).write.mode("overwrite").option("header", True).csv(path)
