"""Snapshots of a set of tables: Parquet per table and a manifest of row counts."""

from __future__ import annotations

import json
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.model import AnalysisError

MANIFEST = "_manifest"
COUNTS = "table_name string, n_rows long"
MANIFEST_SCHEMA = f"{COUNTS}, schema string"


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    out = spark.createDataFrame([], COUNTS)
    for p in parts:
        out = out.unionByName(p)
    return out


def create(spark: SparkSession, tables: Mapping[str, DataFrame], target: str) -> DataFrame:
    """Write every table, then the manifest, with the rows counted in what was
    written and the schema.  A target that holds anything is refused."""
    if _holds_files(spark, target):
        raise AnalysisError(f"{target} is not empty")
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{target}/{name}")
    counts = _union([_count(spark.read.schema(df.schema).parquet(f"{target}/{n}"), n) for n, df in tables.items()], spark)
    schemas = spark.createDataFrame([(n, df.schema.json()) for n, df in tables.items()], "table_name string, schema string")
    counts.join(schemas, "table_name").select(*[c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]).coalesce(1).write.mode(
        "error").parquet(f"{target}/{MANIFEST}")
    return manifest(spark, target)


def _holds_files(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").isEmpty()
    except AnalysisException:  # no such folder
        return False


def manifest(spark: SparkSession, source: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{source}/{MANIFEST}")
    except AnalysisException as problem:
        raise AnalysisError(f"{source} is not a snapshot: it has no manifest") from problem


def verify(spark: SparkSession, source: str) -> DataFrame:
    """One row per table of the manifest: expected rows, found rows (null when
    the files cannot be read) and whether they agree.

    A table is read in full, as its schema in the manifest has it, so that damage shows here."""
    expected = manifest(spark, source)
    found = []
    for row in expected.collect():  # one row per table
        try:
            df = spark.read.schema(T.StructType.fromJson(json.loads(row["schema"]))).parquet(f"{source}/{row['table_name']}")
            whole = df.agg(F.count(F.lit(1)), *[F.count(c) for c in df.columns]).first()
            found.append((row["table_name"], whole[0]))
        except (PySparkException, Py4JJavaError):
            found.append((row["table_name"], None))
    rows = spark.createDataFrame(found, "table_name string, found long")
    return expected.select("table_name", F.col("n_rows").alias("expected")).join(rows, "table_name", "left").withColumn(
        "ok", F.col("expected").eqNullSafe(F.col("found")))


def checked(spark: SparkSession, source: str, names: list[str] | None = None) -> DataFrame:
    """``verify``, refused if a table is damaged or one of ``names`` is missing."""
    found = verify(spark, source)
    known = {r["table_name"]: r["ok"] for r in found.collect()}  # one row per table
    lost = sorted(set(names or ()) - set(known))
    if lost:
        raise AnalysisError(f"the snapshot has no {', '.join(lost)}")
    bad = sorted(n for n, ok in known.items() if not ok)
    if bad:
        raise AnalysisError(f"the snapshot is damaged: {', '.join(bad)}")
    return found


def restore(spark: SparkSession, source: str, target: str, force: bool = False) -> DataFrame:
    """Copy a snapshot back, by the manifest's schemas, and check the counts of what was written.  Plain folders are
    overwritten one by one; ``versions.restore`` stages all tables before it switches to the first."""
    verified = checked(spark, source)
    schemas = {r["table_name"]: r["schema"] for r in manifest(spark, source).collect()}  # one row per table
    for name, schema in schemas.items():
        spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{source}/{name}").write.mode(
            "overwrite" if force else "error").parquet(f"{target}/{name}")
    back = _union([_count(spark.read.parquet(f"{target}/{n}"), n) for n in schemas], spark)
    out = verified.select("table_name", "expected").join(back.withColumnRenamed("n_rows", "restored"), "table_name")
    wrong = out.where("expected <> restored")
    if not wrong.isEmpty():
        raise AnalysisError("the restored tables do not have the snapshot's row counts")
    return out
