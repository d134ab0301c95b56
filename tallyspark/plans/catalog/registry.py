"""The register, and the datasets its queries are asked of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.model import ColumnMeta, Dataset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 2, **special: int) -> DataFrame:
    """Doubles rounded, and negative zero made zero: sums of doubles differ in
    their last bits with the order of the rows."""
    def one(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(F.col(f.name).cast("double"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.col(f.name).cast("string").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return F.col(f.name).cast("long").alias(f.name)
        return F.col(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def orders(spark: SparkSession, folder: str) -> Dataset:
    """Orders; an unspecified priority is a blank."""
    df = table(spark, folder, "orders").withColumn(
        "o_orderpriority", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")))
    return Dataset.open(df, [
        ColumnMeta("o_orderkey", "ignored"), ColumnMeta("o_custkey", "ignored"),
        ColumnMeta("o_orderstatus", "dimension", "generic", 3), ColumnMeta("o_totalprice", "measure", "currency"),
        ColumnMeta("o_orderdate", "date"), ColumnMeta("o_orderpriority", "dimension", "generic", 4)], "orders")


ORDERS = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)"""


def lineitem(spark: SparkSession, folder: str) -> Dataset:
    return Dataset.open(table(spark, folder, "lineitem"), [
        ColumnMeta("l_orderkey", "ignored"), ColumnMeta("l_partkey", "ignored"), ColumnMeta("l_suppkey", "ignored"),
        ColumnMeta("l_linenumber", "dimension", "generic", 7), ColumnMeta("l_quantity", "measure", "count"),
        ColumnMeta("l_extendedprice", "measure", "currency"), ColumnMeta("l_discount", "measure", "percentage"),
        ColumnMeta("l_tax", "measure", "percentage"), ColumnMeta("l_returnflag", "dimension", "generic", 3),
        ColumnMeta("l_linestatus", "dimension", "generic", 2), ColumnMeta("l_shipdate", "date")], "lineitem")


def events(spark: SparkSession, folder: str) -> Dataset:
    """Events; an error carries no value."""
    df = table(spark, folder, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return Dataset.open(df, [
        ColumnMeta("event_id", "ignored"), ColumnMeta("ts", "date"), ColumnMeta("user_id", "ignored"),
        ColumnMeta("event_type", "dimension", "generic", 5), ColumnMeta("value", "measure", "count"),
        ColumnMeta("props", "ignored")], "events")


EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value,
  props FROM events)"""


def sales(spark: SparkSession, folder: str) -> Dataset:
    """Orders with the market segment, nation and region of their customer."""
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"),
                                                 F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    df = table(spark, folder, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "c_mktsegment", "n_name", "r_name")
    return Dataset.open(df, [
        ColumnMeta("o_orderkey", "ignored"), ColumnMeta("o_orderdate", "date"),
        ColumnMeta("o_totalprice", "measure", "currency"), ColumnMeta("r_name", "dimension", "branch", 5),
        ColumnMeta("c_mktsegment", "dimension", "business_unit", 5), ColumnMeta("n_name", "dimension", "generic", 25),
        ColumnMeta("o_orderstatus", "dimension", "generic", 3)], "sales")


SALES = """s AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderstatus, c_mktsegment, n_name, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def periods_sql(source: str, date: str, grain: str = "month") -> str:
    """CTE ``p``: the latest period b0..b1 and the one before, a0..a1, both cut
    to the days there are."""
    return f"""e AS (SELECT max({date})::DATE AS d FROM {source}),
q AS (SELECT d, date_trunc('{grain}', d)::DATE AS b0,
  (date_trunc('{grain}', d) + INTERVAL 1 {grain} - INTERVAL 1 DAY)::DATE AS b9,
  (date_trunc('{grain}', d) - INTERVAL 1 {grain})::DATE AS a0,
  (date_trunc('{grain}', d) - INTERVAL 1 DAY)::DATE AS a9 FROM e),
p AS (SELECT d, b0, d AS b1, a0, CASE WHEN d = b9 THEN a9 ELSE least(a9, a0 + (d - b0)::INTEGER) END AS a1, b9
  FROM q)"""
