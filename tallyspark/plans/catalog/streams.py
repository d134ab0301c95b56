"""Streaming forms, run over the events as a stream that ends."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.plans.catalog.registry import query, rounded, table
from tallyspark.session import fresh_folder
from tallyspark.streaming import jobs


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return jobs.read_files(spark, folder, schema, "events.parquet")


def _clocked(spark: SparkSession, folder: str, more: str) -> DataFrame:
    """The events and, after the last of them, one tick of a clock that closes what is open."""
    ticks = fresh_folder(spark)
    table(spark, folder, "events").agg((F.max("ts") + F.expr(f"INTERVAL {more}")).alias("ts")).coalesce(1).write.parquet(ticks)
    return jobs.with_clock(_stream(spark, folder), spark.readStream.schema("ts timestamp_ntz").parquet(ticks), "ts")


def _finished(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Run a stream to its end, appending to Parquet files, and read them."""
    out, state = fresh_folder(spark), fresh_folder(spark)
    df.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option(
        "path", out).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _trend_sql(key: str) -> str:
    return f"""SELECT strftime({key}, '%Y-%m-%d') AS period_key, event_type, round(sum(value), 2) AS value, count(*) AS n_rows
FROM events GROUP BY {key}, 2"""


@query("stream_trend_day", _trend_sql("date_trunc('day', ts)"))
def stream_trend_day(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_finished(spark, jobs.closed_trend(_clocked(spark, folder, "'3' DAY"), "ts", "value", "day", keys=["event_type"])))


@query("stream_trend_week", _trend_sql("date_trunc('week', ts)"))
def stream_trend_week(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_finished(spark, jobs.closed_trend(_clocked(spark, folder, "'12' DAY"), "ts", "value", "week", keys=["event_type"])))


@query("stream_trend_month", _trend_sql("date_trunc('month', ts)"))
def stream_trend_month(spark: SparkSession, folder: str) -> DataFrame:
    return _calendar(spark, folder, "month")


def _calendar(spark: SparkSession, folder: str, grain: str) -> DataFrame:
    out = fresh_folder(spark)
    jobs.add_to_trend(_stream(spark, folder), "ts", "value", grain, out, fresh_folder(spark), ["event_type"]).awaitTermination()
    return rounded(jobs.trend_so_far(spark, out, ["event_type"]))


@query("stream_trend_quarter", _trend_sql("date_trunc('quarter', ts)"))
def stream_trend_quarter(spark: SparkSession, folder: str) -> DataFrame:
    return _calendar(spark, folder, "quarter")


@query("stream_append", "SELECT 'live' AS _batch, count(*) AS n_rows, count(DISTINCT event_id) AS ids, round(sum(value), 2) AS value FROM events")
def stream_append(spark: SparkSession, folder: str) -> DataFrame:
    """Every event arrives twice and is stored once."""
    twice = _stream(spark, folder).unionByName(_stream(spark, folder))
    out = fresh_folder(spark)
    jobs.append_to(jobs.without_duplicates(twice, ["event_id"], "ts", "60 days"), out, fresh_folder(spark), "live").awaitTermination()
    return rounded(spark.read.parquet(out).groupBy("_batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("ids"), F.sum("value").alias("value")))


@query("stream_alerts", """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS k, sum(value) AS v FROM events GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN v > 50 THEN 'firing' ELSE 'ok' END AS state FROM h)
SELECT event_type || ' above 50' AS alert_id, strftime(k + INTERVAL 1 HOUR, '%Y-%m-%d %H') AS at, round(v, 2) AS value, state,
  state = 'firing' AND coalesce(lag(state) OVER (PARTITION BY event_type ORDER BY k), 'pending') <> 'firing' AS fired FROM s""")
def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly values per event type against a threshold; hours close with the watermark, the last ones with a clock."""
    hourly = jobs.closed_periods(_clocked(spark, folder, "'2' HOUR"), "ts", "value", "1 hour", "0 seconds", ["event_type"]).select(
        F.col("event_type").alias("measure"), F.col("w.end").alias("at"), "value")
    rules = table(spark, folder, "events").select(F.col("event_type").alias("measure")).distinct().select(
        F.concat("measure", F.lit(" above 50")).alias("alert_id"), "measure", F.lit("gt").alias("op"),
        F.lit(50.0).alias("threshold"))
    return rounded(_finished(spark, jobs.alert_evaluations(hourly, rules)).withColumn("at", F.date_format("at", "yyyy-MM-dd HH")))
