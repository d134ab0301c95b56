"""Streams: appending without duplicates, trends with late rows, alerts with memory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyspark.functions import periods
from tallyspark.functions.numbers import number

ALERT_OUTPUT = "alert_id string, at timestamp, value double, state string, fired boolean"
# Windows start on a Monday: the epoch was a Thursday.
_WINDOWS = {"day": ("1 day", None), "week": ("7 days", "4 days")}


def read_files(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000
               ) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def without_duplicates(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats of ``keys`` that arrive within the delay; state older than
    the watermark is forgotten."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(
        list(keys))


def append_to(stream: DataFrame, path: str, checkpoint: str, batch_id: str) -> StreamingQuery:
    """Append all available rows to a Parquet table, exactly once, then stop."""
    return (stream.withColumn("_batch", F.lit(batch_id)).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).partitionBy("_batch")
            .trigger(availableNow=True).start())


def trend(stream: DataFrame, ts: str, measure: str, grain: str = "day", delay: str = "2 days",
          keys: Sequence[str] = ()) -> DataFrame:
    """Sum and rows per period.  Days and weeks are event-time windows and can be
    appended once closed; longer grains are calendar keys, for update mode."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    value = [F.sum(number(measure)).alias("value"), F.count(F.lit(1)).alias("n_rows")]
    if grain in _WINDOWS:
        length, offset = _WINDOWS[grain]
        window = F.window(ts, length, length, offset) if offset else F.window(ts, length)
        return rows.groupBy(window.alias("w"), *keys).agg(*value).select(
            F.col("w.start").cast("date").alias("period_key"), *keys, "value", "n_rows")
    return rows.groupBy(periods.key(F.col(ts), grain).alias("period_key"), *keys).agg(*value)


def with_clock(stream: DataFrame, clock: DataFrame, ts: str) -> DataFrame:
    """``stream`` and the ticks of ``clock`` (one column of times; all other columns are null): time goes on, and
    what is open is closed, when no rows come.  A ``rate`` source is such a clock."""
    tick = clock.select(F.col(clock.columns[0]).cast(stream.schema[ts].dataType).alias(ts), F.lit(True).alias("_tick"))
    return stream.withColumn("_tick", F.lit(False)).unionByName(tick, allowMissingColumns=True)


def closed_periods(stream: DataFrame, ts: str, measure: str, length: str, delay: str = "2 days", keys: Sequence[str] = (),
                   offset: str | None = None) -> DataFrame:
    """Sum and rows of windows, each given once, when the watermark has passed it; its state is then dropped.
    Rows later than ``delay`` are left out.  Ticks of ``with_clock`` move the watermark and nothing else."""
    rows = stream if "_tick" in stream.columns else stream.withColumn("_tick", F.lit(False))
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    window = F.window(ts, length, length, offset) if offset else F.window(ts, length)
    real = ~F.col("_tick")
    # keys are given back as aggregates: a condition on them must not be pushed below the watermark, to ticks that have none
    given = {k: f"_key{i}" for i, k in enumerate(keys)}
    out = rows.groupBy(window.alias("w"), *[F.col(k).alias(g) for k, g in given.items()]).agg(
        *[F.max(k).alias(k) for k in keys], F.sum(F.when(real, number(measure))).alias("value"), F.count_if(real).alias("n_rows"))
    return out.where("n_rows > 0").select("w", *keys, "value", "n_rows")


def closed_trend(stream: DataFrame, ts: str, measure: str, grain: str = "day", delay: str = "2 days", keys: Sequence[str] = ()) -> DataFrame:
    """Days or weeks as ``period_key``, appended once closed."""
    length, offset = _WINDOWS[grain]
    return closed_periods(stream, ts, measure, length, delay, keys, offset).select(
        F.col("w.start").cast("date").alias("period_key"), *keys, "value", "n_rows")


def add_to_trend(stream: DataFrame, ts: str, measure: str, grain: str, out: str, checkpoint: str, keys: Sequence[str] = ()) -> StreamingQuery:
    """Calendar periods of any length without state: every batch writes its own sums under its number, so a batch
    that is run again replaces itself, and a late row counts whenever it comes.  ``trend_so_far`` adds them up."""
    def step(batch: DataFrame, number_: int) -> None:
        parts = batch.groupBy(periods.key(F.col(ts), grain).alias("period_key"), *keys).agg(
            F.sum(number(measure)).alias("value"), F.count(F.lit(1)).alias("n_rows"))
        parts.write.mode("overwrite").parquet(f"{out}/batch={number_}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def trend_so_far(spark: SparkSession, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """The periods of all batches of ``add_to_trend``."""
    return spark.read.parquet(f"{out}/batch=*").groupBy("period_key", *keys).agg(
        F.sum("value").alias("value"), F.sum("n_rows").alias("n_rows"))


class _Alert(StatefulProcessor):
    """One alert: the state it was last in, kept until it has had no evaluation for ``forget`` milliseconds of event time."""

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        was, newest = (before[0], before[1]) if before else ("pending", None)
        for r in sorted(rows, key=lambda r: r["at"]):  # one row per period
            yield Row(alert_id=key[0], at=r["at"], value=r["value"], state=r["state"], fired=r["state"] == "firing" and was != "firing")
            was, newest = r["state"], r["at"]
        self.last.update((was, newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(newest.timestamp() * 1000) + self.forget)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def alert_evaluations(values: DataFrame, rules: DataFrame, forget_days: int = 400) -> DataFrame:
    """Every evaluation of threshold alerts over a stream of closed periods (``measure``, ``at``, ``value``; ``at``
    under a watermark), once each: ``alert_id``, ``at``, ``value``, ``state``, ``fired``.

    The state of an alert is keyed by its id and lives in the checkpoint: an alert fires on entering ``firing`` and
    is armed again by any other state, across batches and restarts.  An alert without evaluations for ``forget_days``
    is forgotten by an event-time timer.  ``rules`` (``alert_id``, ``measure``, ``op``, ``threshold``) is static."""
    spark = values.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    watched = values.join(rules, "measure").select("alert_id", "at", "value", _state().alias("state"))
    return watched.groupBy("alert_id").transformWithState(
        _Alert(forget_days * 86_400_000), ALERT_OUTPUT, "append", "EventTime", eventTimeColumnName="at")


def _state() -> Column:
    v, t = F.col("value"), F.col("threshold")
    over = (F.when(F.col("op") == "lt", v < t).when(F.col("op") == "lte", v <= t)
            .when(F.col("op") == "gt", v > t).when(F.col("op") == "gte", v >= t))
    return F.when(over.isNull(), "pending").when(over, "firing").otherwise("ok")


def follow_alerts(values: DataFrame, rules: DataFrame, out: str, states: str, checkpoint: str) -> StreamingQuery:
    """States of threshold alerts over a stream of evaluations (``measure``,
    ``at``, ``value``); an alert fires on entering ``firing`` only.

    ``rules`` (``alert_id``, ``measure``, ``op``, ``threshold``) is the static
    registry.  Each batch reads the last states left by the batch before and
    writes its own under its number, so a batch that is run again after a
    failure gives the same files.  Values should be aggregated first: what
    reaches an alert is one row per evaluation."""
    watched = values.join(rules, "measure").select("alert_id", F.col("at").cast("timestamp").alias("at"), "value",
                                                   _state().alias("state"))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], "alert_id string, last_state string")
        if number > 0:
            before = spark.read.schema(before.schema).parquet(f"{states}/{number - 1}")
        order = Window.partitionBy("alert_id").orderBy("at")
        rows = batch.withColumn("_before", F.lag("state").over(order)).join(before, "alert_id", "left")
        was = F.coalesce("_before", "last_state", F.lit("pending"))
        rows.select("alert_id", "at", "value", "state", ((F.col("state") == "firing") & (was != "firing")).alias(
            "fired")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        written = spark.read.schema("alert_id string, at timestamp, state string").parquet(f"{out}/batch={number}")
        newest = written.groupBy("alert_id").agg(F.max_by("state", "at").alias("last_state"))
        kept = before.join(newest, "alert_id", "left_anti")
        newest.unionByName(kept).write.mode("overwrite").parquet(f"{states}/{number}")

    return (watched.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(step).start())
