import datetime as dt

from pyspark.sql import functions as F

from tallyspark.streaming import jobs

SCHEMA = "id long, at timestamp, measure string, value double"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def day(d, h=12):
    return dt.datetime(2025, 1, d, h)


def test_alert_state_survives_between_runs(spark, tmp_path):
    src, out, states, check = (str(tmp_path / n) for n in ("in", "out", "states", "check"))
    rules = spark.createDataFrame([("a", "m", "gt", 10.0)], "alert_id string, measure string, op string, threshold double")

    def run():
        stream = jobs.read_files(spark, src, spark.read.parquet(src).schema)
        jobs.follow_alerts(stream.select("measure", "at", "value"), rules, out, states, check).awaitTermination()
        seen = spark.read.schema(jobs.ALERT_OUTPUT).parquet(f"{out}/batch=*")
        return [(r["at"].day, r["state"], r["fired"]) for r in seen.orderBy("at").collect()]

    land(spark, src, [(1, day(1), "m", 5.0), (2, day(2), "m", 20.0)])
    assert run() == [(1, "ok", False), (2, "firing", True)]
    land(spark, src, [(3, day(3), "m", 30.0), (4, day(4), "m", 1.0), (5, day(5), "m", 11.0)])
    assert run()[2:] == [(3, "firing", False), (4, "ok", False), (5, "firing", True)]


def test_repeats_are_stored_once_across_runs(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        stream = jobs.without_duplicates(jobs.read_files(spark, src, spark.read.parquet(src).schema), ["id"], "at", "30 days")
        jobs.append_to(stream, out, check, "live").awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    land(spark, src, [(1, day(1), "m", 1.0), (2, day(2), "m", 1.0)])
    assert run() == [1, 2]
    land(spark, src, [(2, day(2), "m", 1.0), (3, day(3), "m", 1.0)])
    assert run() == [1, 2, 3]


def test_weeks_start_on_monday(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    land(spark, src, [(1, day(5), "m", 1.0), (2, day(6), "m", 2.0), (3, day(31), "m", 4.0)])
    stream = jobs.trend(jobs.read_files(spark, src, spark.read.parquet(src).schema), "at", "value", "week", "0 seconds")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(
        availableNow=True).start().awaitTermination()
    closed = spark.read.parquet(out).orderBy("period_key").select(F.col("period_key").cast("string"), "value").collect()
    assert [tuple(r) for r in closed] == [("2024-12-30", 1.0), ("2025-01-06", 2.0)]


def ran(spark, df, out, check):
    df.writeStream.outputMode("append").option("checkpointLocation", check).trigger(availableNow=True).format("parquet").option(
        "path", out).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def test_alert_state_is_keyed_and_survives_restarts(spark, tmp_path):
    src, ticks, out, check = (str(tmp_path / n) for n in ("in", "ticks", "out", "check"))
    rules = spark.createDataFrame([("a", "m", "gt", 10.0), ("b", "m", "lte", 3.0), ("c", "k", "lt", 1.0)],
                                  "alert_id string, measure string, op string, threshold double")

    def tick(at):
        spark.createDataFrame([(at,)], "ts timestamp").coalesce(1).write.mode("append").parquet(ticks)

    def run():
        stream = jobs.with_clock(jobs.read_files(spark, src, SCHEMA), spark.readStream.schema("ts timestamp").parquet(ticks), "at")
        hours = jobs.closed_periods(stream, "at", "value", "1 hour", "0 seconds", ["measure"]).select("measure", F.col("w.end").alias("at"), "value")
        seen = ran(spark, jobs.alert_evaluations(hours, rules, forget_days=3), out, check)
        return [(r["alert_id"], r["at"].day, r["at"].hour, r["value"], r["state"], r["fired"]) for r in seen.orderBy("at", "alert_id").collect()]

    tick(day(1, 9))
    land(spark, src, [(1, day(1, 9), "m", 8.0), (2, day(1, 9), "m", 8.0), (3, day(1, 10), "m", 20.0), (4, day(1, 11), "k", 5.0)])
    first = run()  # the hours before eleven are closed, eleven is open
    assert first == [("a", 1, 10, 16.0, "firing", True), ("b", 1, 10, 16.0, "ok", False),
                     ("a", 1, 11, 20.0, "firing", False), ("b", 1, 11, 20.0, "ok", False)]
    tick(day(1, 12))  # nothing new but the time
    assert run()[4:] == [("c", 1, 12, 5.0, "ok", False)]
    land(spark, src, [(5, day(1, 13), "m", 2.0), (6, day(1, 14), "m", 30.0), (7, day(1, 9), "m", 99.0)])  # the last is too late
    tick(day(1, 15))
    assert run()[5:] == [("a", 1, 14, 2.0, "ok", False), ("b", 1, 14, 2.0, "firing", True),
                         ("a", 1, 15, 30.0, "firing", True), ("b", 1, 15, 30.0, "ok", False)]
    tick(day(9))  # forgotten, so that the next evaluation fires again
    run()
    land(spark, src, [(8, day(9, 13), "m", 40.0)])
    tick(day(9, 14))
    assert run()[9:] == [("a", 9, 14, 40.0, "firing", True), ("b", 9, 14, 40.0, "ok", False)]


def test_late_rows_on_both_sides_of_the_watermark(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    land(spark, src, [(1, day(1), "m", 1.0), (2, day(6), "m", 2.0)])

    def days():
        stream = jobs.read_files(spark, src, SCHEMA)
        return [(str(r["period_key"]), r["value"], r["n_rows"]) for r in ran(
            spark, jobs.closed_trend(stream, "at", "value", "day", "2 days"), out, check).orderBy("period_key").collect()]

    assert days() == [("2025-01-01", 1.0, 1)]
    land(spark, src, [(3, day(1), "m", 10.0), (4, day(5), "m", 20.0), (5, day(9), "m", 4.0)])  # too late, in time, new
    assert days() == [("2025-01-01", 1.0, 1), ("2025-01-05", 20.0, 1), ("2025-01-06", 2.0, 1)]


def test_calendar_periods_take_late_rows_and_repeated_batches(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def months():
        stream = jobs.read_files(spark, src, SCHEMA)
        jobs.add_to_trend(stream, "at", "value", "month", out, check, ["measure"]).awaitTermination()
        return [(str(r["period_key"]), r["measure"], r["value"], r["n_rows"]) for r in jobs.trend_so_far(spark, out, ["measure"]).orderBy("period_key").collect()]

    land(spark, src, [(1, day(1), "m", 1.0), (2, dt.datetime(2025, 6, 1), "m", 2.0)])
    assert months() == [("2025-01-01", "m", 1.0, 1), ("2025-06-01", "m", 2.0, 1)]
    land(spark, src, [(3, day(2), "m", 5.0)])
    assert months() == [("2025-01-01", "m", 6.0, 2), ("2025-06-01", "m", 2.0, 1)]
    done = spark.read.parquet(f"{out}/batch=1")
    done.write.mode("overwrite").parquet(f"{tmp_path}/again")
    spark.read.parquet(f"{tmp_path}/again").write.mode("overwrite").parquet(f"{out}/batch=1")  # the batch run again
    assert months() == [("2025-01-01", "m", 6.0, 2), ("2025-06-01", "m", 2.0, 1)]
