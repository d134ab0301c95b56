"""Window operators over period series (``measure``, ``period_key``, ``value``).

A series has one row per period, so a window over one series is as long as the
calendar, whatever the size of the facts behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers

SPARK_POINTS = 12
ANOMALY_Z, CRITICAL_Z = 2.5, 3.5


def _by(*keys: str) -> tuple:
    w = Window.partitionBy(*keys)
    return w, w.orderBy("period_key")


def latest_delta(series: DataFrame) -> DataFrame:
    """Current and previous value, change in percent and the last 12 values."""
    _, order = _by("measure")
    newest = order.orderBy(F.desc("period_key"))
    rows = series.select("measure", "period_key", "value", F.lag("value").over(order).alias("previous_value"),
                         F.row_number().over(newest).alias("age"))
    recent = rows.where(F.col("age") <= SPARK_POINTS)
    now = F.col("age") == 1
    spark = F.transform(F.sort_array(F.collect_list(F.struct("period_key", "value"))), lambda p: p["value"])
    out = recent.groupBy("measure").agg(
        F.max(F.when(now, F.col("period_key"))).alias("period_key"),
        F.max(F.when(now, F.col("value"))).alias("current_value"),
        F.max(F.when(now, F.col("previous_value"))).alias("previous_value"), spark.alias("sparkline"))
    return out.select("measure", F.date_format("period_key", "yyyy-MM").alias("period"), "current_value",
                      "previous_value",
                      F.round(numbers.pct_change(F.col("current_value"), F.col("previous_value")), 1).alias("delta_pct"),
                      "sparkline")


def moving_average(series: DataFrame, window: int = 3) -> DataFrame:
    """Trailing mean, null until the window is full."""
    _, order = _by("measure")
    frame = order.rowsBetween(1 - window, 0)
    full = F.count("value").over(frame) == window
    return series.withColumn("moving_avg", F.when(full, F.round(F.avg("value").over(frame), 2)))


def growth(series: DataFrame) -> DataFrame:
    """Change on the previous month, on the previous three months and on the year."""
    whole, order = _by("measure")
    newest = order.orderBy(F.desc("period_key"))
    last3, prior3 = order.rowsBetween(-2, 0), order.rowsBetween(-5, -3)
    rows = series.select(
        "measure", "value", F.row_number().over(newest).alias("age"), F.lag("value", 1).over(order).alias("month_ago"),
        F.lag("value", 12).over(order).alias("year_ago"), F.sum("value").over(last3).alias("quarter"),
        F.sum("value").over(prior3).alias("quarter_ago"), F.count("value").over(prior3).alias("held"))
    held = F.col("held") == 3

    def pct(new: Column, old: Column) -> Column:
        return F.round(numbers.pct_change(new, old), 1)

    return rows.where("age = 1").select(
        "measure", pct(F.col("value"), F.col("month_ago")).alias("mom"),
        F.when(held, pct(F.col("quarter"), F.col("quarter_ago"))).alias("qoq"),
        pct(F.col("value"), F.col("year_ago")).alias("yoy"))


def pareto(shares: DataFrame) -> DataFrame:
    """Running share of ranked members (``dimension``, ``rank``, ``member``,
    ``share_pct``) and how many of them reach 80%."""
    whole = Window.partitionBy("dimension")
    upto = whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = shares.where("rank is not null").withColumn(
        "running", F.sum(F.coalesce("share_pct", F.lit(0.0))).over(upto))
    # shares have one decimal: compare on a grid fine enough to absorb float noise
    reached = F.when(F.round("running", 6) >= 80, F.col("rank"))
    return running.select("dimension", "rank", "member", "share_pct", F.round("running", 1).alias("cumulative_pct"),
                          F.min(reached).over(whole).alias("n_for_80"),
                          F.count(F.lit(1)).over(whole).alias("total_categories"))


def anomalies(series: DataFrame, z: float = ANOMALY_Z) -> DataFrame:
    """Points far from the series' least-squares line, in residual deviations."""
    whole, order = _by("measure")
    t = (F.row_number().over(order) - 1).cast("double")
    fitted = (series.withColumn("t", t)
              .withColumn("n", F.count(F.lit(1)).over(whole))
              .withColumn("slope", F.regr_slope("value", "t").over(whole))
              .withColumn("at_zero", F.regr_intercept("value", "t").over(whole))
              .withColumn("line", F.col("at_zero") + F.col("slope") * F.col("t"))
              .withColumn("residual", F.col("value") - F.col("line"))
              .withColumn("spread", F.stddev_samp("residual").over(whole))
              .withColumn("size", F.avg(F.abs("value")).over(whole) + 1))
    # a straight line leaves residuals of rounding noise: that is no spread
    usable = (F.col("n") >= 5) & (F.col("spread") > F.col("size") * 1e-6)
    off = fitted.where(usable).withColumn("deviation", F.col("residual") / F.col("spread"))
    return off.where(F.abs("deviation") >= z).select(
        "measure", "period_key", "value", F.round("line", 2).alias("expected"), "deviation",
        F.when(F.col("deviation") > 0, "spike").otherwise("dip").alias("direction"),
        F.when(F.abs("deviation") >= CRITICAL_Z, "critical").otherwise("warning").alias("severity"))
