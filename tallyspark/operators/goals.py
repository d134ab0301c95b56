"""Targets and threshold alerts, evaluated for a whole registry at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import periods
from tallyspark.functions.numbers import number, ratio
from tallyspark.model import AnalysisError, Dataset

AT_RISK = 0.9
MAX_TARGETS = 500
# Of several targets covering today, the first grain is the one watched.
TARGET_GRAINS = ("month", "week", "quarter", "year", "day")
ALERT_AGGREGATES = ("total", "latest", "mom_pct", "target_pace")


@dataclass(frozen=True)
class Target:
    target_id: str
    measure: str
    grain: str
    period: str
    value: float
    filters: Mapping[str, str] = field(default_factory=dict)


def evaluate_targets(ds: Dataset, targets: Sequence[Target]) -> DataFrame:
    """Actual, run-rate projection, gap and status of every target.

    The registry is small (at most 500 per dataset), so each target is one conditional sum and the facts
    are read once for all of them, over the union of the targets' windows only."""
    if len(targets) > MAX_TARGETS:
        raise AnalysisError("too many targets on this dataset")
    end = ds.data_end()
    rows, aggs, live = [], [], None
    for i, t in enumerate(targets):
        broken, span = None, None
        try:
            span = periods.span_of(t.period, t.grain)
            ds.need_measure(t.measure)
            cond = ds.between(span.first, span.last)
            for column, value in t.filters.items():
                if column not in ds.user_columns:
                    raise AnalysisError(f"unknown column {column!r}")
                cond = cond & ds.equals(column, value)
            aggs.append(F.coalesce(F.sum(F.when(cond, number(t.measure))), F.lit(0.0)).alias(f"actual{i}"))
            live = cond if live is None else live | cond
        except ValueError as problem:
            broken = str(problem)
        elapsed = 0 if broken or end is None or end < span.first else min(span.days, (end - span.first).days + 1)
        rows.append(F.struct(
            F.lit(t.target_id).alias("target_id"), F.lit(t.measure).alias("measure"), F.lit(t.grain).alias("grain"),
            F.lit(t.period).alias("period"), F.lit(float(t.value)).alias("goal"),
            F.lit(len(t.filters)).alias("filters"),
            (F.lit(None) if broken else F.col(f"actual{i}")).cast("double").alias("actual"),
            F.lit(None if broken else span.days).cast("int").alias("days"), F.lit(elapsed).alias("days_elapsed"),
            F.lit(bool(not broken and end is not None and span.first <= end <= span.last)).alias("current"),
            F.lit(broken).cast("string").alias("reason")))
    facts = ds.frame.where(live).agg(*aggs) if aggs else ds.frame.agg(F.count(F.lit(1)))
    out = facts.select(F.inline(F.array(*rows)))
    actual, goal = F.col("actual"), F.col("goal")
    left = F.col("days") - F.col("days_elapsed")
    projection = F.when((left == 0) | (F.col("days_elapsed") == 0), actual).otherwise(
        ratio(actual, F.col("days_elapsed").cast("double")) * F.col("days"))
    out = out.withColumn("days_remaining", left).withColumn("projection", projection)
    running = (F.when((actual >= goal) & (goal >= 0), "met")
               .when(F.col("projection") >= goal, F.when(left == 0, "missed").otherwise("on_track"))
               .when(left == 0, "missed")
               .when((goal != 0) & (F.col("projection") >= goal * AT_RISK), "at_risk").otherwise("off_track"))
    status = F.when(F.col("reason").isNotNull(), "broken").when(F.col("days_elapsed") == 0, "not_started").otherwise(
        running)
    needed = F.when((left > 0) & (goal > actual), ratio(goal - actual, left.cast("double"))).otherwise(F.lit(0.0))
    return out.select("target_id", "measure", "grain", "period", "goal", "filters", "actual", "projection",
                      ratio(actual, goal).alias("progress"), ratio(F.col("projection"), goal).alias("projected_ratio"),
                      (F.col("projection") - goal).alias("gap"), "days", "days_elapsed", "days_remaining",
                      F.when(F.col("reason").isNull(), needed).alias("needed_per_day"), "current", status.alias("status"),
                      "reason")


@dataclass(frozen=True)
class Alert:
    alert_id: str
    measure: str
    aggregate: str
    op: str
    threshold: float
    last_state: str = "pending"
    enabled: bool = True


def alert_values(ds: Dataset, alerts: Sequence[Alert], targets: Sequence[Target] = ()) -> DataFrame:
    """The watched value of every enabled alert: one monthly pass for all of them.
    Null means there is not enough data; ``error`` says why there can be none."""
    watched = [a for a in alerts if a.enabled]
    known = sorted({a.measure for a in watched if a.measure in ds.measures})
    date = ds.date_column
    month = periods.key(F.col(date), "month") if date else F.lit(None).cast("date")
    monthly = ds.frame.groupBy(month.alias("m")).agg(*[F.sum(number(m)).alias(m) for m in known])
    # one row per month of the calendar
    whole = monthly.agg(*[F.sum(m).alias(f"total__{m}") for m in known],
                        *[F.max_by(m, "m").alias(f"latest__{m}") for m in known], F.max("m").alias("last"))
    before = monthly.where(F.col("m") < whole.select("last").scalar()).agg(
        *[F.max_by(m, "m").alias(f"before__{m}") for m in known])
    row = whole.withColumn("old", before.select(F.struct(*before.columns)).scalar()) if known else whole
    pace = evaluate_targets(ds, targets) if targets else None
    items = []
    for a in watched:
        value, error = F.lit(None).cast("double"), None
        if a.measure not in ds.measures:
            error = f"{a.measure!r} is not a measure of this dataset"
        elif a.aggregate == "total":
            value = F.col(f"total__{a.measure}")
        elif a.aggregate == "target_pace":
            if pace is None:
                error = "no target covers the current period"
            else:
                order = F.array_position(F.array(*[F.lit(g) for g in TARGET_GRAINS]), F.col("grain"))
                mine = pace.where((F.col("measure") == a.measure) & F.col("current") & (F.col("filters") == 0))
                value = mine.agg(F.min_by("projected_ratio", order) * 100).scalar()
        elif not date:
            error = "this alert needs a date column"
        elif a.aggregate == "latest":
            value = F.col(f"latest__{a.measure}")
        elif a.aggregate == "mom_pct":
            old = F.col("old")[f"before__{a.measure}"]
            value = ratio(F.col(f"latest__{a.measure}") - old, old) * 100
        else:
            error = f"invalid aggregate {a.aggregate!r}"
        items.append(F.struct(
            F.lit(a.alert_id).alias("alert_id"), F.lit(a.measure).alias("measure"),
            F.lit(a.aggregate).alias("aggregate"), F.lit(a.op).alias("op"), F.lit(float(a.threshold)).alias("threshold"),
            F.lit(a.last_state).alias("previous_state"), value.alias("value"),
            F.lit(error).cast("string").alias("error")))
    return row.select(F.inline(F.array(*items)))


def crossed(value: Column, op: Column, threshold: Column) -> Column:
    return (F.when(op == "lt", value < threshold).when(op == "lte", value <= threshold)
            .when(op == "gt", value > threshold).when(op == "gte", value >= threshold))


def alert_states(values: DataFrame) -> DataFrame:
    """New state of each alert, and whether it fires now: only on entering
    ``firing``, again after a return to ``ok``."""
    over = crossed(F.col("value"), F.col("op"), F.col("threshold"))
    state = (F.when(F.col("error").isNotNull(), "error").when(F.col("value").isNull(), "pending")
             .when(over, "firing").otherwise("ok"))
    return values.withColumn("state", state).withColumn(
        "fired", (F.col("state") == "firing") & (F.col("previous_state") != "firing"))


def alert_history(values: DataFrame, op: str, threshold: float, keys: Sequence[str], order: str) -> DataFrame:
    """The same machine over a history of values: one state per evaluation."""
    over = crossed(F.col("value"), F.lit(op), F.lit(float(threshold)))
    state = F.when(F.col("value").isNull(), "pending").when(over, "firing").otherwise("ok")
    w = Window.partitionBy(*keys).orderBy(order)
    return values.withColumn("state", state).withColumn(
        "fired", (F.col("state") == "firing") & (F.lag("state", 1, "pending").over(w) != "firing"))


def message(alerts: DataFrame) -> DataFrame:
    """The line a notification would carry for each alert that fires."""
    unit = F.when(F.col("aggregate").isin("mom_pct", "target_pace"), F.lit("%")).otherwise(F.lit(""))
    what = (F.when(F.col("aggregate") == "total", "total").when(F.col("aggregate") == "latest", "latest-period")
            .when(F.col("aggregate") == "mom_pct", "month-over-month change of").otherwise("pace against target for"))
    sign = F.element_at(F.create_map(*[F.lit(x) for x in ("lt", "<", "lte", "≤", "gt", ">", "gte", "≥")]), F.col("op"))
    return alerts.where("fired").withColumn("text", F.concat(
        what, F.lit(" "), "measure", F.lit(" is "), F.format_string("%,.2f", F.col("value")), unit,
        F.lit(" (threshold "), sign, F.lit(" "), F.format_string("%s", F.col("threshold")), F.lit(").")))


