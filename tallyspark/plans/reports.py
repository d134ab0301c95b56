"""Whole answers: the dashboard, its fact sheet and the periodic report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import numbers, periods
from tallyspark.functions.numbers import display
from tallyspark.model import Dataset
from tallyspark.operators import change, forecast, goals, overview, rules, security, series


def dashboard(ds: Dataset, measure: str | None = None, level: StorageLevel = StorageLevel.MEMORY_AND_DISK
              ) -> dict[str, DataFrame]:
    """Every block of a dashboard over one secured, sliced dataset.

    What is kept between blocks is the small aggregates (months x measures,
    members of dimensions), never the facts."""
    out = {"kpis": overview.kpi_totals(ds), "profile": overview.data_profile(ds)}
    if ds.measures:
        out["distributions"] = overview.distribution(ds)
    if ds.dimensions:
        out["filter_options"] = overview.dimension_values(ds)
    monthly = shares = None
    if ds.date_column and ds.measures:
        monthly = overview.monthly_series(ds).persist(level)
        out.update(trend=monthly, deltas=series.latest_delta(monthly), growth=series.growth(monthly),
                   moving_average=series.moving_average(monthly), anomalies=series.anomalies(monthly),
                   forecasts=forecast.forecast(monthly))
    if ds.dimensions and ds.measures:
        shares = overview.breakdown_shares(ds, measure).persist(level)
        out["breakdowns"] = shares
        out["pareto"] = series.pareto(shares.where(F.col("dimension") == next(iter(ds.dimensions))))
    if len(ds.measures) > 1:
        out["correlations"] = overview.correlation_pairs(ds)
    if len(ds.dimensions) > 1 and ds.measures:
        out["treemap"] = overview.treemap(ds, *overview.treemap_levels(ds), measure)
    if ds.measures and (ds.date_column or ds.dimensions):
        out["insights"] = rules.insights(ds, measure, monthly, shares)
    return out


def fact_sheet(ds: Dataset, measure: str | None = None) -> DataFrame:
    """``section``, ``name``, ``value``: the numbers a narrative may use."""
    monthly = overview.monthly_series(ds) if ds.date_column and ds.measures else None
    first = next(iter(ds.dimensions), None)
    def facts(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"),
                         value.cast("double").alias("value"))

    parts = [facts(overview.kpi_totals(ds), "total", F.col("measure"), F.col("total"))]
    if monthly is not None:
        parts.append(facts(series.latest_delta(monthly), "mom_change_pct", F.col("measure"), F.col("delta_pct")))
        rates = series.growth(monthly)
        parts += [facts(rates, rate, F.col("measure"), F.col(rate)) for rate in ("mom", "qoq", "yoy")]
    if first and ds.measures:
        shares = overview.breakdown_shares(ds, measure).where(F.col("dimension") == first)
        parts.append(facts(series.pareto(shares).where("rank = 1"), "top_n_for_80pct", F.col("dimension"), F.col("n_for_80")))
    if len(ds.measures) > 1:
        parts.append(facts(overview.correlation_pairs(ds).where("strongest"), "strongest_correlation",
                           F.concat_ws(" ~ ", "x", "y"), F.col("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report(ds: Dataset, measure: str | None = None, targets: Sequence[goals.Target] = (),
           masks: Mapping[str, str] | None = None) -> DataFrame:
    """``section``, ``position``, ``line``.  A report leaves the application, so
    it is made from masked data and carries no rows."""
    ds = security.secure(ds, (), masks, public=True)
    m = ds.need_measure(measure)
    kinds = F.create_map(*[F.lit(x) for k, v in ds.measures.items() for x in (k, v or "count")])
    sub = F.element_at(kinds, F.col("measure"))

    def words(column: str) -> Column:
        return F.regexp_replace(column, "_", " ")

    def lines(df: DataFrame, section: str, position: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), position.cast("long").alias("position"), line.alias("line"))

    totals = overview.kpi_totals(ds)
    place = F.array_position(F.array(*[F.lit(x) for x in ds.measures]), F.col("measure"))
    head = F.concat(words("measure"), F.lit(": "), display(F.col("total"), sub), F.lit(" in total"))
    parts = []
    if ds.date_column:
        latest = series.latest_delta(overview.monthly_series(ds))
        shown = totals.join(latest, "measure", "left")
        month = F.to_date(F.concat("period", F.lit("-01")))
        tail = F.when(F.col("period").isNotNull(), F.concat(
            F.lit("; "), display(F.col("current_value"), sub), F.lit(" in "), periods.prose(month),
            F.when(F.col("delta_pct").isNotNull(), F.format_string(
                " (%+.1f%% on the month before)", F.col("delta_pct"))).otherwise(F.lit("")))).otherwise(F.lit(""))
        parts.append(lines(shown, "Key numbers", place, F.concat(head, tail)))
        parts.append(lines(change_sentence(ds, m), "Headline", F.lit(1), F.col("summary")))
        sig = change.significance(ds, m)
        parts.append(lines(sig, "Headline", F.lit(2), F.when(
            F.col("level") == "normal", F.lit("Within this series' normal month-to-month variation.")).otherwise(
            F.format_string("A %s move: %.1f× the typical swing.", "level", F.abs("z")))))
        if ds.free_dimensions:
            steps = change.waterfall(ds, m, limit=5).where("not is_other and delta <> 0")
            parts.append(lines(steps, "Where the change came from", F.col("step"), F.concat(
                F.coalesce("member", F.lit("(blank)")), F.lit(": "), numbers.signed(F.col("delta"), ds.measures[m]))))
        if targets:
            now = goals.evaluate_targets(ds, targets).where("current and status <> 'broken'")
            parts.append(lines(now, "Targets", F.lit(0), F.concat(
                words("measure"), F.lit(" "), "period", F.lit(": "), display(F.col("actual"), sub), F.lit(" of "),
                display(F.col("goal"), sub), F.lit(", "), words("status"), F.lit(", on pace for "),
                display(F.col("projection"), sub))))
    else:
        parts.append(lines(totals, "Key numbers", place, head))
    todo = rules.actions(ds, m, targets, 5)
    parts.append(lines(todo, "Recommended actions", F.col("position"), F.concat("title", F.lit(". "), "why", F.lit(" "), "step")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def change_sentence(ds: Dataset, measure: str | None = None, grain: str = "month", compare: str = "previous",
                    dimension: str | None = None) -> DataFrame:
    """One sentence: how much it moved, and the member that moved it most."""
    m = ds.need_measure(measure)
    kind, name = ds.measures[m], numbers.words(m).capitalize()
    row = change.period_totals(ds, m, "sum", grain, compare)
    d = F.col("delta")
    base = F.concat(F.when(d > 0, F.lit(f"{name} rose ")).otherwise(F.lit(f"{name} fell ")),
                    F.coalesce(F.format_string("%.1f%% ", F.abs("pct")), F.lit("")), F.lit("("),
                    numbers.signed(d, kind), F.lit(") from "), "a_label", F.lit(" to "), "b_label")
    cause = F.lit("")
    if ds.free_dimensions:
        chosen = dimension or change.best_split(ds, m, "sum", grain, compare)
        steps = change.waterfall(ds, m, "sum", grain, compare, chosen).where("not is_other")
        lead = steps.agg(F.max_by(F.struct("member", "delta"), F.col("delta")).alias("up"),
                         F.min_by(F.struct("member", "delta"), F.col("delta")).alias("down"))
        row = row.withColumn("lead", F.when(d > 0, lead.select("up").scalar()).otherwise(lead.select("down").scalar()))
        moved, share = F.col("lead.delta"), F.abs(numbers.ratio(F.col("lead.delta"), d)) * 100
        amount = numbers.signed(moved, kind)
        dim = numbers.words(chosen)
        text = F.when(share > 100, F.concat(
            F.lit(f" — {dim} "), "lead.member", F.lit(" alone moved "), amount,
            F.lit(f", more than the whole change; other {dim} values "), F.when(d < 0, F.lit("rose")).otherwise(
                F.lit("fell")), F.lit(" and offset part of it"))).otherwise(F.concat(
            F.lit(f" — {dim} "), "lead.member", F.lit(" accounts for "), amount,
            F.format_string(" (%.0f%% of the move)", share)))
        same = (F.signum(moved) == F.signum(d)) & F.col("lead.member").isNotNull()
        cause = F.when(same, text).otherwise(F.lit(""))
    return row.select("delta", F.when(d == 0, F.concat(
        F.lit(f"{name} was unchanged between "), "a_label", F.lit(" and "), "b_label", F.lit("."))).otherwise(
        F.concat(base, cause, F.lit("."))).alias("summary"))
