"""Certified metrics, metric trees and structured questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import numbers, periods
from tallyspark.functions.numbers import number, ratio
from tallyspark.model import AnalysisError, Dataset
from tallyspark.operators import change, ranking, slices

METRIC_AGGREGATES = ("sum", "avg", "min", "max", "median", "count", "count_distinct")
MONTH = "__month__"
QUESTION_LIMIT, QUESTION_LIMIT_MAX = 20, 100


@dataclass(frozen=True)
class Part:
    """One aggregate of one column."""

    agg: str
    column: str | None = None

    def check(self, ds: Dataset) -> Part:
        if self.agg not in METRIC_AGGREGATES:
            raise AnalysisError(f"invalid aggregate {self.agg!r}")
        if self.agg != "count" and self.column not in ds.user_columns:
            raise AnalysisError(f"unknown column {self.column!r}")
        return self

    def over(self, ds: Dataset, when: Column | None = None, medians: Column | None = None) -> Column:
        """The aggregate, of the rows where ``when`` holds; ``medians`` are those of ``_medians``, where known."""
        if self.agg == "count":
            return (F.count(F.lit(1)) if when is None else F.count_if(when)).cast("double")
        raw = F.col(self.column)
        if self.agg == "count_distinct":
            return F.count_distinct(raw if when is None else F.when(when, raw)).cast("double")
        value = number(raw) if when is None else F.when(when, number(raw))
        if self.agg == "median":
            return F.max(F.element_at(_medians(ds, [self], when) if medians is None else medians, F.lit(self.column)))
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.agg](value)


@dataclass(frozen=True)
class Metric:
    """An aggregate, or the ratio of two; ``percent`` scales by 100."""

    name: str
    numerator: Part
    denominator: Part | None = None
    format: str | None = None

    @property
    def scale(self) -> float:
        return 100.0 if self.format == "percent" else 1.0

    @property
    def parts(self) -> list[Part]:
        return [p for p in (self.numerator, self.denominator) if p is not None]

    def over(self, ds: Dataset, when: Column | None = None, medians: Column | None = None) -> Column:
        values = [p.check(ds).over(ds, when, medians) for p in self.parts]
        return (values[0] if len(values) == 1 else ratio(*values)) * self.scale


def _medians(ds: Dataset, parts: Sequence[Part], when: Column | None = None) -> Column | None:
    """Medians by column, as one map value, ranked together without gathering the rows."""
    columns = sorted({p.column for p in parts if p.agg == "median"})
    if not columns:
        return None
    rows = ds.frame if when is None else ds.frame.where(when)
    found = ranking.quantiles(rows, [], columns, [0.5])
    return found.agg(F.map_from_entries(F.collect_list(F.struct("measure", "q0")))).scalar()


def evaluate(ds: Dataset, metrics: Sequence[Metric]) -> DataFrame:
    """All metrics in one pass; one that cannot be computed is a row with its
    error and does not stop the others."""
    sound, bad = [], []
    for m in metrics:
        try:
            sound.append((m, [p.check(ds) for p in m.parts]))
        except AnalysisError as problem:
            bad.append((m.name, str(problem)))
    medians = _medians(ds, [p for _, parts in sound for p in parts])
    good = [(m.name, m.over(ds, medians=medians)) for m, _ in sound]
    row = ds.frame.agg(*[c.alias(f"v{i}") for i, (_, c) in enumerate(good)]) if good else ds.frame.agg(
        F.count(F.lit(1)))
    shape = [F.struct(F.lit(n).alias("metric"), F.col(f"v{i}").cast("double").alias("value"),
                      F.lit(None).cast("string").alias("error")) for i, (n, _) in enumerate(good)]
    shape += [F.struct(F.lit(n).alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(e).alias("error"))
              for n, e in bad]
    return row.select(F.inline(F.array(*shape)))


def metric_tree(ds: Dataset, metric: Metric, grain: str = "month", compare: str = "previous") -> DataFrame:
    """A ratio's change as the part its numerator caused and the part its
    denominator caused; they add up exactly."""
    per = change.comparison(ds, grain, compare)
    both = change._both(ds, per)
    spans = {"a": change._in(ds, per.a), "b": change._in(ds, per.b)}
    top, bottom = metric.numerator.check(ds), metric.denominator
    aggs = [top.over(both, cond).alias(f"n{k}") for k, cond in spans.items()]
    if bottom is None:
        row = both.frame.agg(*aggs)
        return row.select((F.col("na") * metric.scale).alias("a"), (F.col("nb") * metric.scale).alias("b"),
                          ((F.col("nb") - F.col("na")) * metric.scale).alias("delta"))
    aggs += [bottom.check(ds).over(both, cond).alias(f"d{k}") for k, cond in spans.items()]
    row = both.frame.agg(*aggs).where("da <> 0 and db <> 0 and na is not null and nb is not null")
    up = ratio(F.col("nb") - F.col("na"), F.col("da"))
    down = ratio(F.col("nb"), F.col("db")) - ratio(F.col("nb"), F.col("da"))
    k = metric.scale
    return row.select("na", "nb", "da", "db", (ratio(F.col("na"), F.col("da")) * k).alias("a"),
                      (ratio(F.col("nb"), F.col("db")) * k).alias("b"), ((up + down) * k).alias("delta"),
                      (up * k).alias("numerator_effect"), (down * k).alias("denominator_effect"),
                      F.when(F.abs(up) >= F.abs(down), "numerator").otherwise("denominator").alias("lead"))


# ---------------------------------------------------------- questions ---

@dataclass(frozen=True)
class Question:
    """A structured question: metric x aggregation x group x filters x order."""

    metric: str | None = None
    aggregation: str = "sum"
    group_by: str | None = None
    filters: Mapping[str, Any] = field(default_factory=dict)
    sort: str = "desc"
    limit: int | None = None
    unresolved: Sequence[str] = ()


def ask(ds: Dataset, q: Question, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """``label`` and ``value`` rows.  A reference the dataset does not know is
    refused, not replaced by something it does know."""
    gone = [str(u) for u in q.unresolved if str(u).strip()]
    if gone:
        raise AnalysisError(f"this dataset has nothing matching {gone[0]!r}")
    agg = q.aggregation if q.aggregation in ("sum", "avg", "min", "max", "count") else "sum"
    metric = None
    if q.metric is not None or agg != "count":
        metric = ds.need_measure(q.metric)
    kept = {c: v for c, v in q.filters.items() if c in ds.dimensions}
    cut = ds.slice(kept, date_from, date_to)
    value = slices.aggregate(metric, agg).alias("value")
    if q.group_by == MONTH and ds.date_column:
        date = F.col(ds.date_column)
        return cut.frame.where(date.isNotNull()).groupBy(
            periods.label(periods.key(date, "month"), "month").alias("label")).agg(value)
    if q.group_by in ds.dimensions:
        limit = max(1, min(int(q.limit), QUESTION_LIMIT_MAX)) if q.limit is not None else QUESTION_LIMIT
        order = F.asc_nulls_last("value") if q.sort == "asc" else F.desc_nulls_last("value")
        groups = cut.frame.where(F.col(q.group_by).isNotNull()).groupBy(
            F.col(q.group_by).cast("string").alias("label")).agg(value)
        return groups.orderBy(order, "label").limit(limit)
    row = cut.frame.agg(value)
    if kept:
        # no matching row is not a zero: the caller sees no row at all
        row = row.where("value is not null")
    return row.select(F.lit(None).cast("string").alias("label"), "value")


def answer(ds: Dataset, q: Question, **dates: str | None) -> DataFrame:
    """The result sentence, made from the result rows."""
    rows = ask(ds, q, **dates)
    agg = q.aggregation
    word = {"sum": "Total", "avg": "Average", "min": "Minimum", "max": "Maximum", "count": "Count"}.get(agg, "Total")
    name = q.metric or (next(iter(ds.measures), None) if agg != "count" else None)
    kind = ds.measures.get(name) if name else None
    what = numbers.words(name or "records")
    if q.group_by == MONTH:
        month = F.to_date(F.concat("label", F.lit("-01")))
        said = F.struct("value", periods.prose(month).alias("m"))
        row = rows.agg(F.max_by(said, F.struct("value", "label")).alias("hi"),
                       F.min_by(said, F.struct("value", "label")).alias("lo"), F.max_by(said, "label").alias("end"))

        def part(n: str) -> Column:
            return numbers.display(F.col(f"{n}.value"), kind)

        return row.where("hi is not null").select(F.concat(
            F.lit(f"{word} {what} by month ranges from "), part("lo"), F.lit(" ("), "lo.m", F.lit(") to "), part("hi"),
            F.lit(" ("), "hi.m", F.lit("); latest is "), part("end"), F.lit(" in "), "end.m", F.lit(".")).alias("answer"))
    if q.group_by:
        first = F.sort_array(F.collect_list(F.struct((-F.col("value") if q.sort != "asc" else F.col("value")).alias("k"),
                                                     "label", "value")))  # at most QUESTION_LIMIT_MAX rows
        row = rows.where("value is not null").agg(first.alias("r")).where(F.size("r") > 0)
        lead = F.concat(F.col("r")[0]["label"], F.lit(" leads with "), numbers.display(F.col("r")[0]["value"], kind),
                        F.lit(f" ({word.lower()} {what})"))
        more = F.when(F.size("r") > 1, F.concat(
            F.lit(", followed by "), F.get("r", F.lit(1))["label"], F.lit(" ("),
            numbers.display(F.get("r", F.lit(1))["value"], kind), F.lit(")"))).otherwise(F.lit(""))
        return row.select(F.concat(lead, more, F.lit(".")).alias("answer"))
    return rows.select(F.concat(F.lit(f"{word} {what} is "), numbers.display(F.col("value"), kind), F.lit(".")).alias(
        "answer"))
