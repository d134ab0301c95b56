"""The dashboard's aggregates: totals, trends, shares, spreads and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers, periods
from tallyspark.functions.numbers import number
from tallyspark.model import AnalysisError, Dataset
from tallyspark.operators import ranking, slices

BREAKDOWN_TOP = 20
TREEMAP_CHILDREN, TREEMAP_PARENTS = 12, 8
OPTION_VALUES, SCHEMA_VALUES = 200, 50
SCATTER_POINTS = 400


def _long(row: DataFrame, measures: Sequence[str], fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per measure from columns named ``<field>__<measure>``."""
    parts = [F.struct(F.lit(m).alias("measure"), *[F.col(f"{f}__{m}").alias(f) for f in fields]) for m in measures]
    return row.select(*keep, F.inline(F.array(*parts)))


def kpi_totals(ds: Dataset) -> DataFrame:
    """Total and average of every measure, and the row count, in one pass."""
    ms = list(ds.measures)
    aggs = [a for m in ms for a in (F.sum(number(m)).alias(f"total__{m}"), F.avg(number(m)).alias(f"average__{m}"))]
    row = ds.frame.agg(F.count(F.lit(1)).alias("row_count"), *aggs)
    return _long(row, ms, ["total", "average"], ["row_count"]) if ms else row


def monthly_series(ds: Dataset, measures: Sequence[str] | None = None) -> DataFrame:
    """``measure``, ``period_key``, ``value`` per month; a month without values is 0."""
    ms = list(measures or ds.measures)
    date = F.col(ds.need_date())
    months = ds.frame.where(date.isNotNull()).groupBy(periods.key(date, "month").alias("period_key")).agg(
        *[F.coalesce(F.sum(number(m)), F.lit(0.0)).alias(f"value__{m}") for m in ms])
    return _long(months, ms, ["value"], ["period_key"])


def breakdown_shares(ds: Dataset, measure: str | None = None, top: int = BREAKDOWN_TOP) -> DataFrame:
    """Every dimension's biggest members with their share of the whole, and the
    rest as one row; all dimensions from one scan."""
    m = ds.need_measure(measure)
    v = F.sum(number(m)).alias("value")
    groups = slices.members(ds, list(ds.dimensions), v)
    order = [F.desc_nulls_last("value"), F.asc("member")]
    folded = ranking.top_and_rest(groups, ["dimension"], "member", order, top, [v_again("value")])
    # at most top + 1 rows per dimension
    grand = F.sum("value").over(Window.partitionBy("dimension"))
    return folded.select("dimension", "rank", "member", "value", "folded",
                         numbers.pct_of(F.coalesce("value", F.lit(0.0)), grand).alias("share_pct"))


def v_again(name: str) -> Column:
    return F.sum(name).alias(name)


def distribution(ds: Dataset) -> DataFrame:
    """Five-number summary, mean and standard deviation of every measure."""
    ms = list(ds.measures)
    fields = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    row = ds.frame.agg(*[f(number(m)).alias(f"{name}__{m}") for m in ms for name, f in fields.items()])
    spread = _long(row, ms, list(fields))
    q = ranking.quantiles(ds.frame, [], ms, [0.25, 0.5, 0.75]).select(
        "measure", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    return spread.join(q, "measure").select("measure", "min", "q1", "median", "q3", "max", "mean", "std")


def treemap(ds: Dataset, parent: str, child: str, measure: str | None = None) -> DataFrame:
    """Two levels: the biggest children of each parent, and the parents with the
    biggest totals of those children."""
    m = ds.need_measure(measure)
    pair = ds.frame.where(F.col(parent).isNotNull() & F.col(child).isNotNull()).groupBy(
        F.col(parent).cast("string").alias("parent"), F.col(child).cast("string").alias("child")).agg(
        F.sum(number(m)).alias("value"))
    within = Window.partitionBy("parent").orderBy(F.desc_nulls_last("value"), "child")
    kept = pair.withColumn("child_rank", F.row_number().over(within)).where(F.col("child_rank") <= TREEMAP_CHILDREN)
    parents = kept.groupBy("parent").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("parent_value"))
    top = parents.orderBy(F.desc("parent_value"), "parent").limit(TREEMAP_PARENTS)
    return kept.join(F.broadcast(top), "parent")  # at most TREEMAP_PARENTS rows


def treemap_levels(ds: Dataset) -> tuple[str, str]:
    """Coarser and finer dimension, by their distinct counts."""
    dims = sorted((c for c in ds.columns if c.role == "dimension"), key=lambda c: c.distinct_count or 0)
    if len(dims) < 2:
        raise AnalysisError("a treemap needs two dimensions")
    return dims[0].name, dims[1].name


def dimension_values(ds: Dataset, limit: int = OPTION_VALUES) -> DataFrame:
    """Distinct values per dimension in order; made from the whole secured
    dataset, so the current slice does not hide options."""
    whole = ds.whole if ds.whole is not None else ds.frame
    dims = list(ds.dimensions)
    pairs = whole.select(F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])))
    distinct = pairs.where("value is not null").distinct()
    w = Window.partitionBy("dimension").orderBy("value")
    return distinct.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def schema_summary(ds: Dataset) -> DataFrame:
    """One row per dimension with up to 50 example values."""
    return dimension_values(ds, SCHEMA_VALUES).groupBy("dimension").agg(
        F.sort_array(F.collect_list("value")).alias("examples"), F.count(F.lit(1)).alias("shown"))


def data_profile(ds: Dataset) -> DataFrame:
    """Rows, columns in use, completeness over them, and the span of dates."""
    used = [c.name for c in ds.columns if c.role in ("measure", "dimension", "date")]
    n = F.count(F.lit(1))
    filled = sum((F.count(c) for c in used), F.lit(0))
    date = ds.date_column
    span = [(f(date) if date else F.lit(None)).cast("date").cast("string").alias(name)
            for name, f in (("date_from", F.min), ("date_to", F.max))]
    return ds.frame.agg(n.alias("n_rows"), F.lit(len(used)).alias("columns_used"),
                        F.round(numbers.ratio(filled, n * len(used)) * 100, 1).alias("completeness_pct"), *span)


# --------------------------------------------------------- correlations ---

def correlation_pairs(ds: Dataset) -> DataFrame:
    """r of every pair of measures from one aggregate, the strongest flagged."""
    pairs = list(combinations(ds.measures, 2))
    if not pairs:
        raise AnalysisError("a correlation needs two measures")
    row = ds.frame.agg(F.count(F.lit(1)).alias("n"),
                       *[numbers.pearson(x, y).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    r = F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y"),
                                    F.col(f"r{i}").alias("exact")) for i, (x, y) in enumerate(pairs)]))
    out = row.where("n >= 3").select(r)
    best = Window.orderBy(F.abs("exact").desc_nulls_last(), "i")  # one row per pair of columns
    return out.select("x", "y", F.round("exact", 2).alias("r"),
                      ((F.row_number().over(best) == 1) & F.col("exact").isNotNull()).alias("strongest"))


def regression(ds: Dataset, x: str, y: str) -> DataFrame:
    """r and the least-squares line of two measures, over all rows."""
    a, b = number(ds.need_measure(x)), number(ds.need_measure(y))
    both = ds.frame.where(a.isNotNull() & b.isNotNull())
    row = both.agg(F.count(F.lit(1)).alias("n"), numbers.pearson(x, y).alias("r"), F.regr_slope(b, a).alias("slope"),
                   F.regr_intercept(b, a).alias("intercept"), F.min(a).alias("x_min"), F.max(a).alias("x_max"))
    fits = (F.col("n") >= 3) & F.col("r").isNotNull()

    def line(at: str) -> Column:
        return F.when(fits, F.col("slope") * F.col(at) + F.col("intercept"))

    return row.select("n", F.when(fits, F.round("r", 3)).alias("r"), "x_min", line("x_min").alias("y_at_min"),
                      "x_max", line("x_max").alias("y_at_max"))


def scatter_sample(ds: Dataset, x: str, y: str, order: str, points: int = SCATTER_POINTS) -> DataFrame:
    """A systematic sample of points along a unique ordering column."""
    a, b = ds.need_measure(x), ds.need_measure(y)
    both = ds.frame.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return ranking.systematic_sample(both, order, points).select(
        order, number(a).alias("x"), number(b).alias("y"))
