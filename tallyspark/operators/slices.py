"""Questions about one slice: its value, spread, trend, parts and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers, periods
from tallyspark.functions.numbers import number
from tallyspark.model import ADDITIVE, AnalysisError, Dataset, check_aggregation
from tallyspark.operators import ranking

TREND_POINTS = 400
CONTRIBUTORS = 5
BREAKDOWN_MAX = 500
PAGE_MAX = 200


def aggregate(measure: str | None, agg: str) -> Column:
    """A decomposable aggregation as a column; medians go through
    :func:`value_by`, which ranks values without gathering a group."""
    check_aggregation(agg)
    if agg == "count":
        return F.count(F.lit(1)).cast("double")
    if agg == "median":
        raise AnalysisError("a median is not a partial aggregate")
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg](number(measure))


def value_by(df: DataFrame, keys: Sequence[str], measure: str | None, agg: str,
             known: ranking.Sketch | None = None) -> DataFrame:
    """keys, ``value``, ``n_rows`` for any aggregation."""
    n_rows = F.count(F.lit(1)).alias("n_rows")
    if check_aggregation(agg) != "median":
        return df.groupBy(*keys).agg(aggregate(measure, agg).alias("value"), n_rows)
    middle = ranking.quantiles(df, keys, [measure], [0.5], known).select(*keys, F.col("q0").alias("value"))
    sizes = df.groupBy(*keys).agg(n_rows)
    if not keys:
        return sizes.select(middle.scalar().alias("value"), "n_rows")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    joined = sizes.alias("s").join(middle.alias("m"), on=same, how="left")
    return joined.select(*[F.col(f"s.{k}") for k in keys], F.col("m.value"), F.col("s.n_rows"))


def slice_value(ds: Dataset, measure: str | None = None, agg: str = "sum") -> DataFrame:
    measure = None if agg == "count" else ds.need_measure(measure)
    return value_by(ds.frame, [], measure, agg)


def slice_stats(ds: Dataset, measure: str | None = None) -> DataFrame:
    """Rows with and without a value, and the spread of the values."""
    m = ds.need_measure(measure)
    v = number(m)
    middle = ranking.quantiles(ds.frame, [], [m], [0.5]).select("q0").scalar()
    return ds.frame.agg(
        F.count(F.lit(1)).alias("row_count"), F.count(v).alias("rows_with_value"),
        (F.count(F.lit(1)) - F.count(v)).alias("skipped"), F.min(v).alias("min"), F.avg(v).alias("avg"),
        F.max(v).alias("max"), F.stddev_samp(v).alias("std"),
    ).withColumn("median", middle)


# ---------------------------------------------------------------- trend ---

def trend(ds: Dataset, measure: str | None = None, agg: str = "sum", grain: str = "month",
          points: int = TREND_POINTS) -> DataFrame:
    """The latest ``points`` periods: key, label, value, rows and drill bounds."""
    measure = None if agg == "count" else ds.need_measure(measure)
    date = F.col(ds.need_date())
    dated = ds.frame.where(date.isNotNull()).withColumn("period_key", periods.key(date, grain))
    by_period = value_by(dated, ["period_key"], measure, agg)
    lo, hi = periods.bounds(F.col("period_key"), grain)
    return (by_period.orderBy(F.desc("period_key")).limit(points)
            .select("period_key", periods.label(F.col("period_key"), grain).alias("period"), "value", "n_rows",
                    lo.alias("from"), hi.alias("to")))


def compare_latest(ds: Dataset, measure: str | None = None, agg: str = "sum", grain: str = "month") -> DataFrame:
    """The last period against the existing period before it and against the
    same period a year earlier."""
    points = trend(ds, measure, agg, grain).select("period_key", "period", "value")
    order = Window.orderBy("period_key")  # at most TREND_POINTS rows
    ranked = points.select(
        "*", F.lag("period").over(order).alias("previous_period"), F.lag("value").over(order).alias("previous_value"),
        F.row_number().over(order.orderBy(F.desc("period_key"))).alias("recency"))
    last = ranked.where("recency = 1").withColumn("ago_key", periods.year_ago(F.col("period_key"), grain))
    old = points.select(F.col("period_key").alias("ago_key"), F.col("period").alias("year_ago_period"),
                        F.col("value").alias("year_ago_value"))
    out = last.join(old, "ago_key", "left")

    def gap(name: str) -> list[Column]:
        then = F.col(f"{name}_value")
        present = F.col(f"{name}_period").isNotNull()
        return [F.when(present, F.coalesce("value", F.lit(0.0)) - F.coalesce(then, F.lit(0.0))).alias(f"{name}_delta"),
                numbers.pct_change(F.col("value"), then).alias(f"{name}_pct")]

    return out.select("period", "value", "previous_period", "previous_value", *gap("previous"), "year_ago_period",
                      "year_ago_value", *gap("year_ago"))


def latest_period(ds: Dataset, grain: str = "month") -> DataFrame:
    """The slice's last period and whether the *dataset* ends partway through it."""
    date = F.col(ds.need_date())
    end = F.lit(ds.data_end())
    last = ds.frame.agg(periods.key(F.max(date), grain).alias("k")).where("k is not null")
    partial = (end < periods.last_day_of(F.col("k"), grain)) if grain != "day" else F.lit(False)
    return last.select(periods.label(F.col("k"), grain).alias("period"), end.cast("string").alias("data_through"),
                       partial.alias("partial"))


def with_spine(df: DataFrame, grain: str, last: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Fill the gaps of (keys, ``period_key``, ``value``) with zeros up to ``last``.

    Each period unfolds into itself and the empty ones before the next, so the
    input is read once and joined with nothing."""
    step = periods.step(grain)
    order = Window.partitionBy(*keys).orderBy("period_key")  # one row per period of the calendar
    until = F.coalesce(F.lead("period_key").over(order) - step, last).cast("date")
    open_ended = df.where(F.col("period_key") <= last).withColumn("until", until)
    return open_ended.withColumn("k", F.explode(F.sequence("period_key", F.greatest("period_key", "until"), step))).select(
        *keys, F.col("k").alias("period_key"),
        F.when(F.col("k") == F.col("period_key"), F.coalesce("value", F.lit(0.0))).otherwise(F.lit(0.0)).alias("value"))


# ----------------------------------------------------------- parts of it ---

def members(ds: Dataset, dims: Sequence[str], *aggs: Column, blanks: bool = False) -> DataFrame:
    """Every member of every dimension with its aggregates, from one scan.

    Columns: ``dimension``, ``member`` (text; null kept when ``blanks``) and the aggregates."""
    named = {f"_d{i}": d for i, d in enumerate(dims)}
    source = ds.frame.select("*", *[F.col(d).cast("string").alias(k) for k, d in named.items()])
    keys = [F.col(k) for k in named]
    sets = source.groupingSets([[k] for k in keys], *keys).agg(
        *aggs, *[F.grouping(k).alias(f"{k}_off") for k in named])
    dimension, member = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, d in named.items():
        here = F.col(f"{k}_off") == 0
        dimension = F.when(here, F.lit(d)).otherwise(dimension)
        member = F.when(here, F.col(k)).otherwise(member)
    out = sets.select(dimension.alias("dimension"), member.alias("member"),
                      *[c for c in sets.columns if c not in named and not c.endswith("_off")])
    return out if blanks else out.where("member is not null")


def contributors(ds: Dataset, measure: str | None = None, agg: str = "sum", limit: int = CONTRIBUTORS) -> DataFrame:
    """The biggest members of every free dimension and an exact tail for each."""
    dims = ds.free_dimensions
    if not dims:
        raise AnalysisError("no dimension left to split by")
    return _split(ds, dims, measure, agg, limit)


def breakdown(ds: Dataset, dimension: str, measure: str | None = None, agg: str = "sum", limit: int = 50) -> DataFrame:
    """One dimension of a slice, ranked, with an exact tail."""
    return _split(ds, [ds.need_dimension(dimension)], measure, agg, max(1, min(int(limit), BREAKDOWN_MAX)))


def _split(ds: Dataset, dims: Sequence[str], measure: str | None, agg: str, limit: int) -> DataFrame:
    measure = None if check_aggregation(agg) == "count" else ds.need_measure(measure)
    if agg == "median":
        # not rebuilt from parts: the rows of the tail are ranked anew
        return _with_share(ds, _top_and_tail(ds, dims, measure, limit), measure, agg)
    v = number(measure) if measure else F.lit(1.0)
    partials = [F.count(F.lit(1)).alias("n_rows"), F.sum(v).alias("s"), F.count(v).alias("c"), F.min(v).alias("lo"),
                F.max(v).alias("hi")]
    merge = [F.sum("n_rows").alias("n_rows"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.min("lo").alias("lo"),
             F.max("hi").alias("hi")]
    order = [F.desc_nulls_last(_rebuilt(agg)), F.asc("member")]
    folded = ranking.top_and_rest(members(ds, dims, *partials), ["dimension"], "member", order, limit, merge)
    return _with_share(ds, folded.withColumn("value", _rebuilt(agg)), measure, agg)


def _rebuilt(agg: str) -> Column:
    return {"sum": F.col("s"), "count": F.col("n_rows").cast("double"), "avg": numbers.ratio(F.col("s"), F.col("c")),
            "min": F.col("lo"), "max": F.col("hi")}[agg]


def _with_share(ds: Dataset, folded: DataFrame, measure: str | None, agg: str) -> DataFrame:
    share = F.lit(None).cast("double")
    if agg in ADDITIVE:
        total = ds.frame.agg(aggregate(measure, agg).alias("t")).scalar()
        share = numbers.pct_of(F.coalesce("value", F.lit(0.0)), total)
    return folded.select("dimension", "rank", "member", "value", "n_rows", "folded", share.alias("share_pct"))


def _top_and_tail(ds: Dataset, dims: Sequence[str], measure: str, limit: int) -> DataFrame:
    """Medians of the best members, and of all rows of the other members."""
    by = ["dimension"]
    pairs = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dims]
    rows = ds.frame.select(measure, F.inline(F.array(*pairs))).where("member is not null")
    known = ranking.sketch(rows, [*by, "member"], [measure])
    groups = value_by(rows, [*by, "member"], measure, "median", known)
    order = [F.desc_nulls_last("value"), F.asc("member")]
    merge = [F.max("value").alias("value"), F.sum("n_rows").alias("n_rows")]
    best = ranking.top_and_rest(groups, by, "member", order, limit, merge)
    # found now, so that the members' medians are not computed again for the tail: at most `limit` + 1 rows per dimension
    found, spark = best.collect(), ds.frame.sparkSession
    top = spark.createDataFrame([r for r in found if r["rank"] is not None], best.schema)
    rest = [r for r in found if r["rank"] is None]
    if not rest:
        return top
    shown = top.select("dimension", "member")
    tail_rows = rows.where(F.col("dimension").isin([r["dimension"] for r in rest])).join(
        F.broadcast(shown), ["dimension", "member"], "left_anti")
    middle = ranking.quantiles(tail_rows, by, [measure], [0.5], ranking.Sketch(known.edges, len(dims))).select(
        *by, F.col("q0").alias("value"))
    tail = spark.createDataFrame(rest, best.schema).drop("value").join(middle, by, "left")
    return top.unionByName(tail)


# -------------------------------------------------------------- records ---

def records(ds: Dataset, sort: str | None = None, desc: bool = True, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of the rows behind a number; ties are broken by the other columns.
    A deep page is found by counting, see :func:`ranking.page`."""
    sort = sort or ds.date_column
    if sort is not None and sort not in ds.user_columns:
        raise AnalysisError(f"cannot sort by {sort!r}")
    size = max(1, min(int(page_size), PAGE_MAX))
    order = [(sort, desc)] if sort else []
    order += [(c, False) for c in ds.user_columns if c != sort]
    return ranking.page(ds.frame.select(*ds.user_columns), order, (max(1, int(page)) - 1) * size, size)


def record_count(ds: Dataset) -> DataFrame:
    return ds.frame.agg(F.count(F.lit(1)).alias("total"))


def describe(ds: Dataset, measure: str | None = None, agg: str = "sum") -> DataFrame:
    """One sentence saying what the number covers."""
    measure = None if agg == "count" else ds.need_measure(measure)
    named = {"sum": "Sum", "avg": "Average", "min": "Minimum", "max": "Maximum", "median": "Median"}
    what = "Count of rows" if agg == "count" else f"{named[check_aggregation(agg)]} of {numbers.words(measure)}"
    conds = [f"{numbers.words(k)} = {v}" for k, v in ds.pinned.items()]
    if ds.date_column and (ds.date_from or ds.date_to):
        day = numbers.words(ds.date_column)
        if ds.date_from and ds.date_to:
            conds.append(f"{day} in {ds.date_from}" if ds.date_from == ds.date_to
                         else f"{day} from {ds.date_from} to {ds.date_to}")
        else:
            conds.append(f"{day} from {ds.date_from}" if ds.date_from else f"{day} up to {ds.date_to}")
    where = f" where {' and '.join(conds)}." if conds else "."
    n = F.count(F.lit(1))
    text = F.concat(F.lit(f"{what} across "), F.format_string("%,d", n), F.when(n == 1, F.lit(" row")).otherwise(
        F.lit(" rows")), F.lit(where))
    if measure:
        gone = n - F.count(measure)
        text = F.concat(text, F.when(gone > 0, F.concat(
            F.lit(" "), F.format_string("%,d", gone), F.when(gone == 1, F.lit(" row")).otherwise(F.lit(" rows")),
            F.lit(f" with no {numbers.words(measure)} value "), F.when(gone == 1, F.lit("is")).otherwise(F.lit("are")),
            F.lit(" not counted."))).otherwise(F.lit("")))
    return ds.frame.agg(text.alias("explanation"))
