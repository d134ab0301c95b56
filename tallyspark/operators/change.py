"""Why a number moved: period totals, waterfalls, price/volume/mix, metric trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers, periods
from tallyspark.functions.numbers import number, ratio
from tallyspark.functions.periods import Comparison, Span
from tallyspark.model import ADDITIVE, AnalysisError, Dataset
from tallyspark.operators import overview, ranking, slices

MAX_STEPS = 25
MIN_HISTORY = 5
# Names that mark a measure as a volume, or a dimension as a product.
VOLUME_HINTS = ("unit", "qty", "quantity", "volume", "orders", "items", "count", "sold", "pieces")
PRODUCT_HINTS = ("product", "sku", "item", "category")


def comparison(ds: Dataset, grain: str = "month", compare: str = "previous") -> Comparison:
    try:
        ds.need_date()
        return periods.compare_spans(ds.data_end(), grain, compare, ds.date_from, ds.date_to)
    except ValueError as problem:
        raise AnalysisError(str(problem)) from problem


def comparison_frame(ds: Dataset, grain: str = "month", compare: str = "previous") -> DataFrame:
    """The two periods as a one-row frame."""
    per = comparison(ds, grain, compare)
    row = ds.frame.sparkSession.range(1)
    return row.select(*[F.lit(getattr(span, side).isoformat()).alias(f"{name}_{word}")
                        for name, span in (("a", per.a), ("b", per.b))
                        for word, side in (("from", "first"), ("to", "last"))],
                      F.lit(per.a.label).alias("a_label"), F.lit(per.b.label).alias("b_label"),
                      F.lit(per.like_for_like).alias("like_for_like"), F.lit(per.aligned).alias("aligned"),
                      F.lit(per.data_end.isoformat()).alias("data_end"))


def _undated(ds: Dataset) -> Dataset:
    """The slice's filters without its date range, which B replaces."""
    if not (ds.date_from or ds.date_to):
        return ds
    base = Dataset(frame=ds.whole, columns=ds.columns, name=ds.name, whole=ds.whole, _shared=ds._shared)
    return base.slice(ds.pinned)


def _in(ds: Dataset, span: Span) -> Column:
    return ds.between(span.first, span.last)


def _amount(measure: str | None, agg: str) -> Column:
    return F.lit(1.0) if agg == "count" else number(measure)


def _two(ds: Dataset, per: Comparison, value: Column, names: tuple[str, str] = ("a", "b")) -> list[Column]:
    return [F.sum(F.when(_in(ds, span), value).otherwise(F.lit(0.0))).alias(name)
            for span, name in zip((per.a, per.b), names)]


def _both(ds: Dataset, per: Comparison) -> Dataset:
    base = _undated(ds)
    return base.with_frame(base.frame.where(_in(ds, per.a) | _in(ds, per.b)))


def _need_additive(ds: Dataset, measure: str | None, agg: str) -> str | None:
    if agg not in ADDITIVE:
        raise AnalysisError("a change can only be broken into parts for a total or a count")
    return None if agg == "count" else ds.need_measure(measure)


def period_totals(ds: Dataset, measure: str | None = None, agg: str = "sum", grain: str = "month",
                  compare: str = "previous") -> DataFrame:
    measure = _need_additive(ds, measure, agg)
    per = comparison(ds, grain, compare)
    row = _both(ds, per).frame.agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(
        _two(ds, per, _amount(measure, agg)), "ab")])
    delta = F.col("b") - F.col("a")
    return row.select(F.lit(per.a.label).alias("a_label"), "a", F.lit(per.b.label).alias("b_label"), "b",
                      delta.alias("delta"), numbers.pct_change(F.col("b"), F.col("a")).alias("pct"),
                      F.lit(per.like_for_like).alias("like_for_like"))


def member_changes(ds: Dataset, dims: Sequence[str], measure: str | None = None, agg: str = "sum",
                   grain: str = "month", compare: str = "previous") -> DataFrame:
    """A and B of every member of every dimension from one scan of two periods;
    blanks are members too, so the parts add up to the whole change."""
    measure = _need_additive(ds, measure, agg)
    per = comparison(ds, grain, compare)
    both = _both(ds, per)
    rows = slices.members(both, dims, *_two(ds, per, _amount(measure, agg)), blanks=True)
    return rows.select("dimension", "member", F.coalesce("a", F.lit(0.0)).alias("a"),
                       F.coalesce("b", F.lit(0.0)).alias("b"))


def split_ranking(changes: DataFrame) -> DataFrame:
    """How concentrated the change is in each dimension: the largest move over
    the sum of all moves, 0 when fewer than two members moved."""
    delta = F.col("b") - F.col("a")
    size = F.abs(delta)
    moved = F.count_if(delta != 0)
    per_dim = changes.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("members"),
        F.when(moved >= 2, ratio(F.max(size), F.sum(size))).otherwise(F.lit(0.0)).alias("score"),
        F.max_by(F.struct("member", delta.alias("delta")), F.struct(size, F.col("member"))).alias("top"))
    return per_dim.select("dimension", "members", F.coalesce("score", F.lit(0.0)).alias("score"),
                          F.col("top.member").alias("top"), F.col("top.delta").alias("top_delta"))


def _steps(changes: DataFrame, limit: int) -> DataFrame:
    delta = F.col("b") - F.col("a")
    limit = max(1, min(int(limit), MAX_STEPS))
    order = [F.desc(F.abs(delta)), F.asc_nulls_last("member")]
    merge = [F.sum("a").alias("a"), F.sum("b").alias("b")]
    folded = ranking.top_and_rest(changes, ["dimension"], "member", order, limit, merge)
    # at most MAX_STEPS + 1 rows per dimension from here on
    total = F.sum(delta).over(Window.partitionBy("dimension"))
    shown = Window.partitionBy("dimension").orderBy(F.col("rank").isNull(), F.desc(delta), F.asc_nulls_last("member"))
    return folded.select(
        "dimension", F.row_number().over(shown).alias("step"), "member",
        (F.col("member").isNull() & F.col("rank").isNotNull()).alias("blank"), F.col("rank").isNull().alias("is_other"),
        "folded", "a", "b", delta.alias("delta"), ratio(delta, total).alias("share_of_change"))


def best_split(ds: Dataset, measure: str | None = None, agg: str = "sum", grain: str = "month",
               compare: str = "previous") -> str:
    """The dimension whose movement is most concentrated (first on a tie)."""
    dims = ds.free_dimensions
    if not dims:
        raise AnalysisError("no dimension left to split by")
    found = {r["dimension"]: r["score"] for r in split_ranking(
        member_changes(ds, dims, measure, agg, grain, compare)).select("dimension", "score").collect()}  # one per dim
    return max(dims, key=lambda d: (found.get(d, 0.0), -dims.index(d)))


def waterfall(ds: Dataset, measure: str | None = None, agg: str = "sum", grain: str = "month",
              compare: str = "previous", dimension: str | None = None, limit: int = 8) -> DataFrame:
    """One dimension's steps from A to B: the biggest movers, gainers first, and
    the others as one step.  They add up to the total change."""
    if dimension is not None and dimension not in ds.free_dimensions:
        raise AnalysisError(f"cannot split by {dimension!r}")
    chosen = dimension or best_split(ds, measure, agg, grain, compare)
    return _steps(member_changes(ds, [chosen], measure, agg, grain, compare), limit)


def waterfall_all(ds: Dataset, measure: str | None = None, agg: str = "sum", grain: str = "month",
                  compare: str = "previous", limit: int = 8) -> DataFrame:
    """The steps of every free dimension from one scan."""
    return _steps(member_changes(ds, ds.free_dimensions, measure, agg, grain, compare), limit)


def waterfall_bars(steps: DataFrame) -> DataFrame:
    """Floating bars: each step starts where the running total stands."""
    w = Window.partitionBy("dimension").orderBy("step")
    start = F.sum("a").over(Window.partitionBy("dimension"))
    run = start + F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("dimension", "step", "member", "is_other",
                        F.when(F.col("delta") >= 0, "up").otherwise("down").alias("kind"),
                        F.least(run, run - F.col("delta")).alias("base"), F.abs("delta").alias("bar"),
                        run.alias("running"))


# --------------------------------------------------------- significance ---

def significance(ds: Dataset, measure: str | None = None, agg: str = "sum", grain: str = "month") -> DataFrame:
    """Is the latest change larger than this series usually moves?  Every period
    is measured over the same first days; a missing period is a zero.  No row
    when there is too little history to say."""
    measure = _need_additive(ds, measure, agg)
    per = comparison(ds, grain, "previous")
    date = F.col(ds.need_date())
    base = _undated(ds)
    window = per.b.days if per.like_for_like else 400
    start = periods.key(date, grain)
    rows = base.frame.where(base.between(None, per.b.last) & date.isNotNull() & (
        F.datediff(date.cast("date"), start) < window))
    found = rows.groupBy(start.alias("period_key")).agg(
        F.coalesce(F.sum(_amount(measure, agg)), F.lit(0.0)).alias("value"))
    full = slices.with_spine(found, grain, F.lit(per.b.first))
    order = Window.orderBy("period_key")  # one row per period of the calendar
    deltas = full.select("period_key", (F.col("value") - F.lag("value").over(order)).alias("delta")).where(
        "delta is not null")
    latest = F.col("period_key") == F.lit(per.b.first)
    past = F.when(~latest, F.col("delta"))
    row = deltas.agg(F.max(F.when(latest, F.col("delta"))).alias("latest"), F.avg(past).alias("mean_change"),
                     F.stddev_samp(past).alias("typical_change"), F.count(past).alias("history"))
    z = ratio(F.col("latest") - F.col("mean_change"), F.col("typical_change"))
    ok = row.where((F.col("history") >= MIN_HISTORY) & (F.col("typical_change") > 0) & F.lit(per.aligned))
    return ok.select(
        F.when(F.abs(z) >= 2.5, "unusual").when(F.abs(z) >= 1.5, "notable").otherwise("normal").alias("level"),
        z.alias("z"), "latest", "mean_change", "typical_change", "history",
        F.lit(window if per.like_for_like else None).cast("int").alias("window_days"))


# --------------------------------------------------- price, volume, mix ---

def guess_volume(ds: Dataset, measure: str) -> str | None:
    return next((m for m in ds.measures if m != measure and any(h in m.lower() for h in VOLUME_HINTS)), None)


def price_volume_mix(ds: Dataset, measure: str | None = None, volume: str | None = None,
                     dimension: str | None = None, grain: str = "month", compare: str = "previous") -> DataFrame:
    """Effects per member.  A member new in B has no old price, so it is all
    mix; one that is gone changes no price.  ``value_a``.. are kept so that
    totals can be rebuilt by :func:`price_volume_mix_total`."""
    measure = ds.need_measure(measure)
    volume = volume or guess_volume(ds, measure)
    if volume is None or volume == measure or volume not in ds.measures:
        raise AnalysisError(f"no volume measure for {measure!r}")
    free = ds.free_dimensions
    if dimension is None and free:
        dimension = next((d for d in free if any(h in d.lower() for h in PRODUCT_HINTS)), free[0])
    elif dimension is not None and dimension not in free:
        raise AnalysisError(f"cannot analyse the mix across {dimension!r}")
    per = comparison(ds, grain, compare)
    member = (F.col(dimension).cast("string") if dimension else F.lit(None).cast("string")).alias("member")
    seg = _both(ds, per).frame.groupBy(member).agg(
        *_two(ds, per, number(measure), ("ra", "rb")), *_two(ds, per, number(volume), ("qa", "qb")))
    seg = seg.select("member", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ra", "rb", "qa", "qb")])
    totals = seg.agg(F.sum("qa").alias("qa"), F.sum("qb").alias("qb"))
    # a one-row subquery rather than a window over all members in one task
    seg = seg.withColumn("all", totals.select(F.struct("qa", "qb")).scalar()).where("all.qa > 0 and all.qb > 0")
    grown = F.col("all.qb") - F.col("all.qa")
    share_a, share_b = F.col("qa") / F.col("all.qa"), F.col("qb") / F.col("all.qb")
    seg = (seg.withColumn("price_a", ratio(F.col("ra"), F.col("qa")))
           .withColumn("price_b", ratio(F.col("rb"), F.col("qb"))))
    old = F.coalesce("price_a", "price_b", F.lit(0.0))
    new = F.coalesce("price_b", old)
    return seg.select("member", "ra", "rb", "qa", "qb", "price_a", "price_b",
                      (F.col("rb") - F.col("ra")).alias("delta"), (grown * share_a * old).alias("volume_effect"),
                      (F.col("all.qb") * (share_b - share_a) * old).alias("mix_effect"),
                      (F.col("qb") * (new - old)).alias("price_effect"))


def price_volume_mix_total(parts: DataFrame) -> DataFrame:
    """Volume, mix and price effects of the whole, and what they leave unexplained."""
    row = parts.agg(*[F.sum(c).alias(c) for c in ("ra", "rb", "qa", "qb", "mix_effect", "price_effect")])
    volume = (F.col("qb") - F.col("qa")) * ratio(F.col("ra"), F.col("qa"))
    delta = F.col("rb") - F.col("ra")
    gap = delta - (volume + F.col("mix_effect") + F.col("price_effect"))
    noise = F.greatest(F.lit(1.0), F.abs(delta)) * 1e-6
    return row.where("qa > 0 and qb > 0").select(
        F.col("ra").alias("value_a"), F.col("rb").alias("value_b"), F.col("qa").alias("volume_a"),
        F.col("qb").alias("volume_b"), ratio(F.col("ra"), F.col("qa")).alias("avg_price_a"),
        ratio(F.col("rb"), F.col("qb")).alias("avg_price_b"), delta.alias("delta"), volume.alias("volume_effect"),
        "mix_effect", "price_effect", F.when(F.abs(gap) < noise, F.lit(0.0)).otherwise(gap).alias("unexplained"))


# --------------------------------------------------------------- drivers ---

def drivers(ds: Dataset, measure: str | None = None, limit: int = 6) -> DataFrame:
    """The biggest movers of every dimension between the last two months that
    exist, gainers first, with the dimension's concentration."""
    measure = ds.need_measure(measure)
    date = ds.need_date()
    month = periods.key(F.col(date), "month")
    last = ds.frame.select(month.alias("m")).where("m is not null").distinct().orderBy(F.desc("m")).limit(2)
    found = sorted(r["m"] for r in last.collect())  # two months
    if len(found) < 2:
        raise AnalysisError("need at least two months of data to explain a change")
    spans = [Span(d, periods.month_end(d)) for d in found]
    narrowed = ds.with_frame(ds.frame.where(ds.between(spans[0].first, spans[0].last) | ds.between(
        spans[1].first, spans[1].last)))
    sums = [F.sum(F.when(ds.between(s.first, s.last), number(measure))).alias(n)
            for s, n in zip(spans, ("previous", "current"))]
    groups = slices.members(narrowed, ds.free_dimensions, *sums).select(
        "dimension", "member", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("previous", "current")])
    total = narrowed.frame.agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(sums, "ab")]).select(
        (F.col("b") - F.col("a")).alias("d")).scalar()
    delta = F.col("current") - F.col("previous")
    order = [F.desc(F.abs(delta)), F.asc("member")]
    top = groups.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(*order))).where(
        F.col("rank") <= limit)
    widest = F.max(F.abs(delta)).over(Window.partitionBy("dimension"))  # at most `limit` rows
    shown = Window.partitionBy("dimension").orderBy(F.desc(delta), "member")
    return top.select("dimension", F.row_number().over(shown).alias("position"), "member", "previous", "current",
                      delta.alias("delta"), ratio(delta, total).alias("share"),
                      F.coalesce(ratio(widest, F.abs(total)), F.lit(0.0)).alias("concentration"))


# ------------------------------------------------- comparisons and trees ---

def compare_segments(ds: Dataset, dimension: str, left: str, right: str) -> DataFrame:
    """Every measure's total for two members of a dimension, in one pass."""
    sides = {"a": ds.equals(ds.need_dimension(dimension), left), "b": ds.equals(dimension, right)}
    return _compare(ds, sides)


def compare_periods(ds: Dataset, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    spans = {n: ds.between(periods.first_day(x[0]), periods.last_day(x[1])) for n, x in (("a", a), ("b", b))}
    return _compare(ds, spans)


def _compare(ds: Dataset, sides: dict[str, Column]) -> DataFrame:
    ms = list(ds.measures)
    aggs = [F.sum(F.when(cond, number(m))).alias(f"{n}__{m}") for m in ms for n, cond in sides.items()]
    row = ds.frame.where(sides["a"] | sides["b"]).agg(*aggs)
    long = overview._long(row, ms, ["a", "b"])
    return long.withColumn("delta_pct", F.round(numbers.pct_change(F.col("a"), F.col("b")), 1))


def overlay(ds: Dataset, dimension: str, left: str, right: str, measure: str | None = None) -> DataFrame:
    """Two members' monthly trends side by side; a month only one has is kept."""
    m = number(ds.need_measure(measure))
    one, two = ds.equals(ds.need_dimension(dimension), left), ds.equals(dimension, right)
    date = F.col(ds.need_date())
    return ds.frame.where((one | two) & date.isNotNull()).groupBy(periods.key(date, "month").alias("k")).agg(
        F.sum(F.when(one, m)).alias("a"), F.sum(F.when(two, m)).alias("b")).select(
        F.date_format("k", "yyyy-MM").alias("period"), "a", "b")


def decomposition_tree(ds: Dataset, measure: str | None = None, agg: str = "sum", grain: str = "month",
                       compare: str = "previous", depth: int = 3, limit: int = 10) -> DataFrame:
    """Repeated splitting: each level takes the dimension that best explains the
    change of the member picked at the level above (its biggest mover).

    Each level reads the rows under the members picked so far and reduces them to A
    and B per member of the dimensions left, so nothing near the size of the facts is kept."""
    measure = _need_additive(ds, measure, agg)
    per = comparison(ds, grain, compare)
    dims = ds.free_dimensions
    both, amounts = _both(ds, per), _two(ds, per, _amount(measure, agg))
    out, pins = None, []
    for level in range(1, min(depth, len(dims)) + 1):
        left = [d for d in dims if d not in [p[0] for p in pins]]
        rows = both.frame
        for d, value in pins:
            rows = rows.where(F.col(d).cast("string").eqNullSafe(F.lit(value)))
        under = both.with_frame(rows)
        merged = slices.members(under, left, *amounts, blanks=True)
        scores = {r["dimension"]: r for r in split_ranking(merged).collect()}  # one row per dimension
        chosen = max(left, key=lambda d: (scores[d]["score"] if d in scores else 0.0, -left.index(d)))
        path = " / ".join(f"{d}={v}" for d, v in pins)
        steps = _steps(slices.members(under, [chosen], *amounts, blanks=True), limit).withColumn("level", F.lit(level)).withColumn(
            "path", F.lit(path))
        out = steps if out is None else out.unionByName(steps)
        if chosen not in scores:
            break
        pins.append((chosen, scores[chosen]["top"]))
    return out
