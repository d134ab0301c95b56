"""Forecasts of monthly series by the model that best predicted their own past.

Each series is one row holding its values in order (one per month), and the
models are expressions over that array, so any number of series is fitted in
parallel without a shuffle after the arrays are built.  Training prefixes for
the backtest are rows as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import ratio

YEAR = 12
ORIGINS, HORIZONS, MIN_TESTS = 6, 3, 3
CLEARLY_BETTER = 0.97
# Models from simple to complex, months they need, and their names.
METHODS = ("linear", "seasonal_naive", "holt_damped", "linear_seasonal", "holt_winters")
MIN_TRAIN = {"linear": 4, "seasonal_naive": 12, "holt_damped": 4, "linear_seasonal": 24, "holt_winters": 24}
LABELS = {"linear": "linear trend", "seasonal_naive": "same month last year",
          "holt_damped": "exponential smoothing (damped trend)", "linear_seasonal": "trend + seasonality",
          "holt_winters": "Holt-Winters (seasonal smoothing)"}
# Smoothing parameters tried.
ALPHAS, BETAS, PHIS, GAMMAS = (0.1, 0.3, 0.5, 0.7, 0.9), (0.05, 0.15, 0.3), (0.8, 0.9, 0.98), (0.05, 0.2, 0.4)
HW_ALPHAS = (0.3, 0.7)


def arrays(series: DataFrame) -> DataFrame:
    """``measure``, ``y`` (values in period order), ``n``, ``last_period``."""
    points = F.sort_array(F.collect_list(F.struct("period_key", "value")))  # one per month of the calendar
    return series.groupBy("measure").agg(points.alias("p"), F.max("period_key").alias("last_period")).select(
        "measure", F.transform("p", lambda p: p["value"].cast("double")).alias("y"), F.size("p").alias("n"),
        "last_period")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _mean(values: Column) -> Column:
    return ratio(_sum(values), F.size(values).cast("double"))


def _with_line(df: DataFrame, y: str = "y") -> DataFrame:
    """``slope`` and ``level`` (at t=0) of the least-squares line over 0..n-1."""
    n = F.size(y).cast("double")
    middle = (n - 1) / 2
    top = _sum(F.transform(y, lambda v, i: v * (i.cast("double") - middle)))
    bottom = n * (n * n - 1) / 12
    fitted = df.withColumn("slope", ratio(top, bottom))
    return fitted.withColumn("level", _mean(F.col(y)) - F.col("slope") * middle)


def _ahead(steps: int, value: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda h: value(h.cast("double")))


def _linear(steps: int) -> Column:
    return _ahead(steps, lambda h: F.col("level") + F.col("slope") * (F.size("y") - 1 + h))


def _seasonal_naive(steps: int) -> Column:
    n = F.size("y")
    return _ahead(steps, lambda h: F.get("y", n - YEAR + ((h.cast("int") - 1) % YEAR)))


def _linear_seasonal(steps: int) -> tuple[Column, Column]:
    off = F.transform("y", lambda v, i: v - (F.col("level") + F.col("slope") * i))
    slots = F.transform(F.sequence(F.lit(0), F.lit(YEAR - 1)),
                        lambda s: _mean(F.filter(off, lambda v, i: (i % YEAR) == s)))

    def at(h: Column) -> Column:
        t = F.size("y") - 1 + h
        return F.col("level") + F.col("slope") * t + F.get("_slots", (t % YEAR).cast("int")) - _mean(F.col("_slots"))

    return slots, _ahead(steps, at)


def _grid(**axes: tuple[float, ...]) -> Column:
    """All combinations of the parameters, numbered in nested-loop order."""
    rows = [{}]
    for name, values in axes.items():
        rows = [{**r, name: v} for r in rows for v in values]
    return F.array(*[F.struct(F.lit(i).alias("no"), *[F.lit(float(v)).alias(k) for k, v in r.items()])
                     for i, r in enumerate(rows)])


def _holt_fit() -> Column:
    """Best of the grid by one-step squared error; the first on a tie."""
    y = F.col("y")

    def run(g: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            guess = s["level"] + g["phi"] * s["trend"]
            level = g["alpha"] * v + (1 - g["alpha"]) * guess
            trend = g["beta"] * (level - s["level"]) + (1 - g["beta"]) * g["phi"] * s["trend"]
            return F.struct((s["sse"] + (v - guess) * (v - guess)).alias("sse"), level.alias("level"),
                            trend.alias("trend"))

        start = F.struct(F.lit(0.0).alias("sse"), F.get(y, F.lit(0)).alias("level"),
                         (F.get(y, F.lit(1)) - F.get(y, F.lit(0))).alias("trend"))
        return F.aggregate(F.slice(y, 2, F.size(y)), start, step, lambda s: F.struct(
            s["sse"].alias("sse"), g["no"].alias("no"), s["level"].alias("level"), s["trend"].alias("trend"),
            g["phi"].alias("phi")))

    return F.array_min(F.transform(_grid(alpha=ALPHAS, beta=BETAS, phi=PHIS), run))


def _holt(steps: int) -> Column:
    f = F.col("_holt")
    damp = lambda h: f["phi"] * (1 - F.pow(f["phi"], h)) / (1 - f["phi"])
    return _ahead(steps, lambda h: f["level"] + damp(h) * f["trend"])


def _winters_fit() -> Column:
    y = F.col("y")
    first, second = F.slice(y, 1, YEAR), F.slice(y, YEAR + 1, YEAR)

    def run(g: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            season = F.get(s["season"], F.lit(0))
            guess = s["level"] + s["trend"] + season
            level = g["alpha"] * (v - season) + (1 - g["alpha"]) * (s["level"] + s["trend"])
            trend = g["beta"] * (level - s["level"]) + (1 - g["beta"]) * s["trend"]
            renewed = g["gamma"] * (v - level) + (1 - g["gamma"]) * season
            return F.struct((s["sse"] + (v - guess) * (v - guess)).alias("sse"), level.alias("level"),
                            trend.alias("trend"),
                            F.concat(F.slice(s["season"], 2, YEAR - 1), F.array(renewed)).alias("season"))

        base = _mean(first)
        start = F.struct(F.lit(0.0).alias("sse"), base.alias("level"), ((_mean(second) - base) / YEAR).alias("trend"),
                         F.transform(first, lambda v: v - base).alias("season"))
        return F.aggregate(F.slice(y, YEAR + 1, F.size(y)), start, step, lambda s: F.struct(
            s["sse"].alias("sse"), g["no"].alias("no"), s["level"].alias("level"), s["trend"].alias("trend"),
            s["season"].alias("season")))

    return F.array_min(F.transform(_grid(alpha=HW_ALPHAS, beta=BETAS, gamma=GAMMAS), run))


def _winters(steps: int) -> Column:
    f = F.col("_winters")
    return _ahead(steps, lambda h: f["level"] + h * f["trend"] + F.get(f["season"], ((h.cast("int") - 1) % YEAR)))


def predictions(train: DataFrame, steps: int, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """For rows with an array ``y``: one row per method that has enough history,
    with ``predicted``, an array of ``steps`` values."""
    other = [c for c in train.columns if c != "y"]
    df = _with_line(train)
    pred: dict[str, Column] = {}
    enough = {m: F.size("y") >= MIN_TRAIN[m] for m in METHODS}
    if "linear" in methods:
        pred["linear"] = _linear(steps)
    if "seasonal_naive" in methods:
        pred["seasonal_naive"] = _seasonal_naive(steps)
    if "holt_damped" in methods:
        df = df.withColumn("_holt", F.when(enough["holt_damped"], _holt_fit()))
        pred["holt_damped"] = _holt(steps)
    if "linear_seasonal" in methods:
        slots, pred["linear_seasonal"] = _linear_seasonal(steps)
        df = df.withColumn("_slots", F.when(enough["linear_seasonal"], slots))
    if "holt_winters" in methods:
        df = df.withColumn("_winters", F.when(enough["holt_winters"], _winters_fit()))
        pred["holt_winters"] = _winters(steps)
    rows = [F.struct(F.lit(METHODS.index(m)).alias("complexity"), F.lit(m).alias("method"),
                     F.when(enough[m], p).alias("predicted")) for m, p in pred.items()]
    return df.select(*other, F.inline(F.array(*rows))).where("predicted is not null")


def prefixes(series_arrays: DataFrame) -> DataFrame:
    """Each series as its training prefixes: the last few origins, and the whole."""
    n = F.col("n")
    first = F.greatest(F.lit(min(MIN_TRAIN.values())), n - ORIGINS - HORIZONS + 1)
    return series_arrays.where(n >= 4).withColumn("origin", F.explode(F.sequence(F.least(first, n), n))).select(
        "measure", "n", "last_period", "origin", F.slice("y", F.col("origin") + 1, HORIZONS).alias("actual"),
        F.slice("y", F.lit(1), F.col("origin")).alias("y"))


def _scores(predicted: DataFrame) -> DataFrame:
    tests = predicted.where(F.col("origin") < F.col("n")).select(
        "measure", "method", "complexity", F.posexplode("actual").alias("h0", "actual_value"), "predicted")
    miss = F.col("actual_value") - F.get("predicted", F.col("h0"))
    one = F.col("h0") == 0
    return tests.withColumn("miss", miss).groupBy("measure", "method", "complexity").agg(
        F.count(F.lit(1)).alias("tests"), F.avg(F.abs("miss")).alias("mae"),
        (F.avg(ratio(F.abs("miss"), F.abs(F.nullif("actual_value", F.lit(0.0))))) * 100).alias("mape"),
        F.count_if(one).alias("one_step_tests"),
        F.sqrt(F.avg(F.when(one, F.col("miss") * F.col("miss")))).alias("one_step_rmse"))


def backtest(series: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Errors of each model over the last months of each series."""
    return _scores(predictions(prefixes(arrays(series)), HORIZONS, methods))


def choose(scores: DataFrame) -> DataFrame:
    """The model of each series: from simple to complex, a later one has to be
    clearly better than the best so far."""
    listed = F.sort_array(F.collect_list(F.struct("complexity", "method", "mae", "mape", "tests", "one_step_tests",
                                                  "one_step_rmse")))  # at most one per method
    trusted = scores.where(F.col("tests") >= MIN_TESTS).groupBy("measure").agg(listed.alias("s"))

    def better(best: Column, s: Column) -> Column:
        return F.when(s["mae"] < best["mae"] * CLEARLY_BETTER, s).otherwise(best)

    return trusted.select("measure", F.aggregate(F.slice("s", 2, len(METHODS)), F.col("s")[0], better).alias("best"))


def forecast(series: DataFrame, horizon: int = 3, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """The next ``horizon`` months of every series of four months or more, with a
    95% band from the chosen model's own one-step misses."""
    steps = max(HORIZONS, horizon)
    train = prefixes(arrays(series))
    predicted = predictions(train, steps, methods)
    best = choose(_scores(predicted))
    whole = _with_line(train.where(F.col("origin") == F.col("n")))
    off = F.transform("y", lambda v, i: v - (F.col("level") + F.col("slope") * i))
    spread = F.sqrt(_sum(F.transform(off, lambda v: v * v)) / (F.size("y") - 1))
    base = whole.select("measure", "last_period", spread.alias("spread")).join(best, "measure", "left")
    picked = base.withColumn("method", F.coalesce(F.col("best.method"), F.lit("linear")))
    ahead = predicted.where(F.col("origin") == F.col("n")).select("measure", "method", "predicted")
    sd = F.when(F.col("best.one_step_tests") >= MIN_TESTS, F.col("best.one_step_rmse")).otherwise(F.col("spread"))
    rows = picked.join(ahead, ["measure", "method"]).select(
        "measure", "method", "last_period", sd.alias("sd"), "best",
        F.posexplode(F.slice("predicted", 1, horizon)).alias("h0", "point"))
    band = F.col("sd") * 1.96 * F.sqrt(F.col("h0") + 1)

    def floor0(v: Column) -> Column:
        return F.round(F.greatest(v, F.lit(0.0)), 2)

    return rows.select("measure", "method", (F.col("h0") + 1).alias("step"),
                       F.add_months("last_period", F.col("h0") + 1).alias("period_key"),
                       floor0(F.col("point")).alias("value"), floor0(F.col("point") - band).alias("lower"),
                       floor0(F.col("point") + band).alias("upper"), F.round("best.mape", 1).alias("mape"),
                       F.round("best.mae", 2).alias("mae"), F.col("best.tests").alias("tests"),
                       F.col("best.one_step_tests").alias("months"))
