"""Forecast models, their backtest and the choice between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import forecast
from tallyspark.plans.catalog.registry import query, rounded, table


def _series(spark: SparkSession, folder: str) -> DataFrame:
    """One monthly series per order status, every month of the table."""
    whole = table(spark, folder, "orders")
    return whole.groupBy(F.col("o_orderstatus").alias("measure"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias(
        "period_key")).agg(F.sum("o_totalprice").alias("value"))


def _grid(*axes: tuple[float, ...]) -> str:
    rows = [()]
    for values in axes:
        rows = [(*r, v) for r in rows for v in values]
    return ", ".join(f"({i}, {', '.join(f'{float(v)}::DOUBLE' for v in r)})" for i, r in enumerate(rows))


_CTE = f"""RECURSIVE ser AS (SELECT o_orderstatus AS measure, date_trunc('month', o_orderdate)::DATE AS k, sum(o_totalprice) AS v
  FROM orders GROUP BY 1, 2),
y AS (SELECT measure, k, v, row_number() OVER (PARTITION BY measure ORDER BY k) - 1 AS t, count(*) OVER (PARTITION BY measure) AS n FROM ser),
o AS (SELECT DISTINCT measure, n, unnest(range(greatest(4, n - 8), n + 1)) AS origin FROM y),
h AS (SELECT unnest(range(1, 4)) AS h),
tr AS (SELECT o.measure, origin, o.n, t, v FROM o JOIN y ON o.measure = y.measure AND t < origin),
lin AS (SELECT measure, origin, n, regr_slope(v, t) AS a, regr_intercept(v, t) AS b FROM tr GROUP BY 1, 2, 3),
slot AS (SELECT tr.measure, tr.origin, t % 12 AS s, avg(v - (b + a * t)) AS e FROM tr JOIN lin USING (measure, origin) GROUP BY 1, 2, 3),
mid AS (SELECT measure, origin, avg(e) AS m FROM slot GROUP BY 1, 2),
hg(no, alpha, beta, phi) AS (VALUES {_grid(forecast.ALPHAS, forecast.BETAS, forecast.PHIS)}),
hp AS (SELECT o.measure, o.n, origin, 2 AS t, no, alpha, beta, phi,
    alpha * y1.v + (1 - alpha) * (y0.v + phi * (y1.v - y0.v)) AS level,
    beta * (alpha * y1.v + (1 - alpha) * (y0.v + phi * (y1.v - y0.v)) - y0.v) + (1 - beta) * phi * (y1.v - y0.v) AS trend,
    power(y1.v - (y0.v + phi * (y1.v - y0.v)), 2) AS sse
  FROM o JOIN y y0 ON y0.measure = o.measure AND y0.t = 0 JOIN y y1 ON y1.measure = o.measure AND y1.t = 1, hg
  UNION ALL SELECT hp.measure, hp.n, origin, hp.t + 1, no, alpha, beta, phi, alpha * v + (1 - alpha) * (level + phi * trend),
    beta * (alpha * v + (1 - alpha) * (level + phi * trend) - level) + (1 - beta) * phi * trend,
    sse + power(v - (level + phi * trend), 2)
  FROM hp JOIN y ON y.measure = hp.measure AND y.t = hp.t WHERE hp.t < origin),
hb AS (SELECT * FROM hp WHERE t = origin QUALIFY row_number() OVER (PARTITION BY measure, origin ORDER BY sse, no) = 1),
wg(no, alpha, beta, gamma) AS (VALUES {_grid(forecast.HW_ALPHAS, forecast.BETAS, forecast.GAMMAS)}),
w0 AS (SELECT measure, avg(v) FILTER (t < 12) AS level, (avg(v) FILTER (t >= 12 AND t < 24) - avg(v) FILTER (t < 12)) / 12 AS trend FROM y GROUP BY 1),
w1 AS (SELECT w0.measure, any_value(level) AS level, any_value(trend) AS trend, list(v - level ORDER BY t) AS season
  FROM w0 JOIN y ON y.measure = w0.measure AND t < 12 GROUP BY 1),
wp AS (SELECT o.measure, n, origin, 12 AS t, no, alpha, beta, gamma, level, trend, season, 0.0::DOUBLE AS sse FROM o JOIN w1 USING (measure), wg
  UNION ALL SELECT wp.measure, wp.n, origin, wp.t + 1, no, alpha, beta, gamma, alpha * (v - season[1]) + (1 - alpha) * (level + trend),
    beta * (alpha * (v - season[1]) + (1 - alpha) * (level + trend) - level) + (1 - beta) * trend,
    list_concat(season[2:12], [gamma * (v - (alpha * (v - season[1]) + (1 - alpha) * (level + trend))) + (1 - gamma) * season[1]]),
    sse + power(v - (level + trend + season[1]), 2)
  FROM wp JOIN y ON y.measure = wp.measure AND y.t = wp.t WHERE wp.t < origin),
wb AS (SELECT * FROM wp WHERE t = origin QUALIFY row_number() OVER (PARTITION BY measure, origin ORDER BY sse, no) = 1),
pred AS (SELECT measure, n, origin, 'linear' AS method, 0 AS complexity, h, b + a * (origin - 1 + h) AS p FROM lin, h
  UNION ALL SELECT o.measure, o.n, origin, 'seasonal_naive', 1, h, v FROM o, h, y WHERE y.measure = o.measure AND t = origin - 12 + (h - 1) % 12
  UNION ALL SELECT measure, n, origin, 'holt_damped', 2, h, level + trend * phi * (1 - power(phi, h)) / (1 - phi) FROM hb, h
  UNION ALL SELECT lin.measure, lin.n, lin.origin, 'linear_seasonal', 3, h, b + a * (lin.origin - 1 + h) + e - m FROM lin, h, slot, mid
    WHERE slot.measure = lin.measure AND slot.origin = lin.origin AND mid.measure = lin.measure AND mid.origin = lin.origin AND s = (lin.origin - 1 + h) % 12
  UNION ALL SELECT measure, n, origin, 'holt_winters', 4, h, level + h * trend + season[((h - 1) % 12 + 1)::INT] FROM wb, h),
miss AS (SELECT pred.measure, method, complexity, h, v, v - p AS e FROM pred JOIN y ON y.measure = pred.measure AND t = origin + h - 1 WHERE origin < pred.n),
score AS (SELECT measure, method, complexity, count(*) AS tests, avg(abs(e)) AS mae, avg(abs(e) / nullif(abs(v), 0)) * 100 AS mape,
  count(*) FILTER (h = 1) AS one_step_tests, sqrt(avg(e * e) FILTER (h = 1)) AS one_step_rmse FROM miss GROUP BY 1, 2, 3),
pick AS (SELECT DISTINCT measure, 0 AS i, NULL::VARCHAR AS method, NULL::DOUBLE AS mae FROM y
  UNION ALL SELECT pick.measure, i + 1, CASE WHEN s.mae IS NOT NULL AND (pick.mae IS NULL OR s.mae < pick.mae * 0.97) THEN s.method ELSE pick.method END,
    CASE WHEN s.mae IS NOT NULL AND (pick.mae IS NULL OR s.mae < pick.mae * 0.97) THEN s.mae ELSE pick.mae END
  FROM pick LEFT JOIN score s ON s.measure = pick.measure AND s.complexity = i AND s.tests >= 3 WHERE i < 5),
best AS (SELECT measure, method FROM pick WHERE i = 5),
fin AS (SELECT pred.measure, pred.method, h AS step, (max(k) OVER (PARTITION BY pred.measure) + to_months(h::INT))::DATE AS k, p,
  1.96 * one_step_rmse * sqrt(h) AS band, mape, mae, tests, one_step_tests FROM pred JOIN score USING (measure, method)
  JOIN y ON y.measure = pred.measure AND y.t = pred.n - 1 WHERE origin = pred.n)"""


def cte(measure: str) -> str:
    """The same over one series per value of the SQL expression ``measure``."""
    return _CTE.replace("SELECT o_orderstatus AS measure,", f"SELECT {measure} AS measure,")


_ROWS = """measure, method, step, strftime(k, '%Y-%m-%d') AS period_key, round(greatest(p, 0), 2) AS value,
  round(greatest(p - band, 0), 2) AS lower, round(greatest(p + band, 0), 2) AS upper, round(mape, 1) AS mape,
  round(mae, 2) AS mae, tests, one_step_tests AS months"""


for _method in forecast.METHODS:
    @query(f"forecast_{_method}", f"WITH {_CTE} SELECT {_ROWS} FROM fin WHERE method = '{_method}'")
    def _forecast(spark: SparkSession, folder: str, method: str = _method) -> DataFrame:
        return rounded(forecast.forecast(_series(spark, folder), 3, (method,)))


@query("forecast_best", f"WITH {_CTE} SELECT {_ROWS} FROM fin JOIN best USING (measure, method)")
def forecast_best(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.forecast(_series(spark, folder)))


@query("backtest_scores", f"""WITH {_CTE} SELECT measure, method, complexity, tests, round(mae, 2) AS mae, round(mape, 4) AS mape,
  one_step_tests, round(one_step_rmse, 2) AS one_step_rmse FROM score""")
def backtest_scores(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(forecast.backtest(_series(spark, folder)), mape=4)


@query("model_choice", f"WITH {_CTE} SELECT measure, method, round(mae, 2) AS mae FROM best JOIN score USING (measure, method)")
def model_choice(spark: SparkSession, folder: str) -> DataFrame:
    chosen = forecast.choose(forecast.backtest(_series(spark, folder)))
    return rounded(chosen.select("measure", F.col("best.method").alias("method"), F.col("best.mae").alias("mae")))
