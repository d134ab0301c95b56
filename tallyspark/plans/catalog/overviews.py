"""Dashboard aggregates and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import overview, series, slices
from tallyspark.plans.catalog.registry import (EVENTS, ORDERS, SALES, events, lineitem, orders, query, rounded, sales,
                                               table)

_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _each(template: str, joiner: str = " UNION ALL ") -> str:
    return joiner.join(template.format(m=m) for m in _MEASURES)


_MONTHLY = "m AS (" + _each("SELECT '{m}' AS measure, date_trunc('month', l_shipdate)::DATE AS k, sum({m}) AS v "
                            "FROM lineitem GROUP BY 1, 2") + ")"


@query("kpi_totals", _each("SELECT count(*) AS row_count, '{m}' AS measure, round(sum({m}), 2) AS total, "
                           "round(avg({m}), 4) AS average FROM lineitem"))
def kpi_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(overview.kpi_totals(lineitem(spark, folder)), average=4)


@query("monthly_trend", f"WITH {_MONTHLY} SELECT strftime(k, '%Y-%m-%d') AS period_key, measure, round(v, 2) AS value FROM m")
def monthly_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(overview.monthly_series(lineitem(spark, folder)))


@query("kpi_delta", f"""WITH {_MONTHLY},
r AS (SELECT measure, k, v, lag(v) OVER (PARTITION BY measure ORDER BY k) AS pv,
  row_number() OVER (PARTITION BY measure ORDER BY k DESC) AS age FROM m),
l AS (SELECT measure, array_to_string(list(round(v, 2)::DECIMAL(18,2) ORDER BY k), ',') AS sparkline FROM r
  WHERE age <= 12 GROUP BY 1)
SELECT measure, strftime(k, '%Y-%m') AS period, round(v, 2) AS current_value, round(pv, 2) AS previous_value,
  round((v - pv) / abs(pv) * 100, 1) AS delta_pct, sparkline FROM r JOIN l USING (measure) WHERE age = 1""")
def kpi_delta(spark: SparkSession, folder: str) -> DataFrame:
    rows = series.latest_delta(overview.monthly_series(lineitem(spark, folder)))
    return rounded(rows.withColumn("sparkline", F.array_join(F.transform(
        "sparkline", lambda v: F.round(v, 2).cast("decimal(18,2)").cast("string")), ",")))


@query("breakdown_share", f"""WITH {SALES},
u AS (SELECT 'r_name' AS dimension, r_name AS member, o_totalprice FROM s
  UNION ALL SELECT 'c_mktsegment', c_mktsegment, o_totalprice FROM s
  UNION ALL SELECT 'n_name', n_name, o_totalprice FROM s UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_totalprice FROM s),
g AS (SELECT dimension, member, sum(o_totalprice) AS v FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY v DESC, member) AS k,
  sum(v) OVER (PARTITION BY dimension) AS grand FROM g)
SELECT dimension, CASE WHEN k <= 20 THEN k END AS rank, CASE WHEN k <= 20 THEN member END AS member,
  round(sum(v), 2) AS value, CASE WHEN min(k) > 20 THEN count(*) ELSE 0 END AS folded,
  round(sum(v) / max(grand) * 100, 1) AS share_pct FROM r GROUP BY 1, 2, 3""")
def breakdown_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(overview.breakdown_shares(sales(spark, folder)))


@query("distribution", _each("""SELECT '{m}' AS measure, min({m}) AS "min", round(quantile_cont({m}, 0.25), 4) AS q1,
  round(median({m}), 4) AS median, round(quantile_cont({m}, 0.75), 4) AS q3, max({m}) AS "max",
  round(avg({m}), 4) AS mean, round(stddev_samp({m}), 4) AS std FROM lineitem"""))
def distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(overview.distribution(lineitem(spark, folder)), 4)


@query("treemap", f"""WITH {SALES},
g AS (SELECT r_name AS parent, n_name AS child, sum(o_totalprice) AS value FROM s GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY value DESC, child) AS child_rank FROM g),
t AS (SELECT parent, sum(value) AS parent_value FROM k WHERE child_rank <= 12 GROUP BY 1
  ORDER BY parent_value DESC, parent LIMIT 8)
SELECT parent, child, round(value, 2) AS value, child_rank, round(parent_value, 2) AS parent_value
FROM k JOIN t USING (parent) WHERE child_rank <= 12""")
def treemap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(overview.treemap(sales(spark, folder), "r_name", "n_name"))


@query("filter_options", """
WITH u AS (SELECT 'l_linenumber' AS dimension, l_linenumber::VARCHAR AS value FROM lineitem
  UNION SELECT 'l_returnflag', l_returnflag FROM lineitem UNION SELECT 'l_linestatus', l_linestatus FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value) AS position FROM u WHERE value IS NOT NULL)
SELECT * FROM r WHERE position <= 200""")
def filter_options(spark: SparkSession, folder: str) -> DataFrame:
    """Asked of a slice, answered from the whole."""
    return overview.dimension_values(lineitem(spark, folder).slice({"l_returnflag": "A"}))


@query("schema_summary", """
WITH u AS (SELECT 'event_type' AS dimension, event_type AS value FROM events GROUP BY 2)
SELECT dimension, string_agg(value, ',' ORDER BY value) AS examples, count(*) AS shown FROM u GROUP BY 1""")
def schema_summary(spark: SparkSession, folder: str) -> DataFrame:
    return overview.schema_summary(events(spark, folder)).withColumn("examples", F.array_join("examples", ","))


@query("data_profile", f"""WITH {EVENTS}
SELECT count(*) AS n_rows, 3::BIGINT AS columns_used,
  round((count(ts) + count(event_type) + count(value)) / (count(*) * 3) * 100, 1) AS completeness_pct,
  strftime(min(ts), '%Y-%m-%d') AS date_from, strftime(max(ts), '%Y-%m-%d') AS date_to FROM ev""")
def data_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(overview.data_profile(events(spark, folder)))


_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]]


@query("correlation_pairs", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + """)
SELECT x, y, round(r, 2) + 0.0 AS r, abs(r) = max(abs(r)) OVER () AS strongest FROM c""")
def correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(overview.correlation_pairs(lineitem(spark, folder)))


@query("regression_line", """
WITH f AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r, regr_slope(l_extendedprice, l_quantity) AS a,
  regr_intercept(l_extendedprice, l_quantity) AS b, min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem)
SELECT n, round(r, 3) AS r, x_min, round(a * x_min + b, 2) AS y_at_min, x_max, round(a * x_max + b, 2) AS y_at_max FROM f""")
def regression_line(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(overview.regression(lineitem(spark, folder), "l_quantity", "l_extendedprice"), r=3)


@query("scatter_sample", """
WITH r AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS k, count(*) OVER () AS n FROM events
  WHERE value IS NOT NULL AND event_type <> 'error'),
i AS (SELECT DISTINCT floor(g.i * (n::DOUBLE / 400))::BIGINT AS k FROM range(400) AS g(i), (SELECT max(n) AS n FROM r))
SELECT event_id, value AS x, value AS y FROM r JOIN i USING (k)""")
def scatter_sample(spark: SparkSession, folder: str) -> DataFrame:
    return overview.scatter_sample(events(spark, folder), "value", "value", "event_id")


@query("moving_average", f"""WITH {_MONTHLY}
SELECT measure, strftime(k, '%Y-%m-%d') AS period_key, round(v, 2) AS value, CASE WHEN count(*) OVER w = 3
  THEN round(avg(v) OVER w, 2) END AS moving_avg FROM m
WINDOW w AS (PARTITION BY measure ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def moving_average(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.moving_average(overview.monthly_series(lineitem(spark, folder))))


@query("growth_rates", f"""WITH {_MONTHLY},
r AS (SELECT measure, v, lag(v) OVER w AS m1, lag(v, 12) OVER w AS m12, sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS q,
  sum(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS q0,
  row_number() OVER (PARTITION BY measure ORDER BY k DESC) AS age FROM m WINDOW w AS (PARTITION BY measure ORDER BY k))
SELECT measure, round((v - m1) / abs(m1) * 100, 1) AS mom, round((q - q0) / abs(q0) * 100, 1) AS qoq,
  round((v - m12) / abs(m12) * 100, 1) AS yoy FROM r WHERE age = 1""")
def growth_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.growth(overview.monthly_series(lineitem(spark, folder))))


@query("pareto", f"""WITH {SALES},
g AS (SELECT n_name AS member, sum(o_totalprice) AS v FROM s GROUP BY 1),
r AS (SELECT member, row_number() OVER (ORDER BY v DESC, member) AS rank, round(v / sum(v) OVER () * 100, 1) AS share_pct FROM g),
c AS (SELECT *, sum(share_pct) OVER (ORDER BY rank) AS cum FROM r WHERE rank <= 20)
SELECT 'n_name' AS dimension, rank, member, share_pct, round(cum, 1) AS cumulative_pct,
  min(CASE WHEN round(cum, 6) >= 80 THEN rank END) OVER () AS n_for_80, count(*) OVER () AS total_categories FROM c""")
def pareto(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(series.pareto(overview.breakdown_shares(sales(spark, folder)).where("dimension = 'n_name'")))


@query("anomalies", f"""WITH {ORDERS},
m AS (SELECT o_orderstatus AS measure, date_trunc('month', o_orderdate)::DATE AS k, sum(o_totalprice) AS v FROM o GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY k) - 1 AS t FROM m),
f AS (SELECT measure, regr_slope(v, t) AS a, regr_intercept(v, t) AS b, avg(abs(v)) + 1 AS size, count(*) AS n FROM t GROUP BY 1),
x AS (SELECT t.*, b + a * t AS line, v - (b + a * t) AS res, size, n FROM t JOIN f USING (measure)),
y AS (SELECT *, stddev_samp(res) OVER (PARTITION BY measure) AS spread FROM x)
SELECT measure, strftime(k, '%Y-%m-%d') AS period_key, round(v, 2) AS value, round(line, 2) AS expected,
  round(res / spread, 4) AS deviation, CASE WHEN res > 0 THEN 'spike' ELSE 'dip' END AS direction,
  CASE WHEN abs(res / spread) >= 3.5 THEN 'critical' ELSE 'warning' END AS severity
FROM y WHERE n >= 5 AND spread > 1e-6 * size AND abs(res / spread) >= 2.5""")
def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """One series per order status; the cut-off last month stands out."""
    ds = orders(spark, folder)
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period_key")
    by_status = ds.frame.groupBy(F.col("o_orderstatus").alias("measure"), month).agg(
        F.sum("o_totalprice").alias("value"))
    return rounded(series.anomalies(by_status), deviation=4)


@query("gap_filled_series", """
WITH d AS (SELECT user_id::VARCHAR AS measure, date_trunc('day', ts)::DATE AS k, sum(value) AS v FROM events GROUP BY 1, 2),
s AS (SELECT measure, unnest(generate_series(min(k), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS k
  FROM d GROUP BY 1)
SELECT measure, strftime(k, '%Y-%m-%d') AS period_key, round(coalesce(v, 0), 2) AS value FROM s LEFT JOIN d USING (measure, k)""")
def gap_filled_series(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's days; the days without an event are zeros."""
    ds = events(spark, folder)
    raw = table(spark, folder, "events")
    daily = raw.groupBy(F.col("user_id").cast("string").alias("measure"), F.col("ts").cast("date").alias("period_key")).agg(
        F.sum("value").alias("value"))
    return rounded(slices.with_spine(daily, "day", F.lit(ds.data_end()), ["measure"]))
