"""Slices: value, spread, trend, comparison, parts and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import numbers, periods
from tallyspark.model import ColumnMeta, Dataset
from tallyspark.operators import slices
from tallyspark.plans.catalog.registry import EVENTS, ORDERS, events, lineitem, orders, query, rounded, table

_CUT = "o_orderstatus = 'O' AND o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1999-02-16'"


def _cut(spark: SparkSession, folder: str) -> Dataset:
    return orders(spark, folder).slice({"o_orderstatus": "O"}, "1997-03", "1999-02-15")


@query("slice_value", f"SELECT round(sum(o_totalprice), 2) AS value, count(*) AS n_rows FROM orders WHERE {_CUT}")
def slice_value(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.slice_value(_cut(spark, folder)))


@query("slice_aggregations", f"""
SELECT 'sum' AS agg, round(sum(o_totalprice), 2) AS value, count(*) AS n_rows FROM orders WHERE {_CUT}
UNION ALL SELECT 'avg', round(avg(o_totalprice), 2), count(*) FROM orders WHERE {_CUT}
UNION ALL SELECT 'count', count(*)::DOUBLE, count(*) FROM orders WHERE {_CUT}
UNION ALL SELECT 'min', min(o_totalprice), count(*) FROM orders WHERE {_CUT}
UNION ALL SELECT 'max', max(o_totalprice), count(*) FROM orders WHERE {_CUT}
UNION ALL SELECT 'median', round(median(o_totalprice), 2), count(*) FROM orders WHERE {_CUT}""")
def slice_aggregations(spark: SparkSession, folder: str) -> DataFrame:
    cut, out = _cut(spark, folder), None
    for agg in ("sum", "avg", "count", "min", "max", "median"):
        row = slices.slice_value(cut, agg=agg).select(F.lit(agg).alias("agg"), "value", "n_rows")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("slice_filter_uncastable", "SELECT 0.0 AS value, 0::BIGINT AS n_rows FROM orders HAVING count(*) >= 0")
def slice_filter_uncastable(spark: SparkSession, folder: str) -> DataFrame:
    """A filter value that is no number matches no row of a numeric column."""
    return slices.slice_value(orders(spark, folder).slice({"o_custkey": "not a number"}), agg="count")


@query("slice_stats", f"""WITH {EVENTS}
SELECT count(*) AS row_count, count(value) AS rows_with_value, count(*) - count(value) AS skipped, min(value) AS "min",
  round(avg(value), 4) AS avg, max(value) AS "max", round(stddev_samp(value), 4) AS std,
  round(median(value), 4) AS median FROM ev""")
def slice_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.slice_stats(events(spark, folder)), 4)


def _trend_sql(source: str, date: str, value: str, grain: str, digits: int = 2) -> str:
    k = f"date_trunc('{grain}', {date})"
    day = f"strftime({k}, '%Y-%m-%d')"
    month = f"strftime({k}, '%Y-%m')"
    label = {"day": day, "week": day, "month": month, "year": f"strftime({k}, '%Y')",
             "quarter": f"strftime({k}, '%Y') || '-Q' || quarter({k})"}[grain]
    start = day if grain in ("day", "week") else month
    stop = {"day": day, "week": f"strftime({k} + INTERVAL 6 DAY, '%Y-%m-%d')", "month": month,
            "quarter": f"strftime({k} + INTERVAL 2 MONTH, '%Y-%m')", "year": f"strftime({k}, '%Y') || '-12'"}[grain]
    return f"""SELECT strftime({k}, '%Y-%m-%d') AS period_key, {label} AS period, round({value}, {digits}) AS value,
  count(*) AS n_rows, {start} AS "from", {stop} AS "to" FROM {source}
GROUP BY {k} ORDER BY {k} DESC LIMIT 400"""


for _grain in periods.GRAINS:
    @query(f"grain_trend_{_grain}", _trend_sql("orders", "o_orderdate", "sum(o_totalprice)", _grain))
    def _trend(spark: SparkSession, folder: str, grain: str = _grain) -> DataFrame:
        return rounded(slices.trend(orders(spark, folder), grain=grain))


@query("trend_median_quarter", _trend_sql("lineitem", "l_shipdate", "median(l_extendedprice)", "quarter", 4))
def trend_median_quarter(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.trend(lineitem(spark, folder), "l_extendedprice", "median", "quarter"), 4)


def _compare_sql(source: str, date: str, value: str, grain: str, back: str) -> str:
    label = "strftime(k, '%Y-%m')" if grain == "month" else "strftime(k, '%Y-%m-%d')"
    return f"""WITH {EVENTS},
t AS (SELECT date_trunc('{grain}', {date})::DATE AS k, sum({value}) AS v FROM {source} GROUP BY 1),
r AS (SELECT k, v, {label} AS period, lag({label}) OVER (ORDER BY k) AS pp, lag(v) OVER (ORDER BY k) AS pv,
  row_number() OVER (ORDER BY k DESC) AS age FROM t)
SELECT r.period, round(r.v, 2) AS value, r.pp AS previous_period, round(r.pv, 2) AS previous_value,
  round(r.v - r.pv, 2) AS previous_delta, round((r.v - r.pv) / nullif(abs(r.pv), 0) * 100, 4) AS previous_pct,
  y.period AS year_ago_period, round(y.v, 2) AS year_ago_value, round(r.v - y.v, 2) AS year_ago_delta,
  round((r.v - y.v) / nullif(abs(y.v), 0) * 100, 4) AS year_ago_pct
FROM r LEFT JOIN r y ON y.k = (r.k - {back})::DATE WHERE r.age = 1"""


@query("period_compare_month", _compare_sql("orders", "o_orderdate", "o_totalprice", "month", "INTERVAL 1 YEAR"))
def period_compare_month(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.compare_latest(orders(spark, folder)), previous_pct=4, year_ago_pct=4)


@query("period_compare_week", _compare_sql("ev", "ts", "value", "week", "INTERVAL 364 DAY"))
def period_compare_week(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.compare_latest(events(spark, folder), grain="week"), previous_pct=4, year_ago_pct=4)


@query("latest_period_partial", """
SELECT strftime(max(o_orderdate) FILTER (o_orderstatus = 'F'), '%Y-%m') AS period,
  strftime(max(o_orderdate), '%Y-%m-%d') AS data_through,
  max(o_orderdate)::DATE < last_day((max(o_orderdate) FILTER (o_orderstatus = 'F'))::DATE) AS partial FROM orders""")
def latest_period_partial(spark: SparkSession, folder: str) -> DataFrame:
    return slices.latest_period(orders(spark, folder).slice({"o_orderstatus": "F"}))


def _parts_sql(agg: str, share: str, limit: int) -> str:
    """Contributors in SQL: groups per dimension, ranked, the tail re-aggregated from rows."""
    value = {"sum": "sum(o_totalprice)", "avg": "avg(o_totalprice)", "median": "median(o_totalprice)",
             "min": "min(o_totalprice)"}[agg]
    return f"""WITH {ORDERS},
u AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS member, o_totalprice FROM o
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice FROM o),
g AS (SELECT dimension, member, {value} AS value, row_number() OVER (PARTITION BY dimension
  ORDER BY {value} DESC NULLS LAST, member) AS k FROM u WHERE member IS NOT NULL GROUP BY dimension, member),
x AS (SELECT u.dimension, CASE WHEN k <= {limit} THEN k END AS rank, CASE WHEN k <= {limit} THEN u.member END AS member,
  u.member AS original, o_totalprice FROM u JOIN g USING (dimension, member))
SELECT dimension, rank, member, round({value}, 4) AS value, count(*) AS n_rows,
  CASE WHEN rank IS NULL THEN count(DISTINCT original) ELSE 0 END AS folded, {share} AS share_pct
FROM x GROUP BY dimension, rank, member"""


_SHARE = "round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM o) * 100, 1)"


@query("contributors", _parts_sql("sum", _SHARE, 2))
def contributors(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.contributors(orders(spark, folder), agg="sum", limit=2), 4)


@query("contributors_avg", _parts_sql("avg", "NULL::DOUBLE", 2))
def contributors_avg(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.contributors(orders(spark, folder), agg="avg", limit=2), 4)


@query("contributors_min", _parts_sql("min", "NULL::DOUBLE", 1))
def contributors_min(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.contributors(orders(spark, folder), agg="min", limit=1), 4)


@query("contributors_median", _parts_sql("median", "NULL::DOUBLE", 2))
def contributors_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.contributors(orders(spark, folder), agg="median", limit=2), 4)


def _breakdown_sql(value: str, share: str, limit: int) -> str:
    return f"""WITH g AS (SELECT o_custkey, {value} AS value,
  row_number() OVER (ORDER BY {value} DESC NULLS LAST, o_custkey::VARCHAR) AS k FROM orders GROUP BY o_custkey)
SELECT 'o_custkey' AS dimension, CASE WHEN k <= {limit} THEN k END AS rank,
  CASE WHEN k <= {limit} THEN o_custkey::VARCHAR END AS member, round({value}, 4) AS value, count(*) AS n_rows,
  CASE WHEN min(k) > {limit} THEN count(DISTINCT o_custkey) ELSE 0 END AS folded, {share} AS share_pct
FROM orders JOIN g USING (o_custkey) GROUP BY 2, 3"""


@query("breakdown_with_other", _breakdown_sql(
    "sum(o_totalprice)", "round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) * 100, 1)", 50))
def breakdown_with_other(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.breakdown(orders(spark, folder), "o_custkey"), 4)


@query("breakdown_median_other", _breakdown_sql("median(o_totalprice)", "NULL::DOUBLE", 20))
def breakdown_median_other(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(slices.breakdown(orders(spark, folder), "o_custkey", agg="median", limit=20), 4)


@query("records_page", f"""WITH {ORDERS}
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  o_orderpriority FROM o WHERE o_orderstatus = 'P' ORDER BY o.o_orderdate DESC NULLS LAST, o_orderkey
LIMIT 50 OFFSET 100""")
def records_page(spark: SparkSession, folder: str) -> DataFrame:
    page = slices.records(orders(spark, folder).slice({"o_orderstatus": "P"}), page=3, page_size=50)
    return page.withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))


@query("records_page_deep", f"""WITH {ORDERS}
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM o ORDER BY o.o_orderpriority, o_orderkey LIMIT 50 OFFSET 12450""")
def records_page_deep(spark: SparkSession, folder: str) -> DataFrame:
    """Page 250 by a column of five values: found by counting, not by sorting what comes before."""
    page = slices.records(orders(spark, folder), sort="o_orderpriority", desc=False, page=250, page_size=50)
    return page.withColumn("o_orderdate", F.col("o_orderdate").cast("date").cast("string"))


@query("record_count", f"SELECT count(*) AS total FROM orders WHERE {_CUT}")
def record_count(spark: SparkSession, folder: str) -> DataFrame:
    return slices.record_count(_cut(spark, folder))


@query("tolerant_dates", """
WITH t AS (SELECT l_returnflag, l_quantity, CASE l_returnflag WHEN 'A' THEN strftime(l_shipdate, '%Y-%m-%d')
  WHEN 'N' THEN strftime(l_shipdate, '%Y-%m') ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS day FROM lineitem),
c AS (SELECT l_quantity, TRY_CAST(day AS TIMESTAMP) AS ts FROM t)
SELECT strftime(date_trunc('year', ts), '%Y') AS period, round(sum(l_quantity), 2) AS value, count(*) AS n_rows
FROM c WHERE ts IS NOT NULL GROUP BY 1""")
def tolerant_dates(spark: SparkSession, folder: str) -> DataFrame:
    """A text date column: what does not read as a full date drops out of period work."""
    kind, day = F.col("l_returnflag"), F.col("l_shipdate")
    df = table(spark, folder, "lineitem").select("l_quantity", F.when(kind == "A", F.date_format(day, "yyyy-MM-dd"))
                                                 .when(kind == "N", F.date_format(day, "yyyy-MM"))
                                                 .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss")).alias("day"))
    ds = Dataset.open(df, [ColumnMeta("day", "date"), ColumnMeta("l_quantity", "measure", "count")])
    return rounded(slices.trend(ds, grain="year").select("period", "value", "n_rows"))


@query("relative_presets", """WITH e AS (SELECT max(o_orderdate)::DATE AS d FROM orders),
r AS (SELECT 'MTD' AS preset, date_trunc('month', d)::DATE AS lo FROM e
  UNION ALL SELECT 'QTD', date_trunc('quarter', d)::DATE FROM e UNION ALL SELECT 'YTD', date_trunc('year', d)::DATE FROM e
  UNION ALL SELECT '3M', (date_trunc('month', d) - INTERVAL 2 MONTH)::DATE FROM e
  UNION ALL SELECT '6M', (date_trunc('month', d) - INTERVAL 5 MONTH)::DATE FROM e
  UNION ALL SELECT '12M', (date_trunc('month', d) - INTERVAL 11 MONTH)::DATE FROM e)
SELECT preset, strftime(lo, '%Y-%m-%d') AS date_from, round(sum(o_totalprice), 2) AS value, count(*) AS n_rows
FROM r JOIN orders ON o_orderdate >= lo GROUP BY 1, 2""")
def relative_presets(spark: SparkSession, folder: str) -> DataFrame:
    ds, out = orders(spark, folder), None
    for preset in periods.PRESETS:
        start = periods.preset_start(ds.data_end(), preset)
        row = slices.slice_value(ds.slice(date_from=start.isoformat())).select(
            F.lit(preset).alias("preset"), F.lit(start.isoformat()).alias("date_from"), "value", "n_rows")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("slice_description", f"""SELECT 'Sum of o totalprice across ' || format('{{:,}}', count(*)) ||
  ' rows where o orderstatus = O and o orderdate from 1997-03 to 1999-02-15.' AS explanation FROM orders WHERE {_CUT}""")
def slice_description(spark: SparkSession, folder: str) -> DataFrame:
    return slices.describe(_cut(spark, folder))


@query("year_ago_periods", """SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day,
  strftime(o_orderdate - INTERVAL 1 YEAR, '%Y-%m-%d') AS day_ago,
  strftime(date_trunc('week', o_orderdate) - INTERVAL 364 DAY, '%Y-%m-%d') AS week_ago,
  strftime(date_trunc('quarter', o_orderdate) - INTERVAL 1 YEAR, '%Y-%m-%d') AS quarter_ago FROM orders""")
def year_ago_periods(spark: SparkSession, folder: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, folder, "orders").select(
        day.cast("string").alias("day"), periods.year_ago(day, "day").cast("string").alias("day_ago"),
        periods.year_ago(periods.key(day, "week"), "week").cast("string").alias("week_ago"),
        periods.year_ago(periods.key(day, "quarter"), "quarter").cast("string").alias("quarter_ago")).distinct()


@query("value_format", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 1e5 THEN '₹' || format('{:.2f}', round(o_totalprice / 1e5, 2)) || ' L'
  ELSE '₹' || format('{:,}', round(o_totalprice, 0)::BIGINT) END AS money,
  format('{:.1f}', round(o_totalprice / 1e6 * 100, 1)) || '%' AS percent,
  CASE WHEN o_totalprice >= 1e5 OR o_totalprice = floor(o_totalprice) THEN format('{:,}', round(o_totalprice, 0)::BIGINT)
  ELSE format('{:,}', floor(o_totalprice)::BIGINT) || right(format('{:.2f}', o_totalprice), 3) END AS plain
FROM orders""")
def value_format(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey", numbers.display(v, "currency").alias("money"), numbers.display(v / 1e6, "percentage").alias(
            "percent"), numbers.display(v, "count").alias("plain"))
