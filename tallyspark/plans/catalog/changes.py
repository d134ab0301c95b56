"""Change between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.operators import change, metrics
from tallyspark.plans import reports
from tallyspark.plans.catalog.registry import (EVENTS, ORDERS, SALES, events, lineitem, orders, periods_sql, query,
                                               rounded, sales)

_O = periods_sql("orders", "o_orderdate")
_L = periods_sql("lineitem", "l_shipdate")


def _in(side: str, date: str) -> str:
    return f"({date} >= {side}0 AND {date} < {side}1 + 1)"


def _sums(date: str, value: str) -> str:
    return (f"coalesce(sum(CASE WHEN {_in('a', date)} THEN {value} ELSE 0 END), 0) AS a, "
            f"coalesce(sum(CASE WHEN {_in('b', date)} THEN {value} ELSE 0 END), 0) AS b")


# the first quarter of 2001 against the quarter before
_Q = """p AS (SELECT DATE '2000-10-01' AS a0, DATE '2000-12-31' AS a1, DATE '2001-01-01' AS b0, DATE '2001-03-31' AS b1)"""


def _quarter(ds):
    return ds.slice(date_from="2001-01", date_to="2001-03")


@query("comparison_periods", f"""WITH {_O}
SELECT strftime(a0, '%Y-%m-%d') AS a_from, strftime(a1, '%Y-%m-%d') AS a_to, strftime(b0, '%Y-%m-%d') AS b_from,
  strftime(b1, '%Y-%m-%d') AS b_to, d < b9 AS like_for_like, true AS aligned, strftime(d, '%Y-%m-%d') AS data_end FROM p""")
def comparison_periods(spark: SparkSession, folder: str) -> DataFrame:
    return change.comparison_frame(orders(spark, folder)).drop("a_label", "b_label")


@query("period_totals", f"""WITH {_O}, t AS (SELECT {_sums('o_orderdate', 'o_totalprice')} FROM orders, p)
SELECT round(a, 2) AS a, round(b, 2) AS b, round(b - a, 2) AS delta, round((b - a) / nullif(abs(a), 0) * 100, 4) AS pct FROM t""")
def period_totals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.period_totals(orders(spark, folder)).select("a", "b", "delta", "pct"), pct=4)


@query("period_totals_year_ago", f"""WITH {EVENTS}, e AS (SELECT max(ts)::DATE AS d FROM events),
p AS (SELECT d - INTERVAL 1 YEAR AS a0, d AS b0 FROM e)
SELECT 0.0 + coalesce(sum(CASE WHEN ts::DATE = a0::DATE THEN 1 END), 0) AS a,
  coalesce(sum(CASE WHEN ts::DATE = b0 THEN 1 END), 0)::DOUBLE AS b, NULL::DOUBLE AS pct FROM ev, p""")
def period_totals_year_ago(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the last day against a day a year before that has none: no percentage."""
    return rounded(change.period_totals(events(spark, folder), None, "count", "day", "year_ago").select("a", "b", "pct"))


def _members_sql(date: str, value: str, dims: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS member, {date} AS ts, {value} AS v FROM src"
                               for d in dims.split())
    return f"""u AS ({parts}),
g AS (SELECT dimension, member, {_sums('ts', 'v')} FROM u, p WHERE {_in('a', 'ts')} OR {_in('b', 'ts')} GROUP BY 1, 2)"""


_SRC = f"{ORDERS}, src AS (SELECT * FROM o), {_Q}, " + _members_sql(
    "o_orderdate", "o_totalprice", "o_orderstatus o_orderpriority")
_GEO = f"{SALES}, src AS (SELECT * FROM s), {_Q}, " + _members_sql(
    "o_orderdate", "o_totalprice", "r_name c_mktsegment n_name o_orderstatus")


@query("member_changes", f"WITH {_SRC} SELECT dimension, member, round(a, 2) AS a, round(b, 2) AS b FROM g")
def member_changes(spark: SparkSession, folder: str) -> DataFrame:
    ds = _quarter(orders(spark, folder))
    return rounded(change.member_changes(ds, ds.free_dimensions))


def _steps_sql(limit: int, where: str = "true") -> str:
    return f"""r AS (SELECT *, b - a AS delta, row_number() OVER (PARTITION BY dimension
  ORDER BY abs(b - a) DESC, member NULLS LAST) AS k FROM g WHERE {where}),
f AS (SELECT dimension, CASE WHEN k <= {limit} THEN member END AS member, CASE WHEN k <= {limit} THEN k END AS k,
  sum(a) AS a, sum(b) AS b, sum(delta) AS delta, CASE WHEN min(k) > {limit} THEN count(*) ELSE 0 END AS folded
  FROM r GROUP BY 1, 2, 3),
w AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY k IS NULL, delta DESC, member NULLS LAST) AS step,
  delta / nullif(sum(delta) OVER (PARTITION BY dimension), 0) AS share, sum(a) OVER (PARTITION BY dimension) AS total_a
  FROM f)"""


_STEP_COLUMNS = """dimension, step, member, member IS NULL AND k IS NOT NULL AS blank, k IS NULL AS is_other, folded,
  round(a, 2) AS a, round(b, 2) AS b, round(delta, 2) AS delta, round(share, 6) AS share_of_change"""


@query("variance_waterfall", f"WITH {_GEO}, {_steps_sql(8)} SELECT {_STEP_COLUMNS} FROM w")
def variance_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.waterfall_all(_quarter(sales(spark, folder))), share_of_change=6)


@query("variance_blank_member", f"""WITH {_SRC}, {_steps_sql(2, "dimension = 'o_orderpriority'")} SELECT {_STEP_COLUMNS} FROM w""")
def variance_blank_member(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.waterfall(_quarter(orders(spark, folder)), dimension="o_orderpriority", limit=2),
                   share_of_change=6)


_RANKING = """k AS (SELECT dimension, count(*) AS members, CASE WHEN sum((b <> a)::INT) >= 2
  THEN max(abs(b - a)) / sum(abs(b - a)) ELSE 0 END AS score, max_by(member, abs(b - a)) AS top,
  max_by(b - a, abs(b - a)) AS top_delta FROM g GROUP BY 1)"""


@query("variance_ranking", f"""WITH {_GEO}, {_RANKING}
SELECT dimension, members, round(score, 6) AS score, top, round(top_delta, 2) AS top_delta FROM k""")
def variance_ranking(spark: SparkSession, folder: str) -> DataFrame:
    ds = _quarter(sales(spark, folder))
    return rounded(change.split_ranking(change.member_changes(ds, ds.free_dimensions)), score=6)


@query("variance_auto", f"""WITH {_GEO}, {_RANKING},
best AS (SELECT dimension FROM k ORDER BY score DESC, list_position(['r_name', 'c_mktsegment', 'n_name', 'o_orderstatus'], dimension) LIMIT 1),
{_steps_sql(8, "dimension = (SELECT dimension FROM best)")} SELECT {_STEP_COLUMNS} FROM w""")
def variance_auto(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.waterfall(_quarter(sales(spark, folder))), share_of_change=6)


@query("waterfall_bars", f"""WITH {_GEO}, {_steps_sql(8)},
x AS (SELECT *, total_a + sum(delta) OVER (PARTITION BY dimension ORDER BY step) AS run FROM w)
SELECT dimension, step, member, k IS NULL AS is_other, CASE WHEN delta >= 0 THEN 'up' ELSE 'down' END AS kind,
  round(least(run, run - delta), 2) AS base, round(abs(delta), 2) AS bar, round(run, 2) AS running FROM x""")
def waterfall_bars(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.waterfall_bars(change.waterfall_all(_quarter(sales(spark, folder)))))


@query("significance", f"""WITH {_O},
m AS (SELECT date_trunc('month', o_orderdate)::DATE AS k, sum(o_totalprice) AS v FROM orders, p
  WHERE o_orderdate::DATE <= b1 AND date_diff('day', date_trunc('month', o_orderdate), o_orderdate)
    < CASE WHEN d < b9 THEN (b1 - b0) + 1 ELSE 400 END GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(k) FROM m), (SELECT b0 FROM p), INTERVAL 1 MONTH))::DATE AS k),
f AS (SELECT k, coalesce(v, 0) AS v FROM s LEFT JOIN m USING (k)),
c AS (SELECT k, v - lag(v) OVER (ORDER BY k) AS delta FROM f),
h AS (SELECT max(delta) FILTER (k = b0) AS latest, avg(delta) FILTER (k < b0) AS mean_change,
  stddev_samp(delta) FILTER (k < b0) AS typical_change, count(delta) FILTER (k < b0) AS history,
  max(CASE WHEN d < b9 THEN (b1 - b0) + 1 END) AS window_days FROM c, p)
SELECT CASE WHEN abs((latest - mean_change) / typical_change) >= 2.5 THEN 'unusual'
  WHEN abs((latest - mean_change) / typical_change) >= 1.5 THEN 'notable' ELSE 'normal' END AS level,
  round((latest - mean_change) / typical_change, 6) AS z, round(latest, 2) AS latest, round(mean_change, 4) AS mean_change,
  round(typical_change, 4) AS typical_change, history, window_days FROM h WHERE history >= 5 AND typical_change > 0""")
def significance(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.significance(orders(spark, folder)), z=6, mean_change=4, typical_change=4)


_PVM = f"""{_Q},
g AS (SELECT l_returnflag AS member, sum(CASE WHEN {_in('a', 'l_shipdate')} THEN l_extendedprice ELSE 0 END) AS ra,
  sum(CASE WHEN {_in('b', 'l_shipdate')} THEN l_extendedprice ELSE 0 END) AS rb,
  sum(CASE WHEN {_in('a', 'l_shipdate')} THEN l_quantity ELSE 0 END) AS qa,
  sum(CASE WHEN {_in('b', 'l_shipdate')} THEN l_quantity ELSE 0 END) AS qb
  FROM lineitem, p WHERE {_in('a', 'l_shipdate')} OR {_in('b', 'l_shipdate')} GROUP BY 1),
t AS (SELECT *, sum(qa) OVER () AS ta, sum(qb) OVER () AS tb, ra / nullif(qa, 0) AS price_a, rb / nullif(qb, 0) AS price_b FROM g),
x AS (SELECT *, coalesce(price_a, price_b, 0) AS old, coalesce(price_b, price_a, 0) AS new FROM t),
y AS (SELECT *, (tb - ta) * (qa / ta) * old AS volume_effect, tb * (qb / tb - qa / ta) * old AS mix_effect,
  qb * (new - old) AS price_effect FROM x)"""


@query("pvm_members", f"""WITH {_PVM} SELECT member, round(ra, 2) AS ra, round(rb, 2) AS rb, qa, qb, round(price_a, 4) AS price_a,
  round(price_b, 4) AS price_b, round(rb - ra, 2) AS delta, round(volume_effect, 2) AS volume_effect,
  round(mix_effect, 2) AS mix_effect, round(price_effect, 2) AS price_effect FROM y""")
def pvm_members(spark: SparkSession, folder: str) -> DataFrame:
    ds = _quarter(lineitem(spark, folder))
    return rounded(change.price_volume_mix(ds, "l_extendedprice", dimension="l_returnflag"), price_a=4, price_b=4)


@query("pvm_total", f"""WITH {_PVM},
z AS (SELECT sum(ra) AS ra, sum(rb) AS rb, sum(qa) AS qa, sum(qb) AS qb, sum(mix_effect) AS mix_effect,
  sum(price_effect) AS price_effect FROM y),
v AS (SELECT *, (qb - qa) * ra / qa AS volume_effect, rb - ra AS delta FROM z)
SELECT round(ra, 2) AS value_a, round(rb, 2) AS value_b, qa AS volume_a, qb AS volume_b, round(ra / qa, 4) AS avg_price_a,
  round(rb / qb, 4) AS avg_price_b, round(delta, 2) AS delta, round(volume_effect, 2) AS volume_effect,
  round(mix_effect, 2) AS mix_effect, round(price_effect, 2) AS price_effect,
  CASE WHEN abs(delta - volume_effect - mix_effect - price_effect) < 1e-6 * greatest(1, abs(delta)) THEN 0.0
  ELSE round(delta - volume_effect - mix_effect - price_effect, 2) END AS unexplained FROM v""")
def pvm_total(spark: SparkSession, folder: str) -> DataFrame:
    ds = _quarter(lineitem(spark, folder))
    parts = change.price_volume_mix(ds, "l_extendedprice", dimension="l_returnflag")
    return rounded(change.price_volume_mix_total(parts), avg_price_a=4, avg_price_b=4)


@query("drivers", f"""WITH {ORDERS},
l AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders ORDER BY 1 DESC LIMIT 2),
b AS (SELECT min(m) AS m0, max(m) AS m1 FROM l),
u AS (SELECT 'o_orderstatus' AS dimension, o_orderstatus AS member, date_trunc('month', o_orderdate)::DATE AS m, o_totalprice AS v FROM o
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, date_trunc('month', o_orderdate)::DATE, o_totalprice FROM o),
t AS (SELECT sum(CASE WHEN date_trunc('month', o_orderdate) = m1 THEN o_totalprice ELSE 0 END)
  - sum(CASE WHEN date_trunc('month', o_orderdate) = m0 THEN o_totalprice ELSE 0 END) AS total FROM o, b),
g AS (SELECT dimension, member, sum(CASE WHEN m = m0 THEN v ELSE 0 END) AS previous, sum(CASE WHEN m = m1 THEN v ELSE 0 END) AS current
  FROM u, b WHERE m IN (m0, m1) AND member IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, current - previous AS delta, row_number() OVER (PARTITION BY dimension ORDER BY abs(current - previous) DESC, member) AS k,
  max(abs(current - previous)) OVER (PARTITION BY dimension) AS widest FROM g)
SELECT dimension, row_number() OVER (PARTITION BY dimension ORDER BY delta DESC, member) AS position, member,
  round(previous, 2) AS previous, round(current, 2) AS current, round(delta, 2) AS delta, round(delta / total, 6) AS share,
  round(widest / abs(total), 6) AS concentration FROM r, t WHERE k <= 3""")
def drivers(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.drivers(orders(spark, folder), limit=3), share=6, concentration=6)


@query("metric_tree", f"""WITH {_Q},
t AS (SELECT sum(CASE WHEN {_in('a', 'l_shipdate')} THEN l_extendedprice END) AS na, sum(CASE WHEN {_in('b', 'l_shipdate')} THEN l_extendedprice END) AS nb,
  sum(CASE WHEN {_in('a', 'l_shipdate')} THEN l_quantity END) AS da, sum(CASE WHEN {_in('b', 'l_shipdate')} THEN l_quantity END) AS db FROM lineitem, p)
SELECT round(na, 2) AS na, round(nb, 2) AS nb, da, db, round(na / da, 4) AS a, round(nb / db, 4) AS b,
  round((nb - na) / da + nb / db - nb / da, 4) AS delta, round((nb - na) / da, 4) AS numerator_effect,
  round(nb / db - nb / da, 4) AS denominator_effect,
  CASE WHEN abs((nb - na) / da) >= abs(nb / db - nb / da) THEN 'numerator' ELSE 'denominator' END AS lead FROM t""")
def metric_tree(spark: SparkSession, folder: str) -> DataFrame:
    price = metrics.Metric("price", metrics.Part("sum", "l_extendedprice"), metrics.Part("sum", "l_quantity"))
    return rounded(metrics.metric_tree(_quarter(lineitem(spark, folder)), price), a=4, b=4, delta=4, numerator_effect=4,
                   denominator_effect=4)


_SIDES = " UNION ALL ".join(f"""SELECT '{m}' AS measure, sum({m}) FILTER ({{a}}) AS a, sum({m}) FILTER ({{b}}) AS b FROM lineitem"""
                            for m in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
_OUT = "SELECT measure, round(a, 2) AS a, round(b, 2) AS b, round((a - b) / abs(b) * 100, 1) AS delta_pct FROM t"


@query("compare_segments", f"WITH t AS ({_SIDES.format(a="l_returnflag = 'A'", b="l_returnflag = 'R'")}) {_OUT}")
def compare_segments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.compare_segments(lineitem(spark, folder), "l_returnflag", "A", "R"))


@query("compare_periods", f"WITH t AS ({_SIDES.format(a="year(l_shipdate) = 1999", b="year(l_shipdate) = 1998")}) {_OUT}")
def compare_periods(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.compare_periods(lineitem(spark, folder), ("1999-01", "1999-12"), ("1998-01", "1998-12")))


@query("segment_overlay", """SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m') AS period,
  round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS a, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS b
FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1""")
def segment_overlay(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(change.overlay(lineitem(spark, folder), "l_returnflag", "A", "N"))


@query("decomposition_tree", f"""WITH {ORDERS}, src AS (SELECT * FROM o), {_Q}, {_members_sql(
    "o_orderdate", "o_totalprice", "o_orderstatus o_orderpriority")}, {_RANKING},
best AS (SELECT dimension, top FROM k ORDER BY score DESC, dimension = 'o_orderpriority' LIMIT 1),
g2 AS (SELECT CASE WHEN best.dimension = 'o_orderstatus' THEN 'o_orderpriority' ELSE 'o_orderstatus' END AS dimension,
  CASE WHEN best.dimension = 'o_orderstatus' THEN o_orderpriority ELSE o_orderstatus END AS member,
  {_sums('o_orderdate', 'o_totalprice')} FROM o, p, best
  WHERE CASE WHEN best.dimension = 'o_orderstatus' THEN o_orderstatus ELSE o_orderpriority END IS NOT DISTINCT FROM best.top
    AND ({_in('a', 'o_orderdate')} OR {_in('b', 'o_orderdate')}) GROUP BY 1, 2)
SELECT 1::BIGINT AS level, g.dimension, member, round(a, 2) AS a, round(b, 2) AS b, round(b - a, 2) AS delta FROM g
  WHERE g.dimension = (SELECT dimension FROM best)
UNION ALL SELECT 2, dimension, member, round(a, 2), round(b, 2), round(b - a, 2) FROM g2""")
def decomposition_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = change.decomposition_tree(_quarter(orders(spark, folder)), depth=2)
    return rounded(tree.select("level", "dimension", "member", "a", "b", "delta"))


def _money(v: str) -> str:
    return (f"CASE WHEN {v} >= 1e7 THEN '₹' || format('{{:.2f}}', {v} / 1e7) || ' Cr' WHEN {v} >= 1e5 THEN '₹' || "
            f"format('{{:.2f}}', {v} / 1e5) || ' L' ELSE '₹' || format('{{:,.0f}}', {v}) END")


def _signed(v: str) -> str:
    return f"(CASE WHEN {v} > 0 THEN '+' ELSE '−' END || {_money(f'abs({v})')})"


@query("change_sentence", f"""WITH {SALES}, {_Q},
g AS (SELECT o_orderstatus AS member, {_sums('o_orderdate', 'o_totalprice')} FROM s, p GROUP BY 1),
t AS (SELECT sum(a) AS a, sum(b) AS b, sum(b) - sum(a) AS d FROM g),
l AS (SELECT CASE WHEN d > 0 THEN max_by(member, g.b - g.a) ELSE min_by(member, g.b - g.a) END AS member,
  CASE WHEN d > 0 THEN max(g.b - g.a) ELSE min(g.b - g.a) END AS m, d, t.a FROM g, t GROUP BY d, t.a)
SELECT round(d, 2) AS delta, 'O totalprice ' || CASE WHEN d > 0 THEN 'rose ' ELSE 'fell ' END || format('{{:.1f}}% ', abs(d / a * 100)) ||
  '(' || {_signed('d')} || ') from Oct 2000 – Dec 2000 to Jan 2001 – Mar 2001' || CASE WHEN sign(m) <> sign(d) THEN ''
  WHEN abs(m / d) * 100 > 100 THEN ' — o orderstatus ' || member || ' alone moved ' || {_signed('m')} ||
    ', more than the whole change; other o orderstatus values ' || CASE WHEN d < 0 THEN 'rose' ELSE 'fell' END || ' and offset part of it'
  ELSE ' — o orderstatus ' || member || ' accounts for ' || {_signed('m')} || format(' ({{:.0f}}% of the move)', abs(m / d) * 100) END || '.' AS summary
FROM l""")
def change_sentence(spark: SparkSession, folder: str) -> DataFrame:
    """The change in words, with the order status that moved it most."""
    return rounded(reports.change_sentence(_quarter(sales(spark, folder)), dimension="o_orderstatus"))
