"""Metrics, structured questions, targets, alerts and the rules over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.model import AnalysisError, Dataset
from tallyspark.operators import goals, metrics, rules
from tallyspark.operators.metrics import Metric, Part, Question
from tallyspark.plans import reports
from tallyspark.plans.catalog import changes, forecasts
from tallyspark.plans.catalog.registry import EVENTS, SALES, events, lineitem, orders, query, rounded, sales

METRICS = (
    Metric("revenue", Part("sum", "l_extendedprice"), None, "currency"), Metric("rows", Part("count")),
    Metric("parts", Part("count_distinct", "l_partkey")), Metric("typical price", Part("median", "l_extendedprice")),
    Metric("largest order", Part("max", "l_quantity")), Metric("mean tax", Part("avg", "l_tax"), None, "percent"),
    Metric("unit price", Part("sum", "l_extendedprice"), Part("sum", "l_quantity")),
    Metric("tax to discount", Part("sum", "l_tax"), Part("sum", "l_discount"), "percent"),
    Metric("broken", Part("sum", "no_such_column")), Metric("smallest", Part("min", "l_quantity")))


@query("metrics_all", """
SELECT 'revenue' AS metric, round(sum(l_extendedprice), 2) AS value, NULL AS error FROM lineitem
UNION ALL SELECT 'rows', count(*), NULL FROM lineitem UNION ALL SELECT 'parts', count(DISTINCT l_partkey), NULL FROM lineitem
UNION ALL SELECT 'typical price', round(median(l_extendedprice), 2), NULL FROM lineitem
UNION ALL SELECT 'largest order', max(l_quantity), NULL FROM lineitem
UNION ALL SELECT 'mean tax', round(avg(l_tax) * 100, 2), NULL FROM lineitem
UNION ALL SELECT 'unit price', round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 2), NULL FROM lineitem
UNION ALL SELECT 'tax to discount', round(sum(l_tax) / nullif(sum(l_discount), 0) * 100, 2), NULL FROM lineitem
UNION ALL SELECT 'broken', NULL, 'unknown column ''no_such_column'''
UNION ALL SELECT 'smallest', min(l_quantity), NULL FROM lineitem""")
def metrics_all(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.evaluate(lineitem(spark, folder), METRICS))


@query("metric_ratio_zero", "SELECT 'none' AS metric, NULL::DOUBLE AS value, NULL::VARCHAR AS error")
def metric_ratio_zero(spark: SparkSession, folder: str) -> DataFrame:
    """A ratio over a slice without rows has no value, and is no error."""
    ds = lineitem(spark, folder).slice({"l_returnflag": "no such flag"})
    return metrics.evaluate(ds, [Metric("none", Part("sum", "l_tax"), Part("count"))])


@query("question_grouped", f"""WITH {SALES} SELECT n_name AS label, round(sum(o_totalprice), 2) AS value FROM s
WHERE o_orderstatus = 'F' AND r_name = 'ASIA' GROUP BY 1 ORDER BY sum(o_totalprice) DESC, label LIMIT 3""")
def question_grouped(spark: SparkSession, folder: str) -> DataFrame:
    q = Question("o_totalprice", "sum", "n_name", {"o_orderstatus": "F", "r_name": "ASIA"}, limit=3)
    return rounded(metrics.ask(sales(spark, folder), q))


@query("question_ascending", f"""WITH {SALES} SELECT n_name AS label, round(avg(o_totalprice), 2) AS value FROM s
GROUP BY 1 ORDER BY avg(o_totalprice), label LIMIT 20""")
def question_ascending(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.ask(sales(spark, folder), Question("o_totalprice", "avg", "n_name", sort="asc")))


@query("question_month", """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS label, max(o_totalprice) AS value
FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-07-01' GROUP BY 1""")
def question_month(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ask(orders(spark, folder), Question("o_totalprice", "max", metrics.MONTH), "1998-01", "1999-06")


@query("question_scalar", "SELECT NULL::VARCHAR AS label, count(*)::DOUBLE AS value FROM orders WHERE o_orderpriority = '1-URGENT'")
def question_scalar(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ask(orders(spark, folder), Question(None, "count", None, {"o_orderpriority": "1-URGENT"}))


@query("question_refused", "SELECT 'no such measure' AS why UNION ALL SELECT 'unknown name' UNION ALL SELECT 'no rows' FROM orders HAVING count(*) >= 0")
def question_refused(spark: SparkSession, folder: str) -> DataFrame:
    """Three questions without an answer: each is refused, none is answered with
    another number."""
    ds, why = orders(spark, folder), []
    for name, q in (("no such measure", Question("profit")), ("unknown name", Question("o_totalprice", unresolved=["Mars"]))):
        try:
            metrics.ask(ds, q)
        except AnalysisError:
            why.append((name,))
    none = metrics.ask(ds, Question("o_totalprice", filters={"o_orderstatus": "no such status"})).agg(
        F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no rows").alias("why"))
    return spark.createDataFrame(why, "why string").unionByName(none)


@query("question_answer", f"""WITH {SALES}, g AS (SELECT r_name, sum(o_totalprice) / 1e7 AS v FROM s GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC) AS k FROM g)
SELECT max(r_name) FILTER (k = 1) || ' leads with ₹' || format('{{:.2f}}', round(max(v) FILTER (k = 1), 2)) ||
  ' Cr (total o totalprice), followed by ' || max(r_name) FILTER (k = 2) || ' (₹' ||
  format('{{:.2f}}', round(max(v) FILTER (k = 2), 2)) || ' Cr).' AS answer FROM r""")
def question_answer(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.answer(sales(spark, folder), Question("o_totalprice", "sum", "r_name"))


# --------------------------------------------------------------- targets ---

TARGETS = (
    goals.Target("t1", "o_totalprice", "year", "1999", 400_000_000.0), goals.Target("t2", "o_totalprice", "year", "1999", 1e12),
    goals.Target("t3", "o_totalprice", "month", "2001-08", 20_000_000.0), goals.Target("t4", "o_totalprice", "quarter", "2001-Q3", 1e9),
    goals.Target("t5", "o_totalprice", "week", "2001-07-30", 1000.0, {"o_orderstatus": "F"}),
    goals.Target("t6", "o_totalprice", "day", "2030-01-01", 5.0), goals.Target("t7", "profit", "month", "2001-08", 5.0),
    goals.Target("t8", "o_totalprice", "year", "2001", 950_000_000.0))

_TARGETS = """r(target_id, grain, period, goal, status_filter, lo, hi) AS (VALUES
  ('t1', 'year', '1999', 400000000.0::DOUBLE, NULL, DATE '1999-01-01', DATE '1999-12-31'),
  ('t2', 'year', '1999', 1e12, NULL, DATE '1999-01-01', DATE '1999-12-31'),
  ('t3', 'month', '2001-08', 20000000.0, NULL, DATE '2001-08-01', DATE '2001-08-31'),
  ('t4', 'quarter', '2001-Q3', 1e9, NULL, DATE '2001-07-01', DATE '2001-09-30'),
  ('t5', 'week', '2001-07-30', 1000.0, 'F', DATE '2001-07-30', DATE '2001-08-05'),
  ('t6', 'day', '2030-01-01', 5.0, NULL, DATE '2030-01-01', DATE '2030-01-01'),
  ('t8', 'year', '2001', 950000000.0, NULL, DATE '2001-01-01', DATE '2001-12-31')),
e AS (SELECT max(o_orderdate)::DATE AS d FROM orders),
a AS (SELECT r.*, d, coalesce((SELECT sum(o_totalprice) FROM orders WHERE o_orderdate >= lo AND o_orderdate < hi + 1
    AND (status_filter IS NULL OR o_orderstatus = status_filter)), 0) AS actual, (hi - lo) + 1 AS days,
  CASE WHEN d < lo THEN 0 ELSE least((hi - lo) + 1, (d - lo) + 1) END AS elapsed FROM r, e),
j AS (SELECT *, days - elapsed AS remaining,
  CASE WHEN days = elapsed OR elapsed = 0 THEN actual ELSE actual / elapsed * days END AS projection FROM a),
t AS (SELECT target_id, grain, period, goal, CASE WHEN status_filter IS NULL THEN 0 ELSE 1 END AS filters, actual, projection,
  projection / goal AS ratio, days, elapsed, remaining,
  CASE WHEN remaining > 0 AND goal > actual THEN (goal - actual) / remaining ELSE 0.0 END AS needed,
  lo <= d AND d <= hi AS current, CASE WHEN elapsed = 0 THEN 'not_started' WHEN actual >= goal THEN 'met'
    WHEN remaining = 0 THEN 'missed' WHEN projection >= goal THEN 'on_track'
    WHEN projection >= 0.9 * goal THEN 'at_risk' ELSE 'off_track' END AS status FROM j)"""


@query("targets_eval", f"""WITH {_TARGETS}
SELECT target_id, 'o_totalprice' AS measure, grain, period, goal, filters, round(actual, 2) AS actual, round(projection, 2) AS projection,
  round(actual / goal, 6) AS progress, round(ratio, 6) AS projected_ratio, round(projection - goal, 2) AS gap, days,
  elapsed AS days_elapsed, remaining AS days_remaining, round(needed, 2) AS needed_per_day, current, status,
  NULL::VARCHAR AS reason FROM t
UNION ALL SELECT 't7', 'profit', 'month', '2001-08', 5.0, 0, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL, false, 'broken',
  'orders has no measure ''profit'''""")
def targets_eval(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(goals.evaluate_targets(orders(spark, folder), TARGETS), progress=6, projected_ratio=6)


ALERTS = (
    goals.Alert("a1", "o_totalprice", "total", "gt", 1.0), goals.Alert("a2", "o_totalprice", "latest", "lt", 1e12, "firing"),
    goals.Alert("a3", "o_totalprice", "mom_pct", "lte", -20.0, "ok"), goals.Alert("a4", "o_totalprice", "target_pace", "gte", 1e6),
    goals.Alert("a5", "profit", "total", "gt", 0.0), goals.Alert("a6", "o_totalprice", "total", "lt", 0.0, enabled=False))


@query("alert_states", f"""WITH {_TARGETS},
m AS (SELECT date_trunc('month', o_orderdate) AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1),
z AS (SELECT k, v, lag(v) OVER (ORDER BY k) AS pv FROM m ORDER BY k DESC LIMIT 1),
x AS (SELECT 'a1' AS alert_id, (SELECT sum(v) FROM m) AS value, 'firing' AS state, true AS fired
  UNION ALL SELECT 'a2', (SELECT v FROM z), 'firing', false
  UNION ALL SELECT 'a3', (SELECT (v - pv) / pv * 100 FROM z), CASE WHEN (SELECT (v - pv) / pv * 100 FROM z) <= -20 THEN 'firing' ELSE 'ok' END,
    (SELECT (v - pv) / pv * 100 FROM z) <= -20
  UNION ALL SELECT 'a4', (SELECT ratio * 100 FROM t WHERE target_id = 't3'), 'ok', false
  UNION ALL SELECT 'a5', NULL, 'error', false)
SELECT alert_id, round(value, 4) AS value, state, fired FROM x""")
def alert_states(spark: SparkSession, folder: str) -> DataFrame:
    values = goals.alert_values(orders(spark, folder), ALERTS, TARGETS)
    return rounded(goals.alert_states(values).select("alert_id", "value", "state", "fired"), 4)


@query("alert_history", f"""WITH {EVENTS},
d AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM ev WHERE value IS NOT NULL GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN v > 1000 THEN 'firing' ELSE 'ok' END AS state FROM d)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, round(v, 2) AS value, state,
  state = 'firing' AND coalesce(lag(state) OVER (PARTITION BY event_type ORDER BY day), 'pending') <> 'firing' AS fired FROM s""")
def alert_history(spark: SparkSession, folder: str) -> DataFrame:
    """A threshold over daily values: fires on entry, re-arms on return."""
    daily = events(spark, folder).frame.where("value is not null").groupBy(
        "event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("value"))
    return rounded(goals.alert_history(daily, "gt", 1000.0, ["event_type"], "day"))


@query("alert_messages", f"""WITH {_TARGETS},
m AS (SELECT date_trunc('month', o_orderdate) AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1),
z AS (SELECT v, lag(v) OVER (ORDER BY k) AS pv FROM m ORDER BY k DESC LIMIT 1),
x AS (SELECT 'a1' AS alert_id, 'total o_totalprice' AS what, (SELECT sum(v) FROM m) AS value, '' AS unit, '> 1.0' AS bound
  UNION ALL SELECT 'a3', 'month-over-month change of o_totalprice', (v - pv) / abs(pv) * 100, '%', '≤ -20.0' FROM z WHERE (v - pv) / abs(pv) * 100 <= -20
  UNION ALL SELECT 'a4', 'pace against target for o_totalprice', ratio * 100, '%', '≥ 1000000.0' FROM t WHERE target_id = 't3' AND ratio * 100 >= 1e6)
SELECT alert_id, what || ' is ' || format('{{:,.2f}}', value) || unit || ' (threshold ' || bound || ').' AS text FROM x""")
def alert_messages(spark: SparkSession, folder: str) -> DataFrame:
    values = goals.alert_values(orders(spark, folder), ALERTS, TARGETS)
    return goals.message(goals.alert_states(values)).select("alert_id", "text")


# ----------------------------------------------------------------- rules ---

@query("insights", f"""
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1),
e AS (SELECT min_by(v, k) AS f, max_by(v, k) AS l, max(k) AS k FROM m),
z AS (SELECT v AS pv FROM m ORDER BY k DESC LIMIT 1 OFFSET 1),
n AS (SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS t FROM m),
fit AS (SELECT regr_intercept(v, t) AS b, regr_slope(v, t) AS a FROM n),
x AS (SELECT k, v, v - (b + a * t) AS res FROM n, fit),
y AS (SELECT *, res / stddev_samp(res) OVER () AS dev FROM x),
d AS (SELECT o_orderstatus AS member, sum(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT *, round(v / sum(v) OVER () * 100, 1) AS share, row_number() OVER (ORDER BY v DESC, member) AS rank FROM d)
SELECT 'trend' AS category, 'o_totalprice' AS subject, round((l - f) / abs(f) * 100, 4) AS metric,
  CASE WHEN (l - f) / abs(f) >= 0.05 THEN 'good' WHEN (l - f) / abs(f) <= -0.05 THEN 'warning' ELSE 'info' END AS severity FROM e
UNION ALL SELECT 'momentum', strftime(k, '%Y-%m'), round((l - pv) / abs(pv) * 100, 4), CASE WHEN l > pv THEN 'good' ELSE 'warning' END
  FROM e, z WHERE abs((l - pv) / abs(pv)) >= 0.08
UNION ALL SELECT 'anomaly', strftime(k, '%Y-%m'), round(v, 4), CASE WHEN abs(dev) >= 3.5 THEN 'critical' ELSE 'warning' END FROM y WHERE abs(dev) >= 2.5
UNION ALL SELECT 'concentration', member, share, 'warning' FROM s WHERE rank = 1 AND share >= 40
UNION ALL SELECT 'leader', member, round(v, 4), 'good' FROM s WHERE rank = 1
UNION ALL SELECT 'pareto', 'o_orderstatus', n, 'info' FROM (SELECT min(rank) FILTER (c >= 80) AS n, count(*) AS total
  FROM (SELECT rank, sum(share) OVER (ORDER BY rank) AS c FROM s)) WHERE total > n
UNION ALL SELECT 'forecast', strftime(k, '%Y-%m'), round(greatest(p, 0), 2), 'info'
  FROM (WITH {forecasts.cte("'o_totalprice'")} SELECT k, p FROM fin JOIN best USING (measure, method) WHERE step = 1)""")
def insights(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule, the projection of the next month among them."""
    found = rules.insights(orders(spark, folder))
    metric = F.when(F.col("category") == "forecast", F.round("metric", 2)).otherwise(F.col("metric")).alias("metric")
    return rounded(found.select("category", "subject", metric, "severity"), 4)


@query("insights_text")
def insights_text(spark: SparkSession, folder: str) -> DataFrame:
    return rules.insights(orders(spark, folder)).select("position", "severity", "title", "detail")


def _span(side: str) -> str:
    """How the period ``side`` is called in a sentence."""
    lo, hi = f"{side}0", f"{side}1"
    return (f"CASE WHEN day({lo}) = 1 AND {hi} = last_day({lo}) THEN strftime({lo}, '%b %Y') WHEN {lo} = {hi} THEN strftime({lo}, '%-d %b %Y') "
            f"ELSE strftime({lo}, '%-d %b') || ' – ' || strftime({hi}, '%-d %b %Y') END")


_money = changes._money
_A, _B = changes._in("a", "l_shipdate"), changes._in("b", "l_shipdate")
_V = "l_extendedprice"
#: The actions for line items, rule by rule, each from the question that its rule asks.
_ACTIONS = f"""{changes._L},
li AS (SELECT l_linenumber::VARCHAR AS l_linenumber, l_returnflag, l_linestatus, l_shipdate, l_quantity, {_V} FROM lineitem),
mem AS (SELECT unnest([{{'dimension': 'l_linenumber', 'member': l_linenumber}}, {{'dimension': 'l_returnflag', 'member': l_returnflag}},
  {{'dimension': 'l_linestatus', 'member': l_linestatus}}], recursive := true), l_shipdate, {_V} FROM li),
lab AS (SELECT *, ' from ' || {_span('a')} || ' to ' || {_span('b')} AS words FROM p),
two AS (SELECT dimension, member, sum(CASE WHEN {_A} THEN {_V} ELSE 0 END) AS a, sum(CASE WHEN {_B} THEN {_V} ELSE 0 END) AS b
  FROM mem, p WHERE {_A} OR {_B} GROUP BY 1, 2),
tot AS (SELECT coalesce(sum(CASE WHEN {_A} THEN {_V} END), 0) AS a, coalesce(sum(CASE WHEN {_B} THEN {_V} END), 0) AS b FROM li, p),
mon AS (SELECT date_trunc('month', l_shipdate)::DATE AS k, sum({_V}) AS v FROM li, p WHERE l_shipdate::DATE <= b1
  AND date_diff('day', date_trunc('month', l_shipdate), l_shipdate) < CASE WHEN d < b9 THEN (b1 - b0) + 1 ELSE 400 END GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(k) FROM mon), (SELECT b0 FROM p), INTERVAL 1 MONTH))::DATE AS k),
mv AS (SELECT k, coalesce(v, 0) - lag(coalesce(v, 0)) OVER (ORDER BY k) AS delta FROM spine LEFT JOIN mon USING (k)),
hist AS (SELECT (max(delta) FILTER (k = b0) - avg(delta) FILTER (k < b0)) / stddev_samp(delta) FILTER (k < b0) AS z,
  stddev_samp(delta) FILTER (k < b0) AS sd, count(delta) FILTER (k < b0) AS n FROM mv, p),
sc AS (SELECT dimension, CASE WHEN count(*) FILTER (b <> a) >= 2 THEN max(abs(b - a)) / sum(abs(b - a)) ELSE 0 END AS score FROM two GROUP BY 1),
best AS (SELECT dimension FROM sc ORDER BY score DESC, list_position(['l_linenumber', 'l_returnflag', 'l_linestatus'], dimension) LIMIT 1),
seg AS (SELECT two.*, b - a AS delta, (b - a) / nullif(abs(a), 0) AS moved, sum(a) OVER () AS wa, sum(b) OVER () AS wb,
  replace(dimension, '_', ' ') AS dim, (SELECT words FROM lab) AS words FROM two JOIN best USING (dimension)),
line AS (SELECT *, upper(dim[1]) || dim[2:] || ' ' || member || ': ' || {_money('a')} || ' → ' || {_money('b')} ||
  format(' ({{:+.0f}}%)', moved * 100) || words AS text FROM seg),
pr AS (SELECT l_linenumber AS member, sum(CASE WHEN {_A} THEN {_V} ELSE 0 END) AS ra, sum(CASE WHEN {_B} THEN {_V} ELSE 0 END) AS rb,
  sum(CASE WHEN {_A} THEN l_quantity ELSE 0 END) AS qa, sum(CASE WHEN {_B} THEN l_quantity ELSE 0 END) AS qb FROM li, p WHERE {_A} OR {_B} GROUP BY 1),
pe AS (SELECT *, CASE WHEN qa > 0 AND qb > 0 THEN qb * (rb / qb - ra / qa) ELSE 0 END AS price FROM pr),
er AS (SELECT sum(ra) AS ra, sum(rb) AS rb, sum(qa) AS qa, sum(qb) AS qb, sum(price) AS price, min(price) AS lowest, arg_min(member, price) AS worst FROM pe),
tg AS (SELECT DATE '2001-01-01' AS lo, DATE '2001-12-31' AS hi, 1e12 AS goal, coalesce(sum({_V}), 0) AS actual FROM li WHERE year(l_shipdate) = 2001),
tj AS (SELECT tg.*, hi - d AS remaining, actual / ((d - lo) + 1) * 365 AS ahead FROM tg, p WHERE d BETWEEN lo AND hi),
al AS (SELECT dimension, member, sum({_V}) AS v FROM mem GROUP BY 1, 2),
ar AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY v DESC, member) AS rank, count(*) OVER (PARTITION BY dimension) AS n,
  round(v / sum(v) OVER (PARTITION BY dimension) * 100, 1) AS share FROM al),
act AS (SELECT 'unusual_move:{_V}' AS id, 'unusual_move' AS kind, CASE WHEN abs(z) >= 2.5 THEN 'high' ELSE 'medium' END AS severity, abs(b - a) AS magnitude,
    'Investigate the ' || CASE WHEN b < a THEN 'drop' ELSE 'jump' END || ' in l extendedprice' AS title,
    'L extendedprice ' || CASE WHEN b < a THEN 'fell ' ELSE 'rose ' END || {_money('abs(b - a)')} || (SELECT words FROM lab) || ': ' ||
      format('{{:.1f}}', abs(z)) || '× its typical swing of ' || {_money('sd')} || '.' AS why,
    'See which members moved it before deciding anything.' AS step, '{{}}' AS evidence FROM hist, tot WHERE n >= 5 AND sd > 0 AND abs(z) >= 1.5 AND b <> a
  UNION ALL SELECT 'declining_segment:' || dimension || '=' || member, 'declining_segment', CASE WHEN moved <= -0.3 THEN 'high' ELSE 'medium' END, abs(delta),
    'Find out why ' || member || ' is falling', text || CASE WHEN wb < wa THEN format(', {{:.0f}}% of the overall change', abs(delta / (wb - wa)) * 100) ELSE '' END || '.',
    'Open the rows of ' || member || ' and split them again: price, supply or a lost customer.', '{{"' || dimension || '":"' || member || '"}}'
    FROM line WHERE moved <= -0.15 AND a / wa >= 0.05
  UNION ALL SELECT 'growing_segment:' || dimension || '=' || member, 'growing_segment', 'low', abs(delta), 'Build on ' || member || '''s growth', text || '.',
    'Learn what ' || member || ' does differently and try it with another ' || dim || '.', '{{"' || dimension || '":"' || member || '"}}'
    FROM line WHERE moved >= 0.2 AND b / wb >= 0.05
  UNION ALL SELECT 'price_erosion:{_V}', 'price_erosion', 'medium', abs(price), 'Review pricing and discounts',
    'The average price went from ' || {_money('(ra / qa)')} || ' to ' || {_money('(rb / qb)')} || ' (l extendedprice per l quantity); price changes alone cost ' ||
      {_money('abs(price)')} || CASE WHEN lowest < 0 THEN ', most of it in ' || worst ELSE '' END || '.',
    'Go through discounts and price lists before asking for more volume.', '{{}}'
    FROM er WHERE qa > 0 AND qb > 0 AND price < 0 AND (abs(price) >= 0.25 * abs(CASE WHEN rb = ra THEN 1 ELSE rb - ra END) OR abs(price) >= 0.02 * abs(ra))
  UNION ALL SELECT 'target:t1', 'target', CASE WHEN ahead >= 0.9 * goal THEN 'medium' ELSE 'high' END, abs(ahead - goal), 'Close the gap on the 2001 target',
    'At the current pace l extendedprice reaches ' || {_money('ahead')} || ' against a target of ' || {_money('goal')} || format(' ({{:.0f}}%).', ahead / goal * 100),
    'Plan for ' || {_money('((goal - actual) / remaining)')} || ' a day over the ' || CASE WHEN remaining = 1 THEN 'one day' ELSE remaining || ' days' END || ' left.', '{{}}'
    FROM tj WHERE actual < goal AND remaining > 0 AND ahead < goal
  UNION ALL (SELECT 'concentration:' || dimension || '=' || member, 'concentration', 'medium', abs(v), 'Reduce dependence on ' || member,
    member || format(' is {{:.0f}}% of all l extendedprice across {{}} ', share, n) || replace(dimension, '_', ' ') || ' values.',
    'Secure ' || member || ' and grow the others: its trouble would be everyone''s.', '{{"' || dimension || '":"' || member || '"}}'
    FROM ar WHERE rank = 1 AND n >= 3 AND share >= greatest(40, 150 / n) ORDER BY share DESC, dimension LIMIT 1)
  UNION ALL SELECT 'missing_values:{_V}', 'missing_values', 'medium', missing, 'Fill in missing l extendedprice',
    format('{{:,}} of {{:,}} rows ({{:.0f}}%) have no l extendedprice, so every total understates it.', missing, n, missing / n * 100),
    'Repair the source, or leave these rows out on purpose.', '{{}}'
    FROM (SELECT count(*) AS n, count(*) - count({_V}) AS missing FROM lineitem) WHERE missing / n >= 0.05),
placed AS (SELECT *, row_number() OVER (ORDER BY list_position(['high', 'medium', 'low'], severity), magnitude DESC, id) AS position FROM act)"""


@query("actions", f"""WITH {_ACTIONS}
SELECT id, kind, severity, round(magnitude, 2) AS magnitude, title, why, step, evidence, position FROM placed WHERE position <= 8""")
def actions(spark: SparkSession, folder: str) -> DataFrame:
    """Recommended actions for line items, with a target in reach."""
    found = rules.actions(lineitem(spark, folder), "l_extendedprice", [
        goals.Target("t1", "l_extendedprice", "year", "2001", 1e12)])
    return rounded(found.withColumn("evidence", F.to_json("evidence")))


@query("actions_missing_values", f"""WITH {EVENTS}, n AS (SELECT count(*) AS n, count(*) - count(value) AS missing FROM ev)
SELECT 'missing_values:value' AS id, 'medium' AS severity, missing::DOUBLE AS magnitude FROM n WHERE missing / n >= 0.05""")
def actions_missing_values(spark: SparkSession, folder: str) -> DataFrame:
    return rules.actions(events(spark, folder), "value").where("kind = 'missing_values'").select(
        "id", "severity", "magnitude")


@query("fact_sheet", """
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1),
r AS (SELECT v, lag(v) OVER w AS m1, lag(v, 12) OVER w AS m12, sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS q,
  sum(v) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS q0, row_number() OVER (ORDER BY k DESC) AS age FROM m WINDOW w AS (ORDER BY k)),
d AS (SELECT o_orderstatus AS member, sum(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT row_number() OVER (ORDER BY v DESC, member) AS rank, round(v / sum(v) OVER () * 100, 1) AS share FROM d)
SELECT 'total' AS section, 'o_totalprice' AS name, round(sum(o_totalprice), 2) AS value FROM orders
UNION ALL SELECT 'mom_change_pct', 'o_totalprice', round((v - m1) / abs(m1) * 100, 1) FROM r WHERE age = 1
UNION ALL SELECT 'mom', 'o_totalprice', round((v - m1) / abs(m1) * 100, 1) FROM r WHERE age = 1
UNION ALL SELECT 'qoq', 'o_totalprice', round((q - q0) / abs(q0) * 100, 1) FROM r WHERE age = 1
UNION ALL SELECT 'yoy', 'o_totalprice', round((v - m12) / abs(m12) * 100, 1) FROM r WHERE age = 1
UNION ALL SELECT 'top_n_for_80pct', 'o_orderstatus', min(rank) FILTER (c >= 80) FROM (SELECT rank, sum(share) OVER (ORDER BY rank) AS c FROM s)""")
def fact_sheet(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(reports.fact_sheet(orders(spark, folder)))


@query("report_facts")
def report_facts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.report(sales(spark, folder), None, [goals.Target("t8", "o_totalprice", "year", "2001", 950_000_000.0)])


_MONTHS = """w AS (SELECT measure, k, v, row_number() OVER (PARTITION BY measure ORDER BY k) - 1 AS t FROM (
  SELECT date_trunc('month', l_shipdate)::DATE AS k, sum(l_quantity)::DOUBLE AS l_quantity, sum(l_extendedprice)::DOUBLE AS l_extendedprice,
    sum(l_discount)::DOUBLE AS l_discount, sum(l_tax)::DOUBLE AS l_tax FROM lineitem GROUP BY 1) UNPIVOT (v FOR measure IN (l_quantity, l_extendedprice, l_discount, l_tax))),
lf AS (SELECT measure, regr_intercept(v, t) AS b, regr_slope(v, t) AS a, avg(abs(v)) + 1 AS size FROM w GROUP BY 1),
lr AS (SELECT w.measure, k, v - (b + a * t) AS res, size FROM w JOIN lf USING (measure)),
odd AS (SELECT measure, k FROM (SELECT *, count(*) OVER p AS n, stddev_samp(res) OVER p AS sd FROM lr WINDOW p AS (PARTITION BY measure))
  WHERE n >= 5 AND sd > size * 1e-6 AND abs(res / sd) >= 2.5)"""
#: How many insights the first measure and dimension of line items give.
_INSIGHTS = """q AS (SELECT v, lag(v) OVER (ORDER BY k) AS pv, row_number() OVER (ORDER BY k DESC) AS age FROM w WHERE measure = 'l_quantity'),
sh AS (SELECT *, row_number() OVER (ORDER BY v DESC, member) AS rank, round(v / sum(v) OVER () * 100, 1) AS share
  FROM (SELECT l_linenumber::VARCHAR AS member, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1)),
vital AS (SELECT min(rank) FILTER (round(c, 6) >= 80) AS need, count(*) AS total FROM (SELECT rank, sum(share) OVER (ORDER BY rank) AS c FROM sh)),
ins AS (SELECT 3 + (SELECT count(*) FROM q WHERE age = 1 AND abs((v - pv) / abs(pv)) >= 0.08) + (SELECT count(DISTINCT k) FROM odd)
  + (SELECT count(*) FROM sh WHERE rank = 1 AND share >= 40) + (SELECT count(*) FROM vital WHERE total > need) AS n)"""


@query("dashboard_blocks", f"""
WITH {_MONTHS}, {_INSIGHTS}, m AS (SELECT count(DISTINCT date_trunc('month', l_shipdate)) AS months, count(DISTINCT l_linenumber) AS lines,
  count(DISTINCT l_returnflag) AS flags, count(DISTINCT l_linestatus) AS states,
  count(DISTINCT l_returnflag || l_linestatus) AS pairs FROM lineitem)
SELECT 'kpis' AS block, 4 AS n_rows FROM m UNION ALL SELECT 'profile', 1 FROM m UNION ALL SELECT 'distributions', 4 FROM m
UNION ALL SELECT 'filter_options', lines + flags + states FROM m UNION ALL SELECT 'trend', months * 4 FROM m
UNION ALL SELECT 'deltas', 4 FROM m UNION ALL SELECT 'growth', 4 FROM m UNION ALL SELECT 'moving_average', months * 4 FROM m
UNION ALL SELECT 'forecasts', 12 FROM m UNION ALL SELECT 'breakdowns', lines + flags + states FROM m
UNION ALL SELECT 'pareto', lines FROM m UNION ALL SELECT 'correlations', 6 FROM m UNION ALL SELECT 'treemap', pairs FROM m
UNION ALL SELECT 'anomalies', count(*) FROM odd UNION ALL SELECT 'insights', n FROM ins""")
def dashboard_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows each block of a dashboard has, those of the rules among them."""
    blocks, out = reports.dashboard(lineitem(spark, folder)), None
    for name, block in blocks.items():
        row = block.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("block"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out
