"""Profiles, quality, cleaning, appending and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.model import ColumnMeta, Dataset
from tallyspark.operators import joins, profile
from tallyspark.plans.catalog.registry import EVENTS, ORDERS, events, orders, query, rounded, table
from tallyspark.session import fresh_folder
from tallyspark.sources import batches, versions

_ROLE_TABLES = ("orders", "lineitem", "events", "customer", "part", "documents", "region", "labels")
_ROLE_COLUMNS = """orders.o_orderkey:ignored: orders.o_custkey:ignored: orders.o_orderstatus:dimension:generic
orders.o_totalprice:measure:currency orders.o_orderdate:date: orders.o_orderpriority:dimension:generic
lineitem.l_orderkey:ignored: lineitem.l_partkey:ignored: lineitem.l_suppkey:ignored: lineitem.l_linenumber:dimension:generic
lineitem.l_quantity:measure:count lineitem.l_extendedprice:measure:currency lineitem.l_discount:measure:percentage
lineitem.l_tax:measure:percentage lineitem.l_returnflag:dimension:generic lineitem.l_linestatus:dimension:generic
lineitem.l_shipdate:date: events.event_id:ignored: events.ts:date: events.user_id:ignored: events.event_type:dimension:generic
events.value:measure:count events.props:ignored: customer.c_custkey:ignored: customer.c_name:ignored:
customer.c_nationkey:ignored: customer.c_acctbal:measure:count customer.c_mktsegment:dimension:business_unit
part.p_partkey:ignored: part.p_name:ignored: part.p_brand:dimension:generic part.p_type:dimension:generic
part.p_size:measure:count part.p_retailprice:measure:currency documents.doc_id:ignored: documents.text:ignored:
documents.lang:dimension:generic documents.source:dimension:generic documents.n_chars:measure:count
region.r_regionkey:ignored: region.r_name:dimension:generic labels.doc_id:ignored: labels.quality:dimension:generic
labels.toxic:dimension:generic"""


def _roles_sql() -> str:
    parts = []
    for item in _ROLE_COLUMNS.split():
        name, role, sub = item.split(":")
        t, c = name.split(".")
        kind = f"'{sub}'" if sub else "NULL"
        parts.append(f"SELECT '{t}' AS table_name, '{c}' AS \"column\", '{role}' AS role, {kind} AS subtype, "
                     f"count(DISTINCT {c}) AS distinct_count FROM {t}")
    return " UNION ALL ".join(parts)


@query("role_profile", _roles_sql())
def role_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Roles and distinct counts of every column of eight tables."""
    out = None
    for name in _ROLE_TABLES:
        df = table(spark, folder, name)
        rows = profile.roles_frame(df, profile.detect_roles(df)).select(
            F.lit(name).alias("table_name"), "column", "role", "subtype", "distinct_count")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("role_override", """SELECT 'o_orderstatus' AS "column", 'ignored' AS role FROM orders HAVING count(*) > 0
UNION ALL SELECT 'o_totalprice', 'measure' FROM orders HAVING count(*) > 0""")
def role_override(spark: SparkSession, folder: str) -> DataFrame:
    """A user's choice survives detection."""
    df = table(spark, folder, "orders").select("o_orderstatus", "o_totalprice")
    return profile.roles_frame(df, profile.detect_roles(df, {"o_orderstatus": "ignored"})).select("column", "role")


def _messy(spark: SparkSession, folder: str) -> Dataset:
    """Events without values for errors, and a code that is sometimes a number."""
    ds = events(spark, folder)
    code = F.when(F.col("event_type").isin("view", "click"), F.col("user_id").cast("string")).otherwise(
        F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return Dataset.open(ds.frame.withColumn("code", code), [*ds.columns, ColumnMeta("code", "ignored")], "messy")


_MESSY = f"""{EVENTS}, x AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN user_id::VARCHAR ELSE 'u' || user_id END AS code FROM ev),
f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM x),
n AS (SELECT count(*) AS n, count(value) AS filled FROM x),
o AS (SELECT count(*) AS k FROM x, f WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"""


@query("quality_columns", f"""WITH {_MESSY}
SELECT c AS "column", r AS role, CASE WHEN c = 'value' THEN n - filled ELSE 0 END AS missing_count,
  CASE WHEN c = 'value' THEN round((n - filled) / n * 100, 1) ELSE 0.0 END AS missing_pct, c = 'code' AS mixed_format,
  CASE WHEN c = 'value' THEN k END AS outlier_count
FROM n, o, (VALUES ('event_id', 'ignored'), ('ts', 'date'), ('user_id', 'ignored'), ('event_type', 'dimension'),
  ('value', 'measure'), ('props', 'ignored'), ('code', 'ignored')) AS t(c, r)""")
def quality_columns(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.column_quality(_messy(spark, folder)))


@query("quality_suggestions", f"""WITH {_MESSY}, d AS (SELECT count(*) - count(DISTINCT (event_type, user_id)) AS k FROM events)
SELECT 'drop_duplicates' AS id, 'warning' AS severity, k AS n_rows FROM d WHERE k > 0
UNION ALL SELECT 'fill_value', CASE WHEN (n - filled) / n >= 0.05 THEN 'warning' ELSE 'info' END, n - filled FROM n
UNION ALL SELECT 'format_code', 'info', NULL UNION ALL SELECT 'outliers_value', 'info', k FROM o WHERE k > 0""")
def quality_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    ds = _messy(spark, folder)
    pairs = Dataset.open(ds.frame.select("event_type", "user_id"), [
        ColumnMeta("event_type", "dimension"), ColumnMeta("user_id", "ignored")])
    return profile.suggestions(profile.column_quality(ds), profile.duplicate_count(pairs)).select(
        "id", "severity", "n_rows")


def _repeated(spark: SparkSession, folder: str) -> Dataset:
    df = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return Dataset.open(df, [ColumnMeta("l_returnflag", "dimension"), ColumnMeta("l_linestatus", "dimension"),
                             ColumnMeta("l_quantity", "measure"), ColumnMeta("l_discount", "measure")])


_REPEATED = "(SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)"


@query("duplicate_rows", f"""SELECT (SELECT count(*) FROM lineitem) AS row_count,
  (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM {_REPEATED}) AS duplicate_rows""")
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return profile.duplicate_count(_repeated(spark, folder))


@query("drop_duplicates", f"SELECT * FROM {_REPEATED}")
def drop_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return profile.drop_duplicates(_repeated(spark, folder)).frame


_FILLED = """SELECT event_id, round(coalesce(value, (SELECT {f}(value) FROM ev)), 6) AS value FROM ev"""


@query("fill_mean", f"WITH {EVENTS} {_FILLED.format(f='avg')}")
def fill_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.fill_missing(events(spark, folder), "value", "mean").frame.select("event_id", "value"), 6)


@query("fill_median", f"WITH {EVENTS} {_FILLED.format(f='median')}")
def fill_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(profile.fill_missing(events(spark, folder), "value", "median").frame.select("event_id", "value"), 6)


@query("fill_mode", f"""WITH {ORDERS}, m AS (SELECT o_orderpriority AS v FROM o WHERE o_orderpriority IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority FROM o""")
def fill_mode(spark: SparkSession, folder: str) -> DataFrame:
    return profile.fill_missing(orders(spark, folder), "o_orderpriority", "mode").frame.select(
        "o_orderkey", "o_orderpriority")


# ---------------------------------------------------------------- batches ---

def _before_2001(spark: SparkSession, folder: str) -> DataFrame:
    """Orders up to June 2001 as the first batch."""
    return orders(spark, folder).frame.where("o_orderdate < timestamp_ntz'2001-07-01 00:00:00'").withColumn(
        "_batch", F.lit("first"))


def _since_june(spark: SparkSession, folder: str) -> DataFrame:
    """A second file that overlaps June 2001 and has a column more and one less."""
    df = orders(spark, folder).frame.where("o_orderdate >= timestamp_ntz'2001-06-01 00:00:00'")
    return df.withColumn("channel", F.when(F.col("o_custkey") > 100, "web").otherwise("shop"))


_LATER = """n AS (SELECT *, CASE WHEN o_custkey > 100 THEN 'web' ELSE 'shop' END AS channel FROM o
  WHERE o_orderdate >= DATE '2001-06-01')"""
_SUMMARY = """strftime(date_trunc('month', o_orderdate), '%Y-%m') AS period, _batch, count(*) AS n_rows, count(channel) AS with_channel,
  round(sum(o_totalprice), 2) AS value"""


def _summary(df: DataFrame) -> DataFrame:
    return rounded(df.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), "_batch").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("channel").alias("with_channel"),
        F.sum("o_totalprice").alias("value")))


@query("append_dedup", f"""WITH {ORDERS}, {_LATER},
t AS (SELECT o_orderdate, o_totalprice, NULL AS channel, 'first' AS _batch FROM o WHERE o_orderdate < DATE '2001-07-01'
  UNION ALL SELECT o_orderdate, o_totalprice, channel, 'second' FROM n WHERE o_orderdate >= DATE '2001-07-01')
SELECT {_SUMMARY} FROM t GROUP BY 1, 2""")
def append_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """June is there already and is skipped; the new column is null on old rows."""
    return _summary(batches.append(_before_2001(spark, folder), _since_june(spark, folder), "second", "o_orderdate").table)


@query("append_log", f"""WITH {ORDERS}, {_LATER} SELECT 'second' AS batch_id, 'append' AS mode,
  count(*) FILTER (o_orderdate >= DATE '2001-07-01') AS rows_added, 0 AS rows_removed,
  count(*) FILTER (o_orderdate < DATE '2001-07-01') AS skipped_duplicates FROM n""")
def append_log(spark: SparkSession, folder: str) -> DataFrame:
    incoming = _since_june(spark, folder)
    result = batches.append(_before_2001(spark, folder), incoming, "second", "o_orderdate")
    return batches.batch_log(incoming, result, "second").drop("created_at")


@query("append_all_columns", """WITH w AS (SELECT *, l_shipdate >= DATE '1998-01-01' AS late FROM lineitem),
n AS (SELECT * EXCLUDE late FROM w WHERE l_shipdate >= DATE '1997-11-01' AND l_shipdate < DATE '1998-03-01')
SELECT 'history' AS part, count(*) AS n_rows, round(sum(l_extendedprice), 2) AS value FROM w WHERE NOT late
UNION ALL SELECT 'added', count(*), round(sum(l_extendedprice), 2) FROM n WHERE l_shipdate >= DATE '1998-01-01'
UNION ALL SELECT 'known', count(*), round(sum(l_extendedprice), 2) FROM (SELECT DISTINCT * FROM n WHERE l_shipdate < DATE '1998-01-01')""")
def append_all_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a stored row hash; a file of four months brings two again.  ``known`` are the rows of the
    history that were compared value by value: the filter let through those two months and no others."""
    items = table(spark, folder, "lineitem")
    first = items.where("l_shipdate < timestamp_ntz'1998-01-01 00:00:00'")
    held = first.withColumn(batches.HASH_COLUMN, batches.stable_hash(first.columns, first)).withColumn("_batch", F.lit("first"))
    incoming = items.where("l_shipdate >= timestamp_ntz'1997-11-01 00:00:00' AND l_shipdate < timestamp_ntz'1998-03-01 00:00:00'")
    done = batches.append(held, incoming, "second", "l_shipdate")
    hashed = incoming.withColumn("_hash", batches.stable_hash(incoming.columns, incoming))
    known = batches.known_rows(held, hashed, "l_shipdate")
    known = known.join(hashed.select(F.col("_hash")).distinct(), "_hash", "left_semi")

    def total(df: DataFrame, name: str, price: str = "l_extendedprice") -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(price).alias("value")).withColumn("part", F.lit(name))

    return rounded(total(done.table.where("_batch = 'first'"), "history").unionByName(total(done.added, "added")).unionByName(
        total(known, "known", "_l_extendedprice")).select("part", "n_rows", "value"))


@query("replace_period", f"""WITH {ORDERS}, {_LATER},
t AS (SELECT o_orderdate, o_totalprice, NULL AS channel, 'first' AS _batch FROM o WHERE o_orderdate < DATE '2001-06-01'
  UNION ALL SELECT o_orderdate, o_totalprice, channel, 'second' FROM n)
SELECT {_SUMMARY} FROM t GROUP BY 1, 2""")
def replace_period(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(batches.replace_period(_before_2001(spark, folder), _since_june(spark, folder), "second",
                                           "o_orderdate").table)


@query("rollback", f"""WITH {ORDERS},
t AS (SELECT o_orderdate, o_totalprice, NULL AS channel, CASE WHEN o_orderdate < DATE '2001-06-01' THEN 'first' ELSE 'restored' END AS _batch
  FROM o WHERE o_orderdate < DATE '2001-07-01')
SELECT {_SUMMARY} FROM t GROUP BY 1, 2""")
def rollback(spark: SparkSession, folder: str) -> DataFrame:
    """Take the replacement back: its rows go, the rows it replaced return."""
    done = batches.replace_period(_before_2001(spark, folder), _since_june(spark, folder), "second", "o_orderdate")
    return _summary(batches.rollback(done.table, done.removed, "second", "restored"))


@query("batch_list", f"""WITH {ORDERS} SELECT 'second' AS batch_id, count(*) FILTER (o_orderdate >= DATE '2001-06-01') AS rows_added,
  count(*) FILTER (o_orderdate >= DATE '2001-06-01') AS rows_now, count(*) FILTER (o_orderdate >= DATE '2001-06-01' AND o_orderdate < DATE '2001-07-01') AS rows_removed FROM o""")
def batch_list(spark: SparkSession, folder: str) -> DataFrame:
    incoming = _since_june(spark, folder)
    done = batches.replace_period(_before_2001(spark, folder), incoming, "second", "o_orderdate")
    log = batches.batch_log(incoming, done, "second")
    return batches.list_batches(done.table, log).select("batch_id", "rows_added", "rows_now", "rows_removed")


@query("archive_json", f"""WITH {ORDERS} SELECT count(*) AS n_rows, count(o_orderpriority) AS with_priority, round(sum(o_totalprice), 2) AS value FROM o""")
def archive_json(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to JSON and back, missing values included."""
    ds = orders(spark, folder)
    text = batches.as_json(ds.frame, ds.user_columns)
    back = batches.from_json(text, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                   "o_orderdate timestamp_ntz, o_orderpriority string")
    return rounded(back.agg(F.count(F.lit(1)).alias("n_rows"), F.count("o_orderpriority").alias("with_priority"),
                            F.sum("o_totalprice").alias("value")))


# ------------------------------------------------------------------ joins ---

def _side(spark: SparkSession, folder: str, name: str, key: str, new: str) -> Dataset:
    df = table(spark, folder, name).withColumnRenamed(key, new)
    return Dataset.open(df, [ColumnMeta(c, "ignored") for c in df.columns], name)


@query("join_left", """SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def join_left(spark: SparkSession, folder: str) -> DataFrame:
    left, right = (_side(spark, folder, n, "doc_id", "doc_id") for n in ("documents", "labels"))
    return rounded(joins.join(left, right, "doc_id", "doc_id", "left").drop("text"))


@query("join_inner_renamed", """SELECT a.doc_id, a.quality, b.quality AS labels_quality, b.toxic AS labels_toxic, a.toxic
FROM labels a JOIN labels b ON a.doc_id = b.doc_id""")
def join_inner_renamed(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the right side whose names are taken get its name in front."""
    left, right = (_side(spark, folder, "labels", "doc_id", "doc_id") for _ in range(2))
    return rounded(joins.join(left, right, "doc_id", "doc_id", "inner"))


@query("join_facts", """SELECT c_mktsegment, count(*) AS n_rows, round(sum(o_totalprice), 2) AS value FROM orders LEFT JOIN customer
ON o_custkey = c_custkey GROUP BY 1""")
def join_facts(spark: SparkSession, folder: str) -> DataFrame:
    left, right = _side(spark, folder, "orders", "o_custkey", "o_custkey"), _side(spark, folder, "customer", "c_custkey", "c_custkey")
    return rounded(joins.join(left, right, "o_custkey", "c_custkey").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("value")))


@query("join_rebuilt", """WITH c AS (SELECT * FROM customer WHERE c_custkey % 3 > 0)
SELECT 'first' AS state, false AS stale, count(*) AS n_rows, count(c_acctbal) AS matched, round(sum(o_totalprice), 2) AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'source refreshed', true, count(*), count(c_acctbal), round(sum(o_totalprice), 2) FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'rebuilt', false, count(*), count(c_acctbal), round(sum(o_totalprice), 2) FROM orders LEFT JOIN c ON o_custkey = c_custkey""")
def join_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """A recorded join, one of its sources refreshed, and the join made again."""
    left, right, path = (fresh_folder(spark) for _ in range(3))
    customers = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    versions.create(table(spark, folder, "orders"), left, "b1", name="orders")
    versions.create(customers, right, "b1", name="customers")

    def now(state: str) -> DataFrame:
        df, stale = versions.rows_of(spark, path), joins.is_stale(spark, path)
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("c_acctbal").alias("matched"), F.sum("o_totalprice").alias("value")).select(
            F.lit(state).alias("state"), F.lit(stale).alias("stale"), "n_rows", "matched", "value")

    joins.recorded_join(spark, left, right, "o_custkey", "o_custkey", "left", path, "j1")
    out = now("first")
    versions.refresh(customers.where("o_custkey % 3 > 0"), right, "b2")
    out = out.unionByName(now("source refreshed"))
    joins.rebuild(spark, path, "j2")
    return rounded(out.unionByName(now("rebuilt")))


@query("join_key_overlap", """SELECT count(DISTINCT d.doc_id) AS left_keys, count(DISTINCT l.doc_id) AS matched_keys,
  round(count(DISTINCT l.doc_id) / count(DISTINCT d.doc_id), 6) AS overlap FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def join_key_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(joins.key_overlap(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id",
                                     "doc_id"), 6)


@query("join_key_suggestion", "SELECT 'doc_id' AS key, count(*) > 0 AS usable FROM labels")
def join_key_suggestion(spark: SparkSession, folder: str) -> DataFrame:
    left, right = (_side(spark, folder, n, "doc_id", "doc_id") for n in ("documents", "labels"))
    key = joins.suggest_keys(left, right)[0]
    seen = joins.key_overlap(left.frame, right.frame, key, key)
    return seen.select(F.lit(key).alias("key"), (F.col("matched_keys") > 0).alias("usable"))


@query("place_lookup", """WITH p AS (SELECT n_name AS member, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
g AS (SELECT lower(trim(n_name)) AS place, n_nationkey * 1.5 AS lng, n_nationkey - 10.0 AS lat FROM nation WHERE n_regionkey < 3)
SELECT member, customers, lng::DOUBLE AS lng, lat::DOUBLE AS lat FROM p LEFT JOIN g ON lower(trim(member)) = place""")
def place_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Nations placed by a table of places that knows three of five regions."""
    nation = table(spark, folder, "nation")
    people = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_name").alias("member")).agg(F.count(F.lit(1)).alias("customers"))
    places = nation.where("n_regionkey < 3").select(
        F.lower(F.trim("n_name")).alias("place"), (F.col("n_nationkey") * 1.5).cast("double").alias("lng"),
        (F.col("n_nationkey") - 10.0).cast("double").alias("lat"))
    return joins.locate(people, places)


@query("mappable_share", """SELECT round(avg((n_regionkey < 3)::INT), 6) AS mappable FROM nation""")
def mappable_share(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    places = nation.where("n_regionkey < 3").select(F.lower("n_name").alias("place"), F.lit(0.0).alias("lng"),
                                                    F.lit(0.0).alias("lat"))
    return rounded(joins.mappable_share(joins.locate(nation.select(F.col("n_name").alias("member")), places)), 6)
