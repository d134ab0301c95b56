"""Retention, subject access, erasure and snapshots."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.model import AnalysisError, ColumnMeta, Dataset
from tallyspark.operators import governance
from tallyspark.operators.governance import Policy
from tallyspark.plans.catalog.registry import query, rounded, table
from tallyspark.session import fresh_folder
from tallyspark.sources import snapshots, tables, versions

NOW = dt.datetime(2024, 2, 1)
POLICY = Policy(audit_days=20, archive_days=10, dataset_days=40)


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("ts", F.col("user_id").cast("string").alias("user_id"), F.col(
        "event_type").alias("action"), F.col("props").alias("detail"))


def _batches(spark: SparkSession, folder: str) -> DataFrame:
    """A batch per user, as old as the user's first event; a dataset per nation-sized group."""
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("batch_id")).agg(
        F.min("ts").alias("created_at"), F.min("event_type").alias("dataset_id"))


def _archive(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("batch_id"), F.col("event_type").alias(
        "dataset_id"), "value")


def _datasets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("dataset_id")).agg(
        F.min("ts").alias("ingested_at"))


@query("retention_preview", """
WITH b AS (SELECT user_id AS batch_id, min(ts) AS created_at FROM events GROUP BY 1)
SELECT 'audit_entries' AS category, count(*) AS n_rows FROM events WHERE ts < TIMESTAMP '2024-02-01' - INTERVAL 20 DAY
UNION ALL SELECT 'archived_rows', count(*) FROM events WHERE user_id IN (SELECT batch_id FROM b WHERE created_at < TIMESTAMP '2024-02-01' - INTERVAL 10 DAY)
UNION ALL SELECT 'datasets', count(*) FROM (SELECT event_type, min(ts) AS t FROM events GROUP BY 1) WHERE t < TIMESTAMP '2024-02-01' - INTERVAL 40 DAY""")
def retention_preview(spark: SparkSession, folder: str) -> DataFrame:
    return governance.retention_preview(POLICY, NOW, *(f(spark, folder) for f in (_audit, _archive, _batches, _datasets)))


@query("retention_by_workspace", """
WITH p AS (SELECT DISTINCT user_id AS workspace_id, CASE WHEN user_id < 20 THEN 0 ELSE user_id END AS days FROM events)
SELECT workspace_id, count(*) AS expired_rows FROM events JOIN p ON user_id = workspace_id
WHERE days > 0 AND date_diff('day', ts::DATE, DATE '2024-02-01') > days GROUP BY 1""")
def retention_by_workspace(spark: SparkSession, folder: str) -> DataFrame:
    """Each workspace (here: user) under its own number of days; 0 keeps forever."""
    rows = table(spark, folder, "events").withColumnRenamed("user_id", "workspace_id")
    policies = rows.select("workspace_id").distinct().withColumn(
        "days", F.when(F.col("workspace_id") < 20, 0).otherwise(F.col("workspace_id")))
    return governance.retention_preview_by_workspace(rows, "ts", policies, NOW)


@query("retention_sweep", """
WITH b AS (SELECT user_id AS batch_id, min(ts) AS created_at FROM events GROUP BY 1),
old AS (SELECT batch_id FROM b WHERE created_at < TIMESTAMP '2024-02-01' - INTERVAL 10 DAY)
SELECT 'audit' AS table_name, count(*) + 1 AS n_rows FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 20 DAY
UNION ALL SELECT 'archive', count(*) FROM events WHERE user_id NOT IN (SELECT batch_id FROM old)
UNION ALL SELECT 'batches', count(*) FROM b UNION ALL SELECT 'datasets', count(DISTINCT event_type) FROM events
UNION ALL SELECT 'chunks', count(*) FROM events""")
def retention_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left per table; the audit trail gains the sweep's own row."""
    swept = governance.retention_sweep(POLICY, NOW, *(f(spark, folder) for f in (_audit, _archive, _batches, _datasets)),
                                       {"chunks": _archive(spark, folder)})
    out = None
    for name, df in swept.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("subject_export", """
SELECT 'customer' AS table_name, count(*) AS n_rows, count(*) AS with_key FROM customer WHERE c_custkey = 17
UNION ALL SELECT 'orders', count(*), count(*) FROM orders WHERE o_custkey = 17 HAVING count(*) > 0
UNION ALL SELECT 'events', count(*), count(*) FROM events WHERE user_id = 17 HAVING count(*) > 0""")
def subject_export(spark: SparkSession, folder: str) -> DataFrame:
    """Everything about one person, as JSON rows; counted here."""
    rows = governance.export_subject({
        "customer": (table(spark, folder, "customer"), "c_custkey"), "orders": (table(spark, folder, "orders"), "o_custkey"),
        "events": (table(spark, folder, "events"), "user_id")}, 17)
    return rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(
        F.col("row_json").contains(":17")).alias("with_key"))


def _workspace(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    ev = table(spark, folder, "events")
    who = F.col("user_id").cast("string")
    return {"users": ev.select(who.alias("user_id")).distinct(), "audit": _audit(spark, folder),
            "alerts": ev.where("event_type = 'error'").select("event_id", who.alias("created_by")),
            "reports": ev.groupBy(F.concat("event_type", F.to_date("ts").cast("string")).alias("report_id")).agg(F.sort_array(F.collect_set(
                F.concat(F.lit("user"), who, F.lit("@example.com")))).alias("recipients"))}


@query("member_erasure", """
SELECT 'users' AS table_name, count(DISTINCT user_id) - 1 AS n_rows, 0 AS cleared FROM events
UNION ALL SELECT 'audit', count(*), count(*) FILTER (user_id = 7) FROM events
UNION ALL SELECT 'alerts', count(*), count(*) FILTER (user_id = 7) FROM events WHERE event_type = 'error'
UNION ALL SELECT 'reports', count(DISTINCT event_type || ts::DATE), count(DISTINCT event_type || ts::DATE) FILTER (user_id = 7) FROM events""")
def member_erasure(spark: SparkSession, folder: str) -> DataFrame:
    before = _workspace(spark, folder)
    after = governance.erase_member(before, "7", "USER7@example.com")
    n = F.count(F.lit(1)).alias("n_rows")
    gone = F.count_if(F.size("recipients") < F.size("was")).alias("cleared")
    mail = before["reports"].select("report_id", F.col("recipients").alias("was")).join(after["reports"], "report_id")
    parts = {"users": after["users"].agg(n, F.lit(0).cast("long").alias("cleared")),
             "audit": after["audit"].agg(n, F.count_if(F.col("user_id") == "erased").alias("cleared")),
             "alerts": after["alerts"].agg(n, F.count_if(F.col("created_by").isNull()).alias("cleared")),
             "reports": mail.agg(n, gone)}
    out = None
    for name, row in parts.items():
        row = row.select(F.lit(name).alias("table_name"), "n_rows", "cleared")
        out = row if out is None else out.unionByName(row)
    return out


@query("workspace_erasure", """SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT 'events', count(*) FROM events WHERE event_type <> '1-URGENT'""")
def workspace_erasure(spark: SparkSession, folder: str) -> DataFrame:
    """A tenant's rows leave every table, and it is checked that none is left."""
    tabs = {"orders": table(spark, folder, "orders").withColumnRenamed("o_orderpriority", "workspace_id"),
            "events": table(spark, folder, "events").withColumnRenamed("event_type", "workspace_id")}
    left = governance.erase_workspace(tabs, "1-URGENT")
    governance.check_erased(left, "1-URGENT")
    return governance.survivors(left, F.lit(True))


# --------------------------------------------------------------- snapshots ---

_NAMES = ("nation", "customer", "orders", "events")


@query("snapshot_verify", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS expected, count(*) AS found, true AS ok FROM {n}" for n in _NAMES))
def snapshot_verify(spark: SparkSession, folder: str) -> DataFrame:
    target = fresh_folder(spark)
    snapshots.create(spark, {n: table(spark, folder, n) for n in _NAMES}, target)
    return snapshots.verify(spark, target)


@query("snapshot_restore", "SELECT o_orderstatus, count(*) AS n_rows, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def snapshot_restore(spark: SparkSession, folder: str) -> DataFrame:
    source, target = fresh_folder(spark), fresh_folder(spark)
    snapshots.create(spark, {"orders": table(spark, folder, "orders")}, source)
    snapshots.restore(spark, source, target)
    return rounded(spark.read.parquet(f"{target}/orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("value")))


@query("csv_round_trip", "SELECT c_mktsegment, count(*) AS n_rows, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Export, read back with inferred types, aggregate."""

    path = fresh_folder(spark)
    df = table(spark, folder, "customer")
    tables.write_csv(Dataset.open(df, [ColumnMeta(c, "ignored") for c in df.columns]), path)
    return rounded(tables.read_csv(spark, path).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("c_acctbal").alias("value")))


@query("clean_column_names", "SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS customers FROM customer")
def clean_column_names(spark: SparkSession, folder: str) -> DataFrame:
    """Headers with blanks, a leading digit and a repeat become usable names."""
    path = fresh_folder(spark)
    messy = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Cust Key!"), F.col("c_name").alias("2nd name"), F.col("c_mktsegment").alias("Cust-Key"))
    messy.write.option("header", True).csv(path)
    df = tables.read_csv(spark, path)
    return df.select("Cust_Key", "c_2nd_name", "Cust_Key_1").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("Cust_Key").alias("customers"))


@query("table_refresh", "SELECT count(*) AS n_rows, 'second' AS batch FROM customer WHERE c_acctbal > 0")
def table_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """A table is created from one snapshot of its source and replaced by the next."""
    path = fresh_folder(spark)
    df = table(spark, folder, "customer")
    versions.create(df, path, "first")
    versions.refresh(df.where("c_acctbal > 0"), path, "second")
    return versions.rows_of(spark, path).agg(F.count(F.lit(1)).alias("n_rows"), F.max("_batch").alias("batch"))


def _life(spark: SparkSession, folder: str) -> str:
    """A table of customers: created with half of them, one role overridden, all sent again as a file with one more
    column, refreshed with those in credit, and refreshed in vain."""
    path, df = fresh_folder(spark), table(spark, folder, "customer")
    versions.create(df.where("c_custkey % 2 = 0"), path, "b1", "even.csv", "customers")
    versions.override(spark, path, "c_nationkey", "dimension", "branch")
    versions.append(df.withColumn("in_debt", F.when(F.col("c_acctbal") < 0, "yes").otherwise("no")), path, "b2", "all.csv")
    versions.refresh(df.where("c_acctbal > 0"), path, "b3", "credit.csv")
    try:
        versions.refresh(df.where("c_custkey < 0"), path, "b4", "empty.csv")
    except AnalysisError:
        pass  # the table stays as it was
    return path


@query("table_versions", """WITH v AS (SELECT 1 AS version, 'initial' AS kind, 'b1' AS last_batch, c_custkey % 2 = 0 AS mine, c_acctbal, NULL AS debt FROM customer
  UNION ALL SELECT 2, 'override', 'b1', c_custkey % 2 = 0, c_acctbal, NULL FROM customer
  UNION ALL SELECT 3, 'append', 'b2', true, c_acctbal, CASE WHEN c_custkey % 2 = 1 THEN 1 END FROM customer
  UNION ALL SELECT 4, 'sync', 'b3', c_acctbal > 0, c_acctbal, NULL FROM customer)
SELECT version, kind, last_batch, count(*) AS n_rows, round(sum(c_acctbal), 2) AS value, count(debt) AS with_debt FROM v WHERE mine GROUP BY 1, 2, 3""")
def table_versions(spark: SparkSession, folder: str) -> DataFrame:
    """What every version of a table holds, read after all of them were made: the append adds the rows that are
    new, and readers of old versions are not disturbed."""
    path = _life(spark, folder)
    parts = []
    for version in range(1, versions.current(spark, path).version + 1):
        at, df = versions.current(spark, path, version), versions.rows_of(spark, path, version)
        debt = F.count("in_debt") if "in_debt" in df.columns else F.lit(0).cast("long")
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c_acctbal").alias("value"), debt.alias("with_debt")).select(
            F.lit(version).alias("version"), F.lit(at.kind).alias("kind"), F.lit(at.batches[-1]["batch_id"]).alias("last_batch"), "n_rows", "value", "with_debt"))
    return rounded(reduce(DataFrame.unionByName, parts))


@query("table_batches", """SELECT 'b3' AS batch_id, 'sync' AS mode, 'credit.csv' AS source, count(*) AS rows_added, count(*) AS rows_now
FROM customer WHERE c_acctbal > 0""")
def table_batches(spark: SparkSession, folder: str) -> DataFrame:
    """After a refresh only its own batch is left, and a failed one leaves none."""
    return versions.list_batches(spark, _life(spark, folder))


@query("table_roles", " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{role}' AS role, {sub} AS subtype, count(DISTINCT {c}) AS distinct_count, {own} AS overridden, NULL AS personal "
    "FROM customer WHERE c_acctbal > 0" for c, role, sub, own in (
        ("c_custkey", "ignored", "NULL", "false"), ("c_name", "ignored", "NULL", "false"), ("c_nationkey", "dimension", "'branch'", "true"),
        ("c_acctbal", "measure", "'count'", "false"), ("c_mktsegment", "dimension", "'business_unit'", "false"))))
def table_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Roles after a refresh: found again, except for the one that the user set."""
    return versions.roles(spark, _life(spark, folder))


@query("tables_restored", "SELECT table_name, version, n_rows, value FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, {v} AS version, count(*) AS n_rows, round(sum({c}), 2) AS value FROM {n}"
    for n, v, c in (("customer", 2, "c_acctbal"), ("orders", 1, "o_totalprice"))) + ")")
def tables_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables of a snapshot as new versions: one that has changed since, one that is gone."""
    source, paths = fresh_folder(spark), {"customer": fresh_folder(spark), "orders": fresh_folder(spark)}
    snapshots.create(spark, {n: table(spark, folder, n) for n in paths}, source)
    versions.create(table(spark, folder, "customer").where("c_acctbal > 9000"), paths["customer"], "b1")
    done = versions.restore(spark, source, paths, "b2")
    parts = [versions.rows_of(spark, paths[n]).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(c).alias("value")).select(
        F.lit(n).alias("table_name"), F.lit(done[n].version).alias("version"), "n_rows", "value") for n, c in (("customer", "c_acctbal"), ("orders", "o_totalprice"))]
    return rounded(parts[0].unionByName(parts[1]))


@query("text_files", r"""SELECT count(*) AS n_texts, sum(length(t)) AS n_chars, max(md5(t)) AS last_digest
FROM (SELECT regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g') AS t FROM documents)""")
def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as text files, one a line, and the files read back."""
    path = fresh_folder(spark)
    table(spark, folder, "documents").select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ").alias("value")).write.option(
        "maxRecordsPerFile", 200).text(path)
    lines = tables.read_texts(spark, f"{path}/*.txt").select(F.explode(F.split(F.regexp_replace("text", r"\n$", ""), r"\n")).alias("t"))
    return lines.agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.length("t")).alias("n_chars"), F.max(F.md5("t")).alias("last_digest"))
