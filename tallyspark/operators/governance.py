"""Retention, subject access and erasure as jobs over a workspace's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.model import AnalysisError

FLOOR_DAYS = {"audit": 7, "archive": 7, "dataset": 30}
# Columns that never leave with an export.
SECRET_COLUMNS = ("password_hash", "mfa_secret", "key_hash", "recovery_codes")


@dataclass(frozen=True)
class Policy:
    """Days to keep; 0 keeps forever."""

    audit_days: int = 0
    archive_days: int = 0
    dataset_days: int = 0

    def __post_init__(self) -> None:
        for kind, floor in FLOOR_DAYS.items():
            days = getattr(self, f"{kind}_days")
            if not isinstance(days, int) or isinstance(days, bool):
                raise AnalysisError(f"{kind} retention must be a whole number of days")
            if days < 0 or 0 < days < floor:
                raise AnalysisError(f"{kind} retention must be 0 or at least {floor} days")

    def cutoff(self, kind: str, now: dt.datetime) -> dt.datetime | None:
        days = getattr(self, f"{kind}_days")
        return now - dt.timedelta(days=days) if days else None


def expired(rows: DataFrame, ts: str, cutoff: dt.datetime | None) -> DataFrame:
    if cutoff is None:
        return rows.where(F.lit(False))
    return rows.where(F.col(ts) < F.lit(cutoff).cast(rows.schema[ts].dataType))


def kept(rows: DataFrame, ts: str, cutoff: dt.datetime | None) -> DataFrame:
    if cutoff is None:
        return rows
    return rows.where(F.coalesce(F.col(ts) >= F.lit(cutoff).cast(rows.schema[ts].dataType), F.lit(True)))


def retention_preview(policy: Policy, now: dt.datetime, audit: DataFrame, archive: DataFrame, batches: DataFrame,
                      datasets: DataFrame) -> DataFrame:
    """``category``, ``n_rows``: what a sweep would remove.  ``audit`` has ``ts``,
    ``batches`` has ``batch_id`` and ``created_at``, ``archive`` has ``batch_id``,
    ``datasets`` has ``ingested_at``."""
    old = expired(batches, "created_at", policy.cutoff("archive", now)).select("batch_id").distinct()
    parts = {"audit_entries": expired(audit, "ts", policy.cutoff("audit", now)),
             "archived_rows": archive.join(old, "batch_id", "left_semi"),
             "datasets": expired(datasets, "ingested_at", policy.cutoff("dataset", now))}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("category"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


def retention_preview_by_workspace(rows: DataFrame, ts: str, policies: DataFrame, now: dt.datetime) -> DataFrame:
    """Expired rows of every workspace under its own policy (``workspace_id``, ``days``)."""
    age = F.datediff(F.lit(now.date()), F.col(ts).cast("date"))
    counted = rows.groupBy("workspace_id", age.alias("age")).agg(F.count(F.lit(1)).alias("n"))
    live = policies.where("days > 0")
    return counted.join(live, "workspace_id").where("age > days").groupBy("workspace_id").agg(
        F.sum("n").alias("expired_rows"))


def retention_sweep(policy: Policy, now: dt.datetime, audit: DataFrame, archive: DataFrame, batches: DataFrame,
                    datasets: DataFrame, dependents: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as they are after a sweep.  Datasets go first, with everything
    that hangs off them; the sweep's own audit row is added and survives."""
    gone = expired(datasets, "ingested_at", policy.cutoff("dataset", now)).select("dataset_id").distinct()
    out = {name: df.join(gone, "dataset_id", "left_anti") for name, df in dependents.items()}
    out["datasets"] = datasets.join(gone, "dataset_id", "left_anti")
    live_batches = batches.join(gone, "dataset_id", "left_anti")
    old = expired(live_batches, "created_at", policy.cutoff("archive", now)).select("batch_id").distinct()
    out["batches"] = live_batches
    out["archive"] = archive.join(gone, "dataset_id", "left_anti").join(old, "batch_id", "left_anti")
    preview = retention_preview(policy, now, audit, archive, batches, datasets)
    note = preview.agg(F.sum("n_rows").alias("n"), F.array_join(F.sort_array(F.collect_list(
        F.concat_ws("=", "category", F.col("n_rows").cast("string")))), " ").alias("detail")).where("n > 0").select(
        F.lit(now).cast(audit.schema["ts"].dataType).alias("ts"), F.lit("retention").alias("user_id"),
        F.lit("retention_sweep").alias("action"), "detail")
    out["audit"] = kept(audit, "ts", policy.cutoff("audit", now)).unionByName(note, allowMissingColumns=True)
    return out


def _json(df: DataFrame, table: str) -> DataFrame:
    shown = [c for c in df.columns if c not in SECRET_COLUMNS]
    return df.select(F.lit(table).alias("table_name"),
                     F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("row_json"))


def export_subject(tables: Mapping[str, tuple[DataFrame, str]], subject: object) -> DataFrame:
    """Everything held about one subject: per table, the column that names it."""
    out = None
    for name, (df, key) in tables.items():
        part = _json(df.where(F.col(key) == F.lit(subject)), name)
        out = part if out is None else out.unionByName(part)
    return out


def erase_member(tables: Mapping[str, DataFrame], user_id: str, email: str) -> dict[str, DataFrame]:
    """The tables without one member: keyed rows go, authorship becomes null,
    the audit trail keeps its rows under another name, mailing lists lose the address.

    Recognised by column: ``users``/``rules``/``api_keys`` rows are deleted, ``created_by`` is
    cleared, ``audit`` is de-identified, ``recipients`` arrays are filtered."""
    out = {}
    for name, df in tables.items():
        if name in ("users", "rules"):
            df = df.where(F.coalesce(F.col("user_id") != user_id, F.lit(True)))
        elif name == "api_keys":
            df = df.where(F.coalesce(F.col("created_by") != user_id, F.lit(True)))
        elif name == "audit":
            df = df.withColumn("user_id", F.when(F.col("user_id") == user_id, F.lit("erased")).otherwise(
                F.col("user_id")))
        elif "created_by" in df.columns:
            df = df.withColumn("created_by", F.when(F.col("created_by") != user_id, F.col("created_by")))
        if "recipients" in df.columns:
            df = df.withColumn("recipients", F.filter("recipients", lambda r: F.lower(r) != email.lower()))
        out[name] = df
    return out


def erase_workspace(tables: Mapping[str, DataFrame], workspace_id: str) -> dict[str, DataFrame]:
    return {name: df.where(F.coalesce(F.col("workspace_id") != workspace_id, F.lit(True)))
            for name, df in tables.items()}


def survivors(tables: Mapping[str, DataFrame], gone: Column) -> DataFrame:
    """Rows that should have been erased and were not, per table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count_if(gone).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out.where("n_rows > 0")


def check_erased(tables: Mapping[str, DataFrame], workspace_id: str) -> None:
    """Never claim an erasure that did not happen."""
    left = [f"{r['table_name']} ({r['n_rows']})" for r in survivors(
        tables, F.col("workspace_id") == workspace_id).collect()]  # one row per table
    if left:
        raise AnalysisError(f"erasure incomplete, rows remain in: {', '.join(left)}")


def redact_log(rows: DataFrame, message: str, attributes: str | None = None) -> DataFrame:
    """Log rows with bearer tokens and credential-like attributes hidden."""
    out = rows.withColumn(message, text.redact_text(F.col(message)))
    return out.withColumn(attributes, text.redact(F.col(attributes), rows.schema[attributes].dataType)) if attributes else out
