"""Tables kept in versions: written and checked first, then switched to.

A version is a list of data folders and one row of the table's log, with the roles of
its columns, what the user overrode, the masking policy and the batch.  The log row is
one Parquet file whose commit is the switch: until then readers see the version before,
afterwards those that hold the old version still find its folders.  One writer at a
time: a second that wants the same number is refused.

* ``create``: first load; clean names, roles, personal data, the first batch.
* ``append``: one more folder with the rows that are new; nothing is rewritten.
* ``refresh``: a new full snapshot; roles are found again, overrides and policies of columns that are
  still there are kept, earlier batches and archived rows are no longer referred to.
* ``override``, ``go_back`` and ``restore`` (from a snapshot of several tables, all staged and checked
  before the first is switched) are new rows of the log.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.text import clean_names
from tallyspark.model import BATCH_COLUMN, AnalysisError, ColumnMeta, Dataset
from tallyspark.operators import profile
from tallyspark.sources import batches, snapshots

COLUMN = "struct<name: string, role: string, subtype: string, distinct_count: bigint, overridden: boolean, personal: string>"
BATCH = "struct<batch_id: string, mode: string, source: string, rows_added: bigint>"
LOG = (f"version long, kind string, name string, folders array<string>, schema string, n_rows long, columns array<{COLUMN}>, "
       f"batches array<{BATCH}>, lineage string, created_at timestamp")


@dataclass(frozen=True)
class Version:
    """One row of the log."""

    version: int
    kind: str
    name: str
    folders: tuple[str, ...]
    schema: T.StructType
    n_rows: int
    columns: tuple[Row, ...]
    batches: tuple[Row, ...]
    lineage: str | None = None


def log(spark: SparkSession, path: str) -> DataFrame:
    """Every version of a table."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/_log/*")
    except AnalysisException as problem:
        raise AnalysisError(f"{path} holds no table") from problem


def current(spark: SparkSession, path: str, version: int | None = None) -> Version:
    """The latest version, or an earlier one."""
    rows = log(spark, path)
    row = rows.where(F.col("version") == version).first() if version is not None else rows.orderBy(F.desc("version")).first()
    if row is None:
        raise AnalysisError(f"{path} has no version {version}")
    return Version(row["version"], row["kind"], row["name"], tuple(row["folders"]), T.StructType.fromJson(json.loads(row["schema"])), row["n_rows"],
                   tuple(row["columns"]), tuple(row["batches"]), row["lineage"])


def rows_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows of a version with the column that tells their batch; later columns are null on older rows."""
    at = current(spark, path, version)
    return spark.read.schema(at.schema).parquet(*at.folders)


def opened(spark: SparkSession, path: str, version: int | None = None) -> tuple[Dataset, dict[str, str]]:
    """A version as a dataset with its roles, and its masking policy."""
    at = current(spark, path, version)
    metas = [ColumnMeta(c["name"], c["role"], c["subtype"], c["distinct_count"]) for c in at.columns]
    return Dataset.open(rows_of(spark, path, at.version), metas, at.name), {c["name"]: c["personal"] for c in at.columns if c["personal"]}


def roles(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.createDataFrame(list(current(spark, path, version).columns), COLUMN[7:-1])


def list_batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches of the current version, and the rows of each that it holds."""
    known = spark.createDataFrame(list(current(spark, path).batches), BATCH[7:-1])
    held = rows_of(spark, path).groupBy(F.col(BATCH_COLUMN).alias("batch_id")).agg(F.count(F.lit(1)).alias("rows_now"))
    return known.join(held, "batch_id", "left").withColumn("rows_now", F.coalesce("rows_now", F.lit(0)))


# ------------------------------------------------------------ writing ---

def _staged(df: DataFrame, path: str, batch_id: str) -> tuple[str, T.StructType, int]:
    """Rows written to a folder that no version names yet: the folder, its schema, its rows as read back."""
    folder = f"{path}/data-{uuid.uuid4().hex}"
    tagged = df if BATCH_COLUMN in df.columns else df.withColumn(BATCH_COLUMN, F.lit(batch_id))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in tagged.schema.fields])
    tagged.write.mode("error").parquet(folder)
    return folder, schema, df.sparkSession.read.schema(schema).parquet(folder).count()


def _switch(spark: SparkSession, path: str, to: Version) -> Version:
    """The log row that makes ``to`` the current version; its number must be free."""
    row = (to.version, to.kind, to.name, list(to.folders), to.schema.json(), to.n_rows, list(to.columns), list(to.batches), to.lineage)
    frame = spark.createDataFrame([row], LOG.rsplit(", ", 1)[0]).withColumn("created_at", F.current_timestamp())
    try:
        frame.coalesce(1).write.mode("error").parquet(f"{path}/_log/{to.version:012d}")
    except AnalysisException as problem:
        raise AnalysisError(f"{path} was changed by another writer") from problem
    return to


def _columns(df: DataFrame, kept: Mapping[str, Row]) -> list[Row]:
    """Roles and personal data of the columns of ``df``; ``kept`` are those of the version before."""
    ds, personal = profile.open_profiled(df)
    out = []
    for c in ds.columns:
        old = kept.get(c.name)
        mine = old is not None and old["overridden"]
        out.append(Row(name=c.name, role=old["role"] if mine else c.role, subtype=old["subtype"] if mine else c.subtype,
                       distinct_count=c.distinct_count, overridden=mine, personal=(old["personal"] if old else None) or personal.get(c.name)))
    return out


def publish(df: DataFrame, path: str, batch_id: str, kind: str, source: str, name: str, before: Version | None = None,
            lineage: str | None = None) -> Version:
    """``df`` as the whole of the next version.  Nothing is switched to unless it was written and has rows."""
    clean = df.drop(BATCH_COLUMN).toDF(*clean_names([c for c in df.columns if c != BATCH_COLUMN]))
    spark = df.sparkSession
    folder, schema, n = _staged(clean, path, batch_id)
    if not n:
        raise AnalysisError("no data rows")
    stored = spark.read.schema(schema).parquet(folder)
    columns = _columns(stored.drop(BATCH_COLUMN), {c["name"]: c for c in before.columns} if before else {})
    return _switch(spark, path, Version(before.version + 1 if before else 1, kind, name, (folder,), schema, n, tuple(columns),
                                        (Row(batch_id=batch_id, mode=kind, source=source, rows_added=n),), lineage))


def create(df: DataFrame, path: str, batch_id: str, source: str = "", name: str = "dataset") -> Version:
    return publish(df, path, batch_id, "initial", source, name)


def refresh(incoming: DataFrame, path: str, batch_id: str, source: str = "") -> Version:
    """All rows replaced by a new full snapshot of their source."""
    before = current(incoming.sparkSession, path)
    return publish(incoming, path, batch_id, "sync", source, before.name, before)


def append(incoming: DataFrame, path: str, batch_id: str, source: str = "") -> Version:
    """The rows of ``incoming`` that the table does not have, as one more folder."""
    spark = incoming.sparkSession
    before = current(spark, path)
    clean = incoming.toDF(*clean_names(incoming.columns))
    date = next((c["name"] for c in before.columns if c["role"] == "date"), None)
    added = batches.append(rows_of(spark, path), clean, batch_id, date)
    folder, schema, n = _staged(added.added, path, batch_id)
    known = {f.name for f in before.schema.fields}
    wider = T.StructType([*before.schema.fields, *[f for f in schema.fields if f.name not in known]])
    columns = list(before.columns)
    if added.new_columns:
        columns += _columns(spark.read.schema(schema).parquet(folder).select(*added.new_columns), {})
    return _switch(spark, path, replace(
        before, version=before.version + 1, kind="append", folders=(*before.folders, folder), schema=wider, n_rows=before.n_rows + n, columns=tuple(columns),
        batches=(*before.batches, Row(batch_id=batch_id, mode="append", source=source, rows_added=n))))


def override(spark: SparkSession, path: str, column: str, role: str, subtype: str | None = None) -> Version:
    """The user's own role for a column; it outlasts refreshes."""
    before = current(spark, path)
    if column not in [c["name"] for c in before.columns]:
        raise AnalysisError(f"no such column: {column}")
    if role not in ("measure", "dimension", "date", "ignored"):
        raise AnalysisError(f"unknown role {role!r}")
    columns = [Row(**{**c.asDict(), "role": role, "subtype": subtype, "overridden": True}) if c["name"] == column else c for c in before.columns]
    return _switch(spark, path, replace(before, version=before.version + 1, kind="override", columns=tuple(columns)))


def go_back(spark: SparkSession, path: str, version: int) -> Version:
    """An earlier version made the current one again."""
    return _switch(spark, path, replace(current(spark, path, version), version=current(spark, path).version + 1, kind="go_back"))


def restore(spark: SparkSession, snapshot: str, paths: Mapping[str, str], batch_id: str) -> dict[str, Version]:
    """Tables of a snapshot as new versions of the tables at ``paths``.

    Every table is read by the manifest's schema, staged and counted before the first is switched to: a failure
    until then leaves all tables as they were."""
    snapshots.checked(spark, snapshot, list(paths))
    expected = {r["table_name"]: r for r in snapshots.manifest(spark, snapshot).collect()}  # one row per table
    ready = {}
    for name, path in paths.items():
        df = spark.read.schema(T.StructType.fromJson(json.loads(expected[name]["schema"]))).parquet(f"{snapshot}/{name}")
        try:
            before = current(spark, path)
        except AnalysisError:
            before = None
        folder, schema, n = _staged(df, path, batch_id)
        if n != expected[name]["n_rows"]:
            raise AnalysisError(f"{name} does not have the snapshot's row count")
        columns = _columns(df.drop(BATCH_COLUMN), {c["name"]: c for c in before.columns} if before else {})
        ready[name] = path, Version(before.version + 1 if before else 1, "restore", before.name if before else name, (folder,), schema, n, tuple(columns),
                                    (Row(batch_id=batch_id, mode="restore", source=snapshot, rows_added=n),))
    return {name: _switch(spark, path, to) for name, (path, to) in ready.items()}


def vacuum(spark: SparkSession, path: str, keep: Sequence[int] = ()) -> list[str]:
    """Deletes data folders that neither the current version nor those of ``keep`` name; returns them."""
    held = {f.rsplit("/", 1)[-1] for v in {current(spark, path).version, *keep} for f in current(spark, path, v).folders}
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(there) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in held]
    for folder in gone:
        fs.delete(folder, True)
    return sorted(f.getName() for f in gone)
