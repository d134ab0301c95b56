"""Appending batches to a table, replacing periods, and taking batches back.

The functions return frames; nothing is collected.  Writers should partition
tables by the provenance column, so that a rollback drops one partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import periods
from tallyspark.model import BATCH_COLUMN, AnalysisError

#: A row's hash, stored with it where a table was written so.
HASH_COLUMN = "_row_hash"
#: Most 64-bit words of the Bloom filter of a new file: 2 MiB.
BLOOM_WORDS = 1 << 18
LOG_SCHEMA = ("batch_id string, mode string, rows_added long, rows_removed long, skipped_duplicates long, "
              "created_at timestamp")


@dataclass(frozen=True)
class Appended:
    table: DataFrame  # the new table
    added: DataFrame  # the rows that came in
    removed: DataFrame  # the rows a replaced period gave up, tagged ``replaced_by``
    mode: str
    new_columns: tuple[str, ...]
    missing_columns: tuple[str, ...]


def row_key(columns: Sequence[str]) -> Column:
    """A hash that tells rows apart even where values are missing."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def _user(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (BATCH_COLUMN, HASH_COLUMN)]


def stable_hash(columns: Sequence[str], df: DataFrame) -> Column:
    """A row hash that the order of columns does not change, nor a new column that is null on old rows,
    so that it can be stored in ``HASH_COLUMN`` with the row."""
    out = F.lit(0).cast("long")
    for c in columns:
        value = F.col(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            value = value + F.lit(0.0).cast(df.schema[c].dataType)  # -0.0 is 0.0
        out = out.bitwiseXOR(F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), value)).otherwise(F.lit(0).cast("long")))
    return out


def _mask(h: Column) -> Column:
    """Three bits of a 64-bit word."""
    bit = F.lit(1).cast("long")
    return F.call_function("shiftleft", bit, F.pmod(F.shiftrightunsigned(h, 20), F.lit(64)).cast("int")).bitwiseOR(
        F.call_function("shiftleft", bit, F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int"))).bitwiseOR(
        F.call_function("shiftleft", bit, F.pmod(F.shiftrightunsigned(h, 44), F.lit(64)).cast("int")))


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(words))


def maybe_in(table: DataFrame, hashed: str, keys: DataFrame, key: str, n_keys: int) -> DataFrame:
    """The rows of ``table`` whose hash may be among ``keys``: a Bloom filter of 16 bits a key in 64-bit words, at most
    ``BLOOM_WORDS`` words (beyond that it lets more through, never fewer), joined by broadcast, so no row moves."""
    words = min(BLOOM_WORDS, max(64, 1 << max(0, n_keys // 4).bit_length()))
    bits = keys.groupBy(_word(F.col(key), words).alias("_word")).agg(F.bit_or(_mask(F.col(key))).alias("_bits"))
    mask = _mask(F.col(hashed))
    return table.withColumn("_word", _word(F.col(hashed), words)).join(F.broadcast(bits), "_word").where(
        F.col("_bits").bitwiseAND(mask) == mask).drop("_word", "_bits")


def _within(table: DataFrame, date: str, lo: object, hi: object, nulls: bool) -> DataFrame:
    """Rows that the dates ``lo`` to ``hi`` (and null, if asked) can equal, as literals that prune the scan."""
    kind = table.schema[date].dataType
    span = F.lit(False) if lo is None else F.col(date).between(F.lit(lo).cast(kind), F.lit(hi).cast(kind))
    return table.where((span | F.col(date).isNull()) if nulls else span)


def known_rows(table: DataFrame, aligned: DataFrame, date: str | None = None) -> DataFrame:
    """The distinct rows of ``table`` (columns with a leading ``_``, and ``_hash``) that rows of ``aligned``, which
    has the table's columns and their ``_hash``, may equal.  Nothing of the history moves before the date span and
    the Bloom filter have cut it; the rows that move are about those that are equal."""
    old = _user(table)
    about = [F.count(F.lit(1)).alias("n")]
    if date is not None:
        about += [F.min(date).alias("lo"), F.max(date).alias("hi"), (F.count(F.lit(1)) - F.count(date)).alias("nulls")]
    row = aligned.agg(*about).first()  # one row
    part = table if date is None else _within(table, date, row["lo"], row["hi"], row["nulls"] > 0)
    stored = F.col(HASH_COLUMN) if HASH_COLUMN in table.columns else stable_hash(old, table)
    hashed = part.select(*old, stored.alias("_hash"))
    few = maybe_in(hashed, "_hash", aligned.select(F.col("_hash").alias("_key")), "_key", row["n"])
    return few.select(*[F.col(c).alias(f"_{c}") for c in old], "_hash").distinct()


def append(table: DataFrame, incoming: DataFrame, batch_id: str, date: str | None = None) -> Appended:
    """Add the rows of ``incoming`` that the table does not have yet.

    Rows are compared on the table's own columns, nulls being equal; repeats
    inside the new file are kept.  New columns widen the table; missing ones are null.
    ``date`` names a column whose span in the new file bounds the part of the table that is looked at.
    A table with ``HASH_COLUMN`` is not hashed again, and the new rows get theirs."""
    old, new = _user(table), _user(incoming)
    if not set(old) & set(new):
        raise AnalysisError("this file shares no columns with the dataset")
    extra = tuple(c for c in new if c not in old)
    missing = tuple(c for c in old if c not in new)
    aligned = incoming.select(*[
        (F.col(c).cast(table.schema[c].dataType) if c in new else F.lit(None).cast(table.schema[c].dataType)).alias(c)
        for c in old], *extra)
    hashed = aligned.withColumn("_hash", stable_hash(old, aligned))
    known = known_rows(table, hashed, date if date in old else None).withColumnRenamed("_hash", "_known")
    same = F.col("_hash") == F.col("_known")
    for c in old:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    added = hashed.join(known, same, "left_anti").drop("_hash").withColumn(BATCH_COLUMN, F.lit(batch_id))
    if HASH_COLUMN in table.columns:
        added = added.withColumn(HASH_COLUMN, stable_hash([*old, *extra], added))
    base = table if BATCH_COLUMN in table.columns else table.withColumn(BATCH_COLUMN, F.lit(None).cast("string"))
    nothing = base.where(F.lit(False)).withColumn("replaced_by", F.lit(batch_id))
    return Appended(base.unionByName(added, allowMissingColumns=True), added, nothing, "append", extra, missing)


def replace_period(table: DataFrame, incoming: DataFrame, batch_id: str, date: str | None) -> Appended:
    """Replace the months that the new file covers; undated rows stay.  Without
    a date column this is a plain append."""
    if date is None or date not in incoming.columns:
        return append(table, incoming, batch_id)
    old, new = _user(table), _user(incoming)
    extra = tuple(c for c in new if c not in old)
    missing = tuple(c for c in old if c not in new)

    def month(df: DataFrame) -> Column:
        typed = F.col(date)
        if dict(df.dtypes)[date] == "string":
            typed = periods.tolerant_timestamp(typed)
        return periods.key(typed, "month")

    span = incoming.agg(F.min(month(incoming)).alias("lo"), F.max(month(incoming)).alias("hi")).first()  # one row
    base = table if BATCH_COLUMN in table.columns else table.withColumn(BATCH_COLUMN, F.lit(None).cast("string"))
    inside = F.lit(False) if span["lo"] is None else F.coalesce(
        month(table).between(F.lit(span["lo"]), F.lit(span["hi"])), F.lit(False))
    added = incoming.select(*[
        (F.col(c).cast(table.schema[c].dataType) if c in new else F.lit(None).cast(table.schema[c].dataType)).alias(c)
        for c in old], *extra).withColumn(BATCH_COLUMN, F.lit(batch_id))
    removed = base.where(inside).withColumn("replaced_by", F.lit(batch_id))
    return Appended(base.where(~inside).unionByName(added, allowMissingColumns=True), added, removed, "replace_period",
                    extra, missing)


def rollback(table: DataFrame, archive: DataFrame, batch_id: str, restored_as: str) -> DataFrame:
    """Drop a batch and bring back what it replaced.  A row without provenance
    (a rebuilt join) is nobody's batch and stays."""
    kept = table.where(~F.col(BATCH_COLUMN).eqNullSafe(F.lit(batch_id)))
    back = archive.where(F.col("replaced_by") == batch_id).drop("replaced_by", BATCH_COLUMN).withColumn(
        BATCH_COLUMN, F.lit(restored_as))
    return kept.unionByName(back, allowMissingColumns=True)


def batch_log(incoming: DataFrame, result: Appended, batch_id: str) -> DataFrame:
    """The facts of one append as a row: rows in, out and skipped."""
    n = F.count(F.lit(1))
    skipped = F.col("total") - F.col("rows_added")
    row = result.added.agg(n.alias("rows_added")).withColumn(
        "rows_removed", result.removed.agg(n).scalar()).withColumn("total", incoming.agg(n).scalar())
    return row.select(F.lit(batch_id).alias("batch_id"), F.lit(result.mode).alias("mode"), "rows_added", "rows_removed",
                      (skipped if result.mode == "append" else F.lit(0).cast("long")).alias("skipped_duplicates"),
                      F.current_timestamp().alias("created_at"))


def list_batches(table: DataFrame, log: DataFrame) -> DataFrame:
    """Batches, newest first, with the rows that are still in the table."""
    held = table.groupBy(F.col(BATCH_COLUMN).alias("batch_id")).agg(F.count(F.lit(1)).alias("rows_now"))
    return log.join(held, "batch_id", "left").withColumn("rows_now", F.coalesce("rows_now", F.lit(0))).orderBy(
        F.desc("created_at"), "batch_id")


def as_json(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Archived rows as JSON text, nulls spelled out."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row_json"))


def from_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("row_json", schema).alias("r")).select("r.*")
