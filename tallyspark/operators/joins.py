"""Joining two datasets, and finding the keys to join them on."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import clean_name, distinct_names
from tallyspark.model import AnalysisError, Dataset
from tallyspark.sources import versions

JOIN_TYPES = ("inner", "left")


def join(left: Dataset, right: Dataset, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Equi-join; the right key is dropped and a right column whose name is taken
    becomes ``<right>_<name>``.  Both sides are the readers' secured frames.

    No hint: adaptive execution broadcasts a side it has measured to be small and
    splits skewed partitions of the other."""
    if left_key not in left.user_columns:
        raise AnalysisError(f"{left_key!r} is not a column of the left dataset")
    if right_key not in right.user_columns:
        raise AnalysisError(f"{right_key!r} is not a column of the right dataset")
    how = how if how in JOIN_TYPES else "left"
    taken = set(left.user_columns)
    slug = clean_name(right.name) or "right"
    theirs_in = [c for c in right.user_columns if c != right_key]
    names = distinct_names([clean_name(f"{slug}_{c}") if c in taken else c for c in theirs_in], taken)
    others = [F.col(f"r.{c}").alias(n) for c, n in zip(theirs_in, names, strict=True)]
    theirs, wanted = F.col(f"r.{right_key}"), left.frame.schema[left_key].dataType
    if right.frame.schema[right_key].dataType != wanted:
        theirs = theirs.try_cast(wanted)
    on = F.col(f"l.{left_key}") == theirs
    return left.frame.alias("l").join(right.frame.alias("r"), on, how).select(
        *[F.col(f"l.{c}") for c in left.user_columns], *others)


def suggest_keys(left: Dataset, right: Dataset) -> list[str]:
    """Shared column names, those that look like identifiers first."""
    shared = [c for c in left.user_columns if c in set(right.user_columns)]
    return sorted(shared, key=lambda c: not (c.lower().endswith("_id") or c.lower() == "id"))


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """How many distinct left keys the right side has: evidence for a join key.
    Keys are made distinct before they meet, so a hot key is one row."""
    lk = left.select(F.col(left_key).alias("k")).where("k is not null").distinct()
    rk = right.select(F.col(right_key).alias("k")).where("k is not null").distinct().withColumn("hit", F.lit(1))
    row = lk.join(rk, "k", "left").agg(F.count("k").alias("left_keys"), F.count("hit").alias("matched_keys"))
    return row.withColumn("overlap", F.try_divide("matched_keys", "left_keys"))


def locate(breakdown: DataFrame, places: DataFrame, name: str = "member") -> DataFrame:
    """Coordinates for the members that a table of places knows (``place``,
    ``lng``, ``lat``), matched without case or outer blanks."""
    return breakdown.join(places.withColumnRenamed("place", "_place"),
                          F.lower(F.trim(F.col(name))) == F.col("_place"), "left").drop("_place")


def mappable_share(located: DataFrame) -> DataFrame:
    return located.agg(F.coalesce(F.avg(F.col("lng").isNotNull().cast("double")), F.lit(0.0)).alias("mappable"))


# ------------------------------------------------------- recorded joins ---

def recorded_join(spark: SparkSession, left: str, right: str, left_key: str, right_key: str, how: str, path: str, batch_id: str,
                  name: str | None = None) -> versions.Version:
    """The join of two versioned tables as a table of its own, with the record of what it was made from.
    An empty join is refused and leaves what was there."""
    sides = {side: versions.current(spark, at) for side, at in (("left", left), ("right", right))}
    how = how if how in JOIN_TYPES else "left"
    record = {"left": left, "right": right, "left_key": left_key, "right_key": right_key, "how": how,
              "versions": {side: v.version for side, v in sides.items()}}
    rows = join(versions.opened(spark, left)[0], versions.opened(spark, right)[0], left_key, right_key, how)
    try:
        before = versions.current(spark, path)
    except AnalysisError:
        before = None
    label = before.name if before else (name or "").strip() or f"{sides['left'].name} + {sides['right'].name}"
    try:
        return versions.publish(rows, path, batch_id, "join", "join", label, before, json.dumps(record))
    except AnalysisError as problem:
        raise AnalysisError("the join produced no rows: check the join keys") from problem


def _record(spark: SparkSession, path: str) -> dict:
    lineage = versions.current(spark, path).lineage
    if lineage is None:
        raise AnalysisError(f"{path} is not a join")
    return json.loads(lineage)


def is_stale(spark: SparkSession, path: str) -> bool:
    """Whether a source has another version now than when the join was made."""
    record = _record(spark, path)
    return any(versions.current(spark, record[side]).version != record["versions"][side] for side in ("left", "right"))


def rebuild(spark: SparkSession, path: str, batch_id: str) -> versions.Version:
    """The join again from its sources as they are now, under the same path and name."""
    record = _record(spark, path)
    return recorded_join(spark, *[record[k] for k in ("left", "right", "left_key", "right_key", "how")], path, batch_id)


def relations(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row for each recorded join among the tables at ``paths``."""
    out = []
    for path in paths:
        at = versions.current(spark, path)
        if at.lineage is not None:
            record = json.loads(at.lineage)
            out.append((path, at.name, at.n_rows, *[versions.current(spark, record[side]).name for side in ("left", "right")],
                        *[record[k] for k in ("left_key", "right_key", "how")], is_stale(spark, path)))
    return spark.createDataFrame(out, "path string, name string, n_rows long, left_name string, right_name string, left_key string, "
                                      "right_key string, how string, stale boolean")
