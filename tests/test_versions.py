"""Versioned tables and recorded joins."""
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyspark.model import AnalysisError
from tallyspark.operators import joins
from tallyspark.sources import snapshots, versions

SALES = "Day string, `Branch Name` string, revenue long, email string"


@pytest.fixture
def sales(spark):
    def make(n, start=0):
        return spark.createDataFrame([(f"2025-0{1 + i % 3}-1{i % 9}", ["North", "South"][i % 2], 100 * i, f"p{i}@acme.com") for i in range(start, start + n)], SALES)
    return make


def test_first_load_in_one_step(spark, sales, tmp_path):
    path = str(tmp_path / "t")
    at = versions.create(sales(30), path, "b1", "jan.csv", "sales")
    assert (at.version, at.n_rows, at.kind) == (1, 30, "initial")
    ds, personal = versions.opened(spark, path)
    assert personal == {"email": "email"} and ds.date_column == "Day" and list(ds.measures) == ["revenue"] and ds.name == "sales"
    assert "Branch_Name" in ds.dimensions and rows(versions.list_batches(spark, path)) == [("b1", "initial", "jan.csv", 30, 30)]
    with pytest.raises(AnalysisError):
        versions.create(sales(0), str(tmp_path / "none"), "b1")
    with pytest.raises(AnalysisError):
        versions.current(spark, str(tmp_path / "none"))
    with pytest.raises(AnalysisError):
        versions.create(sales(3), path, "b2")  # the first version is there


def test_refresh_keeps_overrides_and_drops_batches(spark, sales, tmp_path):
    path = str(tmp_path / "t")
    versions.create(sales(30), path, "b1")
    versions.override(spark, path, "revenue", "dimension", "generic")
    versions.append(sales(40), path, "b2", "more.csv")
    assert versions.current(spark, path).n_rows == 40 and [b["rows_added"] for b in versions.current(spark, path).batches] == [30, 10]
    held = versions.rows_of(spark, path)  # a reader of the version before
    fresh = sales(25, 100).withColumn("units", F.lit(3.5)).withColumn("email", F.lit("none"))
    versions.refresh(fresh, path, "b3", "full.csv")
    assert held.count() == 40
    ds, personal = versions.opened(spark, path)
    found = {r["name"]: (r["role"], r["overridden"]) for r in versions.roles(spark, path).collect()}
    assert found["revenue"] == ("dimension", True) and found["units"][0] == "measure" and not found["units"][1]
    assert personal == {"email": "email"}  # the policy of a column outlasts a refresh
    assert rows(versions.list_batches(spark, path), "batch_id", "mode", "rows_now") == [("b3", "sync", 25)]
    before = versions.current(spark, path)
    for bad in (sales(0), sales(5).withColumn("revenue", F.raise_error(F.lit("the source broke")).cast("long"))):
        with pytest.raises(Exception, match="no data rows|the source broke"):
            versions.refresh(bad, path, "b4")
        assert versions.current(spark, path) == before and versions.rows_of(spark, path).count() == 25
    versions.go_back(spark, path, 3)
    assert versions.rows_of(spark, path).count() == 40 and versions.current(spark, path).version == 5
    with pytest.raises(AnalysisError):
        versions.override(spark, path, "gone", "measure")


def test_refresh_from_the_table_itself(spark, sales, tmp_path):
    path = str(tmp_path / "t")
    versions.create(sales(30), path, "b1")
    versions.refresh(versions.rows_of(spark, path).where("revenue >= 1000"), path, "b2")
    assert rows(versions.rows_of(spark, path).groupBy("_batch").count()) == [("b2", 20)]


def test_append_widens_and_a_second_writer_is_refused(spark, sales, tmp_path):
    path = str(tmp_path / "t")
    versions.create(sales(6), path, "b1")
    stale = versions.current(spark, path)
    versions.append(sales(8).withColumn("cost", F.lit(5)), path, "b2")
    assert sorted(rows(versions.rows_of(spark, path).groupBy("_batch").agg(F.count("*"), F.count("cost")))) == [("b1", 6, 0), ("b2", 2, 2)]
    assert "cost" in versions.opened(spark, path)[0].user_columns
    with pytest.raises(AnalysisError, match="another writer"):
        versions._switch(spark, path, versions.replace(stale, version=2))
    assert versions.vacuum(spark, path) == []
    versions.refresh(sales(3), path, "b3")
    assert len(versions.vacuum(spark, path, keep=[1])) == 1 and versions.rows_of(spark, path, 1).count() == 6


def test_restore_switches_all_tables_or_none(spark, sales, tmp_path):
    snap, paths = str(tmp_path / "snap"), {n: str(tmp_path / n) for n in ("one", "two")}
    snapshots.create(spark, {"one": sales(9).toDF("day", "branch", "revenue", "email"), "two": spark.range(4)}, snap)
    versions.create(spark.range(2), paths["two"], "b1")
    with pytest.raises(AnalysisError):
        versions.restore(spark, snap, {**paths, "three": str(tmp_path / "three")}, "b2")
    done = versions.restore(spark, snap, paths, "b2")
    assert {n: (v.version, v.n_rows) for n, v in done.items()} == {"one": (1, 9), "two": (2, 4)}
    spark.range(3).write.mode("overwrite").parquet(f"{snap}/two")
    with pytest.raises(AnalysisError):
        versions.restore(spark, snap, paths, "b3")
    assert versions.current(spark, paths["one"]).version == 1


def test_recorded_joins(spark, tmp_path):
    left, right, path = (str(tmp_path / n) for n in ("orders", "customers", "joined"))
    versions.create(spark.createDataFrame([(1, "c1", 100), (2, "c2", 200), (3, "c9", 50)], "order_no int, customer string, amount long"), left, "b1", name="orders")
    versions.create(spark.createDataFrame([("c1", "North"), ("c2", "South")], "customer string, region string"), right, "b1", name="customers")
    at = joins.recorded_join(spark, left, right, "customer", "customer", "inner", path, "j1")
    assert (at.name, at.n_rows, joins.is_stale(spark, path)) == ("orders + customers", 2, False)
    versions.refresh(spark.createDataFrame([("c9", "East")], "customer string, region string"), right, "b2")
    assert joins.is_stale(spark, path)
    assert rows(joins.relations(spark, [left, path]), "name", "n_rows", "left_name", "right_name", "stale") == [("orders + customers", 2, "orders", "customers", True)]
    joins.rebuild(spark, path, "j2")
    assert rows(versions.rows_of(spark, path), "order_no", "region", "_batch") == [(3, "East", "j2")] and not joins.is_stale(spark, path)
    versions.refresh(spark.createDataFrame([("c0", "West")], "customer string, region string"), right, "b3")
    with pytest.raises(AnalysisError, match="no rows"):
        joins.rebuild(spark, path, "j3")
    assert rows(versions.rows_of(spark, path), "order_no") == [(3,)]
    with pytest.raises(AnalysisError):
        joins.rebuild(spark, left, "j4")
