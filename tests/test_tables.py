import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyspark.functions.text import clean_names, redact, redact_map, redact_text
from tallyspark.model import AnalysisError, ColumnMeta, Dataset
from tallyspark.operators import governance, joins, profile, security, slices
from tallyspark.operators.security import RowRule, Share
from tallyspark.sources import batches, snapshots, tables


def test_append_replace_and_roll_back(spark):
    jan = spark.createDataFrame([("2025-01-05", "Delhi", 1000), ("2025-01-06", "Mumbai", 2000)],
                                "date string, branch string, revenue long").withColumn("_batch", F.lit("b0"))
    feb = spark.createDataFrame([("2025-02-05", "Delhi", 1500), ("2025-02-06", "Mumbai", 2500)],
                                "date string, branch string, revenue long")
    one = batches.append(jan, feb, "b1")
    assert one.table.count() == 4
    assert rows(batches.batch_log(feb, one, "b1"), "rows_added", "skipped_duplicates") == [(2, 0)]
    again = batches.append(one.table, feb, "b2")
    assert rows(batches.batch_log(feb, again, "b2"), "rows_added", "skipped_duplicates") == [(0, 2)]
    wider = batches.append(one.table, feb.withColumn("cost", F.lit(7)).withColumn("revenue", F.col("revenue") + 1), "b3")
    assert wider.new_columns == ("cost",) and wider.table.where("cost is null").count() == 4
    blank = batches.append(one.table, spark.createDataFrame([("2025-03-01", 9)], "date string, revenue long"), "b4")
    assert blank.missing_columns == ("branch",) and blank.table.where("branch is null").count() == 1
    with pytest.raises(AnalysisError):
        batches.append(jan, spark.createDataFrame([(1,)], "other int"), "b5")
    fixed = spark.createDataFrame([("2025-02-05", "Delhi", 7000), ("2025-02-09", "Mumbai", 8887)],
                                  "date string, branch string, revenue long")
    done = batches.replace_period(one.table, fixed, "b6", "date")
    assert done.removed.count() == 2 and done.table.agg(F.sum("revenue")).first()[0] == 18887
    back = batches.rollback(done.table, done.removed, "b6", "b7")
    assert sorted(rows(back, "date", "branch", "revenue")) == sorted(rows(one.table, "date", "branch", "revenue"))


def test_append_keeps_repeats_inside_the_file_and_matches_nulls(spark):
    old = spark.createDataFrame([("x", None)], "a string, b long").withColumn("_batch", F.lit("b0"))
    new = spark.createDataFrame([("x", None), ("y", 1), ("y", 1)], "a string, b long")
    assert sorted(rows(batches.append(old, new, "b1").added, "a")) == [("y",), ("y",)]


def test_append_moves_only_what_may_be_equal(spark):
    held = spark.range(20_000).selectExpr("id", "date_add(date'2025-01-01', CAST(id % 400 AS INT)) AS day", "CAST(id AS double) / 7 AS v",
                                          "if(id % 5 = 0, NULL, concat('n', id)) AS name")
    held = held.withColumn(batches.HASH_COLUMN, batches.stable_hash(held.columns, held)).withColumn("_batch", F.lit("b0"))
    again = held.where("id % 400 BETWEEN 100 AND 103").drop("_batch", batches.HASH_COLUMN)  # 200 rows, 1 %
    new = again.unionByName(again.withColumn("v", F.col("v") + 1)).unionByName(again.where("id % 400 = 101").withColumn("day", F.lit(None).cast("date")))
    hashed = new.withColumn("_hash", batches.stable_hash(new.columns, new))
    near = batches.known_rows(held, hashed, "day")
    assert 200 <= near.count() < 210
    assert 200 <= batches.known_rows(held, hashed).count() < 500
    for table in (held, held.drop(batches.HASH_COLUMN)):  # stored or not
        done = batches.append(table, new.select("name", "v", "day", "id"), "b1", "day")
        assert done.added.count() == 250 and done.table.count() == 20_250
        assert batches.append(done.table, new, "b2", "day").added.isEmpty()
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # the distinct survivors and the filter's words; none over the history
    wider = batches.append(held, again.withColumn("more", F.when(F.col("id") % 2 == 0, "x")), "b3", "day")
    assert wider.added.isEmpty()
    odd = batches.append(held, again.withColumn("more", F.lit("x")).withColumn("v", -F.col("v")), "b4", "day")
    assert batches.append(odd.table, odd.added.drop("_batch", batches.HASH_COLUMN), "b5", "day").added.isEmpty()


def test_undated_rows_stay(spark):
    old = spark.createDataFrame([("2025-01-05", 1), ("soon", 2)], "date string, v long")
    new = spark.createDataFrame([("2025-01-09", 5)], "date string, v long")
    done = batches.replace_period(old, new, "b1", "date")
    assert sorted(rows(done.table, "v")) == [(2,), (5,)]


def test_rules_masks_and_slices_in_order(dataset):
    ds = dataset("date region product revenue", [
        ("2025-01-05", "North", "Widget", 1000), ("2025-01-06", "South", "Widget", 2000),
        ("2025-02-07", "East", "Gadget", 3000), ("2025-02-08", "North", "Gadget", 4000),
        ("2025-03-09", "South", "Gizmo", 5000), ("2025-03-10", None, "Gizmo", 7)])

    def total(rules):
        return slices.slice_value(security.secure(ds, rules)).first()["value"]

    assert total([RowRule("region", ["North"])]) == 5000
    assert total([RowRule("region", ["North"]), RowRule("region", ["South"])]) == 12000
    assert total([RowRule("region", ["North"]), RowRule("product", ["Gadget"])]) == 4000
    assert total([RowRule("region", ["North", "South", "East"], "not_in")]) == 7
    assert total([RowRule("gone", ["x"])]) is None
    masked = security.secure(ds, [RowRule("region", ["North"])], {"region": "person_name"})
    assert rows(masked.frame.select("region").distinct()) == [("N*****",)]
    assert slices.slice_value(masked.slice({"region": "N*****"})).first()["value"] == 5000
    assert rows(security.secure(ds, (), {"region": "person_name"}, admin=True).frame.select("region").distinct()) != []
    public = security.secure(ds, (), {"region": "person_name"}, admin=True, public=True)
    assert public.frame.where("region = 'North'").count() == 0


def test_share_scope_never_widens():
    share = Share({"region": "North"}, "2025-01", "2025-03")
    assert share.clamp({"product": "Widget"}, "2024-01", "2026-01") == (
        {"product": "Widget", "region": "North"}, "2025-01", "2025-03")
    assert share.clamp({}, "2025-02", "2025-02-10")[1:] == ("2025-02", "2025-02-10")
    for bad in (({"region": "South"},), ({}, "2025-06"), ({}, "soon")):
        with pytest.raises(AnalysisError):
            share.clamp(*bad)


def test_personal_data(spark):
    people = spark.createDataFrame([
        ("2025-01-0%d" % i, f"P{i} Sharma", f"p{i}.sharma@acme.com", f"987654321{i}", f"12345678901{i}", "North", 1000)
        for i in range(1, 6)],
        "date string, customer_name string, email string, line string, number string, region string, revenue long")
    found = {r["column"]: r["kind"] for r in profile.detect_pii(people).collect()}
    assert found == {"customer_name": "person_name", "email": "email", "line": "phone", "number": "national_id"}
    ds, kinds = profile.open_profiled(people)
    shown = security.secure(ds, (), kinds).frame.orderBy("date").first()
    assert (shown["email"], shown["line"], shown["number"]) == ("p1***@acme.com", "******3211", "********9011")
    assert ds.date_column == "date" and "revenue" in ds.measures


def test_quality_report_and_cleaning(dataset):
    ds = dataset("date branch revenue", [("2025-01-05", "Delhi", 1000), ("2025-01-06", "Mumbai", None),
                                         ("2025-01-07", None, 1500), ("2025-01-05", "Delhi", 1000),
                                         ("2025-01-09", "Delhi", 99999)])
    assert rows(profile.duplicate_count(ds)) == [(5, 1)]
    q = {r["column"]: r for r in profile.column_quality(ds).collect()}
    assert q["revenue"]["missing_count"] == 1 and q["branch"]["missing_count"] == 1 and q["revenue"]["outlier_count"] >= 1
    ids = {r["id"] for r in profile.suggestions(profile.column_quality(ds), profile.duplicate_count(ds)).collect()}
    assert {"drop_duplicates", "fill_revenue", "fill_branch"} <= ids
    assert profile.drop_duplicates(ds).frame.count() == 4
    assert profile.fill_missing(ds, "branch", "mode").frame.where("branch is null").count() == 0
    assert profile.fill_missing(ds, "revenue", "median").frame.agg(F.max("revenue")).first()[0] == 99999
    with pytest.raises(AnalysisError):
        profile.fill_missing(ds, "nope", "mean")
    empty = dataset("date branch revenue", [("2025-01-05", None, 5)])
    with pytest.raises(Exception, match="no value available"):
        profile.fill_missing(empty, "branch", "mode").frame.collect()


def test_roles(spark):
    df = spark.createDataFrame([(f"2025-01-{i % 28 + 1:02d}", f"c{i}", "North" if i % 2 else "South", i * 10, i / 100, i % 3)
                                for i in range(60)],
                               "day string, code string, region string, revenue long, score double, grade int")
    got = {c.name: (c.role, c.subtype) for c in profile.detect_roles(df)}
    assert got == {"day": ("date", None), "code": ("ignored", None), "region": ("dimension", "branch"),
                   "revenue": ("measure", "currency"), "score": ("measure", "percentage"),
                   "grade": ("dimension", "generic")}


def test_kinds_do_not_hang_on_the_first_rows(spark):
    rows = [("none", "n/a", i) for i in range(250)] + [(f"p{i}@acme.com", f"2025-01-{i % 28 + 1:02d}", i) for i in range(5000)]
    names = "reach string, seen string, amount long"
    forth, back = (spark.createDataFrame(r, names).coalesce(1) for r in (rows, rows[::-1]))
    for df in (forth, back):
        assert {r["column"]: r["kind"] for r in profile.detect_pii(df).collect()} == {"reach": "email"}
        assert {c.name: c.role for c in profile.detect_roles(df)}["seen"] == "date"
    assert sorted(profile._samples(forth, ["seen"], 30, ["reach", "seen"]).collect()) == sorted(profile._samples(back, ["seen"], 30, ["reach", "seen"]).collect())


def test_joins(spark):
    def side(name, df):
        return Dataset.open(df, [ColumnMeta(c, "ignored") for c in df.columns], name)

    orders = side("orders", spark.createDataFrame(
        [("o1", "c1", 100), ("o2", "c2", 200), ("o3", "c1", 300), ("o4", "c9", 50)],
        "order_id string, customer_id string, amount long"))
    customers = side("customers", spark.createDataFrame([("c1", "North", 1), ("c2", "South", 2)],
                                                        "customer_id string, region string, amount long"))
    left = joins.join(orders, customers, "customer_id", "customer_id")
    assert left.columns == ["order_id", "customer_id", "amount", "region", "customers_amount"]
    assert (left.count(), left.agg(F.sum("amount")).first()[0]) == (4, 650)
    assert joins.join(orders, customers, "customer_id", "customer_id", "inner").count() == 3
    assert joins.suggest_keys(orders, customers)[0] == "customer_id"
    assert rows(joins.key_overlap(orders.frame, customers.frame, "customer_id", "customer_id")) == [(3, 2, 2 / 3)]
    with pytest.raises(AnalysisError):
        joins.join(orders, customers, "nope", "customer_id")


def test_snapshots_notice_damage(spark, tmp_path):
    where = str(tmp_path / "snap")
    snapshots.create(spark, {"a": spark.range(5), "b": spark.range(7)}, where)
    assert {r["table_name"]: r["ok"] for r in snapshots.verify(spark, where).collect()} == {"a": True, "b": True}
    spark.range(3).write.mode("overwrite").parquet(f"{where}/b")
    assert {r["table_name"]: r["ok"] for r in snapshots.verify(spark, where).collect()} == {"a": True, "b": False}
    with pytest.raises(AnalysisError):
        snapshots.restore(spark, where, str(tmp_path / "back"))
    with pytest.raises(AnalysisError):
        snapshots.manifest(spark, str(tmp_path / "nothing")).count()


def test_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("Order ID,2nd,Order-ID\n1,a,2\n")
    df = tables.read_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["Order_ID", "c_2nd", "Order_ID_1"] and rows(df) == [(1, "a", 2)]
    assert clean_names(["", "a b", "a-b"]) == ["col", "a_b", "a_b_1"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "n.md").write_bytes("héllo\n\nworld".encode() + b"\xff")
    assert rows(tables.read_texts(spark, str(tmp_path / "t")), "source", "text") == [
        ("n.md", "héllo\n\nworld\ufffd")]
    with pytest.raises(AnalysisError):
        tables.create_table(spark.range(0), str(tmp_path / "empty"), "b0")


def test_retention_policy_and_sweep(spark):
    for bad in ({"audit_days": 3}, {"dataset_days": 20}, {"audit_days": -1}, {"archive_days": 7.5}):
        with pytest.raises(AnalysisError):
            governance.Policy(**bad)
    now = dt.datetime(2025, 6, 1)
    audit = spark.createDataFrame([(dt.datetime(2025, 1, 1), "u", "login", ""), (dt.datetime(2025, 5, 30), "u", "login", "")],
                                  "ts timestamp, user_id string, action string, detail string")
    empty = spark.createDataFrame([], "batch_id string, dataset_id string, created_at timestamp")
    archive = spark.createDataFrame([], "batch_id string, dataset_id string")
    sets = spark.createDataFrame([], "dataset_id string, ingested_at timestamp")
    swept = governance.retention_sweep(governance.Policy(audit_days=30), now, audit, archive, empty, sets, {})["audit"]
    assert sorted(r["action"] for r in swept.collect()) == ["login", "retention_sweep"]
    twice = governance.retention_sweep(governance.Policy(audit_days=30), now, swept, archive, empty, sets, {})["audit"]
    assert twice.count() == 2
    keep = governance.retention_sweep(governance.Policy(), now, audit, archive, empty, sets, {})["audit"]
    assert keep.count() == 2


def test_redaction(spark):
    df = spark.createDataFrame([("Bearer abc.def next", {"api_key": "k", "note": "bearer zzz"})],
                               "line string, extra map<string,string>")
    row = df.select(redact_text(F.col("line")), redact_map(F.col("extra"))).first()
    assert row[0] == "Bearer [redacted] next" and row[1] == {"api_key": "[redacted]", "note": "bearer [redacted]"}


def test_cleaned_names_are_free(spark):
    from tallyspark.functions.text import clean_name, clean_names
    assert clean_names(["a", "a_1", "a"]) == ["a", "a_1", "a_2"] and clean_names(["x y", "x-y", "x_y_1"]) == ["x_y", "x_y_2", "x_y_1"]
    assert [clean_name(n) for n in (" Net  Sales (%) ", "2024", "é", "_a_")] == ["Net_Sales", "c_2024", "col", "a"]


def test_joined_names_are_distinct(dataset):
    from tallyspark.operators import joins
    left = dataset("k v r_v", [("a", 1, 2)], measures=("v", "r_v"))
    right = dataset("k v", [("a", 3)], measures=("v",))
    out = joins.join(left, __import__("dataclasses").replace(right, name="r"), "k", "k")
    assert out.columns == ["k", "v", "r_v", "r_v_1"] and rows(out) == [("a", 1, 2, 3)]


def test_snapshot_refuses_full_targets_and_tells_damage(spark, tmp_path):
    from tallyspark.model import AnalysisError
    from tallyspark.sources import snapshots
    tables = {"one": spark.range(50), "two": spark.range(9)}
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("here")
    with pytest.raises(AnalysisError):
        snapshots.create(spark, tables, f"{tmp_path}/other")
    snapshots.create(spark, tables, f"{tmp_path}/s")
    for part in (tmp_path / "s" / "two").glob("part-*"):
        part.write_bytes(b"PAR1 damaged PAR1")
    for crc in (tmp_path / "s" / "two").glob(".part-*.crc"):
        crc.unlink()
    assert {r["table_name"]: r["ok"] for r in snapshots.verify(spark, f"{tmp_path}/s").collect()} == {"one": True, "two": False}


def test_large_keys_keep_their_value_in_a_sample(spark):
    from pyspark.sql import functions as F

    from tallyspark.operators import ranking
    big = spark.range(4000).select((F.col("id") + 2**60).alias("key"))
    assert ranking.systematic_sample(big, "key", 400).count() == 400


def test_buckets_of_heavy_tails_are_even(spark):
    from pyspark.sql import functions as F

    from tallyspark.operators import ranking
    df = spark.range(200_000).select(F.exp(F.randn(7) * 3).alias("v"))
    edges = ranking.sketch(df, [], ["v"]).edges["v"]
    sizes = [r["count"] for r in df.groupBy(ranking._bucket(F.col("v"), ranking._block(F.col("v"), edges, "double"), edges).alias("b")).count().collect()]
    assert max(sizes) < 0.02 * 200_000
    assert ranking.quantiles(df, [], ["v"], [0.5]).first()["q0"] == df.agg(F.percentile("v", 0.5)).first()[0]


def test_secrets_are_hidden_at_every_depth(spark):
    schema = ("a struct<user: string, Password: string, tokens: array<int>, deep: map<string, map<string, array<string>>>>, "
              "b array<map<string, struct<note: string, api_key: string, n: int>>>, c array<int>, d map<int, string>")
    rows_ = [(("Bearer abc.def x", "pw", [1, 2], {"ok": {"k": ["bearer q-1", None], "my_secret": ["s"]}, "cookie": {"a": ["b"]}, "none": None}),
              [{"x": ("n Bearer z", "key", 3), "authorization": ("a", "b", 4), "y": None}], [5], {1: "Bearer t"}), (None, None, None, None),
             ((None, None, None, {}), [], [], {})]
    df = spark.createDataFrame(rows_, schema)
    out = df.select(*[redact(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    assert [f.dataType.simpleString() for f in out.schema.fields] == [f.dataType.simpleString() for f in df.schema.fields]
    one, two, three = [r.asDict(recursive=True) for r in out.collect()]
    assert one["a"] == {"user": "Bearer [redacted] x", "Password": "[redacted]", "tokens": None,
                        "deep": {"ok": {"k": ["bearer [redacted]", None], "my_secret": None}, "cookie": None, "none": None}}
    assert one["b"] == [{"x": {"note": "n Bearer [redacted]", "api_key": "[redacted]", "n": 3}, "authorization": None, "y": None}]
    assert (one["c"], one["d"]) == ([5], {1: "Bearer [redacted]"})
    assert set(two.values()) == {None}
    assert three["a"] == {"user": None, "Password": "[redacted]", "tokens": None, "deep": {}} and three["b"] == []
