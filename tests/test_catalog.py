import pytest

import __spark_entry__ as entry_point

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(entry_point.queries()) > 100


def test_flagship(spark):
    rows = entry_point.entry(spark).collect()
    assert {r["dimension"] for r in rows} == {"o_orderstatus", "o_orderpriority"}


@pytest.mark.parametrize("name", ["slice_value", "variance_waterfall", "masked_projection", "bm25_top", "rollback"])
def test_same_answer_in_sql(spark, name):
    import duckdb

    from check_queries import TABLES, table
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry_point.queries()[name](spark, SMALL)
    cur = con.execute(entry_point.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in cur.description], cur.fetchall())


def test_plans_reach_the_scan(spark):
    """Two months of a slice read three columns and push the dates down."""
    from tallyspark.operators import slices
    from tallyspark.plans.catalog.registry import orders
    df = slices.slice_value(orders(spark, SMALL).slice({"o_orderstatus": "F"}, "1998-01", "1998-02"))
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(o" in plan.rsplit("PushedFilters", 1)[1]
    assert "o_custkey" not in plan.rsplit("ReadSchema", 1)[1]
