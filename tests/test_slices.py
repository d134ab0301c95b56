import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyspark.model import AnalysisError
from tallyspark.operators import ranking, slices

SALES = [("2024-03-10", "North", "Widget", 50), ("2025-02-03", "North", "Widget", 100),
         ("2025-02-04", "South", "Gadget", 200), ("2025-03-05", "North", "Gadget", 300),
         ("2025-03-06", "South", "Widget", 100), ("2025-03-31", "East", "Widget", 50)]


@pytest.fixture
def sales(dataset):
    return dataset("date region product revenue", SALES)


def test_value_and_spread(sales):
    assert rows(slices.slice_value(sales)) == [(800.0, 6)]
    row = slices.slice_stats(sales).first()
    assert (row["min"], row["max"], row["median"], row["skipped"]) == (50.0, 300.0, 100.0, 0)
    narrowed = sales.slice({"region": "North"}, "2025-03", "2025-03")
    assert rows(slices.slice_value(narrowed)) == [(300.0, 1)]


def test_trend_labels_and_comparison(sales):
    assert sorted(r[0] for r in rows(slices.trend(sales), "period")) == ["2024-03", "2025-02", "2025-03"]
    row = slices.compare_latest(sales).first()
    assert (row["value"], row["previous_delta"], row["year_ago_value"]) == (450.0, 150.0, 50.0)
    assert rows(slices.trend(sales, grain="quarter").orderBy(F.desc("period_key")), "period")[0] == ("2025-Q1",)
    assert rows(slices.trend(sales, grain="week").orderBy(F.desc("period_key")), "period", "to")[0] == (
        "2025-03-31", "2025-04-06")


def test_partial_period_is_the_datasets_not_the_slices(sales):
    assert rows(slices.latest_period(sales, "year"), "partial") == [(True,)]
    assert rows(slices.latest_period(sales.slice({"region": "North"})), "partial") == [(False,)]


def test_breakdown_tail(sales):
    top, rest = sorted(slices.breakdown(sales, "region", limit=1).collect(), key=lambda r: r["rank"] is None)
    assert (top["member"], rest["folded"], rest["value"], rest["n_rows"]) == ("North", 2, 350.0, 3)
    mean = slices.breakdown(sales, "region", agg="avg", limit=1).where("rank is null").first()
    assert mean["value"] == pytest.approx(350 / 3)


def test_refusals(sales):
    for bad in (lambda: sales.slice({"nope": 1}), lambda: sales.slice({"region": None}),
                lambda: sales.slice(date_from="2025"), lambda: slices.slice_value(sales, "region"),
                lambda: slices.slice_value(sales, agg="mode"), lambda: slices.breakdown(sales, "date")):
        with pytest.raises(AnalysisError):
            bad()


@pytest.fixture
def grid(dataset):
    cells = [(f"2025-{i % 12 + 1:02d}-05", None if i % 17 == 0 else f"R{i % 9}", f"P{i % 13}",
              None if i % 11 == 0 else (i * 37) % 500 + 1) for i in range(120)]
    return dataset("date region product revenue", cells)


@pytest.mark.parametrize("agg", ["sum", "avg", "count", "min", "max", "median"])
def test_one_scan_equals_one_dimension_at_a_time(grid, agg):
    together = sorted(rows(slices.contributors(grid, agg=agg, limit=3)), key=str)
    apart = sorted([r for d in ("region", "product") for r in rows(slices.breakdown(grid, d, agg=agg, limit=3))], key=str)
    assert len(together) == len(apart) == 8
    for a, b in zip(together, apart):
        assert a == pytest.approx(b) if not isinstance(a[2], str) else a[:3] == b[:3]


def test_records_and_description(sales):
    page = slices.records(sales, sort="revenue", page=2, page_size=2).collect()
    assert [r["revenue"] for r in page] == [100, 100]
    text = slices.describe(sales.slice({"region": "North"}, "2025-02", "2025-03")).first()[0]
    assert text == "Sum of revenue across 2 rows where region = North and date from 2025-02 to 2025-03."


@pytest.mark.parametrize("few", [20_000, 0])
def test_quantiles_against_brute_force(spark, monkeypatch, few):
    """A hot key, ties, outliers, nulls and a constant group; both join paths."""
    monkeypatch.setattr(ranking, "_BROADCAST_GROUPS", few)
    rng = random.Random(7)
    data = [("hot", rng.choice([rng.random(), 5.0, 1e12, -3.25])) for _ in range(2000)]
    data += [("small", v) for v in (3.0, 1.0, 2.0, 10.0)] + [("flat", 4.0)] * 9 + [("hot", None)] * 50
    df = spark.createDataFrame(data, "k string, v double")
    for r in ranking.quantiles(df, ["k"], ["v"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        values = sorted(v for k, v in data if k == r["k"] and v is not None)
        assert r["n"] == len(values)
        for i, p in enumerate([0.0, 0.25, 0.5, 0.9, 1.0]):
            at = p * (len(values) - 1)
            low = values[int(at)]
            high = values[min(int(at) + 1, len(values) - 1)]
            assert r[f"q{i}"] == pytest.approx(low + (high - low) * (at - int(at)))
    middle = ranking.quantiles(df, [], ["v"], [0.5]).first()["q0"]
    assert middle == pytest.approx(statistics.median(v for _, v in data if v is not None))


def test_fold_of_many_members(spark):
    """More members than salts; the sum of all rows is the sum of all members."""
    df = spark.range(5000).select(F.lit("d").alias("dimension"), F.col("id").cast("string").alias("member"),
                                  F.col("id").cast("double").alias("v"))
    out = ranking.top_and_rest(df, ["dimension"], "member", [F.desc("v"), F.asc("member")], 3,
                               [F.sum("v").alias("v")]).collect()
    assert sorted(r["v"] for r in out if r["rank"]) == [4997.0, 4998.0, 4999.0]
    rest = next(r for r in out if r["rank"] is None)
    assert (rest["folded"], rest["v"]) == (4997, sum(range(4997)))


def test_systematic_sample(spark):
    df = spark.range(1000)
    assert [r[0] for r in rows(ranking.systematic_sample(df, "id", 10).orderBy("id"))] == list(range(0, 1000, 100))
    assert ranking.systematic_sample(df.where("id < 7"), "id", 10).count() == 7


@pytest.mark.parametrize("down", [False, True])
def test_deep_pages_as_by_sorting(spark, monkeypatch, down):
    r = random.Random(5)
    names = [None, "", "a", "a\x00", "customer-1", "customer-10", "customer-2", "customer-é", "custom"]
    data = [(r.choice(names), r.choice([None, 1.5, 1.5, 1.5, -2.0, float("inf"), 7.25]), r.choice([None, True, False]), i // 2) for i in range(300)]
    df = spark.createDataFrame(data, "name string, value double, flag boolean, n long").repartition(3)
    monkeypatch.setattr(ranking, "_AT_ONCE", 20)

    def rank(v, falling=False):
        v = v.encode() if isinstance(v, str) else v
        return (1, 0) if v is None else (0, _Falling(v) if falling else v)

    for lead in ("name", "value"):
        order = [(lead, down)] + [(c, False) for c in df.columns if c != lead]
        want = sorted(data, key=lambda x: [rank(x[df.columns.index(c)], d) for c, d in order])
        for start, size in ((0, 10), (95, 30), (290, 30), (400, 5)):
            found = [tuple(x) for x in ranking.page(df, order, start, size).collect()]
            assert found == want[start : start + size], (lead, start)


class _Falling:
    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return self.v > other.v

    def __eq__(self, other):
        return self.v == other.v


def test_deep_page_of_equal_rows_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_AT_ONCE", 5)
    df = spark.createDataFrame([("x", None)] * 40, "a string, b long")
    assert [tuple(x) for x in ranking.page(df, [("a", False), ("b", True)], 30, 20).collect()] == [("x", None)] * 10
    assert ranking.page(df.where("a = 'y'"), [("a", False)], 30, 20).collect() == []
