import datetime as dt

import pytest
from conftest import rows

from tallyspark.functions.periods import Span, compare_spans, preset_start, span_of
from tallyspark.model import AnalysisError
from tallyspark.operators import change, metrics
from tallyspark.plans import reports

VARIANCE = [("2025-02-03", "North", "Widget", 100, 10), ("2025-02-10", "South", "Gadget", 200, 4),
            ("2025-02-20", "East", "Widget", 100, 10), ("2025-03-03", "North", "Widget", 200, 20),
            ("2025-03-04", "North", "Gadget", 200, 4), ("2025-03-10", "South", "Gadget", 220, 4),
            ("2025-03-31", "East", "Widget", 100, 10)]


@pytest.fixture
def sales(dataset):
    return dataset("date region product revenue units", VARIANCE, ("revenue", "units"))


def test_waterfall_reconciles(sales):
    total = change.period_totals(sales).first()
    assert (total["a"], total["b"], total["delta"]) == (400.0, 720.0, 320.0)
    assert change.best_split(sales) == "region"
    steps = {r["member"]: r["delta"] for r in change.waterfall(sales).collect()}
    assert steps == {"North": 300.0, "South": 20.0, "East": 0.0}
    short = change.waterfall(sales, limit=1).collect()
    rest = next(r for r in short if r["is_other"])
    assert (rest["folded"], rest["a"], rest["b"]) == (2, 300.0, 320.0)
    assert sum(r["delta"] for r in short) == 320.0


def test_price_volume_mix(sales):
    parts = change.price_volume_mix(sales, "revenue", dimension="product")
    t = change.price_volume_mix_total(parts).first()
    assert t["price_effect"] == pytest.approx(20)
    assert t["volume_effect"] == pytest.approx((38 - 24) * 400 / 24)
    assert t["unexplained"] == 0
    assert t["volume_effect"] + t["mix_effect"] + t["price_effect"] == pytest.approx(t["delta"])
    one = sales.slice({"region": "South", "product": "Gadget"})
    s = change.price_volume_mix_total(change.price_volume_mix(one, "revenue")).first()
    assert (s["volume_effect"], s["mix_effect"], s["price_effect"]) == pytest.approx((0, 0, 20))


def test_value_without_volume_is_unexplained(dataset):
    ds = dataset("date product revenue units", [
        ("2025-01-05", "A", 100, 10), ("2025-01-06", "B", 50, 5), ("2025-02-05", "A", 100, 10),
        ("2025-02-28", "Fee", 30, 0)], ("revenue", "units"))
    t = change.price_volume_mix_total(change.price_volume_mix(ds, "revenue")).first()
    assert t["unexplained"] != 0
    assert t["volume_effect"] + t["mix_effect"] + t["price_effect"] + t["unexplained"] == pytest.approx(t["delta"])


def test_blank_member_is_kept(dataset):
    ds = dataset("date region revenue", [("2025-01-05", "North", 100), ("2025-01-06", None, 50),
                                         ("2025-02-05", "North", 100), ("2025-02-28", None, 90)])
    steps = change.waterfall(ds, dimension="region").collect()
    assert {(r["member"], r["blank"], r["delta"]) for r in steps} == {("North", False, 0.0), (None, True, 40.0)}


def test_partial_period_is_like_for_like(dataset):
    ds = dataset("date region revenue", [("2025-02-05", "North", 100), ("2025-02-25", "North", 900),
                                         ("2025-03-04", "North", 120), ("2025-03-10", "South", 1)])
    row = change.comparison_frame(ds).first()
    assert (row["a_to"], row["b_to"], row["like_for_like"]) == ("2025-02-10", "2025-03-10", True)
    total = change.period_totals(ds).first()
    assert (total["a"], total["b"]) == (100.0, 121.0)


def test_period_arithmetic():
    d = dt.date
    assert Span(d(2025, 3, 1), d(2025, 3, 31)).before("previous") == Span(d(2025, 2, 1), d(2025, 2, 28))
    assert Span(d(2024, 2, 29), d(2024, 2, 29)).before("year_ago") == Span(d(2023, 2, 28), d(2023, 2, 28))
    assert Span(d(2025, 3, 5), d(2025, 3, 9)).before("previous") == Span(d(2025, 2, 28), d(2025, 3, 4))
    assert span_of("2025-Q3", "quarter") == Span(d(2025, 7, 1), d(2025, 9, 30))
    for text, grain in (("2025-13", "month"), ("2025-01-07", "week"), ("2025", "month")):
        with pytest.raises(ValueError):
            span_of(text, grain)
    assert compare_spans(d(2025, 12, 31), "year", "previous").a == Span(d(2024, 1, 1), d(2024, 12, 31))
    assert preset_start(d(2025, 5, 20), "QTD") == d(2025, 4, 1) and preset_start(d(2025, 1, 9), "3M") == d(2024, 11, 1)
    with pytest.raises(ValueError):
        compare_spans(d(2025, 1, 1), "month", "previous", date_to="2024-12")


def test_drivers_of_the_last_two_months(dataset):
    ds = dataset("date branch revenue", [("2025-01-05", "Delhi", 100), ("2025-01-06", "Mumbai", 200),
                                         ("2025-02-05", "Delhi", 400), ("2025-02-06", "Mumbai", 150)])
    assert rows(change.drivers(ds).orderBy("position"), "member", "delta", "share") == [
        ("Delhi", 300.0, 300 / 250), ("Mumbai", -50.0, -50 / 250)]
    assert "rose" in reports.change_sentence(ds).first()["summary"]


def test_metric_tree_adds_up(sales):
    price = metrics.Metric("price", metrics.Part("sum", "revenue"), metrics.Part("sum", "units"))
    t = metrics.metric_tree(sales, price).first()
    assert t["numerator_effect"] + t["denominator_effect"] == pytest.approx(t["b"] - t["a"])
    single = metrics.metric_tree(sales, metrics.Metric("revenue", metrics.Part("sum", "revenue"))).first()
    assert single["delta"] == 320.0


def test_significance_flags_an_unusual_month(dataset):
    noise = [3, -5, 8, 1, -7, 4, 6, -2, 5, -4]
    data = []
    for i, n in enumerate(noise):
        data += [(f"2025-{i + 1:02d}-05", "North", 1000 + n), (f"2025-{i + 1:02d}-28", "East", 100)]
    usual = dataset("date region revenue", data + [("2025-11-05", "North", 1001), ("2025-11-28", "East", 100)])
    odd = dataset("date region revenue", data + [("2025-11-05", "North", 400), ("2025-11-28", "East", 100)])
    assert change.significance(usual).first()["level"] == "normal"
    assert change.significance(odd).first()["level"] == "unusual"
    few = dataset("date region revenue", data[:6])
    assert change.significance(few).count() == 0


def test_only_totals_split_and_ranges_need_a_start(sales):
    with pytest.raises(AnalysisError):
        change.waterfall(sales, agg="avg")
    with pytest.raises(AnalysisError):
        change.period_totals(sales.slice(date_to="2025-03"))


def test_decomposition_levels_reconcile(sales):
    tree = change.decomposition_tree(sales, depth=2).collect()
    first = [r for r in tree if r["level"] == 1]
    second = [r for r in tree if r["level"] == 2]
    picked = max(first, key=lambda r: abs(r["delta"]))
    assert sum(r["delta"] for r in first) == 320.0
    assert sum(r["delta"] for r in second) == picked["delta"]
