import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyspark.functions.numbers import display
from tallyspark.model import AnalysisError
from tallyspark.operators import goals, metrics, rules
from tallyspark.operators.goals import Alert, Target
from tallyspark.operators.metrics import Metric, Part, Question
from tallyspark.plans import reports


@pytest.fixture
def months(dataset):
    noise = [3, -5, 8, 1, -7, 4, 6, -2, 5, -4]
    data = []
    for i, n in enumerate(noise):
        m = f"2025-{i + 1:02d}"
        data += [(f"{m}-05", "North", "Widget", 1000 + n, 100, 200), (f"{m}-15", "South", "Gadget", 500, 50, 100),
                 (f"{m}-28", "East", "Widget", 100, 10, 20)]
    data += [("2025-11-05", "North", "Widget", 400, 50, 60), ("2025-11-15", "South", "Gadget", 500, 50, 80),
             ("2025-11-28", "East", "Widget", 100, 10, 20)]
    return dataset("date region product revenue units profit", data, ("revenue", "units", "profit"))


def test_target_statuses(months):
    got = {r["target_id"]: r for r in goals.evaluate_targets(months, [
        Target("met", "revenue", "month", "2025-11", 1000), Target("risk", "revenue", "month", "2025-11", 1100),
        Target("off", "revenue", "month", "2025-11", 5000, {"region": "North"}),
        Target("missed", "revenue", "quarter", "2025-Q3", 99999), Target("later", "revenue", "month", "2026-05", 1),
        Target("bad", "nope", "month", "2025-11", 1), Target("shape", "revenue", "month", "2025-Q1", 1)]).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "met": "met", "risk": "at_risk", "off": "off_track", "missed": "missed", "later": "not_started",
        "bad": "broken", "shape": "broken"}
    assert got["risk"]["projection"] == pytest.approx(1000 / 28 * 30)
    assert got["risk"]["needed_per_day"] == pytest.approx(50)


def test_alerts_fire_once_and_rearm(dataset):
    ds = dataset("date branch revenue", [("2025-01-05", "Delhi", 1000), ("2025-01-06", "Mumbai", 2000),
                                         ("2025-02-05", "Delhi", 500), ("2025-02-06", "Mumbai", 400)])

    def run(state, op="lt", aggregate="mom_pct", threshold=-10.0):
        values = goals.alert_values(ds, [Alert("a", "revenue", aggregate, op, threshold, state)])
        return goals.alert_states(values).first()

    first = run("pending")
    assert (first["value"], first["state"], first["fired"]) == (pytest.approx(-70), "firing", True)
    assert run("firing")["fired"] is False and run("ok")["fired"] is True
    assert run("firing", "gt")["state"] == "ok"
    assert run("ok", aggregate="total")["value"] == 3900 and run("ok", aggregate="latest")["value"] == 900
    assert run("ok", aggregate="target_pace")["state"] == "error"


def test_actions(months):
    found = {r["kind"]: r for r in rules.actions(months, "revenue", [
        Target("t", "revenue", "month", "2025-11", 5000)], 20).collect()}
    assert {"unusual_move", "target", "declining_segment", "concentration", "price_erosion"} <= set(found)
    assert found["declining_segment"]["evidence"] == {"region": "North"} or "product" in found[
        "declining_segment"]["evidence"]


def test_actions_name_the_step_the_share_and_the_worst_price(dataset):
    data = [(f"2025-{m:02d}-{d:02d}", p, 10.0 * price, 10.0) for m, prices in ((1, (9, 9, 5)), (2, (9, 3, 5)))
            for d in (1, 28 if m == 2 else 31) for p, price in zip("ABC", prices)]
    ds = dataset("date product revenue quantity", data, measures=("revenue", "quantity"))
    found = {r["kind"]: r for r in rules.actions(ds, "revenue", limit=20).collect()}
    assert found["declining_segment"]["why"].endswith("(-67%) from Jan 2025 to Feb 2025, 100% of the overall change.")
    assert "B" in found["declining_segment"]["step"] and all(r["step"] for r in found.values())
    assert "(revenue per quantity)" in found["price_erosion"]["why"] and found["price_erosion"]["why"].endswith(", most of it in B.")


def test_no_share_of_a_change_that_was_no_loss(dataset):
    data = [(f"2025-{m:02d}-{d:02d}", r, v) for m, values in ((1, (50, 50)), (2, (30, 90))) for d in (1, 28 if m == 2 else 31)
            for r, v in zip("AB", values)]
    found = {r["kind"]: r for r in rules.actions(dataset("date region revenue", data), "revenue").collect()}
    assert found["declining_segment"]["why"].endswith("(-40%) from Jan 2025 to Feb 2025.")


def test_concentration_needs_more_than_an_even_share(dataset):
    def kinds(shares):
        data = [(f"2025-01-{d:02d}", f"R{i}", s) for i, s in enumerate(shares) for d in (1, 2)]
        return {r["kind"] for r in rules.actions(dataset("date region revenue", data), "revenue").collect()}

    assert "concentration" not in kinds([40.0, 30.0, 30.0])
    assert "concentration" in kinds([55.0, 25.0, 20.0])
    assert "concentration" in kinds([41.0] + [59 / 9] * 9)


def test_missing_values_action(dataset):
    ds = dataset("date region revenue", [(f"2025-01-{i + 1:02d}", "North", None if i % 4 == 0 else 10) for i in range(20)])
    row = next(r for r in rules.actions(ds, "revenue").collect() if r["kind"] == "missing_values")
    assert "5 of 20 rows (25%)" in row["why"]


def test_metrics(dataset):
    ds = dataset("date branch revenue profit", [("2025-01-05", "Delhi", 1000, 200), ("2025-01-06", "Mumbai", 2000, 500),
                                                ("2025-02-05", "Delhi", 500, 100)], ("revenue", "profit"))
    got = {r["metric"]: r["value"] for r in metrics.evaluate(ds, [
        Metric("revenue", Part("sum", "revenue")), Metric("margin", Part("sum", "profit"), Part("sum", "revenue"), "percent"),
        Metric("rows", Part("count")), Metric("branches", Part("count_distinct", "branch")),
        Metric("middle", Part("median", "revenue"))]).collect()}
    assert got == pytest.approx({"revenue": 3500, "margin": 800 / 3500 * 100, "rows": 3, "branches": 2, "middle": 1000})
    assert metrics.evaluate(ds, [Metric("x", Part("sum", "nope"))]).first()["error"]


GOLDEN = [("2025-01-05", "North", "Widget", "Online", 1000.0, 10), ("2025-01-10", "South", "Gadget", "Store", 2000.0, 20),
          ("2025-02-05", "East", "Widget", "Online", 1500.0, 15), ("2025-02-14", "South", "Widget", "Online", 500.0, 5)]


def test_questions(dataset):
    ds = dataset("date region product channel revenue units", GOLDEN, ("revenue", "units"))
    assert rows(metrics.ask(ds, Question("revenue"))) == [(None, 5000.0)]
    assert rows(metrics.ask(ds, Question("revenue", group_by="region", limit=1))) == [("South", 2500.0)]
    assert rows(metrics.ask(ds, Question("revenue", filters={"channel": "Online"}))) == [(None, 3000.0)]
    assert rows(metrics.ask(ds, Question(None, "count"))) == [(None, 4.0)]
    assert sorted(rows(metrics.ask(ds, Question("units", group_by=metrics.MONTH)))) == [("2025-01", 30.0), ("2025-02", 20.0)]
    for bad in (Question("profit"), Question("revenue", unresolved=["Mars"])):
        with pytest.raises(AnalysisError):
            metrics.ask(ds, bad)
    assert metrics.ask(ds, Question("revenue", filters={"region": "West"})).count() == 0
    assert metrics.answer(ds, Question("revenue", group_by="region", limit=2)).first()[0].startswith("South leads with")
    assert metrics.answer(ds, Question("revenue", group_by=metrics.MONTH)).first()[0].endswith("in Feb 2025.")


def test_insights_and_report(months):
    categories = {r["category"] for r in rules.insights(months, "revenue").collect()}
    assert {"trend", "momentum", "forecast", "leader", "concentration", "margin"} <= categories
    lines = reports.report(months, "revenue", [Target("t", "revenue", "month", "2025-11", 1000)]).collect()
    assert {"Headline", "Key numbers", "Targets", "Recommended actions"} <= {r["section"] for r in lines}


def test_display(spark):
    df = spark.createDataFrame([(0.25, "percentage"), (12345678.0, "currency"), (250000.0, "currency"), (99.5, "currency"),
                                (1234.5, "count"), (1200.0, "count"), (None, "count")], "v double, k string")
    assert [r[0] for r in rows(df, display(F.col("v"), F.col("k")))] == [
        "25.0%", "₹1.23 Cr", "₹2.50 L", "₹100", "1,234.50", "1,200", "-"]
