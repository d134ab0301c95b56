import datetime as dt

import pytest
from conftest import rows

from tallyspark.operators import forecast
from tallyspark.operators import series as ops


def test_moving_average_and_growth(series):
    got = ops.moving_average(series([10, 20, 30, 40])).orderBy("period_key")
    assert [r[0] for r in rows(got, "moving_avg")] == [None, None, 20.0, 30.0]
    row = ops.growth(series([100 + 10 * m for m in range(1, 13)] + [260])).first()
    assert row["mom"] == round((260 - 220) / 220 * 100, 1) and row["yoy"] == round((260 - 110) / 110 * 100, 1)
    assert ops.growth(series([5.0])).first()["mom"] is None


def test_latest_delta_from_zero_has_no_percentage(series):
    row = ops.latest_delta(series([0, 5])).first()
    assert (row["current_value"], row["previous_value"], row["delta_pct"]) == (5.0, 0.0, None)
    assert len(ops.latest_delta(series(range(20))).first()["sparkline"]) == 12


def test_pareto(spark):
    shares = spark.createDataFrame([("d", i + 1, n, s) for i, (n, s) in enumerate(
        [("a", 50.0), ("b", 35.0), ("c", 10.0), ("d", 5.0)])], "dimension string, rank int, member string, share_pct double")
    got = {r["rank"]: r for r in ops.pareto(shares).collect()}
    assert got[1]["n_for_80"] == 2 and got[2]["cumulative_pct"] == 85.0 and got[1]["total_categories"] == 4


def test_anomalies(series):
    values = [100 + 3 * i for i in range(12)]
    values[6] = 900
    found = ops.anomalies(series(values)).collect()
    assert [(r["period_key"].month, r["direction"]) for r in found] == [(7, "spike")]
    assert ops.anomalies(series([100 + 3 * i for i in range(12)])).count() == 0
    assert ops.anomalies(series([1, 900, 2, 3])).count() == 0


def seasonal(n, start=1):
    noise = [3, -2, 1, 0, -3, 2, -1, 3, 0, -2, 1, 2]
    bump = {12: 80, 7: -40}
    return [500 + 2 * i + bump.get((start - 1 + i) % 12 + 1, 0) + noise[(i * 5) % 12] for i in range(n)]


def test_line_stays_linear(series):
    out = forecast.forecast(series([100 + 10 * i for i in range(14)])).orderBy("step").collect()
    assert {r["method"] for r in out} == {"linear"}
    assert [r["value"] for r in out] == pytest.approx([240, 250, 260], abs=0.01)
    assert [r["period_key"] for r in out] == [dt.date(2023, 3, 1), dt.date(2023, 4, 1), dt.date(2023, 5, 1)]


def test_seasonal_series_takes_a_seasonal_model(series):
    scores = {r["method"]: r["mae"] for r in forecast.backtest(series(seasonal(36))).collect()}
    row = forecast.forecast(series(seasonal(36))).first()
    assert "season" in row["method"] or row["method"] == "holt_winters"
    assert scores[row["method"]] < scores["linear"] / 3


@pytest.mark.parametrize("start", [1, 3, 8])
def test_phase_is_right_whatever_month_the_data_begins(series, start):
    s = series(seasonal(28, start), dt.date(2022, start, 1))
    out = forecast.forecast(s, 12, ("linear_seasonal",)).collect()
    assert max(out, key=lambda r: r["value"])["period_key"].month == 12
    assert min(out, key=lambda r: r["value"] - 2 * r["step"])["period_key"].month == 7


def test_short_series(series):
    assert forecast.forecast(series([1, 2, 3])).count() == 0
    four = forecast.forecast(series([5, 1, 4, 2])).collect()
    assert {r["method"] for r in four} == {"linear"} and all(r["lower"] >= 0 for r in four)
