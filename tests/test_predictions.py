import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import anomalies as anomaly, churn as lapse, forecast as outlook
from ledgerlight.operators.semantics import Shape
from ledgerlight.operators.smoothing import holt_winters


def months(count, start=dt.datetime(2024, 1, 1)):
    return [dt.datetime(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1) for i in range(count)]


def series(spark, values, periods=None):
    return spark.createDataFrame(
        list(zip(periods or months(len(values)), map(lambda v: None if v is None else float(v), values))),
        "period timestamp_ntz, value double",
    )


def test_thin_series_are_refused(spark):
    for values in ([1, 2, 3], [1, None, 2, None, 3, None]):
        row = outlook.forecast(series(spark, values)).collect()
        assert [(r["method"], r["history_points"], r["value"]) for r in row] == [("refused", 3, None)]


def test_a_line_is_continued(spark):
    rows = outlook.forecast(series(spark, range(10, 70, 10)), horizon=2).collect()
    assert [r["method"] for r in rows] == ["linear_trend"] * 2
    assert [r["value"] for r in rows] == pytest.approx([70, 80])
    assert [str(r["period"]) for r in rows] == ["2024-07-01", "2024-08-01"]


def test_interval_against_the_textbook(spark):
    values = np.array([12.0, 15, 11, 18, 17, 21, 19, 24])
    rows = outlook.forecast(series(spark, values), horizon=3).collect()
    n, x = len(values), np.arange(len(values))
    slope, intercept = np.polyfit(x, values, 1)
    deviation = math.sqrt(((values - slope * x - intercept) ** 2).sum() / (n - 2))
    for h, row in enumerate(rows, start=1):
        at = n - 1 + h
        margin = 1.439756 * deviation * math.sqrt(1 + 1 / n + (at - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
        assert row["upper"] - row["value"] == pytest.approx(margin, rel=1e-6)
    widths = [r["upper"] - r["lower"] for r in rows]
    assert widths == sorted(widths)


def test_values_stay_above_zero_unless_allowed(spark):
    falling = series(spark, [50, 40, 30, 20, 10, 5])
    assert min(r["lower"] for r in outlook.forecast(falling, horizon=6).collect()) == 0
    assert min(r["value"] for r in outlook.forecast(falling, horizon=6, allow_negative=True).collect()) < 0


def test_horizon_and_volatility(spark):
    wild = series(spark, [10, 90, 15, 85, 20, 95])
    rows = outlook.forecast(wild, horizon=24).collect()
    assert len(rows) == 24 and rows[0]["noise_ratio"] > 0.5 and "Volatile" in rows[0]["rationale"]
    assert outlook.forecast(wild, horizon=0).count() == 1
    with pytest.raises(ValueError):
        outlook.forecast(wild, horizon=25)


def test_month_ends_and_weeks(spark):
    ends = [dt.datetime(2026, m, d) for m, d in ((1, 31), (2, 28), (3, 31), (4, 30), (5, 31))]
    assert str(outlook.forecast(series(spark, range(5), ends), horizon=1).first()["period"]) == "2026-06-30"
    weeks = [dt.datetime(2026, 1, 5) + dt.timedelta(weeks=i) for i in range(6)]
    assert str(outlook.forecast(series(spark, range(6), weeks), horizon=2).collect()[1]["period"]) == "2026-02-23"


PATTERN = [10, 12, 15, 20, 26, 30, 32, 29, 22, 16, 12, 40]


def test_seasons_are_found(spark):
    values = [PATTERN[i % 12] + 0.5 * i for i in range(36)]
    rows = outlook.forecast(series(spark, values), horizon=12).collect()
    assert {r["method"] for r in rows} == {"holt_winters"}
    assert [r["value"] for r in rows] == pytest.approx([PATTERN[i % 12] + 0.5 * i for i in range(36, 48)], abs=0.05)


def test_seasonal_band_grows_with_the_root_of_distance(spark):
    noise = np.random.default_rng(5).normal(scale=2, size=48)
    values = [100 + PATTERN[i % 12] + noise[i] for i in range(48)]
    rows = outlook.forecast(series(spark, values), horizon=4).collect()
    widths = [r["upper"] - r["value"] for r in rows]
    assert widths == pytest.approx([widths[0] * math.sqrt(h) for h in (1, 2, 3, 4)])
    assert [r["value"] for r in rows] == pytest.approx([100 + p for p in PATTERN[:4]], abs=4)


def test_smoothing_beats_a_brute_force_search():
    values = np.random.default_rng(1).normal(size=40).cumsum() + np.tile([0.0, 3, -2, 1], 10) + 20

    def loss(alpha, beta, gamma):
        """Least squared error for given weights, starts found by solving the linear system."""
        def errors(start):
            level, trend, season = start[0], start[1], [*start[2:5], -sum(start[2:5])]
            out = []
            for t, y in enumerate(values):
                e = y - level - trend - season[t % 4]
                level, trend = level + trend + alpha * e, trend + beta * e
                season[t % 4] += gamma * e
                out.append(e)
            return np.array(out)

        base = errors(np.zeros(5))
        effect = np.stack([errors(row) - base for row in np.eye(5)], axis=1)
        start = np.linalg.lstsq(effect, -base, rcond=None)[0]
        return (errors(start) ** 2).sum()

    best = min(
        loss(a, a * b, (1 - a) * g)
        for a in np.linspace(0, 1, 11) for b in np.linspace(0, 1, 11) for g in np.linspace(0, 1, 11)
    )
    assert (holt_winters(values, 4, 3)[1] ** 2).sum() <= best * (1 + 1e-9)


def test_a_forecast_per_key_matches_one_at_a_time(spark):
    parts = {"a": list(range(10, 40, 3)), "b": [5, 4, 6, 5, 7], "c": [1, 2], "d": [PATTERN[i % 12] for i in range(30)]}
    together = None
    for key, values in parts.items():
        frame = series(spark, values).withColumn("k", F.lit(key))
        together = frame if together is None else together.union(frame)
    rows = outlook.forecast(together, ["k"], horizon=2).collect()
    for key, values in parts.items():
        alone = outlook.forecast(series(spark, values), horizon=2).collect()
        mine = [r for r in rows if r["k"] == key]
        assert [(r["method"], r["period"]) for r in mine] == [(r["method"], r["period"]) for r in alone]
        for one, other in zip(mine, alone):
            assert one["value"] == (None if other["value"] is None else pytest.approx(other["value"]))


@pytest.mark.parametrize("values, where, direction", [
    ([10, 11, 12, 13, 90, 15, 16, 17], "2024-05-01", "above"), ([50, 51, 52, 53, 4, 55, 56, 57], "2024-05-01", "below"),
])
def test_a_spike_is_flagged(spark, values, where, direction):
    rows = anomaly.anomalies(series(spark, values)).collect()
    assert [(str(r["period"]), r["direction"], r["severity"]) for r in rows] == [(where, direction, "serious")]


def test_anomaly_scores_by_hand(spark):
    values = np.array([10.0, 11, 12, 13, 90, 15, 16, 17])
    x = np.arange(8)
    residual = values - np.polyval(np.polyfit(x, values, 1), x)
    middle = np.median(residual)
    score = (residual - middle) / (1.4826 * np.median(np.abs(residual - middle)))
    assert anomaly.anomalies(series(spark, values)).first()["z_score"] == pytest.approx(score[4])


@pytest.mark.parametrize("values", [range(1, 13), [3, 3, 3, 3, 3, 3], [0.1 * i for i in range(20)], [1, 900, 1], [10, 20, 41, 60, 79, 100, 121, 300 - 160]])
def test_nothing_to_flag(spark, values):
    assert anomaly.anomalies(series(spark, values)).count() == 0


SHAPE = Shape("bought", "amount", None, None, "client", None, None, ("amount",), ())


def purchases(spark, clients, gone):
    """The first ``gone`` clients stop early; the others keep buying, a varying number of times."""
    start = dt.datetime(2025, 1, 1)
    rows = []
    for c in range(clients):
        days = [0, 15 + c % 4] if c < gone else [d + c % 5 for d in (0, 30, 75, 130, 180)[c % 3:]]
        rows += [(f"K{c:03d}", start + dt.timedelta(days=d), 20.0 + 3 * (c % 7)) for d in days]
    return spark.createDataFrame(rows, "client string, bought timestamp_ntz, amount double")


def test_churn_is_refused_without_evidence(spark):
    with pytest.raises(lapse.NotEnoughHistory, match="at least 20"):
        lapse.churn(purchases(spark, 12, 5), SHAPE)
    with pytest.raises(lapse.NotEnoughHistory, match="similar times"):
        lapse.churn(purchases(spark, 30, 0), SHAPE)


def test_churn_against_newton(spark):
    df = purchases(spark, 60, 15)
    model = lapse.churn(df, SHAPE)
    features = {r["customer"]: r for r in lapse.rfm(df, SHAPE).collect()}
    scores = {r["customer"]: r for r in model.scores.collect()}
    names = sorted(features)
    x = np.array([[features[n][c] for c in lapse.PREDICTORS] for n in names], dtype=float)
    recency = np.array([features[n]["recency_days"] for n in names], dtype=float)
    cutoff = round(max(30.0, float(np.percentile(recency, 70))))
    y = (recency > cutoff).astype(float)
    assert (model.cutoff_days, model.customers, model.lapsed) == (cutoff, 60, int(y.sum()))

    x = np.column_stack([np.ones(len(y)), (x - x.mean(axis=0)) / x.std(axis=0)])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty = np.diag([0.0, 1, 1, 1])
    b = np.zeros(4)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (p - y)) + penalty @ b)
    p = 1 / (1 + np.exp(-x @ b))
    assert [scores[n]["risk"] for n in names] == pytest.approx(list(p), abs=1e-5)
    found = {r["feature"]: r["coefficient"] for r in model.drivers.collect()}
    assert [found[n] for n in lapse.PREDICTORS] == pytest.approx(list(b[1:]), abs=1e-4)
    assert model.accuracy == pytest.approx(((p > 0.5) == (y == 1)).mean())
    top = model.at_risk(5).collect()
    assert [r["risk"] for r in top] == sorted((r["risk"] for r in top), reverse=True)
    assert all((r["band"] == "high") == (r["risk"] >= 0.7) for r in top)


def test_rfm_skips_incomplete_rows_and_counts_elapsed_days(spark):
    rows = [
        ("a", dt.datetime(2025, 1, 1, 18), 5.0), ("a", dt.datetime(2025, 1, 3, 6), None), (None, dt.datetime(2025, 1, 9), 1.0),
        ("b", dt.datetime(2025, 1, 5, 5), 2.0), ("b", None, 9.0),
    ]
    df = spark.createDataFrame(rows, "client string, bought timestamp_ntz, amount double")
    found = {r["customer"]: (r["recency_days"], r["frequency"], r["monetary"], r["tenure_days"]) for r in lapse.rfm(df, SHAPE).collect()}
    assert found == {"a": (1, 2, 5.0, 1), "b": (0, 1, 2.0, 0)}


def test_cutoff_has_a_floor(spark):
    assert lapse.lapse_cutoff(lapse.rfm(purchases(spark, 30, 0), SHAPE)).first()[0] == 30
