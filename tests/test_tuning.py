"""The search over settings against plain loops, and small helpers of results and indexes."""

from datetime import date, timedelta
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from stallwise.operators import experiments, features, forecast, intervals, panel_checks

FIRST = date(2024, 1, 1)


@pytest.fixture(scope="module")
def values():
    """Three series of 70 days; the second changes level late, so short windows are better for it."""
    return {"a": [float((7 * d) % 11) for d in range(70)], "b": [5.0 if d < 45 else 50.0 for d in range(70)], "c": [0.0 if d % 3 else 4.0 for d in range(70)]}


@pytest.fixture(scope="module")
def panel(spark, values):
    rows = [(s, FIRST + timedelta(days=d), v, v, 1.0, False) for s, vs in values.items() for d, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, dt date, sale_amount double, demand_latent double, available_weight double, is_censored boolean").persist()


def croston(vs, alpha):
    size, gap, since = None, 1.0, 1.0
    for v in vs:
        if v > 0:
            size, gap = (v, since) if size is None else (alpha * v + (1 - alpha) * size, alpha * since + (1 - alpha) * gap)
            since = 1.0
        else:
            since += 1
    return (1 - alpha / 2) * size / max(gap, 1.0) if size is not None else 0.0


def brute(values, trial, origins):
    out = []
    for o in origins:
        errors = []
        for vs in values.values():
            known = vs[: o + 1]
            scale = max(mean(abs(x - y) for x, y in zip(known[7:], known)), 1e-3)
            for h in range(1, 8):
                if trial.model == "moving_average":
                    p = mean(known[-int(trial.value) :])
                elif trial.model == "seasonal_moving_average":
                    p = mean(known[o + h - 7 * c] for c in range(1, int(trial.value) + 1))
                else:
                    p = croston(known, trial.value)
                errors.append(abs(vs[o + h] - p) / scale)
        out.append(mean(errors))
    return mean(out), stdev(out)


def test_tune_equals_plain_loops(panel, values):
    folds = forecast.folds(panel)
    origins = sorted((r["origin_date"] - FIRST).days for r in folds.collect())
    trials = experiments.random_trials(3, seed=7)
    got = {(r["model"], r["value"]): r for r in experiments.tune(panel, folds, trials).collect()}
    assert set(got) == {(t.model, t.value) for t in trials}
    want = {t: brute(values, t, origins) for t in trials}
    for t, (m, s) in want.items():
        r = got[t.model, t.value]
        assert (r["mean"], r["std"], r["objective"]) == pytest.approx((m, s, m + 0.5 * s))
        assert r["is_current"] == t.current
    for model in experiments.CURRENT:
        own = {t: v for t, v in want.items() if t.model == model}
        best = min(own, key=lambda t: (round(own[t][0] + 0.5 * own[t][1], 9), not t.current, t.value))
        now = next(v for t, v in own.items() if t.current)
        assert [k[1] for k, r in got.items() if k[0] == model and r["best"]] == [best.value]
        assert got[model, best.value]["adopted"] == (not best.current and now[0] - own[best][0] > now[1])
    assert sum(r["adopted"] for r in got.values()) <= len(experiments.CURRENT)


def test_adoption_needs_more_than_the_spread(spark):
    rows = spark.createDataFrame([(0.8, 1.0, 0.1), (0.95, 1.0, 0.1), (1.2, 1.0, 0.1), (0.5, None, None)], "m double, now double, spread double")
    assert [r[0] for r in rows.select(experiments.adopted(F.col("m"), F.col("now"), F.col("spread"))).collect()] == [True, False, False, False]


def test_trials_repeat_for_a_seed_and_hold_the_current_ones():
    a = experiments.random_trials(5, seed=1)
    assert a == experiments.random_trials(5, seed=1) != experiments.random_trials(5, seed=2)
    assert [t.value for t in a if t.current] == list(experiments.CURRENT.values())
    assert len(set(a)) == len(a) == 3 + 5 + 3 + 5  # a seasonal average has three other settings only
    for t in a:
        assert experiments.SPACE[t.model][0] <= t.value <= experiments.SPACE[t.model][1]


def test_wrapped_quantiles_lie_on_the_line(spark):
    rows = spark.createDataFrame([(2.0, 4.0, 10.0), (0.0, 0.0, 0.0)], "pred_lo double, y_pred double, pred_hi double")
    got = intervals.wrapped_quantiles(rows, (0.01, 0.05, 0.275, 0.5, 0.725, 0.99), 0.1).first()
    assert [got[c] for c in ("pred_q01", "pred_q05", "pred_q28", "pred_q50", "pred_q72", "pred_q99")] == pytest.approx([2.0, 2.0, 3.0, 4.0, 7.0, 10.0])
    own = intervals.wrapped_quantiles(rows.withColumn("pred_q50", F.lit(9.0)), (0.5,), 0.1)
    assert [r["pred_q50"] for r in own.collect()] == [9.0, 9.0]


def test_typed_results(spark, panel):
    empty = forecast.empty_result(spark)
    assert empty.isEmpty() and dict(empty.dtypes) == forecast.RESULT_TYPES
    result = forecast.backtest(panel, forecast.folds(panel), ("naive",))
    loose = result.withColumns({"origin": F.col("origin").cast("string"), "y_pred": F.col("y_pred").cast("float"), "note": F.lit("x")})
    done = forecast.cast_result(loose)
    assert done.columns == loose.columns and {c: t for c, t in done.dtypes if c != "note"} == forecast.RESULT_TYPES
    assert empty.unionByName(forecast.cast_result(result)).count() == result.count() == 3 * 8 * 7


def test_indexes_and_names(spark):
    index = spark.createDataFrame([("1_2", "2024-05-01", "3", 1), ("1_3", "2024-05-02 00:00:00", "x", 2), (None, None, None, None)], "series_id string, dt string, h string, other int")
    done = panel_checks.normalize_future_index(index)
    assert dict(done.dtypes) == {"series_id": "string", "dt": "date", "h": "int", "other": "int"}
    assert [(r["dt"], r["h"]) for r in done.collect()] == [(date(2024, 5, 1), 3), (date(2024, 5, 2), None), (None, None)]
    names = spark.createDataFrame([(0.0,) * 4], ["latent_lag_7", "discount", "zero_share_28", "h"])
    assert features.lag_feature_names(names) == ["latent_lag_7", "zero_share_28"]
