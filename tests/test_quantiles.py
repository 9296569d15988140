"""Exact selection, forecasts beyond the panel and Croston at every origin, against plain Python."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from stallwise.operators import forecast, intervals, triage
from stallwise.operators.quantiles import below, exact_quantiles, levels


def test_exact_quantiles_equal_sorting(spark):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [float(rng.randint(0, 3)) for _ in range(300)], "c": [7.0], "d": [1.0, 2.0], "e": [None, None]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    at = (0.0, 0.05, 0.5, 0.625, 0.99, 1.0)
    for few in (0, 1_000_000):
        got = {r["g"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["g"], "x", levels(*at), bins=16, few=few).collect()}
        assert set(got) == {"a", "b", "c", "d"}
        for g, (n, q) in got.items():
            assert n == len(groups[g]) and np.allclose(q, np.quantile(groups[g], at), rtol=1e-12, atol=1e-12)
    whole = exact_quantiles(df, [], "x", levels(0.5), few=0).first()
    assert np.isclose(whole["q"][0], np.quantile([v for _, v in rows if v is not None], 0.5))
    assert exact_quantiles(df.limit(0), ["g"], "x", levels(0.5)).count() == 0


def test_concentration_shares_equal_ranking(spark):
    rng = random.Random(8)
    values = {f"s{i}": float(rng.choice([0, 1, 1, 2, 5, 50])) for i in range(57)}
    df = spark.createDataFrame([(s, v / 2) for s, v in values.items() for _ in range(2)], "series_id string, cost_policy double")
    ranked = sorted(values.values(), reverse=True)
    for r in triage.concentration(df).collect():
        m = int(np.ceil(r["top"] * len(ranked)))
        assert np.isclose(r["share"], sum(ranked[:m]) / sum(ranked))


def panel(spark, days=70):
    rng, first = random.Random(1), datetime.date(2024, 1, 1)
    rows = [(f"s{s}", first + datetime.timedelta(d), float(rng.choice([0, 0, 1, 3]) * (s + 1)), 1.0, False) for s in range(4) for d in range(days)]
    return rows, spark.createDataFrame(rows, "series_id string, dt date, demand_latent double, available_weight double, is_censored boolean").withColumn("sale_amount", F.col("demand_latent"))


def test_croston_at_every_origin_and_beyond_the_panel(spark):
    rows, df = panel(spark)
    folds = forecast.folds(df, n_origins=4)
    origins = {r["origin"]: r["origin_date"] for r in folds.collect()}

    def croston(ys):
        size, gap, since = None, 1.0, 1.0
        for y in ys:
            if y > 0:
                size, gap, since = (y, since, 1.0) if size is None else (0.1 * y + 0.9 * size, 0.1 * since + 0.9 * gap, 1.0)
            else:
                since += 1
        return 0.0 if size is None else 0.95 * size / max(gap, 1.0)

    got = {(r["origin"], r["series_id"]): r["y_pred"] for r in forecast.croston_levels(df, folds).collect()}
    assert len(got) == 16
    for (origin, series), y in got.items():
        assert np.isclose(y, croston([v for s, d, v, *_ in rows if s == series and d <= origins[origin]]))
    said = forecast.beyond(df, ("moving_average", "croston", "weekly_profile")).collect()
    last = max(r[1] for r in rows)
    assert len(said) == 4 * 7 * 3 and {(r["dt"] - last).days for r in said} == set(range(1, 8))
    for r in said:
        own = [(d, v) for s, d, v, *_ in rows if s == r["series_id"]]
        expected = {"moving_average": np.mean([v for _, v in own[-21:]]), "croston": croston([v for _, v in own]), "weekly_profile": np.mean([v for d, v in own if d.weekday() == r["dt"].weekday()])}
        assert np.isclose(r["y_pred"], expected[r["model"]])
    assert forecast.beyond(df.limit(0)).count() == 0


def test_conformal_widths_pool_short_steps(spark):
    """A step with too few scores takes the quantile of all steps."""
    rng = random.Random(2)
    rows = [("m", h, rng.random()) for h in (1, 1, 2) for _ in range(30)] + [("m", 3, 9.0)] * 3
    got = {r["h"]: r["q"] for r in intervals.by_step(spark.createDataFrame(rows, "model string, h int, s double"), "s", 0.1).collect()}
    for h in (1, 2, 3):
        own = [s for _, k, s in rows if k == h]
        own = own if len(own) >= 20 else [s for *_, s in rows]
        level = min(np.ceil((len(own) + 1) * 0.9) / len(own), 1.0)
        assert np.isclose(got[h], np.quantile(own, level))


def test_cuts_below_a_value_are_counted_by_halving(spark):
    """As many as by looking at every cut, for arrays of any length, repeats and ends among them."""
    cuts = [sorted(float(x * x % 17) for x in range(n)) for n in (0, 1, 2, 3, 4, 7, 8, 100, 254, 255)]
    rows = spark.createDataFrame([(c, v / 2) for c in cuts for v in range(-2, 36)] + [(cuts[-1], float("nan"))], "c array<double>, v double")
    got = rows.select(below(F.col("c"), F.col("v"), 255).alias("got"), F.size(F.filter("c", lambda c: c < F.col("v"))).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in got) and max(r["got"] for r in got) == 255
