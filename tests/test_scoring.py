"""Scoring from a frozen state, training on both bases, shuffled labels and ranks."""

import random
import warnings
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stallwise.operators import boosting, experiments, features, leakage, numbering, panel_checks, scoring, triage


@pytest.fixture(scope="module")
def panel(spark):
    """40 series of 70 days; on a third of the days two fifths of the demand are lost, and recovery knows how much."""
    rng, rows = np.random.default_rng(7), []
    for s in range(40):
        for d in range(70):
            demand = float(rng.poisson((4 + s % 5 * 3) * (1.6 if d % 7 == 5 else 1.0)))
            out = bool(rng.random() < 0.33)
            rows.append((f"{s % 4}_{s}", s % 4, s, s % 3, date(2024, 1, 1) + timedelta(days=d), round(demand * 0.6, 4) if out else demand, demand, 1.0, 0, out, 0.6 if out else 1.0, 6 if out else 0))
    schema = "series_id string, store_id int, product_id int, third_category_id int, dt date, sale_amount double, demand_latent double, discount double, activity_flag int, is_censored boolean, available_weight double, oos_hours_day int"
    return spark.createDataFrame(rows, schema).persist()


def ago(panel, *days):
    last = panel.agg(F.max("dt").alias("last"))
    return last.select(F.explode(F.array(*(F.date_sub("last", d) for d in days))).alias("origin_date"))


@pytest.mark.parametrize("conformal", ["cqr", "adaptive"])
def test_the_recovered_basis_takes_the_bias_away(panel, conformal):
    rows = experiments.train_bases(panel, ago(panel, *range(21, 35, 2)), ago(panel, 14), ago(panel, 7), params=boosting.Params(rounds=8, depth=3), conformal=conformal)
    got = {r["basis"]: r for r in experiments.compare_bases(rows).collect()}
    assert got["observed"]["n"] == got["recovered"]["n"] == 40 * 7
    assert got["observed"]["clean_day_bias"] < -0.04 and abs(got["recovered"]["clean_day_bias"]) < 0.08
    assert got["recovered"]["clean_day_bias"] - got["observed"]["clean_day_bias"] > 0.05
    for r in got.values():
        assert r["coverage"] > 0.8 and r["mean_width"] > 0


def test_parts_that_reach_into_each_other_are_refused(panel):
    with pytest.raises(ValueError, match="reach into"):
        experiments.train_bases(panel, ago(panel, 20), ago(panel, 14), ago(panel, 7))


@pytest.fixture(scope="module")
def state(panel):
    return scoring.save_state(features.origin_state(panel), buckets=4)


def grid(panel, horizon=3):
    index = panel_checks.series_index(panel)
    plan = panel.agg(F.lit(0.9).alias("discount"), F.lit(1).alias("activity_flag"))
    return scoring.with_hierarchy(scoring.future_grid(index.select("series_id"), ago(panel, 0), plan, horizon), index)


def test_scoring_rows_have_the_last_days_state_and_what_is_known_ahead(spark, panel, state):
    rows = scoring.scoring_rows(spark, state, grid(panel)).toPandas()
    assert len(rows) == 120 and set(rows["h"]) == {1, 2, 3} and set(rows["discount"]) == {0.9} and set(rows["activity_flag"]) == {1}
    last = panel.filter(F.col("dt") == "2024-03-10").select("series_id", "demand_latent").toPandas().set_index("series_id")["demand_latent"]
    assert (rows["latent_lag_0"].to_numpy() == last[rows["series_id"]].to_numpy()).all()
    assert "sale_amount" not in rows and (rows["dow"] == pd.to_datetime(rows["dt"]).dt.weekday).all()


def test_the_state_is_joined_where_it_lies(spark, panel, state):
    """The side of the state is not moved."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scoring.scoring_rows(spark, state, grid(panel))._jdf.queryExecution().executedPlan().toString()
        # The tree's last branch is the join's right side; deeper lines follow their parents.
        right = plan[plan.rindex("+- ", 0, plan.index("Bucketed: true")) :]
        above = plan[plan.index("SortMergeJoin") : plan.index("Bucketed: true")].rsplit(":", 1)[-1]
        assert "FileScan" in right and "Exchange" not in above, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_rows_without_a_state_are_an_error_and_few_a_warning(spark, panel, state):
    future = grid(panel)
    new = future.filter("series_id like '0_%' and product_id < 8").withColumn("series_id", F.concat(F.lit("new"), "series_id"))
    with pytest.warns(UserWarning, match="no state"):
        rows = scoring.scoring_rows(spark, state, future.unionByName(new))
    assert rows.filter("latent_lag_0 is null").count() == new.count() == 6
    with pytest.raises(ValueError, match="have no state"):
        scoring.scoring_rows(spark, state, future.withColumn("series_id", F.concat(F.lit("new"), "series_id")))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        scoring.scoring_rows(spark, state, future)


def test_a_series_without_hierarchy_fails(panel):
    index = panel_checks.series_index(panel)
    with pytest.raises(Exception, match="without hierarchy: ghost"):
        scoring.with_hierarchy(index.select(F.lit("ghost").alias("series_id"), F.lit(1).alias("h")), index).collect()


def test_labels_are_shuffled_over_the_whole_table(spark):
    rows = [(f"s{i % 30}", i // 30, float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "series_id string, dt int, y double").repartition(7)
    got = leakage.shuffled(df, "y").collect()
    assert sorted(r["y"] for r in got) == sorted(r[2] for r in rows) and {(r["series_id"], r["dt"]) for r in got} == {r[:2] for r in rows}
    was = {r[:2]: r[2] for r in rows}
    series_moved = np.mean([int(r["y"]) % 30 != int(r["series_id"][1:]) for r in got])
    assert series_moved > 0.9 and np.mean([was[r["series_id"], r["dt"]] == r["y"] for r in got]) < 0.02
    # Far from where they were: no salt or range keeps values together.
    place = {k: n for n, k in enumerate(sorted(was))}
    moves = [abs(place[r["series_id"], r["dt"]] - place[f"s{int(r['y']) % 30}", int(r["y"]) // 30]) for r in got]
    assert 250 < np.mean(moves) < 350
    assert sorted(map(tuple, leakage.shuffled(df.repartition(2), "y").collect())) == sorted(map(tuple, got))


def test_shuffled_labels_betray_a_leak(spark):
    rng = random.Random(1)
    rows = [(f"s{i % 20}", i, 10.0 * (i % 20) + rng.random(), i >= 400) for i in range(500)]
    df = spark.createDataFrame(rows, "series_id string, dt int, y double, late boolean")
    train, test = df.filter("not late"), df.filter("late")

    def honest(train, test):
        return test.join(train.groupBy("series_id").agg(F.avg("y").alias("y_pred")), "series_id").select(F.col("y").alias("y_true"), "y_pred")

    def leaking(train, test):
        return test.select(F.col("y").alias("y_true"), (F.col("y") + 1).alias("y_pred"))

    assert leakage.shuffle_test(honest, train, test).first()["passes"]
    assert not leakage.shuffle_test(leaking, train, test).first()["passes"]


def test_numbers_ranks_and_sums_equal_those_of_one_order(spark):
    rng = random.Random(2)
    values = [rng.choice([None, *range(40)]) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v int").repartition(5)
    want = pd.Series(values, dtype="float64").rank()
    got = numbering.ranks(df, "v").toPandas().set_index("id")["rank"].sort_index()
    assert np.allclose(got.fillna(-1), want.fillna(-1))
    placed = {r["id"]: r["n"] for r in numbering.numbered(df, ("v", "id")).collect()}
    assert [placed[i] for i in sorted(range(600), key=lambda i: (values[i] is not None, values[i] or 0, i))] == list(range(600))
    assert numbering.numbered(df.limit(0), ("v",)).count() == 0


def test_overlap_of_axes(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.integers(0, 30, 300).astype(float), "b": rng.random(300)})
    frame["c"] = frame["a"] + rng.random(300)
    frame.loc[::9, "b"] = np.nan
    frame["series_id"] = [f"s{i:03d}" for i in range(300)]
    df = spark.createDataFrame(frame.replace({np.nan: None})[["series_id", "a", "b", "c"]].values.tolist(), "series_id string, a double, b double, c double")
    got = {(r["axis_a"], r["axis_b"]): r for r in triage.axis_overlap(df, ("a", "b", "c"), 50).collect()}
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        both = frame[[x, y]].dropna()
        tops = [set(frame.dropna(subset=[k]).sort_values([k, "series_id"], ascending=[False, True])["series_id"][:50]) for k in (x, y)]
        assert got[x, y]["spearman"] == pytest.approx(both[x].rank().corr(both[y].rank())) and got[x, y]["n_both"] == len(both)
        assert got[x, y]["overlap"] == pytest.approx(len(tops[0] & tops[1]) / 50)


def test_pages_have_totals_and_filters(spark):
    rows = [(f"{s}_{p}", s, p, p % 3, ("low", "high")[p % 2]) for s in range(3) for p in range(7)]
    index = spark.createDataFrame(rows, "series_id string, store_id int, product_id int, third_category_id int, rotation_band string")
    got = triage.catalogue_page(index, "shop 1", store_id=1, band="low", limit=2, offset=1).collect()
    assert [(r["series_id"], r["total"]) for r in got] == [("1_2", 4), ("1_4", 4)]
    assert triage.catalogue_page(index, "item group").count() == 21 and triage.catalogue_page(index, "nothing").count() == 0
    assert triage.catalogue_page(index, offset=50).count() == 0
    with pytest.raises(ValueError, match="page"):
        triage.catalogue_page(index, limit=0)
    marked = spark.createDataFrame([(r[0], float(r[2]), r[2] > 4, r[1] == 2) for r in rows], "series_id string, mean_demand double, high_volume boolean, out_now boolean").selectExpr("*", "int(high_volume) + int(out_now) as n_reasons")
    page = triage.alerts(marked, index, "out_now", store_id=2, band="high", limit=2).collect()
    assert [(r["series_id"], r["total"]) for r in page] == [("2_5", 3), ("2_3", 3)]
    assert [r["series_id"] for r in triage.alerts(marked, index, series=["0_6", "2_0", "0_1"]).collect()] == ["0_6", "2_0"]
    assert triage.missing_reasons(marked) == ["unreliable", "scarce_signal", "waste_risk"]
    with pytest.raises(ValueError, match="can't tell"):
        triage.alerts(marked, index, "waste_risk")
    totals = triage.alert_totals(marked).first()
    assert (totals["n_series"], totals["n_flagged"], totals["n_several"]) == (21, 11, 2) and totals["share_flagged"] == pytest.approx(11 / 21)


def test_crossed_and_missing_quantiles_are_counted(spark):
    from stallwise.operators import forecast

    rows = [(0, 1.0, 2.0, 3.0, 1.0, 3.0), (0, 2.0, 1.0, 3.0, 1.0, 3.0), (1, None, 1.0, 0.5, 4.0, 3.0)]
    df = spark.createDataFrame(rows, "origin int, a double, b double, c double, pred_lo double, pred_hi double")
    got = {r["rule"]: r["violations"] for r in forecast.quantile_violations(df, ("a", "b", "c"), 3).collect()}
    assert got == {"quantiles_cross": 2, "quantile_missing": 1, "too_few_origins": 1, "interval_inverted": 1}
    assert forecast.quantile_violations(df.select("origin", "a", "b"), ("a", "b")).count() == 3
