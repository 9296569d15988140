"""Panels, recovery, features and decisions on small literals with values worked out by hand."""

import datetime as dt
import functools
import itertools
import operator

import pytest
from pyspark.sql import functions as F

from stallwise.functions import arrays, calendar
from stallwise.operators import decision, features, forecast, ingest, leakage, metrics, panel_checks, recovery, triage
from stallwise.sources import panels

DAY = dt.date(2024, 1, 1)


def daily(spark, values, series="1_1", start=DAY, censored=()):
    rows = [(series, start + dt.timedelta(k), float(v), float(v), k in censored, 1.0, 0, 1, 1, 1, 1.0, 0) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, dt date, sale_amount double, demand_latent double, is_censored boolean, available_weight double, oos_hours_day int, store_id int, product_id int, third_category_id int, discount double, activity_flag int")


def hourly(spark, rows):
    """rows: (store, product, day, hours out, sale per open hour in stock)."""
    data = []
    for store, product, day, out, sale in rows:
        flags = [int(h in out) for h in range(24)]
        sales = [0.0 if flags[h] or not 6 <= h <= 21 else float(sale) for h in range(24)]
        data.append((store, product, product % 5, DAY + dt.timedelta(day), sales, flags, sum(sales), sum(flags[6:22])))
    return panels.build_panel(spark.createDataFrame(data, "store_id int, product_id int, third_category_id int, dt date, hours_sale array<double>, hours_stock_status array<int>, sale_amount double, stock_hour6_22_cnt int"))


def test_recovery_undoes_lost_hours(spark):
    panel = hourly(spark, [(1, 1, d, (), 2.0) for d in range(20)] + [(1, 1, 20, range(6, 14), 2.0), (1, 1, 21, range(6, 22), 2.0), (1, 1, 22, range(6, 20), 2.0)])
    got = {r["dt"]: r for r in recovery.recover_by_profile(panel).collect()}
    at = lambda d: got[DAY + dt.timedelta(d)]
    assert at(0)["demand_latent"] == 32.0 and at(0)["inflation_factor"] == 1.0
    assert at(20)["demand_latent"] == pytest.approx(32.0) and at(20)["profile_share"] == pytest.approx(0.5)
    assert at(21)["demand_latent"] == 0.0 and at(22)["demand_latent"] == 4.0  # too little of the day is left to correct


def test_contradicting_hours_fail(spark):
    raw = hourly(spark, [(1, 1, 0, (7,), 1.0)]).withColumn("stock_hour6_22_cnt", F.lit(3))
    with pytest.raises(Exception, match="contradict"):
        panels.build_panel(raw).collect()


def test_violations_and_gaps(spark):
    good = daily(spark, [1, 2, 3]).withColumn("stock_hour6_22_cnt", F.lit(0))
    bad = good.unionByName(good.limit(1)).withColumn("sale_amount", F.when(F.col("sale_amount") == 2, -1.0).otherwise(F.col("sale_amount")))
    found = {r["rule"]: r["violations"] for r in panel_checks.panel_violations(bad).collect()}
    assert found["negative_sale"] == 1 and found["duplicate_key"] == 1 and found["series_with_gaps"] == 0
    assert panel_checks.series_with_gaps(good.filter("sale_amount != 2")).first()["missing_days"] == 1
    dense = panel_checks.densify(good.filter("sale_amount != 2"), static=("store_id", "product_id")).orderBy("dt").collect()
    assert [r["sale_amount"] for r in dense] == [1.0, 0.0, 3.0]


def test_windows_close_at_the_day(spark):
    state = features.origin_state(daily(spark, range(1, 31))).orderBy("dt").collect()
    last = state[-1]
    assert last["latent_lag_0"] == 30 and last["latent_lag_7"] == 23 and last["latent_roll_mean_7"] == 27 and last["latent_roll_median_14"] == 23.5
    assert state[0]["latent_lag_1"] is None and state[0]["latent_roll_mean_7"] is None and last["days_since_sale"] == 0


def test_future_index_must_not_know(spark):
    with pytest.raises(ValueError, match="sale_amount"):
        panel_checks.check_future_index(daily(spark, [1]))


def test_easter_and_distance(spark):
    days = {r["holiday"] for r in calendar.holidays(spark, 2024, 2025).collect()}
    assert {dt.date(2024, 3, 28), dt.date(2024, 3, 29), dt.date(2025, 4, 18)} <= days and len(days) == 24
    one = calendar.with_holiday_distance(spark.createDataFrame([(dt.date(2024, 12, 23),), (dt.date(2024, 12, 25),)], "dt date"), calendar.holidays(spark, 2024, 2024))
    assert [(r["days_to_holiday"], r["is_holiday"]) for r in one.orderBy("dt").collect()] == [(-2, 0), (0, 1)]


def test_folds_and_baselines(spark):
    panel = daily(spark, [k % 7 for k in range(70)])
    folds = forecast.folds(panel, n_origins=3)
    assert [r["origin_date"] for r in folds.orderBy("origin").collect()] == [DAY + dt.timedelta(k) for k in (56, 59, 62)]
    got = forecast.backtest(panel, folds, ("seasonal_naive", "naive", "seasonal_ar"))
    error = {r["model"]: r["mae"] for r in metrics.by(got).collect()}
    assert error["seasonal_naive"] == 0 and error["naive"] > 1
    assert {r["violations"] for r in forecast.result_violations(got).filter("rule != 'scale_not_positive'").collect()} == {0}
    with pytest.raises(Exception, match="too short"):
        forecast.folds(panel, n_origins=30).collect()


def test_croston_of_a_steady_item(spark):
    one = spark.createDataFrame([([0.0, 4.0] * 10,), ([0.0] * 5,)], "y array<double>")
    assert [round(r[0], 6) for r in one.select(forecast.croston(F.col("y"))).collect()] == [1.9, 0.0]


def test_expectations_of_a_uniform_demand(spark):
    levels = tuple(k / 100 for k in range(1, 100))
    row = spark.range(1).select(*(F.lit(10 * q).alias(arrays.quantile_name(q)) for q in levels), F.lit(6.25).alias("qty"))
    got = row.select(*(c.alias(n) for n, c in decision.expected(levels, F.col("qty")).items())).first()
    assert got["expected_shortage"] == pytest.approx((10 - 6.25) ** 2 / 20, abs=2e-3)
    assert got["expected_waste"] - got["expected_shortage"] == pytest.approx(6.25 - got["expected_demand"], abs=1e-9)
    assert decision.Economics().level == 0.625 and arrays.quantile_name(0.625) == "pred_q62"


def test_merge_is_idempotent(spark):
    now = hourly(spark, [(1, 1, d, (), 1.0) for d in range(3)])
    batch = hourly(spark, [(1, 1, 2, (), 1.0), (1, 1, 3, (), 2.0), (2, 1, 0, (), 1.0)])
    compared = ("sale_amount", "hours_sale", "hours_stock_status")
    first = ingest.classify(now, batch, compared)
    row = ingest.report(now, first).first()
    assert (row["n_new"], row["n_duplicate"], row["n_conflict"], row["n_new_series"]) == (2, 1, 0, 1)
    merged = ingest.merge(now, first)
    again = ingest.report(merged, ingest.classify(merged, batch, compared)).first()
    assert merged.count() == 5 and again["n_duplicate"] == 3
    clash = ingest.classify(now, hourly(spark, [(1, 1, 2, (), 5.0)]), compared)
    assert ingest.merge(now, clash, "reject").agg(F.sum("sale_amount")).first()[0] == 48.0
    assert ingest.merge(now, clash, "replace").agg(F.sum("sale_amount")).first()[0] == 112.0


def test_inbox_upserts_once(spark, tmp_path):
    from stallwise.streaming.inbox import watch

    def raw(rows):
        panel = hourly(spark, rows)
        have = {f.name for f in panels.RAW_SCHEMA} & set(panel.columns)
        return panel.select(*(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in panels.RAW_SCHEMA))

    layer, inbox = str(tmp_path / "layer"), str(tmp_path / "inbox")
    ingest.start_layer(panels.build_panel(raw([(1, 1, d, (), 1.0) for d in range(15)])).withColumn("split", F.lit("train")), layer)
    raw([(1, 1, 15, (7, 8), 1.0)]).write.parquet(inbox)
    watch(spark, inbox, layer, str(tmp_path / "state"), ("sale_amount", "hours_sale")).awaitTermination()
    log = ingest.read_log(spark, layer).orderBy("at").collect()
    assert [r["status"] for r in log] == ["written", "written"] and log[-1]["n_new"] == 1
    assert panels.load_layer(spark, f"{layer}/{log[-1]['version']}").count() == 16


def test_the_hash_of_a_batch_follows_its_rows_and_not_their_order(spark):
    batch = hourly(spark, [(s, 1, d, (7,), 1.5) for s in range(3) for d in range(6)])
    mark = lambda df: tuple(ingest.batch_hash(df).first())
    assert mark(batch) == mark(batch.orderBy(F.desc("dt")).repartition(3)) == mark(batch.select(*reversed(batch.columns)))
    assert mark(batch) != mark(batch.limit(17)) and mark(batch) != mark(batch.unionByName(batch.limit(1)))
    assert mark(batch) != mark(batch.withColumn("sale_amount", F.col("sale_amount") + 1e-4))
    assert mark(batch) != mark(batch.withColumn("sale_amount", F.lit(None).cast("double")))
    assert mark(batch.limit(0)) == (0, "0")


def test_a_replayed_batch_changes_nothing_and_a_dry_run_writes_nothing(spark, tmp_path):
    layer = str(tmp_path / "layer")
    ingest.start_layer(hourly(spark, [(1, 1, d, (), 1.0) for d in range(15)]).withColumn("split", F.lit("train")), layer)
    raw = lambda rows: hourly(spark, rows).drop("series_id", "oos_hours_day", "available_weight", "is_censored")
    compared = ("sale_amount", "hours_sale", "hours_stock_status")
    tried = [
        ingest.ingest(spark, raw([(1, 1, 15, (), 1.0)]), layer, compared, dry_run=True).first(),
        ingest.ingest(spark, raw([(1, 1, 15, (), 1.0)]), layer, compared).first(),
        ingest.ingest(spark, raw([(1, 1, 15, (), 1.0)]), layer, compared).first(),
        ingest.ingest(spark, raw([(1, 1, 15, (), 9.0)]), layer, compared).first(),
        ingest.ingest(spark, raw([(1, 1, 15, (), 9.0)]), layer, compared, "replace").first(),
    ]
    assert [r["status"] for r in tried] == ["dry run", "written", "no change", "rejected", "written"]
    assert [r["version"] for r in tried] == ["v000000", "v000001", "v000001", "v000001", "v000002"]
    log = ingest.read_log(spark, layer)
    trained = spark.createDataFrame([(DAY + dt.timedelta(10),)], "trained_until date")
    got = ingest.status(log, trained).first()
    assert (got["version"], got["n_written"], got["n_rejected"], got["n_no_change"], got["n_dry_run"], got["days_behind"]) == ("v000002", 3, 1, 1, 1, 5)
    assert panels.load_layer(spark, f"{layer}/v000002").agg(F.sum("sale_amount")).first()[0] == 15 * 16 + 9 * 16


def test_planted_leaks_are_found(spark):
    panel = daily(spark, range(20)).unionByName(daily(spark, range(5, 25), "2_1"))
    leaky = panel.withColumn("lagged", F.lag("demand_latent", 1).over(__import__("pyspark").sql.Window.orderBy("series_id", "dt")))
    found = {r["rule"]: r["violations"] for r in leakage.lag_violations(leaky, "lagged", "demand_latent", 1).collect()}
    assert found["crosses_series"] == 1
    rows = spark.createDataFrame([("a", DAY, h, float(h), float(h)) for h in range(40)], "series_id string, origin_date date, h int, y double, x double")
    assert leakage.varying_features(rows).first()["feature"] == "x"
    assert leakage.target_correlations(rows, ["x"]).first()["leaks"]


def test_triage_reasons(spark):
    signals = triage.series_signals(daily(spark, [10] * 40, censored=range(34, 40)).unionByName(daily(spark, [1] * 40, "2_1")))
    marked = {r["series_id"]: r for r in triage.triage(signals).collect()}
    assert marked["1_1"]["reasons"] == "high_volume, out_now" and marked["1_1"]["current_run"] == 6 and marked["2_1"]["n_reasons"] == 0


def test_a_version_is_recovered_once_and_judged_as_written(spark, tmp_path, monkeypatch):
    """The rules are checked on the files of the new version, not on a second making of it."""
    layer, compared, judged = str(tmp_path / "layer"), ("sale_amount", "hours_sale"), []
    raw = lambda days: hourly(spark, days).drop("series_id", "oos_hours_day", "available_weight", "is_censored")
    ingest.start_layer(hourly(spark, [(1, 1, d, (), 1.0) for d in range(15)]).withColumn("split", F.lit("train")), layer)
    monkeypatch.setattr(ingest, "panel_violations", lambda df: judged.extend(df.inputFiles()) or panel_checks.panel_violations(df))
    assert ingest.ingest(spark, raw([(1, 1, 15, (), 1.0)]), layer, compared).first()["status"] == "written"
    assert judged and all("/v000001/" in f for f in judged)


def test_profiles_group_days_before_the_sets_repeat_them(spark):
    """Grouping sets repeat a row for each level and hour, so they have to follow a first grouping."""
    panel = hourly(spark, [(1, p, d, (8, 9) if d % 3 == 0 else (), 1.0 + p) for p in (1, 2) for d in range(30)])
    profiles = recovery.hourly_profiles(panel, recovery.Censoring(min_hours_for_profile=1))
    steps = profiles._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in steps[steps.index("Expand") :]
    got = {(r["level"], r["key"], r["h"]): (r["clean_hours"], r["weight"]) for r in profiles.collect()}
    assert got["global", None, 7] == (2 * (30 * 16 - 10 * 2), 1 / 16) and len(got) == 16 * (2 + len({k for level, k, _ in got if level == "third_category_id"}) + 1)


def test_numbers_of_a_batch_are_written_as_the_format_writes_them(spark):
    numbers = [0.0, -0.0, 0.5e-6, 1.5e-6, -1e-9, -2.5, 1 / 3, 123456.7890125, 99999999999.9999995, 1e11, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    wanted = F.coalesce(F.format_string("%.6f", F.col("x") + F.lit(0.0)), F.lit("-"))
    text = ingest._text("x", "double")
    assert "decimal(18,6)" in df.select(text)._jdf.queryExecution().analyzed().toString().lower()
    assert df.filter(text != wanted).count() == 0


def test_mean_discounts_do_not_depend_on_how_the_joins_run(spark, tmp_path):
    """Eight discounts whose exact mean is a tie: their doubles add up to it in the table's order, and to less in that of the parts."""
    plain = lambda x: functools.reduce(operator.add, (1.0 - v for v in x), 0.0) / 8  # noqa: E731  (sum makes up for roundings)
    given = [0.09, 0.1, 0.01, 0.04, 0.1, 0.0, 0.03, 0.08]
    below = next(p for p in itertools.permutations(range(8)) if plain(given[k] for k in p) < 0.94375)
    assert plain(given) == 0.94375
    part_of = {k: n for n, k in enumerate(below)}
    lines = [(part_of[k], 1, 1.0, d, "N", dt.datetime(1998, 2, 25)) for k, d in enumerate(given)]
    tables = {
        "lineitem": (lines, "l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string, l_shipdate timestamp"),
        "part": ([(k, 8) for k in range(8)], "p_partkey long, p_size int"),
        "supplier": ([(1, 1)], "s_suppkey long, s_nationkey int"),
        "nation": ([(1, 3)], "n_nationkey int, n_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for limit in ("-1", "10MB"):
            for key in keys:
                spark.conf.set(key, limit)
            assert [r["discount"] for r in panels.daily_sales(spark, str(tmp_path)).collect()] == [0.9438]
    finally:
        for key in keys:
            spark.conf.unset(key)
