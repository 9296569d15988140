"""The detector of anomalous windows: paths against a walk by hand, verdicts that don't depend on the batch."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import window_forest

SCHEMA = "series_id string, dt date, is_censored boolean, demand_latent double"


@pytest.fixture(scope="module")
def panel(spark):
    """20 series of 60 steady days; the last has a burst from the 50th day on, another sells nothing."""
    rng, rows = np.random.default_rng(3), []
    for s in range(20):
        for d in range(60):
            v = 0.0 if s == 18 else float(rng.normal(10 * (s + 1), 0.5 * (s + 1)))
            rows.append((f"s{s:02d}", date(2024, 1, 1) + timedelta(days=d), d % 9 == 0, v * (6 if s == 19 and d >= 50 else 1)))
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="module")
def early(panel):
    """45 days of the series that sell; the one that does not would be the strange share by itself."""
    return panel.filter((F.col("dt") < F.lit("2024-02-15").cast("date")) & (F.col("series_id") != "s18"))


@pytest.fixture(scope="module")
def detector(early):
    return window_forest.fit(window_forest.demand_windows(early), trees=60, sample=128)


def walk(tree, point, node=0, depth=0):
    if tree["feature"][node] < 0:
        return depth + float(window_forest.usual_path(np.array([tree["n"][node]]))[0])
    side = "low" if point[tree["feature"][node]] < tree["cut"][node] else "high"
    return walk(tree, point, tree[side][node], depth + 1)


def test_paths_equal_a_walk_by_hand():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (90, 3)).astype(float)
    tree = window_forest.grow(points, rng)
    assert np.allclose(window_forest.depths(tree, points), [walk(tree, p) for p in points])
    leaves = [n for f, n in zip(tree["feature"], tree["n"]) if f < 0]
    assert sum(leaves) == 90 and min(leaves) > 0


def test_equal_points_are_one_leaf():
    tree = window_forest.grow(np.ones((5, 2)), np.random.default_rng(0))
    assert tree["n"] == [5] and np.allclose(window_forest.depths(tree, np.ones((1, 2))), window_forest.usual_path(np.array([5])))


def test_threshold_marks_the_share_of_what_was_fitted(early, detector):
    judged = window_forest.judge(detector, window_forest.demand_windows(early))
    values = np.sort([r["score"] for r in judged.collect()])
    assert len(values) == detector.n_windows == 19 * 32
    assert detector.threshold == pytest.approx(np.quantile(values, 0.01))
    assert judged.filter("anomalous").count() == (values <= detector.threshold).sum()


def test_a_burst_is_found_and_verdicts_stay_as_they_are(panel, early, detector):
    known = window_forest.series_levels(early)
    whole = window_forest.judge(detector, window_forest.demand_windows(panel, known=known)).collect()
    burst = [r for r in whole if r["series_id"] == "s19" and r["dt"] >= date(2024, 2, 25)]
    assert burst and all(r["anomalous"] for r in burst)
    strangest = sorted((r["score"], r["series_id"]) for r in whole if r["series_id"] != "s18")[:5]
    assert {s for _, s in strangest} == {"s19"}
    others = [r for r in whole if r["series_id"] not in ("s18", "s19")]
    assert sum(r["anomalous"] for r in others) < 0.15 * len(others)
    alone = window_forest.judge(detector, window_forest.demand_windows(panel.filter("series_id in ('s03', 's19')"), known=known)).collect()
    by_key = {(r["series_id"], r["dt"]): r["score"] for r in whole}
    assert alone and all(by_key[r["series_id"], r["dt"]] == r["score"] for r in alone)


def test_a_kept_detector_says_the_same(spark, tmp_path, panel, detector):
    detector.save(str(tmp_path / "detector"))
    windows = window_forest.demand_windows(panel)
    again = window_forest.judge(window_forest.load(spark, str(tmp_path / "detector")), windows)
    assert sorted(again.collect()) == sorted(window_forest.judge(detector, windows).collect())


def test_fit_does_not_depend_on_the_order_of_rows(early, detector):
    again = window_forest.fit(window_forest.demand_windows(early.repartition(5, "dt")), trees=60, sample=128)
    assert again.threshold == detector.threshold
    assert sorted(again.trees.collect()) == sorted(detector.trees.collect())


def test_edges(spark, panel, early):
    nothing = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="no series"):
        window_forest.fit(window_forest.demand_windows(nothing))
    holed = early.withColumn("demand_latent", F.when(F.dayofmonth("dt") != 20, F.col("demand_latent")))
    kept = window_forest.demand_windows(holed)
    assert kept.count() < window_forest.demand_windows(early).count() and kept.filter(F.exists("window", lambda x: x.isNull())).isEmpty()
    flat = window_forest.demand_windows(panel.filter("series_id = 's18'"))
    assert flat.filter(F.exists("window", lambda x: x != 0)).isEmpty() and flat.count() == 47


def test_contrast_counts_new_findings(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "anomalous boolean, is_censored boolean")
    got = window_forest.contrast_with_censoring(rows).first()
    assert (got["windows"], got["marked"], got["new_findings"], got["marked_stockout_rate"], got["panel_rate"]) == (4, 2, 1, 0.5, 0.5)
