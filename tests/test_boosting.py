"""Joint quantile trees and their Shapley values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import boosting

LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)


def fixed_rows(n, seed):
    rng = np.random.default_rng(seed)
    a, b, shop = rng.random(n), rng.integers(0, 7, n), rng.integers(0, 4, n)
    y = (1 + 4 * a + (b == 6) * 3 + shop) * (0.5 + rng.random(n))
    return [(int(i), float(x) if i % 11 else None, int(k), f"s{s}", float(v), float(v) / 2) for i, (x, k, s, v) in enumerate(zip(a, b, shop, y))]


@pytest.fixture(scope="module")
def fitted(spark):
    schema = "id long, a double, b int, shop string, y double, half double"
    train = spark.createDataFrame(fixed_rows(6000, 1), schema).repartition(4).persist()
    test = spark.createDataFrame(fixed_rows(3000, 2), schema).persist()
    heads = [boosting.Head("y", q) for q in LEVELS] + [boosting.Head("half", 0.5)]
    return boosting.fit(train, heads, ("a", "b"), ("shop",), boosting.Params(rounds=16, depth=3, write_every=6)), train, test


def test_each_level_covers_its_share_and_levels_never_cross(fitted):
    trees, train, test = fitted
    said = trees.predict(test).toPandas()
    names = [c for c in said.columns if c.startswith("pred_q")]
    assert len(names) == len(LEVELS)
    for name, level in zip(names, LEVELS):
        assert abs((said["y"] <= said[name]).mean() - level) < 0.03, name
    assert (np.diff(said[names].to_numpy(), axis=1) >= 0).all()
    # Better than constants by the pinball loss, and the other target's head is fitted to that target.
    y = said["y"].to_numpy()
    for name, level in zip(names, LEVELS):
        loss = lambda q: np.mean(np.maximum(level * (y - q), (level - 1) * (y - q)))  # noqa: B023, E731
        assert loss(said[name].to_numpy()) < 0.8 * loss(np.quantile(y, level))
    half = trees.predict(test, "half").toPandas()
    assert abs((half["half"] <= half["pred_q50"]).mean() - 0.5) < 0.03


def test_a_fit_does_not_depend_on_how_rows_are_dealt(fitted, spark):
    trees, train, _ = fitted
    few = boosting.Params(rounds=2, depth=2)
    a = boosting.fit(train, trees.heads[:2], ("a", "b"), (), few)
    b = boosting.fit(train.repartition(7, "b"), trees.heads[:2], ("a", "b"), (), few)
    assert all((x == y).all() for x, y in zip(a.feature + a.cut, b.feature + b.cut)) and np.allclose(a.value, b.value)


def test_contributions_add_up_and_equal_the_sums_over_subsets(fitted):
    trees, _, test = fitted
    head = trees.heads[2]
    rows = boosting.contributions(trees, test.limit(200), ("id",), head).toPandas()
    sums = rows.groupby("id").agg(total=("contribution", "sum"), base=("base", "first"), said=("prediction", "first"))
    assert np.allclose(sums["total"] + sums["base"], sums["said"], atol=1e-6) and len(sums) == 200
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 8, (6, 3)).astype(np.uint8)
    for r in range(3):
        tree = (trees.feature[r][2], trees.cut[r][2], trees.cover[r][2])
        mean, got = boosting.shapley(bins, tree, trees.value[r][2], trees.depth, 3)
        for row, b in zip(got, bins):
            assert np.allclose(row, boosting.by_subsets(b, tree, trees.value[r][2], trees.depth, 3), atol=1e-9)
        reached = trees.value[r][2][boosting.nodes_of(bins, tree[0], tree[1], trees.depth) - (1 << trees.depth) + 1]
        assert np.allclose(mean + got.sum(axis=1), reached)


def test_the_first_features_and_the_rest_add_up(fitted):
    trees, _, test = fitted
    whole = boosting.contributions(trees, test.limit(50), ("id",), trees.heads[0]).toPandas()
    top = boosting.contributions(trees, test.limit(50), ("id",), trees.heads[0], top_k=1).toPandas()
    assert set(top["rank"]) == {1, 2} and set(top.loc[top["rank"] == 2, "feature"]) == {"rest"}
    most = whole.assign(size=whole["contribution"].abs()).sort_values(["id", "size"], ascending=[True, False]).groupby("id").first()
    assert (top[top["rank"] == 1].set_index("id")["feature"] == most["feature"]).all()
    assert np.allclose(top.groupby("id")["contribution"].sum(), whole.groupby("id")["contribution"].sum())


def test_covers_count_training_rows(fitted):
    trees, train, _ = fitted
    n = train.filter(F.col("y").isNotNull()).count()
    for cover in trees.cover:
        assert (cover[:, 0] == n).all()
        for at in range((1 << trees.depth) - 1):
            assert (cover[:, at] == cover[:, 2 * at + 1] + cover[:, 2 * at + 2]).all()
