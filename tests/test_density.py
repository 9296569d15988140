"""Density clusters against comparing all points."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stallwise.operators import density


def plain(ids, x, eps, least):
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = {i: i for i in np.flatnonzero(core)}
    moved = True
    while moved:
        moved = False
        for i in label:
            best = min(label[j] for j in np.flatnonzero(near[i] & core))
            if best != label[i]:
                label[i], moved = best, True
    out = {}
    for i, s in enumerate(ids):
        touching = [label[j] for j in np.flatnonzero(near[i] & core)] if not core[i] else [label[i]]
        out[s] = ids[min(touching)] if touching else "-1"
    return out


@pytest.mark.parametrize("d, eps, least, seed", [(7, 0.9, 10, 0), (7, 0.5, 4, 1), (3, 0.3, 5, 2), (2, 0.15, 6, 3)])
def test_clusters_are_those_of_all_pairs(spark, d, eps, least, seed):
    """Blobs, a chain of many cells, copies of one point in a dense cell, and noise."""
    rng = np.random.default_rng(seed)
    blobs = np.concatenate([rng.normal(c, 0.25, (60, d)) for c in rng.uniform(-4, 4, (4, d))])
    chain = np.linspace(-6, 6, 120)[:, None] * np.ones((1, d)) / np.sqrt(d) + rng.normal(0, 0.02, (120, d))
    x = np.concatenate([blobs, chain, np.tile(rng.uniform(-4, 4, (1, d)), (40, 1)), rng.uniform(-7, 7, (25, d))])
    ids = [f"s{i:04d}" for i in range(len(x))]
    names = [f"f{k}" for k in range(d)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(series_id=ids)).repartition(5)
    got = {r["series_id"]: r["cluster"] for r in density.density_clusters(df, eps, least, names).collect()}
    want = plain(ids, x, eps, least)
    assert got == want
    assert len(set(want.values())) > 3 and "-1" in want.values()


def test_compared_pairs_are_bounded_by_cells(spark):
    """A dense cell is never compared with itself: as many near cells for one point as for thousands at its place."""
    few = spark.createDataFrame([(f"a{i}", float(i % 2), 0.0) for i in range(40)] + [("z", 9.0, 9.0)], "series_id string, x double, y double")
    got = density.density_clusters(few, 0.5, 5, ("x", "y")).groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == {"a0": 20, "a1": 20, "-1": 1}
    cells = spark.createDataFrame([([0, 0],), ([1, 0],), ([9, 9],)], "cell array<long>")
    assert density.near_cells(cells, 0.5, 0.35, 2).count() == 5


def test_missing_and_constant_columns_and_no_rows(spark):
    rows = [(f"s{i}", 1.0, None if i % 2 else float(i // 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "series_id string, x double, y double")
    assert density.density_clusters(df, 5.0, 3, ("x", "y")).select("cluster").distinct().count() == 1
    assert density.density_clusters(df.limit(0), 0.9, 3, ("x", "y")).count() == 0


def test_components_of_a_long_chain_and_loops(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(100) if i != 50] + [("x", "x")]
    got = {r["node"]: r["root"] for r in density.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {f"n{i:03d}": "n000" if i <= 50 else "n051" for i in range(101)} | {"x": "x"}


def test_boxes_of_cells_bound_their_points_distances(spark):
    """Copies have boxes without extent, which settle a pair of cells whatever the number of copies."""
    points = spark.createDataFrame([([0], [0.1, 0.2])] * 50 + [([1], [1.1, 0.2])] * 50 + [([2], [2.0, 0.0]), ([2], [2.5, 0.7])], "cell array<long>, p array<double>")
    cells = density.boxes(points, 2)
    near = cells.select("cell").crossJoin(cells.selectExpr("cell as other"))
    got = {(r["cell"][0], r["other"][0]): (r["gap"], r["far"]) for r in density.with_boxes(near, cells, cells).withColumns({"gap": density.gap(), "far": density.furthest()}).collect()}
    assert got[0, 1] == pytest.approx((1.0, 1.0)) and got[1, 0] == got[0, 1] and got[0, 0] == (0.0, 0.0)
    assert got[1, 2] == pytest.approx((0.81, 1.96 + 0.25)) and got[2, 2] == pytest.approx((0.0, 0.25 + 0.49))


@pytest.mark.parametrize("block, asking, leads", [(16, 65_536, 1), (40, 9, 2)])
def test_clusters_do_not_depend_on_blocks(spark, monkeypatch, block, asking, leads):
    """Blobs, a chain and noise over many blocks, asked by few points at once and by one of a group first; copies lie among them."""
    for name, value in (("BLOCK", block), ("ASKING", asking), ("LEADS", leads)):
        monkeypatch.setattr(density, name, value)
    rng = np.random.default_rng(block)
    chain = np.linspace(-6, 6, 150)[:, None] * np.ones((1, 3)) / np.sqrt(3) + rng.normal(0, 0.02, (150, 3))
    x = np.concatenate([*(rng.normal(c, 0.3, (70, 3)) for c in rng.uniform(-4, 4, (4, 3))), chain, chain[:20], np.tile([[5.0, -5, 5]], (6, 1)), rng.uniform(-7, 7, (30, 3))])
    ids = [f"s{i:04d}" for i in rng.permutation(len(x))]
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("xyz")).assign(series_id=ids)).repartition(5)
    got = {r["series_id"]: r["cluster"] for r in density.density_clusters(df, 0.3, 5, list("xyz")).collect()}
    order = np.argsort(ids)
    want = plain([ids[i] for i in order], x[order], 0.3, 5)
    assert got == want
    assert len(set(want.values())) > 4 and "-1" in want.values()


def test_points_that_all_differ_ask_few_blocks(spark, monkeypatch):
    """Hardly two of 3,000 points share a cell of diagonal eps; blocks are bounded, and most points are settled in their own."""
    rows, asked = [], density.asked
    monkeypatch.setattr(density, "BLOCK", 300)
    monkeypatch.setattr(density, "asked", lambda *a: rows.append(asked(*a).count()) or asked(*a))
    x = np.random.default_rng(4).normal(0, 1, (3000, 7))
    names = [f"f{k}" for k in range(7)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(series_id=[f"s{i:04d}" for i in range(len(x))]))
    density.density_clusters(df, 1.2, 5, names).count()
    spots = density.blocks(df.select(F.array(*names).alias("p")), 1.2, 300).groupBy("cell").count()
    assert spots.agg({"count": "max"}).first()[0] <= 600 and spots.count() == 10
    assert sum(rows) < 10 * 3000, rows
