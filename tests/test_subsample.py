"""Whole stores over several splits, and the manifest against what is at rest."""

import hashlib
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stallwise.sources import panels, subsample

SCHEMA = "city_id int, store_id int, product_id int, dt date, sale_amount double, hours_sale array<double>, hours_stock_status array<int>, stock_hour6_22_cnt int"


@pytest.fixture(scope="module")
def raw(spark):
    """12 stores in three cities with 1 to 4 products, ten days; every fourth day two open hours are out."""
    rows = []
    for s in range(12):
        for p in range(1 + s % 4):
            for d in range(10):
                out = [1 if d % 4 == 0 and h in (8, 9) else 0 for h in range(24)]
                sale = [0.0 if o or p == 3 else 1.0 for o in out]
                rows.append((s % 3, s, p, date(2024, 3, 1) + timedelta(days=d), sum(sale), sale, out, sum(out)))
    return spark.createDataFrame(rows, SCHEMA).persist()


def split(raw, day):
    return {"train": raw.filter(F.dayofmonth("dt") <= day), "eval": raw.filter(F.dayofmonth("dt") > day)}


def expected(cities, wanted, seed):
    before, out = 0, set()
    for s in sorted((s for s in range(12) if s % 3 in cities), key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s)):
        if before >= wanted:
            break
        out.add(s)
        before += 1 + s % 4
    return out


@pytest.mark.parametrize("wanted,cities,seed", [(1, None, 42), (7, (0, 2), 42), (7, (0, 2), 5), (1000, (1,), 42)])
def test_whole_stores_in_hash_order(spark, raw, tmp_path, wanted, cities, seed):
    manifest = subsample.build_subsample(split(raw, 7), str(tmp_path), wanted, cities, seed).first()
    panel = panels.load_layer(spark, str(tmp_path / "panel"), validate=True)
    stores = {r["store_id"] for r in panel.select("store_id").distinct().collect()}
    assert stores == expected(cities or (0, 1, 2), wanted, seed)
    n = sum(1 + s % 4 for s in stores)
    assert (manifest["n_series"], manifest["n_stores"], manifest["n_rows"], manifest["n_days"]) == (n, len(stores), 10 * n, 10)
    assert manifest["split_names"] == ["train", "eval"] and manifest["split_rows"] == [7 * n, 3 * n]
    assert (manifest["date_min"], manifest["date_max"]) == ("2024-03-01", "2024-03-10")
    assert manifest["censored_share"] == pytest.approx(0.3) and manifest["mean_hours_when_out"] == 2
    assert manifest["zero_share"] == pytest.approx(panel.filter("sale_amount <= 0").count() / (10 * n))
    assert subsample.read_manifest(spark, str(tmp_path)).first() == manifest


def test_splits_that_share_a_day_are_refused(raw, tmp_path):
    both = {"train": raw.filter(F.dayofmonth("dt") <= 7), "eval": raw.filter(F.dayofmonth("dt") >= 7)}
    with pytest.raises(ValueError, match="duplicate_key"):
        subsample.build_subsample(both, str(tmp_path), 5)
    assert not (tmp_path / "manifest").exists()


def test_a_city_without_stores_gives_an_empty_layer(spark, raw, tmp_path):
    manifest = subsample.build_subsample(split(raw, 7), str(tmp_path), 5, cities=(99,)).first()
    assert (manifest["n_series"], manifest["n_rows"], manifest["n_days"]) == (0, 0, 0)
    assert manifest["censored_share"] is None and manifest["date_min"] is None
    assert spark.read.parquet(str(tmp_path / "panel")).isEmpty()


def test_info_of_a_sample(spark, raw, tmp_path):
    manifest = subsample.build_subsample(split(raw, 7), str(tmp_path), 1000)
    whole = panels.load_layer(spark, str(tmp_path / "panel"))
    got = subsample.panel_info(panels.first_series(whole, 3), manifest).first()
    assert (got["n_series"], got["n_rows"], got["of_series"], got["of_rows"], got["is_sample"]) == (3, 30, 30, 300, True)
    assert not subsample.panel_info(whole, manifest).first()["is_sample"]
    none = subsample.panel_info(whole.limit(0), manifest).first()
    assert (none["n_series"], none["n_rows"], none["n_days"], none["date_min"]) == (0, 0, 0, None)
