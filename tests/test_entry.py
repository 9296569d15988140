"""The registry: names agree, queries and oracles return the same, and the library needs no optional part."""

import importlib.util

import duckdb
import pytest

import __spark_entry__
from stallwise.plans import registry

SF = "/root/testdata/sf0.001"
SAMPLE = ("series_inventory", "panel_from_hourly", "censoring_report", "lags", "folds", "metrics_by_origin", "merge_report")


def test_oracles_belong_to_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for table in ("region", "nation", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).fetch_df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    plain = lambda df: sorted(tuple(str(round(x, 4) + 0.0) if isinstance(x, float) else str(x)[:10] for x in row) for row in df[columns].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_nothing_outside_imports_the_optional_part():
    from pathlib import Path

    root = Path(registry.__file__).resolve().parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "stallwise.llm" not in path.read_text()
    assert importlib.util.find_spec("stallwise") is not None
