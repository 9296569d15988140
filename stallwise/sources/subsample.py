"""A subsample of whole stores over several splits, at rest with its manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stallwise.operators.lineage import written
from stallwise.sources import panels


def _shares(row: dict) -> dict[str, float | None]:
    part = lambda a, b: a / b if b else None
    return {
        "censored_share": part(row["n_censored"], row["n_rows"]),
        "zero_share": part(row["n_zero"], row["n_rows"]),
        "censored_zero_share": part(row["n_censored_zero"], row["n_rows"]),
        "mean_hours_when_out": part(row["hours_out"], row["n_censored"]),
    }


def build_subsample(splits: Mapping[str, DataFrame], folder: str, n_series: int, cities: Sequence[int] | None = None, seed: int = 42) -> DataFrame:
    """Chooses whole stores by the first split, takes their rows of every split, tags them, and writes the panel to
    folder/panel and a manifest of one row to folder/manifest, which it returns.

    Rows are counted and days bounded while the panel is written, so the raw tables are read once for it; only distinct
    keys are counted on the written layer, from three of its columns. A panel that breaks a rule (a day that two splits
    hold, say) raises ValueError and leaves no new manifest. Without rows the counts are zero, the shares null."""
    raw = next(iter(splits.values()))
    spark = raw.sparkSession
    inventory = raw.select("city_id", "store_id", "product_id").distinct()
    chosen = written(panels.choose_whole_stores(inventory, n_series, seed, cities).select("store_id", "product_id"))
    rows = None
    for name, frame in splits.items():
        part = panels.build_panel(panels.read_subset(frame, chosen)).withColumn("split", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    out, zero = F.col("is_censored"), F.col("sale_amount") <= 0
    seen = Observation()
    counted = {
        "n_rows": F.count(F.lit(1)),
        "n_censored": F.count_if(out),
        "n_zero": F.count_if(zero),
        "n_censored_zero": F.count_if(out & zero),
        "hours_out": F.coalesce(F.sum(F.when(out, F.col("stock_hour6_22_cnt"))), F.lit(0)),
        "date_min": F.min("dt").cast("string"),
        "date_max": F.max("dt").cast("string"),
        **{f"rows_{k}": F.count_if(F.col("split") == name) for k, name in enumerate(splits)},
    }
    panels.save_layer(rows.observe(seen, *(c.alias(n) for n, c in counted.items())), f"{folder}/panel")
    row = dict(seen.get)
    panel = spark.read.parquet(f"{folder}/panel")
    if row["n_rows"]:
        panels.refuse_invalid(panel)
    series = panel.groupBy("series_id").agg(F.min("store_id").alias("store_id"), F.min("product_id").alias("product_id"))
    keys = series.agg(F.count(F.lit(1)).alias("n_series"), F.count_distinct("store_id").alias("n_stores"), F.count_distinct("product_id").alias("n_products"))
    keys = keys.crossJoin(panel.select("dt").distinct().agg(F.count(F.lit(1)).alias("n_days"))).first()
    values = {
        "seed": seed,
        "n_series_requested": n_series,
        **keys.asDict(),
        "n_rows": row["n_rows"],
        "date_min": row["date_min"],
        "date_max": row["date_max"],
        "cities": None if cities is None else [int(c) for c in cities],
        "split_names": list(splits),
        "split_rows": [row[f"rows_{k}"] for k in range(len(splits))],
        **_shares(row),
    }
    manifest = spark.createDataFrame([tuple(values.values())], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


MANIFEST = (
    "seed long, n_series_requested long, n_series long, n_stores long, n_products long, n_days long, n_rows long, date_min string, date_max string, "
    "cities array<int>, split_names array<string>, split_rows array<long>, censored_share double, zero_share double, censored_zero_share double, mean_hours_when_out double"
)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def panel_info(panel: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: what a panel that is being served holds, against what its manifest says of the whole."""
    series = panel.groupBy("series_id").agg(F.min("store_id").alias("store_id"), F.min("product_id").alias("product_id"), F.count(F.lit(1)).alias("rows"))
    held = series.agg(F.count(F.lit(1)).alias("n_series"), F.count_distinct("store_id").alias("n_stores"), F.count_distinct("product_id").alias("n_products"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))
    days = panel.groupBy("dt").agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("n_days"), F.min("dt").alias("date_min"), F.max("dt").alias("date_max"))
    whole = manifest.select(*(F.col(c).alias(f"of_{c[2:]}") for c in ("n_series", "n_stores", "n_products", "n_days", "n_rows")))
    met = held.crossJoin(F.broadcast(days)).crossJoin(F.broadcast(whole))
    return met.withColumn("is_sample", F.col("n_series") < F.col("of_series"))
