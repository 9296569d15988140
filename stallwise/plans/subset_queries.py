"""Queries over subsamples and their manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stallwise.operators.lineage import folder, written
from stallwise.plans import sql
from stallwise.plans.panel_queries import rounded
from stallwise.sources import panels, subsample

WANTED = 20


def subset(spark, sf_dir):
    """Whole stores of two of three cities; days up to the 23rd are one split, the rest the other. (folder, manifest)"""
    raw = written(panels.hourly_events(spark, sf_dir).withColumn("city_id", F.col("store_id") % 3))
    early = F.dayofmonth("dt") <= 23
    at = f"{folder(spark)}/subsample-{uuid.uuid4().hex}"
    return at, subsample.build_subsample({"train": raw.filter(early), "eval": raw.filter(~early)}, at, WANTED, cities=(0, 1))


def subsample_manifest(spark, sf_dir):
    m = subset(spark, sf_dir)[1]
    days = (F.col(c).cast("date").alias(c) for c in ("date_min", "date_max"))
    return rounded(m.select("n_series", "n_stores", "n_products", "n_days", "n_rows", *days, F.col("split_rows")[0].alias("train_rows"), F.col("split_rows")[1].alias("eval_rows"), "censored_share", "zero_share", "censored_zero_share", "mean_hours_when_out"), 6)


def subsample_panel(spark, sf_dir):
    """The layer at rest, checked as it is loaded."""
    at, _ = subset(spark, sf_dir)
    panel = panels.load_layer(spark, f"{at}/panel", hourly=False, validate=True)
    return rounded(panel.select("split", "series_id", "city_id", "dt", "sale_amount", F.col("stock_hour6_22_cnt").cast("long").alias("hours_out")))


def panel_info(spark, sf_dir):
    """The five first series of the layer against the manifest at rest."""
    at, _ = subset(spark, sf_dir)
    served = panels.first_series(panels.load_layer(spark, f"{at}/panel"), 5)
    return subsample.panel_info(served, subsample.read_manifest(spark, at))


QUERIES = {f.__name__: f for f in (subsample_manifest, subsample_panel, panel_info)}

SUBSET = f"""
sz as (select store_id, count(*) as n from (select distinct store_id, product_id from pb where store_id % 3 in (0, 1)) group by 1),
od as (select *, coalesce(sum(n) over (order by md5('42:' || store_id) rows between unbounded preceding and 1 preceding), 0) as before from sz),
sb as (select case when day(dt) <= 23 then 'train' else 'eval' end as split, * from pb where store_id in (select store_id from od where before < {WANTED}))"""
S = sql.of(sql.PANEL_B, SUBSET)

ORACLE_SQL = {
    "subsample_manifest": S
    + """select count(distinct series_id) as n_series, count(distinct store_id) as n_stores, count(distinct product_id) as n_products, count(distinct dt) as n_days, count(*) as n_rows, min(dt) as date_min, max(dt) as date_max,
      count(*) filter (where split = 'train') as train_rows, count(*) filter (where split = 'eval') as eval_rows, round(avg(cens::int), 6) as censored_share, round(avg((sale <= 0)::int), 6) as zero_share,
      round(avg((cens and sale <= 0)::int), 6) as censored_zero_share, round(avg(hours_out) filter (where cens), 6) as mean_hours_when_out from sb""",
    "subsample_panel": S + "select split, series_id, cast(store_id % 3 as int) as city_id, dt, round(sale, 4) as sale_amount, cast(hours_out as bigint) as hours_out from sb",
    "panel_info": S
    + """, few as (select * from sb where series_id in (select distinct series_id from sb order by series_id limit 5))
    select count(distinct series_id) as n_series, count(distinct store_id) as n_stores, count(distinct product_id) as n_products, count(*) as n_rows, count(distinct dt) as n_days, min(dt) as date_min, max(dt) as date_max,
      (select count(distinct series_id) from sb) as of_series, (select count(distinct store_id) from sb) as of_stores, (select count(distinct product_id) from sb) as of_products,
      (select count(distinct dt) from sb) as of_days, (select count(*) from sb) as of_rows, count(distinct series_id) < (select count(distinct series_id) from sb) as is_sample from few""",
}
