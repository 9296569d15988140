"""Queries over panels, their checks, and demand recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.operators import panel_checks as checks
from stallwise.operators import recovery
from stallwise.operators.lineage import written
from stallwise.plans import sql
from stallwise.sources import panels


def recovered(spark, sf_dir):
    """Panel B with its latent demand."""
    return written(recovery.recover_by_profile(written(panels.panel_b(spark, sf_dir))))


def rounded(df, places: int = 4):
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def series_inventory(spark, sf_dir):
    return panels.series_inventory(panels.daily_sales(spark, sf_dir))


def whole_stores(spark, sf_dir):
    """Whole stores up to the first that reaches 20 series; every chosen store is complete."""
    inventory = series_inventory(spark, sf_dir)
    chosen = panels.choose_whole_stores(inventory, 20)
    whole = inventory.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_series"))
    return chosen.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_chosen")).join(whole, "store_id").select("store_id", "n_series", "n_chosen")


def panel_from_hourly(spark, sf_dir):
    b = panels.panel_b(spark, sf_dir)
    return b.select("series_id", "dt", "sale_amount", F.col("stock_hour6_22_cnt").cast("long").alias("hours_out"), F.col("oos_hours_day").cast("long").alias("oos_day"), "available_weight", "is_censored")


def daily_panel(spark, sf_dir):
    return panels.panel_a(spark, sf_dir).select("series_id", "store_id", "product_id", "dt", "sale_amount", "discount", "activity_flag")


def describe_panel(spark, sf_dir):
    return checks.describe_censoring(panels.panel_b(spark, sf_dir))


def series_index(spark, sf_dir):
    return checks.series_index(panels.panel_b(spark, sf_dir))


def panel_violations(spark, sf_dir):
    return checks.panel_violations(recovered(spark, sf_dir))


def calendar_gaps(spark, sf_dir):
    return checks.series_with_gaps(panels.daily_sales(spark, sf_dir).withColumn("series_id", panels.series_id()))


def densify_daily(spark, sf_dir):
    sparse = panels.daily_sales(spark, sf_dir).withColumn("series_id", panels.series_id())
    return checks.densify(sparse)


def hourly_profile_weights(spark, sf_dir):
    return rounded(recovery.hourly_profiles(panels.panel_b(spark, sf_dir)), 8).withColumn("key", F.coalesce("key", F.lit(-1)))


def recover_hourly_profile(spark, sf_dir):
    return rounded(recovered(spark, sf_dir).select("series_id", "dt", "sale_amount", "profile_share", "demand_latent", "inflation_factor"))


def recover_tobit_ewma(spark, sf_dir):
    return rounded(recovery.recover_by_level(panels.panel_b(spark, sf_dir)).select("series_id", "dt", "sale_amount", "expected_level", "demand_latent"))


def censoring_report(spark, sf_dir):
    return recovery.censoring_report(recovered(spark, sf_dir))


def recensored_bias(spark, sf_dir):
    """Both recoveries as predictions of what was sold: relative bias once censored again, and on clean days."""
    one = recovered(spark, sf_dir).select(F.lit("profile").alias("method"), "sale_amount", "demand_latent", "available_weight", "is_censored")
    two = recovery.recover_by_level(panels.panel_b(spark, sf_dir)).select(F.lit("level").alias("method"), "sale_amount", "demand_latent", "available_weight", "is_censored")
    return one.unionByName(two).groupBy("method").agg(
        F.round(recovery.recensored_bias(F.col("sale_amount"), F.col("demand_latent"), F.col("available_weight")), 5).alias("recensored_bias"),
        F.round(recovery.clean_day_bias(F.col("sale_amount"), F.col("demand_latent"), F.col("is_censored")), 5).alias("clean_day_bias"),
    )


def stockout_runs(spark, sf_dir):
    return recovery.stockout_runs(panels.panel_b(spark, sf_dir))


def hourly_stockout_profile(spark, sf_dir):
    return recovery.hourly_stockout_profile(panels.panel_b(spark, sf_dir))


def open_window_check(spark, sf_dir):
    return recovery.open_window_check(panels.panel_b(spark, sf_dir))


QUERIES = {f.__name__: f for f in (series_inventory, whole_stores, panel_from_hourly, daily_panel, describe_panel, series_index, panel_violations, calendar_gaps, densify_daily, hourly_profile_weights, recover_hourly_profile, recover_tobit_ewma, censoring_report, recensored_bias, stockout_runs, hourly_stockout_profile, open_window_check)}

#: Recovery by level: the mean of the clean values carried to each earlier day, weighted by (1 - 2/15) ** age.
LEVELS = """
lv_carried as (
  select series_id, dt, cens, sale, weight, last_value(case when not cens then sale end ignore nulls) over (partition by series_id order by dt) as carried,
         row_number() over (partition by series_id order by dt) as n
  from pb),
lv_mean as (
  select a.series_id, a.dt, sum(b.carried * pow(13.0 / 15, a.n - 1 - b.n)) / sum(pow(13.0 / 15, a.n - 1 - b.n)) as level
  from lv_carried a join lv_carried b on a.series_id = b.series_id and b.n < a.n and b.carried is not null group by 1, 2),
lv_all as (
  select c.*, coalesce(m.level, avg(case when not cens then sale end) over (partition by c.series_id), avg(case when not cens then sale end) over ()) as level
  from lv_carried c left join lv_mean m on c.series_id = m.series_id and c.dt = m.dt),
lv as (
  select *, case when cens and weight >= 0.15 then greatest(sale, case when sale > 0 then least(greatest(sale, level), 3 * sale) else greatest(sale, level) end) else sale end as latent
  from lv_all)"""

ORACLE_SQL = {
    "whole_stores": sql.A
    + """, sz as (select store_id, count(*) as n from (select distinct store_id, product_id from pa_raw) group by 1),
    od as (select *, coalesce(sum(n) over (order by md5('42:' || store_id) rows between unbounded preceding and 1 preceding), 0) as before from sz)
    select store_id, n as n_series, n as n_chosen from od where before < 20""",
    "series_inventory": sql.A + "select distinct store_id, product_id from pa_raw",
    "panel_from_hourly": sql.B + "select series_id, dt, sale as sale_amount, cast(hours_out as bigint) as hours_out, cast(oos_day as bigint) as oos_day, cast(weight as double) as available_weight, cens as is_censored from pb",
    "daily_panel": sql.A + "select series_id, store_id, product_id, dt, cast(sale as double) as sale_amount, cast(discount as double) as discount, activity as activity_flag from pa",
    "describe_panel": sql.B
    + """select count(*) as n_rows, count(distinct series_id) as n_series, count(distinct dt) as n_days, count(distinct store_id) as n_stores, count(distinct product_id) as n_products,
      min(dt) as first_day, max(dt) as last_day, round(avg(cens::int), 6) as censored_share, round(avg((sale <= 0)::int), 6) as zero_share, round(avg((cens and sale <= 0)::int), 6) as censored_zero_share,
      round(avg(hours_out) filter (where cens), 6) as mean_hours_when_out, round(count(*) / (count(distinct series_id) * count(distinct dt)), 6) as density from pb""",
    "series_index": sql.B + "select distinct series_id, store_id, product_id, third_category_id from pb",
    "panel_violations": sql.B_RECOVERED
    + """, keys as (select count(*) as twice from (select 1 from rc group by series_id, dt having count(*) > 1)),
    gaps as (select count(*) as n from (select 1 from rc group by series_id having max(dt) - min(dt) + 1 <> count(distinct dt)))
    select unnest(['empty', 'null_key', 'null_sale', 'negative_sale', 'flag_without_hours', 'weight_out_of_range', 'latent_below_sale', 'duplicate_key', 'series_with_gaps']) as rule,
           unnest([cast(count(*) = 0 as bigint), count(*) filter (where series_id is null or dt is null), count(*) filter (where sale is null), count(*) filter (where sale < 0),
                   count(*) filter (where cens <> (hours_out > 0)), count(*) filter (where not weight between 0 and 1.000001), count(*) filter (where latent < sale - 0.000001),
                   (select twice from keys), (select n from gaps)]) as violations from rc""",
    "calendar_gaps": sql.A + "select store_id || '_' || product_id as series_id, count(*) as days, cast(max(dt) - min(dt) + 1 - count(*) as bigint) as missing_days from pa_raw group by store_id, product_id having missing_days > 0",
    "densify_daily": sql.A
    + """, span as (select store_id, product_id, min(dt) as a, max(dt) as b from pa_raw group by 1, 2),
    grid as (select store_id, product_id, cast(unnest(generate_series(a, b, interval 1 day)) as date) as dt from span)
    select g.store_id || '_' || g.product_id as series_id, g.store_id, g.product_id, g.dt, coalesce(r.sale, 0.0) as sale_amount,
           cast(last_value(r.discount ignore nulls) over (partition by g.store_id, g.product_id order by g.dt) as double) as discount
    from grid g left join pa_raw r on r.store_id = g.store_id and r.product_id = g.product_id and r.dt = g.dt""",
    "hourly_profile_weights": sql.of(sql.PANEL_B, sql.PROFILES) + "select level, coalesce(key, -1) as key, cast(h as int) as h, round(weight, 8) as weight, cast(clean_hours as bigint) as clean_hours from profiles",
    "recover_hourly_profile": sql.B_RECOVERED
    + """select series_id, dt, round(sale, 4) as sale_amount, round(share, 4) as profile_share, round(latent, 4) as demand_latent,
      round(case when sale > 0 then latent / sale when latent > 0 then null else 1.0 end, 4) as inflation_factor from rc""",
    "recover_tobit_ewma": sql.of(sql.PANEL_B, LEVELS) + "select series_id, dt, round(sale, 4) as sale_amount, round(level, 4) as expected_level, round(latent, 4) as demand_latent from lv",
    "censoring_report": sql.B_RECOVERED
    + """select case when grouping(cens) = 1 then 'all' when cens then 'censored' else 'clean' end as days, count(*) as n, round(avg(sale), 4) as mean_observed, round(avg(latent), 4) as mean_latent,
      round(case when avg(sale) > 0 then 100 * (avg(latent) / avg(sale) - 1) end, 4) as uplift_pct from rc group by grouping sets ((cens), ())""",
    "recensored_bias": sql.of(sql.PANEL_B, sql.PROFILES, sql.RECOVERED, LEVELS)
    + """select method, round((avg(latent * weight) - avg(sale)) / avg(sale), 5) as recensored_bias,
      round((avg(latent) filter (where not cens) - avg(sale) filter (where not cens)) / avg(sale) filter (where not cens), 5) as clean_day_bias
    from (select 'profile' as method, sale, latent, weight, cens from rc union all select 'level', sale, latent, weight, cens from lv) group by 1""",
    "stockout_runs": sql.B
    + """, marked as (select series_id, dt, dt - cast(row_number() over (partition by series_id order by dt) as int) as island from pb where cens)
    select series_id, min(dt) as run_start, max(dt) as run_end, count(*) as days from marked group by series_id, island""",
    "hourly_stockout_profile": sql.B + "select cast(h as int) as h, round(avg(cast(oos as double)), 6) as stockout_share, round(sum(v) / sum(sum(v)) over (), 6) as sales_share, h between 6 and 21 as is_open from pbh group by h",
    "open_window_check": sql.B + "select cast(s as int) as slots, round(avg(cens::int) * avg(hours_out) filter (where cens) / s, 6) as implied_share from pb, (values (16), (17)) t(s) group by s",
}
