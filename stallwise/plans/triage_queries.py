"""Queries over signals, triage, histories and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.operators import panel_checks, triage
from stallwise.operators.lineage import written
from stallwise.plans import sql
from stallwise.plans.backtest_queries import parts, result_of
from stallwise.plans.decision_queries import BASE, GRID, LINES, last_lines
from stallwise.plans.panel_queries import recovered, rounded
from stallwise.sources import panels


def waste_signals(spark, sf_dir):
    return rounded(triage.waste_signals(last_lines(spark, sf_dir)))


def series_signals(spark, sf_dir):
    """Signals of the recovered panel."""
    return rounded(triage.series_signals(recovered(spark, sf_dir)))


def all_signals(spark, sf_dir):
    """Signals of Panel A with the moving average's error and the waste of its reorder lines."""
    built = parts(spark, sf_dir)
    return written(triage.series_signals(built[0], result_of(spark, sf_dir, ("moving_average",), built)).join(triage.waste_signals(last_lines(spark, sf_dir, built)), "series_id", "left"))


def triage_flags(spark, sf_dir):
    return rounded(triage.triage(all_signals(spark, sf_dir)).select("series_id", "series_mase", "unreliable", "high_volume", "scarce_signal", "out_now", "waste_risk", "reasons", F.col("n_reasons").cast("long").alias("n_reasons")))


def triage_summary(spark, sf_dir):
    return rounded(triage.triage_summary(triage.triage(all_signals(spark, sf_dir))))


def triage_recovered(spark, sf_dir):
    """Triage of the recovered panel, where stock-outs are real."""
    marked = triage.triage(triage.series_signals(recovered(spark, sf_dir)))
    return marked.select("series_id", "high_volume", "scarce_signal", "out_now", "reasons")


def alerts_page(spark, sf_dir):
    """The first page of alerts; it is a page by definition."""
    return rounded(triage.alerts_page(triage.triage(all_signals(spark, sf_dir))).select("series_id", "mean_demand", "reasons"))


def signal_state(spark, sf_dir):
    return rounded(triage.signal_state(triage.series_signals(recovered(spark, sf_dir))))


def series_history(spark, sf_dir):
    return rounded(triage.series_history(recovered(spark, sf_dir)))


def dataset_summary_stores(spark, sf_dir):
    return rounded(triage.group_stats(recovered(spark, sf_dir), "store_id"))


def dataset_summary_categories(spark, sf_dir):
    return rounded(triage.group_stats(recovered(spark, sf_dir), "third_category_id"))


def dataset_summary_daily(spark, sf_dir):
    return rounded(triage.group_stats(recovered(spark, sf_dir), "dt"))


def dataset_summary_weekday(spark, sf_dir):
    return rounded(triage.group_stats(recovered(spark, sf_dir).withColumn("dow", F.weekday("dt")), "dow"))


def stockout_histogram(spark, sf_dir):
    return triage.stockout_histogram(panels.panel_b(spark, sf_dir))


def demand_distribution(spark, sf_dir):
    return rounded(triage.demand_distribution(panels.panel_a(spark, sf_dir)))


def cost_concentration(spark, sf_dir):
    return rounded(triage.concentration(last_lines(spark, sf_dir)))


def catalog_search(spark, sf_dir):
    """The first page of series in store 3 with a product 1x; it is a page by definition."""
    return triage.catalogue_search(panel_checks.series_index(panels.panel_b(spark, sf_dir)), "store 3 product 1")


QUERIES = {f.__name__: f for f in (waste_signals, series_signals, triage_flags, triage_summary, triage_recovered, alerts_page, signal_state, series_history, dataset_summary_stores, dataset_summary_categories, dataset_summary_daily, dataset_summary_weekday, stockout_histogram, demand_distribution, cost_concentration, catalog_search)}

SIGNALS = """
sg as (
  select series_id, avg(latent) as mean_demand, coalesce(sum(greatest(latent - sale, 0)) / nullif(sum(latent), 0), 0) as estimated_share,
         count(*) - coalesce(max(case when not cens then pos end), 0) as current_run, avg(cens::int) as stockout_rate, count(*) as days
  from (select *, row_number() over (partition by series_id order by dt) as pos from rc where dt > (select max(dt) from rc) - 28) group by 1)"""
B_SIGNALS = sql.of(sql.PANEL_B, sql.PROFILES, sql.RECOVERED, SIGNALS)
A_SIGNALS = (
    BASE
    + GRID
    + LINES
    + """, sa as (select series_id, avg(sale) as mean_demand from pa where dt > date '1998-04-07' - 28 group by 1),
se as (select series_id, avg(abs(y_true - y_pred)) as mae from ma group by 1),
sk as (select a.series_id, avg(abs(a.sale - b.sale)) as scale from pa a join pa b on a.series_id = b.series_id and b.dt = a.dt - 7 group by 1),
ws as (select series_id, sum(expected_demand) as d, sum(waste_model) as m, sum(waste_policy) as p from li group by 1),
tr as (
  select series_id, mean_demand, coalesce(mae / nullif(scale, 0), 0) as series_mase, coalesce(mae / nullif(scale, 0), 0) > 1 as unreliable,
         mean_demand >= (select quantile_cont(mean_demand, 0.9) from sa) as high_volume, false as scarce_signal, false as out_now, coalesce(p / nullif(d, 0), 0) >= 0.5 and coalesce(greatest(p - m, 0) / nullif(d, 0), 0) > 0 as waste_risk
  from sa join se using (series_id) join sk using (series_id) join ws using (series_id)),
tm as (
  select *, unreliable::int + high_volume::int + scarce_signal::int + out_now::int + waste_risk::int as n_reasons,
         array_to_string(list_filter([case when unreliable then 'unreliable' end, case when high_volume then 'high_volume' end, case when waste_risk then 'waste_risk' end], lambda x: x is not null), ', ') as reasons from tr)"""
)


def _stats(key: str, expr: str) -> str:
    return (
        sql.B_RECOVERED
        + f"""select {expr} as {key}, count(distinct series_id) as n_series, round(avg(sale), 4) as mean_observed, round(avg(latent), 4) as mean_demand, round(sum(latent) / (select sum(latent) from rc), 4) as share_volume,
      round(avg(cens::int), 4) as share_censored, round(case when sum(sale) > 0 then 100 * (sum(latent) / sum(sale) - 1) else 0 end, 4) as uplift_pct from rc group by 1"""
    )


ORACLE_SQL = {
    "waste_signals": BASE
    + GRID
    + LINES
    + """, ws as (select series_id, sum(expected_demand) as d, sum(waste_model) as m, sum(waste_policy) as p from li group by 1)
    select series_id, round(cast(d as double), 4) as expected_demand, round(coalesce(p / nullif(d, 0), 0), 4) as waste_policy, round(coalesce(m / nullif(d, 0), 0), 4) as waste_model, round(coalesce(greatest(p - m, 0) / nullif(d, 0), 0), 4) as waste_avoidable from ws""",
    "series_signals": B_SIGNALS + "select series_id, round(mean_demand, 4) as mean_demand, round(estimated_share, 4) as estimated_share, cast(current_run as bigint) as current_run, round(stockout_rate, 4) as stockout_rate, days from sg",
    "triage_flags": A_SIGNALS + "select series_id, round(series_mase, 4) as series_mase, unreliable, high_volume, scarce_signal, out_now, waste_risk, reasons, cast(n_reasons as bigint) as n_reasons from tm",
    "triage_summary": A_SIGNALS
    + """, lo as (unpivot (select mean_demand, n_reasons, unreliable, high_volume, scarce_signal, out_now, waste_risk from tm) on unreliable, high_volume, scarce_signal, out_now, waste_risk into name reason value hit)
    select reason, count(*) filter (where hit) as series, round(avg(hit::int), 4) as share_series, round(coalesce(sum(mean_demand) filter (where hit) / sum(mean_demand), 0), 4) as share_volume, count(*) filter (where hit and n_reasons = 1) as only_reason from lo group by 1""",
    "triage_recovered": B_SIGNALS
    + """, f as (select series_id, mean_demand >= (select quantile_cont(mean_demand, 0.9) from sg) as high_volume, estimated_share > 0.3 as scarce_signal, current_run >= 5 as out_now from sg)
    select *, array_to_string(list_filter([case when high_volume then 'high_volume' end, case when scarce_signal then 'scarce_signal' end, case when out_now then 'out_now' end], lambda x: x is not null), ', ') as reasons from f""",
    "alerts_page": A_SIGNALS + "select series_id, round(cast(mean_demand as double), 4) as mean_demand, reasons from tm where n_reasons > 0 order by n_reasons desc, tm.mean_demand desc, series_id limit 20",
    "signal_state": B_SIGNALS
    + """, st as (select *, case when estimated_share >= 0.4 then 'scarce' when estimated_share >= 0.3 then 'partial' else 'observed' end as state from sg)
    select series_id, round(estimated_share, 4) as estimated_share, cast(current_run as bigint) as current_run, state, case when current_run >= 3 then 'out for days' else state end as label from st""",
    "series_history": sql.B_RECOVERED
    + """, hb as (select *, row_number() over (partition by series_id order by dt desc) - 1 as back from rc),
    isl as (select series_id, count(*) as days from (select series_id, dt - cast(row_number() over (partition by series_id order by dt) as int) as i from rc where cens) group by series_id, i),
    mx as (select series_id, max(days) as max_run from isl group by 1)
    select series_id, count(*) as n_days, count(*) filter (where cens) as n_censored, count(*) filter (where cens and back < 28) as censored_last_28, cast(coalesce(min(back) filter (where not cens), count(*)) as bigint) as current_run,
           cast(min(back) filter (where sale > 0) as int) as days_since_sale, round(least(greatest(coalesce(sum(latent - sale) filter (where back < 28) / nullif(sum(latent) filter (where back < 28), 0), 0), 0), 1), 4) as estimated_share_28,
           round(case when sum(sale) > 0 then 100 * (sum(latent) / sum(sale) - 1) else 0 end, 4) as uplift_pct,
           round(case when sum(sale) filter (where not cens) > 0 then 100 * (sum(latent) filter (where not cens) / sum(sale) filter (where not cens) - 1) else 0 end, 4) as uplift_clean_pct, cast(coalesce(any_value(max_run), 0) as bigint) as max_run
    from hb left join mx using (series_id) group by 1""",
    "dataset_summary_stores": _stats("store_id", "store_id"),
    "dataset_summary_categories": _stats("third_category_id", "third_category_id"),
    "dataset_summary_daily": _stats("dt", "dt"),
    "dataset_summary_weekday": _stats("dow", "cast(isodow(dt) - 1 as int)"),
    "stockout_histogram": sql.B + "select cast(least(floor(rate * 10), 9) as int) as bin, count(*) as n_series from (select avg(cens::int) as rate from pb group by series_id) group by 1",
    "demand_distribution": sql.A
    + """select round(avg(sale), 4) as mean, round(stddev_samp(sale), 4) as std, round(cast(min(sale) as double), 4) as least, round(cast(max(sale) as double), 4) as most, round(quantile_cont(cast(sale as double), 0.5), 4) as p50, round(quantile_cont(cast(sale as double), 0.9), 4) as p90,
      round(quantile_cont(cast(sale as double), 0.99), 4) as p99, round(avg((sale <= 0)::int), 4) as zero_share, round(case when quantile_cont(cast(sale as double), 0.5) > 0 then quantile_cont(cast(sale as double), 0.99) / quantile_cont(cast(sale as double), 0.5) end, 4) as p99_over_median from pa""",
    "cost_concentration": BASE
    + GRID
    + LINES
    + """, e as (select series_id, sum(cost_policy) as v from li group by 1), r as (select v, row_number() over (order by v desc, series_id) as r, count(*) over () as n, sum(v) over () as a from e)
    select t.top::double as top, round(sum(v) filter (where r <= ceil(t.top * n)) / max(a), 4) as share from r, (values (0.01), (0.05), (0.10), (0.20), (0.50)) t(top) group by 1""",
    "catalog_search": sql.B
    + """, ix as (select distinct series_id, store_id, product_id, third_category_id, 'store ' || store_id || ' · category ' || third_category_id || ' · product ' || product_id as label from pb)
    select series_id, store_id, product_id, third_category_id, label from ix
    where contains(lower(series_id || ' ' || label), 'store') and contains(lower(series_id || ' ' || label), '3') and contains(lower(series_id || ' ' || label), 'product') and contains(lower(series_id || ' ' || label), '1') order by series_id limit 50""",
}
