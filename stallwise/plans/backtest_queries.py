"""Queries over folds, baselines and their metrics, on Panel A."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stallwise.operators import forecast, intervals, metrics
from stallwise.operators.lineage import written
from stallwise.plans import sql
from stallwise.plans.panel_queries import rounded
from stallwise.sources import panels


def parts(spark, sf_dir):
    """Panel A and its folds, written once; what needs them in one query is given them."""
    a = written(panels.panel_a(spark, sf_dir))
    return a, written(forecast.folds(a))


def result_of(spark, sf_dir, models=("naive", "seasonal_naive", "moving_average", "seasonal_moving_average"), built=None):
    return forecast.backtest(*(built or parts(spark, sf_dir)), models=models)


def train_bands(spark, sf_dir, built=None):
    """Rotation bands from what was known at the first origin."""
    a, folds = built or parts(spark, sf_dir)
    first = folds.agg(F.min("origin_date").alias("first"))
    return metrics.rotation_bands(a.crossJoin(F.broadcast(first)).filter("dt <= first"))


def folds(spark, sf_dir):
    return parts(spark, sf_dir)[1]


def fold_disjoint(spark, sf_dir):
    """The folds and three planted bad ones: one that tests its origin's day, one that reaches beyond the panel and one
    whose last day is too early. Only these are violations."""
    a, good = parts(spark, sf_dir)
    last = good.filter("origin = 7")
    overlaps = last.select(F.lit(100).alias("origin"), "origin_date", F.col("origin_date").alias("first_test"), "last_test")
    beyond = last.select(F.lit(101).alias("origin"), F.date_add("origin_date", 1).alias("origin_date"), F.date_add("first_test", 1).alias("first_test"), F.date_add("last_test", 1).alias("last_test"))
    short = last.select(F.lit(102).alias("origin"), "origin_date", "first_test", F.date_sub("last_test", 1).alias("last_test"))
    return forecast.fold_violations(a, good.unionByName(overlaps).unionByName(beyond).unionByName(short))


def naive_scale(spark, sf_dir):
    return rounded(forecast.states(*parts(spark, sf_dir)).select("origin", "series_id", "naive_scale"), 6)


def rotation_bands(spark, sf_dir):
    return rounded(train_bands(spark, sf_dir))


def backtest_baselines(spark, sf_dir):
    return rounded(result_of(spark, sf_dir).select("model", "series_id", "origin", "h", "dt", "y_true", "y_pred"))


def forecast_seasonal_ar(spark, sf_dir):
    return rounded(result_of(spark, sf_dir, ("seasonal_ar",)).select("series_id", "origin", "h", "y_true", "y_pred"))


def forecast_weekly_profile(spark, sf_dir):
    a, f = parts(spark, sf_dir)
    return rounded(forecast.weekday_levels(a, f).select("origin", "series_id", "weekday", "profile"))


def forecast_croston(spark, sf_dir):
    """Croston's forecast of each series at every origin, over its whole history up to that."""
    return rounded(forecast.croston_levels(*parts(spark, sf_dir)))


def forecast_future(spark, sf_dir):
    """Seven days beyond the panel from each series' last state, with intervals from the residuals of all folds."""
    a, f = parts(spark, sf_dir)
    said = forecast.beyond(a, ("moving_average",))
    return rounded(intervals.residual_conformal(forecast.backtest(a, f, ("moving_average",)), said).select("series_id", "h", "dt", "y_pred", "pred_lo", "pred_hi"))


def backtest_croston(spark, sf_dir):
    """Croston, the weekly profile and zero as models of the backtest."""
    a, f = parts(spark, sf_dir)
    return rounded(metrics.by(forecast.backtest(a, f, ("croston", "weekly_profile", "zero")), "origin"))


def result_violations(spark, sf_dir):
    return forecast.result_violations(result_of(spark, sf_dir))


def metrics_by_origin(spark, sf_dir):
    return rounded(metrics.by(result_of(spark, sf_dir), "origin"))


def metrics_by_horizon(spark, sf_dir):
    return rounded(metrics.by(result_of(spark, sf_dir), "h"))


def metrics_by_band(spark, sf_dir):
    built = parts(spark, sf_dir)
    return rounded(metrics.by_band(result_of(spark, sf_dir, built=built), train_bands(spark, sf_dir, built)))


def metric_summary(spark, sf_dir):
    return rounded(metrics.summary(result_of(spark, sf_dir)))


def improvement(spark, sf_dir):
    return rounded(metrics.improvement(metrics.summary(result_of(spark, sf_dir)), "seasonal_naive"))


def breakdown_long(spark, sf_dir):
    built = parts(spark, sf_dir)
    return rounded(metrics.long_form(result_of(spark, sf_dir, built=built), train_bands(spark, sf_dir, built)))


def model_groups(spark, sf_dir):
    return rounded(metrics.model_groups(metrics.summary(result_of(spark, sf_dir)), "seasonal_naive"))


def band_verdicts(spark, sf_dir):
    """Whether the moving average is better than the seasonal naive in each band, beyond 5 %."""
    built = parts(spark, sf_dir)
    each = metrics.by_band(result_of(spark, sf_dir, built=built), train_bands(spark, sf_dir, built))
    two = each.groupBy("rotation_band").pivot("model", ["moving_average", "seasonal_naive"]).agg(F.first("mase"))
    return two.select("rotation_band", metrics.band_verdict(F.col("moving_average"), F.col("seasonal_naive")).alias("verdict"))


def residual_anomalies(spark, sf_dir, z: float = 3.0):
    """Residuals of the moving average that lie over z deviations from their series' mean."""
    r = result_of(spark, sf_dir, ("moving_average",)).withColumn("residual", F.col("y_true") - F.col("y_pred"))
    w = Window.partitionBy("series_id")
    score = (F.col("residual") - F.avg("residual").over(w)) / F.nullif(F.stddev_pop("residual").over(w), F.lit(0.0))
    return rounded(r.withColumn("z", score).filter(F.abs("z") > z).select("series_id", "origin", "h", "residual", "z"))


def typed_result(spark, sf_dir):
    """Results of two runs, added to an empty one."""
    built = parts(spark, sf_dir)
    out = forecast.empty_result(spark)
    for model in ("naive", "moving_average"):
        out = out.unionByName(forecast.cast_result(result_of(spark, sf_dir, (model,), built)))
    return rounded(out)


QUERIES = {f.__name__: f for f in (folds, fold_disjoint, naive_scale, rotation_bands, backtest_baselines, forecast_seasonal_ar, forecast_weekly_profile, forecast_croston, forecast_future, backtest_croston, result_violations, typed_result, metrics_by_origin, metrics_by_horizon, metrics_by_band, metric_summary, improvement, breakdown_long, model_groups, band_verdicts, residual_anomalies)}

FOLDS = """
fd as (select cast(k as int) as origin, date '1998-04-07' - 7 - 3 * (7 - cast(k as int)) as origin_date from (select unnest(range(8)) as k))"""

#: bt: (model, series_id, origin, h, dt, y_true, y_pred, naive_scale), from definitions rather than arrays.
BACKTEST = """
sc as (
  select origin, series_id, greatest(coalesce(s, avg(s) over (partition by origin)), 0.001) as naive_scale from (
    select f.origin, a.series_id, avg(abs(a.sale - b.sale)) as s
    from fd f join pa a on a.dt <= f.origin_date left join pa b on b.series_id = a.series_id and b.dt = a.dt - 7 group by 1, 2)),
grid as (select f.origin, f.origin_date, s.series_id, cast(t.h as int) as h, f.origin_date + cast(t.h as int) as dt from fd f cross join (select distinct series_id from pa) s cross join (select unnest(range(1, 8)) as h) t),
said as (
  select 'naive' as model, g.*, p.sale as y_pred from grid g join pa p on p.series_id = g.series_id and p.dt = g.origin_date
  union all select 'seasonal_naive', g.*, p.sale from grid g join pa p on p.series_id = g.series_id and p.dt = g.dt - 7
  union all select 'moving_average', g.*, m.m from grid g join (
    select f.origin, p.series_id, avg(p.sale) as m from fd f join pa p on p.dt between f.origin_date - 20 and f.origin_date group by 1, 2) m on m.origin = g.origin and m.series_id = g.series_id
  union all select 'seasonal_moving_average', any_value(g.origin), any_value(g.origin_date), g.series_id, any_value(g.h), g.dt, avg(p.sale)
    from grid g join pa p on p.series_id = g.series_id and p.dt in (g.dt - 7, g.dt - 14, g.dt - 21, g.dt - 28) group by g.origin, g.series_id, g.dt),
bt as (select s.model, s.series_id, s.origin, s.h, s.origin_date, s.dt, p.sale as y_true, s.y_pred, c.naive_scale from said s join pa p on p.series_id = s.series_id and p.dt = s.dt join sc c on c.origin = s.origin and c.series_id = s.series_id)"""

BANDS = """
bm as (select series_id, avg(sale) as m from pa where dt <= (select min(origin_date) from fd) group by 1),
bands as (
  select series_id, m, case when m <= (select quantile_cont(m, 0.5) from bm) then 'low' when m > (select quantile_cont(m, 0.85) from bm) then 'high' else 'mid' end as rotation_band from bm)"""

#: cq: the conformal quantile of each step at 90 %; quantile_cont needs a constant level, so ranks are interpolated by hand.
CONFORMAL_RANKS = """cs as (select h, {score} as s from {rows}),
rk as (select h, s, row_number() over (partition by h order by s) - 1 as k, count(*) over (partition by h) as n from cs),
pl as (select h, s, k, n, least(ceil((n + 1) * 0.9) / n, 1) * (n - 1) as place from rk),
cq as (select h, max(case when k = floor(place) then s end) + (max(case when k = least(floor(place) + 1, n - 1) then s end) - max(case when k = floor(place) then s end)) * (max(place) - floor(max(place))) as q from pl group by h)"""

POINT = """avg(abs(y_true - y_pred)) as mae, sqrt(avg(pow(y_true - y_pred, 2))) as rmse, avg(y_pred - y_true) as bias, avg(abs(y_true - y_pred) / naive_scale) as mase,
  case when sum(y_true) > 0 then sum(abs(y_true - y_pred)) / sum(y_true) end as wape,
  coalesce(avg(2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred))) filter (where abs(y_true) + abs(y_pred) > 0), 0) as smape"""
SIX = ("mae", "rmse", "bias", "mase", "wape", "smape")
ROUNDED = ", ".join(f"round({m}, 4) as {m}" for m in SIX)
BT = sql.of(sql.PANEL_A, FOLDS, BACKTEST)
BT_BANDS = sql.of(sql.PANEL_A, FOLDS, BACKTEST, BANDS)
SUMMARY = f""", og as (select model, origin, {POINT} from bt group by 1, 2),
lg as (unpivot og on mae, rmse, bias, mase, wape, smape into name metric value value),
sm as (select model, metric, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, max(value) as worst, min(value) as best, count(*) as n_origins from lg group by 1, 2)"""

ORACLE_SQL = {
    "folds": sql.of(FOLDS) + "select origin, origin_date, origin_date + 1 as first_test, origin_date + 7 as last_test from fd",
    "fold_disjoint": sql.of(FOLDS)
    + """, every as (select origin, origin_date, origin_date + 1 as first_test, origin_date + 7 as last_test from fd
      union all select 100, origin_date, origin_date, origin_date + 7 from fd where origin = 7
      union all select 101, origin_date + 1, origin_date + 2, origin_date + 8 from fd where origin = 7
      union all select 102, origin_date, origin_date + 1, origin_date + 6 from fd where origin = 7)
    select cast(origin as int) as origin, origin_date from every where first_test <= origin_date or last_test > date '1998-04-07' or last_test - first_test <> 6 or origin_date < date '1998-01-01'""",
    "naive_scale": BT + "select origin, series_id, round(naive_scale, 6) as naive_scale from sc",
    "rotation_bands": BT_BANDS + "select series_id, round(m, 4) as mean_demand, rotation_band from bands",
    "backtest_baselines": BT + "select model, series_id, origin, h, dt, round(cast(y_true as double), 4) as y_true, round(cast(y_pred as double), 4) as y_pred from bt",
    "forecast_seasonal_ar": sql.of(sql.PANEL_A, FOLDS)
    + """, xy as (select f.origin, f.origin_date, a.series_id, a.sale as y, b.sale as x from fd f join pa a on a.dt <= f.origin_date join pa b on b.series_id = a.series_id and b.dt = a.dt - 7),
    co as (select origin, origin_date, series_id, case when var_pop(x) > 1e-9 then greatest(least(covar_pop(y, x) / var_pop(x), 1), -1) else 0 end as slope, avg(y) as my, avg(x) as mx from xy group by 1, 2, 3),
    z as (select f.origin, p.series_id, max(p.sale) as top from fd f join pa p on p.dt between f.origin_date - 27 and f.origin_date group by 1, 2)
    select c.series_id, c.origin, cast(t.h as int) as h, round(cast(p.sale as double), 4) as y_true, round(case when z.top <= 0 then 0.0 else greatest(my - slope * mx + slope * l.sale, 0) end, 4) as y_pred
    from co c cross join (select unnest(range(1, 8)) as h) t join pa p on p.series_id = c.series_id and p.dt = c.origin_date + cast(t.h as int)
    join pa l on l.series_id = c.series_id and l.dt = p.dt - 7 join z on z.origin = c.origin and z.series_id = c.series_id""",
    "forecast_weekly_profile": sql.of(sql.PANEL_A, FOLDS) + "select f.origin, p.series_id, cast(isodow(p.dt) - 1 as int) as weekday, round(avg(p.sale), 4) as profile from fd f join pa p on p.dt <= f.origin_date group by 1, 2, 3",
    "forecast_croston": sql.A.replace("with ", "with recursive ", 1)
    + """, ys as (select series_id, sale as y, row_number() over (partition by series_id order by dt) as n from pa),
    cr as (
      select series_id, 0 as n, cast(null as double) as size, 1.0::double as gap, 1.0::double as since from (select distinct series_id from ys)
      union all
      select c.series_id, c.n + 1, case when y > 0 then case when size is null then y else 0.1 * y + 0.9 * size end else size end,
             case when y > 0 then case when size is null then since else 0.1 * since + 0.9 * gap end else gap end, case when y > 0 then 1.0 else since + 1 end
      from cr c join ys on ys.series_id = c.series_id and ys.n = c.n + 1)
    select f.k as origin, series_id, round(coalesce(0.95 * size / greatest(gap, 1), 0), 4) as y_pred
    from cr join (select cast(unnest(range(8)) as int) as k) f on cr.n = 97 - 7 - 3 * (7 - f.k)""",
    "forecast_future": BT
    + ", ma as (select * from bt where model = 'moving_average'), "
    + CONFORMAL_RANKS.format(score="abs(y_true - y_pred)", rows="ma")
    + """, fu as (select series_id, avg(sale) as p from pa where dt > date '1998-04-07' - 21 group by 1)
    select series_id, cast(h as int) as h, date '1998-04-07' + cast(h as int) as dt, round(cast(p as double), 4) as y_pred, round(cast(greatest(p - greatest(q, 1e-6), 0) as double), 4) as pred_lo, round(cast(p + greatest(q, 1e-6) as double), 4) as pred_hi from fu cross join cq""",
    "backtest_croston": BT.replace("with ", "with recursive ", 1)
    + f""", ys as (select series_id, sale as y, row_number() over (partition by series_id order by dt) as n from pa),
    cr as (
      select series_id, 0 as n, cast(null as double) as size, 1.0::double as gap, 1.0::double as since from (select distinct series_id from ys)
      union all
      select c.series_id, c.n + 1, case when y > 0 then case when size is null then y else 0.1 * y + 0.9 * size end else size end,
             case when y > 0 then case when size is null then since else 0.1 * since + 0.9 * gap end else gap end, case when y > 0 then 1.0 else since + 1 end
      from cr c join ys on ys.series_id = c.series_id and ys.n = c.n + 1),
    wd as (select f.origin, p.series_id, isodow(p.dt) as d, avg(p.sale) as m from fd f join pa p on p.dt <= f.origin_date group by 1, 2, 3),
    three as (
      select 'croston' as model, g.*, coalesce(0.95 * size / greatest(gap, 1), 0) as y_pred from grid g join cr on cr.series_id = g.series_id and cr.n = 97 - 7 - 3 * (7 - g.origin)
      union all select 'weekly_profile', g.*, wd.m from grid g join wd on wd.origin = g.origin and wd.series_id = g.series_id and wd.d = isodow(g.dt)
      union all select 'zero', g.*, 0.0 from grid g),
    b3 as (select s.model, s.origin, s.series_id, p.sale as y_true, s.y_pred, c.naive_scale from three s join pa p on p.series_id = s.series_id and p.dt = s.dt join sc c on c.origin = s.origin and c.series_id = s.series_id)
    select model, origin, {ROUNDED}, n from (select model, origin, {POINT}, count(*) as n from b3 group by 1, 2)""",
    "result_violations": BT
    + """select unnest(['not_after_origin', 'step_is_wrong', 'scale_not_positive', 'null_value', 'duplicate_key', 'scale_varies']) as rule,
      unnest([count(*) filter (where dt <= origin_date), count(*) filter (where dt - origin_date <> h), count(*) filter (where naive_scale <= 0), count(*) filter (where y_true is null or y_pred is null),
              count(*) - count(distinct (model, origin, series_id, dt)), (select count(*) from (select 1 from bt group by origin, series_id having min(naive_scale) <> max(naive_scale)))]) as violations from bt""",
    "metrics_by_origin": BT + f"select model, origin, {ROUNDED}, n from (select model, origin, {POINT}, count(*) as n from bt group by 1, 2)",
    "metrics_by_horizon": BT + f"select model, h, {ROUNDED}, n from (select model, h, {POINT}, count(*) as n from bt group by 1, 2)",
    "metrics_by_band": BT_BANDS + f"select model, rotation_band, {ROUNDED}, n from (select model, rotation_band, {POINT}, count(*) as n from bt join bands using (series_id) group by 1, 2)",
    "improvement": BT
    + SUMMARY
    + """, v as (select model, mean as value from sm where metric = 'mase'), r as (select value as ref from v where model = 'seasonal_naive')
    select model, round(value, 4) as value, round(100 * (1 - value / ref), 4) as improvement_pct, value < ref as beats, 100 * (1 - value / ref) >= 20 as reaches_target from v, r""",
    "breakdown_long": BT_BANDS
    + f""", cuts as (
      select model, 'origin' as cut, cast(origin as varchar) as key, {POINT} from bt group by 1, 2, 3
      union all select model, 'h', cast(h as varchar), {POINT} from bt group by 1, 2, 3
      union all select model, 'band', rotation_band, {POINT} from bt join bands using (series_id) group by 1, 2, 3),
    four as (select model, cut, key, mase, wape, mae, rmse from cuts)
    select model, cut, key, metric, round(value, 4) as value from (unpivot four on mase, wape, mae, rmse into name metric value value)""",
    "model_groups": BT
    + SUMMARY
    + """, w as (select model, max(mean) filter (where metric = 'mae') as mae, max(mean) filter (where metric = 'mase') as mase, max(mean) filter (where metric = 'rmse') as rmse, max(mean) filter (where metric = 'wape') as wape from sm group by 1)
    select string_agg(model, ',' order by model) as models, round(min(mase), 4) as mase, round(100 * (1 - min(mase) / (select mase from w where model = 'seasonal_naive')), 4) as improvement_pct
    from w group by round(mae, 6), round(w.mase, 6), round(rmse, 6), round(wape, 6)""",
    "band_verdicts": BT_BANDS
    + """, e as (select rotation_band, avg(abs(y_true - y_pred) / naive_scale) filter (where model = 'moving_average') as a, avg(abs(y_true - y_pred) / naive_scale) filter (where model = 'seasonal_naive') as b from bt join bands using (series_id) group by 1)
    select rotation_band, case when a < 0.95 * b then 'better' when a > 1.05 * b then 'worse' else 'equal' end as verdict from e""",
    "residual_anomalies": BT
    + """, r as (select series_id, origin, h, y_true - y_pred as residual from bt where model = 'moving_average'),
    z as (select *, (residual - avg(residual) over (partition by series_id)) / nullif(stddev_pop(residual) over (partition by series_id), 0) as z from r)
    select series_id, origin, h, round(cast(residual as double), 4) as residual, round(z, 4) as z from z where abs(z) > 3""",
}
ORACLE_SQL["metric_summary"] = BT + SUMMARY + "select model, metric, round(mean, 4) as mean, round(std, 4) as std, round(worst, 4) as worst, round(best, 4) as best, n_origins from sm"
ORACLE_SQL["typed_result"] = (
    BT
    + """select model, origin, origin_date, series_id, dt, h, round(cast(y_true as double), 4) as y_true, round(cast(y_pred as double), 4) as y_pred, round(cast(y_true as double), 4) as y_observed,
    false as is_censored, cast(1 as double) as available_weight, round(cast(naive_scale as double), 4) as naive_scale from bt where model in ('naive', 'moving_average')"""
)
