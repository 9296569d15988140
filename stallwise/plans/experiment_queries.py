"""Queries over paired experiments."""

from __future__ import annotations

from stallwise.operators import experiments, forecast
from stallwise.plans import sql
from stallwise.plans.backtest_queries import BT, parts
from stallwise.plans.panel_queries import recovered, rounded


def censoring_ablation(spark, sf_dir):
    """The 30-day panel with a reduced configuration: three origins, two days apart."""
    panel = recovered(spark, sf_dir)
    return rounded(experiments.censoring_ablation(panel, forecast.folds(panel, n_origins=3, step=2, min_train_days=14)))


def window_sweep(spark, sf_dir):
    return rounded(experiments.window_sweep(*parts(spark, sf_dir)))


#: Four random settings of each model beside the current ones.
TRIALS = experiments.random_trials(4)


def tuning(spark, sf_dir):
    """A seeded search over three models and all folds, in one job."""
    return rounded(experiments.tune(*parts(spark, sf_dir), TRIALS))


QUERIES = {f.__name__: f for f in (censoring_ablation, window_sweep, tuning)}

CROSTON = """ys as (select series_id, sale as y, row_number() over (partition by series_id order by dt) as n from pa),
    cr as (
      select al.value, s.series_id, 0 as n, cast(null as double) as size, 1.0::double as gap, 1.0::double as since from (select distinct series_id from ys) s cross join (select value from tr where model = 'croston') al
      union all
      select c.value, c.series_id, c.n + 1, case when y > 0 then case when size is null then y else c.value * y + (1 - c.value) * size end else size end,
             case when y > 0 then case when size is null then since else c.value * since + (1 - c.value) * gap end else gap end, case when y > 0 then 1.0 else since + 1 end
      from cr c join ys on ys.series_id = c.series_id and ys.n = c.n + 1)"""

ORACLE_SQL = {
    "censoring_ablation": sql.B_RECOVERED
    + """, f3 as (select cast(k as int) as origin, (select min(dt) from rc) + 18 + 2 * cast(k as int) as origin_date from (select unnest(range(3)) as k)),
    ys as (select 'observed' as basis, series_id, dt, sale as y from rc union all select 'recovered', series_id, dt, latent from rc),
    s3 as (select origin, series_id, greatest(coalesce(s, avg(s) over (partition by origin)), 0.001) as scale from (
      select f.origin, a.series_id, avg(abs(a.sale - b.sale)) as s from f3 f join rc a on a.dt <= f.origin_date left join rc b on b.series_id = a.series_id and b.dt = a.dt - 7 group by 1, 2)),
    m3 as (select f.origin, f.origin_date, y.basis, y.series_id, greatest(avg(y.y), 0) as p from f3 f join ys y on y.dt <= f.origin_date and y.dt > f.origin_date - 21 group by 1, 2, 3, 4),
    r3 as (select m.basis, m.p, r.sale, r.weight, r.cens, s.scale from m3 m join rc r on r.series_id = m.series_id and r.dt > m.origin_date and r.dt <= m.origin_date + 7 join s3 s on s.origin = m.origin and s.series_id = m.series_id)
    select basis, count(*) filter (where not cens) as n_clean, round(avg(abs(sale - p) / scale) filter (where not cens), 4) as mase_clean, round((avg(p * weight) - avg(sale)) / avg(sale), 4) as recensored_bias,
           round((avg(p) filter (where not cens) - avg(sale) filter (where not cens)) / avg(sale) filter (where not cens), 4) as clean_day_bias from r3 group by 1""",
    "window_sweep": BT
    + """, ws as (select w.w as win, f.origin, f.origin_date, p.series_id, avg(p.sale) as said from fd f cross join (values (7), (14), (21), (28)) w(w) join pa p on p.dt <= f.origin_date and p.dt > f.origin_date - w.w group by 1, 2, 3, 4),
    we as (select win, ws.origin, avg(abs(p.sale - said) / naive_scale) as mase from ws join pa p on p.series_id = ws.series_id and p.dt > origin_date and p.dt <= origin_date + 7 join sc on sc.origin = ws.origin and sc.series_id = ws.series_id group by 1, 2),
    wm as (select win, avg(mase) as mean, stddev_samp(mase) as std, avg(mase) + 0.5 * stddev_samp(mase) as objective from we group by 1)
    select cast(win as int) as window, round(mean, 4) as mean, round(std, 4) as std, round(objective, 4) as objective,
           objective = (select min(objective) from wm) and (select mean from wm where win = 21) - mean > (select std from wm where win = 21) as adopted from wm""",
}
ORACLE_SQL["tuning"] = (
    BT.replace("with ", "with recursive ", 1)
    + ", tr(model, value, is_current) as (values "
    + ", ".join(f"('{t.model}', {t.value}::double, {t.current})" for t in TRIALS)
    + "), "
    + CROSTON
    + """, said3 as (
      select t.model, t.value, f.origin, f.origin_date, p.series_id, cast(null as int) as h, avg(p.sale) as p from tr t cross join fd f join pa p on p.dt <= f.origin_date and p.dt > f.origin_date - cast(t.value as int) where t.model = 'moving_average' group by all
      union all select t.model, t.value, g.origin, g.origin_date, g.series_id, g.h, avg(p.sale) from tr t cross join grid g join pa p on p.series_id = g.series_id and (g.dt - p.dt) % 7 = 0 and p.dt < g.dt and p.dt >= g.dt - 7 * cast(t.value as int) where t.model = 'seasonal_moving_average' group by all
      union all select 'croston', cr.value, f.origin, f.origin_date, cr.series_id, null, coalesce((1 - cr.value / 2) * size / greatest(gap, 1), 0) from cr join fd f on cr.n = 97 - 7 - 3 * (7 - f.origin)),
    te as (select s.model, s.value, s.origin, avg(abs(p.sale - greatest(s.p, 0)) / sc.naive_scale) as mase from said3 s join pa p on p.series_id = s.series_id and p.dt > s.origin_date and p.dt <= s.origin_date + 7 and (s.h is null or p.dt = s.origin_date + s.h)
      join sc on sc.origin = s.origin and sc.series_id = s.series_id group by 1, 2, 3),
    ts as (select model, value, is_current, avg(mase) as mean, stddev_samp(mase) as std, avg(mase) + 0.5 * stddev_samp(mase) as objective from te join tr using (model, value) group by 1, 2, 3),
    tb as (select *, row_number() over (partition by model order by objective, is_current desc, value) = 1 as best, max(case when is_current then mean end) over (partition by model) as now_mean, max(case when is_current then std end) over (partition by model) as now_std from ts)
    select model, value, is_current, round(mean, 4) as mean, round(std, 4) as std, round(objective, 4) as objective, best, best and not is_current and now_mean - mean > now_std as adopted from tb"""
)
