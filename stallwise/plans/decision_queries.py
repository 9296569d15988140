"""Queries over intervals, orders and policies, on Panel A's backtest: folds 0-3 calibrate, folds 4-7 are judged."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions.arrays import at_level, quantile_name
from stallwise.functions.statistics import half_up
from stallwise.operators import decision, forecast, intervals, metrics
from stallwise.operators.lineage import written
from stallwise.plans import sql
from stallwise.plans.backtest_queries import BACKTEST, BANDS, FOLDS, parts, result_of, train_bands
from stallwise.plans.panel_queries import rounded
from stallwise.sources import panels

MODEL, CURRENT, ALPHA = "moving_average", "seasonal_naive", 0.1
LEVELS = decision.LEVELS


def halves(spark, sf_dir, models=(MODEL,), built=None):
    r = written(result_of(spark, sf_dir, models, built))
    return r.filter("origin < 4"), r.filter("origin >= 4")


def with_grid(spark, sf_dir, built=None):
    """The judged folds with predicted quantiles."""
    return written(intervals.residual_grid(*halves(spark, sf_dir, built=built), LEVELS))


def with_current(spark, sf_dir, built=None):
    """The judged folds: the model with its predicted quantiles, and what the current policy orders, the same weekday of
    the week before."""
    early, late = halves(spark, sf_dir, (MODEL, CURRENT), built)
    model = F.col("model") == MODEL
    return written(intervals.residual_grid(early.filter(model), late.filter(model), LEVELS).unionByName(late.filter(~model), allowMissingColumns=True))


def last_lines(spark, sf_dir, built=None):
    """Reorder lines of the last fold: all series, seven days ahead."""
    a, folds = built = built or parts(spark, sf_dir)
    known = a.crossJoin(F.broadcast(folds.agg(F.max("origin_date").alias("_o")))).filter("dt <= _o").drop("_o")
    return decision.reorder_lines(with_grid(spark, sf_dir, built).filter("origin = 7"), decision.current_policy(known))


def quantile_grid(spark, sf_dir):
    return rounded(with_grid(spark, sf_dir).select("series_id", "origin", "h", *map(quantile_name, LEVELS)))


def conformal_residual(spark, sf_dir):
    return rounded(intervals.residual_conformal(*halves(spark, sf_dir), ALPHA).select("series_id", "origin", "h", "y_pred", "pred_lo", "pred_hi"))


def wrapped_quantiles(spark, sf_dir):
    """Quantiles of a point model from its calibrated interval."""
    done = intervals.residual_conformal(*halves(spark, sf_dir), ALPHA)
    return rounded(intervals.wrapped_quantiles(done, LEVELS, ALPHA).select("series_id", "origin", "h", *map(quantile_name, LEVELS)))


def series_dispersion(spark, sf_dir):
    return rounded(intervals.dispersion(panels.panel_a(spark, sf_dir)))


def conformal_adaptive(spark, sf_dir):
    """Residual intervals in proportion to each series' dispersion as of the first judged origin."""
    a, folds = built = parts(spark, sf_dir)
    known = a.crossJoin(F.broadcast(folds.filter("origin = 4").select(F.col("origin_date").alias("_o")))).filter("dt <= _o").drop("_o")
    return rounded(intervals.residual_conformal(*halves(spark, sf_dir, built=built), ALPHA, intervals.dispersion(known)).select("series_id", "origin", "h", "pred_lo", "pred_hi"))


def cqr(spark, sf_dir):
    """Grids from folds 0-1, conformal scores from folds 2-3, judged on folds 4-7."""
    r = written(result_of(spark, sf_dir, (MODEL,)))
    fit = r.filter("origin < 2")
    grids = [intervals.residual_grid(fit, r.filter(c), (0.05, 0.95)) for c in ("origin in (2, 3)", "origin >= 4")]
    return intervals.conformal_quantiles(*grids, quantile_name(0.05), quantile_name(0.95), ALPHA)


def conformal_cqr(spark, sf_dir):
    return rounded(cqr(spark, sf_dir).select("series_id", "origin", "h", "pred_lo", "pred_hi"))


def coverage_report(spark, sf_dir):
    return rounded(metrics.coverage_report(cqr(spark, sf_dir), ALPHA))


def coverage_by_horizon(spark, sf_dir):
    return rounded(metrics.coverage_report(cqr(spark, sf_dir), ALPHA, keys=("h",)))


def quantile_metrics(spark, sf_dir):
    return rounded(metrics.quantile_metrics(with_grid(spark, sf_dir), LEVELS), 5)


def order_from_quantiles(spark, sf_dir):
    """Orders at the critical level, from a grid without it and from one with it."""
    g = with_grid(spark, sf_dir)
    few = (0.05, 0.5, 0.9, 0.95)
    return rounded(g.select("series_id", "origin", "h", at_level(decision.grid(few), few, decision.Economics().level).alias("interpolated"), decision.best_order(LEVELS).alias("trained")), 6)


def newsvendor_expected(spark, sf_dir):
    g = with_grid(spark, sf_dir).withColumn("qty", decision.best_order(LEVELS))
    return rounded(g.select("series_id", "origin", "h", *(c.alias(n) for n, c in decision.expected(LEVELS, F.col("qty")).items())), 8)


def policies(spark, sf_dir, keys=()):
    built = parts(spark, sf_dir)
    g = with_current(spark, sf_dir, built)
    if keys:
        g = g.join(train_bands(spark, sf_dir, built).select("series_id", "rotation_band"), "series_id")
    orders = written(decision.four_policies(g, CURRENT, MODEL, LEVELS, keys=keys))
    return decision.compared(decision.outcomes(orders, ("policy", *keys)), "current", keys)


def policy_outcomes(spark, sf_dir):
    return rounded(policies(spark, sf_dir))


def policy_by_band(spark, sf_dir):
    return rounded(policies(spark, sf_dir, ("rotation_band",)).select("policy", "rotation_band", "total_cost", "fill_rate", "spoilage_rate", "saving_pct"))


def roi_relative(spark, sf_dir):
    return rounded(decision.relative_roi(policies(spark, sf_dir)))


def roi_grid(spark, sf_dir):
    return rounded(decision.roi_scenarios(decision.relative_roi(policies(spark, sf_dir)), 1_000_000.0, 0.25, 0.08))


def economics_sweep(spark, sf_dir):
    return rounded(decision.economics_sweep(with_current(spark, sf_dir), CURRENT, MODEL))


def economics_levels(spark, sf_dir):
    """The critical level of each discount that was given, as if it were the loss on what is left over."""
    a = panels.panel_a(spark, sf_dir)
    waste = F.greatest(1 - F.col("discount"), F.lit(0.01))
    return a.select(half_up(1 / (1 + waste), 4).alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("days"))


def current_policy(spark, sf_dir):
    return rounded(decision.current_policy(panels.panel_a(spark, sf_dir)))


def plan_default(spark, sf_dir):
    return rounded(decision.default_plan(panels.panel_a(spark, sf_dir)))


def reorder_lines(spark, sf_dir):
    return rounded(last_lines(spark, sf_dir).select("series_id", "h", "qty", "policy_qty", "expected_demand", "cost_model", "cost_policy", "saving", "delta_pct"))


def reorder_catalog(spark, sf_dir):
    """The first page of the catalogue by expected saving; it is a page by definition."""
    return rounded(decision.catalogue(last_lines(spark, sf_dir)).select("series_id", "qty", "policy_qty", "saving"))


def reorder_totals(spark, sf_dir):
    return rounded(decision.catalogue_totals(last_lines(spark, sf_dir)), 3)


QUERIES = {f.__name__: f for f in (quantile_grid, conformal_residual, wrapped_quantiles, series_dispersion, conformal_adaptive, conformal_cqr, coverage_report, coverage_by_horizon, quantile_metrics, order_from_quantiles, newsvendor_expected, policy_outcomes, policy_by_band, roi_relative, roi_grid, economics_sweep, economics_levels, current_policy, plan_default, reorder_lines, reorder_catalog, reorder_totals)}

BASE = sql.of(sql.PANEL_A, FOLDS, BACKTEST, "ma as (select * from bt where model = 'moving_average')")
Q = ("q05", "q50", "q62", "q90", "q95")
GRID = f""", gr as (select h, {', '.join(f'quantile_cont(y_true - y_pred, {q}) as r{k}' for k, q in enumerate(LEVELS))} from ma where origin < 4 group by h),
g as (select m.*, {', '.join(f'greatest(y_pred + r{k}, 0) as {n}' for k, n in enumerate(Q))} from ma m join gr using (h) where origin >= 4)"""

#: Linear interpolation at (n - 1) * level of the sorted scores.
CONFORMAL = "quantile_cont({0}, least(ceil((count(*) + 1) * 0.9) / count(*), 1))"


def _conformal(score: str, rows: str) -> str:
    """Step quantiles of a score; quantile_cont needs a constant level, so ranks are interpolated by hand."""
    return f"""cs as (select h, {score} as s from {rows}),
rk as (select h, s, row_number() over (partition by h order by s) - 1 as k, count(*) over (partition by h) as n from cs),
pl as (select h, s, k, n, least(ceil((n + 1) * 0.9) / n, 1) * (n - 1) as place from rk),
cq as (select h, max(case when k = floor(place) then s end) + (max(case when k = least(floor(place) + 1, n - 1) then s end) - max(case when k = floor(place) then s end)) * (max(place) - floor(max(place))) as q from pl group by h)"""


def _expected(order: str) -> dict[str, str]:
    ys, us = [Q[0], *Q, Q[-1]], [0.0, *LEVELS, 1.0]
    demand, short = [], []
    for a, b, lo, hi in zip(ys, ys[1:], us, us[1:]):
        du = repr(hi - lo)
        ea, eb = f"({a} - {order})", f"({b} - {order})"
        demand.append(f"({a} + {b}) / 2 * {du}")
        short.append(f"case when {ea} >= 0 and {eb} >= 0 then ({ea} + {eb}) / 2 * {du} when {ea} <= 0 and {eb} <= 0 then 0 else pow(greatest({ea}, {eb}), 2) / (2 * abs({eb} - {ea})) * {du} end")
    d, s = "(" + " + ".join(demand) + ")", "(" + " + ".join(short) + ")"
    return {"d": d, "s": s, "w": f"greatest({s} - {d} + {order}, 0)"}


E1 = _expected("q62")
POLICIES = """, od as (
  select series_id, 'current' as policy, y_true, y_pred as qty from bt where model = 'seasonal_naive' and origin >= 4
  union all select series_id, 'model', y_true, q62 from g
  union all select series_id, 'static', y_true, quantile_cont(y_true, 0.625) over (partition by series_id) from g
  union all select series_id, 'perfect', y_true, y_true from g),
oc as (
  select policy, greatest(y_true - qty, 0) as s, greatest(qty - y_true, 0) as w, y_true, qty, series_id from od),
po as (
  select policy, sum(s + 0.6 * w) as total_cost, avg(s + 0.6 * w) as mean_cost, avg(s) as mean_shortage, avg(w) as mean_waste, 1 - sum(s) / sum(y_true) as fill_rate,
         avg((s <= 1e-9)::int) as service_level, coalesce(sum(w) / nullif(sum(qty), 0), 0) as spoilage_rate, avg(qty) as mean_order, count(*) as n from oc group by 1),
pc as (select p.*, -100 * (p.total_cost / (select total_cost from po where policy = 'current') - 1) as saving_pct from po p)"""
ROI = """, ri as (
  select m.saving_pct as cost_saving_pct, c.fill_rate as fill_rate_current, m.fill_rate as fill_rate_model, 100 * (m.fill_rate - c.fill_rate) as fill_rate_gain_pp,
         c.service_level as service_level_current, m.service_level as service_level_model, c.spoilage_rate as spoilage_current, m.spoilage_rate as spoilage_model,
         100 * (c.spoilage_rate - m.spoilage_rate) as spoilage_reduction_pp, m.saving_pct / 100 as captured_fraction, m.saving_pct - s.saving_pct as gain_over_static_pp
  from (select * from pc where policy = 'model') m, (select * from pc where policy = 'current') c, (select * from pc where policy = 'static') s)"""
EM, EP = _expected("qty"), _expected("policy_qty")
LINES = f""", pq as (select series_id, greatest(avg(sale), 0) as policy_qty from pa where dt <= date '1998-04-07' - 7 and dt > date '1998-04-07' - 28 group by 1),
l0 as (select g.*, q62 as qty, policy_qty from g join pq using (series_id) where origin = 7),
ln as (select *, {EM['d']} as d, {EM['s']} as sm, {EM['w']} as wm, {EP['s']} as sp, {EP['w']} as wp from l0),
li as (select series_id, h, qty, policy_qty, d as expected_demand, sm + 0.6 * wm as cost_model, sp + 0.6 * wp as cost_policy, sp + 0.6 * wp - sm - 0.6 * wm as saving,
              case when policy_qty > 0 then 100 * (qty / policy_qty - 1) end as delta_pct, wm as waste_model, wp as waste_policy from ln)"""


def _round(*cols: str, places: int = 4) -> str:
    return ", ".join(f"round(cast({c} as double), {places}) as {c}" for c in cols)


CQR = (
    BASE
    + """, g2 as (select h, quantile_cont(y_true - y_pred, 0.05) as r0, quantile_cont(y_true - y_pred, 0.95) as r1 from ma where origin < 2 group by h),
gg as (select m.*, greatest(y_pred + r0, 0) as a, greatest(y_pred + r1, 0) as b from ma m join g2 using (h) where origin >= 2),
"""
    + _conformal("greatest(a - y_true, y_true - b)", "gg where origin < 4")
    + """, b0 as (select gg.*, greatest(a - q, 0) as lo, b + q as hi from gg join cq using (h) where origin >= 4),
iv as (select * exclude (lo, hi), case when lo > hi then (lo + hi) / 2 else lo end as pred_lo, case when lo > hi then (lo + hi) / 2 else hi end as pred_hi from b0)"""
)
COVER = """avg((y_true >= pred_lo - 1e-9 and y_true <= pred_hi + 1e-9)::int) as coverage, avg(pred_hi - pred_lo) as width,
  avg(pred_hi - pred_lo + 20 * (greatest(pred_lo - y_true, 0) + greatest(y_true - pred_hi, 0))) as interval_score, count(*) as n"""
COVERED = "round(coverage, 4) as coverage, round(width, 4) as width, round(interval_score, 4) as interval_score, n, round(coverage - 0.9, 4) as gap, coverage >= 0.88 as reaches_nominal"
DISPERSION = """ds as (
  select series_id, greatest(coalesce(avg(step), 0), 1e-6) as dispersion from (
    select series_id, abs(sale - lag(sale) over (partition by series_id order by dt)) as step from pa where dt > {0} - 28 and dt <= {0}) group by 1)"""

ORACLE_SQL = {
    "quantile_grid": BASE + GRID + f"select series_id, origin, h, {', '.join(f'round(cast({n} as double), 4) as pred_{n}' for n in Q)} from g",
    "conformal_residual": BASE
    + ", "
    + _conformal("abs(y_true - y_pred)", "ma where origin < 4")
    + f"select series_id, origin, h, {_round('y_pred')}, round(greatest(y_pred - greatest(q, 1e-6), 0), 4) as pred_lo, round(y_pred + greatest(q, 1e-6), 4) as pred_hi from ma join cq using (h) where origin >= 4",
    "wrapped_quantiles": BASE
    + ", "
    + _conformal("abs(y_true - y_pred)", "ma where origin < 4")
    + ", iv as (select series_id, origin, h, y_pred as m, greatest(y_pred - greatest(q, 1e-6), 0) as lo, y_pred + greatest(q, 1e-6) as hi from ma join cq using (h) where origin >= 4) select series_id, origin, h, "
    + ", ".join(f"round(greatest(case when {q} <= 0.5 then lo + (m - lo) * (greatest({q}, 0.05) - 0.05) / 0.45 else m + (hi - m) * (least({q}, 0.95) - 0.5) / 0.45 end, 0), 4) as {quantile_name(q)}" for q in LEVELS)
    + " from iv",
    "series_dispersion": sql.of(sql.PANEL_A, DISPERSION.format("date '1998-04-07'")) + f"select series_id, {_round('dispersion')} from ds",
    "conformal_adaptive": BASE
    + ", "
    + DISPERSION.format("(select origin_date from fd where origin = 4)")
    + ", md as (select ma.*, dispersion from ma join ds using (series_id)), "
    + _conformal("abs(y_true - y_pred) / dispersion", "md where origin < 4")
    + "select series_id, origin, h, round(greatest(y_pred - greatest(q * dispersion, 1e-6), 0), 4) as pred_lo, round(y_pred + greatest(q * dispersion, 1e-6), 4) as pred_hi from md join cq using (h) where origin >= 4",
    "conformal_cqr": CQR + f"select series_id, origin, h, {_round('pred_lo', 'pred_hi')} from iv",
    "coverage_report": CQR + f"select model, {COVERED} from (select model, {COVER} from iv group by 1)",
    "coverage_by_horizon": CQR + f"select model, h, {COVERED} from (select model, h, {COVER} from iv group by 1, 2)",
    "quantile_metrics": BASE
    + GRID
    + " union all ".join(f"select model, {q}::double as level, round(avg(greatest({q} * (y_true - {n}), ({q} - 1) * (y_true - {n}))), 5) as pinball, round(avg((y_true <= {n} + 1e-9)::int), 5) as share_below from g group by 1" for q, n in zip(LEVELS, Q)),
    "order_from_quantiles": BASE + GRID + f"select series_id, origin, h, round(cast(q50 + (q90 - q50) * (0.625 - 0.5) / 0.4 as double), 6) as interpolated, round(cast(q62 as double), 6) as trained from g",
    "newsvendor_expected": BASE
    + GRID
    + f"""select series_id, origin, h, round(cast({E1['d']} as double), 8) as expected_demand, round(cast({E1['s']} as double), 8) as expected_shortage, round(cast({E1['w']} as double), 8) as expected_waste,
      round(cast({E1['s']} + 0.6 * {E1['w']} as double), 8) as expected_cost, 0.05::double as tail_mass from g""",
    "policy_outcomes": BASE + GRID + POLICIES + f"select policy, {_round('total_cost', 'mean_cost', 'mean_shortage', 'mean_waste', 'fill_rate', 'service_level', 'spoilage_rate', 'mean_order')}, n, {_round('saving_pct')} from pc",
    "policy_by_band": sql.of(sql.PANEL_A, FOLDS, BACKTEST, BANDS, "ma as (select * from bt where model = 'moving_average')")
    + GRID
    + POLICIES
    + """, pb as (select policy, rotation_band, sum(s + 0.6 * w) as total_cost, 1 - sum(s) / sum(y_true) as fill_rate, coalesce(sum(w) / nullif(sum(qty), 0), 0) as spoilage_rate from oc join bands using (series_id) group by 1, 2)
    select p.policy, p.rotation_band, round(p.total_cost, 4) as total_cost, round(p.fill_rate, 4) as fill_rate, round(p.spoilage_rate, 4) as spoilage_rate, round(-100 * (p.total_cost / c.total_cost - 1), 4) as saving_pct
    from pb p join pb c on c.rotation_band = p.rotation_band and c.policy = 'current'""",
    "roi_relative": BASE + GRID + POLICIES + ROI + "select " + _round("cost_saving_pct", "fill_rate_current", "fill_rate_model", "fill_rate_gain_pp", "service_level_current", "service_level_model", "spoilage_current", "spoilage_model", "spoilage_reduction_pp", "captured_fraction", "gain_over_static_pp") + " from ri",
    "roi_grid": BASE
    + GRID
    + POLICIES
    + ROI
    + """, sg as (select c::double as capture_fraction, 1e6 * spoilage_reduction_pp / 100 * c as a, 1e6 * fill_rate_gain_pp / 100 * 0.25 * c as b from ri, (values (0.3), (0.5), (0.7), (1.0)) t(c))
    select capture_fraction, 0.08::double as base_spoilage_rate, round(a, 4) as saving_from_spoilage, round(b, 4) as saving_from_lost_sales, round(a + b, 4) as total_saving, round((a + b) / 1e4, 4) as pct_of_revenue,
           case when capture_fraction <= 0.3 then 'pessimistic' when capture_fraction <= 0.5 then 'base' when capture_fraction < 1 then 'optimistic' else 'ceiling' end as scenario from sg""",
    "economics_sweep": BASE
    + GRID
    + """, rt as (select r::double as ratio, 1 / (1 + r::double) as level from (values (0.3), (0.6), (1.0), (1.5)) t(r)),
    so as (select ratio, level, y_true, y_pred, case when level <= 0.5 then q05 + (q50 - q05) * (level - 0.05) / 0.45 when level <= 0.625 then q50 + (q62 - q50) * (level - 0.5) / 0.125 else q62 + (q90 - q62) * (level - 0.625) / 0.275 end as qty from g, rt),
    cu as (select ratio, sum(greatest(y_true - y_pred, 0) + ratio * greatest(y_pred - y_true, 0)) as current_cost from bt, rt where model = 'seasonal_naive' and origin >= 4 group by 1),
    sw as (select so.ratio, level, sum(greatest(y_true - qty, 0) + so.ratio * greatest(qty - y_true, 0)) as model_cost, any_value(current_cost) as current_cost from so join cu on cu.ratio = so.ratio group by 1, 2)
    select ratio, round(level, 4) as level, round(model_cost, 4) as model_cost, round(current_cost, 4) as current_cost, round(100 * (1 - model_cost / current_cost), 4) as saving_pct from sw""",
    "economics_levels": sql.A + "select round(1 / (1 + greatest(1 - cast(discount as double), 0.01)), 4) as level, count(*) as days from pa group by 1",
    "current_policy": sql.A + "select series_id, round(greatest(avg(sale), 0), 4) as policy_qty from pa where dt > date '1998-04-07' - 21 group by 1",
    "plan_default": sql.A + "select round(greatest(least(quantile_cont(cast(discount as double), 0.5), 1), 1e-6), 4) as discount, cast(round_even(quantile_cont(activity, 0.5), 0) as int) as activity_flag from pa where dt > date '1998-04-07' - 21",
    "reorder_lines": BASE + GRID + LINES + "select series_id, h, " + _round("qty", "policy_qty", "expected_demand", "cost_model", "cost_policy", "saving", "delta_pct") + " from li",
    "reorder_catalog": BASE + GRID + LINES + "select series_id, " + _round("qty", "policy_qty", "saving") + " from li where h = 1 order by round(cast(li.saving as double), 6) desc nulls last, series_id limit 20",
    "reorder_totals": BASE + GRID + LINES + "select " + ", ".join(f"round(cast(sum({c}) as double), 3) as {c}" for c in ("qty", "policy_qty", "cost_model", "cost_policy", "saving")) + ", count(*) filter (where abs(delta_pct) > 20) as n_big_change, count(*) as n_lines from li",
}
