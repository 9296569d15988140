"""Queries over scoring from a frozen state, training on both demand bases, what moves a prediction, and rank overlaps.

Where a fitted model's numbers can't be repeated in SQL, the oracle has the rows it must answer for, what it was given, and
what must hold of its answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions.arrays import quantile_name
from stallwise.operators import boosting, decision, experiments, features, forecast, leakage, linear, panel_checks, scoring, segments, triage
from stallwise.operators.lineage import written
from stallwise.operators.metrics import rotation_bands
from stallwise.operators.models import CATEGORICAL, NUMERIC
from stallwise.plans import sql
from stallwise.plans.decision_queries import BASE, GRID, Q, with_grid
from stallwise.plans.model_queries import PLAIN, linear_rows
from stallwise.plans.panel_queries import recovered, rounded
from stallwise.sources import panels

HORIZON = 7
LEVELS = (0.1, 0.5, 0.625, 0.9)
NAMES = [quantile_name(q) for q in LEVELS]


def rises(df, names=tuple(NAMES)):
    """Adds what must hold of predicted levels."""
    pairs = [F.col(a) <= F.col(b) for a, b in zip(names, names[1:])]
    whole = pairs[0]
    for p in pairs[1:]:
        whole = whole & p
    return df.withColumns({"levels_rise": whole, "not_negative": F.col(names[0]) >= 0})


def matrix_of(panel):
    """The state of every day and the supervised matrix at the training origins, written once."""
    state = written(features.origin_state(panel))
    return state, written(features.supervised_matrix(state, panel, features.training_origins(panel, HORIZON), HORIZON))


def scored(spark, sf_dir):
    """Seven days beyond the panel, by a global model trained on twenty origins, from each series' frozen state and
    the recent past's median covariates."""
    panel = written(panels.panel_a(spark, sf_dir))
    state, matrix = matrix_of(panel)
    trees = boosting.fit(matrix, [boosting.Head("y", q) for q in LEVELS], NUMERIC, CATEGORICAL, boosting.Params(rounds=8))
    index = panel_checks.series_index(panel)
    grid = scoring.future_grid(index.select("series_id"), panel.agg(F.max("dt").alias("origin_date")), decision.default_plan(panel), HORIZON)
    return trees.predict(scoring.scoring_rows(spark, scoring.save_state(state), scoring.with_hierarchy(grid, index)))


def score_future(spark, sf_dir):
    """What is scored for the days beyond the panel, and what must hold of the answers."""
    kept = ("series_id", "h", "dt", "dow", "third_category_id", "discount", "activity_flag", "latent_lag_0", "latent_roll_mean_7", "levels_rise", "not_negative")
    return rounded(rises(scored(spark, sf_dir)).select(*kept))


def score_future_levels(spark, sf_dir):
    """The predicted levels of the days beyond the panel."""
    return scored(spark, sf_dir).select("series_id", "h", "dt", *NAMES)


def bases_of(spark, sf_dir):
    panel = written(recovered(spark, sf_dir).withColumns({"discount": F.lit(1.0), "activity_flag": F.lit(0)}))
    last = panel.agg(F.max("dt").alias("last"))
    ago = lambda *days: last.select(F.explode(F.array(*(F.date_sub("last", d) for d in days))).alias("origin_date"))
    return experiments.train_bases(panel, ago(23, 22, 21), ago(14), ago(7), LEVELS, params=boosting.Params(rounds=8))


def train_bases(spark, sf_dir):
    """Both demand bases, trained and calibrated alike: rows of the test days, and what must hold."""
    rows = rises(bases_of(spark, sf_dir))
    holds = lambda c: F.min(F.col(c)).alias(c)
    return rows.withColumn("in_order", F.col("pred_lo") <= F.col("pred_hi")).groupBy("basis").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("series_id").alias("n_series"), F.round(F.avg("y_true"), 4).alias("mean_true"), holds("levels_rise"), holds("not_negative"), holds("in_order"))


def train_bases_metrics(spark, sf_dir):
    """Bias, error, coverage and width of both bases."""
    return experiments.compare_bases(bases_of(spark, sf_dir))


def contributions(spark, sf_dir):
    """The three features that move each prediction of the last training origin most, and the rest."""
    panel = written(panels.panel_a(spark, sf_dir))
    _, matrix = matrix_of(panel)
    head = boosting.Head("y", 0.625)
    trees = boosting.fit(matrix, [head], NUMERIC, CATEGORICAL, boosting.Params(rounds=6))
    last = matrix.agg(F.max("origin_date").alias("_o"))
    asked = matrix.join(F.broadcast(last), F.col("origin_date") == F.col("_o")).drop("_o")
    return boosting.contributions(trees, asked, ("series_id", "h"), head, top_k=3)


def attribution_top(spark, sf_dir):
    """Per prediction and rank the feature, its contribution and the base."""
    return contributions(spark, sf_dir)


def attribution_local(spark, sf_dir):
    """That base and contributions add up to each prediction."""
    sums = contributions(spark, sf_dir).groupBy("series_id", "h").agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(F.col("feature") == "rest").alias("n_rest"), F.abs(F.first("base") + F.sum("contribution") - F.first("prediction")).alias("off"))
    return sums.select("series_id", "h", "n_parts", "n_rest", (F.col("off") < 1e-6).alias("adds_up"))


def shuffle_test(spark, sf_dir):
    """A model of means by series and weekday, trained on true and on globally shuffled labels."""
    panel = written(panels.panel_a(spark, sf_dir))
    last = panel.agg(F.max("dt").alias("_last"))
    rows = panel.crossJoin(F.broadcast(last)).select("series_id", "dt", F.weekday("dt").alias("dow"), F.col("demand_latent").alias("y"), (F.datediff("_last", "dt") < HORIZON).alias("late"))
    rows = written(rows)

    def means(train, test):
        known = train.groupBy("series_id", "dow").agg(F.avg("y").alias("y_pred"))
        return test.join(known, ["series_id", "dow"]).select(F.col("y").alias("y_true"), "y_pred")

    return rounded(leakage.shuffle_test(means, rows.filter("not late").drop("late"), rows.filter("late").drop("late")))


def axis_overlap(spark, sf_dir):
    """How alike the orders of series by demand, variation and stock-outs are."""
    shapes = segments.shape_features(recovered(spark, sf_dir)).select("series_id", *(F.round(c, 4).alias(c) for c in ("cv", "zero_rate", "stockout_rate", "peak_ratio")))
    return rounded(triage.axis_overlap(shapes, ("cv", "zero_rate", "stockout_rate", "peak_ratio"), 50))


def catalogue_index(spark, sf_dir, panel):
    bands = rotation_bands(panel).select("series_id", "rotation_band")
    return panel_checks.series_index(panel).join(bands, "series_id", "left")


def catalog_page(spark, sf_dir):
    """The second page of three of the slow sellers of shop 3, with the number of all of them."""
    index = catalogue_index(spark, sf_dir, recovered(spark, sf_dir))
    return triage.catalogue_page(index, "shop 3", store_id=3, band="low", limit=3, offset=3).select("series_id", "rotation_band", "label", "total")


def alert_totals(spark, sf_dir):
    return rounded(triage.alert_totals(triage.triage(triage.series_signals(recovered(spark, sf_dir)))))


def alerts_by_band(spark, sf_dir):
    """The first alerts of large series among the fast sellers, with the number of all of them."""
    panel = recovered(spark, sf_dir)
    marked = triage.triage(triage.series_signals(panel))
    return rounded(triage.alerts(marked, catalogue_index(spark, sf_dir, panel), "high_volume", band="high", limit=5).select("series_id", "mean_demand", "reasons", "rotation_band", "total"))


def quantile_violations(spark, sf_dir):
    """The judged folds' quantiles, with a planted crossing, a missing level and an inverted interval on some rows."""
    names = ["pred_q05", "pred_q50", "pred_q62", "pred_q90", "pred_q95"]
    g = with_grid(spark, sf_dir).select("series_id", "origin", "h", *names)
    g = g.withColumn("pred_q62", F.when((F.col("h") == 2) & (F.col("origin") == 5), F.col("pred_q50") - 1).otherwise(F.col("pred_q62")))
    g = g.withColumn("pred_q05", F.when((F.col("h") == 3) & (F.col("origin") == 6), None).otherwise(F.col("pred_q05")))
    g = g.withColumns({"pred_lo": F.when(F.col("h") == 7, F.col("pred_q95") + 1).otherwise(F.col("pred_q05")), "pred_hi": F.col("pred_q95")})
    return forecast.quantile_violations(g, names, least_origins=6)


def encoder_fitted_on_train(spark, sf_dir):
    """Means that the linear models' encoding learns, and two that come from all rows."""
    train, test = linear_rows(spark, sf_dir)
    full = train.unionByName(test)
    learned = linear.encoder(train, PLAIN, ("store_id",)).centre
    whole = full.agg(F.avg("discount").alias("discount"), F.avg("h").alias("h")).first()
    honest = leakage.fitted_elsewhere({c: learned[c] for c in PLAIN}, train, full).withColumn("encoding", F.lit("train"))
    planted = leakage.fitted_elsewhere({"discount": whole["discount"]}, train, full).withColumn("encoding", F.lit("all"))
    return rounded(honest.unionByName(planted).select("encoding", "feature", "learned", "leaks"))


QUERIES = {f.__name__: f for f in (score_future, score_future_levels, train_bases, train_bases_metrics, attribution_local, attribution_top, shuffle_test, axis_overlap, catalog_page, alert_totals, alerts_by_band, quantile_violations, encoder_fitted_on_train)}

LAST = "date '1998-04-07'"


def _oracles() -> dict[str, str]:
    from stallwise.plans.model_queries import ORACLE_SQL as shapes
    from stallwise.plans.triage_queries import B_SIGNALS

    axes = ("cv", "zero_rate", "stockout_rate", "peak_ratio")
    each = " union all ".join(f"select series_id, '{a}' as axis, {a} as v from shapes" for a in axes)
    return {
        "score_future": sql.A
        + f""", st as (select series_id, dt, sale, avg(sale) over (partition by series_id order by dt rows between 6 preceding and current row) as m7 from pa),
        plan as (select greatest(least(quantile_cont(cast(discount as double), 0.5), 1), 1e-6) as discount, cast(round_even(quantile_cont(activity, 0.5), 0) as int) as activity_flag from pa where dt > {LAST} - 21)
        select s.series_id, cast(t.h as int) as h, {LAST} + cast(t.h as int) as dt, cast(isodow({LAST} + cast(t.h as int)) - 1 as int) as dow, i.third_category_id, round(p.discount, 4) as discount, p.activity_flag,
               round(cast(s.sale as double), 4) as latent_lag_0, round(s.m7, 4) as latent_roll_mean_7, true as levels_rise, true as not_negative
        from st s join (select distinct series_id, third_category_id from pa) i using (series_id) cross join plan p cross join (select unnest(range(1, 8)) as h) t where s.dt = {LAST}""",
        "catalog_page": sql.B_RECOVERED
        + """, bm as (select series_id, any_value(store_id) as store_id, any_value(third_category_id) as c, any_value(product_id) as p, avg(latent) as m from rc group by 1),
        ix as (select series_id, store_id, 'store ' || store_id || ' · category ' || c || ' · product ' || p as label, case when m <= (select quantile_cont(m, 0.5) from bm) then 'low' when m > (select quantile_cont(m, 0.85) from bm) then 'high' else 'mid' end as rotation_band from bm),
        hit as (select * from ix where store_id = 3 and rotation_band = 'low' and (contains(series_id || ' ' || label, 'shop') or contains(series_id || ' ' || label, 'store')) and contains(series_id || ' ' || label, '3'))
        select series_id, rotation_band, label, (select count(*) from hit) as total from hit order by series_id limit 3 offset 3""",
        "alert_totals": B_SIGNALS
        + """, f as (select mean_demand, (mean_demand >= (select quantile_cont(mean_demand, 0.9) from sg))::int + (estimated_share > 0.3)::int + (current_run >= 5)::int as n from sg)
        select count(*) as n_series, count(*) filter (where n > 0) as n_flagged, count(*) filter (where n > 1) as n_several, round(avg((n > 0)::int), 4) as share_flagged, round(coalesce(sum(mean_demand) filter (where n > 0) / nullif(sum(mean_demand), 0), 0), 4) as share_volume from f""",
        "alerts_by_band": B_SIGNALS
        + """, bm as (select series_id, any_value(store_id) as store_id, avg(latent) as m from rc group by 1),
        f as (select series_id, mean_demand, mean_demand >= (select quantile_cont(mean_demand, 0.9) from sg) as high_volume, estimated_share > 0.3 as scarce_signal, current_run >= 5 as out_now from sg),
        every as (select f.*, case when m <= (select quantile_cont(m, 0.5) from bm) then 'low' when m > (select quantile_cont(m, 0.85) from bm) then 'high' else 'mid' end as rotation_band from f join bm using (series_id) where high_volume),
        hit as (select * from every where rotation_band = 'high')
        select series_id, round(mean_demand, 4) as mean_demand, array_to_string(list_filter([case when high_volume then 'high_volume' end, case when scarce_signal then 'scarce_signal' end, case when out_now then 'out_now' end], lambda x: x is not null), ', ') as reasons, rotation_band, (select count(*) from hit) as total
        from hit order by high_volume::int + scarce_signal::int + out_now::int desc, hit.mean_demand desc, series_id limit 5""",
        "quantile_violations": BASE
        + GRID
        + f""", pl as (select origin, h, case when h = 3 and origin = 6 then null else {Q[0]} end as a, {Q[1]} as b, case when h = 2 and origin = 5 then {Q[1]} - 1 else {Q[2]} end as c, {Q[3]} as d, {Q[4]} as e from g)
        select unnest(['quantiles_cross', 'quantile_missing', 'too_few_origins', 'interval_inverted']) as rule, unnest([count(*) filter (where b < a - 1e-9) + count(*) filter (where c < b - 1e-9) + count(*) filter (where d < c - 1e-9) + count(*) filter (where e < d - 1e-9),
          count(*) filter (where a is null), greatest(6 - count(distinct origin), 0), count(*) filter (where h = 7 and e < e + 1 - 1e-9)]) as violations from pl""",
        "encoder_fitted_on_train": shapes["linear_ridge"][: shapes["linear_ridge"].index("mo as (")]
        + """ names as (select unnest(['h', 'latent_lag_0', 'latent_roll_mean_7', 'discount', 'dow']) as feature, unnest([1, 2, 3, 4, 5]) as j)
        select 'train' as encoding, feature, round(avg(x[j]), 4) as learned, false as leaks from tr, names group by 2 union all select 'all', 'discount', round(avg(x[4]), 4), true from ro""",
        "train_bases": sql.B_RECOVERED
        + """, days as (select max(dt) as last from rc), tested as (select rc.* from rc, days where dt > last - 7), bases as (select 'observed' as basis, series_id, sale as y from tested union all select 'recovered', series_id, latent from tested)
        select basis, count(*) as n, count(distinct series_id) as n_series, round(avg(y), 4) as mean_true, true as levels_rise, true as not_negative, true as in_order from bases group by 1""",
        "attribution_local": sql.A + "select series_id, cast(t.h as int) as h, cast(4 as bigint) as n_parts, cast(1 as bigint) as n_rest, true as adds_up from (select distinct series_id from pa) cross join (select unnest(range(1, 8)) as h) t",
        "shuffle_test": sql.A
        + f""", ro as (select series_id, dt, isodow(dt) as dow, sale as y, dt > {LAST} - 7 as late from pa), tr as (select * from ro where not late), te as (select * from ro where late),
        ks as (select series_id, dt, dow, row_number() over (order by series_id, dt) as n from tr), vs as (select y, row_number() over (order by md5(series_id || '|' || cast(dt as varchar) || '|42')) as n from tr),
        mixed as (select series_id, dow, avg(vs.y) as p from ks join vs using (n) group by 1, 2), plain as (select series_id, dow, avg(y) as p from tr group by 1, 2),
        m as (select (select avg(abs(y - p)) from te join plain using (series_id, dow)) as mae, (select avg(abs(y - p)) from te join mixed using (series_id, dow)) as mae_shuffled,
          (select least(avg(abs(y - (select avg(y) from tr))), avg(abs(y - (select quantile_cont(cast(y as double), 0.5) from tr)))) from te) as mae_constant)
        select round(mae, 4) as mae, round(mae_shuffled, 4) as mae_shuffled, round(mae_constant, 4) as mae_constant, mae_shuffled >= 1.25 * mae and mae_shuffled >= 0.95 * mae_constant as passes from m""",
        "axis_overlap": f"with shapes as ({shapes['shape_features']}), long as ({each}), "
        + """rk as (select *, rank() over (partition by axis order by v) + (count(*) over (partition by axis, v) - 1) / 2.0 as r, row_number() over (partition by axis order by v desc, series_id) as place from long where v is not null),
        pairs as (select a.axis as axis_a, b.axis as axis_b, a.r as ra, b.r as rb, a.place <= 50 and b.place <= 50 as both_first from rk a join rk b on a.series_id = b.series_id and """
        + "(" + " or ".join(f"(a.axis = '{a}' and b.axis = '{b}')" for i, a in enumerate(axes) for b in axes[i + 1 :]) + "))"
        + " select axis_a, axis_b, round(corr(ra, rb), 4) as spearman, count(*) as n_both, round(count(*) filter (where both_first) / 50.0, 4) as overlap from pairs group by 1, 2",
    }


ORACLE_SQL = _oracles()
