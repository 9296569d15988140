"""Queries over segments, anomalies and global models."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions.arrays import quantile_name
from stallwise.operators import boosting, density, features, linear, models, segments, window_forest
from stallwise.operators.lineage import written
from stallwise.operators.metrics import rotation_bands
from stallwise.operators.models import CATEGORICAL, NUMERIC
from stallwise.plans import sql
from stallwise.plans.panel_queries import recovered, rounded
from stallwise.sources import panels


def shape_features(spark, sf_dir):
    return rounded(segments.shape_features(recovered(spark, sf_dir)))


def product_features(spark, sf_dir):
    return rounded(segments.product_features(recovered(spark, sf_dir)))


def product_bands(spark, sf_dir):
    """Rotation bands of products by their mean demand."""
    p = recovered(spark, sf_dir).select(F.col("product_id").cast("string").alias("series_id"), "demand_latent")
    return rounded(rotation_bands(p).select(F.col("series_id").cast("int").alias("product_id"), "mean_demand", "rotation_band"))


def kmeans_profiles(spark, sf_dir):
    p = recovered(spark, sf_dir)
    shapes = segments.shape_features(p).persist()
    return segments.assign_profiles(segments.fit_profiles(shapes, 4), shapes, p)


def cluster_profile(spark, sf_dir):
    """Profiles of series grouped by their busiest weekday, a grouping that SQL can repeat."""
    p = recovered(spark, sf_dir)
    week = p.groupBy("series_id", F.weekday("dt").alias("dow")).agg(F.round(F.sum("demand_latent"), 4).alias("v"))
    best = week.groupBy("series_id").agg(F.min_by("dow", F.struct(-F.col("v"), F.col("dow"))).alias("cluster"))
    return rounded(segments.cluster_profile(p, best))


def cluster_stability(spark, sf_dir):
    """Agreement of the groups found in the first three weeks and in the whole panel."""
    p = recovered(spark, sf_dir)
    early, late = segments.shape_features(p.filter(F.dayofmonth("dt") <= 23)).persist(), segments.shape_features(p).persist()
    return segments.adjusted_rand(segments.assign_profiles(segments.fit_profiles(early, 4), early, p), segments.assign_profiles(segments.fit_profiles(late, 4), late, p))


def dbscan_profiles(spark, sf_dir):
    """Density clusters over all seven shape features, wide enough to find some in 30 days."""
    return density.density_clusters(written(segments.shape_features(recovered(spark, sf_dir))), eps=1.2, min_samples=5)


def demand_windows(spark, sf_dir):
    """What the detector sees of each window: its first and last day, its sum and its highest day, in levels of the series."""
    v = F.col("window")
    sums = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return rounded(window_forest.demand_windows(recovered(spark, sf_dir)).select("series_id", "dt", v[0].alias("first"), v[13].alias("last"), sums.alias("total"), F.array_max(v).alias("most")))


def judged_windows(spark, sf_dir):
    """A detector of the days up to the 23rd, and what it says of all windows, in levels of those days."""
    p = recovered(spark, sf_dir)
    early = p.filter(F.dayofmonth("dt") <= 23)
    detector = window_forest.fit(window_forest.demand_windows(early))
    return window_forest.judge(detector, window_forest.demand_windows(p, known=window_forest.series_levels(early)))


def window_anomalies(spark, sf_dir):
    return judged_windows(spark, sf_dir).select("series_id", "dt", "anomalous", "score")


def window_contrast(spark, sf_dir):
    """How many windows and stock-outs there are; what the forest marks is left to the tests."""
    return rounded(window_forest.contrast_with_censoring(judged_windows(spark, sf_dir)).select("windows", "panel_rate", (F.col("marked") > 0).alias("marks_some"), (F.col("new_findings") <= F.col("marked")).alias("findings_are_marked")))


def product_map(spark, sf_dir):
    return segments.product_map(segments.product_features(recovered(spark, sf_dir)).persist())[0].select("product_id", "x", "y")


def split(spark, sf_dir, n_train: int = 6):
    """Supervised rows of the last origins: all but the last origin train, that one is predicted."""
    a = panels.panel_a(spark, sf_dir)
    picked = features.origins(a, 7, 42).orderBy(F.desc("origin_date")).limit(n_train * 7 + 1).filter(F.pmod(F.datediff(F.lit("1998-03-31").cast("date"), "origin_date"), F.lit(7)) == 0)
    m = features.supervised_matrix(features.origin_state(a), a, picked, 7).persist()
    last = F.lit("1998-03-31").cast("date")
    return m.filter(F.col("dt") <= last), m.filter(F.col("origin_date") == last)


def gbt_point(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return models.fit_boosted(train, rounds=8, depth=4).predict(test).select("series_id", "h", "y", "y_pred")


def gbt_quantile(spark, sf_dir):
    """Five levels, boosted side by side."""
    train, test = split(spark, sf_dir)
    heads = [boosting.Head("y", q) for q in (0.1, 0.25, 0.5, 0.625, 0.9)]
    said = boosting.fit(train, heads, NUMERIC, CATEGORICAL, boosting.Params(rounds=8)).predict(test)
    return said.select("series_id", "h", "y", *(quantile_name(h.level) for h in heads))


#: Few enough for the oracle to eliminate in SQL.
PLAIN = ("h", "latent_lag_0", "latent_roll_mean_7", "discount", "dow")


def linear_rows(spark, sf_dir):
    """Supervised rows of twenty origins, two days apart, whose days end before the last origin; and those of that one."""
    a = written(panels.panel_a(spark, sf_dir))
    last = a.agg(F.date_sub(F.max("dt"), 7).alias("_o"))
    early = a.crossJoin(F.broadcast(last)).filter("dt <= _o").drop("_o")
    state = features.origin_state(a)
    picked = features.training_origins(early, 7).unionByName(last.toDF("origin_date"))
    m = written(features.supervised_matrix(state, a, picked, 7).join(F.broadcast(last), F.lit(True)))
    return m.filter("origin_date < _o").drop("_o"), m.filter("origin_date = _o").drop("_o")


def linear_ridge(spark, sf_dir):
    """Ridge on five numbers and the store."""
    train, test = linear_rows(spark, sf_dir)
    return rounded(linear.fit_linear(train, "ridge", numeric=PLAIN, categorical=("store_id",)).predict(test).select("series_id", "h", "y", "y_pred"))


def linear_lasso(spark, sf_dir):
    train, test = linear_rows(spark, sf_dir)
    return linear.fit_linear(train, "lasso").predict(test).select("series_id", "h", "y", "y_pred")


def linear_elasticnet(spark, sf_dir):
    train, test = linear_rows(spark, sf_dir)
    return linear.fit_linear(train, "elasticnet").predict(test).select("series_id", "h", "y", "y_pred")


def linear_quantile(spark, sf_dir):
    train, test = split(spark, sf_dir)
    return models.fit_linear_quantile(train, 0.9, rounds=4).predict(test).select("series_id", "h", "y", "y_pred")


def attribution(spark, sf_dir):
    """Mean absolute and signed contribution of each feature to the median trees' predictions."""
    train, test = split(spark, sf_dir)
    head = boosting.Head("y", 0.5)
    trees = boosting.fit(train, [head], NUMERIC, CATEGORICAL, boosting.Params(rounds=5))
    return models.global_attribution(boosting.contributions(trees, test, ("series_id", "h"), head))


QUERIES = {f.__name__: f for f in (shape_features, product_features, product_bands, kmeans_profiles, cluster_profile, cluster_stability, dbscan_profiles, demand_windows, window_anomalies, window_contrast, product_map, gbt_point, gbt_quantile, linear_ridge, linear_lasso, linear_elasticnet, linear_quantile, attribution)}

ORACLE_SQL = {
    "shape_features": sql.B_RECOVERED
    + """, sx as (select series_id, dt, latent as y, cens, lag(latent, 7) over w as y7, row_number() over w as n from rc window w as (partition by series_id order by dt)),
    si as (select *, case when y <= 0 then n - sum((y <= 0)::int) over (partition by series_id order by dt) end as island from sx),
    sw as (select series_id, stddev_samp(p) as amp from (select series_id, isodow(dt) as d, avg(y) as p from sx group by 1, 2) group by 1),
    ss as (select series_id, avg(y) as m, stddev_samp(y) as sd, max(y) as top, avg((y <= 0)::int) as zero_rate, count(*) filter (where y <= 0) / nullif(count(distinct island), 0) as zr, avg(cens::int) as stockout_rate,
      case when stddev_pop(y) filter (where y7 is not null) > 1e-12 and stddev_pop(y7) > 1e-12 then corr(y, y7) else 0 end as ac from si group by 1)
    select series_id, round(coalesce(sd / nullif(m, 0), 0), 4) as cv, round(zero_rate, 4) as zero_rate, round(coalesce(amp / nullif(m, 0), 0), 4) as weekly_amplitude, round(coalesce(top / nullif(m, 0), 0), 4) as peak_ratio,
      round(greatest(least(ac, 1), -1), 4) as autocorr_7, round(coalesce(zr, 0), 4) as mean_zero_run, round(stockout_rate, 4) as stockout_rate from ss join sw using (series_id)""",
    "product_features": sql.B_RECOVERED
    + """, pw as (select product_id, stddev_samp(p) as amp from (select product_id, isodow(dt) as d, avg(latent) as p from rc group by 1, 2) group by 1),
    pf as (select product_id, avg(latent) as m, stddev_samp(latent) as sd, avg((latent <= 0)::int) as z, avg(cens::int) as o, max(latent) as top, count(distinct series_id) as n_series from rc group by 1)
    select product_id, round(m, 4) as mean_demand, round(sd / m, 4) as cv, round(z, 4) as zero_rate, round(amp / m, 4) as weekly_amplitude, round(o, 4) as stockout_rate, round(top / m, 4) as peak_ratio, n_series from pf join pw using (product_id)""",
    "product_bands": sql.B_RECOVERED
    + """, pm as (select product_id, avg(latent) as m from rc group by 1)
    select product_id, round(m, 4) as mean_demand, case when m <= (select quantile_cont(m, 0.5) from pm) then 'low' when m > (select quantile_cont(m, 0.85) from pm) then 'high' else 'mid' end as rotation_band from pm""",
    "cluster_profile": sql.B_RECOVERED
    + """, wk as (select series_id, cast(isodow(dt) - 1 as int) as dow, round(sum(latent), 4) as v from rc group by 1, 2),
    cl as (select series_id, dow as cluster from wk qualify row_number() over (partition by series_id order by v desc, dow) = 1)
    select cluster, count(distinct series_id) as series, round(avg(latent), 4) as mean_demand, round(avg((latent <= 0)::int), 4) as zero_rate, round(avg(cens::int), 4) as stockout_rate from rc join cl using (series_id) group by 1""",
}

# The shapes with more places than are shown.
_BEFORE, _SHOWN = ORACLE_SQL["shape_features"].rsplit("select series_id, round(", 1)
ORACLE_SQL["dbscan_profiles"] = (
    f"with recursive shapes as ({_BEFORE}select series_id, round({_SHOWN.replace(', 4)', ', 12)')}), st as (select "
    + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in segments.SHAPE)
    + " from shapes), pt as (select series_id, ["
    + ", ".join(f"coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0)" for c in segments.SHAPE)
    + """] as p from shapes, st), nb as (select a.series_id as a, b.series_id as b from pt a join pt b on list_distance(a.p, b.p) <= 1.2),
    co as (select a from nb group by 1 having count(*) >= 5), ln as (select nb.a, nb.b from nb join co x on x.a = nb.a join co y on y.a = nb.b),
    reach(a, b) as (select a, b from ln union select r.a, l.b from reach r join ln l on l.a = r.b), lb as (select a, min(b) as label from reach group by 1),
    bo as (select nb.a, min(label) as label from nb join lb on lb.a = nb.b group by 1)
    select pt.series_id, coalesce(lb.label, bo.label, '-1') as cluster from pt left join lb on lb.a = pt.series_id left join bo on bo.a = pt.series_id"""
)

#: Ridge by the normal equations: products of the standardised columns, and their elimination pivot by pivot.
ORACLE_SQL["linear_ridge"] = (
    sql.A.replace("with ", "with recursive ", 1)
    + """, st as (select series_id, store_id, dt, sale, avg(sale) over (partition by series_id order by dt rows between 6 preceding and current row) as m7 from pa),
    od as (select date '1998-03-24' - 2 * cast(k as int) as o from (select unnest(range(20)) as k) union all select date '1998-03-31'),
    ro as (select s.series_id, s.dt as o, cast(t.h as int) as h, p.sale::double as y, [t.h::double, s.sale::double, s.m7, p.discount::double, isodow(p.dt) - 1.0] as x, s.store_id
           from st s join od on od.o = s.dt cross join (select unnest(range(1, 8)) as h) t join pa p on p.series_id = s.series_id and p.dt = s.dt + cast(t.h as int)),
    tr as (select * from ro where o <= date '1998-03-24'),
    mo as (select j, avg(x[j]) as m, stddev_pop(x[j]) as s from tr, (select unnest(range(1, 6)) as j) group by 1),
    kinds as (select store_id, 5 + row_number() over (order by store_id) as j from (select distinct store_id from tr)),
    co as (select series_id, o, h, y, j, (x[j] - m) / s as v from ro, mo union all select series_id, o, h, y, k.j, (ro.store_id = k.store_id)::int::double from ro, kinds k),
    ce as (select j, avg(v) as c from co where o <= date '1998-03-24' group by 1),
    z as (select series_id, o, h, y - (select avg(y) from tr) as y, j, v - c as v from co join ce using (j) where o <= date '1998-03-24'),
    gr as (select a.j as i, b.j as j, sum(a.v * b.v) + (a.j = b.j)::int as v from z a join z b on a.series_id = b.series_id and a.o = b.o and a.h = b.h group by 1, 2
           union all select j, 1000, sum(v * y) from z group by 1),
    sz as (select cast(max(i) as int) as p from gr),
    m0 as (select list(r order by i) as m from (select i, list(v order by j) as r from gr group by i)),
    el(k, m) as (select 0, m from m0 union all
      select k + 1, list_transform(range(1, p + 1), lambda i: case when i = k + 1 then list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1])
        else list_transform(range(1, p + 2), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end) from el, sz where k < p),
    w as (select unnest(range(1, p + 1)) as j, unnest(list_transform(m, lambda r: r[p + 1])) as w from el, sz where k = p)
    select series_id, h, round(any_value(y), 4) as y, round(greatest((select avg(y) from tr) + sum(w.w * (v - c)), 0), 4) as y_pred from co join ce using (j) join w using (j) where o = date '1998-03-31' group by 1, 2"""
)
ORACLE_SQL["demand_windows"] = (
    sql.B_RECOVERED
    + """, lv as (select series_id, dt, case when avg(latent) over (partition by series_id) > 0 then latent / avg(latent) over (partition by series_id) else latent end as v from rc),
    ww as (select series_id, dt, first_value(v) over w as first, v as last, sum(v) over w as total, max(v) over w as most, count(*) over w as n from lv window w as (partition by series_id order by dt rows between 13 preceding and current row))
    select series_id, dt, round(first, 4) as first, round(last, 4) as last, round(total, 4) as total, round(most, 4) as most from ww where n = 14"""
)
ORACLE_SQL["window_contrast"] = (
    sql.B_RECOVERED
    + """, ww as (select cens, row_number() over (partition by series_id order by dt) as n from rc)
    select count(*) as windows, round(avg(cens::int), 4) as panel_rate, true as marks_some, true as findings_are_marked from ww where n >= 14"""
)
