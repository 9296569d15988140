"""Queries over batches and leakage checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stallwise.operators import features, ingest, leakage, metrics
from stallwise.operators.lineage import folder, written
from stallwise.plans import sql
from stallwise.plans.backtest_queries import BT, POINT, result_of
from stallwise.plans.panel_queries import rounded
from stallwise.sources import panels

COMPARED = ("sale_amount", "stock_hour6_22_cnt", "hours_sale", "hours_stock_status")


def classified(spark, sf_dir):
    """Days up to the 23rd are the panel; later days, and days from the 20th whose sales were edited on every third
    product, are the batch."""
    b = panels.panel_b(spark, sf_dir)
    current = b.filter(F.dayofmonth("dt") <= 23)
    edited = (F.dayofmonth("dt") <= 23) & (F.col("product_id") % 3 == 0)
    batch = b.filter(F.dayofmonth("dt") >= 20).withColumn("sale_amount", F.when(edited, F.col("sale_amount") + 1.0).otherwise(F.col("sale_amount")))
    return current, ingest.classify(current, batch, COMPARED)


def merge_report(spark, sf_dir):
    return ingest.report(*classified(spark, sf_dir))


def merge_batch(spark, sf_dir):
    """The panel after the batch, conflicts replaced."""
    merged = ingest.merge(*classified(spark, sf_dir), "replace")
    return rounded(merged.select("series_id", "dt", "sale_amount"))


def merge_rejected(spark, sf_dir):
    """The panel after the batch, which is rejected for its conflicts."""
    merged = ingest.merge(*classified(spark, sf_dir), "reject")
    return merged.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


def batch_hash(spark, sf_dir):
    """The hash of each day's batch, whatever the order of its rows."""
    b = panels.panel_b(spark, sf_dir).select("series_id", "dt", "sale_amount", "stock_hour6_22_cnt", "hours_stock_status")
    whole = ingest.batch_hash(b.orderBy(F.desc("sale_amount"))).withColumn("part", F.lit("all"))
    late = ingest.batch_hash(b.filter(F.dayofmonth("dt") > 23)).withColumn("part", F.lit("late"))
    return whole.unionByName(late)


def layer_of(spark, sf_dir):
    """A layer of the first 20 days and four batches: three more days, the same again, an edited day, and a dry run of the
    rest. Returns its folder."""
    layer = f"{folder(spark)}/layer-{uuid.uuid4().hex}"
    b = written(panels.panel_b(spark, sf_dir))
    day = F.dayofmonth("dt")
    ingest.start_layer(b.filter(day <= 20).withColumn("split", F.lit("train")), layer)
    raw = b.drop("series_id", "oos_hours_day", "available_weight", "is_censored")
    more = raw.filter(day.between(20, 23))
    ingest.ingest(spark, more, layer, COMPARED)
    ingest.ingest(spark, more.orderBy("product_id"), layer, COMPARED)
    ingest.ingest(spark, raw.filter(day == 22).withColumn("sale_amount", F.col("sale_amount") + 1.0), layer, COMPARED)
    ingest.ingest(spark, raw.filter(day > 23), layer, COMPARED, dry_run=True)
    return layer


def ingest_log(spark, sf_dir):
    """The log of a layer, in the order of its entries."""
    log = ingest.read_log(spark, layer_of(spark, sf_dir))
    return log.select("version", "status", "n_rows", "n_new", "n_duplicate", "n_conflict", "n_new_series", "last_day")


def freshness(spark, sf_dir):
    """The state of a layer whose models were trained until the 20th."""
    layer = layer_of(spark, sf_dir)
    # The first version holds those days: the events aren't grouped once more for one day, and only its days are read.
    trained = panels.load_layer(spark, f"{layer}/v000000").agg(F.max("dt").alias("trained_until"))
    return ingest.status(ingest.read_log(spark, layer), trained)


def supervised(spark, sf_dir):
    a = panels.panel_a(spark, sf_dir)
    return features.supervised_matrix(features.origin_state(a), a, features.origins(a, 7, 42), 7)


def leak_constant_features(spark, sf_dir):
    """Columns that vary within an origin; only calendar and other known-ahead columns may."""
    m = supervised(spark, sf_dir)
    return leakage.varying_features(m.select("series_id", "origin_date", "dt", "h", "y", "latent_lag_0", "latent_roll_mean_28", "latent_dow_mean_4", "dow", "days_since_start"))


def leak_grouped_lags(spark, sf_dir):
    a = panels.panel_a(spark, sf_dir)
    return leakage.lag_violations(a.withColumn("lagged", features.lag_features("demand_latent")["latent_lag_7"]), "lagged", "demand_latent", 7)


def leak_target_corr(spark, sf_dir):
    names = ("latent_lag_0", "latent_lag_7", "latent_roll_mean_28", "latent_dow_mean_4", "zero_share_28")
    return rounded(leakage.target_correlations(supervised(spark, sf_dir), names, every=True), 6)


def leak_global_aggregates(spark, sf_dir):
    """Columns of the panel's first half that are filled with a mean over all of it; one is planted."""
    a = panels.panel_a(spark, sf_dir)
    mean = a.agg(F.avg("demand_latent").alias("planted"))
    whole = a.crossJoin(F.broadcast(mean))
    train = whole.filter(F.col("dt") < F.lit("1998-02-15").cast("date"))
    return leakage.global_aggregates(train, whole, ("sale_amount", "discount", "planted"))


def leak_target_shift(spark, sf_dir):
    return rounded(leakage.target_shift(result_of(spark, sf_dir, ("seasonal_naive", "seasonal_moving_average"))))


def leak_future_shift(spark, sf_dir):
    return rounded(leakage.future_shift(metrics.by(result_of(spark, sf_dir), "h")))


def series_overlap(spark, sf_dir):
    """Customers' orders ahead of the panel whose store has no state in it."""
    a = panels.panel_a(spark, sf_dir)
    wanted = panels.table(spark, sf_dir, "orders").select(F.concat_ws("_", (F.col("o_custkey") % 5).cast("string"), (F.col("o_orderkey") % 12).cast("string")).alias("series_id"))
    return rounded(leakage.unmatched_share(wanted, a), 6)


QUERIES = {f.__name__: f for f in (merge_report, merge_batch, merge_rejected, batch_hash, ingest_log, freshness, leak_constant_features, leak_grouped_lags, leak_target_corr, leak_global_aggregates, leak_target_shift, leak_future_shift, series_overlap)}

BATCH = sql.of(sql.PANEL_B) + ", cu as (select * from pb where day(dt) <= 23), ba as (select *, case when day(dt) <= 23 and product_id % 3 = 0 then sale + 1 else sale end as v from pb where day(dt) >= 20), kd as (select b.*, case when c.dt is null then 'new' when abs(b.v - c.sale) <= 1e-6 + 1e-5 * abs(c.sale) then 'duplicate' else 'conflict' end as kind from ba b left join cu c using (series_id, dt))"
STATES = "st as (select series_id, dt, sale, avg(sale) over (partition by series_id order by dt rows between 27 preceding and current row) as m28, avg((sale <= 0)::int) over (partition by series_id order by dt rows between 27 preceding and current row) as z28, lag(sale, 7) over w as l7, (lag(sale, 7) over w + lag(sale, 14) over w + lag(sale, 21) over w + lag(sale, 28) over w) / 4 as d4 from pa window w as (partition by series_id order by dt)), sv as (select s.*, p.sale as y from st s cross join (select unnest(range(1, 8)) as h) t join pa p on p.series_id = s.series_id and p.dt = s.dt + cast(t.h as int) where s.dt between date '1998-01-01' + 41 and date '1998-04-07' - 7)"

ORACLE_SQL = {
    "merge_report": BATCH
    + "select count(*) as n_rows, count(*) filter (where kind = 'new') as n_new, count(*) filter (where kind = 'duplicate') as n_duplicate, count(*) filter (where kind = 'conflict') as n_conflict, min(dt) as first_day, max(dt) as last_day, count(distinct series_id) filter (where series_id not in (select series_id from cu)) as n_new_series from kd",
    "batch_hash": sql.of(sql.PANEL_B)
    + """, fl as (select series_id, dt, string_agg(cast(oos as varchar), ';' order by h) as flags from pbh group by 1, 2),
    ln as (select dt, '0x' || substr(md5(cast(dt as varchar) || '|' || flags || '|' || printf('%.6f', sale) || '|' || series_id || '|' || cast(hours_out as varchar)), 1, 15) as m from pb join fl using (series_id, dt))
    select 'all' as part, count(*) as n_rows, cast(sum(cast(cast(m as bigint) as hugeint)) as varchar) as batch_hash from ln
    union all select 'late', count(*), cast(sum(cast(cast(m as bigint) as hugeint)) as varchar) from ln where day(dt) > 23""",
    "ingest_log": sql.of(sql.PANEL_B)
    + """, n as (select count(*) filter (where day(dt) <= 20) as base, count(*) filter (where day(dt) = 20) as one, count(*) filter (where day(dt) between 21 and 23) as fresh, count(*) filter (where day(dt) > 23) as later, max(dt) filter (where day(dt) <= 20) as d20, max(dt) filter (where day(dt) <= 23) as d23, max(dt) filter (where day(dt) = 22) as d22, max(dt) as dl from pb)
    select 'v000000' as version, 'written' as status, base as n_rows, base as n_new, 0 as n_duplicate, 0 as n_conflict, 0 as n_new_series, d20 as last_day from n
    union all select 'v000001', 'written', one + fresh, fresh, one, 0, 0, d23 from n
    union all select 'v000001', 'no change', one + fresh, 0, one + fresh, 0, 0, d23 from n
    union all select 'v000001', 'rejected', one, 0, 0, one, 0, d22 from n
    union all select 'v000001', 'dry run', later, later, 0, 0, 0, dl from n""",
    "freshness": sql.of(sql.PANEL_B) + "select 'v000001' as version, max(dt) filter (where day(dt) <= 23) as last_day, cast(2 as bigint) as n_written, cast(1 as bigint) as n_rejected, cast(1 as bigint) as n_no_change, cast(1 as bigint) as n_dry_run, cast(3 as int) as days_behind from pb",
    "merge_batch": BATCH + "select series_id, dt, round(coalesce(k.v, c.sale), 4) as sale_amount from cu c full join (select series_id, dt, v from kd where kind <> 'duplicate') k using (series_id, dt)",
    "merge_rejected": BATCH + "select dt, count(*) as n from cu group by 1",
    "leak_constant_features": "select unnest(['dow', 'days_since_start']) as feature, unnest([g, g]) as groups from (select count(*) * 49 as g from (" + sql.A + "select distinct series_id from pa))",
    "leak_grouped_lags": sql.A + "select unnest(['crosses_series', 'wrong_value']) as rule, unnest([count(*) filter (where n <= 7 and l is not null), 0]) as violations from (select lag(sale, 7) over w as l, row_number() over w as n from pa window w as (partition by series_id order by dt))",
    "leak_target_corr": sql.of(sql.PANEL_A, STATES)
    + "select feature, round(abs(c), 6) as corr, abs(c) >= 0.999 as leaks from (select unnest(['latent_lag_0', 'latent_lag_7', 'latent_roll_mean_28', 'latent_dow_mean_4', 'zero_share_28']) as feature, unnest([corr(sale, y), corr(l7, y), corr(m28, y), corr(d4, y), corr(z28, y)]) as c from sv)",
    "leak_global_aggregates": sql.A
    + "select 'planted' as \"column\" from (select avg(sale) as m from pa) union all select 'sale_amount' from pa where dt < date '1998-02-15' having min(sale) = max(sale) and abs(min(sale) - (select avg(sale) from pa)) < 1e-9 union all select 'discount' from pa where dt < date '1998-02-15' having min(discount) = max(discount) and abs(min(discount) - (select avg(discount) from pa)) < 1e-9",
    "leak_target_shift": BT
    + "select model, cast(k as int) as shift, round(avg(abs(t.y_true - s.y_pred)), 4) as mae from bt s cross join (values (-1), (0), (1)) v(k) join (select model as m2, series_id as s2, origin as o2, h as h2, y_true from bt) t on t.m2 = s.model and t.s2 = s.series_id and t.o2 = s.origin and t.h2 = s.h - k where model in ('seasonal_naive', 'seasonal_moving_average') group by 1, 2",
    "leak_future_shift": BT
    + f", m as (select model, h, {POINT} from bt group by 1, 2) select model, round(avg(mae) filter (where h <= 3.5), 4) as early, round(avg(mae) filter (where h > 3.5), 4) as late, avg(mae) filter (where h > 3.5) >= 0.98 * avg(mae) filter (where h <= 3.5) as passes from m group by 1",
    "series_overlap": sql.A + "select count(*) as n, round(avg((s.series_id is null)::int), 6) as share from (select (o_custkey % 5) || '_' || (o_orderkey % 12) as series_id from orders) w left join (select distinct series_id from pa) s using (series_id)",
}
