"""Queries over features, the calendar, and the supervised matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallwise.functions import calendar
from stallwise.operators import features
from stallwise.plans import sql
from stallwise.plans.panel_queries import recovered, rounded
from stallwise.sources import panels

HORIZON, MIN_TRAIN = 7, 42


def lags(spark, sf_dir):
    a = panels.panel_a(spark, sf_dir)
    return rounded(a.select("series_id", "dt", *(c.alias(n) for n, c in features.lag_features("demand_latent").items())))


def rolling(spark, sf_dir):
    a = panels.panel_a(spark, sf_dir)
    return rounded(a.select("series_id", "dt", *(c.alias(n) for n, c in features.rolling_features("demand_latent").items())))


def seasonal_mean(spark, sf_dir):
    a = panels.panel_a(spark, sf_dir)
    return rounded(a.select("series_id", "dt", *(c.alias(n) for n, c in features.seasonal_features("demand_latent").items())))


def intermittency(spark, sf_dir):
    a = panels.panel_a(spark, sf_dir)
    steps = features.intermittency_features("demand_latent")
    return rounded(a.withColumn("_at", steps.pop("_at")).select("series_id", "dt", *(c.cast("double").alias(n) for n, c in steps.items())), 6)


def censoring_history(spark, sf_dir):
    b = panels.panel_b(spark, sf_dir)
    return rounded(b.select("series_id", "dt", *(c.alias(n) for n, c in features.censoring_history().items())), 6)


def exogenous_lags(spark, sf_dir):
    a = panels.panel_a(spark, sf_dir)
    return rounded(a.select("series_id", "dt", *(c.alias(n) for n, c in features.exogenous_lags().items())))


def calendar_features(spark, sf_dir):
    days = panels.panel_a(spark, sf_dir).select("dt").distinct()
    return rounded(days.select("dt", *(c.cast("long").alias(n) if n not in ("dow_sin", "dow_cos", "dom_sin", "dom_cos") else c.alias(n) for n, c in calendar.calendar_columns().items())), 8)


def holidays(spark, sf_dir):
    """Holidays of the years in which there were orders."""
    span = panels.table(spark, sf_dir, "orders").agg(F.year(F.min("o_orderdate")).alias("a"), F.year(F.max("o_orderdate")).alias("b")).first()
    return calendar.holidays(spark, span["a"], span["b"])


def holiday_distance(spark, sf_dir):
    orders = panels.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("dt"))
    met = calendar.with_holiday_distance(orders, holidays(spark, sf_dir))
    return met.groupBy("days_to_holiday", "is_holiday").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("dt").alias("days"))


def origins(spark, sf_dir):
    return features.origins(panels.panel_a(spark, sf_dir), HORIZON, MIN_TRAIN)


def origin_states(spark, sf_dir):
    """All features of the recovered panel at the close of each series' last day."""
    state = features.origin_state(recovered(spark, sf_dir).withColumn("discount", F.lit(1.0)).drop("hours_sale", "hours_stock_status"))
    last = state.agg(F.max("dt").alias("dt"))
    return rounded(state.join(F.broadcast(last), "dt").select("series_id", "dt", "latent_lag_0", "latent_lag_7", "latent_lag_28", "latent_roll_mean_28", "latent_roll_median_14", "latent_dow_mean_4", "censored_share_28"))


def supervised_matrix(spark, sf_dir):
    """The supervised matrix at all origins."""
    a = panels.panel_a(spark, sf_dir)
    m = features.supervised_matrix(features.origin_state(a), a, features.origins(a, HORIZON, MIN_TRAIN), HORIZON)
    return rounded(m.select("series_id", "origin_date", "h", "dt", "y", "latent_lag_0", "latent_roll_mean_28", "latent_dow_mean_4", "discount", "dow"))


QUERIES = {f.__name__: f for f in (lags, rolling, seasonal_mean, intermittency, censoring_history, exogenous_lags, calendar_features, holidays, holiday_distance, origins, origin_states, supervised_matrix)}

W = "partition by series_id order by dt"


def _rolling(n: int) -> str:
    frame = f"over ({W} rows between {n - 1} preceding and current row)"
    enough = f"count(*) {frame} >= {max(2, n // 4)}"
    parts = {"mean": "avg(sale)", "std": "stddev_samp(sale)", "max": "max(sale)", "min": "min(sale)", "median": "quantile_cont(sale, 0.5)"}
    return ", ".join(f"round(case when {enough} then {f} {frame} end, 4) as latent_roll_{name}_{n}" for name, f in parts.items())


HOLIDAYS = """
years as (select unnest(range(year(min(o_orderdate)), year(max(o_orderdate)) + 1)) as y from orders),
p1 as (select y, y % 19 as a, y // 100 as b, y % 100 as c from years),
p2 as (select *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 as h from p1),
p3 as (select *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 as l from p2),
p4 as (select *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 as s from p3),
hol as (
  select make_date(y, s // 31, s % 31 + 1) - k as holiday from p4, (values (3), (2)) t(k)
  union select make_date(y, m, d) from years, (values (1, 1), (3, 1), (5, 1), (5, 14), (5, 15), (6, 12), (8, 15), (9, 29), (12, 8), (12, 25)) t(m, d))"""

FRAME28 = f"over ({W} rows between 27 preceding and current row)"

ORACLE_SQL = {
    "lags": sql.A + f"select series_id, dt, {', '.join(f'round(cast(lag(sale, {k}) over ({W}) as double), 4) as latent_lag_{k}' for k in features.LAGS)} from pa",
    "rolling": sql.A
    + f"""select series_id, dt, {', '.join(map(_rolling, (7, 14, 28)))},
      round(case when count(*) {FRAME28} >= 7 and avg(sale) {FRAME28} > 0 then avg(sale) over ({W} rows between 6 preceding and current row) / (avg(sale) {FRAME28}) end, 4) as latent_momentum_7_28 from pa""",
    "seasonal_mean": sql.A
    + f"""select a.series_id, a.dt, round(avg(b.sale), 4) as latent_dow_mean_4, round(stddev_samp(b.sale), 4) as latent_dow_std_4
      from pa a left join pa b on a.series_id = b.series_id and a.dt - b.dt in (7, 14, 21, 28) group by 1, 2""",
    "intermittency": sql.A
    + f"""select series_id, dt, round(avg((sale <= 0)::int) {FRAME28}, 6) as zero_share_28, cast(dt - max(case when sale > 0 then dt end) over ({W}) as double) as days_since_sale from pa""",
    "censoring_history": sql.B
    + f"""select series_id, dt, round(avg(cens::int) over ({W} rows between 6 preceding and current row), 6) as censored_share_7, round(avg(cens::int) {FRAME28}, 6) as censored_share_28,
      round(case when row_number() over ({W}) >= 2 then avg(oos_day) over ({W} rows between 6 preceding and current row) end, 6) as oos_hours_roll_7 from pb""",
    "exogenous_lags": sql.A + f"select series_id, dt, round(cast(discount as double), 4) as discount_lag_0, round(cast(lag(discount, 1) over ({W}) as double), 4) as discount_lag_1, round(cast(lag(discount, 7) over ({W}) as double), 4) as discount_lag_7 from pa",
    "calendar_features": sql.A
    + """select distinct dt, isodow(dt) - 1 as dow, round(sin(2 * pi() * (isodow(dt) - 1) / 7), 8) as dow_sin, round(cos(2 * pi() * (isodow(dt) - 1) / 7), 8) as dow_cos, day(dt) as day_of_month,
      round(sin(2 * pi() * day(dt) / 31), 8) as dom_sin, round(cos(2 * pi() * day(dt) / 31), 8) as dom_cos, weekofyear(dt) as week_of_year, month(dt) as month, cast(isodow(dt) >= 6 as bigint) as is_weekend,
      cast(day(dt) = 1 as bigint) as is_month_start, cast(dt = last_day(dt) as bigint) as is_month_end, cast(dt - date '2020-01-01' as bigint) as days_since_start from pa""",
    "holidays": sql.of(HOLIDAYS) + "select distinct cast(holiday as date) as holiday from hol",
    "holiday_distance": sql.of(HOLIDAYS)
    + """, od as (select cast(o_orderdate as date) as dt, count(*) as n from orders group by 1),
    near as (select dt, n, arg_min(dt - holiday, abs(dt - holiday) * 100000 + (holiday - date '1900-01-01')) as gap from od cross join (select distinct cast(holiday as date) as holiday from hol) group by 1, 2)
    select cast(greatest(least(gap, 7), -7) as int) as days_to_holiday, cast(gap = 0 as int) as is_holiday, cast(sum(n) as bigint) as orders, count(*) as days from near group by 1, 2""",
    "origins": sql.A + "select distinct dt as origin_date from pa where dt >= date '1998-01-01' + 41 and dt <= date '1998-04-07' - 7",
    "origin_states": sql.B_RECOVERED
    + f"""select * from (select series_id, dt, round(latent, 4) as latent_lag_0, round(lag(latent, 7) over w, 4) as latent_lag_7, round(lag(latent, 28) over w, 4) as latent_lag_28,
      round(avg(latent) {FRAME28}, 4) as latent_roll_mean_28, round(quantile_cont(latent, 0.5) over ({W} rows between 13 preceding and current row), 4) as latent_roll_median_14,
      round((lag(latent, 7) over w + lag(latent, 14) over w + lag(latent, 21) over w + lag(latent, 28) over w) / 4, 4) as latent_dow_mean_4, round(avg(cens::int) {FRAME28}, 4) as censored_share_28
      from rc window w as ({W})) where dt = (select max(dt) from rc)""",
    "supervised_matrix": sql.A
    + f""", st as (select series_id, dt, sale, avg(sale) {FRAME28} as m28, (lag(sale, 7) over w + lag(sale, 14) over w + lag(sale, 21) over w + lag(sale, 28) over w) / 4 as d4 from pa window w as ({W}))
    select s.series_id, s.dt as origin_date, cast(t.h as int) as h, p.dt, round(cast(p.sale as double), 4) as y, round(cast(s.sale as double), 4) as latent_lag_0, round(s.m28, 4) as latent_roll_mean_28,
           round(cast(s.d4 as double), 4) as latent_dow_mean_4, round(cast(p.discount as double), 4) as discount, cast(isodow(p.dt) - 1 as int) as dow
    from st s cross join (select unnest(range(1, 8)) as h) t join pa p on p.series_id = s.series_id and p.dt = s.dt + cast(t.h as int)
    where s.dt between date '1998-01-01' + 41 and date '1998-04-07' - 7""",
}
