"""Shared pieces of oracle SQL: the same panels, written independently for DuckDB."""

from __future__ import annotations

#: Panel A, dense: series_id, store_id, product_id, dt, sale (also the demand), discount, activity.
PANEL_A = """
pa_raw as (
  select cast(n_regionkey as int) as store_id, cast(p_size % 10 as int) as product_id, cast(l_shipdate as date) as dt,
         round(sum(l_quantity), 4) as sale, round(avg(1.0 - l_discount), 4) as discount,
         cast(max(case when l_returnflag = 'R' then 1 else 0 end) as int) as activity
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  where l_shipdate >= timestamp '1998-01-01' and l_shipdate < timestamp '1998-04-08'
  group by 1, 2, 3),
pa as (
  select s.store_id || '_' || s.product_id as series_id, s.store_id, s.product_id, s.product_id % 5 as third_category_id, d.dt,
         coalesce(r.sale, 0.0) as sale, coalesce(r.discount, 1.0) as discount, coalesce(r.activity, 0) as activity
  from (select distinct store_id, product_id from pa_raw) s
  cross join (select cast(unnest(generate_series(date '1998-01-01', date '1998-04-07', interval 1 day)) as date) as dt) d
  left join pa_raw r on r.store_id = s.store_id and r.product_id = s.product_id and r.dt = d.dt)"""

#: Panel B, hourly (pbh: series, dt, h, oos, v) and daily (pb), with the derived columns.
PANEL_B = """
pb_raw as (
  select cast(user_id % 10 as int) as store_id, cast(floor(user_id / 10.0) as int) as product_id, cast(ts as date) as dt, cast(hour(ts) as int) as h,
         max(case when event_type = 'error' then 1 else 0 end) as oos, round(sum(case when event_type <> 'error' then value else 0 end), 4) as v
  from events group by 1, 2, 3, 4),
pbh as (
  select s.store_id || '_' || s.product_id as series_id, s.store_id, s.product_id, s.product_id % 5 as third_category_id, d.dt, t.h,
         coalesce(r.oos, 0) as oos, case when coalesce(r.oos, 0) = 1 then 0.0 else coalesce(r.v, 0.0) end as v
  from (select distinct store_id, product_id from pb_raw) s
  cross join (select cast(unnest(generate_series(a, b, interval 1 day)) as date) as dt from (select min(dt) as a, max(dt) as b from pb_raw)) d
  cross join (select unnest(range(24)) as h) t
  left join pb_raw r on r.store_id = s.store_id and r.product_id = s.product_id and r.dt = d.dt and r.h = t.h),
pb as (
  select series_id, store_id, product_id, third_category_id, dt, round(sum(v), 4) as sale, sum(case when h between 6 and 21 then oos else 0 end) as hours_out,
         sum(oos) as oos_day, (16 - sum(case when h between 6 and 21 then oos else 0 end)) / 16.0 as weight,
         sum(case when h between 6 and 21 then oos else 0 end) > 0 as cens
  from pbh group by all)"""

#: Hourly profiles of Panel B: weight of each open hour, by product, third category and overall.
PROFILES = """
pr_levels as (
  select 'product_id' as level, product_id as key, h, oos, v from pbh where h between 6 and 21
  union all select 'third_category_id', third_category_id, h, oos, v from pbh where h between 6 and 21
  union all select 'global', null, h, oos, v from pbh where h between 6 and 21),
pr_hours as (
  select level, key, h, count(*) filter (where oos = 0) as clean, sum(v) filter (where oos = 0) / nullif(count(*) filter (where oos = 0), 0) as m
  from pr_levels group by 1, 2, 3),
pr_filled as (
  select level, key, h, coalesce(m, avg(m) over (partition by level, key)) as m, sum(clean) over (partition by level, key) as clean_hours from pr_hours),
profiles as (
  select level, key, h, clean_hours, case when sum(m) over (partition by level, key) > 0 then m / sum(m) over (partition by level, key) else 1.0 / 16 end as weight
  from pr_filled where m is not null and (level = 'global' or clean_hours >= 200))"""

#: Panel B recovered by profile: pb's columns, share, latent.
RECOVERED = """
rc_hours as (
  select b.series_id, b.dt, b.h, b.oos, b.v, coalesce(p.weight, c.weight, g.weight) as w
  from pbh b
  left join profiles p on p.level = 'product_id' and p.key = b.product_id and p.h = b.h
  left join profiles c on c.level = 'third_category_id' and c.key = b.third_category_id and c.h = b.h
  join profiles g on g.level = 'global' and g.h = b.h
  where b.h between 6 and 21),
rc_share as (select series_id, dt, sum(case when oos = 0 then w else 0 end) / sum(w) as share, sum(v) as open_sale from rc_hours group by 1, 2),
rc_latent as (
  select pb.*, case when hours_out = 0 then 1.0 else share end as share,
         open_sale * case when hours_out > 0 and share >= 0.15 and share < 1 then least(1 / share, 3.0) else 1 end + greatest(sale - open_sale, 0) as raised
  from pb join rc_share using (series_id, dt)),
rc as (select *, case when cens then greatest(raised, sale) else sale end as latent from rc_latent)"""


def of(*parts: str) -> str:
    """A with-clause of these parts."""
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


A = of(PANEL_A)
B = of(PANEL_B)
B_RECOVERED = of(PANEL_B, PROFILES, RECOVERED)
