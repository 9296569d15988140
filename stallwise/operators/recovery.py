"""Demand hidden by stock-outs: hourly profiles, recovery, and what recovery adds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.sources.panels import OPEN_FROM, OPEN_SLOTS, OPEN_TO


@dataclass(frozen=True)
class Censoring:
    max_inflation: float = 3.0
    min_available_weight: float = 0.15
    ewma_span: int = 14
    min_hours_for_profile: int = 200
    levels: tuple[str, ...] = ("product_id", "third_category_id")


def hourly_profiles(panel: DataFrame, cfg: Censoring = Censoring()) -> DataFrame:
    """(level, key, h, weight, clean_hours): the share of a day's demand in each open hour, from hours in stock.

    All levels come out of one pass with grouping sets. An hour that no clean row has takes the mean of the others;
    a level that sold nothing is flat; a level with too few clean hours is left out, but never the global one."""
    open_hours = range(OPEN_FROM, OPEN_TO + 1)
    clean = lambda h: F.get("hours_stock_status", F.lit(h)) == 0
    # A row for each finest key and hour, instead of sixteen for each day of a series, is what the grouping sets repeat.
    slots = [c for h in open_hours for c in (F.sum(F.when(clean(h), F.get("hours_sale", F.lit(h)))).alias(f"s{h}"), F.sum(clean(h).cast("int")).alias(f"c{h}"))]
    longest = F.max(F.greatest(F.size("hours_sale"), F.size("hours_stock_status"))).alias("longest")
    keys = panel.filter(F.col("hours_sale").isNotNull() & F.col("hours_stock_status").isNotNull()).groupBy(*cfg.levels).agg(longest, *slots)
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"s{h}").alias("sale"), F.col(f"c{h}").alias("clean")) for h in open_hours))).alias("x")
    hours = keys.select(*cfg.levels, "longest", each).filter(F.col("x.h") < F.col("longest")).select(*cfg.levels, "x.*")
    sets = [[F.col(c), F.col("h")] for c in cfg.levels] + [[F.col("h")]]
    sums = hours.groupingSets(sets, *cfg.levels, "h").agg(F.coalesce(F.sum("sale"), F.lit(0.0)).alias("sale"), F.sum("clean").alias("clean"), F.grouping_id(*cfg.levels, "h").alias("gid"))
    n = len(cfg.levels)
    # In the grouping id a bit is 0 for a column that is grouped by; h, the last one, always is.
    level, key = F.lit("global"), F.lit(None).cast("int")
    for k, c in enumerate(cfg.levels):
        own = F.col("gid") == sum(1 << (n - j) for j in range(n) if j != k)
        level, key = F.when(own, c).otherwise(level), F.when(own, F.col(c)).otherwise(key)
    rows = sums.select(level.alias("level"), key.alias("key"), "h", "clean", F.when(F.col("clean") > 0, F.col("sale") / F.col("clean")).alias("mean"))
    whole = Window.partitionBy("level", "key")
    rows = rows.withColumn("mean", F.coalesce("mean", F.avg("mean").over(whole))).withColumns({"total": F.sum("mean").over(whole), "clean_hours": F.sum("clean").over(whole)})
    rows = rows.filter((F.col("level") == "global") | (F.col("clean_hours") >= cfg.min_hours_for_profile))
    return rows.filter(F.col("mean").isNotNull()).select("level", "key", "h", F.when(F.col("total") > 0, F.col("mean") / F.col("total")).otherwise(1.0 / OPEN_SLOTS).alias("weight"), "clean_hours")


def finalised(latent: Column) -> dict[str, Column]:
    """Latent demand is at least the sale, and the sale itself on clean days; inflation is null from nothing sold."""
    done = F.when(F.col("is_censored"), F.greatest(latent, F.col("sale_amount"))).otherwise(F.col("sale_amount"))
    ratio = F.when(F.col("sale_amount") > 0, done / F.col("sale_amount")).when(done > 0, F.lit(None)).otherwise(1.0)
    return {"demand_latent": done, "inflation_factor": ratio}


def recover_by_profile(panel: DataFrame, cfg: Censoring = Censoring()) -> DataFrame:
    """Adds profile_share (of the day's demand that could be sold), demand_latent and inflation_factor.

    Profiles are one row per key of the hierarchy: Spark broadcasts them as long as they are below its threshold,
    and otherwise joins by key."""
    profiles = hourly_profiles(panel, cfg).groupBy("level", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "weight"))), lambda x: x["weight"]).alias("weights"))
    out = panel
    for c in cfg.levels:
        out = out.join(profiles.filter(F.col("level") == c).select(F.col("key").alias(c), F.col("weights").alias(f"_w_{c}")), c, "left")
    out = out.crossJoin(F.broadcast(profiles.filter("level = 'global'").select(F.col("weights").alias("_w_global"))))
    weights = F.coalesce(*(F.col(f"_w_{c}") for c in cfg.levels), F.col("_w_global"))
    flags, sales = (F.slice(c, OPEN_FROM + 1, OPEN_SLOTS) for c in ("hours_stock_status", "hours_sale"))
    add = lambda a, x: a + x
    available = F.aggregate(F.zip_with(weights, flags, lambda w, o: F.when(o == 0, w).otherwise(0.0)), F.lit(0.0), add)
    out = out.withColumns({"_open": F.aggregate(sales, F.lit(0.0), add), "profile_share": F.least(F.greatest(F.coalesce(available / F.nullif(F.aggregate(weights, F.lit(0.0), add), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))})
    # A day without a stock-out has all of its profile, whatever the rounding of the sum.
    share = F.when(F.col("stock_hour6_22_cnt") == 0, 1.0).otherwise(F.col("profile_share"))
    factor = F.when((share >= cfg.min_available_weight) & (share < 1.0), F.least(1.0 / share, F.lit(cfg.max_inflation))).otherwise(1.0)
    latent = F.col("_open") * factor + F.greatest(F.col("sale_amount") - F.col("_open"), F.lit(0.0))
    return out.withColumns({"profile_share": share, **finalised(latent)}).drop("_open", "_w_global", *(f"_w_{c}" for c in cfg.levels))


def recover_by_level(panel: DataFrame, cfg: Censoring = Censoring()) -> DataFrame:
    """Recovery by the expected level of clean days, not by the hours that were out.

    The level is an exponentially weighted mean of clean sales up to the day before, the last clean sale standing in
    on censored days. A series' days are folded once, in order; a series is bounded by the calendar."""
    alpha = 2.0 / (cfg.ewma_span + 1)
    days = F.sort_array(F.collect_list(F.struct("dt", F.when(~F.col("is_censored"), F.col("sale_amount")).alias("clean"))))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("num"), F.lit(0.0).alias("den"), F.array().cast("array<double>").alias("levels"))

    def step(a: Column, x: Column) -> Column:
        # Yesterday's carried value enters the mean today; a leading run without one does not.
        num = F.when(a["last"].isNotNull(), a["num"] * (1 - alpha) + a["last"]).otherwise(a["num"])
        den = F.when(a["last"].isNotNull(), a["den"] * (1 - alpha) + 1.0).otherwise(a["den"])
        level = F.when(den > 0, num / den)
        return F.struct(F.coalesce(x["clean"], a["last"]).alias("last"), num.alias("num"), den.alias("den"), F.concat(a["levels"], F.array(level)).alias("levels"))

    folded = panel.groupBy("series_id").agg(F.avg(F.when(~F.col("is_censored"), F.col("sale_amount"))).alias("_series_mean"), days.alias("d"))
    folded = folded.withColumn("levels", F.aggregate("d", start, step, lambda a: a["levels"]))
    levels = folded.select("series_id", "_series_mean", F.explode(F.arrays_zip(F.transform("d", lambda x: x["dt"]).alias("dt"), F.col("levels").alias("level"))).alias("x")).select("series_id", "_series_mean", F.col("x.dt").alias("dt"), F.col("x.level").alias("_level"))
    overall = panel.agg(F.avg(F.when(~F.col("is_censored"), F.col("sale_amount"))).alias("_all"))
    out = panel.join(levels, ["series_id", "dt"]).crossJoin(F.broadcast(overall))
    level = F.coalesce("_level", "_series_mean", "_all")
    sale = F.col("sale_amount")
    raised = F.greatest(sale, level)
    capped = F.when(sale > 0, F.least(raised, sale * cfg.max_inflation)).otherwise(raised)
    latent = F.when(F.col("is_censored") & (F.col("available_weight") >= cfg.min_available_weight), capped).otherwise(sale)
    return out.withColumns({"expected_level": level, **finalised(latent)}).drop("_level", "_series_mean", "_all")


def censoring_report(panel: DataFrame) -> DataFrame:
    """Observed and latent means and the uplift in percent, over all, clean and censored days."""
    sums = panel.groupingSets([[F.col("is_censored")], []], "is_censored").agg(F.count(F.lit(1)).alias("n"), F.avg("sale_amount").alias("observed"), F.avg("demand_latent").alias("latent"), F.grouping("is_censored").alias("whole"))
    days = F.when(F.col("whole") == 1, "all").when(F.col("is_censored"), "censored").otherwise("clean")
    return sums.select(days.alias("days"), "n", F.round("observed", 4).alias("mean_observed"), F.round("latent", 4).alias("mean_latent"), F.round(F.when(F.col("observed") > 0, 100 * (F.col("latent") / F.col("observed") - 1)), 4).alias("uplift_pct"))


def recensored_bias(observed: Column, predicted: Column, weight: Column) -> Column:
    """Relative bias of predictions that are censored again by the day's available share; null from nothing sold."""
    return F.when(F.avg(observed) > 0, (F.avg(predicted * F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0))) - F.avg(observed)) / F.avg(observed))


def clean_day_bias(observed: Column, predicted: Column, censored: Column) -> Column:
    y, p = F.avg(F.when(~censored, observed)), F.avg(F.when(~censored, predicted))
    return F.when(y > 0, (p - y) / y)


def hourly_stockout_profile(panel: DataFrame) -> DataFrame:
    """Per hour of 24: share of days out of stock, share of sales, and whether the hour is a commercial one."""
    hours = panel.select(F.posexplode(F.arrays_zip("hours_sale", "hours_stock_status")).alias("h", "x"))
    sums = hours.groupBy("h").agg(F.avg(F.col("x.hours_stock_status").cast("double")).alias("out"), F.sum("x.hours_sale").alias("sale"))
    return sums.select("h", F.round("out", 6).alias("stockout_share"), F.round(F.col("sale") / F.nullif(F.sum("sale").over(Window.partitionBy()), F.lit(0.0)), 6).alias("sales_share"), F.col("h").between(OPEN_FROM, OPEN_TO).alias("is_open"))


def open_window_check(panel: DataFrame, slots: tuple[int, ...] = (16, 17)) -> DataFrame:
    """Share of commercial hours out of stock that each number of slots would imply."""
    one = panel.agg(F.avg(F.col("is_censored").cast("int")).alias("days"), F.avg(F.when(F.col("is_censored"), F.col("stock_hour6_22_cnt"))).alias("hours"))
    return one.select("days", "hours", F.explode(F.array(*map(F.lit, slots))).alias("slots")).select("slots", F.round(F.col("days") * F.col("hours") / F.col("slots"), 6).alias("implied_share"))


def stockout_runs(panel: DataFrame) -> DataFrame:
    """(series_id, run_start, run_end, days): unbroken runs of censored days, by gaps and islands."""
    w = Window.partitionBy("series_id").orderBy("dt")
    marked = panel.select("series_id", "dt", F.col("is_censored").alias("out")).withColumn("island", F.date_sub("dt", F.sum(F.col("out").cast("int")).over(w).cast("int")))
    return marked.filter("out").groupBy("series_id", "island").agg(F.min("dt").alias("run_start"), F.max("dt").alias("run_end"), F.count(F.lit(1)).alias("days")).drop("island")
