"""From quantiles to orders: newsvendor costs, policies and their comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.arrays import at_level, quantile_name, uncrossed


@dataclass(frozen=True)
class Economics:
    shortage: float = 1.0
    waste: float = 0.6

    @property
    def level(self) -> float:
        if self.shortage <= 0 or self.waste <= 0:
            raise ValueError("costs must be positive")
        return self.shortage / (self.shortage + self.waste)


LEVELS = (0.05, 0.5, 0.625, 0.9, 0.95)


def cost(demand: Column, order: Column, economics: Economics = Economics()) -> Column:
    return economics.shortage * F.greatest(demand - order, F.lit(0.0)) + economics.waste * F.greatest(order - demand, F.lit(0.0))


def grid(levels: Sequence[float]) -> Column:
    return uncrossed([quantile_name(q) for q in levels])


def best_order(levels: Sequence[float], economics: Economics = Economics()) -> Column:
    """The quantile at the economics' critical level, interpolated where it is not one of the predicted ones."""
    return at_level(grid(levels), levels, economics.level)


def expected(levels: Sequence[float], order: Column, economics: Economics = Economics()) -> dict[str, Column]:
    """Expected demand, shortage, waste and cost of an order under the predicted quantiles: their inverse distribution
    is linear between levels and flat beyond them, so the shortage is a lower bound and tail_mass is not described."""
    values = grid(levels)
    ys = F.concat(F.slice(values, 1, 1), values, F.slice(values, len(levels), 1))
    us = [0.0, *levels, 1.0]
    steps = F.array(*(F.lit(b - a) for a, b in zip(us, us[1:])))
    n = len(levels) + 1
    pieces = F.arrays_zip(F.slice(ys, 1, n).alias("a"), F.slice(ys, 2, n).alias("b"), steps.alias("du"))
    demand = F.aggregate(pieces, F.lit(0.0), lambda s, p: s + (p["a"] + p["b"]) / 2 * p["du"])

    def over(p: Column) -> Column:
        a, b = p["a"] - order, p["b"] - order
        top = F.greatest(a, b)
        return F.when((a >= 0) & (b >= 0), (a + b) / 2 * p["du"]).when((a <= 0) & (b <= 0), 0.0).otherwise(top / F.abs(b - a) * p["du"] * top / 2)

    short = F.aggregate(pieces, F.lit(0.0), lambda s, p: s + over(p))
    left = F.greatest(short - demand + order, F.lit(0.0))
    return {"expected_demand": demand, "expected_shortage": short, "expected_waste": left, "expected_cost": economics.shortage * short + economics.waste * left, "tail_mass": F.lit(1.0 - levels[-1])}


def outcomes(orders: DataFrame, keys: Sequence[str] = ("policy",), economics: Economics = Economics()) -> DataFrame:
    """What came of orders (policy, y_true, qty): costs, service and spoilage per policy."""
    short, left = F.greatest(F.col("y_true") - F.col("qty"), F.lit(0.0)), F.greatest(F.col("qty") - F.col("y_true"), F.lit(0.0))
    c = cost(F.col("y_true"), F.col("qty"), economics)
    return orders.groupBy(*keys).agg(
        F.sum(c).alias("total_cost"),
        F.avg(c).alias("mean_cost"),
        F.avg(short).alias("mean_shortage"),
        F.avg(left).alias("mean_waste"),
        F.when(F.sum("y_true") > 0, 1 - F.sum(short) / F.sum("y_true")).alias("fill_rate"),
        F.avg((short <= 1e-9).cast("int")).alias("service_level"),
        F.coalesce(F.sum(left) / F.nullif(F.sum("qty"), F.lit(0.0)), F.lit(0.0)).alias("spoilage_rate"),
        F.avg("qty").alias("mean_order"),
        F.count(F.lit(1)).alias("n"),
    )


def compared(table: DataFrame, reference: str, keys: Sequence[str] = ()) -> DataFrame:
    ref = table.filter(F.col("policy") == reference).select(*keys, F.col("total_cost").alias("_ref"))
    met = table.join(F.broadcast(ref), list(keys)) if keys else table.crossJoin(F.broadcast(ref))
    return met.withColumn("saving_pct", -100 * (F.col("total_cost") / F.col("_ref") - 1)).drop("_ref")


def four_policies(result: DataFrame, current: str, model: str, levels: Sequence[float] = LEVELS, economics: Economics = Economics(), keys: Sequence[str] = ()) -> DataFrame:
    """(policy, y_true, qty): the current point forecast, the model's quantile, the best fixed quantity of each series,
    and perfect foresight. The orders of a row are columns until the last step."""
    w = Window.partitionBy("series_id")
    own = result.filter(F.col("model") == model).select("series_id", "y_true", *keys, best_order(levels, economics).alias("model"), F.percentile("y_true", F.lit(economics.level)).over(w).alias("static"), F.col("y_true").alias("perfect"))
    long = own.unpivot(["series_id", "y_true", *keys], ["model", "static", "perfect"], "policy", "qty")
    now = result.filter(F.col("model") == current).select("series_id", "y_true", *keys, F.lit("current").alias("policy"), F.col("y_pred").alias("qty"))
    return long.unionByName(now)


def relative_roi(table: DataFrame) -> DataFrame:
    """One row of indicators of the model against the current policy."""
    cols = ("saving_pct", "fill_rate", "service_level", "spoilage_rate")
    one = table.groupBy(F.lit(1).alias("_")).pivot("policy", ["current", "model", "static"]).agg(*(F.first(c).alias(c) for c in cols))
    return one.select(
        F.col("model_saving_pct").alias("cost_saving_pct"),
        F.col("current_fill_rate").alias("fill_rate_current"),
        F.col("model_fill_rate").alias("fill_rate_model"),
        (100 * (F.col("model_fill_rate") - F.col("current_fill_rate"))).alias("fill_rate_gain_pp"),
        F.col("current_service_level").alias("service_level_current"),
        F.col("model_service_level").alias("service_level_model"),
        F.col("current_spoilage_rate").alias("spoilage_current"),
        F.col("model_spoilage_rate").alias("spoilage_model"),
        (100 * (F.col("current_spoilage_rate") - F.col("model_spoilage_rate"))).alias("spoilage_reduction_pp"),
        (F.col("model_saving_pct") / 100).alias("captured_fraction"),
        (F.col("model_saving_pct") - F.col("static_saving_pct")).alias("gain_over_static_pp"),
    )


def roi_scenarios(relative: DataFrame, annual_revenue: float, gross_margin: float, base_spoilage_rate: float, capture: Sequence[float] = (0.3, 0.5, 0.7, 1.0)) -> DataFrame:
    """Savings in money under declared assumptions, one row per captured fraction."""
    if any(not 0 < c <= 1 for c in capture):
        raise ValueError("captured fractions lie above 0 and up to 1")
    c = F.col("capture_fraction")
    rows = relative.select("*", F.explode(F.array(*map(F.lit, capture))).alias("capture_fraction"))
    spoilage, lost = F.lit(annual_revenue) * F.col("spoilage_reduction_pp") / 100 * c, F.lit(annual_revenue) * F.col("fill_rate_gain_pp") / 100 * gross_margin * c
    return rows.select("capture_fraction", F.lit(base_spoilage_rate).alias("base_spoilage_rate"), spoilage.alias("saving_from_spoilage"), lost.alias("saving_from_lost_sales"), (spoilage + lost).alias("total_saving"), (100 * (spoilage + lost) / annual_revenue).alias("pct_of_revenue"), F.when(c <= 0.3, "pessimistic").when(c <= 0.5, "base").when(c < 1, "optimistic").otherwise("ceiling").alias("scenario"))


def economics_sweep(result: DataFrame, current: str, model: str, ratios: Sequence[float] = (0.3, 0.6, 1.0, 1.5), levels: Sequence[float] = LEVELS) -> DataFrame:
    """The model's order under each ratio of waste to shortage cost, against the current policy, in one job."""
    own = result.filter(F.col("model") == model)
    per = F.array(*(F.struct(F.lit(r).alias("ratio"), best_order(levels, Economics(1.0, r)).alias("qty")) for r in ratios))
    long = own.select("y_true", F.explode(per).alias("x")).select("y_true", F.col("x.ratio").alias("ratio"), F.col("x.qty").alias("qty"), F.lit("model").alias("policy"))
    now = result.filter(F.col("model") == current).select("y_true", F.explode(F.array(*map(F.lit, ratios))).alias("ratio"), F.col("y_pred").alias("qty"), F.lit("current").alias("policy"))
    c = F.greatest(F.col("y_true") - F.col("qty"), F.lit(0.0)) + F.col("ratio") * F.greatest(F.col("qty") - F.col("y_true"), F.lit(0.0))
    both = long.unionByName(now).groupBy("ratio").agg(F.sum(F.when(F.col("policy") == "model", c)).alias("model_cost"), F.sum(F.when(F.col("policy") == "current", c)).alias("current_cost"))
    return both.select("ratio", (1 / (1 + F.col("ratio"))).alias("level"), "model_cost", "current_cost", (100 * (1 - F.col("model_cost") / F.col("current_cost"))).alias("saving_pct"))


def current_policy(panel: DataFrame, target: str = "demand_latent", window: int = 21) -> DataFrame:
    """(series_id, policy_qty): the mean of the panel's last calendar days, not below zero."""
    last = panel.agg(F.max("dt").alias("last"))
    recent = panel.crossJoin(F.broadcast(last)).filter(F.col("dt") > F.date_sub("last", window))
    return recent.groupBy("series_id").agg(F.greatest(F.avg(target), F.lit(0.0)).alias("policy_qty"))


def default_plan(panel: DataFrame, window: int = 21) -> DataFrame:
    """One row of covariates for days ahead: medians of the last days, discount within (0, 1], flags whole."""
    last = panel.agg(F.max("dt").alias("last"))
    recent = panel.crossJoin(F.broadcast(last)).filter(F.col("dt") > F.date_sub("last", window))
    return recent.agg(F.greatest(F.least(F.percentile("discount", F.lit(0.5)), F.lit(1.0)), F.lit(1e-6)).alias("discount"), F.bround(F.percentile("activity_flag", F.lit(0.5))).cast("int").alias("activity_flag"))


def reorder_lines(grid_rows: DataFrame, policy: DataFrame, levels: Sequence[float] = LEVELS, economics: Economics = Economics()) -> DataFrame:
    """Per (series, step): suggested and policy quantity, and what is expected of each under one distribution."""
    rows = grid_rows.join(policy, "series_id").withColumn("qty", best_order(levels, economics))
    for name, qty in (("model", "qty"), ("policy", "policy_qty")):
        got = expected(levels, F.col(qty), economics)
        rows = rows.withColumns({"expected_demand": got["expected_demand"], f"shortage_{name}": got["expected_shortage"], f"waste_{name}": got["expected_waste"], f"cost_{name}": got["expected_cost"]})
    return rows.withColumns({"saving": F.col("cost_policy") - F.col("cost_model"), "delta_pct": F.when(F.col("policy_qty") > 0, 100 * (F.col("qty") / F.col("policy_qty") - 1))})


def catalogue(lines: DataFrame, sort: str = "saving", descending: bool = True, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the first day's lines; nulls last, ties (to six places) by series."""
    if sort not in ("saving", "delta_pct", "qty", "policy_qty", "series_id"):
        raise ValueError(f"can't sort by {sort}")
    key = F.col(sort) if sort == "series_id" else F.round(sort, 6)
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return lines.filter("h = 1").orderBy(order, "series_id").offset(offset).limit(limit)


def catalogue_totals(lines: DataFrame, big_change_pct: float = 20.0) -> DataFrame:
    return lines.agg(F.sum("qty").alias("qty"), F.sum("policy_qty").alias("policy_qty"), F.sum("cost_model").alias("cost_model"), F.sum("cost_policy").alias("cost_policy"), F.sum("saving").alias("saving"), F.count_if(F.abs("delta_pct") > big_change_pct).alias("n_big_change"), F.count(F.lit(1)).alias("n_lines"))
