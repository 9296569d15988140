"""What a panel must hold, and what it looks like: validation, gaps, densification, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PANEL_TYPES = {"series_id": "string", "dt": "date", "store_id": "int", "product_id": "int", "third_category_id": "int", "sale_amount": "double", "demand_latent": "double", "stock_hour6_22_cnt": "int", "oos_hours_day": "int", "available_weight": "double", "is_censored": "boolean", "discount": "double", "activity_flag": "int", "holiday_flag": "int", "inflation_factor": "double"}
#: Columns that are no features, and those that a future index must not hold.
NOT_FEATURES = {"series_id", "dt", "origin_date", "split", "y", "y_observed", "sale_amount", "demand_latent", "inflation_factor"}
FORBIDDEN_AHEAD = {"sale_amount", "demand_latent", "stock_hour6_22_cnt", "oos_hours_day", "available_weight", "is_censored", "inflation_factor"}


def cast_panel(df: DataFrame) -> DataFrame:
    """Casts the panel columns that are there; adds none."""
    return df.select(*(F.col(c).cast(PANEL_TYPES[c]).alias(c) if c in PANEL_TYPES else F.col(c) for c in df.columns))


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not denied and don't end in _target."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_FEATURES and not f.name.endswith("_target")]


def check_future_index(df: DataFrame) -> DataFrame:
    """The index itself, unless it holds what is not known ahead."""
    bad = sorted(FORBIDDEN_AHEAD & set(df.columns))
    if bad:
        raise ValueError(f"a future index must not hold: {', '.join(bad)}")
    return df


def normalize_future_index(df: DataFrame) -> DataFrame:
    """The key columns that are there, in the panel's types, however the index was made; what does not parse is null."""
    types = {"series_id": "string", "dt": "date", "h": "int"}
    own = dict(df.dtypes)
    day = lambda c: F.to_date(F.substring(c, 1, 10)) if own[c] == "string" else F.col(c).cast("date")
    return df.select(*((day(c) if t == "date" else F.col(c).try_cast(t)).alias(c) if (t := types.get(c)) else F.col(c) for c in df.columns))


def panel_violations(df: DataFrame) -> DataFrame:
    """(rule, violations): how many rows, keys or series break each rule. One pass for rows, one for keys."""
    rows = df.agg(
        (F.count(F.lit(1)) == 0).cast("long").alias("empty"),
        F.count_if(F.col("series_id").isNull() | F.col("dt").isNull()).alias("null_key"),
        F.count_if(F.col("sale_amount").isNull() | F.isnan("sale_amount")).alias("null_sale"),
        F.count_if(F.col("sale_amount") < 0).alias("negative_sale"),
        F.count_if(F.col("is_censored") != (F.col("stock_hour6_22_cnt") > 0)).alias("flag_without_hours"),
        F.count_if(~F.col("available_weight").between(0.0, 1.0 + 1e-6)).alias("weight_out_of_range"),
        *([F.count_if(F.col("demand_latent") < F.col("sale_amount") - 1e-6).alias("latent_below_sale")] if "demand_latent" in df.columns else []),
    )
    days = df.groupBy("series_id", "dt").agg(F.count(F.lit(1)).alias("n"))
    keys = days.groupBy("series_id").agg(F.sum((F.col("n") > 1).cast("int")).alias("twice"), (F.datediff(F.max("dt"), F.min("dt")) + 1 != F.count(F.lit(1))).cast("int").alias("gap"))
    by_key = keys.agg(F.coalesce(F.sum("twice"), F.lit(0)).cast("long").alias("duplicate_key"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("series_with_gaps"))
    wide = rows.crossJoin(by_key)
    return wide.unpivot([], wide.columns, "rule", "violations")


def series_with_gaps(df: DataFrame) -> DataFrame:
    span = df.groupBy("series_id").agg(F.min("dt").alias("first"), F.max("dt").alias("last"), F.count_distinct("dt").alias("days"))
    return span.withColumn("missing_days", (F.datediff("last", "first") + 1 - F.col("days")).cast("long")).filter("missing_days > 0").select("series_id", "days", "missing_days")


def densify(df: DataFrame, target: str = "sale_amount", context: tuple[str, ...] = ("discount",), static: tuple[str, ...] = ("store_id", "product_id")) -> DataFrame:
    """Each series on every day from its first to its last: no sale on days without a row, context carried forward
    and then back, static columns copied."""
    grid = df.groupBy("series_id", *static).agg(F.explode(F.sequence(F.min("dt"), F.max("dt"))).alias("dt"))
    met = grid.join(df.select("series_id", "dt", target, *context), ["series_id", "dt"], "left")
    past = Window.partitionBy("series_id").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("series_id").orderBy("dt").rowsBetween(0, Window.unboundedFollowing)
    return met.select("series_id", *static, "dt", F.coalesce(target, F.lit(0.0)).alias(target), *(F.coalesce(F.last(c, True).over(past), F.first(c, True).over(ahead)).alias(c) for c in context))


def describe_censoring(df: DataFrame) -> DataFrame:
    out, zero = F.col("is_censored"), F.col("sale_amount") <= 0
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("series_id").alias("n_series"),
        F.count_distinct("dt").alias("n_days"),
        F.count_distinct("store_id").alias("n_stores"),
        F.count_distinct("product_id").alias("n_products"),
        F.min("dt").alias("first_day"),
        F.max("dt").alias("last_day"),
        F.round(F.avg(out.cast("int")), 6).alias("censored_share"),
        F.round(F.avg(zero.cast("int")), 6).alias("zero_share"),
        F.round(F.avg((out & zero).cast("int")), 6).alias("censored_zero_share"),
        F.round(F.avg(F.when(out, F.col("stock_hour6_22_cnt"))), 6).alias("mean_hours_when_out"),
        F.round(F.count(F.lit(1)) / (F.count_distinct("series_id") * F.count_distinct("dt")), 6).alias("density"),
    )


def series_index(df: DataFrame, columns: tuple[str, ...] = ("store_id", "product_id", "third_category_id")) -> DataFrame:
    """One row per series with its hierarchy, as of its first day."""
    return df.groupBy("series_id").agg(*(F.min_by(c, "dt").alias(c) for c in columns))
