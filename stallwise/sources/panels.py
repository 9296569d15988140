"""Panels read from tables: adapters, subsets, batches, and layers at rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwise.functions.statistics import half_up
from stallwise.operators.panel_checks import panel_violations

#: Fixed values of the domain: commercial slots of the day, and the longest run of days that Panel A covers.
OPEN_FROM, OPEN_TO = 6, 21
OPEN_SLOTS = OPEN_TO - OPEN_FROM + 1
PANEL_A_FIRST, PANEL_A_LAST = "1998-01-01", "1998-04-07"

RAW_SCHEMA = T.StructType(
    [
        *(T.StructField(c, T.IntegerType()) for c in ("city_id", "store_id", "management_group_id", "first_category_id", "second_category_id", "third_category_id", "product_id")),
        T.StructField("dt", T.DateType()),
        T.StructField("sale_amount", T.DoubleType()),
        T.StructField("hours_sale", T.ArrayType(T.DoubleType())),
        T.StructField("stock_hour6_22_cnt", T.IntegerType()),
        T.StructField("hours_stock_status", T.ArrayType(T.IntegerType())),
        T.StructField("discount", T.DoubleType()),
        *(T.StructField(c, T.IntegerType()) for c in ("holiday_flag", "activity_flag")),
        *(T.StructField(c, T.DoubleType()) for c in ("precpt", "avg_temperature", "avg_humidity", "avg_wind_level")),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_id():
    return F.concat_ws("_", F.col("store_id").cast("string"), F.col("product_id").cast("string"))


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A before densification: one row per (store, product, day) with sales, from the star schema."""
    place_in_table = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", F.col("l_shipdate").cast("date").alias("dt"), *place_in_table)
    line = line.filter(F.col("dt").between(F.lit(PANEL_A_FIRST).cast("date"), F.lit(PANEL_A_LAST).cast("date")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 10).cast("int").alias("product_id"))
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").cast("int").alias("store_id"))
    )
    # Sums of doubles depend on the order of their rows: it is the table's, whatever way the joins are run.
    keys = ["store_id", "product_id", "dt"]
    joined = line.join(part, "l_partkey").join(place, "l_suppkey").repartition(*keys).sortWithinPartitions(*keys, "_file", "_row")
    return joined.groupBy(*keys).agg(
        F.round(F.sum("l_quantity"), 4).alias("sale_amount"),
        half_up(F.avg(1.0 - F.col("l_discount")), 4).alias("discount"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("int").alias("activity_flag"),
    )


def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense daily panel of 97 days; missing days sold nothing. Demand is the sale, nothing is censored."""
    sales = daily_sales(spark, sf_dir)
    days = F.explode(F.sequence(F.lit(PANEL_A_FIRST).cast("date"), F.lit(PANEL_A_LAST).cast("date"))).alias("dt")
    grid = sales.select("store_id", "product_id").distinct().select("*", days)
    dense = grid.join(sales, ["store_id", "product_id", "dt"], "left")
    return dense.select(
        series_id().alias("series_id"),
        "store_id",
        "product_id",
        (F.col("product_id") % 5).cast("int").alias("third_category_id"),
        "dt",
        F.coalesce("sale_amount", F.lit(0.0)).alias("sale_amount"),
        F.coalesce("sale_amount", F.lit(0.0)).alias("demand_latent"),
        F.coalesce("discount", F.lit(1.0)).alias("discount"),
        F.coalesce("activity_flag", F.lit(0)).alias("activity_flag"),
        F.lit(False).alias("is_censored"),
        F.lit(1.0).alias("available_weight"),
        F.lit(0).alias("oos_hours_day"),
    )


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (store, product, day): 24 hourly sales and 24 stock-out flags, days without events included.

    The 48 slots are conditional aggregates of a single grouping, so no list is collected."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("int").alias("store_id"),
        F.floor(F.col("user_id") / 10.0).cast("int").alias("product_id"),
        F.col("ts").cast("date").alias("dt"),
        F.hour("ts").alias("h"),
        (F.col("event_type") == "error").alias("out"),
        "value",
    )
    slots = []
    for h in range(24):
        here = F.col("h") == h
        slots.append(F.coalesce(F.max(F.when(here & F.col("out"), 1).otherwise(0)), F.lit(0)).alias(f"o{h}"))
        slots.append(F.round(F.coalesce(F.sum(F.when(here & ~F.col("out"), F.col("value"))), F.lit(0.0)), 4).alias(f"v{h}"))
    # The slots become arrays before the join: 48 columns with a default each make code too long to be compiled.
    sale = [F.when(F.col(f"o{h}") == 1, 0.0).otherwise(F.col(f"v{h}")) for h in range(24)]
    seen = events.groupBy("store_id", "product_id", "dt").agg(*slots).select("store_id", "product_id", "dt", F.array(*sale).alias("sold"), F.array(*(F.col(f"o{h}") for h in range(24))).alias("out"))
    span = events.agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    grid = events.select("store_id", "product_id").distinct().crossJoin(F.broadcast(span)).select("store_id", "product_id", F.explode(F.sequence("first", "last")).alias("dt"))
    dense = grid.join(seen, ["store_id", "product_id", "dt"], "left")
    none = lambda zero: F.array_repeat(F.lit(zero), 24)
    dense = dense.select("store_id", "product_id", "dt", F.coalesce("sold", none(0.0)).alias("hours_sale"), F.coalesce("out", none(0)).alias("hours_stock_status"))
    return dense.select(
        "store_id",
        "product_id",
        (F.col("product_id") % 5).cast("int").alias("third_category_id"),
        "dt",
        "hours_sale",
        "hours_stock_status",
        F.round(F.aggregate("hours_sale", F.lit(0.0), lambda a, x: a + x), 4).alias("sale_amount"),
        F.aggregate(F.slice("hours_stock_status", OPEN_FROM + 1, OPEN_SLOTS), F.lit(0), lambda a, x: a + x).cast("int").alias("stock_hour6_22_cnt"),
    )


def build_panel(raw: DataFrame, keep_hourly: bool = True) -> DataFrame:
    """Adds the series key and what the hourly flags imply; a row whose flags contradict its declared hours fails."""
    open_hours = F.aggregate(F.slice("hours_stock_status", OPEN_FROM + 1, OPEN_SLOTS), F.lit(0), lambda a, x: a + x.cast("int"))
    agreed = F.assert_true((F.size("hours_stock_status") == 24) & (F.size("hours_sale") == 24) & (open_hours == F.col("stock_hour6_22_cnt")), F.lit("hourly flags contradict the declared stock-out hours"))
    out = raw.withColumn("oos_hours_day", F.aggregate("hours_stock_status", F.lit(0), lambda a, x: a + x.cast("int")))
    out = out.withColumns(
        {
            "series_id": series_id(),
            "available_weight": F.coalesce(agreed.cast("double"), (OPEN_SLOTS - F.col("stock_hour6_22_cnt")) / float(OPEN_SLOTS)),
            "is_censored": F.col("stock_hour6_22_cnt") > 0,
        }
    )
    return out if keep_hourly else out.drop("hours_sale", "hours_stock_status")


def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly panel of 30 days, with the derived columns."""
    return build_panel(hourly_events(spark, sf_dir))


# Subsets (S1-S6, S13)


def series_inventory(panel: DataFrame) -> DataFrame:
    return panel.select("store_id", "product_id").distinct()


def choose_whole_stores(inventory: DataFrame, n_series: int, seed: int = 42, cities: Sequence[int] | None = None) -> DataFrame:
    """Stores in hash order, as long as the stores before hold fewer than n_series; all their series. With cities, only
    stores there (the inventory then holds city_id)."""
    if cities is not None:
        inventory = inventory.filter(F.col("city_id").isin(list(cities)))
    at = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("store_id").cast("string")))
    sizes = inventory.filter("store_id is not null").groupBy("store_id").agg(F.count(F.lit(1)).alias("n")).withColumn("_at", at)
    # A store holds a series at least, so the first n_series stores are enough: the window sees no more rows than that.
    first = sizes.orderBy("_at", "store_id").limit(n_series)
    before = F.coalesce(F.sum("n").over(Window.orderBy("_at", "store_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = first.withColumn("_before", before).filter(F.col("_before") < n_series).select("store_id")
    return inventory.join(F.broadcast(chosen), "store_id", "left_semi")


def read_subset(raw: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen (store, product) pairs."""
    return raw.join(chosen.select("store_id", "product_id").distinct(), ["store_id", "product_id"], "left_semi")


def series_sample(panel: DataFrame, n_series: int, low: float = 0.05, high: float = 0.80, seed: int = 42) -> DataFrame:
    """Rows of n series whose share of censored days lies between low and high; of any series, if those are too few."""
    rate = panel.groupBy("series_id").agg(F.avg(F.col("is_censored").cast("int")).alias("rate"))
    fits = F.col("rate").between(low, high)
    picked = rate.orderBy(fits.desc(), F.xxhash64("series_id", F.lit(seed)), "series_id").limit(n_series)
    enough = rate.filter(fits).limit(n_series).count() >= n_series
    if not enough:
        picked = rate.orderBy(F.xxhash64("series_id", F.lit(seed)), "series_id").limit(n_series)
    return panel.join(picked, "series_id", "left_semi")


def first_series(panel: DataFrame, n_series: int) -> DataFrame:
    """Rows of the n series whose ids sort first."""
    return panel.join(panel.select("series_id").distinct().orderBy("series_id").limit(n_series), "series_id", "left_semi")


# Layers and batches (S7-S10, S12)


def save_layer(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_layer(spark: SparkSession, path: str, hourly: bool = True, validate: bool = False) -> DataFrame:
    """A layer at rest; with validate, one that breaks a rule of panels (days may be missing) is refused."""
    df = spark.read.parquet(path)
    if validate:
        refuse_invalid(df)
    return df if hourly else df.drop("hours_sale", "hours_stock_status")


def refuse_invalid(panel: DataFrame, allowed: Sequence[str] = ("series_with_gaps",)) -> None:
    """Raises ValueError with the broken rules and how often each is."""
    broken = [r for r in panel_violations(panel).filter("violations > 0").collect() if r["rule"] not in allowed]
    if broken:
        raise ValueError("the panel is invalid: " + ", ".join(f"{r['rule']} {r['violations']}" for r in broken))


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_batch(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """A raw batch and its rejected rows. CSV holds the hourly arrays as JSON text; rows that don't parse are rejected."""
    if fmt == "parquet":
        rows = spark.read.parquet(path)
        missing = [f.name for f in RAW_SCHEMA if f.name not in rows.columns]
        if missing:
            raise ValueError(f"batch lacks columns: {', '.join(missing)}")
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA)), rows.limit(0)
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in RAW_SCHEMA])
    rows = spark.read.schema(text).option("header", True).csv(path)
    parsed = rows.withColumns({"sales": F.from_json("hours_sale", "array<double>"), "flags": F.from_json("hours_stock_status", "array<int>")})
    good = (F.size("sales") == 24) & (F.size("flags") == 24) & F.col("dt").isNotNull()
    done = parsed.filter(good).withColumns({"hours_sale": F.col("sales"), "hours_stock_status": F.col("flags")})
    return done.select(*(f.name for f in RAW_SCHEMA)), parsed.filter(F.coalesce(~good, F.lit(True))).drop("sales", "flags")


def export_batch(raw: DataFrame, current: DataFrame, days: int) -> DataFrame:
    """Rows of the panel's series in the last so many days of raw."""
    last = raw.agg(F.max("dt").alias("last"))
    recent = raw.crossJoin(F.broadcast(last)).filter(F.col("dt") > F.date_sub("last", days)).drop("last")
    return read_subset(recent, current)
