"""Scoring days ahead from a state that was frozen on the last day of training.

The state is a table at rest, bucketed and sorted by series, so that each scoring joins it without moving it. Future rows
are a grid of series and steps with what is known ahead, given or taken from the recent past, and the series' hierarchy.
A join that finds no state for many of the rows is an error: a model would answer for all of them with one value.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.functions.calendar import calendar_columns
from stallwise.operators.features import HIERARCHY, KNOWN_AHEAD
from stallwise.operators.leakage import unmatched_share
from stallwise.operators.lineage import folder

#: What a state must not carry: it is known for the target day instead, or is what is asked for.
NOT_CARRIED = (*KNOWN_AHEAD, *HIERARCHY, "dt", "sale_amount", "demand_latent", "inflation", "hours_sale", "hours_stock_status", "is_censored", "available_weight", "oos_hours_day", "stock_hour6_22_cnt")


def save_state(state: DataFrame, name: str | None = None, buckets: int = 16, path: str | None = None) -> str:
    """Writes each series' state on the last day as a table and returns its name: a row a series, origin_date and the
    features, bucketed and sorted by series. Series that have no row on that day have no state."""
    name = name or f"frozen_state_{uuid.uuid4().hex}"
    last = state.agg(F.max("dt").alias("_last"))
    own = state.join(F.broadcast(last), F.col("dt") == F.col("_last")).withColumn("origin_date", F.col("dt")).drop("_last", *(c for c in NOT_CARRIED if c in state.columns))
    path = path or f"{folder(state.sparkSession)}/{name}"
    own.repartition(buckets, "series_id").write.mode("overwrite").option("path", path).option("compression", "zstd").bucketBy(buckets, "series_id").sortBy("series_id").saveAsTable(name)
    return name


def future_grid(index: DataFrame, origin: DataFrame, plan: DataFrame, horizon: int = 7) -> DataFrame:
    """(series_id, hierarchy, h, dt, what is known ahead) for the days after the one-row origin (origin_date); plan: one row
    of covariates for all days."""
    steps = index.crossJoin(F.broadcast(origin.select("origin_date"))).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.withColumn("dt", F.date_add("origin_date", F.col("h"))).drop("origin_date").crossJoin(F.broadcast(plan.select(*KNOWN_AHEAD)))


def with_hierarchy(future: DataFrame, index: DataFrame) -> DataFrame:
    """future with the hierarchy of its series; a row whose series is not in the index fails when it is read."""
    missing = F.raise_error(F.concat(F.lit("series without hierarchy: "), F.coalesce("series_id", F.lit("null")))).cast("boolean")
    met = future.join(index.select("series_id", *HIERARCHY, F.lit(True).alias("_known")), "series_id", "left")
    return met.filter(F.coalesce("_known", missing)).drop("_known")


def scoring_rows(spark: SparkSession, state: str, future: DataFrame, most_unmatched: float = 0.2) -> DataFrame:
    """Future rows (series_id, h, dt, what is known ahead) with the frozen state of table `state` and the calendar of
    their day. More than the given share without a state is an error, any a warning; their features are null."""
    frozen = spark.table(state)
    found = unmatched_share(future, frozen).first()
    share = found["share"] or 0.0
    if share > most_unmatched:
        raise ValueError(f"{share:.0%} of {found['n']} future rows have no state of their series: were model and state made from another panel?")
    if share > 0:
        warnings.warn(f"{share:.1%} of {found['n']} future rows have no state of their series", stacklevel=2)
    return future.join(frozen.drop(*(c for c in future.columns if c != "series_id")), "series_id", "left").withColumns(calendar_columns())
