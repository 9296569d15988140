"""Shapes of series, groups of them, and products on a map."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.statistics import correlation

SHAPE = ("cv", "zero_rate", "weekly_amplitude", "peak_ratio", "autocorr_7", "mean_zero_run", "stockout_rate")


def shape_features(panel: DataFrame, target: str = "demand_latent", min_days: int = 21) -> DataFrame:
    """Each series' form without its level. Series with fewer days are left out; what is undefined is zero."""
    w = Window.partitionBy("series_id").orderBy("dt")
    y = F.col(target)
    rows = panel.select("series_id", "dt", y.alias("y"), F.col("is_censored").cast("int").alias("out"), F.lag(target, 7).over(w).alias("y7"), F.row_number().over(w).alias("n"))
    zero = F.col("y") <= 0
    rows = rows.withColumn("island", F.when(zero, F.col("n") - F.sum(zero.cast("int")).over(w)))
    sums = rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("days"),
        F.avg("y").alias("m"),
        F.stddev_samp("y").alias("sd"),
        F.max("y").alias("top"),
        F.avg(zero.cast("int")).alias("zero_rate"),
        F.count_if(zero).alias("zeros"),
        F.count_distinct("island").alias("runs"),
        F.avg("out").alias("stockout_rate"),
        F.when(F.count(F.lit(1)) > 8, correlation(F.col("y"), F.col("y7"))).alias("ac"),
        F.stddev_pop(F.when(F.col("y7").isNotNull(), F.col("y"))).alias("sa"),
        F.stddev_pop("y7").alias("sb"),
    )
    week = rows.groupBy("series_id", F.weekday("dt").alias("dow")).agg(F.avg("y").alias("p")).groupBy("series_id").agg(F.stddev_samp("p").alias("amp"))
    scale = F.nullif(F.col("m"), F.lit(0.0))
    flat = (F.coalesce("sa", F.lit(0.0)) < 1e-12) | (F.coalesce("sb", F.lit(0.0)) < 1e-12)
    out = sums.join(week, "series_id").filter(F.col("days") >= min_days)
    values = {
        "cv": F.col("sd") / scale,
        "zero_rate": F.col("zero_rate"),
        "weekly_amplitude": F.col("amp") / scale,
        "peak_ratio": F.col("top") / scale,
        "autocorr_7": F.when(flat, 0.0).otherwise(F.greatest(F.least(F.col("ac"), F.lit(1.0)), F.lit(-1.0))),
        "mean_zero_run": F.col("zeros") / F.nullif(F.col("runs"), F.lit(0)),
        "stockout_rate": F.col("stockout_rate"),
    }
    return out.select("series_id", *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in values.items()))


def _standardised(columns: Sequence[str]) -> list:
    return [VectorAssembler(inputCols=list(columns), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]


def fit_profiles(shapes: DataFrame, k: int = 6, seed: int = 42):
    """A model that assigns shapes to the nearest of k centres; it never refits."""
    return Pipeline(stages=[*_standardised(SHAPE), KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="cluster")]).fit(shapes.orderBy("series_id"))


def assign_profiles(model, shapes: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, cluster): series without a shape go to the most populous cluster."""
    got = model.transform(shapes).select("series_id", "cluster")
    most = got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(1).select(F.col("cluster").alias("_most"))
    return series.select("series_id").distinct().join(got, "series_id", "left").crossJoin(F.broadcast(most)).select("series_id", F.coalesce("cluster", "_most").alias("cluster"))


def choose_k(shapes: DataFrame, ks: Sequence[int] = (3, 4, 5, 6, 8, 10), seed: int = 42) -> list[tuple]:
    """(k, silhouette, smallest, largest) for each k; a fit per k."""
    out = []
    for k in ks:
        done = fit_profiles(shapes, k, seed).transform(shapes)
        score = ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(done)
        sizes = done.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.max("n")).first()
        out.append((k, score, *sizes))
    return out


def cluster_profile(panel: DataFrame, clusters: DataFrame) -> DataFrame:
    met = panel.join(clusters, "series_id")
    return met.groupBy("cluster").agg(F.count_distinct("series_id").alias("series"), F.avg("demand_latent").alias("mean_demand"), F.avg((F.col("demand_latent") <= 0).cast("int")).alias("zero_rate"), F.avg(F.col("is_censored").cast("int")).alias("stockout_rate"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: agreement of two assignments of the same series, corrected for chance."""
    cells = a.select("series_id", F.col("cluster").alias("x")).join(b.select("series_id", F.col("cluster").alias("y")), "series_id").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = cells.agg(pairs(F.col("n")).alias("same"), F.sum("n").alias("all"))
    one, two = (cells.groupBy(k).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias(k)) for k in ("x", "y"))
    row = both.crossJoin(one).crossJoin(two)
    chance = F.col("x") * F.col("y") / (F.col("all") * (F.col("all") - 1) / 2)
    return row.select(F.when((F.col("x") + F.col("y")) / 2 == chance, 1.0).otherwise((F.col("same") - chance) / ((F.col("x") + F.col("y")) / 2 - chance)).alias("adjusted_rand"))


def product_features(panel: DataFrame, target: str = "demand_latent") -> DataFrame:
    """Behaviour of each product over all its stores."""
    y = F.col(target)
    week = panel.groupBy("product_id", F.weekday("dt").alias("dow")).agg(F.avg(target).alias("p")).groupBy("product_id").agg(F.stddev_samp("p").alias("amp"))
    sums = panel.groupBy("product_id").agg(F.avg(y).alias("mean_demand"), F.stddev_samp(y).alias("sd"), F.avg((y <= 0).cast("int")).alias("zero_rate"), F.avg(F.col("is_censored").cast("int")).alias("stockout_rate"), F.max(y).alias("top"), F.count_distinct("series_id").alias("n_series"))
    scale = F.nullif(F.col("mean_demand"), F.lit(0.0))
    return sums.join(week, "product_id").select("product_id", "mean_demand", F.coalesce(F.col("sd") / scale, F.lit(0.0)).alias("cv"), "zero_rate", F.coalesce(F.col("amp") / scale, F.lit(0.0)).alias("weekly_amplitude"), "stockout_rate", F.coalesce(F.col("top") / scale, F.lit(0.0)).alias("peak_ratio"), "n_series")


PRODUCT = ("mean_demand", "cv", "zero_rate", "weekly_amplitude", "stockout_rate", "peak_ratio")


def product_map(products: DataFrame, columns: Sequence[str] = PRODUCT) -> tuple[DataFrame, list[float], np.ndarray]:
    """Products in the plane of their two main components, the share of variance of each, and the loadings."""
    model = Pipeline(stages=[*_standardised(columns), PCA(k=2, inputCol="_x", outputCol="_pc")]).fit(products)
    done = model.transform(products).withColumn("_a", vector_to_array("_pc"))
    pca = model.stages[-1]
    return done.select(*products.columns, F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y")), list(pca.explainedVariance), pca.pc.toArray()


def components_needed(variance: Sequence[float], share: float = 0.9) -> int:
    return int(np.searchsorted(np.cumsum(variance), share - 1e-12) + 1)
