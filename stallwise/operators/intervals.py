"""Calibrated intervals and quantile grids from residuals of earlier folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.arrays import at_level, quantile_name
from stallwise.operators.lineage import written
from stallwise.operators.quantiles import conformal_level, exact_quantiles
from stallwise.operators.quantiles import levels as places


def by_step(scores: DataFrame, score: str, alpha: float, least_rows: int = 20, keys: Sequence[str] = ("model",)) -> DataFrame:
    """(keys, h, q): the quantile of each step, or of all steps where one has too few scores. Scores are those of the
    calibration folds; no group of them is gathered."""
    place = conformal_level(alpha)
    each = written(exact_quantiles(scores, [*keys, "h"], score, place))
    if each.filter(F.col("n") < least_rows).isEmpty():
        return each.select(*keys, "h", F.col("q")[0].alias("q"))
    pooled = exact_quantiles(scores, keys, score, place).select(*keys, F.col("q").alias("pool"))
    return each.join(pooled, list(keys)).select(*keys, "h", F.when(F.col("n") < least_rows, F.col("pool")[0]).otherwise(F.col("q")[0]).alias("q"))


def attach(test: DataFrame, widths: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """The step's quantile; beyond the calibrated steps the largest one."""
    widest = widths.groupBy(*keys).agg(F.max("q").alias("_most"))
    met = test.join(F.broadcast(widths), [*keys, "h"], "left").join(F.broadcast(widest), list(keys), "left")
    return met.withColumn("q", F.coalesce("q", "_most")).drop("_most")


def residual_conformal(calibration: DataFrame, test: DataFrame, alpha: float = 0.1, dispersion: DataFrame | None = None) -> DataFrame:
    """pred_lo and pred_hi around the prediction; with dispersion (series_id, dispersion), in proportion to it."""
    score = F.abs(F.col("y_true") - F.col("y_pred"))
    if dispersion is not None:
        overall = dispersion.agg(F.avg("dispersion").alias("_d"))
        fill = lambda df: df.join(dispersion, "series_id", "left").crossJoin(F.broadcast(overall)).withColumn("dispersion", F.coalesce("dispersion", "_d")).drop("_d")
        calibration, test = fill(calibration), fill(test)
        score = score / F.col("dispersion")
    widths = by_step(calibration.withColumn("score", score), "score", alpha)
    half = F.greatest(F.col("q") * (F.col("dispersion") if dispersion is not None else F.lit(1.0)), F.lit(1e-6))
    done = attach(test, widths).withColumns({"pred_lo": F.greatest(F.col("y_pred") - half, F.lit(0.0)), "pred_hi": F.col("y_pred") + half})
    return done.drop("q", "dispersion")


def conformal_quantiles(calibration: DataFrame, test: DataFrame, low: str, high: str, alpha: float = 0.1) -> DataFrame:
    """Conformalised quantile regression: the band between two predicted quantiles, moved by the signed score's
    quantile, which may be below zero; ends that cross meet in the middle."""
    score = F.greatest(F.col(low) - F.col("y_true"), F.col("y_true") - F.col(high))
    done = attach(test, by_step(calibration.withColumn("score", score), "score", alpha))
    lo, hi = F.greatest(F.col(low) - F.col("q"), F.lit(0.0)), F.col(high) + F.col("q")
    middle = (lo + hi) / 2
    return done.withColumns({"pred_lo": F.when(lo > hi, middle).otherwise(lo), "pred_hi": F.when(lo > hi, middle).otherwise(hi)}).drop("q")


def dispersion(panel: DataFrame, target: str = "demand_latent", window: int = 28) -> DataFrame:
    """(series_id, dispersion): mean absolute daily change of the last days; where unknown the mean of the others."""
    w = Window.partitionBy("series_id").orderBy("dt")
    back = Window.partitionBy("series_id").orderBy(F.desc("dt"))
    tail = panel.select("series_id", "dt", F.col(target).alias("y"), F.row_number().over(back).alias("n")).filter(F.col("n") <= window)
    each = tail.withColumn("step", F.abs(F.col("y") - F.lag("y").over(w))).groupBy("series_id").agg(F.avg("step").alias("d"))
    overall = each.agg(F.avg("d").alias("_all"))
    return each.crossJoin(F.broadcast(overall)).select("series_id", F.greatest(F.coalesce("d", "_all"), F.lit(1e-6)).alias("dispersion"))


def residual_grid(calibration: DataFrame, test: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Adds pred_qNN: the prediction plus each level's quantile of the step's residuals, not below zero."""
    residuals = calibration.select("model", "h", (F.col("y_true") - F.col("y_pred")).alias("residual"))
    got = exact_quantiles(residuals, ["model", "h"], "residual", places(*levels)).select("model", "h", F.col("q").alias("_r"))
    met = test.join(F.broadcast(got), ["model", "h"])
    return met.withColumns({quantile_name(q): F.greatest(F.col("y_pred") + F.col("_r")[k], F.lit(0.0)) for k, q in enumerate(levels)}).drop("_r")


def wrapped_quantiles(rows: DataFrame, levels: Sequence[float], alpha: float = 0.1) -> DataFrame:
    """Adds pred_qNN of a calibrated model. A model that predicted these levels itself keeps its own; otherwise they lie
    on the line through the lower limit at alpha / 2, the prediction at one half and the upper limit, flat beyond the
    limits and not below zero."""
    missing = [q for q in levels if quantile_name(q) not in rows.columns]
    line = F.array("pred_lo", "y_pred", "pred_hi")
    anchors = (alpha / 2, 0.5, 1 - alpha / 2)
    return rows.withColumns({quantile_name(q): F.greatest(at_level(line, anchors, q), F.lit(0.0)) for q in missing}) if missing else rows
