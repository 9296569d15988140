"""Paired experiments over the backtest: what recovery does to accuracy, and which setting to adopt."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.functions.arrays import mean, quantile_name
from stallwise.operators import boosting, features, forecast
from stallwise.operators.intervals import conformal_quantiles, dispersion, residual_conformal
from stallwise.operators.lineage import written
from stallwise.operators.recovery import clean_day_bias, recensored_bias


def censoring_ablation(panel: DataFrame, folds: DataFrame, model: str = "moving_average") -> DataFrame:
    """(basis, n_clean, mase_clean, recensored_bias, clean_day_bias): one model on observed and on recovered demand,
    judged on what was sold on clean days and on one scale, that of the observed branch."""
    both = {b: forecast.backtest(panel, folds, (model,), target=t) for b, t in (("observed", "sale_amount"), ("recovered", "demand_latent"))}
    scale = both["observed"].select("origin", "series_id", F.col("naive_scale").alias("_scale")).distinct()
    rows = None
    for basis, result in both.items():
        part = result.withColumn("basis", F.lit(basis))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.join(scale, ["origin", "series_id"])
    error = F.abs(F.col("y_observed") - F.col("y_pred")) / F.col("_scale")
    return rows.groupBy("basis").agg(
        F.count_if(~F.col("is_censored")).alias("n_clean"),
        F.avg(F.when(~F.col("is_censored"), error)).alias("mase_clean"),
        recensored_bias(F.col("y_observed"), F.col("y_pred"), F.col("available_weight")).alias("recensored_bias"),
        clean_day_bias(F.col("y_observed"), F.col("y_pred"), F.col("is_censored")).alias("clean_day_bias"),
    )


def adopted(mean: Column, current_mean: Column, current_std: Column) -> Column:
    """A setting is adopted only if its mean gains more than the current one's spread between origins."""
    return F.coalesce(current_mean - mean > current_std, F.lit(False))


def window_sweep(panel: DataFrame, folds: DataFrame, windows: Sequence[int] = (7, 14, 21, 28), current: int = 21, horizon: int = 7) -> DataFrame:
    """(window, mean, std, objective, adopted): moving averages of several lengths over the same folds, in one job. The
    best by its objective (mean MASE plus half its spread) may be adopted."""
    trials = [Trial("moving_average", float(w), w == current) for w in windows]
    return tune(panel, folds, trials, horizon).select(F.col("value").cast("int").alias("window"), "mean", "std", "objective", "adopted")


@dataclass(frozen=True)
class Trial:
    """One setting of one model: the days of a moving average, the weeks of a seasonal one, or Croston's smoothing."""

    model: str
    value: float
    current: bool = False


#: What the library uses, and the bounds that a search draws from (whole numbers but for Croston's).
CURRENT = {"moving_average": 21.0, "seasonal_moving_average": 4.0, "croston": 0.1}
SPACE = {"moving_average": (2, 28), "seasonal_moving_average": (1, 4), "croston": (0.02, 0.5)}


def random_trials(n: int, models: Sequence[str] = tuple(CURRENT), seed: int = 42) -> list[Trial]:
    """The current settings first, then up to n others for each model, drawn without repeats; the same for a seed."""
    out = [Trial(m, CURRENT[m], True) for m in models]
    for m in models:
        rng, (low, high), seen = random.Random(f"{seed}:{m}"), SPACE[m], {CURRENT[m]}
        for _ in range(20 * n):
            value = round(rng.uniform(low, high), 2) if m == "croston" else float(rng.randint(int(low), int(high)))
            if len(seen) <= n and value not in seen:
                seen.add(value)
                out.append(Trial(m, value))
    return out


def tune(panel: DataFrame, folds: DataFrame, trials: Sequence[Trial], horizon: int = 7, target: str = "demand_latent", weight: float = 0.5) -> DataFrame:
    """(model, value, is_current, mean, std, objective, best, adopted): every trial over the same folds. The state of a
    series and the truth are made once; trials are repeated within a row, and only sums by trial and origin move. The
    loss is MASE for all; std is its spread between origins, objective mean + weight * std. A model's best trial has the
    least objective (ties: the current one, then the least value) and is adopted if its mean gains more than the
    current one's spread. Models without a current trial adopt nothing."""
    state = forecast.states(panel, folds, target).select("origin", "origin_date", "series_id", "naive_scale", "tail")
    smooth = sorted({t.value for t in trials if t.model == "croston"})
    for k, alpha in enumerate(smooth):
        state = state.join(forecast.croston_levels(panel, folds, target, alpha).withColumnRenamed("y_pred", f"_c{k}"), ["origin", "series_id"], "left")
    steps = state.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("dt", F.date_add("origin_date", F.col("h")))
    met = steps.join(panel.select("series_id", "dt", F.col(target).alias("y")), ["series_id", "dt"])
    n, at = F.size("tail"), F.pmod(F.col("h") - 1, F.lit(forecast.SEASON))

    def said(t: Trial) -> Column:
        if t.model == "moving_average":
            w = int(t.value)
            return mean(F.slice("tail", F.greatest(n - w + 1, F.lit(1)), w))
        if t.model == "seasonal_moving_average":
            lagged = F.array(*(F.when(n >= forecast.SEASON * c - at, F.get("tail", n - forecast.SEASON * c + at)) for c in range(1, int(t.value) + 1)))
            return F.coalesce(mean(lagged), mean(F.col("tail")))
        if t.model == "croston":
            return F.coalesce(F.col(f"_c{smooth.index(t.value)}"), F.lit(0.0))
        raise ValueError(f"no settings to search for {t.model}")

    each = [F.struct(F.lit(t.model).alias("model"), F.lit(float(t.value)).alias("value"), F.lit(t.current).alias("is_current"), F.greatest(said(t), F.lit(0.0)).alias("p")) for t in trials]
    errors = met.select("origin", "naive_scale", "y", F.explode(F.array(*each)).alias("t")).groupBy("t.model", "t.value", "t.is_current", "origin").agg(F.avg(F.abs(F.col("y") - F.col("t.p")) / F.col("naive_scale")).alias("mase"))
    sums = errors.groupBy("model", "value", "is_current").agg(F.avg("mase").alias("mean"), F.coalesce(F.stddev_samp("mase"), F.lit(0.0)).alias("std")).withColumn("objective", F.col("mean") + weight * F.col("std"))
    # A row per trial: their number is that of the arguments.
    own = Window.partitionBy("model")
    now = lambda c: F.max(F.when(F.col("is_current"), F.col(c))).over(own)
    first = F.row_number().over(own.orderBy("objective", F.desc("is_current"), "value")) == 1
    judged = sums.withColumns({"best": first, "_mean": now("mean"), "_std": now("std")})
    gains = F.col("best") & ~F.col("is_current") & adopted(F.col("mean"), F.col("_mean"), F.col("_std"))
    return judged.select("model", "value", "is_current", "mean", "std", "objective", "best", gains.alias("adopted"))


#: Demand bases and the labels of the supervised matrix that stand for them.
BASES = {"recovered": "y", "observed": "y_observed"}


def train_bases(panel: DataFrame, train: DataFrame, calibration: DataFrame, test: DataFrame, levels: Sequence[float] = (0.1, 0.5, 0.625, 0.9), alpha: float = 0.1, horizon: int = 7, params: boosting.Params = boosting.Params(), conformal: str = "cqr") -> DataFrame:
    """One model and its calibration on both demand bases: rows (basis, series, origin, h) of the test origins with the
    predicted levels, pred_lo and pred_hi, and what was sold. The features are made once and shared; the levels of both
    bases are boosted in the same jobs. train, calibration and test are tables of origin_date; the days that an earlier
    one forecasts must end before a later one's origins. conformal: `cqr` moves the band of the outer levels, `adaptive`
    puts a band around the median in proportion to each series' daily changes."""
    parts = {"train": train, "calibration": calibration, "test": test}
    origins = None
    for part, dates in parts.items():
        own = dates.select("origin_date", F.lit(part).alias("part"))
        origins = own if origins is None else origins.unionByName(own)
    spans = {r["part"]: (r["a"], r["b"]) for r in origins.groupBy("part").agg(F.min("origin_date").alias("a"), F.date_add(F.max("origin_date"), horizon).alias("b")).collect()}
    if not spans["train"][1] <= spans["calibration"][0] <= spans["calibration"][1] <= spans["test"][0]:
        raise ValueError("a part's days reach into the next part's origins")
    state = features.origin_state(panel)
    matrix = written(features.supervised_matrix(state, panel, origins.select("origin_date"), horizon).join(F.broadcast(origins), "origin_date"))
    heads = [boosting.Head(target, q) for target in BASES.values() for q in levels]
    trees = boosting.fit(matrix.filter("part = 'train'"), heads, ("h", *numeric_features(matrix)), ("store_id", "product_id"), params)
    truth = panel.select("series_id", "dt", "is_censored", "available_weight")
    later = matrix.filter("part <> 'train'").join(truth, ["series_id", "dt"])
    names = [quantile_name(q) for q in levels]
    middle = quantile_name(min(levels, key=lambda q: abs(q - 0.5)))
    rows = None
    for basis, target in BASES.items():
        said = trees.predict(later, target).withColumns({"model": F.lit(basis), "y_true": F.col(target), "y_pred": F.col(middle)})
        said = written(said.select("model", "part", "series_id", "origin_date", "h", "dt", "y_true", "y_observed", "y_pred", *names, "is_censored", "available_weight"))
        known, asked = said.filter("part = 'calibration'"), said.filter("part = 'test'")
        if conformal == "cqr":
            done = conformal_quantiles(known, asked, names[0], names[-1], alpha)
        else:
            column = "demand_latent" if basis == "recovered" else "sale_amount"
            past = panel.crossJoin(F.broadcast(calibration.agg(F.min("origin_date").alias("_o")))).filter("dt <= _o")
            done = residual_conformal(known, asked, alpha, dispersion(past, column))
        rows = done if rows is None else rows.unionByName(done)
    return rows.withColumnRenamed("model", "basis").drop("part")


def numeric_features(matrix: DataFrame) -> list[str]:
    """The state's features, what is known ahead and the calendar, in the matrix' order."""
    skip = {"series_id", "origin_date", "dt", "h", "y", "y_observed", "part", *features.HIERARCHY}
    return [c for c, t in matrix.dtypes if c not in skip and t in ("double", "int", "bigint", "float", "boolean", "smallint", "tinyint")]


def compare_bases(rows: DataFrame) -> DataFrame:
    """(basis, n, mae_clean, recensored_bias, clean_day_bias, coverage, mean_width): on what was sold, bias of the median
    cut down by the day's available share, and the share of each basis' own truth within its interval."""
    error = F.abs(F.col("y_observed") - F.col("y_pred"))
    return rows.groupBy("basis").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(~F.col("is_censored"), error)).alias("mae_clean"),
        recensored_bias(F.col("y_observed"), F.col("y_pred"), F.col("available_weight")).alias("recensored_bias"),
        clean_day_bias(F.col("y_observed"), F.col("y_pred"), F.col("is_censored")).alias("clean_day_bias"),
        F.avg(F.col("y_true").between(F.col("pred_lo"), F.col("pred_hi")).cast("int")).alias("coverage"),
        F.avg(F.col("pred_hi") - F.col("pred_lo")).alias("mean_width"),
    )
