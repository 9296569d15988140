"""Global forecasters on the supervised matrix, with Spark ML. Quantile trees and attribution: boosting; ridge, lasso and elastic net: linear."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = ("h", "latent_lag_0", "latent_lag_7", "latent_roll_mean_7", "latent_roll_mean_28", "latent_roll_std_28", "latent_dow_mean_4", "zero_share_28", "days_since_sale", "discount", "dow", "day_of_month")
CATEGORICAL = ("store_id", "product_id")


def _prepared(numeric: Sequence[str], categorical: Sequence[str], scale: bool) -> list:
    """Medians for missing values, indexes for categories; all learned from the rows that are fitted."""
    filled = [f"_f_{c}" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled)]
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"_i_{c}" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(VectorAssembler(inputCols=[*filled, *(f"_i_{c}" for c in categorical)], outputCol="_raw" if scale else "features"))
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True))
    return stages


def _doubles(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    return df.withColumns({**{c: F.col(c).cast("double") for c in numeric}, **{c: F.col(c).cast("string") for c in categorical}})


class Fitted:
    """A fitted model: rows of a supervised matrix in, y_pred added, not below zero."""

    def __init__(self, model, numeric, categorical):
        self.model, self.numeric, self.categorical = model, numeric, categorical

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        done = self.model.transform(_doubles(df, self.numeric, self.categorical))
        return done.select(*df.columns, F.greatest("prediction", F.lit(0.0)).alias(name))


def fit_boosted(train: DataFrame, rounds: int = 20, depth: int = 5, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, seed: int = 42) -> Fitted:
    """Direct multi-step trees for the absolute error; the step is a feature."""
    stages = [*_prepared(numeric, categorical, False), GBTRegressor(labelCol="y", lossType="absolute", maxIter=rounds, maxDepth=depth, maxBins=128, seed=seed)]
    return Fitted(Pipeline(stages=stages).fit(_doubles(train, numeric, categorical)), numeric, categorical)


def fit_linear_quantile(train: DataFrame, level: float = 0.9, rounds: int = 6, numeric: Sequence[str] = NUMERIC) -> Fitted:
    """Linear quantile regression by repeated weighted least squares: residuals are weighted by the pinball loss's
    slope over their size, so that the weighted squares approach it."""
    prep = Pipeline(stages=_prepared(numeric, (), True)).fit(_doubles(train, numeric, ()))
    rows = prep.transform(_doubles(train, numeric, ())).select("features", "y").withColumn("w", F.lit(1.0)).persist()
    for _ in range(rounds):
        line = LinearRegression(labelCol="y", weightCol="w", regParam=1e-3, standardization=False).fit(rows)
        gap = F.col("y") - F.col("prediction")
        rows = line.transform(rows.select("features", "y")).select("features", "y", (F.when(gap > 0, level).otherwise(1 - level) / F.greatest(F.abs(gap), F.lit(0.05))).alias("w"))
    from pyspark.ml import PipelineModel

    return Fitted(PipelineModel(stages=[*prep.stages, line]), numeric, ())


def global_attribution(parts: DataFrame) -> DataFrame:
    return parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean"))
