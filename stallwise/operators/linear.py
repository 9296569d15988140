"""Ridge, lasso and elastic net over an encoded supervised matrix, from one pass of products.

The encoding is learned from the rows that are fitted and nothing else: medians for missing numbers and a flag where any
was missing, means and deviations, the categories that at least one row in a hundred has (so at most a hundred), and a
column for all rarer ones, which unseen categories share. Tasks sum up products of columns; only one number for each
pair of columns reaches the driver, which solves for the weights. Predictions are plain column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.operators.boosting import matrix
from stallwise.operators.models import CATEGORICAL, NUMERIC
from stallwise.operators.quantiles import exact_quantiles, levels


@dataclass
class Encoder:
    """Columns made from features, by name."""

    medians: dict[str, float]
    flagged: tuple[str, ...]
    centre: dict[str, float] = field(default_factory=dict)
    spread: dict[str, float] = field(default_factory=dict)
    common: dict[str, tuple[str, ...]] = field(default_factory=dict)
    usual: dict[str, str] = field(default_factory=dict)
    rare: dict[str, bool] = field(default_factory=dict)

    def raw(self) -> dict[str, Column]:
        """Numbers without gaps, and flags of gaps."""
        number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        found = {c: F.coalesce(number(c), F.lit(m)) for c, m in self.medians.items()}
        return found | {f"{c} missing": F.when(number(c).isNull(), 1.0).otherwise(0.0) for c in self.flagged}

    def columns(self) -> dict[str, Column]:
        found = {c: (x - self.centre[c]) / self.spread[c] for c, x in self.raw().items()}
        for c, kinds in self.common.items():
            own = F.coalesce(F.col(c).cast("string"), F.lit(self.usual[c]))
            found |= {f"{c}={k}": F.when(own == k, 1.0).otherwise(0.0) for k in kinds}
            if self.rare[c]:
                found[f"{c} rare"] = F.when(own.isin(list(kinds)), 0.0).otherwise(1.0)
        return found


def encoder(train: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, least_share: float = 0.01) -> Encoder:
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), number(c).alias("v")) for c in numeric))).alias("x")
    medians = {r["feature"]: r["q"][0] for r in exact_quantiles(train.select(pairs).select("x.*"), ["feature"], "v", levels(0.5)).collect()}
    counts = train.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(number(c).isNull()).alias(c) for c in numeric)).first()
    found = Encoder({c: medians.get(c, 0.0) for c in numeric}, tuple(c for c in numeric if counts[c]))
    raw = found.raw()
    moments = train.agg(*(F.struct(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).alias(f"c{k}") for k, x in enumerate(raw.values()))).first()
    for k, c in enumerate(raw):
        found.centre[c], found.spread[c] = moments[k]["m"] or 0.0, moments[k]["s"] or 1.0
    for c in categorical:
        kinds = train.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        frequent = kinds.filter(F.col("n") >= least_share * counts["n"]).orderBy(F.desc("n"), "k").collect()
        most = kinds.orderBy(F.desc("n"), "k").limit(1).collect()
        found.common[c], found.usual[c] = tuple(sorted(r["k"] for r in frequent)), most[0]["k"] if most else ""
        found.rare[c] = not kinds.filter(F.col("n") < least_share * counts["n"]).isEmpty()
    return found


def products(rows: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sums, sums of products) of the p columns of rows (_x), an array each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                n, sums, gram = n + len(x), sums + x.sum(axis=0), gram + x.T @ x
        if n:
            values = np.concatenate(([n], sums, gram.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "v"])

    got = rows.select("_x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    values = np.zeros(1 + p + p * p)
    values[got.column("cell").to_numpy()] = got.column("v").to_numpy()
    return values[0], values[1 : 1 + p], values[1 + p :].reshape(p, p)


@dataclass
class Linear:
    encoder: Encoder
    weights: dict[str, float]
    intercept: float
    #: Centred sums of products of the columns, and of each with the label, over n rows.
    gram: np.ndarray
    moment: np.ndarray
    n: float

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        """df with the prediction, not below zero."""
        columns = self.encoder.columns()
        said = F.lit(self.intercept)
        for c, w in self.weights.items():
            if w:
                said = said + F.lit(w) * columns[c]
        return df.withColumn(name, F.greatest(said, F.lit(0.0)))


def solve(gram: np.ndarray, moment: np.ndarray, n: float, l1: float, l2: float, rounds: int = 10_000) -> np.ndarray:
    """Weights that minimise |y - Xw|^2 / 2n + l1 |w| + l2 |w|^2 / 2: by the normal equations, or with l1 by coordinate
    descent until the signs are right, and then exactly."""
    p = len(moment)
    if l1 == 0:
        return np.linalg.lstsq(gram / n + l2 * np.eye(p), moment / n, rcond=None)[0]
    w, g, b = np.zeros(p), gram / n, moment / n
    for number in range(rounds):
        most = 0.0
        for j in np.flatnonzero(np.diag(g) > 1e-15):
            pull = b[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (g[j, j] + l2)
            most, w[j] = max(most, abs(new - w[j])), new
        if number % 50 == 49 or most <= 1e-12 * (1 + np.abs(w).max()):
            # Columns that are nearly alike make the descent slow; with the signs known the rest is a linear system.
            on = np.flatnonzero(w)
            exact = np.zeros(p)
            exact[on] = np.linalg.lstsq(g[np.ix_(on, on)] + l2 * np.eye(len(on)), b[on] - l1 * np.sign(w[on]), rcond=None)[0]
            slope = b - g @ exact - l2 * exact
            if (np.sign(exact) == np.sign(w)).all() and (np.abs(slope) <= l1 * (1 + 1e-9) + 1e-12).all():
                return exact
        if most <= 1e-12 * (1 + np.abs(w).max()):
            break
    return w


def fit_linear(train: DataFrame, kind: str = "ridge", alpha: float | None = None, mix: float = 0.5, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL, target: str = "y") -> Linear:
    """Ridge (alpha 1: on the sum of squares), lasso or elastic net (alpha 0.01: on their mean, mix to the absolute
    values) over the rows of train whose target is not null. The intercept is not penalised."""
    if kind not in ("ridge", "lasso", "elasticnet"):
        raise ValueError("kind is ridge, lasso or elasticnet")
    alpha = (1.0 if kind == "ridge" else 0.01) if alpha is None else alpha
    train = train.filter(F.col(target).isNotNull())
    own = encoder(train, numeric, categorical)
    columns = own.columns()
    rows = train.select(F.array(*columns.values(), F.col(target).cast("double")).alias("_x"))
    n, sums, gram = products(rows, len(columns) + 1)
    if not n:
        raise ValueError("no row to fit")
    means = sums / n
    centred = gram - n * np.outer(means, means)
    g, b = centred[:-1, :-1], centred[:-1, -1]
    share = {"ridge": 0.0, "lasso": 1.0, "elasticnet": mix}[kind]
    w = solve(g, b, n, alpha * share, alpha / n if kind == "ridge" else alpha * (1 - share))
    return Linear(own, dict(zip(columns, w.tolist())), float(means[-1] - means[:-1] @ w), g, b, n)
