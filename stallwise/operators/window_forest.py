"""Anomalous windows of demand: an isolation forest that is fitted once and kept as a table, and its verdicts.

Fit and score are apart, so a window is judged by the limits of the fit and not by the rows that came with it. Lower
scores are stranger; a window is anomalous at or below the threshold, the lower share's quantile of the fitted scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwise.operators.lineage import written
from stallwise.operators.quantiles import exact_quantiles, levels

TREES = "tree int, points int, feature array<int>, cut array<double>, low array<int>, high array<int>, n array<int>"


@dataclass(frozen=True)
class Detector:
    """trees: a row per tree, its nodes in arrays (feature -1 in a leaf, n its points); threshold; windows fitted."""

    trees: DataFrame
    threshold: float
    n_windows: int

    def save(self, folder: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{folder}/trees")
        limits = self.trees.sparkSession.createDataFrame([(self.threshold, self.n_windows)], "threshold double, n_windows long")
        limits.write.mode("overwrite").parquet(f"{folder}/limits")


def load(spark: SparkSession, folder: str) -> Detector:
    limits = spark.read.parquet(f"{folder}/limits").first()
    return Detector(spark.read.parquet(f"{folder}/trees"), limits["threshold"], limits["n_windows"])


def series_levels(panel: DataFrame, target: str = "demand_latent") -> DataFrame:
    """(series_id, level): each series' mean, to set later windows in proportion to."""
    return panel.groupBy("series_id").agg(F.avg(target).alias("level"))


def demand_windows(panel: DataFrame, length: int = 14, target: str = "demand_latent", known: DataFrame | None = None) -> DataFrame:
    """(series_id, dt, is_censored, window): the days up to each day in proportion to the series' level, as they are where
    that is not above zero. Whole windows without nulls only. Levels are those of the panel itself, or `known` ones
    (series_levels of what was fitted); a series that is not among them takes its own."""
    w = Window.partitionBy("series_id").orderBy("dt").rowsBetween(-(length - 1), 0)
    own = F.avg(target).over(Window.partitionBy("series_id"))
    rows = panel.select("series_id", "dt", "is_censored", F.collect_list(target).over(w).alias("_v"), own.alias("_m")).filter(F.size("_v") == length)
    if known is not None:
        rows = rows.join(known.select("series_id", F.col("level").alias("_k")), "series_id", "left").withColumn("_m", F.coalesce("_k", "_m"))
    return rows.select("series_id", "dt", "is_censored", F.transform("_v", lambda x: F.when(F.col("_m") > 0, x / F.col("_m")).otherwise(x)).alias("window"))


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of a search that fails among n points."""
    n = np.asarray(n, dtype=float)
    long = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(long - 1) + np.euler_gamma) - 2 * (long - 1) / long))


def grow(points: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree: random cuts until a point is alone, points are equal, or the depth is that of a balanced tree."""
    most = int(np.ceil(np.log2(max(2, len(points)))))
    tree: dict[str, list] = {k: [] for k in ("feature", "cut", "low", "high", "n")}
    todo = [(points, 0, None, None)]
    while todo:
        at, depth, parent, side = todo.pop()
        me = len(tree["n"])
        if parent is not None:
            tree[side][parent] = me
        spread = np.flatnonzero(at.min(axis=0) < at.max(axis=0)) if len(at) > 1 and depth < most else ()
        f, cut = -1, 0.0
        if len(spread):
            f = int(rng.choice(spread))
            # Within (least, most], so that neither side is empty.
            least, top = at[:, f].min(), at[:, f].max()
            cut = float(top - rng.random() * (top - least))
            below = at[:, f] < cut
            if below.all() or not below.any():
                f = -1
        for k, v in (("feature", f), ("cut", cut), ("low", -1), ("high", -1), ("n", len(at))):
            tree[k].append(v)
        if f >= 0:
            todo += [(at[~below], depth + 1, me, "high"), (at[below], depth + 1, me, "low")]
    return tree


def depths(tree: dict, points: np.ndarray) -> np.ndarray:
    """How deep each point ends, with what a leaf of several points would still take."""
    feature, cut, low, high = (np.asarray(tree[k]) for k in ("feature", "cut", "low", "high"))
    node, depth, rows = np.zeros(len(points), np.int64), np.zeros(len(points)), np.arange(len(points))
    while True:
        inner = rows[feature[node] >= 0]
        if not len(inner):
            return depth + usual_path(np.asarray(tree["n"])[node])
        at = node[inner]
        node[inner] = np.where(points[inner, feature[at]] < cut[at], low[at], high[at])
        depth[inner] += 1


def scores(detector_trees: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with `score` instead of the window. The trees are broadcast: at most their number times twice the sample
    in nodes, whatever was fitted."""
    forest = windows.sparkSession.sparkContext.broadcast([r.asDict() for r in detector_trees.orderBy("tree").collect()])
    kept = [c for c in windows.columns if c != "window"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
            depth = sum((depths(tree, points) for tree in forest.value), np.zeros(len(points))) / len(forest.value)
            usual = np.mean(usual_path(np.array([tree["points"] for tree in forest.value])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(-(2.0 ** (-depth / max(usual, 1e-9))))], names=[*kept, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in windows.dtypes if c != "window")
    return windows.select(*kept, "window").mapInArrow(score, f"{schema}, score double")


def fit(windows: DataFrame, trees: int = 200, sample: int = 256, share: float = 0.01, seed: int = 42) -> Detector:
    """A detector fitted on (series_id, dt, window). Each tree sees at most `sample` windows: a pool of about twice
    trees x sample, picked by a hash, is dealt to the trees by another, so what is shuffled is bounded by the parameters.
    The threshold counts every window."""
    windows = written(windows.select("series_id", "dt", "window"))
    total = windows.count()
    if total == 0:
        raise ValueError("no series is as long as a window")
    chance = lambda *by: F.pmod(F.xxhash64(*by), F.lit(1 << 30)) / float(1 << 30)
    pool = min(total, 2 * trees * sample)
    picked = windows.filter(chance("series_id", "dt", F.lit(seed)) < pool / total) if pool < total else windows
    dealt = picked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_u", chance("tree", "series_id", "dt", F.lit(seed + 1)))
    dealt = dealt.filter(F.col("_u") <= min(1.0, 2.0 * sample / pool))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_u", "series_id", "dt"]).head(sample)
        tree = grow(np.array(rows["window"].tolist(), dtype=float), np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({"tree": [int(key[0])], "points": [len(rows)], **{k: [v] for k, v in tree.items()}})

    built = written(dealt.groupBy("tree").applyInPandas(build, TREES))
    if built.isEmpty():
        raise ValueError("no tree has a window")
    fitted = written(scores(built, windows))
    cut = exact_quantiles(fitted, [], "score", levels(share), n_rows=total).first()["q"][0]
    return Detector(built, cut, total)


def judge(detector: Detector, windows: DataFrame) -> DataFrame:
    """windows with `score` and `anomalous` instead of the window; each by itself."""
    return scores(detector.trees, windows).withColumn("anomalous", F.col("score") <= F.lit(detector.threshold))


def contrast_with_censoring(judged: DataFrame) -> DataFrame:
    """One row: windows, marked ones, how many of those end in a known stock-out, and how many are new findings."""
    return judged.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if("anomalous").alias("marked"),
        F.avg(F.when(F.col("anomalous"), F.col("is_censored").cast("int"))).alias("marked_stockout_rate"),
        F.count_if(F.col("anomalous") & ~F.col("is_censored")).alias("new_findings"),
        F.avg(F.col("is_censored").cast("int")).alias("panel_rate"),
    )
