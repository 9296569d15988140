"""Boosted quantile trees, all heads in the same jobs, and exact Shapley values of their predictions.

A head is a target and a level: five levels of one target, or both demand bases, are boosted side by side over one set
of binned features. Each depth of each round is one pass: tasks count, by head, node, feature and bin, the rows above
and below their current quantile, and only these counts (bounded by the parameters, not by rows) reach the driver,
which picks the splits. Counts are whole numbers, so a fit does not depend on how rows are dealt. A leaf moves by the exact
quantile of its residuals, found without gathering a leaf. Predictions of one target are sorted by level, so they never
cross. Missing values are a bin of their own, below all others; a category stands for its mean target in the training
rows, an unseen one is missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.functions.arrays import quantile_name
from stallwise.operators.lineage import written
from stallwise.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Head:
    target: str
    level: float


@dataclass(frozen=True)
class Params:
    rounds: int = 20
    depth: int = 3
    rate: float = 0.3
    least_rows: int = 20
    bins: int = 63
    #: Rounds after which the rows' current quantiles are written.
    write_every: int = 10


@dataclass
class Trees:
    """Arrays by round, head and node; a node that isn't split sends all rows to its left child."""

    heads: tuple[Head, ...]
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    encodings: dict[str, DataFrame]
    cuts: list[np.ndarray]
    depth: int
    base: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    #: Training rows of each node, the leaves last.
    cover: list[np.ndarray] = field(default_factory=list)

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categorical)

    def arrays(self) -> Trees:
        """Without the tables, as workers need it."""
        return Trees(self.heads, self.numeric, self.categorical, {}, self.cuts, self.depth, self.base, list(self.feature), list(self.cut), list(self.value), list(self.cover))

    def ready(self, df: DataFrame) -> DataFrame:
        """df with the features as one array of doubles, _x."""
        for c in self.categorical:
            df = df.join(self.encodings[c].withColumnRenamed("category", f"_k_{c}"), F.col(c).cast("string") == F.col(f"_k_{c}"), "left").drop(f"_k_{c}")
        return df.withColumn("_x", F.array(*(F.col(c).cast("double") for c in self.numeric), *(F.col(f"_mean_{c}") for c in self.categorical))).drop(*(f"_mean_{c}" for c in self.categorical))

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows of features: 0 if missing."""
        found = np.empty(x.shape, np.uint8)
        for k, cuts in enumerate(self.cuts):
            found[:, k] = np.where(np.isnan(x[:, k]), 0, np.searchsorted(cuts, x[:, k]) + 1)
        return found

    def quantiles(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        """What the rounds from start on add, by row and head; from 0, the quantiles themselves."""
        found = np.tile(self.base if start == 0 else np.zeros(len(self.heads)), (len(bins), 1))
        for r in range(start, len(self.value)):
            for h in range(len(self.heads)):
                found[:, h] += self.value[r][h][nodes_of(bins, self.feature[r][h], self.cut[r][h], self.depth) - (1 << self.depth) + 1]
        return found

    def sorted(self, q: np.ndarray) -> np.ndarray:
        """Not below zero, and rising with the level within each target."""
        q = np.maximum(q, 0.0)
        for target in {h.target for h in self.heads}:
            at = sorted((k for k, h in enumerate(self.heads) if h.target == target), key=lambda k: self.heads[k].level)
            q[:, at] = np.sort(q[:, at], axis=1)
        return q

    def predict(self, df: DataFrame, target: str | None = None) -> DataFrame:
        """df with pred_qNN for each level of a target (the first head's if none is named)."""
        target = target or self.heads[0].target
        own, trees = [k for k, h in enumerate(self.heads) if h.target == target], self.arrays()
        rows = self.ready(df)
        names = [quantile_name(self.heads[k].level) for k in own]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = trees.sorted(trees.quantiles(trees.binned(matrix(batch.column(batch.num_columns - 1)))))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(q[:, k]) for k in own)], names=[*batch.schema.names[:-1], *names])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return rows.select(*df.columns, "_x").mapInArrow(run, f"{fields}, " + ", ".join(f"{n} double" for n in names))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of arrays of equal length; nulls become NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nodes_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Nodes that rows have reached after so many splits, numbered from the root by levels."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = feature[at]
        at = 2 * at + 1 + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > cut[at]))
    return at


def best_splits(n: np.ndarray, above: np.ndarray, level: float, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By node the feature (-1: none) and bin with the largest gain in squared gradient; n and above count rows by node,
    feature and bin. The gradient of a row is level above the current quantile and level - 1 below."""
    left_n, left_a = np.cumsum(n, axis=2), np.cumsum(above, axis=2)
    right_n, right_a = left_n[:, :, -1:] - left_n, left_a[:, :, -1:] - left_a
    pull = lambda a, m: (a - (1 - level) * m) ** 2 / np.maximum(m, 1)
    gain = pull(left_a, left_n) + pull(right_a, right_n) - pull(left_a[:, :, -1:], left_n[:, :, -1:])
    gain = np.where((left_n >= least_rows) & (right_n >= least_rows), gain, 0.0).reshape(len(n), -1)
    best = gain.argmax(axis=1)
    some = gain[np.arange(len(n)), best] > 1e-9
    return np.where(some, best // n.shape[2], -1), np.where(some, best % n.shape[2], 0)


def fit(train: DataFrame, heads: Sequence[Head], numeric: Sequence[str], categorical: Sequence[str] = (), params: Params = Params()) -> Trees:
    """All heads over the rows of train; rows whose target is null don't count for its heads."""
    heads, depth = tuple(heads), params.depth
    targets = list(dict.fromkeys(h.target for h in heads))
    encodings = {c: written(train.groupBy(F.col(c).cast("string").alias("category")).agg(F.avg(targets[0]).alias(f"_mean_{c}"))) for c in categorical}
    trees = Trees(heads, tuple(numeric), tuple(categorical), encodings, [], depth, np.zeros(len(heads)))
    ready = trees.ready(train)
    grid = F.array(*(F.lit(k / params.bins) for k in range(1, params.bins)))
    marks = ready.agg(*(F.percentile_approx(F.col("_x")[k], grid, F.lit(20_000)).alias(f"c{k}") for k in range(len(trees.names)))).first()
    trees.cuts = [np.unique(np.array(x if x else [], np.float64)) for x in marks]
    width = 2 + max(map(len, trees.cuts), default=0)
    own = trees.arrays()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = own.binned(matrix(batch.column(len(targets))))
            start = np.tile(own.base, (len(bins), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([q.tobytes() for q in start], pa.binary())], names=[*targets, "bins", "q"])

    schema = ", ".join(f"{t} double" for t in targets) + ", bins binary, q binary"
    rows = written(ready.select(*(F.col(t).cast("double").alias(t) for t in targets), "_x").mapInArrow(pack, schema))
    n_rows, begun = rows.count() * len(heads), 0

    def opened(batch: pa.RecordBatch, known: Trees, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Targets by head, bins, and current quantiles of a batch."""
        y = np.column_stack([batch.column(targets.index(h.target)).to_numpy(zero_copy_only=False).astype(np.float64) for h in heads])
        bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        q = np.frombuffer(b"".join(batch.column("q").to_pylist()), np.float64).reshape(batch.num_rows, -1)
        return y, bins, q + (known.quantiles(bins, start) if start or known.value else known.base)

    def leaf_values(feature: np.ndarray | None, cut: np.ndarray | None) -> DataFrame:
        """(head, leaf, q): the quantile of residuals at each head's level; of the targets where there is no tree yet."""
        known, start = trees.arrays(), begun

        def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, bins, q = opened(batch, known, start)
                for h in range(len(heads)):
                    leaf = np.zeros(len(y), np.int64) if feature is None else nodes_of(bins, feature[h], cut[h], depth) - (1 << depth) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), h, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(y[:, h] - q[:, h], from_pandas=True)], names=["head", "leaf", "v"])

        level = F.element_at(F.array(*(F.lit(h.level) for h in heads)), F.col("head") + 1)
        return exact_quantiles(rows.mapInArrow(residuals, "head int, leaf int, v double"), ["head", "leaf"], "v", lambda n: F.array((n - 1) * level), n_rows=n_rows)

    for r in leaf_values(None, None).collect():
        trees.base[r["head"]] = r["q"][0]
    for number in range(params.rounds):
        feature, cut = np.full((len(heads), (1 << depth) - 1), -1), np.zeros((len(heads), (1 << depth) - 1), np.int64)
        cover = np.zeros((len(heads), (2 << depth) - 1), np.int64)
        known, start = trees.arrays(), begun
        for d in range(depth):
            n_nodes, first = 1 << d, (1 << d) - 1

            def count(batches: Iterator[pa.RecordBatch], d=d, n_nodes=n_nodes, first=first) -> Iterator[pa.RecordBatch]:
                n = np.zeros((len(heads), n_nodes * len(known.names) * width), np.int64)
                above = np.zeros_like(n)
                for batch in batches:
                    y, bins, q = opened(batch, known, start)
                    for h in range(len(heads)):
                        real = ~np.isnan(y[:, h])
                        node = nodes_of(bins, feature[h], cut[h], d)[real] - first
                        cells = ((node[:, None] * len(known.names) + np.arange(len(known.names))) * width + bins[real]).ravel()
                        n[h] += np.bincount(cells, minlength=n.shape[1])
                        above[h] += np.bincount(cells[np.repeat(y[real, h] > q[real, h], len(known.names))], minlength=n.shape[1])
                head, cell = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(cell), pa.array(n[head, cell]), pa.array(above[head, cell])], names=["head", "cell", "n", "above"])

            got = rows.mapInArrow(count, "head long, cell long, n long, above long").groupBy("head", "cell").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).toArrow()
            head, cell, n, above = (got.column(c).to_numpy() for c in ("head", "cell", "n", "above"))
            for h, own_head in enumerate(heads):
                at = head == h
                counts, more = (np.bincount(cell[at], weights=x[at], minlength=n_nodes * len(trees.names) * width).reshape(n_nodes, len(trees.names), width) for x in (n, above))
                feature[h, first : first + n_nodes], cut[h, first : first + n_nodes] = best_splits(counts, more, own_head.level, params.least_rows)
                cover[h, first : first + n_nodes] = counts[:, 0].sum(axis=1)
                if d == depth - 1:
                    left = np.cumsum(counts, axis=2)[np.arange(n_nodes), np.maximum(feature[h, first:], 0), cut[h, first:]]
                    left = np.where(feature[h, first:] >= 0, left, cover[h, first : first + n_nodes])
                    cover[h, first + n_nodes :: 2], cover[h, first + n_nodes + 1 :: 2] = left, cover[h, first : first + n_nodes] - left
        value = np.zeros((len(heads), 1 << depth))
        for r in leaf_values(feature, cut).collect():
            value[r["head"], r["leaf"]] = params.rate * r["q"][0]
        trees.feature.append(feature)
        trees.cut.append(cut)
        trees.value.append(value)
        trees.cover.append(cover)
        if (number + 1) % params.write_every == 0 and number + 1 < params.rounds:
            known, start = trees.arrays(), begun

            def move(batches: Iterator[pa.RecordBatch], known=known, start=start) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    _, _, q = opened(batch, known, start)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.tobytes() for x in q], pa.binary())], names=batch.schema.names)

            rows, begun = written(rows.mapInArrow(move, schema)), number + 1
    return trees


def shapley_weights(n: int) -> np.ndarray:
    """Weight of a coalition by its size, among n players of which one is being judged."""
    return np.array([factorial(k) * factorial(n - 1 - k) / factorial(n) for k in range(n)])


def leaf_paths(tree: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> Iterator[tuple[int, dict[int, tuple[float, list]]]]:
    """For each leaf with training rows: by feature on its path the share of rows that stay when the feature is unknown,
    and the conditions (node, right) that a row has to meet."""
    feature, _, cover = tree
    for leaf in range(1 << depth):
        at, met, steps = 0, {}, [(leaf >> (depth - 1 - k)) & 1 for k in range(depth)]
        for right in steps:
            below = 2 * at + 1 + right
            if feature[at] >= 0:
                share, conditions = met.get(feature[at], (1.0, []))
                met[int(feature[at])] = (share * cover[below] / max(1, cover[at]), [*conditions, (at, right)])
            elif right:
                break
            at = below
        else:
            yield leaf, met


def shapley(bins: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], value: np.ndarray, depth: int, n_features: int) -> tuple[float, np.ndarray]:
    """(mean value over the training rows, contributions by row and feature) of one tree: exact Shapley values of the
    game in which unknown features follow the training rows' shares."""
    feature, cut, cover = tree
    found, mean = np.zeros((len(bins), n_features)), 0.0
    for leaf, met in leaf_paths(tree, depth):
        players = list(met)
        shares = [met[f][0] for f in players]
        mean += value[leaf] * float(np.prod(shares))
        meets = [np.all([(bins[:, f] > cut[at]) == bool(right) for at, right in met[f][1]], axis=0).astype(np.float64) for f in players]
        weights = shapley_weights(len(players)) if players else ()
        for i, f in enumerate(players):
            # Sums over coalitions by size: the product of (share + met * t) over the other players.
            sums = np.zeros((len(players), len(bins)))
            sums[0] = 1.0
            for j in range(len(players)):
                if j != i:
                    sums[1:] = sums[1:] * shares[j] + sums[:-1] * meets[j]
                    sums[0] *= shares[j]
            found[:, f] += value[leaf] * (meets[i] - shares[i]) * (np.asarray(weights) @ sums)
    return mean, found


def contributions(trees: Trees, df: DataFrame, keys: Sequence[str], head: Head, top_k: int | None = None) -> DataFrame:
    """(keys, rank, feature, contribution, base, prediction): how much each feature moves a row's prediction away
    from the base; base plus contributions is the head's prediction before sorting and clipping. With top_k only the k
    largest in absolute value have rows of their own, ties by name, and `rest` sums up the others."""
    at, own = trees.heads.index(head), trees.arrays()
    names = np.array(own.names)
    kept = len(names) if top_k is None else min(top_k, len(names))
    by_name = np.argsort(np.argsort(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = own.binned(matrix(batch.column(len(keys))))
            base, moved = float(own.base[at]), np.zeros((len(bins), len(names)))
            for r in range(len(own.value)):
                mean, part = shapley(bins, (own.feature[r][at], own.cut[r][at], own.cover[r][at]), own.value[r][at], own.depth, len(names))
                base, moved = base + mean, moved + part
            said = own.quantiles(bins)[:, at]
            order = np.lexsort((np.broadcast_to(by_name, moved.shape), -np.abs(moved).round(12)), axis=1)[:, :kept]
            parts, labels = np.take_along_axis(moved, order, axis=1), names[order]
            if kept < len(names):
                parts = np.column_stack([parts, moved.sum(axis=1) - parts.sum(axis=1)])
                labels = np.column_stack([labels, np.full(len(bins), "rest")])
            n = parts.shape[1]
            pick = pa.array(np.repeat(np.arange(len(bins)), n))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(pick) for k in range(len(keys))), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(bins))), pa.array(labels.ravel().tolist(), pa.string()), pa.array(parts.ravel()), pa.array(np.full(len(pick), base)), pa.array(np.repeat(said, n))],
                names=[*keys, "rank", "feature", "contribution", "base", "prediction"],
            )

    rows = trees.ready(df).select(*keys, "_x")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return rows.mapInArrow(run, f"{fields}, rank int, feature string, contribution double, base double, prediction double")


def by_subsets(bins: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], value: np.ndarray, depth: int, n_features: int) -> np.ndarray:
    """Shapley values of one row and tree by their definition, over all subsets of features: for small trees and tests."""
    feature, cut, cover = tree

    def worth(known: frozenset, at: int = 0, d: int = 0) -> float:
        if d == depth:
            return float(value[at - (1 << depth) + 1])
        left, right = 2 * at + 1, 2 * at + 2
        if feature[at] < 0:
            return worth(known, left, d + 1)
        if feature[at] in known:
            return worth(known, right if bins[feature[at]] > cut[at] else left, d + 1)
        share = cover[left] / max(1, cover[at])
        return share * worth(known, left, d + 1) + (cover[right] / max(1, cover[at])) * worth(known, right, d + 1)

    found = np.zeros(n_features)
    for i in range(n_features):
        others = [f for f in range(n_features) if f != i]
        for k in range(n_features):
            for s in combinations(others, k):
                found[i] += factorial(k) * factorial(n_features - 1 - k) / factorial(n_features) * (worth(frozenset(s) | {i}) - worth(frozenset(s)))
    return found
