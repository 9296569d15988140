"""Connected components of a graph given by its edges, by alternating large and small stars.

First each task replaces its share of the edges by stars of what they join, so that long chains take few rounds. Each
round turns neighbours over to the smallest node that they know (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014); a logarithmic number of rounds leaves one star for each component. Rounds are
written to the checkpoint folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.shared import cut_lineage, shared_folder


def smallest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with m, the smallest b of each a. The join's key differs from the grouping's key in form, so
    that Spark shuffles both sides for the join and can split the edges of a hub."""
    key = F.col("a").bitwiseXOR(F.lit(-1)).alias("ak")
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(key, "m")
    # Merged whatever the size: a round's table is small or large, and broadcasts of all rounds would fill the driver.
    return edges.select(key, "a", "b").join(least.hint("merge"), "ak").select("a", "b", "m")


#: Edges that a task holds at once when it contracts its share.
SHARE = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that its edges lead to) for the nodes of some edges, without those smallest ones."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    above = list(range(len(nodes)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = top(x), top(y)
        above[max(x, y)] = min(x, y)
    roots = np.fromiter(map(top, range(len(nodes))), np.int64, len(nodes))
    below = roots != np.arange(len(nodes))
    return nodes[below], nodes[roots[below]]


def contracted(edges: DataFrame, n_edges: int) -> DataFrame:
    """Edges (a, b) with the same components, a > b, at most as many: each task's share as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars_of() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SHARE:
                yield stars_of()
                held, n = [], 0
        if n:
            yield stars_of()

    return edges.coalesce(1 + n_edges // SHARE).mapInArrow(run, "a long, b long")


def checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots: edges (a, b) of two longs in, each component's smallest node as
    its root out. Loops, nulls and repeated edges are ignored."""
    shared_folder(edges.sparkSession)
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = cut_lineage(contracted(now, now.count()).distinct())
    before = checksum(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = smallest(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = smallest(cut_lineage(large.distinct()))
        # Written by the job that sums it up.
        now = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct().checkpoint(eager=False)
        after = checksum(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
