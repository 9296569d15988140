"""Density clusters in any number of dimensions, by blocks of points that lie together.

Equal points are one. Points are dealt to blocks of bounded size, by their places in a grid, and each block has the least box around
its points. A point is held against its own block first; only if that leaves open what it is does it ask the blocks whose
boxes are near enough. So a point with enough neighbours in its block is a core point without more, the core points of a block
are joined within it, a few points of each of these groups ask other blocks, and what is not in the largest component
then asks all blocks that hold another one, so that no link is lost. Points in a thin place ask for the least cluster
that they touch. What is compared grows with the points and the size of a block, and with the asking points and the blocks near them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.operators.lineage import written

#: Dimensions of the grid that finds near cells; its 3 ** n neighbours are written out for each cell.
GRID_DIMENSIONS = 3
#: Points of a block, roughly, points that ask at once in a block, and those of a group that ask other blocks first. They change no result.
BLOCK, ASKING, LEADS = 4096, 65_536, 32


def sum_of(a: Column, b: Column, part) -> Column:
    return F.aggregate(F.zip_with(a, b, part), F.lit(0.0), lambda s, x: s + x)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): the least node of each component. Loops are allowed."""
    ordered = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    nodes = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    now, before = written(ordered(edges)), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = written(ordered(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = written(ordered(small.select("b", "m").toDF("a", "b").unionByName(least.toDF("a", "b"))))
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == before:
            return nodes.join(now.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        before = sign


def near_cells(cells: DataFrame, eps: float, side: float, d: int) -> DataFrame:
    """(cell, other) of cells whose nearest corners are at most eps apart, each with itself too."""
    k, width = min(d, GRID_DIMENSIONS), eps + side
    at = lambda shift: F.array(*(F.floor(F.col("cell")[i] * side / width) + F.lit(o) for i, o in enumerate(shift)))
    shifts = [[(n // 3**i) % 3 - 1 for i in range(k)] for n in range(3**k)]
    here = cells.select("cell", at([0] * k).alias("coarse"))
    around = cells.select(F.col("cell").alias("other"), F.explode(F.array(*map(at, shifts))).alias("coarse"))
    gap = sum_of(F.col("cell"), F.col("other"), lambda x, y: F.pow(F.greatest(F.abs(x - y) - 1, F.lit(0)) * side, F.lit(2.0)))
    return here.join(around, "coarse").filter(gap <= eps * eps * (1 + 1e-9)).select("cell", "other")


def boxes(points: DataFrame, d: int, *more: Column) -> DataFrame:
    """(cell, lo, hi) and more aggregates: the least box around each cell's points."""
    each = lambda f: F.array(*(f(F.col("p")[i]) for i in range(d)))
    return points.groupBy("cell").agg(each(F.min).alias("lo"), each(F.max).alias("hi"), *more)


def with_boxes(near: DataFrame, cells: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (cell, other) with both boxes."""
    cells = cells.withColumnsRenamed({"lo": "cell_lo", "hi": "cell_hi"})
    return near.join(cells, "cell").join(others.withColumnsRenamed({"cell": "other", "lo": "other_lo", "hi": "other_hi"}), "other")


def _between(part) -> Column:
    """Sum over the dimensions of the square of part(cell's low, high, other's low, high)."""
    ends = F.arrays_zip(*(F.col(c).alias(c) for c in ("cell_lo", "cell_hi", "other_lo", "other_hi")))
    squares = F.transform(ends, lambda e: part(e["cell_lo"], e["cell_hi"], e["other_lo"], e["other_hi"]) * part(e["cell_lo"], e["cell_hi"], e["other_lo"], e["other_hi"]))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def gap() -> Column:
    """Squared distance of the nearest places of two boxes. It is rounded as points' distances are: theirs are never less."""
    return _between(lambda a, b, c, e: F.greatest(c - b, a - e, F.lit(0.0)))


def furthest() -> Column:
    """Squared distance of the furthest places of two boxes; points' distances are never more."""
    return _between(lambda a, b, c, e: F.greatest(e - a, b - c))


def widened(rows: pa.Table, **columns: pa.Array) -> pa.Table:
    """The rows of a block with more columns, as Spark's schema strings have them: places may be null there."""
    rows = rows.set_column(rows.column_names.index("p"), "p", rows["p"].cast(pa.list_(pa.field("element", pa.float64()))))
    for name, column in columns.items():
        rows = rows.append_column(name, column)
    return rows


def points(column: pa.ChunkedArray, d: int) -> np.ndarray:
    return np.array(column.combine_chunks().flatten()).reshape(len(column), d)


def close(x: np.ndarray, y: np.ndarray, limit: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Which points y are neighbours of x, for some of x at a time. Squares are added in the order of the dimensions, so that no
    distance is less than that of a box around y."""
    step = max(1, (1 << 19) // max(1, len(y)))
    for at in (slice(k, k + step) for k in range(0, len(x), step)):
        total = np.zeros((len(x[at]), len(y)))
        for k in range(x.shape[1]):
            apart = np.subtract.outer(x[at, k], y[:, k])
            apart *= apart
            total += apart
        yield at, total <= limit


def least_linked(p: np.ndarray, limit: float) -> np.ndarray:
    """For each point the first one that a chain of neighbours leads to; each point is held once against those not found yet."""
    first, left = np.empty(len(p), np.int64), np.arange(len(p))
    while len(left):
        root, edge, left = left[0], left[:1], left[1:]
        while len(edge):
            first[edge] = root
            hit = np.zeros(len(left), bool)
            for _, near in close(p[edge], p[left], limit):
                hit |= near.any(axis=0)
            edge, left = left[hit], left[~hit]
    return first


def blocks(spots: DataFrame, eps: float, size: int) -> DataFrame:
    """The points (p) with their block (cell): about `size` that follow one another in a grid."""
    coarse = F.transform("p", lambda v: F.floor(v / eps))
    return spots.repartitionByRange(max(1, ceil(spots.count() / size)), coarse, "p").withColumn("cell", F.spark_partition_id())


def asked(asks: DataFrame, near: DataFrame, d: int, limit: float) -> DataFrame:
    """The asking points once for each block (cell) whose box is near enough: `near` holds what is near their own."""
    apart = [F.greatest(F.col("other_lo")[i] - F.col("p")[i], F.col("p")[i] - F.col("other_hi")[i], F.lit(0.0)) for i in range(d)]
    return asks.join(near.select("cell", "other", "other_lo", "other_hi"), "cell").filter(sum((x * x for x in apart), F.lit(0.0)) <= limit).drop("cell", "other_lo", "other_hi").withColumnRenamed("other", "cell")


def answered(asks: DataFrame, there: DataFrame, told: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What `told` makes of the points (name, p, ..) that ask at each block (cell) and of those that lie there. Where many ask they
    are dealt out in parts, so that what a task holds is bounded."""
    parts = max(1, ceil(asks.select("name").distinct().count() / ASKING))
    asks = asks.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))
    there = there.join(asks.select("cell").distinct(), "cell", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # Both sides can come from the same rows; with names of its own Spark tells the columns of one apart.
    there = there.toDF(*there.columns)
    return asks.groupBy("cell", "part").cogroup(there.groupBy("cell", "part")).applyInArrow(told, schema)


def density_clusters(shapes: DataFrame, eps: float = 0.9, min_samples: int = 10, columns: Sequence[str] = ("cv", "zero_rate", "weekly_amplitude", "peak_ratio", "autocorr_7", "mean_zero_run", "stockout_rate")) -> DataFrame:
    """(series_id, cluster) over standardised columns: -1 for noise, else the least series among the cluster's core points;
    a border point goes to the least of the clusters that it touches. A missing value is the column's mean."""
    d, limit = len(columns), eps * eps
    stats = shapes.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns))
    place = F.array(*(F.coalesce((F.col(c) - F.col(f"_{c}.m")) / F.nullif(F.col(f"_{c}.s"), F.lit(0.0)), F.lit(0.0)) for c in columns))
    pts = written(shapes.crossJoin(F.broadcast(stats)).select("series_id", place.alias("p")))
    spots = written(pts.groupBy("p").agg(F.min("series_id").alias("name"), F.count(F.lit(1)).alias("times")))
    spots = written(blocks(spots, eps, BLOCK))
    box = written(boxes(spots, d))
    near = written(with_boxes(box.select("cell").crossJoin(box.select(F.col("cell").alias("other"))), box, box).filter(gap() <= limit))
    apart = near.filter("cell <> other")

    def around(here: pa.Table) -> pa.Table:
        p, times = points(here["p"], d), here["times"].to_numpy()
        n = np.concatenate([found @ times for _, found in close(p, p, limit)])
        return widened(here, n=pa.array(n, pa.int64()))

    def met(asks: pa.Table, there: pa.Table) -> pa.Table:
        times, y = there["times"].to_numpy(), points(there["p"], d)
        n = [found @ times for _, found in close(points(asks["p"], d), y, limit)]
        return pa.table({"name": asks["name"], "n_met": pa.array(np.concatenate(n) if n else [], pa.int64())})

    counted = written(spots.groupBy("cell").applyInArrow(around, "p array<double>, name string, times long, cell int, n long"))
    few = counted.filter(F.col("n") < min_samples)
    more = answered(asked(few.select("cell", "name", "p"), apart, d, limit), spots, met, "name string, n_met long").groupBy("name").agg(F.sum("n_met").alias("n_met"))
    counted = written(counted.join(more, "name", "left").select("cell", "name", "p", (F.col("n") + F.coalesce("n_met", F.lit(0)) >= min_samples).alias("core")))

    # A group of core points that a block's chains join goes by its least name.
    def joined(here: pa.Table) -> pa.Table:
        here = here.take(pc.sort_indices(here["name"]))
        first = least_linked(points(here["p"], d), limit)
        order = np.argsort(first, kind="stable")
        _, start, size = np.unique(first[order], return_index=True, return_counts=True)
        lead = np.zeros(len(first), bool)
        for s, n in zip(start.tolist(), size.tolist()):
            lead[order[s : s + n : ceil(n / LEADS)]] = True
        return widened(here, node=here["name"].take(pa.array(first)), lead=pa.array(lead))

    def linked(asks: pa.Table, there: pa.Table) -> pa.Table:
        """The pairs of different groups that neighbours link."""
        (a, of_a), (b, of_b) = ((t.unique(), t) for t in (asks["node"], there["node"]))
        i, j = pc.index_in(of_a, a).to_numpy(), pc.index_in(of_b, b).to_numpy()
        hit = np.zeros((len(a), len(b)), bool)
        order = np.argsort(j, kind="stable")
        start = np.flatnonzero(np.diff(j[order], prepend=-1))
        if len(i) and len(j):
            for at, found in close(points(asks["p"], d), points(there["p"], d)[order], limit):
                np.logical_or.at(hit, i[at], np.logical_or.reduceat(found, start, axis=1))
        x, y = np.nonzero(hit)
        both = pa.table({"a": a.take(pa.array(x)), "b": b.take(pa.array(y))})
        return both.filter(pc.not_equal(both["a"], both["b"]))

    core = written(counted.filter("core").drop("core").groupBy("cell").applyInArrow(joined, "cell int, name string, p array<double>, node string, lead boolean").select("cell", "name", "p", "node", "lead"))
    links = lambda asks, there: answered(asks, there, linked, "a string, b string").distinct()
    own = core.select("node").distinct().select(F.col("node").alias("a"), F.col("node").alias("b"))
    roots = written(components(written(own.unionByName(links(asked(core.filter("lead").drop("lead"), apart, d, limit), core)))))

    # Of two points in different components at least one lies outside of the largest: those ask, where other components are.
    rooted = written(core.join(roots, "node").select("cell", "name", "p", F.col("root").alias("node")))
    largest = rooted.groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").limit(1).select(F.col("node").alias("_largest"))
    asks = asked(rooted.join(F.broadcast(largest), F.col("node") == F.col("_largest"), "left_anti"), apart, d, limit)
    sole = rooted.groupBy("cell").agg(F.min("node").alias("_a"), F.max("node").alias("_b"))
    asks = asks.join(F.broadcast(sole), "cell").filter("node <> _a or node <> _b").drop("_a", "_b")
    last = written(links(asks, rooted))
    above = components(last).toDF("node", "root")
    inside = written(rooted.join(above, "node", "left").select("cell", "name", "p", F.coalesce("root", "node").alias("cluster")))

    def touched(asks: pa.Table, there: pa.Table) -> pa.Table:
        there = there.take(pc.sort_indices(there["cluster"]))
        y, least = points(there["p"], d), np.full(len(asks), -1)
        for at, found in close(points(asks["p"], d), y, limit) if len(there) else ():
            least[at] = np.where(found.any(axis=1), found.argmax(axis=1), -1)
        return pa.table({"name": asks["name"], "cluster": there["cluster"].take(pa.array(least, mask=least < 0))})

    border = answered(asked(counted.filter("not core").drop("core"), near, d, limit), inside, touched, "name string, cluster string").groupBy("name").agg(F.min("cluster").alias("cluster"))
    found = inside.select("name", "cluster").unionByName(border).join(spots.select("name", "p"), "name").select("p", "cluster")
    return pts.join(found, "p", "left").select("series_id", F.coalesce("cluster", F.lit("-1")).alias("cluster"))
