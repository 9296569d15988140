"""Exact top-k by inner product, with M-tree best-first search.

Vectors become integers, floor(scale * x). One added coordinate makes all of them equally long, so that the
order by inner product is the order by Euclidean distance to the query, which is a metric. The index is an
M-tree in pages: regions around pivots, below them pages of bounded size, in a page leaves that splitting on
distance has made, each with a routing object, a covering radius and its stored distance to the pivot, and in a leaf
the objects in order of their stored distance to the routing object.

A query looks into a page of its nearest region first. The k-th best score there bounds how far an object can be
and still count, so the query is then sent on only to regions that its bound cannot exclude. Within a page a leaf is
left out, with no distance computed, when |d(query, pivot) - d(pivot, routing object)| - radius is beyond the bound;
objects are left out by their stored distances in the same way, each query by its own bound. What is left is scored
exactly, in order of the bounds. Bounds are loosened by more than their rounding, so the result is exact, ties
included. Queries of near regions travel in blocks, so where nothing can be left out a page is sent once for each
block of `block_queries`, and a query once for each page of `page_rows`.

Pivots come from about `sample` vectors (by a hash threshold), every vector is indexed. Of equal vectors the k + 1
with the smallest ids are kept, as no more can be in a result; so copies, however many, weigh nothing.

Rows: vectors that are null, or hold null or non-finite components take no part, nor do null ids; vectors are
compared only with those of equal length, empty ones (score 0) with each other; repeated rows (equal id and vector)
are one; where one id has several vectors, the best of them counts for the id. Queries with fewer candidates return what there is.
Large components are held exactly up to 2**62 after scaling, and scores up to 2**63; beyond that the job fails,
with an overflow error. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.shared import cut_lineage


@dataclass(frozen=True)
class Params:
    scale: int = 1024
    k: int = 10
    sample: int = 4096
    #: Vectors of a region, roughly, and the most regions there are.
    region_rows: int = 4096
    regions: int = 1024
    page_rows: int = 4096
    leaf_rows: int = 64
    block_queries: int = 1024


#: Integers below this are exact as doubles.
EXACT = 2.0**53


def integers(vectors: DataFrame, params: Params, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, norm, vec): valid vectors as little-endian integers, of 32 bits if all fit; norm is the squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy()
                if np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        v = np.floor(params.scale * v)
                    most = np.abs(v).max(initial=0)
                    if most >= 2.0**62:
                        raise OverflowError(f"a component of vector {i} is beyond 62 bits after scaling")
                    rows.append((i, len(v), float(v @ v), v.astype("<i4" if most < 2.0**31 else "<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64(), pa.binary()))], names=["id", "dim", "norm", "vec"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<double>")).mapInArrow(run, "id long, dim int, norm double, vec binary")


def unpacked(vecs, dim: int) -> np.ndarray:
    """Rows of equal length, as 64-bit integers."""
    if all(len(v) == 4 * dim for v in vecs):
        return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), dim).astype(np.int64)
    return np.array([np.frombuffer(v, "<i4" if len(v) == 4 * dim else "<i8") for v in vecs], np.int64).reshape(len(vecs), dim)


def lifted(vecs: np.ndarray, top: float) -> np.ndarray:
    """With the coordinate that makes every vector as long as the longest."""
    vecs = vecs.astype(np.float64)
    return np.column_stack([vecs, np.sqrt(np.maximum(top - (vecs * vecs).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of n points."""
    chosen = points[:1]
    near = distances(points, chosen)[:, 0]
    while len(chosen) < min(n, len(points)) and near.max() > 0:
        chosen = np.vstack([chosen, points[near.argmax()]])
        near = np.minimum(near, distances(points, chosen[-1:])[:, 0])
    return chosen


def leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of the points by leaf: groups are split between two far points, at the median, until they fit."""
    done, open_ = [], [np.arange(len(points))]
    while open_:
        at = open_.pop()
        if len(at) <= most:
            done.append(at)
            continue
        own = points[at]
        a = distances(own, own[:1])[:, 0].argmax()
        to_a = distances(own, own[a : a + 1])[:, 0]
        b = to_a.argmax()
        order = np.argsort(to_a - distances(own, own[b : b + 1])[:, 0], kind="stable")
        open_ += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return done


@dataclass(frozen=True)
class Frame:
    """For vectors of one length: the longest squared length, pivots, and by region how near and how far from its
    pivot its objects are, and its number of pages."""

    top: float
    pivots: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    pages: np.ndarray


def placed(rows: DataFrame, shared) -> DataFrame:
    """rows with region, the nearest pivot's, and the distance to that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                dims, vecs = part.column("dim").to_numpy(), part.column("vec").to_pylist()
                region, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
                for dim in np.unique(dims):
                    at, (top, pivots) = np.flatnonzero(dims == dim), shared.value[int(dim)]
                    d = distances(lifted(unpacked([vecs[i] for i in at], int(dim)), top), pivots)
                    region[at], away[at] = d.argmin(axis=1), d.min(axis=1)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("id", "dim", "vec")), pa.array(region), pa.array(away)], names=["id", "dim", "vec", "region", "away"])

    return rows.select("id", "dim", "vec").mapInArrow(run, "id long, dim int, vec binary, region int, away double")


def pivots_of(rows: DataFrame, params: Params) -> dict[int, tuple[float, np.ndarray]]:
    """By length of vectors: the longest squared length, and pivots from the sample."""
    about = {r["dim"]: (r["n"], r["top"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()}
    share = min(1.0, params.sample / max(1, sum(n for n, _ in about.values())))
    picked = rows.filter(F.pmod(F.xxhash64("vec", "id"), F.lit(1 << 30)) < share * (1 << 30)).select("dim", "id", "vec").orderBy("dim", "id", "vec").toArrow().to_pandas()
    found = {}
    for dim, (n, top) in about.items():
        own = picked[picked["dim"] == dim]["vec"]
        vecs = unpacked(list(own), dim) if len(own) else np.zeros((1, dim), np.int64)
        found[dim] = top, spread(lifted(vecs, top), min(params.regions, max(1, -(-n // params.region_rows))))
    return found


PAGE = "dim int, region int, page int, sizes binary, radii binary, to_pivot binary, routers binary, dists binary, ids binary, vecs binary"


def pages(located: DataFrame, frames, params: Params) -> DataFrame:
    """A row for each page."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, region, page = (int(x) for x in key)
        frame = frames.value[dim]
        vecs = unpacked(list(rows["vec"]), dim)
        points, ids = lifted(vecs, frame.top), rows["id"].to_numpy(np.int64)
        sizes, radii, routers, dists, order = [], [], [], [], []
        for at in leaves(points, params.leaf_rows):
            router = points[at][distances(points[at], points[at].mean(axis=0)[None, :])[:, 0].argmin()]
            d = distances(points[at], router[None, :])[:, 0]
            by = np.argsort(d, kind="stable")
            sizes.append(len(at))
            radii.append(d.max())
            routers.append(router)
            dists.append(d[by])
            order.append(at[by])
        order, routers = np.concatenate(order), np.array(routers)
        to_pivot = distances(routers, frame.pivots[region : region + 1])[:, 0]
        packed = (np.array(sizes, np.int64), np.array(radii), to_pivot, routers, np.concatenate(dists), ids[order])
        wide = np.abs(vecs).max(initial=0) >= 1 << 31
        return pd.DataFrame([[dim, region, page, *(x.tobytes() for x in packed), vecs[order].astype("<i8" if wide else "<i4").tobytes()]], columns=[c.split()[0] for c in PAGE.split(", ")])

    counts = located.groupBy("dim", "region").count().select("dim", "region", F.ceil(F.col("count") / F.lit(params.page_rows)).alias("pages"))
    dealt = located.join(counts, ["dim", "region"]).withColumn("page", F.pmod(F.xxhash64("vec", "id"), F.col("pages")).cast("int"))
    return dealt.select("dim", "region", "page", "id", "vec").groupBy("dim", "region", "page").applyInPandas(build, PAGE)


def blocks_of(pivots: np.ndarray, counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """By home region: the first block of its queries and their number of blocks. Near regions with few queries share
    a block: regions are taken in a chain of nearest neighbours."""
    left, found, at, block, held = set(counts), {}, None, -1, most
    while left:
        order = sorted(left)
        at = order[0] if at is None else order[int(distances(pivots[order], pivots[at : at + 1])[:, 0].argmin())]
        left.remove(at)
        if held >= most or counts[at] >= most:
            block, held = block + 1, 0
        n = -(-counts[at] // most)
        found[at] = block, n
        block, held = block + n - 1, held + counts[at] if n == 1 else most
    return found


class Best:
    """The best so far of each query, an id once with the best of its vectors."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor, self.scored = k, floor, 0
        self.scores: list[np.ndarray] = [np.zeros(0)] * len(floor)
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(floor)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])[: self.k]]
        self.scores[q], self.ids[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], scores[order[-1]])


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, page, frame: Frame, k: int) -> Best:
    """Best-first over the leaves of a page, for queries of one length whose scores are exact as doubles."""
    dim = queries.shape[1]
    sizes, radii, to_pivot = np.frombuffer(page.sizes, np.int64), np.frombuffer(page.radii), np.frombuffer(page.to_pivot)
    routers, stored_all, ids_all = np.frombuffer(page.routers).reshape(len(sizes), -1), np.frombuffer(page.dists), np.frombuffer(page.ids, np.int64)
    vecs = np.frombuffer(page.vecs, "<i4" if len(page.vecs) == 4 * dim * len(ids_all) else "<i8").reshape(len(ids_all), dim)
    stops = np.cumsum(sizes)
    queries = queries.astype(np.float64)
    norms = (queries * queries).sum(axis=1)
    points = np.column_stack([queries, np.zeros(len(queries))])
    best = Best(floor.copy(), k)
    slack = 1e-6 * (1 + np.sqrt(norms.max(initial=0) + frame.top))

    def reach() -> np.ndarray:
        """How far from each query an object can be and still count."""
        return np.sqrt(np.maximum(norms + frame.top - 2 * (best.floor - 1), 0)) + slack

    pivot = distances(points, frame.pivots[page.region : page.region + 1])
    lower = np.maximum(np.abs(pivot - to_pivot[None, :]) - radii[None, :], 0)
    for leaf in np.argsort(lower.min(axis=0, initial=np.inf), kind="stable"):
        live = np.flatnonzero(lower[:, leaf] <= reach())
        if not len(live):
            continue
        d, far = distances(points[live], routers[leaf : leaf + 1])[:, 0], reach()[live]
        near = d - radii[leaf] <= far
        live, d, far = live[near], d[near], far[near]
        if not len(live):
            continue
        start, stop = stops[leaf] - sizes[leaf], stops[leaf]
        stored = stored_all[start:stop]
        a, b = np.searchsorted(stored, d - far, side="left"), np.searchsorted(stored, d + far, side="right")
        own = vecs[start + a.min() : start + b.max()].astype(np.float64)
        ids = ids_all[start + a.min() : start + b.max()]
        at = np.arange(a.min(), b.max())
        within = (at >= a[:, None]) & (at < b[:, None])
        if 2 * within.sum() >= within.size:
            scores = queries[live] @ own.T
        else:  # few objects each
            scores = np.zeros(within.shape)
            for row, (i, j) in enumerate(zip(a - a.min(), b - a.min())):
                scores[row, i:j] = own[i:j] @ queries[live[row]]
        best.scored += int(within.sum())
        hits = within & (scores >= best.floor[live][:, None]) & (query_ids[live][:, None] != ids[None, :])
        for row in np.flatnonzero(hits.any(axis=1)):
            got = np.flatnonzero(hits[row])
            best.add(int(live[row]), scores[row, got], ids[got])
    return best


def long_scores(query: np.ndarray, query_id: int, page, k: int) -> tuple[list[int], list[int]]:
    """Ids and scores of the best of a page, for a query whose scores may be beyond the doubles' exact integers."""
    ids = np.frombuffer(page.ids, np.int64)
    vecs = np.frombuffer(page.vecs, "<i4" if len(page.vecs) == 4 * len(query) * len(ids) else "<i8").reshape(len(ids), -1)
    scores = vecs.astype(object) @ query.astype(object)
    most: dict[int, int] = {}
    for s, i in zip(scores, ids.tolist()):
        if i != query_id:
            most[i] = max(s, most.get(i, s))
    best = sorted((-s, i) for i, s in most.items())[:k]
    return [i for _, i in best], [-s for s, _ in best]


HITS = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries: DataFrame, params: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k best rows of vectors, but the query's own id."""
    context = vectors.sparkSession.sparkContext
    rows = integers(vectors, params, id_col, vec_col)
    few = Window.partitionBy("dim", "vec").orderBy("id")
    rows = cut_lineage(rows.distinct().withColumn("at", F.row_number().over(few)).filter(F.col("at") <= params.k + 1).drop("at"))
    chosen = pivots_of(rows, params)
    pivots = context.broadcast(chosen)
    located = placed(rows, pivots)
    # A row for each pivot at most.
    about = located.groupBy("dim", "region").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect()
    by_dim = {}
    for dim, (top, points) in chosen.items():
        near, far, n_pages = np.full(len(points), np.inf), np.full(len(points), -np.inf), np.zeros(len(points), np.int64)
        for r in about:
            if r["dim"] == dim:
                near[r["region"]], far[r["region"]], n_pages[r["region"]] = r["near"], r["far"], -(-r["n"] // params.page_rows)
        by_dim[dim] = Frame(top, points, near, far, n_pages)
    frames = context.broadcast(by_dim)
    index = cut_lineage(pages(located, frames, params))

    # Queries of a length that no vector has, have no candidates.
    asked = integers(queries, params, id_col, vec_col).distinct().filter(F.col("dim").isin(list(chosen)))
    homes = placed(asked, pivots).withColumnRenamed("region", "home")
    # A row for each pivot at most.
    counts = homes.groupBy("dim", "home").count().collect()
    blocks = context.broadcast({dim: blocks_of(frame.pivots, {r["home"]: r["count"] for r in counts if r["dim"] == dim}, params.block_queries) for dim, frame in by_dim.items()})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, home = (batch.column(n).to_pylist() for n in ("id", "dim", "home"))
            at = [blocks.value[d][h] for d, h in zip(dims, home)]
            block = [first + hash(i) % n for i, (first, n) in zip(ids, at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "dim", "vec", "home")), pa.array(block, pa.int32())], names=["id", "dim", "vec", "home", "block"])

    homes = cut_lineage(homes.select("id", "dim", "vec", "home").mapInArrow(dealt, "id long, dim int, vec binary, home int, block int"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from needs({(d, b, h, b % int(frames.value[d].pages[h])) for d, h, b in zip(*(batch.column(n).to_pylist() for n in ("dim", "home", "block"))) if frames.value[d].pages[h]})

    def needs(found: set) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*sorted(found))], names=["dim", "block", "region", "page"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages that the bound of a query of the block doesn't exclude."""
        for batch in batches:
            dims, found = batch.column("dim").to_numpy(), set()
            block, vecs = (batch.column(n).to_pylist() for n in ("block", "vec"))
            floors = np.array([-np.inf if f is None else float(f) for f in batch.column("floor").to_pylist()])
            for dim in np.unique(dims):
                frame, at = frames.value[int(dim)], np.flatnonzero(dims == dim)
                points = unpacked([vecs[i] for i in at], int(dim)).astype(np.float64)
                norms = (points * points).sum(axis=1)
                reach = np.sqrt(np.maximum(norms + frame.top - 2 * (floors[at] - 1), 0)) * (1 + 1e-6) + 1e-6 * (1 + np.sqrt(norms + frame.top))
                d = distances(np.column_stack([points, np.zeros(len(points))]), frame.pivots)
                live = (d - frame.farthest[None, :] <= reach[:, None]) & (frame.nearest[None, :] - d <= reach[:, None])
                groups: dict[int, np.ndarray] = {}
                for row, i in enumerate(at):
                    groups[block[i]] = groups[block[i]] | live[row] if block[i] in groups else live[row]
                for b, to in groups.items():
                    found |= {(int(dim), b, int(r), p) for r in np.flatnonzero(to) for p in range(int(frame.pages[r]))}
            yield from needs(found)

    def run(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        page, dim = next(index.itertuples()), int(key[0])
        frame, ids, vecs = frames.value[dim], asked["id"].to_numpy(np.int64), unpacked(list(asked["vec"]), dim)
        floor = asked["floor"].astype(float).fillna(-np.inf).to_numpy()
        long = np.sqrt((vecs.astype(np.float64) ** 2).sum(axis=1)) * np.sqrt(frame.top) * 1.001 >= EXACT
        at = np.flatnonzero(~long)
        best = search(vecs[at], ids[at], floor[at], page, frame, params.k)
        out = [(np.repeat(ids[at], [len(x) for x in best.ids]).tolist(), np.concatenate([np.zeros(0, np.int64), *best.ids]).tolist(), np.concatenate([np.zeros(0), *best.scores]).astype(np.int64).tolist())]
        for i in np.flatnonzero(long):
            found, scores = long_scores(vecs[i], int(ids[i]), page, params.k)
            if any(not -(2**63) <= s < 2**63 for s in scores):
                raise OverflowError(f"a score of query {ids[i]} is beyond 64 bits")
            out.append(([int(ids[i])] * len(found), found, scores))
        whose, found, scores = ([x for part in out for x in part[k]] for k in range(3))
        return pd.DataFrame({"query_id": np.array(whose, np.int64), "vec_id": np.array(found, np.int64), "score": np.array(scores, np.int64)})

    place, need = ["dim", "region", "page"], "dim int, block int, region int, page int"
    keys = ["dim", "block", "region", "page"]

    def hits(asked: DataFrame, wanted: DataFrame) -> DataFrame:
        left = index.join(wanted, place)
        right = asked.join(wanted, ["dim", "block"])
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, HITS)

    unknown = homes.withColumn("floor", F.lit(None).cast("long"))
    near = cut_lineage(hits(unknown, homes.mapInArrow(first, need).distinct()))
    floors = near.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= params.k)
    bounded = homes.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left")
    found = near.union(hits(bounded, bounded.mapInArrow(others, need).distinct()))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    unique = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return unique.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= params.k).select("query_id", "rank", "vec_id", "score")
