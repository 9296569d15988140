"""Hard negatives of anchors, by the threshold algorithm over sorted lists per dimension.

Vectors become integers, floor(scale * x); a score is the inner product with the anchor. A page holds some thousand
vectors and, for each dimension, their order by that component. An anchor reads the lists from their far or near end, as
the sign of its own component asks (dimensions where it is zero add nothing and are not read), scores what it has not
met yet by looking the whole vector up, and knows from the components that it has reached the most that an unread vector
can score: the threshold. It ends in a page when the threshold lies strictly below the k-th score of each of its
windows, or below a window's lower end, so ties are settled by the smaller id. What it found goes with it from page
to page of a run, and the best of all runs are taken at the end. Where the threshold before the first read lies below
all that it holds, nothing of a page is scored.

Two passes: the positives of an anchor, among the rows of its label, and then its negatives, one window for each positive.
Rows are dealt to groups by a hash of their label, a group's to pages by a hash of the row, so a label
that many rows have is many pages, and rare labels share one. Positives are sought in the anchor's group, negatives in all
of them, by blocks of anchors of any label. Anchors meet all rows in blocks: the work grows with anchors x rows where nothing can be left out, as it must.

Rows: those with a null id, label or vector or a null or non-finite component take no part; vectors are compared with
those of equal length, empty ones score 0; rows that are equal in id, label and vector are one row; where rows share an
id, each is a row (and an anchor), but an anchor's partners have other ids; fewer partners than asked for are all
returned, and anchors without a positive have no rows; an empty table gives an empty result. Components
are exact up to 2**62 after scaling and scores up to 2**63; beyond that the job fails with an overflow error. Only the
named columns are read, so others can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.metric_search import unpacked
from stallwise.llm.shared import cut_lineage


@dataclass(frozen=True)
class Params:
    scale: int = 256
    positives: int = 5
    negatives: int = 10
    #: A negative's score is at least so many percent of the positive's, and at most so many.
    least_percent: int = 30
    most_percent: int = 90
    groups: int = 64
    page_rows: int = 8192
    #: Pages that a block of anchors visits one after the other.
    run_pages: int = 4
    block_anchors: int = 256
    #: Entries of each list read at first; each further read doubles what has been read.
    first_read: int = 16


def rows_of(vectors: DataFrame, params: Params, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(id, label, dim, vec): valid rows once each, vectors as little-endian integers, of 32 bits if all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, own, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if i is None or own is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy()
                if np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        v = np.floor(params.scale * v)
                    most = np.abs(v).max(initial=0)
                    if most >= 2.0**62:
                        raise OverflowError(f"a component of vector {i} is beyond 62 bits after scaling")
                    rows.append((i, own, len(v), v.astype("<i4" if most < 2.0**31 else "<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["id", "label", "dim", "vec"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).mapInArrow(run, "id long, label long, dim int, vec binary").distinct()


def products(vecs: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of integer rows with an anchor, exact or an error."""
    most = float(np.abs(vecs).max(initial=0)) * float(np.abs(anchor).max(initial=0)) * max(1, len(anchor))
    if most >= 2.0**63:
        raise OverflowError("a score is beyond 63 bits")
    return (vecs.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64) if most < 2.0**53 else vecs @ anchor


@dataclass
class Page:
    """Vectors with, for each dimension, their order by that component, ascending."""

    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray
    order: np.ndarray

    def __post_init__(self) -> None:
        # Doubles where all products are exact in them; the check of each anchor's own size is in `scored`.
        self.most = float(np.abs(self.vecs).max(initial=0))
        self.wide = self.vecs.astype(np.float64)

    def scored(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(anchor).sum(dtype=np.float64)) < 2.0**53:
            return (self.wide[at] @ anchor.astype(np.float64)).astype(np.int64)
        return products(self.vecs[at], anchor)

    def threshold(self, anchor: np.ndarray, used: np.ndarray, depth: int) -> int:
        """The most that a vector can score which is not among the first `depth` of any list that is read."""
        n = len(self.ids)
        at = np.where(anchor[used] > 0, n - 1 - min(depth, n - 1), min(depth, n - 1))
        reached = self.vecs[self.order[at, used], used]
        return sum(int(a) * int(x) for a, x in zip(anchor[used], reached))


@dataclass
class Best:
    """What an anchor holds: scores and ids of rows that can be among the first k of one of its windows (lo, hi)."""

    windows: list[tuple[int | None, int | None]]
    k: int
    scores: np.ndarray
    ids: np.ndarray

    def first(self, window: tuple) -> slice:
        """The first k held rows of a window; rows are held by falling score, then by id."""
        lo, hi = window
        start = 0 if hi is None else int(np.searchsorted(-self.scores, -hi, "left"))
        stop = len(self.scores) if lo is None else int(np.searchsorted(-self.scores, -lo, "right"))
        return slice(start, max(start, min(stop, start + self.k)))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes rows in and keeps those that count in a window."""
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        by = np.lexsort((ids, -scores))
        self.scores, self.ids = scores[by], ids[by]
        keep = np.zeros(len(by), bool)
        for w in self.windows:
            keep[self.first(w)] = True
        self.scores, self.ids = self.scores[keep], self.ids[keep]

    def done(self, threshold: int) -> bool:
        """True if no row that scores at most so much can count."""
        for w in self.windows:
            lo, hi = w
            if lo is not None and (threshold < lo or (hi is not None and hi < lo)):
                continue
            own = self.first(w)
            if own.stop - own.start < self.k or threshold >= self.scores[own.stop - 1]:
                return False
        return True


def read(page: Page, anchor: np.ndarray, own_id: int, label: int, alike: bool, best: Best, first_read: int) -> int:
    """Brings an anchor's best up to date with a page's rows of its label, or of other labels. Returns how many rows were scored."""
    n, met = len(page.ids), (page.labels == label) == alike
    used, unread, depth, scored = np.flatnonzero(anchor), met & (page.ids != own_id), 0, 0
    if not unread.any():
        return 0
    if not len(used):  # every row scores 0
        if not best.done(0):
            at = np.flatnonzero(unread)
            best.add(np.zeros(len(at), np.int64), page.ids[at])
            scored = len(at)
        return scored
    falling = anchor[used] > 0
    while depth < n and not best.done(page.threshold(anchor, used, depth)):
        ahead = min(n, max(first_read, 2 * depth))
        lists = np.concatenate((page.order[n - ahead : n - depth, used[falling]].ravel(), page.order[depth:ahead, used[~falling]].ravel()))
        fresh = np.zeros(n, bool)
        fresh[lists] = True
        at = np.flatnonzero(fresh & unread)
        unread[at] = False
        scored += len(at)
        if len(at):
            scores = page.scored(at, anchor)
            can = np.zeros(len(at), bool)
            for lo, hi in best.windows:
                can |= (scores >= lo if lo is not None else True) & (scores <= hi if hi is not None else True)
            best.add(scores[can], page.ids[at[can]])
        depth = ahead
    return scored


PAGE = "grp int, dim int, run int, page int, ids binary, labels binary, wide boolean, vecs binary, order binary"


def dealt(rows: DataFrame, name: str, most: int) -> DataFrame:
    """rows with their number among the group's shares of at most about `most` rows, by a hash of the row."""
    n = rows.groupBy("grp", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("shares"))
    return rows.join(n, ["grp", "dim"]).withColumn(name, F.pmod(F.xxhash64("vec", "id", "label"), F.col("shares")).cast("int")).drop("shares")


def pages(rows: DataFrame, params: Params) -> DataFrame:
    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        grp, dim, page = (int(x) for x in key)
        vecs = unpacked(list(own["vec"]), dim)
        # Places within a page, in two bytes where they fit.
        order = np.argsort(vecs, axis=0, kind="stable").astype(np.uint16 if len(vecs) <= 1 << 16 else np.int32)
        wide = bool(np.abs(vecs).max(initial=0) >= 1 << 31)
        packed = own["id"].to_numpy(np.int64).tobytes(), own["label"].to_numpy(np.int64).tobytes(), wide, vecs.astype("<i8" if wide else "<i4").tobytes(), order.tobytes()
        return pd.DataFrame([[grp, dim, page // params.run_pages, page, *packed]], columns=[c.split()[0] for c in PAGE.split(", ")])

    return dealt(rows, "page", params.page_rows).groupBy("grp", "dim", "page").applyInPandas(build, PAGE)


def page_of(row) -> Page:
    ids = np.frombuffer(row.ids, np.int64)
    shape = (len(ids), row.dim)
    return Page(ids, np.frombuffer(row.labels, np.int64), np.frombuffer(row.vecs, "<i8" if row.wide else "<i4").reshape(shape).astype(np.int64), np.frombuffer(row.order, np.uint16 if len(ids) <= 1 << 16 else np.int32).reshape(shape))


MET = "anchor binary, anchor_id long, label long, window int, score long, id long, scored long"


def meet(anchors: DataFrame, paged: DataFrame, pairs: DataFrame, alike: bool, k: int, params: Params) -> DataFrame:
    """For each anchor's windows the best rows of each run of pages; pairs: which block of anchors meets which run."""

    def run(key: tuple, own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        dim, found = int(key[1]), []
        vecs = unpacked(list(own["vec"]), dim) if len(own) else []
        # An open end of a window comes as NaN.
        held = [Best([tuple(None if end is None or end != end else int(end) for end in w) for w in ws], k, np.zeros(0, np.int64), np.zeros(0, np.int64)) for ws in own["windows"]]
        scored = [0] * len(held)
        for row in met.sort_values("page").itertuples():
            page = page_of(row)
            for i, (vec, own_id, label) in enumerate(zip(vecs, own["id"], own["label"])):
                scored[i] += read(page, vec, own_id, label, alike, held[i], params.first_read)
        for vec, own_id, label, best, n in zip(own["vec"], own["id"], own["label"], held, scored):
            for at, window in enumerate(best.windows):
                s = best.first(window)
                found += [(vec, own_id, label, at, score, i, n) for score, i in zip(best.scores[s], best.ids[s])]
        return pd.DataFrame(found, columns=[c.split()[0] for c in MET.split(", ")])

    keys = ["grp", "dim", "block", "to_grp", "run"]
    left = anchors.join(pairs, ["grp", "dim", "block"])
    right = paged.withColumnRenamed("grp", "to_grp").join(pairs, ["to_grp", "dim", "run"])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, MET)


def first(met: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window over all runs, numbered from 1."""
    window = Window.partitionBy("anchor_id", "anchor", "label", "window").orderBy(F.desc("score"), "id", "copy")
    # Rows of one id and score are rows of their own; what tells them apart is of no weight.
    return met.withColumn("copy", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).drop("copy")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, params: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: of the column id, label: of the columns of vectors."""
    rows = cut_lineage(rows_of(vectors, params, id_col, vec_col, label).withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(params.groups)).cast("int")))
    paged = cut_lineage(pages(rows, params))
    anchors = cut_lineage(dealt(rows.filter(is_anchor), "block", params.block_anchors))
    blocks, runs = anchors.select("grp", "dim", "block").distinct(), paged.select(F.col("grp").alias("to_grp"), "dim", "run").distinct()
    # Which blocks meet which runs: numbers only, of blocks of rows on either side. Positives are in the anchor's group.
    own = cut_lineage(blocks.join(runs, "dim").filter("grp = to_grp"))
    everything = F.array(F.array(F.lit(None).cast("long"), F.lit(None).cast("long")))
    alike = meet(anchors.withColumn("windows", everything), paged, own, True, params.positives, params)
    positives = cut_lineage(first(alike, params.positives))

    # lo = ceil(least * score / 100), hi = floor(most * score / 100), in decimals, which hold any long times a hundred.
    score = F.col("score").cast("decimal(20,0)")
    lo, hi = F.ceil(score * params.least_percent / 100).cast("long"), F.floor(score * params.most_percent / 100).cast("long")
    windows = positives.groupBy(F.col("anchor").alias("vec"), F.col("anchor_id").alias("id"), "label").agg(F.sort_array(F.collect_list(F.struct("rank", F.array(lo, hi).alias("w")))).alias("ws"))
    # Negatives are in all groups, so that the anchors of all groups share blocks, and a page is sent to as few as can be.
    seekers = anchors.join(windows, ["vec", "id", "label"]).select(F.lit(0).alias("grp"), "dim", "id", "label", "vec", F.col("ws.w").alias("windows"))
    seekers = cut_lineage(dealt(seekers, "block", params.block_anchors))
    met = cut_lineage(seekers.select("grp", "dim", "block").distinct().join(runs, "dim"))
    other = meet(seekers, paged, met, False, params.negatives, params)
    negatives = first(other, params.negatives)
    known = positives.select("anchor", "anchor_id", "label", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = negatives.join(known, ["anchor", "anchor_id", "label", "window"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The query's contract in SQL: every row against every anchor.
ORACLE = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.own = b.own AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10
"""
