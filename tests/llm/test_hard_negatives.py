"""Hard negatives against scoring every row with every anchor."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<double>, label long, score string, id string, window string"


def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def plain(rows, positives=5, negatives=10):
    own = set()
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * c) for c in x)))
    found = []
    for i, label, v in own:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in own if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            near = sorted(r for r in scored if r[2] != label and 30 * -p <= 100 * -r[0] <= 90 * -p)[:negatives]
            found += [(i, pid, rank, nid, -p, -s) for rank, (s, nid, _) in enumerate(near, 1)]
    return sorted(found)


def mined(spark, rows, params=hard.Params()):
    frame = spark.createDataFrame([(*r, "s", "i", "w") for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, hard.mine(frame, F.col("id") % 100 == 0, moved(), params).collect()))


def vectors(rng, n, dim=6, labels=3):
    """Vectors around few centres with many ties and equal ones, and rows that take no part."""
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i * rng.choice([1, 1, 5]), [round(x + rng.gauss(0, 0.2), 1) for x in c], rng.randrange(labels)))
    rows += [(700, [0.0] * dim, 1), (800, [0.5] * dim, None), (900, None, 1), (1000, [1.0, None] + [0.0] * (dim - 2), 1), (1100, [float("nan")] * dim, 1), (1200, [float("inf")] * dim, 2), (None, [0.1] * dim, 0)]
    rows += [(1300, [], 1), (1301, [], 1), (1302, [], 2), (1400, [1.0, 2.0], 1), (1401, [1.0, 2.5], 1), (1402, [0.4, 0.4], 2)]
    rows += [(1500, [1.0] * dim, 0), (1501, [0.9] * dim, 0), (1500, [1.0] * dim, 0)] + [(1600 + k, [0.5] * dim, 1) for k in range(30)]
    return rows + [(1502, [0.1 * k] * dim, 2) for k in range(8)]


@pytest.mark.parametrize("params", [hard.Params(), hard.Params(page_rows=20, run_pages=2, block_anchors=2, groups=2, first_read=1)])
def test_negatives_are_those_of_all_rows(spark, params):
    rows = vectors(random.Random(4), 400)
    found, want = mined(spark, rows, params), plain(rows)
    assert found == want and len(want) > 50


def test_large_components_and_overflow(spark):
    rows = [(0, [2.0**30, 1.0], 0), (1, [1024.0, 1.0], 1), (2, [512.0, 3.0], 2), (3, [500.0, 3.0], 2)]
    assert mined(spark, rows) == plain(rows) != []
    with pytest.raises(Exception, match="beyond 62 bits"):
        mined(spark, [(0, [2.0**60, 1.0], 1)])


def test_an_empty_table_and_anchors_without_partners(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 2)]) == []


def test_reading_ends_early_on_clusters_and_is_exact():
    """The threshold spares most rows where vectors lie in clusters; a page's result equals that of all its rows."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(400, 4)) * 4
    vecs = np.floor(256 * (centres[rng.integers(0, 400, 4000)] + rng.normal(size=(4000, 4)) * 0.05)).astype(np.int64)
    page = hard.Page(np.arange(4000), rng.integers(0, 2, 4000), vecs, np.argsort(vecs, axis=0, kind="stable").astype(np.int32))
    scored = 0
    for i in range(0, 4000, 100):
        best = hard.Best([(None, None)], 5, np.zeros(0, np.int64), np.zeros(0, np.int64))
        scored += hard.read(page, vecs[i], i, page.labels[i], True, best, 16)
        every = sorted((-int(vecs[j] @ vecs[i]), j) for j in range(4000) if j != i and page.labels[j] == page.labels[i])[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == every
    assert scored < 0.3 * 40 * 2000
    done = hard.Best([(None, None)], 5, np.full(5, 10**9), np.arange(5))
    assert hard.read(page, vecs[0], 0, 0, True, done, 16) == 0


def test_the_query_agrees_with_its_sql(spark):
    import duckdb

    from stallwise.llm import queries

    name = "op12_hard_negatives"
    path = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, path)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
