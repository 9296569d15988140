"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are compared only where they meet at an anchor. The anchors are the words of a covering
code: on each of two blocks of 23 bits the binary Golay code, whose words cover all of the block within radius
3; the other bits are free. A fingerprint's home is its nearest anchor. Each fingerprint is replicated to every
anchor within the covering radius plus the threshold that a neighbour of it can have as its home, so of two
fingerprints that differ in at most `threshold` bits, each reaches the other's home, and all pairs are found.

Equal fingerprints are one node, so groups of copies don't add to an anchor. At an anchor, homes meet
replicas; a crowded one is compared by looking up all neighbours of a home within the threshold, which is
linear in the anchor's rows, and links leave as a spanning forest. Components come from components.stars.

Rows: null text and text without a word have fingerprint zero; a text of one or two words is one shingle; very
long texts are hashed in blocks; rows with a null doc_id get a fingerprint but add no link, and take the
component of an equal fingerprint (null without one); repeated rows share fingerprint and component; an empty
table gives an empty result. Only the two named columns are read, so others can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.components import stars
from stallwise.llm.shared import cut_lineage, give_back

SEED = 42
BITS = 23
#: Generator polynomial of the binary Golay code (23, 12).
GOLAY = 0b101011100011
#: Lowest bits of the blocks in a fingerprint.
BLOCKS = (0, BITS)
MASK = (1 << BITS) - 1


def fingerprint(data: bytes | None, shingle: int = 3) -> int:
    words = data.lower().split() if data else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_digest
    counts, block = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(starts), block):
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + block], stops[at : at + block])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("data")).mapInArrow(run, "doc_id long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the code's polynomial: equal for words that differ by a code word."""
    left = words.copy()
    for k in range(BITS - 1, 10, -1):
        left ^= np.where((left >> k) & 1, GOLAY << (k - 11), 0)
    return left


@cache
def code() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """leaders: by syndrome, the pattern of at most 3 bits from the nearest code word. turns[t][syndrome]: the
    code words to add to the home so as to get the homes of all words t bits off and not of any nearer one."""
    single = 1 << np.arange(BITS)
    two = np.array([a | b for i, a in enumerate(single) for b in single[i + 1 :]])
    three = np.array([a | b for a in two for b in single if b > a & -a and not a & b and b > (a & (a - 1))])
    leaders = np.full(1 << 11, -1)
    for near in (three, two, single, np.zeros(1, np.int64)):
        leaders[syndromes(near)] = near
    turns: list[list[np.ndarray]] = [[np.zeros(1, np.int64)] * len(leaders), [], []]
    for t, flips in ((1, single), (2, two)):
        for leader in leaders:
            off = leader ^ flips
            homes = np.setdiff1d(off ^ leaders[syndromes(off)], [0])
            turns[t].append(homes if t == 1 else np.setdiff1d(homes, turns[1][len(turns[2])]))
    return leaders, turns


def ragged(lists: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lists[k] for each of keys, one after the other, and the position in keys that each value came from."""
    sizes, flat = np.array([len(x) for x in lists]), np.concatenate(lists)
    starts, n = np.cumsum(sizes) - sizes, sizes[keys]
    owner = np.repeat(np.arange(len(keys)), n)
    return flat[starts[keys][owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]], owner


def anchors(fps: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of each fingerprint (home first among its own) and the row that each came from."""
    leaders, turns = code()
    parts = [(fps.view(np.uint64) >> np.uint64(low)).astype(np.int64) & MASK for low in BLOCKS]
    signs = [syndromes(p) for p in parts]
    homes = [p ^ leaders[s] for p, s in zip(parts, signs)]
    found, owners = [], []
    for t1 in range(threshold + 1):
        first, own = ragged(turns[t1], signs[0])
        for t2 in range(threshold + 1 - t1):
            second, at = ragged(turns[t2], signs[1][own])
            found.append((homes[0][own[at]] ^ first[at]) << BITS | (homes[1][own[at]] ^ second))
            owners.append(own[at])
    return np.concatenate(found), np.concatenate(owners)


def replicas(nodes: DataFrame, threshold: int) -> DataFrame:
    """(anchor, fp, node, home) of rows (fp, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                fps, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
                at, own = anchors(fps, threshold)
                home = np.arange(len(at)) < len(fps)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(fps[own]), pa.array(ids[own]), pa.array(home)], names=["anchor", "fp", "node", "home"])

    return nodes.select("fp", "node").mapInArrow(run, "anchor long, fp long, node long, home boolean")


def near(threshold: int) -> np.ndarray:
    """All patterns of 1 to threshold bits."""
    found = [0]
    for _ in range(threshold):
        found = sorted({x ^ (1 << k) for x in found for k in range(64)} | set(found))
    return np.array(found[1:], np.uint64)


#: Pairs of an anchor that are compared one with the other; beyond them, neighbours are looked up.
DIRECT = 1 << 21


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links among positions below n that join what was apart."""
    root, links = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            links.append((x, y))
    return links


def crowd(fps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of one anchor's rows, as a forest."""
    homes, links = np.flatnonzero(home), []
    step = max(1, DIRECT // len(fps))
    if len(homes) * len(fps) <= 64 * DIRECT:
        for at in range(0, len(homes), step):
            part = homes[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[None, :]) <= threshold)
            links += forest(len(fps), part[i], j)
    else:
        order = np.argsort(fps)
        for flip in near(threshold):
            sought = fps[homes] ^ flip
            at = np.searchsorted(fps, sought, sorter=order).clip(max=len(fps) - 1)
            hit = fps[order[at]] == sought
            links += forest(len(fps), homes[hit], order[at[hit]])
    if not links:
        return []
    a, b = np.array(links).T
    return forest(len(fps), a, b)


def compare(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows that are sorted by anchor, as positions."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(starts, len(anchor)))
    group = np.repeat(np.arange(len(starts)), sizes)
    alone = np.flatnonzero(home & (sizes[group] > 1) & (sizes[group] <= small))
    n = sizes[group[alone]]
    own = np.repeat(alone, n)
    other = starts[group[own]] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    close = (own != other) & (np.bitwise_count(fps[own] ^ fps[other]) <= threshold)
    a, b = [own[close]], [other[close]]
    for g in np.flatnonzero((sizes > small) & np.logical_or.reduceat(home, starts)):
        rows = slice(starts[g], starts[g] + sizes[g])
        if links := crowd(fps[rows], home[rows], threshold):
            x, y = np.array(links).T + starts[g]
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def links(met: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of linked nodes among rows that are dealt out and sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = compare(rows[0], rows[1].view(np.uint64), rows[3], threshold)
            return pa.RecordBatch.from_arrays([pa.array(rows[2][a]), pa.array(rows[2][b])], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last anchor may go on in the next batch
            held = [x[cut:].copy() for x in rows]
            if cut:
                yield out([x[:cut] for x in rows])
        if held is not None and len(held[0]):
            yield out(held)

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links lead to."""
    prints = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null")
    met = replicas(nodes, threshold).repartition("anchor").sortWithinPartitions("anchor")
    roots = stars(links(met, threshold))
    of_fp = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(of_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
