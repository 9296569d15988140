"""Removal of long repeated substrings across documents, by merging shard Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Documents
are judged on their input, matches lie within a document.

1. Anchors. Of each window of `length` bytes, the k-gram with the smallest hash is its anchor: equal windows have
   equal anchors wherever they stand. A first pass announces each document's anchors by bucket of the hash; the
   bucket answers which of them other documents have too. Nothing else can hold a repeated window.
2. Strings. A second pass cuts out, for each shared anchor, the string of all windows that it is the anchor of,
   and deals the strings out by anchor. Equal strings keep the smallest id, first in each batch, then in each
   bucket; where an anchor has several different strings, suffix_merge.py finds the repeats within them.
3. The windows found are merged into spans, and the spans removed.

Hot groups: a batch of rows answers for itself what it holds twice, and sends one entry per anchor or string, so
that a passage of a third of all documents costs a bucket one entry per batch. An anchor that over
max(hot_rows, rows / 20,000) documents hold may stand in as many different strings; its windows are dealt out
one by one, by their own hash. There can be only some millions of such anchors at any size (all anchors over that
bound), so their hashes are broadcast. Exact copies of whole documents are settled by their digest.

Rows: null and empty text have no bytes; texts shorter than `length` stay whole; very long texts are read in
stretches; a null doc_id is smaller than all others; rows with equal ids don't remove each other's text, and
repeated rows come back with the same result; an empty table gives an empty result. Other columns can have any
name: they are neither read nor returned, unless named in `carry`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.shared import bound_batches, cut_lineage, give_back
from stallwise.llm.suffix_merge import least_owner

#: Bytes of a k-gram.
GRAM = 16
#: Bytes of text that are hashed at once.
STRETCH = 1 << 18
#: Windows of a run; more make another run.
LONGEST = 256
#: Bytes of strings that are merged at once; only one anchor's strings may be more.
PIECE = 1 << 18
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Params:
    length: int = 50
    #: Bytes of text for each bucket.
    bucket_bytes: int = 1 << 20
    hot_rows: int = 20_000


def gram_hashes(data: bytes) -> np.ndarray:
    """A non-zero hash of each GRAM bytes."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    found = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    found += words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found | np.uint64(1)


def sliding(least: Callable, values: np.ndarray, width: int) -> np.ndarray:
    """The minimum (or maximum) of each run of so many values."""
    n, done, reach = len(values) - width + 1, values, 1
    while 2 * reach <= width:
        done = least(done[:-reach], done[reach:])
        reach *= 2
    return least(done[:n], done[width - reach : width - reach + n]) if reach < width else done


def runs(column: pa.BinaryArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and anchor of the runs of windows that have the same anchor. Each window of
    a row is in one run."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at in range(int(offsets[0]), int(offsets[-1]) - length + 1, STRETCH):
        part = column.buffers()[2][at : min(int(offsets[-1]), at + STRETCH + length - 1)]
        least = sliding(np.minimum, gram_hashes(part), length - GRAM + 1)
        # No window goes over the end of its row.
        ends = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, at + len(part), "left")] - at
        over = np.zeros(len(least) + 1, np.int64)
        np.add.at(over, np.clip(ends - length + 1, 0, len(least)), 1)
        np.add.at(over, np.clip(ends, 0, len(least)), -1)
        least[np.cumsum(over[:-1]) > 0] = 0
        starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        n, hashes = np.diff(np.append(starts, len(least))), least[starts]
        for k in range(0, int(n.max()), LONGEST):
            more = (hashes != 0) & (n > k)
            found.append((at + starts[more] + k, np.minimum(n[more] - k, LONGEST), hashes[more]))
    start, n, hashes = (np.concatenate(x) for x in zip(*found))
    row = np.searchsorted(offsets, start, "right") - 1
    order = np.argsort(row, kind="stable")
    return row[order], (start - offsets[row])[order], n[order], hashes[order]


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key and its positions, in order."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(keys) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(held[a]), order[a:b]


def packed(values: np.ndarray) -> bytes:
    """Numbers, small: bytes of equal weight together, then compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpacked(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers of all rows, one after the other."""
    planes = [np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1) for x in table.column(name).to_pylist()]
    return np.ascontiguousarray(np.concatenate(planes, axis=1).T).view(kind).reshape(-1)


def regrouped(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold so many bytes in a column of binaries."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spans_of(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], begins[1:] > ends[:-1]))
    return begins[new], ends[np.concatenate((new[1:], [True]))]


# First pass: which anchors do documents share?

ENTRY = "bucket int, hash binary, id binary, rows binary"


def announce(batches: Iterator[pa.RecordBatch], params: Params, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, which the upper half of a hash gives; the lower half stands for it within the bucket, and
    should two anchors look alike, that only adds strings to compare. From 0: an entry for each anchor of a batch; rows is how many documents hold it, below
    zero if several do. Below 0: anchors known to be shared, for the documents themselves."""
    for batch in regrouped(batches, "data"):
        row, _, _, hashes = runs(batch.column("data"), params.length)
        if not len(row):
            continue
        order = np.argsort(hashes, kind="stable")
        row, hashes = row[order], hashes[order]
        once = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))
        hashes, ids = hashes[once], batch.column("id").to_numpy()[row[once]]
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        sizes = np.diff(np.append(starts, len(hashes)))
        least = np.minimum.reduceat(ids, starts)
        several = least < np.maximum.reduceat(ids, starts)
        rows = np.where(several, -sizes, sizes)
        brief = hashes.astype(np.uint32)
        out = [(b, brief[starts[at]], least[at], rows[at].astype(np.int32)) for b, at in by_key((hashes[starts] >> np.uint64(32)) % np.uint64(buckets))]
        here = np.flatnonzero(np.repeat(several, sizes))
        out += [(-1 - b, brief[here[at]], ids[here[at]], np.zeros(0, np.int32)) for b, at in by_key(ids[here].view(np.uint64) % np.uint64(buckets))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([packed(r[k]) for r in out], pa.binary()) for k in (1, 2, 3))], names=["bucket", "hash", "id", "rows"])
    give_back()


ANSWER = "id long, hot boolean, hashes array<int>"


def answer(table: pa.Table, hot_rows: int) -> pa.Table:
    """For the documents of a bucket: which of the anchors are shared; and, in a row of its own, the hot ones."""
    hashes, ids = unpacked(table, "hash", np.uint32), unpacked(table, "id", np.int64)
    hot = hashes[:0]
    if table.column("bucket")[0].as_py() >= 0:
        rows = unpacked(table, "rows", np.int32).astype(np.int64)
        order = np.argsort(hashes)
        hashes, ids, rows = hashes[order], ids[order], rows[order]
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        sizes = np.diff(np.append(starts, len(hashes)))
        shared = (np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)) | (np.minimum.reduceat(rows, starts) < 0)
        hot = hashes[starts[shared & (np.add.reduceat(np.abs(rows), starts) > hot_rows)]]
        asked = np.repeat(shared, sizes) & (rows > 0)
        hashes, ids = hashes[asked], ids[asked]
    order = np.argsort(ids, kind="stable")
    hashes, ids = hashes[order], ids[order]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    offsets = np.concatenate((starts, [len(ids)], [len(ids) + len(hot)])).astype(np.int32)
    lists = pa.ListArray.from_arrays(offsets, np.concatenate((hashes, hot)).view(np.int32))
    return pa.table({"id": pa.array([*ids[starts].tolist(), NULL_ID], pa.int64()), "hot": [False] * len(starts) + [True], "hashes": lists})


# Second pass: the strings of shared anchors.

STRINGS = "bucket int, text binary, size binary, id binary, key binary, at binary"
#: Kinds of the numbers in those columns; below bucket 0, `size` holds the ends of spans.
KINDS = {"size": np.int64, "id": np.int64, "key": np.int32, "at": np.int64}


def shared_strings(batch: pa.RecordBatch, length: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size, hash) of the strings of a batch's shared anchors; hash 0 for single windows of hot ones."""
    row, start, n, hashes = runs(batch.column("data"), length)
    lists = batch.column("hashes")
    owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()).astype(np.uint64)
    known = owner << np.uint64(32) | lists.flatten().to_numpy().view(np.uint32)
    brief = hashes.astype(np.uint32)
    asked = np.isin(row.astype(np.uint64) << np.uint64(32) | brief, known)
    copied = np.array([len(c) > 0 and k in c.values.to_numpy() for k, c in zip(batch.column("key").to_numpy(), batch.column("copies"))], bool)
    asked &= ~copied[row]
    row, start, n, hashes, brief = (x[asked] for x in (row, start, n, hashes, brief))
    very = np.isin(brief, hot)
    m = n[very]
    step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    return (
        np.concatenate((row[~very], np.repeat(row[very], m))),
        np.concatenate((start[~very], np.repeat(start[very], m) + step)),
        np.concatenate((n[~very] + length - 1, np.full(len(step), length))),
        np.concatenate((hashes[~very], np.zeros(len(step), np.uint64))),
    )


def deal_strings(batches: Iterator[pa.RecordBatch], params: Params, buckets: int, hot) -> Iterator[pa.RecordBatch]:
    """Rows by bucket. From 0: each different string of a batch, for the smallest id that has it. Below 0: spans of
    the other documents with it, which are settled."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in regrouped((b.select(["id", "key", "data", "hashes", "copies"]) for b in batches), "data"):
        ids, keys = (batch.column(n).to_numpy() for n in ("id", "key"))
        row, start, size, held = shared_strings(batch, params.length, hot.value)
        column = batch.column("data")
        begins = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][row] + start
        index: dict[bytes, int] = {}
        text = column.buffers()[2].to_pybytes() if len(row) else b""
        which = np.array([index.setdefault(text[a:b], len(index)) for a, b in zip(begins.tolist(), (begins + size).tolist())], np.int64)
        if not index:
            continue
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[row])
        first = ids[row] == least[which]
        strings = list(index)
        out = []
        ask = np.flatnonzero(first)
        deal = held[ask] >> np.uint64(32)
        for k in np.flatnonzero(held[ask] == 0):
            deal[k] = zlib.crc32(strings[which[ask[k]]])
        for b, at in by_key(deal % np.uint64(buckets)):
            at = ask[at]
            out.append((b, packer.compress(b"".join([strings[i] for i in which[at].tolist()])), size[at], ids[row[at]], keys[row[at]], start[at]))
        done = np.flatnonzero(~first)
        settled: dict[int, list] = {}
        for r, at in by_key(row[done]):
            begins, ends = spans_of(start[done[at]], (start + size)[done[at]])
            settled.setdefault(int(ids[r]) % buckets, []).append((ends, np.full(len(begins), ids[r]), np.full(len(begins), keys[r]), begins))
        for b, each in settled.items():
            ends, whose, key, begins = (np.concatenate(x) for x in zip(*each))
            out.append((-1 - b, b"", ends, whose, key, begins))
        names = [c.split()[0] for c in STRINGS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), *(pa.array([packed(r[k]) for r in out], pa.binary()) for k in range(2, 6))], names=names)
    give_back()


SPANS = "id long, key int, begins array<long>, ends array<long>"


def may_repeat(text: bytes, sizes: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each string its anchor, the least hash in its first window as in all of its windows, and whether another
    document's string can share a window with it: a window holds half of what it has beside the anchor on one side
    of it at least, so strings that share one agree there. Several places of the anchor leave that open."""
    first, near = np.cumsum(sizes) - sizes, (length - GRAM + 1) // 2
    hashes = gram_hashes(text)
    bounds = np.column_stack((first, first + length - GRAM + 1)).ravel()
    of = np.minimum.reduceat(np.append(hashes, np.uint64(0)), bounds)[::2]
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(hashes)]
    at = np.flatnonzero(hashes == of[owner])
    at = at[at + GRAM <= (first + sizes)[owner[at]]]
    places = np.bincount(owner[at], minlength=len(sizes))
    place = at[np.searchsorted(owner[at], np.arange(len(sizes)))]
    can = places > 1
    for begin, inside in ((place - near, place - near >= first), (place + GRAM, place + GRAM + near <= first + sizes)):
        which = np.flatnonzero(inside)
        # Two hashes cover `near` characters, near > GRAM; shorter lengths keep all strings.
        if near < GRAM:
            return of, np.ones(len(sizes), bool)
        keys = (of[which] ^ hashes[begin[which]]) * np.uint64(0x9E3779B97F4A7C15) + hashes[begin[which] + near - GRAM]
        order = np.argsort(keys)
        which, keys = which[order], keys[order]
        if len(which):
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            several = np.minimum.reduceat(least[which], starts) < np.maximum.reduceat(least[which], starts)
            can[which[np.repeat(several, np.diff(np.append(starts, len(which))))]] = True
    return of, can


def pieces(of: np.ndarray, can: np.ndarray, least: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Strings to be merged, all of an anchor together: of anchors that have strings of several documents."""
    order = np.flatnonzero(can)
    order = order[np.argsort(of[order], kind="stable")]
    starts = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(least[order], starts) < np.maximum.reduceat(least[order], starts) if len(order) else np.zeros(0, bool)
    n = np.diff(np.append(starts, len(order)))
    order, n = order[np.repeat(several, n)], n[several]
    held = np.cumsum(np.add.reduceat(sizes[order], np.cumsum(n) - n)) if len(n) else n
    for which in np.split(np.arange(len(n)), np.flatnonzero(np.diff(held // PIECE)) + 1):
        if len(which):
            yield order[n[: which[0]].sum() : n[: which[-1] + 1].sum()]


def settle(table: pa.Table, length: int) -> pa.Table:
    """The spans to remove that a bucket of strings shows."""
    size, ids, keys, start = (unpacked(table, n, k) for n, k in KINDS.items())
    begins, ends, owner = start, size, np.arange(len(ids))
    if table.column("bucket")[0].as_py() >= 0:
        text = b"".join(map(zstandard.decompress, table.column("text").to_pylist()))
        stop = np.cumsum(size)
        index: dict[bytes, int] = {}
        which = np.array([index.setdefault(text[a:b], len(index)) for a, b in zip((stop - size).tolist(), stop.tolist())], np.int64)
        strings = list(index)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids)
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        of, can = may_repeat(b"".join(strings), sizes, least, length)
        lone = ids > least[which]  # the whole string is in a document with a smaller id
        found = [(start[lone], start[lone] + size[lone], np.flatnonzero(lone))]

        flat = [np.zeros(0, np.int64)]
        mixed = np.zeros(0, np.int64)
        for part in pieces(of, can, least, sizes):
            flat.append(least_owner([strings[i] for i in part], least[part], length))
            mixed = np.append(mixed, part)
        flat = np.concatenate(flat)
        first = np.zeros(len(strings), np.int64)
        n_windows = np.zeros(len(strings), np.int64)
        n_windows[mixed] = sizes[mixed] - length + 1
        first[mixed] = np.cumsum(n_windows[mixed]) - n_windows[mixed]
        entry = np.flatnonzero(~lone & (n_windows[which] > 0))
        n = n_windows[which[entry]]
        own = np.repeat(entry, n)
        k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        gone = flat[first[which[own]] + k] < ids[own]
        at = start[own[gone]] + k[gone]
        found.append((at, at + length, own[gone]))
        begins, ends, owner = (np.concatenate(x) for x in zip(*found))
    return spans_by_row(ids[owner], keys[owner], begins, ends)


def spans_by_row(ids: np.ndarray, keys: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Table:
    """A row for each id and key with its spans merged; each gets a stretch of numbers of its own, so one merge does."""
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))[: len(ids)]
    group = np.cumsum(new) - 1
    begins, ends = begins[order] + (group << 40), ends[order] + (group << 40)
    if len(ids):
        begins, ends = spans_of(begins, ends)
    which = begins >> 40
    offsets = pa.array(np.searchsorted(which, np.arange(int(new.sum()) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x - (which << 40))) for x in (begins, ends)]
    return pa.table([pa.array(ids[new]), pa.array(keys[new]), *lists], names=["id", "key", "begins", "ends"])


# The whole.


def copies_of(rows: DataFrame) -> DataFrame:
    """(id, key) of rows whose whole text a row with a smaller id has."""
    light = rows.select("id", "key", F.sha2("data", 256).alias("digest"))
    first = light.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    # Joined on a key of another form than the grouping's, so that Spark can split the hot copies.
    return light.withColumn("d", F.reverse("digest")).join(first.select(F.reverse("digest").alias("d"), "first"), "d").filter("id > first").select("id", "key").distinct()


def repeated_spans(rows: DataFrame, params: Params) -> DataFrame:
    """(id, found): for rows (id, key, data), arrays of (key, begins, ends) to remove; an end of -1 is all."""
    spark = bound_batches(rows.sparkSession)
    volume, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-volume // params.bucket_bytes))
    long_enough = rows.filter(F.octet_length("data") >= params.length)
    hot_rows = max(params.hot_rows, n_rows // 20_000)

    entries = long_enough.select("id", "data").mapInArrow(partial(announce, params=params, buckets=buckets), ENTRY)
    answers = cut_lineage(entries.groupBy("bucket").applyInArrow(lambda table: answer(table, hot_rows), ANSWER))
    listed = answers.filter("hot").select(F.explode("hashes").alias("h")).collect()
    hot = spark.sparkContext.broadcast(np.array(sorted(r["h"] for r in listed), np.int32).view(np.uint32))

    copies = cut_lineage(copies_of(long_enough))
    none = F.array().cast("array<int>")
    known = answers.filter("not hot").select("id", "hashes", none.alias("copies")).unionByName(copies.select("id", none.alias("hashes"), F.array("key").alias("copies")))
    each = known.groupBy("id").agg(F.flatten(F.collect_list("hashes")).alias("hashes"), F.flatten(F.collect_list("copies")).alias("copies"))
    # All columns of rows go along, so that both joins read one and the same shuffle of the texts.
    strings = rows.join(each, "id").select("id", "key", "data", "hashes", "copies", *(c for c in rows.columns if c not in ("id", "key", "data"))).mapInArrow(partial(deal_strings, params=params, buckets=buckets, hot=hot), STRINGS)
    spans = strings.groupBy("bucket").applyInArrow(lambda table: settle(table, params.length), SPANS)
    whole = copies.select("id", "key", F.array(F.lit(0)).cast("array<long>").alias("begins"), F.array(F.lit(-1)).cast("array<long>").alias("ends"))
    return spans.unionByName(whole).groupBy("id").agg(F.collect_list(F.struct("key", "begins", "ends")).alias("found"))


def removed_spans(found: list | None, key: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    own = [f for f in found or [] if f["key"] == key]
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = (np.array([x for f in own for x in f[k]], np.int64) for k in ("begins", "ends"))
    return spans_of(begins, np.where(ends < 0, n, ends))


def kept_bytes(data: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join([data[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(data)])])


def whole_characters(data: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans drawn in to the characters that lie in them whole."""
    inside = lambda at: at < len(data) and data[at] & 0xC0 == 0x80
    out = []
    for a, b in zip(begins.tolist(), ends.tolist()):
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return tuple(np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the digest of what is left of each row.

    with_text adds `text` (null where it was): what is left once runs are drawn in to whole characters. With `carry`, those columns
    come too, in a struct `carried`."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"),
        F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("data"),
        F.col(text_col).isNull().alias("missing"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    )
    found = repeated_spans(rows, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, texts = [], []
            for id_, key, data, missing, own in zip(*(batch.column(n).to_pylist() for n in ("id", "key", "data", "missing", "found"))):
                begins, ends = removed_spans(own, key, len(data))
                out.append((None if id_ == NULL_ID else id_, len(data), int((ends - begins).sum()), len(begins), hashlib.sha256(kept_bytes(data, begins, ends)).hexdigest()))
                if with_text:
                    texts.append(None if missing else kept_bytes(data, *whole_characters(data, begins, ends)).decode("utf-8", "replace"))
            kinds = [pa.int64()] * 4 + [pa.string()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.string())], [*names, "text"]
            if carry:
                columns, names = [*columns, batch.column("carried")], [*names, "carried"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    schema = RESULT + ", text string" * with_text + (f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else "")
    return rows.join(found, "id", "left").mapInArrow(run, schema)
