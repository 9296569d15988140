"""Language-model scores: an interpolated modified Kneser-Ney model of word pairs, mapped from sorted arrays.

Fitting counts all training text, in three jobs. The first counts words, by their 64-bit hashes; sorted, these are
the vocabulary, and a word's place among them is its number. The second counts pairs of numbers, packed into 64 bits,
and for each word its kinds of followers. The third counts how many words each word follows. Every job counts within its
tasks first and ships sorted, packed runs of keys; the owner of a shard merges them and writes one array file, under its
final name only when it is whole, so a task that is run again does no harm. Shards hold ranges of keys; pairs
of a word more frequent than a whole shard are spread over all shards. The number of shards follows the amount
of text, and so do the files: nothing is capped or sampled, and the driver sees only sizes and sums.

Workers map the files and look sorted, distinct keys of a batch up, so they read only pages that they need. The folder has
to be one that workers can open (a mount that all of them see); it holds the model until its owner deletes it.

With c the count of a pair, c(h) of its first word, N1, N2, N3 the numbers of followers of h seen once, twice, more often:
p(w|h) = max(0, c - D(c)) / c(h) + (D1 N1 + D2 N2 + D3 N3) / c(h) * p(w), and p(w) is made in the same way from
the numbers of words that w follows, with 1 / (distinct tokens + 1) below it. An unknown h gives p(w). Discounts come from the
numbers of pairs seen once to four times; where those give none, 1/2, 1, 3/2 are taken.

Rows: null text is empty, and an empty text has its end as only token; very long texts are read whole; a null id
isn't held out; repeated rows count and are scored one by one; an empty table gives an empty result, and without training
rows every token has probability 1. Only the two named columns are read, so others can have any name. More than
2**32 - 2 distinct tokens end the job with an error.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.shared import cut_lineage, shared_folder

#: The end of a text counts as a token; no word is empty.
END = xxhash.xxh64_intdigest(b"")


@dataclass(frozen=True)
class Params:
    #: Bytes of training text for each shard, roughly.
    shard_bytes: int = 48 << 20
    #: Distinct keys that a task counts before it ships them.
    run_keys: int = 1 << 22


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, tokens of all texts as positions in those, where each text ends)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = pc.list_flatten(lists).dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.empty(len(words) + 1, np.uint64)
    hashes[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    hashes[-1] = END
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if b"" in words:  # before leading and behind trailing space
        real = codes != words.index(b"")
        codes, text = codes[real], text[real]
    ends = np.cumsum(np.bincount(text, minlength=len(texts)) + 1)
    every = np.full(len(codes) + len(texts), len(words), np.int64)
    every[np.arange(len(codes)) + text] = codes
    return hashes, every, ends


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts[by], starts)


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Bytes by significance, of differences if the numbers rise: the high ones are mostly zero and compress well."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unpacked(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


#: Runs of sorted keys with counts, for a shard.
RUNS = "kind int, shard int, keys binary, counts binary"


def runs(kind: int, keys: np.ndarray, counts: np.ndarray, shards: np.ndarray) -> pa.RecordBatch:
    """Sorted keys by shard."""
    by = np.argsort(shards, kind="stable")
    shards = shards[by]
    starts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else np.zeros(0, np.int64)
    parts = [(int(shards[a]), packed(keys[by[a:b]], True), packed(counts[by[a:b]].astype(np.uint32))) for a, b in zip(starts, [*starts[1:], len(shards)])]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["kind", "shard", "keys", "counts"])


def counted(texts: DataFrame, keys_of: Callable, shards_of: Callable, most: int) -> DataFrame:
    """Runs of the keys, with counts, that keys_of gives for a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for batch in batches:
            fresh.append(keys_of(batch.column(0)))
            if sum(len(f[0]) for f in fresh) >= most // 4:
                keys, counts = summed(np.concatenate([keys, *(f[0] for f in fresh)]), np.concatenate([counts, *(f[1] for f in fresh)]))
                fresh = []
                if len(keys) >= most:
                    yield runs(0, keys, counts, shards_of(keys))
                    keys, counts = keys[:0], counts[:0]
        keys, counts = summed(np.concatenate([keys, *(f[0] for f in fresh)]), np.concatenate([counts, *(f[1] for f in fresh)]))
        if len(keys):
            yield runs(0, keys, counts, shards_of(keys))

    return texts.mapInArrow(run, RUNS)


def merged(found: DataFrame, n_shards: int, own: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, by_kind: bool = False) -> DataFrame:
    """own(shard, keys, counts) of each shard, its runs summed up (with by_kind: own(shard, runs by kind))."""

    def close(shard: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        sums = {k: summed(np.concatenate([r[0] for r in rs]), np.concatenate([r[1] for r in rs])) for k, rs in held.items()}
        return own(shard, sums) if by_kind else own(shard, *sums[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for kind, shard, keys, counts in zip(*(batch.column(n).to_pylist() for n in ("kind", "shard", "keys", "counts"))):
                if at != shard:
                    if held:
                        yield from close(at, held)
                    at, held = shard, {}
                rs = held.setdefault(kind, [])
                rs.append((unpacked(keys, np.uint64, True), unpacked(counts, np.uint32).astype(np.int64)))
                if len(rs) >= 32:
                    held[kind] = [summed(np.concatenate([r[0] for r in rs]), np.concatenate([r[1] for r in rs]))]
        if held:
            yield from close(at, held)

    return found.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def write(path: str, *arrays: np.ndarray) -> None:
    """One file: the number of arrays, their bytes, and the arrays at multiples of eight."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes() + bytes(-a.nbytes % 8))
    os.replace(part, path)


@lru_cache(maxsize=512)
def mapped(path: str, *kinds: str) -> list[np.ndarray]:
    """The arrays of a file, mapped and not read; none where the file is missing, as an empty shard's is."""
    if not os.path.exists(path):
        return [np.zeros(0, k) for k in kinds]
    data = np.memmap(path, np.uint8, "r")
    n = int(data[:8].view(np.int64)[0])
    sizes, at, found = data[8 : 8 + 8 * n].view(np.int64).tolist(), 8 + 8 * n, []
    for size, kind in zip(sizes, kinds):
        found.append(data[at : at + size].view(kind))
        at += size + -size % 8
    return found


def by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, the positions that have it)."""
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield int(shards[at[0]]), at


def in_ranges(keys: np.ndarray, top: int, n_shards: int) -> np.ndarray:
    """Shards as equal ranges of numbers below top."""
    return (keys.astype(np.float64) * (n_shards / max(1, top))).astype(np.int64).clip(0, n_shards - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """D by count: none, one, two, three or more."""
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        found = [i - (i + 1) * y * b / a for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
        if all(0 <= d <= i for i, d in enumerate(found, 1)):
            return (0.0, *found)
    return 0.0, 0.5, 1.0, 1.5


def kinds_of(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((counts == i).sum()) for i in range(1, 5)]


@dataclass(frozen=True)
class Model:
    """What of a model is small: its folder, sizes, sums and discounts."""

    folder: str
    n_shards: int
    #: Numbers of the first words of the vocabulary's shards, and of all.
    firsts: np.ndarray
    n_words: int
    n_tokens: int
    n_texts: int
    #: Words whose pairs are spread over all shards.
    frequent: np.ndarray
    pair_discounts: tuple = ()
    word_discounts: tuple = ()
    n_pairs: int = 0
    #: Of all pairs' weight in p(w), what the discounts leave for 1 / (distinct tokens + 1).
    left: float = 1.0

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, -1 for unknown ones, counts) of words."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for shard, at in by_shard(word_shards(hashes, self.n_shards)):
            keys, counts = mapped(f"{self.folder}/words-{shard}", "u8", "i8")
            place = np.searchsorted(keys, hashes[at]).clip(0, max(0, len(keys) - 1))
            known = keys[place] == hashes[at] if len(keys) else np.zeros(len(at), bool)
            number[at[known]] = self.firsts[shard] + place[known]
            count[at[known]] = counts[place[known]]
        return number, count

    def pair_shards(self, keys: np.ndarray) -> np.ndarray:
        first = (keys >> np.uint64(32)).astype(np.int64)
        found = in_ranges(first, self.n_words + 1, self.n_shards)
        spread = np.isin(first, self.frequent)
        found[spread] = (mixed(keys[spread]) % np.uint64(self.n_shards)).astype(np.int64)
        return found

    def keys(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Of some texts: distinct tokens' numbers and counts, tokens, ends, and the numbers of the words before
        (n_words before the first, -1 if unknown)."""
        hashes, codes, ends = tokens(texts)
        number, count = self.numbers(hashes)
        before = np.empty(len(codes), np.int64)
        before[1:] = number[codes[:-1]]
        before[np.concatenate(([0], ends[:-1])) if len(ends) else []] = self.n_words
        return number, count, codes, ends, before

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), np.int64)
        for shard, at in by_shard(self.pair_shards(keys)):
            own, small, over_at, over = mapped(f"{self.folder}/pairs-{shard}", "u8", "u1", "i8", "i8")
            if len(own):
                place = np.searchsorted(own, keys[at]).clip(0, len(own) - 1)
                n = np.where(own[place] == keys[at], small[place].astype(np.int64), 0)
                many = np.flatnonzero(n == 255)
                n[many] = over[np.searchsorted(over_at, place[many])]
                found[at] = n
        return found

    def followers(self, number: np.ndarray) -> np.ndarray:
        """Rows N1, N2, N3 of words as first of a pair, and how many words they follow; zeros for unknown ones."""
        found = np.zeros((4, len(number)), np.int64)
        known = np.flatnonzero(number >= 0)
        top = self.n_words + 1
        for shard, at in by_shard(in_ranges(number[known], top, self.n_shards)):
            arrays = mapped(f"{self.folder}/kinds-{shard}", "i8", "u4", "u4", "u4", "u4")
            if len(arrays[0]):
                for row, x in zip(found, arrays[1:]):
                    row[known[at]] = x[number[known[at]] - int(arrays[0][0])]
        return found

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """By text: tokens, known ones, log10 of the smoothed shares, and log10 of the model's probability."""
        number, count, codes, ends, before = self.keys(texts)
        firsts = np.concatenate(([0], ends[:-1]))
        base = np.log10((count + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        # One more for the beginning of a text, which is the first of pairs.
        number, count = np.append(number, self.n_words), np.append(count, self.n_texts)
        kinds = self.followers(number)
        d = np.array(self.word_discounts)
        alone = np.maximum(0, kinds[3] - d[kinds[3].clip(0, 3)]) / max(1, self.n_pairs) + self.left / (self.n_words + 1)
        d = np.array(self.pair_discounts)
        code_before = np.empty(len(codes), np.int64)
        code_before[1:] = codes[:-1]
        code_before[firsts] = len(number) - 1
        left = np.divide(d[1:] @ kinds[:3], count, out=np.ones(len(count)), where=count > 0)
        p = alone[codes] * np.where(before >= 0, left[code_before], 1)
        both = np.flatnonzero((before >= 0) & (number[codes] >= 0))
        keys = before[both].astype(np.uint64) << np.uint64(32) | number[codes[both]].astype(np.uint64)
        distinct, back = np.unique(keys, return_inverse=True)
        c = self.pair_counts(distinct)
        own = np.maximum(0, c - d[c.clip(0, 3)])[back]
        p[both] += own / count[code_before[both]]
        return np.diff(ends, prepend=0), np.add.reduceat((count[codes] > 0).astype(np.int64), firsts), np.add.reduceat(base[codes], firsts), np.add.reduceat(np.log10(p), firsts)


def word_shards(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def model_folder(spark: SparkSession) -> str:
    where = urlparse(shared_folder(spark))
    if where.scheme not in ("", "file"):
        raise ValueError("workers map the model's files: name a folder on a mount that they all see")
    return f"{where.path}/language-model-{uuid.uuid4().hex}"


def row(schema: str, *values) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], types[c.split()[1]]) for v, c in zip(values, schema.split(", "))], names=[c.split()[0] for c in schema.split(", ")])


SIZES = "shard int, n long, total long, ends long"
FOUND = RUNS + ", n1 long, n2 long, n3 long, n4 long, n long"
#: Kinds of runs: pairs, followers of a word that are seen once, twice, more often, and words that it follows.
FOLLOWERS, FOLLOWED = (1, 2, 3), 4


def fit(texts: DataFrame, params: Params = Params(), folder: str | None = None) -> Model:
    """Learns from all texts: a DataFrame of one column of strings. folder: an absolute path that all workers can open."""
    spark = texts.sparkSession
    folder = folder or model_folder(spark)
    os.makedirs(folder, exist_ok=True)
    texts = texts.toDF("text").select(F.col("text").cast("string"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_shards = 1 + n_bytes // params.shard_bytes

    def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        hashes, codes, _ = tokens(column)
        return hashes, np.bincount(codes, minlength=len(hashes))

    def write_words(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = keys[counts > 0], counts[counts > 0]
        write(f"{folder}/words-{shard}", keys, counts)
        yield row(SIZES, shard, len(keys), int(counts.sum()), int(counts[keys == np.uint64(END)].sum()))

    found = merged(counted(texts, words, lambda k: word_shards(k, n_shards), params.run_keys), n_shards, write_words, SIZES).collect()
    sizes = np.zeros(n_shards, np.int64)
    for r in found:
        sizes[r["shard"]] = r["n"]
    n_words, n_tokens, n_texts = int(sizes.sum()), sum(r["total"] for r in found), sum(r["ends"] for r in found)
    if n_words > (1 << 32) - 2:
        raise OverflowError("more distinct tokens than 32 bits can number")
    model = Model(folder, n_shards, np.cumsum(sizes) - sizes, n_words, n_tokens, n_texts, np.zeros(0, np.int64))
    model = Model(*list(vars(model).values())[:6], frequent_words(spark, model, n_tokens // n_shards))

    def pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number, _, codes, _, before = model.keys(column)
        keys = np.sort(before.astype(np.uint64) << np.uint64(32) | number[codes].astype(np.uint64))
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[starts], np.diff(starts, append=len(keys))

    def write_pairs(shard: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        over = np.flatnonzero(counts >= 255)
        write(f"{folder}/pairs-{shard}", keys, np.minimum(counts, 255).astype(np.uint8), over, counts[over])
        first, second = keys >> np.uint64(32), keys & np.uint64((1 << 32) - 1)
        ranges = lambda k: in_ranges(k, n_words + 1, n_shards)
        extra = lambda b, *n: pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x] * b.num_rows, pa.int64()) for x in n)], names=[c.split()[0] for c in FOUND.split(", ")])
        for kind in FOLLOWERS:
            own = first[counts == kind] if kind < 3 else first[counts >= 3]
            own, n = np.unique(own, return_counts=True)
            yield extra(runs(kind, own, n, ranges(own)), 0, 0, 0, 0, 0)
        second, n = np.unique(second, return_counts=True)
        yield extra(runs(FOLLOWED, second, n, ranges(second)), 0, 0, 0, 0, 0)
        yield row(FOUND, 0, shard, b"", b"", *kinds_of(counts), len(keys))

    told = cut_lineage(merged(counted(texts, pairs, model.pair_shards, params.run_keys), n_shards, write_pairs, FOUND))
    sums = told.filter("kind = 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "n"))).first()

    def write_kinds(shard: int, sums: dict) -> Iterator[pa.RecordBatch]:
        lo = min(int(k[0]) for k, _ in sums.values() if len(k))
        hi = max(int(k[-1]) for k, _ in sums.values() if len(k))
        dense = np.zeros((4, hi - lo + 1), np.uint32)
        for kind, (keys, counts) in sums.items():
            dense[kind - 1, keys.astype(np.int64) - lo] = counts
        write(f"{folder}/kinds-{shard}", np.array([lo], np.int64), *dense)
        yield row("n1 long, n2 long, n3 long, n4 long, more long", *kinds_of(dense[3]), int((dense[3] >= 3).sum()))

    kinds = merged(told.filter("kind > 0").select("kind", "shard", "keys", "counts"), n_shards, write_kinds, "n1 long, n2 long, n3 long, n4 long, more long", by_kind=True)
    seen = kinds.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "more"))).first()
    d = discounts(seen["n1"], seen["n2"], seen["n3"], seen["n4"])
    left = (d[1] * seen["n1"] + d[2] * seen["n2"] + d[3] * seen["more"]) / sums["n"] if sums["n"] else 1.0
    return Model(*list(vars(model).values())[:7], discounts(sums["n1"], sums["n2"], sums["n3"], sums["n4"]), d, sums["n"], left)


def frequent_words(spark: SparkSession, model: Model, most: int) -> np.ndarray:
    """Numbers of the words with more than `most` occurrences (the beginning of texts among them): fewer than there are shards."""
    folder, firsts = model.folder, model.firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = mapped(f"{folder}/words-{shard}", "u8", "i8")[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts > most) + firsts[shard], pa.int64())], names=["number"])

    found = [r["number"] for r in spark.range(model.n_shards).mapInArrow(run, "number long").collect()]
    return np.array(sorted(found + [model.n_words] * (model.n_texts > most)), np.int64)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 of the probability) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, known, base, score = shared.value.score(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that takes no part in training; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Learns from the rows that aren't held out and scores all; perplexity is that of a token."""
    model = fit(docs.filter(~held_out()).select("text"), params)
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
