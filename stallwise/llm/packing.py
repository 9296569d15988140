"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

A document is tokenised, ended by an end-of-text id and, if longer than a sequence, cut into full pieces of which
only the first may be shorter. Which lengths share a sequence depends on nothing but how many pieces have each
length, so the plan is made from that histogram (at most `capacity` numbers, whatever the input):

1. Reduction: a set that provably is at least as good as any other with its largest piece is fixed for good: the
   piece alone if nothing fits beside it; with the longest piece that fits, if that fills the sequence or no two
   pieces fit. Every set fixed shrinks the instance, so passes repeat until none is found.
2. Best fit, longest first, packs the rest; sequences with equal contents are kept as one pattern and a count.

Pieces of one length are numbered in parallel (salted groups, then offsets), and the number looks up the
sequence and the place in the plan.

Rows: null text counts as empty (one end-of-text id); very long texts are tokenised in stretches cut where a
space starts a word; ties are numbered in order of doc_id and piece; repeated rows and null doc_ids are packed
row by row; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallwise.llm.shared import cut_lineage, give_back

#: Where a space starts a word right after another: no token reaches over such a place.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Words with their ids that a task keeps; beyond that it starts anew.
KEPT_WORDS = 100_000
#: Pieces that a task holds before it hands them on.
HELD_PIECES = 500
#: What precedes the words of a text: contractions, letters, numbers, signs, white space.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, equal to those of the tokenizer itself.

    A text is cut where a space starts a word, and each distinct word is encoded once, by the tokenizer's own
    vocabulary, whose ids are in the order of its merges. Texts that hold a special token go to the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.path = path
        tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        of = byte_of_char()
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in self.marks}
        self.words = tiktoken.Encoding("words", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """Read anew when a text first needs it: few do, and a worker keeps it for good."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if any(m in text for m in self.marks):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        words = [first, *[" " + w for w in rest]]
        missing = set(words).difference(self.kept)
        if any(w[1:2].isspace() or w[-1:].isspace() for w in missing) or first[:1].isspace() or not first:
            # A space beside other white space doesn't start a word by itself; such texts keep to themselves.
            return b"".join(map(self.of_word, CUT.split(text)))
        if len(self.kept) + len(missing) > KEPT_WORDS:
            self.kept.clear()
            missing = set(words)
        self.kept.update((w, self.of_word(w)) for w in missing)
        return b"".join(map(self.kept.__getitem__, words))

    def of_word(self, word: str) -> bytes:
        return array("I", self.words.encode_ordinary(word)).tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for each piece of each row."""
    end = np.array([end_id], "<u4").tobytes()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        rows: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.encode(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
                    if len(rows) >= HELD_PIECES:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)
        # The worker lives on and serves other operators.
        own.kept.clear()
        give_back()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


#: Lengths of one sequence with the number of pieces of each, in the order of their places.
Pattern = tuple[tuple[int, int], ...]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Takes the pieces of dominating sets out of counts; returns the sets and how often each is used."""
    fixed: list[tuple[Pattern, int]] = []
    moved = True
    while moved:
        moved = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                counts[j] -= 1  # the piece itself is not among those that may join it
                room = capacity - j
                others = sorted(x for x, n in counts.items() if n)
                fit = [x for x in others if x <= room]
                two = 2 * fit[0] if fit and counts[fit[0]] > 1 else sum(fit[:2]) if len(fit) > 1 else room + 1
                counts[j] += 1
                if not fit:
                    pattern, times = ((j, 1),), counts[j]
                elif fit[-1] == room or two > room:
                    k = fit[-1]
                    pattern, times = (((j, 2),), counts[j] // 2) if k == j else (((j, 1), (k, 1)), min(counts[j], counts[k]))
                    if k != j and fit[-1] != room and counts[j] != times:
                        times = min(times, counts[k])
                else:
                    break
                for length, n in pattern:
                    counts[length] -= n * times
                fixed.append((pattern, times))
                moved = True
    for j in [j for j, n in counts.items() if not n]:
        del counts[j]
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest pieces first, each where the least room is left; equal sequences are treated together."""
    by_room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in by_room if r >= length):
            groups = by_room.pop(room) if left else []
            most = room // length
            for pattern, times in groups:
                full = min(times, left // most)
                last = left - full * most if full < times else 0
                for copies, n in ((most, full), (last, 1 if last else 0), (0, times - full - bool(last))):
                    if n:
                        by_room[room - copies * length].append((pattern + ((length, copies),) if copies else pattern, n))
                left -= full * most + last
        most = capacity // length
        for copies, n in ((most, left // most), (left % most, 1)):
            if copies and n:
                by_room[capacity - copies * length].append((((length, copies),), n))
    return [g for groups in by_room.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    rest = {k: n for k, n in counts.items() if n}
    return reduce_by_dominance(rest, capacity) + best_fit(rest, capacity)


def slots(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first number, first sequence, pieces of the length in a sequence, offset), in order."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, used[length], sequence, copies, offset))
            used[length] += copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def numbered(found: DataFrame, n_rows: int) -> DataFrame:
    """Adds rank, from 0 and gapless among the pieces of each length. Groups are salted: none holds a hot length."""
    salts = min(max(n_rows // 2000, 64), 10_000)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("at", F.row_number().over(order)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at") - 1).drop("salt", "at", "before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset of every piece."""
    found = cut_lineage(pieces(docs, tokenizer_path, capacity, end_id, with_ids, id_col, text_col))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(plan(counts, capacity))
    keys = table[:, 0] << 40 | table[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((table, keys))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        places, starts = shared.value
        length, rank = length.to_numpy(), rank.to_numpy()
        row = places[np.searchsorted(starts, length << 40 | rank, side="right") - 1]
        at = rank - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 2] + at // row[:, 3]), pa.array(row[:, 4] + at % row[:, 3] * length)], names=["sequence_id", "offset"])

    # Only length and rank go to Python; the ids stay with Spark.
    ready = numbered(found, sum(counts.values())).withColumn("_place", place("length", "rank"))
    return ready.select(*found.columns, "_place.sequence_id", "_place.offset")
