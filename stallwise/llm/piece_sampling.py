"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

The lattice of a text has an edge for each piece of the vocabulary at each place where it matches; a character
that is no piece is spelled in byte pieces. Going forward, each node gets the total weight of all paths to it;
going backward, an incoming edge is drawn by its share of that weight. So segmentations are drawn by their exact
weights: the product over pieces of 1 / (rank + 1) ** sharpness, the rank being the piece's place in the model.
Draws are hashes of the row key, the seed and the place in the text: they don't depend on partitions or order.

No piece holds a space after another character, so the lattice falls apart at spaces, exactly; the distinct
words of a batch are filtered once, and all occurrences are sampled together.

Decoding joins the pieces' bytes and is lossless: spaces and the sign that stands for them are told apart, as that
sign itself is spelled in bytes.

Rows: null text has null ids and decodes to null; empty text has no ids; very long texts and words are taken
whole; a null key counts as zero; repeated rows get equal segmentations; an empty table gives an empty result.
Only the named columns are read, so others can have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Stands for that sign in a text; a lone surrogate, so that no text holds it.
SIGN = "\ud800"


@dataclass(frozen=True)
class Params:
    model_path: str
    sharpness: float = 1.0
    seed: int = 42


class Vocabulary:
    """Pieces as a trie over code points, in arrays; weights; and bytes for decoding."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        words: list[tuple[str, int]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                words.append((piece, i))
                self.bytes.append(piece.replace(SPACE, " ").encode())
        scores = np.array([model.get_score(i) for i in range(size)])
        self.weight = -sharpness * np.log(np.clip(-scores, 0, size) + 1)
        self.size, self.longest = size, max(len(w) for w, _ in words)
        children: list[dict[str, int]] = [{}]
        ends = {}
        for word, i in words:
            state = 0
            for c in word:
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                state = children[state][c]
            ends[state] = i
        letters = {c: k + 1 for k, c in enumerate(sorted({c for w, _ in words for c in w}))}
        self.letter = np.zeros(0x110000, np.int32)
        for c, k in letters.items():
            self.letter[ord(c)] = k
        self.piece = np.array([ends.get(s, -1) for s in range(len(children))], np.int64)
        keys = sorted((s * (len(letters) + 1) + letters[c], t) for s, kids in enumerate(children) for c, t in kids.items())
        self.n_letters = len(letters) + 1
        self.slots = 1 << 19
        self.table_key, self.table_to = np.full(self.slots + 64, -1, np.int64), np.zeros(self.slots + 64, np.int64)
        self.probes = 1
        for key, to in keys:
            at = self.slot(np.int64(key))
            first = at
            while self.table_key[at] >= 0:
                at += 1
            self.probes = max(self.probes, int(at - first) + 1)
            self.table_key[at], self.table_to[at] = key, to

    def slot(self, key):
        return (key * 0x9E3779B1 >> 7) & (self.slots - 1)

    def step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states that letters lead to, or -1."""
        keys = states * self.n_letters + letters
        at, out = self.slot(keys), np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        for k in range(self.probes):
            found = self.table_key[at[open_] + k]
            hit = found == keys[open_]
            out[open_[hit]] = self.table_to[at[open_[hit]] + k]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
        return out


@cache
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    """One for each worker."""
    return Vocabulary(path, sharpness)


def words_of(text: str) -> list[str]:
    """The text with a space before it, cut before each run of spaces; spaces are the vocabulary's own sign, and
    that sign is SIGN."""
    marked = (" " + text).replace(SPACE, SIGN)
    parts = marked.split(" ")[1:]
    out, spaces = [], 1
    for part in parts:
        if part:
            out.append(SPACE * spaces + part)
            spaces = 1
        else:
            spaces += 1
    if spaces > 1:
        out.append(SPACE * (spaces - 1))
    return out


class Lattice:
    """Edges of distinct words with the chance of each to be the last piece of a path to its end."""

    def __init__(self, words: list[str], vocab: Vocabulary):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(chars)) - first[owner]
        letters = vocab.letter[chars]
        # Node of a word's position p is first + word + p, so that every word has one node more than characters.
        node = np.arange(len(chars)) + owner
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        starts, ends, values = [], [], []
        alone = np.ones(len(chars), bool)
        for n in range(1, vocab.longest + 1):
            state = vocab.step(state, letters[at + n - 1])
            fine = state >= 0
            at, state = at[fine], state[fine]
            piece = vocab.piece[state]
            whole = piece >= 0
            starts.append(node[at[whole]])
            ends.append(node[at[whole]] + n)
            values.append(piece[whole])
            if n == 1:
                alone[at[whole]] = False
            more = place[at] + n < sizes[owner[at]]
            at, state = at[more], state[more]
        spelled = np.flatnonzero(alone)  # characters that are no piece: their edge is size + code point
        starts.append(node[spelled])
        ends.append(node[spelled] + 1)
        values.append(vocab.size + chars[spelled])
        start, end, value = (np.concatenate(x) for x in (starts, ends, values))
        weight = np.where(value < vocab.size, vocab.weight[np.minimum(value, vocab.size - 1)], vocab.weight[-1])
        node_place = np.concatenate((place, sizes))  # by node, once put in order
        order = np.concatenate((node, first + np.arange(len(words)) + sizes))
        where = np.empty(len(order), np.int64)
        where[order] = node_place
        # Forward filtering: all nodes at one distance from the beginning of their words at a time.
        by = np.lexsort((end, where[end]))
        start, end, value, weight = start[by], end[by], value[by], weight[by]
        depth = where[end]
        total = np.zeros(len(order))
        share = np.empty(len(start))
        cuts = np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1]))) if len(depth) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(depth)]):
            w = total[start[a:b]] + weight[a:b]
            e = end[a:b]
            heads = np.flatnonzero(np.concatenate(([True], e[1:] != e[:-1])))
            n = np.diff(np.append(heads, b - a))
            top = np.repeat(np.maximum.reduceat(w, heads), n)
            sums = np.add.reduceat(np.exp(w - top), heads)
            total[e[heads]] = top[heads] + np.log(sums)
            share[a:b] = np.exp(w - top) / np.repeat(sums, n)
        by = np.argsort(end, kind="stable")
        self.start, end, self.value, share = start[by], end[by], value[by], share[by]
        self.begin = first + np.arange(len(words))
        self.finish = self.begin + sizes
        self.sizes = sizes
        # Steps of a staircase: node number plus the shares so far, so that one search draws any edge.
        heads = np.searchsorted(end, np.arange(len(order)), side="left")
        tails = np.searchsorted(end, np.arange(len(order)), side="right")
        run = np.cumsum(share)
        base = np.where(heads > 0, run[np.maximum(heads - 1, 0)], 0.0)
        self.stairs = end + np.minimum(run - base[end], 1 - 1e-12)
        self.heads, self.tails = heads, tails

    def draw(self, nodes: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """An incoming edge of each node."""
        return np.clip(np.searchsorted(self.stairs, nodes + chance, side="right"), self.heads[nodes], self.tails[nodes] - 1)


def chances(keys: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers below 1, by key, place and seed."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def sample(texts: list[str], keys: np.ndarray, vocab: Vocabulary, seed: int) -> list[np.ndarray]:
    """The ids of a sampled segmentation of each text."""
    index: dict[str, int] = {}
    which: list[int] = []
    counts = []
    for text in texts:
        found = words_of(text) if text else []
        counts.append(len(found))
        which += [index.setdefault(w, len(index)) for w in found]
    if not index:
        return [np.zeros(0, np.int64) for _ in texts]
    lattice = Lattice(list(index), vocab)
    word, n = np.array(which), np.array(counts)
    text_of = np.repeat(np.arange(len(texts)), n)
    size = lattice.sizes[word]
    before = np.cumsum(size) - size
    first_word = np.cumsum(n) - n
    before -= np.repeat(before[np.minimum(first_word, len(word) - 1)], n)
    nodes, live, steps = lattice.finish[word].copy(), np.arange(len(word)), []
    taken = np.zeros(len(word), np.int64)
    while len(live):
        edge = lattice.draw(nodes[live], chances(keys[text_of[live]], before[live] + nodes[live] - lattice.begin[word[live]], seed))
        steps.append((live, lattice.value[edge]))
        taken[live] += 1
        nodes[live] = lattice.start[edge]
        live = live[nodes[live] > lattice.begin[word[live]]]
    ends = np.cumsum(taken)
    ids = np.empty(int(ends[-1]), np.int64)
    for k, (who, value) in enumerate(steps):
        ids[ends[who] - 1 - k] = value
    cuts = np.concatenate(([0], ends))[np.concatenate((first_word, [len(word)]))]
    return [spell(ids[a:b], vocab) for a, b in zip(cuts[:-1], cuts[1:])]


def spell(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """With characters that are no piece in byte pieces."""
    rare = np.flatnonzero(ids >= vocab.size)
    if not len(rare):
        return ids
    points = ids[rare] - vocab.size
    if (points < 128).all():
        ids = ids.copy()
        ids[rare] = vocab.byte_id[points]
        return ids
    out, last = [], 0
    for at, point in zip(rare.tolist(), points.tolist()):
        text = SPACE if point == ord(SIGN) else chr(point)
        out += [ids[last:at], vocab.byte_id[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]]
        last = at + 1
    return np.concatenate([*out, ids[last:]])


def join_pieces(ids, vocab: Vocabulary) -> str:
    return b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, found in sampled(batches, params):
            lists = pa.array([None if x is None else x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([names, lists], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


#: Characters of a batch that are sampled together.
TOGETHER = 1 << 21


def sampled(batches: Iterator[pa.RecordBatch], params: Params) -> Iterator[tuple[pa.Array, list]]:
    vocab = vocabulary(params.model_path, params.sharpness)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum([len(t or "") for t in texts]) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                found = sample([t or "" for t in texts[a:b]], keys[a:b], vocab, params.seed)
                yield ids[a:b], [None if t is None else f for t, f in zip(texts[a:b], found)]


def decode(encoded: DataFrame, params: Params, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(params.model_path, params.sharpness)
        for batch in batches:
            texts = [None if x is None else join_pieces(x, vocab) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives back the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(params.model_path, params.sharpness)
        for batch in batches:
            out, row = [], 0
            for names, found in sampled(iter([batch]), params):
                for id_, ids in zip(names.to_pylist(), found):
                    text = batch.column(1)[row].as_py()
                    row += 1
                    out.append((id_, 0 if ids is None else len(ids), None if ids is None else zlib.crc32(ids.astype("<u4").tobytes()), (None if ids is None else join_pieces(ids.tolist(), vocab)) == text))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "n_ids", "ids_crc32", "lossless"])

    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, lossless boolean")
