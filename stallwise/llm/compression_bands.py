"""Quality rules by compression bands.

A text that zstandard shrinks far more than prose repeats itself; one that it hardly shrinks is not prose.
The ratio (compressed bytes / bytes) is taken over the whole document and over fixed chunks of it, and each
is held against limits for its own length, since short inputs compress less well. What is left after the last whole
chunk is a chunk of its own; a document goes if too many of its chunks are bad, with the rest or without it.

The limits come from the table itself: lengths fall into bands of a quarter octave, and of the ratios of all
different texts of a band and its two neighbours, what lies outside of the quartiles by more than `fence` times their
distance, and off the median by more than `least_spread` of it, is out. Chunks have wider fences, as one bad chunk
of two is enough to reject. Counts of ratios by thousandths, which are few at any size, give the quartiles. The
fixed, wide limits of a length weigh as much as `prior_rows` texts beside those of its band, so there is no number of
texts at which the rule changes. A verdict depends on the other texts of its lengths: less the more there are, and
not at all where `Bands` that were fitted before are given.

Rows: null or empty text has no words, fails the base rules and is not kept; very long texts are compressed
whole and chunk by chunk; repeated rows are judged one by one; an empty table gives an empty result.
Only the two named columns are read, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: 64-bit odd multipliers of a polynomial over the eight words of a window.
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(8)], np.uint64)


#: Bands of an octave of lengths.
OCTAVE = 4


def band_of(n_bytes: int) -> int:
    return int(OCTAVE * log2(max(1, n_bytes)))


@dataclass(frozen=True)
class Fences:
    document: float = 2.0
    chunk: float = 4.0
    #: Share of the median that a ratio may be off at least.
    least_document: float = 0.07
    least_chunk: float = 0.15
    #: Texts that a band's fixed limits weigh as much as.
    prior_rows: int = 8


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / plain bytes. By band of lengths, for documents and for chunks, where they are fitted;
    else by length in bytes: (from this length, lowest, highest), and one pair for whole chunks."""

    document: tuple[tuple[int, float, float], ...] = ((0, 0.0, 9.0), (128, 0.30, 1.10), (512, 0.28, 0.85), (2048, 0.25, 0.75))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.75)
    #: Share of chunks out of their band from which a document is rejected.
    bad_chunk_share: float = 0.5
    level: int = 3
    fitted: dict[int, tuple[float, float]] = field(default_factory=dict)
    fitted_chunk: dict[int, tuple[float, float]] = field(default_factory=dict)

    def of(self, n_bytes: int) -> tuple[float, float]:
        return self.fitted.get(band_of(n_bytes)) or self.fixed(n_bytes)

    def of_chunk(self, n_bytes: int) -> tuple[float, float]:
        return self.fitted_chunk.get(band_of(n_bytes)) or self.fixed_chunk(n_bytes)

    def fixed(self, n_bytes: int) -> tuple[float, float]:
        return next((low, high) for start, low, high in reversed(self.document) if n_bytes >= start)

    def fixed_chunk(self, n_bytes: int) -> tuple[float, float]:
        return self.chunk if band_of(n_bytes) == band_of(self.chunk_bytes) else self.fixed(n_bytes)


def blended(found: tuple[float, float], n: int, fixed: tuple[float, float], prior_rows: int) -> tuple[float, float]:
    """Limits of n texts and the fixed ones, by their weights."""
    low, high = ((n * x + prior_rows * y) / (n + prior_rows) for x, y in zip(found, fixed))
    return low, high


def limits(counts: dict[int, int], fence: float, least: float) -> tuple[float, float]:
    """Lowest and highest ratio, of counts by thousandths."""
    bins = sorted(counts)
    upto = np.cumsum([counts[b] for b in bins])
    low, mid, high = (bins[int(np.searchsorted(upto, q * upto[-1]))] / 1000 for q in (0.25, 0.5, 0.75))
    return min(low - fence * (high - low), (1 - least) * mid), max(high + fence * (high - low), (1 + least) * mid)


def fit(docs: DataFrame, bands: Bands = Bands(), fences: Fences = Fences(), text_col: str = "text") -> Bands:
    """The bands with limits from all different texts of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            data = [x.as_py() for x in batch.column(0)]
            band = [band_of(len(x)) for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(band, pa.int32()), pa.array([1000 * len(packer.compress(x)) // len(x) for x in data], pa.int32())], names=["h", "band", "bin"])

    data = F.col(text_col).cast("string").cast("binary")
    texts = docs.select(data.alias("data"), F.xxhash64(data).alias("h")).filter(F.octet_length("data") > 0)
    counts: dict[int, dict[int, int]] = {}
    for r in texts.mapInArrow(run, "h long, band int, bin int").distinct().groupBy("band", "bin").count().collect():
        for band in range(r["band"] - 1, r["band"] + 2):
            at = counts.setdefault(band, {})
            at[r["bin"]] = at.get(r["bin"], 0) + r["count"]
    fitted, fitted_chunk = {}, {}
    for band, c in counts.items():
        n, length = sum(c.values()), round(2 ** ((band + 0.5) / OCTAVE))
        fitted[band] = blended(limits(c, fences.document, fences.least_document), n, bands.fixed(length), fences.prior_rows)
        fitted_chunk[band] = blended(limits(c, fences.chunk, fences.least_chunk), n, bands.fixed_chunk(length), fences.prior_rows)
    return replace(bands, fitted=fitted, fitted_chunk=fitted_chunk)


@dataclass
class Verdict:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    base_failed: bool = True
    ratio: float | None = None
    n_chunks: int = 0
    n_bad_chunks: int = 0
    kept: bool = field(default=False)


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of so many words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    keys = sum((mixed[k : k + n] * POWERS[k] for k in range(window)), np.zeros(n, np.uint64))
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Equal keys are only likely repeats; ranks of pairs, fours and eights decide.
    rank, width = ids.astype(np.int64), 1
    while width < window:
        pairs = rank[: len(rank) - width] * (len(words) + 1) + rank[width:]
        rank = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(data: bytes | None, bands: Bands, packer: zstandard.ZstdCompressor) -> Verdict:
    out = Verdict()
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    words = data.split()
    out.n_words = len(words)
    out.word_chars = int(((raw & 0xC0) != 0x80).sum() - WHITE[raw].sum())
    out.n_symbols = int(SYMBOLS[raw].sum())
    seen: set[bytes] = set()
    for line in data.split(b"\n"):
        if line in seen:
            out.n_dup_lines += 1
        elif line.strip():
            seen.add(line)
    out.n_repeat_words = repeated_words(words)
    out.base_failed = out.n_words < 20 or 100 * out.n_repeat_words > 30 * out.n_words
    out.ratio = len(packer.compress(data)) / len(data)
    size = bands.chunk_bytes
    view = memoryview(data)
    fine = True
    for at in range(0, len(data), size):
        part = view[at : at + size]
        low, high = bands.of_chunk(len(part))
        if len(part) < size and out.n_chunks:
            fine = out.n_bad_chunks < bands.bad_chunk_share * out.n_chunks
        out.n_chunks += 1
        out.n_bad_chunks += not low <= len(packer.compress(part)) / len(part) <= high
    low, high = bands.of(len(data))
    fine = fine and low <= out.ratio <= high and out.n_bad_chunks < bands.bad_chunk_share * out.n_chunks
    out.kept = fine and not out.base_failed
    return out


FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "n_chunks": pa.int64(), "n_bad_chunks": pa.int64()}
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


def compression_bands(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its word and line counts, the base rules' result, ratios and the verdict `kept`, by
    limits that are fitted on docs where none are given."""
    bands = fit(docs, text_col=text_col) if bands is None else bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            found = [judge(x.as_py(), bands, packer) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([getattr(v, k) for v in found], t) for k, t in FIELDS.items())], names=["doc_id", *FIELDS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("data")).mapInArrow(run, SCHEMA)
