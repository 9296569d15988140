"""Language identification: known words first, then ever shorter character n-grams.

A model holds, for each language, smoothed log frequencies of words and of character n-grams. A word that
any language knows has its word scores; an unseen word has the mean scores of its longest n-grams that are
known, backing off from the longest length to single letters. The language with the highest mean over the words
wins, and its share of the exponentials of these means is the score: a text of words that no language knows well
scores near 1 / languages, whatever its length.

The model is fitted on labelled rows. `train_rows_per_lang` bounds them: where a language has more, a hash of
the id picks about that many. All of their words and n-grams make the model, which is broadcast: labelled rows
bound it, not the table.

A word is a run of letters (Unicode's L), in training as in prediction. Rows: null text, or one without a letter,
is `und` with score 0; very long texts are read whole; ties go to the
language that sorts first; repeated rows are scored one by one; rows with a null label or id don't train. An
empty table gives an empty result, and without a labelled row every text is `und`. Only named columns are
read, so other columns can have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.shared import give_back

#: Runs of letters and of numbers other than decimal digits.
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case."""
    found = WORD.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():  # a number such as a half or a circled one
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


@dataclass(frozen=True)
class Params:
    train_rows_per_lang: int = 2000
    longest_gram: int = 4
    #: Added to every count.
    smoothing: float = 0.5


@dataclass(frozen=True)
class Model:
    """langs in order; a row of log frequencies for each word and n-gram."""

    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    longest_gram: int

    def back_off(self, word: str) -> np.ndarray:
        """Mean scores of the longest known n-grams of an unseen word; zeros if not even a letter is known."""
        padded = f"^{word}$"
        for n in range(min(self.longest_gram, len(padded)), 0, -1):
            known = [i for i in (self.grams.get(padded[k : k + n]) for k in range(len(padded) - n + 1)) if i is not None]
            if known:
                return self.gram_scores[known].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None, kept: dict[str, np.ndarray]) -> tuple[str, float]:
        """kept: the back-off scores of words seen before, so that each is worked out once."""
        found = words_of(text)
        if not found or not self.langs:
            return UNKNOWN, 0.0
        scores = np.zeros(len(self.langs))
        known = [i for i in map(self.words.get, found) if i is not None]
        for at in range(0, len(known), 1 << 14):
            scores += self.word_scores[known[at : at + (1 << 14)]].sum(axis=0)
        if len(known) < len(found):
            for word in found:
                if word not in self.words:
                    if (s := kept.get(word)) is None:
                        s = kept[word] = self.back_off(word)
                    scores += s
        scores /= len(found)
        best = int(np.argmax(scores))
        return self.langs[best], float(1 / np.exp(scores - scores[best]).sum())


def tokens(labelled: DataFrame) -> DataFrame:
    """(token, lang, n) over rows (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for text, lang in zip(*(batch.column(n).to_pylist() for n in ("text", "lang"))):
                counts.update((word, lang) for word in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([x for _, x in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["token", "lang", "n"])
        give_back()

    return labelled.select("text", "lang").mapInArrow(run, "token string, lang string, n long").groupBy("token", "lang").agg(F.sum("n").alias("n"))


def grams(words: DataFrame, longest: int) -> DataFrame:
    """(n-gram, lang, n) of distinct words with their counts; the ends of words are marked."""
    padded = words.select("lang", "n", F.concat(F.lit("^"), "token", F.lit("$")).alias("w"))
    at = F.expr(f"flatten(transform(sequence(1, least({longest}, length(w))), k -> transform(sequence(1, length(w) - k + 1), i -> substring(w, i, k))))")
    return padded.select("lang", "n", F.explode(at).alias("token")).groupBy("token", "lang").agg(F.sum("n").alias("n"))


def table_of(counts: DataFrame, langs: list[str], smoothing: float) -> tuple[dict[str, int], np.ndarray]:
    """All tokens of the labelled rows, which bound them, and their log frequencies in each language."""
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(langs)]
    if not langs:
        return {}, np.zeros((0, 0), np.float32)
    rows = counts.groupBy("token").agg(*each).toArrow().sort_by("token")
    ids = {t: i for i, t in enumerate(rows.column("token").to_pylist())}
    n = np.column_stack([rows.column(f"c{i}").to_numpy() for i in range(len(langs))]).astype(np.float32)
    return ids, np.log(n + np.float32(smoothing)) - np.log(n.sum(axis=0, dtype=np.float64) + smoothing * (len(ids) + 1)).astype(np.float32)


def fit(labelled: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from labelled rows only; those without id, text or label are left out."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    n_rows = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(n_rows)
    share = F.lit(1.0)
    for lang, n in n_rows.items():
        share = F.when(F.col("lang") == lang, min(1.0, params.train_rows_per_lang / n)).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    words = tokens(picked).persist()
    word_ids, word_scores = table_of(words, langs, params.smoothing)
    gram_ids, gram_scores = table_of(grams(words, params.longest_gram), langs, params.smoothing)
    words.unpersist()
    pa.default_memory_pool().release_unused()
    return Model(langs, word_ids, word_scores, gram_ids, gram_scores, params.longest_gram)


#: Back-off scores that a task keeps for words it has seen; beyond that it starts anew.
KEPT_WORDS = 50_000


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the winner's share, 0 to 1) of every row; nothing but the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = shared.value, {}
        for batch in batches:
            got = []
            for x in batch.column(1):
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                got.append(own.predict(x.as_py(), kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def select_identified(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known with such a score at least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            found = [shared.value.predict(x.as_py(), kept) for x in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """True for the third of the ids that takes no part in training; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Fits on the rows that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(~held_out()), params)
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
