"""The pair model against counting in dictionaries, and what must hold of any such model."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stallwise.llm import language_model as lm

SCHEMA = "doc_id long, text string, score string, n_tokens string, shard string"


def words_of(text):
    return (text or "").encode().lower().split() + [None]


def apart(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def discounts(ns):
    n = [0, *ns]
    if min(n[1:4]) > 0:
        y = n[1] / (n[1] + 2 * n[2])
        d = [0.0] + [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
        if all(0 <= x <= i for i, x in enumerate(d)):
            return d
    return [0.0, 0.5, 1.0, 1.5]


class Plain:
    def __init__(self, texts):
        self.words, self.pairs, self.first = Counter(), Counter(), Counter()
        for text in texts:
            before = ""
            for w in words_of(text):
                self.words[w] += 1
                self.pairs[before, w] += 1
                self.first[before] += 1
                before = w
        self.follows = Counter(w for _, w in self.pairs)
        self.kinds = defaultdict(lambda: [0, 0, 0, 0])
        for (h, _), c in self.pairs.items():
            self.kinds[h][min(c, 3)] += 1
        self.d2 = discounts([sum(c == i for c in self.pairs.values()) for i in range(1, 5)])
        self.d1 = discounts([sum(c == i for c in self.follows.values()) for i in range(1, 5)])
        self.n, self.v = sum(self.words.values()), len(self.words)

    def alone(self, w):
        if not self.pairs:
            return 1.0
        left = sum(self.d1[min(k, 3)] for k in self.follows.values()) / len(self.pairs)
        k = self.follows[w]
        return max(0, k - self.d1[min(k, 3)]) / len(self.pairs) + left / (self.v + 1)

    def p(self, w, h):
        if h not in self.first:
            return self.alone(w)
        c, n = self.pairs[h, w], self.first[h]
        left = sum(d * k for d, k in zip(self.d2, self.kinds[h])) / n
        return max(0, c - self.d2[min(c, 3)]) / n + left * self.alone(w)

    def score(self, text):
        found, before = words_of(text), ""
        base = sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in found)
        total = 0.0
        for w in found:
            total += math.log10(self.p(w, before))
            before = w
        return len(found), sum(w in self.words for w in found), base, total


def texts(rng, n):
    vocabulary = ["la", "le", "de"] * 9 + ["".join(rng.choices("abcdé", k=rng.randrange(1, 4))) for _ in range(60)]
    found = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))).upper() for _ in range(n)]
    return found + ["", None, " \n", "\x0bx\x1cy\xa0z \t", "one", "one", "same words " * 400, "unseen-before"]


def rows_of(spark, rows, params=lm.Params()):
    docs = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    return docs, lm.score(docs, params).collect()


@pytest.mark.parametrize("params", [lm.Params(), lm.Params(shard_bytes=700, run_keys=40)])
def test_scores_are_those_of_plain_counting(spark, params):
    rng = random.Random(8)
    rows = list(enumerate(texts(rng, 150))) + [(None, "la le de without id"), (3, "repeated id la le")]
    plain = Plain([t for i, t in rows if not apart(i)])
    _, found = rows_of(spark, rows, params)
    assert len(found) == len(rows)
    want = sorted((i is None, i or 0, apart(i), *plain.score(t)) for i, t in rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in found)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9), (a, b)
    assert {r["train_tokens"] for r in found} == {plain.n}
    for r in found:
        assert r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_probabilities_sum_to_one_and_the_model_beats_the_base(spark):
    rng = random.Random(1)
    given = texts(rng, 120)
    model = lm.fit(spark.createDataFrame([(t,) for t in given], "text string"), lm.Params(shard_bytes=2000, run_keys=100))
    known = sorted({w for t in given for w in words_of(t)} - {None})
    for before in ("la", "one", "nobody knows"):
        h = model.score(pa.array([before]))[3][0]
        ended = 10 ** (h)
        # p(text + word + end) / p(end | word) over all words, then the end and an unseen word.
        ahead = [before.split()[-1] + " " + w.decode() for w in known] + [before.split()[-1] + " ¿unseen"]
        total = 0.0
        plain = Plain(given)
        for text, w in zip(ahead, [*known, b"\xc2\xbfunseen"]):
            both = model.score(pa.array([text]))[3][0]
            first = plain.p(before.split()[-1].encode(), "")
            total += 10**both / first / plain.p(None, w)
        first = plain.p(before.split()[-1].encode(), "")
        total += model_end(model, before.split()[-1]) / first
        assert total == pytest.approx(1, abs=1e-9) and ended > 0
    held = texts(random.Random(2), 60)
    _, _, base, score = model.score(pa.array(held))
    assert score.sum() > base.sum()


def model_end(model, word):
    return 10 ** model.score(pa.array([word]))[3][0]


def test_no_rows_and_no_training_rows(spark):
    assert rows_of(spark, [])[1] == []
    only = next(i for i in range(100) if apart(i))
    _, found = rows_of(spark, [(only, "a b")])
    assert (found[0]["n_tokens"], found[0]["n_known"], found[0]["train_tokens"], found[0]["base_score"], found[0]["score"]) == (3, 0, 0, 0.0, 0.0)


def test_packing_keeps_numbers_and_files_give_arrays(tmp_path):
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 999).astype(np.uint64) * np.uint64(2))
    assert (lm.unpacked(lm.packed(keys, True), np.uint64, True) == keys).all()
    counts = rng.integers(0, 1 << 32, 77).astype(np.uint32)
    assert (lm.unpacked(lm.packed(counts), np.uint32) == counts).all()
    lm.write(f"{tmp_path}/x", keys, counts, np.zeros(0, np.int64))
    got = lm.mapped(f"{tmp_path}/x", "u8", "u4", "i8")
    assert (got[0] == keys).all() and (got[1] == counts).all() and not len(got[2])


def test_held_out_text_of_the_given_table_is_likelier_than_by_its_words(spark):
    found = lm.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("held_out and n_tokens > 20").toPandas()
    assert len(found) > 20 and (found["score"] > found["base_score"]).mean() > 0.8
