"""The pipeline's stages on a small table, each on what the one before kept."""

import gc
import random
import re
from pathlib import Path

import numpy as np
from tests.llm.test_operators import SCHEMA, awkward_rows

import corpus_pipeline
from stallwise.llm import near_copies, packing
from stallwise.llm.shared import give_back, tokenizer_path


def test_stages_keep_the_columns_and_clean_documents(spark):
    rows = awkward_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), None if name == "best_fit_packing" else "doc_id long, text string, lang string, source string, n_chars long")
        sizes.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert sizes[0] < len(rows) and sizes[2] < sizes[1]
    left = {r["doc_id"] for r in docs.collect()}
    assert {r[0] for r in rows[19:39]} <= left | {None}, "clean prose stays"


def test_every_dealt_operator_is_registered():
    from stallwise.llm import queries

    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14)) and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def five_word_sets(text):
    words = text.lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_of_similarity_at_least_four_fifths_go(spark):
    """Copies of 30 to 1,000 words with some words changed, below and above the bound, beside a passage that all share."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, passage = [], [word() for _ in range(12)]
    for n, changes in [(30, 1), (100, 1), (100, 2), (100, 3), (100, 5), (300, 5), (300, 6), (300, 9), (1000, 10), (1000, 30)] * 2:
        base = [word() for _ in range(n)] + passage
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for k in rng.sample(range(n), changes):
                copy[k] = word()
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["a b c d e f g", "a b c", "a b c", "", " "]
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    sets, root = [five_word_sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(rows)):
        for j in range(i):
            shared, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * shared >= 4 * either:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    expected = {i for i in range(len(rows)) if root[i] == i}
    assert left == expected and len(rows) - len(expected) > 30
    # The same with every shared shingle a crowded one, in blocks of a few rows, and with ids too many to broadcast.
    for params in (near_copies.Params(few=1, block_rows=2), near_copies.Params(few=2, block_rows=5, broadcast_ids=0)):
        found = near_copies.near_copies(docs, params).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(root))


def test_a_crowd_of_near_copies_is_one_component_where_links_lead(spark):
    """Copies of one text with ever more words changed: beside those that link, some are near to few others only."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, texts = [word() for _ in range(60)], []
    for n in range(120):
        copy = list(base)
        for k in rng.sample(range(60), n % 4):
            copy[k] = word()
        texts.append(" ".join(copy))
    sets, root = [five_word_sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for params in (near_copies.Params(), near_copies.Params(few=3, block_rows=7), near_copies.Params(few=3, sample_rows=10)):
        found = near_copies.near_copies(docs, params).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(root))
    assert 1 < len(set(root)) < 60


def test_near_copies_without_rows_ids_or_words(spark):
    schema = "doc_id long, text string, token int, root string"
    assert near_copies.near_copies(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", 1, "x"), (7, None, 1, "x"), (5, "", 1, "x"), (9, " \n", 1, "x"), (4, "a b c d e f", 1, "x"), (4, "a b c d e f", 1, "x"), (3, "A B C d e f", 1, "x"), (2, "a b c d e g", 1, "x")]
    found = near_copies.near_copies(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, found)) == [(2, 2), (3, 3), (4, 3), (4, 3), (5, 5), (7, 5), (9, 5)]


def test_packed_rows_hold_their_tokens(spark):
    """The ids of a document's pieces are those of the tokenizer, and those of a sequence stand side by side."""
    from tokenizers import Tokenizer

    from stallwise.llm.queries import tokenizer_path

    texts = ["one text", "of these words " * 900, "", "another"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.pack_sequences(spark, docs, "").collect()
    own = Tokenizer.from_file(tokenizer_path())
    for i, text in enumerate(texts):
        ids = [x for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]) for x in r["ids"]]
        assert ids == own.encode(text, add_special_tokens=False).ids + [2]
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert len(sequences.setdefault(r["sequence_id"], [])) == r["offset"]
        sequences[r["sequence_id"]] += r["ids"]
    assert sum(map(len, sequences.values())) == sum(r["length"] for r in rows) and max(map(len, sequences.values())) <= 1024


def test_fingerprints_link_what_shingle_sets_do_not(spark, monkeypatch):
    """The stage named after SimHash takes its links, and chains through both kinds of links are one component."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(50)) for _ in range(5)]
    texts[3] = texts[2] + " more"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    # Fingerprints that hold 1 and 2 for neighbours, and all else for strangers.
    prints = spark.createDataFrame([(0, 0), (1, 0xF0F0), (2, 0xF0F1), (3, 0xAAAA0000), (4, 0x5555_0000_0000)], "doc_id long, fp long")
    monkeypatch.setattr(corpus_pipeline.simhash, "fingerprints", lambda *a: prints)
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()} == {0, 1, 4}


def test_crowds_of_common_shingles_grow_with_the_table(spark):
    """Texts that each share rare shingles with one other text and others with many: whatever the number of rows, what many
    share is told from what few do, so that few rows wait at crowded shingles."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passages = [" ".join(word() for _ in range(8)) for _ in range(60)]

    def crowd(n: int, params: near_copies.Params) -> int:
        passage = lambda: rng.choice(passages[: n // 20])  # noqa: E731  each in about 60 texts
        docs = spark.createDataFrame([(i, " ".join([passage(), passage(), passage(), *(word() for _ in range(9))])) for i in range(n)], "doc_id long, text string").repartition(3)
        texts = near_copies.of_texts(docs, "doc_id", "text")
        known = spark.sparkContext.broadcast(near_copies.common(texts, n, params))
        dealt = near_copies.postings(texts, known, params).repartition("deal").sortWithinPartitions("deal")
        return dealt.mapInArrow(lambda batches: near_copies.meet(batches, params), near_copies.MET).filter(f"kind = {near_copies.CROWD}").count()

    # The exact numbers of the few most common ones, and of none but one.
    for params in (near_copies.Params(sample_rows=30), near_copies.Params(sample_rows=30, max_common=1)):
        small, large = crowd(200, params), crowd(1200, params)
        assert large <= 12 * max(small, 10), (small, large)


def test_a_worker_gives_back_what_it_has_freed():
    held_mb = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024
    arrays = [np.ones(100_000 // 8) for _ in range(2000)]
    pinned = arrays[::50]  # what lies among them stays, so that the heap can't just end sooner
    full = held_mb()
    del arrays
    gc.collect()
    give_back()
    assert len(pinned) == 40 and held_mb() < full - 150


def test_a_worker_keeps_no_second_vocabulary_for_marks_that_few_texts_hold():
    own = packing.Encoder(tokenizer_path())
    plain, marked = "no mark is here", f"here {own.marks[0]} is one"
    got = own.encode(plain)
    assert "tokenizer" not in vars(own)
    for text, ids in ((plain, got), (marked, own.encode(marked))):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_stages_send_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "a text", "en", "s", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name == "line_dedup":  # without Python
            continue
        spark.conf.set(key, str(64 << 20))
        stage(spark, docs, "")
        assert int(spark.conf.get(key).rstrip("b")) <= 2 << 20, name
    spark.conf.set(key, before)


def test_each_of_several_texts_with_one_id_links_at_crowded_shingles(spark):
    """Half of the texts share few ids: a text's links are told by its own shingles, not by those of another text with its id."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, rows = [word() for _ in range(12)], []
    for family in range(8):
        base = [word() for _ in range(rng.choice([20, 40, 60]))] + passage
        for n in range(12):
            copy = list(base)
            for k in rng.sample(range(len(base)), n % 3):
                copy[k] = word()
            rows.append((rng.randrange(6) if n % 2 else 10 + len(rows), " ".join(copy)))
    sets, root = [five_word_sets(t) for _, t in rows], {i: i for i, _ in rows}
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                both = {root[rows[i][0]], root[rows[j][0]]}
                root = {x: min(both) if r in both else r for x, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for params in (near_copies.Params(few=1, block_rows=7), near_copies.Params(few=3, sample_rows=10)):
        found = near_copies.near_copies(docs, params).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == root


def test_near_copies_without_an_id_or_with_one_that_repeats_go_too(spark):
    """Rows without an id and further rows with an id are held against all others; each text that has no copy stays."""
    rng = random.Random(29)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(40))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a), (4, a), (2, b), (2, b), (2, c), (None, d), (None, d + " end"), (7, c + " end"), (9, e), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert left.columns == corpus_pipeline.COLUMNS
    kept = [(r["doc_id"], r["text"]) for r in left.collect()]
    texts = [t for _, t in kept]
    assert (4, a) in kept and (9, e) in kept and texts.count(a) == texts.count(b) == 1
    assert texts.count(c) + texts.count(c + " end") == 1 and texts.count(d) + texts.count(d + " end") == 1 and texts.count(None) + texts.count("") == 1
    assert len(kept) == 6
