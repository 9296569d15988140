"""Each operator on a small table of awkward rows, against a brute-force version where there is one."""

import base64
import hashlib
import math
import random
import re
import types
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from stallwise.llm import compression_bands, language_id, line_dedup, metric_search, packing, page_text, piece_sampling, preferences, simhash, suffix_dedup
from stallwise.llm.queries import tokenizer_path
from stallwise.llm.suffix_merge import least_owner

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words int, carried string"
WORDS = {"en": "the of and to in that was with for house water light".split(), "de": "der die und das nicht haus wasser licht mit von für".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "ing", "heit", "ß"]) for _ in range(n))


def awkward_rows():
    """Nulls in any column, empty, short and long texts, copies, near copies, shared passages, repeated rows; and
    columns named as the operators' own."""
    rng = random.Random(7)
    passage = prose(rng, "en", 60)
    base = prose(rng, "de", 200)
    texts = [None, "", " \n\t ", "one", "two words", "a\nb\nc\nd", "###$$$ 123", "日本語のテキスト" * 20, "x" * 3000, base, base, base + " end", "q " + base]
    texts += [prose(rng, "en", 80) + "\n" + passage + "\n" + prose(rng, "de", 50) for _ in range(4)]
    texts += ["\n".join(["line one", "line two", "line three", prose(rng, "en", 5), "line one", "line two", "line three"]) for _ in range(2)]
    texts += [prose(rng, lang, 60) for lang in ("en", "de") for _ in range(10)]
    texts += [prose(rng, "en", 6000)]
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), "k", 1, None) for i, t in enumerate(texts)]
    rows += [rows[9], (None, base, "de", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty):
    path = tokenizer_path()
    got = packing.pack(docs, path).toPandas()
    from tokenizers import Tokenizer

    own, expected = Tokenizer.from_file(path), []
    for doc_id, text, *_ in awkward_rows():
        ids = own.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected += [(-1 if doc_id is None else doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    found = [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(found) == sorted(expected)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert (rows.offset == rows.length.cumsum() - rows.length).all() and rows.length.sum() <= 1024
    assert packing.pack(empty, path).count() == 0


def test_ids_reach_their_places_without_a_second_way_through_python(docs):
    """A row of a thousand ids stays with Spark when its place is looked up; only its length and rank go to a worker."""
    got = packing.pack(docs, tokenizer_path(), with_ids=True)
    steps = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Python" in line or "InArrow" in line]
    assert len(steps) == 1 and "length" in steps[0] and "ArrowEvalPython" in steps[0]
    rows = got.collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    taken = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip([(-1, 0, 0), *taken], taken))


def test_packing_plan_keeps_every_piece():
    rng = random.Random(3)
    for _ in range(100):
        capacity = rng.choice([10, 50, 1024])
        counts: dict[int, int] = {}
        for _ in range(rng.randint(0, 200)):
            n = rng.randint(1, capacity)
            counts[n] = counts.get(n, 0) + 1
        placed: dict[int, int] = {}
        for pattern, times in packing.plan(counts, capacity):
            assert sum(a * b for a, b in pattern) <= capacity
            for a, b in pattern:
                placed[a] = placed.get(a, 0) + b * times
        assert placed == counts


def test_dominance_fixes_exact_fills():
    counts = {6: 2, 4: 2, 3: 1}
    assert sum(n for _, n in packing.reduce_by_dominance(counts, 10)) == 3 and not counts


def oracle(sql, rows, schema="doc_id bigint, text varchar"):
    con = duckdb.connect()
    name = "documents" if "doc_id" in schema else "conversations"
    con.execute(f"create table {name} ({schema})")
    con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    return con.execute(sql).fetch_df()


def test_line_dedup(spark, docs, empty):
    rows = [(r[0], r[1]) for r in awkward_rows()[:-3]]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "n_spans", "text").toPandas()
    expected = oracle(line_dedup.ORACLE, rows)
    as_rows = lambda df: sorted((int(r.doc_id), int(r.n_lines), int(r.n_removed), int(r.n_spans), r.text if isinstance(r.text, str) else None) for r in df.itertuples())
    assert as_rows(found) == as_rows(expected) and found.n_removed.sum() > 0
    assert line_dedup.dedup_lines(docs, carry=["lang", "n_chars"]).count() == len(awkward_rows())
    assert line_dedup.dedup_lines(empty).count() == 0


def suffix_brute(rows, length=50):
    data = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(i, first.get(b[k : k + length], i))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("params", [suffix_dedup.Params(), suffix_dedup.Params(bucket_bytes=2000, hot_rows=1)])
def test_suffix_dedup(docs, empty, params):
    got = suffix_dedup.remove_repeats(docs, params).toPandas()
    found = sorted((-(1 << 63) if r.doc_id != r.doc_id else int(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples())
    expected = suffix_brute([(r[0], r[1]) for r in awkward_rows()])
    assert found == expected and sum(r[2] for r in found) > 0
    assert suffix_dedup.remove_repeats(empty, params).count() == 0


def test_suffix_text_stays_whole_characters(spark):
    rows = [(1, "é" * 40 + "a"), (2, "ü" + "é" * 40 + "b")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: rows[0][1], 2: "üb"}


def test_merged_transforms_find_the_least_owner():
    rng = random.Random(5)
    for _ in range(40):
        base = bytes(rng.choice(b"ab\0") for _ in range(90))
        strings = list({base[a : a + rng.randint(20, 60)] for a in rng.choices(range(20), k=12)})
        owners, first = np.array([rng.randint(0, 5) for _ in strings]), {}
        for s, o in zip(strings, owners):
            for k in range(len(s) - 11):
                first[s[k : k + 12]] = min(o, first.get(s[k : k + 12], 9))
        assert least_owner(strings, owners, 12).tolist() == [first[s[k : k + 12]] for s in strings for k in range(len(s) - 11)]


def test_preferences(spark, empty):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if i < 4 or t < 2 else f"{i} {t}") for i in range(8) for t in range(i % 4 + 1)]
    rows += [rows[0], (9, 0, None, None), (None, 0, "user", "x"), (6, None, "user", "early")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = preferences.adjacent_preferences(turns).toPandas().fillna(-1)
    expected = oracle(preferences.ORACLE, rows, "conv_id bigint, turn bigint, role varchar, text varchar").fillna(-1)
    columns = sorted(found.columns)
    assert sorted(expected.columns) == columns
    plain = lambda df: sorted(tuple(str(int(x)) if isinstance(x, float | np.integer) else str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert plain(found) == plain(expected) and found.n_common.max() > 0
    assert preferences.adjacent_preferences(turns.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body><header class="masthead"><a href=/>Site</a></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice"><p>We use cookies on this site, do accept them all.</p></div>
<article><h1>The  title &amp; more</h1><p>First paragraph of <b>the text<br>goes on. It is long enough to be one.<p>Second one, with 3 &lt; 5 and a bit more text in it.
<div class="ad">Buy now</div></article><aside class="sidebar"><h3>Related</h3><ul><li><a href="#">Other</a></li></ul></aside>
<form><p>Subscribe to us</p><input></form><section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this article a lot, thank you for writing it.</p></div></section>
<script>var a = "<p>no</p>";</script><footer>&copy; 2024</footer></body>"""


def test_page_text(spark):
    rows = [(i, f"http://x/{i}", PAGE.replace("title", f"title {i}")) for i in range(6)] + [(7, None, None), (8, "u", ""), (None, "u", PAGE), (9, "u", "plain <")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in page_text.extract(pages, page_text.Params(trees=8)).collect()}
    assert got[2]["text"] == "The title 2 & more\n\nFirst paragraph of the text goes on. It is long enough to be one.\n\nSecond one, with 3 < 5 and a bit more text in it."
    assert got[2]["n_chars"] == len(got[2]["text"]) and got[7]["text"] == got[8]["text"] == "" and got[9]["text"] == "plain <"
    assert page_text.extract(pages.limit(0)).count() == 0


def test_comments_end_where_html_ends_them():
    from stallwise.llm.page_dom import read

    for comment in ("<!-->", "<!--->", "<!---->", "<!-- c -->", "<!-- c --!>", "<!--!> x -->", "<!-- a -- b > c -->", "<!--<p>x</p>-->"):
        assert [t for _, t in read(f"<p>a</p>{comment}<p>b</p>").texts] == ["a", "b"], comment


def test_training_pages_are_chosen_by_id_and_page(spark):
    """Neither equal nor null ids bring all pages to the driver, and copies count once."""
    html = "<html><body><nav><a href=x>menu</a></nav><article><p>{}</p></article></body></html>"
    rows = [(None if i % 2 else 7, html.format(f"text number {i} " * 20)) for i in range(400)] + [(1, html.format("copy " * 30))] * 50
    pages = spark.createDataFrame([(*r, "u", "t", 0, "f", 0.0) for r in rows], "page_id long, html string, url string, text string, n_chars int, features string, label double")
    seen = []
    real = page_text.examples
    page_text.examples = lambda pages, params: seen.extend(pages) or real(pages, params)
    try:
        page_text.fit(pages, page_text.Params(train_pages=40, trees=2))
    finally:
        page_text.examples = real
    assert 10 < len(seen) < 90 and len(set(seen)) == len(seen)
    assert page_text.extract(pages).count() == len(rows)


def test_pages_of_any_length_count_siblings_of_a_kind():
    from stallwise.llm.page_dom import FEATURES, features, read

    page = read("<article>" + "<p>text</p>" * 300 + "<nav>menu</nav></article>")
    alike = {n.tag: row[FEATURES.index("like_siblings")] for n, row in zip(page.nodes, features(page))}
    assert alike["p"] == 300 and alike["nav"] == 1


@pytest.mark.parametrize(
    "html, texts",
    [
        ('<div><svg class="icon"/><p>one</p></div><p>two</p>', ["one", "two"]),
        ("<div><canvas>one</div><p>two</p>", ["one", "two"]),
        ("<p><b><button>no</b> one</p><p>two</p>", ["one", "two"]),
        ("<div><svg><path><p>one</p></div><p>two</p>", ["one", "two"]),
        ("<datalist><option>no<option>no</datalist><p>two</p>", ["two"]),
        ("<ul><li>one <object>more<li>two</ul>", ["one more", "two"]),
        ("<p>if <math><mi>a</mi></math> holds <video>more</video></p>", ["if a holds more"]),
        ("<html><head><title>no</title><p>Hello world</p>", ["Hello world"]),
        ("<p>one</p><div><button>more</div><p>two</p>", ["one", "two"]),
        ('if a<b then "x</p><p>second " p', ["if a", 'second " p']),
        ('<p title="a>b" class=x>one</p><p data-x=">">two', ["one", "two"]),
        ("<div><button><div>no</div>no</button>one</div>", ["one"]),
        ("<svg><foreignObject><p>no</p></foreignObject></svg><p>two</p>", ["two"]),
        ("<head><title>no</title><meta charset=x><p>one</p><p>two</p>", ["one", "two"]),
        ("<head><noscript>no</noscript></head><div>one</div>", ["one"]),
    ],
)
def test_hidden_elements_end(html, texts):
    from stallwise.llm.page_dom import read

    assert [t for _, t in read(html).texts] == texts


def test_language_id(docs, empty, spark):
    got = language_id.identify(docs).toPandas()
    assert len(got) == len(awkward_rows())
    by_id = {int(r.doc_id): r for r in got[got.doc_id.notna()].itertuples()}
    for i, text, *_ in awkward_rows()[:-2]:
        held = zlib.crc32(str(i).encode()) % 3 == 1
        assert by_id[i].held_out == held and 0 <= by_id[i].score <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert by_id[i].lang_pred == "und"
    labelled = [(i, prose(random.Random(i), lang, 30), lang) for i, lang in enumerate(["en", "de"] * 60)]
    found = language_id.identify(spark.createDataFrame(labelled, "doc_id long, text string, lang string")).toPandas()
    right = sum(r.lang_pred == labelled[int(r.doc_id)][2] for r in found.itertuples() if r.held_out)
    assert right >= 0.95 * found.held_out.sum()
    assert language_id.identify(empty).count() == 0


def test_language_scores_equal_a_plain_count(spark):
    """Back-off and scores against counts taken by hand; signs of numbers are no letters, nor do they part of words."""
    train = [(3, "the cat sat", "en"), (4, "the dog ½ the", "en"), (5, "der hund der", "de"), (7, None, "de"), (8, "x", None)]
    rows = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language_id.fit(rows, language_id.Params(longest_gram=2))
    assert model.langs == ["de", "en"] and set(model.words) == {"the", "cat", "sat", "dog", "der", "hund"}

    def score(token, tables):
        known = {t for c in tables.values() for t in c}
        return np.array([np.log(tables[x].get(token, 0) + 0.5) - np.log(sum(tables[x].values()) + 0.5 * (len(known) + 1)) for x in ("de", "en")])

    words = {"en": {"the": 3, "cat": 1, "sat": 1, "dog": 1}, "de": {"der": 2, "hund": 1}}
    grams = {x: {} for x in words}
    for lang, counts in words.items():
        for word, n in counts.items():
            padded = f"^{word}$"
            for size in (1, 2):
                for k in range(len(padded) - size + 1):
                    grams[lang][padded[k : k + size]] = grams[lang].get(padded[k : k + size], 0) + n
    unseen = np.mean([score(g, grams) for g in ("th", "he")], axis=0)  # of "^zthez$", the pairs that are known
    for text, means in (("The dog", (score("the", words) + score("dog", words)) / 2), ("zthez, der", (unseen + score("der", words)) / 2)):
        share = np.exp(means) / np.exp(means).sum()
        lang, got = model.predict(text, {})
        assert lang == ("de", "en")[int(np.argmax(means))] and abs(got - share.max()) < 1e-5
    assert model.predict("½ ② 10 Ⅷ ²", {}) == ("und", 0.0)
    assert language_id.words_of("Ab½cd x² ①") == ["ab", "cd", "x"]


def test_metric_search(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 8)) / 3
    vectors[100:400] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(3, vectors[3].tolist()), (1000, None), (1100, [1.0, None] * 4), (1200, [float("nan")] * 8), (None, vectors[0].tolist()), (1300, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = metric_search.top_k(table, table.filter("vec_id % 100 = 0"), metric_search.Params(sample=50, region_rows=100, page_rows=60, leaf_rows=7, block_queries=2))
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())
    whole = np.floor(1024 * vectors).astype(np.int64)
    expected = []
    for q in range(0, 700, 100):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found == expected
    assert metric_search.top_k(table.limit(0), table.limit(0)).count() == 0


def test_metric_search_returns_k_ids_where_ids_have_several_vectors(spark):
    """Twelve vectors of one id are its best one, and leave room for the others, within a page and over pages."""
    rng = random.Random(6)
    rows = [(1, [5.0 + k / 8, 1.0]) for k in range(12)] + [(i, [rng.random(), rng.random()]) for i in range(2, 29)] + [(0, [1.0, 0.5]), (100, [0.5, 1.0]), (100, [0.25, 0.5])]
    rows += [(29, [2.0**40, 0.0]), (29, [2.0**39, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, tuple(math.floor(1024 * c) for c in v)) for i, v in rows]
    for params in (metric_search.Params(), metric_search.Params(page_rows=6, region_rows=10, leaf_rows=3)):
        got = {}
        for r in metric_search.top_k(table, table.filter("vec_id % 100 = 0"), params).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in (0, 100):
            best = {}
            for i, v in whole:
                if i != q:
                    best[i] = max([best.get(i, -(10**30))] + [sum(a * b for a, b in zip(v, w)) for j, w in whole if j == q])
            want = sorted((-s, i) for i, s in best.items())[:10]
            assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_metric_search_holds_large_and_empty_vectors(spark):
    """Components that 32 bits or doubles can't hold after scaling take part, exactly; empty vectors score 0."""
    rows = [(0, [3e6, 1.0]), (1, [2.0**20 + 0.25, -1e-3]), (2, [-(2.0**20), 0.5]), (3, [1e-9, 2.0]), (100, [5e5, -7.25]), (200, []), (4, []), (300, [1e-3, 1e-3])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in metric_search.top_k(table, table.filter("vec_id % 100 = 0"), metric_search.Params(k=3, page_rows=2, region_rows=2)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for q, x in whole:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q and len(y) == len(x))[:3]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    with pytest.raises(Exception, match="OverflowError"):
        huge = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
        metric_search.top_k(huge, huge).count()


def test_metric_search_leaves_out_what_cannot_count():
    """Near one of many clusters, few objects are scored, and the best are those of all."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(64, 4)) * 1000
    vecs = np.floor(centers[rng.integers(0, 64, 4000)] + rng.normal(size=(4000, 4)) * 5).astype(np.int64)
    vecs = np.floor(3000 * vecs / np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))).astype(np.int64)
    top = float((vecs * vecs).sum(axis=1).max())
    points = metric_search.lifted(vecs, top)
    pivots = points[:1]
    sizes, radii, routers, dists, order = [], [], [], [], []
    for at in metric_search.leaves(points, 64):
        d = metric_search.distances(points[at], points[at[:1]])[:, 0]
        by = np.argsort(d)
        sizes, radii, routers, dists, order = [*sizes, len(at)], [*radii, d.max()], [*routers, points[at[0]]], [*dists, d[by]], [*order, at[by]]
    order, routers = np.concatenate(order), np.array(routers)
    page = types.SimpleNamespace(region=0, sizes=np.array(sizes).tobytes(), radii=np.array(radii).tobytes(), to_pivot=metric_search.distances(routers, pivots)[:, 0].tobytes(), routers=routers.tobytes(), dists=np.concatenate(dists).tobytes(), ids=order.tobytes(), vecs=vecs[order].astype("<i4").tobytes())
    queries = np.arange(0, 4000, 100)
    best = metric_search.search(vecs[queries], queries, np.full(len(queries), -np.inf), page, metric_search.Frame(top, pivots, None, None, None), 10)
    for q, ids, scores in zip(queries, best.ids, best.scores):
        expected = sorted((-int(s), i) for i, s in enumerate(vecs @ vecs[q]) if i != q)[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids)] == expected
    assert best.scored < 0.2 * len(queries) * len(vecs)


def test_piece_sampling(docs, empty):
    params = piece_sampling.Params(tokenizer_path("piece_bpe_32k.model"))
    got = piece_sampling.round_trip(docs, params).toPandas()
    assert got.lossless.all() and len(got) == len(awkward_rows())
    again = piece_sampling.round_trip(docs.repartition(7), params).toPandas()
    key = ["n_ids", "ids_crc32"]
    assert sorted(map(str, got[key].itertuples(index=False))) == sorted(map(str, again[key].itertuples(index=False)))
    assert piece_sampling.decode(piece_sampling.encode(docs, params), params).filter("text = 'two words'").count() == 1
    assert piece_sampling.round_trip(empty, params).count() == 0


def test_piece_sampling_follows_the_weights():
    vocab = piece_sampling.Vocabulary(tokenizer_path("piece_bpe_32k.model"), 1.0)
    ids = {vocab.bytes[i].decode(errors="replace"): i for i in range(259, vocab.size)}

    def ways(text):
        if not text:
            return [((), 0.0)]
        return [((ids[text[:n]], *rest), vocab.weight[ids[text[:n]]] + w) for n in range(1, len(text) + 1) if text[:n] in ids for rest, w in ways(text[n:])]

    all_ways = ways(" there")
    total = sum(np.exp(w) for _, w in all_ways)
    drawn = piece_sampling.sample(["there"] * 20000, np.arange(20000), vocab, 1)
    counts: dict[tuple, int] = {}
    for d in drawn:
        counts[tuple(d.tolist())] = counts.get(tuple(d.tolist()), 0) + 1
    for way, w in all_ways:
        assert abs(counts.get(way, 0) / 20000 - np.exp(w) / total) < 0.02


def test_compression_bands(docs, empty):
    got = compression_bands.compression_bands(docs).toPandas()
    by_id = {int(r.doc_id): r for r in got[got.doc_id.notna()].itertuples()}
    for i, text, *_ in awkward_rows()[:-2]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        where = {}
        for k in range(len(words) - 7):
            where.setdefault(tuple(words[k : k + 8]), []).append(k)
        covered = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(8)}
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        r = by_id[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.base_failed and r.kept)
    bands = compression_bands.Bands()
    import zstandard

    judge = lambda t: compression_bands.judge(t.encode(), bands, zstandard.ZstdCompressor(level=3)).kept
    rng = random.Random(1)
    assert judge(prose(rng, "en", 300) + prose(rng, "de", 5)) and not judge(" ".join(base64.b64encode(rng.randbytes(12)).decode() for _ in range(300)))
    assert compression_bands.compression_bands(empty).count() == 0


def test_compression_bands_judge_the_rest_after_whole_chunks():
    import zstandard

    bands, packer, rng = compression_bands.Bands(), zstandard.ZstdCompressor(level=3), random.Random(2)
    head = "".join(rng.choice("abcdefgh  ") for _ in range(4096)).encode()
    noise = bytes(rng.choice(range(33, 126)) for _ in range(3000))
    found = compression_bands.judge(head, bands, packer)
    assert found.kept and (found.n_chunks, found.n_bad_chunks) == (1, 0)
    found = compression_bands.judge(head + noise, bands, packer)
    assert 0.25 <= found.ratio <= 0.75 and not found.base_failed and (found.n_chunks, found.n_bad_chunks) == (2, 1) and not found.kept
    mixed = compression_bands.judge(head + bytes(rng.choice(range(33, 126)) for _ in range(4096)) + head[:1000], bands, packer)
    assert mixed.n_bad_chunks == 1 and not mixed.kept, "a good rest doesn't save a text of bad chunks"


def test_compression_limits_move_without_a_jump(spark):
    """One text more or less moves a limit by little, however few there are, and given bands judge a part as the whole."""
    rng = random.Random(12)
    rows = [(i, prose(rng, "en", 120)) for i in range(60)] + [(60, "spam " * 130)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    band = compression_bands.band_of(len(rows[0][1]))
    spans = [compression_bands.fit(table.filter(f"doc_id < {n}")).fitted.get(band, compression_bands.Bands().fixed(len(rows[0][1]))) for n in (0, 4, 8, 27, 28, 29, 30, 31, 59, 60)]
    assert spans[0] == compression_bands.Bands().fixed(len(rows[0][1]))
    assert all(abs(a - b) < 0.03 for x, y in zip(spans[3:8], spans[4:8]) for a, b in zip(x, y))
    assert spans[0][0] < spans[1][0] < spans[-1][0] and spans[0][1] > spans[1][1] > spans[-1][1]
    bands = compression_bands.fit(table)
    whole = {r["doc_id"]: tuple(r) for r in compression_bands.compression_bands(table, bands).collect()}
    part = compression_bands.compression_bands(table.filter("doc_id % 7 = 4"), bands).collect()
    assert part and all(tuple(r) == whole[r["doc_id"]] for r in part)


def test_compression_bands_are_those_of_the_table(spark):
    """Limits and verdicts against a plain count over all texts; repetitive and noisy texts go, prose stays."""
    import zstandard

    rng, packer = random.Random(4), zstandard.ZstdCompressor(level=3)
    clean = [prose(random.Random(n), "en", 100 + n % 150) for n in range(300)]
    bad = [prose(random.Random(n), "en", 20) + " | ".join(rng.choice(["one", "two", "three"]) + str(rng.randint(0, 2)) for _ in range(200)) for n in range(8)]
    bad += [" ".join(base64.b64encode(rng.randbytes(12)).decode() for _ in range(60)) for _ in range(8)]
    texts = clean + bad + [clean[0]] * 40 + [None, "", "x"]
    rows = [(i, t, 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in compression_bands.compression_bands(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()}
    band = lambda t: int(4 * math.log2(len(t.encode())))
    ratio = lambda t: len(packer.compress(t.encode())) / len(t.encode())
    bins = {}
    for t in {t for t in texts if t}:
        bins.setdefault(band(t), []).append(int(1000 * ratio(t)))

    def inside(t, fence, least):
        near = sorted(x for b in (-1, 0, 1) for x in bins.get(band(t) + b, []))
        if len(near) < 30:
            low, high = next((a, b) for n, a, b in ((2048, 0.25, 0.75), (512, 0.28, 0.85), (128, 0.3, 1.1), (0, 0, 9)) if len(t.encode()) >= n)
        else:
            first, mid, third = (near[math.ceil(q * len(near)) - 1] / 1000 for q in (0.25, 0.5, 0.75))
            low, high = min(first - fence * (third - first), mid * (1 - least)), max(third + fence * (third - first), mid * (1 + least))
        return low <= ratio(t) <= high

    for i, t in enumerate(texts):
        r = got[i]
        assert r["kept"] == bool(t and not r["base_failed"] and inside(t, 2, 0.07) and inside(t, 4, 0.15))
    assert all(got[i]["kept"] for i in range(300)) and not any(got[i]["kept"] for i in range(300, 316))


def simhash_brute(rows):
    def fp(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    prints = [(i, fp(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            # A row without an id only joins an equal fingerprint.
            near = 0 if prints[a][0] is None or prints[b][0] is None else 2
            if (prints[a][1] ^ prints[b][1]).bit_count() <= near:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), f"{p:016x}", str(least.get(find(k)))) for k, (i, p) in enumerate(prints))


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == simhash_brute([(r[0], r[1]) for r in awkward_rows()])
    assert simhash.near_duplicates(empty).count() == 0


def test_crowded_anchors_link_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    base = np.uint64(rng.integers(1 << 62))
    fps = np.unique(np.array([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(46, 64, (60, 2))], np.uint64))
    home = np.ones(len(fps), bool)

    def groups(links):
        label = list(range(len(fps)))
        for a, b in links:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    direct = groups(simhash.crowd(fps, home, 2))
    monkeypatch.setattr(simhash, "DIRECT", 0)
    assert groups(simhash.crowd(fps, home, 2)) == direct and len(set(direct)) < len(fps)


def test_edges_contract_to_stars_of_the_same_components():
    from stallwise.llm.components import forest

    rng = np.random.default_rng(5)
    for n_nodes, n_edges in ((1, 3), (50, 20), (200, 220), (400, 399)):
        a, b = rng.integers(-n_nodes, n_nodes, (2, n_edges))
        least = {x: x for x in {*a.tolist(), *b.tolist()}}
        for _ in least:
            for x, y in zip(a.tolist(), b.tolist()):
                least[x] = least[y] = min(least[x], least[y])
        node, root = forest(a, b)
        assert dict(zip(node.tolist(), root.tolist())) == {x: y for x, y in least.items() if x != y}
