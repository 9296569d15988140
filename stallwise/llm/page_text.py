"""Main text of web pages: gradient-boosted trees over features of DOM elements, decoded along the tree.

Each block element gets a score from its subtree's density of text and links, its tag and attribute tokens and
those of its ancestors, its depth, and how it stands among its siblings. Decoding takes the labelling with the
highest total log-likelihood in which nothing inside a discarded element is kept; so an ancestor and a descendant
can't contradict each other. The blocks of text directly in kept elements are the main text.

The trees are trained here, on about `train_pages` pages (by hash of the id): elements of pages that mark their
article are labelled by it, and further pages are composed from those pages' own paragraphs and links in many
layouts, with menus, headers, adverts, notices, sidebars, forms and comments of known labels.

Rows: null or empty html has an empty text; very long pages are read whole; unclosed and misplaced tags end as
browsers end them, roughly; repeated rows and null ids are treated row by row; an empty table gives an empty
result, and without training pages everything visible is kept. Only the named columns are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.page_dom import FEATURES, OF_TAG, Page, features, read


@dataclass(frozen=True)
class Params:
    train_pages: int = 300
    composed_pages: int = 400
    trees: int = 15
    depth: int = 5
    seed: int = 42


CONTENT = ("article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body entry"', 'section class="story"', 'div class="article-text"', "div", 'div role="main"')
SIDE_TAGS = ("div", "section", "aside", "div")


def composed(rng: random.Random, paragraphs: list[str], shorts: list[str]) -> str:
    """A page whose elements carry their label."""

    def links(n: int) -> str:
        return "".join(f'<li data-label="0"><a href="#">{rng.choice(shorts)}</a></li>' for _ in range(n))

    def texts(n: int, label: int) -> str:
        return "".join(f'<p data-label="{label}">{rng.choice(paragraphs)}</p>' for _ in range(n))

    def few() -> str:
        return rng.choice([rng.choice(shorts), rng.choice(paragraphs)[:120], rng.choice(paragraphs)])

    def boilerplate() -> str:
        tag = rng.choice(SIDE_TAGS)
        return rng.choice(
            [
                lambda: f'<nav data-label="0"><ul data-label="0">{links(rng.randint(2, 9))}</ul></nav>',
                lambda: f'<div class="{rng.choice(["menu", "nav", "breadcrumbs", "pagination"])}" data-label="0"><ul data-label="0">{links(rng.randint(2, 7))}</ul></div>',
                lambda: f'<div data-label="0"><ul data-label="0">{links(rng.randint(3, 9))}</ul></div>',
                lambda: f'<header data-label="0"><h2 data-label="0">{rng.choice(shorts)}</h2>{few()}</header>',
                lambda: f'<div class="{rng.choice(["header", "masthead", "topbar"])}" data-label="0">{few()}</div>',
                lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo", "banner ad-box"])}" data-label="0">{few()}</div>',
                lambda: f'<aside data-label="0"><h3 data-label="0">{rng.choice(shorts)}</h3>{texts(rng.randint(1, 2), 0)}</aside>',
                lambda: f'<{tag} class="{rng.choice(["sidebar", "widget", "related"])}" data-label="0"><h3 data-label="0">{rng.choice(shorts)}</h3><ul data-label="0">{links(4)}</ul>{texts(rng.randint(0, 1), 0)}</{tag}>',
                lambda: f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "discussion", "replies"])}" data-label="0"><h3 data-label="0">{rng.choice(shorts)}</h3>' + "".join(f'<div class="{rng.choice(["comment", "reply"])}" data-label="0">{texts(1, 0)}</div>' for _ in range(rng.randint(1, 4))) + f"</{tag}>",
                lambda: f'<{tag} class="{rng.choice(["cookie-notice", "consent", "notice", "popup", "alert"])}" data-label="0">{rng.choice([texts(1, 0), few()])}</{tag}>',
                lambda: f'<form data-label="0"><p data-label="0">{few()}</p><label>{rng.choice(shorts)}</label><input></form>',
                lambda: f'<div class="{rng.choice(["newsletter", "share", "social", "search"])}" data-label="0">{few()}</div>',
            ]
        )()

    wrap = rng.choice(CONTENT)
    body = [f'<h1 data-label="1">{rng.choice(paragraphs)[: rng.randint(6, 90)]}</h1>'] * (rng.random() < 0.8)
    for _ in range(rng.randint(1, 8)):
        body.append(
            rng.choices(
                [
                    lambda: texts(rng.randint(1, 3), 1),
                    lambda: f'<h2 data-label="1">{rng.choice(shorts)} {rng.choice(shorts)}</h2>' + texts(1, 1),
                    lambda: '<ul data-label="1">' + "".join(f'<li data-label="1">{rng.choice(paragraphs)[:150]}</li>' for _ in range(rng.randint(2, 5))) + "</ul>",
                    lambda: f'<blockquote data-label="1">{rng.choice(paragraphs)}</blockquote>',
                    lambda: f'<div data-label="1">{texts(2, 1)}</div>',
                    lambda: f'<p data-label="1">{rng.choice(shorts)}</p>',
                    boilerplate,
                ],
                [8, 2, 1, 1, 1, 1, 1],
            )[0]()
        )
    content = f'<{wrap} data-label="1">{"".join(body)}</{wrap.split()[0]}>'
    parts = [boilerplate() for _ in range(rng.randint(0, 3))] + [content] + [boilerplate() for _ in range(rng.randint(0, 3))]
    parts.append(rng.choice(['<footer data-label="0">{}</footer>', '<div class="footer" data-label="0">{}</div>', '<div id="copyright" data-label="0"><p data-label="0">{}</p></div>', ""]).format(few()))
    page = "".join(parts)
    return f"<body>{page}</body>" if rng.random() < 0.5 else f'<body><div class="{rng.choice(["wrapper", "container", "page"])}" data-label="1">{page}</div></body>'


#: Names and tags that tell boilerplate even inside an article.
FOREIGN = {"menu", "advert", "foot", "side", "comment", "notice", "form"}


def marked(page: Page) -> None:
    """Labels the elements of a page by its article, if it marks one: what is in it is content, and so is what holds
    it, but not elements in it (and all they hold) whose names tell boilerplate."""
    inside: list[bool] = []
    for node in page.nodes:
        up = node.parent >= 0 and inside[node.parent]
        foreign = OF_TAG.get(node.tag) in FOREIGN or (node.groups & FOREIGN and "main" not in node.groups)
        inside.append((up and not foreign) or node.tag in ("article", "main"))
        node.label = int(inside[-1])
    for node, kept in zip(page.nodes, inside):
        while kept and node.parent >= 0:
            node = page.nodes[node.parent]
            node.label = 1


def examples(htmls: list[str], params: Params) -> list[tuple[list[float], float]]:
    """(features, label) of elements, of the pages and of those composed from them."""
    rows, paragraphs, shorts = [], [], []
    for html in htmls:
        page = read(html)
        if any(n.tag in ("article", "main") for n in page.nodes):
            marked(page)
            rows += [(f, float(n.label)) for f, n in zip(features(page), page.nodes) if n.parent >= 0]
        for owner, text in page.texts:
            (paragraphs if len(text) >= 60 and OF_TAG.get(page.nodes[owner].tag) == "paragraph" else shorts).append(text)
    rng = random.Random(params.seed)
    paragraphs, shorts = paragraphs or shorts, [s[:40] for s in shorts] or [p[:30] for p in paragraphs]
    if paragraphs:
        for _ in range(params.composed_pages):
            page = read(composed(rng, paragraphs, shorts))
            rows += [(f, float(n.label)) for f, n in zip(features(page), page.nodes) if n.label is not None and n.parent >= 0]
    return rows


@dataclass(frozen=True)
class Trees:
    """All trees as arrays: feature (-1 for a leaf), threshold, left and right child, value; and their roots."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while (live := self.feature[at] >= 0).any():
                low = rows[every, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(live, np.where(low, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 2 * total


def fit(pages: DataFrame, params: Params = Params(), id_col: str = "page_id", html_col: str = "html") -> Trees | None:
    """Trains on about `train_pages` pages, by a hash of the id and the page, copies once; so many reach the driver at any size."""
    spark = pages.sparkSession
    n_pages = pages.filter(F.col(html_col).isNotNull()).count()
    share = min(1.0, params.train_pages / max(1, n_pages))
    picked = pages.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(html_col).cast("string"), F.lit(params.seed)), F.lit(1 << 30)) < share * (1 << 30))
    sample = picked.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html")).filter("html is not null").distinct().orderBy("id", "html")
    rows = examples([r["html"] for r in sample.collect()], params)
    if len({y for _, y in rows}) < 2:
        return None
    table = pa.table({"x": pa.array([x for x, _ in rows], pa.list_(pa.float64())), "label": [y for _, y in rows]})
    frame = spark.createDataFrame(table).coalesce(2).select(array_to_vector("x").alias("features"), "label").persist()
    model = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, stepSize=0.3, seed=params.seed, minInstancesPerNode=5).fit(frame)
    frame.unpersist()
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(node, weight: float) -> int:
        at = len(feature)
        for x in (feature, threshold, left, right, value):
            x.append(0)
        if node.subtreeDepth() == 0:
            feature[at], value[at] = -1, weight * node.prediction()
        else:
            feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
            left[at], right[at] = add(node.leftChild(), weight), add(node.rightChild(), weight)
        return at

    for tree, weight in zip(model.trees, model.treeWeights):
        roots.append(add(tree._java_obj.rootNode(), weight))
    return Trees(*(np.array(x) for x in (feature, threshold, left, right, value, roots)))


def kept_elements(page: Page, odds: np.ndarray) -> list[bool]:
    """The best labelling in which nothing inside a discarded element is kept; the body is always kept."""
    n = len(page.nodes)
    gain = odds.tolist()  # of keeping the element and what is best below it, over discarding all of it
    for i in range(n - 1, 0, -1):
        parent = page.nodes[i].parent
        if gain[i] > 0:
            gain[parent] += gain[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[page.nodes[i].parent] and gain[i] > 0
    return kept


def main_texts(htmls: list[str | None], trees: Trees | None) -> list[str]:
    pages = [read(h) if h else None for h in htmls]
    rows = [features(p) for p in pages if p]
    odds = trees.log_odds(np.array([r for page in rows for r in page])) if trees and rows else None
    out, at = [], 0
    for page in pages:
        if page is None:
            out.append("")
            continue
        n = len(page.nodes)
        kept = [True] * n if odds is None else kept_elements(page, odds[at : at + n])
        at += n
        out.append("\n\n".join(text for owner, text in page.texts if kept[owner]))
    return out


def extract(pages: DataFrame, params: Params = Params(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    trees = pages.sparkSession.sparkContext.broadcast(fit(pages, params, id_col, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                texts = main_texts(part.column(2).to_pylist(), trees.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


assert len(FEATURES) == len(features(read(""))[0])
