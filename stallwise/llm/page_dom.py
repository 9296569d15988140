"""A small reader of HTML: block elements as a tree, their text, and the features of each element."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape
from math import log1p

#: Elements whose content is not text of the page.
UNSEEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "textarea", "select", "option", "button"}
#: Those of them whose content is not markup either.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
#: What can stand in a head; anything else ends it.
IN_HEAD = {"html", "head", "meta", "link", "base", "title", "style", "script", "noscript", "template"}
#: Drawings and formulas, which blocks of text end, but for those within an element that may hold them.
FOREIGN_ROOTS, HOLDS_BLOCKS = {"svg", "math"}, {"foreignobject", "desc", "annotation-xml"}
#: Elements that stay within the text of a block.
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "input", "br", "wbr", "html", "meta", "link", "big", "strike", "center", "acronym", "area", "map", "picture", "source", "embed", "param", "track", "col", "base", "object", "canvas", "audio", "video", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msubsup", "msqrt", "mroot", "mstyle", "semantics", "annotation"}
VOID = {"img", "input", "br", "wbr", "meta", "link", "area", "source", "embed", "param", "track", "col", "base", "hr"}
#: An element of the key ends open ones of the set.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Those that begin where a paragraph cannot go on: all other blocks.
OPENING = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
END_OF_COMMENT = re.compile("--!?>")
#: To the end of a tag; only after an equals sign does a quote hold it off.
REST_OF_TAG = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")

#: What names of classes, ids and roles tell, by group.
TOKENS = {
    "main": "article content main post entry body story text page prose",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion banner adsense outbrain taboola",
    "head": "header masthead topbar logo branding",
    "foot": "footer foot copyright legal colophon",
    "side": "sidebar side aside widget widgets related recommended trending more",
    "comment": "comment comments reply replies discussion disqus respond reviews feedback",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert paywall message toast",
    "form": "form newsletter subscribe signup login search contact share social sharing",
}
OF_TOKEN = {t: g for g, names in TOKENS.items() for t in names.split()}
TAGS = {
    "paragraph": {"p", "blockquote", "pre"},
    "heading": {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"},
    "list": {"ul", "ol", "dl", "menu"},
    "item": {"li", "dt", "dd"},
    "box": {"div", "section", "figure", "details"},
    "main": {"article", "main"},
    "menu": {"nav"},
    "head": {"header"},
    "foot": {"footer"},
    "side": {"aside"},
    "form": {"form", "fieldset", "dialog"},
    "table": {"table", "tbody", "thead", "tr", "td", "th"},
    "body": {"body"},
}
OF_TAG = {t: g for g, names in TAGS.items() for t in names}
NEGATIVE_TAGS = {"menu", "foot", "side", "form", "head"}


@dataclass
class Node:
    tag: str
    parent: int
    groups: frozenset[str] = frozenset()
    label: int | None = None
    depth: int = 0
    children: list[int] = field(default_factory=list)
    #: Characters, characters in links, sentence ends, words and text blocks, of the whole subtree in the end.
    chars: int = 0
    linked: int = 0
    stops: int = 0
    words: int = 0
    blocks: int = 0
    elements: int = 1
    begins: int = 0


@dataclass
class Page:
    nodes: list[Node]
    #: Text blocks in page order, with the element that each is in.
    texts: list[tuple[int, str]]


def read(html: str) -> Page:
    """Open elements end where others of their kind must begin, at an end tag of theirs, or with their parents;
    so do hidden ones. Hidden elements that close themselves hide nothing."""
    nodes = [Node("body", -1)]
    stack, texts = [0], []
    buffer: list[str] = []
    hidden: list[str] = []  # a hidden element and what is open in it
    spans: Counter[str] = Counter()  # open elements within the block
    links, linked, seen = 0, 0, 0

    def flush() -> None:
        nonlocal linked, seen
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                node = nodes[stack[-1]]
                texts.append((stack[-1], text))
                node.chars += len(text)
                node.linked += min(linked, len(text))
                node.stops += sum(map(text.count, ".!?"))
                node.words += text.count(" ") + 1
                node.blocks += 1
                seen += len(text)
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if not hidden and raw:
            text = unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if links:
                linked += len(text)

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at, n = 0, len(html)
    while at < n:
        mark = OPENING.search(html, at)
        if not mark:
            say(html[at:])
            break
        say(html[at : mark.start()])
        if mark.group() == "<!--":
            # At once, or with the next two dashes that stand before a bracket or an exclamation mark and one.
            short = next((x for x in (">", "->") if html.startswith(x, mark.end())), "")
            end = END_OF_COMMENT.search(html, mark.end())
            at = mark.end() + len(short) if short else end.end() if end else n
            continue
        rest = REST_OF_TAG.match(html, mark.end())
        if not rest:
            end = html.find(">", mark.end())
            at = n if end < 0 else end + 1
        else:
            at = rest.end()
        if mark.group(2) is None:
            continue
        tag, attributes = mark.group(2).lower(), html[mark.end() : at]
        if mark.group(1):
            if tag in hidden:
                while hidden.pop() != tag:
                    pass
                continue
            if hidden and (spans[tag] or (tag not in INLINE and any(nodes[k].tag == tag for k in stack[1:]))):
                hidden.clear()
            if tag in INLINE and spans[tag] and not hidden:
                spans[tag] -= 1
            if hidden or tag == "br":
                buffer.append(" ")
            elif tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag != "body":
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        close(k)
                        break
                else:
                    flush()
            continue
        if hidden and hidden[0] == "head" and len(hidden) == 1 and tag not in IN_HEAD and tag != "body":
            hidden.clear()
        if hidden and OF_TAG.get(tag) and tag != "body":
            if hidden[0] in FOREIGN_ROOTS and not HOLDS_BLOCKS.intersection(hidden):
                hidden.clear()
            elif UNSEEN.issuperset(hidden) and nodes[stack[-1]].tag in ENDS.get(tag, ()):
                hidden.clear()
        closed = attributes.endswith("/>")
        if tag in UNSEEN and (tag != "head" or not hidden):
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(html, at)
                at = n if not end else end.start()
                if end:
                    rest = html.find(">", at)
                    at = n if rest < 0 else rest + 1
                buffer.append(" ")
            elif not closed:
                hidden.append(tag)
            continue
        if hidden:
            if tag == "body" and "head" in hidden:
                hidden.clear()
            else:
                while len(hidden) > 1 and hidden[-1] in ENDS.get(tag, set()) | {"p"} and tag not in INLINE:
                    hidden.pop()
                if not closed and tag not in VOID:
                    hidden.append(tag)
                continue
        if tag == "br" or tag in VOID:
            buffer.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            links += 1
        if tag in INLINE:
            spans[tag] += 1
            continue
        flush()
        links = 0
        spans.clear()
        if tag == "body":
            target = 0
        else:
            ends = ENDS.get(tag, set()) | {"p"} | (TAGS["heading"] if tag in TAGS["heading"] else set())
            while len(stack) > 1 and nodes[stack[-1]].tag in ends:
                stack.pop()
            target = len(nodes)
            nodes.append(Node(tag, stack[-1], depth=len(stack), begins=seen))
            nodes[stack[-1]].children.append(target)
            stack.append(target)
        names = " "
        for found in ATTRIBUTE.finditer(attributes):
            value = found.group(2) or found.group(3) or found.group(4) or ""
            if found.group(1).lower() == "data-label":
                nodes[target].label = int(value == "1")
            else:
                names += value.lower() + " "
        if len(names) > 1:
            nodes[target].groups = frozenset(OF_TOKEN[t] for t in TOKEN.findall(names) if t in OF_TOKEN)
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        own, up = nodes[i], nodes[nodes[i].parent]
        for k in ("chars", "linked", "stops", "words", "blocks", "elements"):
            setattr(up, k, getattr(up, k) + getattr(own, k))
    return Page(nodes, texts)


FEATURES = [
    *(f"tag_{g}" for g in TAGS),
    *(f"token_{g}" for g in TOKENS),
    *(f"above_{g}" for g in TOKENS),
    *("above_main_tag", "above_negative_tag", "depth", "siblings", "place_among_siblings", "like_siblings", "sibling_share"),
    *("chars", "link_density", "chars_per_element", "words_per_block", "stops_per_word", "blocks", "page_share", "begins_at"),
]


def features(page: Page) -> list[list[float]]:
    """A row of FEATURES for each element of a page."""
    rows: list[list[float]] = []
    above: list[frozenset[str]] = []
    tags_above: list[frozenset[str]] = []
    whole = max(1, page.nodes[0].chars)
    tags = [Counter(page.nodes[c].tag for c in node.children) for node in page.nodes]
    place = {c: k for node in page.nodes for k, c in enumerate(node.children)}
    for i, node in enumerate(page.nodes):
        up = page.nodes[node.parent] if i else None
        over = above[node.parent] | up.groups if up else frozenset()
        over_tags = tags_above[node.parent] | {OF_TAG.get(up.tag, "")} if up else frozenset()
        above.append(over)
        tags_above.append(over_tags)
        kind, n = OF_TAG.get(node.tag, ""), len(up.children) if up else 1
        alike = tags[node.parent][node.tag] if up else 1
        rows.append(
            [
                *(float(kind == g) for g in TAGS),
                *(float(g in node.groups) for g in TOKENS),
                *(float(g in over) for g in TOKENS),
                float("main" in over_tags),
                float(bool(over_tags & NEGATIVE_TAGS)),
                float(node.depth),
                float(n),
                place.get(i, 0) / n,
                float(alike),
                node.chars / max(1, up.chars) if up else 1.0,
                log1p(node.chars),
                node.linked / max(1, node.chars),
                node.chars / node.elements,
                node.words / max(1, node.blocks),
                node.stops / max(1, node.words),
                log1p(node.blocks),
                node.chars / whole,
                node.begins / whole,
            ]
        )
    return rows
