"""Main-text extraction: boosted trees over DOM nodes, then one consistent choice for the whole tree.

A page's block elements are scored from subtree density, attribute tokens, depth and sibling statistics. Decoding picks
the labels with the highest total log-probability under which no node is content below an ancestor that is dropped: a
node is either dropped with all below it, or kept and its children decide for themselves.

The trees are fitted on pages made by `synthetic_pages` from a fixed seed, in which each block's kind is known.
"""

from __future__ import annotations

import html as html_module
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .gbt import Trees, fit

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop|style|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?…。！？]+(?=\s|$)")

# Names of HTML elements and tokens of attributes.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu "
    "nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"),
    "body": ("head",),
}
SCOPES = frozenset("ul ol dl table select body html article section div".split())
DROPPED_TAGS = frozenset("nav aside footer form header menu button select dialog search fieldset head".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TOKENS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar side rail widget footer foot header masthead topbar cookie cookies consent "
    "gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended comments comment reply replies respond disqus discussion search form pagination pager tags "
    "copyright legal disclaimer toolbar skip hidden none outbrain taboola complementary contentinfo".split()
)
CONTENT_TOKENS = frozenset("article articlebody content main post entry story body text blog page maincontent hentry prose document paragraph markdown".split())

FEATURES = (
    "depth", "own_text", "subtree_text", "subtree_link_share", "own_link_share", "density", "children", "sibling_p_share", "share_of_parent", "place_among_siblings", "place_in_page", "is_p", "is_heading", "is_list",
    "is_dropped_tag", "is_content_tag", "is_table", "bad_tokens", "good_tokens", "bad_above", "good_above", "sentences", "word_length", "text_before", "text_after", "controls", "share_of_page", "sibling_text_share",
)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset
    children: list[int] = field(default_factory=list)
    #: (order, text) of the node's own blocks; runs of inline content between block tags
    blocks: list[tuple[int, str]] = field(default_factory=list)
    own: int = 0
    links: int = 0
    tags: int = 1
    controls: int = 0
    at: int = 0


def _tokens(attributes: str) -> frozenset:
    if not attributes or attributes.isspace():
        return frozenset()
    out = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "hidden":
            out.add("hidden")
        elif name.lower() == "style":
            if "display:none" in value.replace(" ", "") or "visibility:hidden" in value.replace(" ", ""):
                out.add("hidden")
        else:
            out.update(_TOKEN.findall(value))
    return frozenset(out)


def parse(page: str) -> list[Node]:
    """Block elements in page order, the root first; unclosed and stray tags are mended as browsers do, nearly."""
    nodes = [Node("html", -1, 0, frozenset())]
    stack, text, link, order, at = [0], [], 0, 0, 0

    def flush():
        nonlocal order
        if text:
            s = " ".join(html_module.unescape("".join(text)).split())
            if s:
                nodes[stack[-1]].blocks.append((order, s))
                nodes[stack[-1]].own += len(s)
                order += 1
            text.clear()

    def close(tags: tuple[str, ...], scope: bool = True):
        for i in range(len(stack) - 1, 0, -1):
            t = nodes[stack[i]].tag
            if t in tags:
                flush()
                del stack[i:]
                return
            if scope and t in SCOPES:
                return

    size = len(page)
    find = _TAG.finditer(page)
    for m in find:
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if link:
                nodes[stack[-1]].links += len(piece)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                text.append(html_module.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, ending = name.lower(), bool(m[1] or m[4])
        if name in RAW:
            if not ending:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
                text.append(" ")
            continue
        if name == "a":
            link = 0 if ending else 1
        if name in ("br", "hr") or name == "img":
            text.append(" ")
        if name == "input":
            nodes[stack[-1]].controls += 1
        if name not in BLOCK:
            nodes[stack[-1]].tags += not ending
            continue
        if ending:
            if name == "p" and not any(nodes[i].tag == "p" for i in stack):
                flush()
            elif name in HEADINGS:
                close(tuple(HEADINGS), scope=False)
            else:
                close((name,), scope=False)
            link = 0
            continue
        flush()
        link = 0
        if name in ("html", "body") and len(stack) > 1 and name == "html":
            continue
        if name not in ("option", "optgroup", "li", "td", "th", "tr", "dt", "dd") or name == "li":
            if nodes[stack[-1]].tag == "p" and name not in ("button",):
                del stack[-1]
            elif nodes[stack[-1]].tag in HEADINGS and name in HEADINGS | {"p"}:
                del stack[-1]
        if name in CLOSES:
            close(CLOSES[name], scope=name != "body")
        me = len(nodes)
        nodes.append(Node(name, stack[-1], nodes[stack[-1]].depth + 1, _tokens(m[3] or m[6] or ""), at=m.start()))
        nodes[stack[-1]].children.append(me)
        nodes[me].controls += name in ("button", "select")
        if len(stack) < 2000:
            stack.append(me)
    if at < size:
        text.append(page[at:])
    flush()
    return nodes


def features(nodes: list[Node], size: int) -> np.ndarray:
    n = len(nodes)
    sub_text, sub_link, sub_tags, controls = (np.array([getattr(x, k) for x in nodes], float) for k in ("own", "links", "tags", "controls"))
    own, own_link = sub_text.copy(), np.minimum(sub_link, sub_text)
    sub_link = own_link.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = nodes[i].parent
        sub_text[p] += sub_text[i]
        sub_link[p] += sub_link[i]
        sub_tags[p] += sub_tags[i]
        controls[p] += controls[i]
    x = np.zeros((n, len(FEATURES)))
    bad_above, good_above = np.zeros(n), np.zeros(n)
    total = max(sub_text[0], 1)
    for i, d in enumerate(nodes):
        bad, good = len(d.tokens & BOILERPLATE_TOKENS), len(d.tokens & CONTENT_TOKENS)
        drops, keeps = d.tag in DROPPED_TAGS, d.tag in CONTENT_TAGS
        if i:
            bad_above[i] = bad_above[d.parent] + (nodes[d.parent].tag in DROPPED_TAGS) + (len(nodes[d.parent].tokens & BOILERPLATE_TOKENS) > 0)
            good_above[i] = good_above[d.parent] + (nodes[d.parent].tag in CONTENT_TAGS) + (len(nodes[d.parent].tokens & CONTENT_TOKENS) > 0)
        p = nodes[d.parent] if i else d
        words = sum(b.count(" ") + 1 for _, b in d.blocks)
        sentences = sum(len(_SENTENCE.findall(b)) for _, b in d.blocks)
        x[i, :7] = d.depth, np.log1p(own[i]), np.log1p(sub_text[i]), sub_link[i] / max(sub_text[i], 1), own_link[i] / max(own[i], 1), sub_text[i] / sub_tags[i], len(d.children)
        x[i, 8] = sub_text[i] / max(sub_text[d.parent], 1) if i else 1
        x[i, 10:23] = (
            d.at / max(size, 1), d.tag == "p", d.tag in HEADINGS, d.tag in ("li", "ul", "ol", "dl", "dd", "dt"), drops, keeps, d.tag in ("table", "tr", "td", "th", "tbody"), bad, good, bad_above[i], good_above[i],
            sentences / max(words, 1), own[i] / max(words, 1),
        )
        x[i, 25], x[i, 26] = controls[i], sub_text[i] / total
        if d.children:
            c = d.children
            share = sum(nodes[k].tag == "p" for k in c) / len(c)
            in_p = sum(sub_text[k] for k in c if nodes[k].tag == "p") / max(sub_text[i], 1)
            for j, k in enumerate(c):
                x[k, 7], x[k, 9], x[k, 27] = share, j / len(c), in_p
                x[k, 23] = np.log1p(sub_text[c[j - 1]]) if j else 0
                x[k, 24] = np.log1p(sub_text[c[j + 1]]) if j + 1 < len(c) else 0
    return x


def decode(nodes: list[Node], p: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the labelling with the most log-probability in which dropped nodes have no kept descendant."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    filled = np.array([bool(d.own) for d in nodes]) | np.array([bool(d.children) for d in nodes])
    keep, drop = np.where(filled, np.log(p), 0.0), np.where(filled, np.log(1 - p), 0.0)
    best = keep.copy()
    keep[0], drop[0] = 0.0, -np.inf  # the root holds the page
    best_below, drop_below = np.zeros(len(nodes)), np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        keep[i] += best_below[i]
        drop[i] += drop_below[i]
        best[i] = max(keep[i], drop[i])
        if i:
            best_below[nodes[i].parent] += best[i]
            drop_below[nodes[i].parent] += drop[i]
    kept = np.zeros(len(nodes), bool)
    for i, d in enumerate(nodes):
        kept[i] = (i == 0 or kept[d.parent]) and keep[i] >= drop[i]
    return kept


def main_text(page: str | None, model: Trees) -> str:
    """The kept blocks in page order, joined by an empty line; null and pages without text give an empty string."""
    return next(main_texts([page], model))


#: Nodes from which on the pages held are scored.
SCORED_NODES = 1 << 12


def main_texts(pages: Iterable[str | None], model: Trees) -> Iterator[str]:
    """main_text of each page in turn. Pages wait for each other's scores, as the trees take as long for one node as for many."""

    def done():
        scores = model.score(np.concatenate([x for _, x in held])) if held else np.zeros(0)
        at = 0
        for nodes, x in held:
            yield _kept_text(nodes, scores[at : at + len(x)])
            at += len(x)

    held, n = [], 0
    none = np.zeros((0, len(FEATURES)))
    for page in pages:
        nodes = parse(page) if page else []
        held.append((nodes, features(nodes, len(page)) if nodes else none))
        n += len(nodes)
        if n >= SCORED_NODES or len(held) >= SCORED_NODES:
            yield from done()
            held, n = [], 0
    yield from done()


def _kept_text(nodes: list[Node], scores: np.ndarray) -> str:
    if not nodes:
        return ""
    kept = decode(nodes, scores)
    blocks = [b for d, k in zip(nodes, kept, strict=True) if k and (d.parent >= 0 or len(nodes) == 1) for b in d.blocks]
    return "\n\n".join(b for _, b in sorted(blocks))


# ---- labelled pages


def _sentence(rng: random.Random, words: int) -> str:
    w = ["".join(rng.choice(["an", "er", "tion", "la", "do", "is", "ent", "que", "ver", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(max(1, words))]
    return " ".join(w).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])


def _paragraph(rng: random.Random) -> str:
    n = rng.choice([1, 1, 1, 2, 3, 5, 8])
    out = " ".join(_sentence(rng, rng.choice([1, 3, 8, 15, 25])) for _ in range(n))
    if rng.random() < 0.15:
        out = f'{out} <a href="/{rng.randint(1, 99)}">{_sentence(rng, 2)}</a> {_sentence(rng, 6)}'
    if rng.random() < 0.1:
        out = f"<b>{out}"
    return out


def synthetic_page(rng: random.Random) -> str:
    """A page whose content elements have the attribute data-y="1"."""
    y = ' data-y="1"'

    def attrs(names, plain=0.3):
        r = rng.random()
        return "" if r < plain else f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'

    def links(n):
        return "".join(f'<li><a href="/{rng.randint(1, 99)}">{_sentence(rng, rng.randint(1, 3))}</a></li>' for _ in range(n))

    def nav():
        tag = rng.choice(["nav", "nav", "div", "ul"])
        inner = links(rng.randint(3, 9))
        return f"<{tag}{attrs(['menu', 'nav-main', 'navbar', 'breadcrumbs', 'topnav'], 0.4 if tag == 'nav' else 0.1)}>{inner if tag == 'ul' else '<ul>' + inner + '</ul>'}</{tag}>"

    def header():
        return f"<header{attrs(['site-header', 'masthead'])}><div>{_sentence(rng, 3)}</div>{rng.choice(['', '<p>' + _sentence(rng, 7) + '</p>'])}</header>"

    def footer():
        tag = rng.choice(["footer", "footer", "div"])
        return f"<{tag}{attrs(['footer', 'page-footer', 'site-info copyright'], 0.6 if tag == 'footer' else 0)}>&copy; {_sentence(rng, 4)} {rng.choice(['', '<p>' + _sentence(rng, 12) + '</p>', '<ul>' + links(4) + '</ul>'])}</{tag}>"

    def aside():
        tag = rng.choice(["aside", "div", "section"])
        return f"<{tag}{attrs(['sidebar', 'widget', 'related', 'side-rail'], 0.5 if tag == 'aside' else 0)}><h3>{_sentence(rng, 2)}</h3>{rng.choice(['<ul>' + links(5) + '</ul>', '<p>' + _sentence(rng, 20) + '</p>', '<p>' + _sentence(rng, 12) + '</p><p>' + _sentence(rng, 9) + '</p>'])}</{tag}>"

    def ad():
        return f"<div{attrs(['ad', 'ads', 'advert banner', 'sponsored', 'promo'], 0)}>{rng.choice(['', '<p>'])}{_sentence(rng, rng.choice([3, 8, 14]))}</div>"

    def notice():
        return f"<div{attrs(['cookie-notice', 'consent', 'alert', 'popup', 'newsletter-signup', 'gdpr-banner'], 0)}><p>{_sentence(rng, rng.choice([6, 14, 25]))}</p><button>{_sentence(rng, 1)}</button></div>"

    def form():
        return f"<form><label>{_sentence(rng, 2)}</label><input name=q><p>{_sentence(rng, 8)}</p><button>{_sentence(rng, 1)}</button></form>"

    def comments():
        tag = rng.choice(["div", "section", "ol"])
        one = lambda: f'<{rng.choice(["li", "div", "article"])} class="comment"><p>{_paragraph(rng)}</p>'
        return f"<{tag}{attrs(['comments', 'comment-list', 'discussion', 'replies'], 0)}><h3>{_sentence(rng, 2)}</h3>{''.join(one() for _ in range(rng.randint(1, 4)))}</{tag}>"

    def article():
        parts = [f"<h1{y}>{_sentence(rng, rng.randint(1, 10))}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 2, 4, 8, 14])):
            r = rng.random()
            if r < 0.72:
                parts.append(f"<p{y}>{_paragraph(rng)}{rng.choice(['</p>', '</p>', '', '<br>'])}")
            elif r < 0.8:
                parts.append(f"<h2{y}>{_sentence(rng, rng.randint(1, 6))}</h2>")
            elif r < 0.86:
                parts.append(f"<ul{y}>" + "".join(f"<li{y}>{_sentence(rng, rng.randint(1, 12))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif r < 0.9:
                parts.append(f"<blockquote{y}><p{y}>{_paragraph(rng)}</p></blockquote>")
            elif r < 0.93:
                parts.append(f"<table{y}>" + "".join(f"<tr{y}>" + "".join(f"<td{y}>{_sentence(rng, 2)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif r < 0.95:
                parts.append(f"<pre{y}>{_sentence(rng, 9)}</pre>")
            else:
                parts.append(rng.choice([ad, notice, aside, form])())
        tag = rng.choice(["article", "article", "main", "div", "section"])
        names = ["content", "post-body", "entry-content", "article-text", "story", "x1"]
        out = f"<{tag}{y}{attrs(names, 0.7 if tag in CONTENT_TAGS else 0.15)}>{''.join(parts)}</{tag}>"
        return f"<div{y}{attrs(['wrap', 'container', 'main'])}>{out}</div>" if rng.random() < 0.35 else out

    before = [f() for f in (header, nav, nav, notice, ad, form) if rng.random() < 0.45]
    after = [f() for f in (aside, ad, comments, form, notice, footer, footer) if rng.random() < 0.45]
    rng.shuffle(before)
    return f"<html><head><title>{_sentence(rng, 4)}</title></head><body>{''.join(before)}{article()}{''.join(after)}</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 11) -> Trees:
    """The model, fitted on so many labelled pages. Structure and labels come from the generator alone."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = synthetic_page(rng)
        nodes = parse(page)
        xs.append(features(nodes, len(page))[1:])
        marks = np.zeros(len(nodes))
        for i, d in enumerate(nodes):
            marks[i] = page[d.at : page.find(">", d.at)].find('data-y="1"') >= 0
        for i in range(len(nodes) - 1, 0, -1):  # what holds content is kept
            marks[nodes[i].parent] = max(marks[nodes[i].parent], marks[i])
        ys.append(marks[1:])
    return fit(np.concatenate(xs), np.concatenate(ys), trees=60, depth=4, rate=0.25, bins=32, least=8)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html; other columns are ignored)."""
    model = trained()

    def make():
        def step(batch):
            texts = list(main_texts((h.as_py() for h in batch.column("html")), model))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    own = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(own.dtypes)
    return map_batches(own, make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
