"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

Method
    A page is read into leaf blocks: runs of text between block-level boundaries, each with the
    open elements around it. A block's features are its ancestors' tags, what their classes, ids
    and roles say, and properties of the text (length, link share, punctuation, cue words, place).
    A two-state chain (boilerplate, main text) with a weight for each feature and transition is
    trained by gradient steps on its log likelihood over labelled pages, and decoded by Viterbi. Where
    a page must have main text - an article or main element holds some, or no block stands in
    anything that tells its role - the best path is taken among those that have a main block.
    The labelled pages are made here by a seeded generator, of many layouts; their text is random
    words, so nothing about a page's topic or language is learned. The trained weights are kept in
    ``chain.json`` beside this module, which ``python -m quern.llm.html`` makes anew.

Defined results: null html is an empty page; a page without main text gives an empty text and 0;
a null id or url is carried along; repeated rows give repeated results; an empty table gives no
rows; columns other than those named are ignored. Unclosed and unknown tags, stray end tags and
pages cut off anywhere are read as far as they go.
"""

from __future__ import annotations

import html
import json
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import map_batches, read_table

TRAINING_PAGES = 800
#: Marks main text in the pages that are made for training.
MARK = "\u2063"
SEED = 7

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")

#: Elements whose content is no text of the page.
_SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title", "textarea", "select", "head"}
_BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
             "thead tr ul".split())
_VOID = {"hr"}
#: What an opening tag ends if it is open inside the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"form"})}

#: What a class, id or role tells about an element, by the words in it.
_WORDS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar topbar pagination pager tabs toc skip",
    "head": "header head masthead banner logo branding topbar",
    "foot": "footer foot colophon contentinfo copyright legal bottom",
    "side": "sidebar side aside widget rail complementary related recommended popular trending tags tagcloud promo more",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored sponsors promoted promotion banner dfp",
    "notice": "notice cookie cookies consent gdpr alert alertdialog warning message modal popup overlay dialog paywall banner disclaimer",
    "social": "share sharing social follow",
    "comment": "comment comments reply replies respond disqus discussion thread responses",
    "form": "form login signin signup search subscribe subscription newsletter contact",
    "body": "content article post entry main story text prose markdown page body single",
}
_GROUPS: dict[str, list[str]] = {}
for _group, _words in _WORDS.items():
    for _word in _words.split():
        _GROUPS.setdefault(_word, []).append(_group)

_TELLING = {f"in:{t}" for t in ("nav", "header", "footer", "aside", "article", "main", "form", "dialog", "menu", "section")}

_CUES = re.compile(r"(?i)©|copyright|all rights reserved|cookie|subscribe|newsletter|sign (?:up|in)|log in|advert|sponsor|privacy|terms of")


@dataclass
class Block:
    """Text between two block boundaries, white space already single."""

    text: str
    leaf: str  # tag of the innermost block element
    path: int  # equal for blocks with the same tags around them
    in_h1: bool
    features: frozenset[str]
    linked: int  # characters inside links


@dataclass(frozen=True)
class Element:
    """An open block element."""

    tag: str
    path: int
    in_h1: bool
    features: frozenset[str]


@lru_cache(maxsize=20_000)
def _own_features(tag: str, attributes: str) -> frozenset[str]:
    found = {f"in:{tag}"} if tag not in ("div", "body", "html") else set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for word in re.split(r"[^a-z]+", value):
                found.update(f"cls:{g}" for g in _GROUPS.get(word, ()))
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            found.add("cls:hidden")
    return frozenset(found)


@lru_cache(maxsize=50_000)
def _within(outer: frozenset[str], own: frozenset[str]) -> frozenset[str]:
    """Features inside an element: its own and all around it, and which of them come from the
    innermost element that says something about its role."""
    telling = {f"inner:{f}" for f in own if f in _TELLING or f.startswith("cls:")}
    return own | (frozenset(f for f in outer if not f.startswith("inner:")) | telling if telling else outer)


def blocks_of(page: str) -> list[Block]:
    """The page's leaf blocks in order. Elements may be nested to any depth: what is kept of those
    around a block is a set of features and a number for their tags."""
    out: list[Block] = []
    stack = [Element("", 0, False, frozenset())]
    paths: dict[tuple[int, str], int] = {}
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links: list[str] = []
    in_link = False

    def close_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.tag, top.path, top.in_h1, top.features, len("".join(links))))
            parts.clear()
            links.clear()

    def close_to(at: int) -> None:
        for element in stack[at:]:
            open_tags[element.tag] -= 1
        del stack[at:]

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            links.append(text)

    at, end = 0, len(page)
    while at < end:
        match = _TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        name = match[2] or match[5]
        if not name:
            continue
        closing, tag, attributes = match[1] or match[4], name.lower(), match[3] or match[6] or ""
        if tag in _SKIPPED:
            if tag not in ("head",) and not closing and not attributes.endswith("/"):
                close_block() if tag not in ("svg", "math") else None
                stop = re.compile(f"</{tag}", re.I).search(page, at)
                at = stop.start() if stop else end
            continue
        if tag in ("br", "wbr", "img"):
            parts.append("" if tag == "wbr" else " ")
        elif tag == "a":
            in_link = not closing
        elif tag in _BLOCK:
            close_block()
            in_link = False
            if closing:
                if open_tags[tag]:
                    close_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            else:
                if stack[-1].tag == "p":  # a block ends an open paragraph
                    close_to(len(stack) - 1)
                ends, within = _ENDS.get(tag, (frozenset(), frozenset()))
                if any(open_tags[t] for t in ends):
                    i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends or stack[i].tag in within)
                    if stack[i].tag not in within:
                        close_to(i)
                if tag not in _VOID:
                    top = stack[-1]
                    path = paths.setdefault((top.path, tag), len(paths) + 1)
                    stack.append(Element(tag, path, top.in_h1 or tag == "h1", _within(top.features, _own_features(tag, attributes))))
                    open_tags[tag] += 1
    close_block()
    return out


def features(blocks: list[Block]) -> Iterator[list[str]]:
    """Features of each block in its page."""
    heading = False
    for i, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        found = [f"leaf:{b.leaf}"]
        found.append("words:" + ("1" if n < 3 else "3" if n < 6 else "6" if n < 16 else "16" if n < 41 else "41"))
        share = b.linked / max(1, len(b.text))
        found.append("link:" + ("0" if share == 0 else "1" if share < 0.34 else "2" if share < 0.8 else "3"))
        found.append("stop" if b.text[-1] in ".!?:;\"”…" else "nostop")
        if _CUES.search(b.text):
            found.append("cue")
        if re.search(r"[|·»›→]", b.text):
            found.append("bar")
        found.append("after-h1" if heading else "before-h1")
        heading = heading or b.in_h1
        if i == 0:
            found.append("first")
        if i == len(blocks) - 1:
            found.append("last")
        if i and blocks[i - 1].path == b.path:
            found.append("same")
        yield found


@dataclass
class Chain:
    """Weights of the main-text state against the other one; ``moves[a][b]`` for going from a to b."""

    weights: dict[str, float]
    moves: tuple[tuple[float, float], tuple[float, float]]
    sums: dict[frozenset[str], float] = field(default_factory=dict)

    def emission(self, block: Block, own: list[str]) -> float:
        total = self.sums.get(block.features)
        if total is None:
            if len(self.sums) > 50_000:
                self.sums.clear()
            total = self.sums[block.features] = sum(self.weights.get(f, 0.0) for f in block.features)
        return total + sum(self.weights.get(f, 0.0) for f in own)

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The best state sequence (Viterbi); with a main block if the page must have main text."""
        if not blocks:
            return []
        (stay, up), (down, keep) = self.moves
        emissions = [self.emission(b, own) for b, own in zip(blocks, features(blocks))]
        ahead = [(0.0, emissions[0])]  # the best score of a path to each state of each block
        back: list[tuple[int, int]] = [(0, 0)]
        for e in emissions[1:]:
            zero, one = ahead[-1]
            to_zero, to_one = one + down > zero + stay, one + keep >= zero + up
            back.append((int(to_zero), int(to_one)))
            ahead.append((one + down if to_zero else zero + stay, (one + keep if to_one else zero + up) + e))
        state = int(ahead[-1][1] > ahead[-1][0])
        out = self._trace(back, len(blocks) - 1, state)
        if any(out) or not must_have_text(blocks):
            return out
        rest = [(0.0, 0.0)]  # the best score of what follows each state
        for e in reversed(emissions[1:]):
            zero, one = rest[-1]
            rest.append((max(stay + zero, up + e + one), max(down + zero, keep + e + one)))
        rest.reverse()
        at = max(range(len(blocks)), key=lambda i: ahead[i][1] + rest[i][1])
        out = self._trace(back, at, 1)
        for e, (zero, one) in zip(emissions[at + 1 :], rest[at + 1 :]):
            out.append(self.moves[out[-1]][1] + e + one > self.moves[out[-1]][0] + zero)
        return out

    @staticmethod
    def _trace(back: list[tuple[int, int]], at: int, state: int) -> list[bool]:
        out = [state]
        for choice in back[at:0:-1]:
            state = choice[state]
            out.append(state)
        return [bool(s) for s in reversed(out)]


_ARTICLE = {"inner:in:article", "inner:in:main"}


def must_have_text(blocks: list[Block]) -> bool:
    """Whether an article or main element has text of its own, or nothing tells any block's role."""
    return any(b.features & _ARTICLE for b in blocks) or not any(f.startswith("inner:") for b in blocks for f in b.features)


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = 300) -> Chain:
    """Maximise the regularised log likelihood of the labelled pages by Adam on exact gradients
    (forward-backward over all pages at once)."""
    pages = [p for p in pages if p[0]]
    found = [[[*b.features, *own] for b, own in zip(blocks, features(blocks))] for blocks, _ in pages]
    index = {f: i for i, f in enumerate(sorted({f for page in found for block in page for f in block}))}
    longest = max(map(len, found))
    rows, columns, y, mask = [], [], np.zeros((len(pages), longest)), np.zeros((len(pages), longest), bool)
    for p, page in enumerate(found):
        for t, block in enumerate(page):
            mask[p, t] = True
            y[p, t] = pages[p][1][t]
            for f in block:
                rows.append(p * longest + t)
                columns.append(index[f])
    rows, columns = np.array(rows), np.array(columns)
    w, moves = np.zeros(len(index)), np.zeros((2, 2))
    m = [np.zeros(len(index)), np.zeros((2, 2))]
    v = [np.zeros(len(index)), np.zeros((2, 2))]
    states = y.astype(int)
    pairs = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (states[:, :-1][pairs], states[:, 1:][pairs]), 1)
    for step in range(1, steps + 1):
        e = np.bincount(rows, w[columns], len(pages) * longest).reshape(len(pages), longest)
        scores = np.stack([np.zeros_like(e), e], axis=2)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, :1] + moves[0], alpha[:, t - 1, 1:] + moves[1]) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = beta[:, t + 1] + scores[:, t + 1]
            new = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
            beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t + 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p_one = np.where(mask, np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]), 0)
        slope = np.bincount(columns, (y - p_one).reshape(-1)[rows], len(index)) - 0.05 * w
        joint = alpha[:, :-1, :, None] + moves + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        bend = seen - (np.exp(joint) * pairs[:, :, None, None]).sum((0, 1)) - 0.05 * moves
        for k, (value, gradient) in enumerate(((w, slope), (moves, bend))):
            m[k] = 0.9 * m[k] + 0.1 * gradient
            v[k] = 0.999 * v[k] + 0.001 * gradient**2
            value += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Chain({f: float(w[i]) for f, i in index.items()}, tuple(tuple(map(float, r)) for r in moves))


class PageMaker:
    """Labelled pages: layouts, class names and texts drawn by a seeded generator."""

    def __init__(self, seed: int = SEED):
        self.pick = random.Random(seed)

    def words(self, low: int, high: int, stop: str = ".") -> str:
        r = self.pick
        made = ["".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if r.random() < 0.15:
            made[0] = r.choice(("&amp;", "&quot;", "12", "###", "!!", "|"))
        text = " ".join(made)
        return text[:1].upper() + text[1:] + stop

    def page(self) -> str:
        """Html in which MARK stands before the text of every main block."""
        r = self.pick

        def keep(text: str) -> str:
            if r.random() < 0.08:
                text += r.choice((" All rights reserved.", " Copyright matters.", " Subscribe to the cookie newsletter.", " Log in | sign up.", " Privacy."))
            return MARK + text

        def box(tags: str, names: str, inner: str) -> str:
            tag = r.choice(tags.split())
            how = r.random()
            label = r.choice(names.split()) if names else ""
            mark = "" if not label or tag != "div" and how < 0.4 else f' {r.choice(("class", "class", "id"))}="{label}"'
            return f"<{tag}{mark}>{inner}</{tag}>"

        def menu() -> str:
            items = [f'<a href="/{i}">{self.words(1, 2, "")}</a>' for i in range(r.randint(3, 8))]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.8 else " | ".join(items)
            return box("nav nav div ul", "nav menu main-menu navbar breadcrumbs", inner)

        def advert() -> str:
            text = self.words(2, 25)
            return box("div div div aside section ins p", "ad ads advert sponsored ad-slot promo banner-ad", r.choice((text, f'<a href="/x">{text}</a>', f"<p>{text}</p>")))

        def notice() -> str:
            text = self.words(4, 40)
            text += r.choice(("", " We use cookies.", " Subscribe to our newsletter."))
            return box("div div section aside dialog", "notice cookie-notice consent-banner alert paywall message cookie", r.choice((text, f"<p>{text}</p> <button>OK</button>")))

        def side() -> str:
            rows = "".join(r.choice((f'<li><a href="/s">{self.words(2, 9, "")}</a></li>', f"<p>{self.words(5, 40)}</p>")) for _ in range(r.randint(1, 6)))
            return box("aside aside div section", "sidebar side-column widget related-posts popular", f"<h3>{self.words(1, 3, '')}</h3>{rows}")

        def comments() -> str:
            some = "".join(r.choice((f'<div class="comment"><b>{self.words(1, 2, "")}</b><p>{self.words(3, 50)}</p></div>', f"<li><p>{self.words(3, 50)}</p></li>",
                                     f"<p>{self.words(3, 40)}</p>")) for _ in range(r.randint(1, 6)))
            return box("section div ol ul", "comments comment-list discussion replies comments-area", f"<h2>{self.words(1, 2, '')}</h2>{some}")

        def fields() -> str:
            inner = f"<label>{self.words(1, 3, '')}</label><input name=q><p>{self.words(2, 20)}</p><button>{self.words(1, 2, '')}</button>"
            return box("form", "search login newsletter-form signup", inner)

        def head() -> str:
            inner = r.choice((f"<h1>{self.words(1, 3, '')}</h1>", f"<div>{self.words(1, 4, '')}</div>", f"<p>{self.words(3, 12)}</p>"))
            return box("header header div", "header site-header masthead", inner + (menu() if r.random() < 0.4 else ""))

        def foot() -> str:
            text = r.choice(("&copy; ", "Copyright ", "", "")) + self.words(1, 3, "") + r.choice((" &middot; ", ". ", " ")) + self.words(2, 25)
            inner = r.choice((text, f"<p>{text}</p>", f"<div>{text}</div>" + menu(), f"<ul><li>{text}</li></ul>"))
            return box("footer footer footer div", "footer site-footer bottom colophon", inner)

        def part() -> str:
            kind = r.random()
            if kind < 0.62:
                text = self.words(r.choice((1, 1, 3)), r.choice((3, 15, 80)), r.choice((".", ".", ".", "", "!", ":")))
                if r.random() < 0.1:
                    return f"<p><b>{keep(text)}<br>" if r.random() < 0.5 else f"<p><a href='/y'>{keep(text)}</a></p>"
                return f"<p>{keep(text)}" + ("</p>" if r.random() < 0.9 else "")
            if kind < 0.7:
                return f"<{(h := r.choice(('h2', 'h3', 'h4')))}>{keep(self.words(1, 8, ''))}</{h}>"
            if kind < 0.78:
                return (t := r.choice(("ul", "ol"))) and f"<{t}>" + "".join(f"<li>{keep(self.words(1, 20, r.choice(('', '.'))))}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>"
            if kind < 0.83:
                return f"<blockquote><p>{keep(self.words(4, 30))}</p></blockquote>"
            if kind < 0.87:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{keep(self.words(1, 3, ''))}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>"
            if kind < 0.90:
                return f"<pre>{keep(self.words(2, 20, ''))}</pre>"
            if kind < 0.92:
                return f"<figure><img src=x><figcaption>{keep(self.words(2, 12))}</figcaption></figure>"
            if kind < 0.945:
                return f"<div>{keep(self.words(2, 60))}</div>"
            return r.choice((advert, side, notice, fields))()

        title = self.words(1, 12, r.choice(("", ".")))
        heading = r.random()
        inner = f"<h1>{keep(title)}</h1>" if heading < 0.6 else f"<header><h1>{keep(title)}</h1></header>" if heading < 0.7 else ""
        inner += "".join(part() for _ in range(r.randint(1, 14)))
        if r.random() < 0.25:
            inner += r.choice((foot, comments, menu))()
        article = box("article article main div div section", "content post article-body entry-content story main-content", inner)
        if article.startswith("<section>"):
            article = f'<div id="content">{article}</div>'
        if 0.7 <= heading < 0.85:
            article = f"<h1>{keep(title)}</h1>" + article
        if r.random() < 0.2:  # simple pages: paragraphs in the body, in a plain element, or a single one
            inner = "".join(f"<p>{keep(self.words(r.choice((1, 8)), r.choice((12, 60))))}</p>" for _ in range(r.choice((1, 1, 2, 4, 8))))
            tag = r.choice(("", "", "div", "article", "main"))
            article = f"<{tag}>{inner}</{tag}>" if tag else inner
        above = [f() for f in (head, menu, notice, advert, fields, side) if r.random() < 0.35]
        below = [f() for f in (comments, side, advert, notice, fields, menu) if r.random() < 0.3] + ([foot()] if r.random() < 0.85 else [])
        r.shuffle(above)
        body = "".join(above) + (f"<main>{article}</main>" if r.random() < 0.2 and not article.startswith("<main") else article) + "".join(below)
        page = f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body>{body}</body></html>"
        return page[: r.randrange(len(page) // 2, len(page))] if r.random() < 0.1 else page


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """The blocks of a page of PageMaker, and which of them are main text."""
    blocks = blocks_of(page)
    labels = [MARK in b.text for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MARK, "")
    kept = [(b, main) for b, main in zip(blocks, labels) if b.text]
    return [b for b, _ in kept], [main for _, main in kept]


_KEPT = Path(__file__).with_name("chain.json")


def fresh_chain(pages: int = TRAINING_PAGES, seed: int = SEED) -> Chain:
    maker = PageMaker(seed)
    return train([labelled(maker.page()) for _ in range(pages)])


@lru_cache(maxsize=4)
def trained_chain(pages: int = TRAINING_PAGES, seed: int = SEED) -> Chain:
    """The kept weights, or newly trained ones for other pages than those that they come from."""
    kept = json.loads(_KEPT.read_text()) if _KEPT.exists() else {}
    if (kept.get("pages"), kept.get("seed")) == (pages, seed):
        return Chain(kept["weights"], tuple(map(tuple, kept["moves"])))
    return fresh_chain(pages, seed)


def main_text(page: str, chain: Chain) -> str:
    blocks = blocks_of(page)
    return "\n".join(b.text for b, keep in zip(blocks, chain.decode(blocks)) if keep)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = chain or trained_chain()
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page, model) for page in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                          names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages, run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLE_SQL: dict[str, str] = {}

if __name__ == "__main__":
    chain = fresh_chain()
    _KEPT.write_text(json.dumps({"pages": TRAINING_PAGES, "seed": SEED, "moves": chain.moves, "weights": chain.weights}, indent=0) + "\n")
