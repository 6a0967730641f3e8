"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts. Each has features of its ancestors (tags, and the words of
their classes, ids and roles) and of its text (length, share of links, punctuation). The field has two labels, main text and
the rest; it is trained by gradient ascent on labelled pages, which make_pages() builds from many templates, and decoded by Viterbi.

Tags are read as the HTML standard's tokenizer reads them, in time that grows with the page alone: quotes count only where a value begins, and a
tag, comment or quote that never ends takes the rest of the page. Ancestors are nodes that blocks share.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import in_blocks, small_batches

# HTML elements by how they are laid out, from the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select "
    "summary table tbody td template textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, by whether it is text that a reader sees.
RAW_TAGS = {"script": False, "style": False, "iframe": False, "noembed": False, "noframes": False, "xmp": True, "textarea": True, "title": True}
#: An opening tag on the left closes open elements on the right, as long as none of the stops lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}

#: An opening tag ends an open paragraph unless one of these lies between.
SHELLS = frozenset("article aside div form section table".split())

# a value in quotes or without, a name with or without a value, and white space, slashes and lone = between them
VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
ATTRIBUTES = rf"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+{VALUE}?+)?+|=)*+"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)|</>|<(?:[!?]|/[^a-zA-Z>])[^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"(=?[^\s/>=]++)(?:\s*+=\s*+({VALUE})?+)?+", re.S)
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW_TAGS}
WORDS = re.compile(r"[a-z]+")

SECTIONS = frozenset("article aside body footer form header main nav section".split())


class Node:
    """An open element: what the features need to know of it and of those around it, which its parent knows already."""

    __slots__ = ("parent", "tag", "words", "block", "section", "section_named", "named", "in_links", "articles", "inside_main")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...]):
        self.parent, self.tag, self.words = parent, tag, words
        self.block = tag if tag in BLOCK_TAGS else parent.block if parent else ""
        starts = tag in SECTIONS
        self.section = tag if starts else parent.section if parent else ""
        names = words[:-1] if words[-1:] == ("hidden",) else words
        self.section_named = bool(names) or (not starts and parent is not None and parent.section_named)
        self.named = (bool(names) and tag not in ("html", "body")) or (parent is not None and parent.named)
        self.in_links = (tag == "a") + (parent.in_links if parent else 0)
        self.articles = min(2, (tag == "article") + (parent.articles if parent else 0))
        self.inside_main = tag in ("article", "main") or (parent is not None and parent.inside_main)


def attribute_words(attributes: str) -> tuple[str, ...]:
    """The words of class, id and role, and `hidden` of an element that is not shown. Of an attribute given twice the first counts."""
    values: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        values.setdefault(name.lower(), value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value)
    words = sorted({w for name in ("class", "id", "role") for w in WORDS.findall(values.get(name, "").lower())})
    if "hidden" in values or re.search(r"display\s*:\s*none", values.get("style", ""), re.I):
        words.append("hidden")
    return tuple(words)


class OpenElements:
    """The stack of open elements, with the places of each tag in it, so that no tag has to look for another through the stack."""

    def __init__(self):
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> Node | None:
        return self.stack[-1] if self.stack else None

    def place(self, tags) -> int:
        """Where the innermost element of these tags is; -1: nowhere."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=-1)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()

    def add(self, tag: str, words: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        self.stack.append(Node(self.top, tag, words))

    def open(self, tag: str) -> None:
        """Before a block-level tag: inline elements end, and so do those that it closes by itself."""
        self.cut(self.blocks[-1] + 1 if self.blocks else 0)
        closes, stops = CLOSES.get(tag, (frozenset(), frozenset()))
        at = self.place({*closes, "p", *(("head",) if tag == "body" else ())})
        if at > self.place((SHELLS | stops) - closes):
            self.cut(at)

    def close(self, tag: str) -> None:
        """An end tag closes the innermost element of its name; an inline one does not reach out of its block."""
        at = self.place((tag,))
        if at >= 0 and (tag in BLOCK_TAGS or not self.blocks or at > self.blocks[-1]):
            self.cut(at)


def leaf_blocks(page: str) -> list[tuple[Node | None, str, int]]:
    """(innermost element, text, characters of it in links) of each block with text, in page order.

    Character references are decoded, white space becomes one space, ends are trimmed. Comments, scripts, styles and embedded frames
    have no text; that of titles and text areas is plain.
    """
    elements = OpenElements()
    out: list[tuple[Node | None, str, int]] = []
    text: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if text:
            clean = " ".join(html_lib.unescape("".join(text)).split())
            if clean:
                in_links = len(" ".join(html_lib.unescape("".join(linked)).split())) if linked else 0
                out.append((elements.top, clean, in_links))
            text.clear()
            linked.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if elements.stack and elements.top.in_links:
            linked.append(piece)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None or (at == size and page[-1] != ">"):  # no tag, or one that the page ends in
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            elements.close(tag)
            continue
        if tag in BLOCK_TAGS:
            flush()
            elements.open(tag)
        elif tag == "br":
            add(" ")
        if tag in VOID_TAGS:
            continue
        words = attribute_words(m[3]) if m[3] else ()
        if tag not in RAW_TAGS:
            elements.add(tag, words)
            continue
        end = RAW_ENDS[tag].search(page, at)
        if RAW_TAGS[tag]:
            elements.add(tag, words)
            add(page[at : end.start() if end else size])
            if tag in BLOCK_TAGS:
                flush()
            elements.close(tag)
        at = end.end() if end else size
    flush()
    return out


def own_features(node: Node) -> list[str]:
    """What an element adds to the features of all within it."""
    return [f"in {node.tag}", *(f"named {w}" for w in node.words)]


def place_features(node: Node | None) -> list[str]:
    """What the place of a block says beside the elements around it."""
    found = ["bias", f"last {node.block if node else ''}"]
    section = node.section if node else ""
    found.append(f"section {section}{' with names' if node and node.section_named else ''}")
    if not (node and node.named):
        found.append(f"section {section} and no names at all")
    if not (node and node.inside_main):
        found.append("outside article and main")
    if node and node.articles > 1:
        found.append("nested article")
    return found


def path_features(node: Node | None) -> set[str]:
    found, at = set(place_features(node)), node
    while at is not None:
        found.update(own_features(at))
        at = at.parent
    return found


def text_features(text: str, links: int, i: int, n: int) -> list[str]:
    words = text.count(" ") + 1
    found = [f"words {min(8, words.bit_length())}", f"links {4 * links // len(text)}"]
    if text[-1] in ".!?:;\"'»”…。":
        found.append("ends a sentence")
    if "©" in text or "copyright" in text.lower():
        found.append("copyright")
    if i == 0:
        found.append("first")
    if i == n - 1:
        found.append("last block")
    return found


class BlockField:
    """Weights of features for the label `main text`, of steps between labels, and of the first label."""

    def __init__(self, ids: dict[str, int], weights: np.ndarray, steps: np.ndarray, first: np.ndarray):
        self.ids, self.weights, self.steps, self.first = ids, weights, steps, first
        self._sums: dict[int, float] = {}

    def _sum(self, mask: int) -> float:
        """The weights of the features that are bits of the mask, each counted once however many elements have it."""
        if mask not in self._sums:
            if len(self._sums) > 50_000:
                self._sums.clear()
            self._sums[mask] = float(sum(self.weights[i] for i in range(mask.bit_length()) if mask >> i & 1))
        return self._sums[mask]

    def _bits(self, features: list[str]) -> int:
        mask = 0
        for f in features:
            if f in self.ids:
                mask |= 1 << self.ids[f]
        return mask

    def score(self, blocks: list[tuple[Node | None, str, int]]) -> np.ndarray:
        """The score of `main text` against the rest for each block of a page. Each element adds its bits to its parent's once."""
        masks: dict[Node | None, int] = {None: 0}
        bases: dict[Node | None, float] = {}
        out = np.empty(len(blocks))
        for i, (node, text, links) in enumerate(blocks):
            base = bases.get(node)
            if base is None:
                todo, at = [], node
                while at not in masks:
                    todo.append(at)
                    at = at.parent
                for n in reversed(todo):
                    masks[n] = masks[n.parent] | self._bits(own_features(n))
                base = bases[node] = self._sum(masks[node] | self._bits(place_features(node)))
            out[i] = base + sum(self.weights[self.ids[f]] for f in text_features(text, links, i, len(blocks)) if f in self.ids)
        return out

    def decode(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of each page (Viterbi), a step of all pages at a time, longest pages first."""
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        sizes = [len(pages[i]) for i in order]
        out: list[np.ndarray] = [np.zeros(len(p), bool) for p in pages]
        alive = sum(n > 0 for n in sizes)
        if not alive:
            return out
        best = np.zeros((alive, 2)) + self.first
        best[:, 1] += [pages[i][0] for i in order[:alive]]
        back: list[np.ndarray] = []
        ended: dict[int, np.ndarray] = {}
        for t in range(1, sizes[0] + 1):
            while alive and sizes[alive - 1] <= t - 1:
                alive -= 1
            still = sum(n > t for n in sizes[:alive]) if alive and sizes[alive - 1] <= t else alive
            for k in range(still, alive):
                ended[k] = best[k].copy()
            alive = still
            if not alive:
                break
            options = best[:alive, :, None] + self.steps
            back.append(options.argmax(axis=1))
            best = options.max(axis=1)
            best[:, 1] += [pages[i][t] for i in order[:alive]]
        for k, final in ended.items():
            label, labels = int(final.argmax()), out[order[k]]
            for t in range(sizes[k] - 1, -1, -1):
                labels[t] = label
                if t:
                    label = int(back[t - 1][k, label])
        return out


def train_field(pages: list[tuple[str, set[str]]], rounds: int = 200, ridge: float = 0.004) -> BlockField:
    """Fits the field on pages with the texts of their main blocks, by Adam on the conditional log-likelihood."""
    data, ids = [], {}
    for page, main in pages:
        blocks = leaf_blocks(page)
        features = [[*sorted(path_features(p)), *text_features(t, links, i, len(blocks))] for i, (p, t, links) in enumerate(blocks)]
        for fs in features:
            for f in fs:
                ids.setdefault(f, len(ids))
        if blocks:
            data.append(([[ids[f] for f in fs] for fs in features], [t in main for _, t, _ in blocks]))
    n, longest = len(data), max(len(y) for _, y in data)
    sizes = np.array([len(y) for _, y in data])
    gold = np.zeros((n, longest), int)
    mask = np.arange(longest) < sizes[:, None]
    flat, starts, cells = [], [], []
    for i, (fs, y) in enumerate(data):
        gold[i, : len(y)] = y
        for t, f in enumerate(fs):
            starts.append(len(flat))
            flat.extend(f)
            cells.append(i * longest + t)
    flat, starts, cells = np.array(flat), np.array(starts), np.array(cells)
    cell_of = np.repeat(cells, np.diff(np.r_[starts, len(flat)]))
    theta = np.zeros(len(ids) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, steps, first = theta[: len(ids)], theta[len(ids) : len(ids) + 4].reshape(2, 2), theta[-2:]
        emit = np.zeros((n, longest, 2))
        emit.reshape(-1, 2)[cells, 1] = np.add.reduceat(w[flat], starts)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp(ahead[:, t - 1, :1] + steps[0], ahead[:, t - 1, 1:] + steps[1]) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            nxt = emit[:, t + 1] + behind[:, t + 1]
            behind[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(steps[:, 0] + nxt[:, :1], steps[:, 1] + nxt[:, 1:]), 0)
        last = ahead[np.arange(n), sizes - 1]
        total = np.logaddexp(last[:, 0], last[:, 1])
        p = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        gradient = np.zeros_like(theta)
        gradient[: len(ids)] = np.bincount(flat, (gold * mask - p[:, :, 1]).ravel()[cell_of], len(ids))
        pairs = np.exp(ahead[:, :-1, :, None] + steps + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        seen = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & mask[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])
        gradient[len(ids) : len(ids) + 4] = (seen - pairs.sum(axis=(0, 1))).ravel()
        gradient[-2:] = [(gold[:, 0] == a).sum() - p[:, 0, a].sum() for a in (0, 1)]
        gradient = gradient / n - ridge * theta / 10
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return BlockField(ids, theta[: len(ids)], theta[len(ids) : len(ids) + 4].reshape(2, 2), theta[-2:])


def make_pages(n: int, seed: int = 17) -> list[tuple[str, set[str]]]:
    """Labelled pages: templates with an article and with menus, notices, adverts, forms, comments and more around and in it; a fifth of them with hardly a sign of where it is."""
    rng = random.Random(seed)
    syllables = "ka ro mi ten sol ver da lin pas tu gre on fa".split()
    unique = iter(range(1 << 40))

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high)))

    def sentence(low: int = 4, high: int = 25) -> str:
        return words(low, high).capitalize() + f" x{next(unique)}" + rng.choice("....!?")

    def paragraph() -> str:
        text = " ".join(sentence(rng.choice((1, 4))) for _ in range(rng.choice((1, 1, 2, 4, 9))))
        return text + rng.choice(("", "", "", "%%%", "###", " |", "$$$", "***")) if rng.random() < 0.5 else text

    def label(low: int = 1, high: int = 4) -> str:
        return words(low, high).capitalize() + f" x{next(unique)}"

    def wrap(options: list[str], inner: str) -> str:
        opening = rng.choice(options)
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def links(k: int) -> str:
        items = [f'<a href="/{words(1, 1)}">{label()}</a>' for _ in range(k)]
        return rng.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def menu() -> str:
        return wrap(["nav", 'div class="menu"', 'div id="nav"', 'ul class="navbar"', 'div role="navigation"', 'nav class="breadcrumbs"', 'div class="breadcrumb"'], links(rng.randint(2, 7)))

    def header() -> str:
        return wrap(["header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'header class="top"', 'div role="banner"'], rng.choice([f"<h1>{label()}</h1>", f"<p>{label()}</p>", label(), f"<div>{label()}</div>{menu()}", f"<h2>{label()}</h2><p>{sentence()}</p>"]))

    def footer() -> str:
        return wrap(["footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div role="contentinfo"'], rng.choice([f"&copy; {label()} &middot; {sentence()}", f"<p>{sentence()}</p>" + links(3), f"<p>Copyright {label()}</p>", links(4), sentence()]))

    def sidebar() -> str:
        return wrap(["aside", 'div class="sidebar"', 'div id="sidebar"', 'section class="related"', 'div class="related-posts"', 'aside class="widget"', 'div class="widget recommended"', 'div class="trending popular"'], rng.choice([f"<h3>{label()}</h3>" + links(4), f"<p>{paragraph()}</p>", f"<h2>{label()}</h2><p>{sentence()}</p><p>{sentence()}</p>", f"<h4>{label()}</h4><ul><li>{label(3, 9)}</li><li>{label(3, 9)}</li></ul>"]))

    def notice() -> str:
        return wrap(['div class="notice"', 'div class="cookie-banner"', 'div id="cookie-notice"', 'div class="alert warning"', 'div class="consent"', 'p class="notice"', 'div role="alert"', 'section class="gdpr"', 'div class="popup modal"', 'div class="disclaimer"'], rng.choice([sentence(), f"<p>{paragraph()}</p><button>{label()}</button>", f"{sentence()} <a href='/p'>{label()}</a>"]))

    def advert() -> str:
        return wrap(['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="banner-ad"', 'div class="sponsored"', 'div class="promo"', 'aside class="ad"', 'section class="promoted sponsor"', 'ins class="adsbygoogle"'], rng.choice([paragraph(), f"<p>{sentence()}</p>", f"<a href='/buy'>{label(2, 6)}</a>", f"<p>{sentence()}</p><p>{sentence()}</p>"]))

    def form() -> str:
        inner = rng.choice([f"<label>{label()}</label><input name='q'><button>{label()}</button>", f"<p>{sentence()}</p><input><input type=submit>", f"<h3>{label()}</h3><p>{paragraph()}</p><select><option>{label()}<option>{label()}</select>", f"<fieldset><legend>{label()}</legend>{sentence()}<textarea>{label()}</textarea></fieldset>"])
        return wrap(["form", 'form class="search"', 'form id="newsletter"', 'form class="login"'], inner) if rng.random() < 0.7 else wrap(['div class="newsletter"', 'div class="subscribe"', 'div class="signup"'], f"<p>{sentence()}</p>" + (f"<form>{inner}</form>" if rng.random() < 0.5 else ""))

    def comments() -> str:
        one = lambda: rng.choice([f'<div class="comment"><p>{paragraph()}</p></div>', f"<li><p>{sentence()}</p></li>", f'<article class="comment"><p>{paragraph()}</p></article>', f"<p>{paragraph()}</p>", f"<div><b>{label()}</b><p>{paragraph()}</p></div>"])
        return wrap(['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'section id="discussion"', 'div class="replies"', 'ul class="reader-comments"', 'div class="responses"', 'div class="user-comments"', 'div class="user-reviews"', 'section class="reviews"', 'div class="feedback opinions"'], (f"<h3>{label()}</h3>" if rng.random() < 0.6 else "") + "".join(one() for _ in range(rng.randint(1, 6))))

    def script() -> str:
        return rng.choice(["<script>var t=\"</p>\";track(1);</script>", "<style>p{margin:0}</style>", "<!-- ad 3 -->", "<script>if(a<b){go()}</script>", ""])

    def hidden() -> str:
        return wrap(["p hidden", "div hidden", 'p style="display:none"', 'div style="display: none"', 'section hidden class="text"'], rng.choice((paragraph, sentence))())

    def bare(keep) -> str:
        """Pages of few signs: without tags, without names, in tables, of one sentence."""
        prose = lambda: keep(rng.choice((paragraph, paragraph, sentence))())
        around = lambda inner, most=2: "".join(rng.choice((menu, header, script, lambda: links(rng.randint(2, 6))))() for _ in range(rng.randint(0, most))) + inner + "".join(rng.choice((footer, footer, menu, sidebar))() for _ in range(rng.randint(0, most)))
        style = rng.randrange(7)
        if style == 0:  # no tag at all
            return keep(rng.choice((" ", "\n", "\n\n")).join(rng.choice((paragraph, sentence, label))() for _ in range(rng.randint(1, 4))))
        if style == 1:  # divs without names
            inner = "".join(f"<div>{prose()}</div>" for _ in range(rng.randint(1, 5)))
            return f"<html><body>{around(rng.choice((inner, f'<div>{inner}</div>')))}</body></html>"
        if style == 2:  # a sentence or two, with what is not of the article beside or within
            shell = rng.choice(("article", "main", 'div class="content"', "div", "section"))
            said = "".join(f"<p>{keep(sentence(2, 8))}</p>" for _ in range(rng.randint(1, 2)))
            beside = "".join(rng.choice((comments, hidden, hidden, advert, notice, form))() for _ in range(rng.randint(0, 2)))
            return rng.choice(("", "<html><body>")) + rng.choice((f"<{shell}>{said}{beside}</{shell}>", f"<{shell}>{said}</{shell}>{beside}", f"<{shell}>{beside}{said}</{shell}>"))
        if style == 3:  # lines
            text = keep(f"{paragraph()} {paragraph()}")
            return f"<html><body>{text.replace('. ', '.<br>', 1) if rng.random() < 0.5 else text}</body></html>"
        if style == 4:  # a table as layout
            return f"<html><body><table><tr><td>{rng.choice((menu(), links(rng.randint(2, 6))))}</td><td>{''.join(f'<p>{prose()}</p>' for _ in range(rng.randint(1, 4)))}</td></tr></table>{footer()}</body></html>"
        if style == 5:  # heading and paragraphs in the body
            return f"<html><head><title>{label()}</title></head><body><h1>{keep(label())}</h1>{''.join(f'<p>{prose()}' for _ in range(rng.randint(1, 5)))}{rng.choice(('', footer()))}</body></html>"
        return around("".join(f"<p>{prose()}</p>" for _ in range(rng.randint(1, 4))) + rng.choice(("", hidden())), 1)

    others = [menu, header, footer, sidebar, notice, advert, form, comments, hidden]
    pages = []
    for _ in range(n):
        main: set[str] = set()

        def keep(text: str, main: set[str] = main) -> str:
            main.add(" ".join(text.split()))
            return text

        if rng.random() < 0.2:
            page = bare(keep)
            pages.append((page, main))
            continue
        body = []
        if rng.random() < 0.8:
            body.append(wrap(["h1", "h1", 'h1 class="title"', "h2"], keep(label(2, 10))))
        for _ in range(rng.choice((1, 2, 3, 4, 6, 9, 14))):
            kind = rng.random()
            if kind < 0.62:
                opening = rng.choice(("<p>", "<p>", "<p>", "<p><b>", '<p class="text">', "<div>"))
                body.append(opening + keep(paragraph()) + rng.choice(("", "</p>" if opening[1] == "p" else "", "<br>")) + ("</div>" if opening == "<div>" else ""))
            elif kind < 0.72:
                body.append(f"<h2>{keep(label(1, 6))}</h2>")
            elif kind < 0.8:
                body.append("<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.85:
                body.append(f"<blockquote><p>{keep(sentence())}</p></blockquote>")
            elif kind < 0.875:
                body.append(f"<table><tr><td>{keep(label(1, 5))}</td><td>{keep(label(1, 5))}</td></tr></table>")
            elif kind < 0.89:
                body.append(f"<pre>{keep(label(3, 12))}</pre>")
            elif kind < 0.94:
                a, b, c = rng.choice((sentence, label))(), label(), rng.choice((sentence, sentence, lambda: "."))()
                keep(f"{a} {b} {c}")
                body.append(f'<p>{a} <a href="/x">{b}</a> {c}</p>')
            else:
                body.append(rng.choice((advert, notice, form, sidebar, hidden))())
        if rng.random() < 0.15:
            body.append(comments())
        if rng.random() < 0.1:
            body.insert(0, header() if rng.random() < 0.3 else menu())
        shell = rng.choice(["article", "article", "article", 'article class="post"', "main", 'main id="content"', 'div class="content"', 'div id="main"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-body"', 'section class="story"', 'section id="article"', 'div id="article"', 'div class="article"', 'div class="text"', 'div class="story-body"', 'div class="blog-post"', 'div role="main"', 'div class="page-content"', 'div itemprop="articleBody"', ""])
        article = f"<{shell}>{''.join(body)}</{shell.split()[0]}>" if shell else "".join(body)
        if rng.random() < 0.2:
            article = f"<main>{article}{rng.choice(others)() if rng.random() < 0.4 else ''}</main>"
        before = [rng.choice((menu, menu, header, notice, advert, form, script))() for _ in range(rng.randint(0, 4))]
        after = [rng.choice((footer, sidebar, comments, advert, notice, form, menu, script))() for _ in range(rng.randint(0, 3))] + ([footer()] if rng.random() < 0.8 else [])
        content = "".join(before) + article + "".join(after)
        if rng.random() < 0.25:
            content = f'<div class="{rng.choice(("wrapper", "container", "page", "layout"))}">{content}</div>'
        head = f"<head><meta charset='utf-8'><title>{label(2, 8)}</title>{script()}</head>"
        pages.append((rng.choice(("<!DOCTYPE html>", "")) + f"<html lang='x'>{head}<body>{content}</body></html>", main))
    return pages


@functools.lru_cache(1)
def default_field() -> BlockField:
    return train_field(make_pages(900))


def extract_text(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), field: BlockField | None = None) -> DataFrame:
    """The columns of `keep`, text (blocks of main text joined by line breaks; empty if none) and n_chars (its code points).

    One row per input row. Null and empty pages have an empty text; repeated rows and null keys are rows like others; pages of any length are read
    whole. Extra columns are dropped; an empty table gives an empty result. No shuffle.
    """
    model = df.sparkSession.sparkContext.broadcast(field or default_field())
    source = small_batches(df).select(*keep, F.col(html).alias("_html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            pages = batch.column("_html").to_pylist()
            kept = batch.drop_columns(["_html"])
            for start, end in in_blocks(pages, 1 << 20):
                blocks = [leaf_blocks(p or "") for p in pages[start:end]]
                labels = own.decode([own.score(b) for b in blocks])
                texts = ["\n".join(t for (_, t, _), ok in zip(b, y, strict=True) if ok) for b, y in zip(blocks, labels, strict=True)]
                rows = kept.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rows.schema.names, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_html")
    return source.mapInArrow(extracted, f"{kinds}, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
