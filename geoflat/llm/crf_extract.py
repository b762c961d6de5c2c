"""Main-text extraction: a linear-chain conditional random field over the DOM's leaf blocks.

A page becomes its leaf blocks in page order: runs of text between block-level tags, with
scripts, styles, comments and other invisible content left out, character references decoded
and white space turned into one space. Each block has features from its ancestors (tags, words
of class, id and role) and from its text (length, link share, punctuation, position, marker
words). A two-label chain (main text or not) is trained on labelled pages by maximum
likelihood with an L2 penalty and decoded by Viterbi, page by page.

Labelled pages: a bounded sample (``TRAIN_PAGES``, lowest hashes of the ids) of the given pages
supplies sentences; ``labelled_page`` sets them into varied layouts (semantic tags, plain
divisions with usual or meaningless class names, tables; menus, headers, notices, adverts,
forms, side columns, comments and footers around and inside the article) whose labels are
known. The sample's own pages join with the label "inside an article element". The model
has a few thousand weights and is broadcast; every page is decoded in full.

Defined cases: null and empty html give the empty text. Unclosed and stray tags, text outside
any block, and truncated pages are read as browsers do (an open paragraph or list item ends
at the next block; an unfinished tag at the end is dropped). Repeated rows give equal rows.
Without any page the model is never asked. Very long pages are read whole, in linear time.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 240
LAYOUTS_PER_PAGE = 4
STEPS, RATE, L2 = 160, 0.08, 2e-3

# Element kinds of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option optgroup p pre search section select summary table tbody td "
    "tfoot th thead title tr ul video audio canvas".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea noscript template iframe noembed".split())
CLOSES_P = BLOCK_TAGS - frozenset("button option optgroup caption head body html".split())
# A start tag of the first closes an open element of the second kind, unless the third is nearer.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
           "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
           "option": ("option", "select")}
# Words that mark furniture of a page, in four languages.
MARKERS = frozenset(
    "cookie cookies privacy subscribe newsletter login register copyright rights reserved advertisement "
    "sponsored share comment comments reply menu home search contact imprint terms policy accept "
    "datenschutz impressum anmelden werbung kommentar antworten startseite suche publicité connexion "
    "commentaires répondre accueil publicidad comentarios responder inicio buscar suscríbete".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_STOP = re.compile(r"[>\"']")
_LOOSE = re.compile(r"[^<>]*(?:>|(?=<)|\Z)")
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")


class Path:
    """An element among its ancestors. ``fresh`` holds the features that no ancestor has, so those
    of a whole path are found once per element, however deep."""

    __slots__ = ("parent", "last", "up", "fresh")

    def __init__(self, parent, tag: str, fresh: tuple[str, ...]):
        self.parent, self.fresh = parent, fresh
        plain = tag in ("html", "body")
        self.last = (parent.last if parent else "none") if plain else tag
        self.up = (parent.up if parent else "none") if plain else (parent.last if parent else "none")


_PATHS: dict = {}  # paths come back on page after page: kept in a bounded table


class Block:
    __slots__ = ("text", "path", "linked", "pieces", "n_linked")

    def __init__(self, path):
        self.path, self.pieces, self.linked, self.n_linked, self.text = path, [], [], 0, ""


class _Tags:
    """Tags of a page one after the other. Where a tag ends is decided by its quotes; a search that
    found no end is remembered by the signs it passed, so no part of a page is searched twice."""

    def __init__(self, page: str):
        self.page, self.dead, self.seen = page, set(), (0, -1)

    def _first_stop(self, at: int) -> int:
        low, stop = self.seen
        if not low <= at <= stop:
            m = _STOP.search(self.page, at)
            self.seen = (at, m.start() if m else len(self.page))
        return self.seen[1]

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose name ends at ``at``, or -1."""
        page, passed, stop = self.page, [], self._first_stop(at)
        while stop < len(page) and stop not in self.dead:
            if page[stop] == ">":
                return stop
            passed.append(stop)
            close = page.find(page[stop], stop + 1)
            m = _STOP.search(page, close + 1) if close >= 0 else None
            stop = m.start() if m else len(page)
        self.dead.update(passed)
        return -1

    def __iter__(self):
        """(text before, closing, tag, attributes) and lastly the text behind; the caller may set
        ``at`` to skip what follows."""
        page, self.at = self.page, 0
        while self.at < len(page):
            m = _TAG.search(page, self.at)
            if m is None:
                yield page[self.at:], False, "", ""
                return
            before, self_at = page[self.at:m.start()], m.end()
            if m[2] is None:
                self.at = self_at
                yield before, False, "", ""
                continue
            end = self.end(self_at)
            if end >= 0:
                attrs, self.at = page[self_at:end], end + 1
            else:
                loose = _LOOSE.match(page, self_at)
                attrs, self.at = loose[0].removesuffix(">"), loose.end()
            yield before, bool(m[1]), m[2].lower(), attrs


class _Stack:
    """Open elements, with the places of each tag."""

    def __init__(self):
        self.items: list[tuple[str, Path | None, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.used: dict[str, int] = {}

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    @property
    def block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    @property
    def path(self) -> Path | None:
        return self.items[-1][1] if self.items else None

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        path, names = self.path, ()
        if tag in BLOCK_TAGS or words:
            names = tuple({f"in:{tag}": 0} if tag not in ("html", "body") else {}) + tuple(
                dict.fromkeys(f"attr:{w}" for w in words))
            key = (id(path), path, tag, words)  # the entry keeps its parent alive, so its id stays its own
            found = _PATHS.get(key)
            if found is None:
                if len(_PATHS) >= 100_000:
                    _PATHS.clear()
                found = _PATHS[key] = Path(path, tag, tuple(n for n in names if not self.used.get(n)))
            path = found
            for n in names:
                self.used[n] = self.used.get(n, 0) + 1
        k = len(self.items)
        self.places.setdefault(tag, []).append(k)
        if tag in BLOCK_TAGS:
            self.blocks.append(k)
        self.items.append((tag, path, names))

    def cut(self, k: int) -> None:
        """Closes the element at place k and all inside it."""
        while len(self.items) > k:
            tag, _, names = self.items.pop()
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
            for n in names:
                self.used[n] -= 1


def leaf_blocks(page: str | None) -> list[Block]:
    """Non-empty leaf blocks in page order, each with its path. The work grows with the page's
    length, whatever its tags."""
    out: list[Block] = []
    stack = _Stack()
    current: Block | None = None
    links = 0
    never_closed: set[str] = set()

    def flush():
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.pieces).split())
            if current.text:
                current.n_linked = len(" ".join("".join(current.linked).split()))
                out.append(current)
            current = None

    def add(raw: str):
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace() or stack.last("head", "title", "select") >= 0:
                return
            current = Block(stack.path)
        text = html_lib.unescape(raw) if "&" in raw else raw
        current.pieces.append(text)
        if links:
            current.linked.append(text)

    page = page or ""
    tags = _Tags(page)
    for before, closing, tag, attrs in tags:
        add(before)
        if not tag:
            continue
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            at = stack.last(tag)
            if at >= 0 and (tag in BLOCK_TAGS or at > stack.block):
                stack.cut(at)
            continue
        drawn = tag == "title" and stack.last("svg") >= 0
        if tag in RAW_TAGS or drawn:
            close = None if tag in never_closed else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, tags.at)
            if close is None:
                never_closed.add(tag)
            tags.at = close.end() if close else tags.at if drawn else len(page)
            continue
        if tag == "br":
            if current is not None:
                current.pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            links = 0
            if tag == "body":  # ends the head, with all that is still open in it
                heads = [p[0] for t in ("head", "title") if (p := stack.places.get(t))]
                if heads:
                    stack.cut(min(heads))
            if tag in CLOSES_P and stack.block >= 0 and stack.block == stack.last("p"):
                stack.cut(stack.block)
            if tag in IMPLIED:
                ends, walls = (x.split() for x in IMPLIED[tag])
                at = stack.last(*ends)
                if at > stack.last(*walls):
                    stack.cut(at)
        if tag in VOID_TAGS or attrs.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag == "a":
            links += 1
        words = tuple(w for g in _ATTR.findall(attrs) for w in _WORDS.findall("".join(g).lower())) \
            if attrs else ()
        stack.push(tag, words)
    flush()
    return out


def _path_names(path: Path | None) -> list[str]:
    """All features of a path."""
    found, at = [], path
    while at is not None:
        found += at.fresh
        at = at.parent
    return ["bias", *sorted(found), *_ends(path)]


def _ends(path: Path | None) -> list[str]:
    return ["tag:" + path.last, "up:" + path.up] if path else ["tag:none", "up:none"]


# The features of a text and the edges of their bins (None: the value itself).
_BINS = {"words": (2, 4, 8, 16, 32, 64, 128), "links": (0.01, 0.25, 0.5, 0.9), "stops": (1, 2, 4, 8),
         "ends": None, "start": None, "at": (0.02, 0.1, 0.9, 0.98), "edge": None, "tail": None,
         "prev": (0, 4, 16, 64), "next": (0, 4, 16, 64), "sign": None}
_W, _L, _S, _A, _N = (_BINS[k] for k in ("words", "links", "stops", "at", "prev"))


def _described(blocks: list[Block]) -> list[tuple[tuple, tuple, tuple]]:
    """(path, binned text features, marker words) per block."""
    words = [b.text.count(" ") + 1 for b in blocks]
    total, count, before, out = sum(words), len(blocks), 0, []
    for k, b in enumerate(blocks):
        n, text = words[k], b.text
        marks = ()
        if n < 60:
            marks = tuple(MARKERS.intersection(_WORD.findall(text.lower())))
        last, first = text[-1], text[0]
        stops = text.count(". ") + text.count(", ") + (last in ".!?")
        out.append((b.path, (
            bisect_right(_W, n), bisect_right(_L, b.n_linked / len(text)) if b.n_linked else 0,
            bisect_right(_S, stops), last if last in ".!?:;,|" else "x",
            "A" if first.isupper() else "a" if first.islower() else "x",
            bisect_right(_A, (before + n / 2) / total), min(k, 2), min(count - 1 - k, 2),
            bisect_right(_N, words[k - 1]) if k else 0,
            bisect_right(_N, words[k + 1]) if k + 1 < count else 0,
            "©" in text or "·" in text), marks))
        before += n
    return out


def _names(described: tuple[tuple, tuple, tuple]) -> list[str]:
    path, bins, marks = described
    return [*_path_names(path), *(f"{k}:{v}" for k, v in zip(_BINS, bins, strict=True)),
            *(f"mark:{w}" for w in marks)]


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Feature names per block."""
    return [_names(d) for d in _described(blocks)]


class CrfModel:
    """Two labels: ``weights[name]`` is what a feature adds to main text over other;
    ``move[i][j]`` is the score of label j after label i."""

    def __init__(self, weights: dict[str, float], move: list[list[float]]):
        self.weights, self.move = weights, move
        self.known: dict = {}
        self.above: dict = {}

    def _known(self, part, names: list[str]) -> float:
        if len(self.known) > 100_000:
            self.known.clear()
        got = self.known[part] = sum(self.weights.get(f, 0.0) for f in names)
        return got

    def _of_path(self, path: Path | None) -> float:
        """Sum over a path, from that of its parent."""
        chain, at = [], path
        while at is not None and at not in self.above:
            chain.append(at)
            at = at.parent
        total = 0.0 if at is None else self.above[at]
        if len(self.above) > 100_000:
            self.above.clear()
        for p in reversed(chain):
            total = self.above[p] = total + sum(self.weights.get(f, 0.0) for f in p.fresh)
        return total + sum(self.weights.get(f, 0.0) for f in ["bias", *_ends(path)])

    def scores(self, blocks: list[Block]) -> list[float]:
        """What each block's features add to main text; sums of paths and of binned text
        features come back again and again, so they are kept in a bounded table."""
        out, known, weights = [], self.known, self.weights
        for path, bins, marks in _described(blocks):
            a, b = known.get(path), known.get(bins)
            if a is None:
                a = known[path] = self._of_path(path)
            if b is None:
                b = self._known(bins, [f"{k}:{v}" for k, v in zip(_BINS, bins, strict=True)])
            out.append(a + b + sum(weights.get(f"mark:{w}", 0.0) for w in marks))
        return out

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi."""
        m0, m1 = self.move
        s0, s1, back = 0.0, 0.0, []
        for k, d in enumerate(scores):
            if k:
                f0, f1 = (s0 + m0[0] < s1 + m1[0]), (s0 + m0[1] < s1 + m1[1])
                back.append((int(f0), int(f1)))
                s0, s1 = max(s0 + m0[0], s1 + m1[0]), max(s0 + m0[1], s1 + m1[1]) + d
            else:
                s1 = d
        label = int(s1 > s0)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1] if scores else []


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS) -> CrfModel:
    """Maximum likelihood; forward-backward runs over all pages side by side."""
    pages = [p for p in pages if p[1]]
    if not pages:
        return CrfModel({}, [[0.0, 0.0], [0.0, 0.0]])
    names = sorted({f for fs, _ in pages for b in fs for f in b})
    at = {f: k for k, f in enumerate(names)}
    n, length = len(pages), max(len(y) for _, y in pages)
    row, col, target, mask = [], [], np.zeros((n, length)), np.zeros((n, length))
    for k, (fs, y) in enumerate(pages):
        target[k, :len(y)], mask[k, :len(y)] = y, 1
        for j, b in enumerate(fs):
            row += [k * length + j] * len(b)
            col += [at[f] for f in b]
    row, col = np.array(row), np.array(col)
    both = mask[:, 1:]
    y0, y1 = target[:, :-1].astype(int), target[:, 1:].astype(int)
    seen = np.array([[(both * (y0 == i) * (y1 == j)).sum() for j in (0, 1)] for i in (0, 1)])
    theta = np.zeros(len(names) + 4)
    m, v, blocks = np.zeros_like(theta), np.zeros_like(theta), mask.sum()
    for t in range(1, steps + 1):
        d = np.bincount(row, weights=theta[col], minlength=n * length).reshape(n, length)
        emit = np.stack([np.zeros_like(d), d], axis=2)
        move = theta[-4:].reshape(2, 2)
        a = np.zeros((n, length, 2))
        a[:, 0] = emit[:, 0]
        for j in range(1, length):
            nxt = np.logaddexp(a[:, j - 1, 0, None] + move[0], a[:, j - 1, 1, None] + move[1]) + emit[:, j]
            a[:, j] = np.where(mask[:, j, None] > 0, nxt, a[:, j - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        b = np.zeros((n, length, 2))
        for j in range(length - 2, -1, -1):
            ahead = emit[:, j + 1] + b[:, j + 1]
            nxt = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
            b[:, j] = np.where(mask[:, j + 1, None] > 0, nxt, 0.0)
        one = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * mask
        pair = np.exp(a[:, :-1, :, None] + move + (emit + b)[:, 1:, None, :] - z[:, None, None, None])
        expected = (pair * both[:, :, None, None]).sum(axis=(0, 1))
        g = np.concatenate([np.bincount(col, weights=(one - target).ravel()[row], minlength=len(names)),
                            (expected - seen).ravel()]) / blocks + L2 * theta / len(pages) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return CrfModel(dict(zip(names, theta[:-4].round(6).tolist(), strict=True)),
                    theta[-4:].reshape(2, 2).round(6).tolist())


# Names that pages give to their parts.
NAMES = {
    "main": "content main article post entry story text body article-body post-content entry-content "
            "main-content story-body page-content c1 x7 wrapper container inner".split(),
    "nav": "nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav links c2 x8".split(),
    "header": "header masthead top site-header banner branding topbar c3 x9".split(),
    "footer": "footer bottom site-footer copyright colophon legal c4 x10".split(),
    "side": "sidebar side aside related widget recommended popular rail more-stories c5 x11".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad sponsor promotion c6".split(),
    "notice": "notice cookie cookie-banner consent alert newsletter popup modal gdpr message c7".split(),
    "comments": "comments comment reader-comments responses discussion replies comment-list c8".split(),
    "form": "form search login subscribe signup contact-form searchform c9".split(),
}


def labelled_page(sentences: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page in a layout drawn by ``rng``, and the labels of its leaf blocks in order. Each
    block ends in a private sign that the caller strips, so labels survive parsing."""
    def text(low: int, high: int) -> str:
        k = rng.randrange(len(sentences))
        words = " ".join(sentences[k:k + 6]).split() or ["text"]
        return html_lib.escape(" ".join(words[:rng.randint(low, high)]))

    def name(kind: str) -> str:
        a = rng.choice(NAMES[kind])
        return rng.choice([f' class="{a}"', f' id="{a}"', f" class='{a} {rng.choice('abcdxyz')}{rng.randint(1, 9)}'", ""]
                          if rng.random() < 0.9 else [""])

    def links(kind: str, tag: str) -> str:
        n = rng.randint(2, 9)
        items = [f'<a href="/{k}">{text(1, 3)}\x02</a>' for k in range(n)]
        style = rng.randrange(4)
        if style == 0:
            inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        elif style == 1:
            inner = "<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
        elif style == 2:
            inner = " | ".join(i.replace("\x02", "") for i in items) + "\x02"
        else:
            inner = "".join(f"<div>{i}</div>" for i in items)
        return f"<{tag}{name(kind)}>{inner}</{tag}>"

    def small(kind: str, tags: str, low: int = 2, high: int = 30) -> str:
        tag = rng.choice(tags.split())
        inner = text(low, high) + "\x02"
        if rng.random() < 0.5:
            inner = f"<{rng.choice(['p', 'div', 'h3', 'h4'])}>{inner}" + rng.choice(["</p>", ""])
            inner = inner.replace("</p>", "") if not inner.startswith("<p>") else inner
        label = name(kind) or (f' class="{rng.choice(NAMES[kind])}"' if tag in ("div", "section", "p") else "")
        return f"<{tag}{label}>{inner}</{tag}>"

    def form(kind: str = "form") -> str:
        return (f"<form{name(kind)} action=/s><label>{text(1, 4)}\x02</label><input name=q>"
                f"<div><button>{text(1, 2)}\x02</button></div></form>")

    def comments() -> str:
        tag = rng.choice(["section", "div", "ol", "aside"])
        label = name("comments") or ' class="comments"'
        each = "".join(f"<{'li' if tag == 'ol' else 'div'} class=\"{rng.choice(['comment', 'reply', 'c', 'response'])}\">"
                       + rng.choice(["", f"<b>{text(1, 2)}</b> "]) + f"<p>{text(3, 60)}\x02</p>"
                       f"</{'li' if tag == 'ol' else 'div'}>" for _ in range(rng.randint(1, 5)))
        return f"<{tag}{label}>" + (f"<h3>{text(1, 3)}\x02</h3>" if tag != "ol" else "") + each + f"</{tag}>"

    def body() -> str:
        parts = [f"<h1>{text(2, 12)}\x01</h1>"] if rng.random() < 0.85 else []
        for k in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.72:
                inner = text(1, 110)
                if rng.random() < 0.2:
                    inner = f"<b>{inner}" + rng.choice(["</b>", "<br>"])
                if rng.random() < 0.2:
                    inner += f' <a href="/x">{text(1, 3)}</a>' + rng.choice([".", ""])
                parts.append(f"<p>{inner}\x01" + rng.choice(["</p>", "</p>", ""]))
            elif r < 0.80:
                parts.append(f"<{(h := rng.choice(['h2', 'h3']))}>{text(1, 8)}\x01</{h}>")
            elif r < 0.86:
                parts.append("<ul>" + "".join(f"<li>{text(2, 25)}\x01</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif r < 0.90:
                parts.append(f"<blockquote>{rng.choice(['', '<p>'])}{text(5, 50)}\x01</blockquote>")
            elif r < 0.93:
                parts.append(f"<table><tr><td>{text(1, 5)}\x01</td><td>{text(1, 9)}\x01</td></tr></table>")
            elif r < 0.96:
                parts.append(f"<pre>{text(3, 20)}\x01</pre>")
            elif k:
                parts.append(rng.choice([lambda: small("ad", "div aside section"), lambda: small("notice", "div aside"),
                                         form, lambda: links("side", "aside")])())
        return "".join(parts)

    main = body()
    style = rng.randrange(8)
    if style <= 2:
        main = f"<article{name('main') if rng.random() < 0.4 else ''}>{main}" + (comments() if rng.random() < 0.2 else "") + "</article>"
    elif style == 3:
        main = f"<main{name('main') if rng.random() < 0.4 else ''}>{main}</main>"
    elif style == 4:
        main = f"<main><article>{main}</article></main>"
    elif style <= 6:
        main = f"<div{name('main') or ' class=content'}>{main}</div>"
    else:
        main = f"<table><tr><td>{links('nav', 'div')}</td><td{name('main')}>{main}</td></tr></table>"
    page = []
    if rng.random() < 0.5:
        page.append(small("notice", "div section p dialog", 3, 40))
    if rng.random() < 0.6:
        page.append(f"<header{name('header')}>{rng.choice([text(1, 6) + chr(2), '<h2>' + text(1, 4) + chr(2) + '</h2>'])}"
                    + (links("nav", "nav") if rng.random() < 0.4 else "") + "</header>")
    elif rng.random() < 0.4:
        page.append(small("header", "div", 1, 8))
    if rng.random() < 0.8:
        page.append(links("nav", rng.choice(["nav", "nav", "div"])))
    for kind, p in (("form", 0.25), ("ad", 0.45)):
        if rng.random() < p:
            page.append(form() if kind == "form" else small("ad", "div aside section ins", 3, 40))
    around = [main]
    if rng.random() < 0.45:
        side = rng.choice([lambda: small("side", "aside div", 3, 60), lambda: links("side", rng.choice(["aside", "div"]))])()
        around.insert(rng.choice([0, 1]), side)
    page += around
    for p, make in ((0.3, comments), (0.25, lambda: small("ad", "div aside section", 3, 40)),
                    (0.2, lambda: links("side", rng.choice(["aside", "div", "section"]))), (0.15, form),
                    (0.15, lambda: small("notice", "div section", 3, 40))):
        if rng.random() < p:
            page.append(make())
    if rng.random() < 0.85:
        foot = rng.choice([f"&copy; {text(1, 12)}\x02", f"<p>{text(2, 25)}\x02</p>", f"{text(1, 5)} &middot; {text(1, 9)}\x02"])
        tag = rng.choice(["footer", "footer", "div"])
        page.append(f"<{tag}{name('footer') or (' class=footer' if tag == 'div' else '')}>{foot}</{tag}>")
    source = (f"<!DOCTYPE html><html><head><title>{text(2, 8)}</title><script>var a='<p>';</script></head><body>"
              + "".join(page) + rng.choice(["</body></html>", ""]))
    blocks = leaf_blocks(source)
    labels = [1 if "\x01" in b.text else 0 for b in blocks]
    return re.sub("[\x01\x02]", "", source), labels


def training_set(pages: list[str], layouts: int = LAYOUTS_PER_PAGE) -> list[tuple[list[list[str]], list[int]]]:
    out = []
    for k, page in enumerate(pages):
        blocks = leaf_blocks(page)
        sentences = [s for b in blocks for s in re.split(r"(?<=[.!?]) ", b.text) if s]
        inside = [int("in:article" in _path_names(b.path)) for b in blocks]
        if any(inside):
            out.append((block_features(blocks), inside))
        for j in range(layouts if sentences else 0):
            source, labels = labelled_page(sentences, random.Random(1000 * k + j))
            parsed = leaf_blocks(source)
            if len(parsed) == len(labels):
                out.append((block_features(parsed), labels))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
        sample: int = TRAIN_PAGES) -> CrfModel:
    html = F.col(f"`{html_col}`").cast("string")
    keyed = pages.where(html.isNotNull()).select(
        F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("a"), F.xxhash64(html).alias("b"), html.alias("html"))
    # the sample is chosen by two numbers a page; only its own pages reach the driver
    chosen = keyed.select("a", "b").distinct().orderBy("a", "b").limit(sample)
    rows = keyed.join(F.broadcast(chosen), ["a", "b"]).groupBy("a", "b").agg(F.first("html").alias("html"))
    return train(training_set([r["html"] for r in sorted(rows.collect(), key=lambda r: (r["a"], r["b"]))]))


def main_text(page: str | None, model: CrfModel) -> str:
    blocks = leaf_blocks(page)
    labels = model.decode(model.scores(blocks))
    return "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extracted(pages: DataFrame, model: CrfModel, html_col: str = "html"):
    """Column expression of the main text of ``html_col``."""
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.move))

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        found = CrfModel(*shared.value)
        return pd.Series([main_text(p, found) for p in pages], dtype=object)

    return extract(F.col(html_col))
