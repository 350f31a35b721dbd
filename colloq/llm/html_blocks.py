"""Main text of web pages by a recurrent block labeller in numpy.

A page becomes a sequence of leaf blocks, each with the tags, classes and ids
above it and its words. A bidirectional LSTM reads the sequence, so each block
is judged in the context of the whole page, and labels it as text or not. The
network is trained on pages made here from a grammar of layouts, never on the
input; its inputs are hashed and unknown names count as nothing. Scoring is
one pass over the pages without a shuffle.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_batches

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[!/a-zA-Z][^>]*\Z", re.S)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template title iframe svg audio video".split())
UNPARSED = frozenset("script style title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    """html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre search section select summary
    table tbody td textarea tfoot th thead tr ul""".split()
)
#: Tags that a new tag ends, if they are open in the same list or paragraph.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select article section div body main aside nav header footer form blockquote".split())

PATH_ROWS, WORD_ROWS, PATH_DIM, WORD_DIM, NUMBERS, UNITS = 4096, 8192, 12, 6, 6, 10
STEPS, PAGES = 260, 24


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple[str, ...], text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(tag: str, attributes: str) -> list[str]:
    out = [tag]
    for m in NAMES.finditer(attributes) if attributes else ():
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            out.append("." + name)
            out += ["." + part for part in re.split(r"[-_\d]+", name) if part and part != name]
    return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order; character references are decoded, runs of white space are one space.

    A block's path is the names above it, each once. An element keeps its own
    path and shares its parent's if it adds no name, so deep pages stay linear.
    """
    out: list[Block] = []
    stack: list[tuple[str, list[str], tuple[str, ...]]] = []
    named, opened = Counter(), Counter()
    endless: set[str] = set()
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0

    def close():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(stack[-1][2] if stack else (), text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def push(tag: str, names: list[str]):
        above = stack[-1][2] if stack else ()
        fresh = tuple(n for n in dict.fromkeys(names) if not named[n])
        named.update(names)
        opened[tag] += 1
        stack.append((tag, names, above + fresh if fresh else above))

    def pop() -> str:
        tag, names, _ = stack.pop()
        named.subtract(names)
        opened[tag] -= 1
        return tag

    def take(raw: str):
        nonlocal linked
        if raw:
            parts.append(text := html.unescape(raw) if "&" in raw else raw)
            linked += len(text) * (in_link > 0)

    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCKS:
                close()
                if opened[tag] > 0:
                    while pop() != tag:
                        pass
            continue
        if tag in RAW:
            # A script or the like that never ends takes the rest; other elements are skipped only if they end.
            end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)  # nor is there one further on
            at = end.end() if end else size if tag in UNPARSED else at
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCKS:
            close()
            in_link = 0 if tag not in ("div", "p", "h1", "h2", "h3", "li") else in_link
            gone = ENDS.get(tag, {"p"})
            while stack and stack[-1][0] in gone and stack[-1][0] not in SCOPES:
                pop()
            if tag != "hr":
                push(tag, _names(tag, m[3]))
    close()
    return out


def _hash(x: str, rows: int) -> int:
    return zlib.crc32(x.encode("utf-8", "replace")) % rows


@functools.lru_cache(100_000)
def _word_row(word: str) -> int:
    return _hash(word.lower().strip(".,;:!?()\"'"), WORD_ROWS)


@functools.lru_cache(20_000)
def _path_rows(path: tuple[str, ...]) -> tuple[int, ...]:
    last = path[-1] if path else ""
    return tuple(_hash(x, PATH_ROWS) for x in (*path, "/" + last))


def features(page: list[Block]) -> list[tuple]:
    """(path rows, word rows, numbers) of each block; every word has a row."""
    n, out = len(page), []
    for i, b in enumerate(page):
        words = b.text.split()
        ends = b.text.count(". ") + b.text.endswith((".", "!", "?"))
        numbers = (min(len(words), 60) / 30 - 1, b.linked / len(b.text), i / n, (n - i) / n, min(ends, 4) / 4, float(len(words) < 8))
        out.append((_path_rows(b.path), tuple(map(_word_row, words)), numbers))
    return out


class Labeller:
    def __init__(self, seed: int = 5):
        r, h = np.random.default_rng(seed), UNITS
        d = PATH_DIM + WORD_DIM + NUMBERS
        n = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {"path": np.zeros((PATH_ROWS, PATH_DIM), np.float32), "word": np.zeros((WORD_ROWS, WORD_DIM), np.float32), "w": n(2, d, 4 * h, s=0.4), "u": n(2, h, 4 * h, s=0.3), "b": np.zeros((2, 1, 4 * h), np.float32), "out": n(2 * h + d, s=0.3), "bias": np.zeros(1, np.float32)}
        self.p["b"][..., h : 2 * h] = 1

    def _inputs(self, pages: list[list[tuple]]):
        flat = [f for page in pages for f in page]
        paths, words = [f[0] for f in flat], [f[1] for f in flat]
        n, m = np.array([len(x) for x in paths]), np.array([len(x) for x in words])
        pi, wi = np.array([i for x in paths for i in x]), np.array([i for x in words for i in x])
        a = np.add.reduceat(self.p["path"][pi], np.cumsum(n) - n)
        b = np.add.reduceat(self.p["word"][wi], np.cumsum(m) - m) / m[:, None].astype(np.float32)
        return np.concatenate([a, b, np.array([f[2] for f in flat], np.float32)], 1).astype(np.float32), (n, m, pi, wi)

    def _grid(self, x: np.ndarray, counts: np.ndarray):
        span = counts.max()
        live = np.arange(span) < counts[:, None]
        grid = np.zeros((len(counts), span, x.shape[1]), np.float32)
        grid[live] = x
        return grid, live

    def forward(self, grid: np.ndarray, live: np.ndarray, keep: bool = False):
        h, (n, span, _) = UNITS, grid.shape
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        hidden, trail = np.empty((n, span, 2 * h), np.float32), []
        for t in range(span):
            a, b = t, span - 1 - t
            x = np.stack([grid[:, a], grid[:, b]])
            g = x @ self.p["w"] + state @ self.p["u"] + self.p["b"]
            gates = 1 / (1 + np.exp(-g[..., : 3 * h]))
            i, f, o, c = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :], np.tanh(g[..., 3 * h :])
            m = np.stack([live[:, a], live[:, b]])[..., None]
            new = np.where(m, f * cell + i * c, cell)
            squashed = np.tanh(new)
            if keep:
                trail.append((x, state, cell, i, f, o, c, squashed, m))
            state, cell = np.where(m, o * squashed, state), new
            hidden[:, a, :h], hidden[:, b, h:] = state[0], state[1]
        both = np.concatenate([hidden, grid], 2)
        logits = both @ self.p["out"] + self.p["bias"]
        return (logits, both, trail) if keep else logits

    def step(self, pages: list[list[tuple]], labels: list[list[int]], optimiser: dict, rate: float) -> float:
        h, p = UNITS, self.p
        x, (n, m, pi, wi) = self._inputs(pages)
        grid, live = self._grid(x, np.array([len(y) for y in labels]))
        target = np.zeros(live.shape, np.float32)
        target[live] = np.concatenate([np.array(y, np.float32) for y in labels])
        logits, both, trail = self.forward(grid, live, True)
        prob = 1 / (1 + np.exp(-logits))
        d = np.where(live, prob - target, 0).astype(np.float32) / live.sum()
        g = {"out": np.einsum("ns,nsk->k", d, both), "bias": d.sum(keepdims=True).ravel(), "w": np.zeros_like(p["w"]), "u": np.zeros_like(p["u"]), "b": np.zeros_like(p["b"])}
        dboth = d[..., None] * p["out"]
        dgrid, span = dboth[..., 2 * h :].copy(), grid.shape[1]
        ds, dc = np.zeros((2, len(pages), h), np.float32), np.zeros((2, len(pages), h), np.float32)
        for t in range(span - 1, -1, -1):
            a, b = t, span - 1 - t
            x_, state, cell, i, f, o, c, squashed, m_ = trail[t]
            ds = ds + np.stack([dboth[:, a, :h], dboth[:, b, h : 2 * h]])
            own = ds * m_
            dcell = (dc + own * o * (1 - squashed * squashed)) * m_
            dg = np.concatenate([dcell * c * i * (1 - i), dcell * cell * f * (1 - f), own * squashed * o * (1 - o), dcell * i * (1 - c * c)], 2)
            g["w"] += x_.transpose(0, 2, 1) @ dg
            g["u"] += state.transpose(0, 2, 1) @ dg
            g["b"] += dg.sum(1, keepdims=True)
            dx = dg @ p["w"].transpose(0, 2, 1)
            dgrid[:, a] += dx[0]
            dgrid[:, b] += dx[1]
            ds = ds * (1 - m_) + dg @ p["u"].transpose(0, 2, 1)
            dc = dc * (1 - m_) + dcell * f
        dflat = dgrid[live]
        g["path"], g["word"] = np.zeros_like(p["path"]), np.zeros_like(p["word"])
        np.add.at(g["path"], pi, np.repeat(dflat[:, :PATH_DIM], n, axis=0))
        np.add.at(g["word"], wi, np.repeat(dflat[:, PATH_DIM : PATH_DIM + WORD_DIM] / m[:, None].astype(np.float32), m, axis=0))
        optimiser["t"] = t = optimiser.get("t", 0) + 1
        for k, grad in g.items():
            m1, m2 = optimiser.setdefault(k, [np.zeros_like(grad), np.zeros_like(grad)])
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            p[k] -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        return float(-np.log(np.where(target == 1, prob, 1 - prob)[live] + 1e-9).mean())

    def label(self, pages: list[list[tuple]], cells: int = 40_000) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length are scored together."""
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(pages[order[end]]) * (end + 1 - at) <= cells:
                end += 1
            some = order[at:end]
            counts = np.array([len(pages[i]) for i in some])
            grid, live = self._grid(self._inputs([pages[i] for i in some])[0], counts)
            good = self.forward(grid, live) > 0
            for row, i in enumerate(some):
                out[i] = good[row, : counts[row]]
            at = end
        return out


# Pages to learn from. Names that page authors give to the parts of a page.
MAIN = "post content entry story article-body main-content post-content entry-content text body-text prose markdown page-content single".split()
PARTS = {
    "menu": "nav navbar menu main-menu site-nav topnav breadcrumb breadcrumbs pagination pager toc tabs skip-link".split(),
    "header": "header site-header masthead top-bar banner branding logo hero".split(),
    "footer": "footer site-footer bottom colophon copyright legal credits".split(),
    "sidebar": "sidebar side widget widgets aside related recommended popular trending tags tag-list archive categories author-box bio".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay message paywall newsletter subscribe promo".split(),
    "advert": "ad ads advert advertisement sponsored sponsor banner-ad ad-slot adsbygoogle promo-box".split(),
    "form": "form search search-form login signup contact-form subscribe-form poll".split(),
    "comments": "comments comment comment-list comment-body reply respond discussion reviews disqus".split(),
    "social": "social share sharing share-buttons follow likes".split(),
}
PHRASES = """Home|About us|Contact|Log in|Sign up|Search|Menu|Read more|Share|Tweet|Next|Previous|Subscribe to our newsletter|We use cookies to improve your experience.|Accept all|Privacy policy|Terms of service|All rights reserved.|Advertisement|Sponsored|Related articles|Leave a comment|Reply|Posted by|Follow us|Copyright|© 2024 example|Newsletter|Enter your email|Submit|Skip to content|Categories|Tags|Archive|Popular posts|Buy now|Download|Back to top|Powered by""".split("|")


def _prose(r: random.Random, low: int, high: int) -> str:
    syllables = r.choice((("the", "er", "an", "th", "ing", "on"), ("ung", "sch", "ein", "der", "ge", "ver"), ("que", "le", "eau", "ment", "re", "oi"), ("ción", "os", "ar", "mente", "la", "do")))
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    out, start = [], True
    for w in words:
        end = r.random() < 0.12
        out.append((w.capitalize() if start else w) + ("." if end else "," if r.random() < 0.05 else ""))
        start = end
    return " ".join(out) + ("." if r.random() < 0.8 else "")


def _part(r: random.Random, kind: str) -> str:
    """A part of a page that is not main text; its words may be prose as well."""
    own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
    tag = own if own and r.random() < 0.6 else r.choice(("div", "section", "div"))
    names = f' {r.choice(("class", "class", "id"))}="{" ".join(r.sample(PARTS[kind], r.randint(1, 2)))}"' if tag not in own_tags or r.random() < 0.5 else ""
    say = lambda: r.choice(PHRASES) if r.random() < 0.4 else _prose(r, 1, 5)
    long_text = lambda: _prose(r, 4, 60) if r.random() < 0.7 else say()
    if kind in ("menu", "social"):
        inner = "<ul>" + "".join(f'<li><a href="/{i}">{say()}</a></li>' for i in range(r.randint(2, 8))) + "</ul>" if r.random() < 0.8 else " | ".join(f'<a href="/{i}">{say()}</a>' for i in range(r.randint(2, 6)))
    elif kind == "comments":
        inner = ("<h3>Comments</h3>" if r.random() < 0.5 else "") + "".join(r.choice(('<div class="comment"><p>{}</p></div>', "<p>{}</p>", '<li class="comment"><b>{}</b> {}</li>', "<article><p>{}</p></article>")).format(long_text(), long_text()) for _ in range(r.randint(1, 5)))
    elif kind == "form":
        inner = f'<label>{say()}</label><input name="q"><select><option>{say()}<option>{say()}</select><button>{say()}</button>' + (f"<p>{long_text()}</p>" if r.random() < 0.4 else "")
    elif kind == "sidebar":
        inner = f"<h3>{say()}</h3>" + r.choice(("<ul>" + "".join(f'<li><a href="/x">{_prose(r, 2, 9)}</a></li>' for _ in range(r.randint(2, 6))) + "</ul>", f"<p>{long_text()}</p>", f"<p>{long_text()}</p><p>{long_text()}</p>"))
    elif kind == "header":
        inner = r.choice((f"<h1>{_prose(r, 1, 4)}</h1>", f'<a href="/">{say()}</a>', f"<p>{long_text()}</p>")) + (_part(r, "menu") if r.random() < 0.4 else "")
    else:
        inner = r.choice((long_text(), f"<p>{long_text()}</p>", f"<p>{long_text()}</p><p>{say()}</p>", f"<span>{say()}</span> {long_text()}"))
    return f"<{tag}{names}>{inner}</{tag}>"


own_tags = frozenset("nav header footer aside form".split())
MARK = "⁣"  # stands before the text of main blocks while pages are made


def made_page(r: random.Random) -> tuple[str, list[int]]:
    """A page and its blocks' labels."""
    body = []
    for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
        p = MARK + _prose(r, 1, r.choice((6, 25, 90)))
        body.append(r.choice((f"<p>{p}</p>",) * 7 + (f"<p><b>{p}<br>", f"<h2>{p}</h2>", f"<ul><li>{p}</li><li>{MARK}{_prose(r, 1, 12)}</li></ul>", f"<blockquote>{p}</blockquote>", f'<p>{p} <a href="#">{_prose(r, 1, 3)}</a> {_prose(r, 1, 9)}</p>', f"<div>{p}</div>", f"<table><tr><td>{p}</td></tr></table>", f"<pre>{p}</pre>", p + "<br>")))
    if r.random() < 0.25:
        body.insert(r.randrange(len(body) + 1), _part(r, r.choice(("advert", "social", "notice", "sidebar"))))
    title = f"<h1>{MARK}{_prose(r, 1, 10)}</h1>" if r.random() < 0.7 else ""
    tag = r.choice(("article", "article", "article", "main", "div", "section", "div"))
    names = f' class="{r.choice(MAIN)}"' if tag in ("div", "section") or r.random() < 0.3 else ""
    main = f"<{tag}{names}>{title}{''.join(body)}</{tag}>"
    if r.random() < 0.3:
        main = f"<{r.choice(('main', 'div'))}>{main}" + "</main></div>"
    before = [_part(r, k) for k in ("header", "menu", "notice", "advert", "sidebar", "form", "social") if r.random() < 0.35]
    after = [_part(r, k) for k in ("comments", "sidebar", "footer", "social", "advert", "form", "notice", "menu") if r.random() < 0.35]
    r.shuffle(before)
    page = "<html><head><title>x</title></head><body>" + "".join(before) + main + "".join(after) + "</body></html>" * (r.random() < 0.9)
    found = blocks(page)
    labels = [int(MARK in b.text) for b in found]
    for b in found:
        b.text = b.text.replace(MARK, "") or "x"
    return found, labels


@functools.lru_cache(2)
def trained(seed: int = 5) -> Labeller:
    """The labeller after a fixed number of steps over made pages; the same for every input."""
    r, net, optimiser = random.Random(seed), Labeller(seed), {}
    for step in range(STEPS):
        made = [made_page(r) for _ in range(PAGES)]
        made = [(b, y) for b, y in made if b and len(b) <= 48]
        net.step([features(b) for b, _ in made], [y for _, y in made], optimiser, 0.02 if step < STEPS * 2 // 3 else 0.006)
    return net


def main_texts(net: Labeller, pages: list[str]) -> list[str]:
    found = [blocks(p) for p in pages]
    good = net.label([features(b) for b in found])
    return ["\n".join(b.text for b, keep in zip(own, k) if keep) for own, k in zip(found, good)]


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null, empty or textless page has the empty text. Pages of any length are
    read whole; malformed markup is read as browsers do in the main cases
    (unclosed elements, cut-off tags). Repeated rows give repeated rows, no
    rows give none, and other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # under 1 MB

    def run(batches):
        for batch in batches:
            texts = []
            for at in range(0, len(batch), 500):
                texts += main_texts(shared.value, [x or "" for x in batch.column(2).slice(at, 500).to_pylist()])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = text_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
