"""Main text of web pages by a recurrent block labeller.

A bidirectional LSTM in numpy reads a page's blocks as a sequence (hashed tag path, hashed words and shape of each) and labels
every block as article or not with the whole page as context; article blocks, joined by newlines, are the text.

Training. No page has labels, so the labeller is trained on pages it makes itself from a grammar of layouts: menus, headers,
footers, sidebars, notices, adverts, forms and reader comments around an article, with the names sites give them. A second labeller is
trained on pages most of which have names that tell nothing, or none, and plain elements in place of landmarks. Where a page names its main
part both vote, elsewhere the second decides. ``TRAIN_PAGES`` and ``BARE_PAGES`` bound the samples whatever the table's size; weights are
fitted once a process from fixed seeds and sent to the tasks (about 300 KB). Pages are read by tasks, batch by batch.

Defined cases: null and empty pages have empty text; very long pages, ill-formed ones too, are read whole in linear time; a page without article blocks has empty text; equal rows give equal rows; an
empty table gives an empty table; columns named like an output column are replaced, all others are kept.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from aerolake.llm.common import map_batches, read_table
from aerolake.llm.html_blocks import DIM, Block, blocks, vectors

TRAIN_PAGES, BARE_PAGES = 1000, 2500
#: Share of the second labeller's pages whose names tell nothing, so that shape, links, words and place must carry its labels; weight of the first.
DISGUISED, NAMED_SHARE = 0.7, 0.7
HIDDEN = 24
EPOCHS = 5
#: Blocks whose features a recurrent pass holds at once; longer pages are read chunk by chunk, states carried on.
CHUNK = 512


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction; parameters W (DIM + hidden + 1, 4 * hidden), gates in the order input, forget, output, candidate."""

    @staticmethod
    def forward(w: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool = False, state: list[np.ndarray] | None = None):
        """x (time, pages, DIM), mask (time, pages): hidden states, and what backward needs.

        ``state`` holds h and c to go on from (empty: zeros) and takes those at the end.
        """
        t, n, d = x.shape
        h_dim = w.shape[1] // 4
        inputs = (x.reshape(t * n, d) @ w[:d] + w[-1]).reshape(t, n, -1)
        h, c = state or (np.zeros((n, h_dim), np.float32), np.zeros((n, h_dim), np.float32))
        out, saved = np.zeros((t, n, h_dim), np.float32), []
        for i in range(t):
            z = inputs[i] + h @ w[d:-1]
            gates = sigmoid(z[:, : 3 * h_dim])
            g_in, g_forget, g_out = gates[:, :h_dim], gates[:, h_dim : 2 * h_dim], gates[:, 2 * h_dim :]
            new = np.tanh(z[:, 3 * h_dim :])
            m = mask[i][:, None]
            c_next = m * (g_forget * c + g_in * new) + (1 - m) * c
            squashed = np.tanh(c_next)
            h_next = m * (g_out * squashed) + (1 - m) * h
            if keep:
                saved.append((h, c, gates, new, squashed))
            h, c = h_next, c_next
            out[i] = h
        if state is not None:
            state[:] = h, c
        return (out, saved) if keep else out

    @staticmethod
    def backward(w: np.ndarray, x: np.ndarray, mask: np.ndarray, saved: list, d_out: np.ndarray) -> np.ndarray:
        t, n, d = x.shape
        h_dim = w.shape[1] // 4
        grad = np.zeros_like(w)
        dh, dc = np.zeros((n, h_dim), np.float32), np.zeros((n, h_dim), np.float32)
        for i in range(t - 1, -1, -1):
            h, c, gates, new, squashed = saved[i]
            g_in, g_forget, g_out = gates[:, :h_dim], gates[:, h_dim : 2 * h_dim], gates[:, 2 * h_dim :]
            m = mask[i][:, None]
            dh = dh + d_out[i]
            da = m * dh
            dcc = m * dc + da * g_out * (1 - squashed**2)
            dz = np.concatenate([dcc * new * g_in * (1 - g_in), dcc * c * g_forget * (1 - g_forget), da * squashed * g_out * (1 - g_out), dcc * g_in * (1 - new**2)], 1)
            grad[:d] += x[i].T @ dz
            grad[d:-1] += h.T @ dz
            grad[-1] += dz.sum(0)
            dh = dz @ w[d:-1].T + (1 - m) * dh
            dc = dcc * g_forget + (1 - m) * dc
        return grad


def short_features(pages: list[list[Block]]) -> list[np.ndarray | None]:
    """Features of the pages that one pass reads; longer ones make theirs chunk by chunk."""
    return [vectors(found) if len(found) <= CHUNK else None for found in pages]


class Labeller:
    """Bidirectional LSTM and a logistic output a block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def new(cls, seed: int, hidden: int = HIDDEN) -> Labeller:
        rng = np.random.default_rng(seed)
        one = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        w = {"ahead": one(DIM + hidden + 1, 4 * hidden), "back": one(DIM + hidden + 1, 4 * hidden), "out": one(2 * hidden + 1)}
        for k in ("ahead", "back"):
            w[k][-1] = 0
            w[k][-1, hidden : 2 * hidden] = 1
        return cls(w)

    @staticmethod
    def _batch(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, seqs))
        x, mask = np.zeros((t, len(seqs), DIM), np.float32), np.zeros((t, len(seqs)), np.float32)
        for i, s in enumerate(seqs):
            x[: len(s), i], mask[: len(s), i] = s, 1
        return x, mask

    def logits(self, seqs: list[np.ndarray]) -> list[np.ndarray]:
        """Log-odds of each block of each sequence; sequences of like length are read together."""
        out: list[np.ndarray | None] = [None] * len(seqs)
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        for k in range(0, len(order), 64):
            some = [i for i in order[k : k + 64] if len(seqs[i])]
            if not some:
                continue
            x, mask = self._batch([seqs[i] for i in some])
            ahead = Lstm.forward(self.w["ahead"], x, mask)
            back = Lstm.forward(self.w["back"], x[::-1], mask[::-1])[::-1]
            z = np.concatenate([ahead, back], 2) @ self.w["out"][:-1] + self.w["out"][-1]
            for j, i in enumerate(some):
                out[i] = z[: len(seqs[i]), j]
        return [np.empty(0, np.float32) if z is None else z for z in out]

    def long_logits(self, found: list[Block], chunk: int = CHUNK) -> np.ndarray:
        """What ``logits`` gives for one page, with the features of one chunk in memory and two hidden states a block."""
        n, hidden = len(found), self.w["ahead"].shape[1] // 4
        both = np.empty((n, 2 * hidden), np.float32)
        starts = range(0, n, chunk)
        for name, order, turn, part in (("ahead", starts, 1, slice(0, hidden)), ("back", reversed(starts), -1, slice(hidden, None))):
            state: list[np.ndarray] = []
            for a in order:
                x = vectors(found, a, a + chunk)[::turn, None]
                out = Lstm.forward(self.w[name], x, np.ones(x.shape[:2], np.float32), state=state)
                both[a : a + chunk, part] = out[::turn, 0]
        return both @ self.w["out"][:-1] + self.w["out"][-1]

    def scores(self, pages: list[list[Block]], features: list[np.ndarray | None] | None = None) -> list[np.ndarray]:
        """Log-odds of each block of each page. Every one sees the whole page, however long. ``features``: what ``short_features`` gave, if known."""
        features = short_features(pages) if features is None else features
        short = [p for p, x in enumerate(features) if x is not None]
        out = [np.zeros(0, np.float32) for _ in pages]
        for p, z in zip(short, self.logits([features[p] for p in short]), strict=True):
            out[p] = z
        for p, found in enumerate(pages):
            if features[p] is None:
                out[p] = self.long_logits(found)
        return out

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Is each block of each page article?"""
        return [z > 0 for z in self.scores(pages)]

    def fit(self, seqs: list[np.ndarray], labels: list[np.ndarray], epochs: int, seed: int, rate: float = 0.01) -> None:
        """Adam on the mean log loss of blocks."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        by_length = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        batches = [by_length[i : i + 32] for i in range(0, len(by_length), 32)]
        hidden = self.w["ahead"].shape[1] // 4
        for epoch in range(epochs):
            for k in rng.permutation(len(batches)):
                some = batches[k]
                x, mask = self._batch([seqs[i] for i in some])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(some):
                    y[: len(labels[i]), j] = labels[i]
                ahead, kept_a = Lstm.forward(self.w["ahead"], x, mask, True)
                back, kept_b = Lstm.forward(self.w["back"], x[::-1], mask[::-1], True)
                both = np.concatenate([ahead, back[::-1]], 2)
                z = both @ self.w["out"][:-1] + self.w["out"][-1]
                dz = (sigmoid(z) - y) * mask / mask.sum()
                d_both = dz[..., None] * self.w["out"][:-1]
                grad = {
                    "out": np.concatenate([(dz[..., None] * both).sum((0, 1)), [dz.sum()]]).astype(np.float32),
                    "ahead": Lstm.backward(self.w["ahead"], x, mask, kept_a, d_both[..., :hidden]),
                    "back": Lstm.backward(self.w["back"], x[::-1], mask[::-1], kept_b, d_both[::-1][..., hidden:]),
                }
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                step += 1
                r = rate * 0.5**epoch if epoch else rate
                for n, g in grad.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.99 * v[n] + 0.01 * g * g
                    self.w[n] = (self.w[n] - r * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


class PageGrammar:
    """Makes labelled training pages: layouts with the parts and names that sites use, around an article of made-up words."""

    PARTS = {
        "nav": ["<nav>", '<nav class="menu">', '<div class="navbar">', '<div id="navigation">', '<ul class="menu">', '<div class="breadcrumb">', '<div role="navigation">', '<div class="topnav">'],
        "header": ["<header>", '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<div role="banner">', '<header class="top">'],
        "footer": ["<footer>", '<div id="footer">', '<div class="site-footer">', '<footer class="bottom">', '<div class="copyright">', '<div role="contentinfo">'],
        "side": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="related">', '<div class="widget">', '<section class="related">', '<div class="recommended">', '<div class="more">', '<div role="complementary">'],
        "notice": ['<div class="cookie-banner">', '<div id="cookie">', '<div class="notice">', '<div class="consent">', '<div class="newsletter">', '<div class="popup">', '<div class="modal">', '<div class="alert">', '<section class="subscribe">', '<div class="gdpr">'],
        "ad": ['<div class="ad">', '<div class="advert">', '<div class="ads">', '<div class="sponsored">', '<div class="promo">', '<aside class="ad">', '<div id="ad">', '<div class="banner">', '<section class="advertisement">'],
        "form": ["<form>", '<form class="search">', '<form id="login">', '<form class="comment-form">', "<form action=x>"],
        "comments": ['<div class="comments">', '<section class="comments">', '<div id="comments">', '<ol class="comment-list">', '<section id="comments">', '<div class="discussion">', '<div class="replies">', '<ul class="comments">'],
    }
    MAIN = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="entry-content">', '<article class="post">', '<section class="article">', '<div class="article-body">', '<div role="main">', '<div class="story">', ""]
    MENU = "Home About Contact News Sports Login Register Search Archive Help Topics Next Previous Share Tags".split()

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.stems = ["".join(self.rng.choice(list("abcdefghijklmnopqrstuvwxyzéäñ"), self.rng.integers(2, 9))) for _ in range(600)]

    def words(self, low: int, high: int) -> str:
        out = [str(x) for x in self.rng.choice(self.stems, self.rng.integers(low, high))]
        out[0] = out[0].capitalize()
        return " ".join(out) + str(self.rng.choice([".", ".", ".", "", "!", "?"]))

    def one(self, options: list[str]) -> str:
        return options[self.rng.integers(len(options))]

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(2, 12)}</h1>")
        for _ in range(r.integers(0, 2) if r.random() < 0.15 else r.integers(1, 14)):
            kind = r.random()
            text = self.words(1, 12) if r.random() < 0.25 else self.words(8, 120)
            if r.random() < 0.2:
                text = text.replace(" ", f' <a href="/x">{self.one(self.stems)}</a> ', 1)
            if kind < 0.06:
                out.append(f"<h2>{self.words(1, 7)}</h2>")
            elif kind < 0.1:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.integers(1, 6))) + "</ul>")
            elif kind < 0.13:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.15:
                out.append(f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>")
            elif kind < 0.17:
                out.append(f"<pre>{text}</pre>")
            elif kind < 0.22:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.25:
                out.append(f"<div>{text}</div>")
            else:
                out.append(f"<p>{text}</p>")
        return "".join(out)

    def part(self, kind: str) -> str:
        r = self.rng
        open_ = self.one(self.PARTS[kind])
        name = open_[1:].split(" ")[0].rstrip(">")
        item = lambda: f'<li><a href="/{self.one(self.stems)}">{self.one(self.MENU) if r.random() < 0.3 else self.words(1, 3)}</a></li>'
        if kind == "nav":
            inner = "".join(item() for _ in range(r.integers(2, 9)))
            inner = inner if name in ("ul", "ol") else f"<ul>{inner}</ul>"
        elif kind == "footer":
            inner = f"&copy; {self.words(2, 20)}" if r.random() < 0.5 else f"<p>{self.words(3, 25)}</p><ul>{item()}{item()}</ul>"
        elif kind == "header":
            inner = f'<a href="/">{self.words(1, 4)}</a><p>{self.words(2, 12)}</p>'
        elif kind == "form":
            inner = f'<label>{self.words(1, 4)}</label><input name="q"><button>{self.words(1, 2)}</button>' + (f"<p>{self.words(3, 20)}</p>" if r.random() < 0.4 else "")
        elif kind == "comments":
            row = "li" if name in ("ol", "ul") else "div"
            inner = (f"<h3>{self.words(1, 4)}</h3>" if row == "div" and r.random() < 0.5 else "") + "".join(f'<{row} class="comment"><p>{self.words(3, 60)}</p></{row}>' if r.random() < 0.7 else f"<{row}><b>{self.one(self.stems)}</b>: {self.words(3, 60)}</{row}>" for _ in range(r.integers(1, 6)))
        elif kind == "side":
            inner = f"<h3>{self.words(1, 4)}</h3>" + ("<ul>" + "".join(item() for _ in range(r.integers(1, 6))) + "</ul>" if r.random() < 0.6 else f"<p>{self.words(3, 50)}</p>")
        else:
            inner = self.words(3, 30) if r.random() < 0.5 else f"<p>{self.words(3, 40)}</p>" + (f"<button>{self.words(1, 3)}</button>" if r.random() < 0.3 else "")
        return f"{open_}{inner}</{name}>"

    def page(self) -> list[tuple[str, bool]]:
        """Chunks of a page and whether each is article."""
        r = self.rng
        some = lambda *kinds: [(self.part(k), False) for k in kinds if r.random() < 0.5]
        main = self.one(self.MAIN)
        name = main[1:].split(" ")[0].rstrip(">") if main else ""
        inner = [(self.article(), True)]
        if name and r.random() < 0.4:
            inner.append((self.part(self.one(["ad", "comments", "side", "notice", "form"])), False))
            inner += [(self.article(), True)] if r.random() < 0.5 else []
        wrap = r.random() < 0.25
        out = [("<html><head><title>t</title></head><body>" + ('<div class="wrapper">' if wrap else ""), False)]
        out += some("notice", "header", "nav", "ad", "side", "form")
        out += [(main, False), *inner, (f"</{name}>" if name else "", False)]
        out += some("ad", "comments", "side", "form", "notice", "nav", "footer")
        return [*out, ("</div>" if wrap else "", False), ("</body></html>", False)]

    def disguised(self, html: str) -> str:
        """A page under other names: every class, id and role gets a name that tells nothing, or none; on some pages landmark elements become plain ones."""
        r, names = self.rng, {}
        bare, plain = r.random() < 0.3, r.random() < 0.6

        def other(m: re.Match) -> str:
            if bare:
                return ""
            if m[2] not in names:
                letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
                names[m[2]] = self.one(self.stems) if r.random() < 0.4 else "css-" + "".join(r.choice(letters, r.integers(2, 7)))
            return f' class="{names[m[2]]}"'

        html = re.sub(r' (class|id|role)="([^"]*)"', other, html)
        return re.sub(r"(</?)(?:nav|header|footer|aside|article|main|section)\b", r"\1div", html) if plain else html

    def sample(self, disguise: float = 0.0) -> tuple[list[Block], np.ndarray]:
        """Blocks of a page and their labels, found by marks in the text; a share of pages is disguised."""
        marked = "".join(c.replace(">", ">\x01").replace("\x01<", "<") if article else c for c, article in self.page())
        if self.rng.random() < disguise:
            marked = self.disguised(marked)
        found = blocks(marked)
        labels = np.array(["\x01" in b.text for b in found], bool)
        for b in found:
            b.text = " ".join(b.text.replace("\x01", "").split())
        keep = [i for i, b in enumerate(found) if b.text]
        return [found[i] for i in keep], labels[keep]


@lru_cache(4)
def trained(pages: int = TRAIN_PAGES, seed: int = 11, epochs: int = EPOCHS, disguise: float = 0.0) -> Labeller:
    """A labeller, fitted on ``pages`` made pages, a share of them disguised."""
    grammar = PageGrammar(seed)
    rows = [x for x in (grammar.sample(disguise) for _ in range(pages)) if len(x[0])]
    labeller = Labeller.new(seed)
    labeller.fit([vectors(b) for b, _ in rows], [y for _, y in rows], epochs, seed)
    return labeller


class Committee:
    """Two labellers: one that knows the names sites give their parts, and one that has learnt to do without. The first counts where a page names its main part."""

    LANDMARKS = tuple("<" + m[1:-1] if m.count(" ") == 0 else m[1:-1].split(" ", 1)[1] for m in PageGrammar.MAIN if m)

    def __init__(self, named: Labeller, bare: Labeller):
        self.named, self.bare = named, bare

    @classmethod
    def trained(cls) -> Committee:
        return cls(trained(), trained(BARE_PAGES, 12, EPOCHS, DISGUISED))

    def label(self, html: list[str], pages: list[list[Block]]) -> list[np.ndarray]:
        """Is each block of each page article? ``html``: the pages' sources."""
        known, features = [any(m in h for m in self.LANDMARKS) for h in html], short_features(pages)
        named = iter(self.named.scores([p for p, k in zip(pages, known, strict=True) if k], [x for x, k in zip(features, known, strict=True) if k]))
        out = []
        for z, k in zip(self.bare.scores(pages, features), known, strict=True):
            out.append((NAMED_SHARE * next(named) + (1 - NAMED_SHARE) * z if k else z) > 0)
        return out


def main_text(found: list[Block], article: np.ndarray) -> str:
    return "\n".join(b.text for b, keep in zip(found, article, strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", committee: Committee | None = None) -> DataFrame:
    """Append ``text`` and ``n_chars``; the html is dropped."""
    both = committee or Committee.trained()
    weights = pages.sparkSession.sparkContext.broadcast((both.named.w, both.bare.w))  # a fixed number of weights

    def task():
        model = Committee(*map(Labeller, weights.value))

        def call(batch: pa.RecordBatch) -> dict:
            html = [h.as_py() or "" for h in batch.column(batch.schema.get_field_index(html_col))]
            found = [blocks(h) for h in html]
            text = [main_text(b, y) for b, y in zip(found, model.label(html, found), strict=True)]
            return {"text": text, "n_chars": [len(t) for t in text]}

        return call

    return map_batches(pages, task, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], (html_col,))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op8_html": op8_html}
