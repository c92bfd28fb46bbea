"""Main-text extraction from HTML with a recurrent block labeller.

A page is a sequence of leaf blocks; each is a vector of its tag path, its hashed words and a few numbers. A
bidirectional LSTM in numpy reads the sequence from both ends, so that every block is labelled with the
whole page in view; blocks labelled as main text are joined.

The network is trained on a bounded sample of the pages. Pages carry no labels, so the sample is labelled
from what its own markup says outright (``markup_labels``), and each sampled page is also shown in altered
forms: with sidebars, notices, forms, comments, headers and adverts put in, made from words of other pages,
and with its article element replaced by other common containers.

Defined results: null, empty and textless pages give an empty text; broken markup is read as far as it
goes; pages are read whole; rows that repeat are extracted each; with no page to learn from every page
is empty anyway; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gleaner.llm.common import slices
from gleaner.llm.html_blocks import N_INPUTS, Block, Node, blocks, vectors

#: Pages on which the network is trained, about, and the longest of them in characters.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 100_000
#: State of each direction.
HIDDEN = 16
#: Sequences labelled together, at most, and the cells (blocks of the longest times sequences) these may fill.
BATCH, CELLS = 128, 1 << 14

#: Names of containers that never hold main text, and of those that do.
ASIDE = frozenset(
    "nav header footer aside form button select option menu head dialog .ad .ads .advert .advertisement .sponsor .sponsored "
    ".banner .cookie .consent .notice .comment .comments .reply .sidebar .menu .nav .navigation .footer .header .promo .share "
    ".social .related .recommended .subscribe .newsletter .signup .login .popup .modal .breadcrumb .breadcrumbs .widget .search".split())
_ENDS = re.compile("</(?:p|h1|h2)>")
MAIN = frozenset("article main .article .content .post .entry .story .main .body".split())


def markup_labels(sequence: list[Block]) -> np.ndarray:
    """1 for blocks that their containers call main text: inside a main container (any, where the page
    has none) and inside none that is set aside. A page header inside the article counts as set aside."""
    def within(names: frozenset) -> np.ndarray:
        known: dict[int, bool] = {}  # by node, as neighbouring blocks share theirs

        def holds(node: Node) -> bool:
            new, at = [], node
            while at is not None and id(at) not in known:
                new.append(at)
                at = at.parent
            found = at is not None and known[id(at)]
            for n in reversed(new):
                found = known[id(n)] = found or any(t in names for t in n.tokens)
            return found

        return np.array([holds(b.node) for b in sequence], dtype=bool)

    inside, apart = within(MAIN), within(ASIDE)
    if not inside.any():
        inside[:] = True
    return (inside & ~apart).astype(np.float32)


def altered(page: str, rng: np.random.Generator, pool: list[str]) -> str:
    """The page with containers of other kinds put in and its article renamed."""
    def phrase(n: int) -> str:
        return " ".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(2, n)))

    links = lambda n: "".join(f'<li><a href="#">{phrase(4)}</a></li>' for _ in range(n))
    paragraphs = lambda n: "".join(f"<p>{phrase(40)}.</p>" for _ in range(n))
    kinds = [
        lambda: f'<header><div class="logo">{phrase(4)}</div><ul>{links(3)}</ul></header>',
        lambda: f'<aside class="sidebar"><h3>{phrase(5)}</h3><ul>{links(4)}</ul>{paragraphs(1)}</aside>',
        lambda: f'<div class="sidebar"><h2>{phrase(5)}</h2>{paragraphs(2)}</div>',
        lambda: f'<div class="{rng.choice(["cookie-notice", "notice", "cookie-banner", "consent popup"])}"><p>{phrase(20)}.</p><button>{phrase(3)}</button></div>',
        lambda: f'<form action="/s"><label>{phrase(4)}</label><input name="q"><button>{phrase(3)}</button></form>',
        lambda: f'<section id="comments" class="comments"><h2>{phrase(4)}</h2>' + "".join(
            f'<div class="comment"><b>{phrase(3)}</b>{paragraphs(1)}</div>' for _ in range(rng.integers(1, 5))) + "</section>",
        lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo banner"])}"><p>{phrase(15)}.</p></div>',
        lambda: f'<div class="{rng.choice(["related", "share social", "newsletter", "breadcrumbs", "menu"])}"><ul>{links(3)}</ul></div>',
        lambda: f'<nav class="menu"><ul>{links(5)}</ul></nav>',
        lambda: f'<footer><p>{phrase(15)}.</p><ul>{links(3)}</ul></footer>']
    # What articles hold besides paragraphs; it goes behind a paragraph or heading of the article.
    parts = [
        lambda: "<ul>" + "".join(f"<li>{phrase(12)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>",
        lambda: "<ol>" + "".join(f"<li>{phrase(25)}.</li>" for _ in range(rng.integers(2, 5))) + "</ol>",
        lambda: "<table>" + "".join(f"<tr><td>{phrase(4)}</td><td>{rng.integers(1000)}</td></tr>" for _ in range(rng.integers(2, 5))) + "</table>",
        lambda: f"<dl><dt>{phrase(4)}</dt><dd>{phrase(20)}.</dd></dl>", lambda: f"<blockquote><p>{phrase(25)}.</p></blockquote>",
        lambda: f"<h2>{phrase(6)}</h2>{paragraphs(1)}", lambda: f"<h3>{phrase(5)}</h3>", lambda: paragraphs(2), lambda: f"<p>{phrase(5)}</p>"]
    for _ in range(rng.integers(0, 4)):
        start, stop = page.find("<article"), page.find("</article>")
        spots = [m.end() for m in _ENDS.finditer(page, max(0, start), stop)] if 0 <= start < stop else []
        if spots:
            spot = int(rng.choice(spots))
            page = page[:spot] + parts[rng.integers(len(parts))]() + page[spot:]
    for _ in range(rng.integers(1, 5)):
        spots = [i for i in (page.find("<article"), page.find("</article>"), page.find("</article>") + 10, page.find("<footer"),
                             page.find("</h1>") + 5, page.find("</p>") + 4) if i > 10]
        if spots:
            spot = int(rng.choice(spots))
            page = page[:spot] + kinds[rng.integers(len(kinds))]() + page[spot:]
    if rng.random() < 0.5:
        tag, name = [("main", ""), ("div", ' class="content"'), ("div", ' class="post-content"'), ("div", ' id="main"'),
                     ("section", ' class="entry-content"'), ("div", ' class="article-body"')][rng.integers(6)]
        page = page.replace("<article", f"<{tag}{name}").replace("</article>", f"</{tag}>")
    return page


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Bidirectional LSTM with a logistic output over both states."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p |= {f"W{d}": make(N_INPUTS, 4 * HIDDEN), f"U{d}": make(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN:2 * HIDDEN] = 1  # remember at first
        self.p |= {"V": make(2 * HIDDEN, 1), "v": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, live: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction; ``x`` (time, batch, inputs), ``live`` (time, batch, 1) is 0 on padding."""
        return self._states((x.reshape(-1, N_INPUTS) @ self.p[f"W{d}"] + self.p[f"c{d}"]).reshape(*x.shape[:2], -1), live, d, keep)

    def _states(self, given: np.ndarray, live: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """The same from the inputs' part of the gates."""
        steps, batch = given.shape[:2]
        h = c = np.zeros((batch, HIDDEN), np.float32)
        out = np.empty((steps, batch, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[f"U{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc))
            c = new * live[t]
            h = o * tc * live[t]
            out[t] = h
        return out

    def forward(self, x: np.ndarray, live: np.ndarray, kept: dict | None = None) -> np.ndarray:
        both = [self._run(x, live, d, None if kept is None else kept.setdefault(d, [])) for d in "fb"]
        states = np.concatenate(both, axis=2)
        if kept is not None:
            kept["states"] = states
        return (states @ self.p["V"])[:, :, 0] + self.p["v"]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict = {}
        mask = live[:, :, 0]
        out = _sigmoid(self.forward(x, live, kept))
        loss = float(-(mask * (y * np.log(out + 1e-7) + (1 - y) * np.log(1 - out + 1e-7))).sum() / mask.sum())
        gap = ((out - y) * mask / mask.sum()).astype(np.float32)
        grads = {"V": np.einsum("tbh,tb->h", kept["states"], gap)[:, None], "v": gap.sum()[None]}
        above = gap[:, :, None] * self.p["V"][:, 0]
        for k, d in enumerate("fb"):
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dU = np.zeros_like(self.p[f"U{d}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tc in reversed(kept[d]):
                dh = (dh + above[t][:, k * HIDDEN:(k + 1) * HIDDEN]) * live[t]
                dnew = dc * live[t] + dh * o * (1 - tc * tc)
                dz = np.hstack([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dh * tc * o * (1 - o), dnew * i * (1 - g * g)])
                dz_all[t] = dz
                dU += h.T @ dz
                dh, dc = dz @ self.p[f"U{d}"].T, dnew * f
            flat = dz_all.reshape(-1, 4 * HIDDEN)
            grads |= {f"W{d}": x.reshape(-1, N_INPUTS).T @ flat, f"U{d}": dU, f"c{d}": flat.sum(axis=0)}
        return loss, grads

    def train(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, batch: int = 24, rate: float = 0.01, seed: int = 9) -> float:
        """Adam over batches of sequences of similar length; returns the last mean loss."""
        rng = np.random.default_rng(seed)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i][1]))
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, [0.0]
        for epoch in range(epochs):
            losses = []
            for g in rng.permutation(len(groups)):
                x, live, y = _padded([sequences[i] for i in groups[g]])
                loss, grads = self.gradients(x, live, y)
                losses.append(loss)
                step += 1
                pace = rate * (0.5 if epoch >= epochs * 2 // 3 else 1.0)
                for k, v in grads.items():
                    v = np.clip(v, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.99 * s[k] + 0.01 * v * v
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses))

    def label(self, sequences: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text for every block of every sequence. Short sequences are padded together within CELLS; a longer
        one is read alone, its vectors a stretch at a time."""
        out: list[np.ndarray] = [np.zeros(0)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if sequences[i]), key=lambda i: len(sequences[i]))
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < min(len(order), lo + BATCH) and len(sequences[order[hi]]) * (hi + 1 - lo) <= CELLS:
                hi += 1
            mine = order[lo:hi]
            if len(sequences[mine[0]]) > CELLS:
                out[mine[0]] = self._long(sequences[mine[0]])
            else:
                x, live, _ = _padded([(vectors(sequences[i]), np.zeros(len(sequences[i]))) for i in mine])
                p = _sigmoid(self.forward(x, live))
                for k, i in enumerate(mine):
                    out[i] = p[:len(sequences[i]), k]
            lo = hi
        return out

    def _long(self, sequence: list[Block]) -> np.ndarray:
        n = len(sequence)
        given = {d: np.empty((n, 1, 4 * HIDDEN), np.float32) for d in "fb"}
        for lo in range(0, n, CELLS):
            x = vectors(sequence[lo:lo + CELLS], lo, n)
            for d in "fb":
                given[d][lo:lo + CELLS, 0] = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        live = np.ones((n, 1, 1), np.float32)
        logit = np.full(n, self.p["v"][0], np.float32)
        for k, d in enumerate("fb"):
            logit += self._states(given.pop(d), live, d, None)[:, 0] @ self.p["V"][k * HIDDEN:(k + 1) * HIDDEN, 0]
        return _sigmoid(logit)


def _padded(group: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(y) for _, y in group)
    x = np.zeros((steps, len(group), N_INPUTS), np.float32)
    live, y = np.zeros((steps, len(group), 1), np.float32), np.zeros((steps, len(group)), np.float32)
    for k, (rows, labels) in enumerate(group):
        x[:len(labels), k], live[:len(labels), k, 0], y[:len(labels), k] = rows, 1, labels
    return x, live, y


def train(pages: list[str], seed: int = 3) -> Labeller:
    """Labeller from pages and altered forms of them."""
    rng = np.random.default_rng(seed)
    model, sequences = Labeller(), []
    parsed = [blocks(p) for p in pages]
    pool = [w for seq in parsed for b in seq[:40] for w in b.text.split()[:20]] or ["text"]
    for page, seq in zip(pages, parsed):
        for s in (seq, blocks(altered(page, rng, pool)), blocks(altered(page, rng, pool))):
            if s:
                sequences.append((vectors(s), markup_labels(s)))
    if sequences:
        model.train(sequences)
    return model


def fit(pages: DataFrame, rows: int = SAMPLE_PAGES, longest: int = SAMPLE_CHARS) -> Labeller:
    """Labeller trained on about ``rows`` pages of at most ``longest`` characters, chosen by the hash of
    url and html; the driver holds no more than these."""
    known = pages.filter(F.length("html").between(1, longest))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("url", "html"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    # Copies of one page hash alike, so distinct pages are taken, and no more than twice the number.
    sample = chosen.select("html").distinct().orderBy(F.xxhash64("html")).limit(2 * rows)
    return train([r["html"] for r in sample.collect()])


def extract(pages: DataFrame, model: Labeller, threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``main_text``: the blocks labelled as main text, joined by line feeds."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            texts = list(pages_)
            found: list[str] = []
            for lo, hi in slices([len(p or "") for p in texts]):
                parsed = [blocks(p) for p in texts[lo:hi]]
                labels = sent.value.label(parsed)
                found += ["\n".join(b.text for b, p in zip(s, marks) if p >= threshold) for s, marks in zip(parsed, labels)]
            yield pd.Series(found, dtype="object")

    return pages.withColumn("main_text", run("html"))
