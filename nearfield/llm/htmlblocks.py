"""HTML main-text extraction with a recurrent block labeller.

A page becomes its sequence of leaf blocks in page order: runs of text between block-level tags.
A leaf's vector holds its hashed tag path (names, and the words of class, id and role), its
hashed words and a few counts, all of them over the whole path and the whole text, however deep
or long.  A bidirectional LSTM in numpy reads the whole sequence, so every
block is labelled with the context of the whole document, and the blocks labelled as main text
are joined.

The labeller is trained here, on pages made by :func:`training_pages` from a seed: page layouts
with known parts, in words that are made up.  ``PAGES`` and ``EPOCHS`` bound the training.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfield.llm.shared import prepare, spread

PATH, WORD, COUNTS = 96, 48, 8
WIDTH = PATH + WORD + COUNTS
HIDDEN = 24
PAGES, EPOCHS, SEED = 1600, 14, 3

INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page.
OPAQUE = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title")
#: Of these, the ones that hold the rest of the page if nothing ends them, as in browsers.
RAW = frozenset(("script", "style", "textarea", "title", "iframe"))
SHUT = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in OPAQUE}
NAME = re.compile(r"[^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.IGNORECASE)
#: A block of these starts afresh what an unclosed one of the same kind held open.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SPACE = re.compile(r"\s+")


@dataclass
class Leaf:
    path: int  # a bit for the bin of each token (tag name, name:word) from the root
    depth: int  # number of these tokens
    text: str
    linked: int  # code points inside links


def tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends a tag whose name ends at ``at``, or -1 if there is none.

    A quote after ``=`` hides what is up to the same quote.  It counts as left open where there is
    no such quote, or where a ``>`` comes before one that no space, ``/`` or ``>`` follows (it then
    begins another value); the tag ends at the first ``>`` then.  Every quote is looked from once,
    so all tags of a page together cost one pass.
    """
    while m := STOP.search(page, at):
        at = m.end()
        quote = m[0]
        if quote == ">":
            return at - 1
        before = at - 2
        while page[before] in " \t\n\r\f":
            before -= 1
        if page[before] != "=":
            continue
        shut = page.find(quote, at)
        if shut < 0:
            return page.find(">", at)
        first = page.find(">", at, shut)
        if first >= 0 and page[shut + 1 : shut + 2] not in ("", " ", "\t", "\n", "\r", "\f", "/", ">"):
            return first
        at = shut + 1
    return -1


@lru_cache(1 << 16)
def path_bits(name: str, attrs: str) -> tuple[int, int]:
    """(bins, number) of an element's tokens."""
    tokens = [name]
    for a in ATTRIBUTE.finditer(attrs):
        value = a[2] or a[3] or a[4] or ""
        key = a[1].lower()
        tokens += [f"{key}:{w}" for w in re.split(r"[^a-z]+", value.lower()) if w] or ([key] if "hidden" in key else [])
    bits = 0
    for t in tokens:
        bits |= 1 << crc32(t.encode()) % PATH
    return bits, len(tokens)


def leaves(page: str) -> list[Leaf]:
    """The text blocks of a page in order: references decoded, white space turned into single
    spaces, blank blocks left out.  One pass, in time linear in the page whatever is broken in it.

    Unclosed tags, stray ends and raw text elements are allowed.  What a head may hold is opaque or
    void, so text after ``<head>`` is the body's, as in browsers, whether or not the optional
    ``</head>`` and ``<body>`` are there.  A tag or comment that nothing ends holds the rest of the
    page, as in browsers; for a quote left open see :func:`tag_end`.  An opaque element that nothing
    ends is left out if it is one of ``RAW``, else only its tag is.
    """
    out: list[Leaf] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # name, bins and number of the path's tokens
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    buffer: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if text:
            out.append(Leaf(stack[-1][1], stack[-1][2], text, linked))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            buffer.append(text)
            if anchors:
                linked += len(text)

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at, n = 0, len(page)
    while (lt := page.find("<", at)) >= 0:
        close = page.startswith("/", lt + 1)
        begin = lt + 2 if close else lt + 1
        letter = page[begin : begin + 1]
        if not (letter.isascii() and letter.isalpha()):
            if letter not in ("!", "?") or close:
                add(page[at:begin])
                at = begin
                continue
            add(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt + 9)
                end = n if end < 0 else end
                add(page[lt + 9 : end])
                at = min(n, end + 3)
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        add(page[at:lt])
        name_end = NAME.match(page, begin).end()
        end = tag_end(page, name_end)
        if end < 0:
            at = n
            break
        name, attrs = page[begin:name_end].lower(), page[name_end:end]
        at = end + 1
        if name in INLINE:
            anchors = max(0, anchors + (-1 if close else 1)) if name == "a" else anchors
        elif name == "br":
            buffer.append(" ")
        elif name == "head":
            pass
        elif name in SHUT:
            if close or name in ("svg", "math") and attrs.endswith("/"):
                continue
            found = None if name in endless else SHUT[name].search(page, at)
            if found:
                end = page.find(">", found.end())
                at = n if end < 0 else end + 1
            elif name in RAW:
                at = n
            else:
                endless.add(name)
        elif close:
            if buffer:
                flush()
            if opened[name] and name != "body" and name != "html":
                while stack[-1][0] != name:
                    pop()
                pop()
                anchors = 0
        else:
            if buffer:
                flush()
            if name in VOID or attrs.rstrip().endswith("/"):
                continue
            if shut := CLOSES.get(name):
                while stack[-1][0] in shut:
                    pop()
            bits, tokens = path_bits(name, attrs)
            stack.append((name, stack[-1][1] | bits, stack[-1][2] + tokens))
            opened[name] += 1
    add(page[at:])
    flush()
    return out


def digits(text: str) -> int:
    return sum(map(text.count, "0123456789")) if text.isascii() else sum(map(str.isdigit, text))


def features(blocks: list[Leaf]) -> np.ndarray:
    n = len(blocks)
    x = np.zeros((n, WIDTH), np.float32)
    paths = b"".join([b.path.to_bytes(PATH // 8, "little") for b in blocks])
    x[:, :PATH] = np.unpackbits(np.frombuffer(paths, np.uint8).reshape(n, PATH // 8), axis=1, bitorder="little")
    for k, b in enumerate(blocks):
        row = x[k]
        words = b.text.lower().split()
        bins = np.bincount([crc32(w.encode()) % WORD for w in words], minlength=WORD)
        row[PATH : PATH + WORD] = np.log1p(bins) * 0.3
        size = len(b.text)
        row[PATH + WORD :] = (
            np.log1p(size) / 8,
            np.log1p(len(words)) / 6,
            b.linked / max(size, 1),
            sum(map(b.text.count, ".!?")) / max(len(words), 1),
            digits(b.text) / max(size, 1),
            float(size > 0 and b.text[-1] in ".!?:;\"'”»"),
            k / max(n - 1, 1),
            np.log1p(b.depth) / 4,
        )
    return x


class BiLstm:
    """A bidirectional LSTM with a logistic output for every step, in numpy."""

    def __init__(self, width: int = WIDTH, hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.hidden = hidden
        scale = 1 / np.sqrt(width + hidden)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.standard_normal((width, 4 * hidden)) * scale).astype(np.float32)
            self.w[f"h{d}"] = (rng.standard_normal((hidden, 4 * hidden)) * scale).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1.0
            self.w[f"c{d}"] = bias
        self.w["o"] = (rng.standard_normal((2 * hidden, 1)) * 0.2).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        k = self.hidden
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h = np.zeros((n, k), np.float32)
        c = np.zeros((n, k), np.float32)
        out = np.zeros((n, steps, k), np.float32)
        tape = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"h{d}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * k]))
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            m = mask[:, t : t + 1]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            h2 = o * tc
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            c = c2 * m + c * (1 - m)
            h = h2 * m + h * (1 - m)
            out[:, t] = h
        return out, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._pass(x, mask, d, False)[0] for d in "fb"], axis=2)
        return (both @ self.w["o"])[:, :, 0] + self.w["ob"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        k = self.hidden
        (hf, tape_f), (hb, tape_b) = self._pass(x, mask, "f", True), self._pass(x, mask, "b", True)
        both = np.concatenate([hf, hb], axis=2)
        z = (both @ self.w["o"])[:, :, 0] + self.w["ob"]
        p = 1 / (1 + np.exp(-z))
        total = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / total
        dz = mask * (p - y) / total
        grad = {"o": np.einsum("ntk,nt->k", both, dz)[:, None], "ob": np.array([dz.sum()])}
        for d, tape, part in (("f", tape_f, slice(0, k)), ("b", tape_b, slice(k, 2 * k))):
            out = dz[:, :, None] * self.w["o"][part, 0]
            w = self.w[f"h{d}"]
            d_pre = np.zeros((*x.shape[:2], 4 * k), np.float32)
            gw = np.zeros_like(w)
            dh = np.zeros((len(x), k), np.float32)
            dc = np.zeros((len(x), k), np.float32)
            for t, h, c, i, f, o, g, tc, m in reversed(tape):
                dh = dh + out[:, t]
                dh2, dc2 = dh * m, dc * m
                dc2 = dc2 + dh2 * o * (1 - tc * tc)
                dg = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
                d_pre[:, t] = dg
                gw += h.T @ dg
                dh = dg @ w.T + dh * (1 - m)
                dc = dc2 * f + dc * (1 - m)
            grad[f"h{d}"] = gw
            grad[f"x{d}"] = np.tensordot(x, d_pre, axes=([0, 1], [0, 1]))
            grad[f"c{d}"] = d_pre.sum(axis=(0, 1))
        return float(loss), grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, batch: int = 32, seed: int = SEED) -> float:
        """Adam; returns the last epoch's mean loss."""
        rng = np.random.Generator(np.random.PCG64(seed))
        order = np.argsort([len(y) for _, y in pages], kind="stable")
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        m = {n: np.zeros_like(w) for n, w in self.w.items()}
        v = {n: np.zeros_like(w) for n, w in self.w.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            losses = []
            for at in rng.permutation(len(groups)):
                x, mask, y = padded([pages[i][0] for i in groups[at]], [pages[i][1] for i in groups[at]])
                value, grad = self.gradients(x, mask, y)
                losses.append(value)
                step += 1
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                now = rate * 0.5 ** (epoch / 6)
                for n, g in grad.items():
                    g = g * min(1.0, 5 / max(size, 1e-9))
                    m[n] = 0.9 * m[n] + 0.1 * g
                    v[n] = 0.99 * v[n] + 0.01 * g * g
                    self.w[n] = (self.w[n] - now * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            loss = float(np.mean(losses))
        return loss

    def label(self, pages: list[np.ndarray], cells: int = 60_000) -> list[np.ndarray]:
        """For each page whether each block is main text.  Pages of like length go together; a
        page of any length is read whole."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [k for k in np.argsort([len(p) for p in pages], kind="stable") if len(pages[k])]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= cells:
                end += 1
            some = order[at:end]
            x, mask, _ = padded([pages[k] for k in some], None)
            z = self.logits(x, mask)
            for row, k in enumerate(some):
                out[k] = z[row, : len(pages[k])] > 0
            at = end
        return out


def padded(xs: list[np.ndarray], ys: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x in xs)
    x = np.zeros((len(xs), steps, WIDTH), np.float32)
    mask = np.zeros((len(xs), steps), np.float32)
    y = np.zeros((len(xs), steps), np.float32)
    for k, a in enumerate(xs):
        x[k, : len(a)] = a
        mask[k, : len(a)] = 1
        if ys is not None:
            y[k, : len(a)] = ys[k]
    return x, mask, y


# ---------------------------------------------------------------- training pages

NAV = "menu nav navigation navbar topnav breadcrumb breadcrumbs toolbar pagination tabs links sitemap".split()
HEAD = "header masthead banner top branding logo site-header page-header".split()
FOOT = "footer bottom copyright legal colophon site-footer page-footer".split()
SIDE = "sidebar side aside related widget rail recommended popular trending more-stories teaser".split()
NOTE = "notice cookie consent cookies alert gdpr banner popup modal overlay message subscribe newsletter signup paywall".split()
ADS = "ad ads advert advertisement sponsor sponsored promo promoted ad-slot adsbox banner-ad".split()
TALK = "comments comment discussion replies reply responses disqus thread comment-list respond".split()
BODY = "article content main post entry story body text article-body entry-content post-content main-content page".split()


def training_pages(n: int, seed: int = SEED) -> Iterator[tuple[str, list[str]]]:
    """Pages with the blocks of their main text, from a seed.

    Each page draws its parts and how they are marked (by element, class, id or role), how its
    paragraphs, lists, quotes and tables look, and which tags it forgets to close.  The words are
    syllables drawn at random, so that nothing is learnt from a vocabulary.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda p: rng.random() < p
    syllables = [a + b + c for a in "bdfgklmnprstvz" for b in "aeiouy" for c in ("", "n", "r", "s", "t")]
    marks = ["", "", "", "***", "###", "%%%", "!!"]

    def word() -> str:
        return "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def words(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def sentence(k: int, tail: str = "") -> str:
        if tail:
            return " ".join(w + tail for w in words(k).split())
        return words(k).capitalize() + pick([".", ".", ".", "!", "?", ""])

    def attrs(names: list[str]) -> str:
        name = pick(names)
        kind = pick(["class", "class", "class", "id", "role", "both"])
        if kind == "both":
            return f' class="{name} {word()}" id="{word()}"'
        return f' {kind}="{pick(["", "", pick(["block-", "js-", "c-", "l-"])])}{name}"'

    def box(tag: str | None, names: list[str], inner: str) -> str:
        if tag and some(0.5):
            return f"<{tag}{attrs(names) if some(0.4) else ''}>{inner}</{tag}>"
        return f"<{pick(['div', 'div', 'section', 'div'])}{attrs(names)}>{inner}</div>".replace("<section", "<div")

    def link(k: int) -> str:
        return f'<a href="/{word()}">{words(k)}</a>'

    def link_list(k: int) -> str:
        if some(0.7):
            return "<ul>" + "".join(f"<li>{link(int(rng.integers(1, 3)))}</li>" for _ in range(k)) + "</ul>"
        return " | ".join(link(1) for _ in range(k)) if some(0.5) else "".join(f"<div>{link(1)}</div>" for _ in range(k))

    def short() -> str:
        return pick([sentence(int(rng.integers(2, 16))), f"<p>{sentence(int(rng.integers(2, 20)))}</p>", f"<p>{link(3)}</p>", f"<h3>{words(2)}</h3><p>{sentence(int(rng.integers(3, 30)))}</p>"])

    for _ in range(n):
        main: list[str] = []
        tail = pick(marks) if some(0.12) else ""
        shout = some(0.04)

        def said(k: int) -> str:
            text = " ".join(sentence(int(rng.integers(3, 18)), tail) for _ in range(max(1, k // 10)))
            text = text.upper() if shout else text
            main.append(text)
            if some(0.15):
                parts = text.split(" ")
                at = int(rng.integers(len(parts)))
                parts[at] = pick(["<b>{}</b>", "<em>{}</em>", '<a href="#">{}</a>', "<code>{}</code>", "<span>{}</span>"]).format(parts[at])
                return " ".join(parts)
            return text

        def paragraph() -> str:
            r = rng.random()
            k = int(pick([3, 8, 15, 30, 60, 120, 200])) if some(0.99) else int(rng.integers(400, 4000))
            if r < 0.74:
                return f"<p>{said(k)}</p>" if some(0.9) else f"<p>{said(k)}"
            if r < 0.80:
                return f"<{(t := pick(['h2', 'h3', 'h4']))}>{said(4)}</{t}>"
            if r < 0.86:
                return f"<{(t := pick(['ul', 'ol']))}>" + "".join(f"<li>{said(int(rng.integers(1, 14)))}</li>" for _ in range(int(rng.integers(2, 6)))) + f"</{t}>"
            if r < 0.90:
                return f"<blockquote>{said(20)}</blockquote>"
            if r < 0.93:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{said(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
            if r < 0.96:
                return f"<pre>{said(12)}</pre>"
            return f"<p><b>{said(k)}<br>" if some(0.6) else f"<div>{said(k)}</div>"

        body = [f"<h1>{said(5)}</h1>"] if some(0.8) else []
        for _ in range(int(pick([1, 2, 4, 8, 12, 25]))):
            body.append(paragraph())
            if some(0.05):
                body.append(pick([box("aside", ADS, short()), box(None, NOTE, short()), box("aside", SIDE, link_list(3)), f"<form{attrs(NOTE)}><label>{words(2)}</label><button>{word()}</button></form>"]))
        if some(0.6):
            article = f"<article{attrs(BODY) if some(0.3) else ''}>" + "".join(body) + "</article>"
        elif some(0.5):
            article = f"<main{attrs(BODY) if some(0.3) else ''}>" + "".join(body) + "</main>"
        else:
            article = f"<div{attrs(BODY)}>" + "".join(body) + "</div>"
        if some(0.3):
            article = f"<div{attrs(BODY + ['wrap', 'container', 'row'])}>{article}</div>"
        if some(0.2):
            for _ in range(int(rng.integers(3, 15))):
                article = f'<div class="{pick(["wrap", "container", "row", "col", "inner"])} {word()}">{article}</div>'
        before, after = [], []
        if some(0.6):
            before.append(box("nav", NAV, link_list(int(rng.integers(2, 9)))))
        if some(0.4):
            before.append(box("header", HEAD, pick([words(2), link_list(4), f"<h1>{words(2)}</h1><p>{sentence(5)}</p>", f"<p>{words(3)}</p>"])))
        if some(0.35):
            (before if some(0.6) else after).append(box("aside", ADS, short()))
        if some(0.25):
            (before if some(0.5) else after).append(box(None, NOTE, short()))
        if some(0.35):
            (before if some(0.3) else after).append(box("aside", SIDE, pick([link_list(5), short(), short() + short()])))
        if some(0.15):
            (before if some(0.5) else after).append(f"<form{attrs(NOTE + NAV)}><label>{words(2)}</label><input><p>{sentence(5)}</p><button>{word()}</button></form>")
        if some(0.3):
            talk = "".join(f"<{pick(['div', 'li', 'article'])} class=\"{pick(['comment', 'reply', 'c', 'item'])}\"><b>{word()}</b><p>{sentence(int(rng.integers(2, 40)))}</p></div>" for _ in range(int(rng.integers(1, 6))))
            if some(0.5):  # replies within replies
                for _ in range(int(rng.integers(2, 20))):
                    talk = f'<div class="{pick(["comment", "reply", "c", "item", "level", "children"])} {word()}"><p>{sentence(int(rng.integers(2, 40 if some(0.95) else 800)))}</p>{talk}</div>'
            after.append(box("section", TALK, f"<h3>{words(1)}</h3>" + talk))
        foot = box("footer", FOOT, pick([f"&copy; {word()}.example &middot; {sentence(5)}", link_list(4), f"<p>{sentence(8)}</p>"])) if some(0.75) else ""
        head = f'<!DOCTYPE html><html lang="{pick(["en", "de", "fr", "es"])}"><head><meta charset="utf-8"><title>{words(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        yield head + "".join(before) + (f"<!-- {word()} -->" if some(0.5) else "") + article + "".join(after) + foot + "</body></html>", main


def labelled(page: str, main: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a training page: a leaf is main text if it is one of its blocks."""
    blocks = leaves(page)
    known = {SPACE.sub(" ", m).strip() for m in main}
    return features(blocks), np.array([b.text in known for b in blocks], np.float32)


_HELD: dict[tuple, BiLstm] = {}


def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> BiLstm:
    """The labeller, trained once per process; the same weights for the same arguments."""
    key = (pages, epochs, seed)
    if key not in _HELD:
        model = BiLstm(seed=seed)
        model.fit([p for p in (labelled(*x) for x in training_pages(pages, seed)) if len(p[1])], epochs, seed=seed)
        _HELD[key] = model
    return _HELD[key]


def extract(model: BiLstm, pages: list[str]) -> list[str]:
    blocks = [leaves(p) for p in pages]
    marks = model.label([features(b) for b in blocks])
    return [" ".join([b.text for b, m in zip(bs, ms) if m]) for bs, ms in zip(blocks, marks)]


def main_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", model: BiLstm | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    A null or empty page, and one without a main block, has the empty text.  Ids may be null or
    repeated; extra columns are not read.  Pages are independent: there is no shuffle, an empty
    table gives an empty result, and the weights (100 kB, whatever the input) travel with the
    function.
    """
    prepare(pages.sparkSession)
    model = model or trained()
    schema = T.StructType([*[pages.schema[c] for c in id_cols], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    k = len(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = extract(model, [x or "" for x in part.column(k).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return spread(pages.select(*id_cols, html_col)).mapInArrow(run, schema)
