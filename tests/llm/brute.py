"""Plain single-machine versions of the operators, written from their definitions."""

from __future__ import annotations

import hashlib
import html.parser
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def unite(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def substring(rows, window=13):
    """rows: (doc_id, text) -> [(doc_id, n_words, n_removed, sha)]"""
    first = {}
    for i, t in rows:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def quality_base(text):
    data = (text or "").encode()
    w = words(text)
    spots = defaultdict(list)
    for k in range(len(w) - 4):
        spots[tuple(w[k : k + 5])].append(k)
    covered = set()
    for at in spots.values():
        if len(at) > 1:
            for k in at:
                covered.update(range(k, k + 5))
    seen, again = set(), 0
    for line in data.split(b"\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n = len(w)
    return (
        n,
        sum(len(x.decode()) for x in w),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        again,
        len(covered),
        n < 10 or 100 * len(covered) > 20 * n,
    )


def fingerprint(text):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def simhash(rows, radius=2):
    """rows: (doc_id, text) -> [(doc_id, hex, component)]"""
    fps = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    pairs = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= radius]
    root = unite(distinct, pairs)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    return [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps)]


def embeddings(rows, threshold=0.98):
    """rows: (vec_id, vector, label) -> [(vec_id, n_links, component, kept)]"""
    good = []
    for k, (i, v, label) in enumerate(rows):
        ok = i is not None and v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append((k, np.array(v, float)) if ok else (k, None))
    links, pairs = Counter(), []
    for a, (k, v) in enumerate(good):
        for m, u in good[a + 1 :]:
            if v is None or u is None or rows[k][2] != rows[m][2] or len(v) != len(u):
                continue
            if v @ u / np.sqrt(v @ v) / np.sqrt(u @ u) >= threshold:
                links[k] += 1
                links[m] += 1
                pairs.append((rows[k][0], rows[m][0]))
    root = unite({r[0] for r in rows if r[0] is not None}, pairs)
    return [(r[0], links[k], root.get(r[0]), r[0] is not None and root[r[0]] == r[0]) for k, r in enumerate(rows)]


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes by source -> targets, by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s if s is not None else ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        over = set()
        for s in open_:
            out[s] = rest * weight[s] / sum(weight[x] for x in open_)
            if out[s] > most * sizes[s]:
                over.add(s)
        if not over:
            break
        full |= over
    for s in full:
        out[s] = most * sizes[s]
    return out


class Article(html.parser.HTMLParser):
    """The blocks inside ``<article>``, but for boilerplate elements in it, read by html.parser."""

    INLINE = set("a b i em strong code span u s sub sup small mark".split())
    OUT = set("nav aside header footer form script style noscript svg select textarea button".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.out = 0
        self.blocks, self.held = [], []

    def cut(self):
        if text := " ".join("".join(self.held).split()):
            self.blocks.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        elif tag not in self.INLINE:
            self.cut()
        self.inside += tag == "article"
        self.out += tag in self.OUT

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.cut()
        self.inside -= tag == "article"
        self.out -= tag in self.OUT

    def handle_data(self, data):
        if self.inside > 0 and self.out <= 0:
            self.held.append(data)


def article(page):
    reader = Article()
    reader.feed(page)
    reader.close()
    reader.cut()
    return " ".join(reader.blocks)


def _class(c):
    if c == " ":
        return 0
    if c in "\t\n\r\x0b\x0c":
        return 1
    if c in "#*$%&|<>":
        return 8
    if "a" <= c <= "z":
        return 2
    if "A" <= c <= "Z":
        return 3
    if c in "0123456789":
        return 4
    if c in ",;:'\"()-":
        return 5
    if c == ".":
        return 6
    if c in "!?":
        return 7
    if c < " " or c == "\x7f":
        return 10
    return 9 if c < "\x7f" else 11


def _js(p, q):
    def kl(a, b):
        return sum(x * np.log2(x / ((x + b.get(k, 0)) / 2)) for k, x in a.items() if x)

    return np.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))


def quality_kept(rows, class_limit, word_limit, common=0.001, least_docs=10, least_words=20):
    """rows: (doc_id, text, lang) -> {doc_id: (class distance, word distance, kept)}"""
    shares, bins, n_docs = defaultdict(Counter), defaultdict(list), Counter()

    def classes(text):
        return Counter(map(_class, text or ""))

    for _, text, lang in rows:
        w = words(text)
        if lang is None or len(w) < least_words:
            continue
        n_docs[lang] += 1
        for x, n in Counter(w).items():
            shares[lang][x] += n / len(w)
        h = classes(text)
        bins[lang].append([h[k] * 1024 // len(text) for k in range(12)])
    refs = {}
    for lang, n in n_docs.items():
        if n < least_docs:
            continue
        middle = [sorted(x)[(len(x) + 1) // 2 - 1] for x in zip(*bins[lang])]
        middle = [x + 0.5 if x else 0.25 for x in middle]
        q = {x: s / n for x, s in shares[lang].items() if s >= common * n}
        q[None] = max(0.0, 1 - sum(q.values()))
        refs[lang] = ({k: x / sum(middle) for k, x in enumerate(middle)}, q)
    out = {}
    for i, text, lang in rows:
        w, h = words(text), classes(text)
        own = [refs[lang]] if lang in refs else list(refs.values())
        a, b = 0.0, 0.0
        if own:
            p = {k: x / max(len(text or ""), 1) for k, x in h.items()}
            a = min(_js(p, c) for c, _ in own)

            def word_distance(q):
                held = Counter()
                for x, n in Counter(w).items():
                    held[x if x in q else None] += n / len(w)
                return _js(held, q)

            b = min(word_distance(q) for _, q in own)
        bad = (len(text or "") >= 200 and a > class_limit) or (len(w) >= 60 and b > word_limit)
        out[i] = (a, b, not quality_base(text)[5] and not bad)
    return out
