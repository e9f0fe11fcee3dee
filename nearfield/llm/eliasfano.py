"""Elias-Fano sequences and an n-gram trie of them, in files that are memory-mapped.

A monotone sequence is split into low bits, packed, and high bits, in unary in a bit vector with a
sampled directory.  Every trie level holds, for all nodes in order, the words of its successors
(made monotone by adding what the lists before it reached), and for each node the position where
its successors begin, which is monotone by itself.  A word below a context of two or more words is
stored by its rank among the successors of the context without its first word: ranks are small
where word numbers are not.

All operations work on arrays of queries at once.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

U = np.uint64
POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
# SELECT[byte, r]: the position of the r-th set bit of a byte
SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _r, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        SELECT[_b, _r] = _p


class BitSelect:
    """select over the set bits (or the clear bits) of a byte array, through counts per 8 bytes."""

    def __init__(self, data: np.ndarray, ones: bool) -> None:
        self.data, self.flip = data, 0 if ones else 255
        counts = POP[data ^ np.uint8(self.flip)] if not ones else POP[data]
        pad = -len(data) % 8
        blocks = np.pad(counts, (0, pad)).reshape(-1, 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(blocks)])

    def __call__(self, r: np.ndarray) -> np.ndarray:
        """Positions of the r-th such bits, r from 0; r must be below their number."""
        block = np.searchsorted(self.before, r, side="right") - 1
        left = r - self.before[block]
        byte = block * 8
        last = len(self.data) - 1
        live = np.arange(len(r))
        # walk the bytes of a block, all queries at once
        for _ in range(8):
            count = POP[self.data[np.minimum(byte[live], last)] ^ np.uint8(self.flip)]
            go = left[live] >= count
            if not go.any():
                break
            moved = live[go]
            left[moved] -= count[go]
            byte[moved] += 1
            live = moved
        return byte * 8 + SELECT[self.data[np.minimum(byte, last)] ^ np.uint8(self.flip), left]


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2**62."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._ones: BitSelect | None = None
        self._zeros: BitSelect | None = None

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if n and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("the sequence has to be monotone")
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel() if low_bits else np.zeros(0, np.uint8)
        low = np.packbits(bits, bitorder="little")
        high_bits = np.zeros((top >> low_bits) + n + 2, np.uint8)
        high_bits[(v >> low_bits) + np.arange(n)] = 1
        # spare bytes let the low bits be read eight bytes at a time
        return cls(n, low_bits, np.concatenate([low, np.zeros(8, np.uint8)]), np.packbits(high_bits, bitorder="little"))

    def nbytes(self) -> int:
        return len(self.low) + len(self.high)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.low_bits
        at = bit >> 3
        word = np.zeros(len(i), np.uint64)
        for k in range((self.low_bits + 7) // 8 + 1):
            word |= self.low[at + k].astype(np.uint64) << U(8 * k) if k < 8 else U(0)
        word >>= (bit & 7).astype(np.uint64)
        return (word & U((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        self._ones = self._ones or BitSelect(self.high, True)
        return (self._ones(i) - i << self.low_bits) | self.lows(i)

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        """The number of values whose high part is below h."""
        self._zeros = self._zeros or BitSelect(self.high, False)
        out = np.zeros(len(h), np.int64)
        some = h > 0
        if some.any():
            out[some] = self._zeros(h[some] - 1) - (h[some] - 1)
        return out

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The position of each value in [begin, end), or -1: the successor of the value there, if
        it equals it.  The high part gives the few candidates, a binary search the one."""
        values = np.asarray(values, np.int64)
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        h = values >> self.low_bits
        clear = len(self.high) * 8 - self.n
        ok = np.flatnonzero((values >= 0) & (h < clear - 1) & (begin < end))
        if not len(ok):
            return out
        low = np.maximum(self._bucket(h[ok]), begin[ok])
        stop = high = np.minimum(self._bucket(h[ok] + 1), end[ok])
        want = values[ok] & ((1 << self.low_bits) - 1)
        high = high.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            mid = (low[live] + high[live]) >> 1
            less = self.lows(mid) < want[live]
            low[live[less]] = mid[less] + 1
            high[live[~less]] = mid[~less]
        hit = np.flatnonzero(low < stop)
        hit = hit[self.lows(low[hit]) == want[hit]]
        out[ok[hit]] = low[hit]
        return out


class Codebook:
    """Quantised log10 values: 2**bits equal steps between the extremes, each step that is used
    standing for the mean of its values."""

    @staticmethod
    def fit(values: np.ndarray, bits: int) -> np.ndarray:
        v = np.asarray(values, np.float64)
        if not len(v):
            return np.zeros(1)
        low, high = v.min(), v.max()
        step = np.minimum((v - low) * ((1 << bits) / max(high - low, 1e-12)), (1 << bits) - 1).astype(np.int64)
        counts = np.bincount(step)
        sums = np.bincount(step, v)
        return sums[counts > 0] / counts[counts > 0]

    @staticmethod
    def codes(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
        edges = (levels[1:] + levels[:-1]) / 2
        return np.searchsorted(edges, values)


class Trie:
    """Levels 1..order of n-grams in a folder of memory-mapped files.

    ``successors[k]`` holds the words of level k + 2, ``begins[k]`` where each node's begin.
    Payloads are codes into codebooks: ``prob`` for each level, ``back`` for all but the last.
    """

    def __init__(self, folder: str) -> None:
        f = Path(folder)
        self.meta = json.loads((f / "meta.json").read_text())

        def mapped(name: str, kind: str) -> np.ndarray:
            path = f / name
            return np.memmap(path, kind, "r") if path.stat().st_size else np.zeros(0, kind)

        def sequence(name: str) -> EliasFano:
            m = self.meta[name]
            return EliasFano(m["n"], m["low_bits"], mapped(f"{name}.low", "u1"), mapped(f"{name}.high", "u1"))

        self.order = self.meta["order"]
        self.words = self.meta["words"]
        self.begins = [sequence(f"begin{k}") for k in range(self.order - 1)]
        self.successors = [sequence(f"words{k}") for k in range(self.order - 1)]
        self.prob = [mapped(f"prob{k}", "u1" if self.meta["bits"] <= 8 else "<u2") for k in range(self.order)]
        self.back = [mapped(f"back{k}", "u1" if self.meta["bits"] <= 8 else "<u2") for k in range(self.order - 1)]
        self.levels = {n: np.array(v) for n, v in self.meta["levels"].items()}

    @staticmethod
    def write(folder: str, grams: list[np.ndarray], probs: list[np.ndarray], backs: list[np.ndarray], bits: int = 8) -> None:
        """``grams[k]``: the (k+1)-grams as rows of word numbers in lexicographic order; level 1 has
        all words 0..V-1.  Every prefix and every suffix of a gram is a gram.  ``probs[k]`` and
        ``backs[k]`` (all but the last level) are log10 values."""
        f = Path(folder)
        f.mkdir(parents=True, exist_ok=True)
        kind = "u1" if bits <= 8 else "<u2"
        meta: dict = {"order": len(grams), "words": len(grams[0]), "bits": bits, "levels": {}}

        def put(name: str, seq: EliasFano) -> None:
            meta[name] = {"n": seq.n, "low_bits": seq.low_bits}
            (f / f"{name}.low").write_bytes(seq.low.tobytes())
            (f / f"{name}.high").write_bytes(seq.high.tobytes())

        begins: list[np.ndarray] = []
        for k in range(len(grams) - 1):
            parent = _rows_of(grams[k], grams[k + 1][:, :-1])
            counts = np.bincount(parent, minlength=len(grams[k]))
            begin = np.concatenate([[0], np.cumsum(counts)])
            if k == 0:
                words = grams[1][:, 1].astype(np.int64)
            else:  # rank among the successors of the context without its first word
                shorter = _rows_of(grams[k], grams[k + 1][:, 1:])
                context = _rows_of(grams[k - 1], grams[k + 1][:, 1:-1])
                words = shorter - begins[k - 1][context]
            put(f"begin{k}", EliasFano.encode(begin))
            put(f"words{k}", EliasFano.encode(_monotone(words, begin)))
            begins.append(begin)
        for name, lists in (("prob", probs), ("back", backs)):
            for k, values in enumerate(lists):
                levels = Codebook.fit(values, bits)
                meta["levels"][f"{name}{k}"] = levels.tolist()
                (f / f"{name}{k}").write_bytes(Codebook.codes(values, levels).astype(kind).tobytes())
        (f / "meta.json").write_text(json.dumps(meta))

    def nbytes(self) -> int:
        return sum(s.nbytes() for s in [*self.begins, *self.successors]) + sum(a.nbytes for a in [*self.prob, *self.back])

    def _child(self, k: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Nodes of level k+2 below ``node`` of level k+1 (-1: none) for a word or rank."""
        out = np.full(len(node), -1, np.int64)
        ok = np.flatnonzero((node >= 0) & (word >= 0))
        if not len(ok):
            return out
        # neighbouring queries mostly share their node: its list is looked up once for all of them
        head = np.r_[True, node[ok[1:]] != node[ok[:-1]]]
        which, parent = np.cumsum(head) - 1, node[ok[head]]
        begin, end = self.begins[k].access(parent), self.begins[k].access(parent + 1)
        seq = self.successors[k]
        base = np.zeros(len(parent), np.int64)
        late = begin > 0
        if late.any():
            base[late] = seq.access(begin[late] - 1)
        out[ok] = seq.find(base[which] + word[ok], begin[which], end[which])
        return out

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """The node of each row of word numbers in its level, -1 where there is none.  Numbers
        outside the vocabulary are no words."""
        grams = np.asarray(grams, np.int64)
        n, width = grams.shape
        valid = ((grams >= 0) & (grams < self.words)).all(axis=1)
        node = np.where(valid, grams[:, 0] if width else -1, -1)
        for k in range(1, width):
            word = grams[:, k]
            if k >= 2:  # its rank among the successors of the context without the first word
                shorter = self.lookup(grams[:, 1 : k + 1])
                context = self.lookup(grams[:, 1:k])
                rank = np.full(n, -1, np.int64)
                ok = np.flatnonzero((shorter >= 0) & (context >= 0))
                if len(ok):
                    rank[ok] = shorter[ok] - self.begins[k - 2].access(context[ok])
                word = rank
            node = self._child(k - 1, node, word)
        return node

    def value(self, name: str, k: int, node: np.ndarray) -> np.ndarray:
        table = self.prob[k] if name == "prob" else self.back[k]
        return self.levels[f"{name}{k}"][table[node]]

    def score(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 back-off weights plus probability, length matched) of words after contexts, rows
        of up to order - 1 word numbers; -1 in a context is unknown.  Unknown words match nothing:
        their length is 0 and the value holds the weights alone."""
        n = len(word)
        out, matched = np.zeros(n), np.zeros(n, np.int64)
        live = np.arange(n)
        width = min(context.shape[1], self.order - 1)
        for m in range(width, -1, -1):
            if not len(live):
                break
            c = context[live, context.shape[1] - m :]
            node = self.lookup(np.concatenate([c, word[live, None]], axis=1))
            hit = node >= 0
            out[live[hit]] += self.value("prob", m, node[hit])
            matched[live[hit]] = m + 1
            live, c = live[~hit], c[~hit]
            if m and len(live):
                ctx = self.lookup(c)
                has = ctx >= 0
                out[live[has]] += self.value("back", m - 1, ctx[has])
        return out, matched


def _rows_of(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The index of each row in a lexicographically sorted table that holds them all."""
    width = table.shape[1]
    if width == 1:
        return rows[:, 0].astype(np.int64)
    # number the prefixes first, then look up (prefix, last word)
    prefixes, which = np.unique(np.concatenate([table[:, :-1], rows[:, :-1]]), axis=0, return_inverse=True)
    del prefixes
    which = which.ravel()
    base = int(max(table[:, -1].max(initial=0), rows[:, -1].max(initial=0))) + 1
    keys = which[: len(table)] * base + table[:, -1]
    return np.searchsorted(keys, which[len(table) :] * base + rows[:, -1])


def _monotone(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Add to each list the last value of the list before it, so that the whole is monotone."""
    starts, ends = begin[:-1], begin[1:]
    full = ends > starts
    last = words[ends[full] - 1] if full.any() else np.zeros(0, np.int64)
    base = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(last) else np.zeros(0, np.int64)
    return words + np.repeat(base, (ends - starts)[full])
