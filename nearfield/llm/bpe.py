"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a pre-token there is exactly one token that can end the prefix's encoding.
A suffix automaton of the whole vocabulary reads the pre-token and holds, at each position, the
longest text ending there that is inside some entry; its suffix links list the entries that end
there, longest first, and the first one that is compatible with the last token of the prefix
before it is the one.
Back-pointers then give the ids.  Two tokens are compatible when no merge across their border
would have happened before the merges inside them: this is read off the border's two spines of
the merge trees, without running any merges.  The result is the id sequence of rank-ordered
merging, in time linear in the text for words of any length.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfield.llm.shared import prepare, spread

#: Distinct chunks and token pairs that a worker remembers before it forgets them all; only speed
#: depends on it.
REMEMBERED = 400_000
BIG = 1 << 60


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others get the code points from 256 on, in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    table = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


#: The steps that a file has to name; without a decoder the tokens' texts are joined by spaces.
KIND = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"], "decoder": None, "post_processor": None}


class SuffixAutomaton:
    """All substrings of some words.  A state stands for the strings that end at the same places;
    they are suffixes of the longest one, of ``size[state]`` symbols.  ``step`` maps
    ``state << WIDTH | symbol`` to a state, ``link`` a state to that of its longest suffix that
    ends at more places.  Built once a process, in time linear in the words."""

    WIDTH = 11

    def __init__(self, words: dict[str, int]) -> None:
        step: dict[int, int] = {}
        link, size = [-1], [0]
        symbols: list[list[int]] = [[]]
        width = self.WIDTH

        def state(n: int, to: int, copied: list[int]) -> int:
            size.append(n)
            link.append(to)
            symbols.append(copied)
            return len(size) - 1

        def cloned(p: int, q: int, c: int) -> int:
            new = state(size[p] + 1, link[q], list(symbols[q]))
            for x in symbols[q]:
                step[new << width | x] = step[q << width | x]
            while p >= 0 and step.get(p << width | c) == q:
                step[p << width | c] = new
                p = link[p]
            link[q] = new
            return new

        for word in words:
            at = 0
            for c in map(ord, word):
                q = step.get(at << width | c)
                if q is not None:  # an earlier word holds this prefix
                    at = q if size[q] == size[at] + 1 else cloned(at, q, c)
                    continue
                new, p = state(size[at] + 1, 0, []), at
                while p >= 0 and (q := step.get(p << width | c)) is None:
                    step[p << width | c] = new
                    symbols[p].append(c)
                    p = link[p]
                if p >= 0:
                    link[new] = q if size[q] == size[p] + 1 else cloned(p, q, c)
                at = new
        self.step, self.link, self.size = step, link, size
        ends: list[list[tuple[int, int]]] = [[] for _ in size]
        for word, value in words.items():
            at = 0
            for c in map(ord, word):
                at = step[at << width | c]
            ends[at].append((len(word), value))
        #: Per state the words that are suffixes of its longest string, longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(size)
        for k in sorted(range(1, len(size)), key=size.__getitem__):
            own, shorter = ends[k], self.ends[link[k]]
            self.ends[k] = (*sorted(own, reverse=True), *shorter) if own else shorter


class WordBpe:
    """A tokenizer file of the kind "BPE with word ends", encoded by the dynamic programme.

    Only files of this kind are taken: see :data:`KIND`.  A pre-token with a symbol that no
    vocabulary entry holds has no encoding, and :meth:`encode` raises ``ValueError``; byte-level
    vocabularies hold all 256 bytes, so no text has one.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("a plain BPE model is needed")
        for part, want in KIND.items():
            have = spec.get(part)
            kinds = [x["type"] for x in have.get("normalizers") or have.get("pretokenizers") or [have]] if have else None
            if kinds != want:
                raise ValueError(f"the {part} has to be {want}, not {kinds}")
        replace, (split, byte_level) = spec["normalizer"]["normalizers"][1], spec["pre_tokenizer"]["pretokenizers"]
        if replace["pattern"] != {"Regex": r"\s+"} or replace["content"] != " " or split["behavior"] != "Removed" or not split["invert"] or byte_level["add_prefix_space"] or byte_level["use_regex"]:
            raise ValueError("white space has to become one space and the pattern's matches the words")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.special_starts = sorted({t[0] for t in self.special})
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.letters = byte_letters()

        # Symbols: byte letters, and byte letters that close a word, one code point each.
        first_final = 0x400
        final = {c: chr(first_final + i) for i, c in enumerate(self.letters)}
        self.final = final

        def symbols(token: str) -> str:
            if self.end and token.endswith(self.end):
                body = token[: -len(self.end)]
                return body[:-1] + final[body[-1]]
            return token

        self.made: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank)
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            left, right, both = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.pair_rank[left, right] = rank
            self.made.setdefault(both, (left, right, rank))
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self.many = 1 + max(self.text_of)
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, list[int]] = {}
        self._chunks: dict[bytes, tuple[bytes, str, int]] = {}

        names = {symbols(t): i for t, i in self.vocab.items() if t not in self.special}
        self.automaton = SuffixAutomaton({s: i for s, i in names.items() if len(s) == 1 or i in self.made})

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens on a border of ``token``'s merge tree, top first, each with the rank of the
        merge that hides it (the top is never hidden)."""
        held = self._left if side == 0 else self._right
        if (out := held.get(token)) is None:
            out, t, hidden = [], token, BIG
            while True:
                out.append((t, hidden))
                made = self.made.get(t)
                if made is None:
                    break
                t, hidden = made[side], made[2]
            held[token] = out
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Does merging the text of ``a b`` end in exactly these two tokens?

        A merge of spine token x of a with spine token y of b, of rank r, happens if both stand
        at the border at time r.  Equal ranks go leftmost first, so x must be hidden later than
        r, and y not earlier than r.
        """
        key = a * self.many + b
        if (out := self._pairs.get(key)) is None:
            rank = self.pair_rank
            out = True
            right = self.spine(b, 0)
            for x, hidden_x in self.spine(a, 1):
                for y, hidden_y in right:
                    r = rank.get((x, y))
                    if r is not None and r < hidden_x and r <= hidden_y:
                        out = False
                        break
                if not out:
                    break
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            self._pairs[key] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given as byte letters."""
        s = word[:-1] + self.final[word[-1]] if self.end else word
        n = len(s)
        last = [-1] * (n + 1)  # the last token of each prefix's encoding
        size = [0] * (n + 1)
        pairs, many = self._pairs, self.many
        step, link, longest, ends = self.automaton.step, self.automaton.link, self.automaton.size, self.automaton.ends
        width = SuffixAutomaton.WIDTH
        state = held = end = 0  # the longest text that ends here and is inside an entry: its state and length
        for c in map(ord, s):
            end += 1
            while (to := step.get(state << width | c)) is None and state:
                state = link[state]
                held = longest[state]
            if to is None:
                break
            state, held = to, held + 1
            for length, token in ends[state]:
                if length > held:
                    continue
                if start := end - length:
                    before = last[start]
                    if before < 0:
                        continue
                    ok = pairs.get(before * many + token)
                    if ok is None:
                        ok = self.compatible(before, token)
                    if not ok:
                        continue
                last[end], size[end] = token, length
                break
        if last[n] < 0:
            raise ValueError(f"no encoding of {word!r}")
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def word(self, word: str) -> list[int]:
        """:meth:`encode_word`, remembered: chunks that differ in case or punctuation share words."""
        if (out := self._words.get(word)) is None:
            out = self.encode_word(word)
            if len(self._words) >= REMEMBERED:
                self._words.clear()
            if len(word) <= 256:
                self._words[word] = out
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text that a white-space boundary surrounds."""
        ids: list[int] = []
        parts = self.special_pattern.split(chunk) if any([c in chunk for c in self.special_starts]) else [chunk]
        letters = self.letters
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            elif part.isascii() and part.isprintable():
                for m in self.pattern.findall(part.lower()):
                    ids += self.word(m)
            elif part:
                part = self.normalize(part)
                if max(part) < "\u0250":
                    for m in self.pattern.findall(part):
                        ids += self.word("".join([letters[b] for b in m.encode("utf-8")]))
                else:  # what counts as a letter depends on the library's Unicode version
                    for m, _ in self.cut(part):
                        ids += self.word(m)
        return ids

    def chunk(self, data: bytes) -> tuple[bytes, str, int]:
        """(ids as little-endian uint32, decoded text, number of ids) of a chunk, remembered."""
        if (out := self._chunks.get(data)) is None:
            ids = self.encode_chunk(data.decode("utf-8"))
            out = (_u32(ids), self.decode(ids), len(ids))
            if len(self._chunks) >= REMEMBERED:
                self._chunks.clear()
            if len(data) <= 256:
                self._chunks[data] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        return array("I", b"".join([self.chunk(c)[0] for c in (text or "").encode("utf-8").split()])).tolist()

    def decode(self, ids: list[int]) -> str:
        """These files name no decoder, and then the tokens' texts are joined by spaces."""
        return " ".join([self.text_of[i] for i in ids])


def _u32(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


_HELD: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _HELD:
        _HELD[path] = WordBpe(path)
    return _HELD[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, [ids array<int>], ids_sha256, decoded_sha256)``, one row per document.

    ``path`` is the tokenizer file on every machine.  A null text is encoded as the empty one (no
    ids); an id may be null or repeated and is passed through; other columns are not read.  A text
    that has no encoding (see :class:`WordBpe`) fails the job rather than losing words.  Rows
    are independent, so there is no shuffle, and an empty table gives an empty result.  A chunk
    between white space is encoded once per worker while it is remembered; whole texts of any
    length are processed, one at a time.
    """
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = T.StructType([*fields, T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = load(path)
        chunk, none = bpe.chunk, hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n, ids, a, b = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                parts = [chunk(c) for c in (text.as_py() or b"").split()]
                if not parts:
                    n.append(0), ids.append([]), a.append(none), b.append(none)
                    continue
                data = b"".join([p[0] for p in parts])
                n.append(len(data) // 4)
                if with_ids:
                    ids.append(np.frombuffer(data, "<u4").astype(np.int32))
                a.append(hashlib.sha256(data).hexdigest())
                b.append(hashlib.sha256(" ".join([p[1] for p in parts if p[2]]).encode()).hexdigest())
            arrays = [batch.column(0), pa.array(n, pa.int64())] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids + [pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, schema)


def decode_ids(path: str, ids: list[int]) -> str:
    return load(path).decode(ids)
