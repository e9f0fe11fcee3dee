"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is an interpolated Kneser-Ney bigram model over words and one end token, learnt from all
training documents.  Neither the counts nor the tries are ever in one place: bigrams are dealt to a
grid of shards by the hashes of their two words, so that even a word with a third of all tokens is
spread over a row and a column of the grid.

1. Each block of documents sends every shard its distinct bigrams there, once, with training counts
   and the documents they occur in.
2. A shard adds up its bigrams, and sends the owner of each word what it has seen of the word.
3. Owners add up the words' totals and reply to the shards that asked.
4. A shard writes its trie (successors by context, quantised smoothed log probabilities and
   back-off weights) to a folder of its own, maps the files, finds its bigrams by successor
   search, and sends each block the sums of its documents; the folder goes at once.

Messages are packed arrays: one row for each block and shard.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.eliasfano import Trie
from nearfield.llm.quality import blocks
from nearfield.llm.shared import mix64, pack_ints, prepare, shards_for, spread, spread_keys, unpack_ints

U = np.uint64
#: Hashes of the two tokens that are no words.
BEGIN, END = U(0x517CC1B727220A95), U(0x2545F4914F6CDD1D)
BLOCK_WORDS = 2_000_000
#: Bytes of input files that one shard is made for.
SHARD_BYTES = 8 << 20
QUANTISED_BITS = 12


def in_training(doc_id: object) -> bool:
    """A document without an id counts as one with the empty id."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


class Packer:
    """Arrays of non-negative integers (uint64) in one binary value."""

    @staticmethod
    def pack(*arrays: np.ndarray) -> bytes:
        parts = [pack_ints(a) for a in arrays]
        return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)

    @staticmethod
    def unpack(data: bytes, most: int | None = None) -> list[np.ndarray]:
        """The arrays, or the first ``most`` of them."""
        n = int.from_bytes(data[:4], "little")
        sizes = np.frombuffer(data[4 : 4 * (n + 1)], "<u4")
        at = 4 * (n + 1) + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return [unpack_ints(data[a:b]) for a, b in list(zip(at, at[1:]))[:most]]


def grid(shards: int) -> tuple[int, int]:
    rows = max(1, int(shards**0.5))
    return rows, max(1, shards // rows)


def block_messages(counts: np.ndarray, ids: np.ndarray, hashes: np.ndarray, train: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, message): per shard the contexts, the words, the bigrams among them (context,
    word, training count, number of occurrences) and the documents of the occurrences."""
    n_docs, v = len(counts), len(hashes)
    all_hashes = np.concatenate([hashes, [BEGIN, END]])
    begin, end = v, v + 1
    ends = np.cumsum(counts)
    word = np.insert(ids, ends, end)
    context = np.insert(ids, ends - counts, begin)
    doc = np.repeat(np.arange(n_docs), counts + 1)
    key = context.astype(np.int64) * (v + 2) + word
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[first, len(key)])
    seen = np.add.reduceat(train[doc].astype(np.int64), first)
    context, word = key[first] // (v + 2), key[first] % (v + 2)
    rows, cols = grid(shards)
    spread = mix64(all_hashes)
    shard = (spread % U(rows)).astype(np.int64)[context] * cols + ((spread >> U(32)) % U(cols)).astype(np.int64)[word]
    by_shard = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[by_shard], np.arange(shards + 1))
    for s in range(shards):
        some = by_shard[cuts[s] : cuts[s + 1]]
        if not len(some):
            continue
        contexts, c = np.unique(context[some], return_inverse=True)
        words, w = np.unique(word[some], return_inverse=True)
        t = times[some]
        at = np.repeat(first[some] - np.r_[0, np.cumsum(t)[:-1]], t) + np.arange(t.sum())
        # pairs are sorted by context: the contexts go as the number of pairs of each
        yield s, Packer.pack(all_hashes[contexts], all_hashes[words], np.bincount(c), w, seen[some], t, doc[at])


class Pairs:
    """A message, opened: its distinct contexts and words, and its pairs as places among these."""

    def __init__(self, data: bytes) -> None:
        self.contexts, self.words, per, w, seen, times, doc = Packer.unpack(data)
        self.c = np.repeat(np.arange(len(per)), per.astype(np.int64))
        self.w, self.seen, self.times, self.doc = (x.astype(np.int64) for x in (w, seen, times, doc))

    def among(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of each pair as places in the sorted ``vocabulary``."""
        return np.searchsorted(vocabulary, self.contexts)[self.c], np.searchsorted(vocabulary, self.words)[self.w]


def shard_counts(messages: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all words of the shard, sorted hashes; context and word of its training bigrams as places
    among these; their counts), bigrams in order.  One message is open at a time."""
    vocabulary = np.unique(np.concatenate([x for m in messages for x in Packer.unpack(m, 2)]))
    keys, counts = [], []
    for m in messages:
        pairs = Pairs(m)
        known = pairs.seen > 0
        c, w = pairs.among(vocabulary)
        keys.append(c[known] * len(vocabulary) + w[known])
        counts.append(pairs.seen[known])
    key, seen = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, seen = key[order], seen[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.add.reduceat(seen, first) if len(first) else np.zeros(0, np.int64)
    return vocabulary, key[first] // len(vocabulary), key[first] % len(vocabulary), count


def owners(vocabulary: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each owner the places of its words."""
    of = (mix64(vocabulary) >> U(7)) % U(shards)
    order = np.argsort(of, kind="stable")
    return np.split(order, np.searchsorted(of[order], np.arange(1, shards)))


STATS = ["tokens", "pairs", "pairs1", "pairs2", "words", "words1", "words2"]


def smoothed(c: np.ndarray, w: np.ndarray, count: np.ndarray, totals: list[np.ndarray], stats: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """log10 of (word probabilities, bigram probabilities, back-off weights) and of an unknown
    word's probability.  ``totals``: per word of the shard, over the whole corpus, its count as a
    context, its distinct followers, its count as a word, its distinct contexts."""
    as_context, followers, _, contexts = (t.astype(np.float64) for t in totals)

    def discount(ones: float, twos: float) -> float:
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones and twos else 0.5

    d1, d2 = discount(stats["words1"], stats["words2"]), discount(stats["pairs1"], stats["pairs2"])
    pairs, words = max(stats["pairs"], 1.0), stats["words"]
    unknown = (d1 * words / pairs if words else 1.0) / (words + 1)
    p1 = np.maximum(contexts - d1, 0) / pairs + unknown
    back = np.where(as_context > 0, d2 * followers / np.maximum(as_context, 1), 1.0)
    p2 = np.maximum(count - d2, 0) / np.maximum(as_context[c], 1) + back[c] * p1[w]
    return np.log10(p1), np.log10(p2), np.log10(back), float(np.log10(unknown))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = QUANTISED_BITS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per row.

    Tokens are the words of the text with A-Z lowered, then one end.  Training documents are those
    of :func:`in_training`.  A null text is the empty one: its end token is scored.  Ids are
    integers, may be null or repeated, and every row is scored for itself.  Words are told apart by
    64-bit hashes.  Extra columns are not read.  Without training documents all words are unknown.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    wide = shards_for(docs, SHARD_BYTES)
    rows, cols = grid(wide)
    shards = rows * cols
    keys = spread_keys(shards, wide)  # one shard to a partition
    places = {k: i for i, k in enumerate(keys)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for block in blocks(pc.ascii_lower(batch.column(1)), BLOCK_WORDS):
                name = (part << 32) | n
                n += 1
                ids = doc_ids[block.rows.start : block.rows.stop]
                train = np.array([in_training(i) for i in ids], bool)
                meta = pd.Series(ids, dtype="Int64")
                head = Packer.pack(meta.fillna(0).to_numpy(np.int64).view(np.uint64), meta.isna().to_numpy(), train, block.counts + 1)
                out = [(name % shards, name, True, head)]
                out += [(s, name, False, m) for s, m in block_messages(block.counts, block.ids, block.words.hashes(), train, shards)]
                s, b, h, m = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in s], pa.int32()), pa.array(b, pa.int64()), pa.array(h, pa.bool_()), pa.array(m, pa.binary())], names=["shard", "block", "head", "message"])

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[~pdf["head"]]
        shard = int(pdf["shard"].iloc[0]) if len(pdf) else -1
        if shard < 0:
            return pd.DataFrame({"owner": [], "shard": [], "message": []})
        vocabulary, c, w, count = shard_counts(list(pdf["message"]))
        n = len(vocabulary)
        seen = [np.bincount(c, count, n), np.bincount(c, minlength=n), np.bincount(w, count, n), np.bincount(w, minlength=n)]
        stats = [count.sum(), len(count), (count == 1).sum(), (count == 2).sum()]
        out = [(keys[o], shard, Packer.pack(vocabulary[at], *[s[at].astype(np.int64) for s in seen])) for o, at in enumerate(owners(vocabulary, shards)) if len(at)]
        out.append((shard, -1, Packer.pack(np.array(stats, np.int64))))
        return pd.DataFrame(out, columns=["owner", "shard", "message"])

    def reply(pdf: pd.DataFrame) -> pd.DataFrame:
        stats = np.zeros(len(STATS))
        for m in pdf.loc[pdf["shard"] < 0, "message"]:
            stats[:4] += Packer.unpack(m)[0]
        asked = pdf[pdf["shard"] >= 0]
        opened = [Packer.unpack(m) for m in asked["message"]]
        out = []
        if opened:
            words, which = np.unique(np.concatenate([o[0] for o in opened]), return_inverse=True)
            totals = [np.bincount(which, np.concatenate([o[k] for o in opened]), len(words)) for k in range(1, 5)]
            known = totals[2] > 0
            stats[4:] = known.sum(), (totals[3] == 1).sum(), (totals[3] == 2).sum()
            cut = np.split(which, np.cumsum([len(o[0]) for o in opened])[:-1])
            owner = int(pdf["owner"].iloc[0])
            out = [(int(s), owner, Packer.pack(*[t[at].astype(np.int64) for t in totals]), None) for s, at in zip(asked["shard"], cut)]
        out.append((-1, -1, None, stats.tolist()))
        return pd.DataFrame(out, columns=["shard", "owner", "message", "stats"])

    def score(messages: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        heads, messages = messages[messages["head"]], messages[~messages["head"]]
        out = [(b, True, m, 0) for b, m in zip(heads["block"], heads["message"])]
        if len(messages):
            vocabulary, c, w, count = shard_counts(list(messages["message"]))
            totals = [np.zeros(len(vocabulary), np.int64) for _ in range(4)]
            by_owner = owners(vocabulary, shards)
            for owner, m in zip(replies["owner"], replies["message"]):
                for total, part in zip(totals, Packer.unpack(m)):
                    total[by_owner[places[owner]]] = part
            stats = {n: float(replies[n].iloc[0]) for n in STATS}
            p1, p2, back, unknown = smoothed(c, w, count, totals, stats)
            known = np.flatnonzero((totals[0] > 0) | (totals[2] > 0))
            place = np.full(len(vocabulary), -1, np.int64)
            place[known] = np.arange(len(known))
            with tempfile.TemporaryDirectory() as folder:
                grams = [np.arange(len(known))[:, None], np.stack([place[c], place[w]], axis=1)]
                Trie.write(folder, grams, [p1[known], p2], [back[known]], bits)
                trie = Trie(folder)
                plain = np.log10(totals[2] + 1.0)
                for block, m in zip(messages["block"], messages["message"]):
                    pairs = Pairs(m)
                    times, doc = pairs.times, pairs.doc
                    u, x = pairs.among(vocabulary)
                    is_known = totals[2][x] > 0
                    value, _ = trie.score(place[u][:, None], np.where(is_known, place[x], -1))
                    value = value + np.where(is_known, 0.0, unknown)
                    base = plain[x]
                    n = int(doc.max()) + 1
                    sums = [np.bincount(doc, np.repeat(v, times), n) for v in (value, base, is_known.astype(float))]
                    here = np.unique(doc)
                    data = Packer.pack(here, sums[2][here].astype(np.int64), sums[0][here].view(np.uint64), sums[1][here].view(np.uint64))
                    out.append((block, False, data, stats["tokens"] + stats["words"] + 1))
                del trie
        frame = pd.DataFrame(out, columns=["block", "head", "message", "mass"])
        frame["tokens"] = float(replies["tokens"].iloc[0]) if len(replies) else 0.0
        return frame

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.loc[pdf["head"], "message"]
        ids, missing, train, tokens = Packer.unpack(head.iloc[0])
        n = len(ids)
        value, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        rest = pdf[~pdf["head"]]
        for m in rest["message"]:
            here, k, v, b = Packer.unpack(m)
            here = here.astype(np.int64)
            value[here] += v.view(np.float64)
            base[here] += b.view(np.float64)
            known[here] += k.astype(np.int64)
        tokens = tokens.astype(np.int64)
        mass = float(rest["mass"].max())
        return pd.DataFrame({
            "id": pd.array(ids.view(np.int64), dtype="Int64").copy() if not missing.any() else pd.Series(ids.view(np.int64), dtype="Int64").mask(missing.astype(bool)),
            "held_out": train == 0, "n_tokens": tokens, "n_known": known, "train_tokens": int(rest["tokens"].max()),
            "base_score": base - tokens * np.log10(mass), "score": value,
        })

    source = spread(docs.select(F.col(id_col).cast("long").alias("id"), text_col))
    messages = source.mapInArrow(send, "shard int, block long, head boolean, message binary").repartition(wide, "shard")
    asked = messages.groupBy("shard").applyInPandas(ask, "owner int, shard int, message binary").repartition(wide, "owner")
    replied = asked.groupBy("owner").applyInPandas(reply, "shard int, owner int, message binary, stats array<double>")
    totals = replied.where("shard < 0").agg(*[F.sum(F.col("stats")[k]).alias(n) for k, n in enumerate(STATS)])
    replies = replied.where("shard >= 0").select("shard", "owner", "message").crossJoin(F.broadcast(totals)).repartition(wide, "shard")
    scored = messages.groupBy("shard").cogroup(replies.groupBy("shard")).applyInPandas(score, "block long, head boolean, message binary, mass double, tokens double")
    result = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.repartition(wide, "block").groupBy("block").applyInPandas(finish, result).withColumnRenamed("id", id_col)
