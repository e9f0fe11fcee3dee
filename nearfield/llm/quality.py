"""Quality rules by distribution divergence.

Two histograms of a document, over character classes and over common words, are compared with
those of reference languages by Jensen-Shannon distance (base 2, so from 0 to 1).  The references
are learnt from the whole corpus: the mean (words) or median (classes) over a language's documents
of their own shares, so that no single long or repetitive document weighs more than another.  Short documents have
unstable histograms; each comparison has a minimum length below which it gives no verdict.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearfield.llm.shared import Words, dropped, prepare, settle, spread, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
#: What makes a word common: this mean share of its language's documents, so 1000 words at most.
#: All other words of a document count together, as one word.
COMMON_SHARE = 0.001
#: Languages with fewer documents have no reference of their own: an absolute count, so that no
#: other language's rows take a reference away.
REFERENCE_DOCS = 10
#: Minimum length: histograms of documents with fewer words don't shape a reference.
REFERENCE_WORDS = 20
#: Bins of a class's share, of which the median is taken.
BINS = 1024

# Byte classes.  Continuation bytes are not characters.
CLASSES = ("space", "line", "lower", "upper", "digit", "comma", "stop", "loud", "symbol", "other", "control", "wide", "continued")
CONTINUED = CLASSES.index("continued")


def class_table() -> np.ndarray:
    t = np.full(256, CLASSES.index("other"), np.uint8)
    t[0:32] = t[127] = CLASSES.index("control")
    t[0x20] = CLASSES.index("space")
    t[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = CLASSES.index("line")
    t[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    t[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    t[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    t[list(b",;:'\"()-")] = CLASSES.index("comma")
    t[ord(".")] = CLASSES.index("stop")
    t[list(b"!?")] = CLASSES.index("loud")
    t[list(SYMBOLS)] = CLASSES.index("symbol")
    t[0xC0:] = CLASSES.index("wide")
    t[0x80:0xC0] = CONTINUED
    return t


TABLE = class_table()


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(TABLE[np.frombuffer(text, np.uint8)], minlength=len(CLASSES))


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                again += 1
            else:
                seen.add(line)
    return again


def repeated_words(ids: np.ndarray, doc: np.ndarray, hashes: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document, the words that lie in a window whose word sequence the document holds twice
    or more.  ``ids`` are the words of a block of documents end to end, ``doc`` their documents."""
    n = len(ids) - window + 1
    covered = np.zeros(len(ids) + 1, np.int32)
    if n > 0:
        inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
        rng = np.random.Generator(np.random.PCG64(5))
        key = doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = hashes[ids]
        for k in range(window):
            mult = rng.integers(1, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            key = (key ^ (h[inside + k] * mult)) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        same = sorted_key[1:] == sorted_key[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = inside[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    return np.bincount(doc[np.cumsum(covered[:-1]) > 0], minlength=n_docs)


@dataclass
class Block:
    """Some documents of an Arrow batch with their words as local ids."""

    rows: range
    source: pa.Array
    counts: np.ndarray  # words of each document
    ids: np.ndarray
    doc: np.ndarray  # document of each word, from 0
    words: Words

    @cached_property
    def texts(self) -> list[bytes]:
        return self.source.cast(pa.large_binary()).to_pylist()


def blocks(texts: pa.Array, most: int = 500_000) -> Iterator[Block]:
    """Whole documents in blocks of about ``most`` words of five bytes, which bounds a worker's
    memory; a longer document is a block of its own.  A null text is the empty one.  Words are what
    the six ASCII white-space characters separate."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, before + 6 * most, "right")))
        part = pc.fill_null(texts.slice(start, stop - start).cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(part)
        counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        doc = np.repeat(np.arange(len(part)), counts)
        if len(words) and (full := pc.greater(pc.binary_length(words), 0)).false_count:
            words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
            counts = np.bincount(doc, minlength=len(part))
        coded = words.dictionary_encode()
        names = coded.dictionary.cast(pa.large_binary()).to_pylist()
        yield Block(range(start, stop), part, counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, Words(names))
        start = stop
        del part, lists, words, coded
    settle()


@dataclass
class References:
    """Class shares and common-word shares of the reference languages: 1000 words at most of each
    language with ``REFERENCE_DOCS`` documents, however many documents there are."""

    languages: list[str]
    classes: np.ndarray  # (languages, classes)
    common: dict[bytes, int]  # word -> column
    words: list[tuple[np.ndarray, np.ndarray]]  # columns and shares of each language's common words


def learn_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common_share: float = COMMON_SHARE, reference_docs: int = REFERENCE_DOCS, reference_words: int = REFERENCE_WORDS) -> References:
    """References from every document of at least ``reference_words`` words whose language is
    given: mean shares of words, and medians of class shares, which junk does not move.

    Each task sums (language, key) pairs: words with their shares, a class with its share's bin
    (such a key starts with a space, as no word does), and a null key that counts documents.
    Only a median per class and the common words of reference languages reach the driver: those
    with ``reference_docs`` such documents.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[bytes | None, float]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, held in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.float64())], names=["lang", "word", "share"])
            sums.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for block in blocks(batch.column(0)):
                ends = np.cumsum(block.counts)
                names = block.words.names
                for k, row in enumerate(block.rows):
                    lang, n = langs[row], int(block.counts[k])
                    if lang is None or n < reference_words:
                        continue
                    ids, times = np.unique(block.ids[ends[k] - n : ends[k]], return_counts=True)
                    held = sums.setdefault(lang, {})
                    for i, t in zip(ids.tolist(), (times / n).tolist()):
                        w = names[i]
                        held[w] = held.get(w, 0.0) + t
                    hist = class_counts(block.texts[k])[:CONTINUED]
                    for c, x in enumerate((hist * BINS // hist.sum()).tolist()):
                        w = b" " + bytes([c]) + x.to_bytes(2, "big")
                        held[w] = held.get(w, 0.0) + 1.0
                    held[None] = held.get(None, 0.0) + 1.0
                if sum(map(len, sums.values())) > 400_000:
                    yield from out()
        yield from out()

    parts = spread(docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))).mapInArrow(run, "lang string, word binary, share double")
    total = parts.groupBy("lang", "word").agg(F.sum("share").alias("share"))
    # a common word of any language reaches common_share of its one document at least
    total = written(total.where(F.col("word").isNull() | (F.col("share") >= common_share)), "quality")
    enough = total.where(F.col("word").isNull() & (F.col("share") >= reference_docs)).select("lang", F.col("share").alias("docs"))
    n_docs = {r["lang"]: r["docs"] for r in enough.collect()}
    languages = sorted(n_docs)
    is_bin = F.substring("word", 1, 1) == F.lit(b" ")
    wanted = total.where(F.col("word").isNotNull()).join(F.broadcast(enough), "lang")
    number = F.conv(F.hex(F.substring("word", 2, 3)), 16, 10).cast("long")  # class and bin
    bins = wanted.where(is_bin).select("lang", F.shiftright(number, 16).alias("class"), number.bitwiseAND(F.lit(0xFFFF)).alias("bin"), "share")
    upto = F.sum("share").over(Window.partitionBy("lang", "class").orderBy("bin"))
    whole = F.sum("share").over(Window.partitionBy("lang", "class"))
    medians = bins.withColumn("upto", upto).withColumn("whole", whole).where(F.col("upto") >= F.col("whole") / 2).groupBy("lang", "class").agg(F.min("bin").alias("bin"))
    place = {lang: k for k, lang in enumerate(languages)}
    classes = np.full((len(languages), CONTINUED), 0.25)  # most documents have hardly any of the class
    for r in medians.collect():
        if r["bin"]:
            classes[place[r["lang"]], r["class"]] = r["bin"] + 0.5
    classes /= classes.sum(axis=1, keepdims=True)
    found = wanted.where(~is_bin & (F.col("share") >= common_share * F.col("docs"))).select("lang", "word", "share").toArrow().combine_chunks().sort_by([("lang", "ascending"), ("word", "ascending")])
    dropped(total)
    sizes = Counter(found.column("lang").to_pylist())
    common: dict[bytes, int] = {}
    words: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    for lang in languages:
        part = found.slice(at, sizes[lang])
        at += sizes[lang]
        columns = [common.setdefault(w, len(common)) for w in part.column("word").to_pylist()]
        words.append((np.array(columns, np.int64), part.column("share").to_numpy() / n_docs[lang]))
    return References(languages, classes, common, words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of distributions along the last axis (broadcast)."""
    m = (p + q) / 2

    def kl(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)

    return np.sqrt(np.maximum(0.0, (kl(p) + kl(q)) / 2))


def word_distances(doc: np.ndarray, column: np.ndarray, p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """:func:`js_distance` of ``n`` documents from ``q``, given their (document, column) shares
    ``p`` that aren't zero.  Words that are not common in the reference (0 in ``q``) count
    together with the other words, the last of ``q``."""
    common = q[column] > 0
    common &= column < len(q) - 1
    there, mine = q[column[common]], p[common]
    rest = np.bincount(doc[~common], p[~common], minlength=n)
    m, m_rest = (mine + there) / 2, (rest + q[-1]) / 2

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / b), 0.0)

    # where a document has none of a common word, q counts in full
    both = np.bincount(doc[common], part(mine, m) + part(there, m) - there, minlength=n) + q[:-1].sum()
    both += part(rest, m_rest) + part(np.full(n, q[-1]), m_rest)
    return np.sqrt(np.maximum(0.0, both / 2))


@dataclass(frozen=True)
class Limits:
    """A document is kept if its nearest reference is within both distances.

    The distances are chosen on the labels of documents with even crc32(doc_id), where they give
    the largest sum of the shares of good documents kept and bad ones rejected (in the middle of
    the ties); the odd ones are held out.
    """

    class_distance: float = 0.185
    word_distance: float = 0.56
    class_min_chars: int = 200
    word_min_words: int = 60


def rule_schema(id_field: T.StructField) -> T.StructType:
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    doubles = ["class_distance", "word_distance"]
    return T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in longs], T.StructField("base_failed", T.BooleanType()), *[T.StructField(c, T.DoubleType()) for c in doubles], T.StructField("kept", T.BooleanType())])


def judge(texts: pa.Array, langs: list[str | None], refs: References, limits: Limits) -> dict[str, np.ndarray]:
    """The columns of :func:`rule_schema` but the id, for a batch of texts."""
    parts: list[dict[str, np.ndarray]] = []
    known = {lang: k for k, lang in enumerate(refs.languages)}
    for block in blocks(texts):
        n = len(block.texts)
        hist = np.stack([class_counts(t) for t in block.texts])
        repeat = repeated_words(block.ids, block.doc, block.words.hashes(), n)
        out = {
            "n_words": block.counts,
            "word_chars": hist[:, 2:CONTINUED].sum(axis=1),
            "n_symbols": hist[:, CLASSES.index("symbol")],
            "n_dup_lines": np.array([duplicate_lines(t) for t in block.texts], np.int64),
            "n_repeat_words": repeat,
        }
        out["base_failed"] = (block.counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * block.counts)
        chars = hist[:, :CONTINUED].astype(float)
        n_chars = chars.sum(axis=1)
        by_class = np.zeros(n)
        by_word = np.zeros(n)
        if refs.languages:
            by_class[:] = by_word[:] = np.inf
            own = np.array([known.get(langs[r], -1) for r in block.rows])
            share = chars / np.maximum(n_chars, 1)[:, None]
            column = np.array([refs.common.get(w, len(refs.common)) for w in block.words.names], np.int64)
            width = len(refs.common) + 1
            key, counts = np.unique(block.doc * width + column[block.ids], return_counts=True)
            doc, column = key // width, key % width
            p = counts / block.counts[doc]
            for k, (columns, shares) in enumerate(refs.words):
                mine = (own == k) | (own < 0)
                if not mine.any():
                    continue
                by_class[mine] = np.minimum(by_class[mine], js_distance(share[mine], refs.classes[k]))
                q = np.zeros(width)
                q[columns] = shares
                q[-1] = max(0.0, 1.0 - q.sum())
                some = mine[doc]
                by_word[mine] = np.minimum(by_word[mine], word_distances(doc[some], column[some], p[some], q, n)[mine])
        out["class_distance"], out["word_distance"] = by_class, by_word
        bad = (n_chars >= limits.class_min_chars) & (by_class > limits.class_distance)
        bad |= (block.counts >= limits.word_min_words) & (by_word > limits.word_distance)
        out["kept"] = ~out["base_failed"] & ~bad
        parts.append(out)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), refs: References | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the counts, both distances and the verdict ``kept``.

    A null text is the empty one: no words, base_failed.  Documents below a minimum length pass
    that comparison.  A document is compared with its own language's reference; one whose language
    is null or too rare to have a reference, with all references, of which the nearest counts.  So
    a verdict depends on the documents of its language and on no language's share of the table.
    Ids may be null or repeated; extra columns are not read.  An empty table gives an empty result
    and no references.  Rows are independent: there is no shuffle but for the references.
    """
    prepare(docs.sparkSession)
    refs = refs or learn_references(docs, text_col, lang_col)
    schema = rule_schema(T.StructField(id_col, docs.schema[id_col].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = judge(batch.column(1), batch.column(2).to_pylist(), refs, limits)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[f.name]) for f in schema.fields[1:]]], names=schema.names)

    ids = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    return spread(ids).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), refs: References | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    prepare(docs.sparkSession)
    refs = refs or learn_references(docs, text_col, lang_col)
    names = docs.columns
    text_at, lang_at = names.index(text_col), names.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                langs = [None if x is None else str(x) for x in batch.column(lang_at).to_pylist()]
                out = judge(batch.column(text_at), langs, refs, limits)
                yield batch.filter(pa.array(out["kept"]))

    return spread(docs).mapInArrow(run, docs.schema)
