"""Incremental substring deduplication with a log-structured fingerprint index.

A window is 13 consecutive words.  Its fingerprint is the least hash of the five-word shingles
inside it: equal windows have equal fingerprints, and neighbouring windows mostly share theirs, so
an index entry stands for several windows.  The index is a set of immutable runs of fingerprints,
sorted inside each shard, one entry a fingerprint: the first document that holds it and whether
others do.  A new batch is sorted likewise and merge-joined with the runs; the fingerprints that
more than one document holds are matches.  When a level has ``fanout`` runs, they are compacted
into one run of the next level, and the old ones go.  A manifest names the runs of each level, so
that a later session takes the index up again.

The windows behind matches are then verified by hashes of their whole word sequences under two
independent hashes of the words, which also decides who came first.

A block of documents sends each fingerprint, and later each window, once to the shard of its hash;
what other documents of the block hold is already decided there, and goes round the shards in
equal parts.  A passage that a third of all documents share costs its shard one entry a block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.quality import Block, blocks
from nearfield.llm.shared import mix64, pack_ints, pack_sorted, prepare, settle, shards_for, spread, spread_keys, unpack_ints, unpack_sorted
from nearfield.sources.scratch import new_path

WINDOW = 13
INNER = 5
KEY_BITS = 48
#: Three batches at a fanout of two: the first two runs are compacted, the third batch is
#: merge-joined with the compacted run.
FANOUT = 2
BATCHES = 3
U = np.uint64


def multipliers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1)


def sequence_hash(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(multipliers(seed, width)):
        out += h[k : k + n] * m
    return mix64(out)


def windows_inside(doc: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows that lie in one document."""
    n = max(0, len(doc) - width + 1)
    return np.flatnonzero(doc[:n] == doc[width - 1 :]) if n else np.zeros(0, np.int64)


def fingerprints(block: Block, window: int = WINDOW, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows, their fingerprints)."""
    h = block.words.hashes()[block.ids] if len(block.ids) else np.zeros(0, np.uint64)
    starts = windows_inside(block.doc, window)
    shingles = sequence_hash(h, inner, 11)
    n = max(0, len(h) - window + 1)
    least = shingles[:n].copy()
    for k in range(1, window - inner + 1):
        np.minimum(least, shingles[k : k + n], out=least)
    return starts, mix64(least[starts]) >> U(64 - KEY_BITS)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((keys >> U(KEY_BITS - 24)) * U(shards)) >> U(24)).astype(np.int64)


def _raw(values: np.ndarray) -> bytes:
    return pack_ints(np.ascontiguousarray(values, np.int64).view(np.uint64))


def _ids(data: bytes) -> np.ndarray:
    return unpack_ints(data).view(np.int64)


ENTRY = "shard int, history boolean, keys binary, docs binary, many binary, also_keys binary, also_docs binary"
MERGED = "run boolean, shard int, keys binary, docs binary, many binary, doc long, key long"


def _block_entries(block: Block, ids: np.ndarray, window: int, inner: int, names: list[int]) -> pa.RecordBatch | None:
    shards = len(names)
    starts, keys = fingerprints(block, window, inner)
    if not len(keys):
        return None
    docs = ids[block.doc[starts]]
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]
    keys, docs = keys[new], docs[new]
    first = np.r_[True, keys[1:] != keys[:-1]]
    sizes = np.diff(np.r_[np.flatnonzero(first), len(keys)])
    many = sizes > 1
    in_many = np.repeat(many, sizes)
    of = shard_of(keys[first], shards)
    cut = np.searchsorted(of, np.arange(shards + 1))
    first_keys, first_docs, also_keys, also_docs = keys[first], docs[first], keys[in_many], docs[in_many]
    share = _shares(len(also_keys), shards, int(keys[0]))
    rows = []
    for s in range(shards):
        a, b, c, d = cut[s], cut[s + 1], *share[s]
        if b > a or d > c:
            rows.append((names[s], False, pack_sorted(first_keys[a:b]), _raw(first_docs[a:b]), pack_ints(many[a:b]), pack_sorted(also_keys[c:d]), _raw(also_docs[c:d])))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=[x.split()[0] for x in ENTRY.split(", ")]).cast(_arrow(ENTRY))


def _shares(n: int, shards: int, turn: int) -> list[tuple[int, int]]:
    """n items in equal runs, one a shard, the first run at a shard that ``turn`` draws."""
    cuts = [n * k // shards for k in range(shards + 1)]
    return [(cuts[(s + turn) % shards], cuts[(s + turn) % shards + 1]) for s in range(shards)]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def merge_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge a shard's history with its batch: the new run and the matches."""
    keys = [unpack_sorted(x) for x in pdf["keys"]]
    lengths = [len(k) for k in keys]
    docs = np.concatenate([_ids(x) for x in pdf["docs"]])
    many = np.concatenate([unpack_ints(x) for x in pdf["many"]]).astype(bool)
    old = np.repeat(pdf["history"].to_numpy(bool), lengths)
    keys = np.concatenate(keys)
    order = np.lexsort((docs, ~old, keys))  # a run's document first, then by id
    keys, docs, many, old = keys[order], docs[order], many[order], old[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, len(keys)])
    group = np.repeat(np.arange(len(start)), size)
    shared = (np.maximum.reduceat(docs, start) != np.minimum.reduceat(docs, start)) | np.logical_or.reduceat(many, start)
    fresh = np.logical_or.reduceat(~old, start)
    # a run's entry that stood for several documents has reported them before
    told = (shared & fresh)[group] & ~(old & many)
    # what a block found among its own documents came here to be passed on
    also = [(unpack_sorted(k), _ids(d)) for k, d in zip(pdf["also_keys"], pdf["also_docs"]) if k is not None]
    match = pd.DataFrame({
        "doc": np.concatenate([docs[told], *[d for _, d in also]]),
        "key": np.concatenate([keys[told], *[k for k, _ in also]]).view(np.int64),
    })
    keep = np.ones(len(start), bool) if not old.any() or (pdf["history"].all()) else ~np.logical_or.reduceat(old, start)
    held = pd.DataFrame({"run": [True], "shard": [int(pdf["shard"].iloc[0])], "keys": [pack_sorted(keys[start][keep])], "docs": [_raw(docs[start][keep])], "many": [pack_ints(shared[keep])]})
    out = pd.concat([held, match.assign(run=False)])
    settle()
    return out.reindex(columns=["run", "shard", "keys", "docs", "many", "doc", "key"]).astype({"shard": "Int32", "doc": "Int64", "key": "Int64"})


class SubstringIndex:
    """The runs of the index, in a folder that all machines share (``path``, or a scratch folder).

    Ids are integers.  The folder holds a table for each run and manifests, of which the last
    counts: it is written, under another name and renamed, when the runs it names are complete, and
    runs that it no longer names are deleted after it.  So a session that stops anywhere leaves an
    index that :meth:`open` takes up as of its last manifest.  The number of shards is fixed when
    the index is made; take it in proportion to the data.  One session writes at a time.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, inner: int = INNER, shards: int = 64, fanout: int = FANOUT, path: str | None = None) -> None:
        prepare(spark)
        self.spark, self.window, self.inner, self.fanout, self.shards = spark, window, inner, fanout, shards
        self.names = spread_keys(self.shards)  # one shard to a partition
        self.path = (path or new_path(spark, "substring-index")).rstrip("/")
        self.levels: list[list[str]] = [[]]
        self.written = self.compactions = self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SubstringIndex:
        """The index in ``path`` as of its last manifest."""
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        versions = sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))
        if not versions:
            raise FileNotFoundError(f"no manifest in {path}")
        state = json.loads(spark.sparkContext.wholeTextFiles(f"{path.rstrip('/')}/{versions[-1]}").first()[1])
        index = cls(spark, state["window"], state["inner"], state["shards"], state["fanout"], path)
        index.levels, index.written, index.compactions = state["levels"], state["written"], state["compactions"]
        index.version = int(versions[-1][9:-5])
        return index

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commit(self) -> None:
        self.version += 1
        state = {k: getattr(self, k) for k in ("window", "inner", "shards", "fanout", "levels", "written", "compactions")}
        temporary, fs = self._fs(f".manifest-{self.version:09d}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final, _ = self._fs(f"manifest-{self.version:09d}.json")
        if not fs.rename(temporary, final):
            raise OSError(f"could not commit {final}")

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def run(self, name: str) -> DataFrame:
        """The entries of a run, as history."""
        none = F.lit(None).cast("binary")
        return self._table(name).where("run").select("shard", F.lit(True).alias("history"), "keys", "docs", "many", none.alias("also_keys"), none.alias("also_docs"))

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(MERGED).parquet(f"{self.path}/{name}")

    def _merge(self, entries: DataFrame) -> str:
        self.written += 1
        name = f"run-{self.written:09d}"
        merged = entries.repartition(self.shards, "shard").groupBy("shard").applyInPandas(merge_shard, MERGED)
        # entries and matches apart: the matches outlive the run; an earlier attempt's files go
        merged.write.partitionBy("run").mode("overwrite").parquet(f"{self.path}/{name}")
        return name

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Merge-join a batch with the runs, append its run, compact full levels, and return the
        matches ``(doc, key)`` that it brings, those of earlier documents included."""
        window, inner, names = self.window, self.inner, self.names

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for block in blocks(batch.column(1)):
                    out = _block_entries(block, ids[block.rows.start : block.rows.stop], window, inner, names)
                    if out is not None:
                        yield out

        fresh = spread(docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), text_col)).mapInArrow(entries, ENTRY)
        for name in self.runs():
            fresh = fresh.unionByName(self.run(name))
        name = self._merge(fresh)
        self.levels[0].append(name)
        self._commit()
        self.compact()
        return self._table(name).where("not run").select("doc", "key")

    def compact(self) -> None:
        """Merge the runs of every level that has ``fanout`` of them into one of the next."""
        level = 0
        while level < len(self.levels):
            old = self.levels[level]
            if len(old) >= self.fanout:
                both = self.run(old[0])
                for name in old[1:]:
                    both = both.unionByName(self.run(name))
                merged = self._merge(both)
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(merged)
                self.levels[level] = []
                self.compactions += 1
                self._commit()
                self._delete(old)
            level += 1

    def _delete(self, names: list[str]) -> None:
        """Delete the entries of runs; their matches stay."""
        for name in names:
            p, fs = self._fs(f"{name}/run=true")
            fs.delete(p, True)

    def close(self) -> None:
        """Drop the index but for the matches that its batches brought."""
        self._delete(self.runs())
        self.levels = [[]]
        self._commit()


WINDOWS = "shard int, hashes binary, checks binary, docs binary, at binary, also_docs binary, also_at binary"


def _window_entries(block: Block, ids: np.ndarray, wanted: list[np.ndarray], window: int, inner: int, names: list[int]) -> list[tuple]:
    """Hashes of the windows behind matches: of the block's first document with each, and of the
    block's other documents those that are thereby known to repeat it."""
    starts, keys = fingerprints(block, window, inner)
    if not len(starts):
        return []
    shards = len(names)
    sizes = [len(w) for w in wanted]
    salt = mix64(np.arange(len(wanted), dtype=np.uint64) + U(1))
    want = np.concatenate(wanted).astype(np.int64).view(np.uint64) ^ np.repeat(salt, sizes)
    hit = np.isin(keys ^ salt[block.doc[starts]], want)
    starts = starts[hit]
    h = block.words.hashes()[block.ids]
    other = block.words.hashes(1)[block.ids]
    hashes, checks = sequence_hash(h, window, 21)[starts], sequence_hash(other, window, 22)[starts]
    local = block.doc[starts]
    at = starts - np.r_[0, np.cumsum(block.counts)][local]
    docs = ids[local]
    order = np.lexsort((docs, checks, hashes))
    hashes, checks, docs, at = hashes[order], checks[order], docs[order], at[order]
    first = np.r_[True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])]
    group = np.cumsum(first) - 1
    lead = docs == docs[first][group]
    of = ((hashes >> U(40)) * U(shards) >> U(24)).astype(np.int64)
    decided = ~lead
    also_docs, also_at = docs[decided], at[decided]
    hashes, checks, docs, at, of = hashes[lead], checks[lead], docs[lead], at[lead], of[lead]
    cut = np.searchsorted(of, np.arange(shards + 1))
    share = _shares(len(also_docs), shards, int(hashes[0]) if len(hashes) else 0)
    rows = []
    for s in range(shards):
        a, b, c, d = cut[s], cut[s + 1], *share[s]
        if b > a or d > c:
            rows.append((names[s], pack_sorted(hashes[a:b]), pack_ints(checks[a:b]), _raw(docs[a:b]), pack_ints(at[a:b]), _raw(also_docs[c:d]), pack_ints(also_at[c:d])))
    return rows


def verify_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc, at): a row for each window that an earlier document holds too."""
    hashes = np.concatenate([unpack_sorted(x) for x in pdf["hashes"]])
    checks, docs, at = (np.concatenate([f(x) for x in pdf[c]]) for c, f in (("checks", unpack_ints), ("docs", _ids), ("at", unpack_ints)))
    order = np.lexsort((docs, checks, hashes))
    hashes, checks, docs, at = hashes[order], checks[order], docs[order], at[order]
    first = np.r_[True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])]
    later = docs > docs[first][np.cumsum(first) - 1]
    docs = np.concatenate([docs[later], *[_ids(x) for x in pdf["also_docs"]]])
    at = np.concatenate([at[later], *[unpack_ints(x) for x in pdf["also_at"]]])
    settle()
    return pd.DataFrame({"doc": docs, "at": at.astype(np.int32)})


def repeats(docs: DataFrame, matches: DataFrame, window: int = WINDOW, inner: int = INNER, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, starts)``: first words of the windows whose word sequence a document with a smaller
    id also holds.  ``docs`` are all documents that ``matches`` may name; ``docs`` has to be free
    of null ids."""
    shards = shards or shards_for(docs)
    names = spread_keys(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = batch.column(2)
            for block in blocks(batch.column(1)):
                wanted = [keys[r].values.to_numpy(zero_copy_only=False) for r in block.rows]
                rows = _window_entries(block, ids[block.rows.start : block.rows.stop], wanted, window, inner, names)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=[x.split()[0] for x in WINDOWS.split(", ")]).cast(_arrow(WINDOWS))

    per_doc = matches.groupBy(F.col("doc").alias("__nf_doc")).agg(F.collect_set("key").alias("__nf_keys"))
    with_keys = docs.join(per_doc, F.col(id_col) == F.col("__nf_doc")).select(F.col(id_col).cast("long"), text_col, "__nf_keys")
    found = with_keys.mapInArrow(run, WINDOWS).repartition(shards, "shard").groupBy("shard").applyInPandas(verify_shard, "doc long, at int")
    return found.groupBy("doc").agg(F.collect_list("at").alias("starts"))


def covered(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def cut_text(text: str, gone: np.ndarray) -> str:
    """``text`` without the words marked in ``gone``, each with the white space before it."""
    import re

    out, at = [], 0
    for k, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if not gone[k]:
            out.append(text[at : m.end()])
        at = m.end()
    out.append(text[at:])
    return "".join(out).lstrip(" \t\n\r\x0b\x0c") if gone.any() else text


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, inner: int = INNER, batches: int = BATCHES, fanout: int = FANOUT, digests: bool = False) -> DataFrame:
    """``docs`` without the words of repeated windows: all columns, the text cut.  With
    ``digests``, instead ``(doc_id, n_words, n_removed, kept_sha256)``.

    Windows are judged on the input.  A null text has no words and stays null.  Texts shorter than
    a window keep everything.  A row without an id is neither earlier nor later than any other and
    keeps everything.  Rows that repeat an id are one document in several pieces: they don't
    remove each other's words, but a window in one that an earlier document holds goes from all.
    Columns with any other names pass through.  An empty table gives an empty result.

    The index takes the documents in ``batches`` ranges of ids, one after the other, and compacts
    levels of ``fanout`` runs on the way.
    """
    spark = docs.sparkSession
    prepare(spark)
    shards = shards_for(docs)
    index = SubstringIndex(spark, window, inner, shards, fanout)
    named = docs.where(F.col(id_col).isNotNull())
    cuts = named.select(F.col(id_col).cast("double").alias("i")).approxQuantile("i", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    matches = None
    for low, high in zip(edges, edges[1:]):
        part = named
        if low is not None:
            part = part.where(F.col(id_col) > low)
        if high is not None:
            part = part.where(F.col(id_col) <= high)
        new = index.add(part, id_col, text_col)
        matches = new if matches is None else matches.unionAll(new)
    index.close()

    names, text_at = docs.columns, docs.columns.index(text_col)
    id_field, text_only = docs.schema[id_col], [id_col, text_col]
    columns = text_only if digests else names
    found = repeats(named.select(*[F.col(f"`{c}`") for c in columns]), matches, window, inner, shards, id_col, text_col)
    starts = found.select(F.col("doc").alias("__nf_of"), F.col("starts").alias("__nf_starts"))
    whole = named.select(*[F.col(f"`{c}`") for c in columns]).join(starts, F.col(id_col) == F.col("__nf_of"), "left").drop("__nf_of")
    rest = docs.where(F.col(id_col).isNull()).select(*[F.col(f"`{c}`") for c in columns]).withColumn("__nf_starts", F.lit(None).cast("array<int>"))
    both = whole.unionAll(rest)
    if digests:
        schema = T.StructType([id_field, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    else:
        schema = docs.schema

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            marks = batch.column(len(columns))
            texts = batch.column(1 if digests else text_at)
            if digests:
                n_words, n_gone, sha = [], [], []
                for text, mark in zip(texts.cast(pa.binary()), marks):
                    words = (text.as_py() or b"").split()
                    n_words.append(len(words))
                    if mark.is_valid:
                        gone = covered(len(words), mark.values.to_numpy(zero_copy_only=False), window)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    n_gone.append(n_words[-1] - len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(sha, pa.string())], names=schema.names)
            else:
                new = []
                for text, mark in zip(texts, marks):
                    value = text.as_py()
                    if value and mark.is_valid:
                        n = len(value.encode("utf-8").split())
                        value = cut_text(value, covered(n, mark.values.to_numpy(zero_copy_only=False), window))
                    new.append(value)
                arrays = [*batch.columns[: len(columns)]]
                arrays[text_at] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        settle()

    return both.mapInArrow(run, schema)
