"""SimHash near-duplicates, searched with BK-trees over shards of the fingerprint space.

Two 64-bit fingerprints that differ in at most two bits agree on one of three bit blocks, and,
among the bits left, again on one of three.  The nine (block, value, sub-block, value) keys of a
fingerprint therefore name nine shards, one of which holds any partner.  Each shard's distinct
fingerprints go into one BK-tree, children keyed by their integer Hamming distance to the parent,
and a search follows only the edges within the radius.  Trees travel to the shard's own queries by
key: sending all trees to every executor would grow with the data, and would bring all fingerprints
to the driver.  A shard of more than ``SPLIT`` fingerprints is cut into chunks, and each pair of
chunks is a unit of work of its own.

Copies collapse first: trees hold distinct fingerprints, a shard emits one edge per fingerprint to
the least member it reaches (never pairs), and the edges meet in distributed components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nearfield.llm.components import connected_components
from nearfield.llm.shared import partitions, prepare, settle, spread, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Distinct fingerprints of a shard that one tree may hold.
SPLIT = 4096


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()
    if len(words) <= width:
        return [h(b" ".join(words), SEED)] if words else []
    line = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    return [h(line[a : b - 1], SEED) for a, b in zip(starts, starts[width:])]


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes: bit set in over half of them (none: zero)."""
    out = np.zeros(len(hashes), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, h in enumerate(hashes):
        if len(h):
            ones = np.zeros(64, np.int64)
            for i in range(0, len(h), 1 << 16):
                part = h[i : i + (1 << 16)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = weights[ones * 2 > len(h)].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed 64-bit integer."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = fold([np.array(shingle_hashes(t.as_py() or b""), dtype=np.uint64) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])
        settle()

    return spread(docs.select(id_col, text_col)).mapInArrow(run, schema)


BLOCKS = ((0, 21), (21, 42), (42, 64))


def shard_keys(fps: np.ndarray) -> np.ndarray:
    """The nine keys of each fingerprint, as int64 of shape (n, 9)."""
    one = np.uint64(1)
    out = []
    for i, (a, b) in enumerate(BLOCKS):
        width = b - a
        value = (fps >> np.uint64(a)) & ((one << np.uint64(width)) - one)
        low = fps & ((one << np.uint64(a)) - one)
        high = fps >> np.uint64(b) if b < 64 else np.zeros_like(fps)
        rest, bits = low | (high << np.uint64(a)), 64 - width
        cuts = [0, bits // 3, 2 * bits // 3, bits]
        for j in range(3):
            sub = (rest >> np.uint64(cuts[j])) & ((one << np.uint64(cuts[j + 1] - cuts[j])) - one)
            out.append((np.uint64(3 * i + j) << np.uint64(40)) | (value << np.uint64(16)) | sub)
    return np.stack(out, axis=1).view(np.int64)


class BkTree:
    """Distinct integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        values, children = self.values, self.children
        values.append(value)
        children.append({})
        new = len(values) - 1
        at = 0
        while at != new:
            edge = (values[at] ^ value).bit_count()
            if edge == 0:
                values.pop(), children.pop()
                return
            at = children[at].setdefault(edge, new)

    def within(self, value: int, radius: int) -> list[int]:
        """The values at distance ``radius`` or less."""
        found = []
        todo = [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(values[at])
            kids = children[at]
            if kids:
                for edge in range(max(0, d - radius), d + radius + 1):
                    if (kid := kids.get(edge)) is not None:
                        todo.append(kid)
        return found


def shard_links(values: list[int], radius: int, others: list[int] | None = None) -> list[tuple[int, int]]:
    """(value, least value of its component among those given), where these differ.  Compares all
    ``values``, or if ``others`` are given the values with the others."""
    values = sorted(set(values))
    parent = {v: v for v in [*values, *(others or [])]}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    def join(v: int, found: list[int]) -> None:
        for w in found:
            a, b = root(v), root(w)
            if a != b:
                parent[max(a, b)] = min(a, b)

    tree = BkTree()
    for v in values:
        if others is None:
            join(v, tree.within(v, radius))
        tree.add(v)
    for v in others or []:
        join(v, tree.within(v, radius))
    return [(v, r) for v in parent if (r := root(v)) != v]


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bool]]]:
    """(values, whether each is of the unit's first chunk) of each run of equal (key, unit) in a
    stream that is sorted by them."""
    held_key, held, held_own = None, [], []
    for batch in batches:
        keys, units, own, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (units[1:] != units[:-1])])
        ends = np.r_[starts[1:], len(keys)]
        if held_key is not None and (keys[0], units[0]) != held_key:
            yield held, held_own
            held, held_own = [], []
        many = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
        for k in many:
            run, mine = fps[starts[k] : ends[k]].tolist(), own[starts[k] : ends[k]].tolist()
            if starts[k] == 0:
                run, mine = held + run, held_own + mine
            if ends[k] == len(keys):
                held_key, held, held_own = (keys[-1], units[-1]), run, mine
            else:
                yield run, mine
    if held:
        yield held, held_own


def links(distinct_fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` that connect all pairs within
    ``radius`` (2 or less) bits: at most one edge per fingerprint and unit of work, which is a
    shard, or a pair of chunks of a shard of more than ``split`` fingerprints."""
    if not 0 <= radius <= 2:
        raise ValueError("three blocks of three find partners at up to two bits")
    prepare(distinct_fps.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            keys = shard_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, 9))], names=["key", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()

        def out() -> pa.RecordBatch:
            a, b = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for values, own in _bins(batches):
            if len(values) > 1:
                first = [v for v, o in zip(values, own) if o]
                edges.update(shard_links(first, radius, [v for v, o in zip(values, own) if not o] or None))
                if len(edges) > 100_000:
                    yield out()
                    edges.clear()
        yield out()
        settle()

    spark = distinct_fps.sparkSession
    keys = distinct_fps.select("fp").mapInArrow(keyed, "key long, fp long")
    large = F.ceil(F.count("*") / split).cast("int").alias("chunks")
    hot = written(keys.groupBy(F.col("key").alias("h_key")).agg(large).where("chunks > 1"), "simhash-hot")
    if hot.isEmpty():
        units = keys.select("key", F.lit(0).cast("long").alias("unit"), F.lit(True).alias("own"), "fp")
    else:  # a shard's chunks meet in pairs (low, high); within low = high all values are compared
        cut = keys.join(hot, F.col("key") == F.col("h_key"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        cut = cut.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("long"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)))
        low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
        units = cut.select("key", (F.shiftleft(low, 31) + high).alias("unit"), (F.col("chunk") == low).alias("own"), "fp")
    return units.repartition(partitions(spark), "key", "unit").sortWithinPartitions("key", "unit").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)``, one row per row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other.  ``component_id`` is the
    smallest id that is not null in the component; null ids take part, and a component of null
    ids only has a null ``component_id``.  Repeated rows stay repeated and share a component.  Extra
    columns are not read, so their names cannot clash.  An empty table gives an empty result.
    Hot groups: a group of copies is one fingerprint from the first aggregation on; a shard with
    many different fingerprints is cut (see :func:`links`).
    """
    fps = written(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "simhash")
    groups = fps.groupBy("fp").agg(F.min("id").alias("least"))
    parts = connected_components(links(groups, radius))
    rooted = groups.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "whole_root")
    per_fp = rooted.join(whole, F.col("root") == F.col("whole_root")).select(F.col("fp").alias("of_fp"), "component_id")
    return fps.join(per_fp, F.col("fp") == F.col("of_fp")).select(
        F.col("id").alias(id_col),
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, unchanged, that represent their near-duplicate group: the row with
    the smallest id.  Repeated rows of that id keep one of them.  Rows without an id stay: there
    is nothing to name them by.  All columns of ``docs`` pass through whatever their names."""
    keepers = near_duplicates(docs, id_col, text_col, radius).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__nf_keep")).distinct()
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rank = F.row_number().over(Window.partitionBy("__nf_keep").orderBy("__nf_keep"))
    named = docs.where(F.col(id_col).isNotNull()).join(keepers, F.col(id_col) == F.col("__nf_keep"))
    kept = named.withColumn("__nf_rank", rank).where("__nf_rank = 1").select(*cols)
    return kept.unionAll(docs.where(F.col(id_col).isNull()).select(*cols))
