"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine
verification and distributed connected components.

Equal vectors collapse first and count by multiplicity.  Every distinct vector gets one sign code
per table.  The codes travel alone, packed: a shard sorts its codes and names the buckets of two or
more vectors, and only these vectors are fetched.  A bucket is compared exactly, in blocks.  A set
of vectors that is a bucket in several tables is compared in the first of them only, and so is a
pair that shares several tables, which both vectors' codes tell; so links are counted without a
list of pairs.  A bucket larger than a block is cut into chunks, and each pair of chunks is a unit
of work of its own: nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import connected_components
from nearfield.llm.shared import mix64, pack_ints, pack_sorted, partitions, prepare, shards_for, spread_keys, unpack_ints, unpack_sorted, written

#: A pair at the threshold is missed with 3.9e-6; 24 tables of 14 bits missed 5.2e-6.
TABLES = 40
BITS = 20
THRESHOLD = 0.98
CHUNK = 512
SEED = 8
#: Bytes of input vectors that one shard of the codes is made for.
SHARD_BYTES = 16 << 20
#: Bits of a spot's key: a hash of the code with label and width, then the table.
HASH_BITS, TABLE_BITS = 48, 8


def recall_of(threshold: float, bits: int = BITS, tables: int = TABLES) -> float:
    """The chance that a pair at exactly ``threshold`` shares a code in some table."""
    same = 1 - math.acos(threshold) / math.pi
    return 1 - (1 - same**bits) ** tables


def sign_codes(vectors: np.ndarray, bits: int = BITS, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """The codes of each row, int32 of shape (n, tables).  Hyperplanes depend on the width only."""
    planes = np.random.Generator(np.random.PCG64([seed, vectors.shape[1]])).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    out = np.zeros((len(vectors), tables, 4), np.uint8)
    out[:, :, : -(-bits // 8)] = np.packbits(signs, axis=2, bitorder="little")
    return out.view("<i4")[:, :, 0].astype(np.int32)


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b, the index of the node with the least id in each component."""
    parent = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(n)
    label = rank.copy()  # the least rank reached
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        by_rank = np.empty(n, np.int64)
        by_rank[rank] = new
        new = by_rank[new]  # jump
        if (new == label).all():
            break
        label = new
    parent[rank] = np.arange(n)
    return parent[label]


def compare(ids: np.ndarray, mult: np.ndarray, x: np.ndarray, codes: np.ndarray, chunk: np.ndarray, table: int, low: int, high: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One bucket, or one pair of chunks of it: (place, links, id of the root of its component) of
    the vectors that link here.  A pair that shares a code in an earlier table was counted there."""
    links = np.zeros(len(ids), np.int64)
    edges_a, edges_b = [], []
    rows, cols = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
    for s in range(0, len(rows), CHUNK):
        r = rows[s : s + CHUNK]
        for t in range(0, len(cols), CHUNK):
            c = cols[t : t + CHUNK]
            near = x[r] @ x[c].T >= threshold
            if low == high:
                near &= r[:, None] < c[None, :]
            i, j = np.nonzero(near)
            i, j = r[i], c[j]
            fresh = ~(codes[i, :table] == codes[j, :table]).any(axis=1) & (codes[i, table] == codes[j, table])
            i, j = i[fresh], j[fresh]
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            edges_a.append(i)
            edges_b.append(j)
    root = np.arange(len(ids))
    if edges_a:
        a, b = np.concatenate(edges_a), np.concatenate(edges_b)
        if len(a):
            root = _roots(len(ids), a, b, ids)
    hit = (links > 0) | (root != np.arange(len(ids)))
    return np.flatnonzero(hit), links[hit], ids[root][hit]


U = np.uint64


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow or underflow in the norm."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a list column for each length of its lists."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.r_[0, np.cumsum(sizes)]
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        yield rows, flat[starts[rows][:, None] + np.arange(width)]


def spot_messages(batches: Iterator[pa.RecordBatch], bits: int, tables: int, names: list[int]) -> Iterator[pa.RecordBatch]:
    """(node, label's hash, vector) -> packed (keys, nodes) of a batch's codes, a row a shard."""
    shards = len(names)
    for batch in batches:
        nodes = batch.column(0).to_numpy(zero_copy_only=False)
        labels = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, whose = [], []
        for rows, x in _by_width(batch.column(2)):
            codes = sign_codes(unit_rows(x), bits, tables).astype(np.uint64)
            base = mix64(labels[rows] * U(0x9E3779B97F4A7C15) + U(x.shape[1]))
            key = mix64(base[:, None] + mix64(codes + (np.arange(tables, dtype=np.uint64) << U(32))))
            keys.append((key >> U(64 - HASH_BITS) << U(TABLE_BITS) | np.arange(tables, dtype=np.uint64)).ravel())
            whose.append(np.repeat(nodes[rows], tables))
        if not keys:
            continue
        keys, whose = np.concatenate(keys), np.concatenate(whose)
        order = np.argsort(keys, kind="stable")
        keys, whose = keys[order], whose[order].view(np.uint64)
        cut = np.searchsorted((keys >> U(HASH_BITS + TABLE_BITS - 24)) * U(shards) >> U(24), np.arange(shards + 1))
        out = [(names[s], pack_sorted(keys[a:b]), pack_ints(whose[a:b])) for s, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        shard, k, w = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(k, pa.binary()), pa.array(w, pa.binary())], names=["shard", "keys", "nodes"])


BUCKET = "tab int, lead long, chunks int, low int, high int, chunk int, nodes array<long>"


def shard_buckets(pdf: pd.DataFrame, chunk: int = CHUNK) -> pd.DataFrame:
    """The buckets of two or more vectors in a shard: (table, least node, number of chunks,
    pair of chunks, chunk, nodes in order), one row for a bucket of up to ``CHUNK``, else one for each chunk and pair."""
    keys = np.concatenate([unpack_sorted(k) for k in pdf["keys"]])
    nodes = np.concatenate([unpack_ints(w) for w in pdf["nodes"]]).view(np.int64)
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    end = np.r_[start[1:], len(keys)]
    rows = []
    for s, e in zip(*(x[end - start > 1].tolist() for x in (start, end))):
        table, members = int(keys[s] & U((1 << TABLE_BITS) - 1)), nodes[s:e]
        chunks = -(-len(members) // chunk)
        parts = [members] if chunks == 1 else [members[k::chunks] for k in range(chunks)]
        for k, part in enumerate(parts):
            rows += [(table, int(members[0]), chunks, min(k, j), max(k, j), k, part) for j in range(chunks)]
    return pd.DataFrame(rows, columns=["tab", "lead", "chunks", "low", "high", "chunk", "nodes"])


KEYS = ["tab", "lead", "low", "high"]
#: Vector components that are widened to double precision at once.
CELLS = 4_000_000


def compare_stream(batches: Iterator[pa.RecordBatch], threshold: float, bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """:func:`compare` for each run of equal keys and lengths in a stream that is sorted by them;
    one bucket, or one pair of chunks, is in memory at a time.  Labels are compared themselves: a
    bucket may mix those whose hashes are equal."""
    held_key, held = None, []

    def done(key: tuple, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, ids, mult, chunk, unit, codes = parts[0][:6] if len(parts) == 1 else (np.concatenate([p[k] for p in parts]) for k in range(6))
        kinds: dict = {}
        for k, label in enumerate([x for p in parts for x in p[6]]):
            kinds.setdefault(label, []).append(k)
        for r in kinds.values():
            if len(r) > 1:
                at, links, root = compare(ids[r], mult[r], unit[r], codes[r], chunk[r], key[0], key[2], key[3], threshold)
                if len(at):
                    r = np.array(r)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(node[r]), pa.array(ids[r]), pa.array(links), pa.array(root)], names=["node", "id", "links", "root"])

    for whole in batches:
        sizes = whole.column("v").value_lengths().to_numpy(zero_copy_only=False)
        step = max(1, CELLS // max(int(sizes.max(initial=1)), 1))
        for at in range(0, whole.num_rows, step):
            batch, widths = whole.slice(at, step), sizes[at : at + step]
            place, of_width = np.zeros(len(widths), np.int64), {}
            for rows, x in _by_width(batch.column("v")):
                unit = unit_rows(x)
                of_width[x.shape[1]] = unit, sign_codes(unit, bits, tables)
                place[rows] = np.arange(len(rows))
            keys = np.stack([*[batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in KEYS], widths])
            node, ids, mult, chunk = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "id", "mult", "chunk"))
            labels = batch.column("label").to_pylist()
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(widths)]):
                key = tuple(keys[:, s].tolist())
                if held_key is not None and key != held_key:
                    yield from done(held_key, held)
                    held = []
                held_key = key
                a, b = place[s], place[e - 1] + 1
                unit, codes = of_width[key[4]]
                held.append((node[s:e], ids[s:e], mult[s:e], chunk[s:e], unit[a:b], codes[a:b], labels[s:e]))
    if held:
        yield from done(held_key, held)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, bits: int = BITS, tables: int = TABLES, chunk: int = CHUNK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors are compared if their labels are equal and not null and their lengths are equal, by
    cosine in double precision.  Null vectors, vectors with null or non-finite components, empty
    and zero vectors and those without an id link with nothing and are their own component (null
    for a null id).  Repeated ids are rows of one node: their vectors link as usual and each counts.
    Extra columns are not read.  An empty table gives an empty result.

    A pair at the threshold is found with probability ``recall_of(threshold)``, and a pair above it
    with a greater one; a pair that is found is verified, so none below the threshold links.
    """
    if not 0 < bits <= 31 or not 0 < tables <= 1 << TABLE_BITS:
        raise ValueError("codes have up to 31 bits, in up to 256 tables")
    spark = vectors.sparkSession
    prepare(spark)
    names = spread_keys(shards_for(vectors, SHARD_BYTES))  # one shard to a partition
    v, big = F.col("v"), F.lit(float("inf"))
    number = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(number & F.exists(v, lambda x: x != 0), F.lit(False))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")).withColumn("usable", usable)
    distinct = base.where("usable").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("mult"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")

    # rows find their node by a hash, of a seed under which no two nodes collide
    for seed in range(64):
        name = F.xxhash64(F.lit(seed), F.col("label"), F.col("v"))
        if nodes.groupBy(name.alias("h")).count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("no seed tells the vectors apart")

    spots = nodes.select("node", F.xxhash64("label"), "v").mapInArrow(lambda batches: spot_messages(batches, bits, tables, names), "shard int, keys binary, nodes binary")
    buckets = written(spots.repartition(len(names), "shard").groupBy("shard").applyInPandas(lambda pdf: shard_buckets(pdf, chunk), BUCKET), "vector-buckets")
    # a set that is a bucket in several tables: the first has all its pairs that no earlier bucket has
    small = buckets.where("chunks = 1").groupBy("nodes").agg(F.min("tab").alias("tab"), F.min("lead").alias("lead"))
    members = small.select("tab", "lead", *[F.lit(0).alias(c) for c in ("low", "high", "chunk")], F.explode("nodes").alias("member"))
    members = members.unionByName(buckets.where("chunks > 1").select(*KEYS, "chunk", F.explode("nodes").alias("member")))
    loaded = members.join(nodes, F.col("member") == F.col("node")).select(*KEYS, "chunk", "node", "id", "mult", "label", "v")
    ordered = loaded.repartition(partitions(spark), *KEYS).sortWithinPartitions(*KEYS, F.size("v"))
    found = written(ordered.mapInArrow(lambda batches: compare_stream(batches, threshold, bits, tables), "node long, id long, links long, root long"), "vector-links")

    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy(F.col("node").alias("l_node")).agg(F.sum("links").alias("links"))
    per = nodes.select(name.alias("h"), "node", F.col("id").alias("of"), "mult")
    per = per.join(linked, F.col("node") == F.col("l_node"), "left").drop("node").join(parts, F.col("of") == F.col("node"), "left")
    per = per.select("h", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("component", "of").alias("component_id"))
    rows = base.select("id", F.when(F.col("usable"), name).alias("r_h"))
    out = rows.join(per, F.col("r_h") == F.col("h"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
