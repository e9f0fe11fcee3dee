"""Hilbert-curve sharding with DataFrame functions only.

Metadata dimensions are quantised to a few bits each, the cells are numbered along a Hilbert
curve, rows are ordered by the curve index (equal texts side by side, then by id) and the order is
cut into runs of equal length.  Neighbouring cells are near in every dimension, so a run covers a
small box, and a reader with a predicate on any of the dimensions skips most files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.shared import partitions, written

#: Cells a dimension: 2 ** 16, so 2048 to an octave of sizes and a cell of its own for nearly every label.
BITS = 16


def hilbert_tables(dims: int) -> tuple[list[int], list[int]]:
    """``(digit, next_state)`` for state * 2**dims + corner.

    A state is the entry corner and the direction of a cell's curve.  Inside a cell the corner is
    mirrored and rotated into standard position, where the Gray code numbers the sub-cells.
    """
    full = (1 << dims) - 1

    def rotate(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & full

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    number_of = {gray(i): i for i in range(1 << dims)}

    def trailing_ones(i: int) -> int:
        n = 0
        while i & 1:
            i >>= 1
            n += 1
        return n

    def entry(i: int) -> int:
        return 0 if i == 0 else gray(2 * ((i - 1) // 2))

    def direction(i: int) -> int:
        if i == 0:
            return 0
        return trailing_ones(i - 1 if i % 2 == 0 else i) % dims

    digit, following = [], []
    for e in range(1 << dims):
        for d in range(dims):
            for corner in range(1 << dims):
                w = number_of[rotate(corner ^ e, d + 1)]
                digit.append(w)
                e2 = e ^ rotate(entry(w), dims - (d + 1) % dims)
                d2 = (d + direction(w) + 1) % dims
                following.append(e2 * dims + d2)
    return digit, following


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The index along the curve of integer coordinates in [0, 2**bits)."""
    dims = len(coordinates)
    digit, following = hilbert_tables(dims)
    corners = []
    for level in range(bits - 1, -1, -1):
        corner = F.lit(0)
        for k, c in enumerate(coordinates):
            corner = corner.bitwiseOR(F.shiftleft(F.shiftright(c.cast("int"), level).bitwiseAND(F.lit(1)), k))
        corners.append(corner)
    digits = F.array(*map(F.lit, digit))
    states = F.array(*map(F.lit, following))

    def step(acc: Column, corner: Column) -> Column:
        at = acc["state"] * (1 << dims) + corner + 1
        return F.struct(F.element_at(states, at).alias("state"), (acc["index"] * (1 << dims) + F.element_at(digits, at)).alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.array(*corners), start, step)["index"]


def log_cell(size: Column, bits: int = BITS) -> Column:
    """A size on a logarithmic scale, order kept.  No text has 2**31 bytes or more, so sizes are
    below 2**32 and none is clipped."""
    return F.floor(F.log2(F.greatest(size.cast("double"), F.lit(1.0))) * ((1 << bits) / 32)).cast("int")


def label_cell(label: Column, bits: int = BITS) -> Column:
    """A label by hash: equality predicates prune.  Null is cell 0."""
    return F.coalesce(F.crc32(label.cast("binary")) % ((1 << bits) - 1) + 1, F.lit(0)).cast("int")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def hilbert_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", labels: tuple[str, ...] = ("source", "lang"), bits: int = BITS, pass_through: bool = False) -> DataFrame:
    """``(doc_id, size, text_crc32, curve, shard, slot)``, one row per row of ``docs``; with
    ``pass_through`` also ``row``, a struct of all columns of ``docs``.

    Law ``rows``: the counts of any two shards differ by one at most.  Slots run from 0 in curve
    order.  A null text has no bytes and crc 0; null labels and ids sort first; fully repeated
    rows tie and get neighbouring slots.  Other columns are not read.  An empty table gives an
    empty result.

    The global order is a range partitioning of rows on (curve, crc, id), whose ids keep any
    hot cell divisible; positions come from each sorted partition's own numbering plus the sizes
    of the partitions before it (one row per partition, broadcast).
    """
    spark = docs.sparkSession
    size, crc = size_of(F.col(text_col)), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
    cells = [log_cell(size, bits), *[label_cell(F.col(c), bits) for c in labels]]
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if pass_through else []
    narrow = docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), hilbert_index(cells, bits).alias("curve"), *whole)
    keys = ["curve", "crc", "id"]
    ordered = narrow.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    table = written(ordered.withColumn("at", F.monotonically_increasing_id()), "hilbert")
    part = F.shiftright("at", 33)
    runs = table.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    w = Window.orderBy("part")
    runs = runs.select(F.col("part").alias("of"), (F.sum("n").over(w) - F.col("n")).alias("first"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    rank = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = table.join(F.broadcast(runs), part == F.col("of")).withColumn("rank", rank)
    shard = F.expr(f"(rank * {shards} + {shards} - 1) div total")  # run s starts at floor(s * total / shards)
    start = F.expr(f"(shard * total) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "curve", "shard", (F.col("rank") - start).cast("long").alias("slot"), *["row"] * pass_through
    )


def manifest(placed: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard of ``hilbert_shards(..., pass_through=True)`` the row count, bytes, and least and
    greatest value of each column: what a reader checks a predicate against before it opens a file.
    Nulls are in the count only.  Repeated ids are rows like any other."""
    stats = [f(F.col(f"row.`{c}`")).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *stats)


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", **options: object) -> None:
    """Write ``docs`` as one folder per shard (column ``__nf_shard``), rows in curve order.  Ids may
    be null or repeated."""
    placed = hilbert_shards(docs, shards, id_col, pass_through=True, **options)
    cols = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    ordered = placed.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select(*cols, F.col("shard").alias("__nf_shard")).write.partitionBy("__nf_shard").parquet(path)
