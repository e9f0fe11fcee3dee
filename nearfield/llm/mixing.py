"""Mixing sources to target weights.

Words are counted per source, targets follow from the weights by filling: a source never gives
more than ``max_repeats`` times its own size, and what it leaves is shared again by weight.  A
document is then emitted floor(rate) times, plus once more with a probability equal to the
fraction, drawn by a hash of the document and a seed.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.shared import written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3.0
SEED = 20240601
#: A table of sources up to this many rows (about 50 bytes each) is broadcast; a longer one is joined.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``sizes(source, size)`` -> ``(source, source_size, target)``, one row per source.

    Sources go by code point, null last, and take the weights in turn.  Filling: target =
    min(cap, weight * level), with one level at which the targets sum to the total.  Sorted by
    cap / weight the capped sources come first, so the level follows from running sums.  The
    windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    which = (F.row_number().over(order) - 1) % len(weights) + 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), which.cast("int"))).withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    total = F.sum("source_size").over(all_rows).cast("double")
    # the level if every source before this one is capped; the first source below its cap fixes it
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    fixed = F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(all_rows)
    per = per.withColumn("at", fixed["level"])
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("at"), "cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeats: float = MAX_REPEATS, seed: int = SEED, pass_through: bool = False) -> DataFrame:
    """``(doc_id, size, source_size, target, copies)``, one row per row of ``docs``; with
    ``pass_through`` all columns of ``docs`` and ``__nf_copies``.

    A null text has size 0, a null source is a source of its own and comes last.  Sources of
    size 0 get target 0 and rate 0.  The draw hashes id, source and text with the seed, so reruns
    agree, repeated rows draw alike and rows without an id draw by their text.  Extra columns are
    not read unless they pass through.  An empty table gives an empty result.  The hot source is
    pre-aggregated; the documents themselves are not shuffled while there are at most
    ``BROADCAST_SOURCES`` sources.
    """
    spark = docs.sparkSession
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    plain = [F.col(id_col).alias("__nf_id"), F.col(source_col).alias("__nf_source"), size_of(F.col(text_col)).alias("__nf_size"), draw.alias("__nf_draw")]
    if pass_through:
        sized = docs.select("*", *plain)
        measured = docs.select(plain[1], plain[2])
    else:
        sized = measured = written(docs.select(*plain), "mix-sizes")
    targets = written(source_targets(measured.select(F.col("__nf_source").alias("source"), F.col("__nf_size").alias("size")), weights, max_repeats), "mix-targets")
    targets = targets.select(F.col("source").alias("__nf_of"), F.col("source_size").alias("__nf_source_size"), F.col("target").alias("__nf_target"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("__nf_source_size") > 0, F.least(F.col("__nf_target") / F.col("__nf_source_size"), F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(F.col("__nf_draw") < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    joined = sized.join(targets, F.col("__nf_source").eqNullSafe(F.col("__nf_of"))).withColumn("__nf_copies", copies)
    if pass_through:
        return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__nf_copies")
    return joined.select(F.col("__nf_id").alias(id_col), F.col("__nf_size").alias("size"), F.col("__nf_source_size").alias("source_size"), F.col("__nf_target").alias("target"), F.col("__nf_copies").alias("copies"))


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``."""
    counted = mix(docs, pass_through=True, **options)
    cols = [F.col(f"`{c}`") for c in docs.columns]
    many = counted.where("__nf_copies > 0").withColumn("__nf_nth", F.explode(F.sequence(F.lit(1), F.col("__nf_copies"))))
    return many.select(*cols)
