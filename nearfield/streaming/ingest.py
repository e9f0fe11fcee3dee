"""Streams of observations: each micro-batch is appended to a store, running moments are merged,
and a uniform sample is kept.

Moments and samples merge, so a stream gives the same state as one batch over all its rows.  The
sample is the ``capacity`` rows with the least hash of (seed, row id): any order of arrival, any
partitioning and any restart give the same rows, each row being equally likely.  (``Reservoir``
keeps the sequential algorithm for arrays on the driver.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.sources.store import ObservationStore

MOMENTS = "key string, n long, mean double, m2 double, low double, high double"


def moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mergeable moments per key: count, mean, sum of squared deviations, range."""
    v = F.col(value).cast("double")
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"))


def merge_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """The moments of both inputs together, of which each has a key once.  Keys without a value
    in either are left out."""
    both = a.unionByName(b)
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    parts = F.collect_list(F.struct("n", "mean", "m2"))  # one of each input
    first = both.where("n > 0").groupBy("key").agg(F.sum("n").alias("n"), mean.alias("mean"), parts.alias("parts"), F.min("low").alias("low"), F.max("high").alias("high"))
    # deviations from the common mean are added: raw squares would cancel where the mean is large
    m2 = F.aggregate("parts", F.lit(0.0), lambda sum_, p: sum_ + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return first.select("key", "n", "mean", m2.alias("m2"), "low", "high")


def deviation(state: DataFrame) -> DataFrame:
    """``scale``: the population deviation, 1 for fewer than two rows or none."""
    sd = F.sqrt(F.col("m2") / F.col("n"))
    return state.withColumn("scale", F.when((F.col("n") >= 2) & (sd > 0), sd).otherwise(F.lit(1.0)))


def sample_key(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))


def bottom_k(rows: DataFrame, id_col: str, capacity: int, seed: int) -> DataFrame:
    """A uniform sample of ``capacity`` rows; samples of parts merge by taking it again."""
    return rows.orderBy(sample_key(F.col(id_col), seed), id_col).limit(capacity)


def ingest(stream: DataFrame, store: ObservationStore, checkpoint: str, to_rows: Callable[[DataFrame], DataFrame], on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append every micro-batch of ``stream`` to ``store``, available data only.

    ``to_rows`` maps a micro-batch to ``(position, x, y[, yvar])``.  A batch that was appended
    before a crash is recognised by its number and not appended again.
    """

    def append(batch: DataFrame, number: int) -> None:
        if number < store.identity.get("stream_batches", 0):
            return
        rows = to_rows(batch)
        store.append(rows, stream_batches=number + 1)  # one commit for the rows and the number
        if on_batch:
            on_batch(rows, number)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
