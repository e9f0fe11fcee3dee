"""Dependence of outputs on inputs: first-order shares by rank bins, in two estimators, and the
metric weights that follow.

Rows are ranked within each dimension.  A window over one dimension would put all rows into as
many tasks as there are dimensions, so ranks come from a range partitioning on (dimension, value,
row) and the sizes of the partitions before each: any number of rows spreads evenly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions import expr
from nearfield.sources.scratch import written

MIN_VAR = 1e-12
DEPENDENCE_Z = 3.0


def dimension_ranks(table: DataFrame) -> DataFrame:
    """``table(row_id, x, y)`` -> ``(dim, v, y, rank, n)``; ranks from 0 by (value, row id)."""
    spark = table.sparkSession
    long = table.select("row_id", F.col("y").cast("double").alias("y"), F.posexplode(expr.doubles(F.col("x"))).alias("dim", "v"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # -0.0 and 0.0 are one value
    ordered = long.withColumn("v", F.col("v") + 0.0).repartitionByRange(n, "dim", "v", "row_id").sortWithinPartitions("dim", "v", "row_id")
    # written once: another run of the range partitioning would draw other bounds
    placed = written(ordered.withColumn("at", F.monotonically_increasing_id()), "ranks").withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part", "dim").agg(F.count("*").alias("m"), F.min("at").alias("first_at"))
    # one row per partition and dimension
    w = Window.partitionBy("dim").orderBy("part")
    sizes = sizes.select(F.col("part").alias("s_part"), F.col("dim").alias("s_dim"), "first_at", (F.sum("m").over(w) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("dim")).alias("n"))
    joined = placed.join(F.broadcast(sizes), (F.col("part") == F.col("s_part")) & (F.col("dim") == F.col("s_dim")))
    return joined.select("dim", "v", "y", (F.col("before") + F.col("at") - F.col("first_at")).alias("rank"), "n")


def _cells(ranked: DataFrame, bins: Column) -> DataFrame:
    """Per dimension and cell: rows, sum of y."""
    cell = F.floor(F.col("rank") * bins / F.col("n")).cast("long")
    return ranked.groupBy("dim", cell.alias("cell")).agg(F.count("*").alias("c"), F.sum("y").alias("t"))


def _totals(table: DataFrame) -> DataFrame:
    y = F.col("y").cast("double")
    return table.agg(F.count("*").alias("rows"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"))


def calculate_sobol_indices(table: DataFrame) -> DataFrame:
    """``(dim, share)``: explained share of y's variance over 10 rank bins (3 below 30 rows).
    All ones with fewer than 9 rows or without variance; 0 for a constant input."""
    bins = F.when(F.col("n") >= 30, 10).otherwise(3)
    ranked = dimension_ranks(table)
    spread = table.select(F.posexplode(expr.doubles(F.col("x"))).alias("dim", "v")).groupBy("dim").agg(F.var_pop("v").alias("xvar")).withColumnRenamed("dim", "x_dim")
    total = F.broadcast(_totals(table))  # one row
    per = _cells(ranked, bins).crossJoin(total)
    d = F.col("t") / F.col("c") - F.col("mean")
    explained = per.groupBy("dim").agg(F.sum(F.col("c") / F.col("rows") * d * d).alias("e"), F.max("rows").alias("rows"), F.max("var").alias("var"))
    out = explained.join(F.broadcast(spread), F.col("dim") == F.col("x_dim"))  # one row per dimension
    share = F.when((F.col("rows") < 9) | ~(F.col("var") > 0), F.lit(1.0)).when(F.col("xvar") <= MIN_VAR, F.lit(0.0)).otherwise(F.col("e") / F.when(F.col("var") > 0, F.col("var")))
    return out.select("dim", share.alias("share"))


def _between(cells: DataFrame, keys: list[str], total: DataFrame, b: Column, least_cells: int = 0) -> DataFrame:
    """The share of the total sum of squares between cells, less what chance gives."""
    per = cells.crossJoin(F.broadcast(total))  # one row
    tc = F.col("t") - F.col("c") * F.col("mean")
    out = per.groupBy(*keys).agg(F.sum(tc * tc / F.col("c")).alias("ssb"), F.max("rows").alias("rows"), (F.max("var") * F.max("rows")).alias("sst"), F.count("*").alias("cells"))
    within = (F.col("sst") - F.col("ssb")) / (F.col("rows") - b)
    bad = (F.col("rows") < 2 * b) | ~(F.col("sst") > 0) | (F.col("cells") < least_cells)
    share = F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.col("ssb") - (b - 1) * within, F.lit(0.0)) / F.col("sst"))
    return out.select(*keys, share.alias("share"), "cells", "rows")


def sobol_index(table: DataFrame, num_bins: int | None = None) -> DataFrame:
    """``(dim, share)``: the bias-corrected estimator with floor(sqrt(n)) bins, at least two."""
    ranked = dimension_ranks(table)
    bins = F.lit(num_bins) if num_bins else F.greatest(F.floor(F.sqrt("n")), F.lit(2))
    cells = _cells(ranked, bins)
    b = F.lit(num_bins) if num_bins else F.greatest(F.floor(F.sqrt("rows")), F.lit(2))
    return _between(cells, ["dim"], _totals(table), b).select("dim", "share")


def group_sobol_index(table: DataFrame, dims: Sequence[int]) -> DataFrame:
    """One row ``(share, cells)``: the estimator over the distinct values of several inputs."""
    x = expr.doubles(F.col("x"))
    keyed = table.select(F.array(*[x[d] for d in dims]).alias("g"), F.col("y").cast("double").alias("y"))
    cells = keyed.groupBy("g").agg(F.count("*").alias("c"), F.sum("y").alias("t")).withColumn("one", F.lit(0))
    return _between(cells, ["one"], _totals(table), F.col("cells"), 2).select("share", "cells")


def null_sd(rows: Column, cells: Column | None = None) -> Column:
    """The estimator's deviation when there is no dependence."""
    b = cells if cells is not None else F.greatest(F.floor(F.sqrt(rows)), F.lit(2))
    return F.when(rows < 3, F.lit(expr.INF)).otherwise(F.sqrt(2.0 * (b - 1)) / rows)


def dependence_weights(table: DataFrame, floor: float = 1e-6, tied: Sequence[Sequence[int]] = ()) -> DataFrame:
    """``(dim, weight)``.  Shares that chance explains become 0; the rest is raised to a floor,
    scaled to mean one over units (a tied group is one unit) and divided by the input's variance
    (tied inputs: 1).  Without any dependence all shares are one."""
    grouped = {d: g for g, dims in enumerate(tied) for d in dims}
    total = _totals(table)
    singles = sobol_index(table).crossJoin(F.broadcast(total.select("rows")))
    singles = singles.where(~F.col("dim").isin(list(grouped))) if grouped else singles
    s = F.when(F.col("share") > DEPENDENCE_Z * null_sd(F.col("rows")), F.col("share")).otherwise(F.lit(0.0))
    units = singles.select(F.concat(F.lit("d"), F.col("dim")).alias("unit"), s.alias("s"))
    for g, dims in enumerate(tied):
        joint = group_sobol_index(table, dims).crossJoin(total.select("rows"))
        units = units.unionByName(joint.select(F.lit(f"g{g}").alias("unit"), F.when(F.col("share") > DEPENDENCE_Z * null_sd(F.col("rows"), F.col("cells")), F.col("share")).otherwise(F.lit(0.0)).alias("s")))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))  # one row per unit
    top = F.max("s").over(every)
    units = units.withColumn("s2", F.when(top > 0, F.greatest(F.col("s"), floor * top)).otherwise(F.lit(1.0)))
    units = units.withColumn("u", F.count("*").over(every) * F.col("s2") / F.sum("s2").over(every)).select("unit", "u")
    spread = table.select(F.posexplode(expr.doubles(F.col("x"))).alias("dim", "v")).groupBy("dim").agg(F.var_pop("v").alias("xvar"))
    of = F.concat(F.lit("d"), F.col("dim"))
    for d, g in grouped.items():
        of = F.when(F.col("dim") == d, F.lit(f"g{g}")).otherwise(of)
    var = F.when(F.col("dim").isin(list(grouped)), F.lit(1.0)) if grouped else F.when(F.lit(False), F.lit(1.0))
    var = var.otherwise(F.when(F.col("xvar") > MIN_VAR, F.col("xvar")).otherwise(F.lit(1.0)))
    joined = spread.withColumn("of", of).join(F.broadcast(units), F.col("of") == F.col("unit"))
    return joined.select("dim", (F.col("u") / var).alias("weight"))
