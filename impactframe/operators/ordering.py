"""Order as a column, over all rows or within keys, without gathering the rows of a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impactframe.session import cut


def global_rank(rows: DataFrame, key: Column) -> DataFrame:
    """Adds `ord`, the rank from 1 in the order of key: rows are range-partitioned and sorted, then each partition's
    rows are numbered after the counts of the partitions before it. Only one count per partition is exchanged."""
    spread = cut(rows.withColumn("_k", key).repartitionByRange("_k").sortWithinPartitions("_k").withColumn("_p", F.spark_partition_id()))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy("_k"))
    return spread.withColumn("_r", local).join(starts, "_p").withColumn("ord", F.col("_start") + F.col("_r")).drop("_k", "_p", "_n", "_r", "_start")


def running(rows: DataFrame, keys: list[str], order: Column, size: str | None = None) -> DataFrame:
    """Adds `ord`, the place of a row among those of its keys, and `total`, the sum of `size` up to it.

    Rows are range-partitioned by keys and order, so a key with many rows spreads over tasks; each part is numbered on its
    own, and what lies before it is added. Only the counts of keys that a border cuts are exchanged, at most one a part.
    Equal places are numbered arbitrarily, null keys are a key.
    """
    sorted_ = [*keys, "_o"]
    spread = rows.withColumn("_o", order).withColumn("_s", F.col(size).cast("bigint") if size else F.lit(0).cast("bigint"))
    spread = cut(spread.repartitionByRange(*sorted_).sortWithinPartitions(*sorted_).withColumn("_p", F.spark_partition_id()))
    parts = spread.groupBy("_p", *keys).agg(F.count("*").alias("_n"), F.sum("_s").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cuts = parts.select("_p", *keys, F.sum("_n").over(earlier).alias("_n0"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0")).where("_n0 is not null")
    cuts = cuts.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n0", "_t0")
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = Window.partitionBy("_p", *keys).orderBy("_o")
    local = spread.withColumn("_r", F.row_number().over(own)).withColumn("_c", F.sum("_s").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(F.broadcast(cuts), same, "left")  # fewer rows than there are partitions
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.withColumn("ord", F.col("_r") + zero("_n0")).withColumn("total", zero("_c") + zero("_t0"))
    return out.drop("_o", "_s", "_p", "_q", "_n0", "_t0", "_r", "_c", *[f"_k{i}" for i in range(len(keys))])
