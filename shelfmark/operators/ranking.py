"""Row numbers and top-k that hold when one group contains a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.session import durable


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The rank filter sits directly on the window, so Spark keeps at most ``k`` rows of each group in
    every map task before the shuffle.  A hot group therefore never arrives whole in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def group_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_number"
) -> DataFrame:
    """``row_number()`` over unbounded groups (or the whole table, with no keys) without one big task.

    Rows are range-partitioned by key and order, so a hot group spreads over many partitions.  Each
    partition numbers its own slice, and slice sizes summed over the earlier partitions give offsets.
    The offset table holds one row per group and partition.  Range bounds are sampled anew when a plan
    runs again, so the partitioned rows are checkpointed before both uses.  Pass narrow frames and end
    ``order`` with a unique column.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    ranged = durable(ranged.withColumn("_slice", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_at"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = ranged.withColumn("_inner", F.row_number().over(inside))
    same = F.col("_slice") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return (
        numbered.join(offsets, same)
        .withColumn(name, (F.col("_inner") + F.col("_offset")).cast("bigint"))
        .drop("_slice", "_at", "_inner", "_offset", *[f"_key{i}" for i in range(len(keys))])
    )


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` columns per key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*").select(*df.columns)
