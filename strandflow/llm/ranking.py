"""Exact ranks and running sums without a single-task window.

Rows are ordered by a uniform hash.  The hash's top bits name a bucket; sums by bucket are a
small table whose running totals give every bucket's offset, and a window inside the
bucket finishes the order.  A group that holds a third of all rows is spread over all of its
buckets, so no task gets a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of each group: a task's share of a group is its rows divided by this.
BUCKETS = 4096


def hash_bucket(order: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a uniform 64-bit hash; ascending in the hash."""
    return F.shiftright(F.col(order), 64 - (buckets.bit_length() - 1))


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str, totals: bool = False) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one in (group, bucket, order).

    ``order`` must be total up to rows that are alike in every column used later.  With ``totals``
    also ``name_total``, the group's whole sum.  Null groups are a group of their own.
    """
    valued = df.withColumn("_v", value)
    sums = valued.groupBy(*group, bucket).agg(F.sum("_v").alias("_s"))
    across = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sums = sums.withColumn("_before", F.sum("_s").over(across.orderBy(bucket)) - F.col("_s"))
    if totals:
        sums = sums.withColumn(f"{name}_total", F.sum("_s").over(across))
    keys = [*group, bucket]
    renamed = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_before", *([f"{name}_total"] if totals else []))
    inside = Window.partitionBy(*keys).orderBy(*order)
    out = valued.withColumn("_in", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v"))
    match = F.lit(True)
    for i, c in enumerate(keys):
        match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(renamed, match).withColumn(name, F.col("_before") + F.col("_in"))
    return out.drop("_v", "_in", "_before", *[f"_k{i}" for i in range(len(keys))])
