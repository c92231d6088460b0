"""Scans in a total order that never put one key into one task.

A window partitioned by a key sorts all rows of that key in one task; with a key
that holds a third of the table this is the slowest task of the job.  Here rows
are range-partitioned on (key, order), so a hot key spreads over as many tasks as
it has rows for.  Each task walks its sorted slice once and emits finished rows
plus its first and last row; the few boundary rows are put together afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.session import cut_lineage, parallelism

#: What a slice should hold, in bytes of the files it comes from.
SLICE_BYTES = 128 << 20
#: Rows of no known size (made in the driver) are stated as about this many bytes.
UNKNOWN = 1 << 62


def slices_for(df: DataFrame) -> int:
    """How many slices the tables under ``df`` should be cut into: by their bytes, at least as many as there are tasks for a shuffle."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves().iterator()
    size = 0
    while leaves.hasNext():
        found = int(str(leaves.next().stats().sizeInBytes()))
        size += found if found < UNKNOWN else 0
    return max(parallelism(df.sparkSession), math.ceil(size / SLICE_BYTES))


def sorted_slices(df: DataFrame, keys: list[str | Column], partitions: int | None = None, then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, ties sorted by ``then``; nulls come first.

    Rows with equal keys are in one slice, so repeated rows stand beside each other if ``then`` has their other columns.
    The number of partitions follows the input's bytes and is fixed, so adaptive execution does not merge them.
    An empty table gives empty slices.
    """
    return df.repartitionByRange(partitions or slices_for(df), *keys).sortWithinPartitions(*keys, *then)


def running_total(df: DataFrame, key: str, order: list, amount: Column, name: str) -> DataFrame:
    """``df`` with ``name`` (put in place of a column of that name): the sum of ``amount`` over the rows of the same key that come before, 0 for the first.

    Rows are cut into sorted slices; totals run within (key, slice), and the totals of a key's slices, at most one
    row a slice, give what comes before each.  Rows without a key are one key.
    """
    sliced = cut_lineage(sorted_slices(df.withColumn("_amount", amount.cast("long")), [F.col(key), *order]).withColumn("_slice", F.spark_partition_id()))
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = sliced.groupBy(key, "_slice").agg(F.sum("_amount").alias("_all")).select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_all").over(earlier), zero).alias("_offset"))
    local = sliced.withColumn("_local", F.coalesce(F.sum("_amount").over(inside), zero))
    joined = local.join(offsets, local[key].eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")))
    return joined.withColumn(name, F.col("_local") + F.col("_offset")).drop("_amount", "_slice", "_local", "_key", "_of", "_offset")


def previous(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the value of the row before in the same key's order, null for the first; no key is one task.

    Within a slice it is the row before; the first row of a slice takes the last row of the key's slice before it.
    """
    sliced = cut_lineage(sorted_slices(df, [key, *order]).withColumn("_slice", F.spark_partition_id()))
    inside, slices = Window.partitionBy(key, "_slice").orderBy(*order), Window.partitionBy(key).orderBy("_slice")
    ends = sliced.groupBy(key, "_slice").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    ends = ends.select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), F.lag("_end").over(slices).alias("_before"))
    local = sliced.withColumn("_n", F.row_number().over(inside)).withColumn("_own", F.lag(value).over(inside))
    joined = local.join(ends, local[key].eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")))
    return joined.withColumn(name, F.when(F.col("_n") == 1, F.col(f"_before.{value}")).otherwise(F.col("_own"))).drop("_slice", "_n", "_own", "_key", "_of", "_before")
