"""Rankings put together: reciprocal rank fusion, pooling, first-wins duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(legs: dict[str, DataFrame], key: str, k: int | None = None, constant: int = 60, by: str | None = None) -> DataFrame:
    """(key, rrf, <leg>_rank ...): the sum over the legs of 1 / (constant + rank).

    ``legs`` are frames with key and rank from 1, and ``by`` (a query's id) if given.  Any number of legs is one
    union and one aggregation.  Ties follow the legs' ranks in the order given, then the key; without ``k`` nothing is cut.
    """
    groups = [by, key] if by else [key]
    tagged = [df.select(*groups, "rank", F.lit(name).alias("leg")) for name, df in legs.items()]
    union = reduce(DataFrame.unionByName, tagged)
    ranks = [F.min(F.when(F.col("leg") == n, F.col("rank"))).alias(f"{n}_rank") for n in legs]
    fused = union.groupBy(*groups).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), *ranks)
    order = [F.desc("rrf"), *[F.asc_nulls_last(f"{n}_rank") for n in legs], F.asc(key)]
    if k is None:
        return fused
    if by is None:
        return fused.orderBy(*order).limit(k)
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key, the first in ``order``; rows whose keys are all null stay as they are."""
    named = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in keys))
    kept = df.where(named).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return kept.unionByName(df.where(~named))


def round_robin(hits: DataFrame, key: str, sub_query: str = "sub_query", rank: str = "rank") -> DataFrame:
    """One pool of several rankings: all first places, then all second places, and so on; a key counts where it comes first.

    (key, position, sub_queries): ``sub_queries`` lists in order which rankings have the key.
    """
    per_key = hits.groupBy(key).agg(F.min(F.struct(rank, sub_query)).alias("first"), F.array_sort(F.collect_set(sub_query)).alias("sub_queries"))
    order = Window.orderBy("first", key)
    return per_key.select(key, F.row_number().over(order).cast("int").alias("position"), "sub_queries")
