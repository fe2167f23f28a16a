"""Top-k, ranks within groups and shares of a total, all with explicit ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[Column], k: int) -> DataFrame:
    """The first k rows by the order given; Spark keeps k rows per partition and merges, nothing is sorted whole."""
    return df.orderBy(*by).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], by: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank. Catalyst's window-group limit cuts each map task's rows to k first."""
    w = Window.partitionBy(*group).orderBy(*by)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def with_share(df: DataFrame, value: str, share: str = "share") -> DataFrame:
    """df (a small aggregate) with each row's part of the total of value, 0 where the total is 0."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(share, F.round(F.coalesce(F.try_divide(value, "_total"), F.lit(0.0)), 6)).drop("_total")


def numbered(df: DataFrame, key: list[str], bucket: Column, by: list[Column], place: str = "place") -> DataFrame:
    """df with each row's place (from 1) within its key, by bucket in ascending order and then by the columns given.

    Rows are numbered within (key, bucket) and shifted by what the earlier buckets of the key hold, so that a key with a
    large part of all rows is sorted in pieces. A null bucket comes first.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*key).orderBy("_bucket")) - F.col("_n")).drop("_n")
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_bucket").orderBy(*by)))
    match = [inside[c].eqNullSafe(earlier[c]) for c in [*key, "_bucket"]]
    joined = inside.join(earlier, reduce(lambda a, b: a & b, match))
    return joined.select(*[inside[c] for c in df.columns], (F.col("_k") + F.col("_before")).cast("long").alias(place))
