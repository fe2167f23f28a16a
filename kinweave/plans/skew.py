"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No more keys than this are ever called heavy, which bounds what is broadcast for them.
MAX_HEAVY = 20_000
#: Below this many rows a key is never heavy.
LEAST_HEAVY = 20_000


def heavy_keys(rows: DataFrame, key: str, total: int, least: int = LEAST_HEAVY) -> DataFrame:
    """The keys that hold over max(least, total / MAX_HEAVY) of rows: fewer than MAX_HEAVY of them by counting."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(least, total // MAX_HEAVY)).select(key)


def lookup_join(rows: DataFrame, key: str, facts: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """rows left-joined to facts (unique key, same column name); the heavy keys' facts go by broadcast, the rest by shuffle.

    heavy: the heavy keys of rows (at most MAX_HEAVY rows), or None where there are none. Rows without a key match nothing
    and, where keys are heavy, are not shuffled either, since all of them would meet in one task.
    """
    if heavy is None:
        return rows.join(facts, key, "left")
    marks = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    marked = rows.join(marks, key, "left")
    hot_facts = F.broadcast(facts.join(F.broadcast(heavy), key, "left_semi"))
    hot = marked.where("_heavy").drop("_heavy").join(hot_facts, key, "left")
    cold = marked.where(F.col("_heavy").isNull() & F.col(key).isNotNull()).drop("_heavy").join(facts, key, "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != key]
    return hot.unionByName(cold).unionByName(rows.where(F.col(key).isNull()).select("*", *none))


def heavy_or_none(rows: DataFrame, key: str, total: int, least: int = LEAST_HEAVY) -> DataFrame | None:
    """As heavy_keys, as a local table; None where no key is heavy."""
    if total <= least:
        return None
    found = heavy_keys(rows, key, total, least).collect()
    return rows.sparkSession.createDataFrame(found, rows.select(key).schema) if found else None
