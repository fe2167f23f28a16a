"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Settings that the plans rely on.

    The JVM leaves methods of over 8000 bytes of bytecode uncompiled; a generated stage beyond that runs several times
    faster split into the expressions' own small methods.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", None) != "8000":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
