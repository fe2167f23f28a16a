"""Exact removal of messages that were delivered more than once, by quotient hash tables.

An identifier is cut into a head of eight bytes (read as a 64-bit integer) and its tail. Adding the hash of the tail to
the head by exclusive or is one round of an unbalanced Feistel network: a permutation, so head and tail can be had back
from the permuted form and no two identifiers share one. The low bits of the permuted head are the quotient, which names
the shard; the remaining bits and the tail are the complete remainder, which the shard's hash table stores. Equality of
quotient and remainder is therefore equality of identifiers: there are no false matches, unlike with fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTIENT_BITS = 16


BLANKS = " \t\r\n\u00a0<>"


def has_message_id(raw: Column) -> Column:
    """Whether anything but blanks and angle brackets stands there."""
    return F.coalesce(F.trim(raw, F.lit(BLANKS)) != "", F.lit(False))


def with_message_id(rows: DataFrame, identifier: str) -> DataFrame:
    """The rows that have an identifier, with _mid: without blanks and angle brackets around it, in lower case after its @.

    Each step is a projection of its own, so that none is computed twice.
    """
    bare = rows.withColumn("_bare", F.trim(identifier, F.lit(BLANKS))).where("_bare <> ''").withColumn("_at", F.instr("_bare", "@"))
    lowered = F.concat(F.expr("substring(_bare, 1, _at)"), F.lower(F.expr("substring(_bare, _at + 1)")))
    return bare.withColumn("_mid", F.when(F.col("_at") > 0, lowered).otherwise(F.col("_bare"))).drop("_bare", "_at")


def permuted(rows: DataFrame, identifier: str, bits: int = QUOTIENT_BITS) -> DataFrame:
    """rows with _quotient (int), _rest (the other bits of the permuted head) and _tail (binary) of a text identifier.

    Heads shorter than eight bytes are padded with the byte 0xFF, which UTF-8 text never holds, so that padding adds no
    false match.
    """
    raw = F.encode(F.col(identifier), "utf-8")
    cut = rows.withColumn("_head", F.rpad(F.substring(raw, 1, 8), 8, F.lit(b"\xff"))).withColumn("_tail", F.substring(raw, F.lit(9), F.greatest(F.length(raw) - 8, F.lit(0))))
    mixed = cut.withColumn("_mixed", F.conv(F.hex("_head"), 16, -10).cast("long").bitwiseXOR(F.xxhash64("_tail")))
    return mixed.withColumn("_quotient", F.col("_mixed").bitwiseAND((1 << bits) - 1).cast("int")).withColumn("_rest", F.shiftrightunsigned("_mixed", bits)).drop("_head", "_mixed")


def first_deliveries(rows: DataFrame, partition: str, key: str, identifier: str) -> DataFrame:
    """The key of the first row (smallest key) of each identifier, per value of partition, for rows that have one.

    Each shard's table is Tungsten's hash map over (quotient, remainder); an insert of a known identifier only lowers the
    kept key. Copies meet in the map-side table already, so an identifier that a third of all rows carry crosses the
    shuffle once per map task.
    """
    found = with_message_id(rows.select(partition, key, identifier), identifier).select(partition, key, "_mid")
    return permuted(found, "_mid").groupBy(partition, "_quotient", "_rest", "_tail").agg(F.min(key).alias(key)).select(partition, key)


def superfluous_deliveries(rows: DataFrame, partition: str, key: str, identifier: str) -> DataFrame:
    """(partition, key) of the rows whose identifier another row of the same partition with a smaller key also has.

    rows: partition (which table or stream), key (unique per partition), identifier (text). Blanks and angle brackets
    around an identifier and the case after its @ do not count. Rows without an identifier (null, blank, "<>") are never
    copies. The result keeps every other column out, so clashing names do no harm; an empty input gives an empty result.
    The anti-join runs on the unique keys, never on identifiers, so no identifier can make it skewed.
    """
    has = rows.where(has_message_id(F.col(identifier))).select(partition, key)
    return has.join(first_deliveries(rows, partition, key, identifier), [partition, key], "left_anti")


def distinct_messages(rows: DataFrame, key: str, identifier: str, source: DataFrame | None = None) -> DataFrame:
    """rows of one table without superfluous deliveries, as superfluous_deliveries has them; rows without an identifier stay.

    One join on the unique key; all columns of rows are kept. source: the table that rows was derived from, with all its
    rows, so that reading the identifiers does not repeat the derivation.
    """
    ids = (rows if source is None else source).select(F.lit(0).alias("_table"), key, identifier)
    firsts = first_deliveries(ids, "_table", key, identifier).select(key, F.lit(True).alias("_first"))
    keep = F.col("_first") | ~has_message_id(F.col(identifier))
    return rows.join(firsts, key, "left").where(keep).drop("_first")
