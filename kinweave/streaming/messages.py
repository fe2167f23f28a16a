"""Live forms of the message operators: exact removal of copies within a watermark, and upserts of contact counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.quotient_dedup import has_message_id, permuted, with_message_id
from kinweave.sources.sinks import merge_snapshot


def single_messages(stream: DataFrame, identifier: str, at: str, delay: str = "60 days") -> DataFrame:
    """The stream without messages whose identifier came before within delay; rows without an identifier all stay.

    The state is keyed by quotient and complete remainder of the identifier, as in the batch operator, and forgets what
    is older than the watermark.
    """
    known = permuted(with_message_id(stream, identifier), "_mid").withWatermark(at, delay)
    single = known.dropDuplicatesWithinWatermark(["_quotient", "_rest", "_tail"]).select(*stream.columns)
    return single.unionByName(stream.where(~has_message_id(F.col(identifier))))


def contact_counters(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, checkpoint: str) -> StreamingQuery:
    """Keep a snapshot of per-contact counters: each batch is summed up by itself and merged into it.

    read gives the latest snapshot, write stores the next one under the batch's number, so that a repeated batch
    overwrites its own result instead of counting twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("loaded_at").alias("first_at"), F.max("loaded_at").alias("last_at"))
        write(merge_snapshot(read(), new, key, ["n"], ["first_at"], ["last_at"], []), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_activity(stream: DataFrame, at: str, group: str, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Messages per group and window of event time."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n")
