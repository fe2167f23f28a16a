"""Dates of all message tables as UTC seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.moments import to_utc
from kinweave.operators.quotient_dedup import distinct_messages


def message_moments(rows: DataFrame, mailboxes: DataFrame, text: str = "date", status: str | None = None) -> DataFrame:
    """rows with utc_second and the zone of their mailbox (_mailbox_zone), null utc_second where the date is unreadable.

    mailboxes(mailbox_id, tz_name) is joined by a broadcast when its rows prove few; a mailbox that is missing or has
    several rows gives the smallest of its zones or none. Rows are neither dropped nor repeated. status: as to_utc has it.
    """
    from kinweave.plans.lineage import broadcast_if_small

    zones = mailboxes.groupBy("mailbox_id").agg(F.min("tz_name").alias("_mailbox_zone"))
    joined = rows.join(broadcast_if_small(zones, 100_000), "mailbox_id", "left")
    return to_utc(joined, text, "_mailbox_zone", defaults=zones.select("_mailbox_zone"), status=status)


def unified_moments(tables: dict[str, tuple[DataFrame, str]], mailboxes: DataFrame, status: str | None = None) -> DataFrame:
    """origin, record_id, date, utc_second (and status, if named) of every row of the tables {origin: (rows, id column)}.

    The tables are united before the parse so that one plan and one as-of join serve all of them.
    """
    parts = [df.select(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("record_id"), "mailbox_id", "date") for origin, (df, key) in tables.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return message_moments(rows, mailboxes, status=status).select("origin", "record_id", "date", "utc_second", *([status] if status else []))


def clean_messages(rows: DataFrame, mailboxes: DataFrame, key: str, *columns: str) -> DataFrame:
    """Messages once each, with their moment: key, message_id, columns, utc_second and moment (a timestamp).

    Repeated deliveries are taken out by identifier, as distinct_messages does; rows whose date names no moment stay, with
    a null moment. rows: one table with key, mailbox_id, date, message_id and the columns named.
    """
    own = rows.select(*dict.fromkeys([key, "mailbox_id", "date", "message_id", *columns]))
    timed = message_moments(own, mailboxes).withColumn("moment", F.timestamp_seconds("utc_second"))
    return distinct_messages(timed, key, "message_id", own).select(*dict.fromkeys([key, *columns, "message_id", "utc_second", "moment"]))
