"""Clean views of the message tables, under every query that counts, orders or times messages, and the same in SQL.

Repeated deliveries are taken out (p6) and dates are read as moments (p4); a message whose date cannot be read stays, with
a null moment, and is left out only where time matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.dates import clean_messages
from kinweave.plans.tables import table
from kinweave.queries.messages import DUPES_SQL, MOMENTS_SQL

# How directions are written, in lower case without blanks around.
SENT, RECEIVED = ["sent", "outgoing", "outbound", "out"], ["received", "incoming", "inbound", "in"]
BLANKS = " \t\r\n <>"


def registry() -> tuple[dict, dict, object]:
    """A module's QUERIES, ORACLES and the decorator that fills them: query(sql) or query() where SQL cannot say it."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def side_of(direction: Column) -> Column:
    """`sent` by the mailbox owner, `received`, or null for anything else."""
    d = F.lower(F.trim(direction, F.lit(" \t\r\n ")))
    return F.when(d.isin(SENT), "sent").when(d.isin(RECEIVED), "received")


def thread_of(raw: Column) -> Column:
    return F.nullif(F.trim(raw, F.lit(BLANKS)), F.lit(""))


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """id, contact_id, mailbox_id, side, subject, snippet, thread, at_s (UTC second), moment: each message once."""
    rows = table(spark, folder, "interactions")
    clean = clean_messages(rows, table(spark, folder, "mailboxes"), "id", "contact_id", "mailbox_id", "direction", "subject", "snippet", "thread_id")
    return clean.select("id", "contact_id", "mailbox_id", side_of(F.col("direction")).alias("side"), "subject", "snippet", thread_of(F.col("thread_id")).alias("thread"), F.col("utc_second").alias("at_s"), "moment")


def emails(spark: SparkSession, folder: str) -> DataFrame:
    """email_id, mailbox_id, from_email, from_name, to_emails, cc_emails, subject, snippet, thread, at_s, moment: each mail once; addresses trimmed, in lower case."""
    rows = table(spark, folder, "emails")
    clean = clean_messages(rows, table(spark, folder, "mailboxes"), "email_id", "mailbox_id", "from_email", "from_name", "to_emails", "cc_emails", "subject", "snippet", "thread_id")
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return clean.select("email_id", "mailbox_id", F.lower(F.trim("from_email")).alias("from_email"), "from_name", low("to_emails").alias("to_emails"), low("cc_emails").alias("cc_emails"), "subject", "snippet", thread_of(F.col("thread_id")).alias("thread"), F.col("utc_second").alias("at_s"), "moment")


#: im: interactions; em: emails; xm: moments of channel_interactions. `at_s` is the UTC second, `day` its date.
IM_SQL = f"""{MOMENTS_SQL}, {DUPES_SQL},
im AS (
  SELECT i.id, i.contact_id, i.mailbox_id, i.subject, i.snippet, nullif(trim(i.thread_id, ' <>' || chr(9) || chr(10) || chr(13) || chr(160)), '') AS thread, m.utc_second AS at_s, make_timestamp(m.utc_second * 1000000)::DATE AS day,
    CASE WHEN lower(trim(i.direction)) IN ('sent', 'outgoing', 'outbound', 'out') THEN 'sent' WHEN lower(trim(i.direction)) IN ('received', 'incoming', 'inbound', 'in') THEN 'received' END AS side
  FROM interactions i JOIN m ON m.origin = 'interactions' AND m.record_id = i.id WHERE i.id NOT IN (SELECT record_id FROM dupes WHERE origin = 'interactions'))
"""
EM_SQL = f"""{MOMENTS_SQL}, {DUPES_SQL},
em AS (
  SELECT e.email_id, e.mailbox_id, lower(trim(e.from_email)) AS from_email, e.from_name, [lower(trim(x)) FOR x IN coalesce(e.to_emails, [])] AS to_emails, [lower(trim(x)) FOR x IN coalesce(e.cc_emails, [])] AS cc_emails, e.subject, e.snippet,
    nullif(trim(e.thread_id, ' <>' || chr(9) || chr(10) || chr(13) || chr(160)), '') AS thread, m.utc_second AS at_s, make_timestamp(m.utc_second * 1000000)::DATE AS day
  FROM emails e JOIN m ON m.origin = 'emails' AND m.record_id = e.email_id WHERE e.email_id NOT IN (SELECT record_id FROM dupes WHERE origin = 'emails'))
"""
