"""p4 and p6: moments and copies of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.dates import unified_moments
from kinweave.operators.quotient_dedup import superfluous_deliveries
from kinweave.plans.tables import table


def _moments(spark: SparkSession, folder: str, status: str | None = None) -> DataFrame:
    sources = {"interactions": "id", "emails": "email_id", "channel_interactions": "row_id"}
    return unified_moments({t: (table(spark, folder, t), key) for t, key in sources.items()}, table(spark, folder, "mailboxes"), status)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _moments(spark, folder).where(F.col("utc_second").isNotNull()).select("origin", "record_id", "utc_second")


def p4_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """The rows whose date names no moment, with what stands there and why."""
    found = _moments(spark, folder, "reason").where(F.col("utc_second").isNull())
    return found.select("origin", "record_id", F.col("date").alias("text"), "reason")


def p4_unclear(spark: SparkSession, folder: str) -> DataFrame:
    """The rows whose clock time occurs twice or never in their zone, with how it was taken."""
    found = _moments(spark, folder, "reading").where(F.col("reading").isin("twice", "skipped"))
    return found.select("origin", "record_id", "reading", "utc_second")


def message_ids(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.lit(t).alias("origin"), F.col(key).alias("record_id"), "message_id") for t, key in (("interactions", "id"), ("emails", "email_id"))]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return superfluous_deliveries(message_ids(spark, folder), "origin", "record_id", "message_id")


#: Moments in SQL: the table m(origin, record_id, text, utc_second, shaped, utc_wall, first_second).
_TAIL = r"(?:\s*(Z|z|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|(?:UTC|GMT)?[+-]\d{2}))?(?:\s*\[([^\]]+)\])?(?:\s*\([^)]*\))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_FORMS = {
    "a": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:\s*T\s*|\s+){_CLOCK}{_TAIL})?$", "y mo d h mi se off zone"),
    "b": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?{_TAIL}$", "y mo d h mi se off zone"),
    "c": (rf"^(\d{{1,2}})\.\s*(\d{{1,2}})\.\s*(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_TAIL})?$", "d mo y h mi se off zone"),
    "d": (rf"^(?:[A-Za-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[\s-]+([A-Za-z]{{3,9}})\.?,?[\s-]+(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_TAIL})?$", "d mo y h mi se off zone"),
    "e": (rf"^([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_CLOCK}\s*(?:([AaPp])\.?[Mm]\.?)?{_TAIL})?$", "mo d y h mi se half off zone"),
}
_PARTS = ", ".join(f"regexp_extract(s, '{p}', [{', '.join(repr(n) for n in names.split())}]) AS {k}" for k, (p, names) in _FORMS.items())
_PICKED = ", ".join("coalesce(" + ", ".join(f"nullif({k}.{c}, '')" for k, (_, names) in _FORMS.items() if c in names.split()) + f") AS {c}" for c in ("y", "mo", "d", "h", "mi", "se", "half", "off", "zone"))
MOMENTS_SQL = rf"""
raw AS (
  SELECT 'interactions' AS origin, id AS record_id, mailbox_id, date AS text FROM interactions
  UNION ALL SELECT 'emails', email_id, mailbox_id, date FROM emails UNION ALL SELECT 'channel_interactions', row_id, mailbox_id, date FROM channel_interactions),
bare AS (SELECT *, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS s FROM raw),
forms AS (SELECT *, {_PARTS} FROM bare),
picked AS (SELECT origin, record_id, mailbox_id, text, s, {_PICKED} FROM forms),
numbers AS (
  SELECT origin, record_id, mailbox_id, text, s, off, trim(zone) AS zone, y IS NOT NULL AS shaped,
    CASE WHEN length(y) = 2 THEN y::INT + CASE WHEN y::INT < 70 THEN 2000 ELSE 1900 END ELSE y::INT END AS y, d::INT AS d,
    coalesce(TRY_CAST(mo AS INT), nullif(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(mo, 3))), 0)) AS mo,
    CASE WHEN half IS NULL THEN coalesce(h::INT, 0) WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE WHEN lower(half) = 'p' THEN 12 ELSE 0 END END AS h, coalesce(mi::INT, 0) AS mi, coalesce(se::INT, 0) AS se,
    CASE WHEN regexp_matches(s, '^-?\d{{9,10}}(\.\d*)?$') THEN floor(TRY_CAST(s AS DECIMAL(38, 9))) WHEN regexp_matches(s, '^-?\d{{12,13}}(\.\d*)?$') THEN floor(TRY_CAST(s AS DECIMAL(38, 9)) / 1000)
      WHEN regexp_matches(s, '^-?\d{{15,16}}(\.\d*)?$') THEN floor(TRY_CAST(s AS DECIMAL(38, 9)) / 1000000) WHEN regexp_matches(s, '^-?\d{{18,19}}(\.\d*)?$') THEN floor(TRY_CAST(s AS DECIMAL(38, 9)) / 1000000000) END::BIGINT AS counted FROM picked),
shifts AS (
  SELECT *, CASE WHEN h <= 23 AND mi <= 59 AND se <= 59 THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, h, mi, se) AS TIMESTAMP) END AS wall,
    CASE WHEN off IS NULL THEN NULL
      WHEN regexp_matches(off, '\d$') THEN CASE WHEN regexp_extract(off, '[+-](\d\d)', 1)::INT <= 15 AND coalesce(nullif(regexp_extract(off, '[+-]\d\d:?(\d\d)', 1), ''), '0')::INT <= 59
        THEN (CASE WHEN contains(off, '-') THEN -1 ELSE 1 END) * (regexp_extract(off, '[+-](\d\d)', 1)::INT * 3600 + coalesce(nullif(regexp_extract(off, '[+-]\d\d:?(\d\d)', 1), ''), '0')::INT * 60) END
      ELSE CASE upper(off) WHEN 'Z' THEN 0 WHEN 'UT' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'CET' THEN 3600 WHEN 'CEST' THEN 7200 WHEN 'BST' THEN 3600 WHEN 'EET' THEN 7200 WHEN 'EEST' THEN 10800
        WHEN 'IST' THEN 19800 WHEN 'JST' THEN 32400 WHEN 'AEST' THEN 36000 WHEN 'AEDT' THEN 39600 WHEN 'EST' THEN -18000 WHEN 'EDT' THEN -14400 WHEN 'CST' THEN -21600 WHEN 'CDT' THEN -18000 WHEN 'MST' THEN -25200
        WHEN 'MDT' THEN -21600 WHEN 'PST' THEN -28800 WHEN 'PDT' THEN -25200 WHEN 'MSK' THEN 10800 WHEN 'NPT' THEN 20700 WHEN 'WET' THEN 0 WHEN 'WEST' THEN 3600 END END AS shift FROM numbers),
zoned AS (
  SELECT s.*, z.name AS tz FROM shifts s LEFT JOIN (SELECT mailbox_id, min(tz_name) AS tz_name FROM mailboxes GROUP BY 1) b USING (mailbox_id)
  LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) z ON lower(z.name) = lower(coalesce(nullif(s.zone, ''), b.tz_name))),
placed AS (SELECT *, CASE WHEN wall IS NOT NULL AND off IS NULL AND tz IS NOT NULL THEN epoch(timezone(tz, wall))::BIGINT END AS one FROM zoned),
m AS (
  SELECT origin, record_id, text, s, shaped, one, wall, tz,
    CASE WHEN one IS NOT NULL AND timezone(tz, to_timestamp(one - 3600)) = wall THEN one - 3600 WHEN one IS NOT NULL AND timezone(tz, to_timestamp(one - 1800)) = wall THEN one - 1800 END AS earlier,
    CASE WHEN one IS NOT NULL THEN coalesce(CASE WHEN timezone(tz, to_timestamp(one - 3600)) = wall THEN one - 3600 WHEN timezone(tz, to_timestamp(one - 1800)) = wall THEN one - 1800 END, one)
      WHEN off IS NOT NULL THEN epoch(wall)::BIGINT - shift WHEN wall IS NULL AND NOT shaped THEN counted END AS utc_second FROM placed)
"""
P4_SQL = f"WITH {MOMENTS_SQL} SELECT origin, record_id, utc_second FROM m WHERE utc_second IS NOT NULL"
P4_UNREADABLE_SQL = f"WITH {MOMENTS_SQL} SELECT origin, record_id, text, CASE WHEN coalesce(s, '') = '' THEN 'blank' WHEN shaped THEN 'impossible' ELSE 'no date' END AS reason FROM m WHERE utc_second IS NULL"
P4_UNCLEAR_SQL = f"WITH {MOMENTS_SQL} SELECT origin, record_id, CASE WHEN earlier IS NOT NULL THEN 'twice' ELSE 'skipped' END AS reading, utc_second FROM m WHERE earlier IS NOT NULL OR timezone(tz, to_timestamp(one)) <> wall"

#: Superfluous deliveries in SQL: the table dupes(origin, record_id).
DUPES_SQL = r"""
d_ids AS (
  SELECT 'interactions' AS origin, id AS record_id, message_id FROM interactions
  UNION ALL SELECT 'emails', email_id, message_id FROM emails),
d_bare AS (SELECT origin, record_id, regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g') AS m FROM d_ids),
d_clean AS (
  SELECT origin, record_id, CASE WHEN instr(m, '@') > 0 THEN left(m, instr(m, '@')) || lower(substr(m, instr(m, '@') + 1)) ELSE m END AS m
  FROM d_bare WHERE m <> ''),
dupes AS (SELECT origin, record_id FROM (SELECT origin, record_id, min(record_id) OVER (PARTITION BY origin, m) AS first FROM d_clean) WHERE record_id > first)
"""
P6_SQL = f"WITH {DUPES_SQL} SELECT * FROM dupes"

QUERIES = {"p4_found": p4_found, "p4_unreadable": p4_unreadable, "p4_unclear": p4_unclear, "p6_found": p6_found}
ORACLES = {"p4_found": P4_SQL, "p4_unreadable": P4_UNREADABLE_SQL, "p4_unclear": P4_UNCLEAR_SQL, "p6_found": P6_SQL}
