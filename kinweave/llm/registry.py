"""Queries of this subpackage and the SQL they are compared to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.conversations import arrival, clean_thread, conversations, lean_messages
from kinweave.llm.leaks import leaked_items
from kinweave.llm.linkage import linked_groups
from kinweave.llm.matching import same_people
from kinweave.llm.packing import packed_documents
from kinweave.llm.sentences import document_sentences
from kinweave.llm.survivors import survivor_choices, survivors
from kinweave.llm.tags import mapped_elements
from kinweave.operators.dates import message_moments
from kinweave.operators.quotient_dedup import distinct_messages
from kinweave.plans.tables import table
from kinweave.queries.messages import DUPES_SQL, MOMENTS_SQL


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    return same_people(table(spark, folder, "contacts"), table(spark, folder, "google_contacts"), table(spark, folder, "vcards"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_matches(spark, folder).select("source1", "key1", "source2", "key2")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor_choices(table(spark, folder, "merge_previews"), table(spark, folder, "contact_entries"))


def p2_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivors(table(spark, folder, "merge_previews"), table(spark, folder, "contact_entries"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_groups(table(spark, folder, "duplicate_pairs"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "interactions").select("id", "mailbox_id", "message_id", "date", "direction", "snippet", "thread_id", "loaded_at")
    lean = lean_messages(message_moments(rows, table(spark, folder, "mailboxes")), "message_id")
    arrivals = rows.select(clean_thread(F.col("thread_id")).alias("thread"), arrival(F.col("loaded_at")))
    return conversations(distinct_messages(lean, "id", "message_id", rows), arrivals)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for origin, key, values in (("contact_entries", "entry_id", "tags"), ("extracted_entities", "entity_id", "suggested_industries")):
        rows = table(spark, folder, origin).select(F.lit(origin).alias("origin"), F.col(key).alias("record_id"), F.posexplode(values).alias("value_no", "value"))
        parts.append(rows.withColumn("value_no", F.col("value_no").cast("long")))
    return mapped_elements(parts[0].unionByName(parts[1]), table(spark, folder, "industry_registry")).select("origin", "record_id", "value_no", "tag")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return document_sentences(table(spark, folder, "documents"))


_NOT_KNOWN = "'n/a','na','n.a.','unknown','not known','unbekannt','none','null','nil','nan','tbd','tba','to be added','to be announced','to be determined','xxx','xx','x','empty','(empty)','see card','call office','no mail','no email','no phone','missing','undefined','not available','not applicable','(none)','(null)','(unknown)'"

_P2_CELLS = rf"""
WITH named AS (SELECT DISTINCT group_id, source_file FROM (SELECT group_id, unnest([keep, merge_from]) AS source_file FROM merge_previews) WHERE source_file IS NOT NULL AND group_id IS NOT NULL),
people AS (SELECT group_id, e.* REPLACE (TRY_CAST(e.updated AS DATE) AS updated) FROM named JOIN contact_entries e USING (source_file)),
cells AS (
  SELECT group_id, entry_id, updated, space, u.field, u.value FROM (
    SELECT group_id, entry_id, updated, space, unnest([
      {{'field': 'name', 'value': name}}, {{'field': 'organization', 'value': organization}}, {{'field': 'role', 'value': role}},
      {{'field': 'location', 'value': location}}, {{'field': 'email', 'value': channels.email}}, {{'field': 'phone', 'value': channels.phone}}]) AS u FROM people)),
good AS (
  SELECT * FROM cells
  WHERE regexp_matches(value, '[\p{{L}}\p{{N}}]') AND lower(trim(value)) NOT IN ({_NOT_KNOWN})
    AND (field <> 'email' OR regexp_matches(trim(value), '^[^@\s<>,;]+@[^@\s<>,;.]+(\.[^@\s<>,;.]+)+$'))
    AND (field <> 'phone' OR length(regexp_replace(value, '[^0-9]', '', 'g')) >= 5))
"""

P2_SQL = rf"""{_P2_CELLS},
picked AS (SELECT group_id, field, entry_id, row_number() OVER (PARTITION BY group_id, field ORDER BY updated DESC NULLS LAST, entry_id) AS k FROM good),
sizes AS (SELECT p.group_id, p.entry_id, p.updated, count(g.field) AS n FROM people p LEFT JOIN good g ON g.group_id = p.group_id AND g.entry_id = p.entry_id GROUP BY ALL),
kept AS (SELECT group_id, entry_id, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, updated DESC NULLS LAST, entry_id) AS k FROM sizes)
SELECT group_id, field, entry_id FROM picked WHERE k = 1
UNION ALL SELECT group_id, 'keep', entry_id FROM kept WHERE k = 1
"""

P2_SURVIVORS_SQL = rf"""{_P2_CELLS},
dated AS (
  SELECT *, CASE WHEN field = 'phone' THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(trim(regexp_replace(value, '\s+', ' ', 'g'))) END AS form,
    CASE space WHEN '1-personal' THEN 0.8 WHEN '2-work' THEN 1.0 WHEN '3-fund' THEN 1.0 WHEN '4-research' THEN 0.9 WHEN '5-community' THEN 0.7 ELSE 0.5 END::DOUBLE AS trust,
    row_number() OVER (PARTITION BY group_id, field ORDER BY updated DESC NULLS LAST, entry_id) AS place, max(updated) OVER (PARTITION BY group_id, field) AS newest FROM good),
votes AS (
  SELECT group_id, field, form, min(place) AS place, arg_min(value, place) AS value,
    sum(trust * pow(2.0, -(CASE WHEN place = 1 THEN 0 WHEN newest IS NULL THEN 1 WHEN updated IS NULL THEN 1000001 ELSE datediff('day', updated, newest) + 1 END) / 365.0)) AS votes
  FROM dated GROUP BY 1, 2, 3),
won AS (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY round(votes, 9) DESC, place) AS k, count(*) OVER (PARTITION BY group_id, field) AS forms FROM votes)
SELECT group_id, max(value) FILTER (WHERE field = 'name') AS name, max(value) FILTER (WHERE field = 'organization') AS organization, max(value) FILTER (WHERE field = 'role') AS role,
  max(value) FILTER (WHERE field = 'location') AS location, max(value) FILTER (WHERE field = 'email') AS email, max(value) FILTER (WHERE field = 'phone') AS phone,
  count(*) AS n_fields, count(*) FILTER (WHERE forms > 1) AS n_conflicts
FROM won WHERE k = 1 GROUP BY group_id
"""

P3_SQL = f"""
WITH {MOMENTS_SQL}, {DUPES_SQL},
x AS (
  SELECT i.id, trim(i.thread_id, ' <>' || chr(9) || chr(10) || chr(13) || chr(160)) AS thread, m.utc_second AS moment, trim(coalesce(i.snippet, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(12288)) <> '' AS said,
    CASE WHEN lower(trim(i.direction)) IN ('sent', 'outgoing', 'outbound', 'out') THEN 'me' WHEN lower(trim(i.direction)) IN ('received', 'incoming', 'inbound', 'in') THEN 'contact' END AS speaker
  FROM interactions i JOIN m ON m.origin = 'interactions' AND m.record_id = i.id WHERE i.id NOT IN (SELECT record_id FROM dupes WHERE origin = 'interactions')),
kept AS (SELECT thread FROM x WHERE thread <> '' GROUP BY 1 HAVING count(*) = count(moment) AND count(*) = count(speaker) AND count(DISTINCT speaker) = 2 AND bool_or(said))
SELECT first_value(id) OVER w AS conv_id, row_number() OVER w AS turn_no, id, speaker FROM x JOIN kept USING (thread) WINDOW w AS (PARTITION BY thread ORDER BY moment, id)
"""

P7_SQL = r"""
WITH RECURSIVE clean AS (
  SELECT regexp_replace(trim(contact1), '^(\./)+', '') AS a, regexp_replace(trim(contact2), '^(\./)+', '') AS b
  FROM duplicate_pairs WHERE NOT isnan(similarity) AND similarity >= 0.7),
links AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM clean UNION ALL SELECT b, a FROM clean) WHERE a <> b AND a <> '' AND b <> ''),
reach AS (SELECT DISTINCT a AS contact, a AS other FROM links UNION SELECT reach.contact, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT contact, min(other) AS group_key FROM reach GROUP BY contact
"""

QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches, "p3_found": p3_found, "p2_found": p2_found, "p2_survivors": p2_survivors, "p5_found": p5_found, "p7_found": p7_found, "p8_containers": p8_containers, "p9_found": p9_found, "p10_found": p10_found}
ORACLES = {"p3_found": P3_SQL, "p2_found": P2_SQL, "p2_survivors": P2_SURVIVORS_SQL, "p7_found": P7_SQL}
