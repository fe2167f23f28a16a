"""Text functions and writers over the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import tagging, text
from kinweave.plans.tables import table
from kinweave.queries.reports import _RULES, _TAGS
from kinweave.queries.views import registry
from kinweave.sources import files, sinks

QUERIES, ORACLES, query = registry()


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), {_TAGS}))), ',') AS tags FROM (SELECT id, tags, lower(trim(email)) AS a, split_part(lower(trim(email)), '@', 1) AS l, CASE WHEN contains(email, '@') THEN substr(lower(trim(email)), instr(lower(trim(email)), '@') + 1) END AS d FROM contacts)")
def contacts_tagged(spark, folder):
    tagged = tagging.tagged(table(spark, folder, "contacts").select("id", "email", "tags"), "email", "tags", rules=_RULES)
    return tagged.select("id", F.array_join("tags", ",").alias("tags"))


@query("SELECT entry_id, name FROM contact_entries WHERE regexp_matches(name, '[A-Z]') AND NOT regexp_matches(name, '^\\d{4}-\\d{2}-\\d{2}$') AND NOT starts_with(name, '#') AND NOT regexp_matches(name, '(?i)^[a-z_]+$') AND name <> '.md'")
def likely_contacts(spark, folder):
    return table(spark, folder, "contact_entries").where(files.likely_contact(F.col("name"))).select("entry_id", "name")


@query("SELECT entry_id, left(regexp_replace(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 50) AS slug FROM contact_entries WHERE name IS NOT NULL")
def entry_slugs(spark, folder):
    return table(spark, folder, "contact_entries").where("name IS NOT NULL").select("entry_id", sinks.slug(F.col("name")).alias("slug"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^---(?s:.*?)---', ''), chr(10))) AS line, unnest(range(1, len(string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^---(?s:.*?)---', ''), chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS lines, min(line_no) AS first_line, sum(length(line))::BIGINT AS chars FROM l WHERE trim(line) <> '' AND NOT starts_with(line, '#') GROUP BY 1""")
def body_profile(spark, folder):
    lines = text.body_lines(table(spark, folder, "documents"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"), F.sum(F.length("line")).alias("chars"))


@query("SELECT row_id, CASE WHEN length(s) > 40 THEN left(s, 37) || '...' ELSE s END AS summary FROM (SELECT row_id, regexp_replace(summary, '\\[\\[([^\\]|]+)(\\|[^\\]]*)?\\]\\]', '\\1', 'g') AS s FROM channel_interactions WHERE summary IS NOT NULL)")
def short_summaries(spark, folder):
    return table(spark, folder, "channel_interactions").where("summary IS NOT NULL").select("row_id", text.shortened(text.without_links(F.col("summary")), 40).alias("summary"))


@query("""
SELECT card_id, concat_ws(chr(10), 'BEGIN:VCARD', 'VERSION:3.0', CASE WHEN name <> '' THEN 'FN:' || name END, CASE WHEN len(emails) > 0 THEN array_to_string([CASE WHEN e.value IS NOT NULL THEN 'EMAIL:' || e.value END FOR e IN emails], chr(10)) END,
  CASE WHEN len(phones) > 0 THEN array_to_string(['TEL:' || p.value FOR p IN phones], chr(10)) END, CASE WHEN organization <> '' THEN 'ORG:' || organization END, CASE WHEN role <> '' THEN 'TITLE:' || role END, 'END:VCARD') AS card FROM vcards
WHERE len(list_filter(coalesce(emails, []), lambda e: e.value IS NULL)) = 0 AND len(list_filter(coalesce(phones, []), lambda p: p.value IS NULL)) = 0""")
def card_texts(spark, folder):
    v = table(spark, folder, "vcards").where("NOT exists(coalesce(emails, array()), e -> e.value IS NULL) AND NOT exists(coalesce(phones, array()), p -> p.value IS NULL)")
    return v.select("card_id", sinks.vcard_text(F.col("name"), F.col("emails.value"), F.col("phones.value"), F.col("organization"), F.col("role")).alias("card"))
