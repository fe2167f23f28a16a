"""Tags, follow-ups, insights and further reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import ranking, tagging, text
from kinweave.plans.tables import table
from kinweave.queries.views import registry

AS_OF = "2025-12-31"
QUERIES, ORACLES, query = registry()

# written out apart from the operator's rules: exact domains, patterns of domains, of what stands before the @, custom texts, top-level domains
_TAG_SQL = {
    "regexp_matches(d, '^(usv\\.com|a16z\\.com|pantera\\.capital|sequoiacap\\.com|paradigm\\.xyz|polychain\\.capital|dragonfly\\.xyz)$')": "investor vc",
    "regexp_matches(d, '^(google|microsoft|apple|amazon|meta)\\.com$')": "tech bigtech", "d IN ('ethereum.org', 'consensys.net')": "crypto ethereum", "d = 'protocol.ai'": "crypto filecoin",
    "regexp_matches(d, '^(paradigm\\.xyz|polychain\\.capital|dragonfly\\.xyz)$')": "crypto",
    "d IN ('edu', 'ac.uk') OR regexp_matches(d, '\\.edu$') OR regexp_matches(d, '\\.ac\\.')": "academic", "d IN ('gov', 'europa.eu') OR regexp_matches(d, '\\.gov(\\.|$)')": "government", "d = 'europa.eu'": "eu",
    "regexp_matches(d, '-law\\.') OR regexp_matches(d, '\\.legal\\.')": "legal", "regexp_matches(d, '\\.health$|^clinic|^doctor')": "medical", "regexp_matches(d, '\\.vc$|ventures\\.')": "investor vc", "regexp_matches(d, 'capital\\.')": "investor",
    "l IN ('newsletter', 'news', 'digest', 'weekly', 'daily', 'updates')": "newsletter", "l IN ('noreply', 'no-reply', 'notifications')": "automated", "l IN ('support', 'help')": "support", "l = 'sales'": "sales",
    "l IN ('info', 'hello', 'team')": "generic", "l IN ('marketing', 'pr')": "marketing", "l = 'pr'": "pr",
    "contains(a, 'ledger')": "ledger", "contains(a, 'robotics')": "hardware", "regexp_matches(a, 'owner\\d')": "owner",
    "regexp_matches(d, '(^|\\.)(io|xyz|eth)$')": "tech", "regexp_matches(d, '(^|\\.)edu$')": "academic", "regexp_matches(d, '(^|\\.)gov$')": "government",
}
_TAGS = "list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN d IS NOT NULL AND ({test}) THEN [{', '.join(repr(t) for t in tags.split())}] ELSE [] END" for test, tags in _TAG_SQL.items()) + "])))"
_TAGGED = "(SELECT *, lower(trim(from_email)) AS a, split_part(lower(trim(from_email)), '@', 1) AS l, CASE WHEN contains(from_email, '@') THEN substr(lower(trim(from_email)), instr(lower(trim(from_email)), '@') + 1) END AS d FROM emails WHERE from_email IS NOT NULL)"
#: The built-in rules and three of one's own, by texts in the address.
_RULES = [*tagging.RULES, ("custom", "ledger", "ledger"), ("custom", "robotics", "hardware"), *[("custom", f"owner{k}", "owner") for k in range(10)]]


@query(f"SELECT DISTINCT from_email, array_to_string({_TAGS}, ',') AS tags FROM {_TAGGED}")
def sender_tags(spark, folder):
    senders = table(spark, folder, "emails").where("from_email IS NOT NULL").select("from_email").distinct()
    return senders.select("from_email", F.array_join(tagging.tags_of(F.col("from_email"), _RULES), ",").alias("tags"))


@query(f"SELECT t AS tag, count(*) AS mails FROM (SELECT unnest({_TAGS}) AS t FROM {_TAGGED}) GROUP BY 1")
def tag_counts(spark, folder):
    mails = table(spark, folder, "emails").where("from_email IS NOT NULL")
    return mails.select(F.explode(tagging.tags_of(F.col("from_email"), _RULES)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("mails"))


@query("SELECT entry_id, CASE WHEN d > 90 THEN 'overdue' WHEN d > 83 THEN 'this_week' ELSE 'next_week' END AS queue FROM (SELECT entry_id, datediff('day', last_interaction, DATE '2025-10-31') AS d FROM contact_entries WHERE status = 'active') WHERE d > 76")
def follow_up_queue(spark, folder):
    d = F.datediff(F.lit("2025-10-31").cast("date"), F.col("last_interaction"))
    e = table(spark, folder, "contact_entries").where("status = 'active'").select("entry_id", d.alias("d")).where("d > 76")
    return e.select("entry_id", F.when(F.col("d") > 90, "overdue").when(F.col("d") > 83, "this_week").otherwise("next_week").alias("queue"))


@query("SELECT entry_id, name, location FROM contact_entries WHERE lower(location) = 'velmora' OR len(list_filter(tags, lambda t: contains(lower(t), 'velmora'))) > 0 OR contains(lower(organization), 'velmora')")
def location_search(spark, folder):
    hit = (F.lower("location") == "velmora") | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit("velmora"))) | F.contains(F.lower("organization"), F.lit("velmora"))
    return table(spark, folder, "contact_entries").where(hit).select("entry_id", "name", "location")


@query("SELECT lower(trim(name)) AS name, count(DISTINCT space) AS spaces, count(*) AS entries FROM contact_entries WHERE trim(coalesce(name, '')) <> '' GROUP BY 1 HAVING count(DISTINCT space) > 1")
def cross_space_names(spark, folder):
    e = table(spark, folder, "contact_entries").where("trim(coalesce(name, '')) <> ''")
    return e.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.count_distinct("space").alias("spaces"), F.count(F.lit(1)).alias("entries")).where("spaces > 1")


@query("SELECT organization, lower(role) AS role, count(*) AS people, min(entry_id) AS first_id FROM contact_entries WHERE organization IS NOT NULL AND role IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def same_role_groups(spark, folder):
    e = table(spark, folder, "contact_entries").where("organization IS NOT NULL AND role IS NOT NULL")
    return e.groupBy("organization", F.lower("role").alias("role")).agg(F.count(F.lit(1)).alias("people"), F.min("entry_id").alias("first_id")).where("people > 1")


@query("SELECT entry_id, channels.phone AS phone FROM contact_entries WHERE channels.phone <> '' AND coalesce(channels.email, '') = ''")
def phone_only_contacts(spark, folder):
    return table(spark, folder, "contact_entries").where("channels.phone <> '' AND coalesce(channels.email, '') = ''").select("entry_id", F.col("channels.phone").alias("phone"))


@query("""
WITH v AS (SELECT lower(from_name) AS who, lower(from_email) AS email, count(*) AS votes FROM emails WHERE from_name IS NOT NULL AND from_email IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY who ORDER BY votes DESC, email) AS k FROM v)
SELECT who, email, votes, round(least(1.0, votes / 5.0), 6) AS confidence FROM b WHERE k = 1""")
def discovered_addresses(spark, folder):
    v = table(spark, folder, "emails").where("from_name IS NOT NULL AND from_email IS NOT NULL").groupBy(F.lower("from_name").alias("who"), F.lower("from_email").alias("email")).agg(F.count(F.lit(1)).alias("votes"))
    # most votes, then the smallest address: an aggregate with map-side partials, no window
    best = v.groupBy("who").agg(F.min(F.struct((-F.col("votes")).alias("minus"), "email")).alias("x")).select("who", "x.email", (-F.col("x.minus")).alias("votes"))
    return best.select("who", "email", "votes", F.round(F.least(F.lit(1.0), F.col("votes") / 5), 6).alias("confidence"))


@query("""
SELECT 'community' AS kind, 'community ' || community_id AS title, count(*)::DOUBLE AS weight FROM contacts WHERE community_id IS NOT NULL GROUP BY community_id HAVING count(*) >= 3
UNION ALL SELECT * FROM (SELECT 'bridge', email, round(betweenness_centrality, 6) FROM (SELECT * FROM contacts ORDER BY degree_centrality DESC NULLS LAST, id LIMIT 10) WHERE betweenness_centrality > 0.01 AND NOT isnan(betweenness_centrality))
UNION ALL SELECT * FROM (SELECT 'reconnect', email, round(frequency_score, 6) FROM contacts WHERE last_seen < DATE '2025-06-30' AND frequency_score >= 0.5 AND reciprocity_score > 0.3 ORDER BY frequency_score DESC, id LIMIT 15)
UNION ALL SELECT 'pattern', CASE WHEN r > 0.6 THEN 'mostly sending' WHEN r < 0.4 THEN 'mostly receiving' ELSE 'balanced' END, round(r, 6) FROM (SELECT sum(sent_count) / sum(sent_count + received_count) AS r FROM contacts)""")
def insights(spark, folder):
    c = table(spark, folder, "contacts")
    groups = c.where("community_id IS NOT NULL").groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(F.lit("community").alias("kind"), F.concat(F.lit("community "), F.col("community_id").cast("string")).alias("title"), F.col("n").cast("double").alias("weight"))
    top = ranking.top_k(c, [F.col("degree_centrality").desc_nulls_last(), F.col("id")], 10)
    bridges = top.where("betweenness_centrality > 0.01 AND NOT isnan(betweenness_centrality)").select(F.lit("bridge").alias("kind"), F.col("email").alias("title"), F.round("betweenness_centrality", 6).alias("weight"))
    ratio = c.agg((F.sum("sent_count") / F.sum(F.col("sent_count") + F.col("received_count"))).alias("r"))
    pattern = ratio.select(F.lit("pattern").alias("kind"), F.when(F.col("r") > 0.6, "mostly sending").when(F.col("r") < 0.4, "mostly receiving").otherwise("balanced").alias("title"), F.round("r", 6).alias("weight"))
    away = ranking.top_k(c.where("last_seen < DATE'2025-06-30' AND frequency_score >= 0.5 AND reciprocity_score > 0.3"), [F.desc("frequency_score"), F.col("id")], 15)
    away = away.select(F.lit("reconnect").alias("kind"), F.col("email").alias("title"), F.round("frequency_score", 6).alias("weight"))
    return groups.unionByName(bridges).unionByName(away).unionByName(pattern)


_MEETING = r"\b(?:[Mm]et|[Cc]all with|[Mm]eeting with) ((?:Dr\. |Mr\. |Mrs\. |Prof\. )?[A-Z][A-Za-z.]+(?: [A-Z][A-Za-z]+)*)"


@query(f"SELECT who, count(*) AS meetings, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MEETING}', 1)) AS who FROM documents) GROUP BY 1")
def named_in_meetings(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MEETING.replace(r"\b", text.START)), F.lit(1))).alias("who")).groupBy("who").agg(F.count(F.lit(1)).alias("meetings"), F.count_distinct("doc_id").alias("documents"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]+'))) [1] AS first_address, len(regexp_extract_all(lower(text), '[a-z0-9._+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]+')) AS n FROM documents WHERE regexp_matches(lower(text), '[a-z0-9._+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]+')")
def document_addresses(spark, folder):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9._+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]+)"), F.lit(1))
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", found.alias("a")).where(F.size("a") > 0)
    return d.select("doc_id", F.array_min("a").alias("first_address"), F.size("a").cast("long").alias("n"))


@query("SELECT kind, source_group, count(*) AS documents, sum(n_chars)::BIGINT AS chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM (SELECT kind, split_part(source, '/', 1) AS source_group, n_chars FROM documents) GROUP BY 1, 2")
def document_profile(spark, folder):
    d = table(spark, folder, "documents").select("kind", F.split_part("source", F.lit("/"), F.lit(1)).alias("source_group"), "n_chars")
    return d.groupBy("kind", "source_group").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("SELECT entity_type, industry, n FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY n DESC, industry) AS k FROM (SELECT entity_type, i AS industry, count(*) AS n FROM (SELECT entity_type, unnest(suggested_industries) AS i FROM extracted_entities) WHERE i IS NOT NULL GROUP BY 1, 2)) WHERE k <= 5")
def industries_by_type(spark, folder):
    g = table(spark, folder, "extracted_entities").select("entity_type", F.explode("suggested_industries").alias("industry")).where("industry IS NOT NULL").groupBy("entity_type", "industry").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_k_per_group(g, ["entity_type"], [F.desc("n"), F.col("industry")], 5).select("entity_type", "industry", "n")
