"""Relationship queries over contacts, messages and notes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import entities, ranking, resolve, scoring, text
from kinweave.operators import registry as register
from kinweave.operators.dates import message_moments
from kinweave.plans.lineage import materialise
from kinweave.plans.skew import heavy_or_none, lookup_join
from kinweave.plans.tables import table
from kinweave.queries.messages import MOMENTS_SQL
from kinweave.queries.views import EM_SQL, IM_SQL, emails, interactions, registry

AS_OF = "2025-12-31"
SCORED_AT, SCORED_BEFORE = "2025-06-30", "2025-06-23"
QUERIES, ORACLES, query = registry()

_COUNTS = f"WITH {IM_SQL}, c AS (SELECT contact_id, count(*) FILTER (WHERE side = 'sent') AS sent, count(*) FILTER (WHERE side = 'received') AS received FROM im WHERE contact_id IS NOT NULL GROUP BY 1)"


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return interactions(spark, folder).where("contact_id IS NOT NULL").groupBy("contact_id").agg(F.count_if(F.col("side") == "sent").alias("sent"), F.count_if(F.col("side") == "received").alias("received"))


# --- scores and classes ---------------------------------------------------------------------------------------------

def _score_sql(name: str, as_of: str) -> str:
    """Scores of all contacts by name at a moment, as the table `name`, from the table x(contact, kind, at)."""
    return f"""
{name}_g AS (
  SELECT p.contact, count(x.kind) AS n, count(*) FILTER (WHERE x.at_s >= epoch(TIMESTAMP '{as_of}') - 30 * 86400) AS n_recent, max(x.at_s) AS last_at,
    coalesce(avg(CASE WHEN x.kind IS NULL THEN NULL WHEN x.kind = 'meeting' THEN 1.0 WHEN x.kind = 'call' THEN 0.8 WHEN x.kind = 'email' THEN 0.5 WHEN x.kind = 'message' THEN 0.4 ELSE 0.2 END), 0) AS depth
  FROM people p LEFT JOIN (SELECT * FROM x WHERE at_s IS NULL OR at_s <= epoch(TIMESTAMP '{as_of}')) x USING (contact) GROUP BY 1),
{name}_s AS (SELECT *, floor((epoch(TIMESTAMP '{as_of}') - last_at) / 86400)::BIGINT AS days_since FROM {name}_g),
{name}_r AS (SELECT *, coalesce(exp(-days_since / 30.0), 0) AS recency, least(n_recent / 4.0, 1.0) AS frequency FROM {name}_s),
{name}_f AS (SELECT *, 0.4 * recency + 0.3 * frequency + 0.2 * depth + 0.05 AS score FROM {name}_r),
{name} AS (SELECT *, CASE WHEN score > 0.7 THEN 'active' WHEN score > 0.5 THEN 'warming' WHEN score > 0.4 THEN 'cooling' ELSE 'dormant' END AS status FROM {name}_f)"""


_PEOPLE = f"""WITH {MOMENTS_SQL},
people AS (SELECT DISTINCT lower(trim(name)) AS contact FROM contacts WHERE trim(name) <> ''),
named AS (SELECT lower(trim(email)) AS email, min(lower(trim(name))) AS contact FROM contacts WHERE trim(name) <> '' AND trim(email) <> '' GROUP BY 1),
x AS (
  SELECT coalesce(n.contact, lower(trim(c.contact))) AS contact, coalesce(lower(trim(c.interaction_type)), '') AS kind, m.utc_second AS at_s
  FROM channel_interactions c JOIN m ON m.origin = 'channel_interactions' AND m.record_id = c.row_id LEFT JOIN named n ON n.email = lower(trim(c.contact)))"""
_SCORE = _PEOPLE + "," + _score_sql("f", SCORED_AT)


def _scores(spark: SparkSession, folder: str, as_of: str = SCORED_AT) -> DataFrame:
    # an interaction names its contact by name or by address; a contact is a name, with or without interactions up to as_of
    people = table(spark, folder, "contacts").select(F.lower(F.trim("name")).alias("contact"), F.lower(F.trim("email")).alias("who")).where("contact <> ''")
    named = people.where("who <> ''").groupBy("who").agg(F.min("contact").alias("named"))
    raw = table(spark, folder, "channel_interactions").select("mailbox_id", "date", F.lower(F.trim("contact")).alias("who"), F.lower(F.trim("interaction_type")).alias("kind"))
    heavy = heavy_or_none(raw, "who", raw.count())
    rows = message_moments(raw, table(spark, folder, "mailboxes"))
    rows = rows.where(F.col("utc_second").isNull() | (F.col("utc_second") <= F.unix_timestamp(F.lit(as_of).cast("timestamp"))))
    rows = lookup_join(rows.withColumn("moment", F.timestamp_seconds("utc_second")), "who", named, heavy)
    return scoring.relationship_scores(rows.withColumn("contact", F.coalesce("named", "who")), "contact", "moment", "kind", as_of, contacts=people.select("contact"))


@query(_SCORE + "SELECT contact, n, days_since, round(recency, 6) AS recency, round(frequency, 6) AS frequency, round(depth, 6) AS depth, round(score, 6) AS score, status FROM f")
def relationship_score(spark, folder):
    return _scores(spark, folder)


@query(_SCORE + "SELECT status, count(*) AS contacts, round(avg(round(score, 6)), 6) AS mean_score FROM f GROUP BY 1")
def score_status_summary(spark, folder):
    return _scores(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("contacts"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("""
WITH w AS (SELECT lower(coalesce(interaction_type, '')) AS k, contact FROM channel_interactions WHERE contact IS NOT NULL)
SELECT contact, count(*) AS n, round(avg(CASE k WHEN 'meeting' THEN 1.0 WHEN 'call' THEN 0.8 WHEN 'email' THEN 0.5 WHEN 'message' THEN 0.4 ELSE 0.2 END), 6) AS depth FROM w GROUP BY 1""")
def interaction_depth(spark, folder):
    rows = table(spark, folder, "channel_interactions").withColumn("moment", F.lit(None).cast("timestamp"))
    return scoring.relationship_scores(rows, "contact", "moment", "interaction_type", AS_OF).select("contact", "n", "depth")


@query(_PEOPLE + "," + _score_sql("f", SCORED_AT) + "," + _score_sql("g", SCORED_BEFORE) + " SELECT f.contact, round(f.score, 6) AS score, round(g.score, 6) AS before, CASE WHEN round(f.score, 6) > round(g.score, 6) THEN 'up' WHEN round(f.score, 6) < round(g.score, 6) THEN 'down' ELSE 'stable' END AS trend FROM f JOIN g USING (contact)")
def score_trend(spark, folder):
    # scores of this week beside those of the week before
    now, before = _scores(spark, folder), _scores(spark, folder, SCORED_BEFORE).select("contact", F.col("score").alias("before"))
    trend = F.when(F.col("score") > F.col("before"), "up").when(F.col("score") < F.col("before"), "down").otherwise("stable")
    return now.join(before, "contact").select("contact", "score", "before", trend.alias("trend"))


@query("""
SELECT email, round((sent_count + received_count) / (greatest(datediff('day', first_seen, DATE '2025-12-31'), 1) / 30.0), 6) AS frequency,
  round(CASE WHEN sent_count + received_count = 0 OR sent_count IS NULL OR received_count IS NULL THEN 0.0 ELSE 1.0 - 2 * abs(sent_count::DOUBLE / (sent_count + received_count) - 0.5) END, 6) AS reciprocity,
  round(pow(2.718, -datediff('day', last_seen, DATE '2025-12-31') / 90.0), 6) AS recency FROM contacts""")
def email_scores(spark, folder):
    return scoring.correspondence_metrics(table(spark, folder, "contacts"), AS_OF)


@query(_COUNTS + " SELECT CASE WHEN sent + received = 0 THEN 'unknown' WHEN sent::DOUBLE / (sent + received) > 0.7 THEN 'mostly_sent' WHEN sent::DOUBLE / (sent + received) < 0.3 THEN 'mostly_received' ELSE 'balanced' END AS direction, count(*) AS contacts, sum(sent + received)::BIGINT AS mails FROM c GROUP BY 1")
def direction_class(spark, folder):
    c = _counts(spark, folder).withColumn("direction", scoring.direction_class(F.col("sent"), F.col("received")))
    return c.groupBy("direction").agg(F.count(F.lit(1)).alias("contacts"), F.sum(F.col("sent") + F.col("received")).alias("mails"))


@query(_COUNTS + " SELECT CASE WHEN sent + received >= 50 THEN 'high' WHEN sent + received >= 10 THEN 'medium' WHEN sent + received >= 3 THEN 'low' ELSE 'minimal' END AS tier, count(*) AS contacts, sum(sent + received)::BIGINT AS mails FROM c GROUP BY 1")
def frequency_tier(spark, folder):
    c = _counts(spark, folder)
    return c.groupBy(scoring.frequency_tier(F.col("sent") + F.col("received")).alias("tier")).agg(F.count(F.lit(1)).alias("contacts"), F.sum(F.col("sent") + F.col("received")).alias("mails"))


@query("SELECT CASE WHEN last_seen IS NULL THEN 'unknown' WHEN d <= 14 THEN 'active' WHEN d <= 30 THEN 'warming' WHEN d <= 60 THEN 'cooling' ELSE 'dormant' END AS status, count(*) AS contacts FROM (SELECT last_seen, datediff('day', last_seen, DATE '2025-12-31') AS d FROM contacts) GROUP BY 1")
def recency_status(spark, folder):
    days = F.datediff(F.lit(AS_OF).cast("date"), F.col("last_seen"))
    return table(spark, folder, "contacts").groupBy(scoring.recency_status(days).alias("status")).agg(F.count(F.lit(1)).alias("contacts"))


@query(_COUNTS + " SELECT contact_id, round(coalesce(least(sent, received)::DOUBLE / nullif(greatest(sent, received), 0), 0.0), 6) AS reciprocity FROM c")
def reciprocity_minmax(spark, folder):
    return _counts(spark, folder).select("contact_id", F.round(scoring.reciprocity_minmax(F.col("sent"), F.col("received")), 6).alias("reciprocity"))


# --- top-k and lookups ------------------------------------------------------------------------------------------------

def _top(by):
    return lambda spark, folder: ranking.top_k(table(spark, folder, "contacts").where("sent_count + received_count > 0").select("id", "email", by), [F.col(by).desc_nulls_last(), F.col("id")], 50)


for _name, _by in (("frequency", "frequency_score"), ("recency", "recency_score"), ("centrality", "degree_centrality")):
    QUERIES[f"top_contacts_{_name}"] = _top(_by)
    ORACLES[f"top_contacts_{_name}"] = f"SELECT id, email, {_by} FROM contacts WHERE sent_count + received_count > 0 ORDER BY {_by} DESC NULLS LAST, id LIMIT 50"


@query("SELECT id, email, sent_count + received_count AS total FROM contacts WHERE sent_count + received_count > 0 ORDER BY total DESC, id LIMIT 50")
def top_contacts_total(spark, folder):
    return ranking.top_k(table(spark, folder, "contacts").select("id", "email", (F.col("sent_count") + F.col("received_count")).alias("total")).where("total > 0"), [F.desc("total"), F.col("id")], 50)


@query("SELECT id, email, frequency_score, reciprocity_score FROM contacts WHERE last_seen < DATE '2025-06-30' AND frequency_score >= 0.5 AND reciprocity_score > 0.3 ORDER BY frequency_score DESC, id LIMIT 20")
def reconnection_candidates(spark, folder):
    c = table(spark, folder, "contacts").where("last_seen < DATE'2025-06-30' AND frequency_score >= 0.5 AND reciprocity_score > 0.3")
    return ranking.top_k(c.select("id", "email", "frequency_score", "reciprocity_score"), [F.desc("frequency_score"), F.col("id")], 20)


@query("(SELECT id, email, 'sent' AS side, sent_count, received_count FROM contacts WHERE sent_count > 3 * received_count AND sent_count >= 5 ORDER BY sent_count DESC, id LIMIT 50) UNION ALL (SELECT id, email, 'received', sent_count, received_count FROM contacts WHERE received_count > 3 * sent_count AND received_count >= 5 ORDER BY received_count DESC, id LIMIT 50)")
def one_way_contacts(spark, folder):
    c = table(spark, folder, "contacts")
    side = lambda a, b, name: ranking.top_k(c.where((F.col(a) > 3 * F.col(b)) & (F.col(a) >= 5)).select("id", "email", F.lit(name).alias("side"), "sent_count", "received_count"), [F.desc(a), F.col("id")], 50)
    return side("sent_count", "received_count", "sent").unionByName(side("received_count", "sent_count", "received"))


@query("SELECT id, email, sent_count + received_count AS total FROM contacts WHERE sent_count + received_count >= 5 AND community_id = 1 AND lower(domain) <> 'gmail.com' ORDER BY total DESC, id LIMIT 50")
def contact_filter(spark, folder):
    # all conditions are optional; here: a least total, a community and an excluded domain
    c = table(spark, folder, "contacts").withColumn("total", F.col("sent_count") + F.col("received_count"))
    return ranking.top_k(c.where((F.col("total") >= 5) & (F.col("community_id") == 1) & (F.lower("domain") != "gmail.com")).select("id", "email", "total"), [F.desc("total"), F.col("id")], 50)


@query("SELECT id, email, name FROM contacts WHERE email ILIKE '%vel%' OR name ILIKE '%vel%' OR domain ILIKE '%vel%' OR len(list_filter(topics, lambda t: t ILIKE '%vel%')) > 0")
def contact_search(spark, folder):
    hit = F.col("email").ilike("%vel%") | F.col("name").ilike("%vel%") | F.col("domain").ilike("%vel%") | F.exists("topics", lambda t: t.ilike("%vel%"))
    return table(spark, folder, "contacts").where(hit).select("id", "email", "name")


@query("SELECT entry_id, name FROM (SELECT entry_id, name, CASE WHEN lower(name) = 'ana' THEN 0 WHEN contains(lower(name), 'ana') THEN 1 END AS r FROM contact_entries) WHERE r IS NOT NULL ORDER BY r, name, entry_id LIMIT 1")
def contact_lookup_fallback(spark, folder):
    low = F.lower("name")
    hits = table(spark, folder, "contact_entries").select("entry_id", "name", F.when(low == "ana", 0).when(low.contains("ana"), 1).alias("r")).where("r IS NOT NULL")
    return ranking.top_k(hits, [F.col("r"), F.col("name"), F.col("entry_id")], 1).select("entry_id", "name")


@query("SELECT entry_id, coalesce(datediff('day', last_interaction, DATE '2025-12-31'), 999) AS days_since FROM contact_entries WHERE status = 'dormant'")
def attention_needed(spark, folder):
    days = F.coalesce(F.datediff(F.lit(AS_OF).cast("date"), F.col("last_interaction")), F.lit(999)).cast("long")
    return table(spark, folder, "contact_entries").where("status = 'dormant'").select("entry_id", days.alias("days_since")).orderBy(F.desc("days_since"), "entry_id")


@query("SELECT entry_id, name FROM contact_entries WHERE name IS NOT NULL ORDER BY name, entry_id")
def index_by_name(spark, folder):
    return table(spark, folder, "contact_entries").where("name IS NOT NULL").select("entry_id", "name").orderBy("name", "entry_id")


@query("SELECT entry_id, name, space FROM contact_entries WHERE lower(trim(status)) = 'draft'")
def draft_entries(spark, folder):
    return table(spark, folder, "contact_entries").where(F.lower(F.trim("status")) == "draft").select("entry_id", "name", "space")


@query("SELECT entry_id, name, interaction_count FROM contact_entries WHERE lower(trim(status)) = 'dormant' AND interaction_count >= 5 ORDER BY interaction_count DESC, entry_id LIMIT 30")
def dormant_high_value(spark, folder):
    e = table(spark, folder, "contact_entries").where((F.lower(F.trim("status")) == "dormant") & (F.col("interaction_count") >= 5))
    return ranking.top_k(e.select("entry_id", "name", "interaction_count"), [F.desc("interaction_count"), F.col("entry_id")], 30)


@query("SELECT entry_id, name, last_interaction::VARCHAR AS last_interaction FROM contact_entries WHERE last_interaction BETWEEN DATE '2025-06-23' AND DATE '2025-06-30'")
def recent_entries(spark, folder):
    # the seven days up to the date of the report
    return table(spark, folder, "contact_entries").where("last_interaction BETWEEN DATE'2025-06-23' AND DATE'2025-06-30'").select("entry_id", "name", F.col("last_interaction").cast("string").alias("last_interaction"))


@query("SELECT domain, id, email, total, rank FROM (SELECT domain, id, email, sent_count + received_count AS total, row_number() OVER (PARTITION BY domain ORDER BY sent_count + received_count DESC NULLS LAST, id) AS rank FROM contacts) WHERE rank <= 3")
def contact_rank_in_domain(spark, folder):
    c = table(spark, folder, "contacts").select("domain", "id", "email", (F.col("sent_count") + F.col("received_count")).alias("total"))
    return ranking.top_k_per_group(c, ["domain"], [F.col("total").desc_nulls_last(), F.col("id")], 3)


# --- aggregates -------------------------------------------------------------------------------------------------------

@query("SELECT (SELECT count(*) FROM contacts) AS contacts, (SELECT count(*) FROM interactions) AS interactions, (SELECT count(DISTINCT thread_id) FROM interactions) AS threads, count(DISTINCT community_id) AS communities, count(*) FILTER (WHERE is_sensitive) AS sensitive, coalesce(sum(sent_count), 0)::BIGINT AS sent, coalesce(sum(received_count), 0)::BIGINT AS received FROM contacts")
def global_stats(spark, folder):
    c = table(spark, folder, "contacts").agg(F.count(F.lit(1)).alias("contacts"), F.count_distinct("community_id").alias("communities"), F.count_if("is_sensitive").alias("sensitive"), F.coalesce(F.sum("sent_count"), F.lit(0)).alias("sent"), F.coalesce(F.sum("received_count"), F.lit(0)).alias("received"))
    return c.crossJoin(table(spark, folder, "interactions").agg(F.count(F.lit(1)).alias("interactions"), F.count_distinct("thread_id").alias("threads")))


@query("SELECT status, space, contact_type, count(*) AS entries FROM contact_entries GROUP BY ALL")
def index_summary(spark, folder):
    return table(spark, folder, "contact_entries").groupBy("status", "space", "contact_type").agg(F.count(F.lit(1)).alias("entries"))


@query(f"WITH {IM_SQL} SELECT contact_id, strftime(day, '%Y-%m') AS month, count(*) AS n FROM im WHERE contact_id IS NOT NULL AND at_s IS NOT NULL GROUP BY 1, 2")
def monthly_counts(spark, folder):
    return interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL").groupBy("contact_id", F.date_format("moment", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT domain, count(*) AS contacts, sum(sent_count + received_count)::BIGINT AS total FROM contacts GROUP BY 1 ORDER BY total DESC NULLS LAST, domain LIMIT 30")
def domain_rollup(spark, folder):
    g = table(spark, folder, "contacts").groupBy("domain").agg(F.count(F.lit(1)).alias("contacts"), F.sum(F.col("sent_count") + F.col("received_count")).alias("total"))
    return ranking.top_k(g, [F.col("total").desc_nulls_last(), F.col("domain")], 30)


def _case(column: str, classes, other: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce({column}, '')), '{w}')" for w in words) + f" THEN '{name}'" for name, words in classes)
    return f"CASE {whens} ELSE '{other}' END"


@query(f"WITH {EM_SQL}, t AS (SELECT CASE WHEN k <> 'personal' THEN k WHEN contains(lower(coalesce(from_name, '')), 'via zapier') OR (contains(from_email, '@home.') AND contains(lower(from_name), 'via')) THEN 'forwarded' ELSE 'personal' END AS kind FROM (SELECT *, {_case('from_email', text.SENDER_PATTERNS, 'personal')} AS k FROM em)) SELECT kind, count(*) AS mails, round(count(*) / (SELECT count(*) FROM t), 6) AS share FROM t GROUP BY 1")
def sender_type_share(spark, folder):
    g = emails(spark, folder).groupBy(text.sender_type(F.col("from_email"), F.col("from_name"), "home.").alias("kind")).agg(F.count(F.lit(1)).alias("mails"))
    return ranking.with_share(g, "mails")


@query(f"SELECT {_case('summary', text.INTERACTION_WORDS, 'mention')} AS kind, count(*) AS n FROM channel_interactions GROUP BY 1")
def interaction_kinds(spark, folder):
    return table(spark, folder, "channel_interactions").groupBy(text.interaction_kind(F.col("summary")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {EM_SQL},
t AS (SELECT thread, count(*) AS messages, min(at_s) AS first_at, max(at_s) AS last_at, arg_min(subject, (at_s, email_id)) FILTER (WHERE subject IS NOT NULL AND at_s IS NOT NULL) AS subject FROM em WHERE thread IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
p AS (SELECT DISTINCT thread, unnest(list_concat([from_email], to_emails, cc_emails)) AS who FROM em WHERE thread IS NOT NULL),
n AS (SELECT thread, count(*) AS participants, array_to_string(list_sort(list(who))[1:5], ',') AS who FROM p WHERE who <> '' GROUP BY 1)
SELECT t.*, coalesce(n.participants, 0) AS participants, n.who FROM t LEFT JOIN n USING (thread)""")
def thread_rollup(spark, folder):
    # read three times
    mails = materialise(emails(spark, folder).where("thread IS NOT NULL").select("thread", "email_id", "at_s", "subject", "from_email", "to_emails", "cc_emails"), "mails")
    threads = mails.groupBy("thread").agg(F.count(F.lit(1)).alias("messages"), F.min("at_s").alias("first_at"), F.max("at_s").alias("last_at"), F.min_by("subject", F.when(F.col("subject").isNotNull() & F.col("at_s").isNotNull(), F.struct("at_s", "email_id"))).alias("subject")).where("messages >= 2")
    people = mails.select("thread", F.explode(F.concat(F.array("from_email"), "to_emails", "cc_emails")).alias("who")).where("who <> ''").distinct()
    # five names stand for a thread, so a mailing list's participants are counted but never gathered
    sizes = people.groupBy("thread").agg(F.count(F.lit(1)).alias("participants"))
    named = ranking.top_k_per_group(people, ["thread"], [F.col("who")], 5).groupBy("thread").agg(F.array_join(F.sort_array(F.collect_list("who")), ",").alias("who"))
    return threads.join(sizes, "thread", "left").join(named, "thread", "left").withColumn("participants", F.coalesce("participants", F.lit(0)))


@query(f"WITH {IM_SQL}, t AS (SELECT contact_id, thread, count(*) AS n, max(at_s) AS last_at, arg_min(subject, (at_s, id)) FILTER (WHERE subject IS NOT NULL AND at_s IS NOT NULL) AS subject FROM im WHERE contact_id IS NOT NULL AND thread IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2) SELECT contact_id, thread, n, rank, left(trim(regexp_replace(subject, '^(?i)(re:|fwd?:|fw:)\\s*', '')), 60) AS subject FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY n DESC, last_at DESC NULLS LAST, thread) AS rank FROM t) WHERE rank <= 5")
def key_threads_topk(spark, folder):
    rows = interactions(spark, folder).where("contact_id IS NOT NULL AND thread IS NOT NULL")
    t = rows.groupBy("contact_id", "thread").agg(F.count(F.lit(1)).alias("n"), F.max("at_s").alias("last_at"), F.min_by("subject", F.when(F.col("subject").isNotNull() & F.col("at_s").isNotNull(), F.struct("at_s", "id"))).alias("subject")).where("n >= 2")
    top = ranking.top_k_per_group(t, ["contact_id"], [F.desc("n"), F.col("last_at").desc_nulls_last(), F.col("thread")], 5)
    return top.select("contact_id", "thread", "n", "rank", F.substring(F.trim(F.regexp_replace("subject", r"^(?i)(re:|fwd?:|fw:)\s*", "")), 1, 60).alias("subject"))


@query(f"""
WITH {EM_SQL},
a AS (SELECT from_email AS email, from_name AS name, at_s, email_id, 1 AS f, 0 AS t FROM em UNION ALL SELECT unnest(list_distinct(list_concat(to_emails, cc_emails))), NULL, at_s, email_id, 0, 1 FROM em)
SELECT email, sum(f)::BIGINT AS from_count, sum(t)::BIGINT AS to_count, min(at_s) AS first_at, max(at_s) AS last_at, arg_max(trim(name), (at_s, email_id)) FILTER (WHERE trim(name) <> '' AND at_s IS NOT NULL) AS name FROM a WHERE email <> '' GROUP BY 1""")
def contact_counters(spark, folder):
    e = emails(spark, folder)
    sent = e.select(F.col("from_email").alias("email"), F.col("from_name").alias("name"), "at_s", "email_id", F.lit(1).alias("f"), F.lit(0).alias("t"))
    got = e.select(F.explode(F.array_distinct(F.concat("to_emails", "cc_emails"))).alias("email"), F.lit(None).cast("string").alias("name"), "at_s", "email_id", F.lit(0).alias("f"), F.lit(1).alias("t"))
    named = F.when((F.trim("name") != "") & F.col("at_s").isNotNull(), F.struct("at_s", "email_id"))
    return sent.unionByName(got).where("email <> ''").groupBy("email").agg(F.sum("f").alias("from_count"), F.sum("t").alias("to_count"), F.min("at_s").alias("first_at"), F.max("at_s").alias("last_at"), F.max_by(F.trim("name"), named).alias("name"))


@query("SELECT channel, coalesce(interaction_type, '(none)') AS interaction_type, count(*) AS n, count(DISTINCT contact) AS contacts FROM channel_interactions GROUP BY 1, 2")
def channel_activity(spark, folder):
    return table(spark, folder, "channel_interactions").groupBy("channel", F.coalesce("interaction_type", F.lit("(none)")).alias("interaction_type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("contact").alias("contacts"))


@query("SELECT channel, n FROM (SELECT channel, count(*) AS n FROM channel_interactions GROUP BY 1 UNION ALL SELECT 'interactions', count(*) FROM interactions UNION ALL SELECT 'emails', count(*) FROM emails)")
def union_channels(spark, folder):
    parts = [table(spark, folder, "channel_interactions").select("channel"), table(spark, folder, "interactions").select(F.lit("interactions").alias("channel")), table(spark, folder, "emails").select(F.lit("emails").alias("channel"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT *, coalesce(sent_count, 0) + coalesce(received_count, 0) AS total FROM contacts WHERE community_id IS NOT NULL),
d AS (SELECT community_id, domain, count(*) AS n FROM c WHERE domain <> '' GROUP BY 1, 2),
dr AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY n DESC, domain) AS k FROM d),
tops AS (SELECT community_id, list(domain ORDER BY k) AS domains FROM dr WHERE k <= 5 GROUP BY 1),
sr AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY total DESC, id) AS k FROM c),
samples AS (SELECT community_id, string_agg(email, ',' ORDER BY k) AS samples FROM sr WHERE k <= 10 GROUP BY 1),
sizes AS (SELECT community_id, count(*) AS members FROM c GROUP BY 1)
SELECT community_id, members, array_to_string(domains, ',') AS domains, samples,
  CASE WHEN s.j LIKE '%law%' OR s.j LIKE '%legal%' THEN 'Legal Contacts' WHEN s.j LIKE '%.vc%' OR s.j LIKE '%capital%' OR s.j LIKE '%ventures%' OR s.j LIKE '%usv%' THEN 'Investors & VCs'
    WHEN s.j LIKE '%.edu%' OR s.j LIKE '%university%' OR s.j LIKE '%research%' THEN 'Academic Network' WHEN s.j LIKE '%gmail%' OR s.j LIKE '%yahoo%' OR s.j LIKE '%outlook%' THEN 'Personal Contacts'
    ELSE upper(left(split_part(domains[1], '.', 1), 1)) || lower(substr(split_part(domains[1], '.', 1), 2)) || ' Network' END AS theme
FROM sizes LEFT JOIN tops USING (community_id) LEFT JOIN samples USING (community_id) LEFT JOIN (SELECT community_id, array_to_string(domains, ' ') AS j FROM tops) s USING (community_id)""")
def community_rollup(spark, folder):
    c = table(spark, folder, "contacts").where("community_id IS NOT NULL").withColumn("total", F.coalesce("sent_count", F.lit(0)) + F.coalesce("received_count", F.lit(0)))
    domains = c.where("domain <> ''").groupBy("community_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    # only five domains and ten samples of a community are ever put together
    tops = ranking.top_k_per_group(domains, ["community_id"], [F.desc("n"), F.col("domain")], 5).groupBy("community_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "domain"))), lambda x: x.domain).alias("d"))
    samples = ranking.top_k_per_group(c.select("community_id", "id", "email", "total"), ["community_id"], [F.desc("total"), F.col("id")], 10).groupBy("community_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "email"))), lambda x: x.email), ",").alias("samples"))
    sizes = c.groupBy("community_id").agg(F.count(F.lit(1)).alias("members"))
    return sizes.join(tops, "community_id", "left").join(samples, "community_id", "left").select("community_id", "members", F.array_join("d", ",").alias("domains"), "samples", text.theme_of(F.col("d")).alias("theme"))


@query("SELECT regexp_replace(regexp_replace(regexp_replace(trim(lower(t)), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS tag, count(*) AS n FROM (SELECT unnest(tags) AS t FROM contact_entries) WHERE t IS NOT NULL GROUP BY 1")
def industry_tag_counts(spark, folder):
    return table(spark, folder, "contact_entries").select(F.explode("tags").alias("t")).where("t IS NOT NULL").groupBy(text.kebab(F.col("t")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(entity_type, 'unknown') AS entity_type, count(*) AS n, count(*) FILTER (WHERE confidence > 0.8) AS high, count(*) FILTER (WHERE confidence BETWEEN 0.5 AND 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5) AS low FROM extracted_entities GROUP BY 1")
def extraction_summary(spark, folder):
    c = F.col("confidence")
    return table(spark, folder, "extracted_entities").groupBy(F.coalesce("entity_type", F.lit("unknown")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c > 0.8).alias("high"), F.count_if(c.between(0.5, 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"))


@query("SELECT r.tag, coalesce(n, 0) AS uses FROM industry_registry r LEFT JOIN (SELECT t, count(*) AS n FROM (SELECT unnest(tags) AS t FROM contact_entries) GROUP BY 1) u ON u.t = r.tag")
def registry_counts(spark, folder):
    uses = table(spark, folder, "contact_entries").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "industry_registry").select("tag").join(uses, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("uses"))


@query("SELECT organization, count(*) AS people, max(last_interaction)::VARCHAR AS last_interaction, sum(interaction_count)::BIGINT AS interactions FROM contact_entries WHERE organization IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def company_rollup(spark, folder):
    return table(spark, folder, "contact_entries").where("organization IS NOT NULL").groupBy("organization").agg(F.count(F.lit(1)).alias("people"), F.max("last_interaction").cast("string").alias("last_interaction"), F.sum("interaction_count").alias("interactions")).where("people >= 2")


@query("SELECT contact, channels, n FROM (SELECT contact, count(DISTINCT channel) AS channels, count(*) AS n FROM channel_interactions WHERE contact IS NOT NULL GROUP BY 1) WHERE channels >= 2")
def multi_channel_contacts(spark, folder):
    return table(spark, folder, "channel_interactions").where("contact IS NOT NULL").groupBy("contact").agg(F.count_distinct("channel").alias("channels"), F.count(F.lit(1)).alias("n")).where("channels >= 2")


@query("SELECT e.entity_id, e.doc_id, e.name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name), entity_type ORDER BY confidence DESC NULLS LAST, entity_id) AS k FROM extracted_entities WHERE name IS NOT NULL) e WHERE k = 1")
def entity_keep_best(spark, folder):
    e = table(spark, folder, "extracted_entities").where("name IS NOT NULL").withColumn("low", F.lower("name"))
    return resolve.keep_best(e, ["low", "entity_type"], "confidence", "entity_id").select("entity_id", "doc_id", "name")


@query("SELECT name, count(*) AS mentions FROM extracted_entities WHERE name IS NOT NULL AND lower(name) NOT IN (SELECT lower(name) FROM contact_entries WHERE name IS NOT NULL) GROUP BY 1")
def new_name_detection(spark, folder):
    known = table(spark, folder, "contact_entries").where("name IS NOT NULL").select(F.lower("name").alias("low")).distinct()
    # counted before the join, so that a name in very many documents is one row of it
    counted = table(spark, folder, "extracted_entities").where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))
    return counted.withColumn("low", F.lower("name")).join(known, "low", "left_anti").select("name", "mentions")


@query("SELECT DISTINCT p AS source_file FROM (SELECT unnest([keep, merge_from]) AS p FROM merge_previews) WHERE p NOT IN (SELECT source_file FROM contact_entries) UNION SELECT DISTINCT p FROM (SELECT unnest([contact1, contact2]) AS p FROM duplicate_pairs) WHERE p IS NOT NULL AND p NOT IN (SELECT source_file FROM contact_entries)")
def broken_links(spark, folder):
    named = table(spark, folder, "merge_previews").select(F.explode(F.array("keep", "merge_from")).alias("source_file")).unionByName(table(spark, folder, "duplicate_pairs").select(F.explode(F.array("contact1", "contact2")).alias("source_file")))
    return named.where("source_file IS NOT NULL").distinct().join(table(spark, folder, "contact_entries").select("source_file"), "source_file", "left_anti")


# --- entity resolution ------------------------------------------------------------------------------------------------

@query()
def similar_entities(spark, folder):
    return resolve.similar_names(table(spark, folder, "extracted_entities"), "entity_id", "entity_type", "name", 0.7)


@query()
def entry_duplicates(spark, folder):
    return resolve.duplicate_pairs(table(spark, folder, "contact_entries"), "entry_id", "contact_type", "name", "organization", ["channels.email", "channels.linkedin", "channels.telegram"])


@query("""
WITH n AS (SELECT entry_id AS key, lower(coalesce(contact_type, '')) AS kind, lower(trim(coalesce(name, ''))) AS name FROM contact_entries)
SELECT key, min(key) OVER (PARTITION BY kind, name) AS class_key FROM n WHERE name <> ''""")
def exact_name_classes(spark, folder):
    return resolve.exact_groups(table(spark, folder, "contact_entries"), "entry_id", "contact_type", "name")


_STAGES = """
le AS (SELECT card_id, unnest(range(len(emails))) AS place, lower(trim(unnest(emails).value)) AS v FROM vcards), re AS (SELECT min(resource_name) AS resource_name, v FROM (SELECT resource_name, lower(trim(unnest(emails))) AS v FROM google_contacts) WHERE v <> '' GROUP BY v),
lp AS (SELECT card_id, unnest(range(len(phones))) AS place, regexp_replace(unnest(phones).value, '[\\s().+-]', '', 'g') AS v FROM vcards), rp AS (SELECT min(resource_name) AS resource_name, v FROM (SELECT resource_name, regexp_replace(unnest(phones), '[\\s().+-]', '', 'g') AS v FROM google_contacts) WHERE v <> '' GROUP BY v),
ln AS (SELECT card_id, lower(trim(name)) || '|' || lower(trim(organization)) AS v FROM vcards WHERE trim(name) <> '' AND trim(organization) <> ''), rn AS (SELECT min(resource_name) AS resource_name, lower(trim(name)) || '|' || lower(trim(organization)) AS v FROM google_contacts WHERE trim(name) <> '' AND trim(organization) <> '' GROUP BY 2)"""


@query(f"""
WITH {_STAGES},
m AS (
  SELECT card_id, resource_name, 0 AS k, place, 'email' AS stage, 1.0 AS confidence FROM le JOIN re USING (v)
  UNION ALL SELECT card_id, resource_name, 1, place, 'phone', 0.95 FROM lp JOIN rp USING (v)
  UNION ALL SELECT card_id, resource_name, 2, 0, 'name_organization', 0.85 FROM ln JOIN rn USING (v))
SELECT card_id, resource_name, stage, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY k, place, resource_name) AS n FROM m) WHERE n = 1""")
def staged_match(spark, folder):
    return resolve.staged_match(*_sides(spark, folder), "card_id", "resource_name", _STAGE_COLUMNS)


@query(f"""
WITH {_STAGES},
m AS (SELECT card_id, min(k) AS k FROM (SELECT card_id, 0 AS k FROM le JOIN re USING (v) UNION ALL SELECT card_id, 1 FROM lp JOIN rp USING (v) UNION ALL SELECT card_id, 2 FROM ln JOIN rn USING (v)) GROUP BY 1)
SELECT card_id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'nameless' WHEN m.k <= 1 THEN 'known' WHEN m.k = 2 THEN 'review' ELSE 'new' END AS outcome FROM vcards LEFT JOIN m USING (card_id)""")
def import_outcomes(spark, folder):
    # every card of an import once: known by address or number, to be looked at, or new
    found = resolve.staged_match(*_sides(spark, folder), "card_id", "resource_name", _STAGE_COLUMNS).select("card_id", "stage")
    outcome = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "nameless").when(F.col("stage").isin("email", "phone"), "known").when(F.col("stage").isNotNull(), "review").otherwise("new")
    return table(spark, folder, "vcards").select("card_id", "name").join(found, "card_id", "left").select("card_id", outcome.alias("outcome"))


_STAGE_COLUMNS = [("emails", "email", 1.0), ("phones", "phone", 0.95), ("firms", "name_organization", 0.85)]


def _sides(spark, folder):
    """Cards and address-book contacts with all their addresses, numbers and the name with its organization."""
    phone = lambda x: F.regexp_replace(x, r"(?U)[\s\-.()+]", "")
    email = lambda x: F.lower(F.trim(x))
    firm = F.when((F.trim("organization") != "") & (F.trim("name") != ""), F.array(F.concat_ws("|", F.lower(F.trim("name")), F.lower(F.trim("organization"))))).alias("firms")
    left = table(spark, folder, "vcards").select("card_id", "name", F.transform("emails.value", email).alias("emails"), F.transform("phones.value", phone).alias("phones"), firm)
    right = table(spark, folder, "google_contacts").select("resource_name", "name", F.transform("emails", email).alias("emails"), F.transform("phones", phone).alias("phones"), firm)
    return left, right


@query()
def card_duplicates(spark, folder):
    # staged_match and a last stage of similar names, which has no SQL, as DuckDB's distance counts bytes
    return resolve.duplicate_check(*_sides(spark, folder), "card_id", "resource_name", _STAGE_COLUMNS, "name")


@query("""
WITH p AS (SELECT DISTINCT keep AS a, merge_from AS b FROM merge_previews),
f AS (SELECT source_file, updated, tags, {'name': name, 'organization': organization, 'role': role, 'location': location} AS v FROM contact_entries),
j AS (SELECT a, b, coalesce(y.updated > coalesce(x.updated, ''), false) AS t, x.v AS vx, y.v AS vy, coalesce(x.tags, []) AS tx, coalesce(y.tags, []) AS ty FROM p JOIN f x ON x.source_file = a JOIN f y ON y.source_file = b),
k AS (SELECT a, b, t, CASE WHEN t THEN vy ELSE vx END AS m, CASE WHEN t THEN vx ELSE vy END AS o, CASE WHEN t THEN ty ELSE tx END AS tm, CASE WHEN t THEN tx ELSE ty END AS other FROM j),
r AS (
  SELECT a, b, CASE WHEN t THEN b ELSE a END AS keep,
    concat_ws(',', CASE WHEN coalesce(m.name, '') = '' AND coalesce(o.name, '') <> '' THEN 'name' END, CASE WHEN coalesce(m.organization, '') = '' AND coalesce(o.organization, '') <> '' THEN 'organization' END, CASE WHEN coalesce(m.role, '') = '' AND coalesce(o.role, '') <> '' THEN 'role' END, CASE WHEN coalesce(m.location, '') = '' AND coalesce(o.location, '') <> '' THEN 'location' END) AS filled,
    concat_ws(',', CASE WHEN m.name <> '' AND o.name <> '' AND m.name <> o.name THEN 'name' END, CASE WHEN m.organization <> '' AND o.organization <> '' AND m.organization <> o.organization THEN 'organization' END, CASE WHEN m.role <> '' AND o.role <> '' AND m.role <> o.role THEN 'role' END, CASE WHEN m.location <> '' AND o.location <> '' AND m.location <> o.location THEN 'location' END) AS conflicts,
    CASE WHEN len(list_filter(other, lambda x: NOT list_contains(tm, x))) > 0 THEN 'tags' ELSE '' END AS united FROM k)
SELECT *, conflicts <> '' AS action_required FROM r""")
def merge_preview(spark, folder):
    pairs = table(spark, folder, "merge_previews").select(F.col("keep").alias("a"), F.col("merge_from").alias("b")).distinct()
    return resolve.merge_pairs(pairs, table(spark, folder, "contact_entries"), "source_file", ["name", "organization", "role", "location"], "updated", ["tags"])


@query("""
SELECT entry_id AS key, 'incomplete' AS issue, 'name' AS field FROM contact_entries WHERE coalesce(trim(name), '') = ''
UNION ALL SELECT entry_id, 'incomplete', 'space' FROM contact_entries WHERE coalesce(trim(space), '') = ''
UNION ALL SELECT entry_id, 'invalid', 'status' FROM contact_entries WHERE trim(status) <> '' AND status NOT IN ('active', 'draft', 'dormant', 'archived')
UNION ALL SELECT entry_id, 'stale', 'last_interaction' FROM contact_entries WHERE datediff('day', last_interaction, DATE '2025-12-31') > 180""")
def validation_issues(spark, folder):
    return resolve.validation_issues(table(spark, folder, "contact_entries"), "entry_id", ["name", "space"], {"status": ["active", "draft", "dormant", "archived"]}, "last_interaction", AS_OF)


@query("SELECT a.tag AS a, b.tag AS b, levenshtein(a.tag, b.tag)::INT AS d FROM industry_registry a JOIN industry_registry b ON a.tag < b.tag WHERE levenshtein(a.tag, b.tag) < 4")
def registry_potential_merges(spark, folder):
    return register.near_tags(table(spark, folder, "industry_registry"), "tag", 4).where("a < b").select("a", "b", F.col("edits").alias("d"))


# --- text -------------------------------------------------------------------------------------------------------------

# written out apart from the operator's list
_STOP = ", ".join(f"'{w}'" for w in "re fwd fw the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might must this that these those i you he she it we they my your his her its our their what which who whom whose when where why how all each every both few more most other some such no nor not only own same so than too very just about up down out off over under".split())


@query(f"SELECT email_id, list_aggregate(list_distinct_first, 'string_agg', ',') AS keywords FROM (SELECT email_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:10] AS list_distinct_first FROM (SELECT email_id, list_filter(regexp_extract_all(lower(subject), '\\b([a-z]{{3,}})\\b', 1), lambda x: x NOT IN ({_STOP})) AS w FROM emails WHERE subject IS NOT NULL)) WHERE len(list_distinct_first) > 0")
def mail_keywords(spark, folder):
    e = table(spark, folder, "emails").select("email_id", text.keywords(F.col("subject")).alias("k"))
    return e.where(F.size("k") > 0).select("email_id", F.array_join("k", ",").alias("keywords"))


@query("SELECT topic, n FROM (SELECT t AS topic, count(*) AS n FROM (SELECT unnest(topics) AS t FROM contacts) WHERE t IS NOT NULL GROUP BY 1) ORDER BY n DESC, topic LIMIT 20")
def topic_topk(spark, folder):
    return ranking.top_k(table(spark, folder, "contacts").select(F.explode("topics").alias("topic")).where("topic IS NOT NULL").groupBy("topic").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("topic")], 20)


@query("SELECT trim(regexp_replace(lower(trim(subject)), '^((re|fwd?|aw|wg)\\s*:\\s*)+', '')) AS subject, count(*) AS n, min(email_id) AS first_id FROM emails WHERE subject IS NOT NULL GROUP BY 1")
def subject_dedup(spark, folder):
    return table(spark, folder, "emails").where("subject IS NOT NULL").groupBy(text.bare_subject(F.col("subject")).alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.min("email_id").alias("first_id"))


@query("SELECT card_id, k AS place, nullif(regexp_replace(phones[k].value, '[^0-9]', '', 'g'), '') AS digits FROM (SELECT card_id, phones, unnest(range(1, len(phones) + 1)) AS k FROM vcards)")
def phone_normalise(spark, folder):
    p = table(spark, folder, "vcards").select("card_id", F.posexplode("phones").alias("k", "p"))
    return p.select("card_id", (F.col("k") + 1).cast("long").alias("place"), text.digits_of(F.col("p.value")).alias("digits"))


@query("SELECT lower(split_part(from_email, '@', -1)) AS domain, count(*) AS mails FROM emails WHERE contains(from_email, '@') GROUP BY 1")
def sender_domains(spark, folder):
    return table(spark, folder, "emails").groupBy(text.domain_of(F.col("from_email")).alias("domain")).agg(F.count(F.lit(1)).alias("mails")).where("domain IS NOT NULL")


#: Lines of notes' bodies for the patterns: signs between words doubled, so that a match may end and the next begin with one.
_BODIES = r"b AS (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^---(?s:.*?)---', ''), chr(10))), '([^\p{L}\p{N}_])', '\1\1', 'g') AS line FROM documents WHERE text IS NOT NULL), l AS (SELECT * FROM b WHERE trim(line) <> '' AND NOT starts_with(line, '#'))"
_GAP, _NAME = r"[\s\p{Z}]+", "[A-Z][a-zA-Z]*"
_OPEN, _CLOSE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _found(pattern: str, group: str = "1") -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all(line, '{pattern}', {group})) AS name FROM l"


_SUFFIXES = "Inc|Corp|Corporation|Ltd|Limited|GmbH|Labs|Protocol|Foundation|Network|DAO|Technologies|Ventures|Capital"


@query(f"WITH {_BODIES}, f AS ({_found(f'{_OPEN}({_NAME}(?:{_GAP}{_NAME})*{_GAP}(?:{_SUFFIXES})){_CLOSE}')} UNION ALL SELECT * FROM ({_found(f'{_OPEN}(?:at|from|with|by){_GAP}({_NAME}(?:{_GAP}{_NAME}){{0,3}}){_CLOSE}')}) WHERE lower(name) NOT IN ('the', 'this', 'that', 'their', 'there')) SELECT DISTINCT doc_id, lower(regexp_replace(name, '{_GAP}', ' ', 'g')) AS name FROM f")
def entity_companies(spark, folder):
    return _entities(spark, folder, "company")


def _entities(spark, folder, kind):
    found = entities.document_entities(table(spark, folder, "documents"), "doc_id", "text").where(F.col("entity_type") == kind)
    return found.select("doc_id", F.lower(F.regexp_replace("name", r"[\s\p{Z}]+", " ")).alias("name")).distinct()


_PROJECTS = " UNION ALL ".join(_found(f"(?i){_OPEN}({_NAME}){_GAP}{w}{_CLOSE}") for w in "protocol platform network chain token blockchain mainnet testnet DAO dApp".split())


@query(f"WITH {_BODIES}, f AS ({_PROJECTS}) SELECT DISTINCT doc_id, lower(name) AS name FROM f")
def entity_projects(spark, folder):
    return _entities(spark, folder, "project")


_EVENTS = " UNION ALL ".join(_found(f"(?i){_OPEN}({_NAME}(?:{_GAP}{_NAME})*{_GAP}{w}(?:{_GAP}\\d{{4}})?){_CLOSE}") for w in "conference summit meetup hackathon workshop symposium expo week".split())


@query(f"WITH {_BODIES}, f AS ({_EVENTS}) SELECT DISTINCT doc_id, lower(regexp_replace(name, '{_GAP}', ' ', 'g')) AS name FROM f")
def entity_events(spark, folder):
    return _entities(spark, folder, "event")


@query()
def document_entities(spark, folder):
    return entities.document_entities(table(spark, folder, "documents"), "doc_id", "text")


_INDUSTRY = "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}' END" for k, ws in text.INDUSTRY_WORDS.items()) + "]"


@query(f"SELECT doc_id, list_aggregate(list_filter({_INDUSTRY}, lambda x: x IS NOT NULL)[1:3], 'string_agg', ',') AS industries FROM documents WHERE len(list_filter({_INDUSTRY}, lambda x: x IS NOT NULL)) > 0")
def industry_suggestions(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", text.industries(F.col("text")).alias("i"))
    return d.where(F.size("i") > 0).select("doc_id", F.array_join("i", ",").alias("industries"))


_LINES = "l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM documents WHERE text IS NOT NULL))"


@query(f"WITH {_LINES} SELECT doc_id, line_no, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading FROM (SELECT *, nullif(regexp_extract(line, '^#+\\s+(.+)$', 1), '') AS h FROM l)")
def heading_carry(spark, folder):
    return text.with_heading(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "line_no", "heading")


@query(f"WITH {_LINES} SELECT doc_id, line_no, left(concat_ws(' ', lag(line) OVER w, line, lead(line) OVER w), 500) AS context FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def context_window(spark, folder):
    return text.with_context(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "line_no", "context")


# --- orders and events ------------------------------------------------------------------------------------------------

@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, floor(epoch(max(ts)))::BIGINT AS last_at, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_profile(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last_at"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def order_rollup(spark, folder):
    customers = table(spark, folder, "customer").join(F.broadcast(table(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
