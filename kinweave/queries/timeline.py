"""Order in time: open conversations, gaps after meetings, silences, histories of correspondence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import mail, ranking, scoring, text
from kinweave.plans.tables import table
from kinweave.queries.views import EM_SQL, IM_SQL, emails, interactions, registry

QUERIES, ORACLES, query = registry()
NOW = "2025-10-31"
_NOW = "epoch(TIMESTAMP '2025-10-31')"


def _days_until_now(at="at_s"):
    return F.floor((F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.col(at)) / 86_400).cast("long")


# --- open conversations ------------------------------------------------------------------------------------------------

_ASKS = " OR ".join(f"contains(lower(coalesce(snippet, '')), '{w}')" for w in ("?", "let me know", "thoughts", "what do you think", "when", "how about"))
_OPEN_SQL = f"""
WITH {IM_SQL},
u AS (SELECT *, count(*) OVER (PARTITION BY thread) AS n, row_number() OVER (PARTITION BY thread ORDER BY at_s DESC, id DESC) AS k FROM im WHERE thread IS NOT NULL AND at_s IS NOT NULL AND side IS NOT NULL),
v AS (SELECT thread, n, id, side, coalesce(snippet, '') AS snippet, floor(({_NOW} - at_s) / 86400)::BIGINT AS days FROM u WHERE k = 1 AND n >= 2),
o AS (SELECT thread, n, days, id, CASE WHEN side = 'received' THEN 'unanswered_by_me' ELSE 'no_response_to_my_message' END AS gap, left(replace(snippet, chr(10), ' '), 100) AS preview FROM v WHERE side = 'received' OR (days > 14 AND ({_ASKS})))
"""


def _open(spark, folder) -> DataFrame:
    """Conversations of two messages or more whose last word waits for an answer: theirs at any age, mine if it asks and is over 14 days old."""
    rows = interactions(spark, folder).where("thread IS NOT NULL AND at_s IS NOT NULL AND side IS NOT NULL")
    last = F.max_by(F.struct("id", "side", F.coalesce("snippet", F.lit("")).alias("snippet"), "at_s"), F.struct("at_s", "id"))
    x = rows.groupBy("thread").agg(last.alias("m"), F.count(F.lit(1)).alias("n")).where("n >= 2").select("thread", "n", "m.*").withColumn("days", _days_until_now())
    x = x.where((F.col("side") == "received") | (text.asks(F.col("snippet")) & (F.col("days") > 14)))
    gap = F.when(F.col("side") == "received", "unanswered_by_me").otherwise("no_response_to_my_message")
    return x.select("thread", "n", "days", "id", gap.alias("gap"), F.substring(F.translate("snippet", "\n", " "), 1, 100).alias("preview"))


@query(_OPEN_SQL + "SELECT * FROM o")
def conversation_ending(spark, folder):
    return _open(spark, folder)


@query(_OPEN_SQL + "SELECT thread, n, days, preview FROM o WHERE gap = 'unanswered_by_me' AND days > 7 ORDER BY n DESC, days, thread LIMIT 30")
def unanswered_list(spark, folder):
    return ranking.top_k(_open(spark, folder).where("gap = 'unanswered_by_me' AND days > 7").select("thread", "n", "days", "preview"), [F.desc("n"), F.col("days"), F.col("thread")], 30)


@query(_OPEN_SQL + "SELECT thread, n, days, preview FROM o WHERE gap = 'no_response_to_my_message' ORDER BY days, thread LIMIT 20")
def waiting_list(spark, folder):
    return ranking.top_k(_open(spark, folder).where("gap = 'no_response_to_my_message'").select("thread", "n", "days", "preview"), [F.col("days"), F.col("thread")], 20)


@query(f"WITH {IM_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY at_s DESC, id DESC) AS k FROM im WHERE thread IS NOT NULL AND at_s IS NOT NULL) SELECT thread, max(id) FILTER (WHERE k = 1) AS last_id, max(id) FILTER (WHERE k = 2) AS second_last_id, max(side) FILTER (WHERE k = 2) AS second_last_side FROM r WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2")
def last_two_messages(spark, folder):
    # the last message, and the last among the others: two aggregations with map-side partials
    rows = interactions(spark, folder).where("thread IS NOT NULL AND at_s IS NOT NULL").select("thread", "id", "at_s", "side")
    top = ranking.top_k_per_group(rows, ["thread"], [F.desc("at_s"), F.desc("id")], 2)
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return top.groupBy("thread").agg(pick(1, "id").alias("last_id"), pick(2, "id").alias("second_last_id"), pick(2, "side").alias("second_last_side"), F.count(F.lit(1)).alias("k")).where("k = 2").drop("k")


# --- gaps after meetings -------------------------------------------------------------------------------------------------

_MEETINGS = [("spring", "2023-04-10"), ("summer", "2024-07-01"), ("autumn", "2025-03-17"), ("winter", "2025-09-22")]
_GAPS_SQL = f"""
WITH {IM_SQL}, w(name, day0) AS (VALUES {', '.join(f"('{n}', epoch(DATE '{d}')::BIGINT)" for n, d in _MEETINGS)}),
j AS (SELECT contact_id, name, day0, at_s FROM im, w WHERE contact_id IS NOT NULL AND at_s >= day0 - 3 * 86400 AND at_s <= {_NOW}),
g AS (
  SELECT contact_id, name, count(*) FILTER (WHERE at_s <= day0 + 5 * 86400) AS during, count(*) FILTER (WHERE at_s > day0 + 5 * 86400) AS after,
    max(at_s) FILTER (WHERE at_s <= day0 + 5 * 86400) AS last_during, min(at_s) FILTER (WHERE at_s > day0 + 5 * 86400) AS first_after FROM j GROUP BY 1, 2),
gaps AS (
  SELECT contact_id, name, during, after, floor(({_NOW} - last_during) / 86400)::BIGINT AS days_since, after > 0 AS weak, CASE WHEN after > 0 THEN floor((first_after - last_during) / 86400)::BIGINT END AS days_to_follow_up
  FROM g WHERE during > 0 AND ((after = 0 AND floor(({_NOW} - last_during) / 86400) > 30) OR after BETWEEN 1 AND 2))
"""


def _gaps(spark, folder) -> DataFrame:
    """Contacts met at a meeting (3 days before to 5 after) with no message since (and over 30 days gone) or only one or two."""
    # a constant table of windows, summed up before anything is shuffled
    windows = F.broadcast(spark.createDataFrame(_MEETINGS, "name string, day string").select("name", F.unix_timestamp(F.to_timestamp("day")).alias("day0")))
    rows = interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL").where(F.col("at_s") <= F.unix_timestamp(F.lit(NOW).cast("timestamp")))
    j = rows.select("contact_id", "at_s").join(windows, F.col("at_s") >= F.col("day0") - 3 * 86_400)
    inside = F.col("at_s") <= F.col("day0") + 5 * 86_400
    g = j.groupBy("contact_id", "name").agg(F.count_if(inside).alias("during"), F.count_if(~inside).alias("after"), F.max(F.when(inside, F.col("at_s"))).alias("last_during"), F.min(F.when(~inside, F.col("at_s"))).alias("first_after"))
    g = g.withColumn("days_since", _days_until_now("last_during")).where((F.col("during") > 0) & (((F.col("after") == 0) & (F.col("days_since") > 30)) | F.col("after").between(1, 2)))
    between = F.when(F.col("after") > 0, F.floor((F.col("first_after") - F.col("last_during")) / 86_400).cast("long"))
    return g.select("contact_id", "name", "during", "after", "days_since", (F.col("after") > 0).alias("weak"), between.alias("days_to_follow_up"))


@query(_GAPS_SQL + "SELECT * FROM gaps")
def post_event_gaps(spark, folder):
    return _gaps(spark, folder)


@query(_GAPS_SQL + "SELECT name, weak, contact_id, during, rank FROM (SELECT *, row_number() OVER (PARTITION BY name, weak ORDER BY during DESC, contact_id) AS rank FROM gaps) WHERE rank <= CASE WHEN weak THEN 10 ELSE 15 END")
def post_event_tops(spark, folder):
    top = ranking.top_k_per_group(_gaps(spark, folder).select("name", "weak", "contact_id", "during"), ["name", "weak"], [F.desc("during"), F.col("contact_id")], 15)
    return top.where(~F.col("weak") | (F.col("rank") <= 10))


# --- silences and activity -----------------------------------------------------------------------------------------------

@query(f"WITH {IM_SQL} SELECT contact_id, id, gap_s FROM (SELECT contact_id, id, at_s - lag(at_s) OVER (PARTITION BY contact_id ORDER BY at_s, id) AS gap_s FROM im WHERE contact_id IS NOT NULL AND at_s IS NOT NULL) WHERE gap_s > 90 * 86400")
def silence_gaps(spark, folder):
    # a silence of days lies between the last message of one day and the first of a later one, so a contact's messages are summed up by day first
    rows = interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL")
    days = rows.groupBy("contact_id", F.floor(F.col("at_s") / 86_400).alias("day")).agg(F.min(F.struct("at_s", "id")).alias("first"), F.max("at_s").alias("last"))
    gap = F.col("first.at_s") - F.lag("last").over(Window.partitionBy("contact_id").orderBy("day"))
    return days.select("contact_id", F.col("first.id").alias("id"), gap.alias("gap_s")).where("gap_s > 90 * 86400")


@query(f"WITH {IM_SQL} SELECT contact_id, id, row_number() OVER (PARTITION BY contact_id ORDER BY at_s DESC, id DESC) AS place FROM im WHERE contact_id IS NOT NULL AND at_s IS NOT NULL")
def contact_timeline(spark, folder):
    # newest first; numbered month by month, so that no contact is sorted whole
    rows = interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL").select("contact_id", "id", "at_s")
    return ranking.numbered(rows, ["contact_id"], -F.floor(F.col("at_s") / (30 * 86_400)), [F.desc("at_s"), F.desc("id")]).drop("at_s")


@query(f"WITH {IM_SQL} SELECT date_trunc('week', day)::DATE::VARCHAR AS week, count(*) AS messages, count(DISTINCT contact_id) AS contacts, count(*) FILTER (WHERE side = 'sent') AS sent, count(*) FILTER (WHERE side = 'received') AS received FROM im WHERE at_s IS NOT NULL GROUP BY 1")
def weekly_activity(spark, folder):
    week = F.to_date(F.date_trunc("week", "moment")).cast("string").alias("week")
    return interactions(spark, folder).where("at_s IS NOT NULL").groupBy(week).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("contact_id").alias("contacts"), F.count_if(F.col("side") == "sent").alias("sent"), F.count_if(F.col("side") == "received").alias("received"))


@query(f"WITH {IM_SQL}, f AS (SELECT contact_id, date_trunc('week', min(day))::DATE::VARCHAR AS week FROM im WHERE contact_id IS NOT NULL AND at_s IS NOT NULL GROUP BY 1) SELECT week, count(*) AS new_contacts FROM f GROUP BY 1")
def new_contacts_by_week(spark, folder):
    first = interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL").groupBy("contact_id").agg(F.min("moment").alias("first"))
    return first.groupBy(F.to_date(F.date_trunc("week", "first")).cast("string").alias("week")).agg(F.count(F.lit(1)).alias("new_contacts"))


@query(f"WITH {IM_SQL} SELECT contact_id, month, n, sum(n) OVER (PARTITION BY contact_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS last_three FROM (SELECT contact_id, strftime(day, '%Y-%m') AS month, count(*) AS n FROM im WHERE contact_id IS NOT NULL AND at_s IS NOT NULL GROUP BY 1, 2)")
def rolling_months(spark, folder):
    m = interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL").groupBy("contact_id", F.date_format("moment", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.withColumn("last_three", F.sum("n").over(Window.partitionBy("contact_id").orderBy("month").rowsBetween(-2, 0)))


@query(f"WITH {IM_SQL}, s AS (SELECT contact_id, count(DISTINCT thread) AS threads, count(*) AS messages FROM im GROUP BY 1) SELECT c.id, c.email, s.threads, s.messages FROM contacts c LEFT JOIN s ON s.contact_id = c.id")
def contact_threads(spark, folder):
    s = interactions(spark, folder).where("contact_id IS NOT NULL").groupBy(F.col("contact_id").alias("id")).agg(F.count_distinct("thread").alias("threads"), F.count(F.lit(1)).alias("messages"))
    return table(spark, folder, "contacts").select("id", "email").join(s, "id", "left")


# --- correspondence ------------------------------------------------------------------------------------------------------

@query(f"""
WITH {IM_SQL},
h AS (SELECT contact_id, count(*) AS total, count(*) FILTER (WHERE side = 'sent') AS sent, count(*) FILTER (WHERE side = 'received') AS received, min(at_s) AS first_at, max(at_s) AS last_at, count(DISTINCT strftime(day, '%Y-%m')) AS active_months FROM im WHERE contact_id IS NOT NULL AND at_s IS NOT NULL GROUP BY 1)
SELECT *, round(total / greatest(1.0, greatest(1, floor((last_at - first_at) / 86400)) / 30.0), 6) AS per_month,
  CASE WHEN floor(({_NOW} - last_at) / 86400) <= 14 THEN 'active' WHEN floor(({_NOW} - last_at) / 86400) <= 30 THEN 'warming' WHEN floor(({_NOW} - last_at) / 86400) <= 60 THEN 'cooling' ELSE 'dormant' END AS status FROM h""")
def mail_history(spark, folder):
    rows = interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL")
    h = rows.groupBy("contact_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("side") == "sent").alias("sent"), F.count_if(F.col("side") == "received").alias("received"), F.min("at_s").alias("first_at"), F.max("at_s").alias("last_at"), F.count_distinct(F.date_format("moment", "yyyy-MM")).alias("active_months"))
    return h.withColumn("per_month", F.round(scoring.span_frequency(F.col("total"), F.col("first_at"), F.col("last_at")), 6)).withColumn("status", scoring.recency_status(_days_until_now("last_at")))


# written out apart from the operator's list
_NO_TOPICS = ", ".join(f"'{w}'" for w in "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might must shall can need this that these those i you he she it we they me him her us them my your his its our their what which who whom when where why how all each every both few more most other some such no not only same so than too very just about into over after before between under again then once here there any if because until while during through above below up down out re fwd fw subject please thanks thank hi hello dear best regards sincerely cheers".split())


@query(f"""
WITH {IM_SQL},
s AS (SELECT contact_id, at_s, id, regexp_extract_all(regexp_replace(lower(subject), '^(re:|fwd?:|fw:)\\s*', ''), '\\b([a-z]{{3,}})\\b', 1) AS ws FROM im WHERE contact_id IS NOT NULL AND at_s IS NOT NULL AND subject IS NOT NULL),
f AS (SELECT contact_id, at_s, id, [w FOR w IN ws IF w NOT IN ({_NO_TOPICS})] AS ws FROM s),
t AS (SELECT contact_id, at_s, id, unnest(ws) AS topic, unnest(range(len(ws))) AS k FROM f),
n AS (SELECT contact_id, topic, count(*) AS n, min((at_s, id, k)) AS first FROM t GROUP BY 1, 2)
SELECT contact_id, topic, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY n DESC, first, topic) AS rank FROM n) WHERE rank <= 5""")
def contact_topics(spark, folder):
    rows = interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL")
    return mail.top_topics(rows, "contact_id", "subject", ["at_s", "id"])


@query(f"""
WITH {IM_SQL},
s AS (SELECT contact_id, lower(trim(regexp_replace(subject, '^(?i)(re:|fwd?:|fw:)\\s*', ''))) AS form, at_s, id, left(trim(regexp_replace(subject, '^(?i)(re:|fwd?:|fw:)\\s*', '')), 80) AS sample FROM im WHERE contact_id IS NOT NULL AND at_s IS NOT NULL AND subject IS NOT NULL),
f AS (SELECT contact_id, form, arg_min(sample, (at_s, id)) AS sample, min((at_s, id)) AS first FROM s WHERE form <> '' GROUP BY 1, 2)
SELECT contact_id, sample, rank FROM (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY first) AS rank FROM f) WHERE rank <= 5""")
def subject_samples(spark, folder):
    bare = F.trim(F.regexp_replace("subject", r"^(?i)(re:|fwd?:|fw:)\s*", ""))
    rows = interactions(spark, folder).where("contact_id IS NOT NULL AND at_s IS NOT NULL AND subject IS NOT NULL").select("contact_id", F.struct("at_s", "id").alias("o"), bare.alias("bare")).where("bare <> ''")
    forms = rows.groupBy("contact_id", F.lower("bare").alias("form")).agg(F.min("o").alias("first"), F.substring(F.min_by("bare", "o"), 1, 80).alias("sample"))
    return ranking.top_k_per_group(forms, ["contact_id"], [F.col("first")], 5).select("contact_id", "sample", "rank")


@query(f"""
WITH {EM_SQL},
k AS (SELECT c.email, kw, min((e.at_s, e.email_id, pos)) AS first FROM (SELECT from_email AS email, email_id FROM em WHERE at_s IS NOT NULL) c JOIN em e USING (email_id) JOIN (SELECT email_id, unnest(keywords) AS kw, unnest(range(len(keywords))) AS pos FROM emails) w USING (email_id) WHERE kw <> '' AND c.email <> '' GROUP BY 1, 2)
SELECT email, string_agg(kw, ',' ORDER BY rank) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY first, kw) AS rank FROM k) WHERE rank <= 50 GROUP BY 1""")
def sender_topics(spark, folder):
    # the keywords of a sender's mails in the order of their first appearance, fifty at most
    mails = emails(spark, folder).where("at_s IS NOT NULL AND from_email <> ''").select("email_id", F.col("from_email").alias("email"), "at_s")
    words = table(spark, folder, "emails").select("email_id", F.posexplode("keywords").alias("k", "kw")).where("kw <> ''")
    first = words.join(mails, "email_id").groupBy("email", "kw").agg(F.min(F.struct("at_s", "email_id", "k")).alias("first"))
    top = ranking.top_k_per_group(first, ["email"], [F.col("first"), F.col("kw")], 50)
    return top.groupBy("email").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "kw"))), lambda x: x.kw), ",").alias("topics"))
