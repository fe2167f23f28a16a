"""Mails and cards: filters of senders, lists by volume, primary addresses, what an import would do."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import mail, ranking, resolve, scoring, tagging, text
from kinweave.plans.tables import table
from kinweave.queries.relations import _COUNTS, _counts
from kinweave.queries.views import EM_SQL, emails, registry

QUERIES, ORACLES, query = registry()

_EXCLUDED, _SENSITIVE = ["mailhaven.*"], ["*legal*", "*health*"]
_MACHINES = " OR ".join(f"contains(lower(from_email || chr(10) || coalesce(from_name, '')), '{w}')" for w in "substack.com beehiiv.com mailchimp.com sendgrid.net constantcontact.com getrevue.co convertkit.com newsletter news@ digest@ weekly@ daily@ updates@ info@ hello@ team@ marketing@ noreply no-reply donotreply notifications@ alert@ alerts@ system@ mailer@ daemon@ postmaster@ bounce@ auto@ automated@ linkedin.com facebook.com twitter.com".split())


@query(f"WITH {EM_SQL} SELECT email_id, len(list_filter(list_concat([from_email], to_emails, cc_emails), lambda a: regexp_matches(a, '@[^@]*(legal|health)[^@]*$'))) > 0 AS sensitive FROM em WHERE contains(from_email, '@') AND NOT regexp_matches(from_email, '@mailhaven\\.[^@]*$') AND NOT ({_MACHINES})")
def personal_mails(spark, folder):
    return mail.kept_mails(emails(spark, folder), _EXCLUDED, _SENSITIVE).select("email_id", "sensitive")


def _class_sql(column: str) -> str:
    cases = {
        "automated": "noreply no-reply donotreply notifications@ alert@ alerts@ system@ mailer@ daemon@ postmaster@ bounce@ auto@ automated@",
        "newsletter": "newsletter news@ digest@ weekly@ daily@ updates@ marketing@ info@ hello@ team@ mail.beehiiv.com substack.com mailchimp.com sendgrid.net constantcontact.com",
        "transactional": "receipt invoice order confirmation booking support@ help@ service@ billing@",
        "social": "linkedin.com twitter.com facebook.com github.com slack.com discord.com telegram.org zoom.us",
    }
    whens = " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words.split()) + f" THEN '{name}'" for name, words in cases.items())
    return f"CASE {whens} ELSE 'personal' END"


_SENDERS_SQL = f"WITH {EM_SQL}, s AS (SELECT from_email AS email, count(*) AS n FROM em WHERE from_email <> '' GROUP BY 1), k AS (SELECT *, {_class_sql('email')} AS kind FROM s)"


def _senders(spark, folder):
    return emails(spark, folder).where("from_email <> ''").groupBy(F.col("from_email").alias("email")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", text.sender_type(F.col("email")))


@query(_SENDERS_SQL + ", l AS (SELECT 'all' AS list, email, n, 30 AS most FROM k UNION ALL SELECT kind, email, n, CASE kind WHEN 'personal' THEN 50 WHEN 'newsletter' THEN 20 ELSE 15 END FROM k WHERE kind IN ('personal', 'newsletter', 'social')) SELECT list, email, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY n DESC, email) AS rank FROM l) WHERE rank <= most")
def sender_tops(spark, folder):
    s = _senders(spark, folder)
    lists = s.select(F.lit("all").alias("list"), "email", "n").unionByName(s.where(F.col("kind").isin("personal", "newsletter", "social")).select(F.col("kind").alias("list"), "email", "n"))
    top = ranking.top_k_per_group(lists, ["list"], [F.desc("n"), F.col("email")], 50)
    most = F.when(F.col("list") == "all", 30).when(F.col("list") == "newsletter", 20).when(F.col("list") == "social", 15).otherwise(50)
    return top.where(F.col("rank") <= most)


@query(_SENDERS_SQL + " SELECT kind, sum(n)::BIGINT AS mails, count(*) AS senders FROM k GROUP BY 1")
def sender_classes(spark, folder):
    return _senders(spark, folder).groupBy("kind").agg(F.sum("n").alias("mails"), F.count(F.lit(1)).alias("senders"))


@query(_SENDERS_SQL + ", x AS (SELECT n, CASE WHEN email = 'notifications@github.com' THEN 'github' WHEN kind = 'newsletter' THEN 'newsletters' WHEN kind = 'automated' THEN 'automated' END AS category FROM k) SELECT category, count(*) AS senders, sum(n)::BIGINT AS mails FROM x WHERE category IS NOT NULL GROUP BY 1")
def mailbox_categories(spark, folder):
    # the lists of whole addresses are those of the classes; only they are counted, nothing is deleted
    s = _senders(spark, folder)
    category = F.when(F.col("email") == mail.GITHUB_SENDER, "github").when(F.col("kind") == "newsletter", "newsletters").when((F.col("kind") == "automated") & ~F.col("email").contains("github.com"), "automated")
    return s.withColumn("category", category).where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("senders"), F.sum("n").alias("mails"))


_LISTS_SQL = _COUNTS + """,
t AS (SELECT c.contact_id, x.domain, c.sent + c.received AS total, c.sent::DOUBLE / nullif(c.sent + c.received, 0) AS r FROM c JOIN contacts x ON x.id = c.contact_id WHERE c.sent + c.received > 0),
l AS (
  SELECT 'high' AS list, contact_id, total, 30 AS most FROM t WHERE total >= 50 AND domain NOT IN ('gmail.com', 'google.com') UNION ALL SELECT 'medium', contact_id, total, 40 FROM t WHERE total BETWEEN 10 AND 49 AND domain NOT IN ('gmail.com', 'google.com')
  UNION ALL SELECT 'balanced', contact_id, total, 40 FROM t WHERE total >= 5 AND r BETWEEN 0.3 AND 0.7 UNION ALL SELECT 'newsletters', contact_id, total, 30 FROM t WHERE total >= 10 AND r < 0.3 UNION ALL SELECT 'outreach', contact_id, total, 30 FROM t WHERE total >= 3 AND r > 0.7)
SELECT list, contact_id, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY total DESC, contact_id) AS rank FROM l) WHERE rank <= most"""


@query(_LISTS_SQL)
def contact_lists(spark, folder):
    c = _counts(spark, folder).withColumn("total", F.col("sent") + F.col("received")).where("total > 0")
    t = c.join(table(spark, folder, "contacts").select(F.col("id").alias("contact_id"), "domain"), "contact_id")
    t = t.withColumns({"tier": scoring.frequency_tier(F.col("total")), "way": scoring.direction_class(F.col("sent"), F.col("received")), "open": ~F.col("domain").isin("gmail.com", "google.com")})
    tests = [("high", 30, "tier = 'high' AND open"), ("medium", 40, "tier = 'medium' AND open"), ("balanced", 40, "total >= 5 AND way = 'balanced'"), ("newsletters", 30, "total >= 10 AND way = 'mostly_received'"), ("outreach", 30, "total >= 3 AND way = 'mostly_sent'")]
    out = None
    for name, most, test in tests:
        part = ranking.top_k_per_group(t.where(test).select(F.lit(name).alias("list"), "contact_id", "total"), ["list"], [F.desc("total"), F.col("contact_id")], most)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
WITH {EM_SQL},
o AS (SELECT e.email_id, e.from_email, list_concat(e.to_emails, e.cc_emails) AS people, lower(trim(b.address)) AS owner FROM em e JOIN mailboxes b USING (mailbox_id)),
r AS (SELECT email_id, 'received' AS direction FROM o WHERE list_contains(people, owner)), s AS (SELECT email_id, 'sent' AS direction FROM o WHERE from_email = owner AND email_id NOT IN (SELECT email_id FROM r))
SELECT * FROM r UNION ALL SELECT * FROM s""")
def mail_directions(spark, folder):
    owners = table(spark, folder, "mailboxes").select("mailbox_id", F.lower(F.trim("address")).alias("owner"))
    # one row per mailbox, 40 in these tables, joined on its unique id
    mails = emails(spark, folder).join(owners, "mailbox_id")
    received = mails.where(F.exists(F.concat("to_emails", "cc_emails"), lambda a: a == F.col("owner"))).select("email_id")
    return mail.merged_directions(received, mails.where("from_email = owner").select("email_id"), "email_id")


@query(f"WITH {EM_SQL}, a AS (SELECT DISTINCT from_email AS email FROM em WHERE contains(from_email, '@')) SELECT email, regexp_matches(email, '@(usv\\.com|a16z\\.com|pantera\\.capital|sequoiacap\\.com|paradigm\\.xyz|polychain\\.capital|dragonfly\\.xyz)$') OR regexp_matches(email, '@.*(\\.vc$|capital\\.|ventures\\.)') AS investor, regexp_matches(email, '@home\\.tarvik\\.example$') AS internal FROM a")
def sender_flags(spark, folder):
    a = emails(spark, folder).select(F.col("from_email").alias("email")).where(F.contains("email", F.lit("@"))).distinct()
    return a.select("email", tagging.is_investor(tagging.tags_of(F.col("email"))).alias("investor"), tagging.is_internal(F.col("email"), ["home.tarvik.example"]).alias("internal"))


# --- cards ---------------------------------------------------------------------------------------------------------------

@query("SELECT card_id, coalesce(list_filter(emails, lambda e: upper(e.type) IN ('WORK', 'PREF'))[1].value, emails[1].value) AS email, coalesce(list_filter(phones, lambda p: upper(p.type) IN ('CELL', 'MOBILE', 'PREF'))[1].value, phones[1].value) AS phone, list_filter(urls, lambda u: contains(lower(u), 'linkedin.com'))[1] AS linkedin, list_filter(urls, lambda u: NOT contains(lower(u), 'linkedin.com'))[1] AS url FROM vcards")
def card_primaries(spark, folder):
    first = lambda c, kinds: resolve.primary(F.col(c), kinds)
    linked = lambda u: F.contains(F.lower(u), F.lit("linkedin.com"))
    return table(spark, folder, "vcards").select("card_id", first("emails", ["WORK", "PREF"]).alias("email"), first("phones", ["CELL", "MOBILE", "PREF"]).alias("phone"), F.get(F.filter("urls", linked), F.lit(0)).alias("linkedin"), F.get(F.filter("urls", lambda u: ~linked(u)), F.lit(0)).alias("url"))


@query("""
WITH k AS (SELECT DISTINCT lower(trim(email)) AS email FROM contacts WHERE trim(email) <> ''),
c AS (SELECT coalesce(source, 'unknown') AS source, card_id, trim(coalesce(name, '')) <> '' AS named, len(list_filter(emails, lambda e: trim(e.value) <> '')) > 0 AS mailed, len(list_filter(phones, lambda p: trim(p.value) <> '')) > 0 AS phoned FROM vcards),
m AS (SELECT DISTINCT card_id FROM (SELECT card_id, lower(trim(unnest(emails).value)) AS email FROM vcards) JOIN k USING (email))
SELECT source, count(*) AS cards, count(*) FILTER (WHERE named) AS named, count(*) FILTER (WHERE mailed) AS with_email, count(*) FILTER (WHERE phoned) AS with_phone, count(*) FILTER (WHERE card_id IN (SELECT card_id FROM m)) AS known, count(*) FILTER (WHERE card_id NOT IN (SELECT card_id FROM m)) AS fresh FROM c GROUP BY 1""")
def import_counters(spark, folder):
    cards, filled = table(spark, folder, "vcards"), lambda c: F.coalesce(F.exists(c, lambda e: F.trim(e.value) != ""), F.lit(False))
    known = table(spark, folder, "contacts").select(F.lower(F.trim("email")).alias("email")).where("email <> ''").distinct()
    hit = cards.select("card_id", F.explode("emails.value").alias("e")).select("card_id", F.lower(F.trim("e")).alias("email")).join(known, "email", "left_semi").select("card_id").distinct().withColumn("hit", F.lit(True))
    c = cards.select("card_id", F.coalesce("source", F.lit("unknown")).alias("source"), (F.trim(F.coalesce("name", F.lit(""))) != "").alias("named"), filled("emails").alias("mailed"), filled("phones").alias("phoned")).join(hit, "card_id", "left")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("cards"), F.count_if("named").alias("named"), F.count_if("mailed").alias("with_email"), F.count_if("phoned").alias("with_phone"), F.count("hit").alias("known"), F.count_if(F.col("hit").isNull()).alias("fresh"))


@query("""
WITH e AS (SELECT DISTINCT card_id, lower(trim(unnest(emails).value)) AS v FROM vcards), p AS (SELECT DISTINCT card_id, regexp_replace(unnest(phones).value, '[\\s().+-]', '', 'g') AS v FROM vcards),
f AS (SELECT card_id, lower(trim(name)) || '|' || lower(trim(organization)) AS v FROM vcards WHERE trim(name) <> '' AND trim(organization) <> ''),
a AS (SELECT 'email' AS reason, card_id, v FROM e WHERE v <> '' UNION ALL SELECT 'phone', card_id, v FROM p WHERE v <> '' UNION ALL SELECT 'name_organization', card_id, v FROM f),
g AS (SELECT reason, v, min(card_id) AS first FROM a GROUP BY 1, 2 HAVING count(*) > 1)
SELECT DISTINCT a.card_id, g.first AS merge_with, a.reason FROM a JOIN g USING (reason, v) WHERE a.card_id <> g.first""")
def merge_candidates(spark, folder):
    phone = lambda x: F.regexp_replace(x, r"(?U)[\s().+-]", "")
    c = table(spark, folder, "vcards")
    keys = {"email": F.transform("emails.value", lambda x: F.lower(F.trim(x))), "phone": F.transform("phones.value", phone), "name_organization": F.when((F.trim("name") != "") & (F.trim("organization") != ""), F.array(F.concat_ws("|", F.lower(F.trim("name")), F.lower(F.trim("organization")))))}
    return resolve.merge_candidates(c, "card_id", keys)


@query("SELECT entry_id, trim(regexp_replace(regexp_replace(regexp_replace(name, '[^\\p{L}\\p{M}\\p{N}_\\s''-]', '', 'g'), '\\s*-\\s*[^-]+$', ''), '\\s+', ' ', 'g')) AS searched FROM contact_entries WHERE name IS NOT NULL")
def search_names(spark, folder):
    return table(spark, folder, "contact_entries").where("name IS NOT NULL").select("entry_id", mail.search_name(F.col("name")).alias("searched"))


@query("""
WITH v AS (SELECT card_id, name, lower(trim(unnest(emails).value)) AS email FROM vcards), c AS (SELECT lower(trim(email)) AS email, arg_min(name, id) AS name, min(id) AS id FROM contacts WHERE name IS NOT NULL AND trim(email) <> '' GROUP BY 1),
j AS (SELECT DISTINCT v.card_id, c.id AS contact_id, lower(v.name) AS a, lower(c.name) AS b FROM v JOIN c USING (email)),
w AS (SELECT *, list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '') AS x, list_filter(regexp_split_to_array(b, '\\s+'), lambda x: x <> '') AS y FROM j)
SELECT card_id, contact_id, trim(b) <> '' AND coalesce(a = b OR x[1] = y[1] OR (len(x) > 1 AND len(y) > 1 AND x[-1] = y[-1]), false) AS same FROM w""")
def name_checks(spark, folder):
    cards = table(spark, folder, "vcards").select("card_id", F.col("name").alias("a"), F.explode("emails.value").alias("e")).select("card_id", "a", F.lower(F.trim("e")).alias("email"))
    known = table(spark, folder, "contacts").where("name IS NOT NULL AND trim(email) <> ''").groupBy(F.lower(F.trim("email")).alias("email")).agg(F.min_by("name", "id").alias("b"), F.min("id").alias("contact_id"))
    return cards.join(known, "email").select("card_id", "contact_id", mail.name_matches(F.col("a"), F.col("b")).alias("same"), "a", "b").distinct().select("card_id", "contact_id", "same")
