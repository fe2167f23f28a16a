"""The landscape of entries: industries, relationships, gaps, parties, members and what is drafted from notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import ranking, resolve, text
from kinweave.operators import registry as register
from kinweave.plans.lineage import materialise
from kinweave.plans.skew import heavy_or_none, lookup_join
from kinweave.plans.tables import table
from kinweave.queries.relations import AS_OF, _PEOPLE, _score_sql, _scores
from kinweave.queries.views import EM_SQL, IM_SQL, emails, interactions, registry

QUERIES, ORACLES, query = registry()

_KEBAB = r"trim(regexp_replace(regexp_replace(trim(lower(t)), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"
_RELATION = "CASE WHEN organization IS NULL THEN NULL WHEN regexp_matches(lower(organization), 'labs|capital|ventures') THEN 'investor' ELSE 'partner' END"
_ENTRIES_SQL = f"""
WITH e AS (
  SELECT entry_id, name, lower(coalesce(nullif(trim(contact_type), ''), 'person')) AS kind, lower(trim(status)) AS status, organization, tags, interaction_count, {_RELATION} AS relation,
    CASE WHEN interaction_count > 10 THEN 4 WHEN interaction_count > 6 THEN 3 WHEN interaction_count > 2 THEN 2 ELSE 1 END AS relevance FROM contact_entries),
i AS (SELECT * FROM (SELECT e.*, {_KEBAB} AS industry FROM e, (SELECT entry_id, unnest(tags) AS t FROM contact_entries) u WHERE u.entry_id = e.entry_id) WHERE industry <> '')
"""


def _entries(spark, folder) -> DataFrame:
    """Entries with a kind, a relationship told by the organization's name, and a relevance by their interactions."""
    n = F.col("interaction_count")
    relation = F.when(F.col("organization").isNotNull(), text.group_relation(F.array("organization")))
    relevance = F.when(n > 10, 4).when(n > 6, 3).when(n > 2, 2).otherwise(1)
    kind = F.lower(F.coalesce(F.nullif(F.trim("contact_type"), F.lit("")), F.lit("person")))
    return table(spark, folder, "contact_entries").select("entry_id", "name", kind.alias("kind"), F.lower(F.trim("status")).alias("status"), "organization", "tags", "interaction_count", "location", relation.alias("relation"), relevance.alias("relevance"))


def _by_industry(spark, folder) -> DataFrame:
    return _entries(spark, folder).withColumn("t", F.explode("tags")).withColumn("industry", text.kebab(F.col("t"))).where("industry <> ''")


@query(_ENTRIES_SQL + "SELECT industry, count(*) AS total, count(*) FILTER (WHERE kind = 'person') AS people, count(*) FILTER (WHERE kind = 'company') AS companies, count(*) FILTER (WHERE kind = 'project') AS projects, count(*) FILTER (WHERE kind = 'event') AS events, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE relation = 'competitor') AS competitors, count(*) FILTER (WHERE relation = 'partner') AS partners FROM i GROUP BY 1 ORDER BY total DESC, industry")
def industry_rollup(spark, folder):
    of = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    g = _by_industry(spark, folder).groupBy("industry").agg(F.count(F.lit(1)).alias("total"), of("kind", "person").alias("people"), of("kind", "company").alias("companies"), of("kind", "project").alias("projects"), of("kind", "event").alias("events"), of("status", "active").alias("active"), of("relation", "competitor").alias("competitors"), of("relation", "partner").alias("partners"))
    return g.orderBy(F.desc("total"), "industry")


@query(_ENTRIES_SQL + "SELECT count(*) FILTER (WHERE relation = 'partner') AS partners, count(*) FILTER (WHERE relation = 'customer') AS customers, count(*) FILTER (WHERE relation = 'investor') AS investors, count(*) FILTER (WHERE relation = 'competitor') AS competitors, count(*) FILTER (WHERE relation LIKE 'target_%') AS targets, count(*) FILTER (WHERE status = 'dormant') AS dormant FROM e")
def relationship_distribution(spark, folder):
    e, of = _entries(spark, folder), lambda v: F.count_if(F.coalesce(F.col("relation") == v, F.lit(False)))
    return e.agg(of("partner").alias("partners"), of("customer").alias("customers"), of("investor").alias("investors"), of("competitor").alias("competitors"), F.count_if(F.coalesce(F.startswith("relation", F.lit("target_")), F.lit(False))).alias("targets"), F.count_if(F.coalesce(F.col("status") == "dormant", F.lit(False))).alias("dormant"))


@query(_ENTRIES_SQL + "SELECT relation || 's' AS bucket, entry_id, name, status FROM e WHERE relation IN ('partner', 'vendor', 'customer', 'investor')")
def ecosystem(spark, folder):
    e = _entries(spark, folder).where(F.col("relation").isin("partner", "vendor", "customer", "investor"))
    return e.select(F.concat("relation", F.lit("s")).alias("bucket"), "entry_id", "name", "status")


@query(_ENTRIES_SQL + ", g AS (SELECT 'No partners in ' || industry AS gap, 0 AS k FROM i GROUP BY industry HAVING count(*) FILTER (WHERE relation = 'partner') = 0 UNION ALL SELECT 'High-relevance target not contacted: ' || name, 1 FROM e WHERE relevance >= 4 AND status = 'draft' AND name IS NOT NULL) SELECT gap FROM g ORDER BY k, gap LIMIT 10")
def coverage_gaps(spark, folder):
    none = _by_industry(spark, folder).groupBy("industry").agg(F.count_if(F.coalesce(F.col("relation") == "partner", F.lit(False))).alias("n")).where("n = 0").select(F.concat(F.lit("No partners in "), "industry").alias("gap"), F.lit(0).alias("k"))
    targets = _entries(spark, folder).where("relevance >= 4 AND status = 'draft' AND name IS NOT NULL").select(F.concat(F.lit("High-relevance target not contacted: "), "name").alias("gap"), F.lit(1).alias("k"))
    return ranking.top_k(none.unionByName(targets), [F.col("k"), F.col("gap")], 10).select("gap")


@query("SELECT tag FROM industry_registry WHERE tag NOT IN (SELECT t FROM (SELECT unnest(tags) AS t FROM contact_entries WHERE lower(trim(status)) = 'active') WHERE t IS NOT NULL)")
def unused_industries(spark, folder):
    used = table(spark, folder, "contact_entries").where(F.lower(F.trim("status")) == "active").select(F.explode("tags").alias("tag")).distinct()
    return table(spark, folder, "industry_registry").select("tag").join(used, "tag", "left_anti")


@query(_ENTRIES_SQL + "SELECT entry_id, name, relevance FROM e WHERE relation = 'investor' ORDER BY relevance DESC, entry_id LIMIT 50")
def investors_by_relevance(spark, folder):
    return ranking.top_k(_entries(spark, folder).where("relation = 'investor'").select("entry_id", "name", "relevance"), [F.desc("relevance"), F.col("entry_id")], 50)


@query(_ENTRIES_SQL + "SELECT status, location, entry_id FROM (SELECT CASE WHEN e.status IN ('active', 'warming') THEN 'relevant' ELSE 'reconnect' END AS status, lower(trim(c.location)) AS location, e.entry_id, row_number() OVER (PARTITION BY CASE WHEN e.status IN ('active', 'warming') THEN 'relevant' ELSE 'reconnect' END, lower(trim(c.location)) ORDER BY e.interaction_count DESC NULLS LAST, e.entry_id) AS k FROM e JOIN contact_entries c USING (entry_id) WHERE e.status IN ('active', 'warming', 'dormant') AND trim(c.location) <> '') WHERE k <= 5")
def trip_contacts(spark, folder):
    e = _entries(spark, folder).where(F.col("status").isin("active", "warming", "dormant") & (F.trim("location") != ""))
    rows = e.select(F.when(F.col("status") == "dormant", "reconnect").otherwise("relevant").alias("status"), F.lower(F.trim("location")).alias("location"), "entry_id", "interaction_count")
    return ranking.top_k_per_group(rows, ["status", "location"], [F.col("interaction_count").desc_nulls_last(), F.col("entry_id")], 5).select("status", "location", "entry_id")


def _met(spark, folder) -> DataFrame:
    """Normal tags of entries with their first entry and number of uses."""
    tags = table(spark, folder, "contact_entries").select("entry_id", F.explode("tags").alias("t")).where("t IS NOT NULL")
    return tags.groupBy(text.kebab(F.col("t")).alias("tag")).agg(F.min("entry_id").alias("first"), F.count(F.lit(1)).alias("uses"))


@query()
def registry_register(spark, folder):
    names = table(spark, folder, "industry_registry").select(text.kebab(F.col("tag")).alias("tag"), F.transform("aliases", lambda x: text.kebab(x)).alias("aliases"), F.unix_date("first_seen").alias("place"))
    return register.registered(_met(spark, folder), names)


@query()
def registry_update(spark, folder):
    # the registry after all entries: uses of each registered tag, and which are new
    r = registry_register(spark, folder)
    return r.groupBy("canonical").agg(F.sum("uses").alias("uses"), F.bool_or(F.col("how") == "new").alias("is_new"), F.count_if(F.col("how") == "similar").alias("spellings"))


# --- parties and members -------------------------------------------------------------------------------------------------

_PARTIES = """
WITH o AS (SELECT organization AS g FROM vcards UNION ALL SELECT organization FROM google_contacts UNION ALL SELECT organization FROM contact_entries),
b AS (SELECT trim(regexp_replace(regexp_replace(g, '\\([^)]*\\)', '', 'g'), '^[^\\p{L}\\p{N}]+', '')) AS g FROM o WHERE g IS NOT NULL),
s AS (
  SELECT CASE WHEN contains(g, ' <> ') THEN string_split(g, ' <> ') WHEN contains(g, ' x ') THEN string_split(g, ' x ') WHEN contains(g, ' X ') THEN string_split(g, ' X ') WHEN contains(g, ' & ') THEN string_split(g, ' & ')
    WHEN contains(g, ' <-> ') THEN string_split(g, ' <-> ') WHEN contains(g, ' | ') THEN string_split(g, ' | ') WHEN contains(g, ' / ') THEN string_split(g, ' / ') ELSE CASE WHEN length(g) > 2 THEN [g] ELSE [] END END AS parts, g FROM b),
p AS (SELECT trim(unnest(parts)) AS party FROM s),
n AS (SELECT party, count(*) AS n FROM p WHERE length(party) > 1 GROUP BY 1)
SELECT party, n, CASE WHEN regexp_matches(lower(party), 'labs|capital|ventures|fund|group|inc|ltd|exchange|\\.com|\\.io|network|finance|global|solutions|tech|dao|protocol|foundation') THEN 'company' WHEN contains(lower(party), 'chain') THEN 'project' ELSE 'company' END AS kind,
  CASE WHEN n > 1000 THEN 4 WHEN n > 300 THEN 3 WHEN n > 100 THEN 2 ELSE 1 END AS relevance,
  CASE WHEN regexp_matches(lower(party), 'labs|capital|ventures') THEN 'investor' ELSE 'partner' END AS relation,
  array_to_string(list_sort(list_concat(CASE WHEN regexp_matches(lower(party), 'eth|bzz|defi|web3|crypto|chain|dao') THEN ['web3', 'blockchain'] ELSE [] END, CASE WHEN regexp_matches(lower(party), 'network|infrastructure|protocol|storage') THEN ['infrastructure'] ELSE [] END,
    CASE WHEN regexp_matches(lower(party), 'capital|ventures|fund|trading|exchange') THEN ['finance'] ELSE [] END, CASE WHEN regexp_matches(lower(party), 'ai|gordon') THEN ['ai'] ELSE [] END, CASE WHEN regexp_matches(lower(party), 'market|liquidity|maker') THEN ['market_making'] ELSE [] END))[1:5], ',') AS industries
FROM n"""


@query(_PARTIES)
def party_occurrences(spark, folder):
    names = table(spark, folder, "vcards").select("organization").unionByName(table(spark, folder, "google_contacts").select("organization")).unionByName(table(spark, folder, "contact_entries").select("organization"))
    n = names.select(F.explode(text.parties(F.col("organization"))).alias("party")).where(F.length("party") > 1).groupBy("party").agg(F.count(F.lit(1)).alias("n"))
    who = F.array("party")
    return n.select("party", "n", text.party_class(F.col("party")).alias("kind"), text.relevance_tier(F.col("n")).alias("relevance"), text.group_relation(who).alias("relation"), F.array_join(text.group_industries(who), ",").alias("industries"))


_MEMBERS_SQL = f"""
WITH {EM_SQL},
kept AS (SELECT thread FROM em WHERE thread IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
msgs AS (SELECT thread, from_email AS who, at_s FROM em WHERE thread IN (SELECT thread FROM kept) AND from_email <> '' AND from_email NOT IN (SELECT lower(trim(address)) FROM mailboxes WHERE address IS NOT NULL)),
g AS (SELECT who, thread, count(*) AS messages, min(at_s) AS first_at, max(at_s) AS last_at FROM msgs GROUP BY 1, 2),
p AS (SELECT who, count(*) AS threads, sum(messages)::BIGINT AS messages, min(first_at) AS first_at, max(last_at) AS last_at FROM g GROUP BY 1)
"""


def _members(spark, folder) -> DataFrame:
    """(who, thread, messages, first_at, last_at): who but the owners of mailboxes wrote how often in each thread of two mails or more."""
    mails = materialise(emails(spark, folder).where("thread IS NOT NULL").select("thread", F.col("from_email").alias("who"), "at_s"), "mails")
    g = mails.groupBy("who", "thread").agg(F.count(F.lit(1)).alias("messages"), F.min("at_s").alias("first_at"), F.max("at_s").alias("last_at"))
    kept = mails.groupBy("thread").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("thread")
    owners = table(spark, folder, "mailboxes").select(F.lower(F.trim("address")).alias("who")).where("who IS NOT NULL").distinct()
    return g.join(kept, "thread", "left_semi").where("who <> ''").join(owners, "who", "left_anti")


@query(_MEMBERS_SQL + "SELECT * FROM g")
def group_membership(spark, folder):
    return _members(spark, folder).select("who", "thread", "messages", "first_at", "last_at")


@query(_MEMBERS_SQL + "SELECT p.*, who IN (SELECT lower(trim(email)) FROM contacts WHERE email IS NOT NULL) AS known FROM p ORDER BY messages DESC, who LIMIT 200")
def members_top(spark, folder):
    totals = _members(spark, folder).groupBy("who").agg(F.count(F.lit(1)).alias("threads"), F.sum("messages").alias("messages"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    top = ranking.top_k(totals, [F.desc("messages"), F.col("who")], 200)
    known = table(spark, folder, "contacts").select(F.lower(F.trim("email")).alias("who"), F.lit(True).alias("known")).where("who IS NOT NULL").distinct()
    return top.join(known, "who", "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query(_MEMBERS_SQL + "SELECT count(*) AS people, count(*) FILTER (WHERE threads = 1) AS in_one, count(*) FILTER (WHERE threads > 1) AS in_several, count(*) FILTER (WHERE threads >= 5) AS in_five FROM p")
def member_classes(spark, folder):
    n = _members(spark, folder).groupBy("who").agg(F.count(F.lit(1)).alias("threads"))
    return n.agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("threads") == 1).alias("in_one"), F.count_if(F.col("threads") > 1).alias("in_several"), F.count_if(F.col("threads") >= 5).alias("in_five"))


@query(_MEMBERS_SQL + "SELECT who, threads, messages FROM p WHERE threads >= 5 ORDER BY threads DESC, messages DESC, who LIMIT 20")
def connectors(spark, folder):
    n = _members(spark, folder).groupBy("who").agg(F.count(F.lit(1)).alias("threads"), F.sum("messages").alias("messages")).where("threads >= 5")
    return ranking.top_k(n, [F.desc("threads"), F.desc("messages"), F.col("who")], 20)


# the groups are named by parties that the test tables have at every size
_INSTRUCTIONS = [("Ledger, Partners and Studio weekly", "send the weekly digest"), ("Labs / Media / Games", "ask before adding people"), ("Foundation board", "board members only")]


@query("SELECT entry_id, word, CASE WHEN contains('foundation board', word) THEN 'board members only' WHEN contains('labs / media / games', word) THEN 'ask before adding people' WHEN contains('ledger, partners and studio weekly', word) THEN 'send the weekly digest' END AS instruction FROM (SELECT entry_id, lower(list_extract(string_split(trim(organization), ' '), -1)) AS word FROM contact_entries WHERE trim(organization) <> '') WHERE instruction IS NOT NULL")
def contact_instructions(spark, folder):
    word = F.lower(F.try_element_at(F.split(F.trim("organization"), " "), F.lit(-1)))
    e = table(spark, folder, "contact_entries").where("trim(organization) <> ''").select("entry_id", word.alias("word"))
    return e.withColumn("instruction", text.instruction_for(F.col("word"), _INSTRUCTIONS)).where("instruction IS NOT NULL")


# --- entities and contacts -----------------------------------------------------------------------------------------------

@query("""
WITH e AS (SELECT entity_id, lower(trim(name)) AS name FROM extracted_entities WHERE trim(name) <> ''), c AS (SELECT lower(trim(organization)) AS name, min(entry_id) AS entry_id FROM contact_entries WHERE trim(organization) <> '' GROUP BY 1),
n AS (SELECT DISTINCT name FROM e),
x AS (SELECT n.name, c.entry_id, CASE WHEN n.name = c.name THEN 0 ELSE 1 END AS k FROM n JOIN c ON contains(n.name, c.name) OR contains(c.name, n.name))
SELECT e.entity_id, m.entry_id, CASE m.k WHEN 0 THEN 'exact' ELSE 'contained' END AS how FROM e JOIN (SELECT name, arg_min(entry_id, (k, entry_id)) AS entry_id, min(k) AS k FROM x GROUP BY 1) m USING (name)""")
def entity_contact_match(spark, folder):
    return resolve.named_or_contained(table(spark, folder, "extracted_entities"), "entity_id", "name", table(spark, folder, "contact_entries"), "entry_id", "organization")


@query("SELECT min(entity_id) AS entity_id, lower(trim(name)) AS name, entity_type, 'draft' AS status, max(confidence) AS confidence FROM extracted_entities WHERE trim(name) <> '' AND confidence > 0.8 AND lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM contact_entries WHERE name IS NOT NULL) AND lower(trim(name)) NOT IN (SELECT lower(trim(organization)) FROM contact_entries WHERE organization IS NOT NULL) GROUP BY 2, 3")
def entity_drafts(spark, folder):
    sure = table(spark, folder, "extracted_entities").where("trim(name) <> '' AND confidence > 0.8").groupBy(F.lower(F.trim("name")).alias("name"), "entity_type").agg(F.min("entity_id").alias("entity_id"), F.max("confidence").alias("confidence"))
    e = table(spark, folder, "contact_entries")
    known = e.select(F.explode(F.array(F.lower(F.trim("name")), F.lower(F.trim("organization")))).alias("name")).where("name IS NOT NULL").distinct()
    return sure.join(known, "name", "left_anti").select("entity_id", "name", "entity_type", F.lit("draft").alias("status"), "confidence")


@query(f"{_PEOPLE}, {_score_sql('f', '2025-06-30')} SELECT c.row_id, f.contact, round(f.score, 6) AS score, f.status FROM channel_interactions c JOIN m ON m.origin = 'channel_interactions' AND m.record_id = c.row_id LEFT JOIN named n ON n.email = lower(trim(c.contact)) JOIN f ON f.contact = coalesce(n.contact, lower(trim(c.contact))) WHERE lower(trim(c.interaction_type)) = 'meeting' AND m.utc_second BETWEEN epoch(TIMESTAMP '2025-06-01') AND epoch(TIMESTAMP '2025-06-30')")
def meeting_scores(spark, folder):
    from kinweave.operators.dates import message_moments

    people = table(spark, folder, "contacts").select(F.lower(F.trim("name")).alias("named"), F.lower(F.trim("email")).alias("who")).where("named <> '' AND who <> ''").groupBy("who").agg(F.min("named").alias("named"))
    rows = table(spark, folder, "channel_interactions").where(F.lower(F.trim("interaction_type")) == "meeting").select("row_id", "mailbox_id", "date", F.lower(F.trim("contact")).alias("who"))
    held = message_moments(rows, table(spark, folder, "mailboxes")).where("utc_second BETWEEN unix_timestamp(TIMESTAMP'2025-06-01 00:00:00') AND unix_timestamp(TIMESTAMP'2025-06-30 00:00:00')")
    held = held.join(people, "who", "left").select("row_id", F.coalesce("named", "who").alias("contact"))
    return held.join(_scores(spark, folder).select("contact", "score", "status"), "contact")


@query(f"WITH {EM_SQL}, c AS (SELECT lower(trim(email)) AS email, min(id) AS id FROM contacts WHERE email IS NOT NULL GROUP BY 1) SELECT e.email_id, c.id AS contact_id FROM em e LEFT JOIN c ON c.email = e.from_email")
def mail_contacts(spark, folder):
    # a newsletter may send a third of all mails: its contact goes to them by broadcast
    raw = table(spark, folder, "emails").select(F.lower(F.trim("from_email")).alias("email"))
    heavy = heavy_or_none(raw, "email", raw.count())
    mails = emails(spark, folder).select("email_id", F.col("from_email").alias("email"))
    known = table(spark, folder, "contacts").where("email IS NOT NULL").groupBy(F.lower(F.trim("email")).alias("email")).agg(F.min("id").alias("contact_id"))
    return lookup_join(mails, "email", known, heavy).select("email_id", "contact_id")


@query(f"WITH {IM_SQL}, s AS (SELECT contact_id, count(*) AS n FROM im WHERE at_s BETWEEN epoch(DATE '{AS_OF}' - INTERVAL 365 DAY) AND epoch(DATE '{AS_OF}') AND contact_id IS NOT NULL GROUP BY 1) SELECT c.id, c.email, coalesce(s.n, 0) AS last_year FROM contacts c LEFT JOIN s ON s.contact_id = c.id")
def contact_activity(spark, folder):
    within = f"at_s BETWEEN unix_timestamp(DATE'{AS_OF}' - INTERVAL 365 DAYS) AND unix_timestamp(DATE'{AS_OF}')"
    s = interactions(spark, folder).where("contact_id IS NOT NULL").where(within).groupBy(F.col("contact_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "contacts").select("id", "email").join(s, "id", "left").select("id", "email", F.coalesce("n", F.lit(0)).alias("last_year"))
