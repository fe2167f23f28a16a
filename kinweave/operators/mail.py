"""Predicates and classes of mails and their senders, and the history of a correspondence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.text import contains_any, domain_of, glob_regex

# Texts in a sender's address or header that mark a newsletter or a machine.
NEWSLETTER_PATTERNS = [
    "substack.com", "beehiiv.com", "mailchimp.com", "sendgrid.net", "constantcontact.com", "getrevue.co", "convertkit.com",
    "newsletter", "news@", "digest@", "weekly@", "daily@", "updates@", "info@", "hello@", "team@", "marketing@",
]
AUTOMATED_PATTERNS = [
    "noreply", "no-reply", "donotreply", "notifications@", "alert@", "alerts@", "system@", "mailer@", "daemon@", "postmaster@", "bounce@", "auto@", "automated@",
    "notifications@github.com", "noreply@github.com", "calendar-notification@google.com", "drive-shares-noreply@google.com", "linkedin.com", "facebook.com", "twitter.com",
]
# The sender of code notifications, and words that are no topics of a subject.
GITHUB_SENDER = "notifications@github.com"
TOPIC_STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might must shall can need "
    "this that these those i you he she it we they me him her us them my your his its our their what which who whom when where why how all each every both few more most other "
    "some such no not only same so than too very just about into over after before between under again then once here there any if because until while during through above below "
    "up down out re fwd fw subject please thanks thank hi hello dear best regards sincerely cheers"
).split()


def _matches_globs(domain: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | domain.rlike(glob_regex(g))
    return hit


def excluded_sender(address: Column, globs: list[str]) -> Column:
    """Whether mails of this address are left out: its domain meets a shell pattern, or it is no address at all."""
    return F.coalesce(_matches_globs(domain_of(address), globs), F.lit(True))


def sensitive_mail(addresses: Column, globs: list[str]) -> Column:
    """Whether the domain of any of the addresses (an array) meets one of the shell patterns; null counts as none."""
    return F.coalesce(F.exists(addresses, lambda a: F.coalesce(_matches_globs(domain_of(a), globs), F.lit(False))), F.lit(False))


def personal_sender(address: Column, header: Column) -> Column:
    """Whether neither the address nor the header marks a newsletter or a machine."""
    both = F.lower(F.concat_ws("\n", address, header))
    return ~contains_any(both, NEWSLETTER_PATTERNS + AUTOMATED_PATTERNS)


def kept_mails(mails: DataFrame, excluded: list[str], sensitive: list[str], address: str = "from_email", name: str = "from_name", to: str = "to_emails", cc: str = "cc_emails") -> DataFrame:
    """Mails that pass the filter chain, with the column sensitive: a sender who is present, not excluded and personal."""
    none = F.array().cast("array<string>")
    people = F.concat(F.array(address), F.coalesce(to, none), F.coalesce(cc, none))
    kept = mails.where(~excluded_sender(F.col(address), excluded) & personal_sender(F.col(address), F.col(name)))
    return kept.withColumn("sensitive", sensitive_mail(people, sensitive))


def mailbox_category(address: Column, newsletters: list[str], automated: list[str]) -> Column:
    """`github`, `newsletters` or `automated` by the sender's whole address, else null; lists of addresses in lower case."""
    low = F.lower(F.trim(address))
    return F.when(low == GITHUB_SENDER, "github").when(low.isin(newsletters), "newsletters").when(low.isin(automated) & ~low.contains("github.com"), "automated")


def topic_words(subject: Column) -> Column:
    """Words of a subject that can be topics: lower case, one leading reply mark off, three letters or more."""
    bare = F.regexp_replace(F.lower(subject), r"^(re:|fwd?:|fw:)\s*", "")
    words = F.regexp_extract_all(bare, F.lit(r"(?<![a-z0-9_])([a-z]{3,})(?![a-z0-9_])"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(TOPIC_STOP_WORDS))


def search_name(name: Column) -> Column:
    """A name as it is searched for: signs taken off, and what follows a dash with it."""
    bare = F.regexp_replace(name, r"(?U)[^\w\s\-']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\s*-\s*[^-]+$", ""), r"(?U)\s+", " "))


def name_matches(wanted: Column, found: Column) -> Column:
    """Whether two names are the same, or share the first word, or (of two words or more) the last; false for null or blank."""
    parts = lambda c: F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")
    a, b = parts(wanted), parts(found)
    first = F.get(a, F.lit(0)) == F.get(b, F.lit(0))
    last = (F.size(a) > 1) & (F.size(b) > 1) & (F.try_element_at(a, F.lit(-1)) == F.try_element_at(b, F.lit(-1)))
    return F.coalesce((F.lower(wanted) == F.lower(found)) | first | last, F.lit(False)) & F.coalesce(F.trim(found) != "", F.lit(False))


def merged_directions(received: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    """received and what of sent has no key in it, with the column direction: the received copy of a mail wins."""
    return received.withColumn("direction", F.lit("received")).unionByName(sent.join(received.select(key), key, "left_anti").withColumn("direction", F.lit("sent")))


def topic_union(old: Column, new: Column, most: int = 50) -> Column:
    """Both lists in order, each value once, at most `most`."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none))), 1, most)


def top_topics(rows: DataFrame, contact: str, subject: str, order: list[str], most: int = 5) -> DataFrame:
    """(contact, topic, n, rank): the most frequent topic words of each contact, ties to the first that appeared.

    order: columns by which messages are in order. Words are counted per contact with map-side partials; no window sees
    more than a contact's distinct words.
    """
    words = rows.where(F.col(subject).isNotNull()).select(contact, F.struct(*order).alias("o"), F.posexplode(topic_words(F.col(subject))).alias("k", "topic"))
    counts = words.groupBy(contact, "topic").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "k")).alias("first"))
    w = Window.partitionBy(contact).orderBy(F.desc("n"), "first", "topic")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most).select(contact, "topic", "n", "rank")
