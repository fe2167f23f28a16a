"""Text expressions: keywords, normal forms, links, glob rules and pattern extraction, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = (
    "re fwd fw the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would "
    "could should may might must this that these those i you he she it we they my your his her its our their what which who whom whose "
    "when where why how all each every both few more most other some such no nor not only own same so than too very just "
    "about up down out off over under"
).split()

# Texts by which a sender is told to be a machine, a newsletter, a service or a platform, in order of precedence.
SENDER_PATTERNS = [
    ("automated", ["noreply", "no-reply", "donotreply", "notifications@", "alert@", "alerts@", "system@", "mailer@", "daemon@", "postmaster@", "bounce@", "auto@", "automated@"]),
    ("newsletter", ["newsletter", "news@", "digest@", "weekly@", "daily@", "updates@", "marketing@", "info@", "hello@", "team@", "mail.beehiiv.com", "substack.com", "mailchimp.com", "sendgrid.net", "constantcontact.com"]),
    ("transactional", ["receipt", "invoice", "order", "confirmation", "booking", "support@", "help@", "service@", "billing@"]),
    ("social", ["linkedin.com", "twitter.com", "facebook.com", "github.com", "slack.com", "discord.com", "telegram.org", "zoom.us"]),
]

# Texts that ask for an answer.
QUESTION_MARKERS = ["?", "let me know", "thoughts", "what do you think", "when", "how about"]

# Words that tell the kind of an interaction, in order of precedence.
INTERACTION_WORDS = [
    ("meeting", ["met", "meeting", "met with", "call with", "spoke"]),
    ("email", ["email", "sent", "received", "replied"]),
    ("message", ["message", "dm", "chat"]),
    ("call", ["called", "phone", "rang"]),
]

# Words that tell an industry.
INDUSTRY_WORDS = {
    "storage": ["storage", "ipfs", "filecoin", "arweave", "backup"], "defi": ["defi", "swap", "liquidity", "lending", "yield", "amm"],
    "nft": ["nft", "marketplace", "collectible", "art"], "web3": ["web3", "decentralized", "blockchain", "crypto"],
    "ai_ml": ["ai", "ml", "machine learning", "artificial intelligence", "llm"], "identity": ["identity", "did", "credential", "verification", "ssi"],
    "privacy": ["privacy", "zero knowledge", "zk", "encryption"], "rwa": ["rwa", "real world asset", "tokenization", "real estate"],
    "data_infrastructure": ["data", "infrastructure", "api", "indexing"],
}

# What makes a capitalised phrase a company, a role, a project or an event.
COMPANY_SUFFIXES = ["Inc", "Corp", "Corporation", "Ltd", "Limited", "GmbH", "Labs", "Protocol", "Foundation", "Network", "DAO", "Technologies", "Ventures", "Capital"]
EVENT_WORDS = ["conference", "summit", "meetup", "hackathon", "workshop", "symposium", "expo", "week"]
PROJECT_WORDS = ["protocol", "platform", "network", "chain", "token", "blockchain", "mainnet", "testnet", "DAO", "dApp"]


#: Where no ASCII letter, digit or underscore stands before or after: the same in every regular expression library.
START, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def keywords(text: Column, most: int = 10) -> Column:
    """Distinct words of three letters or more that are no stop words, in order, at most `most`."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"{START}([a-z]{{3,}}){END}"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS))), 1, most)


def bare_subject(subject: Column) -> Column:
    """The subject in lower case without leading reply and forward marks."""
    return F.trim(F.regexp_replace(F.lower(F.trim(subject)), r"^((re|fwd?|aw|wg)\s*:\s*)+", ""))


def kebab(text: Column) -> Column:
    t = F.regexp_replace(F.trim(F.lower(text)), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^-|-$", "")


def digits_of(phone: Column) -> Column:
    return F.nullif(F.regexp_replace(phone, r"[^0-9]", ""), F.lit(""))


def domain_of(address: Column) -> Column:
    """What follows the last @ in lower case; null without one."""
    return F.when(F.contains(address, F.lit("@")), F.lower(F.substring_index(address, "@", -1)))


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def first_class(text: Column, classes: list[tuple[str, list[str]]], other: str) -> Column:
    """The first class one of whose words the text contains, in lower case."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(other)
    for name, words in reversed(classes):
        out = F.when(contains_any(low, words), name).otherwise(out)
    return out


def sender_type(address: Column, name: Column | None = None, own_domain: str = "") -> Column:
    """The class of a sender by address, then `forwarded` by a display name that says so, else `personal`.

    A name with "via zapier" is forwarded, and one with "via" at own_domain.
    """
    by_address = first_class(address, SENDER_PATTERNS, "")
    if name is None:
        return F.when(by_address == "", "personal").otherwise(by_address)
    low = F.lower(F.coalesce(name, F.lit("")))
    relayed = low.contains("via zapier") | (low.contains("via") & F.coalesce(F.lower(address).contains("@" + own_domain), F.lit(False)) if own_domain else F.lit(False))
    return F.when(by_address != "", by_address).when(relayed, "forwarded").otherwise("personal")


def asks(text: Column) -> Column:
    """Whether the text asks for an answer."""
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), QUESTION_MARKERS)


def interaction_kind(text: Column) -> Column:
    return first_class(text, INTERACTION_WORDS, "mention")


def industries(text: Column, most: int = 3) -> Column:
    """The first industries whose words the text contains, in the fixed order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    marks = F.array(*[F.when(contains_any(low, words), name) for name, words in INDUSTRY_WORDS.items()])
    return F.slice(F.array_compact(marks), 1, most)


#: [[Name]] and [[Name|alias]].
LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def wiki_links(text: Column) -> Column:
    """Names in [[Name]] and [[Name|alias]]."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.trim(x))


def without_links(text: Column) -> Column:
    """The text with the name in place of each link."""
    return F.regexp_replace(text, LINK, "$1")


def shortened(text: Column, most: int = 100) -> Column:
    """At most `most` signs, the last three of them dots where something was cut off."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


# What separates the parties in a group's name, in order of precedence.
GROUP_SEPARATORS = [" <> ", " x ", " X ", " & ", " <-> ", " | ", " / "]


def parties(group: Column) -> Column:
    """The parties that a group's name joins: split at the first separator of the list that occurs, notes in brackets and
    signs in front taken off; parts of one letter are dropped, and a name without separator stands for itself."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(group, r"\([^)]*\)", ""), r"^[^\p{L}\p{N}]+", ""))
    out = F.when(F.length(bare) > 2, F.array(bare)).otherwise(F.array().cast("array<string>"))
    for sep in reversed(GROUP_SEPARATORS):
        parts = F.transform(F.split(bare, "\\Q" + sep + "\\E"), lambda x: F.trim(x))
        out = F.when(F.contains(bare, F.lit(sep)), F.filter(parts, lambda x: F.length(x) > 1)).otherwise(out)
    return F.when(group.isNotNull(), out)


def snippet_around(text: Column, start: Column, length: Column, margin: int = 50) -> Column:
    """The text from margin signs before start (from 1) to margin after its end, without words cut at either side."""
    lo = F.greatest(start - margin, F.lit(1))
    cut = F.substring(text, lo, length + (start - lo) + margin)
    inside = (lo > 1) & ~F.substring(text, lo - 1, F.lit(1)).rlike(r"\s")
    cut = F.when(inside, F.regexp_replace(cut, r"^\S*\s", "")).otherwise(cut)
    return F.trim(F.when(lo + F.length(cut) - 1 < F.length(text), F.regexp_replace(cut, r"\s\S*$", "")).otherwise(cut))


def glob_regex(glob: str) -> str:
    """A shell pattern as an anchored regular expression."""
    special = {"*": ".*", "?": "."}
    return "^" + "".join(special.get(c, "\\" + c if c in ".+(){}|^$\\" else c.replace("!", "^") if c == "!" else c) for c in glob) + "$"


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1), line of each line of the text."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("k", "line")).select(key, (F.col("k") + 1).cast("long").alias("line_no"), "line")


def _split(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(text).isNotNull()).select(key, F.split(F.regexp_replace(text, "\r", ""), "\n").alias("_lines"))


def with_heading(df: DataFrame, key: str, text: str, pattern: str = r"^#+\s+(.+)$") -> DataFrame:
    """(key, line_no from 1, line, heading): each line of the text with the last heading at or above it, null above the first.

    A text is cut into sections where it stands, so no line is shuffled or sorted. Null texts have no lines.
    """
    own = _split(df, key, text).withColumn("_own", F.transform("_lines", lambda x: F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))))
    starts = F.filter(F.sequence(F.lit(0), F.size("_own") - 1), lambda i: (i == 0) | F.get("_own", i).isNotNull())
    cut = own.select(key, "_lines", "_own", starts.alias("_starts"), F.size("_own").alias("_n"))
    section = lambda s, k: F.struct(F.get("_own", s).alias("heading"), s.alias("start"), F.slice("_lines", s + 1, F.coalesce(F.get("_starts", k + 1), F.col("_n")) - s).alias("body"))
    sections = cut.select(key, F.explode(F.transform("_starts", section)).alias("_s"))
    return sections.select(key, "_s.start", "_s.heading", F.posexplode("_s.body").alias("k", "line")).select(key, (F.col("start") + F.col("k") + 1).cast("long").alias("line_no"), "line", "heading")


def with_context(df: DataFrame, key: str, text: str, most: int = 500) -> DataFrame:
    """(key, line_no from 1, line, context): each line with its neighbours, joined by blanks and cut to most characters."""
    cut = _split(df, key, text).withColumn("_n", F.size("_lines"))
    beside = lambda x, i: F.struct(x.alias("line"), F.substring(F.concat_ws(" ", F.get("_lines", i - 1), x, F.get("_lines", i + 1)), 1, most).alias("context"))
    found = cut.select(key, F.posexplode(F.transform("_lines", beside)).alias("k", "c"))
    return found.select(key, (F.col("k") + 1).cast("long").alias("line_no"), "c.line", "c.context")


def body_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of a note's body: without the settings at its head, blank lines and headings.

    Lines count from the end of the settings.
    """
    bare = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?s)\A---.*?---", "")
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(bare, "\n")).alias("k", "line"))
    return lines.where(F.col("line").rlike(r"[^\s\p{Z}]") & ~F.col("line").startswith("#")).select(key, (F.col("k") + 1).cast("long").alias("line_no"), "line")


# Parts of a name by which a party is a company or else a project, in order of precedence.
COMPANY_INDICATORS = ["labs", "capital", "ventures", "fund", "group", "inc", "ltd", "exchange", ".com", ".io", "network", "finance", "global", "solutions", "tech", "dao", "protocol", "foundation"]
PROJECT_INDICATORS = ["chain", "network", "protocol"]
# Parts of group names by which industries are told.
GROUP_INDUSTRIES = [
    (["web3", "blockchain"], ["eth", "bzz", "defi", "web3", "crypto", "chain", "dao"]),
    (["infrastructure"], ["network", "infrastructure", "protocol", "storage"]),
    (["finance"], ["capital", "ventures", "fund", "trading", "exchange"]),
    (["ai"], ["ai", "gordon"]),
    (["market_making"], ["market", "liquidity", "maker"]),
]
# Parts of group names by which a relationship is told, in order of precedence within a name.
GROUP_RELATIONS = [("investor", ["labs", "capital", "ventures"]), ("partner", ["exchange", ".com", ".io", "listing", "ama"])]
# Parts of domains by which a circle of contacts is named, in order of precedence.
THEMES = [
    ("Legal Contacts", ["law", "legal"]), ("Investors & VCs", [".vc", "capital", "ventures", "usv"]), ("Academic Network", [".edu", "university", "research"]),
    ("Personal Contacts", ["gmail", "yahoo", "outlook"]),
]


def party_class(name: Column, own: list[str] = ()) -> Column:
    """`company` or `project` by parts of the name, `company` where none tells; null for one's own names."""
    low = F.lower(name)
    kind = F.when(contains_any(low, COMPANY_INDICATORS), "company").when(contains_any(low, PROJECT_INDICATORS), "project").otherwise("company")
    return F.when(name.isNotNull() & ~contains_any(low, list(own)), kind)


def group_industries(groups: Column, most: int = 5) -> Column:
    """Sorted industries that the names of groups (an array) tell, at most `most`."""
    none = F.array().cast("array<string>")
    tells = lambda words: F.exists(groups, lambda g: contains_any(F.lower(F.coalesce(g, F.lit(""))), words))
    found = [F.when(tells(words), F.array(*map(F.lit, tags))).otherwise(none) for tags, words in GROUP_INDUSTRIES]
    return F.slice(F.array_sort(F.flatten(F.array(*found))), 1, most)


def group_relation(groups: Column) -> Column:
    """The relationship that the first telling group name tells; `partner` where none does."""
    told = F.transform(groups, lambda g: F.nullif(first_class(g, GROUP_RELATIONS, ""), F.lit("")))
    return F.coalesce(F.get(F.array_compact(told), F.lit(0)), F.lit("partner"))


def relevance_tier(messages: Column) -> Column:
    """4 for over 1,000 messages, 3 for over 300, 2 for over 100, else 1."""
    return F.when(messages > 1000, 4).when(messages > 300, 3).when(messages > 100, 2).otherwise(1)


def theme_of(domains: Column) -> Column:
    """The theme of a circle by its domains (an array): a named one, else the first domain's first label as a network."""
    joined = F.array_join(domains, " ")
    out = F.concat(F.initcap(F.get(F.split(F.get(domains, F.lit(0)), r"\."), F.lit(0))), F.lit(" Network"))
    for name, words in reversed(THEMES):
        out = F.when(contains_any(joined, words), name).otherwise(out)
    return F.when(F.size(domains) > 0, out)


def instruction_for(name: Column, instructions: list[tuple[str, str]]) -> Column:
    """The instruction of the last group whose name contains the contact's; null for none. Names compare in lower case."""
    out = F.lit(None).cast("string")
    for group, text in instructions:
        out = F.when(F.lit(group.lower()).contains(F.lower(name)), text).otherwise(out)
    return out
