"""Tags of addresses by a table of rules: exact domains, patterns of domains and of addresses, custom texts, top-level domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.text import domain_of, glob_regex

# Tags of domains, of domains by pattern, of addresses by pattern of what stands before the @, and of top-level domains.
DOMAIN_TAGS = {
    "usv.com": "investor vc", "a16z.com": "investor vc", "pantera.capital": "investor vc", "sequoiacap.com": "investor vc",
    "paradigm.xyz": "investor vc crypto", "polychain.capital": "investor vc crypto", "dragonfly.xyz": "investor vc crypto",
    "google.com": "tech bigtech", "microsoft.com": "tech bigtech", "apple.com": "tech bigtech", "amazon.com": "tech bigtech", "meta.com": "tech bigtech",
    "ethereum.org": "crypto ethereum", "consensys.net": "crypto ethereum", "protocol.ai": "crypto filecoin",
    "edu": "academic", "ac.uk": "academic", "uni-*.de": "academic",
    "gov": "government", "europa.eu": "government eu",
}
DOMAIN_PATTERNS = {
    "*-law.*": "legal", "*.legal.*": "legal", "*.health": "medical", "clinic*": "medical", "doctor*": "medical", "*.vc": "investor vc", "*capital.*": "investor",
    "*ventures.*": "investor vc", "*.edu": "academic", "*.ac.*": "academic", "*.gov": "government", "*.gov.*": "government",
}
ADDRESS_PATTERNS = {
    "newsletter@*": "newsletter", "news@*": "newsletter", "digest@*": "newsletter", "weekly@*": "newsletter", "daily@*": "newsletter", "updates@*": "newsletter",
    "noreply@*": "automated", "no-reply@*": "automated", "notifications@*": "automated", "support@*": "support", "help@*": "support", "sales@*": "sales",
    "info@*": "generic", "hello@*": "generic", "team@*": "generic", "marketing@*": "marketing", "pr@*": "marketing pr",
}
TOP_LEVEL_TAGS = {"edu": "academic", "gov": "government", "io": "tech", "xyz": "tech", "eth": "tech"}

#: (kind, pattern, tags): domain, domain_glob, address_glob, top_level, or custom (a text in the address or the name).
RULES = [
    *[("domain", k, v) for k, v in DOMAIN_TAGS.items()],
    *[("domain_glob", k, v) for k, v in DOMAIN_PATTERNS.items()],
    *[("address_glob", k, v) for k, v in ADDRESS_PATTERNS.items()],
    *[("top_level", k, v) for k, v in TOP_LEVEL_TAGS.items()],
]


def tags_of(address: Column, rules: list[tuple[str, str, str]] | None = None, name: Column | None = None) -> Column:
    """The sorted tags of all rules that an address (or, for custom rules, its name) meets; none without an @, null for null.

    The rules become one expression, so a table of addresses is tagged in its scan's stage without a join.
    """
    low, found = F.lower(F.trim(address)), []
    local = F.substring_index(low, "@", 1)
    domain = F.when(F.contains(low, F.lit("@")), F.substring(low, F.instr(low, "@") + 1, F.length(low)))
    top = F.substring_index(domain, ".", -1)
    who = F.lower(F.coalesce(name, F.lit(""))) if name is not None else F.lit("")
    for kind, pattern, tags in RULES if rules is None else rules:
        if kind == "domain":
            hit = domain == pattern
        elif kind == "top_level":
            hit = top == pattern
        elif kind == "custom":
            hit = F.contains(low, F.lit(pattern)) | F.contains(who, F.lit(pattern))
        else:
            hit = domain.rlike(glob_regex(pattern)) if kind == "domain_glob" else local.rlike(glob_regex(pattern.split("@")[0]))
        found.append(F.when(domain.isNotNull() & hit, F.array(*map(F.lit, tags.split()))))
    none = F.array().cast("array<string>")
    parts = F.transform(F.array(*found), lambda x: F.coalesce(x, none))
    return F.when(address.isNotNull(), F.array_sort(F.array_distinct(F.flatten(parts))))


def is_investor(tags: Column) -> Column:
    return F.coalesce(F.array_contains(tags, "investor") | F.array_contains(tags, "vc"), F.lit(False))


def is_internal(address: Column, own_domains: list[str]) -> Column:
    """Whether the address belongs to one of one's own domains."""
    return F.coalesce(domain_of(F.lower(F.trim(address))).isin(own_domains), F.lit(False))


def tagged(df: DataFrame, address: str, tags: str, overwrite: bool = False, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """df with tags merged into, or put in place of, the tags it has."""
    new = tags_of(F.col(address), rules)
    return df.withColumn(tags, new if overwrite else F.array_sort(F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))))


def rule_table(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """Rules kind|pattern|tags from a delimited text, or contact_tags of a YAML file (a list of texts per tag, as custom rules).

    A table of rules is small by nature (refused over 10,000).
    """
    if path.endswith((".yml", ".yaml")):
        import yaml

        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
        found = (yaml.safe_load(text) or {}).get("contact_tags") or {}
        return [("custom", str(p).lower(), tag) for tag, patterns in found.items() for p in patterns]
    rows = spark.read.option("sep", "|").schema("kind string, pattern string, tags string").csv(path).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 tag rules")
    return [(r.kind, r.pattern, r.tags) for r in rows]
