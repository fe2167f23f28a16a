"""The best representative of each duplicate group, field by field.

Fields are unpivoted to long rows. Each usable value of a group and field collects votes, one per record that holds it:
the trust in the record's source times a decay with its age. The winner is the value with most votes, taken by max_by, and
winners are pivoted back to one row per group. All steps are sums and maxima with map-side partial aggregation, so a group
that holds a large part of all rows is never gathered anywhere.

Age counts from the leader of the group and field, the newest record with a usable value: the leader has age 0, any other
record one day more than it lies behind. Only ratios of votes matter, so this is the same as counting from today. A short
half-life makes the leader win against any number of others: with NEWEST_WINS each of them has less than 2^-64 votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.plans.lineage import materialise
from kinweave.plans.skew import heavy_or_none, lookup_join

# Texts that stand for "not known", in lower case.
NOT_KNOWN = [
    "n/a", "na", "n.a.", "unknown", "not known", "unbekannt", "none", "null", "nil", "nan", "tbd", "tba", "to be added", "to be announced",
    "to be determined", "xxx", "xx", "x", "empty", "(empty)", "see card", "call office", "no mail", "no email", "no phone", "missing", "undefined",
    "not available", "not applicable", "(none)", "(null)", "(unknown)",
]

FIELDS = ["name", "organization", "role", "location", "email", "phone"]
#: Half-life in days under which the newest record outvotes all older ones together, up to 2^64 of them.
NEWEST_WINS = 1 / 64
#: How far an undated record lies behind a dated one.
UNDATED_DAYS = 1_000_000
#: Trust in a record by the space it is kept in, for survivors that are built from votes; others have OTHER_TRUST.
SPACE_TRUST, OTHER_TRUST = {"1-personal": 0.8, "2-work": 1.0, "3-fund": 1.0, "4-research": 0.9, "5-community": 0.7}, 0.5


def usable(field: Column, value: Column) -> Column:
    """Whether the value says something: not null, blank, without letters or digits, or a text for "not known".

    An email must be one whole address, a phone must have five digits at least.
    """
    bare = F.lower(F.regexp_replace(value, r"^[\s ]+|[\s ]+$", ""))
    known = bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(NOT_KNOWN)
    whole = F.when(field == "email", bare.rlike(r"^[^@\s<>,;]+@[^@\s<>,;.]+(\.[^@\s<>,;.]+)+$")).when(field == "phone", F.length(F.regexp_replace(bare, r"[^0-9]", "")) >= 5).otherwise(True)
    return F.coalesce(known & whole, F.lit(False))


def normal_value(field: Column, value: Column) -> Column:
    """The form under which values are the same: digits of a phone, else lower case with single blanks."""
    return F.when(field == "phone", F.regexp_replace(value, r"[^0-9]", "")).otherwise(F.lower(F.trim(F.regexp_replace(value, r"[\s ]+", " "))))


def members(previews: DataFrame, entries: DataFrame) -> DataFrame:
    """(group_id, entry columns): the records that the proposals of a group name, each once.

    Proposals with a null group or key, and keys of no entry, name nobody.
    """
    named = previews.select("group_id", F.explode(F.array("keep", "merge_from")).alias("source_file")).where("group_id IS NOT NULL AND source_file IS NOT NULL").distinct()
    own = entries.select("source_file", "entry_id", "name", "organization", "role", "location", F.col("channels.email").alias("email"), F.col("channels.phone").alias("phone"), F.expr("try_cast(updated AS DATE)").alias("updated"), *(["space"] if "space" in entries.columns else [F.lit(None).cast("string").alias("space")]))
    return materialise(named.join(own, "source_file"), "members")


def long_values(people: DataFrame) -> DataFrame:
    """One row per usable value: group_id, entry_id, updated (a date), space, field, value."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS]))
    long = people.select("group_id", "entry_id", "updated", "space", cells.alias("c")).select("*", "c.field", "c.value").drop("c")
    return long.where(usable(F.col("field"), F.col("value")))


def trust_of(space: Column, trust: dict[str, float] | None) -> Column:
    """The trust in a record by its space; 1 for all without a table of trust."""
    if trust is None:
        return F.lit(1.0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in trust.items() for x in kv]), space), F.lit(OTHER_TRUST))


def winners(long: DataFrame, half_life_days: float, trust: dict[str, float] | None = None) -> DataFrame:
    """(group_id, field, value, votes, entry_id): the value of each group and field with most votes and the newest entry that has it.

    A vote is trust * 2^(-age / half_life_days). Ties go to the newer value, then to the smaller entry_id. A null date is
    the oldest. Empty input gives an empty result.
    """
    newest = F.struct("updated", (-F.col("entry_id")).alias("back"))
    leaders = long.groupBy("group_id", "field").agg(F.max(newest).alias("lead"))
    behind = F.coalesce(F.datediff("lead.updated", "updated"), F.when(F.col("lead.updated").isNull(), 0).otherwise(UNDATED_DAYS))
    age = F.when(F.col("lead.back") == -F.col("entry_id"), 0).otherwise(behind + 1)
    vote = trust_of(F.col("space"), trust) * F.pow(F.lit(2.0), -age / F.lit(float(half_life_days)))
    keyed, key = long.withColumn("cell", F.concat_ws(" ", "group_id", "field")), F.concat_ws(" ", "group_id", "field").alias("cell")
    # the leader of a group of very many records goes to its rows by broadcast
    heavy = heavy_or_none(keyed, "cell", long.count())
    aged = lookup_join(keyed, "cell", leaders.select(key, "lead"), heavy).withColumn("vote", vote)
    votes = aged.groupBy("group_id", "field", normal_value(F.col("field"), F.col("value")).alias("key")).agg(F.sum("vote").alias("votes"), F.max(newest).alias("newest"), F.max_by("value", newest).alias("value"), F.max_by("entry_id", newest).alias("entry_id"))
    best = votes.groupBy("group_id", "field").agg(F.max_by(F.struct("value", "votes", "entry_id"), F.struct(F.round("votes", 9), "newest")).alias("w"))
    return best.select("group_id", "field", "w.value", "w.votes", "w.entry_id")


def pivoted(best: DataFrame) -> DataFrame:
    """One row per group: for each field a struct (value, entry_id), null where no record has a usable value."""
    cell = F.struct("value", "entry_id")
    return best.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == f, cell)).alias(f) for f in FIELDS])


def keepers(people: DataFrame) -> DataFrame:
    """(group_id, entry_id): of each group the entry with most usable fields, then latest updated, then smaller entry_id."""
    n = sum((usable(F.lit(f), F.col(f)).cast("int") for f in FIELDS), F.lit(0))
    return people.groupBy("group_id").agg(F.max_by("entry_id", F.struct(n.alias("n"), F.col("updated"), (-F.col("entry_id")).alias("back"))).alias("entry_id"))


def survivor_choices(previews: DataFrame, entries: DataFrame) -> DataFrame:
    """(group_id, field, entry_id): from which entry each field of the survivor comes, and as field `keep` the entry to keep.

    The survivor's row is that of the votes under NEWEST_WINS, unpivoted. Rows in any order and number give the same
    result; a group none of whose keys names an entry has no rows.
    """
    people = members(previews, entries)
    wide = pivoted(winners(long_values(people), NEWEST_WINS))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).entry_id.alias("entry_id")) for f in FIELDS]))
    chosen = wide.select("group_id", cells.alias("c")).select("group_id", "c.*").where("entry_id IS NOT NULL")
    return chosen.unionByName(keepers(people).select("group_id", F.lit("keep").alias("field"), "entry_id"))


def survivors(previews: DataFrame, entries: DataFrame, half_life_days: float = 365.0, trust: dict[str, float] | None = SPACE_TRUST) -> DataFrame:
    """One built record per group: each field's winning value under votes of trust and age, and the number of its conflicts."""
    long = long_values(members(previews, entries))
    wide = pivoted(winners(long, half_life_days, trust)).select("group_id", *[F.col(f).value.alias(f) for f in FIELDS])
    filled = sum((F.col(f).isNotNull().cast("long") for f in FIELDS), F.lit(0))
    clash = long.groupBy("group_id", "field").agg(F.count_distinct(normal_value(F.col("field"), F.col("value"))).alias("k")).groupBy("group_id").agg(F.count_if(F.col("k") > 1).alias("n_conflicts"))
    return wide.withColumn("n_fields", filled).join(clash, "group_id")
