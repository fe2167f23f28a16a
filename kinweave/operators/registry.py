"""A registry of tags that grows by the tags met: each is registered as itself, as another's alias or slip, or as new.

The rule is a fold in the order in which tags are first met: a tag that is neither in the registry nor an alias goes to the
first registered tag less than three edits away, and else becomes one itself. Whether a tag is new hangs only on earlier
tags near it, so the fold is the first independent set in that order of the graph of near tags, which rounds of joins find:
a tag is new once all earlier near tags are known to be none, and is none once an earlier near tag is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.plans.lineage import discard, materialise

#: Fewer edits than this make two tags near.
NEAR = 3


def _less_one(texts: Column) -> Column:
    """All texts that come of the given ones by taking out one sign."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.left(t, i - 1), F.substring(t, i + 1, F.length(t))))
    return F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda t: t != ""), cut)))


def near_tags(tags: DataFrame, tag: str, near: int = NEAR) -> DataFrame:
    """(a, b, edits): every two different tags less than `near` edits apart, both ways.

    Two texts k edits apart have a text in common that comes of each by taking out k signs at most, so they meet in a join
    by equality; the distance decides.
    """
    one, cut = tags.select(F.col(tag).alias("t")).where("t IS NOT NULL").distinct().withColumn("cut0", F.array("t")), ["cut0"]
    for k in range(1, near):
        one = one.withColumn(f"cut{k}", _less_one(F.col(f"cut{k - 1}")))
        cut.append(f"cut{k}")
    all_ = one.select("t", F.explode(F.array_distinct(F.concat(*cut))).alias("part"))
    pairs = all_.select(F.col("t").alias("a"), "part").join(all_.select(F.col("t").alias("b"), "part"), "part").where("a <> b").select("a", "b").distinct()
    return pairs.withColumn("edits", F.levenshtein("a", "b")).where(F.col("edits") < near)


def registered(met: DataFrame, registry: DataFrame) -> DataFrame:
    """(tag, canonical, how, uses): under which registered tag each tag met is counted.

    met: tag (in its normal form), first (its place in the order of meeting), uses. registry: tag, aliases, place (its order
    in the registry). how: `exact`, `alias`, `similar` or `new`. Null and empty tags are left out; repeated ones are summed
    up, the earliest place counts; an alias of several entries means the first of them.
    """
    met = met.where("tag <> ''").groupBy("tag").agg(F.min("first").alias("first"), F.sum("uses").alias("uses"))
    known = registry.where("tag <> ''").groupBy("tag").agg(F.min("place").alias("place"))
    alias = registry.where("tag <> ''").select(F.explode("aliases").alias("tag"), F.struct("place", F.col("tag").alias("canonical")).alias("m")).where("tag <> ''").groupBy("tag").agg(F.min("m").alias("m")).select("tag", "m.canonical")
    own = materialise(met.join(known.select("tag", F.lit(True).alias("exact")), "tag", "left").join(alias, "tag", "left"), "met")
    settled = own.where("exact OR canonical IS NOT NULL").select("tag", F.when(F.col("exact"), F.col("tag")).otherwise(F.col("canonical")).alias("canonical"), F.when(F.col("exact"), "exact").otherwise("alias").alias("how"), "uses")
    open_ = own.where("exact IS NULL AND canonical IS NULL").select("tag", "first", "uses")
    # registered tags come before all that are met
    order = F.struct(F.lit(0).alias("late"), F.col("place").cast("long").alias("at"), F.col("tag"))
    nodes = known.select("tag", order.alias("o"), F.lit("new").alias("state")).unionByName(open_.select("tag", F.struct(F.lit(1).alias("late"), F.col("first").cast("long").alias("at"), F.col("tag")).alias("o"), F.lit(None).cast("string").alias("state")))
    state = materialise(nodes, "tags")
    near = near_tags(nodes, "tag").join(nodes.select(F.col("tag").alias("a"), F.col("o").alias("oa")), "a").join(nodes.select(F.col("tag").alias("b"), F.col("o").alias("ob")), "b")
    earlier = materialise(near.where("ob < oa").select("a", "b", "ob"), "near")
    while state.where("state IS NULL").take(1):
        seen = earlier.join(state.select(F.col("tag").alias("b"), F.coalesce("state", F.lit("open")).alias("s")), "b").groupBy(F.col("a").alias("tag")).agg(F.bool_or(F.col("s") == "new").alias("hit"), F.bool_or(F.col("s") == "open").alias("wait"))
        following = state.join(seen, "tag", "left").withColumn("state", F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("hit"), "none").when(F.coalesce(~F.col("wait"), F.lit(True)), "new"))
        before, state = state, materialise(following.select("tag", "o", "state"), "tags")
        discard(before)
    target = earlier.join(state.where("state = 'new'").select(F.col("tag").alias("b")), "b").groupBy(F.col("a").alias("tag")).agg(F.min(F.struct("ob", "b")).alias("m")).select("tag", F.col("m.b").alias("canonical"))
    ends = open_.join(state.select("tag", "state"), "tag").join(target, "tag", "left")
    found = ends.select("tag", F.when(F.col("state") == "new", F.col("tag")).otherwise(F.col("canonical")).alias("canonical"), F.when(F.col("state") == "new", "new").otherwise("similar").alias("how"), "uses")
    return settled.unionByName(found)
