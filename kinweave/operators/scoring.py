"""Relationship scores and classes as column expressions and grouped aggregates; `as_of` replaces any clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of an interaction by its kind, and of the parts of a score.
DEPTH_WEIGHTS = {"meeting": 1.0, "call": 0.8, "email": 0.5, "message": 0.4, "mention": 0.2}
OTHER_DEPTH = 0.2
SCORE_WEIGHTS = {"recency": 0.4, "frequency": 0.3, "depth": 0.2, "reciprocity": 0.1}


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole periods of 24 hours between two moments, rounded down."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)


def direction_class(sent: Column, received: Column) -> Column:
    total = sent + received
    ratio = F.try_divide(sent, total)
    return F.when(total == 0, "unknown").when(ratio > 0.7, "mostly_sent").when(ratio < 0.3, "mostly_received").otherwise("balanced")


def frequency_tier(total: Column) -> Column:
    return F.when(total >= 50, "high").when(total >= 10, "medium").when(total >= 3, "low").otherwise("minimal")


def recency_status(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days <= 14, "active").when(days <= 30, "warming").when(days <= 60, "cooling").otherwise("dormant")


def score_status(score: Column) -> Column:
    return F.when(score > 0.7, "active").when(score > 0.5, "warming").when(score > 0.4, "cooling").otherwise("dormant")


def reciprocity_even(sent: Column, received: Column) -> Column:
    """1 where both sides write as much, 0 where one does not write at all or nobody does."""
    return F.coalesce(F.lit(1.0) - 2 * F.abs(F.try_divide(sent, sent + received) - 0.5), F.lit(0.0))


def reciprocity_minmax(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.least(a, b), F.greatest(a, b)), F.lit(0.0))


def relationship_scores(rows: DataFrame, contact: str, moment: str, kind: str, as_of: str, window_days: int = 30, contacts: DataFrame | None = None) -> DataFrame:
    """One row per contact: recency, frequency, depth, score (unrounded parts to 9 digits) and status.

    recency exp(-days/30) since the last interaction, frequency the interactions of the last window_days by 4 (1 at most),
    depth the mean weight of the kinds, reciprocity taken as 0.5. Rows without contact are left out, rows without moment
    count for depth only. contacts: a table of the one column contact, all of whose (distinct) rows come out, those without
    interactions too; interactions of others are then left out. One aggregation with map-side partials: a contact with a
    third of all rows is no burden.
    """
    now = F.lit(as_of).cast("timestamp")
    weights = F.create_map(*[F.lit(x) for kv in DEPTH_WEIGHTS.items() for x in kv])
    depth = F.coalesce(F.try_element_at(weights, F.lower(F.col(kind))), F.lit(OTHER_DEPTH))
    recent = F.col(moment) >= now - F.expr(f"INTERVAL {int(window_days)} DAYS")
    g = rows.where(F.col(contact).isNotNull()).groupBy(F.col(contact).alias("contact")).agg(F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("n_recent"), F.max(moment).alias("last_at"), F.avg(depth).alias("depth"))
    if contacts is not None:
        g = contacts.where("contact IS NOT NULL").distinct().join(g, "contact", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_recent", "depth")})
    g = g.withColumn("days_since", elapsed_days(now, F.col("last_at")))
    g = g.withColumn("recency", F.coalesce(F.exp(-F.col("days_since") / 30), F.lit(0.0))).withColumn("frequency", F.least(F.col("n_recent") / 4, F.lit(1.0)))
    w = SCORE_WEIGHTS
    score = w["recency"] * F.col("recency") + w["frequency"] * F.col("frequency") + w["depth"] * F.col("depth") + w["reciprocity"] * 0.5
    return g.withColumn("score", score).select("contact", "n", "days_since", *[F.round(c, 6).alias(c) for c in ("recency", "frequency", "depth", "score")], score_status(F.col("score")).alias("status"))


def correspondence_metrics(contacts: DataFrame, as_of: str) -> DataFrame:
    """email with frequency (messages a month since first seen), reciprocity and recency (2.718^(-days/90))."""
    day = F.lit(as_of).cast("date")
    total = F.col("sent_count") + F.col("received_count")
    months = F.greatest(F.datediff(day, F.col("first_seen")), F.lit(1)) / 30
    recency = F.pow(F.lit(2.718), -F.datediff(day, F.col("last_seen")) / 90)
    return contacts.select("email", F.round(F.try_divide(total, months), 6).alias("frequency"), F.round(reciprocity_even(F.col("sent_count"), F.col("received_count")), 6).alias("reciprocity"), F.round(recency, 6).alias("recency"))


def span_frequency(total: Column, first_at: Column, last_at: Column) -> Column:
    """Messages a month (of 30 days) between the first and the last second of contact, one month at least."""
    days = F.greatest(F.floor((last_at - first_at) / 86_400), F.lit(1))
    return total / F.greatest(days / 30, F.lit(1.0))
