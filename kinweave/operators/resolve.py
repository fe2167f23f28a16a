"""Similarity joins, staged matching, validation and merging of entity records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from kinweave.operators import local_names
from kinweave.plans.lineage import materialise
from kinweave.plans.skew import heavy_or_none, lookup_join


def letters(name: Column) -> Column:
    """63 bits: in each of 21 classes of letters as many as the name has of them, 3 at most. An edit sets or clears one at most of each."""
    at = lambda c: (F.ascii(c) % 21 * 3).cast("int")
    field = lambda bits, c: F.call_function("shiftright", bits, at(c)).bitwiseAND(F.lit(7).cast("long"))
    more = lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", (field(bits, c) * 2 + 1).bitwiseAND(F.lit(7).cast("long")), at(c)))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1))), F.lit(0).cast("long"), more)


def letter_pairs(name: Column) -> Column:
    """64 bits: those that the name's neighbouring letters hash to. An edit takes away two at most and adds two at most."""
    two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(2)))
    bit = lambda pair: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(pair), F.lit(64)).cast("int"))
    return F.aggregate(two, F.lit(0).cast("long"), lambda bits, pair: bits.bitwiseOR(bit(pair)))


#: Pairs of names of one kind beyond which all are tried in tasks that hold the names; below, and for names that differ by less than WIDE of their letters, a join on pieces finds the candidates.
MANY, WIDE = 1_000_000, 0.25
#: Names of a kind that one task takes at once, and the most it may hold of each of two blocks; how many blocks a kind is cut into where BLOCK would give more.
BLOCK, MOST, BLOCKS = 4096, 65_536, 8


def similar_names(df: DataFrame, key: str, kind: str, name: str, least: float = 0.7) -> DataFrame:
    """(a, b, similarity): keys of records of one kind whose names are similar, one row per pair of different names' keys.

    similarity is 1 - levenshtein / length of the longer, in lower case. Equal names are first made one (the smallest
    key stands for them, see exact_groups), so copies are never expanded into pairs. Null names count as empty and match
    nothing. Both ways to find the pairs are exact.
    """
    share = 1.0 - least
    n = df.select(F.lower(F.coalesce(F.col(kind), F.lit(""))).alias("kind"), F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))).alias("name"), F.col(key).alias("key")).where("name <> ''")
    n = n.groupBy("kind", "name").agg(F.min("key").alias("key")).withColumn("len", F.length("name"))
    close = None
    if share > WIDE:
        # pieces are three letters long or four, and so many names share them that trying all pairs is less work
        n = materialise(n, "names")
        sizes = n.groupBy("kind").agg(F.count_if(F.col("len") <= local_names.LONGEST).alias("n"), F.max("len").alias("longest"))
        all_of = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"), F.max("longest").alias("longest"), F.sum(F.when(F.col("n") <= BLOCK, F.col("n"))).alias("few")).first()
        if (all_of.pairs or 0) > MANY:
            close = _close_in_blocks(n.where(F.col("len") <= local_names.LONGEST), share, sizes.where(F.col("n") > BLOCK).select("kind", "n").collect(), all_of.few or 0)
            if all_of.longest > local_names.LONGEST:
                close = close.unionByName(_close_by_pieces(n, share, local_names.LONGEST))
    if close is None:
        close = _close_by_pieces(n, share)
    pairs = close.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "la", "d").distinct()
    return pairs.select("a", "b", F.round(1 - F.col("d") / F.col("la"), 6).alias("similarity"))


def _close_in_blocks(n: DataFrame, share: float, large: list[Row], few: int) -> DataFrame:
    """(ka, kb, la, d): the pairs of names of one kind within the edits of the longer (of la letters), d edits apart.

    n(kind, name, key). A kind of large (kind, n) is cut into blocks by its names' hash, and a task tries the pairs of two
    blocks or of one; the other kinds, few names in all, are tried whole, several in a task.
    """
    marks, tasks = [], 0
    for kind, count in large:
        blocks = max(-(-count // MOST), min(BLOCKS, -(-count // BLOCK)))
        marks.append((kind, blocks, tasks))
        tasks += blocks * (blocks + 1) // 2
    bins = max(1, -(-few // BLOCK))
    of = F.broadcast(n.sparkSession.createDataFrame(marks, "kind string, blocks int, first int"))
    rows = n.join(of, "kind", "left").withColumn("block", F.pmod(F.xxhash64("name"), F.coalesce("blocks", F.lit(1))).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    task = F.when(F.col("blocks").isNull(), tasks + F.pmod(F.xxhash64("kind"), F.lit(bins))).otherwise(F.col("first") + F.floor(high * (high + 1) / 2) + low).cast("int")
    # side: 0 for both sides of a block with itself, else 1 and 2
    rows = rows.select(task.alias("task"), F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"), "kind", "name", "key")

    def run(batches):
        if not (batches := [b for b in batches if b.num_rows]):
            return
        held = pa.Table.from_batches(batches)
        names, keys = held["name"].to_pylist(), held["key"].combine_chunks()
        kinds = held["kind"].combine_chunks().dictionary_encode().indices.to_numpy()
        side, alphabet = held["side"].to_numpy(), local_names.Alphabet(names)
        group = np.stack([held["task"].to_numpy(), kinds])
        order = np.lexsort(group)
        cuts = np.flatnonzero((np.diff(group[:, order], axis=1) != 0).any(axis=0)) + 1
        for own in np.split(order, cuts):
            part = [local_names.by_length(names, own[side[own] == s], alphabet) for s in range(3)]
            for x, y, same in ((part[0], part[0], True), (part[1], part[2], False)):
                for i, j, d, longest in local_names.similar(x, y, share, same):
                    columns = [keys.take(pa.array(i)), keys.take(pa.array(j)), pa.array(np.full(len(i), longest, np.int32)), pa.array(d.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["ka", "kb", "la", "d"])

    spread = rows.repartitionById(tasks + bins, F.col("task"))
    return spread.mapInArrow(run, f"ka {n.schema['key'].dataType.simpleString()}, kb {n.schema['key'].dataType.simpleString()}, la int, d int")


def _close_by_pieces(n: DataFrame, share: float, over: int = 0) -> DataFrame:
    """As _close_in_blocks, of n(kind, name, key, len), the pairs whose longer name has more than `over` letters; a pair found by several pieces comes several times.

    Candidates share a piece: a name within k edits of another has one of k + 1 pieces unchanged. Of several such pieces one
    is found where at most i edits lie before piece i and k - i after it, so the piece joins by its place too, shifted by i
    at most, and the lengths bound the shift from the end. Of these, the join itself drops pairs whose letters or pairs of
    letters differ by more than the edits can change, and the bounded distance decides. No pair is lost.
    """
    n = n.where(F.col("len") >= int(over * (1 - share))).select("*", letters(F.col("name")).alias("one"), letter_pairs(F.col("name")).alias("two"))
    # edits that a pair with this name as its longer member may have
    n = n.withColumn("k", F.floor(F.col("len") * share + 1e-9).cast("int"))
    cut = lambda i: F.floor(i * F.col("len") / (F.col("k") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(i.alias("i"), cut(i).alias("at"), (cut(i + 1) - cut(i)).alias("w")))
    longer = n.where(F.col("len") > over).select("kind", F.col("name").alias("a"), F.col("key").alias("ka"), F.col("len").alias("la"), F.col("k").alias("edits"), F.col("one").alias("one_a"), F.col("two").alias("two_a"), F.explode(F.filter(pieces, lambda p: p.w > 0)).alias("p"))
    longer = longer.select("*", F.expr("substring(a, p.at + 1, p.w)").alias("gram"), F.explode(F.sequence(-F.col("p.i"), F.col("p.i"))).alias("shift"))
    longer = longer.select("kind", "a", "ka", "la", "edits", "one_a", "two_a", F.col("p.i").alias("i"), F.col("p.w").alias("w"), "gram", "shift", (F.col("p.at") + F.col("shift")).alias("pos")).where("pos >= 0")
    # as many widths as names have lengths, and fewer
    widths = longer.select("w").distinct()
    grams = n.join(F.broadcast(widths), F.col("len") >= F.col("w")).select("kind", F.col("name").alias("b"), F.col("key").alias("kb"), F.col("len").alias("lb"), F.col("one").alias("one_b"), F.col("two").alias("two_b"), "w", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("len") - F.col("w") + 1), lambda i: F.substring(F.col("name"), i, F.col("w")))).alias("pos", "gram"))
    near = "(lb < la OR (lb = la AND a < b)) AND la - lb <= edits AND abs(shift - (lb - la)) <= edits - i"
    alike = " AND ".join(f"bit_count({own} & ~{other}) <= {most}" for own, other, most in (("one_a", "one_b", "edits"), ("one_b", "one_a", "edits"), ("two_a", "two_b", "2 * edits"), ("two_b", "two_a", "2 * edits")))
    pairs = longer.join(grams, ["kind", "w", "gram", "pos"]).where(f"{near} AND {alike}")
    return pairs.select("a", "b", "ka", "kb", "la", F.expr("levenshtein(a, b, edits)").alias("d")).where("d >= 0").select("ka", "kb", "la", "d")


def exact_groups(df: DataFrame, key: str, kind: str, name: str) -> DataFrame:
    """(key, class_key): of each record, the smallest key with the same kind and name in lower case.

    A name that very many records share goes to them by broadcast.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    n = df.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(kind), F.lit(""))).alias("_kind"), low(name).alias("_name")).where("_name <> ''").select("key", F.concat_ws("\n", "_kind", "_name").alias("_group"))
    classes = n.groupBy("_group").agg(F.min("key").alias("class_key"), F.count(F.lit(1)).alias("_n"))
    return lookup_join(n, "_group", classes.drop("_n"), heavy_or_none(n, "_group", n.count())).select("key", "class_key")


def primary(values: Column, kinds: list[str]) -> Column:
    """The value of the first entry of one of the kinds, else of the first entry: values is an array of (type, value)."""
    fit = F.filter(values, lambda e: F.upper(e.type).isin(kinds))
    return F.coalesce(F.get(fit, F.lit(0)).value, F.get(values, F.lit(0)).value)


def merge_candidates(df: DataFrame, key: str, keys: dict[str, Column]) -> DataFrame:
    """(key, merge_with, reason): records that share a value with an earlier one, which is the smallest key that has it.

    keys: for each reason an array of values; null and empty ones are shared by nobody. Each record is linked to the
    first of its value's group, never to all others of it.
    """
    parts = [df.select(F.lit(reason).alias("reason"), F.col(key).alias("_key"), F.explode(F.array_distinct(values)).alias("_v")).where("_v <> ''") for reason, values in keys.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.withColumn("_value", F.concat_ws("\n", "reason", "_v"))
    firsts = rows.groupBy("_value").agg(F.min("_key").alias("merge_with"))
    found = lookup_join(rows, "_value", firsts, heavy_or_none(rows, "_value", rows.count())).where("_key <> merge_with")
    return found.select(F.col("_key").alias(key), "merge_with", "reason").distinct()


def named_or_contained(left: DataFrame, key: str, name: str, right: DataFrame, other: str, other_name: str) -> DataFrame:
    """(key, other, how): of each left record the right one of the same name (`exact`), else one whose name contains it or is
    contained in it (`contained`); the smallest other key of several. Names compare trimmed and in lower case; empty ones match nothing.

    Distinct names only are compared: the longer one's pieces of every length that occurs among the other side's names are
    joined to those names by equality, so no pair of names is tried that shares nothing.
    """
    low = lambda c: F.lower(F.trim(F.col(c)))
    own = left.select(key, low(name).alias("name")).where("name <> ''")
    names = own.select("name").distinct()
    facts = right.select(low(other_name).alias("fact"), F.col(other).alias("_other")).where("fact <> ''").groupBy("fact").agg(F.min("_other").alias(other))

    def pieces(rows: DataFrame, column: str, widths: DataFrame) -> DataFrame:
        sized = rows.join(F.broadcast(widths), F.length(column) >= F.col("w"))
        cut = F.transform(F.sequence(F.lit(1), F.length(column) - F.col("w") + 1), lambda i: F.substring(F.col(column), i, F.col("w")))
        return sized.select("*", F.explode(F.array_distinct(cut)).alias("piece")).drop("w")

    lengths = lambda rows, c: rows.select(F.length(c).alias("w")).distinct()
    inside = pieces(names, "name", lengths(facts, "fact")).join(facts.withColumnRenamed("fact", "piece"), "piece").select("name", F.col("piece").alias("fact"), other)
    around = pieces(facts, "fact", lengths(names, "name")).join(names.withColumnRenamed("name", "piece"), "piece").select(F.col("piece").alias("name"), "fact", other)
    rank = F.struct(F.when(F.col("name") == F.col("fact"), 0).otherwise(1).alias("k"), F.col(other))
    best = inside.unionByName(around).groupBy("name").agg(F.min(rank).alias("m"))
    facts = best.select("name", F.col(f"m.{other}").alias(other), F.when(F.col("m.k") == 0, "exact").otherwise("contained").alias("how"))
    return lookup_join(own, "name", facts, heavy_or_none(own, "name", own.count())).where(F.col("how").isNotNull()).select(key, other, "how")


#: Over how many tasks the values of one name's records are spread.
SPREAD = 16


def duplicate_pairs(df: DataFrame, key: str, kind: str, name: str, organization: str, channels: list[str], least: float = 0.7) -> DataFrame:
    """(a, b, similarity, same_org, shared, class), a < b: records of one kind whose names are similar, linked by representatives.

    Records of equal names are linked to the smallest key among them, which represents them (similarity 1); representatives
    of similar names are linked to each other, where same_org and shared tell whether any two records of theirs have that in
    common. likely: over 0.95, or one of the channels (columns) is filled and equal; possible: over 0.85, or the
    organization is equal; else review. Nameless records match nothing. No link between different names is lost, and copies
    are not expanded into all pairs.
    """
    labels = {c: c.split(".")[-1] for c in channels}
    groups = materialise(exact_groups(df, key, kind, name), "classes")
    cells = F.array(F.struct(F.lit("org").alias("field"), F.col(organization).alias("value")), *[F.struct(F.lit(labels[c]).alias("field"), F.nullif(F.col(c), F.lit("")).alias("value")) for c in channels])
    facts = groups.join(df.select(F.col(key).alias("key"), F.explode(cells).alias("c")), "key").select("class_key", "key", "c.field", "c.value").where("value IS NOT NULL")
    facts = materialise(facts, "facts")
    # of each representative to the other records of its name
    own = facts.where("class_key = key").select("class_key", "field", F.col("value").alias("of_first"))
    inner = groups.where("class_key <> key").select(F.col("class_key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    told = lookup_values(facts.where("class_key <> key"), own).groupBy(F.col("class_key").alias("a"), F.col("key").alias("b")).agg(F.collect_set("field").alias("fields"))
    # of each representative to those of similar names: a value in common of any of their records
    near = materialise(similar_names(df, key, kind, name, least), "near")
    values = facts.select("class_key", "field", "value").distinct().withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SPREAD)).cast("int"))
    spread = near.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    mine = spread.join(values.withColumnRenamed("class_key", "a"), ["a", "salt"])
    both = mine.join(values.withColumnRenamed("class_key", "b"), ["b", "salt", "field", "value"]).groupBy("a", "b").agg(F.collect_set("field").alias("fields"))
    links = inner.join(told, ["a", "b"], "left").unionByName(near.join(both, ["a", "b"], "left"))
    has = lambda f: F.coalesce(F.array_contains("fields", f), F.lit(False))
    shared = F.concat_ws(",", *[F.when(has(labels[c]), labels[c]) for c in channels])
    out = links.select("a", "b", "similarity", has("org").alias("same_org"), shared.alias("shared"))
    sure = (F.col("similarity") > 0.95) | (F.col("shared") != "")
    return out.withColumn("class", F.when(sure, "likely").when((F.col("similarity") > 0.85) | F.col("same_org"), "possible").otherwise("review"))


def lookup_values(rows: DataFrame, first: DataFrame) -> DataFrame:
    """rows(class_key, key, field, value) whose value is that of their class's first record."""
    keyed = rows.withColumn("cell", F.concat_ws("\n", F.col("class_key").cast("string"), "field"))
    facts = first.select(F.concat_ws("\n", F.col("class_key").cast("string"), "field").alias("cell"), "of_first")
    return lookup_join(keyed, "cell", facts, heavy_or_none(keyed, "cell", keyed.count())).where("value = of_first")


def _stages(left: DataFrame, right: DataFrame, key: str, other: str, stages: list[tuple[str, str, float]]) -> DataFrame:
    """(key, rank, place, other, stage, confidence): every left value that some right record holds, whose owner is the smallest other key.

    A value that very many left records hold (a switchboard) goes to them by broadcast.
    """
    found = None
    for rank, (column, label, sure) in enumerate(stages):
        own = left.select(key, F.posexplode(column).alias("place", "value")).where("value <> ''")
        owners = right.select(other, F.explode(column).alias("value")).where("value <> ''").groupBy("value").agg(F.min(other).alias(other))
        hit = lookup_join(own, "value", owners, heavy_or_none(own, "value", own.count())).where(F.col(other).isNotNull())
        part = hit.select(key, F.lit(rank).alias("rank"), "place", other, F.lit(label).alias("stage"), F.lit(sure).alias("confidence"))
        found = part if found is None else found.unionByName(part)
    return found


def _first_stage(found: DataFrame, key: str, other: str) -> DataFrame:
    best = found.groupBy(key).agg(F.min_by(F.struct(other, "stage", "confidence"), F.struct("rank", "place", other)).alias("m"))
    return best.select(key, f"m.{other}", "m.stage", "m.confidence")


def staged_match(left: DataFrame, right: DataFrame, key: str, other: str, stages: list[tuple[str, str, float]]) -> DataFrame:
    """(key, other, stage, confidence): of each left record the match of its first stage that has one.

    stages: (array column of both sides, label, confidence) in order of trust; every value of the left is tried in its
    order against every value of the right. Null and empty values match nothing.
    """
    return _first_stage(_stages(left, right, key, other, stages), key, other)


def duplicate_check(left: DataFrame, right: DataFrame, key: str, other: str, stages: list[tuple[str, str, float]], name: str, least: float = 0.85, trust: float = 0.7) -> DataFrame:
    """As staged_match, with a last stage `similar`: records without another match take the smallest owner of a name that is
    equal or of similarity over least, with trust times the similarity.
    """
    found = _stages(left, right, key, other, stages)
    low = F.lower(F.trim(F.col(name)))
    own = left.select(key, low.alias("value")).where("value <> ''")
    owners = right.select(other, low.alias("value")).where("value <> ''").groupBy("value").agg(F.min(other).alias(other))
    names = own.select("value").unionByName(owners.select("value")).distinct()
    near = similar_names(names.select(F.col("value").alias("key"), F.lit("").alias("kind"), F.col("value").alias("name")), "key", "kind", "name", least).where(F.col("similarity") > least)
    both = near.select(F.col("a").alias("value"), F.col("b").alias("near"), "similarity").unionByName(near.select(F.col("b").alias("value"), F.col("a").alias("near"), "similarity"))
    both = both.unionByName(owners.select("value", F.col("value").alias("near"), F.lit(1.0).alias("similarity")))
    # the best owner of each distinct name first, then the names' records: a name of very many records is one row of the first join
    best = both.join(owners.withColumnRenamed("value", "near"), "near").groupBy("value").agg(F.min_by(F.struct(other, "similarity"), other).alias("b"))
    hit = lookup_join(own, "value", best, heavy_or_none(own, "value", own.count())).where(F.col("b").isNotNull())
    last = hit.select(key, F.lit(len(stages)).alias("rank"), F.lit(0).alias("place"), f"b.{other}", F.lit("similar").alias("stage"), F.round(trust * F.col("b.similarity"), 6).alias("confidence"))
    return _first_stage(found.unionByName(last), key, other)


def merge_pairs(pairs: DataFrame, records: DataFrame, key: str, fields: list[str], newer: str, lists: list[str] = ()) -> DataFrame:
    """(a, b, keep, filled, conflicts, united, action_required): which record of each pair stays, the fields it takes from
    the other, those that differ, the lists that grow by the other's members, and whether someone must decide.

    The one with the later `newer` stays, ties and nulls keep a. lists: array columns, of which both records' members stay.
    """
    side = lambda s: records.select(F.col(key).alias(s), F.struct(*fields, *lists, newer).alias(f"r{s}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    take_b = F.coalesce(F.col(f"rb.{newer}") > F.coalesce(F.col(f"ra.{newer}"), F.lit("")), F.lit(False))
    empty = lambda c: c.isNull() | (c == "")
    none = F.array().cast("array<string>")
    filled, clash, grown = [], [], []
    for f in fields:
        keep, other = F.when(take_b, F.col(f"rb.{f}")).otherwise(F.col(f"ra.{f}")), F.when(take_b, F.col(f"ra.{f}")).otherwise(F.col(f"rb.{f}"))
        filled.append(F.when(empty(keep) & ~empty(other), f))
        clash.append(F.when(~empty(keep) & ~empty(other) & (keep != other), f))
    for f in lists:
        keep, other = F.when(take_b, F.col(f"rb.{f}")).otherwise(F.col(f"ra.{f}")), F.when(take_b, F.col(f"ra.{f}")).otherwise(F.col(f"rb.{f}"))
        grown.append(F.when(F.size(F.array_except(F.coalesce(other, none), F.coalesce(keep, none))) > 0, f))
    conflicts = F.concat_ws(",", *clash)
    return j.select("a", "b", F.when(take_b, F.col("b")).otherwise(F.col("a")).alias("keep"), F.concat_ws(",", *filled).alias("filled"), conflicts.alias("conflicts"), F.concat_ws(",", *grown).alias("united"), (conflicts != "").alias("action_required"))


def validation_issues(df: DataFrame, key: str, required: list[str], allowed: dict[str, list[str]], dated: str, as_of: str, stale_days: int = 180) -> DataFrame:
    """(key, issue, field): required fields that are empty, values out of their list, and records untouched for too long."""
    row = lambda cond, issue, field: F.when(cond, F.struct(F.lit(issue).alias("issue"), F.lit(field).alias("field")))
    tests = [row(F.col(c).isNull() | (F.trim(F.col(c)) == ""), "incomplete", c) for c in required]
    tests += [row(F.col(c).isNotNull() & (F.trim(F.col(c)) != "") & ~F.col(c).isin(v), "invalid", c) for c, v in allowed.items()]
    tests.append(row(F.datediff(F.lit(as_of).cast("date"), F.col(dated)) > stale_days, "stale", dated))
    return df.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*tests))).alias("x")).select("key", "x.issue", "x.field")


def keep_best(df: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """The row of each key with the highest score, ties to the smallest order."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc_nulls_last(), F.col(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
