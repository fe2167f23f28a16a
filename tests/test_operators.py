from datetime import date

from pyspark.sql import functions as F

from kinweave.operators import graph, ranking, resolve, scoring, tagging, text


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_class_boundaries(spark):
    df = spark.createDataFrame([(7, 3), (3, 7), (8, 2), (0, 0), (2, 8)], "s long, r long")
    assert [r[0] for r in df.select(scoring.direction_class(F.col("s"), F.col("r"))).collect()] == ["balanced", "balanced", "mostly_sent", "unknown", "mostly_received"]
    df = spark.createDataFrame([(x,) for x in (2, 3, 9, 10, 49, 50)], "n long")
    assert [r[0] for r in df.select(scoring.frequency_tier(F.col("n"))).collect()] == ["minimal", "low", "low", "medium", "medium", "high"]
    df = spark.createDataFrame([(x,) for x in (14, 15, 30, 31, 60, 61, None)], "n long")
    assert [r[0] for r in df.select(scoring.recency_status(F.col("n"))).collect()] == ["active", "warming", "warming", "cooling", "cooling", "dormant", "unknown"]


def test_scores(spark):
    rows = [("a", "2025-01-31", "meeting")] * 4 + [("b", "2025-01-24", k) for k in ("meeting", "call", "odd")] + [("c", "2024-12-02", "mention"), ("d", None, "email"), (None, "2025-01-01", "call")]
    df = spark.createDataFrame(rows, "who string, at string, kind string").withColumn("at", F.to_timestamp("at"))
    got = {r.contact: r for r in scoring.relationship_scores(df, "who", "at", "kind", "2025-01-31").collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert abs(got["a"].score - 0.95) < 1e-6 and got["a"].status == "active"
    assert abs(got["b"].score - 0.72509) < 1e-4 and abs(got["b"].depth - 0.66667) < 1e-4
    assert abs(got["c"].score - 0.14413) < 1e-4 and got["d"].recency == 0


def test_correspondence_metrics(spark):
    day = date(2025, 12, 31)
    rows = [("x", 22, 25, date.fromordinal(day.toordinal() - 700), date.fromordinal(day.toordinal() - 5)), ("y", 3, 1, day, day), ("z", None, None, None, None)]
    df = spark.createDataFrame(rows, "email string, sent_count long, received_count long, first_seen date, last_seen date")
    got = {r.email: r for r in scoring.correspondence_metrics(df, "2025-12-31").collect()}
    assert (round(got["x"].frequency, 5), round(got["x"].reciprocity, 5), round(got["x"].recency, 5)) == (2.01429, 0.93617, 0.94596)
    assert (got["y"].frequency, got["y"].reciprocity, got["y"].recency) == (120.0, 0.5, 1.0)


def test_top_k_ties_and_groups(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("g", 3, None), ("h", 4, 1)], "g string, id long, v long")
    assert values(ranking.top_k(df, [F.col("v").desc_nulls_last(), F.col("id")], 2), "id") == [(1,), (2,)]
    assert values(ranking.top_k_per_group(df, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], 1), "g", "id") == [("g", 1), ("h", 4)]
    assert ranking.with_share(df.where("false"), "v").count() == 0


def test_graph_of_the_examples(spark):
    rows = [("t1", x) for x in "abc"] + [("t2", x) for x in "ab"] + [("t3", "d"), (None, "a"), ("t1", None), ("t1", "a")]
    e = graph.coparticipation_edges(spark.createDataFrame(rows, "t string, n string"), "t", "n")
    assert values(e, "src", "dst", "weight") == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    small = graph.coparticipation_edges(spark.createDataFrame(rows, "t string, n string"), "t", "n", most_per_thread=2)
    assert values(small, "src", "dst", "weight") == values(e, "src", "dst", "weight")
    assert {r.centrality for r in graph.degree_centrality(e).collect()} == {1.0}
    path = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, dst string, weight long")
    b = {r.node: r.betweenness for r in graph.betweenness(path).collect()}
    assert abs(b["b"] - 2 / 3) < 1e-6 and abs(b["c"] - 2 / 3) < 1e-6 and b["a"] == b["d"] == 0
    assert {r.node: r.eccentricity for r in graph.eccentricities(path).collect()} == {"a": 3, "b": 2, "c": 2, "d": 3}
    assert graph.graph_stats(path).first().density == 0.5
    assert {r.component for r in graph.components(path).collect()} == {"a"}
    assert graph.components(path.where("false")).count() == 0
    assert graph.communities(path).count() == 4


def test_similar_names_lose_no_pair(spark):
    import itertools
    import random

    rng = random.Random(4)
    base = ["john smith", "jane doe", "acme corp", "abcdefghij", "katharina", "li"]
    names = {"".join(c if rng.random() > 0.15 else rng.choice("abcx ") for c in rng.choice(base)).strip() for _ in range(150)} - {""}
    rows = [(i, "person", n) for i, n in enumerate(sorted(names))] + [(900, "person", None), (901, "person", ""), (902, "firm", "john smith")]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    ids = {n: i for i, n in enumerate(sorted(names))}
    norm = sorted({" ".join([n]) for n in names})
    want = {tuple(sorted((ids[a], ids[b]))) for a, b in itertools.combinations(norm, 2) if lev(a, b) <= int(max(len(a), len(b)) * 0.3 + 1e-9)}
    got = {(r.a, r.b) for r in resolve.similar_names(spark.createDataFrame(rows, "id long, kind string, name string"), "id", "kind", "name", 0.7).collect()}
    assert got == want


def test_validation_and_merge(spark):
    df = spark.createDataFrame([(1, "", "odd", date(2020, 1, 1)), (2, "x", "draft", None), (3, None, None, date(2025, 7, 4))], "id long, name string, status string, d date")
    got = values(resolve.validation_issues(df, "id", ["name"], {"status": ["draft"]}, "d", "2025-12-31"), "key", "issue", "field")
    assert got == [(1, "incomplete", "name"), (1, "invalid", "status"), (1, "stale", "d"), (3, "incomplete", "name")]
    recs = spark.createDataFrame([("a", "Ann", "", "2024"), ("b", "Anne", "CTO", "2025"), ("c", "Ann", None, None)], "k string, name string, role string, updated string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    got = values(resolve.merge_pairs(pairs, recs, "k", ["name", "role"], "updated"), "b", "keep", "filled", "conflicts")
    assert got == [("b", "b", "", "name"), ("c", "a", "", "")]


def test_text_functions(spark):
    df = spark.createDataFrame([("Re: The Partnership proposal and the partnership budget",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.keywords(F.col("t"))).collect()] == [["partnership", "proposal", "budget"], None, []]
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.kebab(F.lit("Real World__Assets "))) == "real-world-assets"
    assert get(text.bare_subject(F.lit("Re: FWD: Plan"))) == "plan"
    assert get(text.interaction_kind(F.lit("Presented roadmap to [[Bo Ray]]"))) == "email"
    assert get(text.wiki_links(F.lit("Met [[Ann Lee|Annie]] and [[Bo]]"))) == ["Ann Lee", "Bo"]
    assert get(text.strip_html(F.lit("<p>a <b>b</b></p>"))) == "a b"
    assert get(text.sender_type(F.lit("noreply@github.com"))) == "automated"
    assert get(text.sender_type(F.lit(None).cast("string"))) == "personal"


def test_parties_and_snippets(spark):
    cases = {"Acme <> Beta x Gamma": ["Acme", "Beta x Gamma"], "🚀 Acme (old) | B": ["Acme"], "Acme": ["Acme"], "ab": [], "": []}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "g string")
    assert {r.g: r.p for r in df.select("g", text.parties(F.col("g")).alias("p")).collect()} == {**cases, None: None}
    line = "one two three four five six seven eight"
    got = spark.range(1).select(text.snippet_around(F.lit(line), F.lit(15), F.lit(4), 6)).first()[0]
    assert got == "three four five"


def test_tags(spark):
    cases = {"fred@usv.com": ["investor", "vc"], "ann@acme-law.eu": ["legal"], "researcher@stanford.edu": ["academic"], "noreply@github.com": ["automated"], "someone@random.com": []}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "e string")
    got = {r.e: r.t for r in df.select("e", tagging.tags_of(F.col("e")).alias("t")).collect()}
    assert got == {**cases, None: None}


def test_written_tables_and_sweep(spark):
    import os

    from kinweave.plans import lineage

    df = lineage.materialise(spark.range(5).withColumn("x", F.lit(None).cast("string")), "t")
    path = df._kinweave_path.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    lineage.sweep(spark)
    assert not os.path.exists(path)
    assert lineage.broadcast_if_small(spark.range(3), 2).count() == 3
