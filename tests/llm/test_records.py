import random

from conftest import run_oracles

from kinweave.llm import linkage, matching, registry, survivors, tags

SMALL = "/root/testdata/sf0.001"
PAIRS = "contact1 string, contact2 string, similarity double, v long, c string"
ENTRY = "entry_id long, name string, source_file string, organization string, role string, location string, channels struct<email:string,telegram:string,linkedin:string,phone:string>, updated string, value string, field string"
PREVIEW = "preview_id long, group_id long, keep string, merge_from string, field string"


def test_queries_equal_their_sql(spark):
    assert run_oracles(spark, SMALL, registry.QUERIES, registry.ORACLES) == []


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {x: root(x) for x in up}


def groups(spark, rows, **how):
    return {r.contact: r.group_key for r in linkage.linked_groups(spark.createDataFrame(rows, PAIRS), **how).collect()}


def test_linkage_of_a_star_a_chain_and_noise(spark):
    rng = random.Random(2)
    links = [("hub", f"s{i:03}") for i in range(300)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [(f"r{rng.randrange(60):02}", f"r{rng.randrange(60):02}") for _ in range(50)]
    rows = [(a, b, 0.7 + rng.random() * 0.3, 1, "x") if rng.random() < 0.5 else (f" ./{b} ", a, 0.9, 1, None) for a, b in links]
    rows += [("hub", "c000", 0.69, 1, ""), ("hub", "c001", None, 1, ""), ("hub", "c002", float("nan"), 1, ""), (None, "c003", 1.0, 1, ""), ("self", "self", 1.0, 1, ""), ("", "hub", 1.0, 1, "")]
    assert groups(spark, rows) == groups(spark, rows, local_edges=0) == union_find([x for x in links if x[0] != x[1]])


def test_linkage_with_heavy_keys_split(spark, monkeypatch):
    from kinweave.plans import skew

    monkeypatch.setattr(linkage, "heavy_or_none", lambda rows, key, total: skew.heavy_or_none(rows, key, total, 20))
    links = [("hub", f"s{i:03}") for i in range(100)] + [("s001", "t1"), ("u1", "u2")]
    assert groups(spark, [(a, b, 1.0, 0, "") for a, b in links]) == union_find(links)


def test_linkage_of_nothing(spark):
    assert groups(spark, []) == {} and groups(spark, [("a", "b", 0.1, 0, "")]) == {}


def test_survivors(spark):
    ch = lambda email=None, phone=None: (email, None, None, phone)
    rows = [
        (1, "Ann", "a", "Acme", "n/a", None, ch("x@", "12"), "2024-01-01", "v", "f"),
        (2, "Unknown", "b", "Acme", "CTO", " ", ch("ann@x.org", "+1 (2) 345"), "2025-01-01", "v", "f"),
        (3, "Anne", "c", "Beta", "CEO", "Rome", ch("see card", None), "2025-01-01", "v", "f"),
        (4, None, "d", None, None, None, None, None, "v", "f"),
    ]
    entries = spark.createDataFrame(rows, ENTRY)
    previews = spark.createDataFrame([(1, 7, "a", "b", "f"), (2, 7, "b", "c", "f"), (3, 7, "a", "b", "f"), (4, 8, "d", "missing", "f"), (5, None, "a", None, "f")], PREVIEW)
    got = {(r.group_id, r.field): r.entry_id for r in survivors.survivor_choices(previews, entries).collect()}
    assert got == {(7, "name"): 3, (7, "organization"): 2, (7, "role"): 2, (7, "location"): 3, (7, "email"): 2, (7, "phone"): 2, (7, "keep"): 2, (8, "keep"): 4}
    built = {r.group_id: r for r in survivors.survivors(previews, entries, half_life_days=10_000.0).collect()}
    assert built[7].organization == "Acme" and built[7].n_conflicts == 3 and 8 not in built
    assert survivors.survivor_choices(previews.where("false"), entries).count() == 0
    # an undated or foreign date never wins over a day, and extra columns do no harm
    assert got[7, "keep"] == 2
    assert survivors.survivors(previews, entries.where("false")).count() == 0


def test_votes_reach_newest_in_the_limit(spark):
    """300 older records of one value against one newer of another: votes decide by half-life and trust."""
    long = "group_id long, entry_id long, updated date, space string, field string, value string"
    from datetime import date

    rows = [(1, k, date(2025, 1, 1), "a", "role", "CTO") for k in range(300)] + [(1, 900, date(2025, 1, 2), "b", "role", "CEO")]
    rows += [(2, k, date(2025, 1, 1), "a", "role", "x" if k > 5 else "y") for k in range(5, 300)] + [(3, 1, None, "a", "role", "only")]
    df = spark.createDataFrame(rows, long)
    best = lambda **how: {r.group_id: (r.value, r.entry_id) for r in survivors.winners(df, **how).collect()}
    assert best(half_life_days=survivors.NEWEST_WINS) == {1: ("CEO", 900), 2: ("y", 5), 3: ("only", 1)}
    assert best(half_life_days=30.0) == {1: ("CTO", 0), 2: ("x", 6), 3: ("only", 1)}
    assert best(half_life_days=30.0, trust={"a": 0.001, "b": 1.0})[1] == ("CEO", 900)


def test_tags(spark):
    registry_rows = spark.createDataFrame([("real-estate", "Real Estate", ["immobilier"]), ("ai-ml", "Artificial Intelligence", None), ("media", "Media and Publishing", ["journalism"]), ("privacy", "Privacy Technology", []), (None, "x", [])], "tag string, label string, aliases array<string>")
    cases = {
        "Real Estate": "real-estate", "#real_estate ": "real-estate", "REAL-ESTATE company": "real-estate", "Estate, Real": "real-estate", "raal estate": "real-estate", "Ｉｍｍｏｂｉｌｉｅｒ": "real-estate", "realestate": "real-estate",
        "artifical inteligence": "ai-ml", "Media & Publishing": "media", "sector: Journalism": "media", "Privacy Tech": "privacy", "mediation": "(none)", "privateer": "(none)", "": "(none)", "???": "(none)", None: "(none)", "sector": "(none)", "z" * 3000: "(none)",
    }
    rows = [(i, v) for i, v in enumerate(cases)] * 2
    df = spark.createDataFrame(rows, "form long, value string")
    out = tags.mapped_elements(df, registry_rows).collect()
    assert len(out) == len(rows) and {r.value: r.tag for r in out} == cases
    assert {r.value: r.tag for r in tags.mapped_elements(df.limit(2), registry_rows.where("false")).collect()}.popitem()[1] == "(none)"
    assert tags.mapped_elements(df.where("false"), registry_rows).count() == 0
    blocks = tags.map_values(df.where("value <> ''").select(tags.plain("value").alias("form")).where("form <> ''").distinct(), registry_rows, block=2)
    assert {r.form: r.tag for r in blocks.collect()}["real estate"] == "real-estate"


CONTACTS = "id long, email string, name string, domain string, rec string"
GOOGLE = "resource_name string, name string, given_name string, family_name string, emails array<string>, phones array<string>, organization string, person string"
VCARDS = "card_id long, name string, first_name string, last_name string, emails array<struct<type:string,value:string>>, phones array<struct<type:string,value:string>>, organization string, person string"


def people_tables(spark, c=(), g=(), v=()):
    return spark.createDataFrame(list(c), CONTACTS), spark.createDataFrame(list(g), GOOGLE), spark.createDataFrame(list(v), VCARDS)


def test_matching(spark):
    c = [(1, "ann.lee@acme-1.test", "A. Lee", "acme-1.test", "x"), (2, "annlee77@free.example", None, "free.example", "x"), (3, "info@acme-1.test", "Acme", "acme-1.test", "x"), (4, None, None, None, "x"), (5, "zoe@other.test", "Zoé Ruiz", "other.test", "x")]
    g = [("g1", "Lee, Ann", None, None, ["mailto:ANN.LEE+news@acme-1.test"], ["+384 (0)43 762 1914"], "Acme Ltd", "p"), ("g2", "Bob Stone", "Bob", "Stone", ["info@acme-1.test"], ["+384437621914"], "ACME", "p"), ("g3", "", None, None, None, None, None, "p")]
    v = [(10, "Anne Lee", "Ann", "Lee", [("WORK", "annlee77@free.example")], [("CELL", "043 762-1914")], None, "p"), (11, "Lina Lee", "Lina", "Lee", [], [("CELL", "043 762-1914")], None, "p"), (12, "Zoe Ruiz", "Zoe", "Ruiz", None, [("X", "0")], "Elsewhere Inc", "p"), (13, None, None, None, None, None, None, "p")]
    got = {(r.source1, r.key1, r.source2, r.key2): r.confidence for r in matching.same_people(*people_tables(spark, c, g, v)).collect()}
    assert set(got) >= {("contacts", "1", "google_contacts", "g1"), ("contacts", "2", "vcards", "10"), ("google_contacts", "g1", "vcards", "10"), ("contacts", "1", "vcards", "10"), ("contacts", "2", "google_contacts", "g1")}
    assert not [k for k in got if "11" in k or "g2" in k or "3" in k[1:2] or "4" in k[1:2] or "13" in k]
    assert all(0 <= x <= 1 for x in got.values())
    assert matching.same_people(*people_tables(spark)).count() == 0
    assert matching.same_people(*people_tables(spark, c)).count() == 0


def test_window_pairs_cross_blocks_and_equal_keys(spark):
    rows = [("e|same@x|ann lee", "e|same@x", ["ann", "lee"], f"r{i:03}") for i in range(60)]
    df = spark.createDataFrame(rows, "key string, mark string, words array<string>, rec string")
    want = {(f"r{i:03}", f"r{i + k:03}") for i in range(60) for k in range(1, 5) if i + k < 60}
    assert {(r.a, r.b) for r in matching.window_pairs(df, window=5, block=7).collect()} == want
    assert matching.window_pairs(df.where("false")).count() == 0


def test_names_and_numbers():
    assert matching.compare_names(["ann", "lee"], ["ann", "lee"]) == "full" and matching.compare_names(["a", "lee"], ["ann", "lee"]) == "initial"
    assert matching.compare_names(["ann", "lee"], ["bob", "lee"]) == "other" and matching.compare_names([], ["ann", "lee"]) == "none"
    assert matching.name_words("Dr. Lee, Ann B.") == ["ann", "lee"] and matching.name_words("Liz Stone") == ["elizabeth", "stone"]
    assert matching.clean_phone("+999-28-2692722 ext. 48") == matching.clean_phone("028 269-2722") == "282692722"
    assert matching.clean_phone("000000000") is None and matching.clean_email("none@") is None and matching.clean_email(" <A.B+x@Y.org> ") == "a.b@y.org"


def test_assignment_has_the_greatest_total():
    """Against every possible assignment of small graphs."""
    from itertools import product

    rng = random.Random(8)
    for _ in range(300):
        n, m = rng.randrange(1, 5), rng.randrange(1, 5)
        edges = [(f"p{i}", f"q{j}", rng.choice([0.35, 0.4, 0.45, 0.55, 0.5999])) for i in range(n) for j in range(m) if rng.random() < 0.6]
        weight = {(p, q): w for p, q, w in edges}
        best = 0.0
        for choice in product([None, *range(m)], repeat=n):
            used = [j for j in choice if j is not None]
            if len(used) == len(set(used)) and all((f"p{i}", f"q{j}") in weight for i, j in enumerate(choice) if j is not None):
                best = max(best, sum(weight[f"p{i}", f"q{j}"] for i, j in enumerate(choice) if j is not None))
        got = matching.best_assignment(edges)
        assert len({p for p, _ in got}) == len({q for _, q in got}) == len(got)
        assert abs(sum(weight[x] for x in got) - best) < 1e-9


def test_large_parts_are_auctioned(spark):
    """A name that many records share: the auction's total is within its rise of the greatest, part by part."""
    rng = random.Random(9)
    edges = sorted({(f"p{rng.randrange(14):02}", f"q{rng.randrange(12):02}"): rng.choice([0.35, 0.4, 0.4, 0.55]) for _ in range(60)}.items())
    edges = [(p, q, w) for (p, q), w in edges] + [("alone", "one", 0.4), ("left", "x", 0.4), ("left", "y", 0.5), ("right", "x", 0.45)]
    weight = {(p, q): w for p, q, w in edges}
    best = sum(weight[x] for x in matching.best_assignment(edges))
    df = spark.createDataFrame(edges, "p string, q string, confidence double")
    for part_links in (10, 1, 5_000):
        got = [tuple(r) for r in matching.assigned(df, part_links).collect()]
        assert len({p for p, _ in got}) == len({q for _, q in got}) == len(got)
        assert best - 0.01 * len(got) - 1e-9 <= sum(weight[x] for x in got) <= best + 1e-9
    assert matching.assigned(df.where("false")).count() == 0


def test_namesakes_of_two_firms_stay_two(spark):
    """A name alone joins a lone record to the better of two people, and never two people that both have a card."""
    c = [(1, "ann.lee@acme-1.test", "Ann Lee", "acme-1.test", "x"), (2, "ann.lee@beta-2.test", "Ann Lee", "beta-2.test", "x"), (3, "zed@free.example", "Zed Moor", "free.example", "x")]
    g = [("g1", "Ann Lee", None, None, ["ann.lee@acme-1.test"], None, "Acme", "p"), ("g2", "Zed Moor", None, None, [], ["043 762-1999"], None, "p")]
    v = [(10, "Ann Lee", None, None, [("WORK", "ann.lee@acme-1.test")], [], "Acme", "p"), (11, "Ann Lee", None, None, [("WORK", "ann.lee@beta-2.test")], [], "Beta", "p")]
    got = {(r.source1, r.key1, r.source2, r.key2) for r in matching.same_people(*people_tables(spark, c, g, v)).collect()}
    assert got == {("contacts", "1", "google_contacts", "g1"), ("contacts", "1", "vcards", "10"), ("google_contacts", "g1", "vcards", "10"), ("contacts", "2", "vcards", "11"), ("contacts", "3", "google_contacts", "g2")}
