from pyspark.sql import functions as F

from kinweave.operators import mail, ranking, resolve, scoring, tagging, text


def one(spark, **cells):
    """The values of expressions over one row."""
    row = spark.range(1).select(*[c.alias(k) for k, c in cells.items()]).first()
    return row.asDict()


def test_filters_of_senders(spark):
    shape = "from_email string, from_name string, to_emails array<string>, cc_emails array<string>, sensitive string"
    rows = [
        ("ann@acme.test", "Ann", ["bob@law.example"], None, "x"), ("ann@acme.test", None, None, ["x@acme.test"], "x"), ("news@acme.test", "Acme", [], [], "x"), ("bo@acme.test", "Acme Newsletter", [], [], "x"),
        ("bo@spam.test", "Bo", [], [], "x"), ("no address", "Bo", [], [], "x"), (None, None, None, None, "x"), ("", "", [], [], "x"),
    ]
    kept = mail.kept_mails(spark.createDataFrame(rows, shape).select("from_email", "from_name", "to_emails", "cc_emails"), ["spam.*"], ["law.*"])
    assert sorted((r.from_email, r.sensitive) for r in kept.collect()) == [("ann@acme.test", False), ("ann@acme.test", True)]


def test_names_topics_and_unions(spark):
    got = one(
        spark, a=mail.search_name(F.lit("Ann Lee (1) - NTC Kranj")), b=mail.name_matches(F.lit("Ann Lee"), F.lit("ann Stone")), c=mail.name_matches(F.lit("Ann Lee"), F.lit("Bo LEE")), d=mail.name_matches(F.lit("Ann"), F.lit("Lee Ann")),
        e=mail.name_matches(F.lit("Ann"), F.lit(None).cast("string")), f=mail.topic_words(F.lit("Re: re The Budget for 2025 and the budget plan")), g=mail.topic_union(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), 3),
        h=mail.topic_union(F.lit(None).cast("array<string>"), F.array(F.lit("x"))), i=mail.mailbox_category(F.lit(" Notifications@GitHub.com"), ["n@x.test"], ["a@x.test"]), j=mail.mailbox_category(F.lit("n@x.test"), ["n@x.test"], []), k=mail.mailbox_category(F.lit("p@x.test"), ["n@x.test"], []),
        l=text.sender_type(F.lit("bo@x.test"), F.lit("Bo via Zapier")), m=text.sender_type(F.lit("bo@own.test"), F.lit("Bo via form"), "own.test"), n=text.sender_type(F.lit("noreply@own.test"), F.lit("via zapier")), o=text.sender_type(F.lit("bo@x.test"), F.lit("Bo via form"), "own.test"),
    )
    assert got == {"a": "Ann Lee 1", "b": True, "c": True, "d": False, "e": False, "f": ["budget", "budget", "plan"], "g": ["a", "b", "c"], "h": ["x"], "i": "github", "j": "newsletters", "k": None, "l": "forwarded", "m": "forwarded", "n": "automated", "o": "personal"}


def test_merged_directions(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(2,), (3,)], "id long")
    assert sorted((r.id, r.direction) for r in mail.merged_directions(a, b, "id").collect()) == [(1, "received"), (2, "received"), (3, "sent")]


def test_groups_and_themes(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    got = one(
        spark, a=text.party_class(F.lit("Acme Labs")), b=text.party_class(F.lit("Sidechain")), c=text.party_class(F.lit("Bob")), d=text.party_class(F.lit("our_org x"), ["our_org"]), e=text.group_relation(arr("Bob", "Acme Listing", "Beta Capital")), f=text.group_relation(arr("Bob")),
        g=text.group_industries(arr("DeFi Storage", "Market Fund")), h=text.theme_of(arr("acme.io", "x.vc")), i=text.theme_of(arr("acme.test")), j=text.relevance_tier(F.lit(101)), k=text.relevance_tier(F.lit(100)), l=text.relevance_tier(F.lit(1001)),
        m=text.instruction_for(F.lit("Acme"), [("ACME x Beta", "call"), ("Other", "no")]), n=text.instruction_for(F.lit("Zed"), [("ACME x Beta", "call")]),
    )
    assert got == {"a": "company", "b": "project", "c": "company", "d": None, "e": "partner", "f": "partner", "g": ["blockchain", "finance", "infrastructure", "market_making", "web3"], "h": "Investors & VCs", "i": "Acme Network", "j": 2, "k": 1, "l": 4, "m": "call", "n": None}


def test_tags(spark):
    t = lambda a, **how: tagging.tags_of(F.lit(a), **how)
    custom = [*tagging.RULES, ("custom", "falcon", "bird")]
    got = one(spark, a=t("Fred@USV.com"), b=t("researcher@stanford.edu"), c=t("noreply@github.com"), d=t("someone@random.com"), e=t("x@team.xyz"), f=t("no address"), g=t("bo@x.test", rules=custom, name=F.lit("Falcon Bo")), h=t("news@falcon.io", rules=custom), i=tagging.is_investor(t("a@b.vc")), j=tagging.is_internal(F.lit("A@own.test"), ["own.test"]))
    assert got == {"a": ["investor", "vc"], "b": ["academic"], "c": ["automated"], "d": [], "e": ["tech"], "f": [], "g": ["bird"], "h": ["bird", "newsletter", "tech"], "i": True, "j": True}


def test_numbered_in_pieces(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, None, 900, 300, 301)] + [("b", 2), (None, 1)], "k string, v long")
    got = {(r.k, r.v): r.place for r in ranking.numbered(df, ["k"], F.floor(F.col("v") / 100), [F.col("v")]).collect()}
    assert got == {("a", None): 1, ("a", 1): 2, ("a", 5): 3, ("a", 300): 4, ("a", 301): 5, ("a", 900): 6, ("b", 2): 1, (None, 1): 1}


def test_scores_of_the_fixtures(spark):
    """Scores of hand-made contacts, one of them without interactions."""
    at = lambda d: f"2025-06-{d:02} 00:00:00"
    rows = [("ann", at(30), k) for k in ["meeting"] * 4] + [("bo", at(23), k) for k in ("meeting", "Call", "odd")] + [("cy", at(15), k) for k in ("meeting", "email")] + [("dee", "2025-05-01 00:00:00", "mention"), ("stranger", at(1), "email"), (None, at(1), "email")]
    df = spark.createDataFrame(rows, "who string, at string, kind string").withColumn("at", F.to_timestamp("at"))
    people = spark.createDataFrame([(x,) for x in ("ann", "bo", "cy", "dee", "none", "ann")], "contact string")
    got = {r.contact: (r.days_since, r.score, r.status) for r in scoring.relationship_scores(df, "who", "at", "kind", "2025-06-30", contacts=people).collect()}
    assert got == {"ann": (0, 0.95, "active"), "bo": (7, 0.725089, "active"), "cy": (15, 0.592612, "warming"), "dee": (60, 0.144134, "dormant"), "none": (None, 0.05, "dormant")}


def test_names_contained_and_candidates(spark):
    left = spark.createDataFrame([(1, "Acme"), (2, " BETA Labs Ltd "), (3, "Zed"), (4, None), (5, ""), (6, "Acme")], "id long, name string")
    right = spark.createDataFrame([(9, "acme"), (8, "Acme Corp"), (7, "beta labs"), (6, "beta labs"), (5, None), (4, "")], "other long, org string")
    got = {r.id: (r.other, r.how) for r in resolve.named_or_contained(left, "id", "name", right, "other", "org").collect()}
    assert got == {1: (9, "exact"), 2: (6, "contained"), 6: (9, "exact")}
    cards = spark.createDataFrame([(1, ["x", ""]), (2, ["y", "x"]), (3, ["x"]), (4, None)], "id long, mails array<string>")
    assert sorted(tuple(r) for r in resolve.merge_candidates(cards, "id", {"email": F.col("mails")}).collect()) == [(2, 1, "email"), (3, 1, "email")]


def test_lines_headings_and_bodies(spark):
    note = "---\ntype: x\n---\n# Top\nfirst\r\n\n## Sub\nlast"
    df = spark.createDataFrame([(1, "zero\n# A\none\ntwo\n## B\n\nthree"), (2, ""), (3, None), (4, note)], "id long, text string")
    headed = {(r.id, r.line_no): r.heading for r in text.with_heading(df, "id", "text").collect()}
    assert [headed[1, k] for k in range(1, 8)] == [None, "A", "A", "A", "B", "B", "B"] and headed[2, 1] is None and (3, 1) not in headed
    near = {(r.id, r.line_no): r.context for r in text.with_context(df, "id", "text", 12).collect()}
    assert near[1, 1] == "zero # A" and near[1, 3] == "# A one two" and near[1, 7] == " three" and near[2, 1] == ""
    assert [(r.line_no, r.line) for r in text.body_lines(df.where("id = 4"), "id", "text").collect()] == [(3, "first"), (6, "last")]
