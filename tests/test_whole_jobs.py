"""Cases that were cut short once: each failed before its query did the whole job."""


from kinweave.operators import resolve


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_similar_entities_from_seven_tenths(spark, tmp_path):
    from kinweave.queries.relations import QUERIES

    rows = [(1, "person", "Abcdefghij"), (2, "person", "Abcdefgxyz"), (3, "company", "Acme Corp"), (4, "company", "Acme Corporation")]
    spark.createDataFrame(rows, "entity_id long, entity_type string, name string").write.parquet(f"{tmp_path}/extracted_entities.parquet")
    assert [tuple(r) for r in QUERIES["similar_entities"](spark, str(tmp_path)).collect()] == [(1, 2, 0.7)]


def test_duplicate_classes_equal_a_pair_loop(spark):
    """Equal names are linked to the first of them, the first ones of similar names to each other; evidence is that of all records."""
    rows = [
        (1, "person", "Jane Doe", "Acme", None, None), (2, "person", "Jane Dow", "Beta", None, None), (3, "person", "jane doe", None, None, "x"),
        (4, "person", "Abcdefghij", "Acme", "q", None), (5, "person", "Abcdefgxyz", "Acme", None, ""), (6, "person", "Abcdefguvw", None, "q", ""),
        (7, None, "Abcdefghij", None, None, None), (8, None, "Abcdefghijk", "Z", None, None), (9, "person", None, "Acme", "q", None),
        (10, "person", "Abcdefghijabcdefghij", None, None, None), (11, "person", "Abcdefghijabcdefghix", None, None, None),
    ]
    rows += [(12, "person", "JANE DOE ", "Beta", "q", None), (13, "person", "jane dow", None, None, "x")]
    of = lambda r: (r[1] or "", (r[2] or "").strip().lower())
    first: dict = {}
    for r in rows:
        first.setdefault(of(r), r[0])

    def link(a, b, s, xs, ys):
        equal = lambda k: any(x[k] and x[k] == y[k] for x in xs for y in ys)
        shared, same = ",".join(c for c, k in (("email", 4), ("telegram", 5)) if equal(k)), equal(3)
        return (a, b, round(s, 6), same, shared, "likely" if s > 0.95 or shared else "possible" if s > 0.85 or same else "review")

    want = [link(first[of(r)], r[0], 1.0, [x for x in rows if x[0] == first[of(r)]], [r]) for r in rows if r[2] and first[of(r)] != r[0]]
    for x in first:
        for y in first:
            s = 1 - edits(x[1], y[1]) / max(len(x[1]), len(y[1]), 1)
            if x[0] == y[0] and x[1] and y[1] and first[x] < first[y] and s >= 0.7:
                want.append(link(first[x], first[y], s, [r for r in rows if of(r) == x], [r for r in rows if of(r) == y]))
    want.sort()
    df = spark.createDataFrame(rows, "id long, kind string, name string, org string, email string, telegram string")
    got = resolve.duplicate_pairs(df, "id", "kind", "name", "org", ["email", "telegram"])
    assert sorted(tuple(r) for r in got.collect()) == want and {r[5] for r in want} == {"likely", "possible", "review"}


def test_all_addresses_and_stages_of_cards(spark, tmp_path):
    from kinweave.queries.relations import QUERIES

    pair = "array<struct<type string, value string>>"
    cards = [
        (1, "A", [("", "no@x"), ("", " Second@X ")], [], None), (2, "B", [], [("", "1"), ("", "+9 (77) 5-4")], None),
        (3, "Ann Lee", [], [], "Acme"), (4, "Ann Lee", [], [], "Other"), (5, "Abcdefghijabcdefghik", [], [], None),
        (6, "Abcdefghijabcdefxyzw", [], [], None), (7, None, None, None, None), (8, "C", [("", "second@x"), ("", "own@y")], [("", "97754")], None),
    ]
    spark.createDataFrame(cards, f"card_id long, name string, emails {pair}, phones {pair}, organization string").write.parquet(f"{tmp_path}/vcards.parquet")
    google = [("p1", "Q", ["own@y", "second@x"], ["5", "97754"], None), ("p2", "ann lee", None, [], "ACME"), ("p3", "Ann Lee", [], [], None), ("p0", "Abcdefghijabcdefghij", ["own@y"], [], None)]
    spark.createDataFrame(google, "resource_name string, name string, emails array<string>, phones array<string>, organization string").write.parquet(f"{tmp_path}/google_contacts.parquet")
    got = sorted(tuple(r) for r in QUERIES["card_duplicates"](spark, str(tmp_path)).collect())
    assert got == [(1, "p1", "email", 1.0), (2, "p1", "phone", 0.95), (3, "p2", "name_organization", 0.85), (4, "p2", "similar", 0.7), (5, "p0", "similar", 0.665), (8, "p1", "email", 1.0)]


def test_events_and_projects_of_any_case(spark):
    from kinweave.operators import entities

    note = "---\nx: big week\n---\n# Some summit\nWe join the Token Summit 2024, then the storage network.\r\nAcme platform\nacme Platform"
    df = spark.createDataFrame([(1, note), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.entity_type, r.name, r.line_no) for r in entities.document_entities(df, "doc_id", "text").collect() if r.entity_type in ("project", "event")}
    assert got == {("event", "We join the Token Summit 2024", 3), ("project", "storage", 3), ("project", "the", 3), ("project", "Acme", 4)}


def test_companies_by_preposition_and_people_by_role(spark):
    from kinweave.operators import entities

    lines = [
        "Lunch with Acme Beta Gamma Delta Epsilon by The river", "from Zed Labs and at This", "Zed Labs wrote", "Met CEO Ann Lee from Acme Beta today", "Vice President Bo Ray",
        "Cy Dun, Lead engineer at Orb2", "CTO Cy Dun", "Co-founder Di Fox", "with \u00c9cole", "ceo Eve Low",
    ]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = {(r.entity_type, r.name, r.confidence, r.line_no, r.role, r.organization) for r in entities.document_entities(df, "doc_id", "text").collect()}
    assert got == {
        ("company", "Acme Beta Gamma Delta", 0.6, 1, None, None), ("company", "Zed Labs", 0.9, 2, None, None), ("company", "Acme Beta", 0.6, 4, None, None),
        ("person", "Ann Lee", 0.85, 4, "CEO", "[[Acme Beta]]"), ("person", "Bo Ray", 0.85, 5, "President", None),
        ("person", "Cy Dun", 0.9, 6, "Lead engineer", "[[Orb]]"), ("person", "Di Fox", 0.85, 8, "Co-founder", None),
    }


def test_gaps_by_marker_and_age(spark, tmp_path):
    """The last word by the sender's clock counts, repeated deliveries do not; mine needs a question and 15 days."""
    from kinweave.queries.timeline import QUERIES

    rows = []
    cases = {"asked": ("sent", "Thoughts", "2025-10-01"), "fresh": ("sent", "why?", "2025-10-16 00:00:01"), "told": ("sent", "Done.", "2025-01-01"), "theirs": ("received", "Done.", "2025-10-30"), "empty": ("sent", None, "2025-01-01")}
    for k, (t, (side, snippet, at)) in enumerate(cases.items()):
        # the older message was loaded last
        rows += [(10 * k + 1, t, "sent", "when?", "2024-01-01"), (10 * k, f" <{t}> ", side, snippet, at)]
    rows += [(99, "alone", "received", "?", "2025-01-01"), (12, "fresh", None, "?", "2025-01-01"), (13, "fresh", "received", "?", "soon"), (14, "twice", "received", "?", "2025-01-01"), (15, "twice", "received", "?", "2025-01-01")]
    df = spark.createDataFrame([(*r, 1, "same" if r[0] in (14, 15) else None, 5, "s") for r in rows], "id long, thread_id string, direction string, snippet string, date string, mailbox_id long, message_id string, contact_id long, subject string")
    df.write.parquet(f"{tmp_path}/interactions.parquet")
    spark.createDataFrame([(1, "UTC")], "mailbox_id long, tz_name string").write.parquet(f"{tmp_path}/mailboxes.parquet")
    got = {(r.thread, r.gap, r.days) for r in QUERIES["conversation_ending"](spark, str(tmp_path)).collect()}
    assert got == {("asked", "no_response_to_my_message", 30), ("theirs", "unanswered_by_me", 1)}

def test_all_numbers_of_a_card(spark, tmp_path):
    from kinweave.queries.relations import QUERIES

    rows = [(1, [("", "+1 2"), ("", "(3) 4")]), (2, []), (3, None), (4, [("", "none")])]
    spark.createDataFrame(rows, "card_id long, phones array<struct<type string, value string>>").write.parquet(f"{tmp_path}/vcards.parquet")
    assert sorted(tuple(r) for r in QUERIES["phone_normalise"](spark, str(tmp_path)).collect()) == [(1, 1, "12"), (1, 2, "34"), (4, 1, None)]


def test_similar_names_lose_no_pair_to_the_bits_of_letters(spark):
    """Against a loop over all pairs: repeated letters, letters of two UTF-16 units, short names; and every pair tested by distance comes out of the join once."""
    import random

    rng = random.Random(5)
    names = ["😀😁ab", "😀😂ab", "aaaaaaaaaa", "aaaaaaabbb", "aaaaaaaaaabbb", "é-é-é-é-é-", "é-é-é-è-è-", "ab", "abc", "abd", "abcd", "abce", "😁😁😁😁😁😁😁😁😁😁", "😁😁😁😁😁😁😁abc"]
    names += ["".join(rng.choice("abc ") for _ in range(rng.randint(3, 14))).strip() or "x" for _ in range(150)]
    names = sorted(set(names))
    want = set()
    for i, x in enumerate(names):
        for j in range(i):
            k, longest = edits(x, names[j]), max(len(x), len(names[j]))
            if k <= int(longest * 0.3 + 1e-9):
                want.add((j, i, round(1 - k / longest, 6)))
    df = spark.createDataFrame([(i, "p", x) for i, x in enumerate(names)], "id long, kind string, name string")
    out = resolve.similar_names(df, "id", "kind", "name", 0.7)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    # candidates were made one by a shuffle of all of them before any was tested: now the bits are part of the join
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in next(line for line in plan.splitlines() if "Join Inner" in line and "gram" in line)


def test_many_similar_names_are_tried_without_a_join(spark, monkeypatch):
    """Against a loop over all pairs: kinds in blocks and whole, names of up to 64 letters and beyond; candidates of many names were rows of a join, whose number ran out of time."""
    import random

    rng = random.Random(6)
    base = ["john smith", "jane doe", "é-é-é-è-è-", "😀😁ab", "".join(rng.choice("abcdefgh ") for _ in range(66)).strip()]
    names = {"".join("" if rng.random() < 0.05 else rng.choice("abcx ") if rng.random() < 0.1 else c for c in rng.choice(base) + rng.choice(["", "x", "yz"])).strip() for _ in range(130)} - {""}
    assert min(map(len, names)) < 6 and any(len(x) == 64 for x in names) and max(map(len, names)) > 64
    rows = [(kind, x) for k, kind in enumerate(["person", None, "firm", "event"]) for x in sorted(names)[:: k * k + 1]]
    want = set()
    for i, (kind, x) in enumerate(rows):
        for j in range(i):
            longest = max(len(x), len(rows[j][1]))
            if kind == rows[j][0] and (d := edits(x, rows[j][1])) <= int(longest * 0.3 + 1e-9):
                want.add((j, i, round(1 - d / longest, 6)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(len(rows), "firm", "FIRM"), (len(rows) + 1, "firm", None)], "id long, kind string, name string")
    monkeypatch.setattr(resolve, "MANY", 100)
    monkeypatch.setattr(resolve, "BLOCK", 20)
    out = resolve.similar_names(df, "id", "kind", "name", 0.7)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    few = resolve.similar_names(df.where("length(name) <= 64"), "id", "kind", "name", 0.7)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "gram" not in plan and {tuple(r) for r in few.collect()} == {w for w in want if max(len(rows[k][1]) for k in w[:2]) <= 64}
