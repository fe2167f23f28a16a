import os

from pyspark.sql import functions as F

from kinweave.sources import files, sinks
from kinweave.streaming import messages as live


def put(folder, name, body):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(body)


def test_journal_and_calendar(spark, tmp_path):
    d = str(tmp_path)
    put(d, "1-personal/journal/2025-12-18.md", "Met [[Ann Lee|Annie]] and [[Filecoin]] on [[2025-12-18]]\nPresented roadmap to [[Bo Ray]]\n")
    put(d, "1-personal/journal/2024-01-01.md", "Met [[Old One]]")
    put(d, "1-personal/journal/index.md", "[[No Day]]")
    j = files.journal_interactions(spark, d, "2025-12-01", "2025-12-31")
    assert sorted((r.contact, r.interaction_type) for r in j.collect()) == [("Ann Lee", "meeting"), ("Bo Ray", "email")]
    put(d, "org/calendar.org", "* TODO Sync with [[Ann Lee]] :work:\n <2025-12-18 Thu 10:00-11:00>\n* Heading [[Bo Ray]] <2025-12-19 Fri>\n")
    c = files.calendar_interactions(spark, d, "2025-12-01", "2025-12-31").collect()
    assert [(r.contact, r.summary, r.metadata["start_time"], r.metadata["end_time"]) for r in c] == [("Ann Lee", "Sync with Ann Lee", "10:00", "11:00")]
    both = files.scan_all(spark, {"journal": d, "calendar": d}, "2025-12-31", {"journal": 30, "calendar": 13})
    assert both.count() == 3 and both.columns == files.INTERACTION
    assert files.scan_all(spark, {"journal": d, "calendar": d}, "2025-12-31", {"journal": 30, "calendar": 5}).count() == 2
    assert [r.context for r in j.where("contact = 'Bo Ray'").collect()] == ["Met [[Ann Lee|Annie]] and [[Filecoin]] on [[2025-12-18]] Presented roadmap to [[Bo Ray]] "]
    assert c[0].context.startswith("* TODO Sync")


def test_notes(spark, tmp_path):
    d = str(tmp_path)
    put(d, "1-personal/contacts/people/ann.md", "---\nname: Ann Lee\nstatus: active\ntags: [a, b]\n---\nBody")
    put(d, "2-work/contacts/companies/acme.md", "no front matter")
    put(d, "2-work/contacts/people/_template.md", "---\nname: T\n---\n")
    got = {r.name: (r.space, r.contact_type, r.status) for r in files.notes(spark, d).collect()}
    assert got["Ann Lee"] == ("1-personal", "person", "active") and got["acme"] == ("2-work", "company", "draft")
    assert {r.name for r in files.notes(spark, d, keep_invalid=False, skip_templates=True).collect()} == {"Ann Lee"}


def test_vcards_there_and_back(spark, tmp_path):
    d = str(tmp_path)
    put(d, "a.vcf", "BEGIN:VCARD\r\nVERSION:3.0\r\nFN:Ann\r\n  Lee\r\nEMAIL;TYPE=WORK:ann@x.org\r\nTEL;TYPE=CELL:+1 22\r\nORG:Acme;Dept\r\nEND:VCARD\r\nBEGIN:VCARD\r\nN:Ray;Bo;;;\r\nEND:VCARD\r\nBEGIN:VCARD\r\nTEL:1\r\nEND:VCARD\r\n")
    got = {r.name: r for r in files.vcards(spark, d).collect()}
    assert set(got) == {"Ann Lee", "Bo Ray"}
    assert got["Ann Lee"].emails[0].value == "ann@x.org" and got["Ann Lee"].emails[0].type == "WORK" and got["Ann Lee"].organization == "Acme"
    put(d, "b.vcf", "BEGIN:VCARD\nFN:Cy\nPRODID:-//Apple Inc.//x\nADR;TYPE=HOME:;;1 Way;Oslo;;;Norway\nADR;TYPE=WORK:;;2 Way;Bonn;;;Germany\nURL:https://linkedin.com/in/cy\nNOTE:a\\nb\nPHOTO;ENCODING=b:aGk=\nEND:VCARD\n")
    cy = files.vcards(spark, d).where("name = 'Cy'").withColumn("place", files.located(F.col("addresses"))).first()
    assert (cy.place, cy.urls, cy.notes, bytes(cy.photo), cy.source) == ("Bonn, Germany", ["https://linkedin.com/in/cy"], "a\nb", b"hi", "apple")
    os.remove(f"{d}/b.vcf")
    text = files.vcards(spark, d).select(sinks.vcard_text(F.col("name"), F.transform("emails", lambda e: e.value), F.transform("phones", lambda e: e.value), F.col("organization"), F.col("role")).alias("t"))
    sinks.write_text(text.withColumn("t", F.col("t")), "t", f"{d}/out")
    assert sorted(r.name for r in spark.read.text(f"{d}/out", wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit("FN:(.*)"), F.lit(1))).alias("name")).collect()) == ["Ann Lee", "Bo Ray"]


def test_mailbox(spark, tmp_path):
    d = str(tmp_path)
    put(d, "m.mbox", "From a@x Mon\nFrom: Ann <ann@x.org>\nTo: Bo <BO@y.org>, c@z.org\nSubject: Hi\nMessage-ID: <1@x>\nDate: Mon, 1 Jan 2024 00:00:00 +0000\n\nHello\n> quoted\n-- \nsig\n\nFrom b@y Mon\nFrom: bo@y.org\nTo: ann@x.org\nReferences: <1@x> <2@x>\nMessage-ID: <3@y>\nContent-Type: text/html\n\n<p>Yes <b>so</b></p>\n\nFrom junk\nno headers here\n")
    got = {r.message_id: r for r in files.mailboxes(spark, f"{d}/m.mbox").collect()}
    assert got["<1@x>"].to_emails == ["bo@y.org", "c@z.org"] and got["<1@x>"].snippet == "Hello"
    assert got["<3@y>"].thread_id == "<1@x>" and got["<3@y>"].snippet == "Yes so" and len(got) == 2
    assert {r.fault: r.n for r in files.mail_faults(spark, f"{d}/m.mbox").collect()} == {"no sender": 1}
    kept = files.mailboxes(spark, f"{d}/m.mbox", ["y.*"], ["z.*"]).collect()
    assert [(r.message_id, r.sensitive, r.snippet) for r in kept] == [("<1@x>", True, None)]
    put(d, "q.mbox", "From a@x Mon\nFrom: Ann <ann@x.org>\nMessage-ID: <5@x>\n\nOne\n  > quoted\n___\nsig\n")
    assert files.mailboxes(spark, f"{d}/q.mbox").first().snippet == "One"


def test_chat_and_tables(spark, tmp_path):
    d = str(tmp_path)
    put(d, "c.json", '{"chats": {"list": [{"name": "G", "type": "private_group", "id": 1, "messages": [{"from": "Ann", "date": "2025-01-01T00:00:00", "text": "hi"}, {"from": "Bo", "date": "2025-01-02T00:00:00", "text": ["see ", {"type": "link", "text": "x.org"}]}]}]}}')
    assert [(r.sender, r.text) for r in files.chat_messages(spark, f"{d}/c.json").orderBy("n").collect()] == [("Ann", "hi"), ("Bo", "see x.org")]
    put(d, "t.md", "# T\n| Group Name | Messages |\n|---|---|\n| A <> B | 3 | extra |\n| | 2 |\n")
    assert [tuple(r) for r in files.pipe_tables(spark, f"{d}/t.md", ["name", "messages"]).collect()] == [("A <> B", "3", "extra")]
    put(d, "r.md", "# R\n### Acme (company)\n\n- A x B (12 messages) - NOTE: call\n- C (3 messages)\n**Status:** NEW\n### Bo\n- D (1 messages)\n")
    got = sorted(tuple(r) for r in files.report_contacts(spark, f"{d}/r.md").collect())
    assert got == [("Acme", "company", "NEW", "A x B", 12, "call"), ("Acme", "company", "NEW", "C", 3, None), ("Bo", None, None, "D", 1, None)]
    put(d, "rules.yaml", "contact_tags:\n  bird: [Falcon, hawk]\n")
    from kinweave.operators import tagging

    assert tagging.rule_table(spark, f"{d}/rules.yaml") == [("custom", "falcon", "bird"), ("custom", "hawk", "bird")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "Ann/Lee"), (2, "annlee"), (3, "Bo")], "id long, name string")
    assert {r.id: r.file_name for r in sinks.file_names(df, "name", "id").collect()} == {1: "AnnLee.md", 2: "annlee (1).md", 3: "Bo.md"}
    assert df.select(sinks.slug(F.lit("  Héllo, World! "))).first()[0] == "héllo-world"
    old = spark.createDataFrame([("a", 1, 5, 5)], "k string, n long, f long, l long")
    new = spark.createDataFrame([("a", 2, 1, 9), ("b", 1, 2, 2), (None, 1, 1, 1)], "k string, n long, f long, l long")
    assert sorted(tuple(r) for r in sinks.merge_snapshot(old, new, "k", ["n"], ["f"], ["l"], []).collect()) == [("a", 3, 1, 9), ("b", 1, 2, 2)]


def test_notes_are_updated_and_reports_written(spark, tmp_path):
    note = "---\nname: Ann\nstatus: draft\n---\n# Ann\n\n## Email History\n\nold\n\n## Next\n\nx\n"
    df = spark.createDataFrame([(1, note), (2, "plain")], "id long, t string")
    got = {r.id: (r.s, r.f) for r in df.select("id", sinks.with_section(F.col("t"), "Email History", F.lit("new")).alias("s"), sinks.with_fields(F.col("t"), {"status": F.lit("active"), "org": F.lit(None).cast("string")}).alias("f")).collect()}
    assert got[1][0] == "---\nname: Ann\nstatus: draft\n---\n# Ann\n\n## Email History\n\nnew\n\n## Next\n\nx\n" and got[2][0] == "plain\n\n## Email History\n\nnew\n"
    assert got[1][1] == note.replace("status: draft", "status: active") and got[2][1] == "---\nstatus: active\n---\nplain"
    sinks.write_report({"Open Threads": df.select("id"), "None": df.where("false")}, f"{tmp_path}/r")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/r/open-threads/table").collect()) == ["", "## Open Threads", "| 1 |", "| 2 |", "| id |", "|---|"]
    assert spark.read.json(f"{tmp_path}/r/open-threads/rows").count() == 2
    shape = "k string, n long, l long, name string, topics array<string>"
    old, new = spark.createDataFrame([("a", 1, 5, "Ann", ["x", "y"])], shape), spark.createDataFrame([("a", 2, 9, " ", ["y", "z"]), ("b", 1, 1, "Bo", None)], shape)
    merged = {r.k: (r.n, r.l, r.name, r.topics) for r in sinks.merge_snapshot(old, new, "k", ["n"], [], ["l"], [], {"name": "l"}, {"topics": 2}).collect()}
    assert merged == {"a": (3, 9, "Ann", ["x", "y"]), "b": (1, 1, "Bo", [])}


def test_stream_keeps_single_messages(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1, "<a@x>", "2025-01-01 00:00:00"), (2, "a@X", "2025-01-02 00:00:00"), (3, None, "2025-01-02 00:00:00"), (4, None, "2025-01-02 00:00:00"), (5, "b@x", "2025-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "id long, message_id string, at string").withColumn("at", F.to_timestamp("at"))
    for k in range(3):
        df.where(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{d}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = live.single_messages(stream, "message_id", "at").writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r.id for r in spark.read.parquet(f"{d}/out").collect()]
    assert len(got) == 4 and {3, 4, 5} <= set(got) and len({1, 2} & set(got)) == 1
