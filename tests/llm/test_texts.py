import random
import re
from datetime import datetime, timedelta, timezone

import pytest

from kinweave.llm import conversations as conv
from kinweave.llm import leaks, packing
from kinweave.llm.sentences import document_sentences, sentence_spans

MESSAGE = "id long, thread_id string, direction string, snippet string, utc_second long, thread string, part long, loaded_at timestamp"


def test_conversations_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for n in range(900):
        t = rng.choice(["hot"] * 4 + [f"t{rng.randrange(60)}"])
        bad = rng.random() < 0.004 and t != "hot"
        moment = None if bad else 1_700_000_000 + rng.randrange(0, 400 * 86_400, 3600)
        if rng.random() < 0.02:
            moment = 7_270_000_000  # a sender's clock in the year 2200
        # most rows arrive soon after, some years late or years early, some at an unknown time
        arrived = datetime(2023, 11, 14, tzinfo=timezone.utc) + timedelta(days=n // 3 if rng.random() < 0.9 else rng.randrange(-900, 900))
        rows.append((n, rng.choice(["<{}>", "{}", " {} "]).format(t), "??" if bad and rng.random() < 0.5 else rng.choice(["sent", " IN", "Outbound", "received"]), rng.choice(["", None, " \n", "ok"]), moment, "x", 3, arrived if rng.random() < 0.99 else None))
    far = datetime(2290, 1, 1, tzinfo=timezone.utc)
    rows += [(2000, None, "sent", "x", 5, "x", 0, far), (2001, "<>", "sent", "x", 5, "x", 0, far), (2002, "one", "sent", "x", 5, "x", 0, far)]
    df = spark.createDataFrame(rows, MESSAGE)
    by = {}
    for i, t, d, s, u, *_ in rows:
        t = (t or "").strip(" <>")
        who = {"sent": "me", "outbound": "me", "in": "contact", "received": "contact"}.get(d.strip().lower())
        if t:
            by.setdefault(t, []).append((u, i, who, bool((s or "").strip())))
    want = set()
    for ms in by.values():
        if all(m[0] is not None and m[2] for m in ms) and len({m[2] for m in ms}) == 2 and any(m[3] for m in ms):
            ms.sort()
            want |= {(ms[0][1], k, m[1], m[2]) for k, m in enumerate(ms, 1)}
    # short timeouts, many steps and small states; the result must not depend on them, and no row may be late
    for how in ({}, {"timeout": 3_600, "delay": 0, "step_rows": 60, "state_rows": 40}):
        out = conv.conversations(conv.lean_messages(df.repartition(6)), **how)
        assert {(r.conv_id, r.turn_no, r.id, r.speaker) for r in out.collect()} == want
    assert conv.conversations(conv.lean_messages(df.where("false"))).count() == 0


def test_live_stream_closes_silent_conversations(spark, tmp_path):
    """Valid conversations leave the stream when the timeout runs out; broken and open ones do not; senders' dates move no clock."""
    d = str(tmp_path)
    shape = "thread string, id long, moment long, arrived long, speaker string, said boolean"
    day = 86_400
    batches = [
        [("a", 1, 0, 0, "me", True), ("late", 7, 9_000_000_000, day, "me", True), ("mute", 9, 5, day, "me", True)],
        [("a", 2, -day, day, "contact", True), ("late", 8, 5, 2 * day, "contact", False)],
        [("b", 3, 90 * day, 90 * day, "me", True), ("b", 5, 90 * day, 90 * day, "contact", True), ("", 6, 0, 90 * day, "me", True)],
        [("c", 4, 95 * day, 95 * day, "me", True)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{d}/in/{k}")
    for k in range(len(batches)):
        stream = spark.readStream.schema(shape).parquet(f"{d}/in/[0-{k}]")
        conv.live_conversations(stream, 10 * day, 60 * day).writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.conv_id, r.turn_no, r.id, r.speaker) for r in spark.read.parquet(f"{d}/out").collect()) == [(2, 1, 2, "contact"), (2, 2, 1, "me"), (8, 1, 8, "contact"), (8, 2, 7, "me")]


DOCS = "doc_id long, text string, lang string, item_id long, items string"
ITEM = "When Edda Treavixder left Tnaveonix after 22 weeks, the marbled whistles kept for Hana Urbembxra passed to Mulpikix in Casterno. Neither Michael Briimbxnik nor Nora Zanambxdahl knew that Mulpanaix counted 116 nimble whistles among the gifts sent to Yostad."
HAN = "如果Mira Zanolxn每周从Belhaven给Nyloskix寄270封名片，那么496周之后Rafael Kolovixnik一共会收到多少封？"


def test_leaks(spark):
    words = ITEM.split()
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["weather", "the", "grant", "round", "left", "weeks", "meeting", "after", "sent", "to", "was", "booked"]) for _ in range(n))
    first = re.split(r"(?<=\.)\s", ITEM)[0].split()
    altered = first[:3] + ["wrogn"] + first[4:9] + first[10:]
    spoiled = [w if k % 3 else "other" for k, w in enumerate(first)]
    cases = {
        1: (filler(40) + " " + ITEM.upper() + " " + filler(30), True),
        2: (filler(9) + " " + " ".join(words[2:14]).replace(" ", "\n") + " " + filler(9), True),
        3: (filler(9) + " " + " ".join(words[2:13]) + " " + filler(9), False),
        4: (filler(30) + " " + " ".join(altered) + " " + filler(30), True),
        5: (filler(30) + " " + " ".join(spoiled) + " " + filler(30), False),
        6: (filler(5) + " <b>" + "</b> _".join(words[:14]) + "_", True),
        7: (filler(200), False),
        8: (None, False),
        9: ("", False),
        10: ("x " * 30_000 + ITEM, True),
        11: (ITEM, True),
        12: (ITEM, True),
    }
    docs = spark.createDataFrame([(k, t, None, 5, "c") for k, (t, _) in cases.items()] + [(20, "他说" + HAN[2:40].replace("，", " , ") + "吗", "zh", 0, ""), (21, "他说" + HAN[2:12] + "吗", "zh", 0, "")], DOCS)
    items = spark.createDataFrame([(100, ITEM, "en"), (101, HAN, "zh"), (102, None, "en"), (103, "", "en")], "item_id long, text string, lang string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, items).collect()}
    assert got == {(k, 100) for k, (_, yes) in cases.items() if yes} | {(20, 101)}
    assert leaks.leaked_items(docs, items.where("false")).count() == 0
    assert leaks.leaked_items(docs.where("false"), items).count() == 0
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs, items, shard_passages=7, shard_chars=1).collect()} == got


def cut(text, lang=""):
    return [text[a:b] for a, b in sentence_spans(text, lang)]


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("en", ["Met Dr. Ann Lee at 3.15 p.m. on Jan. 4.", "“Who owns this?” asked Leon twice.", "She wrote, “Send it. I will sign.”", "(Seats were scarce. Nadia stood.)", "He paused... then agreed.", "The U.S. team of Acme Inc. joins.", "See https://x.org/v1.2.html for v3.1.0."]),
        ("de", ["Am 5. März trifft Ida das Team.", "Die 2. Runde war kürzer als die 1. Runde.", "Das sind ca. 5,2 Mio. Euro, z. B. heute.", "„Das geht nicht. Wir warten“, sagte Ana."]),
        ("fr", ["La version v3.5.0 est prête !", "« Envoyez-le demain. Je signerai », a dit Ida.", "Voir p. 907 du dossier, art. 8.", "Rendez-vous avec M. Lee demain."]),
        ("es", ["¿Quién sigue con el núm. 3?", "¡La Dra. Lee aceptó!", "Abrirá una oficina en EE. UU. este año."]),
        ("hi", ["उसने कहा, “कल भेजो। मैं हस्ताक्षर करूँगा।”", "डॉ. शर्वेल अगले सप्ताह आएँगे।"]),
        ("ar", ["قالت: «أرسل الملف غدا. سأوقعه فورا.»", "هل أرسلت الرد؟", "قال د. نوريم إن العرض جاهز."]),
        ("th", ["ยังไม่มีคำตอบจาก Media เลยค่ะ", "เขาบอกว่าจะติดต่อกลับมาเร็ว ๆ นี้ครับ", "งบประมาณทั้งหมด 77.49 ล้านบาท"]),
    ],
)
def test_sentences_of_spaced_scripts(lang, parts):
    assert cut(" ".join(parts), lang) == parts
    assert [p for block in parts for p in cut(block, lang)] == parts


@pytest.mark.parametrize("parts", [["她说：“明天发给我。我马上签字。”然后离开了。", "我们（包括同事）都同意延期……但是时间不多了。", "比去年多40元！"], ["契約（第7条。旧版）を確認してください。", "彼は「明日送ります。必ず送ります。」と言いました。", "返事はまだですか？"]])
def test_sentences_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_blocks_lists_and_odd_texts(spark):
    assert cut("# Notes Oct. 21\n\nHi Ann,\n\n1. ask Bo\n2. Send Nr. 9\nand more\n- last\n\nBest,\nIda") == ["# Notes Oct. 21", "Hi Ann,", "1. ask Bo", "2. Send Nr. 9\nand more", "- last", "Best,\nIda"]
    assert cut("Das gilt wohl nur bis zum\n4. Mai oder so", "de") == ["Das gilt wohl nur bis zum\n4. Mai oder so"]
    assert cut("One ends here.Two starts there. See v1.2 or a.B@x.org now.") == ["One ends here.", "Two starts there.", "See v1.2 or a.B@x.org now."]
    assert cut("An “open quote. Next one.") == ["An “open quote.", "Next one."]
    assert cut("") == cut(" \n\n ") == []
    long = "A word. " * 20_000
    assert len(cut(long)) == 20_000
    df = spark.createDataFrame([(1, "A b. C d.", None, 0, ""), (1, "A b. C d.", "EN", 0, ""), (2, None, "en", 0, ""), (3, "  ", "en", 0, ""), (None, "x", "en", 0, "")], DOCS)
    assert sorted((r.doc_id, r.sent_start, r.sent_end) for r in document_sentences(df).collect()) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert document_sentences(df.where("false")).count() == 0


def test_sentences_cover_the_text():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["Ann ", "b", ". ", "!", "“", "”", "(", ")", "\n", "\n\n", "。", "3", "Dr. ", "ก ", " ", "- x", "…"]) for _ in range(60))
        spans = sentence_spans(t)
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert re.sub(r"\s", "", t) == re.sub(r"\s", "", "".join(t[a:b] for a, b in spans))


def test_packing(spark):
    rng = random.Random(6)
    texts = [" ".join("word" for _ in range(int(rng.paretovariate(0.9)) * 5 % 6000)) for _ in range(500)] + [None, "", "x" * 100]
    df = spark.createDataFrame([(i, t, None, 0, "c") for i, t in enumerate(texts)], DOCS)
    out = packing.packed_documents(df, capacity=512, group=16)
    rows = out.collect()
    room = {}
    for r in rows:
        room[r.container] = room.get(r.container, 0) + r.n_tokens
    assert max(room.values()) <= 512
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r.n_tokens)
    assert {k: sum(v) for k, v in whole.items()} == {k: v for k, v in sizes.items() if v}
    assert all(len(v) == 1 for k, v in whole.items() if sizes[k] <= 512) and all(len(v) == -(-sizes[k] // 512) for k, v in whole.items())
    assert len(room) <= -(-sum(sizes.values()) // 512) * 1.05 + 8
    again = packing.packed_documents(df.repartition(7, "text"), capacity=512, group=16)
    assert {(r.container, r.doc_id, r.piece) for r in again.collect()} == {(r.container, r.doc_id, r.piece) for r in out.collect()}
    assert packing.packed_documents(df.where("false")).count() == 0


def test_differencing_uses_every_item_once():
    rng = random.Random(8)
    for _ in range(50):
        sizes = [rng.randrange(1, 300) for _ in range(rng.randrange(1, 80))]
        found = packing.pack(sizes, 300)
        assert sorted(k for c in found for k in c) == list(range(len(sizes))) and all(sum(sizes[k] for k in c) <= 300 for c in found)
    assert packing.multiway([8, 7, 6, 5, 4], 2) and max(sum([8, 7, 6, 5, 4][k] for k in c) for c in packing.multiway([8, 7, 6, 5, 4], 2)) == 16


def test_long_texts_are_read_once():
    """A megabyte of unclosed marks, of stops or of blanks takes no longer than other text; context is never cut."""
    import time

    for text in ("(" * 1_000_000, "[a " * 300_000, "." * 1_000_000, "a" + " " * 1_000_000 + "b", '."' + '"' * 1_000_000, ".!" * 500_000):
        began = time.time()
        assert len(sentence_spans(text)) == 1
        assert time.time() - began < 5
    assert len(sentence_spans("It cost etc." + " " * 40 + "and more.")) == 1
    assert sentence_spans("He said (a (b) c. D) so. Then (open. End.") == [(0, 24), (25, 36), (37, 41)]
