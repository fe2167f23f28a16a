import random

from kinweave.operators.quotient_dedup import distinct_messages, permuted, superfluous_deliveries

SHAPE = "origin string, id long, message_id string, _tail string"


def brute(rows):
    first, out = {}, set()
    for o, i, m, _ in sorted(rows, key=lambda r: r[1]):
        m = (m or "").strip(" \t\r\n <>")
        m = m.split("@", 1)[0] + "@" + m.split("@", 1)[1].lower() if "@" in m else m
        if m:
            if (o, m) in first:
                out.add((o, i))
            first.setdefault((o, m), i)
    return out


def test_against_brute_force_with_a_hot_identifier(spark):
    rng = random.Random(1)
    forms = ["<{}@MX.org>", "{}@mx.org", " <{}@mx.ORG> ", "{}"]
    ids = ["a", "A", "abcdefgh", "abcdefghi", "x" * 300, "ž", "", None]
    rows = [(rng.choice("pq"), n, None if (m := rng.choice(ids)) is None else rng.choice(forms).format(m) if m else rng.choice(["", "<>", " "]), "t") for n in range(600)]
    rows += [("p", 1000 + n, "hot@x", "t") for n in range(300)]
    df = spark.createDataFrame(rows, SHAPE)
    got = {(r.origin, r.id) for r in superfluous_deliveries(df, "origin", "id", "message_id").collect()}
    assert got == brute(rows)
    one = df.where("origin = 'p'")
    kept = {r.id for r in distinct_messages(one, "id", "message_id").collect()}
    assert kept == {r[1] for r in rows if r[0] == "p"} - {i for o, i in brute(rows) if o == "p"}


def test_empty(spark):
    assert superfluous_deliveries(spark.createDataFrame([], SHAPE), "origin", "id", "message_id").count() == 0


def test_permutation_is_one_to_one(spark):
    words = [f"{a}{b}" for a in ("", "a", "aaaaaaa", "aaaaaaaa", "ü", "zzzzzzzzzzzz") for b in range(300)]
    df = permuted(spark.createDataFrame([(w,) for w in words], "w string"), "w")
    assert df.select("_quotient", "_rest", "_tail").distinct().count() == len(set(words))
