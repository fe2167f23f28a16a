import random

from kinweave.operators import registry


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def fold(met, entries):
    """One tag after the other, as the rule has it."""
    names = [t for t, _, _ in sorted(entries, key=lambda e: e[2])]
    alias = {}
    for t, aliases, _ in sorted(entries, key=lambda e: e[2]):
        for a in aliases or []:
            alias.setdefault(a, t)
    out = {}
    for tag, _ in sorted(met.items(), key=lambda x: (x[1], x[0])):
        if tag in {t for t, _, _ in entries}:
            out[tag] = (tag, "exact")
        elif tag in alias:
            out[tag] = (alias[tag], "alias")
        elif near := [n for n in names if edits(tag, n) < 3]:
            out[tag] = (near[0], "similar")
        else:
            names.append(tag)
            out[tag] = (tag, "new")
    return out


def test_registered_equals_the_fold(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
    for _ in range(2):
        entries = [("abab", ["bbbb", "aaaaaaaa"], 3), ("babababa", None, 1), ("aaaabbbbaaa", ["bbbb"], 2)]
        met = {}
        for _ in range(60):
            met.setdefault(word(), rng.randrange(50))
        met |= {"abab": 5, "bbbb": 7}
        rows = [(t, f, 1, "x") for t, f in met.items()] + [("abab", 99, 4, "x"), (None, 1, 1, "x"), ("", 1, 1, "x")]
        df = spark.createDataFrame(rows, "tag string, first long, uses long, place string")
        reg = spark.createDataFrame(entries, "tag string, aliases array<string>, place int")
        got = {r.tag: (r.canonical, r.how) for r in registry.registered(df, reg).collect()}
        assert got == fold(met, entries)
    assert {r.tag: r.uses for r in registry.registered(df, reg).collect()}["abab"] == 5
    assert registry.registered(df.where("false"), reg).count() == 0
    assert {r.how for r in registry.registered(df, reg.where("false")).collect()} == {"new", "similar"}
