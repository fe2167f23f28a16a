"""Records of the same people in sources without a common identifier.

Every record is entered under several composite sort keys (address, number, both orders of its name, firm), the entries are
sorted, and a window slides over them; pairs inside a window that a cheap test lets through are scored by weighted field
similarities. One person may have several records in a source: confident pairs make clusters by connection, so that each
source has at most one cluster of a person. Then the clusters of each two sources are assigned one to one with the greatest
total confidence; clusters that both have records in a source are two people and are never assigned to each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.linkage import linked_groups
from kinweave.llm.tags import edits
from kinweave.operators.ranking import top_k_per_group
from kinweave.plans.lineage import broadcast_if_small, discard, materialise
from kinweave.plans.skew import heavy_or_none, lookup_join

# Titles, roles of shared addresses, legal forms, and short forms of given names.
TITLES = frozenset("dr prof mag mr mrs ms ing dipl univ doc sir phd msc".split())
ROLES = frozenset("info office contact sales support admin hello team mail kontakt help noreply no-reply newsletter digest press jobs hr billing service reception".split())
LEGAL_FORMS = r"\b(inc|ltd|limited|gmbh|corp|corporation|co|llc|ag|plc|sa|srl|bv|ab|oy|kg)\b"
SHORT_FORMS = {
    "liz": "elizabeth", "beth": "elizabeth", "lisa": "elizabeth", "betty": "elizabeth", "bill": "william", "will": "william", "bob": "robert", "rob": "robert", "dick": "richard", "rick": "richard",
    "kate": "katharina", "kathi": "katharina", "tina": "christina", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "jenny": "jennifer", "mike": "michael", "mick": "michael", "tom": "tomas",
    "nick": "nicholas", "niko": "nicholas", "sandy": "alexander", "sasha": "alexander", "xander": "alexander", "ben": "benjamin", "seb": "sebastian", "basti": "sebastian", "theo": "teodor", "ted": "teodor", "pepe": "jose",
    "tess": "theresa", "terry": "theresa", "resi": "theresa", "toni": "anton", "tony": "anton", "drea": "andreas", "andi": "andreas", "andy": "andreas", "fredo": "frederic", "sam": "samuel", "gabi": "gabriela", "vicky": "viktor", "vic": "viktor",
}

WINDOW, BLOCK = 10, 2_000
#: A connected part of so many links at most is assigned exactly by one task; a larger one by an auction over all tasks,
#: whose bids rise by so much at least: its total is less than the greatest by at most that for each pair.
PART_LINKS, LEAST_RISE = 5_000, 0.01
CONFIDENT, WEAK = 0.6, 0.35
WEIGHTS = {"email": 0.6, "phone": 0.45, "full": 0.4, "initial": 0.2, "other_name": -0.7, "firm": 0.2, "other_firm": -0.2, "same_domain": -0.25}

_EMAIL = re.compile(r"^([^@\s<>,;]+)@([^@\s<>,;]+\.[^@\s<>,;.]+)$")


def fold(text: str) -> str:
    """Lower case without accents; letters that have no decomposition in their usual transcription."""
    if text.isascii():
        return text.lower()
    t = "".join([c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c)])
    return t.translate(str.maketrans({"đ": "d", "ł": "l", "ø": "o", "æ": "ae", "ß": "ss", "ı": "i"}))


def clean_email(raw: str | None) -> str | None:
    """One whole address in lower case without mailto:, brackets and what follows a plus; else None."""
    if not raw:
        return None
    m = _EMAIL.match(re.sub(r"^mailto:", "", raw.strip().strip("<> ").lower()))
    return f"{m[1].split('+')[0]}@{m[2]}" if m and m[1].split("+")[0] else None


def clean_phone(raw: str | None) -> str | None:
    """The last nine digits of a number without extension and trunk zero; None for fewer or for one repeated digit."""
    if not raw:
        return None
    d = re.sub(r"\D", "", re.sub(r"(?i)(ext|x|durchwahl)\b.*$", "", raw).replace("(0)", ""))
    return d[-9:] if len(d) >= 9 and len(set(d[-9:])) > 2 else None


def name_words(*texts: str | None) -> list[str]:
    """The two main words of a name, or one and an initial, in alphabetical order; the most complete of the texts counts."""
    best: list[str] = []
    for text in texts:
        if not text:
            continue
        words = [w for w in re.findall(r"[^\W\d_]+", fold(re.sub(r"\(.*?\)|\".*?\"", " ", text))) if w not in TITLES]
        long = [SHORT_FORMS.get(w, w) for w in words if len(w) > 1]
        kept = [long[0], long[-1]] if len(long) > 1 else long + [w for w in words if len(w) == 1][:1]
        if sum(map(len, kept)) > 3 and (len(kept), sum(len(w) > 1 for w in kept)) > (len(best), sum(len(w) > 1 for w in best)):
            best = kept
    return sorted(best)


def completed(words: list[str], locals_: list[str]) -> list[str]:
    """words, with an initial or a missing name made good by what stands before the @ of the record's addresses."""
    if len(words) == 2 and all(len(w) > 1 for w in words):
        return words
    for text in locals_:
        found = [w for w in name_words(text) or [fold(text)] if w.isalpha()]
        if not words and len(found) == 2:
            return found
        if len(words) == 2:
            initial, family = sorted(words, key=len)
            given = next((w for w in found if len(w) > 1 and w[0] == initial and _near(w, family) == 9 and not w.endswith(family)), None)
            if given and len(family) > 1:
                return sorted([SHORT_FORMS.get(given, given), family])
    return words


def firm(raw: str | None) -> str | None:
    """The firm's name without legal form, accents and signs."""
    if not raw:
        return None
    t = re.sub(r"[^a-z0-9]", "", re.sub(LEGAL_FORMS, "", fold(raw)))
    return t if len(t) > 3 and t not in ("unknown", "none", "null") else None


def _near(a: str, b: str) -> int:
    """0 for the same word or its beginning as a short form, else the slips of the pen between them (2 in long words); 9 beyond."""
    if a == b or (min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 5 and (a.startswith(b) or b.startswith(a)) and abs(len(a) - len(b)) >= 2):
        return 0
    shorter = min(len(a), len(b))
    most = 0 if shorter < 4 else 1 if shorter < 8 else 2
    found = edits(a, b, most)
    return found if found <= most else 9


def compare_names(a: list[str], b: list[str]) -> str:
    """`full`, `initial`, `other` or, where one is missing or too short to tell, `none`."""
    if not a or not b:
        return "none"
    if len(a) < 2 or len(b) < 2:
        long = a if len(a) < 2 else b
        rest = b if len(a) < 2 else a
        return "none" if any(_near(long[0], w) < 9 for w in rest) else "other"
    options = []
    for x, y in ((b[0], b[1]), (b[1], b[0])):
        slips, initials = 0, 0
        for u, v in ((a[0], x), (a[1], y)):
            if len(u) == 1 or len(v) == 1:
                initials += 1
                slips += 0 if u[0] == v[0] else 9
            else:
                slips += _near(u, v)
        options.append((slips, initials))
    slips, initials = min(options)
    return "other" if slips > 2 or initials > 1 else "initial" if initials else "full"


@lru_cache(maxsize=200_000)
def _names(a: str, b: str) -> float:
    kind = compare_names(a.split(), b.split())
    return {"full": WEIGHTS["full"], "initial": WEIGHTS["initial"], "other": WEIGHTS["other_name"]}.get(kind, 0.0)


@F.pandas_udf(T.DoubleType())
def name_weight(a: pd.Series, b: pd.Series) -> pd.Series:
    """The part of two names, each a text of its words, in a pair's confidence."""
    return pd.Series([_names(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def with_confidence(both: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, confidence) of the pairs, at least `least`, whose records' columns are the structs x and y, as _side gives them.

    A weighted sum of the fields' similarities, within 0 and 1. Only names are compared in Python, each two of them once, and
    only where the other fields leave a chance to reach `least`.
    """
    own, phone = F.arrays_overlap("x.own", "y.own"), F.arrays_overlap("x.phones", "y.phones")
    alike = F.exists("x.firms", lambda f: F.exists("y.firms", lambda g: (f == g) | ((F.length(f) >= 5) & (F.length(g) >= 5) & (f.startswith(g) | g.startswith(f)))))
    firm = F.when((F.size("x.firms") == 0) | (F.size("y.firms") == 0), 0.0).when(alike, WEIGHTS["firm"]).otherwise(WEIGHTS["other_firm"])
    domain = F.when(~own & F.arrays_overlap("x.domains", "y.domains"), WEIGHTS["same_domain"]).otherwise(0.0)
    rest = F.when(own, WEIGHTS["email"]).otherwise(0.0) + F.when(phone, WEIGHTS["phone"]).otherwise(0.0) + firm + domain
    rows = both.select("a", "b", rest.alias("rest"), F.col("x.name").alias("n"), F.col("y.name").alias("m"))
    if least > 0:
        rows = rows.where(F.col("rest") + WEIGHTS["full"] >= least - 1e-6)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rest") + name_weight("n", "m"))), 4)
    return rows.select("a", "b", score.alias("confidence")).where(F.col("confidence") >= least)


def records(contacts: DataFrame, google: DataFrame, vcards: DataFrame) -> DataFrame:
    """rec, emails, own, phones, words, name, firms, domains of every record of the three sources; rec is `source|key`.

    own: addresses that are no role's; domains: those of own addresses that belong to a firm which some record names.
    """
    none = F.array().cast("array<string>")
    parts = [
        contacts.where("id IS NOT NULL").select(F.concat(F.lit("contacts|"), F.col("id").cast("string")).alias("rec"), F.array("name").alias("names"), F.array("email").alias("emails"), none.alias("phones"), F.lit(None).cast("string").alias("organization")),
        google.where("resource_name IS NOT NULL").select(F.concat(F.lit("google_contacts|"), "resource_name").alias("rec"), F.array(F.concat_ws(" ", "given_name", "family_name"), "name").alias("names"), F.coalesce("emails", none).alias("emails"), F.coalesce("phones", none).alias("phones"), "organization"),
        vcards.where("card_id IS NOT NULL").select(F.concat(F.lit("vcards|"), F.col("card_id").cast("string")).alias("rec"), F.array(F.concat_ws(" ", "first_name", "last_name"), "name").alias("names"), F.coalesce(F.transform("emails", lambda x: x.value), none).alias("emails"), F.coalesce(F.transform("phones", lambda x: x.value), none).alias("phones"), "organization"),
    ]

    def clean(batches):
        for batch in batches:
            rows = []
            for rec, names, emails, phones, org in zip(*(batch[c] for c in ("rec", "names", "emails", "phones", "organization")), strict=True):
                es = sorted({e for e in map(clean_email, emails) if e})
                ps = sorted({p for p in map(clean_phone, phones) if p})
                words = name_words(*names)
                words = completed(words, [re.sub(r"[._-]+", " ", re.sub(r"[.\d]+$", "", e.split("@")[0])) for e in es if e.split("@")[0] not in ROLES])
                labels = [re.sub(r"[^a-z0-9]", "", re.sub(r"-[0-9a-z]{1,3}$", "", fold(e.split("@")[1].split(".")[0]))) for e in es]
                rows.append((rec, es, ps, words, firm(org), labels))
            yield pd.DataFrame(rows, columns=["rec", "emails", "phones", "words", "firm", "labels"])

    raw = parts[0].unionByName(parts[1]).unionByName(parts[2])
    cleaned = materialise(raw.mapInPandas(clean, "rec string, emails array<string>, phones array<string>, words array<string>, firm string, labels array<string>"), "records")
    firms = cleaned.where("firm IS NOT NULL").select(F.col("firm").alias("label"), F.lit(True).alias("is_firm")).distinct()
    places = cleaned.select("rec", F.explode(F.arrays_zip("emails", "labels")).alias("z")).select("rec", F.col("z.labels").alias("label"), F.substring_index("z.emails", "@", -1).alias("domain"))
    # a mail provider or a large firm may have a third of all addresses
    known = lookup_join(places, "label", firms, heavy_or_none(places, "label", places.count())).where("is_firm").groupBy("rec").agg(F.collect_set("label").alias("own"), F.collect_set("domain").alias("work"))
    joined = cleaned.join(known.withColumnRenamed("own", "labelled"), "rec", "left")
    all_firms = F.array_compact(F.array_distinct(F.concat(F.array("firm"), F.coalesce("labelled", none))))
    own = F.filter("emails", lambda e: ~F.substring_index(e, "@", 1).isin(sorted(ROLES)))
    domains = F.array_intersect(F.transform(own, lambda e: F.substring_index(e, "@", -1)), F.coalesce("work", none))
    return materialise(joined.select("rec", "emails", own.alias("own"), "phones", "words", F.array_join("words", " ").alias("name"), all_firms.alias("firms"), domains.alias("domains")), "records")


def sort_entries(people: DataFrame) -> DataFrame:
    """(key, words, mark, rec): the entries of each record under its composite sort keys; mark is the leading part."""
    name = F.concat_ws(" ", "words")
    w = lambda i: F.coalesce(F.get("words", F.lit(i)), F.lit(""))
    place = F.coalesce(F.get("firms", F.lit(0)), F.lit(""))
    entry = lambda kind, mark, *rest: F.struct(F.concat_ws("|", F.lit(kind), mark, *rest).alias("key"), F.concat_ws("|", F.lit(kind), mark).alias("mark"))
    by_email = F.transform("emails", lambda e: entry("e", e, name))
    by_phone = F.transform("phones", lambda p: entry("p", p, name))
    named = F.when(F.size("words") > 1, F.array(entry("a", w(0), w(1), place), entry("b", w(1), w(0), place))).otherwise(F.array())
    placed = F.when((F.size("words") > 1) & (F.size("firms") > 0), F.array(entry("f", place, w(0), w(1)), entry("g", place, w(1), w(0)))).otherwise(F.array())
    return people.select("rec", "words", F.explode(F.concat(by_email, by_phone, named, placed)).alias("x")).select("x.key", "x.mark", "words", "rec")


def _letter_sets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its letters as bits (a slip changes two at most), its length, and a number for its first three letters."""
    distinct = {w: k for k, w in enumerate(dict.fromkeys(words))}
    bits = np.array([sum({1 << (ord(c) % 62) for c in w}) for w in distinct], dtype=np.int64)
    length = np.array([len(w) for w in distinct], dtype=np.int64)
    start = pd.factorize(np.array([w[:3] for w in distinct], dtype=object))[0]
    at = np.array([distinct[w] for w in words], dtype=np.int64)
    return bits[at], length[at], start[at]


def window_pairs(entries: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: records within a window of each other in the global order of keys, if mark or names are alike.

    The order is cut into blocks of a bounded number of entries; each also gets the last entries of the block before, so
    that no window is lost at a boundary, and a key that very many records share is spread over blocks like any other.
    """
    spark = entries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # a row's place: the number of its partition, and its own in it
    ordered = entries.repartitionByRange(n, "key", "rec").sortWithinPartitions("key", "rec").select("mark", "words", "rec", F.monotonically_increasing_id().alias("row"))
    ordered = ordered.select("mark", "words", "rec", F.shiftright("row", 33).cast("int").alias("part"), F.col("row").bitwiseAND((1 << 33) - 1).alias("at"))
    ordered = materialise(ordered, "ordered")
    sizes = {r.part: r.n for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total))
        total += sizes[part]
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "part int, start long"))
    placed = ordered.join(offsets, "part").withColumn("pos", F.col("at") + F.col("start"))
    home = F.floor(F.col("pos") / block)
    blocks = F.when(F.col("pos") % block >= block - (window - 1), F.array(home, home + 1)).otherwise(F.array(home))
    placed = placed.select("mark", "words", "rec", "pos", F.explode(blocks).alias("block"))

    def slide(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("pos", ignore_index=True)
        start, n = int(g["block"].iloc[0]) * block, len(g)
        first = [w[0] if len(w) else "" for w in g["words"]]
        second = [w[1] if len(w) > 1 else "" for w in g["words"]]
        # words, beginnings, marks and records as numbers; an empty word is alike to none
        coded = pd.factorize(np.array(first + second, dtype=object))[0]
        f, s = coded[:n].copy(), coded[n:].copy()
        f[np.array([not x for x in first], dtype=bool)] = -1
        s[np.array([not x for x in second], dtype=bool)] = -2
        # the letters of each word as a set of bits, its length and its beginning
        masks, sizes, starts = _letter_sets(first + second)
        near = lambda u, v: (np.bitwise_count(masks[u] ^ masks[v]) <= 4) | (sizes[u] <= 1) | (sizes[v] <= 1) | (starts[u] == starts[v])
        at = np.arange(n)
        heads = pd.factorize(np.array([f"{x[:4]} {y[:4]}" for x, y in zip(first, second, strict=True)], dtype=object))[0]
        initials = pd.factorize(np.array([min(x[:1], y[:1]) + max(x[:1], y[:1]) for x, y in zip(first, second, strict=True)], dtype=object))[0]
        mark, rec = (pd.factorize(g[c])[0] for c in ("mark", "rec"))
        names, pos = g["rec"].to_numpy(), g["pos"].to_numpy()
        exact = g["mark"].str[0].isin(["e", "p"]).to_numpy()
        out = []
        for k in range(1, min(window, n)):
            x, y = slice(k, None), slice(None, -k)
            same = mark[x] == mark[y]
            i, j = at[x], at[y]
            # one word in common, and the other two no further apart than two slips of the pen, an initial or a short form
            shared = ((f[x] == f[y]) & (f[x] >= 0) & near(n + i, n + j)) | ((s[x] == s[y]) & (s[x] >= 0) & near(i, j)) | ((f[x] == s[y]) & (f[x] >= 0) & near(n + i, j)) | ((s[x] == f[y]) & (s[x] >= 0) & near(i, n + j)) | (heads[x] == heads[y])
            take = ((same & exact[x]) | (shared & ((initials[x] == initials[y]) | same))) & (rec[x] != rec[y]) & (pos[x] >= start)
            i = np.nonzero(take)[0]
            out.append(pd.DataFrame({"a": names[i + k], "b": names[i]}))
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}, dtype=object)
        turned = found["a"] > found["b"]
        return pd.DataFrame({"a": found["b"].where(turned, found["a"]), "b": found["a"].where(turned, found["b"])}).drop_duplicates()

    return placed.groupBy("block").applyInPandas(slide, "a string, b string").distinct()


def _side(people: DataFrame, end: str, as_: str) -> DataFrame:
    return people.select(F.col("rec").alias(end), F.struct("own", "phones", "name", "firms", "domains").alias(as_))


def scored_pairs(pairs: DataFrame, people: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, b, confidence) of the pairs that reach least."""
    both = pairs.join(_side(people, "a", "x"), "a").join(_side(people, "b", "y"), "b")
    return with_confidence(both, least)


def best_assignment(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """The one-to-one pairs (p, q) of a bipartite graph with the greatest total weight; all weights are positive.

    From the free left ends the way that gains most, over edges in and out of the assignment, is taken as long as one gains.
    """
    out: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for p, q, w in sorted(edges):
        out[p].append((q, round(w * 10_000)))
    mine: dict[str, str] = {}
    held: dict[str, tuple[str, int]] = {}
    while True:
        gain = {p: 0 for p in out if p not in mine}
        came: dict[str, str] = {}
        best: dict[str, int] = {}
        todo = list(gain)
        while todo:
            following = {}
            for p in todo:
                for q, w in out[p]:
                    if mine.get(p) != q and gain[p] + w > best.get(q, -1):
                        best[q], came[q] = gain[p] + w, p
                        if q in held and gain.get(held[q][0], -(10**9)) < best[q] - held[q][1]:
                            gain[held[q][0]] = best[q] - held[q][1]
                            following[held[q][0]] = None
            todo = list(following)
        free = [(-g, q) for q, g in best.items() if q not in held and g > 0]
        if not free:
            return sorted(mine.items())
        q = min(free)[1]
        while q is not None:
            p = came[q]
            before = mine.get(p)
            mine[p], held[q] = q, (p, dict(out[p])[q])
            if before is not None and held.get(before, ("",))[0] == p:
                del held[before]
            q = before


def auctioned(edges: DataFrame, rise: float = LEAST_RISE) -> DataFrame:
    """(p, q): a one-to-one assignment of edges(p, q, confidence) by an auction, in rounds of joins and aggregations.

    Every p without a q bids for the q that leaves it most, as much as would make the next best (or none) as good and `rise`
    more; each q goes to the highest bid, and whoever held it bids again. It ends when no bid leaves its bidder anything.
    """
    spark = edges.sparkSession
    held = spark.createDataFrame([], edges.select("q", "p", F.col("confidence").alias("price")).schema)
    while True:
        priced = edges.join(held.select("q", "price"), "q", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
        free = priced.join(held.select("p"), "p", "left_anti").withColumn("net", F.round(F.col("confidence") - F.col("price"), 6)).where("net > 0")
        two = top_k_per_group(free, ["p"], [F.desc("net"), F.col("q")], 2)
        pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
        bids = two.groupBy("p").agg(pick(1, "q").alias("q"), pick(1, "price").alias("price"), pick(1, "net").alias("net"), F.coalesce(pick(2, "net"), F.lit(0.0)).alias("next"))
        bids = bids.select("q", F.struct((F.col("price") + F.col("net") - F.col("next") + rise).alias("price"), "p").alias("bid"))
        won = materialise(bids.groupBy("q").agg(F.max("bid").alias("bid")).select("q", "bid.p", "bid.price"), "bids")
        if not won.take(1):
            discard(won)
            return held.select("p", "q")
        before, held = held, materialise(held.join(won.select("q"), "q", "left_anti").unionByName(won), "held")
        discard(before)
        discard(won)


def assigned(edges: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """(p, q): the one-to-one assignment of greatest total confidence over edges(p, q, confidence), distinct, p and q of two sides.

    Parts of the graph that are not connected are assigned apart: pairs whose ends have no other edge at once, the others
    exactly, part by part; parts of over part_links links (a name that very many records share) by auctioned.
    """
    edges = materialise(edges, "sides")
    degree = lambda end: edges.groupBy(end).agg(F.count(F.lit(1)).alias(f"n_{end}"))
    counted = materialise(edges.join(degree("p"), "p").join(degree("q"), "q"), "sides")
    alone = counted.where("n_p = 1 AND n_q = 1").select("p", "q")
    contested = counted.where("n_p > 1 OR n_q > 1").select("p", "q", "confidence")
    if not contested.take(1):
        return alone
    part = linked_groups(contested.select(F.concat(F.lit("p "), "p").alias("u"), F.concat(F.lit("q "), "q").alias("v"), F.lit(1.0).alias("s")), "u", "v", "s", 0.0)
    named = materialise(contested.join(part.select(F.expr("substring(contact, 3)").alias("p"), "group_key").where("contact LIKE 'p %'"), "p"), "parts")
    # at most one part in part_links links is large
    sizes = named.groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_links).select("group_key")
    large = materialise(sizes, "large")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(best_assignment(list(zip(rows["p"], rows["q"], rows["confidence"], strict=True))), columns=["p", "q"])

    small = named.join(large, "group_key", "left_anti") if large.take(1) else named
    out = alone.unionByName(small.groupBy("group_key").applyInPandas(solve, "p string, q string"))
    if large.take(1):
        rest = materialise(named.join(broadcast_if_small(large, 100_000), "group_key", "left_semi").select("p", "q", "confidence"), "contested")
        out = out.unionByName(auctioned(rest))
    return out


def same_people(contacts: DataFrame, google: DataFrame, vcards: DataFrame, confident: float = CONFIDENT, weak: float = WEAK) -> DataFrame:
    """(source1, key1, source2, key2, confidence): every pair of records of one person from two sources, source1 < source2.

    confidence is that of the pair's own fields; a pair that is one person's through other records may have little. Records
    whose fields are all null, blank or useless match nothing; repeated rows of one key count once; an empty source takes
    part in no pair; other columns are ignored.
    """
    people = records(contacts, google, vcards)
    pairs = materialise(scored_pairs(window_pairs(sort_entries(people)), people, weak), "pairs")
    groups = linked_groups(pairs, "a", "b", "confidence", confident)
    source = F.substring_index("rec", "|", 1)
    own = people.select("rec").distinct().join(groups.select(F.col("contact").alias("rec"), "group_key"), "rec", "left").select("rec", source.alias("source"), F.coalesce("group_key", "rec").alias("person"))
    own = materialise(own, "persons")
    loose = pairs.where(F.col("confidence") < confident)
    for left, right in (("google_contacts", "vcards"), ("contacts", "google_contacts"), ("contacts", "vcards")):
        has = own.groupBy("person").agg(F.collect_set("source").alias("sources"))
        end = lambda rec, name: own.join(has, "person").select(F.col("rec").alias(rec), F.col("person").alias(name), F.col("sources").alias(f"s_{name}"))
        links = loose.join(end("a", "p"), "a").join(end("b", "q"), "b").where(~F.arrays_overlap("s_p", "s_q"))
        turned = links.select(F.col("q").alias("p"), F.col("p").alias("q"), F.col("s_q").alias("s_p"), F.col("s_p").alias("s_q"), "confidence")
        sides = links.select("p", "q", "s_p", "s_q", "confidence").unionByName(turned).where(F.array_contains("s_p", left) & F.array_contains("s_q", right))
        # a cluster of all three sources has no side here; one of two sources stands on one side only, as its other end lacks both
        won = assigned(sides.groupBy("p", "q").agg(F.max("confidence").alias("confidence")))
        own = materialise(own.join(won.select(F.col("q").alias("person"), F.col("p").alias("into")), "person", "left").select("rec", "source", F.coalesce("into", "person").alias("person")), "persons")
    key = F.expr("substring(rec, instr(rec, '|') + 1)")
    one, two = (own.select("person", F.col("rec").alias(end), F.col("source").alias(f"source{i}"), key.alias(f"key{i}")) for i, end in ((1, "a"), (2, "b")))
    found = one.join(two, "person").where("source1 < source2").select("a", "b", "source1", "key1", "source2", "key2")
    return found.join(_side(people, "a", "x"), "a").join(_side(people, "b", "y"), "b").transform(_scored_columns)


def _scored_columns(both: DataFrame) -> DataFrame:
    kept = both.select("source1", "key1", "source2", "key2", F.struct("source1", "key1", "source2", "key2").alias("a"), F.lit(0).alias("b"), "x", "y")
    return with_confidence(kept).select("a.*", "confidence")
