"""Free-entered values mapped to the entries of a reference list.

Distinct values are normalised and looked up through an inverted index of weighted character n-grams; the names that reach
a threshold of weighted cosine are candidates. A candidate is confirmed by its edit distance, since short decoys are as near
by cosine as real slips; of several, the one with fewest edits and then the highest cosine is meant, if it leads by a margin.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.plans.lineage import materialise
from kinweave.plans.skew import lookup_join

# Words that people put around a tag without changing what it means.
FILLERS = ["sector", "industry", "company", "companies", "startup", "startups", "firm", "firms", "branch", "tag", "eu", "us", "uk"]

THRESHOLD, MARGIN = 0.12, 0.02
#: Names in a block of the index, which is what an executor holds of it at once.
BLOCK = 20_000


def _plain(text: str) -> str:
    t = unicodedata.normalize("NFKC", text).casefold()
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^\w]+|_", " ", t.replace("&", " and ")).split())


@F.pandas_udf(T.StringType())
def plain(values: pd.Series) -> pd.Series:
    """Compatibility form, folded case, without accents; every run of other signs is one blank."""
    return values.map(lambda v: None if v is None else _plain(v))


def _grams(text: str) -> set[str]:
    """Bigrams, trigrams and pairs one sign apart of each word with its ends marked: the order of words does not count."""
    out = set()
    for word in (f"^{w}$" for w in text.split()):
        out.update(word[i : i + 2] for i in range(len(word) - 1))
        out.update(word[i : i + 3] for i in range(len(word) - 2))
        out.update(word[i] + "_" + word[i + 2] for i in range(len(word) - 2))
    joined = text.replace(" ", "")
    out.update("~" + joined[i : i + 3] for i in range(len(joined) - 2))
    return out


def _variants(form: str) -> list[str]:
    """The form, and what is left of it as words around a tag are taken off its ends."""
    out, todo = [], [tuple(form.split())]
    while todo:
        words = todo.pop(0)
        if words and words not in out:
            out.append(words)
            todo += [words[1:]] if words[0] in FILLERS else []
            todo += [words[:-1]] if words[-1] in FILLERS else []
    return [" ".join(w) for w in out]


#: Letters are counted in so many classes, by code point.
CLASSES = 64


def _letters(text: str) -> np.ndarray:
    return np.bincount([ord(c) % CLASSES for c in text if c != " "], minlength=CLASSES)


class Index:
    """Inverted index of idf-weighted n-grams over a block of names, with each name's letters counted."""

    def __init__(self, names: list[tuple[str, str]], weights: dict[str, float], unseen: float):
        self.names, self.weights, self.unseen = names, weights, unseen
        lists: dict[str, list[int]] = {}
        norms = []
        for k, (name, _) in enumerate(names):
            grams = _grams(name)
            norms.append(math.sqrt(sum(weights[g] ** 2 for g in grams)) or 1.0)
            for g in grams:
                lists.setdefault(g, []).append(k)
        self.norms = np.array(norms)
        self.lists = {g: np.array(v, dtype=np.int32) for g, v in lists.items()}
        self.letters = np.array([_letters(name) for name, _ in names])
        self.slips = np.array([max(1, _allowed(name.replace(" ", ""))) for name, _ in names])

    def norm(self, text: str) -> float:
        return math.sqrt(sum(self.weights.get(g, self.unseen) ** 2 for g in _grams(text))) or 1.0

    def search(self, text: str, threshold: float, norm: float | None = None) -> list[tuple[float, int]]:
        """(cosine, number) of the names whose weighted cosine with text reaches the threshold and whose letters allow the slips
        that they may carry: each slip adds and takes away one letter at most, in whatever order the words stand."""
        hit = [g for g in _grams(text) if g in self.lists]
        if not hit:
            return []
        dot = np.zeros(len(self.names))
        for g in hit:
            dot[self.lists[g]] += self.weights[g] ** 2
        cosine = dot / self.norms / (norm or self.norm(text))
        near = np.nonzero(cosine >= threshold)[0]
        apart = self.letters[near] - _letters(text)
        near = near[np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1)) <= self.slips[near]]
        return [(float(cosine[k]), int(k)) for k in near]


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap of neighbours), or most + 1 beyond most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def _allowed(name: str) -> int:
    """Slips of the pen that a name of this length may carry and still be meant."""
    return 0 if len(name) < 4 else 1 if len(name) < 9 else 2 if len(name) < 11 else 3 if len(name) < 24 else 4


def _slips(value: str, name: str) -> int:
    """Fewest edits between value and name, words in their order or in any; -1 if more than the length allows."""
    joined, target = value.replace(" ", ""), name.replace(" ", "")
    most = _allowed(target)
    if joined == target + "s" or joined + "s" == target and len(target) > 4:
        return 0 if joined == target else 1
    found = edits(joined, target, most)
    words, own = value.split(), name.split()
    if found and len(own) > 1:
        for k in range(1, len(words)):
            found = min(found, edits("".join(words[k:] + words[:k]), target, most))
        found = min(found, edits("".join(sorted(words)), "".join(sorted(own)), most), edits("".join(reversed(words)), target, most))
    return found if found <= most else -1


def registry_names(registry: DataFrame) -> DataFrame:
    """(name, tag): tag, label and aliases of each entry in plain form, with "technology" also shortened to "tech".

    A name of several tags goes to the smallest of them.
    """
    raw = F.explode(F.concat(F.array("tag", "label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    names = registry.where("tag IS NOT NULL").select("tag", raw.alias("raw")).where("raw IS NOT NULL").select("tag", plain("raw").alias("name")).where("name <> ''")
    short = names.select("tag", F.regexp_replace("name", r"\btechnology\b", "tech").alias("name"))
    return names.unionByName(short).groupBy("name").agg(F.min("tag").alias("tag"))


def map_values(values: DataFrame, registry: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, block: int = BLOCK) -> DataFrame:
    """(form, tag) for every plain form (column form, distinct) that means a registry entry.

    Candidates come from the inverted index by weighted cosine and are confirmed by their edit distance. The tag with
    fewest edits, then highest cosine, is taken; if another tag has as few edits (some) and comes within the margin, none
    is. The index goes to the executors in blocks of a bounded number of names, with the weights of their n-grams only; every
    form meets every block, and its length is that under the weights of all names.
    """
    names = materialise(registry_names(registry), "names")
    n = max(1, names.count())
    blocks = -(-n // block)
    numbered = names.withColumn("b", F.pmod(F.xxhash64("name"), F.lit(blocks)))
    counts = materialise(_with_grams(numbered, "name").select("b", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.collect_set("b").alias("blocks")), "grams")
    spark, found = values.sparkSession, None
    variants = _with_variants(values)
    if blocks > 1:
        variants = variants.join(_lengths(variants, counts, n), "variant")
    else:
        variants = variants.withColumn("length", F.lit(None).cast("double"))
    # little data, much work per row: an own number of tasks, which adaptive execution leaves alone
    spread = variants.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    for b in range(blocks):
        part = [(r.name, r.tag) for r in numbered.where(F.col("b") == b).select("name", "tag").orderBy("name").collect()]
        weights = {r.gram: math.log(n / r.n) + 1 for r in counts.where(F.array_contains("blocks", F.lit(b).cast("long"))).select("gram", "n").collect()}
        index = spark.sparkContext.broadcast((part, weights, math.log(n) + 1))
        hits = spread.mapInPandas(_searcher(index, threshold), "form string, tag string, near int, cosine double")
        found = hits if found is None else found.unionByName(hits)
    by_tag = found.groupBy("form", "tag").agg(F.max(F.struct("near", "cosine")).alias("s"))
    order = F.struct("s.near", "s.cosine", "tag")
    best = by_tag.groupBy("form").agg(F.max(order).alias("b"), F.slice(F.sort_array(F.collect_list(order), asc=False), 1, 2).alias("two"))
    second = F.get("two", F.lit(1))
    tied = F.coalesce((F.col("b.near") < 0) & (second.near == F.col("b.near")) & (second.cosine > F.col("b.cosine") - margin), F.lit(False))
    return best.where(~tied).select("form", F.col("b.tag").alias("tag"))


def _with_grams(rows: DataFrame, text: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def grams(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sorted(_grams(v)))

    return rows.withColumn("grams", grams(text))


def _with_variants(values: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def variants(forms: pd.Series) -> pd.Series:
        return forms.map(_variants)

    return values.select("form", F.explode(variants("form")).alias("variant"))


def _lengths(variants: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """(variant, length): the length of each variant's vector under the weights of all names."""
    grams = _with_grams(variants.select("variant").distinct(), "variant").select("variant", F.explode("grams").alias("gram"))
    weight = F.log(F.lit(float(n)) / F.coalesce("n", F.lit(1))) + 1
    return grams.join(counts.select("gram", "n"), "gram", "left").groupBy("variant").agg(F.sqrt(F.sum(weight * weight)).alias("length"))


def _searcher(index, threshold: float):
    def search(batches):
        own = Index(*index.value)
        for batch in batches:
            rows = []
            for form, variant, length in zip(batch["form"], batch["variant"], batch["length"], strict=True):
                for cosine, k in own.search(variant, threshold, None if pd.isna(length) else length):
                    name, tag = own.names[k]
                    slips = _slips(variant, name)
                    if slips >= 0:
                        rows.append((form, tag, -slips, cosine))
            yield pd.DataFrame(rows, columns=["form", "tag", "near", "cosine"]).astype({"form": "object", "tag": "object", "near": "int32", "cosine": "float64"})

    return search


def mapped_elements(elements: DataFrame, registry: DataFrame) -> DataFrame:
    """elements (with a text column value) with the column tag: a registry tag, or `(none)` for what matches none.

    Each element keeps its row, repeated ones too; null and blank values are `(none)`, and an empty registry leaves all
    unmatched. The work is done once per distinct plain form; values that very many rows share are joined by broadcast.
    """
    counted = materialise(elements.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n")), "values")
    forms = materialise(counted.select("value", "n", plain("value").alias("form")), "forms")
    tags = map_values(forms.where("form <> ''").select("form").distinct(), registry)
    facts = materialise(forms.join(tags, "form").select("value", "tag"), "mapped")
    total = counted.agg(F.sum("n")).first()[0] or 0
    heavy = counted.where(F.col("n") > max(20_000, total // 20_000)).select("value").collect()
    hot = elements.sparkSession.createDataFrame(heavy, "value string") if heavy else None
    return lookup_join(elements, "value", facts, hot).withColumn("tag", F.coalesce("tag", F.lit("(none)")))
