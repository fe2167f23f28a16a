"""Evaluation texts that leaked into a corpus, found by latent semantic retrieval and confirmed word by word.

Texts are cut into overlapping passages of WINDOW words over the vocabulary of the evaluation items (other words can't
contribute to a dot product with an item). Passages are weighted by tf-idf with the square of the idf, so that what is
particular to an item outweighs its phrasing. A randomised SVD, computed by two distributed passes over the passages of a
bounded sample of documents and of all items, gives the latent space; passages of the corpus whose cosine with a passage of an item is high are
candidates. A candidate document is confirmed by a long common run or by aligning the item's sentences.

The corpus is read a constant number of times whatever the number of items: its words are coded once, counted once and
searched once; the texts of candidates are read again. Items are held in shards of a bounded number
of passages, so a book-length item is spread over several.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.lineage import materialise

WINDOW, STRIDE = 12, 4
#: Distance of an item's passages. The nearest of them is out of line with a passage of a document by one word at most.
ITEM_STRIDE = 2
RANK, OVERSAMPLE = 128, 16
#: The latent space is fitted on so many documents at most, chosen by their ids, and on all items; counts, weights and search
#: cover all documents.
FITTED_DOCUMENTS = 20_000
COSINE = 0.55
#: A passage is searched for unless its known words weigh less than this part of the lightest passage of any item: one of
#: words so common cannot be most of an item's sentence.
LIGHT = 0.125
#: Passages, or characters, of items in one shard, which is what an executor holds of them at once.
SHARD_PASSAGES, SHARD_CHARS = 100_000, 20_000_000
#: Matrices that one task of the tree adds up.
FAN_IN = 16
#: Passages of documents in memory at once, and those that meet a shard while it is loaded.
CHUNK, SLAB = 2_048, 65_536

_TAG = re.compile(r"<[^<>]{0,500}>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")
_HAN = re.compile(r"^[぀-ヿ㐀-鿿豈-﫿]$")
_SENTENCE = re.compile(r"(?<=[.?!])[\"”»’)]*\s+|(?<=[。？！])|\n\s*\n")


_MARKS = frozenset(chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c)))


def tokens(text: str) -> list[str]:
    """Words without case, accents, mark-up and punctuation; each Han or Kana sign is a word."""
    t = _TAG.sub("", html.unescape(text) if "&" in text else text)
    if t.isascii():
        return _TOKEN.findall(t.lower())
    t = unicodedata.normalize("NFKD", _HIDDEN.sub("", t)).casefold()
    for mark in _MARKS.intersection(t):
        t = t.replace(mark, "")
    return _TOKEN.findall(unicodedata.normalize("NFC", t))


def _starts(n: int, stride: int) -> np.ndarray:
    """First words of the passages of a text of n words; the last passage ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    at = np.arange(0, n - WINDOW + 1, stride)
    return at if at[-1] == n - WINDOW else np.append(at, n - WINDOW)


def _passages(ids: np.ndarray, stride: int) -> np.ndarray:
    """Matrix of word ids, one row a passage; -1 for words outside the vocabulary, repetitions and beyond the end."""
    padded = np.append(ids, np.full(max(0, WINDOW - len(ids)), -1, dtype=ids.dtype))
    rows = np.sort(padded[_starts(len(ids), stride)[:, None] + np.arange(WINDOW)], axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
    return rows


def _project(rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Passages times basis; basis holds the weights and ends with a row of zeros for -1."""
    out = np.zeros((len(rows), basis.shape[1]), dtype=np.float32)
    for k in range(rows.shape[1]):
        out += basis[rows[:, k]]
    return out


def _weighted(basis: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.vstack([basis * weights[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)


def _vocabulary(items: DataFrame) -> dict[str, int]:
    """The words of all items with numbers. Only item words are kept, so its size is bounded by the items' language, not by the corpus."""

    def words(batches):
        for batch in batches:
            yield pd.DataFrame({"word": sorted({w for t in batch["text"] for w in tokens(t)})}, dtype=object)

    found = items.select("text").mapInPandas(words, "word string").distinct().collect()
    return {w: k for k, w in enumerate(sorted(r.word for r in found))}


def _coded(documents: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, ids): the words of each document (or item) as numbers of the vocabulary, -1 outside it; documents without any stay out."""

    def code(batches):
        number = vocabulary.value
        for batch in batches:
            ids = [np.array([number.get(w, -1) for w in tokens(t)], dtype=np.int32) for t in batch["text"]]
            keep = [k for k, x in enumerate(ids) if (x >= 0).any()]
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[keep], "ids": [ids[k] for k in keep]})

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(code, "doc_id long, ids array<int>")


def _chunks(batches, stride: int, size: int = CHUNK):
    """(passages, document of each) of about size passages at a time, so that long and many documents fit in memory."""
    for batch in batches:
        docs = batch["doc_id"].to_numpy() if "doc_id" in batch else np.zeros(len(batch), dtype=np.int64)
        held, of, n = [], [], 0
        for doc, ids in zip(docs, batch["ids"], strict=True):
            rows = _passages(np.asarray(ids, dtype=np.int32), stride)
            for k in range(0, len(rows), CHUNK):
                held.append(rows[k : k + CHUNK])
                of.append(np.full(len(held[-1]), doc, dtype=np.int64))
                n += len(held[-1])
                if n >= size:
                    yield np.vstack(held), np.concatenate(of)
                    held, of, n = [], [], 0
        if held:
            yield np.vstack(held), np.concatenate(of)


def _document_frequencies(coded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages (without overlap) of all documents each word of the vocabulary occurs, and their number."""

    def count(batches):
        total, n = np.zeros(size + 1, dtype=np.int64), 0
        for rows, _ in _chunks(batches, WINDOW):
            total += np.bincount(rows.ravel() + 1, minlength=size + 1)
            n += len(rows)
        hit = np.nonzero(total[1:])[0]
        yield pd.DataFrame({"word": np.append(hit, -1), "n": np.append(total[1:][hit], n)})

    found = coded.select("ids").mapInPandas(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(size, dtype=np.int64), 0
    for r in found:
        if r.word < 0:
            n = r.n
        else:
            out[r.word] = r.n
    return out, n


def _summed(coded: DataFrame, partial, shape: tuple[int, int], stride: int = WINDOW) -> np.ndarray:
    """Sum over all partitions of the matrix that partial makes of a partition, added up as a tree on the executors."""

    def make(batches):
        total = np.zeros(shape)
        for rows, _ in _chunks(batches, stride):
            total += partial(rows)
        yield pd.DataFrame({"m": [total.tobytes()]})

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            for m in batch["m"]:
                total += np.frombuffer(m).reshape(shape)
        yield pd.DataFrame({"m": [total.tobytes()]})

    parts = coded.select("ids").mapInPandas(make, "m binary")
    left = parts.rdd.getNumPartitions()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = parts.repartition(left).mapInPandas(add, "m binary")
    return sum((np.frombuffer(r.m).reshape(shape) for r in parts.repartition(1).mapInPandas(add, "m binary").collect()), np.zeros(shape))


def latent_basis(coded: DataFrame, items: DataFrame, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Words x rank: right singular vectors of the weighted passages of all documents and, as much again, of the items."""
    size, width = len(weights), min(len(weights), rank + OVERSAMPLE)
    spark = coded.sparkSession
    omega = np.random.default_rng(7).standard_normal((size, width))

    def spread_back(rows: np.ndarray, z: np.ndarray) -> np.ndarray:
        out = np.zeros((size + 1, z.shape[1]))
        order = np.argsort(rows, axis=None, kind="stable")
        words, where = rows.ravel()[order], order // rows.shape[1]
        first = np.nonzero(np.r_[True, words[1:] != words[:-1]])[0]
        out[words[first]] = np.add.reduceat(z[where], first, axis=0)
        return out[:size] * weights[:, None]

    def gram(basis: np.ndarray, back: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(_weighted(basis, weights))

        def one(rows):
            z = _project(rows, shared.value).astype(np.float64)
            return spread_back(rows, z) if back else z.T @ z

        of_documents = _summed(coded, one, (size, width) if back else (width, width))
        of_items = _summed(items, one, (size, width) if back else (width, width), 1)
        scale = np.linalg.norm(of_documents) / max(np.linalg.norm(of_items), 1e-12)
        return of_documents + of_items * (scale if scale > 0 else 1.0)

    q, _ = np.linalg.qr(gram(omega, True))
    _, u = np.linalg.eigh(gram(q, False))
    return q @ u[:, ::-1][:, :rank]


def _lightest(items: DataFrame, weights: np.ndarray) -> float:
    """The least squared weight of a passage of any item."""
    square = items.sparkSession.sparkContext.broadcast(np.append(weights**2, 0.0))

    def least(batches):
        for rows, _ in _chunks(batches, ITEM_STRIDE):
            yield pd.DataFrame({"least": [float(square.value[rows].sum(axis=1).min())]})

    return items.select("ids").mapInPandas(least, "least double").agg(F.min("least")).first()[0] or 0.0


def _shards(items: DataFrame, basis: np.ndarray, weights: np.ndarray, most: int):
    """Broadcasts of (latent passages, item of each), of at most `most` passages; only one is on the driver at a time."""
    projection = _weighted(basis, weights)

    def shard(rows, of):
        latent = _project(np.vstack(rows), projection)
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        return items.sparkSession.sparkContext.broadcast((latent.T.copy(), np.concatenate(of)))

    held, of, n = [], [], 0
    for r in items.orderBy("doc_id").toLocalIterator():
        rows = _passages(np.asarray(r.ids, dtype=np.int32), ITEM_STRIDE)
        for k in range(0, len(rows), most):
            held.append(rows[k : k + most])
            of.append(np.full(len(held[-1]), r.doc_id, dtype=np.int64))
            n += len(held[-1])
            if n >= most:
                yield shard(held, of)
                held, of, n = [], [], 0
    if held:
        yield shard(held, of)


def _candidates(coded: DataFrame, shards: list, weights: np.ndarray, basis: np.ndarray, cosine: float, least: float) -> DataFrame:
    """(doc_id, item_id): documents with a passage near one of the item's in the latent space. One sweep for all shards."""
    shared = coded.sparkSession.sparkContext.broadcast((_weighted(basis, weights), np.append(weights**2, 0.0)))

    def search(batches):
        projection, square = shared.value
        for rows, of in _chunks(batches, STRIDE, SLAB):
            known = square[rows].sum(axis=1) >= least
            rows, of = rows[known], of[known]
            found: set[tuple[int, int]] = set()
            latent = _project(rows, projection)
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
            for shard in shards:
                targets, owner = shard.value
                for k in range(0, len(rows), 256):
                    a, b = np.divmod(np.flatnonzero(latent[k : k + 256] @ targets >= cosine), targets.shape[1])
                    if len(a):
                        found.update(zip(of[k + a].tolist(), owner[b].tolist(), strict=True))
                if len(shards) > 1:
                    # the next shard takes this one's place in memory
                    shard.__dict__.pop("_value", None)
            yield pd.DataFrame(sorted(found), columns=["doc_id", "item_id"]).astype("int64")

    return coded.mapInPandas(search, "doc_id long, item_id long")


class Confirm:
    """Exact test of an item against a text."""

    def __init__(self, text: str):
        self.words = tokens(text)
        self.han = sum(bool(_HAN.match(w)) for w in self.words) > len(self.words) / 2
        joined = "".join(self.words)
        self.runs = [joined[i : i + 20] for i in range(len(joined) - 19)] if self.han else [f" {' '.join(self.words[i : i + 12])} " for i in range(len(self.words) - 11)]
        self.sentences = [s for s in (tokens(x) for x in _SENTENCE.split(text)) if s]

    def holds(self, text: "Text") -> bool:
        if self.han:
            if any(run in text.signs for run in self.runs):
                return True
        else:
            # only where twelve words in a row occur in the text at all can they stand there in a row
            streak = 0
            for k, w in enumerate(self.words):
                streak = streak + 1 if w in text.codes else 0
                if streak >= 12 and self.runs[k - 11] in text.words:
                    return True
        for s in self.sentences:
            most = len(s) // 8
            # a word that the text lacks is altered wherever the sentence stands
            if sum(w not in text.codes for w in s) <= most and _altered(s, text.codes, text.coded) <= most:
                return True
        return False


class Text:
    """What the tests of all items need of one text."""

    def __init__(self, text: str):
        words = tokens(text)
        codes = defaultdict(lambda: len(codes))
        self.coded = np.array([codes[w] for w in words], dtype=np.int32)
        self.codes = dict(codes)
        self.words, self.signs = f" {' '.join(words)} ", "".join(words)


def _altered(sentence: list[str], codes: dict[str, int], text: np.ndarray) -> int:
    """Fewest words of the sentence that are replaced or left out where it stands in the text (a common subsequence in place)."""
    row = np.zeros(len(text) + 1, dtype=np.int32)
    for k, w in enumerate(sentence, 1):
        nxt = row + 1
        np.minimum(nxt[1:], row[:-1] + (text != codes.get(w, -1)), out=nxt[1:])
        nxt[0] = k
        row = np.minimum(nxt, np.minimum.accumulate(nxt - np.arange(len(nxt))) + np.arange(len(nxt)))
    return int(row.min())


def _text_shards(items: DataFrame, most: int):
    """Lists of (item_id, text) of about `most` characters, of which the driver holds one at a time."""
    held, n = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        held.append((r.item_id, r.text))
        n += len(r.text)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _confirmed(candidates: DataFrame, documents: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    """The candidates whose document holds the item, of the items given."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(dict(rows))
    least, most = rows[0][0], rows[-1][0]

    def test(batches):
        texts = shared.value
        known: dict[int, Confirm] = {}
        for batch in batches:
            found = []
            for doc, text, wanted in zip(batch["doc_id"], batch["text"], batch["items"], strict=True):
                own = Text(text)
                for k in wanted:
                    item = known.get(k) or known.setdefault(k, Confirm(texts[k]))
                    if item.holds(own):
                        found.append((doc, k))
            yield pd.DataFrame(found, columns=["doc_id", "item_id"]).astype("int64")

    # a document meets each item of the shard once, so its list is no longer than the shard
    wanted = candidates.where(F.col("item_id").between(least, most)).distinct().groupBy("doc_id").agg(F.collect_list("item_id").alias("items"))
    return wanted.join(documents, "doc_id").mapInPandas(test, "doc_id long, item_id long")


def leaked_items(documents: DataFrame, items: DataFrame, cosine: float = COSINE, shard_passages: int = SHARD_PASSAGES, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, item_id): the documents that contain an item in part (12 words in a row, or 20 signs of Chinese) or a
    whole sentence of it with at most one word in eight altered.

    Null and blank texts contain nothing and are contained in nothing; repeated documents are each reported; other columns
    are ignored; without items or documents the result is empty; of several items with one id the smallest text counts. A
    sentence shorter than eight words must be whole. The result does not depend on the sizes of shards.
    """
    spark: SparkSession = documents.sparkSession
    listed = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    number = _vocabulary(listed)
    if not number:
        return spark.createDataFrame([], "doc_id long, item_id long")
    vocabulary = spark.sparkContext.broadcast(number)
    targets = materialise(_coded(listed.select(F.col("item_id").alias("doc_id"), "text"), vocabulary), "items")
    coded = materialise(_coded(documents, vocabulary), "coded")
    counts, n = _document_frequencies(coded, len(number))
    weights = np.log((n + 1.0) / (counts + 1.0)) ** 2 + 1e-3
    share = FITTED_DOCUMENTS / max(1, coded.count())
    fitted = coded if share >= 1 else coded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    basis = latent_basis(fitted, targets, weights)
    shards = list(_shards(targets, basis, weights, shard_passages))
    near = materialise(_candidates(coded, shards, weights, basis, cosine, LIGHT * _lightest(targets, weights)).distinct(), "candidates")
    suspects = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").join(near.select("doc_id").distinct(), "doc_id", "left_semi")
    out = None
    for rows in _text_shards(listed, shard_chars):
        found = _confirmed(near, suspects, rows)
        out = found if out is None else out.unionByName(found)
    return out
