"""Documents packed whole into containers of a fixed number of tokens by Karmarkar-Karp multiway differencing.

Documents are dealt into groups of a bounded number of tokens, in an order that only their ids decide, so that the same
documents always come out in the same containers. In a group, the least number of containers that could hold
it is tried first: every document starts as a partial partition of one filled and else empty containers, and the two
partitions with the largest imbalance are merged again and again, the fullest container of one with the emptiest of the
other, until one partition with nearly equal containers is left. While a container exceeds the capacity, the number of
containers rises by one.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.lineage import materialise

CAPACITY = 2_048
#: Containers of a full group, and of a bucket of groups, which one task deals out.
GROUP, BUCKET = 160, 640
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that tokenizer cuts a text into words before it merges bytes.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def counter(tokenizer: str):
    """A function from texts to numbers of tokens; a file of ranks (.tiktoken) or of the tokenizers library (.json)."""
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for k in range(0, len(texts), 64) for e in t.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document with a text; tokenizer is the path of a public tokenizer file."""

    def count(batches):
        of = counter(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array(of(batch["text"].tolist()), dtype=np.int64)})

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long")


def multiway(sizes: list[int], ways: int) -> list[list[int]]:
    """Numbers of the items in each of `ways` containers, by largest differencing."""
    heap = [(-s, k, [s], [[k]]) for k, s in enumerate(sizes)]
    # a partial partition keeps its filled containers only, fullest first; the others are empty
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, items_a = heapq.heappop(heap)
        _, _, sums_b, items_b = heapq.heappop(heap)
        free = ways - len(sums_a)
        if len(sums_b) > len(sums_a):
            sums_a, items_a, sums_b, items_b = sums_b, items_b, sums_a, items_a
            free = ways - len(sums_a)
        pairs = list(zip(sums_a, items_a, strict=True))
        for k, (s, it) in enumerate(zip(sums_b, items_b, strict=True)):
            if k < free:
                pairs.append((s, it))
            else:
                # the fullest of one with the emptiest of the other
                at = len(sums_a) - 1 - (k - free)
                pairs[at] = (pairs[at][0] + s, pairs[at][1] + it)
        pairs.sort(key=lambda x: -x[0])
        sums, items = [p[0] for p in pairs], [p[1] for p in pairs]
        least = sums[-1] if len(sums) == ways else 0
        ticket += 1
        heapq.heappush(heap, (least - sums[0], ticket, sums, items))
    return heap[0][3] if heap else []


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers, none over capacity; every size is at most capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = multiway(sizes, ways)
        if all(sum(sizes[k] for k in c) <= capacity for c in found):
            return found
        ways += 1


def packed_documents(documents: DataFrame, capacity: int = CAPACITY, group: int = GROUP, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, doc_id, piece, n_tokens): which container holds each document, or each piece of one over capacity.

    A document over capacity is cut into pieces of exactly capacity, and a rest that is packed like a document; piece
    counts from 0. Documents without tokens take no room and are in no container; null texts are left out. container is a
    text unique per container; it depends on the documents only, not on how they are partitioned. Groups are filled up to their last few tokens, so that the number of containers stays near
    the total by capacity.
    """
    sized = materialise(token_counts(documents, tokenizer).where("n_tokens > 0"), "sizes")
    whole = F.floor(F.col("n_tokens") / capacity)
    rest = F.col("n_tokens") - whole * capacity
    full = sized.where(F.col("n_tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece"))
    full = full.select(F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container"), "doc_id", F.col("piece").cast("long").alias("piece"), F.lit(capacity).cast("long").alias("n_tokens"))
    items = sized.select("doc_id", whole.cast("long").alias("piece"), rest.cast("long").alias("n_tokens")).where("n_tokens > 0")

    tokens = items.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = -(-tokens // (capacity * max(group, BUCKET // group * group))) or 1

    def deal(batches):
        """Containers of groups of documents, each group about as full as `group` containers."""
        bucket, number, held, total = None, 0, [], 0
        aside: list[tuple[int, int, int]] = []
        room = group * capacity - capacity // 2

        def emit():
            found = pack([x[2] for x in held], capacity)
            rows = [(f"g-{bucket}-{number}-{c}", *held[k]) for c, ks in enumerate(found) for k in ks]
            return pd.DataFrame(rows, columns=["container", "doc_id", "piece", "n_tokens"])

        for batch in batches:
            for own, *item in zip(*(batch[c].tolist() for c in ("bucket", "doc_id", "piece", "n_tokens")), strict=True):
                if own != bucket:
                    held += aside
                    if held:
                        yield emit()
                    bucket, number, held, aside, total = own, 0, [], [], 0
                if total + item[2] <= room:
                    held.append(item)
                    total += item[2]
                else:
                    aside.append(item)
                # close the group when it is full, or when enough that did not fit waits for the next one
                if room - total < 8 or len(aside) >= 64:
                    yield emit()
                    number, held, total = number + 1, aside, sum(x[2] for x in aside)
                    aside = []
        held += aside
        if held:
            yield emit()

    mixed = F.xxhash64("doc_id", "piece")
    keyed = items.withColumn("bucket", F.pmod(mixed, F.lit(buckets))).withColumn("mixed", mixed)
    n = max(1, int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartition(n, "bucket").sortWithinPartitions("bucket", "mixed", "doc_id", "piece").drop("mixed")
    return full.unionByName(ordered.mapInPandas(deal, "container string, doc_id long, piece long, n_tokens long"))
