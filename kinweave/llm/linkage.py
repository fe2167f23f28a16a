"""One group key for every record that pairwise matches link, by low-diameter decomposition.

On each level every vertex draws an exponentially distributed head start; a few rounds of relaxation let clusters grow
from the vertices whose start time is earliest, the cluster of a vertex being the centre that reaches it first. Clusters
are contracted to super-vertices, edges between clusters make the next level's graph, and the levels' assignments are
composed. A centre reaches a vertex only along links, so a contraction never joins what is not linked, whatever the number
of rounds; and the recursion ends only when no edge between clusters is left. Once a level has left at most LOCAL_EDGES
edges, one task goes on with the same decomposition in memory: what it holds is bounded, and every edge is still used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.lineage import discard, materialise
from kinweave.plans.skew import heavy_or_none, lookup_join

RATE = 0.2
ROUNDS = 4
#: At most so many edges (16 bytes each) of a contracted graph are gathered in one task, on an executor.
LOCAL_EDGES = 1_000_000


def clean_key(raw):
    """A record key without blanks around it and without leading ./ steps."""
    return F.regexp_replace(F.regexp_replace(raw, r"^[\s ]+|[\s ]+$", ""), r"^(\./)+", "")


def linked_groups(pairs: DataFrame, left: str = "contact1", right: str = "contact2", similarity: str = "similarity", threshold: float = 0.7, rate: float = RATE, rounds: int = ROUNDS, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(contact, group_key): every record that a pair of at least threshold links to another one, with the smallest key of its group.

    Pairs with a null key, a null or NaN similarity, or the same record twice are no links. Repeated, turned-round and
    contradicting pairs do no harm: one sufficient row makes a link. Other columns are ignored. Without links the result
    is empty. Keys compare by their UTF-8 bytes.
    """
    a, b, sim = clean_key(F.col(left)), clean_key(F.col(right)), F.col(similarity)
    links = pairs.where(sim.isNotNull() & ~F.isnan(sim) & (sim >= threshold)).select(a.alias("a"), b.alias("b"))
    links = links.where((F.col("a") != F.col("b")) & (F.col("a") != "") & (F.col("b") != ""))
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("contact")).distinct()
    names = materialise(ends.select("contact", F.monotonically_increasing_id().alias("v")), "vertices")
    total = links.count()
    by_left = lookup_join(links, "a", names.select(F.col("contact").alias("a"), F.col("v").alias("x")), heavy_or_none(links, "a", total))
    coded = lookup_join(by_left, "b", names.select(F.col("contact").alias("b"), F.col("v").alias("y")), heavy_or_none(links, "b", total))
    edges = materialise(coded.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "edges")
    levels: list[DataFrame] = []
    while (count := edges.count()) > 0:
        # the first level is always taken by all tasks
        local = bool(levels) and count <= local_edges
        labels, following = (_in_memory(edges, len(levels), rate), None) if local else _level(edges, count, len(levels), rate, rounds)
        discard(edges)
        levels.append(labels)
        if local:
            break
        edges = following
    if not levels:
        return names.select("contact", F.col("contact").alias("group_key")).limit(0)
    whole = levels[-1]
    for labels in reversed(levels[:-1]):
        up = whole.select(F.col("v").alias("c"), F.col("c").alias("_up"))
        joined = lookup_join(labels, "c", up, heavy_or_none(labels, "c", labels.count()))
        whole = materialise(joined.select("v", F.coalesce("_up", "c").alias("c")), "composed")
    members = materialise(names.join(whole, "v").select("contact", "c"), "members")
    smallest = members.groupBy("c").agg(F.min("contact").alias("group_key"))
    return lookup_join(members, "c", smallest, heavy_or_none(members, "c", total * 2)).select("contact", "group_key")


def _level(edges: DataFrame, count: int, level: int, rate: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The (v, c) assignment of one decomposition and the edges between its clusters.

    Every vertex also has an edge to itself that costs nothing, so that a round is one join and one aggregation and the
    rounds make one plan. Only where heavy vertices split the join, which reads the state twice, is it written between.
    """
    both = edges.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select(F.col("e.x").alias("v"), F.col("e.y").alias("to"))
    heavy = heavy_or_none(both, "v", 2 * count)
    vertices = both.select("v").distinct()
    uniform = (F.shiftrightunsigned(F.xxhash64("v", F.lit(level)), 11).cast("double") + 1) / F.lit(float(1 << 53))
    state = vertices.select("v", F.struct((F.log(uniform) / rate).alias("at"), F.col("v").alias("c")).alias("s"))
    steps = both.select("v", "to", F.lit(1.0).alias("cost")).unionByName(vertices.select("v", F.col("v").alias("to"), F.lit(0.0).alias("cost")))
    for _ in range(rounds):
        state = state if heavy is None else materialise(state, "state")
        sent = lookup_join(steps, "v", state, heavy).select(F.col("to").alias("v"), F.struct((F.col("s.at") + F.col("cost")).alias("at"), F.col("s.c").alias("c")).alias("s"))
        state = sent.groupBy("v").agg(F.min("s").alias("s"))
    labels = materialise(state.select("v", F.col("s.c").alias("c")), "labels")
    step = lookup_join(edges.withColumnRenamed("x", "v"), "v", labels, heavy).select(F.col("c").alias("x"), F.col("y").alias("v"))
    step = lookup_join(step, "v", labels, heavy).select(F.least("x", "c").alias("x"), F.greatest("x", "c").alias("y"))
    return labels, materialise(step.where("x <> y").distinct(), "edges")


def decomposed(x: np.ndarray, y: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, centre of each) after all levels of the decomposition of the edges x-y."""
    names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = ends[: len(x)], ends[len(x) :]
    whole = np.arange(len(names))
    rng = np.random.default_rng(seed)
    while len(u):
        centre, at = np.arange(len(names)), -rng.exponential(1 / rate, len(names))
        while True:
            # who is reached earlier than by its own centre takes over the centre of the neighbour that reaches it first
            to, source = np.concatenate([u, v]), np.concatenate([v, u])
            arrival = at[source] + 1.0
            order = np.lexsort((centre[source], arrival, to))
            first = order[np.r_[True, to[order][1:] != to[order][:-1]]]
            better = first[arrival[first] < at[to[first]]]
            if not len(better):
                break
            at[to[better]], centre[to[better]] = arrival[better], centre[source[better]]
        whole = centre[whole]
        u, v = centre[u], centre[v]
        links = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)])[:, u != v], axis=1)
        u, v = links[0], links[1]
    return names, names[whole]


def _in_memory(edges: DataFrame, level: int, rate: float) -> DataFrame:
    """The (v, c) assignment of all further levels, by one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v, c = decomposed(rows["x"].to_numpy(), rows["y"].to_numpy(), rate, level)
        return pd.DataFrame({"v": v, "c": c})

    return materialise(edges.groupBy(F.lit(0).alias("all")).applyInPandas(run, "v long, c long"), "labels")
