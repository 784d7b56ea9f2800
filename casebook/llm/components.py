"""Connected components of links.

Every partition first keeps no more links than its nodes need.  While all of them together are
few (``ONE_TASK`` links, a bounded size that is checked), one task finishes; beyond that, large-star and
small-star steps on DataFrames do, each a shuffle by node.  There the smallest neighbour of a
node is an aggregation that Spark pre-aggregates; it is stored and joined back, so that Spark can
split the rows of a node with very many links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

ONE_TASK = 2_000_000


def forest(pairs: np.ndarray) -> np.ndarray:
    """Links of the same components, (smallest member, other member)."""
    if not len(pairs):
        return np.zeros((0, 2), np.int64)
    ids, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[root[other]], ids[other]], axis=1)


def _reduced(batches):
    kept, held, size = np.zeros((0, 2), np.int64), [], 0
    for pdf in batches:
        held.append(pdf[["a", "b"]].to_numpy(np.int64))
        size += len(pdf)
        if size > 500_000:
            kept, held, size = forest(np.concatenate([kept, *held])), [], 0
    kept = forest(np.concatenate([kept, *held]))
    yield pd.DataFrame({"a": kept[:, 0], "b": kept[:, 1]})


def components(links: DataFrame, one_task: int = ONE_TASK, reduced: bool = False, into: store.Scratch | None = None) -> DataFrame:
    """``links`` (a, b: long, no nulls) as a stored table (id, component): every node with a link, and the smallest it reaches.

    ``reduced`` says that partitions hold forests already; another worker beside the one that made them is spared.
    The table is one of ``into`` where that is given.
    """
    scratch = store.Scratch(links.sparkSession, "components")
    links = links.select("a", "b").where("a <> b")
    now = scratch.store(links if reduced else links.mapInPandas(_reduced, "a long, b long"), "links")
    size = now.count()
    if size <= one_task:
        now = scratch.store(now.coalesce(1).mapInPandas(_reduced, "a long, b long"), "forest")
        size = 0
    before = None
    while size:
        step = store.Scratch(links.sparkSession, "star")
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = step.store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = step.store(both.join(least, "a").where("b > a").select("m", "b"), "large")
        least = step.store(large.groupBy("b").agg(F.min("m").alias("s")), "least")
        small = large.join(least, "b").where("m <> s").select(F.col("s").alias("a"), F.col("m").alias("b")).union(least.select(F.col("s").alias("a"), "b"))
        now = scratch.store(small.distinct(), "stars")
        step.clear()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    out = into.store(nodes, "components") if into else store.materialize(nodes, "components")
    scratch.clear()
    return out
