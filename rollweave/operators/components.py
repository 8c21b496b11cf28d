"""Connected components of a graph held in a table, by hooking to the least neighbour and pointer jumping.

A small graph, of at most ``LOCAL_EDGES`` distinct edges, takes the same steps on arrays within one task, which saves the rounds over
the cluster; its size is checked first, and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.session import drop, store

#: Most distinct edges that one task holds, some 16 MB of numbers.
LOCAL_EDGES = 1_000_000


def connected(edges: DataFrame, a: str, b: str, most_rounds: int = 40, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of the edges. Loops and repeated edges change nothing; nulls don't count.

    A hub is no hot spot: each round reduces the neighbours of a node to their minimum before the shuffle. The joins are merges even where
    a side is small: rounds are many, and every broadcast would stay with the driver for a while.
    """
    e = store(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y")).distinct())
    if e.count() <= local_edges:
        return _within_a_task(e)
    both = store(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), e)
    label = store(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("c")))
    for _ in range(most_rounds):
        # least label around each node, then the label of that label
        near = both.join(label.select(F.col("node").alias("y"), "c").hint("merge"), "y").groupBy("x").agg(F.min("c").alias("m"))
        low = label.join(near.hint("merge"), label["node"] == near["x"]).select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = label.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        label = store(low.join(up.hint("merge"), "c", "left").select("node", "old", F.least("c", F.coalesce("cc", "c")).alias("c")), label)
        if not label.filter(F.col("c") != F.col("old")).limit(1).count():
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    drop(both)
    return label.select("node", F.col("c").alias("component"))


def _within_a_task(e: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        every = pd.concat(parts, ignore_index=True)
        nodes, at = np.unique(np.concatenate([every["x"].to_numpy(), every["y"].to_numpy()]), return_inverse=True)
        a, b = at[: len(every)], at[len(every) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pd.DataFrame({"node": nodes, "component": nodes[label]})

    kind = dict(e.dtypes)["x"]
    return e.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")
