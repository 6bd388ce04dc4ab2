"""Connected components of links, in a task (numpy) and on Spark (contraction)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import scratch, stored


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of i and j in place; a group's parent is its smallest member."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def forest(parent: np.ndarray) -> np.ndarray:
    """Members that are not their group's parent."""
    return np.flatnonzero(parent != np.arange(len(parent)))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (u, v): label is the smallest node of its component.

    Each round points every node at the smallest node within two steps of least
    neighbours and replaces the ends of the links by what they point at; links
    inside one node vanish. At least every second linked node goes in a round.
    Sums and minima are combined before the shuffle, and joins on a node of many
    links can be split, so a large component needs no large task.
    """
    with scratch(links.sparkSession):
        rest = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        total = None
        while not rest.isEmpty():
            both = rest.union(rest.select("v", "u"))
            up = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("up"))
            up = stored(up)
            far = up.alias("x").join(up.select(F.col("node").alias("mid"), F.col("up").alias("top")), F.col("up") == F.col("mid"), "left").select(
                "node", F.coalesce("top", "up").alias("up"))
            far = stored(far)
            total = far if total is None else total.join(far.select(F.col("node").alias("was"), F.col("up").alias("top")), F.col("up") == F.col("was"), "left").select(
                "node", F.coalesce("top", "up").alias("up"))
            a = far.select(F.col("node").alias("u"), F.col("up").alias("a"))
            b = far.select(F.col("node").alias("v"), F.col("up").alias("b"))
            moved = rest.join(a, "u").join(b, "v").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            rest = stored(moved.distinct())
        if total is None:
            total = rest.select(F.col("u").alias("node"), F.col("v").alias("up"))
        return stored(total.withColumnRenamed("up", "label"), result=True)
