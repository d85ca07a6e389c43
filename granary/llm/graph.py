"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links a, b (long) that isn't itself the smallest node of its component.

    Each round links the neighbours of every node to the smallest of them, first the larger ones, then the smaller ones,
    until nothing changes. A node's minimum is pre-aggregated before its shuffle; the joins can be split where a node has
    very many links. Links of a node to itself and with null ends count for nothing; an empty table gives no rows.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links, "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = links.union(links.select("b", "a"))
        lows = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(lows, "a").where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        links = materialize(small.union(lows.select("a", F.col("low").alias("b"))).distinct(), "links")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n nodes over the links a-b."""
    low = np.arange(n)
    while len(a):
        least = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(before, low):
            break
    return low
