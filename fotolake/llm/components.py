"""Connected components by random-order contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import pointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (a long, b long); root is the same for all nodes of a component.

    Each round names every node after the neighbour (or itself) that comes first in a hashed order, renames the ends of
    the edges and drops loops and repeats. The hashed order makes the expected number of rounds logarithmic, on long
    paths as well. Minima are pre-aggregated before the shuffle, and the renaming joins have one unique side, so a node
    with many edges is no hot task. Null ends are dropped; an empty input gives an empty result. It raises if
    `max_rounds` do not suffice, which would be a fault and never cuts the result short.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = pointed(edges.distinct())
    names: DataFrame | None = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("n"))
        first = pointed(first.select(F.col("a").alias("node"), F.least(own, F.col("m"))["n"].alias("root")))
        if names is None:
            names = first
        else:
            step = first.select(F.col("node").alias("root"), F.col("root").alias("next"))
            names = pointed(names.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left, right = first.select(F.col("node").alias("a"), F.col("root").alias("ra")), first.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = pointed(edges.where("a <> b").distinct())
    else:
        raise RuntimeError("components: rounds exhausted")
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return names
