"""Embedding near-duplicates: collisions counted in windows of sorted projections, then exact cosines.

Vectors are compared only where labels are equal and not null. Equal vectors are one node with a multiplicity. Each node is
projected on Gaussian directions of a fixed seed; two unit vectors whose chord is d differ there by a normal variable of
deviation d. The first two directions cut a label into slabs wide enough that a pair at the threshold lies in the same or
adjacent slabs but for a stated share; slab cells are cut by hash into blocks of at most BLOCK nodes, and each pair of
blocks of adjacent cells is a task. A task sorts one block by each direction, takes around each vector of the other block a
window of fixed half-width, counts for each pair the windows it falls in, and verifies by cosine in double precision the
pairs whose count reaches a threshold set from the binomial law for the wanted recall. After the first DENSE directions only
pairs that can still reach it are counted further. It returns sums of links and a
spanning forest, never the pairs themselves.

Nulls and ties: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
with nothing and are their own component. Vectors of different lengths do not link. Ids may repeat; a null id takes part, and
a component is named by its smallest non-null id; rows that repeat an id are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import col, written
from fotolake.llm.components import components
from fotolake.llm.simhash import Forest

SEED, BLOCK = 20_240, 2048
#: Directions, and the windows' half-width and the slabs' width as multiples of the chord at the threshold.
DIRECTIONS, HALF_WIDTH, SLAB = 32, 1.5, 2.5
#: Directions counted for all pairs of a task, before only those that can still reach the threshold are.
DENSE = 14
#: At most so many slab cells, of about 150 bytes, are broadcast; more are joined by shuffle, each to SALT parts of its vectors.
BROADCAST_CELLS, SALT = 200_000, 16


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((DIRECTIONS, dim))


def chord(cosine: float) -> float:
    return math.sqrt(max(2 - 2 * cosine, 1e-6))


def threshold(recall: float) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall` at least."""
    p = math.erf(HALF_WIDTH / math.sqrt(2))
    sure, count = 0.0, DIRECTIONS
    while count >= 0:
        sure += math.comb(DIRECTIONS, count) * p**count * (1 - p) ** (DIRECTIONS - count)
        if sure >= recall:
            return count
        count -= 1
    return 0


def collisions(a: np.ndarray, b: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of projections with b's row in the window around a's row in `least` directions or more."""
    n, d = a.shape
    low, size, rank = np.empty((d, n), np.uint16), np.empty((d, n), np.uint16), np.empty((d, len(b)), np.uint16)
    for j in range(d):
        order = np.argsort(b[:, j])
        line = b[order, j]
        low[j] = np.searchsorted(line, a[:, j] - half, "left")
        size[j] = np.searchsorted(line, a[:, j] + half, "right") - low[j]
        rank[j, order] = np.arange(len(b), dtype=np.uint16)
    counts = np.zeros((n, len(b)), np.uint8)
    for j in range(min(DENSE, d)):
        counts += (rank[j][None, :] - low[j][:, None]) < size[j][:, None]
    u, v = np.divmod(np.flatnonzero(counts >= max(0, least - max(0, d - DENSE))), len(b))
    count = counts[u, v]
    for j in range(DENSE, d):
        count += (rank[j][v] - low[j][u]) < size[j][u]
        able = count >= max(0, least - (d - 1 - j))
        u, v, count = u[able], v[able], count[able]
    return u, v


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _compare(pdf: pd.DataFrame, cosine: float, least: int) -> pd.DataFrame:
    pdf = pdf.sort_values("node", kind="stable")
    unit, node, n = _unit(pdf["vec"]), pdf["node"].to_numpy(), pdf["n"].to_numpy()
    same = bool((pdf["ka"] == pdf["kb"]).iat[0])
    left = np.arange(len(pdf)) if same else np.flatnonzero((pdf["block"] == pdf["ka"]).to_numpy())
    right = left if same else np.flatnonzero((pdf["block"] != pdf["ka"]).to_numpy())
    links, forest = np.zeros(len(pdf), np.int64), Forest(len(pdf))
    if len(left) and len(right):
        line = unit @ directions(unit.shape[1]).T
        half = HALF_WIDTH * chord(cosine)
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            u, v = collisions(line[rows], line[right], half, least)
            u, v = rows[u], right[v]
            if same:
                u, v = u[u < v], v[u < v]
            for part in range(0, len(u), 100_000):
                x, y = u[part : part + 100_000], v[part : part + 100_000]
                close = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                x, y = x[close], y[close]
                np.add.at(links, x, n[y])
                np.add.at(links, y, n[x])
                forest.join(x, y)
    some, apart = np.flatnonzero(links), np.flatnonzero(forest.root != np.arange(len(pdf)))
    rows = [(node[some], np.full(len(some), -1), links[some]), (node[apart], node[forest.root[apart]], np.zeros(len(apart), np.int64))]
    return pd.DataFrame({c: np.concatenate([r[i] for r in rows]) for i, c in enumerate(("a", "b", "links"))})


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, recall: float = 0.99) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row; `recall` is that of the counts, for pairs at the threshold."""
    src = vectors.select(col(id_col).alias("id"), col(label_col).alias("label"), col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    src = src.withColumn("good", F.coalesce(good, F.lit(False)))
    valid = src.where("good").drop("good")
    nodes = written(valid.groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "vectors")

    @F.pandas_udf("array<int>")
    def slab(vec: pd.Series) -> pd.Series:
        width = SLAB * chord(cosine)
        return pd.Series([np.floor(directions_of(len(x)) @ unit / width).astype(int) for x, unit in zip(vec, map(_one, vec))], dtype=object)

    at = nodes.withColumn("slab", slab("vec")).select("*", F.col("slab")[0].alias("x"), F.col("slab")[1].alias("y"), F.size("vec").alias("dim")).drop("slab")
    at = written(at, "slabs")
    cell = ["label", "dim", "x", "y"]
    sizes = at.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    around = sizes.withColumn("s", steps).select("label", "dim", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), F.struct((-F.col("s.dx")).alias("dx"), (-F.col("s.dy")).alias("dy"), "k").alias("near"))
    around = around.groupBy(*cell).agg(F.collect_list("near").alias("near"))  # at most nine
    name = lambda x, y, k: F.struct(x.alias("x"), y.alias("y"), k.alias("k"))
    cells = written(sizes.join(around, cell), "cells")
    if cells.count() <= BROADCAST_CELLS:
        own = at.join(F.broadcast(cells), cell)
    else:  # a dense cell is dealt over SALT tasks
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
        own = at.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(cells.select("*", parts), [*cell, "salt"])
    own = own.withColumn("block", name(F.col("x"), F.col("y"), F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))
    out = own.select("label", "dim", "node", "n", "vec", "block", "x", "y", F.explode("near").alias("near"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.col("near.k") - 1)).alias("j"))
    out = out.withColumn("to", name(F.col("x") + F.col("near.dx"), F.col("y") + F.col("near.dy"), F.col("j")))
    text = lambda c: F.concat_ws(":", F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"{c}.k"))
    out = out.select("label", "dim", "node", "n", "vec", text("block").alias("block"), text("to").alias("to"))
    out = out.select("label", "dim", "node", "n", "vec", "block", F.least("block", "to").alias("ka"), F.greatest("block", "to").alias("kb"))
    found = written(out.groupBy("label", "dim", "ka", "kb").applyInPandas(functools.partial(_compare, cosine=cosine, least=threshold(recall)), "a long, b long, links long"), "vector-links")
    links = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.join(links, "node", "left").join(components(found.where("b >= 0").select("a", "b")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "vector-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    rows = valid.join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    rows = rows.unionByName(src.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return rows.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _one(x) -> np.ndarray:
    v = np.asarray(x, np.float64)
    v = v / np.abs(v).max()
    return v / np.linalg.norm(v)


@functools.cache
def directions_of(dim: int) -> np.ndarray:
    """The two directions that cut slabs."""
    return directions(dim)[:2]
