"""The prefix trie of conversations: which turns conversations share from their start on, and what a cache of them would save.

A conversation is rebuilt first: up to h = crc32(id) % 6 turns of the conversation that opens its hundred, then its own turns after
its first h. A node of the trie is a distinct sequence of first turns; it belongs to the smallest conversation that starts with it.
What a conversation owns is therefore a chain: from some first depth on, all of its prefixes to its end, or nothing.

1. Each prefix gets a digest of 128 bits: two sums, over its turns, of hashes of the depth, role and text. Sums grow along a
   conversation by running sums, so no text is joined to another; a prefix's smallest conversation is a minimum by digest.
2. All conversations search their first owned depth at once, by halving: a round joins one depth of each to the minima.
   The rounds are as many as the longest conversation has binary digits.
3. The chain hangs at the owner of the prefix before it. Totals of subtrees of chains (conversations, leaves, saved tokens) are
   summed up from the bottom, by ancestors twice as far away in each round, and running sums from a chain's end give its nodes'.

Running sums sort by range and carry sums over from one range to the next (one number a range), so a conversation with any share of
all turns is many tasks. Ids of the conversations that end at a node are joined by ranges of 65,536 ids first; the final
hash, which reads them in order by its nature, takes these pieces as a stream.

Nulls and ties: null roles and texts are empty; rows with a null conv_id are no conversation. Turns with the same number (null
first) are ordered by role, then by the SHA-256 of their text, so repeated rows are turns each. Very long texts are hashed once and
not shuffled. Other columns are not read; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import col, written

#: Conversations take their first turns from the one that opens their run of so many ids, and fewer turns than MOST.
BLOCK, MOST = 100, 6
#: Ids in a range of those that are joined before they are hashed.
IDS = 1 << 16


def running(df: DataFrame, key: str, order: Column, sums: list[str]) -> DataFrame:
    """`df` with the columns `sums` replaced by their running sums within `key`, in `order`, which is unique there or among equal rows.

    Ranges of the sorted rows are summed each, and what a key had in earlier ranges is added; only a range's first key can have any,
    so the rows to carry are fewer than the ranges.
    """
    ranged = written(df.repartitionByRange(key, order).withColumn("__range", F.spark_partition_id()), "ranged")
    here = Window.partitionBy(key, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy(key, "__range").agg(*(F.sum(s).alias(s) for s in sums), F.lit(1).alias("__one"))
    carry = carry.select(key, "__range", *(F.sum(s).over(before).alias(f"__{s}") for s in sums), F.sum("__one").over(before).alias("__past")).where("__past is not null").drop("__past")
    own = ranged.withColumns({s: F.sum(s).over(here) for s in sums}).join(F.broadcast(carry), [key, "__range"], "left")
    return own.withColumns({s: F.col(s) + F.coalesce(F.col(f"__{s}"), F.lit(0)) for s in sums}).drop("__range", *(f"__{s}" for s in sums))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place from 1, role, sha, chars) of each turn."""
    empty = lambda name: F.coalesce(col(name).cast("string"), F.lit(""))
    rows = conversations.select(col(conv_col).cast("long").alias("conv_id"), col(turn_col).alias("turn"), empty(role_col).alias("role"), F.unhex(F.sha2(empty(text_col), 256)).alias("sha"), F.char_length(empty(text_col)).cast("long").alias("chars"))
    rows = rows.where("conv_id is not null").select("conv_id", F.struct("turn", "role", "sha").alias("at"), "chars", F.lit(1).cast("long").alias("place"))
    return running(rows, "conv_id", F.asc_nulls_first("at"), ["place"]).select("conv_id", "place", "at.role", "at.sha", "chars")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, role, sha, chars) of each rebuilt turn, and (conv_id, turns) of each conversation."""
    lengths = rows.groupBy("conv_id").agg(F.max("place").alias("own"))
    lent = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).alias("lent")
    opener = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("opener")
    convs = lengths.select("conv_id", "own", lent, opener)
    openers = lengths.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("opener"), F.col("own").alias("has"))
    convs = written(convs.join(openers, "opener", "left").withColumn("taken", F.least("lent", F.coalesce("has", F.lit(0)))).drop("has"), "conversations")
    heads = rows.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < MOST)).withColumnRenamed("conv_id", "opener")
    first = convs.join(heads, "opener").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "role", "sha", "chars")
    own = rows.join(convs, "conv_id").where("place > lent").select("conv_id", (F.col("place") - F.col("lent") + F.col("taken")).alias("depth"), "role", "sha", "chars")
    return first.unionByName(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("lent"), F.lit(0))).alias("turns"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, a, b): the digest (a, b) of the first `depth` turns."""
    lane = lambda seed: F.xxhash64(F.lit(seed), "depth", "role", "sha").cast("decimal(20,0)")
    rows = rows.select("conv_id", "depth", "chars", lane(1).alias("a"), lane(2).alias("b"))
    return written(running(rows, "conv_id", F.col("depth"), ["a", "b"]), "prefixes")


def chains(convs: DataFrame, known: DataFrame, root: int) -> DataFrame:
    """(conv_id, turns, first, at, parent): the first depth that a conversation owns (turns + 1: none), and where its chain hangs.

    `convs` (conv_id, turns), `known` the prefixes, `root` the smallest conversation, which owns all of its prefixes.
    """
    minima = written(known.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner")), "minima").withColumnRenamed("depth", "mid")
    state = convs.select("conv_id", "turns", F.lit(0).cast("long").alias("at"), (F.col("turns") + 1).alias("first"), F.lit(root).cast("long").alias("parent"))
    done, state = state.where(F.col("conv_id") == root), state.where(F.col("conv_id") != root)
    done = done.select("conv_id", "turns", F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("parent"))
    state = written(state, "search")
    while not state.where("first - at > 1").isEmpty():
        probe = state.where("first - at > 1").withColumn("mid", F.expr("(at + first) div 2"))
        probe = probe.join(known.select("conv_id", F.col("depth").alias("mid"), "a", "b"), ["conv_id", "mid"]).join(minima, ["mid", "a", "b"])
        own = F.col("owner") == F.col("conv_id")
        probe = probe.select("conv_id", "turns", F.when(own, F.col("at")).otherwise(F.col("mid")).alias("at"), F.when(own, F.col("mid")).otherwise(F.col("first")).alias("first"), F.when(own, F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        state = written(state.where("first - at <= 1").unionByName(probe), "search")
    return written(state.unionByName(done), "chains")


def subtotals(links: DataFrame, sums: list[str]) -> DataFrame:
    """(conv_id, *sums): each column summed over a chain and all chains below it; `links` (conv_id, parent, *sums).

    After k rounds a row has the sums of what is nearer than 2^k below it, and its ancestor 2^k above it.
    """
    state = written(links.select("conv_id", F.col("parent").alias("up"), *sums), "totals")
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(s).alias(f"__{s}") for s in sums))
        above = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        state = state.join(below, "conv_id", "left").join(above, "up", "left")
        state = written(state.select("conv_id", F.col("next").alias("up"), *((F.col(s) + F.coalesce(F.col(f"__{s}"), F.lit(0))).alias(s) for s in sums)), "totals")
    return state.drop("up")


def _hash(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, ends_sha256) of rows (conv_id, depth, ids) that are sorted by node and, within it, by range of ids."""
    node, digest, done = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(i) for i in range(3)), strict=True):
            here, ids = (conv.as_py(), depth.as_py()), ids.as_py().encode()
            if here == node:
                digest.update(b"," + ids)
                continue
            if node is not None:
                done.append((*node, digest.hexdigest()))
            node, digest = here, hashlib.sha256(ids)
        yield rows()
        done.clear()
    if node is not None:
        done.append((*node, digest.hexdigest()))
        yield rows()


def ends(found: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of each node at which conversations end."""
    owns = F.col("first") <= F.col("turns")
    last = found.select(F.when(owns, F.col("conv_id")).otherwise(F.col("parent")).alias("node"), F.col("turns").alias("depth"), "conv_id", F.floor(F.col("conv_id") / IDS).alias("range"))
    parts = last.groupBy("node", "depth", "range").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    parts = parts.repartition("node", "depth").sortWithinPartitions("node", "depth", "range").select("node", "depth", "ids")
    return parts.mapInArrow(_hash, "conv_id long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    saved_tokens sums, over a node's subtree, the code points of each node's last text times its conversations less one.
    """
    rows, convs = rebuilt(written(turns(conversations, **columns), "turns"))
    known, convs = prefixes(rows), written(convs, "lengths")
    root = convs.agg(F.min("conv_id")).first()[0]
    zero = F.lit(0).cast("long")
    found = chains(convs, known, root if root is not None else 0)
    owning = found.where("first <= turns")
    below = owning.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("chains"))
    below = written(below, "below")
    leaf = owning.join(below.withColumnRenamed("depth", "turns"), ["conv_id", "turns"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    each = found.join(leaf, "conv_id", "left").select("conv_id", "parent", "at", F.coalesce("leaf", zero).alias("leaves"), F.lit(1).cast("long").alias("convs"))
    each = written(each, "each")
    nodes = known.select("conv_id", "depth", "chars").unionByName(found.where("first = 0").select("conv_id", zero.alias("depth"), zero.alias("chars")))
    nodes = nodes.join(owning.select("conv_id", "first", "turns", "parent"), "conv_id").where("depth >= first")

    def hung(totals: DataFrame, sums: list[str]) -> DataFrame:
        """Sums of the chains that hang at a node."""
        return totals.join(found.where("parent is not null").select("conv_id", "parent", "at"), "conv_id").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(*(F.sum(s).alias(s) for s in sums))

    totals = hung(subtotals(each, ["convs", "leaves"]), ["convs", "leaves"])
    nodes = nodes.join(totals, ["conv_id", "depth"], "left").fillna(0, ["convs", "leaves"])
    nodes = running(nodes, "conv_id", F.desc("depth"), ["convs", "leaves"]).join(each.select("conv_id", F.col("leaves").alias("leaf")), "conv_id")
    nodes = nodes.withColumns({"n_convs": F.col("convs") + 1, "n_leaves": F.col("leaves") + F.col("leaf"), "saved": F.col("convs") * F.col("chars")}).drop("convs", "leaves", "leaf")
    nodes = written(nodes, "nodes")
    own = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"))
    own = each.select("conv_id", "parent").join(own, "conv_id", "left").fillna(0, ["saved"])
    more = hung(subtotals(own, ["saved"]), ["saved"]).withColumnRenamed("saved", "more")
    nodes = nodes.join(more, ["conv_id", "depth"], "left").withColumn("saved", F.col("saved") + F.coalesce("more", zero)).drop("more")
    nodes = running(nodes, "conv_id", F.desc("depth"), ["saved"]).join(below, ["conv_id", "depth"], "left").join(ends(found), ["conv_id", "depth"], "left")
    above = F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("parent"))
    children = F.coalesce("chains", zero) + F.when(F.col("depth") < F.col("turns"), 1).otherwise(0)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select("conv_id", "depth", above.alias("parent_conv_id"), "n_convs", children.cast("long").alias("n_children"), "n_leaves", F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


ORACLE = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS UBIGINT))),
    lambda v, b: list_reduce(list_prepend(xor(v, b), CAST(range(8) AS UBIGINT[])), lambda u, i: xor(u >> 1, (u & 1) * CAST(3988292384 AS UBIGINT)))), CAST(4294967295 AS UBIGINT)) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
turned AS (SELECT i.c, 0 AS part, k, r, x FROM ids i JOIN t ON t.c = i.base AND k <= h UNION ALL SELECT i.c, 1, k, r, x FROM ids i JOIN t ON t.c = i.c AND k > h),
d AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d, r, x FROM turned),
pre AS (SELECT c, d, length(x) AS chars, list({'r': r, 'x': x}) OVER (PARTITION BY c ORDER BY d) AS seq FROM d UNION ALL SELECT c, 0, 0, [] FROM ids),
m AS (SELECT c, d, chars, min(c) OVER (PARTITION BY d, seq) AS o, count(*) OVER (PARTITION BY d, seq) AS n FROM pre),
node AS (SELECT c, d, n, chars, (SELECT o FROM m p WHERE p.c = m.c AND p.d = m.d - 1) AS up FROM m WHERE c = o),
kids AS (SELECT up AS c, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.c = node.c AND kids.d = node.d),
below AS (SELECT m.o AS c, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n - 1) * f.chars) AS saved FROM full_node f JOIN m ON m.c = f.c AND m.d <= f.d GROUP BY ALL),
ends AS (SELECT o AS c, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC) AS z FROM m) WHERE z = 1 GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, up AS parent_conv_id, n AS n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM full_node f JOIN below b ON b.c = f.c AND b.d = f.d LEFT JOIN ends e ON e.c = f.c AND e.d = f.d
"""
