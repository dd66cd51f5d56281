"""Source divergence: how far each source's words are from the other sources of its language and from the language itself.

Terms are runs of letters (A to Z in either case, lower-cased, and everything beyond ASCII). A language keeps the V terms that are
in at least `least_docs` of its documents. A group, one (lang, source), and the language as a whole give a kept term
p = 1 + floor(1e9 (count + 2) / (N + 2 V)), N being their occurrences of kept terms; two such numbers differ by
f = floor((p - q)^2 / (p + q)). All of it is whole numbers, without rounding.

- `pair` sums f over all kept terms for each two sources of a language. Most terms are in one of the two or in neither, so the sum
  starts from p at count 0 on both sides, adds what each source's *count buckets* (how many terms it has so many times) change
  against the other's p at count 0, and corrects that for the terms that both have, which their postings give in blocks of
  whole terms.
- `term` ranks the terms that a group uses more than its language, by f, to rank `ranks`. It is a search by upper bounds: all
  terms of a count bucket share p, and f falls as the language's q rises to p, so the bucket's rarest term in the language
  bounds f. Buckets are evaluated best bound first, in slices, until no bound left reaches the group's last rank; ties with it
  are evaluated, so the order among equal values is exact.

Documents are read twice: for document frequencies, then for counts by source of the terms kept, which meet a broadcast of kept
terms (at most BROADCAST_TERMS terms and BROADCAST_BYTES bytes, counted first) or else a shuffle by term. Nothing is collected.

Nulls and ties: null text, lang and source are empty texts, which are languages and sources of their own. Repeated rows are
documents each. Groups without terms take part in pairs; a language without kept terms has pairs of value 0 and no terms. Equal
values are ranked by item, by its UTF-8 bytes. Very long texts are read in pieces; columns other than the three named are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.llm.common import col, written

#: What separates terms becomes a space, A to Z lower case.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 20
#: At most so many kept terms, and bytes of them, are broadcast.
BROADCAST_TERMS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Distinct terms that a task holds before it hands their counts on, postings of a block of terms, pairs of postings at a time.
HELD, BLOCK, PAIRS = 300_000, 200_000, 1_000_000
#: Terms that the first slice of the search evaluates for each group; each later slice reaches so many times as far.
FIRST_REACH, FURTHER = 64, 8


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a list for each piece of it."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def _count(batches: Iterable[pa.RecordBatch], by_doc: bool) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n): occurrences, or, `by_doc`, documents that hold the term (source empty)."""
    held: dict[tuple[str, str], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), into in held.items():
            keys, counts = pa.array(list(into), pa.binary()).cast(pa.string()), pa.array(list(into.values()), pa.int64())
            for at in range(0, len(keys), 50_000):
                part = keys.slice(at, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), part, counts.slice(at, 50_000)], ["lang", "source", "term", "n"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            into = held.setdefault((lang.as_py(), "" if by_doc else source.as_py()), Counter())
            before = len(into)
            if by_doc:
                into.update(set().union(*terms(text.as_py())))
            else:
                for some in terms(text.as_py()):
                    into.update(some)
            size += len(into) - before
            if size >= HELD:
                yield from rows()
                size = 0
    yield from rows()


def _counted(docs: DataFrame, by_doc: bool) -> DataFrame:
    return docs.mapInArrow(functools.partial(_count, by_doc=by_doc), "lang string, source string, term string, n long")


def kept_terms(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, term) of the terms in at least `least_docs` documents of their language."""
    return _counted(docs, True).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term")


def _broadcast_if_small(df: DataFrame, size: Column) -> DataFrame:
    """A written table, as a broadcast if it is within the bounds."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_TERMS and total <= BROADCAST_BYTES else df


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count among n occurrences of v kept terms, exact at any size."""
    big = F.lit(1_000_000_000).cast("decimal(12,0)") * (count + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", big, (n + 2 * v).cast("decimal(22,0)"))


def apart(p: Column, q: Column) -> Column:
    """f of two numbers p and q."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _both(key: tuple[pa.Scalar, ...], batch: pa.Table) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value): for sources a < b, what the terms of this block that both have add to the sum without them."""
    at = batch.select(["source", "term"]).combine_chunks()
    sources, g = np.unique(np.array(at["source"].to_pylist(), object), return_inverse=True)
    t = at["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    p, zero = batch["p"].to_numpy(), batch["zero"].to_numpy()
    order = np.lexsort((g, t))
    g, t, p, zero = g[order], t[order], p[order], zero[order]
    ends = np.searchsorted(t, t, side="right")  # the rows after a row, up to here, are its term's later sources
    more = ends - np.arange(len(t)) - 1
    reach, width, total = np.cumsum(more), len(sources), {}

    def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x - y) ** 2 // (x + y)

    start = 0
    while start < len(t):
        stop = max(start + 1, int(np.searchsorted(reach, (reach[start - 1] if start else 0) + PAIRS, side="right")))
        left = np.repeat(np.arange(start, stop), more[start:stop])
        right = np.arange(len(left)) - np.repeat(np.cumsum(more[start:stop]) - more[start:stop], more[start:stop]) + left + 1
        values = f(p[left], p[right]) - f(p[left], zero[right]) - f(zero[left], p[right]) + f(zero[left], zero[right])
        pairs, where = np.unique(g[left] * width + g[right], return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, where, values)
        for k, x in zip(pairs.tolist(), sums.tolist(), strict=True):
            total[k] = total.get(k, 0) + x
        start = stop
    names, pairs = sources.tolist(), list(total)
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(part), pa.string()), pa.array([names[k // width] for k in part], pa.string()), pa.array([names[k % width] for k in part], pa.string()), pa.array([total[k] for k in part], pa.int64())], ["lang", "a", "b", "value"])


def _both_table(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_both(key, batch)), pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]))


def source_pairs(groups: DataFrame, postings: DataFrame, buckets: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each source and each other source of its language.

    `groups` (lang, source, v, zero), `postings` (lang, source, term, p, zero) and `buckets` (lang, source, p, zero, terms).
    """
    blocks = max(1, -(-postings.count() // BLOCK))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks))
    both = postings.select("lang", "source", "term", "p", "zero", block.alias("block")).groupBy("lang", "block").applyInArrow(_both_table, "lang string, a string, b string, value long")
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), "v")
    a, b = F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")
    alone = buckets.join(other, "lang").where("source <> other").select("lang", a, b, (F.col("terms") * (apart(F.col("p"), F.col("other_zero")) - apart(F.col("zero"), F.col("other_zero")))).alias("value"))
    neither = groups.drop("v").join(other, "lang").where("source < other").select("lang", a, b, F.when(F.col("v") > 0, F.col("v") * apart(F.col("zero"), F.col("other_zero"))).otherwise(0).cast("long").alias("value"))
    sums = both.unionByName(alone).unionByName(neither).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", "value", sides.alias("s")).select("lang", "s.source", "s.item", "value")


def telling_terms(postings: DataFrame, buckets: DataFrame, ranks: int = 10) -> DataFrame:
    """(lang, source, item, value) of the terms that a group uses more than its language, to rank `ranks` by f.

    `postings` (lang, source, term, count, p, q) and `buckets` (lang, source, count, terms, p, least_q); see the module for the search.
    """
    group = Window.partitionBy("lang", "source")
    best_first = group.orderBy(F.desc("bound"), "count")
    left = buckets.where("p > least_q").withColumn("bound", apart(F.col("p"), F.col("least_q")))
    left = left.select("lang", "source", "count", "bound", (F.sum("terms").over(best_first) - F.col("terms")).alias("before"))
    left, best, reached, reach = written(left, "bounds"), None, 0, FIRST_REACH
    while True:
        slice_ = left.where((F.col("before") >= reached) & (F.col("before") < reach)).drop("bound", "before")
        found = postings.join(slice_, ["lang", "source", "count"], "left_semi").where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        found = found if best is None else found.unionByName(best)
        place = F.row_number().over(group.orderBy(F.desc("value"), "item"))
        best = written(found.withColumn("place", place).where(F.col("place") <= ranks).drop("place"), "best")
        last = best.groupBy("lang", "source").agg(F.count("*").alias("found"), F.min("value").alias("least")).where(F.col("found") >= ranks).select("lang", "source", "least")
        left = left.where(F.col("before") >= reach).join(last, ["lang", "source"], "left").where("least is null or bound >= least").drop("least")
        left, reached, reach = written(left, "bounds"), reach, reach * FURTHER
        if left.isEmpty():
            return best


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` and `term` of each (lang, source) group."""
    empty = lambda name: F.coalesce(col(name).cast("string"), F.lit(""))
    docs = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    kept = written(kept_terms(docs, least_docs), "terms")
    counts = _counted(docs, False).join(_broadcast_if_small(kept, F.octet_length("term") + F.octet_length("lang")), ["lang", "term"])
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("count"))
    counts = written(counts.withColumn("all", F.sum("count").over(Window.partitionBy("lang", "term"))), "postings")
    whole = counts.groupBy("lang").agg(F.sum("count").alias("lang_n")).join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "full")
    own = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n")))
    groups = written(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(1)), "groups")
    sized = _broadcast_if_small(groups, F.octet_length("source") + F.octet_length("lang"))
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("all"), F.col("lang_n"), F.col("v"))
    postings = counts.join(sized, ["lang", "source"]).select("lang", "source", "term", "count", p.alias("p"), q.alias("q"), "zero")
    buckets = written(postings.groupBy("lang", "source", "count", "p", "zero").agg(F.count("*").alias("terms"), F.min("q").alias("least_q")), "buckets")
    pairs = source_pairs(sized.select("lang", "source", "v", "zero"), postings, buckets).withColumn("part", F.lit("pair"))
    best = telling_terms(postings, buckets, ranks).withColumn("part", F.lit("term"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), place.cast("int").alias("rank"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN l USING (lang, term) GROUP BY ALL),
lv AS (SELECT lang, count(*) AS v, sum(total) AS n FROM l GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lv.n, 0) AS ln, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN lv USING (lang)),
p AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v) AS BIGINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (total + 2)) // (ln + 2 * v) AS BIGINT) AS q
  FROM g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM best),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
