"""SimHash near-duplicates: whole-text fingerprints, tiled exact comparison, connected components.

A text is lower-cased in A-Z, cut into words at ASCII white space and into shingles of `words` words, repeats included
(fewer words: the whole sequence). A shingle's hash is XXH64 of its UTF-8 bytes under seed 42; wider fingerprints take
further 64-bit words from fixed mixes of that hash. A bit is 1 if it is set in over half the hashes. Fingerprints that
differ in at most `radius` bits are linked.

Comparison is exact. Distinct fingerprints are put into blocks by population count, counts with many of them split by hash, and
each pair of blocks whose counts lie within the radius is one task, of bounded size. A task sorts both blocks by the
population counts of four segments, cuts them into tiles, skips tile pairs whose counts must differ by more than the
radius, and compares the rest by exclusive-or and bit counts. It returns a spanning forest of its links, not the links, so
that a group of thousands of copies gives thousands of rows. The number of comparisons still grows with the square of
the distinct fingerprints, as the method has it; see the README for figures.

With a `similarity`, fingerprints count each distinct shingle once, as that similarity does, and a bit set in just half the
hashes is that of their sum, so that bits of few shingles are not mostly zero. Linked fingerprints are only candidates. Sets of
a Jaccard similarity s have sizes of a ratio of s or more, so blocks and tiles go by the number of shingles in place of the
population count, and only pairs of such a ratio are compared: none that could be similar is left out. Each candidate component is
cut by hash into blocks of bounded number and size, and the texts' shingle sets are compared as incidence matrices; pairs of that
Jaccard similarity or more are the links. A component of several blocks is first compared within its blocks and with REPRESENTATIVES of its texts.
What that links needs no more comparison, so then only the texts outside the largest linked part are compared, pair of blocks by pair
of blocks, with all others: no pair of texts that are not linked yet is left out. Texts of equal fingerprints and sizes count as equal.

Nulls and ties: a null text counts as empty, and its fingerprint is zero, linked like any other. A row with a null id
takes part, but a component is named by its smallest non-null id (null if it has none). Repeated rows are all returned.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import col, parts, texts, without_keys, written
from fotolake.llm.components import components

SEED = 42
#: A block holds a 24th of the distinct fingerprints, within these bounds; two blocks of the upper one take 17 MB a word.
BLOCK_SHARE, BLOCK_LEAST, BLOCK_MOST = 24, 1024, 1 << 19
#: Where sizes bound what is compared: the share of a block, as a block meets few others, and steps of sizes within the ratio.
SIZED_SHARE, STEPS = 64, 8
TILE = 512
#: Texts and shingles of a candidate component in a block of exact comparison, on average, and columns of an incidence matrix at a time.
TEXTS, SHINGLES, COLUMNS = 512, 500_000, 8192
#: Texts of a candidate component of several blocks that all of its texts are compared with first.
REPRESENTATIVES = 8
#: At most so many candidates, of about 64 bytes, are broadcast to the texts; more are joined by shuffle.
BROADCAST_CANDIDATES = 500_000


def shingle_hashes(text: str, words: int) -> np.ndarray:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in tokens])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64-bit hash from a hash: multiply and shift, another odd multiplier for each k."""
    if not k:
        return h
    h = (h ^ (h >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str, words: int, width: int = 1, distinct: bool = False) -> list[int]:
    """`width` 64-bit words as signed integers; `distinct`: of each shingle once, ties as the hashes' sum has it."""
    h = shingle_hashes(text, words)
    return bits(np.unique(h) if distinct else h, width, distinct)


def bits(h: np.ndarray, width: int, distinct: bool) -> list[int]:
    """The fingerprint of shingle hashes."""
    if not len(h):
        return [0] * width
    out = []
    for k in range(width):
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            part = mixed(h[at : at + (1 << 16)], k)
            count += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if distinct:
            count = count * 2 + np.unpackbits(mixed(h.sum(keepdims=True), k).view(np.uint8), bitorder="little")
            out.append(int(np.packbits(count > len(h), bitorder="little").view(np.int64)[0]))
            continue
        out.append(int(np.packbits(count * 2 > len(h), bitorder="little").view(np.int64)[0]))
    return out


def _fingerprints(batches: Iterable[pa.RecordBatch], words: int, width: int, distinct: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, docs in texts(batches):
        found, sizes = [], []
        for t in docs:
            h = shingle_hashes(t, words)
            h = np.unique(h) if distinct else h
            found.append(bits(h, width, distinct))
            sizes.append(len(h))
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array([f[k] for f in found], pa.int64()) for k in range(width)), pa.array(sizes, pa.int64())], ["id", *(f"f{k}" for k in range(width)), "size"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 5, width: int = 1, distinct: bool = False) -> DataFrame:
    """(id, f0, ..., size): the fingerprint of each row, as signed 64-bit words, and its number of shingles."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *(T.StructField(f"f{k}", T.LongType()) for k in range(width)), T.StructField("size", T.LongType())])
    kind = to_arrow_type(src.schema["id"].dataType)
    return src.mapInArrow(functools.partial(_fingerprints, words=words, width=width, distinct=distinct, kind=kind), schema)


class Forest:
    """Union-find on numpy arrays; every entry points at its root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                further = root[root]
                if np.array_equal(further, root):
                    break
                root[:] = further


def _segments(f: np.ndarray) -> np.ndarray:
    """Population counts of four segments of each fingerprint: 16 bits each of one word, or a word each of four."""
    parts = f.view(np.uint16) if f.shape[1] == 1 else f
    return np.bitwise_count(parts.reshape(len(f), 4, -1)).sum(axis=2, dtype=np.int16)


def _tiles(f: np.ndarray, size: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows by segment counts, or by size and then these; the tiles' starts, and their least and largest counts, or sizes."""
    seg = _segments(f)
    order = np.lexsort(seg.T[::-1] if size is None else (*seg.T[::-1], size))
    starts = np.arange(0, len(f), TILE)
    seg = (seg if size is None else size[:, None])[order]
    return order, starts, np.minimum.reduceat(seg, starts, axis=0), np.maximum.reduceat(seg, starts, axis=0)


def linked(f: np.ndarray, g: np.ndarray | None, radius: int, size: np.ndarray | None = None, other: np.ndarray | None = None, ratio: float = 0.0) -> np.ndarray:
    """Roots of the rows of f and g (rows of uint64 words) under links between f and g, or within f if g is None.

    With `size` (and `other`, of g), only rows whose sizes have that ratio or more are linked.
    """
    same = g is None
    g, other = (f, size) if same else (g, other)
    forest = Forest(len(f) if same else len(f) + len(g))
    fo, fs, flo, fhi = _tiles(f, size)
    go, gs, glo, ghi = (fo, fs, flo, fhi) if same else _tiles(g, other)
    a, b, shift = np.ascontiguousarray(f[fo].T), np.ascontiguousarray(g[go].T), 0 if same else len(f)
    m, n = (None, None) if size is None else (size[fo], other[go])
    for i, at in enumerate(fs):
        if size is None:
            near = np.flatnonzero(np.maximum(0, np.maximum(glo - fhi[i], flo[i] - ghi)).sum(axis=1) <= radius)
        else:
            near = np.flatnonzero((ghi[:, 0] >= ratio * flo[i, 0] - 1e-6) & (fhi[i, 0] >= ratio * glo[:, 0] - 1e-6))
        for j in near[near >= i] if same else near:
            x, y = a[:, at : at + TILE], b[:, gs[j] : gs[j] + TILE]
            bits = x[0, :, None] ^ y[0, None, :]
            apart = np.bitwise_count(bits).astype(np.uint16 if len(a) > 1 else np.uint8, copy=False)
            for k in range(1, len(a)):
                apart += np.bitwise_count(np.bitwise_xor(x[k, :, None], y[k, None, :], out=bits))
            u, v = np.divmod(np.flatnonzero(apart <= radius), y.shape[1])
            if same and i == j:
                u, v = u[u < v], v[u < v]
            if size is not None and len(u):
                p, q = m[at + u], n[gs[j] + v]
                alike = np.minimum(p, q) >= ratio * np.maximum(p, q) - 1e-6
                u, v = u[alike], v[alike]
            if len(u):
                forest.join(fo[at + u], go[gs[j] + v] + shift)
    return forest.root


def _compare(pdf: pd.DataFrame, width: int, radius: int, ratio: float | None = None) -> pd.DataFrame:
    f = np.ascontiguousarray(pdf[[f"f{k}" for k in range(width)]].to_numpy(np.int64)).view(np.uint64)
    node, left = pdf["node"].to_numpy(), (pdf["block"] == pdf["ka"]).to_numpy()
    size = None if ratio is None else pdf["size"].to_numpy(np.int64)
    if pdf["ka"].iat[0] == pdf["kb"].iat[0]:
        root = linked(f, None, radius, size, ratio=ratio or 0.0)
    elif left.all() or not left.any():
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    else:
        order = np.argsort(~left, kind="stable")
        f, node, n = f[order], node[order], int(left.sum())
        own, other = (None, None) if size is None else (size[order][:n], size[order][n:])
        root = linked(f[:n], f[n:], radius, own, other, ratio or 0.0)
    apart = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": node[apart], "b": node[root[apart]]})


def _shingles(batches: Iterable[pa.RecordBatch], words: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, root, k, rep, text, size, f0, ...) whose text has that size and fingerprint, with the sorted distinct hashes as bytes."""
    names = ["node", "root", "k", "rep", "hashes"]
    for batch in batches:
        for part in parts(batch, 4, rows=256):
            rows = []
            for node, root, k, rep, text, size, *f in zip(*(c.to_pylist() for c in part.columns), strict=True):
                h = np.unique(shingle_hashes(text or "", words))
                if len(h) == size and bits(h, width, distinct=True) == f:
                    rows.append((node, root, k, rep, h.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], names)


def _similar(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """A spanning forest of the pairs of similar texts, between two blocks or within one."""
    pdf = pdf.drop_duplicates("node")
    sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
    node, left = pdf["node"].to_numpy(), (pdf["b"] == pdf["lo"]).to_numpy()
    sizes = np.array([len(x) for x in sets])
    ids, column = np.unique(np.concatenate(sets), return_inverse=True) if sizes.sum() else (np.empty(0), np.empty(0, int))
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(ids), COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, len(ids) - at)), np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        both += part @ part.T
    enough = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    if (pdf["lo"] != pdf["hi"]).any():
        enough &= left[:, None] != left[None, :]
    u, v = np.nonzero(np.triu(enough, 1))
    forest = Forest(len(sets))
    forest.join(u, v)
    apart = np.flatnonzero(forest.root != np.arange(len(sets)))
    return pd.DataFrame({"a": node[apart], "b": node[forest.root[apart]]})


def _blocks(n: Column, size: Column) -> Column:
    """Blocks of so many texts with so many shingles."""
    return F.greatest(F.ceil(n / TEXTS), F.ceil(size / SHINGLES), F.lit(1)).cast("int")


def _verified(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, found: DataFrame, words: int, width: int, similarity: float) -> DataFrame:
    """Links of similar texts within candidate components (node, root), enough of them to join all that are similar."""
    f = [f"f{k}" for k in range(width)]
    found = found.join(reps, "node").where("first is not null")
    count = found.groupBy("root").agg(_blocks(F.count("*"), F.sum("size")).alias("k"))
    wanted = written(found.join(count, "root").select(F.col("first").alias("id"), "node", "root", "k", "size", *f), "simhash-candidates")
    several = wanted.where("k > 1")
    first = several.groupBy("root", F.pmod(F.xxhash64("node", F.lit("first")), F.lit(REPRESENTATIVES))).agg(F.min("node").alias("node")).select("node", F.lit(True).alias("rep"))
    wanted = written(wanted.join(first, "node", "left").withColumn("rep", F.coalesce("rep", F.lit(False))), "simhash-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_CANDIDATES else wanted
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).join(few, "id").select("node", "root", "k", "rep", "text", "size", *f)
    sets = written(rows.mapInArrow(functools.partial(_shingles, words=words, width=width), "node long, root long, k int, rep boolean, hashes binary"), "simhash-sets")
    similar = lambda pairs: pairs.select("root", "node", "hashes", "b", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi")).groupBy("root", "lo", "hi").applyInPandas(functools.partial(_similar, similarity=similarity), "a long, b long")
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    links = written(similar(sets.withColumn("b", F.explode(F.when(F.col("rep"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(own)))).withColumn("j", F.col("b"))), "simhash-links")
    if several.isEmpty():
        return links
    # Parts of components of several blocks that are linked so far, and the largest of each.
    linked_so_far = components(links.join(several.select(F.col("node").alias("a")), "a", "left_semi")).withColumnRenamed("root", "part")
    members = written(several.select("node", "root", "size").join(linked_so_far, "node", "left").withColumn("part", F.coalesce("part", "node")), "simhash-parts")
    sizes = members.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = sizes.groupBy("root").agg(F.max(F.struct("n", "part", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")).where(F.col("n") > F.col("most.n"))
    most = most.select("root", F.col("most.part").alias("largest"), _blocks(F.col("most.n"), F.col("most.size")).alias("inner"), _blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("outer"))
    # Blocks of the texts outside the largest part come first and meet all blocks; those of the part meet only them.
    inside = F.col("part") == F.col("largest")
    h = F.xxhash64("node")
    at = members.join(most, "root").select("node", F.when(inside, F.col("outer") + F.pmod(h, F.col("inner"))).otherwise(F.pmod(h, F.col("outer"))).cast("int").alias("b"), F.when(inside, F.col("outer")).otherwise(F.col("outer") + F.col("inner")).alias("to"))
    rest = sets.select("root", "node", "hashes").join(at, "node").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("to") - 1)))
    return links.unionByName(similar(rest))


def blocks(sizes: dict[int, int], bits: int, radius: int, share: int = BLOCK_SHARE) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each population count: its first block, its number of blocks, and the first and last block within the radius.

    Consecutive counts share a block until it is full; a count with more fingerprints than a block has several.
    """
    block = min(BLOCK_MOST, max(BLOCK_LEAST, sum(sizes.values()) // share))
    first, splits, ranges, fill = [0] * (bits + 1), [1] * (bits + 1), [], 0
    for p in range(bits + 1):
        n = sizes.get(p, 0)
        if not ranges or fill + n > block:
            first[p], splits[p], fill = len(ranges), max(1, -(-n // block)), n if n <= block else block
            ranges += [[p, p] for _ in range(splits[p])]
        else:
            first[p], fill = len(ranges) - 1, fill + n
            ranges[-1][1] = p
    near = [[i for i, (low, high) in enumerate(ranges) if low <= own[1] + radius and high >= own[0] - radius] for own in (ranges[first[p]] for p in range(bits + 1))]
    return first, splits, [x[0] for x in near], [x[-1] for x in near]


def near(prints: DataFrame, width: int, radius: int, verify: Callable[[DataFrame, DataFrame], DataFrame] | None = None, ratio: float | None = None) -> DataFrame:
    """(f0, ..., component_id) of each distinct fingerprint of `prints` (id, f0, ..., size); with a `ratio`, of each fingerprint and size.

    `verify`, given distinct fingerprints and candidate components (node, root), returns the links that hold. With a `ratio`, only
    fingerprints whose sizes have that ratio or more are linked, and blocks go by steps of size, STEPS of them within the ratio.
    """
    f = [f"f{k}" for k in range(width)]
    if ratio is None:
        keys, size, share, reach = f, [F.max("size").alias("size")], BLOCK_SHARE, radius
        place = functools.reduce(lambda x, y: x + y, (F.bit_count(x) for x in f))
    else:
        step = max(-math.log(ratio), 0.05) / STEPS
        keys, size, share, reach = [*f, "size"], [], SIZED_SHARE, math.ceil(-math.log(ratio) / step) + 1
        place = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / step).cast("int")
    reps = written(prints.groupBy(*keys).agg(F.min("id").alias("first"), *size).withColumn("node", F.monotonically_increasing_id()), "simhash-distinct")
    sizes = {r["p"]: r["count"] for r in reps.groupBy(place.alias("p")).count().collect()}  # at most 64 * width + 1 rows, or 44 / step
    block_of, splits, first, last = blocks(sizes, 64 * width if ratio is None else max(sizes, default=0), reach, share)
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("p"))
    at = reps.withColumn("p", place).select(*f, "size", "node", (of(block_of) + F.pmod(F.xxhash64("node"), of(splits))).cast("int").alias("block"), F.explode(F.sequence(of(first), of(last))).alias("to"))
    pairs = at.select(*f, *keys[width:], "node", "block", F.least("block", "to").alias("ka"), F.greatest("block", "to").alias("kb"))
    links = pairs.groupBy("ka", "kb").applyInPandas(functools.partial(_compare, width=width, radius=radius, ratio=ratio), "a long, b long")
    found = components(links)
    if verify is not None:
        found = components(verify(reps, found))
    named = reps.join(found, "node", "left").select(*keys, "first", F.coalesce("root", "node").alias("root"))
    named = written(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select(*keys, "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 4, width: int = 1, similarity: float | None = None) -> DataFrame:
    """(id_col, fingerprint, component_id) of each row; the fingerprint in 16 hex digits a 64-bit word.

    component_id is the smallest id that links reach. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, words, width, similarity is not None), "simhash-prints")
    f = [f"f{k}" for k in range(width)]
    verify = None if similarity is None else lambda reps, found: _verified(docs, id_col, text_col, reps, found, words, width, similarity)
    named = near(prints, width, radius, verify, similarity or None)
    digits = F.concat(*(F.lower(F.lpad(F.hex(x), 16, "0")) for x in reversed(f)))
    return prints.join(named, f if not similarity else [*f, "size"]).select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, words: int, radius: int, width: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, all columns kept: that with the smallest id, then by its text's MD5.

    Rows are told apart by id and text, so a text that shares its id with a copy is judged on its own, and rows with a null
    id (after all others) are dropped as copies like any. Of rows equal in both, one stays, by a hash of all its columns.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    key = F.struct(col(id_col).isNull().alias("last"), col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("text"))
    named = simhash_components(docs.select(key.alias("key"), col(text_col).alias("text")), "key", "text", words, radius, width, similarity)
    rows = named.groupBy("key").agg(F.max(F.col("key") == F.col("component_id")).alias("first"), F.count("*").alias("rows"))
    rows = written(rows.where("not first or rows > 1"), "near-copies")
    again = written(rows.where("first").select(F.col("key").alias("__again")), "near-repeats")
    whole = F.struct(*map(col, docs.columns))
    once = docs.join(again, key == F.col("__again")).groupBy("__again").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("__row"))
    return without_keys(docs, rows, key).unionByName(once.select(*(F.col("__row").getField(c).alias(c) for c in docs.columns)))
