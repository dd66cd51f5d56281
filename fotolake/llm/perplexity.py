"""Quality rules: counts of words, symbols, repeated lines and windows, and the perplexity of an n-gram model.

The model is a modified Kneser-Ney model of characters: ORDER - 1 characters predict the next. Runs of white space are a space,
digits are 0, a text starts with START marks; case and all other characters count. Spark counts the n-grams of all texts, and
from them, order by order, the continuation counts, discounts, probabilities and back-off weights. The model is stored as arrays
sorted by the hash of the n-gram, with an index of the first bits, and a text's bits are looked up by whole arrays.

A text's perplexity is 2 to the power of its bits per character. Each language (`lang`) has its own band of these, from the
texts that pass the counting rules: from the median less `width` times its distance to the first quartile, to the median
plus `width` times that of the third, distances of `least` bits at the least. Repetitive texts fall below, texts unlike
the corpus above. Quartiles are exact to STEP bits: they come from counts of steps, which are few whatever the number of texts.

Size: executors hold one piece of the model of up to `most` entries (12 bytes each; counted before it is gathered). A larger model is
cut by the two characters before the predicted one, which leaves all that a prediction needs in one piece but for n-grams of one
and two characters, which each piece has; the texts are then read once a piece and their bits, whole numbers of STEP / 1024, summed up.

Nulls and ties: null text is empty; a null language is one of its own. Repeated rows are counted each and repeat. Texts without
characters have perplexity 1, and fail by their words. Very long texts are read in pieces and whole. Columns other than those
named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import BROADCAST_KEYS, col, texts, written

ORDER = 5
#: Stands before a text; no other, since white space is a space. Bits are kept in whole numbers of 2^-BITS, bands in steps of STEP.
START, BITS, STEP = ord("\n"), 20, 1 / 1024
#: Characters read at a time, n-grams sorted at a time (22 bits at most, see `distinct`).
PIECE, SORTED = 1 << 20, 1 << 21
_SPACE = re.compile(rb"[ \t-\r]")
_POINTS = 0x110000


def repeated_words(ids: np.ndarray, kinds: int) -> int:
    """How many words are in a window of three that is there twice or more; `ids` are below `kinds`."""
    if len(ids) < 3:
        return 0
    first, last = ids[:-1] * kinds + ids[1:], ids[2:]
    if kinds >= 1 << 20:
        first = np.unique(first, return_inverse=True)[1]
    _, where, n = np.unique(first[:-1] * kinds + last, return_inverse=True, return_counts=True)
    twice, covered = n[where] > 1, np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data, known, ids, at, seen, dup = text.encode("utf-8", "surrogatepass"), {}, [], 0, set(), 0
    while at < len(data):
        gap = _SPACE.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in data[at:end].split()), np.int64))
        at = end
    words = np.concatenate(ids) if ids else np.empty(0, np.int64)
    for line in data.split(b"\n"):
        if line in seen:
            dup += bool(line.split(None, 1))
        else:
            seen.add(line)
    spaces, symbols = (len(data) - len(data.translate(None, x)) for x in (b" \t\n\x0b\x0c\r", b"#*$%&|<>"))
    return len(words), len(text) - spaces, symbols, dup, repeated_words(words, max(1, len(known)))


def streams(text: str) -> Iterator[np.ndarray]:
    """The characters of a text that the model sees, in pieces that each start with the ORDER - 1 before them."""
    before, gap = np.full(ORDER - 1, START, np.int64), False
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        space = (points == 32) | ((points >= 9) & (points <= 13))
        points = np.where(space, 32, np.where((points >= 48) & (points <= 57), 48, points))
        points = points[~(space & np.concatenate([[gap], space[:-1]]))]
        gap = bool(space[-1])
        if len(points):
            piece = np.concatenate([before, points])
            yield piece
            before = piece[1 - ORDER :]


def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of ORDER characters in pieces of a stream, a row of code points each, and their counts."""
    points = np.concatenate(parts)
    starts = np.ones(len(points), bool)
    for end in np.cumsum([len(p) for p in parts]).tolist():
        starts[end - ORDER + 1 : end] = False
    starts = np.flatnonzero(starts)
    present = np.flatnonzero(np.bincount(points, minlength=_POINTS))
    bits = max(1, int(len(present) - 1).bit_length())
    if bits * ORDER <= 64:
        ranks = np.zeros(_POINTS, np.uint64)
        ranks[present] = np.arange(len(present), dtype=np.uint64)
        letters, key = ranks[points], np.zeros(len(starts), np.uint64)
        for i in range(ORDER):
            key = (key << np.uint64(bits)) | letters[starts + i]
        key, n = np.unique(key, return_counts=True)
        columns = [present[((key >> np.uint64(bits * (ORDER - 1 - i))) & np.uint64((1 << bits) - 1)).astype(np.int64)] for i in range(ORDER)]
        return np.stack(columns, axis=1), n
    # letters of more kinds: the first three have numbers among SORTED at most, the last two 21 bits each
    first = (points[starts] << 42) | (points[starts + 1] << 21) | points[starts + 2]
    first, number = np.unique(first, return_inverse=True)
    key, n = np.unique((number.astype(np.uint64) << np.uint64(42)) | (points[starts + 3] << 21).astype(np.uint64) | points[starts + 4].astype(np.uint64), return_counts=True)
    first, rest = first[(key >> np.uint64(42)).astype(np.int64)], (key & np.uint64((1 << 42) - 1)).astype(np.int64)
    return np.stack([first >> 42, (first >> 21) & 0x1FFFFF, first & 0x1FFFFF, rest >> 21, rest & 0x1FFFFF], axis=1), n


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        grams, n = distinct(held)
        for at in range(0, len(n), 50_000):
            text = grams[at : at + 50_000].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(n[at : at + 50_000], pa.int64())], ["gram", "n"])
        held.clear()

    for _, some in texts(batches, chars=PIECE):
        for piece in (p for text in some for p in streams(text)):
            if size + len(piece) > SORTED and held:
                yield from rows()
                size = 0
            held.append(piece)
            size += len(piece)
    if held:
        yield from rows()


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): the n-grams of ORDER characters of all texts."""
    src = docs.select(F.lit(0).alias("id"), col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What counts of 1, 2 and more lose, from how many n-grams have counts 1 to 4; within 0 and the count."""
    share = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [(k + 1) * share * after / here if here else 0.0 for k, (here, after) in enumerate(((n1, n2), (n2, n3), (n3, n4)))]
    return tuple(min(max(k + 1 - x, 0.0), k + 1.0) for k, x in enumerate(raw))


def model(grams: DataFrame) -> tuple[DataFrame, float]:
    """(key, weight, probability): log2 of the probability of each n-gram, and of the back-off weight of each context; and that of
    a character never seen. `grams` are the counts (gram, n) of n-grams of ORDER characters."""
    orders = {ORDER: written(grams, "order")}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = written(orders[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "order")
    low, entries, unseen = None, [], 0.0
    for k in range(1, ORDER + 1):
        n = F.col("n")
        n1, n2, n3, n4, kinds = orders[k].agg(*(F.count_if(n == i) for i in (1, 2, 3, 4)), F.count("*")).first()
        d1, d2, d3 = discounts(n1, n2, n3, n4)
        taken = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        own = orders[k].withColumn("context", F.substring("gram", 1, k - 1))
        contexts = own.groupBy("context").agg(F.sum("n").alias("all"), F.sum(taken).alias("left"))
        contexts = written(contexts.select("context", "all", (F.col("left") / F.col("all")).alias("back")), "contexts")
        if k == 1:
            row = contexts.first()
            n_all, back = (row["all"], row["back"]) if row else (1, 1.0)
            unseen = max(back, 1e-9) / (kinds + 1)
            low = own.select("gram", ((n - taken) / float(n_all) + back / (kinds + 1)).alias("p"))
        else:
            joined = own.withColumn("suffix", F.substring("gram", 2, k - 1)).join(contexts, "context").join(low.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix")
            low = joined.select("gram", ((n - taken) / F.col("all") + F.col("back") * F.col("low")).alias("p"))
            entries.append(contexts.select(F.col("context").alias("key"), F.col("back").alias("w"), F.lit(False).alias("probability")))
        low = written(low, "probabilities")
        entries.append(low.select(F.col("gram").alias("key"), F.col("p").alias("w"), F.lit(True).alias("probability")))
    every = functools.reduce(DataFrame.unionByName, entries)
    fixed = F.round(F.log2(F.greatest("w", F.lit(2.0**-1000))) * (1 << BITS)).cast("int")
    return every.select("key", fixed.alias("weight"), "probability"), float(np.log2(unseen))


def _mixed(points: np.ndarray) -> np.ndarray:
    """A number of 64 well-mixed bits for each code point."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_FACTORS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(ORDER)]


class Hashed:
    """Weights by hash: sorted arrays, with an index of where each run of equal first bits starts."""

    def __init__(self, keys: list[str], weights: np.ndarray) -> None:
        lengths = np.array([len(k) for k in keys], np.int64)
        points = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), "<u4")
        hashes, ends = np.zeros(len(keys), np.uint64), np.cumsum(lengths)
        for i in range(int(lengths.max(initial=0))):
            some = np.flatnonzero(lengths > i)
            hashes[some] += _mixed(points[ends[some] - 1 - i]) * _FACTORS[i]
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.bits = min(22, max(1, len(keys).bit_length()))
        self.starts = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Where each hash stands, -1 where it doesn't."""
        if not len(self.hashes):
            return np.full(len(wanted), -1, np.int64)
        at = self.starts[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        last = len(self.hashes) - 1
        there = self.hashes[np.minimum(at, last)]
        on = np.flatnonzero(there < wanted)
        while len(on):
            at[on] += 1
            on = on[at[on] <= last]
            there[on] = self.hashes[at[on]]
            on = on[there[on] < wanted[on]]
        return np.where((at <= last) & (self.hashes[np.minimum(at, last)] == wanted), at, -1)


class Scorer:
    """Bits of texts by a piece of the model, in whole numbers of 2^-BITS."""

    def __init__(self, grams: Hashed, contexts: Hashed, unseen: float, piece: int, pieces: int) -> None:
        self.grams, self.contexts, self.unseen, self.piece, self.pieces = grams, contexts, round(unseen * (1 << BITS)), piece, pieces

    def __call__(self, text: str) -> tuple[int, int]:
        """Bits and characters; of other pieces' characters, none."""
        total, chars = 0, 0
        for points in streams(text):
            mixed = _mixed(points)
            ends = np.arange(ORDER - 1, len(points))
            if self.pieces > 1:
                ends = ends[piece_of(points[ends - 2], points[ends - 1], self.pieces) == self.piece]
            chars += len(ends)
            for k in range(ORDER, 0, -1):
                if not len(ends):
                    break
                context = np.zeros(len(ends), np.uint64)
                for i in range(1, k):
                    context += mixed[ends - i] * _FACTORS[i - 1]
                at = self.grams.find(mixed[ends] + context * _FACTORS[1])
                total -= int(self.grams.weights[at[at >= 0]].sum(dtype=np.int64))
                ends, context = ends[at < 0], context[at < 0]
                if k > 1 and len(ends):
                    at = self.contexts.find(context)
                    total -= int(self.contexts.weights[at[at >= 0]].sum(dtype=np.int64))
            total -= self.unseen * len(ends)
        return total, chars


def piece_of(c: np.ndarray, d: np.ndarray, pieces: int) -> np.ndarray:
    """The piece of the model that has what follows the characters c and d."""
    return ((c * 2_097_143 + d) * 40_503 % 1_000_003) % pieces


def _score(batches: Iterable[pa.RecordBatch], scorer, kind: pa.DataType, counted: bool) -> Iterator[pa.RecordBatch]:
    names = ["id", "key", "bits", "chars", *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] * counted]
    keys = {}
    for batch in batches:
        at = 0
        for ids, some in texts([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["id", "text"])], chars=PIECE):
            rows = [[*scorer.value(t), *(base(t) if counted else ())] for t in some]
            keys = batch.column(2).slice(at, len(ids))
            at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), keys, *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], names)


def _pieces(entries: DataFrame, most: int) -> tuple[DataFrame, int]:
    """`entries` with the `piece` of each (null: in all pieces), pieces of `most` entries at most."""
    n, short = entries.agg(F.count("*"), F.count_if(F.char_length("key") <= F.when(F.col("probability"), 2).otherwise(1))).first()
    if short > most // 2:
        raise ValueError(f"{short} n-grams of one and two characters: set `most` to twice as many")
    pieces = 1 if n <= most else -(-2 * n // (most - short))
    while True:
        # the two characters before the predicted one: of an n-gram the last but one and two, of a context the last two
        back = F.when(F.col("probability"), 1).otherwise(0)
        at = lambda i: F.ascii(F.substr("key", F.char_length("key") - back - F.lit(i), F.lit(1))).cast("long")
        piece = ((at(1) * 2_097_143 + at(0)) * 40_503 % 1_000_003) % pieces
        cut = entries.withColumn("piece", F.when(F.char_length("key") > back + 1, piece))
        largest = cut.where("piece is not null").groupBy("piece").count().agg(F.max("count")).first()[0] or 0
        if largest + short <= most or pieces == 1:
            return cut, pieces
        if pieces > 1_000_000:
            raise ValueError("what follows two characters is more than `most` entries")
        pieces *= 2


def scored(docs: DataFrame, entries: DataFrame, unseen: float, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None, most: int = 4_000_000) -> DataFrame:
    """(id, key, bits, chars, and the counts of `base`) of each row; key is `carry`."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    carry = F.lit("") if carry is None else carry
    src = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), carry.cast("string").alias("key"))
    kind = src.schema["id"].dataType
    fields = lambda names: T.StructType([T.StructField("id", kind), T.StructField("key", T.StringType()), *(T.StructField(x, T.LongType()) for x in names)])
    rules = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    cut, pieces = _pieces(entries, most)
    cut = written(cut, "model") if pieces > 1 else cut

    def run(rows: DataFrame, piece: int, counted: bool) -> DataFrame:
        table = cut.where((F.col("piece") == piece) | F.col("piece").isNull()).toArrow()  # `most` entries at most
        side = lambda wanted: (lambda t: Hashed(t["key"].to_pylist(), t["weight"].to_numpy()))(table.filter(pa.compute.equal(table["probability"], wanted)))
        scorer = spark.sparkContext.broadcast(Scorer(side(True), side(False), unseen, piece, pieces))
        return rows.mapInArrow(functools.partial(_score, scorer=scorer, kind=to_arrow_type(kind), counted=counted), fields(["bits", "chars", *rules * counted]))

    if pieces == 1:
        return run(src, 0, True)
    tagged = src.withColumn("key", F.concat(F.md5("text"), "key"))
    first = written(run(tagged, 0, True), "bits")
    parts = [written(run(tagged, i, False).withColumn("piece", F.lit(i)).dropDuplicates(["id", "key"]), "bits") for i in range(1, pieces)]
    more = functools.reduce(DataFrame.unionByName, parts).groupBy("id", "key").agg(F.sum("bits").alias("b"), F.sum("chars").alias("c"))
    more = more.withColumnsRenamed({"id": "other", "key": "same"})
    out = first.join(more, F.col("id").eqNullSafe(F.col("other")) & (F.col("key") == F.col("same")), "left")
    return out.select("id", F.substring("key", 33, 1 << 30).alias("key"), (F.col("bits") + F.coalesce("b", F.lit(0))).alias("bits"), (F.col("chars") + F.coalesce("c", F.lit(0))).alias("chars"), *rules)


def bands(steps: DataFrame, width: float, least: float) -> DataFrame:
    """(key, low, high): each language's band in steps, of rows (key, step)."""
    by = Window.partitionBy("key").orderBy("step")
    n = steps.groupBy("key", "step").agg(F.count("*").alias("n")).withColumns({"upto": F.sum("n").over(by), "all": F.sum("n").over(Window.partitionBy("key"))})
    quartile = lambda i: F.min(F.when(F.col("upto") * 4 >= F.col("all") * i, F.col("step"))).alias(f"q{i}")
    q = n.groupBy("key").agg(*map(quartile, (1, 2, 3)))
    away = lambda a, b: F.greatest((F.col(a) - F.col(b)) * F.lit(float(width)), F.lit(least / STEP))
    return q.select("key", (F.col("q2") - away("q2", "q1")).alias("low"), (F.col("q2") + away("q3", "q2")).alias("high"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50, most_repeated: int = 50, width: float = 12.0, least: float = 0.5, most: int = 4_000_000) -> DataFrame:
    """(id_col, the counts of `base`, base_failed, kept, bits_per_char) of each row.

    base_failed: fewer than `least_words` words, or over `most_repeated` percent of them in repeated windows; kept: not that, and the bits
    of a character are within the language's band.
    """
    entries, unseen = model(counts(docs, text_col))
    lang = F.concat(F.when(col(lang_col).isNull(), "-").otherwise("+"), F.coalesce(col(lang_col).cast("string"), F.lit("")))
    rows = scored(docs, entries, unseen, id_col, text_col, lang, most)
    rows = rows.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    rows = written(rows.withColumn("step", F.expr(f"bits div ({1 << (BITS - 10)} * greatest(chars, 1))")), "scores")
    band = written(bands(rows.where("not base_failed"), width, least), "bands")
    out = rows.join(F.broadcast(band) if band.count() <= BROADCAST_KEYS else band, "key", "left")
    kept = ~F.col("base_failed") & F.col("step").between(F.col("low"), F.col("high"))
    bits = F.col("bits") / F.greatest("chars", F.lit(1)) / float(1 << BITS)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), bits.alias("bits_per_char"))
