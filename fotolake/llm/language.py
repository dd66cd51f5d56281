"""Language identification by rank-order profiles of character n-grams.

Letters are lower-cased; everything else is a boundary, runs of which count once. One- to three-grams
of a whole text, boundaries included, are counted and ranked (ties by code points). A language's profile holds its most frequent
n-grams of the training texts; a text's distance to it sums how far each of its most frequent n-grams is out of place, absent
ones by the profile's length. The nearest language is predicted (ties: the first by name); the score compares the nearest
distance with the second: 0.5 if equal, 1 if the nearest is 0.

Profiles are learned from about `most` texts of each language, chosen by a hash of id and text, so no shuffle of texts is needed;
n-grams are counted on the executors and only profiles come to the driver, `size` numbers a language (languages are few: a
thousand make 3 MB).

Nulls and ties: texts that are null or without letters are `und`, with score 0, as are all if there is nothing to learn from.
Rows with a null language are not learned from. Very long texts are read whole. Repeated rows repeat; columns other than those
named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import col, fold, texts

BITS, EDGE = 21, 0x110000  # bits of a code point, three of which make an n-gram's number, and what stands for a boundary


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts, most frequent first; an n-gram is its code points, EDGE at boundaries, in one number."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    n = np.where(_letters()[points], points, EDGE)
    n = np.concatenate([[EDGE], n, [EDGE]])
    n = n[np.concatenate([[True], (n[1:] != EDGE) | (n[:-1] != EDGE)])]
    if len(n) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = (n[:-1] << BITS) + n[1:]
    triples = (n[:-2] << (2 * BITS)) + pairs[1:]
    codes = np.concatenate([n[n != EDGE], pairs, triples[n[1:-1] != EDGE]])
    codes, counts = np.unique(codes, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    return codes[order], counts[order]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[int, int]] = {}
    for langs, docs in texts(batches):
        for lang, text in zip(langs, docs, strict=True):
            into = held.setdefault(lang, {})
            for g, c in zip(*(x.tolist() for x in grams(text)), strict=True):
                into[g] = into.get(g, 0) + c
    rows = [(lang, g, c) for lang, into in held.items() for g, c in into.items()]
    for at in range(0, len(rows), 50_000):
        part = list(zip(*rows[at : at + 50_000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], ["lang", "gram", "n"])


def profiles(docs: DataFrame, parts: int, held: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400, most: int = 4000) -> dict[str, list[int]]:
    """Each language's most frequent n-grams, most frequent first, from rows outside fold `held` of `parts`."""
    src = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"))
    src = src.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold(F.col("id"), parts) != held)
    share = src.groupBy("lang").count().withColumn("share", F.least(F.lit(1.0), F.lit(float(most)) / F.col("count"))).select("lang", "share")
    draw = F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1_000_003)) / 1_000_003.0
    some = src.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text")
    counts = some.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in rows:
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Model:
    def __init__(self, known: dict[str, list[int]], size: int) -> None:
        self.names, self.size = sorted(known), size
        self.codes = np.unique(np.concatenate([np.array(known[n], np.int64) for n in self.names])) if known else np.empty(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int32)
        for row, n in zip(self.ranks, self.names, strict=True):
            row[np.searchsorted(self.codes, known[n])] = np.arange(len(known[n]))

    def __call__(self, text: str) -> tuple[str, float]:
        codes, _ = grams(text)
        codes = codes[: self.size]
        if not len(codes) or not self.names:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(codes)))).sum(axis=1) / (self.size * len(codes))
        best = int(far.argmin())
        second = min((x for i, x in enumerate(far) if i != best), default=1.0)
        return self.names[best], float(second / (far[best] + second)) if far[best] + second > 0 else 0.5


def _predict(batches: Iterable[pa.RecordBatch], known: dict[str, list[int]], size: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    model = Model(known, size)
    for ids, docs in texts(batches):
        found = [model(t) for t in docs]
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])


def predict(docs: DataFrame, known: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """(id_col, lang_pred, score) of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(functools.partial(_predict, known=known, size=size, kind=to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)
