"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, at most `most_positive` labelled ids outside the held-out fold, the first by a hash of
the id; all texts outside that fold, whatever they are, are the unlabelled. The class prior is the toxic
share of the labelled ids there. A text's features are the distinct words it holds; the vocabulary is the at most
`size` words whose document frequencies differ most between positives and unlabelled, by APART deviations at least. Candidates
are the words of two or more positives, the `most_words` most frequent of them; their frequencies are counted over all unlabelled texts.

A linear model is trained in numpy by the logistic loss under the non-negative risk: prior * positive risk + max(0, unlabelled
negative risk - prior * positives' negative risk); where the bracket is negative, the step goes against it. Each of PASSES steps sees all
unlabelled texts, at every size of the table alike: their sums are taken on the executors over distinct sets of features with
their numbers of texts, and only sums of `size` numbers come to the driver. The steps are few on purpose: the logistic loss has no
bound, and steps until the risk no longer falls fit the positives alone (see the README for figures). The model's sigmoid is the score.

Nulls and ties: a null text counts as empty and scores as a text without known words; rows repeat as they come, and of
labelled rows that share an id the least text is taken. Very long texts are read whole, columns other than those named are
not read, an empty table gives an empty result. Without
positives or unlabelled texts the score is the prior (0 without labels). Ties in the vocabulary are broken by the word.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import col, fold, labelled_sample, sigmoid, texts, written

WORD = re.compile(r"[^\W\d_]+")
PASSES, RATE, DECAY, SLACK, AGAINST = 60, 0.25, 1e-4, 0.0, 1.0
#: A word is taken only from so many deviations on, about 5 % of false ones among 10,000 words.
APART = 4.5


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _frequencies(batches: Iterable[pa.RecordBatch], among: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Document frequencies of words, or of those of `among`, in parts of bounded size."""
    held: dict[str, int] = {}

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for _, docs in texts(batches):
        for t in docs:
            for w in words(t) if among is None else words(t) & among:
                held[w] = held.get(w, 0) + 1
        if len(held) > 500_000:
            yield part()
            held = {}
    if held:
        yield part()


def _vectors(batches: Iterable[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for classes, docs in texts(batches):
        rows = [sorted(vocabulary[w] for w in words(t) & vocabulary.keys()) for t in docs]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(rows, pa.list_(pa.int32()))], ["drawn", "at"])


def sums(lengths: np.ndarray, at: np.ndarray, w: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Of log(1 + exp(f)) over texts of so many features each: its gradient by weights and bias, its sum, and the number of texts.

    `times`: how many texts each row stands for, one if not given.
    """
    times = np.ones(len(lengths)) if times is None else times
    owner = np.repeat(np.arange(len(lengths)), lengths)
    f = np.bincount(owner, weights=w[at], minlength=len(lengths)) + w[-1]
    s = sigmoid(f) * times
    return np.concatenate([np.bincount(at, weights=s[owner], minlength=len(w) - 1), [s.sum(), (np.logaddexp(0, f) * times).sum(), times.sum()]])


def _sums(batches: Iterable[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(w) + 2)
    for batch in batches:
        lists = batch.column(0)
        total += sums(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.int64), w, batch.column(1).to_numpy().astype(float))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "x"])


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(r) for r in rows], np.int64), np.array([x for r in rows for x in r], np.int64)


def risk_step(positive: np.ndarray, seen: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, prior: float) -> np.ndarray:
    """The direction of a step down the non-negative risk, from the two classes' `sums`; `seen` counts the positives' features."""
    n, m = positive[-1], unlabelled[-1]
    bracket = unlabelled[-2] / m - prior * positive[-2] / n
    toward = unlabelled[:-2] / m - prior * positive[:-2] / n  # of the bracket
    g = -AGAINST * toward if bracket < -SLACK else toward + prior * (positive[:-2] - seen) / n
    g[:-1] += DECAY * w[:-1]
    return g


def fit(positive: list[list[int]], over_all: Callable[[np.ndarray], np.ndarray], size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk, by Adam; `over_all` yields the unlabelled `sums` of all texts."""
    p = _flat(positive)
    seen = np.append(np.bincount(p[1], minlength=size), float(len(positive)))
    w = np.zeros(size + 1)
    w[-1] = math.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, PASSES + 1):
        grad = risk_step(sums(*p, w), seen, over_all(w), w, prior)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, parts: int, held: int, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_positive: int = 4000, size: int = 1000, most_words: int = 200_000) -> tuple[dict[str, float], float]:
    """Words' weights, and the bias."""
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("double").alias("y")).where(fold(F.col("id"), parts) != held)
    share = known.agg(F.avg("y")).first()[0]
    if share is None:
        return {}, -40.0
    prior = min(0.9, max(1e-3, share))
    toxic = written(labelled_sample(docs, labels, label_col, parts, held, most_positive, id_col, text_col, value=1).select(F.lit(1).alias("drawn"), "text"), "toxicity")
    src = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).where(fold(F.col("id"), parts) != held)
    n, m = toxic.count(), src.count()
    if not n or not m:
        return {}, math.log(prior / (1 - prior))
    counted = lambda df, among: df.select(F.lit(0), "text").mapInArrow(functools.partial(_frequencies, among=among), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    in_positive = {r["word"]: r["n"] for r in counted(toxic, None).where("n >= 2").orderBy(F.desc("n"), "word").limit(most_words).collect()}
    in_all = {r["word"]: r["n"] for r in counted(src, frozenset(in_positive)).collect()}
    apart = {}
    for word, k in in_positive.items():
        both = k + in_all.get(word, 0)
        pooled = both / (n + m)
        z = abs(k / n - in_all.get(word, 0) / m) / math.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m) + 1e-12)
        if z >= APART and both >= 5:
            apart[word] = z
    vocabulary = sorted(apart, key=lambda x: (-apart[x], x))[:size]
    at = {w: i for i, w in enumerate(vocabulary)}
    vectors = functools.partial(_vectors, vocabulary=at)
    positive = sorted(tuple(r["at"]) for r in toxic.mapInArrow(vectors, "drawn int, at array<int>").collect())
    # Texts alike have one row of few numbers, however many they are.
    unlabelled = written(src.select(F.lit(0), "text").mapInArrow(vectors, "drawn int, at array<int>").groupBy("at").agg(F.count("*").alias("n")), "toxicity")

    def over_all(w: np.ndarray) -> np.ndarray:
        total = unlabelled.mapInArrow(functools.partial(_sums, w=w), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
        return np.array([r["x"] for r in total])

    w, b = fit([list(x) for x in positive], over_all, len(vocabulary), prior)
    return dict(zip(vocabulary, w.tolist(), strict=True)), b


def _score(batches: Iterable[pa.RecordBatch], weights: dict[str, float], bias: float, threshold: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, docs in texts(batches):
        f = sigmoid(np.array([math.fsum(weights[w] for w in words(t) & weights.keys()) + bias for t in docs]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(f, pa.float64()), pa.array((f >= threshold).astype(np.int32), pa.int32())], ["id", "score", "predicted"])


def score(docs: DataFrame, weights: dict[str, float], bias: float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id_col, score, predicted) of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return src.mapInArrow(functools.partial(_score, weights=weights, bias=bias, threshold=threshold, kind=to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)
