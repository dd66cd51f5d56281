"""Document quality by a linear-chain conditional random field over lines.

Each line has shares of character classes, word statistics and repetition, cut into bins at the training lines' quantiles; a
line's features are its own bins and those of the lines before and after. The field has two labels, bad and good, weights
for the features and a 2 x 2 table of transitions. Training lines take their document's label, and a document is one chain.
The sample is bounded: at most `most` labelled documents outside the held-out fold, of at most `longest` lines each and
`most_lines` together, the first by a hash of the id. A document's
score is the mean of its lines' marginals of good, by forward and backward passes over the whole document, weighted by the
lines' lengths.

Nulls and ties: blank lines are no lines; a text without lines, null ones too, is scored as one empty line. Rows repeat as
they come. Without labels of both kinds every document scores the share of good ones (1 without labels, so that nothing
is rejected).
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import col, labelled_sample, parts, sigmoid, texts, written

STEPS, RATE, DECAY = 200, 0.05, 1e-3
BINS = 6
#: Classes of characters: other signs, lower case, upper case, digits, white space, sentence marks, bars, exclamation.
CLASSES, MARKS = 8, ".,;:?'\"-()’“”"


@functools.cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        out[c] = 4 if ch.isspace() else 3 if ch.isdigit() else 2 if ch.isupper() else 1 if ch.isalpha() else 5 if ch in MARKS else 6 if ch == "|" else 7 if ch == "!" else 0
    return out


def lines_of(text: str) -> list[str]:
    return [x for x in text.split("\n") if x and not x.isspace()] or [""]


def measures(lines: list[str]) -> np.ndarray:
    """A row of raw measures for each line."""
    points = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    cls = _classes()[points]
    length = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    share = np.stack([np.add.reduceat(cls == k, starts, dtype=np.int64) for k in range(CLASSES)], axis=1).astype(np.float64)
    share[:, 4] -= 1  # the line's end
    share /= np.maximum(length, 1)[:, None]
    parts = [x.split() for x in lines]
    count = np.array([len(p) for p in parts])
    distinct = np.array([len(set(p)) for p in parts])
    last = np.array([x.rstrip()[-1:] in (".", "?", "!", "…", '"', "”") for x in lines])
    many = np.maximum(count, 1)
    return np.column_stack([share, np.log1p(length), length / many, distinct / many, np.log1p(count), last])


class Field:
    """Weights of a trained field; `cuts` has the bins' bounds of each measure."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, moves: np.ndarray, share: float) -> None:
        self.cuts, self.weights, self.moves, self.share = cuts, weights, moves, share

    @property
    def width(self) -> int:
        return self.cuts.shape[0] * BINS

    def bins(self, raw: np.ndarray) -> np.ndarray:
        """For each line the numbers of its own features, one a measure."""
        return np.stack([np.searchsorted(c, raw[:, k], "right") + k * BINS for k, c in enumerate(self.cuts)], axis=1)

    def unary(self, bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The score of good less that of bad; first and last mark the ends of chains."""
        w, n = self.weights, self.width
        own = w[bins].sum(axis=1)
        left, right = w[n + bins].sum(axis=1), w[2 * n + bins].sum(axis=1)
        before = np.where(first, w[3 * n], np.concatenate([[0], left[:-1]]))
        after = np.where(last, w[3 * n + 1], np.concatenate([right[1:], [0]]))
        return own + before + after + w[3 * n + 2]


def marginals(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line of the chains laid end to end, and the expected transitions (2 x 2, summed)."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, lengths.max() + 1), "right")  # chains with a line t
    e = np.exp(moves - moves.max())
    good = sigmoid(unary)
    ahead, behind = np.empty((len(unary), 2)), np.empty((len(unary), 2))
    own = np.stack([1 - good, good], axis=1) + 1e-12
    for t, k in enumerate(active):
        at = starts[:k] + t
        a = own[at] if not t else own[at] * (ahead[at - 1] @ e)
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(active) - 1, -1, -1):
        at = starts[: active[t]] + t
        behind[at] = 1.0
        if t + 1 < len(active):
            inner = at[: active[t + 1]]
            b = (behind[inner + 1] * own[inner + 1]) @ e.T
            behind[inner] = b / b.sum(axis=1, keepdims=True)
    both = ahead * behind
    p = both[:, 1] / both.sum(axis=1)
    inner = np.concatenate([np.arange(s, s + n - 1) for s, n in zip(starts, lengths, strict=True)]).astype(int) if lengths.max() > 1 else np.empty(0, int)
    pair = ahead[inner][:, :, None] * e[None] * (own[inner + 1] * behind[inner + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p, pair.sum(axis=0)


def fit(raw: np.ndarray, lengths: np.ndarray, good: np.ndarray) -> Field:
    """The field that makes the chains' labels likeliest; `good` has a label for each chain."""
    cuts = np.stack([np.quantile(raw[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(raw.shape[1])])
    field = Field(cuts, np.zeros(3 * len(cuts) * BINS + 3), np.zeros((2, 2)), float(good.mean()))
    bins, n = field.bins(raw), field.width
    ends = np.cumsum(lengths) - 1
    first, last = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    first[ends - lengths + 1] = last[ends] = True
    y = np.repeat(good, lengths).astype(float)
    steps = float((lengths - 1).sum())
    seen = np.diag([((lengths - 1) * (1 - good)).sum(), ((lengths - 1) * good).sum()]).astype(float)
    theta = np.concatenate([field.weights, field.moves.ravel()])
    one, two = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        field.weights, field.moves = theta[:-4], theta[-4:].reshape(2, 2)
        p, pair = marginals(field.unary(bins, first, last), lengths, field.moves)
        d = (p - y) / len(y)
        before, after = np.where(first, 0, d), np.where(last, 0, d)
        to = lambda g: np.bincount(bins.ravel(), weights=np.repeat(g, bins.shape[1]), minlength=n)
        left, right = np.concatenate([before[1:], [0]]), np.concatenate([[0], after[:-1]])
        grad = np.concatenate([to(d), to(left), to(right), [d[first].sum(), d[last].sum(), d.sum()], ((pair - seen) / max(steps, 1)).ravel() * min(1, steps / len(y))]) + DECAY * theta / 10
        one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad**2
        theta = theta - RATE * one / (1 - 0.9**step) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    field.weights, field.moves = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def score_texts(field: Field | None, docs: list[str], share: float) -> np.ndarray:
    if not docs:
        return np.empty(0)
    if field is None:
        return np.full(len(docs), share)
    chains = [lines_of(t) for t in docs]
    lengths = np.array([len(c) for c in chains])
    flat = [x for c in chains for x in c]
    ends = np.cumsum(lengths)
    first, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    first[ends - lengths] = last[ends - 1] = True
    p, _ = marginals(field.unary(field.bins(measures(flat)), first, last), lengths, field.moves)
    weight = np.array([max(1, len(x)) for x in flat], float)
    return np.clip(np.add.reduceat(p * weight, ends - lengths) / np.add.reduceat(weight, ends - lengths), 0, 1)


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for classes, docs in texts(batches):
        chains = [lines_of(t) for t in docs]
        raw = measures([x for c in chains for x in c]).astype(np.float32)
        ends = np.cumsum([len(c) for c in chains])
        rows = [raw[e - len(c) : e].ravel().tolist() for c, e in zip(chains, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(rows, pa.list_(pa.float32()))], ["label", "raw"])


def train(docs: DataFrame, labels: DataFrame, parts: int, held: int, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 5000, most_lines: int = 200_000, longest: int = 2000) -> tuple[Field | None, float]:
    """The field (None without labels of both kinds), and the share of good documents."""
    sample = labelled_sample(docs, labels, label_col, parts, held, most, id_col, text_col)
    sample = written(sample.select(F.xxhash64("id").alias("h"), "label", "text", F.size(F.split("text", "\n")).alias("lines")).where(F.col("lines") <= longest), "quality")
    sizes = sorted(map(tuple, sample.select("h", "lines").collect()))  # at most `most` pairs
    total = np.cumsum([n for _, n in sizes])
    fits = int(np.searchsorted(total, most_lines, "right"))
    sample = sample.where(F.col("h") <= sizes[fits - 1][0]) if 0 < fits < len(sizes) else sample
    rows = sorted((r["label"], r["raw"]) for r in sample.select("label", "text").mapInArrow(_measure, "label int, raw array<float>").collect())
    good = np.array([int(label > 0) for label, _ in rows])
    if not len(good) or good.min() == good.max():
        return None, float(good.mean()) if len(good) else 1.0
    wide = measures([""]).shape[1]
    raws = [np.array(r, np.float64).reshape(-1, wide) for _, r in rows]
    return fit(np.concatenate(raws), np.array([len(r) for r in raws]), good), float(good.mean())


def _score(batches: Iterable[pa.RecordBatch], field: Field | None, share: float, threshold: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, docs in texts(batches):
        s = score_texts(field, docs, share)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["id", "score", "predicted"])


def score(docs: DataFrame, field: Field | None, share: float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id_col, score, predicted) of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return src.mapInArrow(functools.partial(_score, field=field, share=share, threshold=threshold, kind=to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)


def _keep(batches: Iterable[pa.RecordBatch], at: int, field: Field | None, share: float, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, at):
            s = score_texts(field, [t or "" for t in part.column(at).to_pylist()], share)
            yield part.filter(pa.array(s >= threshold))


def without_rejected(docs: DataFrame, field: Field | None, share: float, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that are not rejected, all columns kept."""
    return docs.mapInArrow(functools.partial(_keep, at=docs.columns.index(text_col), field=field, share=share, threshold=threshold), docs.schema)
