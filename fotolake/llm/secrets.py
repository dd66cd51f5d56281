"""Secret scans: three fixed patterns, and a battery of randomness tests for other tokens.

Base spans, leftmost and non-overlapping per kind, over the whole text in code points: assign, access, hex. Patterns are
matched first; matches that are too short are then dropped. Spans are those of whole matches.

The battery looks at the remaining tokens of 16 or more characters of `[A-Za-z0-9+/_=-]` (20 or more of digits alone). A
token's encoding is inferred from its characters (hex, base32, base36, base62, base64, base64url). Its null hypothesis is written
language in that alphabet, whose letter frequencies, changes of class and alternation of vowels are fixed values. Three tests
are taken against it and joined by Fisher's rule: chi-squared uniformity over the alphabet, runs of character classes, and
serial correlation (of vowels; not for hex, which has few letters). The same three are taken against randomness, serial correlation there of
character values. Where the letters are of one case their likelihood under the table takes the place of uniformity, and of letters
alone, where classes say nothing, that of runs too. Parts of 16 or more between joiners and slashes are tested beside the whole. A token counts as random if
language is rejected after false-discovery control by Benjamini and Hochberg over the text's candidates, weighted by their
lengths, and randomness itself is not. Control is within each text, so that its spans do not hang on other texts. Such a token is
a span of kind `random`, unless it overlaps a base span.

Nulls and ties: a null text counts as empty; a row always gives a row, repeated rows repeat. Spans are ordered by start, then
kind as listed. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fotolake.llm.common import col, parts, texts

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words of ASSIGN in lower case; a text without any has no match.
HINTS = ("passw", "secret", "token", "api_key", "apikey")
#: Least characters of a token, and of one of digits alone, such as a number of a card.
LEAST, LEAST_DIGITS = 16, 20
TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
#: Relative frequencies of letters in written language, in percent.
LETTERS = {"e": 12.7, "t": 9.1, "a": 8.2, "o": 7.5, "i": 7.0, "n": 6.7, "s": 6.3, "h": 6.1, "r": 6.0, "d": 4.3, "l": 4.0, "c": 2.8, "u": 2.8, "m": 2.4, "w": 2.4, "f": 2.2, "g": 2.0, "y": 2.0, "p": 1.9, "b": 1.5, "v": 1.0, "k": 0.8, "j": 0.15, "x": 0.15, "q": 0.1, "z": 0.07}
#: Least frequency at which a letter counts, in percent, for languages that use rare letters more.
RARE = 0.5
#: Of written language: changes of class a character, and serial correlation of vowels with its deviation times the root of the length.
CHANGES, ALTERNATION, ALTERNATION_SD = 0.08, -0.15, 0.9
VOWELS = frozenset("aeiouyAEIOUY")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def encoding(token: str) -> str:
    """The smallest alphabet that holds the token."""
    body = token.rstrip("=")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return "hex"
    if set(body) <= set(ALPHABETS["base32"]):
        return "base32"
    if body in (body.lower(), body.upper()) and set(body.lower()) <= set(ALPHABETS["base36"]):
        return "base36"
    for name in ("base62", "base64"):
        if set(body) <= set(ALPHABETS[name]):
            return name
    return "base64url"


def _tail(z: float) -> float:
    """P(Z >= z) of a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _fisher(*p: float) -> float:
    """Fisher's combination of independent p-values."""
    x = -sum(math.log(max(q, 1e-300)) for q in p)
    term, total = 1.0, 1.0
    for i in range(1, len(p)):
        term *= x / i
        total += term
    return min(1.0, math.exp(-x) * total)


def _serial(values: list[float]) -> float | None:
    """Lag-one serial correlation, None of a constant."""
    mid = sum(values) / len(values)
    around = sum((v - mid) ** 2 for v in values)
    return sum((a - mid) * (b - mid) for a, b in zip(values, values[1:])) / around if around else None


def _alternation(body: str) -> list[float]:
    """The p of language of the serial correlation of vowels; none where there are none, or nothing else."""
    serial = _serial([float(c in VOWELS) for c in body])
    return [] if serial is None else [_tail((serial - ALTERNATION) * math.sqrt(len(body)) / ALTERNATION_SD)]


@functools.cache
def _language(name: str) -> tuple[float, float]:
    """Sums of squares and cubes of the alphabet's character probabilities in language."""
    weights = [LETTERS.get(c.lower(), 1.0) * (0.04 if c.isupper() and name != "base32" else 1.0) for c in ALPHABETS[name]]
    total = sum(weights)
    return sum((w / total) ** 2 for w in weights), sum((w / total) ** 3 for w in weights)


def battery(token: str) -> tuple[float, float]:
    """(p of language, p of randomness) of a token."""
    name = encoding(token)
    body = token.rstrip("=")
    body = body.lower() if name in ("hex", "base36") else body
    alphabet, n = ALPHABETS[name], len(body)
    k = len(alphabet)
    # Uniformity: the sum of squared counts, whose mean and variance are known for any character probabilities.
    squares = sum(c * c for c in Counter(body).values())

    def moments(s2: float, s3: float) -> tuple[float, float]:
        pairs = n * (n - 1)
        mean = n + pairs * s2
        variance = 4 * pairs * (n - 2) * (s3 - s2 * s2) + 2 * pairs * (s2 - s2 * s2)
        return mean, math.sqrt(max(variance, 1e-9))

    mean, sd = moments(*_language(name))
    flat_mean, flat_sd = moments(1 / k, 1 / (k * k))
    uniform_language, uniform_random = _tail((mean - squares) / sd), _tail((squares - flat_mean) / flat_sd)
    own = "".join(c for c in body if c.isalpha())
    if name != "hex" and len(own) >= LEAST // 2 and (own.islower() or own.isupper()):
        uniform_language = _likelihood(own.lower())
    # Runs of classes (upper, lower, digit, other): language keeps to a class, randomness changes as its shares say.
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in body]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    share = Counter("u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in alphabet)
    q = 1 - sum((v / k) ** 2 for v in share.values())
    spread = lambda p: math.sqrt(max((n - 1) * p * (1 - p), 1e-9))
    runs_language = _tail((changes - 0.5 - (n - 1) * CHANGES) / spread(CHANGES))
    runs_random = min(1.0, 2 * _tail((abs(changes - (n - 1) * q) - 0.5) / spread(q))) if q else 1.0
    # Serial correlation of character values: about normal with variance 1/n for random characters.
    serial = _serial([alphabet.find(c) for c in body])
    serial_random = min(1.0, 2 * _tail(abs((1.0 if serial is None else serial) + 1 / n) * math.sqrt(n)))
    language = _fisher(uniform_language, runs_language, *([] if name == "hex" else _alternation(body)))
    return language, min(1.0, 3 * min(uniform_random, runs_random, serial_random))


@functools.cache
def _written() -> tuple[dict[str, float], float, float]:
    """Of each letter, the log of its frequency in language over that at random (rare letters as RARE), its mean and variance in language."""
    total = sum(max(w, RARE) for w in LETTERS.values())
    p = {c: max(w, RARE) / total for c, w in LETTERS.items()}
    score = {c: math.log(26 * x) for c, x in p.items()}
    mean = sum(p[c] * score[c] for c in p)
    return score, mean, sum(p[c] * (score[c] - mean) ** 2 for c in p)


def _likelihood(low: str) -> float:
    """The p of language of letters by their likelihood under the table."""
    score, mean, variance = _written()
    return _tail((len(low) * mean - sum(score[c] for c in low)) / math.sqrt(len(low) * variance))


def letters(body: str) -> tuple[float, float]:
    """(p of language, p of randomness) of letters alone, whose case and class say little: language is told by letter frequencies."""
    low, n = body.lower(), len(body)
    language = _likelihood(low)
    squares, pairs, k = sum(c * c for c in Counter(low).values()), n * (n - 1), 1 / 26
    uniform = _tail((squares - n - pairs * k) / math.sqrt(2 * pairs * (k - k * k)))
    runs = 1.0
    if not (body.islower() or body.isupper()):
        changes = sum(a.isupper() != b.isupper() for a, b in zip(body, body[1:]))
        runs = min(1.0, 2 * _tail((abs(changes - (n - 1) / 2) - 0.5) / math.sqrt((n - 1) / 4)))
    serial = _serial([ord(c) - 97 for c in low])
    serial_random = min(1.0, 2 * _tail(abs((1.0 if serial is None else serial) + 1 / n) * math.sqrt(n)))
    return _fisher(language, *_alternation(low)), min(1.0, 3 * min(uniform, runs, serial_random))


def tested(token: str, fit: float = 0.001) -> tuple[float, float]:
    """The battery of a token, or of a part of LEAST or more between joiners or slashes that is random and less like language.

    The p of language is taken times the number of candidates. Letters alone are tested by `letters`.
    """
    body = token.rstrip("=")
    pieces = {token, *(x for joiners in ("[_-]", "/", "[_/-]") for x in re.split(joiners, body) if LEAST <= len(x) < len(body))}
    found = [letters(x.rstrip("=")) if x.rstrip("=").isalpha() else battery(x) for x in sorted(pieces)]
    random = [x for x in found if x[1] >= fit]
    language, best = min(random) if random else max(found, key=lambda x: x[1])
    return min(1.0, language * len(found)), best


def discoveries(p: list[float], lengths: list[int], rate: float) -> list[bool]:
    """Benjamini and Hochberg's step-up rule on p-values weighted by lengths (weights of mean 1)."""
    if not p:
        return []
    mean = sum(lengths) / len(lengths)
    weighted = [x / (n / mean) for x, n in zip(p, lengths, strict=True)]
    order = sorted(range(len(p)), key=lambda i: weighted[i])
    most = max((r for r, i in enumerate(order, 1) if weighted[i] <= rate * r / len(p)), default=0)
    found = [False] * len(p)
    for i in order[:most]:
        found[i] = True
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found, low = [], text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans(text: str, rate: float = 0.001, fit: float = 0.001) -> list[tuple[int, int, int]]:
    """Base spans and random tokens, by start, then kind. `rate`: false discoveries; `fit`: least p of randomness."""
    found = base_spans(text)
    # Base spans that start before a token's end overlap it if the farthest of their ends is beyond its start.
    starts, farthest = [s for s, _, _ in found], [*itertools.accumulate((e for _, _, e in found), max)]
    clear = lambda m: not (i := bisect.bisect_left(starts, m.end())) or farthest[i - 1] <= m.start()
    tokens = [m for m in TOKEN.finditer(text) if (len(m.group()) >= LEAST_DIGITS or not m.group().isdigit()) and clear(m)]
    if tokens:
        scores = [tested(m.group(), fit) for m in tokens]
        picked = discoveries([p for p, _ in scores], [len(m.group()) for m in tokens], rate)
        found += [(m.start(), 3, m.end()) for m, keep, (_, random) in zip(tokens, picked, scores, strict=True) if keep and random >= fit]
    return sorted(found)


def _said(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(batches: Iterable[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, docs in texts(batches):
        rows = [spans(t) for t in docs]
        base = [[s for s in r if s[1] < 3] for r in rows]
        counts = [[sum(s[1] == k for s in r) for r in base] for k in range(3)]
        hashes = [hashlib.sha256(_said(r).encode()).hexdigest() for r in base]
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(map(_said, rows), pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return src.mapInArrow(functools.partial(_scan, kind=to_arrow_type(kind)), schema).withColumnRenamed("id", id_col)


def _redact(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in parts(whole, at)):
        old = batch.column(at)
        new = pa.array([t if t is None else redacted(t, spans(t)) for t in (x.as_py() for x in old)], old.type)
        yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """`docs` with spans replaced by their kinds, all columns kept; `length_col`, if given, follows the texts' new lengths.

    A null text stays null. The length is changed only where the text is.
    """
    names = docs.columns
    out = docs.withColumn("__before", F.length(col(text_col))) if length_col else docs
    out = out.mapInArrow(functools.partial(_redact, at=names.index(text_col)), out.schema)
    if length_col:
        after = F.length(col(text_col))
        out = out.withColumn(length_col, F.when(after == F.col("__before"), col(length_col)).otherwise(after.cast(docs.schema[length_col].dataType))).drop("__before")
    return out.select(*map(col, names))
