"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document's tokens (its ids and an end id) are cut at every full window; full pieces are windows of their own. The
remaining pieces of a run of documents are packed together: multiway differencing merges partial partitions, largest
against smallest, so that opposing imbalances cancel and the windows come out nearly equal. If a window exceeds the
capacity, the window count rises and the run is packed again.

Runs follow the input's partitions, so packing needs no shuffle, and a task's memory is bounded by one run. Rows of a task
that is run again come out alike if its input comes in the same order, as a table read from storage does; write other
inputs first.

Nulls and ties: a null text counts as empty, which is one piece of the end id alone. Ids may be null or repeat; each row is
packed as a document of its own. An empty table gives an empty result. Pieces of equal length are taken in input order.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import string
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fotolake.llm.common import col, parts

#: Remainder pieces packed together; parts whose ids a worker keeps, in two generations of this number, about 75 MB together;
#: the longest part that is kept; parts the library is given in one text; rows and bytes of texts encoded together.
RUN, CACHE, LONGEST, JOINED, BATCH, CHARS = 1024, 250_000, 64, 1000, 4096, 2_000_000

#: Signs that are cut off the end of letters, at most so many, and how many such ends are kept.
SIGNS, MOST_SIGNS, MOST_TAILS = string.punctuation, 8, 10_000

#: The letters that stand for bytes in byte-level BPE files; the bytes that stand for themselves come first.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = np.zeros(256, "<u4")
LETTERS[PLAIN_BYTES] = PLAIN_BYTES
LETTERS[LETTERS == 0] = 256 + np.arange(256 - len(PLAIN_BYTES))


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, by a tokenizer file of the tokenizers library.

    A byte-level file starts a word at each space that no white space precedes, so a text can be cut there and the parts
    encoded apart. Parts repeat: the distinct ones of a batch are looked up, and the unknown ones go to the library joined by
    spaces, many in a text; each id stands for a known number of bytes, which tells the parts apart again. A space and letters
    are one word, so such parts go to the file's model at once, and signs after letters are a word of their own. A text's
    first part, other files, and texts that hold one of the file's added tokens (such as an end mark) or white space next to
    a space go to the library as they are.
    """

    def __init__(self, path: str, kept: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept or CACHE
        form = json.loads(self.tokenizer.to_str())
        pre = form["pre_tokenizer"] or {}
        self.added = [t["content"] for t in form["added_tokens"]]
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.apart = self.apart and not any(form[k] for k in ("normalizer", "truncation", "padding")) and not any(" " in t for t in self.added)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.bytes[list(vocab.values())] = [len(t) for t in vocab]  # a letter a byte
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        return next(self.many(pa.array([text], pa.string())))

    def whole(self, text: str, by=None) -> np.ndarray:
        return np.array((by or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def keep(self, part: str, ids: bytes) -> None:
        if len(self.new) >= self.kept:
            self.old, self.new = self.new, {}
        self.new[part] = ids

    def tail(self, signs: str) -> bytes:
        if signs not in self.tails:
            if len(self.tails) >= MOST_TAILS:
                self.tails.clear()
            self.tails[signs] = self.whole(signs).tobytes()
        return self.tails[signs]

    def learn(self, parts: list[str], letters: bool) -> list[bytes]:
        """The ids of a space and each part, all of letters or not; no part is empty or ends in white space."""
        out = []
        for at in range(0, len(parts), JOINED):
            some = parts[at : at + JOINED]
            text = " " + " ".join(some)
            raw = np.frombuffer(text.encode(), "u1")
            starts = np.flatnonzero(raw == 32)
            if letters:
                ids = self.whole(np.insert(LETTERS[raw], starts[1:], 32).tobytes().decode("utf-32-le"), self.model)
            else:
                ids = self.whole(text)
            want, ends = np.append(starts[1:], len(raw)), np.cumsum(self.bytes[ids])
            cuts = np.searchsorted(ends, want)
            if ends[-1:].tolist() != [len(raw)] or not np.array_equal(ends[cuts], want):  # a file whose ids do not stand for bytes
                out += [self.whole(" " + p).tobytes() for p in some]
                continue
            flat, stops = ids.tobytes(), (4 * (cuts + 1)).tolist()
            out += [flat[i:j] for i, j in zip([0, *stops], stops)]
        for part, ids in zip(parts, out, strict=True):
            if len(part) <= LONGEST:
                self.keep(part, ids)
        return out

    def found(self, words: list[str], needed: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The ids of a space and each needed word; which of them cannot be cut off because they are empty or end in white space."""
        values, bad = list(map(self.new.get, words)), np.zeros(len(words), bool)
        letters, others, ended = [], [], []  # places of words: of letters alone, any other, and letters with signs after them
        for i in np.flatnonzero(needed & np.array([ids is None for ids in values], bool)).tolist():
            word = words[i]
            if (ids := self.old.get(word)) is not None:
                values[i] = ids
                self.keep(word, ids)
            elif word.isalpha():
                letters.append(i)
            elif (stem := word.rstrip(SIGNS)).isalpha() and len(word) - len(stem) <= MOST_SIGNS:
                ended.append((i, stem))
            elif not word or word[-1].isspace():
                bad[i] = True
            else:
                others.append(i)
        for group, known in ((letters, True), (others, False)):
            for i, ids in zip(group, self.learn([words[i] for i in group], known), strict=True):
                values[i] = ids
        stems = {stem: self.new.get(stem) or self.old.get(stem) for _, stem in ended}
        unknown = [stem for stem, ids in stems.items() if ids is None]
        stems.update(zip(unknown, self.learn(unknown, True), strict=True))
        for i, stem in ended:
            values[i] = ids = stems[stem] + self.tail(words[i][len(stem) :])
            if len(words[i]) <= LONGEST:
                self.keep(words[i], ids)
        return [ids or b"" for ids in values], bad

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; there are no nulls."""
        if not self.apart:
            yield from (self.whole(t).tobytes() for t in texts.to_pylist())
            return
        if not len(texts):
            return
        odd = np.zeros(len(texts), bool)
        for mark in self.added:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        listed = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        words = pc.binary_join(listed, pa.scalar(" ", coded.dictionary.type))[0].as_py().split(" ")  # faster than one by one
        count = pc.list_value_length(split).to_numpy().astype(np.int64)
        first = np.cumsum(count) - count
        last = first + count - 1

        needed, inner = np.zeros(len(words), bool), np.ones(len(code), bool)
        inner[first] = False
        needed[code[inner]] = True
        values, bad = self.found(words, needed)
        uncut = bad[code]
        spoilt = uncut.copy()
        spoilt[last] = False
        spoilt[first] = np.array([w[-1:].isspace() for w in words], bool)[code[first]]
        odd |= (count == 1) | np.logical_or.reduceat(spoilt, first)

        # The first place of a text stands for its first part or, if it cannot be cut, for the whole; so do some last parts.
        heads = [text.as_py() if o else words[c] for text, o, c in zip(texts, odd.tolist(), code[first].tolist(), strict=True)]
        tails = last[uncut[last] & ~odd]
        values += [self.whole(t).tobytes() for t in [*heads, *(" " + words[c] for c in code[tails].tolist())]]
        code[first] = len(words) + np.arange(len(first))
        code[tails] = len(words) + len(first) + np.arange(len(tails))
        kept = ~np.repeat(odd, count)
        kept[first] = True
        code = code[kept]

        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        size, start = sizes[code], (np.cumsum(sizes) - sizes)[code]
        ends = np.cumsum(size)
        ids = np.frombuffer(b"".join(values), "<u4")[np.repeat(start - ends + size, size) + np.arange(ends[-1])]
        stops = ends[np.cumsum(np.where(odd, 1, count)) - 1].tolist()
        for i, j in zip([0, *stops], stops):
            yield ids[i:j].tobytes()


@functools.lru_cache(2)
def encoder(path: str, kept: int | None = None) -> Encoder:
    """The encoder of a file, kept while the Python worker lives, so that later tasks find the parts of earlier ones."""
    return Encoder(path, kept)


def differencing(sizes: list[int], k: int) -> list[int]:
    """The window, 0 to k - 1, of each size: Karmarkar-Karp differencing into k windows."""
    # A node is (its windows' sums, descending and less their least; left, right; for each window its place in left and right).
    n = len(sizes)
    nodes: list[tuple | None] = [None] * n
    sums: list[np.ndarray] = []
    heap = []
    for i, s in enumerate(sizes):
        start = np.zeros(k, np.int64)
        start[0] = s
        sums.append(start)
        heap.append((-(s if k > 1 else 0), i))
    heapq.heapify(heap)
    back = np.arange(k - 1, -1, -1)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        nodes.append((a, b, order, back[order]))
        sums[a] = sums[b] = None
        sums.append(both)
        heapq.heappush(heap, (-int(both[0]), len(nodes) - 1))
    window = [0] * n
    stack = [(heap[0][1], np.arange(k))] if heap else []
    while stack:
        i, final = stack.pop()
        if i < n:
            window[i] = int(final[0])
            continue
        a, b, left, right = nodes[i]
        for child, place in ((a, left), (b, right)):
            own = np.empty(k, np.int64)
            own[place] = final
            stack.append((child, own))
    return window


def windows(sizes: list[int], capacity: int) -> list[int]:
    """The window of each size (each at most `capacity`); the count rises until every window holds."""
    total, k = sum(sizes), 0
    while True:
        k = max(k + 1, -(-total // capacity))
        window = differencing(sizes, k)
        most = int(np.bincount(window, weights=sizes, minlength=k).max()) if sizes else 0
        if most <= capacity:
            return window
        k += max(k // 100, (most - capacity) * k // (4 * capacity))


def _run(pieces: list[tuple], capacity: int, first: int) -> tuple[list[tuple], int]:
    at = windows([p[2] for p in pieces], capacity)
    names, fill, out = {}, {}, []
    for piece, w in zip(pieces, at, strict=True):
        seq = names.setdefault(w, first + len(names))
        out.append((*piece, seq, fill.get(seq, 0)))
        fill[seq] = fill.get(seq, 0) + piece[2]
    return out, first + len(names)


def _pack(batches: Iterable[pa.RecordBatch], path: str, capacity: int, end_id: int, kind: pa.DataType, keep_ids: bool, kept: int = CACHE, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    seq = (context.partitionId() if context else 0) << 40
    encode, end, waiting = encoder(path, kept), np.array([end_id], "<u4").tobytes(), []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
        arrays = [pa.array([np.frombuffer(x, "<i4") for x in c] if t == types[5] else c, t) for c, t in zip(cols, types, strict=True) if t != types[5] or keep_ids]
        return pa.RecordBatch.from_arrays(arrays, [c for c in COLUMNS if c != "ids" or keep_ids])

    for some in (x for b in batches for x in parts(b, 1, BATCH, chars)):
        ready = []
        for doc, tokens in zip(some.column(0).to_pylist(), encode.many(some.column(1).fill_null("")), strict=True):
            tokens += end
            total = len(tokens) // 4
            for start in range(0, total, capacity):
                part = tokens[4 * start : 4 * (start + capacity)]
                piece = (doc, start, len(part) // 4, zlib.crc32(part), total, part if keep_ids else None)
                if piece[2] == capacity:
                    ready.append((*piece, seq, 0))
                    seq += 1
                else:
                    waiting.append(piece)
            if len(waiting) >= RUN:
                rows, seq = _run(waiting, capacity, seq)
                ready += rows
                waiting = []
        if ready:
            yield batch(ready)
    if waiting:
        yield batch(_run(waiting, capacity, seq)[0])


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, keep_ids: bool = False, kept: int = CACHE, chars: int = CHARS) -> DataFrame:
    """A row for each piece: (id_col, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset).

    `kept` parts in two generations and texts of `chars` bytes at once are what a worker holds; more is faster, the rows are the same.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType
    fields = [T.StructField(c, id_type if c == "doc_id" else T.ArrayType(T.IntegerType()) if c == "ids" else T.LongType()) for c in COLUMNS if c != "ids" or keep_ids]
    run = functools.partial(_pack, path=tokenizer_path, capacity=capacity, end_id=end_id, kind=to_arrow_type(id_type), keep_ids=keep_ids, kept=kept, chars=chars)
    return src.mapInArrow(run, T.StructType(fields)).withColumnRenamed("doc_id", id_col)
