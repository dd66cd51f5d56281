"""Tags of image files as rows: (photo, ext, dir, nr, tag, values), by a walk over the directories in their first bytes.

A directory is known by what points to it: a header, a maker's signature, or a tag of another directory. Only the tags of WANTED are
decoded; what they mean is left to relational rules (`operators.embedded`). Damaged directories end where they are damaged.
The walk runs Arrow-batched, a file at a time; rows carry values only, never the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats. Signatures: (dir, bytes, where the base is, where the directory is from there or None for a header, byte order).
SIGNED = [
    ("olympus", b"OLYMPUS\0", 0, 12, 8),
    ("olympus", b"OM SYSTEM\0", 0, 16, 12),
    ("panasonic", b"Panasonic\0\0\0", 0, 12, "II"),
    ("nikon", b"Nikon\0\x02", 10, None, None),
    ("canon", b"CMT3", 4, None, None),
]
#: Tags that point to directories.
POINTERS = {("root", 0x14A): "raw", ("root", 0x8769): "exif", ("exif", 0x927C): "canon", ("olympus", 0x2040): "processing", ("olympus", 0x2020): "settings", ("cfa", 0xF000): "fuji"}
#: Tags to decode: by their own type, or as signed numbers of 2 or 4 bytes, a list of operations, or a block with a directory of its own.
WANTED = {
    ("raw", 0x7037): "own", ("raw", 0x7035): "own", ("raw", 0x7032): "own", ("raw", 0x74C8): "own",
    ("fuji", 0xF00B): "own", ("fuji", 0xF00F): "own", ("fuji", 0xF010): "own",
    ("fujinote", 0x1403): "own", ("fujinote", 0x140B): "own", ("fujinote", 0x1444): "own", ("fujinote", 0x1445): "own",
    ("processing", 0x150A): "own", ("processing", 0x150C): "own", ("processing", 0x1113): "own", ("settings", 0x050C): "own",
    ("panasonic", 0x008A): "own", ("root", 0x0119): "i16", ("root", 0x2F): "own", ("root", 0x30): "own", ("root", 0x31): "own", ("root", 0x32): "own",
    ("root", 0xC74E): "ops", ("raw", 0xC74E): "ops", ("root", 0xC7B5): "own", ("raw", 0xC7B5): "own",
    ("raw", 0xC7D5): "block", ("lens", 0x05): "i32", ("lens", 0x06): "i32", ("nikon", 0x002A): "own", ("nikon", 0x1B): "own",
    ("canon", 0x9A): "own", ("canon", 0x4018): "own",
}
#: Types of numbers: struct code and bytes; 5 and 10 are quotients.
TYPES = {3: ("H", 2), 8: ("h", 2), 4: ("I", 4), 9: ("i", 4), 5: ("I", 8), 10: ("i", 8), 11: ("f", 4), 12: ("d", 8)}
SCHEMA = "dir string, nr int, tag int, values array<double>"
HEAD = 16 << 20
#: Rows after which a batch is passed on.
ROWS = 4096


class Walk:
    def __init__(self, data: bytes) -> None:
        self.data, self.rows, self.seen = data, [], set()

    def get(self, code: str, at: int, order: str) -> tuple:
        return struct.unpack_from(order + code, self.data, at)

    def numbers(self, kind: int, n: int, at: int, order: str) -> list[float] | None:
        if kind not in TYPES or n > 100_000:
            return None
        code, size = TYPES[kind]
        got = self.get(f"{n * (2 if kind in (5, 10) else 1)}{code}", at, order)
        if kind in (5, 10):
            return [a / b if b else 0.0 for a, b in zip(got[::2], got[1::2], strict=True)]
        return [float(x) for x in got]

    def header(self, name: str, nr: int, base: int) -> None:
        order = {b"II": "<", b"MM": ">"}.get(self.data[base : base + 2])
        if order:
            self.directory(name, nr, base, self.get("I", base + 4, order)[0], order)

    def directory(self, name: str, nr: int, base: int, at: int, order: str) -> None:
        if (name, base, at) in self.seen:
            return
        self.seen.add((name, base, at))
        for i in range(min(self.get("H", base + at, order)[0], 1000)):
            entry = base + at + 2 + 12 * i
            tag, kind, n = self.get("HHI", entry, order)
            size = n * {1: 1, 2: 1, 6: 1, 7: 1, 3: 2, 8: 2, 4: 4, 9: 4, 11: 4, 13: 4}.get(kind, 8)
            place = entry + 8 if size <= 4 else base + self.get("I", entry + 8, order)[0]
            try:
                self.entry(name, nr, base, tag, kind, n, size, place, order)
            except struct.error:  # beyond the file's end
                continue

    def entry(self, name: str, nr: int, base: int, tag: int, kind: int, n: int, size: int, place: int, order: str) -> None:
        to, how = POINTERS.get((name, tag)), WANTED.get((name, tag))
        if to == "canon":  # the note stands where its bytes are pointed to
            self.directory(to, 0, base, place - base, order)
        elif to:
            inside = self.numbers(kind, n, place, order) if kind in (4, 9) else [self.get("I", place, order)[0]]
            for j, target in enumerate(inside or []):
                try:
                    self.directory(to, j, base, int(target), order)
                except struct.error:
                    continue
        if how == "own":
            self.add(name, nr, tag, self.numbers(kind, n, place, order))
        elif how in ("i16", "i32"):
            width = int(how[1:]) // 8
            self.add(name, nr, tag, [float(size), *map(float, self.get(f"{size // width}{'h' if width == 2 else 'i'}", place, order))])
            if how == "i32":  # the fifth byte is a switch
                self.add(name, nr, tag | 1 << 16, [float(self.data[place + 4])])
        elif how == "ops":
            self.operations(nr, place, size)
        elif how == "block" and self.data[place : place + 6] == b"Nikon\0":
            self.header("lens", nr, place + 10)

    def operations(self, nr: int, at: int, size: int) -> None:
        """Each operation is a row of directory `ops`, its numbers big-endian doubles (after the number of planes, of which three count)."""
        end, place = at + size, at + 4
        for i in range(min(self.get("I", at, ">")[0], 64)):
            if place + 16 > end:
                return
            code, _, _, length = self.get("IIII", place, ">")
            body = place + 16
            if code == 1:
                planes = min(self.get("I", body, ">")[0], 3)
                self.add("ops", nr * 64 + i, 1, [x for k in range(planes) for x in self.get("4d", body + 4 + 48 * k, ">")])
            elif code == 3:
                self.add("ops", nr * 64 + i, 3, list(self.get("5d", body, ">")))
            place = body + length

    def add(self, name: str, nr: int, tag: int, values: list[float] | None) -> None:
        if values is not None:
            self.rows.append((name, nr, tag, values))


def tags_of(data: bytes, ext: str) -> list[tuple]:
    """(dir, nr, tag, values) of one file's bytes."""
    walk = Walk(data)

    def tried(f, *args) -> None:
        try:
            f(*args)
        except struct.error:
            pass

    tried(walk.header, "root", 0, 0)
    if ext == "raf":
        tried(lambda: walk.header("cfa", 0, walk.get("I", 100, ">")[0]))
        tried(_raf_header, walk)
        at = data.find(b"FUJIFILM", 100)
        while at >= 0:
            offset = walk.get("I", at + 8, "<")[0] if at + 12 <= len(data) else 0
            if 9 <= offset < 64:
                tried(walk.directory, "fujinote", 0, at, offset, "<")
                break
            at = data.find(b"FUJIFILM", at + 8)
    for name, sign, base, place, order in SIGNED:
        at = data.find(sign)
        if at < 0 or (name == "olympus" and sign != SIGNED[0][1] and SIGNED[0][1] in data):
            continue
        if place is None:
            tried(walk.header, name, 0, at + base)
        else:
            mark = order.encode() if isinstance(order, str) else data[at + order : at + order + 2]
            if mark in (b"II", b"MM"):
                tried(walk.directory, name, 0, at, place, "<" if mark == b"II" else ">")
    return walk.rows


def _raf_header(walk: Walk) -> None:
    """The aspect entry of a header directory whose entries are (tag, size, bytes)."""
    at = walk.get("I", 92, ">")[0]
    place = at + 4
    for _ in range(min(walk.get("I", at, ">")[0], 256)):
        tag, size = walk.get("HH", place, ">")
        if tag == 0x115 and size == 4:
            walk.add("header", 0, tag, [float(x) for x in walk.get("HH", place + 4, ">")])
        place += 4 + size


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _rows(batches: Iterable[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["photo", "ext", "dir", "nr", "tag", "values"]
    types = [kind, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    for batch in batches:
        rows: list[tuple] = []
        for photo, ext, content in zip(*batch.columns, strict=True):
            photo, ext = photo.as_py(), ext.as_py()
            rows += [(photo, ext, *found) for found in tags_of(content.as_py() or b"", ext or "")]
            if len(rows) >= ROWS:
                yield _batch(rows, names, types)
                rows = []
        if rows:
            yield _batch(rows, names, types)


def tag_rows(files: DataFrame, photo: str = "photo", content: str = "content", ext: Column | None = None) -> DataFrame:
    """(photo, ext, dir, nr, tag, values) of files (photo, content and `ext`, the lower-case extension)."""
    import functools

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    src = files.select(F.col(photo).alias("photo"), (F.col("ext") if ext is None else ext).alias("ext"), F.substring(content, 1, HEAD).alias("content"))
    schema = StructType([StructField("photo", src.schema["photo"].dataType), *_parse_datatype_string("ext string, " + SCHEMA).fields])
    return src.mapInArrow(functools.partial(_rows, kind=to_arrow_type(src.schema["photo"].dataType)), schema)


def read(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Tag rows of the files below a path; photo is the file's path."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=pattern).load(path)
    return tag_rows(files, "path", "content", F.lower(F.element_at(F.split("path", r"\."), -1)))
