"""Lua table literals: parsed to plain values, to JSON, to smart rules and to develop settings."""

from __future__ import annotations

import json
import math
import re

from fotolake.operators.predicates import Rule, Rules

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--\[\[.*?\]\]|--[^\n]*)|(?P<number>-?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))|(?P<long>\[(?P<eq>=*)\[\n?(?P<body>.*?)\](?P=eq)\])|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<sign>[{}=,;\[\]])""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\n": "\n"}


class LuaError(ValueError):
    pass


def _tokens(source: str):
    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise LuaError(f"unreadable at {at}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup not in ("eq", "body") else "long"
        if m["skip"] is not None:
            continue
        if m["long"] is not None:
            yield "value", m["body"]
        elif kind == "number":
            yield "value", float(int(m["number"], 16)) if "x" in m["number"].lower() else float(m["number"])
        elif kind == "text":
            yield "value", re.sub(r"\\(\d{1,3}|.)", lambda e: chr(int(e[1])) if e[1].isdigit() else _ESCAPES.get(e[1], e[1]), m["text"][1:-1], flags=re.S)
        else:
            yield kind, m[0]


def parse(source: str) -> list:
    """A table as a list of (key or None, value); tables nest. A leading `name =` or `return` is skipped."""
    tokens = list(_tokens(source))
    at = 0
    while at < len(tokens) and tokens[at] != ("sign", "{"):
        at += 1
    if at == len(tokens):
        raise LuaError("no table")
    stack: list[tuple[list, str | None]] = []
    table: list = []
    key: str | None = None
    at += 1
    while at < len(tokens):
        kind, value = tokens[at]
        after = tokens[at + 1] if at + 1 < len(tokens) else None
        if kind == "sign" and value == "}":
            if not stack:
                return table
            done, (table, key) = table, stack.pop()
            table.append((key, done))
            key = None
        elif kind == "sign" and value == "{":
            stack.append((table, key))
            table, key = [], None
        elif kind == "sign" and value == "[":
            if at + 3 >= len(tokens) or tokens[at + 2] != ("sign", "]") or tokens[at + 3] != ("sign", "="):
                raise LuaError("bad key")
            k = tokens[at + 1][1]
            key = f"{k:g}" if isinstance(k, float) else k
            at += 3
        elif kind == "name" and after == ("sign", "="):
            key = value
            at += 1
        elif kind in ("value", "name"):
            table.append((key, {"true": True, "false": False, "nil": None}.get(value, value) if kind == "name" else value))
            key = None
        at += 1
    raise LuaError("table not closed")


def plain(table: list):
    """A parsed table as JSON values: a list if no key is named, else an object (unnamed items by their number)."""
    if not isinstance(table, list):
        return int(table) if isinstance(table, float) and table.is_integer() else table
    if all(k is None for k, _ in table):
        return [plain(v) for _, v in table]
    count = iter(range(1, len(table) + 1))
    return {k if k is not None else str(next(count)): plain(v) for k, v in table}


def to_json(source: str | None) -> str | None:
    """JSON text of a Lua table; null if it does not parse."""
    try:
        return None if source is None else json.dumps(plain(parse(source)), ensure_ascii=False)
    except LuaError:
        return None


#: Words of a label text in English, Korean, German and French, by label number; the first hit counts.
LABEL_WORDS = ((1, ("red", "빨", "rot", "rouge")), (2, ("yellow", "노", "gelb", "jaune")), (3, ("green", "녹", "초록", "grün", "vert")), (4, ("blue", "파", "blau", "bleu")), (5, ("purple", "자주", "보라", "lila", "violet")))
UNIT_DAYS = {"hours": 1 / 24, "days": 1, "weeks": 7, "months": 30, "years": 365}
UP, DOWN = (">", ">="), ("<", "<=")


def label_number(s: str) -> int:
    low = s.lower()
    return next((n for n, words in LABEL_WORDS if any(w in low for w in words)), 0)


def _text(v) -> str:
    return "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)


def smart_rules(source: str, strict: bool = False) -> tuple[Rules, list[str]]:
    """Rules of a foreign smart collection, and warnings of what is left out.

    Lossy cases are kept: `>` on a rating of 5 means at least 5, `==` on ratings is two rules, `>` on ISO and focal length
    is at least. With `strict` each of them, and negative text operators, is warned of as well.
    """
    try:
        items = parse(source)
    except LuaError:
        return Rules(()), []
    top = {k: v for k, v in items if k is not None}
    rules: list[Rule] = []
    warnings: list[str] = []

    def warn(message: str) -> None:
        if message not in warnings:
            warnings.append(message)

    for key, item in items:
        if key is not None:
            continue
        f = dict(item) if isinstance(item, list) else {}
        name, op, raw = _text(f.get("criteria")), _text(f.get("operation")), f.get("value")
        number = raw if isinstance(raw, float) else 0.0
        text = _text(raw)
        made = _rules_of(name, op, raw, number, text, f)
        if not made:
            warn(f"{name} {op} is not supported")
        elif strict and (op in (">", "<") and name in ("rating", "isoSpeedRating", "focalLength") or op in ("noneOf", "!=", "notEqual")):
            warn(f"{name} {op} is read as a wider rule")
        rules += made
    return Rules(tuple(rules), match_all=top.get("combine", "intersect") != "union"), warnings


def _rules_of(name: str, op: str, raw, number: float, text: str, f: dict) -> list[Rule]:
    whole = int(number)
    if name == "rating":
        if op in UP:
            return [Rule("rating_at_least", min(5, whole + (op == ">")))]
        if op in DOWN:
            return [Rule("rating_at_most", max(0, min(5, whole - (op == "<"))))]
        return [Rule("rating_at_least", whole), Rule("rating_at_most", whole)] if op == "==" else []
    if name == "pick":
        return [Rule("flag_is", whole if whole in (1, -1) else 0)]
    if name in ("labelColor", "labelText"):
        return [Rule("label_is", (whole if 0 <= whole <= 5 else 0) if name == "labelColor" and isinstance(raw, float) else label_number(text))]
    if name == "keywords":
        return [Rule("has_keywords", op == "notEmpty") if op in ("empty", "notEmpty") else Rule("keyword_contains", text)]
    if name in ("captureTime", "touchTime") and op == "inLast":
        days = max(1, math.ceil(number * UNIT_DAYS.get(_text(f.get("value_units")) or "days", 1)))
        return [Rule("captured_within_days" if name == "captureTime" else "edited_within_days", days)]
    if name == "captureTime":
        return [Rule("captured_after", text)] if op in (*UP, "after") else [Rule("captured_before", text)] if op in (*DOWN, "before") else []
    if name in ("hasAdjustments", "developPreset"):
        return [Rule("has_edits", raw if isinstance(raw, bool) else number != 0)]
    if name in ("isoSpeedRating", "focalLength"):
        kind, value = ("iso", whole) if name == "isoSpeedRating" else ("focal", number)
        return [Rule(f"{kind}_at_least", value)] if op in UP else [Rule(f"{kind}_at_most", value)] if op in DOWN else []
    kinds = {"allText": "text_contains", "filename": "text_contains", "title": "text_contains", "caption": "text_contains", "camera": "camera_contains", "cameraModel": "camera_contains", "lens": "lens_contains", "fileFormat": "file_type_is", "folder": "in_folder"}
    return [Rule(kinds[name], text)] if name in kinds else []
