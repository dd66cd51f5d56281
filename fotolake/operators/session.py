"""Selections, undo, recent lists, backups, carried settings, translated labels: small state as frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A backup's folder name.
STAMP = r"^\d{4}-\d{2}-\d{2} \d{6}$"
#: Settings that a new catalogue takes over are given by the caller; these are never.
SESSION_KEYS = ("session",)


def recent(uses: DataFrame, key: str, when: str, n: int = 8) -> DataFrame:
    """The `n` keys used last, one row each, by a bounded top-k."""
    return uses.groupBy(key).agg(F.max(when).alias(when)).orderBy(F.desc(when), key).limit(n)


def stale_backups(folders: DataFrame, keep: int = 5, within: str | None = None) -> DataFrame:
    """Backup folders (name) older than the newest `keep`, of each catalogue `within`; other names are never touched."""
    w = (Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))).orderBy(F.desc("name"))
    return folders.where(F.col("name").rlike(STAMP)).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") > keep).drop("__rn")


def carried(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Settings (key, value) of a catalogue with the listed keys of another put over them."""
    wanted = source.where(F.col("key").isin(*[k for k in keys if k not in SESSION_KEYS]))
    return target.join(wanted.select("key"), "key", "left_anti").select("key", "value").unionByName(wanted.select("key", "value"))


def at_step(history: DataFrame, pointers: DataFrame, move: int) -> DataFrame:
    """The history row (photo_id, id, ...) `move` steps from each photo's pointer (photo_id, pos; 0-based by id)."""
    w = Window.partitionBy("photo_id").orderBy("id")
    steps = history.withColumn("pos", F.row_number().over(w) - 1)
    return steps.join(pointers.select("photo_id", (F.col("pos") + move).alias("pos")), ["photo_id", "pos"])


def toggled(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """An ordered selection (id, seq) with each of `ids` (id, seq) taken out if in, else put at the end."""
    stay = selection.join(ids.select("id"), "id", "left_anti").select("id", "seq")
    top = selection.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))
    new = ids.join(selection.select("id"), "id", "left_anti").join(F.broadcast(top)).select("id", (F.col("top") + 1 + F.col("seq")).alias("seq"))
    return stay.unionByName(new)


def restored(saved: DataFrame, view: DataFrame, most: int = 5000) -> DataFrame:
    """A saved selection (id, seq) without ids that are not in view, the first `most` by place, then id."""
    return saved.join(view.select("id"), "id", "left_semi").orderBy("seq", "id").limit(most)


def stepped(view: DataFrame, current: DataFrame, delta: int) -> DataFrame:
    """(session, id): the row `delta` places from each session's current one in a ranked view (id, rank), clamped."""
    last = view.agg(F.max("rank").alias("last"))
    at = current.join(view, "id").join(F.broadcast(last)).select("session", F.greatest(F.lit(0), F.least(F.col("last"), F.col("rank") + delta)).alias("rank"))
    return at.join(view, "rank").select("session", "id")


def translated(labels: DataFrame, templates: dict[str, str]) -> DataFrame:
    """`labels` with `text`: labels that fit a template, values carried over; the template with
    the longest literal part wins, ties to the smaller source. Values are never empty; other labels stay as they are.

    Templates, of the program, map a source with {} for values to a target with {} or {0}, {1}; each is compiled into a column.
    """
    out: Column = F.col("label")
    for source, target in sorted(templates.items(), key=lambda r: (-len(r[0].replace("{}", "")), r[0]), reverse=True):
        pattern = "(?s)^" + "(.+?)".join(re.escape(p) for p in source.split("{}")) + "$"
        pieces = re.split(r"\{(\d*)\}", target)
        parts = [F.lit(pieces[0])]
        for i, (number, literal) in enumerate(zip(pieces[1::2], pieces[2::2], strict=True)):
            parts += [F.regexp_extract("label", pattern, (int(number) if number else i) + 1), F.lit(literal)]
        out = F.when(F.col("label").rlike(pattern), F.concat(*parts)).otherwise(out)
    return labels.withColumn("text", out)


def slider(label: Column, names: Column) -> Column:
    """`Name +0.65` with the name translated by a map column."""
    name = F.regexp_extract(label, r"^(.*) ([+-]?[0-9.]+)$", 1)
    value = F.regexp_extract(label, r"^(.*) ([+-]?[0-9.]+)$", 2)
    return F.when(F.try_element_at(names, name).isNotNull(), F.concat(F.try_element_at(names, name), F.lit(" "), value)).otherwise(label)
