"""Faces and people: similarity, grouping, covers, merges. The similarity threshold is always a parameter."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.functions.vector import dot, norm
from fotolake.operators.views import numbered

NEW_BASE = 1 << 40  # temporary ids of new people start here
BLOCK = 2000  # centroids in one array
BOXES = 512  # boxes compared at once


def centroids(faces: DataFrame) -> DataFrame:
    """(person, centroid): the unit sum of a known person's embeddings, summed component by component."""
    parts = faces.where("person > 0").select("person", F.posexplode("emb").alias("i", "x"))
    sums = parts.groupBy("person", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    c = sums.groupBy("person").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v")).withColumn("v", F.col("v.s"))
    length = F.greatest(norm(F.col("v")), F.lit(1e-6))
    return c.select("person", F.transform("v", lambda x: x / length).alias("centroid"))


def assign_known(faces: DataFrame, threshold: float) -> DataFrame:
    """(face_id, person, similarity) of unassigned faces near a known person; the nearest, ties to the smaller id.

    Centroids go to the faces in arrays of at most BLOCK: one is broadcast; more, counted first, are joined by block number,
    each face meeting each block once.
    """
    known = centroids(faces)
    n = known.count()
    blocks = max(1, -(-n // BLOCK))
    people = known.withColumn("block", F.pmod(F.xxhash64("person"), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("person", "centroid")).alias("people"))
    loose = faces.where("person = 0").select("face_id", "emb").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = loose.join(F.broadcast(people) if blocks == 1 else people, "block")
    near = F.array_max(F.transform("people", lambda p: F.struct(dot(F.col("emb"), p["centroid"]).alias("s"), (-p["person"]).alias("p"))))
    best = met.select("face_id", near.alias("x")).groupBy("face_id").agg(F.max("x").alias("b"))
    return best.where(F.col("b.s") >= threshold).select("face_id", (-F.col("b.p")).alias("person"), F.col("b.s").alias("similarity"))


def _lead(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["score", "face_id"], ascending=[False, True])
    vectors = np.stack(pdf["emb"].to_numpy()).astype(np.float64) if len(pdf) else np.empty((0, 1))
    sums, groups = np.empty_like(vectors), []
    for v, face in zip(vectors, pdf["face_id"], strict=True):
        k = len(groups)
        near = sums[:k] @ v / np.maximum(np.linalg.norm(sums[:k], axis=1), 1e-6) if k else np.empty(0)
        if k and near.max() >= threshold:
            at = int(near.argmax())
            sums[at] += v
            groups[at].append(face)
        else:
            sums[k] = v
            groups.append([face])
    rows = [(f, NEW_BASE + i) for i, g in enumerate(g for g in groups if len(g) > 1) for f in g]
    return pd.DataFrame(rows, columns=["face_id", "person"]).astype("int64")


def lead_groups(faces: DataFrame, threshold: float, within: str) -> DataFrame:
    """(face_id, person) of new groups among `faces`: leaders in descending score, groups of two or more.

    The rule depends on order, so the faces of one value of `within` (an event, a folder) are one task, whose memory they must
    fit. Temporary person ids count from NEW_BASE on in each.
    """
    return faces.select(F.col(within).alias("g"), "face_id", "score", "emb").groupBy("g").applyInPandas(lambda pdf: _lead(pdf, threshold), "face_id long, person long")


def apply_groups(faces: DataFrame, persons: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces and persons after changes (face_id, person); temporary ids become new persons, empty persons go."""
    new = changes.where(F.col("person") >= NEW_BASE).select("person").distinct()
    top = persons.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ids = numbered(new, [F.col("person")], "k").join(F.broadcast(top)).select("person", (F.col("top") + 1 + F.col("k")).alias("new_id"))  # top is a row
    mapped = changes.join(ids, "person", "left").select("face_id", F.coalesce("new_id", "person").alias("__p"))
    faces = faces.join(mapped, "face_id", "left").withColumn("person", F.coalesce("__p", "person")).drop("__p")
    people = persons.unionByName(ids.select(F.col("new_id").alias("id"), F.lit("").alias("name")))
    return faces, drop_empty(people, faces)


def drop_empty(persons: DataFrame, faces: DataFrame) -> DataFrame:
    return persons.join(faces.select(F.col("person").alias("id")), "id", "left_semi")


def covers(faces: DataFrame) -> DataFrame:
    """(person, face_id): the face largest in width times score; ties to the larger id."""
    best = F.max(F.struct((F.col("w") * F.col("score")).alias("k"), "face_id"))
    return faces.where("person > 0").groupBy("person").agg(best["face_id"].alias("face_id"))


def people_list(faces: DataFrame) -> DataFrame:
    """(person, photos, faces) of each known person."""
    return faces.where("person > 0").groupBy("person").agg(F.countDistinct("photo_id").alias("photos"), F.count("*").alias("faces"))


def merge(faces: DataFrame, old: int, into: int) -> DataFrame:
    return faces.withColumn("person", F.when(F.col("person") == old, into).otherwise(F.col("person")))


def iou(a, b):
    """Intersection over union of boxes as struct columns (x, y, w, h)."""
    x = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0.0))
    y = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0.0))
    both = x * y
    return both / F.greatest(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(1e-6))


def _clash(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Which boxes of `a` and of `b` (x, y, w, h) overlap by `most` or more."""
    a, b = a[:, None, :], b[None, :, :]
    both = np.maximum(0, np.minimum(a[..., 0] + a[..., 2], b[..., 0] + b[..., 2]) - np.maximum(a[..., 0], b[..., 0])) * np.maximum(0, np.minimum(a[..., 1] + a[..., 3], b[..., 1] + b[..., 3]) - np.maximum(a[..., 1], b[..., 1]))
    return ~(both / np.maximum(a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - both, 1e-6) < most)


def _kept(box: np.ndarray, most: float) -> np.ndarray:
    """Which of a photo's boxes, best first, stay: blocks of BOXES meet the kept ones of earlier blocks, then each other."""
    kept = np.ones(len(box), bool)
    for at in range(0, len(box), BOXES):
        here, stay = box[at : at + BOXES], kept[at : at + BOXES]
        for before in range(0, at, BOXES):
            stay &= ~_clash(here, box[before : before + BOXES][kept[before : before + BOXES]], most).any(1)
        clash = np.triu(_clash(here, here, most), 1)
        for i in np.flatnonzero(clash.any(1)):  # boxes that clash with a later one
            if stay[i]:
                stay[clash[i]] = False
    return kept


def _runs(ids: pa.Array) -> np.ndarray:
    """Numbers that rise by one where the id changes; nulls are equal."""
    codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])]) if len(codes) else codes


def _suppress(batches: Iterable[pa.RecordBatch], most: float) -> Iterator[pa.RecordBatch]:
    """Batches in order of photos, best boxes first; a photo that goes on in the next batch waits for it."""
    waiting: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        photo = _runs(table.column("photo_id").combine_chunks())
        box = np.column_stack([table.column(c).to_numpy().astype(float) for c in "xywh"])
        edges = [0, *(np.flatnonzero(photo[1:] != photo[:-1]) + 1), len(photo)] if len(photo) else [0]
        keep = np.concatenate([_kept(box[a:b], most) for a, b in zip(edges[:-1], edges[1:], strict=True)]) if len(photo) else np.ones(0, bool)
        yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        photo = batch.column("photo_id")
        runs = _runs(photo)
        last = int(np.searchsorted(runs, runs[-1]))
        if last or (waiting and waiting[-1].column("photo_id")[-1].as_py() != photo[0].as_py()):
            yield from done(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield from done(pa.Table.from_batches(waiting))


def suppress(detections: DataFrame, most: float = 0.3) -> DataFrame:
    """Greedy non-maximum suppression within each photo (photo_id, det_id, x, y, w, h, score)."""
    ordered = detections.repartition("photo_id").sortWithinPartitions("photo_id", F.desc("score"), "det_id")
    return ordered.mapInArrow(functools.partial(_suppress, most=most), detections.schema)
