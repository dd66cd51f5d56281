"""The catalogue's own tables: declared shapes, ordered loads, and each change by name.

A table may lack columns that later versions added: they are read with their defaults. New rows get ids after the largest, in the
order given, by a ranked sort that no task holds whole. Time is a parameter. Every change returns new frames.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotolake.functions.settings import GROUPS, SECTIONS, copy_groups
from fotolake.operators.catalog import keep_newest, removal_closure, set_where, upsert, without
from fotolake.operators.people import drop_empty
from fotolake.operators.views import numbered

#: Fixed names, types and defaults (SQL) of the stored tables.
TABLES = {
    "photos": {"id": ("long", None), "path": ("string", None), "file_size": ("long", "0"), "meta": ("string", "'{}'"), "rating": ("int", "0"), "flag": ("int", "0"), "label": ("int", "0"), "title": ("string", "''"), "caption": ("string", "''"), "master_id": ("long", None), "copy_name": ("string", "''"), "develop": ("string", None), "import_id": ("long", "0"), "imported_at": ("long", "0"), "thumb_ver": ("long", "0"), "exported_at": ("long", "0"), "edited_at": ("long", "0"), "stack_id": ("long", "0"), "stack_pos": ("int", "0")},
    "collections": {"id": ("long", None), "name": ("string", "''"), "parent_id": ("long", None), "smart": ("string", None)},
    "collection_photos": {"collection_id": ("long", None), "photo_id": ("long", None), "position": ("long", "0")},
    "history": {"id": ("long", None), "photo_id": ("long", None), "label": ("string", "''"), "settings": ("string", "'{}'"), "ts": ("long", "0")},
    "snapshots": {"id": ("long", None), "photo_id": ("long", None), "name": ("string", "''"), "settings": ("string", "'{}'"), "ts": ("long", "0")},
    "presets": {"id": ("long", None), "grp": ("string", "''"), "name": ("string", "''"), "data": ("string", "'{}'")},
    "faces": {"id": ("long", None), "photo_id": ("long", None), "x": ("double", "0"), "y": ("double", "0"), "w": ("double", "0"), "h": ("double", "0"), "score": ("double", "0"), "emb": ("binary", None), "thumb": ("binary", None), "person_id": ("long", "0")},
    "persons": {"id": ("long", None), "name": ("string", "''")},
    "kv": {"key": ("string", None), "value": ("string", None)},
}
NOCASE = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def opened(df: DataFrame, name: str) -> DataFrame:
    """A stored table in its declared shape: missing columns and nulls by default, others cast, unknown ones left out."""
    out = []
    for c, (kind, default) in TABLES[name].items():
        have = F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
        out.append((have if default is None else F.coalesce(have, F.expr(default).cast(kind))).alias(c))
    return df.select(*out)


def inserted(table: DataFrame, new: DataFrame, *order: str, key: str = "id") -> DataFrame:
    """`table` with the rows of `new` (all its columns but the key), numbered after the largest key in that total order."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))  # a row
    ranked = numbered(new, [F.col(c) for c in order], "__rank").join(F.broadcast(top))
    return table.unionByName(ranked.withColumn(key, (F.col("__top") + 1 + F.col("__rank")).cast(table.schema[key].dataType)).select(table.columns))


# Loads --------------------------------------------------------------------------------------------------------------------


def loaded(photos: DataFrame, links: DataFrame, keywords: DataFrame) -> DataFrame:
    """Photos with their keywords (photo_keywords: photo_id, keyword_id; keywords: id, name), in the order of lower case and name."""
    words = links.join(keywords.select(F.col("id").alias("keyword_id"), "name"), "keyword_id")
    words = words.groupBy(F.col("photo_id").alias("id")).agg(F.transform(F.array_sort(F.collect_set(F.struct(F.lower("name").alias("k"), "name"))), lambda x: x["name"]).alias("keywords"))
    return photos.join(words, "id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def collections(table: DataFrame, members: DataFrame) -> DataFrame:
    """(id, name, parent_id, smart, members): photo ids in the order of their places."""
    placed = members.groupBy(F.col("collection_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "photo_id"))), lambda x: x["photo_id"]).alias("members"))
    return table.join(placed, "id", "left").withColumn("members", F.coalesce("members", F.array().cast("array<long>")))


def by_name(df: DataFrame, *columns: str) -> DataFrame:
    """Ordered by those names regardless of ASCII case, then by id."""
    return df.orderBy(*(NOCASE(F.col(c)) for c in columns), "id")


def embedding(raw: Column) -> Column:
    """An array of floats from little-endian 32-bit bytes; a value is its sign, exponent and fraction, so no Python is needed."""
    word = lambda i: F.conv(F.concat(*(F.substring(F.hex(raw), i * 8 + 7 - 2 * k, 2) for k in range(4))), 16, 10).cast("long")

    def value(w: Column) -> Column:
        sign = F.when(F.shiftright(w, 31) == 1, -1.0).otherwise(1.0)
        power, fraction = F.shiftright(w, 23).bitwiseAND(F.lit(255)), w.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
        return sign * F.when(power == 0, fraction * 2.0**-149).otherwise((1 + fraction / (1 << 23)) * F.pow(F.lit(2.0), power - 127))

    return F.transform(F.sequence(F.lit(0), F.floor(F.octet_length(raw) / 4).cast("int") - 1), lambda i: value(word(i)))


def people(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """(id, name, photos, place) of persons, by the photos they are in: named ones first, then those of more photos, then by name and id."""
    n = faces.where("person_id > 0").groupBy(F.col("person_id").alias("id")).agg(F.count_distinct("photo_id").alias("photos"))
    listed = persons.join(n, "id", "left").select("id", "name", F.coalesce("photos", F.lit(0)).alias("photos"))
    return numbered(listed, [(F.col("name") == "").cast("int"), F.desc("photos"), F.col("name"), F.col("id")], "place")


def history(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The steps of the given photos (photo_id) whose settings parse, with their 0-based place."""
    good = table.join(ids.select("photo_id").distinct(), "photo_id", "left_semi").where(F.try_parse_json("settings").isNotNull())
    return good.withColumn("place", F.row_number().over(Window.partitionBy("photo_id").orderBy("id")) - 1)


def snapshots(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The snapshots of the given photos (photo_id), with their 0-based place by time."""
    good = table.join(ids.select("photo_id").distinct(), "photo_id", "left_semi").where(F.try_parse_json("settings").isNotNull())
    return good.withColumn("place", F.row_number().over(Window.partitionBy("photo_id").orderBy("ts", "id")) - 1)


def presets(table: DataFrame) -> DataFrame:
    """(id, grp, name, settings, groups) of presets whose data parse and have both parts, as JSON texts."""
    part = lambda k: F.get_json_object("data", f"$.{k}")
    return table.select("id", "grp", "name", part("settings").alias("settings"), part("groups").alias("groups")).where("settings is not null and groups is not null")


def value_of(kv: DataFrame, key: str) -> DataFrame:
    return kv.where(F.col("key") == key).select("value")


# Changes ------------------------------------------------------------------------------------------------------------------


def add_photos(photos: DataFrame, new: DataFrame, import_id: int, now: int, order: str = "path") -> DataFrame:
    """Photos with new files (path, file_size, meta, develop): rating from the metadata, at most 5, one import for all."""
    rating = F.least(F.coalesce(F.get_json_object("meta", "$.rating").try_cast("int"), F.lit(0)), F.lit(5))
    return inserted(photos, opened(new.withColumns({"rating": rating, "import_id": F.lit(import_id), "imported_at": F.lit(now)}), "photos").drop("id"), order)


def next_import(photos: DataFrame) -> DataFrame:
    return photos.agg((F.coalesce(F.max("import_id"), F.lit(0)) + 1).alias("import_id"))


def set_rating(photos: DataFrame, ids: DataFrame, stars: int) -> DataFrame:
    return set_where(photos, ids, rating=max(0, min(5, stars)))


def set_text(photos: DataFrame, ids: DataFrame, title: str | None = None, caption: str | None = None) -> DataFrame:
    """Title or caption, whichever is given."""
    return set_where(photos, ids, **{k: v for k, v in (("title", title), ("caption", caption)) if v is not None})


def set_develop(photos: DataFrame, new: DataFrame, now: int, quiet: bool = False) -> DataFrame:
    """Settings (id, develop; of several for an id the largest text) put in with the time of the edit; the picture's version rises unless `quiet`."""
    once = new.groupBy("id").agg(F.max("develop").alias("__new"), F.lit(True).alias("__hit"))
    put = photos.join(once, "id", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    rise = F.lit(0) if quiet else hit.cast("int")
    return put.withColumns({"develop": F.when(hit, F.col("__new")).otherwise(F.col("develop")), "thumb_ver": F.col("thumb_ver") + rise, "edited_at": F.when(hit, F.lit(now)).otherwise(F.col("edited_at"))}).select(photos.columns)


def mark_exported(photos: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    return set_where(photos, ids, exported_at=now)


def bump_thumb(photos: DataFrame, ids: DataFrame) -> DataFrame:
    return set_where(photos, ids, thumb_ver=F.col("thumb_ver") + 1)


def create_collection(table: DataFrame, new: DataFrame) -> DataFrame:
    """Collections with new ones (name, smart; seq for their order)."""
    return inserted(table, new.withColumn("parent_id", F.lit(None).cast("long")), "seq")


def update_smart(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Name and rules of collections (id, name, smart)."""
    new = changes.groupBy("id").agg(F.max(F.struct("name", "smart")).alias("__c")).select("id", F.col("__c.name").alias("__n"), F.col("__c.smart").alias("__s"), F.lit(True).alias("__hit"))
    return table.join(new, "id", "left").withColumns({"name": F.when(F.col("__hit"), F.col("__n")).otherwise(F.col("name")), "smart": F.when(F.col("__hit"), F.col("__s")).otherwise(F.col("smart"))}).select(table.columns)


def delete_collection(table: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Collections and members without the given ones (id)."""
    return without(table, ids), without(members, ids.select(F.col("id").alias("collection_id")), "collection_id")


def remove_from_collection(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without the pairs (collection_id, photo_id)."""
    return members.join(gone.select("collection_id", "photo_id"), ["collection_id", "photo_id"], "left_anti").select(members.columns)


def push_history(table: DataFrame, new: DataFrame, keep: int = 500) -> DataFrame:
    """Steps with new ones (photo_id, label, settings, ts; seq for their order), the newest `keep` of each photo."""
    return keep_newest(inserted(table, new, "seq"), ["photo_id"], "id", keep)


def replace_last_history(table: DataFrame, new: DataFrame) -> DataFrame:
    """The last step of each photo with the label, settings and time of `new` (photo_id, label, settings, ts)."""
    last = table.groupBy("photo_id").agg(F.max("id").alias("id")).join(new, "photo_id")
    return upsert(table, last.select(table.columns), ["id"])


def clear_history(table: DataFrame, ids: DataFrame) -> DataFrame:
    return without(table, ids.select("photo_id"), "photo_id")


def rename_person(persons: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    return set_where(persons, ids, name=name.strip())


def add_faces(faces: DataFrame, persons: DataFrame, scanned: DataFrame, new: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces, persons and scanned photos after a detection: `new` faces take the place of those of `photos` (photo_id), unassigned."""
    kept = without(faces, photos.select("photo_id"), "photo_id")
    out = inserted(kept, opened(new.withColumn("person_id", F.lit(0)), "faces").drop("id"), "photo_id", "score", "x", "y")
    seen = scanned.select("photo_id").unionByName(photos.select("photo_id")).distinct()
    return out, drop_empty(persons, out.withColumnRenamed("person_id", "person")), seen


def clear_people(faces: DataFrame, persons: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return faces.limit(0), persons.limit(0), scanned.limit(0)


def unscanned(photos: DataFrame, scanned: DataFrame) -> DataFrame:
    """(id, path) of originals that no face detection has seen and that are not missing."""
    return photos.where("master is null and not missing").join(scanned.select(F.col("photo_id").alias("id")), "id", "left_anti").select("id", "path")


def put_if_absent(table: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Rows of `new` whose key is not there; the first of each key by its whole row."""
    once = new.groupBy(key).agg(F.min(F.struct(*[c for c in table.columns if c != key])).alias("__r"))
    once = once.select(*(F.col(key) if c == key else F.col("__r").getField(c).alias(c) for c in table.columns))
    return table.unionByName(once.join(table.select(key), key, "left_anti").select(table.columns))


def remove(photos: DataFrame, ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """The tables without photos and their copies, and persons left without faces gone (tables: faces, persons, and others by photo_id)."""
    gone = removal_closure(photos.withColumnRenamed("master_id", "master") if "master_id" in photos.columns else photos, ids)
    out = {"photos": without(photos, gone)} | {n: without(df, gone.select(F.col("id").alias("photo_id")), "photo_id") for n, df in tables.items() if n != "persons"}
    if "persons" in tables:
        out["persons"] = drop_empty(tables["persons"], out["faces"].withColumnRenamed("person_id", "person"))
    return out


# Reports ------------------------------------------------------------------------------------------------------------------


#: Fields of a settings document outside plain adjustments: its geometry, and what is painted or placed.
GEOMETRY, PLACED = "geometry", ("masks", "privacy", "spots", "red_eye")


def edit_flags(photos: DataFrame, default: str) -> DataFrame:
    """(id, crop, adjust, masks) of settings documents (develop, JSON objects of one level of fields) against a default document.

    Crop: the geometry differs, its aspect apart; masks: something is placed; adjust: any other field differs. A field that is
    missing is at its default; photos without settings have no flags.
    """
    fields = lambda doc: F.from_json(doc, "map<string,string>")
    df = photos.select("id", fields(F.coalesce("develop", F.lit("{}"))).alias("m"), fields(F.lit(default)).alias("d"))
    shape = lambda c: F.map_filter(F.from_json(F.coalesce(F.try_element_at(c, F.lit(GEOMETRY)), F.lit("{}")), "map<string,string>"), lambda k, v: k != "aspect")
    entries = lambda c: F.array_sort(F.map_entries(c))
    crop = F.exists(F.map_keys(shape(F.col("m"))), lambda k: ~F.try_element_at(shape(F.col("m")), k).eqNullSafe(F.try_element_at(shape(F.col("d")), k)))
    placed = [~F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("[]")).isin("[]", "") for k in PLACED]
    other = F.exists(F.map_keys("m"), lambda k: ~k.isin(GEOMETRY, *PLACED) & ~F.try_element_at("m", k).eqNullSafe(F.try_element_at("d", k)))
    return df.select("id", crop.alias("crop"), other.alias("adjust"), functools.reduce(Column.__or__, placed).alias("masks"))


def reset_sections(settings: Column, default: Column, fields: list[str], sections: list[str]) -> Column:
    """Struct settings with the named sections at their defaults."""
    return copy_groups(settings, default, fields, [g for s in sections for g in SECTIONS[s]])


def section_modified(settings: Column, default: Column, section: str) -> Column:
    """Whether a section's fields differ from the defaults."""
    names = [f for g in SECTIONS[section] for f in GROUPS[g]]
    return functools.reduce(Column.__or__, (~settings[f].eqNullSafe(default[f]) for f in names))


def spot_signature(x: Column, y: Column, radius: Column, path: Column) -> Column:
    """A fingerprint of a spot's shape: place, painted path and size."""
    return F.xxhash64(x, y, F.to_json(path), radius)


def edited_count(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count(F.when(F.col("edited"), 1)).alias("n"))


def edited_settings(photos: DataFrame) -> DataFrame:
    """The number of photos with settings of their own."""
    return photos.agg(F.count("develop").alias("n"))


def new_presets(table: DataFrame, new: DataFrame) -> DataFrame:
    """Presets with those of `new` (grp, name, data) whose group and name are not there, the first of each."""
    once = new.groupBy("grp", "name").agg(F.min("data").alias("data"))
    return inserted(table, once.join(table.select("grp", "name"), ["grp", "name"], "left_anti"), "grp", "name")


def put_metadata(photos: DataFrame, new: DataFrame) -> DataFrame:
    """Foreign metadata (id, rating, flag, label, title, caption, touched): values always, texts if either is not empty, the time of the edit if there is one."""
    names = ("rating", "flag", "label", "title", "caption", "touched")
    once = new.groupBy("id").agg(F.max(F.struct("touched", *names[:-1])).alias("__m")).select("id", *(F.col(f"__m.{c}").alias(f"__{c}") for c in names), F.lit(True).alias("__hit"))
    put = photos.join(once, "id", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    texts = hit & ((F.col("__title") != "") | (F.col("__caption") != ""))
    cols = {c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("rating", "flag", "label")} | {c: F.when(texts, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("title", "caption")}
    return put.withColumns(cols | {"edited_at": F.when(hit & (F.col("__touched") > 0), F.col("__touched")).otherwise(F.col("edited_at"))}).select(photos.columns)


def session_document(view: DataFrame, selected: DataFrame, most_selected: int = 5000, most_views: int = 500) -> DataFrame:
    """(session, value): per session its first selected ids (session, id, seq) and view places (session, photo_id, zoom, x, y) as JSON."""
    first = lambda df, order, n: df.withColumn("__rn", F.row_number().over(Window.partitionBy("session").orderBy(order))).where(F.col("__rn") <= n)
    chosen = first(selected, "seq", most_selected).groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "id"))), lambda x: x["id"]).alias("selected"))
    places = first(view, "photo_id", most_views).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("photo_id", "zoom", "x", "y"))).alias("views"))
    return chosen.join(places, "session", "full").select("session", F.to_json(F.struct("selected", "views")).alias("value"))


def targets(selection: DataFrame, current: DataFrame, single: bool) -> DataFrame:
    """(session, id): the selection (session, id), or the current photo in single views and where nothing is selected."""
    if single:
        return current.select("session", "id")
    return selection.select("session", "id").unionByName(current.join(selection, "session", "left_anti").select("session", "id"))


def best_image(photos: DataFrame, *kinds: DataFrame) -> DataFrame:
    """(id, kind, key) of the first image at hand, in the order of the kinds (id, version, kind, key) given; of the photo's own version."""
    ranked = functools.reduce(DataFrame.unionByName, (k.withColumn("__at", F.lit(i)) for i, k in enumerate(kinds)))
    met = ranked.join(photos.select("id", F.col("thumb_ver").alias("version")), ["id", "version"])
    return met.groupBy("id").agg(F.min_by(F.struct("kind", "key"), "__at").alias("b")).select("id", "b.kind", "b.key")


def stale_images(images: DataFrame, photos: DataFrame, back: int = 4) -> DataFrame:
    """The images (id, version) of the `back` versions before a photo's own."""
    now = photos.select("id", F.col("thumb_ver").alias("__now"))
    return images.join(now, "id").where((F.col("version") < F.col("__now")) & (F.col("version") >= F.col("__now") - back)).select(images.columns)


def overridden(own: DataFrame, bundled: DataFrame, name: str = "file") -> DataFrame:
    """The caller's own files and those bundled files whose name, in lower case, none of them has."""
    low = own.select(F.lower(name).alias("__low"))
    return own.unionByName(bundled.withColumn("__low", F.lower(name)).join(low, "__low", "left_anti").select(own.columns))


def sizes_by_import(photos: DataFrame) -> DataFrame:
    """(import_id, photos, bytes) of each import, of originals."""
    return photos.where("master is null").groupBy("import_id").agg(F.count("*").alias("photos"), F.sum("file_size").alias("bytes"))


def add_snapshot(table: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Snapshots with new ones (photo_id, name, settings), numbered in that order."""
    return inserted(table, new.withColumn("ts", F.lit(now).cast(table.schema["ts"].dataType)), "photo_id", "name", "settings")


def delete_snapshots(table: DataFrame, ids: DataFrame) -> DataFrame:
    return without(table, ids.select("id"), "id")


def save_presets(table: DataFrame, new: DataFrame) -> DataFrame:
    """Presets with new ones (grp, name, settings and groups as JSON), whether their names are there or not."""
    data = F.concat(F.lit('{"settings":'), "settings", F.lit(',"groups":'), "groups", F.lit("}"))
    return inserted(table, new.select("grp", "name", data.alias("data")), "grp", "name", "data")


def delete_presets(table: DataFrame, ids: DataFrame) -> DataFrame:
    return without(table, ids.select("id"), "id")


def delete_preset_group(table: DataFrame, groups: DataFrame) -> DataFrame:
    return without(table, groups.select("grp"), "grp")


def face_thumbs(faces: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, thumb) of faces that have one."""
    return faces.join(ids.select("id").distinct(), "id", "left_semi").where("thumb is not null and length(thumb) > 0").select("id", "thumb")


def select_all(view: DataFrame) -> DataFrame:
    """The selection (id, seq) of all photos in a ranked view (id, rank), in its order."""
    return view.select("id", F.col("rank").cast("long").alias("seq"))


def folder_sizes(spark, folders: dict[str, str]) -> DataFrame:
    """(folder, files, bytes) of each named folder and all below it, from listings alone."""
    from fotolake.sources.files import walked

    out = None
    for name, path in folders.items():
        listed = walked(spark, path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
        part = listed.select(F.lit(name).alias("folder"), "files", "bytes")
        out = part if out is None else out.unionByName(part)
    return out
