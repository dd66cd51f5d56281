"""Queries of the store's operators: stored tables derived from the star schema, each with its DuckDB SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from fotolake.operators import session, store, views
from fotolake.plans.queries import query
from fotolake.plans.shapes import table

#: Stored tables, by expressions that Spark SQL and DuckDB read alike.
PHOTOS = """SELECT o_orderkey AS id, concat('/p/d', CAST(o_custkey % 40 AS STRING), '/', CAST(o_orderkey AS STRING), '.cr3') AS path, CAST(o_orderkey % 7000 AS BIGINT) AS file_size, CAST(o_orderkey % 6 AS INT) AS rating,
  CAST(o_orderkey % 3 - 1 AS INT) AS flag, CAST(o_orderkey % 5 AS INT) AS label, concat('T', CAST(o_orderkey % 9 AS STRING)) AS title, '' AS caption, CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 END AS master_id,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('{"exposure":', CAST(o_orderkey % 3 AS STRING), ',"geometry":{"angle":', CAST(o_orderkey % 5 AS STRING), '},"spots":[', CASE WHEN o_orderkey % 8 = 0 THEN '1' ELSE '' END, ']}') END AS develop,
  CAST(floor(o_orderkey / 500.0) AS BIGINT) AS import_id, CAST(o_orderkey % 11 AS BIGINT) AS thumb_ver, CAST(0 AS BIGINT) AS exported_at, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 1700000000 + o_orderkey ELSE 0 END AS BIGINT) AS edited_at, o_orderkey % 31 = 0 AS missing FROM orders"""
COLLECTIONS = "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN c_custkey - 1 END AS parent_id, CASE WHEN c_custkey % 3 = 0 THEN '{}' END AS smart FROM customer"
MEMBERS = "SELECT o_custkey AS collection_id, o_orderkey AS photo_id, o_orderkey * 7 % 1009 AS position FROM orders"
STEPS = "SELECT event_id AS id, user_id AS photo_id, event_type AS label, CASE WHEN event_id % 7 = 4 THEN 'broken' ELSE concat('{\"a\":', CAST(event_id AS STRING), '}') END AS settings, event_id * 7 % 1009 AS ts FROM events"
PRESETS = "SELECT p_partkey AS id, p_brand AS grp, p_name AS name, CASE WHEN p_partkey % 7 = 0 THEN '{' WHEN p_partkey % 5 = 0 THEN '{\"settings\":{}}' ELSE concat('{\"settings\":{\"a\":', CAST(p_size AS STRING), '},\"groups\":{\"b\":true}}') END AS data FROM part"
FACES = "SELECT vec_id AS id, CAST(floor(vec_id / 3.0) AS BIGINT) AS photo_id, CAST(CASE WHEN label IS NULL THEN 0 ELSE label END AS BIGINT) AS person_id, CAST(vec_id % 7 AS DOUBLE) AS x, CAST(vec_id % 11 AS DOUBLE) AS y, CAST(vec_id % 101 AS DOUBLE) / 101 AS score FROM embeddings"
PERSONS = "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS name FROM nation"
W = {"p": PHOTOS, "c": COLLECTIONS, "m": MEMBERS, "s": STEPS, "r": PRESETS, "f": FACES, "n": PERSONS}
SOURCE = {"p": "orders", "c": "customer", "m": "orders", "s": "events", "r": "part", "f": "embeddings", "n": "nation"}


@pandas_udf(BinaryType())
def _packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda x: np.asarray(x, "<f4").tobytes())


def of(spark, sf, key):
    name = SOURCE[key]
    text = W[key].replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {" + name + "}")
    return spark.sql(text, **{name: table(spark, sf, name)})


def sql(keys: str, text: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({W[k]})" for k in keys) + " " + text


@query(sql("p", "SELECT id, path, rating, 0 AS stack_pos, '{}' AS meta, CAST(0 AS BIGINT) AS stack_id FROM p"))
def table_opened(spark, sf):
    """An older table, without the columns that came later."""
    return store.opened(of(spark, sf, "p"), "photos").select("id", "path", "rating", "stack_pos", "meta", "stack_id")


@query("WITH k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END AS name FROM part), l AS (SELECT l_orderkey AS id, l_partkey FROM lineitem), w AS (SELECT DISTINCT l.id, k.name FROM l JOIN k ON l_partkey = k.id) SELECT o_orderkey AS id, coalesce(string_agg(name, ',' ORDER BY lower(name), name), '') AS words FROM orders LEFT JOIN w ON w.id = o_orderkey GROUP BY 1")
def photos_loaded(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("n"))
    keywords = part.select("id", F.when(F.col("id") % 2 == 0, F.upper("n")).otherwise(F.col("n")).alias("name"))
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_partkey").alias("keyword_id"))
    photos = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return store.loaded(photos, links, keywords).select("id", F.array_join("keywords", ",").alias("words"))


@query(sql("cm", "SELECT c.id, c.name, coalesce(string_agg(CAST(photo_id AS STRING), ',' ORDER BY position, photo_id), '') AS members FROM c LEFT JOIN m ON collection_id = c.id GROUP BY 1, 2"))
def collections_loaded(spark, sf):
    return store.collections(of(spark, sf, "c"), of(spark, sf, "m")).select("id", "name", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(sql("c", "SELECT name, id FROM c ORDER BY lower(name), id LIMIT 40"))
def collections_first_by_name(spark, sf):
    return store.by_name(of(spark, sf, "c"), "name").select("name", "id").limit(40)


@query("SELECT vec_id, i, round(CAST(embedding[i] AS DOUBLE), 7) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE embedding IS NOT NULL)")
def embeddings_decoded(spark, sf):
    """Embeddings packed as bytes, read back."""
    raw = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", _packed("embedding").alias("raw"))
    return raw.select("vec_id", F.posexplode(store.embedding(F.col("raw"))).alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("v", 7).alias("v"))


@query(sql("fn", "SELECT n.id, n.name, coalesce(k, 0) AS photos, row_number() OVER (ORDER BY n.name = '', coalesce(k, 0) DESC, n.name, n.id) - 1 AS place FROM n LEFT JOIN (SELECT person_id, count(DISTINCT photo_id) AS k FROM f WHERE person_id > 0 GROUP BY 1) ON person_id = n.id"))
def people_listed(spark, sf):
    return store.people(of(spark, sf, "n"), of(spark, sf, "f"))


GOOD = "SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY {}) - 1 AS place FROM s WHERE settings <> 'broken' AND photo_id % 4 = 1"


@query(sql("s", GOOD.format("id")))
def history_loaded(spark, sf):
    s = of(spark, sf, "s")
    return store.history(s, s.where("photo_id % 4 = 1").select("photo_id"))


@query(sql("s", GOOD.format("ts, id")))
def snapshots_loaded(spark, sf):
    s = of(spark, sf, "s")
    return store.snapshots(s, s.where("photo_id % 4 = 1").select("photo_id"))


@query(sql("r", """SELECT id, grp, name, json_extract(data, '$.settings')::STRING AS settings, json_extract(data, '$.groups')::STRING AS groups FROM r WHERE id % 7 <> 0 AND id % 5 <> 0"""))
def presets_loaded(spark, sf):
    return store.presets(of(spark, sf, "r"))


@query("SELECT c_mktsegment AS value FROM customer WHERE c_custkey = 7")
def value_looked_up(spark, sf):
    c = table(spark, sf, "customer")
    kv = c.select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    return store.value_of(kv, "k7")


@query(sql("p", "SELECT id, path, rating, import_id FROM p UNION ALL SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY c_name), c_name, CAST(least(c_custkey % 8, 5) AS INT), 99 FROM customer"))
def photos_added(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_name").alias("path"), F.concat(F.lit('{"rating":'), (F.col("c_custkey") % 8).cast("string"), F.lit("}")).alias("meta"))
    return store.add_photos(store.opened(of(spark, sf, "p"), "photos"), new, 99, 1).select("id", "path", "rating", "import_id")


@query(sql("p", "SELECT max(import_id) + 1 AS import_id FROM p"))
def import_next(spark, sf):
    return store.next_import(of(spark, sf, "p"))


@query(sql("p", "SELECT id, CASE WHEN id % 4 = 0 THEN 5 ELSE rating END AS rating, CASE WHEN id % 4 = 0 THEN 'new' ELSE title END AS title, caption FROM p"))
def texts_and_ratings_set(spark, sf):
    p = of(spark, sf, "p")
    ids = p.where("id % 4 = 0").select("id")
    return store.set_text(store.set_rating(p, ids, 9), ids, title="new").select("id", "rating", "title", "caption")


@query(sql("p", "SELECT id, CASE WHEN id % 6 = 0 THEN '{}' ELSE develop END AS develop, thumb_ver + CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END AS thumb_ver, CASE WHEN id % 6 = 0 THEN 1800000000 ELSE edited_at END AS edited_at FROM p"))
def settings_set(spark, sf):
    p = of(spark, sf, "p")
    return store.set_develop(p, p.where("id % 6 = 0").select("id", F.lit("{}").alias("develop")), 1_800_000_000).select("id", "develop", "thumb_ver", "edited_at")


@query(sql("p", "SELECT id, CASE WHEN id % 6 = 0 THEN '{}' ELSE develop END AS develop, thumb_ver, CASE WHEN id % 6 = 0 THEN 1800000000 ELSE edited_at END AS edited_at FROM p"))
def settings_set_quietly(spark, sf):
    p = of(spark, sf, "p")
    return store.set_develop(p, p.where("id % 6 = 0").select("id", F.lit("{}").alias("develop")), 1_800_000_000, quiet=True).select("id", "develop", "thumb_ver", "edited_at")


@query(sql("p", "SELECT id, thumb_ver + CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS thumb_ver, CASE WHEN id % 9 = 0 THEN 5 ELSE exported_at END AS exported_at FROM p"))
def exports_marked(spark, sf):
    p = of(spark, sf, "p")
    ids = p.where("id % 9 = 0").select("id")
    return store.mark_exported(store.bump_thumb(p, ids), ids, 5).select("id", "thumb_ver", "exported_at")


@query(sql("c", "SELECT id, name, smart FROM c UNION ALL SELECT (SELECT max(id) FROM c) + row_number() OVER (ORDER BY n_nationkey), n_name, CASE WHEN n_nationkey % 2 = 0 THEN '[]' END FROM nation"))
def collections_created(spark, sf):
    new = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "[]").alias("smart"), F.col("n_nationkey").alias("seq"))
    return store.create_collection(of(spark, sf, "c"), new).select("id", "name", "smart")


@query(sql("c", "SELECT id, CASE WHEN id % 10 = 0 THEN concat('x', name) ELSE name END AS name, CASE WHEN id % 10 = 0 THEN NULL ELSE smart END AS smart FROM c"))
def collections_changed(spark, sf):
    c = of(spark, sf, "c")
    return store.update_smart(c, c.where("id % 10 = 0").select("id", F.concat(F.lit("x"), "name").alias("name"), F.lit(None).cast("string").alias("smart"))).select("id", "name", "smart")


@query(sql("cm", "SELECT 'c' AS kind, id, id AS other FROM c WHERE id % 3 <> 0 UNION ALL SELECT 'm', collection_id, photo_id FROM m WHERE collection_id % 3 <> 0"))
def collections_deleted(spark, sf):
    c, m = of(spark, sf, "c"), of(spark, sf, "m")
    c, m = store.delete_collection(c, m, c.where("id % 3 = 0").select("id"))
    return c.select(F.lit("c").alias("kind"), "id", F.col("id").alias("other")).unionByName(m.select(F.lit("m").alias("kind"), F.col("collection_id").alias("id"), F.col("photo_id").alias("other")))


@query(sql("m", "SELECT * FROM m WHERE NOT (collection_id % 2 = 0 AND photo_id % 3 = 0)"))
def members_removed(spark, sf):
    m = of(spark, sf, "m")
    return store.remove_from_collection(m, m.where("collection_id % 2 = 0 and photo_id % 3 = 0"))


@query(sql("s", "SELECT id, photo_id, label FROM (SELECT id, photo_id, label FROM s UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY c_custkey), c_custkey, 'new' FROM customer) QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY id DESC) <= 3"))
def history_pushed(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("photo_id"), F.lit("new").alias("label"), F.lit("{}").alias("settings"), F.lit(0).cast("long").alias("ts"), F.col("c_custkey").alias("seq"))
    return store.push_history(of(spark, sf, "s"), new, 3).select("id", "photo_id", "label")


@query(sql("s", "SELECT id, photo_id, CASE WHEN photo_id % 5 = 0 AND id = max(id) OVER (PARTITION BY photo_id) THEN 'last' ELSE label END AS label FROM s"))
def history_replaced(spark, sf):
    s = of(spark, sf, "s")
    new = s.where("photo_id % 5 = 0").select("photo_id").distinct().select("photo_id", F.lit("last").alias("label"), F.lit("{}").alias("settings"), F.lit(0).cast("long").alias("ts"))
    return store.replace_last_history(s, new).select("id", "photo_id", "label")


@query(sql("s", "SELECT id, photo_id FROM s WHERE photo_id % 2 <> 0"))
def history_cleared(spark, sf):
    s = of(spark, sf, "s")
    return store.clear_history(s, s.where("photo_id % 2 = 0").select("photo_id").distinct()).select("id", "photo_id")


@query(sql("n", "SELECT id, CASE WHEN id % 4 = 1 THEN 'Ann' ELSE name END AS name FROM n"))
def people_renamed(spark, sf):
    n = of(spark, sf, "n")
    return store.rename_person(n, n.where("id % 4 = 1").select("id"), "  Ann ")


@query(sql("pf", "SELECT id, path FROM p WHERE master_id IS NULL AND NOT missing AND id NOT IN (SELECT photo_id FROM f)"))
def photos_unscanned(spark, sf):
    return store.unscanned(of(spark, sf, "p").withColumnRenamed("master_id", "master"), of(spark, sf, "f").select("photo_id"))


@query("SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 <> 0")
def masks_kept_once(spark, sf):
    c = table(spark, sf, "customer")
    have = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return store.put_if_absent(have, c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")))


@query(sql("pfn", """, g AS (SELECT id FROM p WHERE id % 5 = 0 UNION SELECT id FROM p WHERE master_id IN (SELECT id FROM p WHERE id % 5 = 0)), k AS (SELECT * FROM f WHERE photo_id NOT IN (SELECT id FROM g))
SELECT 'p' AS kind, id FROM p WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'f', id FROM k UNION ALL SELECT 'n', id FROM n WHERE id IN (SELECT person_id FROM k)""").replace(") , g AS", "), g AS"))
def photos_and_people_removed(spark, sf):
    p = of(spark, sf, "p")
    out = store.remove(p, p.where("id % 5 = 0").select("id"), faces=of(spark, sf, "f"), persons=of(spark, sf, "n"))
    return out["photos"].select(F.lit("p").alias("kind"), "id").unionByName(out["faces"].select(F.lit("f").alias("kind"), "id")).unionByName(out["persons"].select(F.lit("n").alias("kind"), "id"))


@query(sql("fn", """, k AS (SELECT * FROM f WHERE photo_id % 2 <> 0), a AS (SELECT (SELECT max(id) FROM k) + row_number() OVER (ORDER BY photo_id, score, x, y) AS id, photo_id, CAST(0 AS BIGINT) AS person_id FROM f WHERE photo_id % 2 = 0 AND x > 2)
SELECT 'f' AS kind, id, photo_id AS other FROM k UNION ALL SELECT 'f', id, photo_id FROM a UNION ALL SELECT 'n', id, 0 FROM n WHERE id IN (SELECT person_id FROM k UNION ALL SELECT person_id FROM a) UNION ALL SELECT 's', 0, photo_id FROM (SELECT DISTINCT photo_id FROM f WHERE photo_id % 2 = 0 OR photo_id % 3 = 0)""").replace(") , k AS", "), k AS"))
def faces_detected(spark, sf):
    f = store.opened(of(spark, sf, "f"), "faces")
    even = f.where("photo_id % 2 = 0")
    faces, persons, seen = store.add_faces(f, of(spark, sf, "n"), f.where("photo_id % 3 = 0").select("photo_id"), even.where("x > 2"), even.select("photo_id").distinct())
    out = faces.select(F.lit("f").alias("kind"), "id", F.col("photo_id").alias("other")).unionByName(persons.select(F.lit("n").alias("kind"), "id", F.lit(0).cast("long").alias("other")))
    return out.unionByName(seen.select(F.lit("s").alias("kind"), F.lit(0).cast("long").alias("id"), F.col("photo_id").alias("other")))


@query(sql("p", "SELECT id, develop IS NOT NULL AND id % 5 <> 0 AS crop, develop IS NOT NULL AND id % 3 <> 0 AS adjust, id % 8 = 0 AS masks FROM p"))
def edits_summed_up(spark, sf):
    return store.edit_flags(of(spark, sf, "p"), '{"exposure":0,"geometry":{"angle":0},"spots":[]}')


@query(sql("p", "SELECT count(develop) AS n FROM p"))
def edited_counted(spark, sf):
    return store.edited_settings(of(spark, sf, "p"))


@query(sql("p", "SELECT import_id, count(*) AS photos, sum(file_size) AS bytes FROM p WHERE master_id IS NULL GROUP BY 1"))
def sizes_of_imports(spark, sf):
    return store.sizes_by_import(of(spark, sf, "p").withColumnRenamed("master_id", "master"))


@query(sql("r", "SELECT id, grp, name FROM r UNION ALL SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY grp, name), grp, name FROM (SELECT DISTINCT grp, name FROM (SELECT CASE WHEN id % 2 = 0 THEN grp ELSE 'Own' END AS grp, name FROM r) EXCEPT SELECT grp, name FROM r)"))
def presets_imported(spark, sf):
    r = of(spark, sf, "r")
    return store.new_presets(r, r.select(F.when(F.col("id") % 2 == 0, F.col("grp")).otherwise("Own").alias("grp"), "name", "data")).select("id", "grp", "name")


@query(sql("p", "SELECT id, CASE WHEN id % 7 = 0 THEN 1 ELSE rating END AS rating, CASE WHEN id % 14 = 0 THEN 'foreign' ELSE title END AS title, CASE WHEN id % 21 = 0 THEN 77 ELSE edited_at END AS edited_at FROM p"))
def metadata_taken_over(spark, sf):
    p = of(spark, sf, "p")
    new = p.where("id % 7 = 0").select("id", F.lit(1).alias("rating"), F.lit(0).alias("flag"), F.lit(2).alias("label"), F.when(F.col("id") % 14 == 0, "foreign").otherwise("").alias("title"), F.lit("").alias("caption"), F.when(F.col("id") % 21 == 0, 77).otherwise(0).alias("touched"))
    return store.put_metadata(p, new).select("id", "rating", "title", "edited_at")


@query("""WITH s AS (SELECT o_custkey AS session, o_orderkey AS id FROM orders), a AS (SELECT session, list(id ORDER BY id) AS v FROM s GROUP BY 1)
SELECT session, concat('{"selected":[', array_to_string(v[:3], ','), '],"views":[', array_to_string(list_transform(v[:2], lambda x: concat('{"photo_id":', x, ',"zoom":1.5,"x":0.5,"y":0.5}')), ','), ']}') AS value FROM a""")
def session_saved(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"))
    return store.session_document(o.select("session", F.col("id").alias("photo_id"), F.lit(1.5).alias("zoom"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y")), o.withColumn("seq", F.col("id")), 3, 2)


@query("WITH s AS (SELECT o_custkey AS session, o_orderkey AS id FROM orders WHERE o_custkey % 2 = 0) SELECT session, id FROM s UNION ALL SELECT c_custkey, -c_custkey FROM customer WHERE c_custkey NOT IN (SELECT session FROM s)")
def selection_targets(spark, sf):
    s = table(spark, sf, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"))
    return store.targets(s, table(spark, sf, "customer").select(F.col("c_custkey").alias("session"), (-F.col("c_custkey")).alias("id")), single=False)


@query(sql("p", "SELECT id, CASE WHEN id % 2 = 0 THEN 'exact' ELSE 'preview' END AS kind, concat(CASE WHEN id % 2 = 0 THEN 'e' ELSE 'v' END, CAST(id AS STRING)) AS key FROM p WHERE id % 2 = 0 OR id % 3 = 0"))
def images_at_hand(spark, sf):
    p = of(spark, sf, "p")
    image = lambda where, kind, letter, version: p.where(where).select("id", version.alias("version"), F.lit(kind).alias("kind"), F.concat(F.lit(letter), F.col("id").cast("string")).alias("key"))
    return store.best_image(p, image("id % 2 = 0", "exact", "e", F.col("thumb_ver")), image("id % 3 = 0", "preview", "v", F.col("thumb_ver")), image("id % 5 = 0", "embedded", "m", F.col("thumb_ver") - 1))


@query(sql("p", "SELECT id, thumb_ver - k AS version FROM p, (SELECT unnest(range(1, 5)) AS k)"))
def images_stale(spark, sf):
    p = of(spark, sf, "p")
    images = p.select("id", F.explode(F.sequence(F.col("thumb_ver") - 6, F.col("thumb_ver"))).alias("version"))
    return store.stale_images(images, p)


@query("SELECT n_name AS file, 'own' AS origin FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT lower(n_name), 'bundled' FROM nation WHERE n_nationkey % 2 <> 0")
def files_overridden(spark, sf):
    n = table(spark, sf, "nation")
    return store.overridden(n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("file"), F.lit("own").alias("origin")), n.select(F.lower("n_name").alias("file"), F.lit("bundled").alias("origin")))


DOC = "SELECT o_orderkey AS id, CAST(o_orderkey % 2 AS DOUBLE) AS exposure, CAST(o_orderkey % 3 AS DOUBLE) AS contrast, CAST(o_orderkey % 5 AS DOUBLE) AS texture FROM orders"


@query(f"SELECT id, 0.0::DOUBLE AS exposure, 0.0::DOUBLE AS texture, exposure <> 0 OR contrast <> 0 OR texture <> 0 AS basic FROM ({DOC})")
def sections_reset(spark, sf):
    fields = ["exposure", "contrast", "texture", "highlights", "shadows", "whites", "blacks", "clarity", "dehaze", "vibrance", "saturation", "wb_custom", "temp_k", "tint_k", "temp", "tint", "profile", "profile_amount", "treatment", "bw_mix"]
    df = spark.sql(DOC.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))
    now = F.struct(*(F.col(f).alias(f) if f in ("exposure", "contrast", "texture") else F.lit(0.0).alias(f) for f in fields))
    df = df.select("id", now.alias("s"), F.struct(*(F.lit(0.0).alias(f) for f in fields)).alias("d"))
    out = store.reset_sections(F.col("s"), F.col("d"), fields, ["basic"])
    return df.select("id", out.alias("o"), store.section_modified(F.col("s"), F.col("d"), "basic").alias("basic")).select("id", "o.exposure", "o.texture", "basic")


@query("WITH v AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_name DESC) - 1 AS rank FROM customer) SELECT a.id AS session, b.id FROM v a JOIN v b ON b.rank = greatest(0, least((SELECT max(rank) FROM v), a.rank - 3))")
def view_stepped(spark, sf):
    ranked = views.numbered(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name"), [F.desc("c_name")]).select("id", "rank")
    return session.stepped(ranked, ranked.select(F.col("id").alias("session"), "id"), -3)


@query("SELECT c_custkey AS id, c_custkey * 7 % 1000 AS seq FROM customer WHERE c_custkey % 4 = 0 ORDER BY 2, 1 LIMIT 50")
def session_restored(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 1000).alias("seq"))
    return session.restored(c.where("id % 2 = 0"), c.where("id % 4 = 0").select("id"), 50)


@query("SELECT concat('k', CAST(c_custkey AS STRING)) AS key, c_name AS value FROM customer WHERE c_custkey <> 4 UNION ALL SELECT 'prefs', 'new'")
def settings_carried(spark, sf):
    c = table(spark, sf, "customer")
    kv = c.select(F.when(F.col("c_custkey") == 4, "prefs").otherwise(F.concat(F.lit("k"), F.col("c_custkey").cast("string"))).alias("key"), F.col("c_name").alias("value"))
    return session.carried(kv, spark.createDataFrame([("prefs", "new"), ("session", "s"), ("other", "x")], "key string, value string"), ["prefs", "session"])
