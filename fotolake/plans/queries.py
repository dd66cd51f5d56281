"""The engine's queries over the derived shapes, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotolake.functions import color, text, vector
from fotolake.operators import catalog, edits, lens, people, planning, sensor, session, stacks, stats, views
from fotolake.operators.predicates import Filter, Rule, Rules, count_rules, kind_of, of_source
from fotolake.plans.shapes import FACES_SQL, HISTORY_SQL, PHOTOS_SQL, faces, history, photos, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
P, FC, H = f"WITH p AS ({PHOTOS_SQL})", f"WITH f AS ({FACES_SQL})", f"WITH h AS ({HISTORY_SQL})"
NOW = 1_700_600_000


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = sql
        return f

    return put


# Predicates ---------------------------------------------------------------------------------------------------------------

HAY = "lower(concat(file_name, ' ', title, ' ', caption, ' ', array_to_string(keywords, ' '), ' ', coalesce(make, ''), ' ', coalesce(model, ''), ' ', coalesce(lens, '')))"
CAMERA = "concat(lower(coalesce(make, '')), ' ', lower(coalesce(model, '')))"
RULES: dict[str, tuple[Rule, str]] = {
    "rating_at_least": (Rule("rating_at_least", 4), "rating >= 4"),
    "rating_at_most": (Rule("rating_at_most", 1), "rating <= 1"),
    "flag_is": (Rule("flag_is", 1), "flag = 1"),
    "label_is": (Rule("label_is", 2), "label = 2"),
    "keyword_contains": (Rule("keyword_contains", "LACE1"), "len(list_filter(keywords, lambda k: contains(lower(k), 'lace1'))) > 0"),
    "text_contains": (Rule("text_contains", "Canon  img_1"), f"contains({HAY}, 'canon') AND contains({HAY}, 'img_1')"),
    "camera_contains": (Rule("camera_contains", "Sony model 3"), f"contains({CAMERA}, 'sony model 3')"),
    "lens_contains": (Rule("lens_contains", "-105MM"), "coalesce(contains(lower(lens), '-105mm'), false)"),
    "captured_after": (Rule("captured_after", "2024-01-20 12"), "coalesce(capture_time >= '2024-01-20 12', false)"),
    "captured_before": (Rule("captured_before", "2024-01-10"), "coalesce(capture_time <= '2024-01-10', false)"),
    "file_type_is": (Rule("file_type_is", "cr3"), "ext = 'CR3'"),
    "has_edits": (Rule("has_edits", False), "edited = false"),
    "iso_at_least": (Rule("iso_at_least", 3200), "coalesce(iso >= 3200, false)"),
    "iso_at_most": (Rule("iso_at_most", 400), "coalesce(iso <= 400, false)"),
    "focal_at_least": (Rule("focal_at_least", 70.0), "coalesce(focal >= 70, false)"),
    "focal_at_most": (Rule("focal_at_most", 24.0), "coalesce(focal <= 24, false)"),
    "in_folder": (Rule("in_folder", "/U1"), "contains(lower(folder), '/u1')"),
    "has_keywords": (Rule("has_keywords", False), "len(keywords) = 0"),
    "captured_within_days": (Rule("captured_within_days", 3), "coalesce(capture_time >= strftime(to_timestamp(1700600000 - 3 * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d 00:00:00'), false)"),
    "edited_within_days": (Rule("edited_within_days", 7), "edited_at > 0 AND edited_at >= 1700600000 - 7 * 86400"),
}


def _rule(name: str) -> Query:
    return lambda spark, sf: photos(spark, sf).where(RULES[name][0].column(NOW)).select("id", "path", "rating")


for _name, (_, _sql) in RULES.items():
    query(f"{P} SELECT id, path, rating FROM p WHERE {_sql}", f"rule_{_name}")(_rule(_name))


@query(f"{P} SELECT 'all' AS name, count(*) FILTER (WHERE rating >= 3 AND coalesce(iso >= 1600, false)) AS n FROM p UNION ALL SELECT 'any', count(*) FILTER (WHERE rating >= 5 OR ext = 'CR3') FROM p UNION ALL SELECT 'none', count(*) FROM p")
def rule_sets_counted(spark, sf):
    sets = {"all": Rules((Rule("rating_at_least", 3), Rule("iso_at_least", 1600))), "any": Rules((Rule("rating_at_least", 5), Rule("file_type_is", "CR3")), match_all=False), "none": Rules(())}
    return count_rules(photos(spark, sf), sets)


@query(f"{P} SELECT id, file_name FROM p WHERE rating >= 2 AND flag <> -1 AND label IN (1, 3, 4) AND is_raw AND edited AND contains({HAY}, 'model')")
def filter_bar(spark, sf):
    return photos(spark, sf).where(Filter(text="Model", rating=2, flag="not_rejected", labels=(1, 3, 4), kind="raw", edited=True).column()).select("id", "file_name")


@query(f"{P} SELECT id, ext FROM p WHERE rating = 3 AND flag = -1 AND NOT is_raw AND ext NOT IN ('JPG', 'JPEG', 'HEIC', 'HEIF', 'HIF') AND exported_at > 0")
def filter_other_kinds(spark, sf):
    return photos(spark, sf).where(Filter(rating=3, rating_op="exactly", flag="rejected", kind="other", exported=True).column()).select("id", "ext")


@query(f"{P} SELECT id FROM p WHERE folder = '/photos/u7'")
def source_folder(spark, sf):
    return of_source(photos(spark, sf), "folder", "/photos/u7").select("id")


@query(f"{P} SELECT id FROM p WHERE import_id = 0 + 1 AND import_id <> 0")
def source_last_import(spark, sf):
    return of_source(photos(spark, sf), "last_import", 1).select("id")


@query(f"{P} SELECT id FROM p WHERE missing")
def source_missing(spark, sf):
    return of_source(photos(spark, sf), "missing").select("id")


@query(f"{P} SELECT id FROM p WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 40 = 1)")
def source_collection(spark, sf):
    members = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 40).alias("collection_id"), F.col("l_partkey").alias("photo_id"))
    return of_source(photos(spark, sf), "collection", 1, members=members).select("id")


@query(f"{P}, f AS ({FACES_SQL}) SELECT id FROM p WHERE id IN (SELECT photo_id FROM f WHERE person = 3)")
def source_person(spark, sf):
    return of_source(photos(spark, sf), "person", 3, faces=faces(spark, sf)).select("id")


@query(f"{P} SELECT id, CASE WHEN ext IN ('CR3', 'NEF') THEN 'raw' WHEN ext IN ('JPG', 'PNG') THEN 'raster' ELSE 'heif' END AS kind, CASE WHEN master IS NOT NULL THEN concat(file_name, ' (', copy_name, ')') ELSE file_name END AS shown FROM p")
def kinds_and_names(spark, sf):
    return photos(spark, sf).select("id", kind_of(F.col("ext")).alias("kind"), catalog.display_name().alias("shown"))


# Views --------------------------------------------------------------------------------------------------------------------

VISIBLE = "SELECT * FROM p WHERE rating >= 2 AND flag <> -1"
KEY = "coalesce(capture_time, '')"


@query(f"""{P}, v AS ({VISIBLE}), k AS (SELECT *, row_number() OVER (ORDER BY {KEY}, file_name, id) AS r FROM v),
g AS (SELECT *, CASE WHEN stack_id = 0 THEN r ELSE min(r) OVER (PARTITION BY stack_id) END AS place, CASE WHEN stack_id = 0 THEN 1 ELSE row_number() OVER (PARTITION BY stack_id ORDER BY stack_pos, id) END AS rn FROM k)
SELECT id, file_name, row_number() OVER (ORDER BY place, rn) - 1 AS rank FROM g WHERE rn = 1""")
def view_library(spark, sf):
    """Filter, order by capture time, gather stacks and show only their tops."""
    view = views.library_view(photos(spark, sf).where(Filter(rating=2, flag="not_rejected").column()))
    keys = [F.col(f"view_key{i}") for i in range(3)] + [F.col("stack_rank")]
    return views.numbered(view.select("id", "file_name", *keys), keys).select("id", "file_name", "rank")


@query(f"""{P}, v AS ({VISIBLE}), k AS (SELECT *, row_number() OVER (ORDER BY rating DESC, id DESC) AS r FROM v),
g AS (SELECT *, CASE WHEN stack_id = 0 THEN r ELSE min(r) OVER (PARTITION BY stack_id) END AS place, CASE WHEN stack_id = 0 THEN 1 ELSE row_number() OVER (PARTITION BY stack_id ORDER BY stack_pos, id) END AS rn FROM k)
SELECT id, rating, row_number() OVER (ORDER BY place, rn) - 1 AS rank FROM g WHERE rn = 1 OR stack_id % 3 = 0""")
def view_by_rating_expanded(spark, sf):
    df = photos(spark, sf)
    view = views.library_view(df.where(Filter(rating=2, flag="not_rejected").column()), "rating", True, df.where("stack_id <> 0 and stack_id % 3 = 0").select("stack_id"))
    keys = [F.desc("view_key0"), F.desc("view_key1"), F.asc("stack_rank")]
    return views.numbered(view.select("id", "rating", "view_key0", "view_key1", "stack_rank"), keys).select("id", "rating", "rank")


@query(f"{P}, k AS (SELECT id, row_number() OVER (ORDER BY lower(file_name), id) - 1 AS rank FROM p) SELECT id, rank FROM k WHERE rank BETWEEN 20 AND 120")
def range_selection(spark, sf):
    ranked = views.numbered(photos(spark, sf).select("id", F.lower("file_name").alias("k")), [F.col("k"), F.col("id")])
    return ranked.where("rank between 20 and 120").select("id", "rank")


@query(f"{P} SELECT id, lag(concat('{{\"exposure\":', CAST(rating AS STRING), '}}')) OVER (ORDER BY {KEY}, file_name, id) AS previous FROM p")
def paste_previous(spark, sf):
    """The settings of the photo before each in the view's order."""
    view = photos(spark, sf).withColumn("develop", F.concat(F.lit('{"exposure":'), F.col("rating").cast("string"), F.lit("}")))
    return edits.previous_settings(view, [F.coalesce("capture_time", F.lit("")), F.col("file_name"), F.col("id")])


# Stacks -------------------------------------------------------------------------------------------------------------------

SECS = "((((CAST(substr(capture_time, 1, 4) AS DOUBLE) * 372 + CAST(substr(capture_time, 6, 2) AS DOUBLE) * 31 + CAST(substr(capture_time, 9, 2) AS DOUBLE)) * 24 + CAST(substr(capture_time, 12, 2) AS DOUBLE)) * 60 + CAST(substr(capture_time, 15, 2) AS DOUBLE)) * 60 + CAST(substr(capture_time, 18, 2) AS DOUBLE))"


@query(f"{P} SELECT id, {SECS} AS secs FROM p WHERE capture_time IS NOT NULL")
def capture_seconds(spark, sf):
    return photos(spark, sf).where("capture_time is not null").select("id", text.capture_secs(F.col("capture_time")).alias("secs"))


@query(f"""{P}, t AS (SELECT id, folder, {SECS} AS t FROM p WHERE stack_id = 0 AND master IS NULL AND capture_time IS NOT NULL),
c AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, id) <= 200 THEN 0 ELSE 1 END AS cut FROM t),
r AS (SELECT *, sum(cut) OVER (ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY run) AS n FROM r)
SELECT id, first_value(id) OVER (PARTITION BY run ORDER BY t, id) AS stack_id, row_number() OVER (PARTITION BY run ORDER BY t, id) - 1 AS stack_pos FROM n WHERE n > 1""")
def stacks_by_time(spark, sf):
    return stacks.auto_stack(photos(spark, sf), 200)


@query(f"""{P}, t AS (SELECT id, folder, {SECS} AS t FROM p WHERE stack_id = 0 AND master IS NULL AND capture_time IS NOT NULL),
c AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY folder ORDER BY t, id) <= 3600 THEN 0 ELSE 1 END AS cut FROM t),
r AS (SELECT *, sum(cut) OVER (PARTITION BY folder ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, count(*) OVER (PARTITION BY folder, run) AS n FROM r)
SELECT id, first_value(id) OVER (PARTITION BY folder, run ORDER BY t, id) AS stack_id, row_number() OVER (PARTITION BY folder, run ORDER BY t, id) - 1 AS stack_pos FROM n WHERE n > 1""")
def stacks_by_time_in_folders(spark, sf):
    return stacks.auto_stack(photos(spark, sf), 3600, within="folder")


@query(f"""{P}, s AS (SELECT CAST(floor(id / 30.0) AS BIGINT) AS grp, id, id AS seq, stack_id AS old FROM p WHERE id % 10 IN (1, 5)),
b AS (SELECT s.grp, m.id, min(s.seq) AS seq, min(m.stack_pos) AS pos FROM s JOIN p m ON s.old <> 0 AND m.stack_id = s.old GROUP BY ALL),
r AS (SELECT grp, id, min((seq, pos)) AS place FROM (SELECT * FROM b UNION ALL SELECT grp, id, seq, 0 FROM s WHERE old = 0) GROUP BY grp, id),
t AS (SELECT grp, arg_min(id, seq) AS top, count(*) AS n FROM s GROUP BY grp)
SELECT r.id, t.top AS stack_id, row_number() OVER (PARTITION BY r.grp ORDER BY r.id <> t.top, r.place, r.id) - 1 AS stack_pos FROM r JOIN t USING (grp) WHERE t.n > 1""")
def stacks_merged(spark, sf):
    df = photos(spark, sf)
    chosen = df.where("id % 10 in (1, 5)").select(F.floor(F.col("id") / 30).alias("group"), "id", F.col("id").alias("seq"))
    return stacks.stack(df, chosen)


@query(f"""{P}, s AS (SELECT id, stack_id, stack_pos, id % 3 = 0 AS gone FROM p WHERE stack_id <> 0), t AS (SELECT *, bool_or(gone) OVER (PARTITION BY stack_id) AS touched, count(*) FILTER (WHERE NOT gone) OVER (PARTITION BY stack_id) AS left_n FROM s)
SELECT id, CASE WHEN NOT gone AND left_n > 1 THEN first_value(id) OVER (PARTITION BY stack_id, gone ORDER BY stack_pos, id) ELSE 0 END AS stack_id, CASE WHEN NOT gone AND left_n > 1 THEN row_number() OVER (PARTITION BY stack_id, gone ORDER BY stack_pos, id) - 1 ELSE 0 END AS stack_pos FROM t WHERE touched""")
def stacks_left(spark, sf):
    df = photos(spark, sf)
    return stacks.unstack(df, df.where("id % 3 = 0").select("id"))


@query(f"""{P}, t AS (SELECT stack_id, min(id) AS top FROM p WHERE stack_id <> 0 AND id % 10 = 2 GROUP BY 1)
SELECT p.id, t.top AS stack_id, row_number() OVER (PARTITION BY p.stack_id ORDER BY p.id <> t.top, p.stack_pos, p.id) - 1 AS stack_pos FROM p JOIN t USING (stack_id)""")
def stacks_new_top(spark, sf):
    df = photos(spark, sf)
    return stacks.to_top(df, df.where("id % 10 = 2").select("id"))


@query(f"{P} SELECT id, CAST(0 AS BIGINT) AS stack_id, 0 AS stack_pos FROM p WHERE stack_id <> 0 AND stack_id IN (SELECT stack_id FROM p WHERE id % 30 = 1)")
def stacks_dissolved(spark, sf):
    df = photos(spark, sf)
    return stacks.dissolve(df, df.where("id % 30 = 1").select("id"))


@query(f"{P} SELECT stack_id, count(*) AS n FROM p WHERE stack_id <> 0 GROUP BY 1")
def stack_sizes(spark, sf):
    return stacks.sizes(photos(spark, sf))


# Keywords, folders, collections ----------------------------------------------------------------------------------------------

WORDS = "SELECT id, i AS place, keywords[i] AS keyword FROM (SELECT id, keywords, unnest(range(1, len(keywords) + 1)) AS i FROM p)"


@query(f"{P}, w AS ({WORDS}) SELECT arg_min(keyword, (id, place)) AS keyword, count(*) AS n FROM w GROUP BY lower(keyword)")
def keyword_counts(spark, sf):
    return catalog.keyword_counts(photos(spark, sf))


@query(f"{P}, w AS ({WORDS}), c AS (SELECT arg_min(keyword, (id, place)) AS keyword, count(*) AS n FROM w GROUP BY lower(keyword)) SELECT * FROM c ORDER BY n DESC, lower(keyword) LIMIT 24")
def keywords_top(spark, sf):
    return catalog.top_keywords(photos(spark, sf))


@query(f"{P} SELECT folder, count(*) AS n FROM p GROUP BY 1")
def folder_counts(spark, sf):
    return catalog.folders(photos(spark, sf))


@query(f"""{P}, w AS ({WORDS}), l AS (SELECT DISTINCT id AS photo_id, keyword FROM w), s AS (SELECT lower(keyword) AS k, min(keyword) AS old FROM l GROUP BY 1),
n AS (SELECT lower(v) AS k, coalesce(old, v) AS keyword FROM (VALUES ('New'), ('TAG3')) x(v) LEFT JOIN s ON k = lower(v))
SELECT * FROM l UNION ALL SELECT p.id, n.keyword FROM p, n WHERE p.id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM l WHERE l.photo_id = p.id AND lower(l.keyword) = n.k)""")
def keywords_added(spark, sf):
    df = photos(spark, sf)
    links = df.select(F.col("id").alias("photo_id"), F.explode("keywords").alias("keyword")).distinct()
    words = spark.createDataFrame([(" New ",), ("TAG3",), ("",)], "keyword string")
    return catalog.add_keywords(links, df.where("id % 100 = 0").select(F.col("id").alias("photo_id")), words)


@query(f"{P}, w AS ({WORDS}) SELECT DISTINCT id AS photo_id, keyword FROM w WHERE NOT (id % 2 = 0 AND lower(keyword) = 'place3')")
def keyword_removed(spark, sf):
    df = photos(spark, sf)
    links = df.select(F.col("id").alias("photo_id"), F.explode("keywords").alias("keyword")).distinct()
    return catalog.remove_keyword(links, df.where("id % 2 = 0").select(F.col("id").alias("photo_id")), "Place3")


MEMBERS = "SELECT l_orderkey % 50 AS collection_id, l_partkey AS photo_id, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2"


@query(f"""WITH m AS ({MEMBERS}), n AS (SELECT o_orderkey % 50 AS collection_id, o_custkey AS photo_id, o_orderkey AS seq FROM orders),
b AS (SELECT collection_id, max(position) AS base FROM m GROUP BY 1),
i AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY seq, photo_id) AS i FROM n),
a AS (SELECT i.collection_id, i.photo_id, min(coalesce(base, 0) + i.i) AS position FROM i LEFT JOIN b USING (collection_id) GROUP BY 1, 2)
SELECT collection_id, photo_id, position FROM m UNION ALL SELECT * FROM a WHERE (collection_id, photo_id) NOT IN (SELECT (collection_id, photo_id) FROM m)""")
def collection_appended(spark, sf):
    members = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("collection_id"), F.col("l_partkey").alias("photo_id")).agg(F.min("l_linenumber").cast("long").alias("position"))
    new = table(spark, sf, "orders").select((F.col("o_orderkey") % 50).alias("collection_id"), F.col("o_custkey").alias("photo_id"), F.col("o_orderkey").alias("seq"))
    return catalog.add_to_collection(members, new)


@query("WITH q AS (SELECT event_id AS photo_id FROM events WHERE event_id % 3 = 0), s AS (SELECT event_id AS photo_id FROM events WHERE event_id % 4 = 0) SELECT photo_id FROM q UNION SELECT photo_id FROM s")
def quick_toggled_in(spark, sf):
    ids = table(spark, sf, "events").select(F.col("event_id").alias("photo_id"))
    return catalog.toggle_quick(ids.where("photo_id % 3 = 0"), ids.where("photo_id % 4 = 0"))


@query("SELECT event_id AS photo_id FROM events WHERE event_id % 3 = 0 AND event_id % 6 <> 0")
def quick_toggled_out(spark, sf):
    ids = table(spark, sf, "events").select(F.col("event_id").alias("photo_id"))
    return catalog.toggle_quick(ids.where("photo_id % 3 = 0"), ids.where("photo_id % 6 = 0"))


@query("""WITH RECURSIVE n AS (SELECT concat('r', r_regionkey) AS id, r_name AS name, NULL AS parent FROM region UNION ALL SELECT concat('n', n_nationkey), n_name, concat('r', n_regionkey) FROM nation UNION ALL SELECT concat('s', s_suppkey), s_name, concat('n', s_nationkey) FROM supplier),
t AS (SELECT id, name, name AS path, 1 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, n.name, concat(t.path, '/', n.name), t.depth + 1 FROM n JOIN t ON n.parent = t.id) SELECT * FROM t""")
def hierarchy_paths(spark, sf):
    text_id = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = table(spark, sf, "region").select(text_id("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.unionByName(table(spark, sf, "nation").select(text_id("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), text_id("r", "n_regionkey").alias("parent")))
    nodes = nodes.unionByName(table(spark, sf, "supplier").select(text_id("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), text_id("n", "s_nationkey").alias("parent")))
    return catalog.hierarchy(spark, nodes)


# Changes ------------------------------------------------------------------------------------------------------------------


@query(f"{P}, g AS (SELECT id FROM p WHERE id % 50 = 0 UNION SELECT id FROM p WHERE master IN (SELECT id FROM p WHERE id % 50 = 0)) SELECT id, path FROM p WHERE id NOT IN (SELECT id FROM g)")
def photos_removed(spark, sf):
    df = photos(spark, sf)
    return catalog.remove_photos(df, df.where("id % 50 = 0").select("id"), {})["photos"].select("id", "path")


@query(f"{P} SELECT id, CASE WHEN id % 5 = 0 THEN 5 ELSE rating END AS rating, CASE WHEN id % 5 = 0 THEN -flag ELSE flag END AS flag FROM p")
def photos_updated(spark, sf):
    df = photos(spark, sf)
    return catalog.set_where(df, df.where("id % 5 = 0").select("id"), rating=5, flag=-F.col("flag")).select("id", "rating", "flag")


@query(f"""{P}, c AS (SELECT master AS m, count(*) AS have FROM p WHERE master IS NOT NULL GROUP BY 1), s AS (SELECT *, coalesce(master, id) AS m FROM p WHERE id % 9 = 0)
SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY s.id) AS id, s.m AS master, concat('Copy ', coalesce(c.have, 0) + row_number() OVER (PARTITION BY s.m ORDER BY s.id)) AS copy_name, s.rating, s.id AS source FROM s LEFT JOIN c USING (m)""")
def virtual_copies(spark, sf):
    df = photos(spark, sf)
    return catalog.virtual_copies(df, df.where("id % 9 = 0").select("id")).select("id", "master", "copy_name", "rating", "source")


@query(f"{P}, t AS (SELECT id, label FROM p WHERE id % 40 < 2) SELECT id, CASE WHEN (SELECT bool_and(label = 2) FROM t) THEN 0 ELSE 2 END AS label FROM t")
def label_applied(spark, sf):
    df = photos(spark, sf)
    return catalog.label_or_clear(df, df.where("id % 40 < 2").select("id"), 2)


@query("SELECT event_type AS key, arg_max(event_id, event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1")
def latest_by_key(spark, sf):
    return catalog.latest(table(spark, sf, "events").select(F.col("event_type").alias("key"), "event_id", "user_id", F.col("event_id").alias("seq")), ["key"], "seq").select("key", "event_id", "user_id")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def rows_deleted(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return catalog.without(df, df.where("o_orderkey % 2 <> 0").select("o_orderkey"), "o_orderkey")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 7 = 0")
def rows_upserted(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    new = old.where("id % 3 = 0").select("id", F.lit("new").alias("value")).unionByName(old.where("id % 7 = 0").select((-F.col("id")).alias("id"), F.lit("new").alias("value")))
    return catalog.upsert(old, new, ["id"])


# History ------------------------------------------------------------------------------------------------------------------


@query(f"{H} SELECT id, photo_id, label FROM h QUALIFY row_number() OVER (PARTITION BY photo_id ORDER BY id DESC) <= 5")
def history_kept(spark, sf):
    return catalog.keep_newest(history(spark, sf), ["photo_id"], "id", 5).select("id", "photo_id", "label")


@query(f"""{H}, n AS (SELECT *, lead(label) OVER w AS next, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000 AS after FROM h WINDOW w AS (PARTITION BY photo_id ORDER BY ts, id))
SELECT id, photo_id, label FROM n WHERE NOT coalesce(next = label AND after < 3600000, false)""")
def history_coalesced(spark, sf):
    return catalog.coalesced(history(spark, sf), "photo_id", 3_600_000).select("id", "photo_id", "label")


@query(f"{H} SELECT id, photo_id FROM h WHERE id <= 500")
def history_truncated(spark, sf):
    return history(spark, sf).where("id <= 500").select("id", "photo_id")


# People -------------------------------------------------------------------------------------------------------------------


@query(f"{FC} SELECT person, max((w * score, face_id))[2] AS face_id FROM f WHERE person > 0 GROUP BY 1")
def person_covers(spark, sf):
    return people.covers(faces(spark, sf))


@query(f"{FC} SELECT person, count(DISTINCT photo_id) AS photos, count(*) AS faces FROM f WHERE person > 0 GROUP BY 1")
def person_counts(spark, sf):
    return people.people_list(faces(spark, sf))


@query(f"""{FC}, s AS (SELECT person, i, sum(CAST(emb[i] AS DOUBLE)) AS s FROM (SELECT person, emb, unnest(range(1, len(emb) + 1)) AS i FROM f WHERE person > 0) GROUP BY 1, 2),
c AS (SELECT person, list(s ORDER BY i) AS v FROM s GROUP BY 1), u AS (SELECT person, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-6)) AS v FROM c),
d AS (SELECT face_id, person, list_dot_product(CAST(emb AS DOUBLE[]), v) AS s FROM (SELECT face_id, emb FROM f WHERE person = 0), u),
b AS (SELECT face_id, arg_max(person, (s, -person)) AS person, max(s) AS s FROM d GROUP BY 1) SELECT face_id, person, round(s, 6) AS similarity FROM b WHERE s >= 0.2""")
def faces_assigned(spark, sf):
    return people.assign_known(faces(spark, sf), 0.2).withColumn("similarity", F.round("similarity", 6))


@query(f"{FC} SELECT face_id, CASE WHEN person = 3 THEN 5 ELSE person END AS person FROM f")
def people_merged(spark, sf):
    return people.merge(faces(spark, sf), 3, 5).select("face_id", "person")


@query()
def face_groups(spark, sf):
    """Leader grouping depends on order, so SQL does not express it; tests hold it against a plain loop."""
    return people.lead_groups(faces(spark, sf).withColumn("event", F.floor(F.col("photo_id") / 64)), 0.3, "event")


@query(f"{FC}, n AS (SELECT face_id AS a, emb, lead(face_id) OVER w AS b, lead(emb) OVER w AS other FROM f WINDOW w AS (PARTITION BY person ORDER BY face_id)) SELECT a, b, round(list_dot_product(CAST(emb AS DOUBLE[]), CAST(other AS DOUBLE[])) / greatest(sqrt(list_dot_product(CAST(emb AS DOUBLE[]), CAST(emb AS DOUBLE[]))) * sqrt(list_dot_product(CAST(other AS DOUBLE[]), CAST(other AS DOUBLE[]))), 1e-12), 6) AS s FROM n WHERE b IS NOT NULL")
def face_similarity(spark, sf):
    """Each face beside the next of its person."""
    w = Window.partitionBy("person").orderBy("face_id")
    pairs = faces(spark, sf).select(F.col("face_id").alias("a"), "emb", F.lead("face_id").over(w).alias("b"), F.lead("emb").over(w).alias("other"))
    return pairs.where("b is not null").select("a", "b", F.round(vector.cosine(F.col("emb"), F.col("other")), 6).alias("s"))


# Planning -----------------------------------------------------------------------------------------------------------------

FILES_SQL = "SELECT concat('/disk/d', CAST(event_id % 9 AS STRING), '/', CASE WHEN event_id % 13 = 0 THEN '.' ELSE '' END, 'IMG_', CAST(event_id % 1200 AS STRING), CASE event_id % 3 WHEN 0 THEN '.cr3' WHEN 1 THEN '.JPG' ELSE '.txt' END) AS path, 1000000 + event_id % 700 AS size FROM events"


def files(spark, sf):
    return spark.sql(FILES_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events"))


@query(f"{P}, d AS ({FILES_SQL}) SELECT path, size FROM d WHERE (path LIKE '%.cr3' OR path LIKE '%.JPG') AND path NOT LIKE '%/.%' AND lower(path) NOT IN (SELECT lower(replace(path, '/photos/u', '/disk/d')) FROM p WHERE master IS NULL)")
def import_candidates(spark, sf):
    moved = photos(spark, sf).withColumn("path", F.replace("path", F.lit("/photos/u"), F.lit("/disk/d")))
    return planning.new_files(files(spark, sf), moved)


@query(f"""{P}, d AS ({FILES_SQL}), n AS (SELECT path AS new_path, size, lower(string_split(path, '/')[-1]) AS n FROM d),
m AS (SELECT p.id, p.path, min((CASE WHEN p.file_size = 0 OR p.file_size = n.size THEN 0 ELSE 1 END, n.new_path)) AS b FROM p JOIN n ON lower(p.file_name) = n.n WHERE p.missing AND p.master IS NULL GROUP BY 1, 2)
SELECT id, path, b[2] AS new_path FROM m""")
def relink_plan(spark, sf):
    return planning.relink(photos(spark, sf), files(spark, sf))


@query(f"{P} SELECT id, concat('/photos/moved', substr(path, 11)) AS new_path FROM p WHERE path LIKE '/photos/u1/%' AND id % 2 = 0")
def relocate_plan(spark, sf):
    df = photos(spark, sf)
    there = df.where("id % 2 = 0").select(F.concat(F.lit("/photos/moved"), F.substr("path", F.lit(11))).alias("path"))
    listed = there.where("path like '/photos/moved/%'")
    return planning.relocate(df.where("id % 2 = 0"), listed, "/photos/u1", "/photos/moved")


STEM = "regexp_replace(file_name, '\\.[^.]*$', '')"
DATE = "CASE WHEN capture_time IS NULL THEN '' ELSE replace(substr(capture_time, 1, 10), '-', '') END"


@query(f"""{P}, s AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS seq FROM p),
n AS (SELECT id, path, seq, concat(folder, '/', {DATE}, '_', lpad(CAST(1 + seq % 20 AS STRING), 3, '0'), '_', rating, '.', string_split(file_name, '.')[-1]) AS new_path FROM s),
a AS (SELECT *, row_number() OVER (PARTITION BY lower(new_path) ORDER BY seq) > 1 AS again FROM n)
SELECT id, path, new_path, again OR (new_path <> path AND new_path IN (SELECT path FROM p) AND new_path NOT IN (SELECT path FROM a)) AS conflict FROM a""")
def rename_plan(spark, sf):
    df = photos(spark, sf)
    chosen = views.numbered(df, [F.col("id")], "seq")
    numbered = chosen.withColumn("order", F.col("seq")).withColumn("seq", F.col("seq") % 20)
    stem = text.file_stem("{date}_{seq:3}_{rating}", F.col("seq") + 1)
    plan = planning.rename_plan(numbered.withColumn("file_name", F.concat(stem, F.lit("."), F.substring_index("file_name", ".", -1))).drop("seq").withColumnRenamed("order", "seq").withColumn("master", F.lit(None).cast("long")), df.select("path"), "{name}")
    return plan


@query(f"""{P} SELECT id, concat({DATE}, '_', lpad(CAST(id AS STRING), CAST(greatest(5, length(CAST(id AS STRING))) AS INT), '0'), '_', CASE WHEN master IS NOT NULL THEN concat({STEM}, '-', replace(copy_name, ' ', '')) ELSE {STEM} END, '-', coalesce(model, ''), '-r', rating) AS stem FROM p""")
def export_names(spark, sf):
    return photos(spark, sf).select("id", text.file_stem("{date}_{seq:5}_{name}-{camera}-r{rating}", F.col("id")).alias("stem"))


@query(f"""{P}, i AS (SELECT id, concat('/out/', folder[9:]) AS dir, concat('s', id % 40) AS stem, 'jpg' AS ext FROM p), r AS (SELECT *, id % 40 AS n, row_number() OVER (PARTITION BY dir, stem ORDER BY id) AS rn FROM i),
f AS (SELECT *, list_filter(range(1, rn + 5), lambda x: NOT ((x = 1 AND n % 3 = 0) OR (x = 2 AND n % 5 = 0) OR (x = 3 AND n % 4 = 0)))[rn] AS free FROM r)
SELECT id, concat(dir, '/', stem, CASE WHEN free > 1 THEN concat('-', CAST(free AS STRING)) ELSE '' END, '.', ext) AS out_path FROM f""")
def export_paths(spark, sf):
    items = photos(spark, sf).select("id", F.concat(F.lit("/out/"), F.substr("folder", F.lit(9))).alias("dir"), F.concat(F.lit("s"), (F.col("id") % 40).cast("string")).alias("stem"), F.lit("jpg").alias("ext"), F.col("id").alias("seq"))
    n = F.regexp_extract("stem", r"(\d+)", 1).cast("int")
    there = F.array_compact(F.array(F.when(n % 3 == 0, ".jpg"), F.when(n % 5 == 0, "-2.jpg"), F.when(n % 4 == 0, "-3.jpg")))
    files = items.select("dir", "stem").distinct().select("dir", "stem", F.explode(there).alias("end")).select(F.concat("dir", F.lit("/"), "stem", "end").alias("path"))
    return planning.export_paths(items, files)


@query(f"""{P}, i AS (SELECT id, concat(folder, '/', {STEM}, '.jpg') AS f FROM p) SELECT id, f AS out_path FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS rn FROM i) WHERE rn = 1 AND f NOT IN (SELECT path FROM p)""")
def export_skipping(spark, sf):
    df = photos(spark, sf)
    items = df.select("id", F.col("folder").alias("dir"), text.stem_of(F.col("file_name")).alias("stem"), F.lit("jpg").alias("ext"), F.col("id").alias("seq"))
    return planning.export_paths(items, df.select("path"), "skip")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) * 100 AS BIGINT) AS w, CAST(floor(l_extendedprice) AS BIGINT) AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, greatest(CAST(round(w * k) AS BIGINT), 1) AS out_w, greatest(CAST(round(h * k) AS BIGINT), 1) AS out_h FROM (SELECT *, least(2000.0::DOUBLE / greatest(w, h), 1.0::DOUBLE) AS k FROM s)""")
def export_sizes(spark, sf):
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(floor(l_quantity) * 100 as bigint)").alias("w"), F.expr("cast(floor(l_extendedprice) as bigint)").alias("h"))
    w, h = planning.target_size(F.col("w"), F.col("h"), "long_edge", 2000, enlarge=False)
    return s.select("l_orderkey", "l_linenumber", w.alias("out_w"), h.alias("out_h"))


@query(f"{P}, r AS (SELECT id, folder, row_number() OVER (PARTITION BY folder ORDER BY id) - 1 AS seq FROM p) SELECT id, CAST(seq // 12 AS BIGINT) AS page, CAST((seq % 12) // 4 AS BIGINT) AS \"row\", CAST(seq % 4 AS BIGINT) AS \"column\" FROM r")
def print_pages(spark, sf):
    df = photos(spark, sf).withColumn("seq", (F.row_number().over(Window.partitionBy("folder").orderBy("id")) - 1).cast("long"))
    return planning.pages(df, 3, 4).select("id", "page", "row", "column")


@query("SELECT event_id, CASE WHEN v <= 0 THEN 0 WHEN v < 1 AND abs(1 / d - v) < v * 0.01 THEN 1 ELSE CAST(round(v * 10000) AS BIGINT) END AS num, CASE WHEN v <= 0 THEN 1 WHEN v < 1 AND abs(1 / d - v) < v * 0.01 THEN CAST(d AS BIGINT) ELSE 10000 END AS den FROM (SELECT event_id, v, greatest(round(1 / v), 1) AS d FROM (SELECT event_id, CAST(1 AS DOUBLE) / (1 + event_id % 250) AS v FROM events))")
def rationals(spark, sf):
    v = F.lit(1.0) / (1 + F.col("event_id") % 250)
    return table(spark, sf, "events").select("event_id", text.rational(v).alias("r")).select("event_id", "r.num", "r.den")


@query(r"""SELECT doc_id, substr(sha256(text), 1, 24) AS key, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[<>:"/\\|?*\x00-\x1f\x7f-\x{9f}]', '_', 'g'), '^\s+|\s+$', '', 'g'), '\.+$', '')) AS name FROM documents""")
def content_keys(spark, sf):
    """Keys of contents, and whole texts made names."""
    return table(spark, sf, "documents").select("doc_id", text.content_key(F.col("text")).alias("key"), F.sha2(text.sanitize(F.col("text")), 256).alias("name"))


# Numbers ------------------------------------------------------------------------------------------------------------------

PIXELS = "SELECT l_suppkey % 20 AS image, CAST(l_quantity * 5 AS INT) AS r, CAST(floor(l_discount * 2000) AS INT) AS g, CAST(floor(l_tax * 3000) AS INT) AS b FROM lineitem"


def pixels(spark, sf):
    return spark.sql(PIXELS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf, "lineitem"))


HIST = f"SELECT image, channel, CAST(bin AS INT) AS bin, count(*) AS n FROM (SELECT image, unnest([{{'channel': 'r', 'bin': r}}, {{'channel': 'g', 'bin': g}}, {{'channel': 'b', 'bin': b}}, {{'channel': 'l', 'bin': CAST(least(floor(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b), 255) AS INT)}}], recursive := true) FROM ({PIXELS})) GROUP BY ALL"


@query(HIST)
def histograms(spark, sf):
    return stats.histogram(pixels(spark, sf), ["image"])


@query(f"""WITH h AS ({HIST}), c AS (SELECT image, bin, sum(n) OVER (PARTITION BY image ORDER BY bin) AS acc, sum(n) OVER (PARTITION BY image) AS total FROM h WHERE channel = 'l'),
p AS (SELECT image, min(bin) FILTER (acc >= floor(total * 0.005::DOUBLE)) / 255.0::DOUBLE AS lo, min(bin) FILTER (acc >= floor(total * 0.5::DOUBLE)) / 255.0::DOUBLE AS mid, min(bin) FILTER (acc >= floor(total * 0.995::DOUBLE)) / 255.0::DOUBLE AS hi FROM c GROUP BY 1)
SELECT image, greatest(-5.0, least(5.0, round(image / 10.0::DOUBLE + greatest(-2.5, least(2.5, log2(pow(0.46 / greatest(mid, 0.02), 2.2)))) * 0.7, 2))) AS exposure,
round(CASE WHEN hi > 0.97 THEN -greatest(0.0, least(60.0, (hi - 0.9) * 600)) ELSE 0.0 END) AS highlights, round(CASE WHEN lo < 0.05 THEN greatest(0.0, least(45.0, (0.08 - lo) * 500)) ELSE 0.0 END) AS shadows,
round(greatest(-30.0, least(40.0, (0.98 - hi) * 150))) AS whites, round(greatest(-30.0, least(20.0, (0.02 - lo) * -150))) AS blacks, round(greatest(-20.0, least(30.0, (0.85 - (hi - lo)) * 60))) AS contrast, greatest(image * 2.0, 10.0) AS vibrance FROM p""")
def auto_tone(spark, sf):
    hist = stats.histogram(pixels(spark, sf), ["image"]).where("channel = 'l'")
    return stats.auto_tone(hist, ["image"], hist.select("image", (F.col("image") / 10.0).alias("exposure"), (F.col("image") * 2.0).alias("vibrance")).distinct())


LIGHT = "CASE WHEN exposure > 0 AND iso > 0 AND fnumber > 0 THEN log2(exposure) + log2(iso / 100.0::DOUBLE) - 2 * log2(fnumber) END"


@query(f"""{P}, l AS (SELECT id, folder, {LIGHT} AS light FROM p), r AS (SELECT l.folder, l.id AS ref, l.light AS ref_light FROM l JOIN (SELECT folder, min(id) AS id FROM p WHERE iso IS NOT NULL GROUP BY 1) m USING (id))
SELECT l.id, l.folder, greatest(-5.0, least(5.0, round(0.5 + ref_light - light, 2))) AS ev FROM l JOIN r USING (folder) WHERE l.id <> ref AND light IS NOT NULL""")
def exposures_matched(spark, sf):
    df = photos(spark, sf)
    ref = df.where("iso is not null").groupBy("folder").agg(F.min("id").alias("id")).select("id", F.lit(0.5).alias("base"))
    return stats.match_exposures(df, ref, "folder")


@query("WITH c AS (SELECT l_suppkey % 10 AS image, CAST(l_discount AS DOUBLE) + 0.03 AS a, l_tax + 0.025 AS b FROM lineitem), g AS (SELECT image, b / a AS r FROM c WHERE a > 0.02 AND a < 0.7 AND b > 0.02 AND b < 0.7), n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY r) - 1 AS rn, count(*) OVER (PARTITION BY image) AS n FROM g) SELECT image, round(CASE WHEN max(n) >= 50 THEN max(r) FILTER (rn = n // 2) ELSE 1.0 END, 9) AS median FROM n GROUP BY 1")
def exposure_ratios(spark, sf):
    cells = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("image"), (F.col("l_discount") + 0.03).alias("a"), (F.col("l_tax") + 0.025).alias("b"))
    return stats.exposure_ratio(cells, ["image"]).withColumn("median", F.round("median", 9))


@query("SELECT l_partkey AS pixel, round(CASE WHEN sum(w) > 0 THEN sum(l_extendedprice * w) / sum(w) ELSE arg_min(l_extendedprice, o) END, 1) AS value FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN 0 ELSE l_quantity END AS w, l_orderkey * 10 + l_linenumber AS o FROM lineitem) GROUP BY 1")
def exposures_merged(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pixel"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_discount") > 0.05, 0.0).otherwise(F.col("l_quantity")).alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return stats.weighted_merge(s, ["pixel"], "value", "w", "o").withColumn("value", F.round("value", 1))


@query("SELECT event_id, round(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE 1.055 * pow(v, 1 / 2.4::DOUBLE) - 0.055 END, 9) AS enc, round(CASE WHEN v <= 0.04045 THEN v / 12.92 ELSE pow((v + 0.055) / 1.055, 2.4) END, 9) AS dec FROM (SELECT event_id, (event_id % 1001) / 1000.0::DOUBLE AS v FROM events)")
def srgb_transfer(spark, sf):
    v = (F.col("event_id") % 1001) / 1000.0
    return table(spark, sf, "events").select("event_id", F.round(color.srgb_encode(v), 9).alias("enc"), F.round(color.srgb_decode(v), 9).alias("dec"))


@query(f"""SELECT image, r, g, b, round(CASE WHEN c = 0 THEN 0 WHEN mx = r THEN ((g - b) / c + CASE WHEN g < b THEN 6 ELSE 0 END) * 60 WHEN mx = g THEN ((b - r) / c + 2) * 60 ELSE ((r - g) / c + 4) * 60 END, 6) AS hue, c AS chroma FROM
(SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS c FROM (SELECT DISTINCT image, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM ({PIXELS})))""")
def hues(spark, sf):
    df = pixels(spark, sf).select("image", *(F.col(c).cast("double").alias(c) for c in "rgb")).distinct()
    hue, chroma = color.hue_chroma(F.col("r"), F.col("g"), F.col("b"))
    return df.select("image", "r", "g", "b", F.round(hue, 6).alias("hue"), chroma.alias("chroma"))


@query("SELECT n_nationkey, p_partkey, round(a, 9) AS a FROM (SELECT n_nationkey, p_partkey, t * t * (3 - 2 * t) AS a FROM (SELECT n_nationkey, p_partkey, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p_size - n_nationkey) / 10.0::DOUBLE)) AS t FROM part JOIN nation ON p_partkey % 25 = n_nationkey))")
def smooth_steps(spark, sf):
    df = table(spark, sf, "part").join(table(spark, sf, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    return df.select("n_nationkey", "p_partkey", F.round(color.smoothstep(F.col("n_nationkey"), F.col("n_nationkey") + 10.0, F.col("p_size")), 9).alias("a"))


# Lenses -------------------------------------------------------------------------------------------------------------------

LENS_NAME = "concat(p_brand, ' EF', 10 + p_size, '-', 60 + p_size * 2, 'mm f/2.80 ', split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2))"


@query(f"SELECT p_partkey, CAST(10 + p_size AS DOUBLE) AS low, CAST(60 + p_size * 2 AS DOUBLE) AS high FROM (SELECT p_partkey, p_size, {LENS_NAME} AS n FROM part)")
def lens_focals(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.expr("concat(p_brand, ' ', cast(10 + p_size as string), '-', cast(60 + p_size * 2 as string), 'mm f/2.80')").alias("n"))
    return df.select("p_partkey", text.name_focal(F.col("n")).alias("f")).select("p_partkey", "f.low", "f.high")


@query("""WITH c AS (SELECT s_nationkey AS lens, s_suppkey, CAST(20 + s_suppkey % 60 AS DOUBLE) AS focal, CAST(2 + s_suppkey % 5 AS DOUBLE) AS aperture, CAST(1 + s_suppkey % 90 AS DOUBLE) AS distance, s_acctbal / 10000 AS k FROM supplier),
q AS (SELECT c_custkey AS shot, c_nationkey AS lens, CAST(20 + c_custkey % 61 AS DOUBLE) AS focal, CAST(2 + c_custkey % 6 AS DOUBLE) AS aperture, 10.0::DOUBLE AS distance FROM customer),
d AS (SELECT q.shot, c.s_suppkey, c.k, sqrt(pow((c.focal - q.focal) / 60, 2) + pow(4 / c.aperture - 4 / q.aperture, 2) + pow(0.1 / c.distance - 0.1 / q.distance, 2)) AS d FROM q JOIN c USING (lens)),
a AS (SELECT shot, min(d) AS least, arg_min(k, (d, k)) AS hit, sum(k * pow(greatest(d, 1e-9), -3.5)) / sum(pow(greatest(d, 1e-9), -3.5)) AS mean FROM d GROUP BY 1) SELECT shot, round(CASE WHEN least < 1e-4 THEN hit ELSE mean END, 6) AS k FROM a WHERE least <= 1""")
def vignetting_interpolated(spark, sf):
    points = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("lens"), F.lit(20.0).alias("low"), F.lit(80.0).alias("high"), (20 + F.col("s_suppkey") % 60).cast("double").alias("focal"), (2 + F.col("s_suppkey") % 5).cast("double").alias("aperture"), (1 + F.col("s_suppkey") % 90).cast("double").alias("distance"), F.array(*[F.col("s_acctbal") / 10000] * 3).alias("k"))
    shots = table(spark, sf, "customer").select(F.col("c_custkey").alias("shot"), F.col("c_nationkey").alias("lens"), (20 + F.col("c_custkey") % 61).cast("double").alias("focal"), (2 + F.col("c_custkey") % 6).cast("double").alias("aperture"), F.lit(10.0).alias("distance"))
    return lens.vignetting(shots, points).select("shot", F.round(F.col("k")[0], 6).alias("k"))


@query()
def distortion_interpolated(spark, sf):
    """Hermite terms between calibration points; tests hold it against the formulas in numpy."""
    points = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("lens"), (10 + F.col("s_suppkey") % 7 * 10).cast("double").alias("focal")).agg(F.avg("s_acctbal").alias("a")).select("lens", "focal", F.array(F.col("a") / 1e5, F.col("a") / 2e5, F.lit(0.0)).alias("t"))
    shots = spread(table(spark, sf, "customer"), "c_custkey").select(F.col("c_custkey").alias("shot"), F.col("c_nationkey").alias("lens"), (5 + F.col("c_custkey") % 80).cast("double").alias("focal"))
    out = lens.interpolated(shots, points, [True, True, True])
    return out.select("shot", F.round(lens.dist_ratio("ptlens", F.col("t"), F.lit(0.7)), 9).alias("ratio"))


@query("""WITH n AS (SELECT p_partkey, p_size, concat('EF', 10 + p_size, '-', 60 + p_size * 2, 'mm f/2.80 ', p_name) AS n,
list_distinct(list_concat(['ef', CAST(10 + p_size AS STRING), CAST(60 + p_size * 2 AS STRING), '2.8'], list_filter(regexp_extract_all(lower(p_name), '[a-z]+|[0-9][0-9.]*'), lambda x: x NOT IN ('mm', 'f')))) AS w FROM part),
m AS (SELECT a.p_partkey AS shot, b.n AS lens, len(list_intersect(a.w, b.w)) AS i, len(a.w) + 1 AS nw, len(b.w) AS nl FROM n a JOIN n b ON a.p_size = b.p_size AND b.p_partkey % 3 = 0),
s AS (SELECT shot, lens, CAST(i AS DOUBLE) / (nw + nl - i) + 0.5::DOUBLE * i / nw AS score FROM m)
SELECT shot, arg_min(lens, (-score, lens)) AS lens, round(max(score), 9) AS score FROM s WHERE score > 0.7 GROUP BY 1""")
def lens_matches(spark, sf):
    """The best lens by name tokens within a focal range."""
    df = table(spark, sf, "part").select("p_partkey", "p_size", F.expr("concat('EF', cast(10 + p_size as string), '-', cast(60 + p_size * 2 as string), 'mm f/2.80 ', p_name)").alias("n"))
    return lens.find(df.select(F.col("p_partkey").alias("shot"), F.col("n").alias("name"), F.lit(1.0).alias("crop")), df.where("p_partkey % 3 = 0").select(F.col("n").alias("lens"), F.lit(1.0).alias("crop"))).withColumn("score", F.round("score", 9))


# Session and sensor -----------------------------------------------------------------------------------------------------------


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1 ORDER BY ts DESC, user_id LIMIT 8")
def recently_used(spark, sf):
    return session.recent(table(spark, sf, "events").select("user_id", "ts"), "user_id", "ts")


STAMPS = "SELECT user_id % 20 AS cat, concat(replace(replace(substr(CAST(ts AS STRING), 1, 19), ':', ''), '/', ''), CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END) AS name FROM events"


@query(f"SELECT cat, name FROM (SELECT DISTINCT * FROM ({STAMPS}) WHERE name NOT LIKE '%x') QUALIFY row_number() OVER (PARTITION BY cat ORDER BY name DESC) > 5")
def backups_pruned(spark, sf):
    stamps = spark.sql(STAMPS.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events")).distinct()
    return session.stale_backups(stamps, 5, "cat")


@query(f"{H}, s AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY id) - 1 AS pos FROM h), c AS (SELECT photo_id, max(pos) AS pos FROM s GROUP BY 1) SELECT s.photo_id, s.id, s.label FROM s JOIN c ON s.photo_id = c.photo_id AND s.pos = c.pos - 1")
def undo_step(spark, sf):
    h = history(spark, sf)
    now = h.groupBy("photo_id").agg((F.count("*") - 1).alias("pos"))
    return session.at_step(h, now, -1).select("photo_id", "id", "label")


@query("SELECT c_custkey AS id, c_custkey AS seq FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, (SELECT max(c_custkey) FROM customer WHERE c_custkey % 3 = 0) + 1 + c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 <> 0")
def selection_toggled(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"))
    return session.toggled(c.where("id % 3 = 0"), c.where("id % 5 = 0"))


@query("""SELECT c_custkey, label, CASE WHEN regexp_full_match(label, 'Exposure .+ of .+') THEN regexp_replace(label, '^Exposure (.+?) of (.+)$', '\\2: Belichtung \\1')
WHEN regexp_full_match(label, 'Crop .+') THEN regexp_replace(label, '^Crop (.+)$', 'Zuschnitt (\\1)') ELSE label END AS text
FROM (SELECT c_custkey, concat(CASE c_custkey % 3 WHEN 0 THEN 'Exposure ' WHEN 1 THEN 'Crop ' ELSE 'Other ' END, CAST(c_custkey % 17 AS STRING), CASE WHEN c_custkey % 2 = 0 THEN concat(' of ', c_mktsegment) ELSE '' END) AS label FROM customer)""")
def labels_translated(spark, sf):
    templates = {"Exposure {} of {}": "{1}: Belichtung {0}", "Crop {}": "Zuschnitt ({})"}
    kind = F.when(F.col("c_custkey") % 3 == 0, "Exposure ").when(F.col("c_custkey") % 3 == 1, "Crop ").otherwise("Other ")
    label = F.concat(kind, (F.col("c_custkey") % 17).cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" of "), "c_mktsegment")).otherwise(""))
    return session.translated(table(spark, sf, "customer").select("c_custkey", label.alias("label")), templates)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - b) / (w - b), 9) AS v FROM (SELECT *, [1.0, 2.0, 3.0, 4.0][CAST((l_linenumber % 2) * 2 + l_orderkey % 2 + 1 AS INT)] AS b, [50.0, 60.0, 70.0, 80.0][CAST((l_linenumber % 2) * 2 + l_orderkey % 2 + 1 AS INT)] AS w FROM lineitem)")
def sensor_scaled(spark, sf):
    v = sensor.scaled(F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"), [1.0, 2.0, 3.0, 4.0], [50.0, 60.0, 70.0, 80.0])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(v, 9).alias("v"))


@query("WITH s AS (SELECT p_partkey, CAST(p_size * 100 AS BIGINT) AS w, CAST(1000 + p_partkey % 900 AS BIGINT) AS h FROM part), c AS (SELECT *, CASE WHEN w / h > 1.5 THEN round(h * 1.5) ELSE w END AS cw, CASE WHEN w / h > 1.5 THEN h ELSE round(w / 1.5) END AS ch FROM s) SELECT p_partkey, CAST(floor((w - cw) / 2) AS BIGINT) AS x, CAST(floor((h - ch) / 2) AS BIGINT) AS y, CAST(cw AS BIGINT) AS w, CAST(ch AS BIGINT) AS h FROM c")
def aspect_crops(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", sensor.aspect_crop((F.col("p_size") * 100).cast("double"), (1000 + F.col("p_partkey") % 900).cast("double"), F.lit(1.5)).alias("r"))
    return p.select("p_partkey", "r.x", "r.y", "r.w", "r.h")


@query("SELECT event_id, regexp_replace(props, '[^0-9]', '', 'g') AS digits, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_parsed(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.regexp_replace("props", "[^0-9]", "").alias("digits"), F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))
