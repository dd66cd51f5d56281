"""Derived tables of the queries, each from the star-schema tables by the same expressions in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Photos from events: expressions that Spark SQL and DuckDB read alike.
PHOTOS = """
SELECT event_id AS id, concat('/photos/u', CAST(user_id % 50 AS STRING)) AS folder,
  concat('IMG_', CAST(event_id % 1000 AS STRING), '.', CASE event_type WHEN 'view' THEN 'CR3' WHEN 'click' THEN 'jpg' WHEN 'purchase' THEN 'NEF' WHEN 'signup' THEN 'HEIC' ELSE 'png' END) AS file_name,
  CASE event_type WHEN 'view' THEN 'CR3' WHEN 'click' THEN 'JPG' WHEN 'purchase' THEN 'NEF' WHEN 'signup' THEN 'HEIC' ELSE 'PNG' END AS ext,
  event_type IN ('view', 'purchase') AS is_raw,
  CAST(event_id % 6 AS INT) AS rating, CAST(event_id % 3 - 1 AS INT) AS flag, CAST(CAST(floor(event_id / 7.0) AS BIGINT) % 6 AS INT) AS label,
  concat('Title ', CAST(event_id % 13 AS STRING)) AS title,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('Caption of ', event_type) END AS caption,
  CASE event_id % 4 WHEN 0 THEN 'Canon' WHEN 1 THEN 'SONY' WHEN 2 THEN 'Nikon' END AS make,
  concat('Model ', CAST(event_id % 7 AS STRING)) AS model,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('EF24-', CAST(70 + event_id % 3 * 35 AS STRING), 'mm f/2.8') END AS lens,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE substr(CAST(ts AS STRING), 1, 19) END AS capture_time,
  CAST(CASE WHEN event_id % 9 = 0 THEN NULL ELSE 100 * (1 + event_id % 64) END AS INT) AS iso,
  CAST(CASE WHEN event_id % 8 = 0 THEN NULL ELSE 10 + event_id % 90 END AS DOUBLE) AS focal,
  CAST(1.0 AS DOUBLE) / (1 + event_id % 250) AS exposure, CAST(1 + event_id % 10 AS DOUBLE) AS fnumber,
  CASE WHEN event_id % 17 = 0 THEN event_id + 1 END AS master, CASE WHEN event_id % 17 = 0 THEN 'Copy 1' ELSE '' END AS copy_name,
  CAST(floor(event_id / 100.0) AS BIGINT) AS import_id,
  CASE WHEN event_id % 3 = 0 THEN 1700000000 + event_id ELSE 0 END AS exported_at,
  CASE WHEN event_id % 4 = 1 THEN 1700000000 + event_id ELSE 0 END AS edited_at, event_id % 4 = 1 AS edited,
  CASE WHEN event_id % 10 < 3 THEN event_id - event_id % 10 + 1 ELSE 0 END AS stack_id, CAST(CASE WHEN event_id % 10 < 3 THEN event_id % 10 ELSE 0 END AS INT) AS stack_pos,
  event_id % 29 = 0 AS missing, 1000000 + event_id % 5000 AS file_size
FROM events
"""
#: Keywords of a photo: up to three, of mixed case, as an array in either engine.
KEYWORDS = ["CASE WHEN id % 3 = 0 THEN concat('Place', CAST(id % 20 AS STRING)) END", "CASE WHEN id % 4 = 0 THEN concat('PLACE', CAST(id % 8 AS STRING)) END", "CASE WHEN id % 5 <> 0 THEN concat('tag', CAST(id % 30 AS STRING)) END"]
#: The same as a DuckDB query.
PHOTOS_SQL = f"SELECT *, concat(folder, '/', file_name) AS path, list_filter([{', '.join(KEYWORDS)}], lambda k: k IS NOT NULL) AS keywords FROM ({PHOTOS})"
#: Faces from embeddings: label 0 is unassigned, one photo for four faces.
FACES_SQL = "SELECT vec_id AS face_id, CAST(floor(vec_id / 4.0) AS BIGINT) AS photo_id, CAST(CASE WHEN label IS NULL THEN -1 ELSE label END AS BIGINT) AS person, CAST(vec_id % 101 AS DOUBLE) / 101 AS score, CAST(10 + vec_id % 37 AS DOUBLE) AS w, embedding AS emb FROM embeddings"
HISTORY_SQL = "SELECT event_id AS id, user_id AS photo_id, event_type AS label, ts FROM events"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows of a small file over all tasks, for work that takes much longer a row than reading it."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def _query(spark: SparkSession, sf_dir: str, name: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {" + name + "}"), **{name: table(spark, sf_dir, name)})


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _query(spark, sf_dir, "events", PHOTOS)
    return df.withColumn("path", F.concat("folder", F.lit("/"), "file_name")).withColumn("keywords", F.array_compact(F.array(*map(F.expr, KEYWORDS))))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "embeddings", FACES_SQL)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, "events", HISTORY_SQL)
