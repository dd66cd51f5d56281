"""The scalars as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: SQL functions that stay in the JVM.
SQL = {
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "capture_secs(t STRING) RETURNS DOUBLE": r"""((((try_cast(nullif(regexp_extract(t, '^\\s*(\\d+)[-:](\\d+)[-:](\\d+)[ T](\\d+):(\\d+)', 1), '') AS DOUBLE) * 372
      + try_cast(nullif(regexp_extract(t, '^\\s*(\\d+)[-:](\\d+)[-:](\\d+)[ T](\\d+):(\\d+)', 2), '') AS DOUBLE) * 31
      + try_cast(nullif(regexp_extract(t, '^\\s*(\\d+)[-:](\\d+)[-:](\\d+)[ T](\\d+):(\\d+)', 3), '') AS DOUBLE)) * 24
      + try_cast(nullif(regexp_extract(t, '^\\s*(\\d+)[-:](\\d+)[-:](\\d+)[ T](\\d+):(\\d+)', 4), '') AS DOUBLE)) * 60
      + try_cast(nullif(regexp_extract(t, '^\\s*(\\d+)[-:](\\d+)[-:](\\d+)[ T](\\d+):(\\d+)', 5), '') AS DOUBLE)) * 60
      + coalesce(try_cast(nullif(regexp_extract(t, ':\\d+:(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), 0D))""",
    "lens_words(name STRING) RETURNS ARRAY<STRING>": r"""array_sort(array_distinct(filter(transform(regexp_extract_all(replace(replace(lower(name), 'f/', 'f '), 'ƒ', 'f'), '([0-9][0-9.]*|(?:(?![0-9])[\\p{L}\\p{N}])+)', 1),
      w -> CASE WHEN contains(w, '.') THEN regexp_replace(regexp_replace(w, '0+$', ''), '\\.+$', '') ELSE w END), w -> w NOT IN ('mm', 'f'))))""",
    "name_focal(name STRING) RETURNS STRUCT<low DOUBLE, high DOUBLE>": r"""CASE WHEN regexp_like(lower(name), '(?:^|[^a-z0-9]|f)([0-9][0-9.]*)(?:-([0-9][0-9.]*))?\\s*mm') THEN named_struct(
      'low', try_cast(nullif(regexp_extract(lower(name), '(?:^|[^a-z0-9]|f)([0-9][0-9.]*)(?:-([0-9][0-9.]*))?\\s*mm', 1), '') AS DOUBLE),
      'high', coalesce(try_cast(nullif(regexp_extract(lower(name), '(?:^|[^a-z0-9]|f)([0-9][0-9.]*)(?:-([0-9][0-9.]*))?\\s*mm', 2), '') AS DOUBLE), try_cast(nullif(regexp_extract(lower(name), '(?:^|[^a-z0-9]|f)([0-9][0-9.]*)(?:-([0-9][0-9.]*))?\\s*mm', 1), '') AS DOUBLE))) END""",
    "srgb_encode(v DOUBLE) RETURNS DOUBLE": "CASE WHEN v <= 0.0031308D THEN v * 12.92D ELSE 1.055D * pow(v, 1D / 2.4D) - 0.055D END",
    "srgb_decode(v DOUBLE) RETURNS DOUBLE": "CASE WHEN v <= 0.04045D THEN v / 12.92D ELSE pow((v + 0.055D) / 1.055D, 2.4D) END",
}


def register(spark: SparkSession) -> list[str]:
    """Registers the functions, SQL ones and Arrow-batched ones, and returns their names."""
    from fotolake.functions.settings import json_changes, json_patch
    from fotolake.sources.files import lua_json
    from fotolake.sources.migration import compose_hangul

    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("json_patch", json_patch)
    spark.udf.register("json_changes", json_changes)
    spark.udf.register("lua_to_json", lua_json)
    spark.udf.register("compose_hangul", compose_hangul)
    return [h.split("(")[0] for h in SQL] + ["json_patch", "json_changes", "lua_to_json", "compose_hangul"]
