"""XMP sidecars and presets: parsed to maps, read as settings, written back."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import MapType, StringType

from fotolake.functions.text import escape
from fotolake.functions.vector import held
from fotolake.sources import masks as local
from fotolake.sources import presets

#: Namespaces of the formats, and names of curves.
RDF, CRS = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://ns.adobe.com/camera-raw-settings/1.0/}"
CURVES = ("ToneCurvePV2012", "ToneCurvePV2012Red", "ToneCurvePV2012Green", "ToneCurvePV2012Blue")


def parse(packet: str | None) -> dict[str, str] | None:
    """Scalar settings of a packet by name, from attributes and elements; curves as `x,y;x,y`. Looks are left out."""
    try:
        root = ET.fromstring(re.sub(r"<\?xpacket.*?\?>", "", packet or "").strip())
    except ET.ParseError:
        return None
    out: dict[str, str] = {}
    for d in root.iter(RDF + "Description"):
        for k, v in d.attrib.items():
            if k.startswith(CRS):
                out.setdefault(k[len(CRS) :], v)
        for e in d:
            name = e.tag[len(CRS) :] if e.tag.startswith(CRS) else ""
            if name and name != "Look":
                items = [li.text or "" for li in e.iter(RDF + "li")]
                if items:
                    out.setdefault(name, ";".join(re.sub(r"\s", "", x) for x in items))
                elif e.text and e.text.strip():
                    out.setdefault(name, e.text.strip())
        break  # the packet's own settings; nested descriptions belong to looks and masks
    return out


@pandas_udf(MapType(StringType(), StringType()))
def _parsed(packets: pd.Series) -> pd.Series:
    return packets.map(lambda p: parse(p if isinstance(p, str) else None))


def crs_map(packet: Column) -> Column:
    """Scalar settings of a packet by name, parsed in Arrow batches; null for what is no XML."""
    return _parsed(packet)


def settings(packets: DataFrame, packet_col: str = "xmp", photo_col: str | None = None) -> DataFrame:
    """`packets` with a struct of all settings (`presets.settings`), the groups present, and the curves; with an id, masks too.

    A packet with masks also has the group `masks`; masks are an array as `masks.masks` has them.
    """
    m = F.col("__m")
    df = held(held(packets.withColumn("__m", crs_map(F.col(packet_col)))).withColumn("settings", presets.settings(m)))
    curves = F.array(*(presets.curve(F.try_element_at(m, F.lit(c))) for c in CURVES))
    df = held(df.withColumns({"groups": F.when(m.isNotNull(), presets.groups(F.col("settings"), m)), "curves": curves}).drop("__m"))
    if photo_col is None:
        return df
    found = local.masks(packets, photo_col, packet_col)
    found = found.groupBy("photo").agg(F.collect_list(F.struct("mask", "name", "amount", "local", "components")).alias("masks"), F.sum("left").alias("left"))
    ordered = F.array_sort("masks", lambda a, b: a["mask"] - b["mask"])
    df = df.join(found.withColumn("masks", ordered).withColumnRenamed("photo", photo_col), photo_col, "left")
    return df.withColumn("groups", F.when(F.col("masks").isNotNull(), F.array_sort(F.array_union(F.coalesce("groups", F.array()), F.array(F.lit("masks"))))).otherwise(F.col("groups")))


def rating(packet: Column) -> Column:
    """The rating attribute or element, 0 to 5; null if there is none."""
    found = F.nullif(F.regexp_extract(packet, r'xmp:Rating(?:="|>)(-?\d+)', 1), F.lit("")).cast("int")
    return F.when(found.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(5), found)))


def curve_xml(name: str, points: Column) -> Column:
    """A curve of points in 0 to 1 as an element of the packet; empty without points."""
    whole = lambda v: F.round(v * 255).cast("int").cast("string")
    items = F.array_join(F.transform(points, lambda p: F.concat(F.lit("<rdf:li>"), whole(p["x"]), F.lit(", "), whole(p["y"]), F.lit("</rdf:li>"))), "")
    return F.when(F.size(points) > 0, F.concat(F.lit(f"<crs:{name}><rdf:Seq>"), items, F.lit(f"</rdf:Seq></crs:{name}>"))).otherwise("")


def packet(curves: Column | None = None, masks: Column | None = None) -> Column:
    """An XMP packet of title, caption, keywords, rating and settings (columns of those names; settings as `presets.settings` has them),
    and of curves and masks as `settings` gives them."""
    alt = lambda tag, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"<dc:{tag}><rdf:Alt><rdf:li xml:lang=\"x-default\">"), escape(F.col(c)), F.lit(f"</rdf:li></rdf:Alt></dc:{tag}>"))).otherwise("")
    words = F.when(F.size("keywords") > 0, F.concat(F.lit("<dc:subject><rdf:Bag>"), F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("<rdf:li>"), escape(k), F.lit("</rdf:li>"))), ""), F.lit("</rdf:Bag></dc:subject>"))).otherwise("")
    crs = F.array_join(F.transform(F.sort_array(F.map_entries(presets.written(F.col("settings")))), lambda e: F.concat(F.lit(" crs:"), e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))), "")
    lines = F.concat(*(curve_xml(name, F.get(curves, F.lit(i))) for i, name in enumerate(CURVES))) if curves is not None else F.lit("")
    parts = local.xml(masks) if masks is not None else F.lit("")
    head = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:crs="http://ns.adobe.com/camera-raw-settings/1.0/" xmp:Rating="'
    return F.concat(F.lit(head), F.col("rating").cast("string"), F.lit('"'), crs, F.lit(">"), alt("title", "title"), alt("description", "caption"), words, F.coalesce(lines, F.lit("")), F.coalesce(parts, F.lit("")), F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))
