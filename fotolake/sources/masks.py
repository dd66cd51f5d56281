"""Local corrections in sidecars, both ways: XML read and written by Spark, flattened to rows of masks, components and their parts.

A packet holds lists of corrections, each with adjustments and components; a component's shape is a map of numbers, or points. What a
kind of component needs and may have is one table, read by one loop. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions.text import escape
from fotolake.functions.vector import held

#: Fixed values of the format: the lists of corrections, in the order they are read.
LISTS = ("MaskGroupBasedCorrections", "GradientBasedCorrections", "CircularGradientBasedCorrections", "PaintBasedCorrections")
#: Local settings with the names they are read from (the first that is there; it is written) and the factor to our scale.
LOCAL = {
    "temp": (("LocalTemperature",), 100.0), "tint": (("LocalTint",), 100.0), "exposure": (("LocalExposure2012", "LocalExposure"), 4.0), "contrast": (("LocalContrast2012", "LocalContrast"), 100.0),
    "highlights": (("LocalHighlights2012",), 100.0), "shadows": (("LocalShadows2012",), 100.0), "whites": (("LocalWhites2012",), 100.0), "blacks": (("LocalBlacks2012",), 100.0),
    "texture": (("LocalTexture",), 100.0), "clarity": (("LocalClarity2012", "LocalClarity"), 100.0), "dehaze": (("LocalDehaze",), 100.0), "hue": (("LocalHue",), 180.0),
    "saturation": (("LocalSaturation",), 100.0), "sharpness": (("LocalSharpness",), 100.0), "noise": (("LocalLuminanceNoise",), 100.0),
}
#: Kinds of components by name: what each needs, and what it may have with its default.
KINDS = {
    "Mask/Gradient": ("linear", ("ZeroX", "ZeroY", "FullX", "FullY"), {}),
    "Mask/CircularGradient": ("radial", ("Top", "Left", "Bottom", "Right"), {"Angle": 0.0, "Feather": 50.0}),
    "Mask/Paint": ("brush", (), {"Radius": 0.05, "Flow": 1.0, "CenterWeight": 0.5}),
    "Mask/RangeMask": ("luminance", (), {}),
    "Mask/Image": ("ai", (), {}),
}
#: What a model is asked for, by type and category of the component; None: any other category.
SUBJECTS = {(1, None): "subject", (2, None): "sky", (0, 22): "background", (0, None): "people"}
SMOOTH = 0.5
_SCALARS = ("What", "MaskBlendMode", "MaskInverted", "MaskValue", "Flipped", "MaskSubType", "MaskSubCategoryID", *dict.fromkeys(k for _, need, may in KINDS.values() for k in (*need, *may)))
_RANGE = ("Type", "LumRange", "LumFeather")
_CORRECTION = ("CorrectionActive", "CorrectionName", "CorrectionAmount", *(n for names, _ in LOCAL.values() for n in names))


def _fields(names: tuple[str, ...]) -> str:
    """Scalars as attributes or as elements."""
    return ", ".join(f"_{n}: string, {n}: string" for n in names)


def _entry(inner: str) -> str:
    """A list entry whose content is in a description of its own or its own."""
    return f"struct<Description: struct<{inner}>, {inner}>"


_range = f"CorrectionRangeMask: {_entry(_fields(_RANGE))}"
_component = f"{_fields(_SCALARS)}, Dabs: struct<Seq: struct<li: array<string>>>, {_range}"
_correction = f"{_fields(_CORRECTION)}, CorrectionMasks: struct<Seq: struct<li: array<{_entry(_component)}>>>"
_lists = ", ".join(f"{name}: struct<Seq: struct<li: array<{_entry(_correction)}>>>" for name in LISTS)
PACKET = f"RDF struct<Description: array<struct<{_lists}>>>"


def _of(x: Column, name: str) -> Column:
    """A part of an entry, from either place, as an attribute or an element."""
    return F.coalesce(*(side[n] for side in (x["Description"], x) for n in (f"_{name}", name)))


def _part(x: Column, name: str) -> Column:
    return F.coalesce(x["Description"][name], x[name])


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def _shape(x: Column) -> Column:
    """struct(kind, values, points, subject) of a component, null where the kind is unknown or lacks a part."""
    n = lambda k: _number(_of(x, k))
    pairs = F.filter(F.transform(_part(x, "Dabs")["Seq"]["li"], lambda d: F.transform(F.slice(F.split(F.trim(d), r"\s+"), 2, 2), lambda v: v.try_cast("double"))), lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    r = _part(x, "CorrectionRangeMask")
    ends = F.filter(F.transform(F.split(F.trim(_of(r, "LumRange")), r"\s+"), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    middle = lambda i, default: F.when(F.size(ends) >= 4, (ends[i] + ends[i + 1]) / 2).otherwise(default)
    kind_no, category = n("MaskSubType").cast("int"), F.coalesce(n("MaskSubCategoryID").cast("int"), F.lit(0))
    subject = F.coalesce(*(F.when((kind_no == t) & (F.lit(True) if c is None else category == c), s) for (t, c), s in sorted(SUBJECTS.items(), key=lambda e: e[0][1] is None)))
    none = F.lit(None)
    out = none.cast("struct<kind: string, values: map<string, double>, points: array<array<double>>, subject: string>")
    for what, (kind, need, may) in KINDS.items():
        values, ok = {k: n(k) for k in need} | {k: F.coalesce(n(k), F.lit(d)) for k, d in may.items()}, F.lit(True)
        for k in need:
            ok = ok & values[k].isNotNull()
        if kind == "brush":
            values |= {"Erase": F.when(n("MaskValue") <= 0, 1.0).otherwise(0.0)}
            values |= {"Feather": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - values.pop("CenterWeight"))), "Flow": F.greatest(F.lit(0.0), F.least(F.lit(1.0), values["Flow"]))}
            ok = F.size(pairs) > 0
        if kind == "luminance":
            values, ok = {"Low": middle(0, 0.0), "High": middle(2, 1.0), "Smooth": F.coalesce(_number(_of(r, "LumFeather")), F.lit(SMOOTH))}, _number(_of(r, "Type")).cast("int") == 2
        if kind == "ai":
            ok = subject.isNotNull()
        table = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values())) if values else F.create_map().cast("map<string, double>")
        shape = F.struct(F.lit(kind).alias("kind"), table.alias("values"), (pairs if kind == "brush" else none.cast("array<array<double>>")).alias("points"), (subject if kind == "ai" else none.cast("string")).alias("subject"))
        out = F.when((_of(x, "What") == what) & F.coalesce(ok, F.lit(False)), shape).otherwise(out)
    return out


def masks(packets: DataFrame, id_col: str = "photo", packet_col: str = "xmp") -> DataFrame:
    """(photo, mask, list, name, active, amount, local, left, components) of each correction that has a component.

    local: adjustments that are not zero, by name; left: components of kinds not known, or that lack a part; components: (what is in
    `components`) in order. Packets that are no XML have no masks.
    """
    text = F.trim(F.regexp_replace(packet_col, r"(?s)<\?.*?\?>", ""))
    root = F.from_xml(text, F.lit(PACKET), {"attributePrefix": "_", "ignoreNamespace": "true", "mode": "PERMISSIVE"})["RDF"]["Description"]
    packets = held(packets.select(F.col(id_col).alias("photo"), F.get(root, F.lit(0)).alias("first")))  # a packet is parsed once
    first = F.col("first")
    tagged = lambda name: F.transform(first[name]["Seq"]["li"], lambda x: F.struct(F.lit(name).alias("list"), x.alias("x")))
    entries = F.concat(*(F.coalesce(tagged(name), F.array()) for name in LISTS))
    df = packets.select("photo", F.posexplode(entries).alias("mask", "e")).select("photo", "mask", "e.list", F.col("e.x").alias("x"))
    x = F.col("x")

    def component(c: Column) -> Column:
        blend, inverted = F.coalesce(_number(_of(c, "MaskBlendMode")).cast("int"), F.lit(0)), _true(_of(c, "MaskInverted"))
        op = F.when((blend == 1) & inverted, "subtract").when(blend == 1, "intersect").otherwise("add")
        flipped = (_of(c, "What") == "Mask/CircularGradient") & _true(_of(c, "Flipped"))
        return F.struct(op.alias("op"), ((inverted & (op != "subtract")) != F.coalesce(flipped, F.lit(False))).alias("inverted"), _shape(c).alias("shape"))

    found = F.transform(_part(x, "CorrectionMasks")["Seq"]["li"], component)
    local = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), (F.coalesce(*(_number(_of(x, n)) for n in names), F.lit(0.0)) * factor).alias("v")) for k, (names, factor) in LOCAL.items())), lambda e: e["v"] != 0))
    df = held(df).select("photo", "mask", "list", F.coalesce(_of(x, "CorrectionName"), F.lit("")).alias("name"), (F.lower(F.coalesce(_of(x, "CorrectionActive"), F.lit("true"))) != "false").alias("active"), F.coalesce(_number(_of(x, "CorrectionAmount")), F.lit(1.0)).alias("amount"), local.alias("local"), F.coalesce(found, F.array()).alias("found"))
    whole = F.filter("found", lambda c: c["shape"].isNotNull())
    df = held(held(df).withColumn("components", whole))
    return df.select("photo", "mask", "list", "name", "active", "amount", "local", (F.size("found") - F.size("components")).alias("left"), "components").where("active and size(components) > 0").drop("active")


def components(mask_rows: DataFrame) -> DataFrame:
    """(photo, mask, component, kind, op, inverted, subject, key, value): a row for each number of each component's shape."""
    rows = mask_rows.select("photo", "mask", F.posexplode("components").alias("component", "c"))
    shape = F.col("c.shape")
    points = F.transform(F.coalesce(shape["points"], F.array()), lambda p, i: F.array(F.struct(F.concat(F.lit("x"), i.cast("string")).alias("key"), p[0].alias("value")), F.struct(F.concat(F.lit("y"), i.cast("string")).alias("key"), p[1].alias("value"))))
    entries = F.concat(F.map_entries(shape["values"]), F.flatten(points))
    rows = rows.select("photo", "mask", "component", shape["kind"].alias("kind"), "c.op", "c.inverted", shape["subject"].alias("subject"), F.explode_outer(entries).alias("e"))
    return rows.select("photo", "mask", "component", "kind", "op", "inverted", "subject", "e.key", "e.value")


def warnings(mask_rows: DataFrame) -> DataFrame:
    """(photo, left): how many components of a packet's masks could not be read, of those with any."""
    return mask_rows.groupBy("photo").agg(F.sum("left").alias("left")).where("left > 0")


def _six(v: Column) -> Column:
    return F.format_string("%.6f", v)


def xml(mask_array: Column) -> Column:
    """The element of a packet for masks (array of name, amount, local, components as `masks` has them); empty without any.

    Masks of images and of kinds that the format does not hold are left out, and so are masks of such alone.
    """

    def component(c: Column) -> Column:
        shape = c["shape"]
        v = lambda k: F.try_element_at(shape["values"], F.lit(k))
        attribute = lambda k, value: F.concat(F.lit(f' crs:{k}="'), value, F.lit('"'))
        low = lambda b: F.when(b, "true").otherwise("false")
        subtract = c["op"] == "subtract"
        blend = F.when(c["op"] == "add", "0").otherwise("1")
        common = F.concat(attribute("MaskActive", F.lit("true")), attribute("MaskBlendMode", blend), attribute("MaskInverted", low(subtract | c["inverted"])))
        out = F.lit(None).cast("string")
        for what, (kind, need, may) in KINDS.items():
            if kind == "ai":
                continue
            names, inner = [*need, *may], F.lit("")
            value = {k: v(k) for k in names}
            more = attribute("MaskValue", F.lit("1"))
            if kind == "radial":
                more = F.concat(more, attribute("Flipped", F.lit("false")))
            if kind == "brush":
                more = attribute("MaskValue", F.when(v("Erase") > 0, "0").otherwise("1"))
                value["CenterWeight"] = 1 - v("Feather")
                inner = F.concat(F.lit("<crs:Dabs><rdf:Seq>"), F.array_join(F.transform(shape["points"], lambda p: F.concat(F.lit("<rdf:li>d "), _six(p[0]), F.lit(" "), _six(p[1]), F.lit("</rdf:li>"))), ""), F.lit("</rdf:Seq></crs:Dabs>"))
            if kind == "luminance":
                half = v("Smooth") / 2
                ends = [F.greatest(v("Low") - half, F.lit(0.0)), F.least(v("Low") + half, F.lit(1.0)), F.greatest(v("High") - half, F.lit(0.0)), F.least(v("High") + half, F.lit(1.0))]
                inner = F.concat(F.lit('<crs:CorrectionRangeMask><rdf:Description crs:Version="3" crs:Type="2" crs:LumRange="'), F.array_join(F.array(*map(_six, ends)), " "), F.lit('" crs:LumFeather="'), _six(v("Smooth")), F.lit('"/></crs:CorrectionRangeMask>'))
            text = F.concat(F.lit("<rdf:li><rdf:Description"), attribute("What", F.lit(what)), common, more, *(attribute(k, _six(value[k])) for k in names), F.lit(">"), inner, F.lit("</rdf:Description></rdf:li>"))
            out = F.when(shape["kind"] == kind, text).otherwise(out)
        return out

    def correction(m: Column) -> Column:
        parts = F.array_compact(F.transform(m["components"], component))
        local = F.concat(*(F.concat(F.lit(f' crs:{names[0]}="'), _six(F.coalesce(F.try_element_at(m["local"], F.lit(k)), F.lit(0.0)) / factor), F.lit('"')) for k, (names, factor) in LOCAL.items()))
        head = F.concat(F.lit('<rdf:li><rdf:Description crs:What="Correction" crs:CorrectionActive="true" crs:CorrectionName="'), escape(m["name"]), F.lit('" crs:CorrectionAmount="'), _six(m["amount"]), F.lit('"'), local, F.lit("><crs:CorrectionMasks><rdf:Seq>"))
        return F.when(F.size(parts) > 0, F.concat(head, F.array_join(parts, ""), F.lit("</rdf:Seq></crs:CorrectionMasks></rdf:Description></rdf:li>")))

    every = F.array_compact(F.transform(mask_array, correction))
    return F.when(F.size(every) > 0, F.concat(F.lit(f"<crs:{LISTS[0]}><rdf:Seq>"), F.array_join(every, ""), F.lit(f"</rdf:Seq></crs:{LISTS[0]}>"))).otherwise("")
