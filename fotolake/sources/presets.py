"""Foreign develop settings, all keys both ways: a parsed map of names to a flat struct of settings, and back to attributes.

Settings are one table: a field, its group, and the names it is read from (the first that is there), each with how its number is
taken over. Names and ranges are those of the public format and of the stored document. Rules that look at several names, such as
white balance, crop and looks, are columns of their own. A name that is missing leaves its field null; a group is present if one of
its names is. Everything stays in the JVM.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotolake.functions.vector import let

#: The eight colour bands of the format.
BANDS = ("Red", "Orange", "Yellow", "Green", "Aqua", "Blue", "Purple", "Magenta")


def _same(x: Column) -> Column:
    return x


def _between(low: float, high: float, factor: float = 1.0):
    return lambda x: F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x * factor)))


#: Field -> (group, ((name, how its number is taken over, what writes it back), ...)). The first name is written.
NUMBERS: dict[str, tuple[str, tuple[tuple, ...]]] = {}


def _plain(group: str, **fields: str) -> None:
    NUMBERS.update({f: (group, ((name, _same),)) for f, name in fields.items()})


NUMBERS["exposure"] = ("basic_tone", (("Exposure2012", _same), ("Exposure", _same)))
NUMBERS["contrast"] = ("basic_tone", (("Contrast2012", _same), ("Contrast", lambda x: x - 25)))
NUMBERS["highlights"] = ("basic_tone", (("Highlights2012", _same), ("HighlightRecovery", lambda x: -x)))
NUMBERS["shadows"] = ("basic_tone", (("Shadows2012", _same), ("FillLight", _same)))
_plain("basic_tone", whites="Whites2012", blacks="Blacks2012")
_plain("presence", texture="Texture", clarity="Clarity2012", dehaze="Dehaze", vibrance="Vibrance", saturation="Saturation")
_plain("tone_curve", curve_shadows="ParametricShadows", curve_darks="ParametricDarks", curve_lights="ParametricLights", curve_highlights="ParametricHighlights")
for _i, _name in enumerate(("Shadow", "Midtone", "Highlight")):
    NUMBERS[f"curve_split_{_i}"] = ("tone_curve", ((f"Parametric{_name}Split", _between(0.05, 0.95, 0.01)),))
for _b in BANDS:
    _plain("treatment", **{f"bw_{_b.lower()}": f"GrayMixer{_b}"})
    _plain("hsl", **{f"{k}_{_b.lower()}": f"{name}Adjustment{_b}" for k, name in (("hue", "Hue"), ("sat", "Saturation"), ("lum", "Luminance"))})
for _name in ("Shadow", "Midtone", "Highlight", "Global"):
    _old = _name in ("Shadow", "Highlight")
    for _k, _short, _long in (("hue", "Hue", "Hue"), ("sat", "Sat", "Saturation"), ("lum", "Lum", None)):
        NUMBERS[f"grade_{_name.lower()}_{_k}"] = ("color_grading", ((f"ColorGrade{_name}{_short}", _same), *([(f"SplitToning{_name}{_long}", _same)] if _old and _long else [])))
NUMBERS["grade_balance"] = ("color_grading", (("ColorGradeBalance", _same), ("SplitToningBalance", _same)))
_plain("color_grading", grade_blending="ColorGradeBlending")
_plain("detail", sharpen_amount="Sharpness", sharpen_radius="SharpenRadius", sharpen_detail="SharpenDetail", sharpen_masking="SharpenEdgeMasking")
_plain("detail", noise="LuminanceSmoothing", noise_detail="LuminanceNoiseReductionDetail", noise_contrast="LuminanceNoiseReductionContrast")
_plain("detail", colour_noise="ColorNoiseReduction", colour_noise_detail="ColorNoiseReductionDetail", colour_noise_smooth="ColorNoiseReductionSmoothness")
_plain("lens", lens_distortion="LensManualDistortionAmount", lens_vignette="VignetteAmount", lens_midpoint="VignetteMidpoint", defringe_purple="DefringePurpleAmount", defringe_green="DefringeGreenAmount")
_plain("crop", perspective_vertical="PerspectiveVertical", perspective_horizontal="PerspectiveHorizontal", perspective_scale="PerspectiveScale")
_plain("effects", vignette="PostCropVignetteAmount", vignette_midpoint="PostCropVignetteMidpoint", vignette_roundness="PostCropVignetteRoundness", vignette_feather="PostCropVignetteFeather", vignette_highlights="PostCropVignetteHighlightContrast")
_plain("effects", grain="GrainAmount", grain_size="GrainSize", grain_roughness="GrainFrequency")
_plain("calibration", shadow_tint="ShadowTint", red_hue="RedHue", red_sat="RedSaturation", green_hue="GreenHue", green_sat="GreenSaturation", blue_hue="BlueHue", blue_sat="BlueSaturation")


def number(m: Column, name: str) -> Column:
    return F.trim(F.try_element_at(m, F.lit(name))).try_cast("double")


def switch(m: Column, name: str) -> Column:
    """True or false of a switch, null if it is neither."""
    v = F.lower(F.trim(F.try_element_at(m, F.lit(name))))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


def _first(m: Column, names: tuple[tuple, ...]) -> Column:
    return F.coalesce(*(how(number(m, name)) for name, how in names))


def _limited(x: Column, most: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), x)))


def white_balance(m: Column) -> dict[str, Column]:
    """As shot: nothing. Steps given are taken; else kelvin and tint, with steps that come near them for pictures without."""
    shot = F.coalesce(F.try_element_at(m, F.lit("WhiteBalance")) == "As Shot", F.lit(False))
    steps, kelvin = number(m, "IncrementalTemperature"), number(m, "Temperature")
    near = F.when(kelvin.isNotNull(), F.round(_limited(1e6 / 5500 - 1e6 / F.greatest(kelvin, F.lit(1000.0)), 100.0)))
    tint, own = number(m, "IncrementalTint"), number(m, "Tint")
    custom = ~shot & steps.isNull() & kelvin.isNotNull()
    return {
        "as_shot": shot,
        "wb_custom": custom,
        "temp_k": F.when(custom, F.greatest(F.lit(2000.0), F.least(F.lit(50000.0), kelvin))),
        "temp": F.when(~shot, F.coalesce(_limited(steps, 100.0), near)),
        "tint_k": F.when(~shot & tint.isNull(), _limited(own, 150.0)),
        "tint": F.when(~shot, F.coalesce(_limited(tint, 100.0), F.round(_limited(own / 1.5, 100.0)))),
    }


def settings(m: Column) -> Column:
    """struct of all settings of a map of names to texts."""
    out = {f: _first(m, names) for f, (_, names) in NUMBERS.items()} | white_balance(m)
    newer = number(m, "Texture").isNotNull() | number(m, "Clarity2012").isNotNull()
    out["clarity"] = F.when(newer, out["clarity"]).otherwise(number(m, "Clarity"))
    out["profile"] = F.coalesce(F.try_element_at(m, F.lit("LookName")), F.try_element_at(m, F.lit("CameraProfile")))
    out["profile_amount"] = F.when(number(m, "LookAmount").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(200.0), number(m, "LookAmount") * 100)))
    out["black_white"] = switch(m, "ConvertToGrayscale")
    out["remove_ca"] = switch(m, "AutoLateralCA")
    enabled = switch(m, "LensProfileEnable")
    out["lens_profile"] = enabled
    for f, name in (("lens_profile_file", "LensProfileFilename"), ("lens_profile_name", "LensProfileName")):
        out[f] = F.when(enabled.isNotNull(), F.try_element_at(m, F.lit(name)))
    for f, name in (("lens_profile_distortion", "LensProfileDistortionScale"), ("lens_profile_vignetting", "LensProfileVignettingScale")):
        out[f] = F.when(enabled.isNotNull(), number(m, name))
    cropped = F.coalesce(switch(m, "HasCrop"), F.lit(False))
    edges = [number(m, f"Crop{side}") for side in ("Left", "Top", "Right", "Bottom")]
    whole = cropped & functools.reduce(Column.__and__, (e.isNotNull() for e in edges))
    out |= {f"crop_{side}": F.when(whole, e) for side, e in zip(("left", "top", "right", "bottom"), edges)}
    turn = F.coalesce(number(m, "PerspectiveRotate"), F.lit(0.0)) + F.when(cropped, F.coalesce(number(m, "CropAngle"), F.lit(0.0))).otherwise(0.0)
    out["angle"] = F.when(number(m, "PerspectiveRotate").isNotNull() | (cropped & number(m, "CropAngle").isNotNull()), turn)
    return F.struct(*(v.alias(k) for k, v in out.items()))


def groups(s: Column, m: Column) -> Column:
    """The groups, by name, that settings `s` from map `m` say something of."""
    fields: dict[str, list[Column]] = {}
    for f, (g, _) in NUMBERS.items():
        fields.setdefault(g, []).append(s[f].isNotNull())
    fields.setdefault("white_balance", []).extend([s["as_shot"], s["temp"].isNotNull(), s["tint"].isNotNull()])
    fields["treatment"] += [s["profile"].isNotNull(), s["black_white"].isNotNull()]
    fields["lens"] += [s["remove_ca"].isNotNull(), s["lens_profile"].isNotNull()]
    fields["crop"] += [s["crop_left"].isNotNull(), number(m, "PerspectiveRotate").isNotNull()]
    fields["tone_curve"].append(F.exists(F.map_keys(m), lambda k: k.startswith("ToneCurvePV2012")))
    return F.array_sort(F.array_compact(F.array(*(F.when(functools.reduce(Column.__or__, c), g) for g, c in fields.items()))))


def curve(points: Column) -> Column:
    """Points `x,y;x,y` of a curve in 0 to 255, as ordered pairs in 0 to 1, one for each x."""
    pairs = F.filter(F.transform(F.split(points, ";"), lambda p: F.struct((F.split_part(p, F.lit(","), F.lit(1)).try_cast("double") / 255).alias("x"), (F.split_part(p, F.lit(","), F.lit(2)).try_cast("double") / 255).alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    ordered = F.array_sort(pairs, lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0))
    none = F.array().cast("array<struct<x:double,y:double>>")
    return F.aggregate(ordered, none, lambda kept, p: F.when((F.size(kept) > 0) & (F.abs(F.try_element_at(kept, F.lit(-1))["x"] - p["x"]) < 1e-4), kept).otherwise(F.concat(kept, F.array(p))))


def written(s: Column) -> Column:
    """map of names to texts of a settings struct; `settings` of it gives the struct again."""
    return let(s, _written)


def _written(s: Column) -> Column:
    back = {"curve_split_0": 100.0, "curve_split_1": 100.0, "curve_split_2": 100.0}
    text = lambda v: let(v, lambda v: F.when(v == F.round(v), F.round(v).cast("long").cast("string")).otherwise(v.cast("string")))
    entry = lambda name, v: F.struct(F.lit(name).alias("k"), v.alias("v"))
    said = lambda c: F.when(c, "True").otherwise("False")
    out = [entry(names[0][0], text(s[f] * back.get(f, 1.0))) for f, (_, names) in NUMBERS.items()]
    steps = ~F.coalesce(s["wb_custom"], F.lit(False))
    out += [entry("WhiteBalance", F.when(s["as_shot"], "As Shot").when(s["temp"].isNotNull() | s["tint"].isNotNull(), "Custom"))]
    out += [entry("Temperature", text(s["temp_k"])), entry("IncrementalTemperature", F.when(steps, text(s["temp"]))), entry("Tint", text(s["tint_k"])), entry("IncrementalTint", F.when(s["tint_k"].isNull(), text(s["tint"])))]
    out += [entry("CameraProfile", s["profile"]), entry("LookAmount", text(s["profile_amount"] / 100))]
    out += [entry(name, F.when(s[f].isNotNull(), said(s[f]))) for f, name in (("black_white", "ConvertToGrayscale"), ("remove_ca", "AutoLateralCA"), ("lens_profile", "LensProfileEnable"))]
    out += [entry("LensProfileFilename", s["lens_profile_file"]), entry("LensProfileName", s["lens_profile_name"]), entry("LensProfileDistortionScale", text(s["lens_profile_distortion"])), entry("LensProfileVignettingScale", text(s["lens_profile_vignetting"]))]
    out += [entry("HasCrop", F.when(s["crop_left"].isNotNull() | s["angle"].isNotNull(), said(s["crop_left"].isNotNull())))]
    out += [entry(f"Crop{side}", text(s[f"crop_{side.lower()}"])) for side in ("Left", "Top", "Right", "Bottom")]
    out += [entry("CropAngle", F.when(s["crop_left"].isNotNull(), text(s["angle"]))), entry("PerspectiveRotate", F.when(s["crop_left"].isNull(), text(s["angle"])))]
    return F.map_from_entries(F.filter(F.array(*out), lambda e: e["v"].isNotNull()))
