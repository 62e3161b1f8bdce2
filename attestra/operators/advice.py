"""Which steps prepare a page for reading: an ordered plan from its measurements, each step seeing what earlier ones change.

The measurements are columns of a row for each page (``MEASURES``). The plan is
``steps``, ``array<struct<name, params, reason>>`` as ``geometry.page_transform``
takes it, and ``notes`` about steps that were weighed and left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import STEP_RULES

#: Of a page: size and marked area in pixels, grey levels (0 black to 255 white), heights of characters, tilt in degrees.
MEASURES = "width int, height int, content_box array<int>, paper_level double, text_contrast double, ink_share double, text_height double, small_height double, tilt double, tilt_gain double, tilt_at_limit boolean, background_spread double, noise double, sharpness double"
#: Steps, in the order in which they are applied.
STEPS = ("crop", "denoise", "rotate", "flatten_light", "stretch_contrast", "brighten", "resize", "sharpen", "adaptive_threshold")
STEP = "struct<name:string,params:map<string,double>,reason:string>"
#: A change of size that is worth a step, and the largest page side that a reader takes without shrinking it.
RESIZED, MAX_SIDE = 0.05, 2000.0


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def odd(value: Column, least: int = 3) -> Column:
    """The whole number nearest to ``value``, half to even, at least ``least``; the next one if that is even."""
    n = F.greatest(F.lit(least), F.rint(value).cast("int"))
    return n + F.when(n % 2 == 0, 1).otherwise(0)


def shrink(width: Column, height: Column, max_side: float) -> Column:
    """The factor by which a reader shrinks a page of that size."""
    return F.least(F.lit(1.0), F.try_divide(_num(max_side), F.greatest(width, height)))


def _step(name: str, when: Column, reason: Column, **params) -> Column:
    values = F.map_from_arrays(F.array(*map(F.lit, params)), F.array(*[_num(v).cast("double") for v in params.values()]))
    return F.when(when, F.struct(F.lit(name).alias("name"), values.alias("params"), reason.alias("reason")).cast(STEP))


def _says(text: str, *values: Column) -> Column:
    return F.format_string(text, *[v.cast("double") for v in values])


def advised(pages: DataFrame, rules: dict[str, dict] = STEP_RULES, max_side: float = MAX_SIDE) -> DataFrame:
    """Adds ``steps`` and ``notes`` to pages with the columns of ``MEASURES``; other columns stay.

    A step whose measurement is null is left out; so is every step of a page
    without a size, as nothing of it is above or below anything. A page without
    letter-sized marks keeps its size. An empty table gives an empty one.
    Parameters are rounded half to even by their shortest decimal print, so 0.885
    is 0.88 although its binary value lies a little above.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    w, h, box = F.col("width").cast("double"), F.col("height").cast("double"), F.col("content_box")
    th = F.when(F.col("text_height") != 0, F.col("text_height"))
    steps, notes = {}, []

    # Cropping pays where the reader then shrinks the page less.
    r = rules["crop"]
    margin = F.greatest(_num(r["min_margin_px"]), r["margin_per_text_height"] * F.coalesce(th, F.lit(0.0)))
    out = pages.withColumns({"_margin": margin})
    low = lambda i: F.greatest(F.lit(0), (F.get(box, F.lit(i)) - F.col("_margin")).cast("int"))
    high = lambda i, side: F.least(F.col(side), (F.get(box, F.lit(i)) + F.col("_margin")).cast("int"))
    out = out.withColumns({"_x0": low(0), "_y0": low(1), "_x1": high(2, "width"), "_y1": high(3, "height")})
    wide, tall = (F.col("_x1") - F.col("_x0")).cast("double"), (F.col("_y1") - F.col("_y0")).cast("double")
    out = out.withColumns({"_trimmed": 1.0 - F.try_divide(wide * tall, w * h), "_before": shrink(w, h, max_side), "_after": shrink(wide, tall, max_side)})
    empty = yes(box.isNotNull() & (F.col("_trimmed") >= r["min_trim_share"]))
    gains = yes(F.col("_after") - F.col("_before") >= r["min_scale_gain"])
    out = out.withColumns({"_crop": empty & gains, "_no_crop": empty & ~gains})
    steps["crop"] = _step("crop", F.col("_crop"), _says("%.0f%% of the page is empty; read at x%.2f instead of x%.2f", F.col("_trimmed") * 100, F.col("_after"), F.col("_before")), left=F.col("_x0"), top=F.col("_y0"), right=F.col("_x1"), bottom=F.col("_y1"))
    notes.append(F.when(F.col("_no_crop"), F.lit("crop: gains too little")))
    out = out.withColumns({"_w": F.when(F.col("_crop"), wide).otherwise(w), "_h": F.when(F.col("_crop"), tall).otherwise(h)})

    r = rules["denoise"]
    strength = F.bround(F.least(_num(r["max_strength"]), F.col("noise") * r["strength_per_sigma"]), 1)
    steps["denoise"] = _step("denoise", yes(F.col("noise") > r["above_noise_sigma"]), _says("noise %.1f", F.col("noise")), strength=strength)

    r = rules["deskew"]
    tilted, clear = yes(F.abs("tilt") >= r["min_tilt_deg"]), yes(F.col("tilt_gain") >= r["min_alignment_gain"])
    trusted = ~yes(F.col("tilt_at_limit"))
    steps["rotate"] = _step("rotate", tilted & trusted & clear, _says("tilt %+.1f degrees; lines x%.2f as distinct", F.col("tilt"), F.col("tilt_gain")), angle=F.col("tilt"))
    notes += [F.when(tilted & ~trusted, F.lit("rotate: tilt at the limit of the search")), F.when(tilted & trusted & ~clear, F.lit("rotate: gains too little"))]

    # Uneven light is a shadow on grey paper, and dark print on white.
    r = rules["flatten_light"]
    uneven, grey = yes(F.col("background_spread") > r["above_background_spread"]), yes(F.col("paper_level") < r["below_paper_level"])
    kernel = F.when(th.isNotNull(), odd(th * r["kernel_per_text_height"], 15)).otherwise(odd(F.least(w, h) / 20.0, 15))
    steps["flatten_light"] = _step("flatten_light", uneven & grey, _says("light varies by %.0f", F.col("background_spread")), kernel_px=kernel)
    notes.append(F.when(uneven & ~grey, F.lit("flatten_light: paper is white")))
    flat = uneven & grey & yes(F.col("paper_level") > 0)
    out = out.withColumns({"_flat": uneven & grey, "_contrast": F.when(flat, F.least(F.lit(255.0), F.try_divide(F.col("text_contrast") * 255.0, F.col("paper_level")))).otherwise(F.col("text_contrast")), "_paper": F.when(flat, 255.0).otherwise(F.col("paper_level"))})

    r = rules["stretch_contrast"]
    out = out.withColumn("_stretched", yes((F.col("_contrast") > 0) & (F.col("_contrast") < r["below_text_contrast"]) & (F.col("ink_share") > 0)))
    steps["stretch_contrast"] = _step("stretch_contrast", F.col("_stretched"), _says("contrast %.0f", F.col("_contrast")), ink_level=F.bround(F.col("_paper") - F.col("_contrast"), 1), paper_level=F.bround("_paper", 1), target_ink=r["target_ink_level"], target_paper=r["target_paper_level"])
    notes.append(F.when(yes(F.col("_contrast") <= 0), F.lit("stretch_contrast: ink and paper do not differ")))

    r = rules["brighten"]
    dark = yes((F.col("_paper") > 0) & (F.col("_paper") < r["below_paper_level"]) & ~F.col("_flat") & ~F.col("_stretched"))
    gamma = F.greatest(_num(r["min_gamma"]), F.try_divide(F.log(_num(r["target_paper_level"]) / 255.0), F.log(F.col("_paper") / 255.0)))
    steps["brighten"] = _step("brighten", dark, _says("paper at %.0f", F.col("_paper")), gamma=F.bround(gamma, 3))

    # Characters are made as high as the reader wants them, as far as it takes the page.
    r = rules["resize"]
    small = F.col("small_height" if r["size_basis"] == "small" else "text_height")
    seen, room = small * shrink(F.col("_w"), F.col("_h"), max_side), F.try_divide(_num(max_side), F.greatest("_w", "_h"))
    out = out.withColumns({"_seen": seen, "_room": room, "_fit": F.try_divide(_num(r["target_text_height_px"]), small)})
    low, high = yes((F.col("_seen") > 0) & (F.col("_seen") < r["below_text_height_px"])), yes(F.col("_seen") > r["above_text_height_px"])
    out = out.withColumns({"_low": low, "_high": high & ~low, "_wanted": F.least(_num(r["max_upscale"]), F.col("_fit"))})
    up = F.least("_wanted", "_room")
    out = out.withColumns({"_up": up, "_stuck": F.col("_low") & yes(up < 1 + RESIZED), "_held": F.col("_low") & yes((up >= 1 + RESIZED) & (up < F.col("_wanted") - RESIZED))})
    out = out.withColumn("_factor", F.when(F.col("_low") & ~F.col("_stuck"), F.col("_up")).when(F.col("_high"), F.greatest(_num(r["min_downscale"]), F.col("_fit"))).otherwise(1.0))
    changed = yes(F.abs(F.col("_factor") - 1.0) >= RESIZED)
    steps["resize"] = _step("resize", changed, _says("characters of %.0f px are read at %.0f px", small, F.col("_seen")), scale=F.bround("_factor", 3))
    notes += [F.when(small.isNull(), F.lit("resize: height of characters unknown")), F.when(F.col("_stuck"), F.lit("resize: page is at the reader's limit")), F.when(F.col("_held"), F.lit("resize: held by the reader's limit"))]

    r, s = rules["adaptive_threshold"], rules["sharpen"]
    faint, soft = yes(F.col("text_contrast") < r["below_text_contrast"]), yes(F.col("sharpness") < s["below_sharpness"])
    share = 1.0 - F.try_divide(F.col("sharpness"), _num(s["below_sharpness"]))
    steps["sharpen"] = _step("sharpen", soft & ~faint, _says("sharpness %.0f", F.col("sharpness")), amount=F.bround(s["min_amount"] + share * (s["max_amount"] - s["min_amount"]), 2), radius_px=s["radius_px"])
    notes.append(F.when(soft & faint, F.lit("sharpen: page is thresholded")))
    size = F.coalesce(th, F.least(w, h) / 40.0) * F.when(changed, F.col("_factor")).otherwise(1.0)
    offset = F.bround(F.greatest(_num(r["min_offset"]), F.col("noise") * r["offset_per_noise_sigma"]), 1)
    steps["adaptive_threshold"] = _step("adaptive_threshold", faint, _says("contrast %.0f", F.col("text_contrast")), block_px=odd(size * r["block_per_text_height"], 15), offset=offset)

    plan = {"steps": F.array_compact(F.array(*[steps[k] for k in STEPS])), "notes": F.array_compact(F.array(*notes))}
    return out.select(*pages.columns, *[c.alias(k) for k, c in plan.items()])


def param(step: str, name: str) -> Column:
    """A parameter of a step of the plan; null where the plan has no such step."""
    found = F.get(F.filter("steps", lambda s: s["name"] == step), F.lit(0))
    return F.try_element_at(found["params"], F.lit(name))
