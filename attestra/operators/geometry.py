"""Page transforms: steps folded to an affine map, its inverse, and boxes moved by it.

A transform is ``array<double>`` of a, b, c, d, e, f: x' = a x + b y + c and
y' = d x + e y + f.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def affine(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values])


def compose(then: Column, first: Column) -> Column:
    """The map that does ``first`` and then ``then``."""
    p, q = (lambda i: F.get(then, F.lit(i))), (lambda i: F.get(first, F.lit(i)))
    return affine(p(0) * q(0) + p(1) * q(3), p(0) * q(1) + p(1) * q(4), p(0) * q(2) + p(1) * q(5) + p(2), p(3) * q(0) + p(4) * q(3), p(3) * q(1) + p(4) * q(4), p(3) * q(2) + p(4) * q(5) + p(5))


def step_transform(step: Column, width: Column, height: Column) -> Column:
    """The map of one step: crop (left, top), resize (scale) or rotate (degrees, page grown to fit); others leave points where they are."""
    v = lambda k: F.coalesce(F.try_element_at(step["params"], F.lit(k)), F.lit(0.0))
    scale = F.coalesce(F.try_element_at(step["params"], F.lit("scale")), F.lit(1.0))
    turn = F.radians(v("angle"))
    cos, sin = F.cos(turn), F.sin(turn)
    new_w, new_h = F.floor(height * F.abs(sin) + width * F.abs(cos)), F.floor(height * F.abs(cos) + width * F.abs(sin))
    rotate = affine(cos, sin, (1 - cos) * width / 2 - sin * height / 2 + new_w / 2 - width / 2, -sin, cos, sin * width / 2 + (1 - cos) * height / 2 + new_h / 2 - height / 2)
    name = step["name"]
    return F.when(name == "crop", affine(1, 0, -v("left"), 0, 1, -v("top"))).when(name == "resize", affine(scale, 0, 0, 0, scale, 0)).when(name == "rotate", rotate).otherwise(affine(*IDENTITY))


def step_size(step: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Width and height of the page after a step."""
    p = lambda k, other: F.coalesce(F.try_element_at(step["params"], F.lit(k)), other)
    turn, scale = F.radians(p("angle", F.lit(0.0))), p("scale", F.lit(1.0))
    cos, sin = F.abs(F.cos(turn)), F.abs(F.sin(turn))
    name = step["name"]
    w = F.when(name == "crop", p("right", width) - p("left", F.lit(0.0))).when(name == "resize", F.floor(width * scale).cast("double")).when(name == "rotate", F.floor(height * sin + width * cos).cast("double")).otherwise(width)
    h = F.when(name == "crop", p("bottom", height) - p("top", F.lit(0.0))).when(name == "resize", F.floor(height * scale).cast("double")).when(name == "rotate", F.floor(height * cos + width * sin).cast("double")).otherwise(height)
    return w, h


def page_transform(steps: Column, width: Column, height: Column) -> Column:
    """From points of the original page to points of the processed one."""
    start = F.struct(affine(*IDENTITY).alias("m"), width.cast("double").alias("w"), height.cast("double").alias("h"))

    def fold(acc: Column, step: Column) -> Column:
        w, h = step_size(step, acc["w"], acc["h"])
        return F.struct(compose(step_transform(step, acc["w"], acc["h"]), acc["m"]).alias("m"), w.alias("w"), h.alias("h"))

    return F.aggregate(steps, start, fold, lambda acc: acc["m"])


def invert(m: Column) -> Column:
    """The inverse map; null where there is none."""
    v = lambda i: F.get(m, F.lit(i))
    det = v(0) * v(4) - v(1) * v(3)
    return F.when(F.abs(det) >= 1e-12, affine(v(4) / det, -v(1) / det, (v(1) * v(5) - v(4) * v(2)) / det, -v(3) / det, v(0) / det, (v(3) * v(2) - v(0) * v(5)) / det))


def apply(m: Column, point: Column) -> Column:
    v, x, y = (lambda i: F.get(m, F.lit(i))), F.get(point, F.lit(0)), F.get(point, F.lit(1))
    return F.array(v(0) * x + v(1) * y + v(2), v(3) * x + v(4) * y + v(5))


def page_box(m: Column, box: Column) -> Column:
    """A box of the processed page on the original one, to a tenth. ``m`` should be a plain column, as it is named many times."""
    back = invert(m)
    return F.transform(box, lambda p: F.transform(apply(back, p), lambda v: F.bround(v, 1)))
