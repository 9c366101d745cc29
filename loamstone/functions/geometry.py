"""Bounding boxes as structs (x0, y0, x1, y1): pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])


def from_size(left: Column, top: Column, width: Column, height: Column) -> Column:
    """The other encoding: a corner and a size."""
    return bbox(left, top, left + width, top + height)


def from_json(text: Column) -> Column:
    """Either encoding, or a list of four numbers, from JSON; null if it is none of them."""
    s = F.from_json(text, "x0 double, y0 double, x1 double, y1 double, left double, top double, width double, height double")
    four = F.from_json(text, "array<double>")
    whole = lambda *names: F.lit(True) if not names else s[names[0]].isNotNull() & whole(*names[1:])
    return (
        F.when(whole("x0", "y0", "x1", "y1"), bbox(s["x0"], s["y0"], s["x1"], s["y1"]))
        .when(whole("left", "top", "width", "height"), from_size(s["left"], s["top"], s["width"], s["height"]))
        .when(F.size(four) == 4, bbox(F.get(four, F.lit(0)), F.get(four, F.lit(1)), F.get(four, F.lit(2)), F.get(four, F.lit(3))))
    )


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(b["x1"] - b["x0"], zero) * F.greatest(b["y1"] - b["y0"], zero)


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    width = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), zero)
    return width * F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), zero)


def overlap_ratio(a: Column, b: Column) -> Column:
    """The share of ``a`` that lies in ``b``; 0 for an empty ``a``."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(F.lit(0.0))


def gap(a: Column, b: Column, axis: str) -> Column:
    """Distance along x or y; 0 if the boxes overlap there."""
    low, high = f"{axis}0", f"{axis}1"
    return F.greatest(F.lit(0.0), b[low] - a[high], a[low] - b[high])


def near(a: Column, b: Column, vertical: float, horizontal: float) -> Column:
    return (gap(a, b, "y") <= vertical) & (gap(a, b, "x") <= horizontal)


def center(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of the centres."""
    p, q = center(a), center(b)
    return F.sqrt(F.pow(p["x"] - q["x"], F.lit(2)) + F.pow(p["y"] - q["y"], F.lit(2)))
