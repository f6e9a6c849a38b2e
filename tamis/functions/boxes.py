"""Boxes between resolutions: whole numbers, cut off at the frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A box that leaves less than this share of the frame out isn't worth a crop.
MOST_CONTENT = 0.95


def scaled(x: Column, y: Column, w: Column, h: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """The box times two factors, fractions dropped, inside a frame of width x height and at least one pixel large."""
    first = lambda at, s: F.greatest(F.lit(0).cast("long"), (at * s).cast("long"))
    extent = lambda n, s, most, at: F.greatest(F.lit(1).cast("long"), F.least((n * s).cast("long"), most - at))
    left, top = first(x, sx), first(y, sy)
    return F.struct(left.alias("x"), top.alias("y"), extent(w, sx, width, left).alias("w"), extent(h, sy, height, top).alias("h"))


def content_box(x: Column, y: Column, w: Column, h: Column, scale: Column, width: Column, height: Column) -> Column:
    """A box found in a frame made smaller by `scale`, in the frame itself; null if it is nearly all of it."""
    box = scaled(x, y, w, h, 1 / scale, 1 / scale, width, height)
    return F.when(box["w"] * box["h"] / (width * height) < MOST_CONTENT, box)
