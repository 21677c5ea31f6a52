"""Box and interval column functions over struct<x1,y1,x2,y2> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_box(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def width(b: Column) -> Column:
    return F.greatest(F.lit(1), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(1), b["y2"] - b["y1"])


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def area(b: Column) -> Column:
    return width(b) * height(b)


def shared_x(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))


def shared_y(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    return shared_x(a, b) * shared_y(a, b)


def box_iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    return inter / F.greatest(F.lit(1), area(a) + area(b) - inter)


def overlap_over_smaller(a: Column, b: Column) -> Column:
    return intersection(a, b) / F.least(area(a), area(b))


def union_box(a: Column, b: Column) -> Column:
    return make_box(
        F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]),
        F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]),
    )


def _height_ratio(a: Column, b: Column) -> Column:
    return F.least(height(a), height(b)) / F.greatest(height(a), height(b))


def _raw_width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def _overlap_share(a: Column, b: Column) -> Column:
    return shared_x(a, b) / F.greatest(F.lit(1), F.least(_raw_width(a), _raw_width(b)))


def spatial_compatibility(a: Column, b: Column) -> Column:
    """0 when two boxes cannot be one caption row, else at least .05."""
    ratio = shared_y(a, b) / F.least(height(a), height(b))
    drift = F.abs(center_y(a) - center_y(b))
    tolerance = F.greatest(F.lit(8.0), (height(a) + height(b)) / 2 * F.lit(0.35))
    reach = F.greatest(F.lit(100.0), (_raw_width(a) + _raw_width(b)) * F.lit(0.75))
    apart = ((ratio < 0.5) & (drift > tolerance)) | (F.abs(center_x(a) - center_x(b)) > reach)
    score = F.greatest(F.lit(0.05), ratio, F.greatest(F.lit(0.0), F.lit(1.0) - drift / tolerance))
    return F.when(apart, F.lit(0.0)).otherwise(score)


def same_caption_stream(a: Column, b: Column) -> Column:
    narrow = F.least(width(a), width(b))
    return (
        (_height_ratio(a, b) >= 0.72)
        & (F.abs(center_y(a) - center_y(b)) <= (height(a) + height(b)) / 2 * F.lit(2.5))
        & (F.abs(center_x(a) - center_x(b)) <= F.greatest(F.lit(24.0), narrow * F.lit(0.25)))
        & (shared_x(a, b) / narrow >= 0.5)
    )


def boxes_stacked(a: Column, b: Column) -> Column:
    """Two rows of one two-line caption, whichever is on top."""
    tall = F.greatest(height(a), height(b))
    delta = F.abs(center_y(a) - center_y(b))
    return (
        (_height_ratio(a, b) >= 0.72)
        & (delta >= tall * F.lit(0.52)) & (delta <= tall * F.lit(1.25))
        & (_overlap_share(a, b) >= 0.60)
    )


def stacked_line_score(top: Column, bottom: Column) -> Column:
    tall = F.greatest(height(top), height(bottom))
    delta = center_y(bottom) - center_y(top)
    shift = F.abs(center_x(top) - center_x(bottom))
    narrow = F.greatest(F.lit(1), F.least(_raw_width(top), _raw_width(bottom)))
    share = shared_x(top, bottom) / narrow
    fits = (
        (_height_ratio(top, bottom) >= 0.72)
        & (delta >= tall * F.lit(0.52)) & (delta <= tall * F.lit(1.25)) & (share >= 0.60)
        & (shift <= F.greatest(_raw_width(top), _raw_width(bottom)) * F.lit(0.30))
    )
    return F.when(fits, share - shift / narrow * F.lit(0.1))


def fragments_share_line(a: Column, b: Column, roi: Column | None = None) -> Column:
    short, tall = F.least(height(a), height(b)), F.greatest(height(a), height(b))
    drift = F.abs(center_y(a) - center_y(b))
    ok = (
        (short / tall >= 0.68) & (shared_y(a, b) / short >= 0.58) & (drift <= tall * F.lit(0.38))
    )
    if roi is not None:
        margin = F.greatest(F.lit(3), F.bround(width(roi) * F.lit(0.01), 0))
        touch = lambda c: F.least(F.abs(c["x1"] - roi["x1"]), F.abs(roi["x2"] - c["x2"])) <= margin
        uneven = (drift > tall * F.lit(0.25)) | (F.abs(a["y2"] - b["y2"]) > tall * F.lit(0.22))
        ok = ok & ~((touch(a) != touch(b)) & uneven)
    a_first = a["x1"] <= b["x1"]
    first_end = F.when(a_first, a["x2"]).otherwise(b["x2"])
    second_start = F.when(a_first, b["x1"]).otherwise(a["x1"])
    smaller = F.greatest(F.lit(1), F.least(_raw_width(a), _raw_width(b)))
    overlap = F.greatest(F.lit(0), first_end - second_start) / smaller
    gap = F.greatest(F.lit(0), second_start - first_end)
    return ok & (overlap <= 0.55) & (gap <= F.greatest(F.lit(24), F.bround(tall * F.lit(0.9), 0)))


def intervals_overlap(s1, e1, s2, e2) -> Column:
    return F.least(e1, e2) > F.greatest(s1, s2)


def substantial_overlap(s1, e1, s2, e2) -> Column:
    shorter = F.least(e1 - s1, e2 - s2)
    return (shorter > 0) & ((F.least(e1, e2) - F.greatest(s1, s2)) / shorter >= 0.55)


def frame_iou(s1, e1, s2, e2) -> Column:
    """Temporal IoU of two inclusive frame ranges."""
    inter = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    union = F.greatest(e1, e2) - F.least(s1, s2) + 1
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def polygon_to_box(points: Column, offset_x: Column, offset_y: Column) -> Column:
    """Bounding box of array<array<double>>, truncated to ints and shifted."""
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)))
    bad = lambda arr: F.exists(
        arr, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    )
    usable = points.isNotNull() & (F.size(points) > 0) & ~bad(xs) & ~bad(ys)
    return F.when(
        usable,
        make_box(
            F.array_min(xs).cast("int") + offset_x, F.array_min(ys).cast("int") + offset_y,
            F.array_max(xs).cast("int") + offset_x, F.array_max(ys).cast("int") + offset_y,
        ),
    )


def roi_pixels(roi: Column, frame_w: Column, frame_h: Column) -> Column:
    """Pixel window of a normalised region; always at least one pixel."""
    left = F.greatest(F.lit(0), F.least(F.bround(frame_w * roi["x"], 0).cast("long"), frame_w - 1))
    top = F.greatest(F.lit(0), F.least(F.bround(frame_h * roi["y"], 0).cast("long"), frame_h - 1))
    right = F.bround(frame_w * (roi["x"] + roi["width"]), 0).cast("long")
    bottom = F.bround(frame_h * (roi["y"] + roi["height"]), 0).cast("long")
    return make_box(
        left, top,
        F.greatest(left + 1, F.least(frame_w, right)),
        F.greatest(top + 1, F.least(frame_h, bottom)),
    )
