"""Caption regions: validation, box spaces, row clusters and region estimates."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captrail.config import CaptionConfig
from captrail.functions import geometry as G
from captrail.functions import text as T
from captrail.functions.numeric import clamp, half_even, is_finite
from captrail.operators.folds import cut

# The default region and the smallest side the editor allows.
DEFAULT_ROI = {"x": 0.08, "y": 0.52, "width": 0.84, "height": 0.24}
MIN_UI_SIDE = 0.03

# Vertical shifts (top, bottom) in pixels of a focus box.
FOCUS_SHIFTS = (
    (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-2, 0), (2, 0), (0, -2), (0, 2),
    (-1, -1), (1, 1), (-2, -2), (2, 2),
)

SIDES = ("x", "y", "width", "height")


def validate_roi(roi: Column, level: str) -> Column:
    """True for a usable region; ``level`` is 'model', 'api' or 'ui'."""
    x, y, w, h = (roi[c] for c in SIDES)
    finite = is_finite(x) & is_finite(y) & is_finite(w) & is_finite(h)
    if level == "ui":
        ok = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1)
    else:
        ok = x.between(0.0, 1.0) & y.between(0.0, 1.0) & (w <= 1) & (h <= 1)
        if level == "model":
            ok = ok & (w > 0) & (h > 0) & (x + w <= 1.000001) & (y + h <= 1.000001)
        elif level == "api":
            ok = ok & (w >= 0.01) & (h >= 0.01) & (x + w <= 1) & (y + h <= 1)
        else:
            raise ValueError(f"unknown level {level!r}")
    return finite & ok


def sanitize_roi(roi: Column) -> Column:
    """Editor form: the default when invalid, at least MIN_UI_SIDE, six decimals."""
    w = clamp(roi["width"], MIN_UI_SIDE, 1.0)
    h = clamp(roi["height"], MIN_UI_SIDE, 1.0)
    good = {
        "x": clamp(roi["x"], 0.0, F.lit(1.0) - w), "y": clamp(roi["y"], 0.0, F.lit(1.0) - h),
        "width": w, "height": h,
    }
    six = lambda c: F.floor(c * 1000000 + F.lit(0.5)) / 1000000
    valid = validate_roi(roi, "ui")
    return F.struct(*[
        F.when(valid, six(good[c])).otherwise(F.lit(DEFAULT_ROI[c])).alias(c) for c in SIDES
    ])


def _percent_rect(left, top, right, bottom, width, height) -> Column:
    l, r = clamp(left, 0.0, width), clamp(right, 0.0, width)
    t, b = clamp(top, 0.0, height), clamp(bottom, 0.0, height)
    rect = F.struct(
        (l / width * 100).alias("left"), (t / height * 100).alias("top"),
        ((r - l) / width * 100).alias("width"), ((b - t) / height * 100).alias("height"),
    )
    return F.when((r > l) & (b > t), rect)


def normalize_box(box: Column, width: Column, height: Column, space: Column, roi: Column) -> Column:
    """array<double>[x1,y1,x2,y2] in a named space to a percent rectangle.

    ``roi`` offsets 'roi' spaces; offsets up to 1 count as fractions.
    """
    name = F.lower(F.coalesce(space, F.lit("")))
    unit, local = F.contains(name, F.lit("normalized")), F.contains(name, F.lit("roi"))
    shift = lambda v, side: F.coalesce(v, F.lit(0)) * F.when(F.abs(F.coalesce(v, F.lit(0))) <= 1, side).otherwise(1)
    ox, oy = shift(roi["x1"], width), shift(roi["y1"], height)

    def place(v, side, offset):
        return F.when(unit, v * side).when(local & roi.isNotNull(), v + offset).otherwise(v)

    xs = [place(F.get(box, F.lit(i)), width, ox) for i in (0, 2)]
    ys = [place(F.get(box, F.lit(i)), height, oy) for i in (1, 3)]
    return _percent_rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys), width, height)


def normalize_roi_box(roi: Column, width: Column, height: Column) -> Column:
    """Region in pixels or fractions to a percent rectangle."""
    px = (F.abs(roi["x"]) > 1) | (F.abs(roi["width"]) > 1)
    py = (F.abs(roi["y"]) > 1) | (F.abs(roi["height"]) > 1)
    x, w = (F.when(px, roi[c] / width).otherwise(roi[c]) for c in ("x", "width"))
    y, h = (F.when(py, roi[c] / height).otherwise(roi[c]) for c in ("y", "height"))
    one = F.lit(1.0)
    return _percent_rect(x, y, x + w, y + h, one, one)


def focus_variants(box: Column) -> Column:
    """Array of the distinct non-empty vertical shifts of a box."""
    shifted = F.array(*[
        G.make_box(box["x1"], box["y1"] + a, box["x2"], box["y2"] + b) for a, b in FOCUS_SHIFTS
    ])
    return F.array_distinct(F.filter(shifted, lambda v: v["y2"] > v["y1"]))


def focus_box(events: DataFrame, videos: DataFrame) -> DataFrame:
    """Band to watch for short changes: median rows plus padding inside the region.

    ``videos``: (video_id, frame_w, frame_h, roi).
    """
    box = F.col("box")
    bands = events.where(box.isNotNull()).groupBy("video_id").agg(
        F.median(box["y1"]).cast("int").alias("_top"), F.median(box["y2"]).cast("int").alias("_bottom"),
        F.median(G.height(box)).alias("_height"),
    )
    pad = F.greatest(F.lit(6), half_even(F.col("_height") * F.lit(0.35)).cast("long"))
    px = lambda side, v: half_even(F.col(side) * v).cast("long")
    roi = F.col("roi")
    top, bottom = px("frame_h", roi["y"]), px("frame_h", roi["y"] + roi["height"])
    return bands.join(videos, "video_id").select(
        "video_id", px("frame_w", roi["x"]).alias("x1"),
        F.greatest(top, F.col("_top") - pad).alias("y1"),
        px("frame_w", roi["x"] + roi["width"]).alias("x2"),
        F.least(bottom, F.col("_bottom") + pad).alias("y2"),
    )


def screen_candidates(obs: DataFrame, frame_w: int, frame_h: int, min_confidence: float = 0.55) -> DataFrame:
    """Detections that may belong to a caption row, with normalised geometry.

    ``obs`` needs text, confidence and x1..y2. Confidence must exceed the limit.
    """
    sides = {"x1": frame_w, "y1": frame_h, "x2": frame_w, "y2": frame_h}
    rounded = {c: clamp(half_even(F.col(c).cast("double")).cast("long"), 0, top) for c, top in sides.items()}
    w = (F.col("x2") - F.col("x1")) / F.lit(float(frame_w))
    h = (F.col("y2") - F.col("y1")) / F.lit(float(frame_h))
    finite = is_finite(F.col("confidence"))
    for c in sides:
        finite = finite & is_finite(F.col(c).cast("double"))
    return (
        obs.where(finite & (F.col("confidence") > min_confidence) & (F.trim("text") != ""))
        .withColumns(rounded)
        .withColumns({
            "text": F.trim("text"), "w": w, "h": h,
            "cx": (F.col("x1") + F.col("x2")) / 2 / F.lit(float(frame_w)),
            "cy": (F.col("y1") + F.col("y2")) / 2 / F.lit(float(frame_h)),
        })
        .where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
        .where((F.col("w") >= 0.01) & F.col("h").between(0.008, 0.22))
    )


def _middle(ascending: list[float]) -> float:
    n = len(ascending)
    return ascending[n // 2] if n % 2 else (ascending[n // 2 - 1] + ascending[n // 2]) / 2


def cluster_rows_pdf(pdf: pd.DataFrame, tolerance: float = 0.06) -> pd.DataFrame:
    """Row clusters of one video's sample, then rows that form one caption merged.

    Boxes arrive by rising centre, so every cluster stays sorted and its median
    is read by position.
    """
    pdf = pdf.sort_values(["cy", "sample_index", "x1", "text"], kind="stable").reset_index(drop=True)
    centres: list[list[float]] = []
    members: list[list[int]] = []
    for pos, (cy, h) in enumerate(zip(pdf["cy"], pdf["h"])):
        dist = [abs(cy - _middle(c)) for c in centres]
        near = [(d, k) for k, d in enumerate(dist) if d <= max(tolerance, h * 0.8)]
        if near:
            k = min(near)[1]
        else:
            k = len(centres)
            centres.append([])
            members.append([])
        bisect.insort(centres[k], cy)
        members[k].append(pos)

    row = np.empty(len(pdf), dtype="int64")
    for number, k in enumerate(sorted(range(len(members)), key=lambda k: _middle(centres[k]))):
        row[members[k]] = number
    return pdf.assign(cluster_id=_captions(pdf, row))


def _captions(pdf: pd.DataFrame, row: np.ndarray) -> np.ndarray:
    """Number the captions: from the top, a row joins the caption above while both are seen together and lie close."""
    edges = pd.DataFrame({"top": pdf["cy"] - pdf["h"] / 2, "bottom": pdf["cy"] + pdf["h"] / 2, "cx": pdf["cx"], "at": pdf["sample_index"]})
    caption = row.copy()
    for number in range(1, int(row.max(initial=0)) + 1):
        above, below = edges[caption == caption[row == number - 1][0]], edges[row == number]
        shown = [np.unique(x["at"]) for x in (above, below)]
        together = len(np.intersect1d(*shown)) >= 0.50 * max(1, min(map(len, shown)))
        gap, shift = below["top"].median() - above["bottom"].median(), abs(below["cx"].median() - above["cx"].median())
        if together and gap <= 0.035 and shift <= 0.20:
            caption[row == number] = caption[row == number - 1][0]
    return np.unique(caption, return_inverse=True)[1].astype("int64")


def cluster_rows(candidates: DataFrame, tolerance: float = 0.06) -> DataFrame:
    """Cluster screened boxes per video.

    The input is the representative sample of a video (16 frames), so a group
    stays small whatever the length of the video.
    """
    schema = candidates.withColumn("cluster_id", F.lit(0).cast("long")).schema
    return candidates.groupBy("video_id").applyInPandas(
        lambda pdf: cluster_rows_pdf(pdf, tolerance), schema
    )


def score_clusters(members: DataFrame, tolerance: float = 0.06) -> DataFrame:
    """Score per (video_id, cluster_id); ``members`` carries sample_index and sample_count."""
    keys = ["video_id", "cluster_id"]
    # Four branches read the members and three of them the frames: stored once, by the columns they need.
    members = cut(members.select(*keys, "sample_index", "sample_count", "confidence", "x1", "cand_no", "text", "cx", "cy"))
    per_frame = members.groupBy(*keys, "sample_index").agg(
        F.avg("confidence").alias("_conf"),
        F.array_sort(F.collect_list(F.struct("x1", "cand_no", "text"))).alias("_texts"),
    ).withColumn(
        "_text", T.variation_key(F.array_join(F.transform("_texts", lambda t: t["text"]), " "))
    ).drop("_texts")
    per_frame = cut(per_frame)
    order = Window.partitionBy(*keys).orderBy("sample_index")
    runs = (
        per_frame.withColumn("_run", F.col("sample_index") - F.row_number().over(order))
        .groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_len"))
        .groupBy(*keys).agg(F.max("_len").alias("longest_run"))
    )
    texts = (
        per_frame.where("_text <> ''").groupBy(*keys, "_text").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_kinds"), F.max("_n").alias("_top"))
    )
    frames = per_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_hits"), F.avg("_conf").alias("mean_confidence"),
        (F.max("sample_index") - F.min("sample_index") + 1).alias("_span"),
    )
    boxes = members.groupBy(*keys).agg(
        F.median("cy").alias("median_cy"), F.stddev_pop("cy").alias("_spread"),
        F.avg(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("cx") - F.lit(0.5)) / F.lit(0.5))).alias("_centring"),
        F.first("sample_count").alias("sample_count"),
    )
    one = F.lit(1.0)
    frequency = F.col("frame_hits") / F.col("sample_count")
    bottom = clamp((F.col("median_cy") - F.lit(0.25)) / F.lit(0.70), 0.0, 1.0)
    concentration = one - F.least(one, F.col("_spread") / F.lit(tolerance))
    continuity = (F.col("longest_run") / F.col("sample_count") + F.col("frame_hits") / F.col("_span")) / 2
    kinds, top = F.coalesce("_kinds", F.lit(0)), F.coalesce("_top", F.lit(0))
    variation = F.least(one, kinds / F.greatest(F.lit(2.0), F.col("frame_hits") * F.lit(0.35)))
    still = (frequency >= 0.60) & (top / F.col("frame_hits") >= 0.80)
    score = (
        frequency * F.lit(0.24) + F.col("mean_confidence") * F.lit(0.16) + bottom * F.lit(0.25)
        + concentration * F.lit(0.12) + F.col("_centring") * F.lit(0.08) + continuity * F.lit(0.07)
        + variation * F.lit(0.08) - F.when(still, F.lit(0.5)).otherwise(F.lit(0.0))
    )
    joined = boxes.join(frames, keys).join(runs, keys).join(texts, keys, "left")
    return joined.select(
        *keys, "frame_hits", "sample_count", "mean_confidence", "median_cy", "longest_run",
        score.alias("score"),
    )


def roi_from_cluster(members: DataFrame, frame_w: int, frame_h: int) -> DataFrame:
    """Region rectangle per (video_id, cluster_id) from its boxes."""
    keys = ["video_id", "cluster_id"]
    central = F.col("cx").between(0.08, 0.92) | (F.col("w") >= 0.30)
    m = members.withColumns({
        "_x1": F.col("x1") / F.lit(float(frame_w)), "_x2": F.col("x2") / F.lit(float(frame_w)),
        "_y1": F.col("y1") / F.lit(float(frame_h)), "_y2": F.col("y2") / F.lit(float(frame_h)), "_c": central,
    })
    inner = lambda c: F.when(F.col("_c"), F.col(c))
    stats = m.groupBy(*keys).agg(
        F.coalesce(F.percentile(inner("_x1"), F.lit(0.03)), F.percentile("_x1", F.lit(0.03))).alias("_l"),
        F.coalesce(F.percentile(inner("_x2"), F.lit(0.97)), F.percentile("_x2", F.lit(0.97))).alias("_r"),
        F.percentile("_y1", F.lit(0.03)).alias("_t"), F.percentile("_y2", F.lit(0.97)).alias("_b"),
        F.median("h").alias("_th"),
    )
    pad_x = F.greatest(F.lit(0.04), F.col("_th") * F.lit(1.2))
    pad_y = F.greatest(F.lit(0.012), F.col("_th") * F.lit(0.45))
    w = F.least(F.lit(0.92), F.greatest(F.lit(0.40), F.col("_r") - F.col("_l") + pad_x * 2))
    h = F.least(F.lit(0.36), F.greatest(F.lit(0.07), F.col("_b") - F.col("_t") + pad_y * 2))
    x = clamp((F.col("_l") + F.col("_r")) / 2 - w / 2, 0.0, F.lit(1.0) - w)
    y = clamp((F.col("_t") + F.col("_b")) / 2 - h / 2, 0.0, F.lit(1.0) - h)
    six = lambda c: half_even(c, 6)
    return stats.select(
        *keys, six(x).alias("x"), six(y).alias("y"), six(w).alias("width"), six(h).alias("height")
    )


def pick_cluster(scored: DataFrame, min_score: float = 0.48) -> DataFrame:
    """Best cluster per video among those seen in enough frames."""
    enough = F.col("frame_hits") >= F.greatest(F.lit(2), F.ceil(F.col("sample_count") * F.lit(0.25)))
    rank = F.struct("score", "frame_hits", "mean_confidence", "median_cy")
    best = scored.where(enough).groupBy("video_id").agg(F.max_by(F.struct("*"), rank).alias("b"))
    return best.where(F.col("b.score") >= min_score).select("b.*")


def estimate_roi(samples: DataFrame, frame_w: int, frame_h: int, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Caption region per video from detections on its representative frames.

    ``samples``: video_id, sample_index, sample_count, cand_no, text, confidence,
    x1..y2. Videos without a convincing row give no output.
    """
    members = cut(cluster_rows(
        screen_candidates(samples, frame_w, frame_h, cfg.min_ocr_confidence), cfg.roi_y_tolerance
    ))
    best = pick_cluster(score_clusters(members, cfg.roi_y_tolerance), cfg.roi_min_score)
    region = roi_from_cluster(members, frame_w, frame_h)
    return best.join(region, ["video_id", "cluster_id"]).select(
        "video_id", "x", "y", "width", "height", half_even(F.col("score"), 6).alias("score"),
        F.col("sample_count").alias("frames_analyzed"), "frame_hits",
        half_even(F.col("mean_confidence"), 6).alias("mean_confidence"),
    )
