"""Operators over cue tables: (video_id, cue_id, text, start_time, end_time, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from captrail.functions import geometry as G
from captrail.functions import text as T
from captrail.functions import timecode as TC
from captrail.functions.numeric import half_even, is_finite
from captrail.operators.folds import cut
from captrail.operators.intervals import asof_join, overlap_join
from captrail.operators.ordered import ordered, quantiles, time_chunk

ORDER = ["start_time", "end_time", "cue_id"]


def _chunk(seconds: float) -> Column:
    return time_chunk("start_time", seconds)


def resolve_overlaps(cues: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Trim a cue that runs into the next one on the same row or stream."""
    nxt = ordered(
        cues, ["video_id"], ORDER, _chunk(chunk_seconds),
        lead={"_n": F.struct("start_time", "box")},
    )
    start, box = F.col("_n.start_time"), F.col("_n.box")
    here = F.col("box")
    same_row = (
        here.isNull() | box.isNull()
        | (G.spatial_compatibility(here, box) > 0) | G.same_caption_stream(here, box)
    )
    trim = (
        F.col("_n").isNotNull() & same_row
        & (F.abs(F.col("start_time") - start) > 0.005) & (F.col("end_time") > start)
    )
    trimmed = half_even(F.greatest(F.col("start_time") + F.lit(0.05), start), 3)
    return nxt.withColumn("end_time", F.when(trim, trimmed).otherwise(F.col("end_time"))).drop("_n")


def mark_coverage(cues: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Add what each cue adds to its video: ``gap_before`` and ``new_time``, in ms."""
    ms = lambda c: half_even(F.col(c) * 1000, 0).cast("long")
    timed = cues.withColumns({"_s": ms("start_time"), "_e": ms("end_time")})
    seen = ordered(
        timed, ["video_id"], ORDER, _chunk(chunk_seconds), max_before={"_reach": "_e"},
    )
    reach = F.coalesce(F.col("_reach"), F.lit(0))
    return seen.withColumns({
        "gap_before": F.greatest(F.lit(0), F.col("_s") - reach),
        "new_time": F.greatest(F.lit(0), F.col("_e") - F.greatest(F.col("_s"), reach)),
    }).drop("_s", "_e", "_reach")


def timeline_quality(cues: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Per video: cues, covered time and longest silent gap after trimming."""
    marked = mark_coverage(resolve_overlaps(cues, chunk_seconds), chunk_seconds)
    return marked.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("cues"),
        F.sum("new_time").alias("covered_ms"),
        F.max("gap_before").alias("longest_gap_ms"),
    )


def timeline_stats(cues: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Corpus timing statistics: durations, short cues, reading speed, coverage share."""
    dur = half_even((F.col("end_time") - F.col("start_time")) * 1000, 0).cast("long")
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    marked = mark_coverage(cues, chunk_seconds).withColumns({"_d": dur, "_c": chars})
    middle = quantiles(marked, ["video_id"], F.col("_d"), {"median_ms": 0.5}, 1000.0)
    return marked.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("cues"),
        F.min("_d").alias("min_ms"), F.max("_d").alias("max_ms"),
        F.count_if(F.col("_d") < 600).alias("short_cues"),
        F.count_if(F.col("_c") * 1000 > F.col("_d") * 20).alias("fast_cues"),
        F.sum("new_time").alias("covered_ms"),
        F.max(half_even(F.col("end_time") * 1000, 0).cast("long")).alias("last_ms"),
        F.max("gap_before").alias("longest_gap_ms"),
    ).join(middle, "video_id", "left").withColumn("covered_share", half_even(F.try_divide("covered_ms", "last_ms"), 6))


def audit_order(cues: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Cues that start before the previous one in stored order, or overlap it."""
    seen = ordered(
        cues, ["video_id"], ORDER, _chunk(chunk_seconds),
        lag={"_p": F.struct("cue_id", "end_time")}, max_before={"_reach": "end_time"},
    )
    return seen.where(F.col("_reach") > F.col("start_time")).select(
        "video_id", "cue_id", F.col("_p.cue_id").alias("previous_id"),
        F.col("_p.end_time").alias("previous_end"), "start_time",
        (F.col("_p.end_time") > F.col("start_time")).alias("adjacent"),
    )


def number_cues(cues: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """1-based position of each cue in its video."""
    return ordered(cues, ["video_id"], ORDER, _chunk(chunk_seconds), number="number")


def srt_blocks(cues: DataFrame, style: str = "batch", chunk_seconds: float = 600.0) -> DataFrame:
    """One numbered SRT block per cue.

    A file is its blocks in order, joined by a blank line; keeping blocks as
    rows means no video has to fit into one string. ``style='service'`` uses
    half-up milliseconds and also removes NULs.
    """
    clock = TC.srt_time if style == "batch" else TC.srt_time_js
    body = F.col("text") if style == "batch" else T.clean_text(F.col("text"))
    body = F.regexp_replace(F.replace(body, F.lit("\r"), F.lit("")), r"\A\s+|\s+\z", "")
    span = F.concat(clock(F.col("start_time")), F.lit(" --> "), clock(F.col("end_time")))
    block = F.concat_ws("\n", F.col("number").cast("string"), span, body)
    return number_cues(cues, chunk_seconds).select("video_id", "number", block.alias("block"))


def cue_at(points: DataFrame, cues: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Cue shown at each (video_id, t): the last one started, if still running."""
    hits = asof_join(
        points, cues.select("video_id", "cue_id", "text", "start_time", "end_time"),
        ["video_id"], "t", "start_time", ["end_time", "cue_id"], "hit",
        chunk_seconds=chunk_seconds,
    )
    live = F.when(F.col("t") < F.col("hit.end_time"), F.col("hit"))
    return hits.withColumn("hit", live).select(
        *points.columns, F.col("hit.cue_id").alias("cue_id"), F.col("hit.text").alias("text")
    )


def cues_in_window(cues: DataFrame, windows: DataFrame, width: float = 8.0) -> DataFrame:
    """Cues visible in (video_id, view_id, view_start, view_end) with clipped percent extent."""
    both = overlap_join(
        windows, cues, ["video_id"],
        (F.col("view_start"), F.col("view_end")), (F.col("start_time"), F.col("end_time")),
        (F.col("start_time") < F.col("view_end")) & (F.col("end_time") > F.col("view_start")), width,
    )
    span = F.col("view_end") - F.col("view_start")
    left = F.greatest(F.col("start_time"), F.col("view_start"))
    right = F.least(F.col("end_time"), F.col("view_end"))
    return both.select(
        "video_id", "view_id", "cue_id",
        half_even((left - F.col("view_start")) * 100 / span, 4).alias("left_pct"),
        half_even((right - left) * 100 / span, 4).alias("width_pct"),
    )


def active_at_grid(cues: DataFrame, videos: DataFrame, k: int) -> DataFrame:
    """All cues active at each of ``k`` evenly spaced instants of (video_id, duration)."""
    grid = videos.select(
        "video_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_index"), "duration"
    ).withColumn("t", F.col("sample_index") * F.col("duration") / F.lit(max(1, k - 1)))
    both = overlap_join(
        grid, cues, ["video_id"], (F.col("t"), F.col("t")),
        (F.col("start_time"), F.col("end_time")),
        (F.col("start_time") <= F.col("t")) & (F.col("t") < F.col("end_time")),
    )
    return both.select("video_id", "sample_index", "t", "cue_id")


def _geometry(box: Column) -> dict[str, Column]:
    one = F.lit(1.0)
    return {
        "_w": F.greatest(one, (box["x2"] - box["x1"]).cast("double")),
        "_h": F.greatest(one, (box["y2"] - box["y1"]).cast("double")),
        "_cx": (box["x1"] + box["x2"]) / 2, "_cy": (box["y1"] + box["y2"]) / 2,
    }


def row_reach(height, other):
    """How far apart the centres of two boxes of one caption row may lie; numbers or arrays."""
    return np.maximum(np.maximum(18.0, height * 0.55), other * 0.4)


def row_support(height: np.ndarray, centre: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each class of boxes the weight of all classes whose centre is within reach.

    For each height the centres are sorted and their weights summed up once; each class then looks up both ends of its
    reach. Classes times heights, not classes times classes.
    """
    out = np.zeros(len(height), np.int64)
    for other in np.unique(height):
        own = np.flatnonzero(height == other)
        own = own[np.argsort(centre[own], kind="stable")]
        at, sums = centre[own], np.concatenate(([0], np.cumsum(weight[own])))
        reach = row_reach(height, other)
        low, high = np.searchsorted(at, centre - reach, "left"), np.searchsorted(at, centre + reach, "right")
        # The ends are rounded, the distance decides: an end may be off by one centre.
        near = lambda k: (k >= 0) & (k < len(at)) & (np.abs(at[np.clip(k, 0, len(at) - 1)] - centre) <= reach)
        low = np.where(near(low - 1), low - 1, np.where(near(low), low, np.minimum(low + 1, high)))
        high = np.where(near(high), high + 1, np.where(near(high - 1), high, np.maximum(high - 1, low)))
        out += sums[high] - sums[low]
    return out


def _weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(counts[order])
    low, high = (values[order[np.searchsorted(upto, rank, "right")]] for rank in ((upto[-1] - 1) // 2, upto[-1] // 2))
    return float(low if low == high else low * 0.5 + high * 0.5)


def dominant_geometry(events: DataFrame) -> DataFrame:
    """Dominant caption row per video: centre and height of the best supported row.

    Events become classes of equal height and centre, whose number is bounded by the pixel grid however many events a
    video has; a video's classes are handled at once. Weights are summed as integers, which makes ties independent of the
    order of rows.
    """
    boxed = events.where(F.col("box").isNotNull()).withColumns(_geometry(F.col("box")))
    weight = F.least(F.lit(6.0), F.col("_w") / F.col("_h")) * F.greatest(F.lit(0.2), F.col("confidence"))
    classes = boxed.groupBy("video_id", "_h", "_cy").agg(
        F.sum(half_even(weight * 1000000000, 0).cast("long")).alias("_weight"),
        F.min(F.struct("start_time", "end_time", "cue_id")).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    )

    def dominant(rows: pa.Table) -> pa.Table:
        h, cy, weight, n = (rows.column(c).to_numpy() for c in ("_h", "_cy", "_weight", "_n"))
        support = row_support(h, cy, weight)
        best = np.flatnonzero(support == support.max())
        first = rows.column("_first").take(pa.array(best)).to_pylist()
        seed = best[min(range(len(best)), key=lambda k: tuple(first[k].values()))]
        kept = np.abs(cy - cy[seed]) <= row_reach(h[seed], h)
        values = [_weighted_median(cy[kept], n[kept]), _weighted_median(h[kept], n[kept]), int(n[kept].sum()), int(n.sum())]
        names = ["dominant_cy", "dominant_h", "dominant_events", "boxed_events"]
        return pa.table({"video_id": rows.column("video_id").slice(0, 1), **{c: pa.array([v]) for c, v in zip(names, values, strict=True)}})

    schema = StructType([
        events.schema["video_id"], StructField("dominant_cy", DoubleType()), StructField("dominant_h", DoubleType()),
        StructField("dominant_events", LongType()), StructField("boxed_events", LongType()),
    ])
    return classes.groupBy("video_id").applyInArrow(dominant, schema)


def dominant_rejection(roi: Column, sample_fps: float) -> Column:
    """Name of the first rule that rejects an event, null when it stays."""
    w, h, cx, cy = (F.col(c) for c in ("_w", "_h", "_cx", "_cy"))
    box, big_h = F.col("box"), F.col("dominant_h")
    roi_w = F.greatest(F.lit(1.0), (roi["x2"] - roi["x1"]).cast("double"))
    vo = F.abs(cy - F.col("dominant_cy"))
    ho = F.abs(cx - (roi["x1"] + roi["x2"]) / 2)
    lasting = F.col("end_time") - F.col("start_time") >= max(1.2, 2.5 / max(0.25, sample_fps))
    edge = F.least(F.abs(box["x1"] - roi["x1"]), F.abs(roi["x2"] - box["x2"]))
    at = lambda c, f: c * F.lit(f)
    return (
        F.when(h < F.greatest(F.lit(6.0), at(big_h, 0.30)), "tiny")
        .when(lasting & (w / h < 2.6) & ((vo > at(big_h, 0.25)) | (ho > at(roi_w, 0.18))), "label")
        .when(lasting & (h < at(big_h, 0.75)) & (vo > at(big_h, 0.40)), "byline")
        .when((h < at(big_h, 0.55)) & (vo > at(big_h, 0.40)), "small")
        .when((vo > at(big_h, 0.60)) & (ho > at(roi_w, 0.20)) & (w < at(roi_w, 0.55)), "corner")
        .when((ho > at(roi_w, 0.35)) & (w < at(roi_w, 0.16)) & (h < at(big_h, 0.80)), "side")
        .when((edge <= F.greatest(F.lit(3.0), at(roi_w, 0.01))) & (w < at(roi_w, 0.60))
              & ((h < at(big_h, 0.75)) | (h > at(big_h, 1.20))), "clipped")
    )


def filter_dominant(events: DataFrame, roi: Column, sample_fps: float) -> DataFrame:
    """Drop events that do not fit the dominant caption geometry, then competitors."""
    plain = events.columns
    judged = (
        events.withColumns(_geometry(F.col("box")))
        .join(dominant_geometry(events), "video_id", "left")
        .withColumn("_rule", dominant_rejection(roi, sample_fps))
    )
    few = F.coalesce(F.col("boxed_events"), F.lit(0)) < 2
    kept = judged.where(few | F.col("box").isNull() | F.col("_rule").isNull())
    return suppress_competitors(cut(kept.select(*plain)))


def competitor_losers(events: DataFrame) -> DataFrame:
    """(video_id, cue_id) of weak rows that wrap around, or hang on, a strong caption."""
    base = events.where(F.col("box").isNotNull()).select(
        "video_id", "cue_id", "start_time", "end_time", "confidence", "box",
        T.norm_caption(F.col("text")).alias("norm"), F.contains("text", F.lit("\n")).alias("multi"),
    )

    def side(df, p):
        return df.select("video_id", *[F.col(c).alias(p + c) for c in df.columns if c != "video_id"])

    span = lambda p: (F.col(p + "start_time"), F.col(p + "end_time"))
    expanded = side(base.where("multi"), "e_")
    strong = side(base.where("not multi and confidence >= 0.96"), "s_")
    wins = overlap_join(
        expanded, strong, ["video_id"], span("e_"), span("s_"),
        G.substantial_overlap(*span("e_"), *span("s_"))
        & T.token_run_contained(F.col("e_norm"), F.col("s_norm"))
        & (F.col("s_confidence") - F.col("e_confidence") >= 0.06)
        & (G.overlap_over_smaller(F.col("e_box"), F.col("s_box")) >= 0.88),
    )
    wins = cut(wins)  # few rows, read twice
    third = side(base, "c_")
    hangers = overlap_join(
        wins, third, ["video_id"], span("s_"), span("c_"),
        (F.col("c_cue_id") != F.col("s_cue_id")) & (F.col("c_cue_id") != F.col("e_cue_id"))
        & (F.col("s_confidence") - F.col("c_confidence") >= 0.06)
        & G.substantial_overlap(*span("s_"), *span("c_"))
        & G.substantial_overlap(*span("e_"), *span("c_"))
        & (G.overlap_over_smaller(F.col("e_box"), F.col("c_box")) >= 0.08)
        & G.boxes_stacked(F.col("s_box"), F.col("c_box")),
    )
    return (
        wins.select("video_id", F.col("e_cue_id").alias("cue_id"))
        .union(hangers.select("video_id", F.col("c_cue_id").alias("cue_id"))).distinct()
    )


def suppress_competitors(events: DataFrame) -> DataFrame:
    return events.join(competitor_losers(events), ["video_id", "cue_id"], "left_anti")


def adopt_track(cues: DataFrame, track: str) -> DataFrame:
    """Final cues from a source track: usable rows only, clean columns, stable new ids."""
    usable = (
        (F.trim("text") != "") & is_finite(F.col("start_time")) & is_finite(F.col("end_time"))
        & (F.col("start_time") >= 0) & (F.col("end_time") > F.col("start_time"))
    )
    new_id = F.md5(F.concat_ws("|", F.lit(track), F.col("video_id").cast("string"), F.col("cue_id").cast("string")))
    box = F.col("box") if track == "visual" else F.lit(None)
    return cues.where(usable).select(
        "video_id", new_id.alias("cue_id"), F.trim("text").alias("text"), "start_time", "end_time",
        "confidence", box.alias("box"), F.lit(track).alias("source"),
    )


def to_api(cues: DataFrame) -> DataFrame:
    """API form: trimmed text and list position instead of client ids."""
    return number_cues(cues).select(
        "video_id", "number", T.clean_text(F.col("text")).alias("text"),
        "start_time", "end_time", "confidence",
    )


def lint_cues(cues: DataFrame) -> DataFrame:
    """First failing row of every video and its rule, in stored order (cue_id)."""
    finite = is_finite(F.col("start_time")) & is_finite(F.col("end_time"))
    rule = (
        F.when(F.trim("text") == "", "blank_text").when(~finite, "bad_time")
        .when((F.col("start_time") < 0) | (F.col("end_time") <= F.col("start_time")), "bad_range")
    )
    return (
        cues.select("video_id", "cue_id", rule.alias("rule")).where("rule is not null")
        .groupBy("video_id")
        .agg(F.min("cue_id").alias("cue_id"), F.min_by("rule", "cue_id").alias("rule"),
             F.count(F.lit(1)).alias("violations"))
    )


def editor_form(cues: DataFrame) -> DataFrame:
    """Clamp times as the editor does: start >= 0, end >= start, default length 2 s."""
    number = lambda c: F.when(is_finite(F.col(c)), F.col(c))
    start = F.greatest(F.lit(0.0), F.coalesce(number("start_time"), F.lit(0.0)))
    end = F.greatest(start, F.coalesce(number("end_time"), start + F.lit(2.0)))
    return cues.withColumns({
        "text": F.coalesce("text", F.lit("")), "start_time": start, "end_time": end,
    })


FRAME_FIELDS = ("start_frame", "end_frame_excl", "start_pts", "end_pts", "time_base")


def apply_cue_patches(cues: DataFrame, patches: DataFrame) -> DataFrame:
    """Overlay (video_id, cue_id, text?, start_time?, end_time?); new times void frame data."""
    p = patches.select(
        "video_id", "cue_id", *[F.col(c).alias(f"_p_{c}") for c in ("text", "start_time", "end_time")]
    )
    moved = lambda c: F.col(f"_p_{c}").isNotNull() & ~F.col(f"_p_{c}").eqNullSafe(F.col(c))
    joined = cues.join(p, ["video_id", "cue_id"], "left").withColumn(
        "_moved", moved("start_time") | moved("end_time")
    )
    updates = {c: F.coalesce(F.col(f"_p_{c}"), F.col(c)) for c in ("text", "start_time", "end_time")}
    updates |= {c: F.when(~F.col("_moved"), F.col(c)) for c in FRAME_FIELDS if c in cues.columns}
    return joined.withColumns(updates).select(*cues.columns)


def coverage_gaps(events: DataFrame, videos: DataFrame, chunk_frames: int = 20000) -> DataFrame:
    """Uncovered inclusive frame ranges, including head and tail.

    ``events``: (video_id, event_key, start_frame, end_frame inclusive);
    ``videos``: (video_id, frame_count).
    """
    chunk = F.floor(F.col("start_frame") / F.lit(chunk_frames))
    seen = ordered(
        events, ["video_id"], ["start_frame", "end_frame", "event_key"], chunk,
        max_before={"_reach": "end_frame"},
    )
    inner = seen.select(
        "video_id", (F.coalesce(F.col("_reach"), F.lit(-1)) + 1).alias("gap_start"),
        (F.col("start_frame") - 1).alias("gap_end"),
    )
    last = events.groupBy("video_id").agg(F.max("end_frame").alias("_last"))
    tail = videos.join(last, "video_id", "left").select(
        "video_id", (F.coalesce(F.col("_last"), F.lit(-1)) + 1).alias("gap_start"),
        (F.col("frame_count") - 1).alias("gap_end"),
    )
    return inner.union(tail).where(F.col("gap_start") <= F.col("gap_end"))
