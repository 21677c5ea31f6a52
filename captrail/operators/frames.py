"""Frame timing: order, durations, sampling, lookup and snapping to frame boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrail.functions import timecode as TC
from captrail.functions.numeric import half_even
from captrail.operators.intervals import points_in_spans
from captrail.operators.ordered import ordered, quantiles, time_chunk


def _pts_chunk(seconds: float) -> Column:
    return F.floor(
        F.col("pts") * F.col("time_base_num") / F.col("time_base_den") / F.lit(float(seconds))
    )


def frame_durations(frames: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Number the frames and fill their durations.

    A frame lasts until the next one; the last lasts as declared, or as long as
    the median step.
    """
    steps = ordered(
        frames, ["video_id"], ["pts"], _pts_chunk(chunk_seconds), lead={"_next": "pts"}, number="_n"
    ).withColumn("_step", F.col("_next") - F.col("pts"))
    middle = quantiles(steps, ["video_id"], F.when(F.col("_step") > 0, F.col("_step")), {"_middle": 0.5}, 1000.0)
    typical = steps.groupBy("video_id").agg(F.min("pts").alias("start_pts")).join(middle, "video_id", "left").select(
        "video_id", "start_pts", F.greatest(F.lit(1), half_even(F.col("_middle")).cast("long")).alias("_typical"))
    declared = F.when(F.col("duration_pts") > 0, F.col("duration_pts"))
    lasts = F.coalesce(F.col("_step"), declared, F.col("_typical"))
    return steps.join(typical, "video_id").select(
        "video_id", (F.col("_n") - 1).alias("frame_index"), "pts",
        F.when(lasts > 0, lasts).otherwise(F.col("_typical")).cast("long").alias("duration_pts"),
        "start_pts", "time_base_num", "time_base_den",
        TC.pts_seconds(F.col("pts"), F.col("start_pts"), F.col("time_base_num"), F.col("time_base_den")).alias("ts"),
        F.col("_next").isNull().alias("last"),
    )


def video_metadata(timed: DataFrame) -> DataFrame:
    """Duration, rate and variable-rate flag per video from ``frame_durations`` output."""
    step = F.when(~F.col("last") & (F.col("duration_pts") > 0), F.col("duration_pts"))
    base = timed.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frame_count"), F.min("start_pts").alias("start_pts"),
        F.max(F.col("pts") + F.col("duration_pts")).alias("end_pts"),
        F.min(step).alias("_lo"), F.max(step).alias("_hi"),
        F.first("time_base_num").alias("num"), F.first("time_base_den").alias("den"),
    ).join(quantiles(timed, ["video_id"], step, {"median_step": 0.5}, 1000.0), "video_id", "left")
    limit = F.greatest(F.lit(1.0), F.col("median_step") * F.lit(0.001))
    uneven = (F.col("_hi") - F.col("median_step") > limit) | (F.col("median_step") - F.col("_lo") > limit)
    duration = TC.pts_seconds(F.col("end_pts"), F.col("start_pts"), F.col("num"), F.col("den"))
    return base.select(
        "video_id", "frame_count", "start_pts", "end_pts", "median_step",
        F.coalesce(uneven, F.lit(False)).alias("variable_frame_rate"), duration.alias("duration"),
        F.try_divide(F.col("frame_count").cast("double"), duration).alias("fps"),
        TC.pts_seconds(F.col("start_pts"), F.lit(0), F.col("num"), F.col("den")).alias("start_time"),
    )


def sample_frames(timed: DataFrame, fps: float) -> DataFrame:
    """First frame of every 1/fps bucket; one aggregation, no ordering of a video."""
    bucket = F.floor((F.col("ts") + F.lit(1e-9)) * F.lit(float(fps)))
    first = timed.groupBy("video_id", bucket.alias("bucket")).agg(
        F.min_by(F.struct("frame_index", "pts", "ts"), F.struct("ts", "frame_index")).alias("f")
    )
    return first.select("video_id", "bucket", "f.*")


def representative_frames(timed: DataFrame, videos: DataFrame, k: int = 16, chunk_seconds: float = 600.0) -> DataFrame:
    """First frame reaching each of ``k`` evenly spaced instants, once per frame.

    ``videos``: (video_id, duration, fps).
    """
    half = F.lit(0.5) / F.col("fps")
    grid = videos.select(
        "video_id", half.alias("_half"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_index"), "duration"
    ).select(
        "video_id", "sample_index",
        (F.least(F.greatest(F.lit(0.0), F.col("duration") - F.col("_half")),
                 F.col("sample_index") * F.col("duration") / F.lit(max(1, k - 1))) - F.col("_half")).alias("t"),
    )
    last = timed.groupBy("video_id").agg(F.max_by(F.struct("frame_index", "pts", "ts"), "pts").alias("_last"))
    hits = nearest_frames(grid, timed, chunk_seconds).join(last, "video_id", "left")
    chosen = F.when(F.col("prev.ts") >= F.col("t"), F.col("prev")).otherwise(F.coalesce(F.col("next"), F.col("_last")))
    return (
        hits.select("video_id", "sample_index", chosen.alias("f")).where("f is not null")
        .groupBy("video_id", "f.frame_index", "f.pts", "f.ts").agg(F.min("sample_index").alias("sample_index"))
    )


def nearest_frames(points: DataFrame, timed: DataFrame, chunk_seconds: float = 600.0, more: tuple[str, ...] = ()) -> DataFrame:
    """For (video_id, t, ...): struct ``prev`` of the last boundary <= t, ``next`` of the first > t.

    The structs hold frame_index, pts, ts and the columns named in ``more``.
    """
    held = F.struct(F.col("frame_index").cast("bigint").alias("frame_index"), F.col("pts").cast("bigint").alias("pts"), "ts", *more)
    shape = timed.select(held.alias("f")).schema["f"].dataType
    facts = timed.select(
        "video_id", F.col("ts").alias("_t"), F.lit(0).alias("_side"), F.col("frame_index").alias("_i"),
        held.alias("_f"),
    )
    row = F.struct(*[F.col(c) for c in points.columns])
    asked = points.select(
        "video_id", F.col("t").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_i"),
        F.lit(None).cast(shape).alias("_f"), row.alias("_p"),
    )
    rows = asked.unionByName(facts, allowMissingColumns=True)
    out = ordered(
        rows, ["video_id"], ["_t", "_side", "_i"], time_chunk("_t", chunk_seconds),
        last_seen={"prev": "_f"}, next_seen={"next": "_f"},
    )
    return out.where("_p is not null").select("_p.*", "prev", "next")


def frame_boundaries(timed: DataFrame) -> DataFrame:
    """Frame starts plus one closing boundary per video."""
    end_pts = F.col("pts") + F.col("duration_pts")
    closing = timed.where("last").select(
        "video_id", (F.col("frame_index") + 1).alias("frame_index"), end_pts.alias("pts"),
        TC.pts_seconds(end_pts, F.col("start_pts"), F.col("time_base_num"), F.col("time_base_den")).alias("ts"),
    )
    return timed.select("video_id", "frame_index", "pts", "ts").union(closing)


def snap_to_frames(cues: DataFrame, timed: DataFrame, chunk_seconds: float = 600.0) -> DataFrame:
    """Move cue times onto frame boundaries; seconds are derived from PTS again.

    The nearest boundary wins, the earlier one on a tie. A cue keeps at least one
    frame and never starts at the closing boundary.
    """
    spot = F.struct("frame_index", "pts", "ts")
    bounds = ordered(
        frame_boundaries(timed), ["video_id"], ["frame_index"], F.floor(F.col("frame_index") / F.lit(20_000)),
        lag={"before": spot}, lead={"after": spot},
    )
    ends = F.array(
        F.struct(F.lit("s").alias("side"), F.col("start_time").alias("t")),
        F.struct(F.lit("e").alias("side"), F.col("end_time").alias("t")),
    )
    points = cues.select("video_id", "cue_id", F.inline(ends))
    near = nearest_frames(points, bounds, chunk_seconds, ("before", "after"))
    nearer = F.col("t") - F.col("prev.ts") <= F.col("next.ts") - F.col("t")
    take_prev = F.col("next").isNull() | (F.col("prev").isNotNull() & nearer)
    chosen = F.when(take_prev, F.col("prev")).otherwise(F.col("next"))
    side = lambda name: F.first(F.when(F.col("side") == name, chosen), ignorenulls=True)
    pair = near.groupBy("video_id", "cue_id").agg(side("s").alias("_s"), side("e").alias("_e"))
    plain = lambda c: F.struct(F.col(f"{c}.frame_index"), F.col(f"{c}.pts"), F.col(f"{c}.ts"))
    closing = F.col("_s.after").isNull()
    framed = pair.withColumns({
        "_start": F.when(closing, F.col("_s.before")).otherwise(plain("_s")),
        "_least": F.when(closing, plain("_s")).otherwise(F.col("_s.after")),
    }).withColumn("_end", F.when(F.col("_e.frame_index") > F.col("_start.frame_index"), plain("_e")).otherwise(F.col("_least")))
    timed_pair = framed.where("_start is not null").select(
        "video_id", "cue_id", F.col("_start.frame_index").alias("start_frame"), F.col("_end.frame_index").alias("end_frame_excl"),
        F.col("_start.pts").alias("start_pts"), F.col("_end.pts").alias("end_pts"),
        F.col("_start.ts").alias("start_time"), F.col("_end.ts").alias("end_time"),
    )
    return cues.drop("start_time", "end_time", "start_frame", "end_frame_excl", "start_pts", "end_pts").join(
        timed_pair, ["video_id", "cue_id"]
    )


def frames_in_windows(timed: DataFrame, windows: DataFrame, width: float = 8.0) -> DataFrame:
    """Frames whose start lies in the closed window (video_id, window_id, w_start, w_end)."""
    slack = F.lit(1e-9)
    return points_in_spans(
        windows, timed.select("video_id", "frame_index", "pts", "ts"), ["video_id"],
        (F.col("w_start") - slack, F.col("w_end") + slack), F.col("ts"), width,
    )
