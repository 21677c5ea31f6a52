"""Visual change: scores, robust change points, short stable intervals, probe choice."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrail.config import CaptionConfig
from captrail.functions.numeric import half_even
from captrail.operators.folds import Fold, cut, fold_groups
from captrail.operators.intervals import points_in_spans
from captrail.operators.ordered import ordered, quantiles, top_k_per

CHUNK_FRAMES = 20000


def _chunk() -> Column:
    return F.floor(F.col("frame_index") / F.lit(CHUNK_FRAMES))


def change_scores(signatures: DataFrame) -> DataFrame:
    """Mean absolute difference of each signature to the previous one of its variant.

    ``signatures``: (video_id, variant, frame_index, signature array<double>).
    """
    seen = ordered(
        signatures, ["video_id", "variant"], ["frame_index"], _chunk(), lag={"_before": "signature"}
    ).where("_before is not null")
    diff = F.zip_with("signature", "_before", lambda a, b: F.abs(a - b))
    total = F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v)
    return seen.select("video_id", "variant", "frame_index", (total / F.size("signature")).alias("score"))


def blend_scores(local: Column, whole: Column) -> Column:
    return local * F.lit(0.88) + whole * F.lit(0.12)


def change_thresholds(scores: DataFrame, floor: float) -> DataFrame:
    """Robust threshold per (video, variant): median plus five median deviations."""
    keys = ["video_id", "variant"]
    middle = quantiles(scores, keys, F.col("score"), {"baseline": 0.5}, 1.0)
    centred = scores.join(middle, keys)
    spread = quantiles(centred, keys, F.abs(F.col("score") - F.col("baseline")), {"deviation": 0.5}, 1.0)
    known = middle.join(spread, keys).join(scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)
    reach = F.col("baseline") + F.greatest(F.lit(1.0), F.col("deviation") * F.lit(5.0))
    return known.where("n >= 2").select(*keys, F.greatest(F.lit(float(floor)), reach).alias("threshold"))


def stable_intervals(
    scores: DataFrame, observed: DataFrame, videos: DataFrame, cfg: CaptionConfig = CaptionConfig()
) -> DataFrame:
    """Short stretches between two change points that no observed frame covers.

    ``scores``: (video_id, variant, frame_index, score); ``observed``: (video_id,
    frame_index); ``videos``: (video_id, fps).
    """
    keys = ["video_id", "variant"]
    raw = (
        scores.join(change_thresholds(scores, cfg.discovery_change_threshold), keys)
        .where("score >= threshold").join(videos.select("video_id", "fps"), "video_id")
    )
    gap = F.greatest(F.lit(1), half_even(F.col("fps") * F.lit(0.05)).cast("long"))
    lagged = ordered(raw, keys, ["frame_index"], _chunk(), lag={"_p": "frame_index"})
    opens = F.col("_p").isNull() | (F.col("frame_index") - F.col("_p") > gap)
    marked = ordered(
        lagged.withColumn("_open", F.when(opens, F.col("frame_index"))), keys, ["frame_index"], _chunk(),
        last_seen={"_cluster": "_open"},
    )
    # Clusters may chain over many frames, but each is reduced by a partial aggregate.
    peaks = marked.groupBy(*keys, "_cluster").agg(
        F.max_by(F.struct("frame_index", "score"), F.struct("score", -F.col("frame_index"))).alias("p"),
        F.first("threshold").alias("threshold"), F.first("fps").alias("fps"),
    ).select(*keys, "p.frame_index", "p.score", "threshold", "fps")
    peaks = cut(peaks)
    pairs = ordered(
        peaks, keys, ["frame_index"], _chunk(), lead={"_n": F.struct("frame_index", "score")}
    ).where("_n is not null")
    low = F.greatest(F.lit(1), F.ceil(F.lit(cfg.min_event_duration) * F.col("fps")))
    high = F.greatest(low, F.ceil(F.col("fps") / F.lit(max(0.25, cfg.sample_fps)) * F.lit(1.15)))
    length = F.col("_n.frame_index") - F.col("frame_index")
    spans = pairs.where((length >= low) & (length <= high)).select(
        *keys, F.col("frame_index").alias("start_frame"), (F.col("_n.frame_index") - 1).alias("end_frame"),
        F.least(F.col("score"), F.col("_n.score")).alias("priority"), "threshold",
    )
    spans = cut(spans)
    covered = points_in_spans(
        spans, observed.select("video_id", F.col("frame_index").alias("_seen")), ["video_id"],
        (F.col("start_frame"), F.col("end_frame")), F.col("_seen"), width=256.0,
    ).select(*keys, "start_frame").distinct()
    free = spans.join(covered, [*keys, "start_frame"], "left_anti")
    return free.select(
        *keys, "start_frame", "end_frame",
        F.floor((F.col("start_frame") + F.col("end_frame")) / 2).alias("frame_index"), "priority",
        (F.col("priority") / F.greatest(F.lit(1.0), F.col("threshold"))).alias("strength"),
    )


def merge_variants(intervals: DataFrame) -> DataFrame:
    """One row per representative frame with its best strength and its support."""
    return intervals.groupBy("video_id", "frame_index").agg(
        F.max("strength").alias("strength"), F.max("priority").alias("priority"),
        F.count(F.lit(1)).alias("support"),
    )


class ProbeChoice(Fold):
    """Take frames in order of strength, none too close to one already taken."""

    def __init__(self):
        self.taken: list[int] = []

    def push(self, row):
        frame = row["frame_index"]
        at = bisect.bisect_left(self.taken, frame)
        if any(abs(frame - t) <= row["_reach"] for t in self.taken[max(0, at - 1):at + 1]):
            return ()
        self.taken.insert(at, frame)
        return [row]


def select_probes(
    merged: DataFrame, observed: DataFrame, videos: DataFrame, budget: int
) -> DataFrame:
    """Frames to look at next, at most ``budget`` per video.

    A frame keeps away others within its reach, so frames decide among each other only in islands without a wider gap.
    Islands are solved apart; the budget then goes to the best of what they took.
    """
    rank = ["_o1", "_o2", "_o3", "_o4"]
    reach = F.greatest(F.lit(1), half_even(F.col("fps") * F.lit(0.02)).cast("long"))
    rows = (
        minus_observed(merged, observed, "video_id", "frame_index").join(videos.select("video_id", "fps"), "video_id")
        .select(
            "video_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("strength").cast("double").alias("strength"), reach.alias("_reach"),
            (-F.col("strength")).alias("_o1"), (-F.col("support")).alias("_o2"),
            (-F.col("priority")).alias("_o3"), (-F.col("frame_index")).alias("_o4"),
        )
    )
    lagged = ordered(rows, ["video_id"], ["frame_index"], _chunk(), lag={"_p": "frame_index"})
    opens = F.col("_p").isNull() | (F.col("frame_index") - F.col("_p") > F.col("_reach"))
    marked = ordered(
        lagged.withColumn("_open", F.when(opens, F.col("frame_index"))), ["video_id"], ["frame_index"], _chunk(),
        last_seen={"_island": "_open"},
    ).drop("_p", "_open")
    taken = fold_groups(marked, ["video_id", "_island"], rank, ProbeChoice, marked.schema)
    best = top_k_per(taken, ["video_id"], [F.col(c) for c in rank], budget, ["frame_index"], salts=16)
    return best.select("video_id", "frame_index", "strength")


def minus_observed(wanted: DataFrame, observed: DataFrame, *keys: str) -> DataFrame:
    """Wanted rows whose keys were not observed yet."""
    return wanted.join(observed.select(*keys), list(keys), "left_anti")
