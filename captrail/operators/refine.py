"""Boundary refinement of events against observed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrail.config import CaptionConfig
from captrail.functions import geometry as G
from captrail.functions import text as TX
from captrail.functions.numeric import clamp, half_even
from captrail.functions.similarity import caption_similarity
from captrail.operators.folds import cut, spread
from captrail.operators.intervals import points_in_spans


def _alike_pairs(
    events: DataFrame, obs: DataFrame, span: tuple[Column, Column], threshold: float, width: float, out: list[Column],
) -> DataFrame:
    """Columns ``out`` of each (event, detection) inside ``span`` at one place whose texts are alike.

    Pairs carry the texts as 64-bit hashes and are stored before the texts are compared, so that both sides are dealt
    once; rows without any value in ``out`` after the keys are dropped.
    """
    e = cut(events.select("*", TX.norm_caption(F.col("text")).alias("_en")).drop("text"))
    o = cut(obs.select(
        "video_id", "frame_index", "ts", TX.norm_caption(F.col("text")).alias("_on"),
        F.struct("x1", "y1", "x2", "y2").alias("_ob"),
    ))
    named = e.withColumn("_ei", F.xxhash64("_en")).drop("_en"), o.withColumn("_oi", F.xxhash64("_on")).drop("_on")
    near = points_in_spans(*named, ["video_id"], span, F.col("ts"), width).where(
        F.col("box").isNull() | (G.spatial_compatibility(F.col("box"), F.col("_ob")) > 0)
    )
    pairs = near.select(*out, "_ei", "_oi")
    pairs = cut(pairs.where(" or ".join(f"`{c}` is not null" for c in pairs.columns[2:-2])))
    inside = TX.token_subset(F.col("_on"), F.col("_en")) & (F.length("_on") >= 4)
    score = caption_similarity(F.col("_en"), F.col("_on"), threshold)
    # A few texts meet in many frames: one comparison per distinct pair of texts.
    name = lambda df, i, text: df.groupBy(F.xxhash64(text).alias(i)).agg(F.first(text).alias(text))
    texts = pairs.select("_ei", "_oi").distinct().join(name(e, "_ei", "_en"), "_ei").join(name(o, "_oi", "_on"), "_oi")
    alike = cut(spread(texts, "_ei", "_oi").withColumn("_hit", inside | (score >= threshold)).where("_hit").select("_ei", "_oi"))
    return pairs.join(alike, ["_ei", "_oi"], "left_semi").drop("_ei", "_oi")


def event_frame_hits(
    events: DataFrame, obs: DataFrame, span: tuple[Column, Column], threshold: float,
    keep: tuple[str, ...] = (), width: float = 2.0,
) -> DataFrame:
    """Frames inside ``span`` of an event that show its text at its place.

    ``obs`` has one row per detection. Returns (video_id, cue_id, frame_index,
    ts) once per hit, plus the event columns in ``keep``.
    """
    e = events.select("video_id", "cue_id", *keep, span[0].alias("_from"), span[1].alias("_to"), "text", "box")
    columns = [F.col(c) for c in ("video_id", "cue_id", *keep, "frame_index", "ts")]
    return _alike_pairs(e, obs, (F.col("_from"), F.col("_to")), threshold, width, columns).distinct()


def refine_boundaries(
    events: DataFrame, obs: DataFrame, videos: DataFrame, cfg: CaptionConfig = CaptionConfig()
) -> DataFrame:
    """Tighten events to the observed frames around their coarse bounds.

    ``videos``: (video_id, duration, fps). An event whose two windows lie close
    together looks for frames once.
    """
    step, width = F.lit(cfg.interval), 2.0
    threshold = max(0.42, cfg.text_similarity_threshold - 0.15)
    timed = events.join(videos.select("video_id", "duration", "fps"), "video_id")
    s, e, dur = F.col("start_time"), F.col("end_time"), F.col("duration")
    at_start = F.greatest(F.lit(0.0), s - step), F.least(dur, s)
    at_end = F.greatest(s, e - step), F.least(dur, e)
    window = lambda a, b: F.struct(a.alias("_a"), b.alias("_b"))
    first, last = F.least(at_start[0], at_end[0]), F.greatest(at_start[1], at_end[1])
    windows = F.when(last - first <= width, F.array(window(first, last))).otherwise(F.array(window(*at_start), window(*at_end)))
    both = timed.select("video_id", "cue_id", "text", "box", "fps", "start_time", "end_time", "duration", F.inline(windows))
    keys = ["video_id", "cue_id"]
    found = [
        F.when(F.col("ts").between(*at_start), F.col("ts")).alias("_start"),
        F.when(F.col("ts").between(*at_end), (F.col("frame_index") + 1) / F.col("fps")).alias("_end"),
    ]
    hits = _alike_pairs(both, obs, (F.col("_a"), F.col("_b")), threshold, width, [*map(F.col, keys), *found])
    seen = hits.groupBy(*keys).agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"))
    least = F.lit(cfg.min_event_duration)
    start = clamp(F.coalesce("_start", s), 0.0, dur)
    end = F.greatest(F.col("_s") + least, F.least(F.coalesce("_end", e), dur))
    joined = timed.join(seen, keys, "left").withColumn("_s", start).withColumn("_e", end)
    over = F.col("_e") > dur
    new_end = F.when(over, dur).otherwise(F.col("_e"))
    new_start = F.when(over, F.greatest(F.lit(0.0), F.least(F.col("_s"), dur - least))).otherwise(F.col("_s"))
    return joined.withColumns({
        "start_time": half_even(new_start, 3), "end_time": half_even(new_end, 3),
    }).select(*events.columns)


def locate_transitions(states: DataFrame, scores: DataFrame) -> DataFrame:
    """Frame where an event starts, between its last negative and first positive sample.

    ``states``: (video_id, cue_id, frame_index, hit) observed around one bound, the
    frames of a search window; ``scores``: (video_id, frame_index, score). The
    strongest change strictly after the last negative and up to the first positive
    frame wins (first on a tie); it counts only when the states on both sides
    confirm it, else the first positive frame stands.
    """
    keys = ["video_id", "cue_id"]
    first = states.groupBy(*keys).agg(F.min(F.when(F.col("hit"), F.col("frame_index"))).alias("positive"))
    anchored = states.join(first.where("positive is not null"), keys)
    bounds = anchored.groupBy(*keys, "positive").agg(
        F.max(F.when(~F.col("hit") & (F.col("frame_index") < F.col("positive")), F.col("frame_index"))).alias("negative")
    )
    bracket = bounds.where("negative is not null")
    inside = points_in_spans(
        bracket, scores, ["video_id"], (F.col("negative") + 1, F.col("positive")), F.col("frame_index"), 256.0
    )
    best = inside.groupBy(*keys).agg(
        F.max_by("frame_index", F.struct("score", -F.col("frame_index"))).alias("candidate")
    )
    at = states.select(*keys, F.col("frame_index").alias("_f"), "hit")
    after = at.select(*keys, F.col("_f").alias("candidate"), F.col("hit").alias("hit_at"))
    before = at.select(*keys, (F.col("_f") + 1).alias("candidate"), F.col("hit").alias("hit_before"))
    joined = bounds.join(best, keys, "left").join(after, [*keys, "candidate"], "left").join(
        before, [*keys, "candidate"], "left"
    )
    confirmed = F.coalesce(F.col("hit_at"), F.lit(False)) & ~F.coalesce(F.col("hit_before"), F.lit(True))
    return joined.select(
        *keys, "negative", "positive", "candidate", confirmed.alias("confirmed"),
        F.when(confirmed, F.col("candidate")).otherwise(F.col("positive")).alias("transition"),
    )
