"""Validation and normalisation of loosely typed cue records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captrail.functions import text as TX
from captrail.functions.numeric import clamp, is_finite
from captrail.operators.ordered import ordered

# Field aliases, in order of preference.
START_KEYS = ("start_time", "startTime", "start")
END_KEYS = ("end_time", "endTime", "end")
SOURCE_START_KEYS = ("start", "start_time", "startTime")
SOURCE_END_KEYS = ("end", "end_time", "endTime")
MAX_SAFE_INTEGER = 9007199254740991


def first_present(item: Column, keys, kind: str = "string") -> Column:
    """First non-null value among alias keys of a variant."""
    return F.coalesce(*[F.try_variant_get(item, f"$.{k}", kind) for k in keys])


def gate(df: DataFrame, keep: Column) -> DataFrame:
    """Filter that stays above the parsing.

    A plain filter would be pushed below it by repeating the parse expressions
    inside the condition, which outgrows generated code.
    """
    return df.select(F.explode(F.when(keep, F.array(F.struct("*")))).alias("r")).select("r.*")


def number(text: Column) -> Column:
    """Finite number from text, else null."""
    value = F.trim(text).try_cast("double")
    return F.when(is_finite(value), value)


def _safe_integer(text: Column, minimum: int = -MAX_SAFE_INTEGER) -> Column:
    """Whole number within the exact range of doubles and at least ``minimum``, else null."""
    value = F.trim(text).try_cast("double")
    return F.when((value == F.floor(value)) & value.between(float(minimum), float(MAX_SAFE_INTEGER)), value.cast("long"))


def judge_cues(items: DataFrame) -> DataFrame:
    """Normalise (owner, n, item variant) cue records; ``problem`` names the first fault.

    Fields are read once, then parsed, then judged, so that generated code stays small.
    """
    item = F.col("item")
    texts = {k: first_present(item, (k,)) for k in (
        "id", "text", "confidence", "source", "start_frame", "end_frame_exclusive", "start_pts", "end_pts", "time_base")}
    raw = items.select(
        "owner", "n", *[c.alias(f"_{k}") for k, c in texts.items()],
        first_present(item, START_KEYS).alias("_start"), first_present(item, END_KEYS).alias("_end"),
        F.try_variant_get(item, "$.position", "variant").isNotNull().alias("_boxed"),
        F.transform(F.try_variant_get(item, "$.position", "array<string>"), number).alias("_box"),
    )
    parsed = raw.withColumns({
        "start_time": number(F.col("_start")), "end_time": number(F.col("_end")), "_conf": number(F.col("_confidence")),
        "_good_box": F.coalesce((F.size("_box") == 4) & ~F.exists("_box", lambda v: v.isNull()), F.lit(False)),
        "start_frame": _safe_integer(F.col("_start_frame"), 0), "end_frame_excl": _safe_integer(F.col("_end_frame_exclusive"), 1),
        "start_pts": _safe_integer(F.col("_start_pts")), "end_pts": _safe_integer(F.col("_end_pts")),
    })
    s, e = F.col("start_time"), F.col("end_time")
    bad_int = F.lit(False)
    for value, given in (("start_frame", "_start_frame"), ("end_frame_excl", "_end_frame_exclusive"),
                         ("start_pts", "_start_pts"), ("end_pts", "_end_pts")):
        bad_int = bad_int | (F.col(given).isNotNull() & F.col(value).isNull())
    conf = F.col("_conf")
    fault = (
        F.when(s.isNull() | (s < 0) | e.isNull() | (e <= s), "time")
        .when(F.col("_confidence").isNotNull() & ~F.coalesce(conf.between(0.0, 1.0), F.lit(False)), "confidence")
        .when(F.col("_boxed") & ~F.col("_good_box"), "position").when(bad_int, "integer")
        .when(F.col("end_frame_excl") <= F.col("start_frame"), "frame_order")
    )
    at = lambda i: F.get("_box", F.lit(i))
    box = F.struct(at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2"))
    return parsed.select(
        "owner", "n", F.coalesce("_id", F.concat(F.lit("subtitle-"), F.col("n").cast("string"))).alias("id"),
        TX.clean_text(F.coalesce("_text", F.lit(""))).alias("text"), "start_time", "end_time",
        F.when(F.col("_confidence").isNotNull(), clamp(F.coalesce(conf, F.lit(0.0)), 0.0, 1.0)).alias("confidence"),
        F.when(F.col("_good_box"), box).alias("box"), F.col("_source").alias("source"),
        "start_frame", "end_frame_excl", "start_pts", "end_pts", F.col("_time_base").alias("time_base"),
        fault.alias("problem"),
    )


def normalize_cues(items: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects). Strict rejects every faulty record, lenient only bad times."""
    judged = judge_cues(items)
    fatal = F.col("problem").isNotNull() if strict else F.coalesce(F.col("problem") == "time", F.lit(False))
    return gate(judged, ~fatal).drop("problem"), gate(judged, fatal).select("owner", "n", "problem")


def normalize_visual(items: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Visual source cues from (owner, n, item variant). Polygons stay nested, bad boxes become empty."""
    item = F.col("item")
    place = F.coalesce(F.try_variant_get(item, "$.bbox", "variant"), F.try_variant_get(item, "$.position", "variant"))
    raw = items.select(
        F.trim(F.coalesce(F.col("owner").cast("string"), first_present(item, ("taskId", "task_id")), F.lit(""))).alias("owner"), "n",
        first_present(item, SOURCE_START_KEYS).alias("_start"), first_present(item, SOURCE_END_KEYS).alias("_end"),
        F.nullif(first_present(item, ("confidence",)), F.lit("")).alias("_confidence"),
        F.coalesce(first_present(item, ("text",)), F.lit("")).alias("_text"), place.alias("_place"),
    )
    parsed = raw.withColumns({
        "start_time": number(F.col("_start")), "end_time": number(F.col("_end")), "_conf": number(F.col("_confidence")),
        "_nested": F.try_variant_get("_place", "$", "array<array<double>>"),
        "_flat": F.transform(F.try_variant_get("_place", "$", "array<string>"), number),
    }).withColumns({
        "_flat_ok": F.coalesce(~F.exists("_flat", lambda v: v.isNull()), F.lit(False)),
        "_nested": F.when(~F.exists("_nested", lambda p: p.isNull() | F.exists(p, lambda v: v.isNull())), F.col("_nested")),
    })
    empty = F.array().cast("array<array<double>>")
    bbox = F.coalesce("_nested", F.when(F.col("_flat_ok"), F.transform("_flat", lambda v: F.array(v))), empty)
    conf, s, e, owner = F.col("_conf"), F.col("start_time"), F.col("end_time"), F.col("owner")
    problem = (
        F.when(owner == "", "owner")
        .when(s.isNull() | (s < 0) | e.isNull() | (e <= s), "time")
        .when(F.lit(strict) & F.col("_place").isNotNull() & F.col("_nested").isNull() & ~F.col("_flat_ok"), "bbox")
        .when(F.lit(strict) & F.col("_confidence").isNotNull() & ~F.coalesce(conf.between(0.0, 1.0), F.lit(False)), "confidence")
    )
    out = parsed.select(
        "owner", "n", TX.clean_text(F.col("_text")).alias("text"), "start_time", "end_time", bbox.alias("bbox"),
        F.when(conf.isNotNull(), clamp(conf, 0.0, 1.0)).alias("confidence"), problem.alias("problem"),
    )
    return gate(out, F.col("problem").isNull()).drop("problem"), gate(out, F.col("problem").isNotNull()).select("owner", "n", "problem")


def normalize_audio(items: DataFrame) -> DataFrame:
    """Audio source cues: sentence times as given, else from fully timed words.

    Words keep missing times; an inverted pair loses both.
    """
    item = F.col("item")
    raw = F.coalesce(F.try_variant_get(item, "$.words", "array<variant>"), F.array().cast("array<variant>"))

    def read(v):
        return F.struct(
            TX.clean_text(first_present(v, ("word", "text"))).alias("word"), number(first_present(v, SOURCE_START_KEYS)).alias("start"),
            number(first_present(v, SOURCE_END_KEYS)).alias("end"), number(first_present(v, ("confidence", "score"))).alias("confidence"),
        )

    def judge(w):
        start, end = F.when(w["start"] >= 0, w["start"]), F.when(w["end"] >= 0, w["end"])
        good = ~F.coalesce((w["start"] >= 0) & (w["end"] <= w["start"]), F.lit(False)) | (w["end"] < 0)
        return F.struct(
            w["word"].alias("word"), F.when(good, start).alias("start"), F.when(good, end).alias("end"),
            F.when(w["confidence"].isNotNull(), clamp(w["confidence"], 0.0, 1.0)).alias("confidence"),
        )

    items = items.withColumn("_w", F.transform(raw, read))
    words = F.filter(F.transform("_w", judge), lambda w: F.coalesce(w["word"], F.lit("")) != "")
    start, end = number(first_present(item, SOURCE_START_KEYS)), number(first_present(item, SOURCE_END_KEYS))
    given = F.coalesce((start >= 0) & (end > start), F.lit(False))
    conf = number(first_present(item, ("confidence",)))
    timed = F.filter("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    staged = items.select(
        "owner", "n", TX.clean_text(F.coalesce(first_present(item, ("text",)), F.lit(""))).alias("text"),
        words.alias("words"), given.alias("_given"), start.alias("_s"), end.alias("_e"),
        F.when(conf.isNotNull(), clamp(conf, 0.0, 1.0)).alias("confidence"),
    )
    return staged.select(
        "owner", "n", "text",
        F.when(F.col("_given"), F.col("_s")).otherwise(F.array_min(F.transform(timed, lambda w: w["start"]))).alias("start_time"),
        F.when(F.col("_given"), F.col("_e")).otherwise(F.array_max(F.transform(timed, lambda w: w["end"]))).alias("end_time"),
        "words", "confidence",
    )


# Accepted tiers of a truth file.
TIERS = ("A", "B", "C")


def lint_truth(events: DataFrame, videos: DataFrame) -> DataFrame:
    """Violations in truth events, one row per broken rule.

    ``events``: (video_id, idx, text, start_frame, end_frame, start_time, end_time,
    box, tier, uncertainty, confidence); ``videos``: (video_id, fps, frame_count,
    width, height).
    """
    chunk = F.floor(F.col("idx") / F.lit(20000))
    j = ordered(events, ["video_id"], ["idx"], chunk, lag={"_pe": "end_frame"}).drop(
        "fps", "frame_count", "width", "height"
    ).join(videos, "video_id")
    s, e, fps, box = F.col("start_frame"), F.col("end_frame"), F.col("fps"), F.col("box")
    rules = {
        "empty_text": F.trim("text") == "",
        "frame_range": (s < 0) | (e < s) | (e >= F.col("frame_count")),
        "start_time": F.abs(F.col("start_time") - s / fps) > 1e-6,
        "end_time": F.abs(F.col("end_time") - (e + 1) / fps) > 1e-6,
        "box": box.isNotNull() & ~((box["x1"] >= 0) & (box["x1"] < box["x2"]) & (box["x2"] <= F.col("width"))
                                   & (box["y1"] >= 0) & (box["y1"] < box["y2"]) & (box["y2"] <= F.col("height"))),
        "tier": ~F.col("tier").isin(*TIERS),
        "tier_a_uncertainty": (F.col("tier") == "A") & (F.col("uncertainty") != 0),
        "confidence": ~F.col("confidence").between(0.0, 1.0),
        "overlap": s <= F.col("_pe"),
    }
    broken = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))
    return j.select("video_id", "idx", F.explode(broken).alias("rule"))


# Upload rules.
VIDEO_SUFFIXES = ("mp4",)
AUDIO_SUFFIXES = ("mp4", "m4a", "mp3", "wav", "flac", "ogg", "webm")
TASK_ID = "^[A-Za-z0-9_-]{1,80}$"


def audit_media_manifest(manifest: DataFrame, max_bytes: int) -> DataFrame:
    """Check (task_id, filename, kind, size_bytes) rows and clean the file names."""
    base = F.regexp_extract(F.coalesce("filename", F.lit("")), r"([^/]*)$", 1)
    bare = F.trim(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""))
    clean = F.when(bare == "", "video.mp4").otherwise(bare)
    suffix = F.lower(F.regexp_extract(clean, r"\.([A-Za-z0-9]+)$", 1))
    allowed = F.when(F.col("kind") == "audio", suffix.isin(*AUDIO_SUFFIXES)).otherwise(suffix.isin(*VIDEO_SUFFIXES))
    problem = (
        F.when(~F.col("task_id").rlike(TASK_ID), "task_id").when(~allowed, "suffix")
        .when(F.col("size_bytes") <= 0, "empty").when(F.col("size_bytes") > max_bytes, "too_large")
    )
    return manifest.select("task_id", clean.alias("filename"), suffix.alias("suffix"), problem.alias("problem"))
