"""Sinks. Output is partitioned by video; no video is gathered into one value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrail.functions.numeric import half_even
from captrail.operators.cues import number_cues, srt_blocks


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """Sorted files: long videos are split over several, in order."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_srt(cues: DataFrame, path: str, style: str = "batch") -> None:
    """One folder per video with SRT parts; their blocks in file order make the document."""
    text = srt_blocks(cues, style).select("video_id", "number", F.concat("block", F.lit("\n")).alias("value"))
    _ranged(text, "video_id", "number").drop("number").write.mode("overwrite").partitionBy("video_id").text(path)


def write_cues_json(cues: DataFrame, path: str) -> None:
    """One folder per video with one JSON cue per line, in order."""
    rows = number_cues(cues)
    _ranged(rows, "video_id", "number").write.mode("overwrite").partitionBy("video_id").json(path)


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON rows per section of the report, by video; the summary is one row per video."""
    for name, rows in sections.items():
        out = rows if name == "summary" else _ranged(rows, "video_id", "truth_idx" if "truth_idx" in rows.columns else "idx")
        out.write.mode("overwrite").json(f"{path}/{name}")


def append_events(events: DataFrame, path: str) -> None:
    """Append sequenced events, a folder per task and run, in the form that ``read_event_log`` reads."""
    rows = events.withColumns({"task": F.col("task_id"), "run": F.col("run_id")})
    _ranged(rows, "task_id", "run_id", "seq").write.mode("append").partitionBy("task", "run").json(path)


def build_diagnostics(cues: DataFrame, videos: DataFrame, run_stats: DataFrame) -> DataFrame:
    """One row per cue with its derived frames and nested run context.

    ``videos``: (video_id, fps, frame_count, duration, roi); ``run_stats``:
    (video_id, ...) counters of the run. A row per cue keeps reports of long
    videos distributable.
    """
    stats = [c for c in run_stats.columns if c != "video_id"]
    fps, count = F.col("fps"), F.col("frame_count")
    own_start = F.col("start_frame") if "start_frame" in cues.columns else F.lit(None).cast("long")
    own_end = F.col("end_frame_excl") if "end_frame_excl" in cues.columns else F.lit(None).cast("long")
    nearest = half_even(F.col("start_time") * fps, 0).cast("long")
    start = F.coalesce(own_start, F.greatest(F.lit(0), F.least(count - 1, nearest)))
    end = F.coalesce(own_end, F.greatest(start + 1, F.least(count, F.ceil(F.col("end_time") * fps))))
    return cues.join(videos, "video_id").join(run_stats, "video_id", "left").select(
        "video_id", "cue_id",
        F.struct("fps", "frame_count", "duration").alias("video"), F.struct(*stats).alias("run"),
        F.struct("text", "start_time", "end_time", start.alias("start_frame"), end.alias("end_frame_excl"), "confidence").alias("event"),
    )
