"""Sequenced progress events in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrail.functions.numeric import clamp, finite_nonneg, half_even
from captrail.operators.clean import first_present, number
from captrail.operators.folds import Fold, fold_groups
from captrail.operators.ordered import ordered, time_chunk, top_k_per

# Identifier patterns and terminal event types.
RUN_ID = "^[a-f0-9]{32}$"
EVENT_TYPE = "^[a-z][a-z0-9_.-]{0,63}$"
TASK_ID = "^[A-Za-z0-9][A-Za-z0-9_-]{0,79}$"
TERMINAL_TYPES = ("job.completed", "job.failed")

RUN = ["task_id", "run_id"]
CHUNK_EVENTS = 20000


def _seq_chunk(column: str = "seq") -> Column:
    return F.floor(F.col(column) / F.lit(CHUNK_EVENTS))


def well_formed() -> Column:
    return (
        F.col("seq").isNotNull() & (F.col("seq") >= 1) & F.col("task_id").isNotNull()
        & F.coalesce(F.col("run_id").rlike(RUN_ID), F.lit(False)) & F.coalesce(F.col("type").rlike(EVENT_TYPE), F.lit(False))
    )


def validate_events(events: DataFrame, tie: str = "occurred_at") -> DataFrame:
    """Well-formed events, the first occurrence per (task, run, seq)."""
    rest = [c for c in events.columns if c not in (*RUN, "seq")]
    return events.where(well_formed()).groupBy(*RUN, "seq").agg(
        F.min_by(F.struct(*rest), F.col(tie)).alias("e")
    ).select(*RUN, "seq", "e.*")


def keep_increasing(events: DataFrame, position: str) -> DataFrame:
    """Rows whose seq exceeds every earlier seq of the run, by ``position`` in the log."""
    seen = ordered(events, RUN, [position], _seq_chunk(position), max_before={"_top": "seq"})
    return seen.where(F.col("_top").isNull() | (F.col("seq") > F.col("_top"))).drop("_top")


def assign_seq(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Continue each run's numbering over new rows sorted by ``order`` (a number)."""
    last = existing.groupBy(*RUN).agg(F.max("seq").alias("_last"))
    numbered = ordered(new, RUN, [order], _seq_chunk(order), number="_n")
    return numbered.join(last, RUN, "left").withColumn(
        "seq", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long")
    ).drop("_last", "_n")


def parse_cursor(cursor: Column) -> Column:
    """'run:seq' or plain 'seq' to struct<run_id,seq>; null when malformed."""
    with_run = F.regexp_extract(cursor, r"^([a-f0-9]{32}):(\d+)$", 1)
    seq = F.coalesce(
        F.when(with_run != "", F.regexp_extract(cursor, r"^([a-f0-9]{32}):(\d+)$", 2)), F.when(cursor.rlike(r"^\d+$"), cursor)
    ).try_cast("long")
    return F.when(seq.isNotNull(), F.struct(F.when(with_run != "", with_run).alias("run_id"), seq.alias("seq")))


def cursor_request(requested_run: Column, last_event_id: Column, after_seq: Column) -> Column:
    """What a reader asks for, struct(run_id, seq, error).

    The id of its last event goes before ``after_seq``; nothing at all means from the start. An id that names another run
    than the requested one, or that cannot be read, is an error.
    """
    given = F.trim(F.coalesce(last_event_id, F.lit("")))
    cursor = parse_cursor(F.when(given != "", given).otherwise(F.coalesce(F.trim(after_seq), F.lit("0"))))
    run = F.coalesce(cursor["run_id"], requested_run)
    clash = cursor["run_id"].isNotNull() & requested_run.isNotNull() & (cursor["run_id"] != requested_run)
    error = F.when(cursor.isNull(), "unreadable").when(clash, "conflict")
    return F.struct(F.when(error.isNull(), run).alias("run_id"), F.when(error.isNull(), cursor["seq"]).alias("seq"), error.alias("error"))


def resume_cursors(cursors: DataFrame, events: DataFrame) -> DataFrame:
    """Where readers go on: their rows with the newest ``run``, ``after`` and ``reset``.

    ``cursors``: (task_id, run_id?, seq). A reader of another run, or one ahead of the log, starts over. Tasks without
    events leave their readers as they are.
    """
    runs = events.groupBy(*RUN).agg(F.max("seq").alias("_latest"), F.max(F.struct("occurred_at", "seq")).alias("_at"))
    newest = runs.groupBy("task_id").agg(F.max_by(F.struct(F.col("run_id").alias("run"), "_latest"), F.struct("_at", "run_id")).alias("_n"))
    joined = cursors.join(newest, "task_id", "left").withColumn("run", F.col("_n.run"))
    moved = F.col("run").isNotNull() & ((F.col("seq") > F.col("_n._latest")) | F.coalesce(F.col("run_id") != F.col("run"), F.lit(False)))
    return joined.withColumns({"reset": moved, "after": F.when(moved, F.lit(0)).otherwise(F.col("seq"))}).select(*cursors.columns, "run", "after", "reset")


def replay(events: DataFrame, task_id: str, run_id: str, after_seq: int = 0, limit: int = 500) -> DataFrame:
    """One cursor page of a run: rows after ``after_seq`` with latest_seq and has_more."""
    if limit < 1:
        raise ValueError("a page has at least one row")
    run = events.where((F.col("task_id") == task_id) & (F.col("run_id") == run_id))
    return page_run(run, after_seq, limit)


def page_run(run: DataFrame, after_seq: int, limit: int) -> DataFrame:
    waiting = run.where(F.col("seq") > after_seq)
    return waiting.orderBy("seq").limit(limit).withColumns({
        "latest_seq": run.select(F.max("seq")).scalar(),
        "has_more": waiting.select(F.count(F.lit(1))).scalar() > limit,
    })


def retain_latest(events: DataFrame, keys: list[str], distinct_on: str, k: int) -> DataFrame:
    """Newest ``k`` distinct items per key; a repeated item counts at its last seq."""
    last = events.groupBy(*keys, distinct_on).agg(F.max("seq").alias("seq"))
    return top_k_per(last, keys, [F.desc("seq")], k, [distinct_on], salts=16)


def retain_previews(previews: DataFrame, ended: DataFrame, k: int = 8) -> DataFrame:
    """Previews that stay: all that serve as evidence, and the newest ``k`` others of runs that have not ended.

    ``previews``: (task_id, run_id, preview_id, seq, evidence); ``ended``: (task_id, run_id).
    """
    evidence = previews.where("evidence").groupBy(*RUN, "preview_id").agg(F.max("seq").alias("seq"))
    others = previews.join(evidence, [*RUN, "preview_id"], "left_anti").join(ended.select(*RUN), RUN, "left_anti")
    newest = retain_latest(others, RUN, "preview_id", k).drop("rank")
    return evidence.withColumn("evidence", F.lit(True)).unionByName(newest.withColumn("evidence", F.lit(False)))


def latest_snapshot(events: DataFrame) -> DataFrame:
    """Per task: newest run with its last event, last frame event and last frame with a preview.

    Reduced per run first, then per task.
    """
    frame = F.col("type") == "frame.analyzed"
    row = F.struct("seq", "type", "occurred_at", "progress", "message")
    runs = events.groupBy(*RUN).agg(
        F.max(F.struct("occurred_at", "seq")).alias("_at"), F.max_by(row, "seq").alias("latest_event"),
        F.max_by(row, F.when(frame, F.col("seq"))).alias("latest_frame_event"),
        F.max_by(row, F.when(frame & F.col("preview_id").isNotNull(), F.col("seq"))).alias("latest_preview_event"),
    )
    best = F.struct("run_id", "latest_event", "latest_frame_event", "latest_preview_event")
    return runs.groupBy("task_id").agg(F.max_by(best, "_at").alias("s")).select("task_id", "s.*")


def stage_stats(events: DataFrame) -> DataFrame:
    """Work per (run, stage): events, OCR calls, highest processed/total, duration, throughput."""
    took = F.timestamp_diff("MILLISECOND", F.min("occurred_at"), F.max("occurred_at"))
    stats = events.groupBy(*RUN, "stage").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("type") == "frame.analyzed").alias("ocr_calls"),
        F.max("processed").alias("processed"), F.max("total").alias("total"), took.alias("elapsed_ms"),
    )
    return stats.withColumn("per_second", half_even(F.try_divide(F.col("ocr_calls") * 1000, F.col("elapsed_ms")), 6))


def audit_sequences(events: DataFrame) -> DataFrame:
    """Per run: rows, first and last seq, missing numbers, duplicates, inversions, terminal events."""
    per_seq = events.groupBy(*RUN, "seq").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("type").isin(*TERMINAL_TYPES)).alias("_t"),
        F.min("occurred_at").alias("_at"),
    )
    timed = ordered(per_seq, RUN, ["seq"], _seq_chunk(), lag={"_before": "_at"})
    out = timed.groupBy(*RUN).agg(
        F.sum("_n").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.count(F.lit(1)).alias("_distinct"), F.sum("_t").alias("terminals"),
        F.count_if(F.col("_at") < F.col("_before")).alias("inversions"),
    )
    return out.select(
        *RUN, "events", "first_seq", "last_seq",
        (F.col("last_seq") - F.col("first_seq") + 1 - F.col("_distinct")).alias("missing"),
        (F.col("events") - F.col("_distinct")).alias("duplicates"), "inversions", "terminals",
    )


def audit_media_time(events: DataFrame) -> DataFrame:
    """Events whose media time falls back within their (run, stage) pass."""
    seen = ordered(
        events.where("media_time is not null"), [*RUN, "stage"], ["seq"], _seq_chunk(),
        lag={"_p": F.struct("seq", "media_time")},
    )
    return seen.where(F.col("media_time") < F.col("_p.media_time")).select(
        *RUN, "stage", "seq", "media_time", F.col("_p.media_time").alias("previous_media_time")
    )


def flatten_frames(events: DataFrame, most: int | None = None) -> DataFrame:
    """Typed columns from the JSON payload of frame events; old and new key spellings.

    All candidates stay unless the caller wants ``most`` of a frame.
    """
    given = F.coalesce(F.try_variant_get(F.col("_v"), "$.candidates", "array<variant>"), F.array().cast("array<variant>"))
    v = F.col("_v")
    get = lambda *keys: first_present(v, keys)
    whole = lambda *keys: F.floor(finite_nonneg(number(get(*keys))))
    return events.where("type = 'frame.analyzed'").withColumn("_v", F.try_parse_json("payload")).select(
        *RUN, "seq", whole("frame_index", "frameIndex").alias("frame_index"), number(get("pts")).alias("pts"),
        number(get("time_base_num", "timeBaseNum")).alias("time_base_num"), number(get("time_base_den", "timeBaseDen")).alias("time_base_den"),
        number(get("media_time", "mediaTime")).alias("media_time"), whole("processed").alias("processed"), whole("total").alias("total"),
        whole("detected_cue_count", "detectedCueCount", "cue_count").alias("cue_count"),
        F.coalesce(get("coordinate_space", "coordinateSpace"), F.lit("video")).alias("coordinate_space"),
        F.coalesce(get("preview_id", "previewId", "frame_preview_id", "framePreviewId", "preview.frame.id"), F.lit("")).alias("preview_id"),
        (given if most is None else F.slice(given, 1, most)).alias("candidates"),
    )


def explode_candidates(frames: DataFrame) -> DataFrame:
    """One row per kept candidate of ``flatten_frames`` output."""
    item = F.col("c")
    box = F.coalesce(*[F.try_variant_get(item, f"$.{k}", "array<double>") for k in ("position", "box", "bbox")])
    return frames.select(*RUN, "seq", "coordinate_space", F.posexplode("candidates").alias("n", "c")).select(
        *RUN, "seq", "n", F.coalesce(first_present(item, ("text", "value")), F.lit("")).alias("text"),
        number(first_present(item, ("confidence", "score"))).alias("confidence"), box.alias("position"),
        F.coalesce(first_present(item, ("coordinate_space", "coordinateSpace")), F.col("coordinate_space")).alias("coordinate_space"),
    )


def progress_state(events: DataFrame, thumbnails: int = 5) -> DataFrame:
    """Final reducer state per run: last given value of every field, newest frames and thumbnails.

    ``events`` may lack values (null); an absent field keeps the older value. ``frame_seq`` and ``preview_seq`` number the
    newest frame and the newest one with a preview.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    ended, frame = F.col("type").isin(*TERMINAL_TYPES), F.col("type") == "frame.analyzed"
    bounded = lambda c: F.when(F.col(c).isNotNull(), clamp(F.col(c).cast("double"), 0.0, 100.0))
    percent = F.when(F.col("type") == "job.completed", 100.0).otherwise(bounded("progress"))
    e = events.withColumns({
        "progress": percent, "stage_progress": bounded("stage_progress"), "_end": F.when(ended, F.split_part("type", F.lit("."), F.lit(2))),
        "_why": F.when(F.col("type") == "job.failed", F.col("message")),
        "preview_id": F.when(frame & (F.col("preview_id") != ""), F.col("preview_id")),
    })
    base = e.groupBy(*RUN).agg(
        F.max("seq").alias("last_seq"),
        *[last(c) for c in ("stage", "label", "message", "progress", "stage_progress", "processed", "total", "cue_count")],
        F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("seq"))).alias("terminal"),
        F.max_by("_why", F.when(F.col("_why").isNotNull(), F.col("seq"))).alias("failure"),
        F.max(F.when(frame, F.col("seq"))).alias("frame_seq"), F.max(F.when(F.col("preview_id").isNotNull(), F.col("seq"))).alias("preview_seq"),
    )
    newest = retain_latest(e.where("preview_id is not null"), RUN, "preview_id", thumbnails)
    thumbs = newest.groupBy(*RUN).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "preview_id"))), lambda t: t["preview_id"]).alias("thumbnails")
    )
    return base.join(thumbs, RUN, "left")


def cue_table(events: DataFrame) -> DataFrame:
    """Latest version of every cue of a run from cue.upserted events."""
    return events.where("type = 'cue.upserted'").groupBy(*RUN, "cue_id").agg(
        F.max("seq").alias("seq"), F.max_by("message", "seq").alias("message"), F.count(F.lit(1)).alias("versions")
    )


def first_terminal(events: DataFrame) -> DataFrame:
    """The one terminal event that counts per run."""
    ends = events.where(F.col("type").isin(*TERMINAL_TYPES))
    return ends.groupBy(*RUN).agg(F.min_by(F.struct("seq", "type", "message"), "seq").alias("t")).select(*RUN, "t.*")


def classify_interrupted(jobs: DataFrame) -> DataFrame:
    """What becomes of jobs found open at a restart.

    ``jobs``: (id, kind, status, run_id, completion_pending, recovery_pending).
    """
    open_ = F.col("status").isin("queued", "processing")
    pending = F.coalesce("recovery_pending", F.lit(False))
    fresh = open_ & F.col("run_id").isNotNull() & ~pending
    done = F.coalesce("completion_pending", F.lit(False)) & (F.col("kind") != "audio")
    audio = (F.col("kind") == "audio") & open_
    return jobs.select(
        "id", "kind", "run_id", "status",
        F.when(audio, "failed").when(fresh & done, "completed").when(fresh, "failed").otherwise(F.col("status")).alias("final_status"),
        (fresh | pending | audio).alias("recovered"),
    )


class RateLimit(Fold):
    """Keep a preview when enough time passed since the last kept one; evidence always."""

    def __init__(self, seconds: float):
        self.seconds, self.last = seconds, None

    def push(self, row):
        if row["evidence"]:
            return [row]
        if self.last is not None and row["at"] - self.last < self.seconds:
            return ()
        self.last = row["at"]
        return [row]


def rate_limit(previews: DataFrame, seconds: float = 1.0) -> DataFrame:
    """``previews``: (task_id, run_id, seq, at seconds, evidence)."""
    return fold_groups(previews, RUN, ["at", "seq"], lambda: RateLimit(seconds), previews.schema)


class Stalls(Fold):
    """Consecutive failing polls of a run; progress of the cursor clears them."""

    def __init__(self, max_errors: int, timeout: float):
        self.max_errors, self.timeout = max_errors, timeout
        self.errors, self.cursor, self.moved, self.over = 0, -1, None, False

    def push(self, row):
        if self.over:
            return ()
        if self.moved is None or row["cursor"] > self.cursor:
            self.cursor, self.moved, self.errors = max(self.cursor, row["cursor"]), row["at"], 0
        if not row["ok"]:
            self.errors += 1
        reason = "errors" if self.errors >= self.max_errors else None
        if reason is None and row["at"] - self.moved > self.timeout:
            reason = "stalled"
        if reason is None:
            return ()
        self.over = True
        return [{"task_id": row["task_id"], "run_id": row["run_id"], "at": row["at"], "cursor": self.cursor, "reason": reason}]


STALL = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("at", T.DoubleType()),
    T.StructField("cursor", T.LongType()), T.StructField("reason", T.StringType()),
])


def stalled_runs(polls: DataFrame, timeout: float = 1800.0, max_errors: int = 5) -> DataFrame:
    """Runs given up on. ``polls``: (task_id, run_id, at seconds, cursor, ok).

    A poll moves a run if its cursor exceeds all earlier ones; failed polls count from the last move on.
    """
    order, chunk = ["at", "cursor"], time_chunk("at", 43_200.0)
    failed = (~F.col("ok")).cast("long")
    seen = ordered(polls, RUN, order, chunk, max_before={"_top": "cursor"}, running_sum={"_failed": failed})
    moved = F.when(F.col("_top").isNull() | (F.col("cursor") > F.col("_top")), F.struct("at", (F.col("_failed") - failed).alias("failed")))
    told = ordered(seen, RUN, order, chunk, last_seen={"_moved": moved})
    reason = F.when(F.col("_failed") - F.col("_moved.failed") >= max_errors, "errors").when(F.col("at") - F.col("_moved.at") > timeout, "stalled")
    first = F.min_by(F.struct("at", F.greatest("cursor", "_top").alias("cursor"), "reason"), F.struct("at", "cursor")).alias("e")
    return told.withColumn("reason", reason).where("reason is not null").groupBy(*RUN).agg(first).select(*RUN, "e.at", "e.cursor", "e.reason")
