"""Task table: status rules, summaries, edits and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrail.functions.numeric import clamp, half_up_int, is_finite
from captrail.operators.folds import Fold, fold_groups

# Status names and their accepted spellings.
STATUS_WORDS = {
    "queued": ("queued", "pending"),
    "processing": ("processing", "running", "in_progress", "started"),
    "completed": ("completed", "complete", "succeeded", "success", "done"),
    "failed": ("failed", "failure", "error", "cancelled", "canceled"),
}
SOURCE_STATUSES = ("pending", "queued", "processing", "completed", "failed", "skipped")
TASK_STATUSES = ("queued", "processing", "completed", "failed")
TERMINAL = ("completed", "failed")


def normalize_status(raw: Column, fallback: str = "processing") -> Column:
    word = F.lower(F.coalesce(raw, F.lit("")))
    out = F.lit(fallback)
    for name, words in STATUS_WORDS.items():
        out = F.when(word.isin(*words), name).otherwise(out)
    return out


def normalize_progress(raw: Column, status: Column, fallback: float = 0.0) -> Column:
    """Clamp to 0..100; text that is no number counts as 100 when completed."""
    value = raw.try_cast("double")
    return F.when(is_finite(value), clamp(value, 0.0, 100.0)).when(status == "completed", 100.0).otherwise(fallback)


def normalize_job_status(jobs: DataFrame) -> DataFrame:
    """(id, status, progress, error as text) to the canonical vocabulary."""
    status = normalize_status(F.col("status"))
    return jobs.select(
        "id", status.alias("status"), normalize_progress(F.col("progress"), status).alias("progress"),
        F.nullif("error", F.lit("")).alias("error"),
    )


def audio_only() -> Column:
    return F.coalesce(F.col("analysis_mode") == "audio", F.lit(False))


def source_status(source: str) -> Column:
    own = F.when(F.col(f"{source}_status").isin(*SOURCE_STATUSES), F.col(f"{source}_status"))
    if source == "audio":
        return F.coalesce(own, F.lit("pending"))
    shared = F.when(F.col("status").isin(*TASK_STATUSES), F.col("status"))
    return F.when(audio_only(), "skipped").otherwise(F.coalesce(own, shared, F.lit("pending")))


def source_progress(source: str) -> Column:
    value = F.col(f"{source}_progress").cast("double")
    own = F.when(is_finite(value), clamp(value, 0.0, 100.0))
    if source == "audio":
        return F.coalesce(own, F.lit(0.0))
    return F.coalesce(own, normalize_progress(F.col("progress"), F.col("status")))


def task_summary(tasks: DataFrame) -> DataFrame:
    """Summary projection with per-source status, progress and cue counts.

    Counts are columns of the table, so no cue array is read.
    """
    mode = F.when(audio_only(), "audio").otherwise("audio_visual")
    zero_if_audio = F.when(audio_only(), 0.0).otherwise(source_progress("visual"))
    return tasks.select(
        "id", "filename", mode.alias("analysis_mode"), "status",
        source_status("visual").alias("visual_status"), source_status("audio").alias("audio_status"),
        zero_if_audio.alias("visual_progress"), source_progress("audio").alias("audio_progress"),
        "visual_error", "audio_error", F.coalesce("revision", F.lit(0)).alias("revision"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("subtitle_count", "visual_count", "audio_count")],
        "archived_at", "created_at", "updated_at",
    )


def parent_state(tasks: DataFrame) -> DataFrame:
    """Status of a task from its two sources. The messages are fixed values."""
    t = tasks.withColumns({
        "_vs": source_status("visual"), "_as": source_status("audio"),
        "_vp": source_progress("visual"), "_ap": source_progress("audio"),
    })
    v, a = F.col("_vs") != "skipped", F.col("_as") != "skipped"
    ended = lambda on, c: ~on | F.col(c).isin(*TERMINAL)
    has = lambda on, c, s: on & (F.col(c) == s)
    n = v.cast("int") + a.cast("int")
    mean = half_up_int((F.when(v, F.col("_vp")).otherwise(0.0) + F.when(a, F.col("_ap")).otherwise(0.0)) / F.greatest(n, F.lit(1)))
    over = ended(v, "_vs") & ended(a, "_as")
    won = has(v, "_vs", "completed") | has(a, "_as", "completed")
    lost = has(v, "_vs", "failed") | has(a, "_as", "failed")
    state = F.when(n == 0, "failed").when(~over, "processing").when(won, "completed").otherwise("failed")
    summary = F.concat_ws(" · ", F.when(v, F.concat(F.lit("Visual "), F.col("_vs"))), F.when(a, F.concat(F.lit("Audio "), F.col("_as"))))
    one = F.when(v, "Visual").otherwise("Audio")
    done = F.when(n == 1, F.concat(one, F.lit(" subtitle extraction completed"))).when(
        lost, "Subtitle extraction completed with one source unavailable"
    ).otherwise("Visual and audio subtitle extraction completed")
    broken = F.when(n == 1, F.concat(one, F.lit(" subtitle extraction failed"))).otherwise("Visual and audio subtitle extraction failed")
    nothing = F.lit("No subtitle source is enabled")
    errors = F.concat_ws(" | ", F.when(v & (F.col("visual_error") != ""), F.col("visual_error")), F.when(a & (F.col("audio_error") != ""), F.col("audio_error")))
    return t.select(
        "id", state.alias("status"),
        F.when(n == 0, 0).when(over & won, 100).otherwise(mean).cast("long").alias("progress"),
        F.when(n == 0, nothing).when(~over, summary).when(won, done).otherwise(broken).alias("message"),
        F.when(n == 0, nothing).when(over & ~won, F.when(errors == "", "AI processing failed").otherwise(errors)).alias("error"),
    )


def matching_tasks(tasks: DataFrame, status: str | None = None, search: str = "", include_archived: bool = False) -> DataFrame:
    out = tasks if include_archived else tasks.where("archived_at is null")
    if status:
        out = out.where(F.col("status") == status)
    needle = search.strip().lower()
    return out.where(F.contains(F.lower("filename"), F.lit(needle))) if needle else out


def list_tasks(
    tasks: DataFrame, page: int = 1, limit: int = 20, status: str | None = None, search: str = "",
    include_archived: bool = False,
) -> DataFrame:
    """One page of task summaries, newest first, with the total and the page count.

    The page is a top-k; the total is a separate aggregate, so nothing is
    numbered globally.
    """
    if page < 1 or limit < 1:
        raise ValueError("pages count from 1 and have at least one row")
    found = matching_tasks(tasks, status, search, include_archived)
    newest = F.coalesce("updated_at", "created_at")
    rows = task_summary(found.orderBy(newest.desc(), "id").offset((page - 1) * limit).limit(limit))
    total = found.select(F.count(F.lit(1))).scalar()
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / limit))


def merge_job_updates(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply source job updates to tasks.

    ``tasks``: (id, status, metadata map, snapshot struct<run_id,latest_seq,
    latest_event,latest_frame_event>); ``updates``: (id, status, metadata,
    run_id, latest_seq, latest_event, latest_frame_event). New metadata wins per
    key; cached events survive only within the same run.
    """
    u = updates.select("id", *[F.col(c).alias(f"_{c}") for c in updates.columns if c != "id"])
    j = tasks.join(u, "id", "left")
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("metadata", empty), F.coalesce("_metadata", empty)
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    snap = F.col("snapshot")
    usable = F.col("_run_id").isNotNull() & (F.col("_latest_seq") >= 0)
    same_run = F.coalesce(snap["run_id"] == F.col("_run_id"), F.lit(False))
    same_event = same_run & F.coalesce(snap["latest_seq"] == F.col("_latest_seq"), F.lit(False))
    fresh = F.struct(
        F.col("_run_id").alias("run_id"), F.col("_latest_seq").alias("latest_seq"),
        F.coalesce("_latest_event", F.when(same_event, snap["latest_event"])).alias("latest_event"),
        F.coalesce("_latest_frame_event", F.when(same_run, snap["latest_frame_event"])).alias("latest_frame_event"),
    )
    return j.withColumns({
        "status": F.when(F.col("_status").isNotNull(), normalize_status(F.col("_status"))).otherwise(F.col("status")),
        "metadata": F.map_concat(kept, new), "snapshot": F.when(usable, fresh).otherwise(snap),
    }).select(*tasks.columns)


class EditReplay(Fold):
    """Accept an edit only on the revision it was made for."""

    def __init__(self):
        self.revision: int | None = None

    def push(self, row):
        if self.revision is None:
            self.revision = row["revision"] or 0
        ok = row["expected_revision"] == self.revision
        self.revision += ok
        return [{
            "task_no": row["task_no"], "edit_no": row["edit_no"], "expected_revision": row["expected_revision"],
            "accepted": ok, "revision": self.revision, "cue_count": row["cue_count"],
        }]


DECISION = [
    T.StructField("expected_revision", T.LongType()), T.StructField("accepted", T.BooleanType()),
    T.StructField("revision", T.LongType()), T.StructField("cue_count", T.LongType()),
]


def replay_edits(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """Decision per edit in arrival order. ``tasks``: (task_no, revision)."""
    rows = edits.join(tasks.select("task_no", F.col("revision").cast("long").alias("revision")), "task_no").withColumn(
        "expected_revision", F.col("expected_revision").cast("long")
    )
    schema = T.StructType([edits.schema["task_no"], edits.schema["edit_no"], *DECISION])
    return fold_groups(rows, ["task_no"], ["arrival_ts", "edit_no", "tie"], EditReplay, schema)


def edit_state(decisions: DataFrame) -> DataFrame:
    """Last accepted edit per task with conflict counts."""
    return decisions.groupBy("task_no").agg(
        F.max("revision").alias("revision"), F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("conflicts"),
        F.max_by("cue_count", F.when(F.col("accepted"), F.col("revision"))).alias("cue_count"),
    )


def apply_transitions(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """Start and archive commands: the first valid start wins, archiving keeps its first time.

    ``commands``: (id, command_no, command, at). Returns the new task fields and
    how many start commands lost.
    """
    order = F.struct("at", "command_no")
    c = commands.groupBy("id").agg(
        F.min_by("command_no", F.when(F.col("command") == "start", order)).alias("_start"),
        F.min(F.when(F.col("command") == "archive", F.col("at"))).alias("_archive"),
        F.count_if(F.col("command") == "start").alias("_starts"),
    )
    j = tasks.join(c, "id", "left")
    starts = (F.col("status") == "awaiting_roi") & F.col("_start").isNotNull()
    reset = lambda name, value: F.when(starts, value).otherwise(F.col(name)).alias(name)
    return j.select(
        "id", reset("status", F.lit("queued")), reset("visual_status", F.lit("queued")), reset("audio_status", F.lit("queued")),
        reset("visual_progress", F.lit(0)), reset("audio_progress", F.lit(0)),
        reset("visual_error", F.lit(None)), reset("audio_error", F.lit(None)),
        F.coalesce("archived_at", "_archive").alias("archived_at"),
        F.when(starts, F.col("_start")).alias("started_by"),
        (F.coalesce("_starts", F.lit(0)) - F.when(starts, 1).otherwise(0)).alias("conflicts"),
    )
