"""Streaming twins of the event log operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrail.config import CaptionConfig
from captrail.functions import text as TX
from captrail.operators import eventlog as EL
from captrail.operators.tasks import DECISION, EditReplay
from captrail.operators.tracks import _KEPT, Association
from captrail.streaming.stateful import StateFold, state_fold, stream_fold


def clean_events(stream: DataFrame) -> DataFrame:
    """Well-formed events only."""
    return stream.where(EL.well_formed())


def dedupe_events(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """First occurrence per (task, run, seq) within the watermark."""
    return stream.withWatermark("occurred_at", watermark).dropDuplicatesWithinWatermark(["task_id", "run_id", "seq"])


class Monotone(StateFold):
    """Per task: drop stale numbers of the current run; a new run starts over."""

    STATE = "run string, last long, ended boolean"

    def __init__(self):
        self.run, self.last, self.ended = None, 0, False

    def push(self, row):
        if row["run_id"] != self.run:
            self.run, self.last, self.ended = row["run_id"], 0, False
        if row["seq"] <= self.last:
            return ()
        self.last = row["seq"]
        self.ended = self.ended or row["type"] in EL.TERMINAL_TYPES
        return [row]


def _plain(df: DataFrame) -> T.StructType:
    return T.StructType(df.schema.fields)


def monotone(stream: DataFrame, live: float | None = 86_400.0, linger: float | None = 600.0) -> DataFrame:
    return state_fold(stream, ["task_id"], ["occurred_at", "seq"], Monotone, _plain(stream), live, linger)


class Reducer(StateFold):
    """Progress state of a task; every event emits the new state, a new run clears it.

    A value that an event lacks stays. The newest frame, and the newest with a preview, are known by their numbers.
    """

    VALUES = ("stage", "label", "message", "processed", "total", "stage_progress", "cue_count")
    STATE = ("run_id string, last_seq long, stage string, label string, message string, processed long, total long, stage_progress double, "
             "cue_count long, progress double, terminal string, failure string, frame_seq long, preview_seq long, thumbnails array<string>")

    def __init__(self, thumbnails: int = 5):
        self.limit = thumbnails
        self._clear(None)

    def _clear(self, run):
        for part in self.STATE.split(", "):
            setattr(self, part.split()[0], None)
        self.run_id, self.last_seq, self.thumbnails = run, 0, []

    @property
    def ended(self):
        return self.terminal is not None

    def push(self, row):
        if row["run_id"] != self.run_id:
            self._clear(row["run_id"])
        if row["seq"] <= self.last_seq:
            return ()
        self.last_seq = row["seq"]
        for name in self.VALUES:
            if row.get(name) is not None:
                value = row[name]
                setattr(self, name, max(0.0, min(100.0, float(value))) if name == "stage_progress" else value)
        if row["progress"] is not None:
            self.progress = max(0.0, min(100.0, float(row["progress"])))
        if row["type"] == "frame.analyzed":
            self.frame_seq = self.last_seq
            if row["preview_id"]:
                self.preview_seq = self.last_seq
                kept = [t for t in self.thumbnails if t != row["preview_id"]]
                self.thumbnails = (kept + [row["preview_id"]])[-self.limit:]
        if row["type"] in EL.TERMINAL_TYPES:
            self.terminal = row["type"].split(".")[1]
            if row["type"] == "job.completed":
                self.progress = 100.0
            elif row["message"] is not None:
                self.failure = row["message"]
        names = [part.split()[0] for part in self.STATE.split(", ")]
        return [{n: getattr(self, n) for n in names} | {"task_id": row["task_id"], "thumbnails": ",".join(self.thumbnails) or None}]


_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "array<string>": T.StringType()}
PROGRESS = T.StructType([T.StructField("task_id", T.StringType())] + [T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in Reducer.STATE.split(", "))])


def progress_state_stream(stream: DataFrame, thumbnails: int = 5, live: float | None = 86_400.0, linger: float | None = 600.0) -> DataFrame:
    """State after every event; the last row per run equals the batch ``progress_state``."""
    return state_fold(stream, ["task_id"], ["occurred_at", "seq"], lambda: Reducer(thumbnails), PROGRESS, live, linger)


class CursorEpochs(StateFold):
    """Per task: the newest run, how far it is, and how many runs there were; answers readers by it."""

    STATE = "run string, latest long, epoch long"

    def __init__(self):
        self.run, self.latest, self.epoch = None, 0, 0

    def push(self, row):
        if row["reader"] is None:
            if row["run_id"] != self.run:
                self.run, self.latest, self.epoch = row["run_id"], 0, self.epoch + 1
            self.latest = max(self.latest, row["seq"])
            return ()
        known = self.run is not None
        reset = known and (row["seq"] > self.latest or row["run_id"] not in (None, self.run))
        return [{"task_id": row["task_id"], "reader": row["reader"], "run": self.run, "after": 0 if reset else row["seq"], "reset": reset, "epoch": self.epoch}]


RESUME = T.StructType([T.StructField("task_id", T.StringType()), T.StructField("reader", T.StringType()), T.StructField("run", T.StringType()),
                       T.StructField("after", T.LongType()), T.StructField("reset", T.BooleanType()), T.StructField("epoch", T.LongType())])


def resume_stream(stream: DataFrame, live: float | None = 86_400.0) -> DataFrame:
    """Answers to readers as they come, in one stream with the events they read: (task_id, run_id, seq, occurred_at, reader).

    ``reader`` is null for events. A reader of another run, or one ahead of the log, starts over.
    """
    return state_fold(stream, ["task_id"], ["occurred_at", "reader", "seq"], CursorEpochs, RESUME, live, None)


class SingleTerminal(StateFold):
    """Pass events of a run up to and including its first terminal event."""

    STATE = "ended boolean"

    def __init__(self):
        self.ended = False

    def push(self, row):
        if self.ended:
            return ()
        self.ended = row["type"] in EL.TERMINAL_TYPES
        return [row]


def single_terminal(stream: DataFrame, live: float | None = 86_400.0, linger: float | None = 600.0) -> DataFrame:
    return state_fold(stream, EL.RUN, ["seq"], SingleTerminal, _plain(stream), live, linger)


class PreviewRate(EL.RateLimit, StateFold):
    STATE = "last double"


def rate_limit_stream(stream: DataFrame, seconds: float = 1.0, live: float | None = 86_400.0) -> DataFrame:
    return state_fold(stream, EL.RUN, ["at", "seq"], lambda: PreviewRate(seconds), _plain(stream), live, None)


class Watch(EL.Stalls, StateFold):
    """Stalled runs, also those of which nothing is heard any more."""

    STATE = "errors int, cursor long, moved double, over boolean"

    @property
    def ended(self):
        return self.over

    def silence(self):
        return None if self.over else self.timeout

    def silent(self, key):
        if self.over or self.moved is None:
            return ()
        self.over = True
        return [key | {"at": self.moved + self.timeout, "cursor": self.cursor, "reason": "silent"}]


def stalled_runs_stream(
    stream: DataFrame, timeout: float = 1800.0, max_errors: int = 5, live: float | None = 86_400.0, linger: float | None = 86_400.0,
) -> DataFrame:
    """Runs given up on, once each. A run without any poll for ``timeout`` seconds of the clock is reported as silent."""
    return state_fold(stream, EL.RUN, ["at", "cursor"], lambda: Watch(max_errors, timeout), EL.STALL, live, linger)


class EditStream(EditReplay, StateFold):
    STATE = "revision long"


def edit_decisions(stream: DataFrame, live: float | None = None) -> DataFrame:
    """Accept or reject edits by revision. Rows carry the task's ``revision`` at the start.

    Give ``live`` only where rows carry the revision that is stored by then: a dropped state starts from it.
    """
    schema = T.StructType([stream.schema["task_no"], stream.schema["edit_no"], *DECISION])
    return state_fold(stream, ["task_no"], ["arrival_ts", "edit_no", "tie"], EditStream, schema, live, None)


class StreamAssociation(Association):
    """Association whose session is named by the first instant of its state."""

    SPARE = ("known",)

    def __init__(self, cfg: CaptionConfig):
        Association.__init__(self, cfg)
        self.session: float | None = None

    def push(self, row):
        if self.session is None:
            self.session = row["ts"]
        row["session_id"] = self.session
        return Association.push(self, row)


def associate_stream(stream: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Track association over a stream of observations with event time ``seen_at``.

    An instant is settled when a later one arrives, or when the watermark has
    left the reach of every open track; then the state is dropped.
    """
    rows = stream.withColumn("lines", TX.line_breaks(F.col("text"))).withColumns({"session_id": F.lit(0.0), "band": F.lit(0).cast("long")})
    rows = rows.select(*_KEPT, "seen_at")
    schema = T.StructType([f for f in rows.schema.fields if f.name in _KEPT and f.name != "band"] + [T.StructField("track_no", T.LongType())])
    return stream_fold(
        rows, ["video_id", "lines"], ["ts", "cand_no"], lambda: StreamAssociation(cfg), schema,
        event_time="seen_at", idle_seconds=cfg.track_reach,
    )


BUCKETS = 16


class SnapshotStore:
    """Latest snapshot per task, in ``BUCKETS`` parts by task, each a folder of its own for every change.

    A manifest with the folder of each bucket is written last, so readers see whole tables only: a batch that breaks off
    leaves the one before, and a batch that is repeated, known by its number, changes nothing. Buckets without new events
    keep their folders.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def current(self) -> tuple[int, dict[int, str]]:
        """Number of the last whole batch (-1: none) and the folder of each bucket."""
        try:
            rows = self.spark.read.schema("bucket int, folder string, batch long").json(f"{self.path}/manifest")
            last = rows.agg(F.max("batch")).first()[0]
            return (-1, {}) if last is None else (last, {r.bucket: r.folder for r in rows.where(F.col("batch") == last).collect() if r.folder})
        except AnalysisException:  # nothing was written yet
            return -1, {}

    def read(self) -> DataFrame | None:
        """The table, or nothing before the first batch."""
        folders = self.current()[1]
        return self.spark.read.parquet(*folders.values()) if folders else None

    def merge(self, events: DataFrame, batch: int) -> None:
        last, folders = self.current()
        if batch <= last:
            return
        bucket = F.pmod(F.xxhash64("task_id"), F.lit(BUCKETS)).cast("int")
        new = EL.latest_snapshot(events)
        touched = {r.b for r in new.select(bucket.alias("b")).distinct().collect()}
        old = [folders[b] for b in touched if b in folders]
        if old:
            at = lambda df: df.select("task_id", F.struct(*[F.col(c) for c in new.columns]).alias("s"))
            rank = F.struct("s.latest_event.occurred_at", "s.latest_event.seq")
            before = self.spark.read.schema(new.schema).parquet(*old)
            new = at(new).unionByName(at(before)).groupBy("task_id").agg(F.max_by("s", rank).alias("s")).select("s.*")
        name = f"{self.path}/data/{batch}-{uuid.uuid4().hex}"
        new.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(name)
        folders |= {b: f"{name}/bucket={b}" for b in touched}
        rows = sorted(folders.items()) or [(0, None)]
        self.spark.createDataFrame(rows, "bucket int, folder string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/batch={batch}")


def snapshot_sink(stream: DataFrame, path: str, checkpoint: str, seconds: int = 1):
    """Latest snapshot per task in the ``SnapshotStore`` at ``path``, at most once per ``seconds``.

    A micro-batch holds all that came in since the last one, terminal events too, so none waits longer than the trigger.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        SnapshotStore(batch.sparkSession, path).merge(batch, batch_id)

    return (
        stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
    )
