"""Readers. Each is a parser over a text or JSON column plus a thin file scan.

Faulty records become rows of a ``rejects`` frame; nothing is raised per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrail.functions import timecode as TC
from captrail.functions.numeric import half_even
from captrail.operators.clean import first_present, number
from captrail.operators.eventlog import keep_increasing, well_formed
from captrail.operators.ordered import ordered

EVENT_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()), T.StructField("payload", T.StringType()),
    T.StructField("progress", T.LongType()), T.StructField("message", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])

# Keys under which a prediction document may hold its list.
LIST_KEYS = ("events", "subtitles", "items", "predictions")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (doc, text)."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1).alias("doc"), F.col("value").alias("text")
    )


def _box(item: Column) -> tuple[Column, Column]:
    values = F.try_variant_get(item, "$.position", "array<double>")
    given = F.try_variant_get(item, "$.position", "variant").isNotNull()
    at = lambda i: F.get(values, F.lit(i))
    good = F.coalesce((F.size(values) == 4) & (at(0) < at(2)) & (at(1) < at(3)), F.lit(False))
    box = F.struct(at(0).alias("x1"), at(1).alias("y1"), at(2).alias("x2"), at(3).alias("y2"))
    return F.when(good, box), given & ~good


def _frame(item: Column, key: str) -> Column:
    value = number(F.try_variant_get(item, f"$.{key}", "string"))
    return F.when((value >= 0) & (value == F.floor(value)), value.cast("long"))


def parse_truth(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, text) truth documents to (events, rejects)."""
    v = docs.withColumn("v", F.try_parse_json("text"))
    fps = number(F.try_variant_get("v", "$.video.fps", "string"))
    items = F.try_variant_get("v", "$.events", "array<variant>")
    head = v.select("doc", fps.alias("fps"), items.alias("items"))
    usable = (F.col("fps") > 0) & F.col("items").isNotNull()
    broken = head.where(~F.coalesce(usable, F.lit(False))).select("doc", F.lit(None).cast("long").alias("idx"), F.lit("document").alias("rule"))
    rows = head.where(usable).select("doc", "fps", F.posexplode("items").alias("idx", "item"))
    item = F.col("item")
    box, bad_box = _box(item)
    raw = F.try_variant_get(item, "$.boundary_uncertainty_frames", "string")
    uncertainty = F.when(raw.isNull(), F.lit(0).cast("long")).otherwise(_frame(item, "boundary_uncertainty_frames"))
    events = rows.select(
        "doc", "fps", F.col("idx").cast("long").alias("idx"), F.try_variant_get(item, "$.text", "string").alias("text"),
        _frame(item, "first_frame").alias("start_frame"), _frame(item, "last_frame").alias("end_frame"),
        number(F.try_variant_get(item, "$.start_time", "string")).alias("start_time"),
        number(F.try_variant_get(item, "$.end_time", "string")).alias("end_time"),
        box.alias("box"), F.try_variant_get(item, "$.verification_tier", "string").alias("tier"),
        uncertainty.alias("uncertainty"), number(F.try_variant_get(item, "$.confidence.text", "string")).alias("confidence"),
        bad_box.alias("_bad_box"),
    )
    seen = ordered(events, ["doc"], ["idx"], F.floor(F.col("idx") / 20000), lag={"_p": F.struct("start_frame", "end_frame")})
    rule = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "text")
        .when(F.col("start_frame").isNull() | F.col("end_frame").isNull() | (F.col("end_frame") < F.col("start_frame")), "frames")
        .when(F.col("_bad_box"), "position").when(F.col("uncertainty").isNull(), "uncertainty")
        .when(F.col("start_frame") < F.col("_p.start_frame"), "order").when(F.col("start_frame") <= F.col("_p.end_frame"), "overlap")
    )
    judged = seen.withColumn("rule", rule)
    good = judged.where("rule is null").drop("_bad_box", "_p", "rule")
    return good, judged.where("rule is not null").select("doc", "idx", "rule").unionByName(broken)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row: what reads them, filters too, gets the value and not its expression."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def parse_predictions(docs: DataFrame, fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, text) prediction documents and (doc, fps) to (events, rejects).

    The root is a list or an object holding one; times turn into frames, the end
    being exclusive. ``idx`` counts the events by frames, ``raw_idx`` is the place
    in the document.
    """
    v = F.col("v")
    items = F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in LIST_KEYS]
    )
    parsed = _once(docs.select("doc", "text"), v=F.try_parse_json("text"))
    head = _once(parsed, items=items).select("doc", "items").join(fps, "doc")
    broken = head.where("items is null").select("doc", F.lit(None).cast("long").alias("idx"), F.lit("document").alias("rule"))
    rows = head.where("items is not null").select("doc", "fps", F.posexplode("items").alias("idx", "item"))
    item = F.col("item")
    time = lambda k: F.when(number(F.try_variant_get(item, f"$.{k}", "string")) >= 0, number(F.try_variant_get(item, f"$.{k}", "string")))
    given = lambda k: F.try_variant_get(item, f"$.{k}", "string").isNotNull()
    to_frame = lambda s: half_even(s * F.col("fps"), 0).cast("long")
    start = F.when(given("first_frame"), _frame(item, "first_frame")).otherwise(F.greatest(F.lit(0), to_frame(time("start_time"))))
    staged = _once(rows, start_frame=F.when(given("first_frame") | time("start_time").isNotNull(), start))
    end = F.when(given("last_frame"), _frame(item, "last_frame")).when(
        time("end_time").isNotNull(), F.greatest(F.col("start_frame"), to_frame(time("end_time")) - 1)
    )
    box, bad_box = _box(item)
    events = _once(
        staged.withColumn("idx", F.col("idx").cast("long")), text=F.try_variant_get(item, "$.text", "string"), end_frame=end, box=box, _bad_box=bad_box,
    ).select("doc", "idx", "text", "start_frame", "end_frame", "box", "_bad_box")
    rule = (
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "text")
        .when(F.col("start_frame").isNull() | F.col("end_frame").isNull() | (F.col("end_frame") < F.col("start_frame")), "frames")
        .when(F.col("_bad_box"), "position")
    )
    judged = events.withColumn("rule", rule)
    order = Window.partitionBy("doc").orderBy("start_frame", "end_frame", "raw_idx")
    good = judged.where("rule is null").drop("_bad_box", "rule").withColumnRenamed("idx", "raw_idx")
    good = good.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return good, judged.where("rule is not null").select("doc", "idx", "rule").unionByName(broken)


def parse_srt(docs: DataFrame) -> DataFrame:
    """(doc, text) SRT documents to cues; the id counts blocks, also dropped ones."""
    content = F.replace(F.regexp_replace("text", "^﻿", ""), F.lit("\r\n"), F.lit("\n"))
    blocks = F.split(F.regexp_replace(content, r"\A\s+|\s+\z", ""), r"\n\s*\n")
    rows = docs.select("doc", F.posexplode(blocks).alias("n", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True)
    clock = r"(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d{1,2}:\d{2}:\d{2}[,.]\d{1,3})"
    timed = rows.withColumn("lines", lines).withColumn("at", at.cast("int")).where("at > 0")
    line = F.get("lines", F.col("at") - 1)
    rest = F.trim(F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.lit(0), F.size("lines") - F.col("at"))), " "))
    return timed.select(
        "doc", (F.col("n") + 1).cast("long").alias("cue_id"), rest.alias("text"),
        TC.parse_srt_time(F.nullif(F.regexp_extract(line, clock, 1), F.lit(""))).alias("start_time"),
        TC.parse_srt_time(F.nullif(F.regexp_extract(line, clock, 2), F.lit(""))).alias("end_time"),
        F.lit(1.0).alias("confidence"), F.lit("reference").alias("source"),
    ).where("text <> '' and start_time is not null and end_time is not null")


def parse_asr(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, text) speech worker payloads to (cues, errors)."""
    p = docs.withColumn("v", F.try_parse_json("text"))
    ok = F.coalesce(F.try_variant_get("v", "$.ok", "boolean"), F.lit(False))
    message = F.concat_ws(": ", F.coalesce(F.try_variant_get("v", "$.error_type", "string"), F.lit("WorkerError")),
                          F.coalesce(F.try_variant_get("v", "$.error", "string"), F.lit("invalid payload")))
    errors = p.where(~ok).select("doc", message.alias("error"))
    rows = p.where(ok).select("doc", F.posexplode(F.try_variant_get("v", "$.subtitles", "array<variant>")).alias("n", "item"))
    item = F.col("item")
    words = F.coalesce(
        F.try_variant_get(item, "$.words", "array<struct<word:string,start:double,end:double,confidence:double>>"),
        F.array().cast("array<struct<word:string,start:double,end:double,confidence:double>>"),
    )
    cues = rows.select(
        "doc", F.concat(F.lit("audio-"), F.col("n").cast("string")).alias("cue_id"),
        first_present(item, ("text",)).alias("text"), number(first_present(item, ("start", "start_time"))).alias("start_time"),
        number(first_present(item, ("end", "end_time"))).alias("end_time"), words.alias("words"),
        number(first_present(item, ("confidence",))).alias("confidence"),
    )
    return cues, errors


def parse_tasks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Task documents, a list or {tasks: []}, to (tasks, rejects); every task needs an id."""
    v = F.col("v")
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.tasks", "array<variant>"))
    rows = docs.withColumn("v", F.try_parse_json("text")).select("doc", F.posexplode(items).alias("n", "item"))
    get = lambda *keys: first_present(F.col("item"), keys)
    whole = lambda *keys: number(get(*keys)).cast("long")
    size = lambda key: F.coalesce(F.size(F.try_variant_get("item", f"$.{key}", "array<variant>")), F.lit(0))
    tasks = rows.select(
        "doc", "n", get("id").alias("id"), get("filename").alias("filename"), get("status").alias("status"),
        get("analysisMode").alias("analysis_mode"), get("visualStatus").alias("visual_status"), get("audioStatus").alias("audio_status"),
        whole("visualProgress").alias("visual_progress"), whole("audioProgress").alias("audio_progress"), whole("progress").alias("progress"),
        get("visualError").alias("visual_error"), get("audioError").alias("audio_error"), whole("revision").alias("revision"),
        *[F.coalesce(whole(f"{k}Count"), size(f"{k}s").cast("long")).alias(c) for k, c in
          (("subtitle", "subtitle_count"), ("visualSubtitle", "visual_count"), ("audioSubtitle", "audio_count"))],
        *[get(k).try_cast("timestamp").alias(c) for k, c in
          (("archivedAt", "archived_at"), ("createdAt", "created_at"), ("updatedAt", "updated_at"))],
    )
    missing = F.coalesce("id", F.lit("")) == ""
    return tasks.where(~missing).drop("n"), tasks.where(missing).select("doc", "n", F.lit("id").alias("rule"))


def parse_jobs(docs: DataFrame) -> DataFrame:
    """One job per document; unreadable ones are skipped."""
    get = lambda *keys: first_present(F.col("v"), keys)
    return docs.withColumn("v", F.try_parse_json("text")).where("v is not null").select(
        "doc", get("task_id").alias("id"), get("kind").alias("kind"), get("status").alias("status"), get("run_id").alias("run_id"),
        number(get("progress")).alias("progress"), get("message").alias("message"),
        F.coalesce(F.try_variant_get("v", "$.completion_pending", "boolean"), F.lit(False)).alias("completion_pending"),
        F.coalesce(F.try_variant_get("v", "$.recovery_pending", "boolean"), F.lit(False)).alias("recovery_pending"),
    ).where("id is not null")


def _event_rows(raw: DataFrame, path: str = "_metadata.file_path", *more: str) -> DataFrame:
    """Good events whose ids agree with their place: ``<task>/<run>.jsonl`` or ``task=<task>/run=<run>/part-*``."""
    path = F.col(path)
    parts = r"task=([^/]+)/run=([^/]+)/[^/]+$"
    placed = path.rlike(parts)
    tagged = raw.select(
        *[F.col(f.name) for f in EVENT_SCHEMA], *more,
        F.when(placed, F.regexp_extract(path, parts, 1)).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("_task"),
        F.when(placed, F.regexp_extract(path, parts, 2)).otherwise(F.regexp_extract(path, r"([^/]+)\.jsonl?$", 1)).alias("_run"),
    )
    own_place = (F.col("task_id") == F.col("_task")) & (F.col("run_id") == F.col("_run"))
    return tagged.where(F.col("_corrupt").isNull() & well_formed() & own_place).drop("_corrupt", "_task", "_run")


def _in_file_order(raw: DataFrame) -> DataFrame:
    """Add ``_position``: a number that grows along a run's files, in the order they were appended, and their lines.

    Within a split rows come in order, a row has at least one byte, and a split tells where in its file it starts; so
    the start plus the number of rows before it in the split is increasing. Files of one append share a name part.
    """
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
                      F.col("_metadata.file_modification_time").alias("_saved"), F.monotonically_increasing_id().alias("_row"))
    splits = rows.groupBy("_file", "_from").agg(F.min("_row").alias("_first"), F.min("_saved").alias("_saved"))
    files = splits.groupBy("_file").agg(F.min("_saved").alias("_saved")).select(
        "_file", "_saved", F.regexp_extract("_file", r"^(.*)/[^/]*$", 1).alias("_folder"),
        F.coalesce(F.nullif(F.regexp_extract("_file", r"part-\d+-([0-9a-f\-]{36})", 1), F.lit("")), F.col("_file")).alias("_append"))
    appended = Window.partitionBy("_folder", "_append")
    order = Window.partitionBy("_folder").orderBy("_appended", "_append", "_file")
    ranked = files.withColumn("_appended", F.min("_saved").over(appended)).select("_file", F.row_number().over(order).alias("_rank"))
    start = splits.select("_file", "_from", "_first").join(ranked, "_file")
    place = F.col("_rank") * F.lit(1 << 42) + F.col("_from") + F.col("_row") - F.col("_first")
    return rows.drop("_saved").join(start, ["_file", "_from"]).withColumn("_position", place)


def read_event_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events under ``folder``, one file or one folder of parts per run.

    Bad and misplaced rows are dropped, and so is a row whose number does not exceed all earlier ones of its file order.
    """
    raw = spark.read.schema(EVENT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").option(
        "recursiveFileLookup", "true").json(folder)
    return keep_increasing(_event_rows(_in_file_order(raw), "_file", "_position"), "_position").drop("_position")


def stream_event_log(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same rows as a stream; a torn last line does not hide the good ones."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").option(
        "recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return _event_rows(raw)


def increasing_events(log: DataFrame, position: str) -> DataFrame:
    return keep_increasing(log, position)


def read_truth(spark: SparkSession, path: str):
    return parse_truth(documents(spark, path))


def read_predictions(spark: SparkSession, path: str, fps: DataFrame):
    return parse_predictions(documents(spark, path), fps)


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(documents(spark, path))


def read_asr(spark: SparkSession, path: str):
    return parse_asr(documents(spark, path))


def read_tasks(spark: SparkSession, path: str):
    return parse_tasks(documents(spark, path))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return parse_jobs(documents(spark, path))
