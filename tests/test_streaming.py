"""Streams replayed to the end give the rows of their batch twins."""

import time

import pytest
from pyspark.sql import functions as F

from captrail.functions import text as TX
from captrail.operators import eventlog as EL
from captrail.operators import tasks as TK
from captrail.operators import tracks as TR
from captrail.plans import operations as OP
from captrail.sources import readers as RD
from captrail.sources.tables import load
from captrail.streaming import progress as ST


@pytest.fixture(autouse=True)
def only_batches_with_data(spark):
    """Else a stream with timers never runs out of batches."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def replay(spark, df, folder, transform, name, files=3, order="seq"):
    """Write ``df`` as ordered files, stream them one by one, return the collected rows."""
    schema = df.schema
    n = files
    cuts = df.approxQuantile(order, [i / n for i in range(1, n)], 0.0) if n > 1 else []
    low = None
    for i, high in enumerate([*cuts, None]):
        part = df
        if low is not None:
            part = part.where(F.col(order) > low)
        if high is not None:
            part = part.where(F.col(order) <= high)
        part.coalesce(1).write.mode("append").parquet(str(folder))
        low = high
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
        return spark.sql(f"select * from {name}").collect()
    finally:
        query.stop()


def rows(df):
    return sorted(map(str, df if isinstance(df, list) else df.collect()))


@pytest.fixture(scope="module")
def events(spark, data):
    return OP.progress(spark, data).where("task_id in ('task-0', 'task-3', 'task-7')").withColumns(
        {"seq": F.col("seq").cast("long"), "occurred_at": F.col("occurred_at").cast("timestamp")}
    )


def test_dedupe(spark, events, tmp_path):
    doubled = events.unionByName(events.where("seq % 2 = 0"))
    got = replay(spark, doubled, tmp_path / "in", lambda s: ST.dedupe_events(ST.clean_events(s), "60 days"), "dedupe")
    assert rows(got) == rows(events)


def test_monotone_drops_stale(spark, events, tmp_path):
    stale = events.where("seq % 5 = 0").withColumn("occurred_at", F.col("occurred_at") + F.expr("interval 1 second"))
    got = replay(spark, events.unionByName(stale), tmp_path / "in", ST.monotone, "monotone", files=1)
    assert rows(got) == rows(events)


def test_progress_state_equals_batch(spark, events, tmp_path):
    got = replay(spark, events, tmp_path / "in", ST.progress_state_stream, "state")
    last = {}
    for r in got:
        last[r["run_id"]] = max(last.get(r["run_id"], r), r, key=lambda x: x["last_seq"])
    want = EL.progress_state(events).withColumn("thumbnails", F.array_join("thumbnails", ",")).collect()
    fields = ("last_seq", "stage", "label", "message", "progress", "stage_progress", "processed", "total", "cue_count", "terminal", "failure",
              "frame_seq", "preview_seq", "thumbnails")
    assert {r["run_id"]: tuple(r[f] for f in fields) for r in want} == {k: tuple(r[f] for f in fields) for k, r in last.items()}


def test_readers_resume_as_in_batch(spark, events, tmp_path):
    runs = events.groupBy("task_id", "run_id").agg(F.max("seq").alias("latest"), F.lit("2100-01-01").cast("timestamp").alias("occurred_at"))
    ask = runs.select("task_id", F.when(F.col("latest") % 3 != 0, F.col("run_id")).alias("run_id"), (F.col("latest") % 2 * 100000 + 7).alias("seq"), "occurred_at", F.col("run_id").alias("reader"))
    both = events.select("task_id", "run_id", "seq", "occurred_at", F.lit(None).cast("string").alias("reader")).unionByName(ask)
    got = replay(spark, both, tmp_path / "in", ST.resume_stream, "resume", files=1)
    want = EL.resume_cursors(ask, events).select("task_id", "reader", "run", "after", "reset").collect()
    assert sorted((r.task_id, r.reader, r.run, r.after, r.reset) for r in got) == sorted(map(tuple, want)) and any(r.reset for r in got) and any(not r.reset for r in got)


def test_single_terminal(spark, events, tmp_path):
    got = replay(spark, events, tmp_path / "in", ST.single_terminal, "terminal")
    ends = [r for r in got if r["type"] in EL.TERMINAL_TYPES]
    want = EL.first_terminal(events).collect()
    assert sorted((r["run_id"], r["seq"]) for r in ends) == sorted((r["run_id"], r["seq"]) for r in want)


def test_rate_limit_equals_batch(spark, events, tmp_path):
    p = events.select("task_id", F.lit("r").alias("run_id"), "seq", (F.col("seq") / 20).alias("at"), (F.col("seq") % 9 == 0).alias("evidence"))
    got = replay(spark, p, tmp_path / "in", lambda s: ST.rate_limit_stream(s, 3.0), "limit")
    assert rows(got) == rows(EL.rate_limit(p, 3.0))
    assert len(got) < p.count()


def test_stalled_equals_batch(spark, events, tmp_path):
    polls = events.select("task_id", F.lit("r").alias("run_id"), (F.col("seq") * 2).cast("double").alias("at"),
                          (F.col("seq") - F.col("seq") % 200).alias("cursor"), (F.col("seq") % 3 == 0).alias("ok"))
    got = replay(spark, polls, tmp_path / "in", lambda s: ST.stalled_runs_stream(s, 300.0, 50), "stalls", order="at")
    assert rows(got) == rows(EL.stalled_runs(polls, 300.0, 50)) and got


def test_edits_equal_batch(spark, data, tmp_path):
    tasks = load(spark, data, "tasks").where("task_no < 60")
    edits = load(spark, data, "edits").where("task_no < 60").join(
        tasks.select("task_no", F.col("revision").cast("long").alias("revision")), "task_no"
    ).withColumn("at", F.unix_micros(F.col("arrival_ts").cast("timestamp")))
    got = replay(spark, edits, tmp_path / "in", ST.edit_decisions, "edits", order="at")
    want = TK.replay_edits(tasks, load(spark, data, "edits").where("task_no < 60"))
    assert rows(got) == rows(want)


def test_association_equals_batch(spark, data, tmp_path):
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    obs = load(spark, data, "obs").where("video_id = 3").withColumn("cand_no", F.col("cand_no").cast("long")).dropDuplicates(["ts", "cand_no"])
    timed = obs.withColumn("seen_at", F.timestamp_micros((F.col("ts") * 1000000 + 10**9).cast("long")))
    flush = timed.limit(1).withColumns({"ts": F.lit(1e6), "seen_at": F.timestamp_micros(F.lit(10**13)), "video_id": F.lit(999).cast("long")})
    got = replay(spark, timed.unionByName(flush), tmp_path / "in",
                 lambda s: ST.associate_stream(s.withWatermark("seen_at", "1 second")), "tracks", order="ts", files=4)
    want = TR.associate_tracks(obs).collect()

    def groups(rs):
        out = {}
        for r in rs:
            if r["video_id"] == 3:
                out.setdefault((r["lines"], r["session_id"], r["track_no"]), []).append((r["ts"], r["cand_no"]))
        return sorted(sorted(v) for v in out.values())

    assert sorted(x for g in groups(got) for x in g) == sorted(x for g in groups(want) for x in g)
    assert groups(got) == groups(want)


def test_snapshot_sink(spark, events, tmp_path):
    folder = tmp_path / "in"
    for i in range(2):
        events.where(f"seq % 2 = {i}").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = ST.snapshot_sink(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 1).start()
    query.processAllAvailable()
    query.stop()
    store = ST.SnapshotStore(spark, str(tmp_path / "out"))
    pick = lambda df: sorted((r["task_id"], r["run_id"], r["latest_event"]["seq"]) for r in df.collect())
    assert pick(store.read()) == pick(EL.latest_snapshot(events))


def test_snapshot_store_survives_broken_and_repeated_batches(spark, events, tmp_path):
    store = ST.SnapshotStore(spark, str(tmp_path))
    pick = lambda df: sorted((r["task_id"], r["run_id"], r["latest_event"]["seq"]) for r in df.collect())
    assert store.read() is None
    store.merge(events.where("task_id = 'task-0'"), 0)
    first, before = pick(store.read()), store.current()
    store.merge(events.where("task_id = 'task-3'"), 0)
    assert store.current() == before and pick(store.read()) == first, "a repeated batch changes nothing"
    (tmp_path / "data" / "1-broken" / "bucket=3").mkdir(parents=True)
    (tmp_path / "manifest" / "batch=1").mkdir()
    assert pick(store.read()) == first, "a batch without its manifest does not count"
    store.merge(events.where("task_id <> 'task-0'"), 1)
    assert pick(store.read()) == pick(EL.latest_snapshot(events))
    kept = [b for b, f in before[1].items() if store.current()[1][b] == f]
    assert len(kept) == len(before[1]), "buckets without new events keep their folders"


def wait_for(found, seconds=90):
    end = time.time() + seconds
    while not (out := found()) and time.time() < end:
        time.sleep(0.5)
    return out


def started(spark, stream, name):
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="1 second").start()


def test_a_silent_run_is_reported_once(spark, tmp_path):
    schema = "task_id string, run_id string, at double, cursor long, ok boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("t", "quiet", 0.0, 1, True), ("t", "quiet", 1.0, 2, True), ("t", "failing", 0.0, 1, False), ("t", "failing", 1.0, 1, False)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = started(spark, ST.stalled_runs_stream(stream, 4.0, 2), "silent")
    try:
        told = lambda: sorted((r.run_id, r["at"], r.cursor, r.reason) for r in spark.sql("select * from silent").collect())
        want = [("failing", 1.0, 1, "errors"), ("quiet", 5.0, 2, "silent")]
        assert wait_for(lambda: told() == want), told()
        put([("t", "quiet", 2.0, 3, True), ("t", "failing", 3.0, 1, False)])
        time.sleep(8)
        assert told() == want
    finally:
        query.stop()


def test_state_goes_after_the_end_and_the_time_to_live(spark, events, tmp_path):
    put = lambda df: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(events)
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = started(spark, ST.single_terminal(stream, live=20.0, linger=3.0), "released")
    try:
        held = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert wait_for(lambda: held() and max(held()) > 0) and wait_for(lambda: held()[-1] == 0), held()
        ends = spark.sql("select * from released where type in ('job.completed', 'job.failed')").count()
        assert ends == EL.first_terminal(events).count() > 0
    finally:
        query.stop()


def test_torn_log_line_is_isolated(spark, tmp_path):
    run = "a" * 32
    folder = tmp_path / "log" / "t1"
    folder.mkdir(parents=True)
    line = '{"task_id":"t1","run_id":"%s","seq":%d,"type":"stage.progress","occurred_at":"2024-01-01T00:00:0%dZ","payload":"{}","progress":1,"message":"m"}'
    text = "\n".join([line % (run, 1, 1), line % (run, 2, 2), line % (run, 2, 3), line % ("b" * 32, 9, 4), '{"task_id":"t1","seq'])
    (folder / f"{run}.jsonl").write_text(text)
    got = RD.read_event_log(spark, str(tmp_path / "log"))
    assert sorted(r["seq"] for r in got.collect()) == [1, 2]
    query = RD.stream_event_log(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("torn").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["seq"] for r in spark.sql("select * from torn").collect()) == [1, 2, 2]
