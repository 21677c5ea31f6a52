"""Files written by the sinks read back as the rows they came from."""

import glob
import json

from pyspark.sql import functions as F

from captrail.operators import evaluate as EV
from captrail.operators import eventlog as EL
from captrail.plans import operations as OP
from captrail.sources import readers as RD
from captrail.sources import writers as WR
from captrail.sources.tables import cues


def test_srt_parts_make_a_document(spark, data, tmp_path):
    c = cues(spark, data).where("video_id < 3")
    WR.write_srt(c, str(tmp_path / "srt"))
    for video in (0, 1, 2):
        parts = sorted(glob.glob(str(tmp_path / "srt" / f"video_id={video}" / "part-*")))
        text = "\n".join(open(p, newline="").read().rstrip("\n") + "\n" for p in parts)
        docs = spark.createDataFrame([(str(video), text)], "doc string, text string")
        got = RD.parse_srt(docs).select("start_time", F.col("text")).collect()
        want = c.where(f"video_id = {video}").select("start_time", F.regexp_replace("text", r"\s+", " ")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_cue_json_is_ordered(spark, data, tmp_path):
    c = cues(spark, data).where("video_id = 1")
    WR.write_cues_json(c, str(tmp_path / "json"))
    parts = sorted(glob.glob(str(tmp_path / "json" / "video_id=1" / "part-*")))
    rows = [json.loads(line) for p in parts for line in open(p)]
    assert [r["number"] for r in rows] == list(range(1, c.count() + 1))


def test_events_append_with_continued_numbers(spark, data, tmp_path):
    path = str(tmp_path / "log")
    e = OP.progress(spark, data).where("task_id = 'task-1'").select("task_id", "run_id", "seq", "type", "message")
    old, new = e.where("seq % 2 = 0"), e.where("seq % 2 = 1")
    WR.append_events(old, path)
    stored = RD.read_event_log(spark, path)
    numbered = EL.assign_seq(new.withColumnRenamed("seq", "position"), stored, "position").drop("position")
    WR.append_events(numbered, path)
    want = old.unionByName(numbered).select("task_id", "run_id", "seq", "type", "message").collect()
    got = RD.read_event_log(spark, path).select("task_id", "run_id", "seq", "type", "message").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == e.count()


def test_log_keeps_numbers_that_grow_along_the_file(spark, tmp_path):
    run = "a" * 32
    folder = tmp_path / "log" / "t1"
    folder.mkdir(parents=True)
    rows = [{"task_id": "t1", "run_id": run, "seq": s, "type": "stage.progress", "message": m} for s, m in
            [(1, "first"), (3, "kept"), (2, "late"), (3, "again"), (5, "kept"), (4, "late"), (6, "last")]]
    (folder / f"{run}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{torn")
    got = RD.read_event_log(spark, str(tmp_path / "log")).orderBy("seq").collect()
    assert [(r.seq, r.message) for r in got] == [(1, "first"), (3, "kept"), (5, "kept"), (6, "last")]


def test_report_covers_both_sides_and_is_written_by_section(spark, tmp_path):
    event = "video_id int, idx long, text string, start_frame long, end_frame long, tier string, uncertainty long"
    truth = spark.createDataFrame([(1, 0, "A", 0, 9, "A", 0), (1, 1, "B", 10, 19, "A", 0), (2, 0, "C", 0, 9, "B", 1)], event)
    pred = spark.createDataFrame([(1, 0, "a", 0, 9), (1, 1, "x\ny", 30, 39), (3, 0, "only", 5, 6)], "video_id int, idx long, text string, start_frame long, end_frame long")
    match = spark.createDataFrame([(1, 0, 0, 1.0, True, 1.0)], "video_id int, truth_idx long, pred_idx long, similarity double, exact boolean, temporal_iou double")
    videos = spark.createDataFrame([(1, 25.0)], "video_id int, fps double")
    sections = EV.report_sections(truth, pred, match, videos)
    summary = {r.video_id: (r.fps, r.truth, r.prediction, r.matched, r.false_positive, r.false_negative) for r in sections["summary"].collect()}
    assert summary == {1: (25.0, 2, 2, 1, 1, 1), 2: (30.0, 1, 0, 0, 0, 1), 3: (30.0, 0, 1, 0, 1, 0)}
    lines = {v: [r.line for r in EV.report_lines(sections["summary"], sections["false_positives"], sections["false_negatives"]).orderBy("line_no").collect() if r.video_id == v] for v in (1, 2, 3)}
    assert lines[1][5:] == ["  Tier A: matched=1/2 exact_both=1/2 result=FAIL", "  False positives (1):", "    [1] 30-39 x\ny", "  False negatives (1):", "    [1] 10-19 B"]
    assert lines[2][6:] == ["  False positives (0):", "    (none)", "  False negatives (1):", "    [0] 0-9 C"]
    assert lines[3][6:] == ["  False positives (1):", "    [0] 5-6 only", "  False negatives (0):", "    (none)"]
    WR.write_report(sections, str(tmp_path))
    read = lambda name: spark.read.json(str(tmp_path / name)).collect()
    assert [(r.truth_idx, r.matched, r.exact_both) for r in read("tier_a")] == [(0, True, True), (1, False, False)]
    assert [(r.truth_normalized, r.pred_normalized) for r in read("matches")] == [("a", "a")] and len(read("summary")) == 3 and len(read("false_positives")) == 2
