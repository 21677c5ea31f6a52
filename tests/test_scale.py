"""Steps whose work must follow the rows, checked in plans and counts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from captrail.config import CaptionConfig
from captrail.functions import pybox as B
from captrail.functions import similarity as SIM
from captrail.operators import compose as CO
from captrail.operators import evaluate as EV
from captrail.operators import fusion as FU
from captrail.operators import refine
from captrail.operators import tracks as TR
from captrail.operators.folds import plain
from captrail.operators.ordered import ordered
from captrail.sources import readers as RD


def plan(df):
    return df._jdf.queryExecution().toString()


def test_next_seen_never_looks_to_the_end(spark):
    """A window frame from the row to the end of its chunk costs the square of the chunk."""
    rows = spark.range(40).select((F.col("id") % 2).alias("key"), "id", F.when(F.col("id") % 7 < 2, F.col("id")).alias("v"))
    out = ordered(rows, ["key"], ["id"], F.floor(F.col("id") / 10), next_seen={"n": "v"})
    assert "unboundedfollowing" not in plan(out).lower().replace(" ", "").replace("$()", "")
    have = {r.id: r.n for r in out.collect()}
    given = [k for k in range(40) if k % 7 < 2]
    assert have == {k: min((g for g in given if g >= k and g % 2 == k % 2), default=None) for k in range(40)}


def test_text_of_a_candidate_is_derived_once(spark):
    """The rules of a caption share one value of the text, however it came about."""
    rows = spark.createDataFrame([(t, 0.9, 300, 400, 700, 440) for t in ("GOLDEN HARVEST", "  ab ", "12:30", "5 m", "quiet 7 s", None)],
                                 "raw string, confidence double, x1 int, y1 int, x2 int, y2 int")
    obs = rows.withColumn("text", F.reverse(F.reverse("raw"))).drop("raw")
    out = CO.filter_candidates(obs, *(F.lit(v) for v in (1000, 600, 0, 200)), CaptionConfig(min_ocr_confidence=0.8))
    condition = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line)
    assert condition.count("reverse(reverse(") <= 2  # one in the condition, one in a null check inferred from it
    assert [r.text for r in out.collect()] == ["GOLDEN HARVEST"]


def test_frames_without_rivals_are_composed_from_batch_masks(monkeypatch):
    """Pairs are picked for a whole batch; only frames in which boxes cover each other are looked at one by one."""
    rng = np.random.default_rng(4)
    groups = [[(int(x), int(y), int(x) + 60, int(y) + 30) for x, y in rng.integers(0, 90, (k % 5, 2))] for k in range(40)]
    pairs, begin = B.BoxPairs.within(groups)
    n = np.array([len(g) for g in groups])
    found = CO._pairs(pairs.cover >= 0.3, begin, n)
    for k, g in enumerate(groups):
        square = (pairs.cover >= 0.3)[begin[k]: begin[k + 1]].reshape(len(g), len(g))
        assert found.get(k, []) == [tuple(p) for p in np.argwhere(np.triu(square, 1)).tolist()]
    monkeypatch.setattr(CO, "Frame", None)
    apart = [CO.Line("left", 0.9, (0, 0, 50, 20)), CO.Line(" low ", 0.8, (400, 300, 480, 330))]
    assert [(x.text, x.conf) for x in CO.compose_frames([apart, apart[:1]])[0]] == [("left", 0.9), ("low", 0.8)]


def test_plain_values_equal_those_of_arrow():
    columns = [pa.array([1, None, 3]), pa.array([1, 2, 3], pa.int32()), pa.array([0.5, float("inf"), -1.0]), pa.array(["a", None, "ü"]),
               pa.array([True, False, None]), pa.array([{"x": 1}, None, {"x": 2}]), pa.array([[1], [], None])]
    for column in columns:
        got, want = plain(column), column.to_pylist()
        assert got == want and [type(x) for x in got] == [type(x) for x in want]


def test_scores_are_shared_by_all_groups(monkeypatch):
    """Two groups with the same captions ask the matcher once, and not at all where shared letters rule a match out."""
    asked = []
    monkeypatch.setattr(TR, "caption_score", lambda a, b: asked.append((a, b)) or SIM.caption_score(a, b))
    TR.known_score.cache_clear()
    seen = [("golden harvest", 0.0), ("golden harvets", 0.5), ("wxyz wxyz wxyz", 1.0)]
    for _ in range(2):
        fold = TR.Association(CaptionConfig())
        out = []
        for k, (text, ts) in enumerate(seen):
            out += fold.push({"video_id": 1, "session_id": 0.0, "lines": 0, "band": 0, "ts": ts, "cand_no": k, "text": text,
                              "confidence": 0.9, "x1": 0, "y1": 0, "x2": 200, "y2": 40})
        out += fold.finish()
        assert [r["track_no"] for r in out] == [0, 0, 1]
    TR.known_score.cache_clear()
    assert asked == [("golden harvest", "golden harvets")]


def test_bounded_scores_lose_no_match():
    rng = np.random.default_rng(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice(list("abc d"), rng.integers(0, 9))) for _ in range(2))
        full, got = SIM.caption_score(a, b), TR.known_score(a, b, 0.68)
        assert got == full or (got == 0 and full < 0.68)


def test_a_prediction_document_is_parsed_once(spark):
    """The text of a document is parsed in one place of the plan, not in every condition on what it holds."""
    docs = spark.createDataFrame([("a", '[{"text": "x", "first_frame": 3, "last_frame": 5}, {"text": " "}, {"text": "y", "start_time": 1.0, "end_time": 2.0}]'),
                                  ("b", '{"items": [{"text": "z", "first_frame": 9, "last_frame": 2}]}'), ("c", "none")], "doc string, text string")
    good, bad = RD.parse_predictions(docs, docs.select("doc", F.lit(30.0).alias("fps")))
    lines = good._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum(line.count("parse_json") + line.count("parseJson") for line in lines) <= 1
    assert sorted((r.doc, r.idx, r.raw_idx, r.text, r.start_frame, r.end_frame) for r in good.collect()) == [("a", 0, 0, "x", 3, 5), ("a", 1, 2, "y", 30, 59)]
    assert sorted(((r.doc, r.idx, r.rule) for r in bad.collect()), key=str) == [("a", 1, "text"), ("b", 0, "frames"), ("c", None, "document")]


def test_multiline_rows_alone_are_not_folded(spark):
    """The fold sees rows that start close to others, once; the result is that of folding them all."""
    starts = [0, 1, 9, 20, 21, 22, 50, 70, 70, 90, 120, 121]
    rows = [(v, i, f"t{i}", s, s + 8, (10.0, 60.0 * (i % 2), 200.0, 60.0 * (i % 2) + 50) if i % 5 else None) for v in (1, 2) for i, s in enumerate(starts[v - 1:])]
    pred = spark.createDataFrame(rows, "video_id long, idx long, text string, start_frame long, end_frame long, box struct<x1:double,y1:double,x2:double,y2:double>")
    out = EV.merge_multiline(pred, spark.createDataFrame([(1, 30.0)], "video_id long, fps double"))
    assert "MapInArrow" not in plan(out)
    want = []
    for v in (1, 2):
        fold, done = EV.MultilineMerge(), []
        for w, i, text, start, end, box in rows:
            if w == v:
                given = {"text": text, "start_frame": start, "end_frame": end, "box": dict(zip(("x1", "y1", "x2", "y2"), box)) if box else None, "sources": [i], "fps": 30.0}
                done.extend(fold.push(given))
        want += [(v, k, r["text"], r["start_frame"], r["end_frame"], r["sources"]) for k, r in enumerate([*done, *fold.finish()])]
    got = sorted((r.video_id, r.idx, r.text, r.start_frame, r.end_frame, r.sources) for r in out.collect())
    assert got == want and any(len(r[-1]) > 1 for r in got) and any(len(r[-1]) == 1 for r in got)


def test_plain_structs_and_lists():
    kind = pa.list_(pa.struct([("k", pa.string()), ("v", pa.float64()), ("b", pa.bool_())]))
    values = [[{"k": "a", "v": 1.0, "b": True}, None], None, [], [{"k": None, "v": None, "b": False}], [{"k": "é", "v": 2.5, "b": None}]]
    column = pa.array(values, kind)
    for a in range(6):
        for n in range(6 - a):
            assert plain(column.slice(a, n)) == values[a:a + n]
    boxes = pa.array([{"x": 1, "y": [1, 2]}, None, {"x": None, "y": None}])
    assert plain(boxes) == boxes.to_pylist() and plain(boxes.slice(1)) == boxes.to_pylist()[1:]


def test_segments_are_split_a_few_at_a_time():
    """The words of a batch of segments are never Python objects all at once."""
    word = lambda i, k: {"word": f" w{i % 7}{'.' * (k % 9 == 8)}", "start": 0.3 * k, "end": 0.3 * k + 0.25, "confidence": 0.5 if k % 4 else None}
    segments = [[word(i, k) for k in range(i % 61)] if i % 13 else None for i in range(1500)]
    kind = pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("confidence", pa.float64())]))
    column = pa.array(segments, kind)
    want = pa.array([None if s is None else FU.split_words(s) for s in segments], FU.split_segments(column).type)
    tracemalloc.start()
    got = FU.split_segments(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(want) and peak < 4e6
    assert FU.split_segments(column.slice(0, 0)).to_pylist() == []


def test_refined_bounds_deal_events_once(spark, monkeypatch):
    """Close windows of an event are one row, far ones two; pairs are stored once, not joined again for the result."""
    rng = random.Random(12)
    obs = [(1, f, f / 2, rng.choice(["red door open", "blue road", "tall tree"]), 0, 0, 100, 50) for f in range(200)]
    events = [(1, k, rng.choice(["red door open", "blue road"]), float(a), a + d, None) for k, (a, d) in enumerate(
        (rng.randrange(0, 190) / 2, rng.choice([0.0, 0.5, 1.0, 40.0])) for _ in range(60))]
    o = spark.createDataFrame(obs, "video_id long, frame_index long, ts double, text string, x1 int, y1 int, x2 int, y2 int")
    e = spark.createDataFrame(events, "video_id long, cue_id long, text string, start_time double, end_time double, box struct<x1:int,y1:int,x2:int,y2:int>")
    videos = spark.createDataFrame([(1, 100.0, 2.0)], "video_id long, duration double, fps double")
    dealt, join = [], refine.points_in_spans
    monkeypatch.setattr(refine, "points_in_spans", lambda spans, *rest: dealt.append(spans.count()) or join(spans, *rest))
    out = refine.refine_boundaries(e, o, videos)
    assert dealt == [sum(2 if b - a > 1.5 else 1 for _, _, _, a, b, _ in events)]
    assert "_ob" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for _, k, text, a, b, _ in events:
        starts = [ts for _, _, ts, t, *_ in obs if t == text and max(0, a - 0.5) <= ts <= min(100, a)]
        ends = [(f + 1) / 2 for _, f, ts, t, *_ in obs if t == text and max(a, b - 0.5) <= ts <= min(100, b)]
        start = min(starts, default=a)
        want[k] = (start, max(start + 0.1, min(max(ends, default=b), 100)))
    got = {r.cue_id: (r.start_time, r.end_time) for r in out.collect()}
    assert got == {k: pytest.approx(v, abs=1e-3) for k, v in want.items()}
