"""Small literal cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from captrail.config import CaptionConfig
from captrail.functions import geometry as G
from captrail.functions import pybox as B
from captrail.functions import text as TX
from captrail.functions import timecode as TC
from captrail.operators import changes as CH
from captrail.operators import compose as CO
from captrail.operators import cues as C
from captrail.operators import evaluate as EV
from captrail.operators import frames as FR
from captrail.operators import fusion as FU
from captrail.operators import refine as RF
from captrail.operators import roi as R
from captrail.operators import tracks as TR


def lines(*rows):
    return [CO.Line(t, c, b) for t, c, b in rows]


def texts(out):
    return [x.text for x in out]


def test_same_baseline_fragments():
    out = CO.compose_frame(lines(("THE FIRST", .96, (100, 100, 300, 150)), ("GADGET", .98, (285, 101, 450, 151))))
    assert texts(out) == ["THE FIRST GADGET"] and out[0].box == (100, 100, 450, 151) and .96 < out[0].conf < .98


def test_token_overlap_join():
    out = CO.compose_frame(lines(("TO WATCH", .9, (100, 100, 310, 155)), ("WATCH", .9, (290, 101, 400, 154)), ("OUT", .9, (390, 100, 475, 156))))
    assert texts(out) == ["TO WATCH OUT"]


def test_nested_alternatives():
    out = CO.compose_frame(lines(("PROTECT YOURSELF", .9, (100, 100, 500, 160)), ("PROTECT", .9, (100, 100, 290, 160)), ("YOURSELF", .9, (300, 100, 500, 160))))
    assert texts(out) == ["PROTECT YOURSELF"]


def test_region_edge_and_baselines():
    out = CO.compose_frame(lines(("IST", .9, (86, 1172, 250, 1288)), ("BASICALLY SIRIUS", .9, (251, 1224, 836, 1319))), (86, 998, 994, 1459))
    assert len(out) == 2
    assert len(CO.compose_frame(lines(("TOP LINE", .9, (100, 100, 350, 150)), ("BOTTOM LINE", .9, (100, 200, 400, 250))))) == 2


def test_stacked_title_and_byline():
    out = CO.compose_frame(lines(("HOW TO PLAY", .98, (120, 1055, 949, 1230)), ("SIRIUS", .98, (319, 1183, 776, 1359)), ("BY AUTHOR", .9, (340, 1402, 745, 1459))))
    assert len(out) == 2 and out[0].text == "HOW TO PLAY\nSIRIUS" and out[0].box == (120, 1055, 949, 1359)


def test_single_detection_is_untouched(spark):
    df = spark.createDataFrame([(1, 0, 0.0, [("a  b", 0.5, 1, 2, 3, 4)])], "video_id int, frame_index int, ts double, candidates array<struct<text:string,confidence:double,x1:int,y1:int,x2:int,y2:int>>")
    assert CO.compose_lines(df).collect()[0]["candidates"][0]["text"] == "a  b"


OBS = "video_id int, ts double, cand_no int, text string, confidence double, x1 int, y1 int, x2 int, y2 int"


def events(spark, rows, cfg, duration=3.0):
    obs = spark.createDataFrame([(1, ts, i, t, c, *box) for i, (ts, t, c, box) in enumerate(rows)], OBS)
    videos = spark.createDataFrame([(1, duration)], "video_id int, duration double")
    return TR.build_events(obs, videos, cfg).orderBy("start_time", "text").collect()


LOW = (100, 500, 500, 550)


def test_progressive_caption_is_one_event(spark):
    rows = [(0.0, "THE SECOND", .9, LOW), (.5, "THE SECOND STAR POWER", .9, LOW), (1.0, "THE SECOND STAR POWER", .9, LOW), (1.5, "IS REALLY GOOD", .9, LOW)]
    out = events(spark, rows, CaptionConfig(text_similarity_threshold=.55, min_event_duration=.2))
    assert [e["text"] for e in out] == ["THE SECOND STAR POWER", "IS REALLY GOOD"]


def test_two_rows_stay_apart_and_single_sample_lasts_one_interval(spark):
    rows = [(t, s, .9, (100, y, 400, y + 50)) for t in (0.0, .5) for s, y in (("TOP ROW", 500), ("BOTTOM ROW", 650))]
    assert len(events(spark, rows, CaptionConfig())) == 2
    one = events(spark, [(8.5, "AND", .9, LOW)], CaptionConfig(), 20.0)[0]
    assert (one["start_time"], one["end_time"]) == (8.5, 9.0)


def test_nested_track_merges(spark):
    full = "PROTECT YOURSELF NOW"
    rows = [(round(.851 + .2 * i, 3), full, .9, LOW) for i in range(4)] + [(1.451, "PROTECT", .8, (100, 500, 300, 550)), (1.468, "PROTECT", .8, (100, 500, 300, 550))]
    out = events(spark, rows, CaptionConfig(sample_fps=5.0))
    assert len(out) == 1 and (out[0]["start_time"], out[0]["end_time"]) == (.851, 1.651)


def test_partitioning_does_not_change_events(spark, data):
    from captrail.plans.tracks import _durations
    from captrail.sources.tables import load

    obs = load(spark, data, "obs").where("video_id < 4")
    videos = _durations(spark, data)
    pick = lambda df: sorted(map(str, df.select("video_id", "text", "start_time", "end_time", "confidence", "box").collect()))
    whole = pick(TR.build_events(obs, videos))
    assert whole == pick(TR.build_events(obs.repartition(7).orderBy(F.rand(3)), videos)) and whole


def test_sessions_equal_whole_video(spark, data):
    """Association per session equals one fold over the whole video."""
    from captrail.sources.tables import load

    obs = load(spark, data, "obs").where("video_id = 2")
    rows = sorted((r.asDict() for r in obs.collect()), key=lambda r: (r["ts"], r["cand_no"]))
    fold, out = TR.Association(CaptionConfig()), []
    for r in rows:
        r |= {"session_id": 0.0, "lines": 0, "band": 0}
        out += list(fold.push(r))
    out += list(fold.finish())

    def groups(rs):
        by = {}
        for r in rs:
            by.setdefault((r["session_id"], r["lines"], r["track_no"]), []).append((r["ts"], r["cand_no"]))
        return sorted(sorted(v) for v in by.values())

    assert groups(out) == groups(r.asDict() for r in TR.associate_tracks(obs).collect())


def test_chunked_windows_equal_plain_windows(spark, data):
    from pyspark.sql import Window

    from captrail.operators.ordered import ordered, time_chunk
    from captrail.sources.tables import cues

    c = cues(spark, data)
    keys, order = ["video_id"], ["start_time", "end_time", "cue_id"]
    odd = F.when(F.col("cue_id") % 9 == 0, F.col("cue_id"))
    got = ordered(
        c, keys, order, time_chunk("start_time", 1.5), lag={"a": "cue_id"}, lead={"b": "text"}, max_before={"m": "end_time"},
        running_sum={"s": F.lit(1)}, last_seen={"l": odd}, next_seen={"n": odd}, number="i",
    ).select("cue_id", "a", "b", "m", "s", "l", "n", "i")
    w = Window.partitionBy(*keys).orderBy(*order)
    full = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = c.select(
        "cue_id", F.lag("cue_id").over(w), F.lead("text").over(w), F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.sum(F.lit(1)).over(full), F.last(odd, True).over(full), F.first(odd, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.row_number().over(w),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_kernel_boxes_equal_columns(spark, data):
    from captrail.sources.tables import load

    df = load(spark, data, "boxes").limit(2000)
    a = G.make_box(*[F.col("a" + c) for c in ("x1", "y1", "x2", "y2")])
    b = G.make_box(*[F.col("b" + c) for c in ("x1", "y1", "x2", "y2")])
    roi = G.make_box(*[F.lit(v) for v in (10, 0, 160, 100)])
    rows = df.select(a.alias("a"), b.alias("b"), G.spatial_compatibility(a, b), G.stacked_line_score(a, b), G.fragments_share_line(a, b, roi), G.box_iou(a, b)).collect()
    for p, q, near, stack, line, iou in rows:
        p, q = tuple(p), tuple(q)
        pair = B.BoxPairs([[p]], [[q]])
        assert B.Spot.of(p).nearness(B.Spot.of(q)) == near and pair.stacked[0, 0] == (-np.inf if stack is None else stack)
        assert pair.on_one_line((10, 0, 160, 100))[0, 0] == line and pair.iou[0, 0] == iou
        assert pair.cover[0, 0] == B.overlap_over_smaller(p, q)


CUE = "video_id int, cue_id int, text string, start_time double, end_time double, confidence double, box struct<x1:int,y1:int,x2:int,y2:int>, source string"


def test_overlap_trim_is_idempotent(spark):
    df = spark.createDataFrame([(1, 1, "A", 0.0, 1.4, .9, LOW, "ocr"), (1, 2, "B", 1.2, 2.5, .9, LOW, "ocr")], CUE)
    once = C.resolve_overlaps(df)
    assert [r["end_time"] for r in once.orderBy("cue_id").collect()] == [1.2, 2.5]
    assert sorted(once.collect()) == sorted(C.resolve_overlaps(once).collect())


def test_boundary_refinement(spark):
    ev = spark.createDataFrame([(1, 1, "HELLO WORLD", 1.0, 1.2, .9, LOW, "ocr")], CUE)
    obs = spark.createDataFrame([(1, i, i / 10, "HELLO WORLD", *LOW) for i in (7, 8, 9, 12, 13, 14)] + [(1, 6, .6, "OTHER TEXT", *LOW)],
                                "video_id int, frame_index int, ts double, text string, x1 int, y1 int, x2 int, y2 int")
    videos = spark.createDataFrame([(1, 3.0, 10.0)], "video_id int, duration double, fps double")
    wide = ev.withColumn("end_time", F.lit(1.5))
    out = RF.refine_boundaries(wide, obs, videos).collect()[0]
    assert (out["start_time"], out["end_time"]) == (.7, 1.5)


def test_speech_never_creates_or_moves_cues(spark):
    ev = spark.createDataFrame([(1, 1, "BUTONMANY", 1.0, 2.0, .8, LOW, "ocr")], CUE)
    asr = spark.createDataFrame([(1, 1, "well but on many other maps", .9, 2.4, .6)], "video_id int, asr_id int, text string, start_time double, end_time double, confidence double")
    out = FU.fuse_asr(ev, asr).collect()
    assert [(r["text"], r["start_time"], r["end_time"], r["source"], r["confidence"]) for r in out] == [("but on many", 1.0, 2.0, "ocr+whisper", .75)]
    assert FU.fuse_asr(ev.where("false"), asr).count() == 0


def test_window_match_bands():
    assert FU.window_match("OTHERMAPS", "in other map today", 2) is None
    assert FU.window_match("OTHERMAPS", "in other maps today", 2) == (1.0, "other maps")
    assert FU.window_match("helo", "well hello there", 1)[1] == "hello"
    assert FU.window_match("completely different", "nothing alike here", 0) is None


def test_asr_segments(spark):
    words = "array<struct<word:string,start:double,end:double,score:double>>"
    shape = f"video_id int, seg_idx int, text string, start double, end double, score double, words {words}"
    al = spark.createDataFrame([(1, 0, "hello world", None, None, None, [("hello", 1.0, 1.5, 1.5), ("world", 1.5, 2.0, -0.2), ("x", 3.0, 2.0, None)]),
                                (1, 1, "next", 3.0, 4.0, .7, [])], shape)
    tr = spark.createDataFrame([(1, 0, "hello world", 1.0, 2.1, None, None)], shape)
    a, b = FU.normalize_asr(al, tr).orderBy("seg_idx").collect()
    assert (a["start_time"], a["end_time"], a["confidence"]) == (1.0, 2.1, .5) and b["confidence"] == .7
    assert [w["confidence"] for w in a["words"]] == [1.0, 0.0, None] and a["words"][2]["start"] is None


def test_evaluation_normal_forms(spark):
    rows = spark.createDataFrame([("HOW TO PLAY /\nSIRIUS", "how to play sirius"), ("Don’t  use-them", "don t use them"), ("ﬁne Straße", "fine strasse")], "t string, n string")
    assert all(r[0] == r[1] for r in rows.select(TX.norm_eval(F.col("t")), "n").collect())


TL = "video_id int, idx int, text string, start_frame int, end_frame int, tier string, uncertainty int"


def test_alignment_prefers_time_among_repeats(spark):
    truth = spark.createDataFrame([(1, 0, "again", 0, 9, "A", 0), (1, 1, "again", 20, 29, "A", 0)], TL)
    pred = spark.createDataFrame([(1, 0, "again", 20, 29, None, 0)], TL)
    out = EV.align_timelines(truth, pred).collect()
    assert [(r["truth_idx"], r["pred_idx"]) for r in out] == [(1, 0)]


def brute_alignment(truth, pred, threshold=.72):
    """Plain quadratic dynamic program over one video."""
    from difflib import SequenceMatcher

    def sim(a, b):
        return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()

    n, m = len(truth), len(pred)
    score = [[(0, 0.0, 0.0, 0)] * (m + 1) for _ in range(n + 1)]
    move = [[None] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            (ta, s1, e1), (tb, s2, e2) = truth[i - 1], pred[j - 1]
            options = [(score[i - 1][j], 1), (score[i][j - 1], 0)]
            v = sim(ta, tb)
            if v >= threshold:
                p = score[i - 1][j - 1]
                inter = max(0, min(e1, e2) - max(s1, s2) + 1) / (max(e1, e2) - min(s1, s2) + 1)
                options.append(((p[0] + 1, p[1] + v, p[2] + inter, p[3] - abs(s1 + e1 - s2 - e2)), 2))
            score[i][j], move[i][j] = max(options)
    out, i, j = [], n, m
    while i and j:
        if move[i][j] == 2:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif move[i][j] == 1:
            i -= 1
        else:
            j -= 1
    return sorted(out)


def test_alignment_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    words = ["alpha", "alphb", "beta", "betta", "gamma", "delta", "deltas", "omega"]
    truth, pred, want = [], [], set()
    for video in range(12):
        sides = []
        for _ in range(2):
            at, rows = 0, []
            for _ in range(rng.randint(1, 14)):
                at += rng.randint(1, 6)
                rows.append((rng.choice(words), at, at + rng.randint(0, 4)))
            sides.append(sorted(rows, key=lambda r: r[1]))
        t, p = sides
        truth += [(video, i, *r, None, 0) for i, r in enumerate(t)]
        pred += [(video, i, *r, None, 0) for i, r in enumerate(p)]
        want |= {(video, i, j) for i, j in brute_alignment(t, p)}
    got = EV.align_timelines(spark.createDataFrame(truth, TL), spark.createDataFrame(pred, TL)).collect()
    assert {(r["video_id"], r["truth_idx"], r["pred_idx"]) for r in got} == want


def test_report_counts_and_empty_side(spark):
    truth = spark.createDataFrame([(1, 0, "a b c", 0, 9, "A", 0), (1, 1, "d e f", 20, 29, "B", 2), (2, 0, "x", 0, 3, "B", 0)], TL)
    pred = spark.createDataFrame([(1, 0, "A B C", 0, 9, None, 0), (1, 1, "d e f", 21, 31, None, 0)], TL).withColumn("box", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"))
    videos = spark.createDataFrame([(1, 10.0), (2, 10.0)], "video_id int, fps double")
    one, two = EV.evaluate_timelines(truth, pred, videos).orderBy("video_id").collect()
    assert (one["matched"], one["precision"], one["recall"], one["start_frame_mae"], one["end_frame_mae"]) == (2, 1.0, 1.0, .5, 1.0)
    assert one["tier_a_passed"] and one["within_uncertainty"] == 2 and one["end_seconds_mae"] == .1
    assert (two["truth"], two["matched"], two["f1"], two["false_negative"]) == (1, 0, 0.0, 1)


def test_multiline_merge(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = [(1, 0, "HOW TO PLAY", 10, 40, (100., 100., 500., 150.)), (1, 1, "SIRIUS", 10, 40, (150., 160., 450., 210.)), (1, 2, "BY AUTHOR", 10, 40, (150., 400., 450., 450.)), (1, 3, "LEFT", 60, 80, None)]
    pred = spark.createDataFrame(rows, f"video_id int, idx int, text string, start_frame int, end_frame int, box {box}")
    out = EV.merge_multiline(pred, spark.createDataFrame([(1, 10.0)], "video_id int, fps double"))
    assert [r["text"] for r in out.orderBy("idx").collect()] == ["HOW TO PLAY / SIRIUS", "BY AUTHOR", "LEFT"]


def test_variable_rate_frames(spark):
    f = spark.createDataFrame([(1, p, 33, 1, 1000) for p in (100, 133, 183, 216)], "video_id int, pts long, duration_pts long, time_base_num long, time_base_den long")
    timed = FR.frame_durations(f)
    assert [r["ts"] for r in timed.orderBy("pts").collect()] == [0.0, .033, .083, .116]
    assert FR.video_metadata(timed).collect()[0]["variable_frame_rate"]
    cue = spark.createDataFrame([(1, 1, "A", .083, .116, .9, None, "ocr")], CUE)
    out = FR.snap_to_frames(cue, timed).collect()[0]
    assert (out["start_frame"], out["end_frame_excl"], out["start_pts"], out["end_pts"]) == (2, 3, 183, 216)


def test_probe_in_short_state(spark):
    scores = spark.createDataFrame([(1, 0, i, 20.0 if i in (2, 4) else 0.0) for i in range(1, 8)], "video_id int, variant int, frame_index long, score double")
    videos = spark.createDataFrame([(1, 10.0)], "video_id int, fps double")
    seen = spark.createDataFrame([(1, 0), (1, 5)], "video_id int, frame_index long")
    iv = CH.stable_intervals(scores, seen, videos, CaptionConfig())
    assert [r["frame_index"] for r in CH.select_probes(CH.merge_variants(iv), seen, videos, 4).collect()] == [2]


def test_region_estimate(spark):
    def sample(rows):
        shape = "video_id int, sample_index int, sample_count int, cand_no long, text string, confidence double, x1 int, y1 int, x2 int, y2 int"
        return spark.createDataFrame([(1, i, 16, 0, t, .9, *b) for i, t, b in rows], shape)

    caption = [(i, f"caption number {i}", (600 + i % 5, 820 + i % 7, 1300, 880 + i % 7)) for i in range(12)]
    out = R.estimate_roi(sample(caption), 1920, 1080).collect()
    assert len(out) == 1 and .7 < out[0]["y"] + out[0]["height"] / 2 < .82
    assert R.estimate_roi(sample([(i, "LOGO", (600, 820, 1300, 880)) for i in range(16)]), 1920, 1080).count() == 0
    assert R.estimate_roi(sample(caption[:2]), 1920, 1080).count() == 0


def test_clock_parsing(spark):
    df = spark.createDataFrame([("00:01:02,250", 62.25), ("00:72.000", None), ("90.5", 90.5), ("61:05", 3665.0), ("1:61:00", None)], "t string, v double")
    assert all(r[0] == r[1] for r in df.select(TC.parse_clock(F.col("t")), "v").collect())
    one = spark.createDataFrame([(62.3456, 3723.456)], "a double, b double").select(TC.srt_time(F.col("a")), TC.clock(F.col("b"))).collect()[0]
    assert tuple(one) == ("00:01:02,346", "01:02:03.456")


@pytest.mark.parametrize("t,want", [(6789.25, 6789), (6789.5, None), (-1.0, None)])
def test_cue_lookup(spark, t, want):
    c = spark.range(10000).select(F.lit(1).alias("video_id"), F.col("id").alias("cue_id"), F.lit("x").alias("text"), F.col("id").cast("double").alias("start_time"), (F.col("id") + 0.5).alias("end_time"))
    p = spark.createDataFrame([(1, t)], "video_id int, t double")
    assert [r["cue_id"] for r in C.cue_at(p, c).collect()] == [want]


def test_fold_is_casefold_for_every_letter(spark):
    texts = [(chr(c) + "A" + chr(c),) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c]
    rows = spark.createDataFrame(texts, "t string").select("t", TX.fold(F.col("t")).alias("f")).collect()
    assert [r.t for r in rows if r.f != r.t.casefold()] == []
    odd = spark.createDataFrame([("ﬁne ΟΔΟΣ ς Straße",)], "t string").select(TX.norm_caption(F.col("t"))).first()[0]
    assert odd == "fine οδοσ σ strasse"


def test_bands_split_association_without_changing_it(spark):
    """Bands of rows give the tracks of one fold over all rows, also where bands move and touch."""
    import random

    rng = random.Random(12)
    rows = []
    for k in range(1500):
        y, h = rng.choice([100, 130, 131, 300, 340, 700, 716]) + rng.randrange(3), rng.choice([0, 8, 30, 40])
        rows.append((1, (k // 6) * 0.5 + (100 if k > 900 else 0), k, rng.choice(["SMALL STAR", "SMALL STAR POWER", "OLD ROAD", "OLD\nROAD"]), 0.5 + rng.randrange(50) / 100, 100, y, 300, y + h))
    obs = spark.createDataFrame(rows, "video_id int, ts double, cand_no long, text string, confidence double, x1 int, y1 int, x2 int, y2 int")
    folds, tracks = {}, {}
    for r in sorted((r.asDict() for r in TR.sessionize(obs).collect()), key=lambda r: (r["ts"], r["cand_no"])):
        key = (r["session_id"], r["text"].count("\n"))
        fold = folds.setdefault(key, TR.Association(CaptionConfig()))
        for done in fold.push(r | {"lines": key[1], "band": 0}):
            tracks.setdefault((*key, done["track_no"]), set()).add(done["cand_no"])
    for key, fold in folds.items():
        for done in fold.finish():
            tracks.setdefault((*key, done["track_no"]), set()).add(done["cand_no"])
    split = {}
    found = TR.associate_tracks(obs).collect()
    for r in found:
        split.setdefault((r["session_id"], r["lines"], r["track_no"]), set()).add(r["cand_no"])
    assert sorted(map(sorted, split.values())) == sorted(map(sorted, tracks.values()))
    banded = TR.bands(TR.sessionize(obs).withColumn("lines", F.lit(0)), ["video_id", "session_id", "lines"])
    assert banded.groupBy("session_id", "band").count().agg(F.max("count")).first()[0] < 500 and banded.count() == 1500


def test_row_support_equals_all_pairs():
    from captrail.operators.cues import _weighted_median, row_reach, row_support

    rng = np.random.default_rng(3)
    for scale in (0.5, 0.1):
        h, cy = rng.integers(1, 60, 400) * scale * 2, rng.integers(0, 600, 400) * scale
        classes = np.unique(np.stack([h, cy], axis=1), axis=0)
        h, cy, w = classes[:, 0], classes[:, 1], rng.integers(1, 10**9, len(classes))
        near = np.abs(cy[None, :] - cy[:, None]) <= row_reach(h[:, None], h[None, :])
        assert (row_support(h, cy, w) == (near * w[None, :]).sum(axis=1)).all()
    v, n = rng.normal(size=9), rng.integers(1, 5, 9)
    assert _weighted_median(v, n) == np.median(np.repeat(v, n))


def test_probes_equal_the_sequential_choice(spark):
    import random

    rng = random.Random(2)
    rows = [(v, f, rng.randrange(5) / 2, rng.randrange(3), float(rng.randrange(4))) for v in (1, 2) for f in rng.sample(range(300), 140)]
    seen = [(1, f) for f in range(0, 300, 9)]
    want = []
    for v, fps, budget in ((1, 100.0, 30), (2, 160.0, 30)):
        taken = []
        for _, f, s, *_ in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[2], -r[3], -r[4], -r[1])):
            if len(taken) < budget and (v, f) not in seen and all(abs(f - t) > max(1, round(fps * 0.02)) for t in taken):
                taken.append(f)
                want.append((v, f, s))
    merged = spark.createDataFrame(rows, "video_id int, frame_index long, strength double, support long, priority double")
    videos = spark.createDataFrame([(1, 100.0), (2, 160.0)], "video_id int, fps double")
    got = CH.select_probes(merged, spark.createDataFrame(seen, "video_id int, frame_index long"), videos, 30)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_summary_of_equal_readings(spark):
    """Readings alike in length, confidence, time and number: the text decides, whatever the order of the rows."""
    seen = "video_id int, session_id long, lines int, track_no long, ts double, cand_no long, text string, confidence double, x1 int, y1 int, x2 int, y2 int"
    row = lambda track, text: (1, 0, 0, track, 1.0, 8, text, 0.8, 0, 0, 9, 9)
    tracks = [row(0, "RED GIZMO"), row(0, "OLD PLATE"), row(1, "OLD PLATE"), row(1, "RED GIZMO")]
    videos = spark.createDataFrame([(1, 9.0)], "video_id int, duration double")
    out = TR.summarize_tracks(spark.createDataFrame(tracks, seen).coalesce(1), videos)
    assert [r.text for r in out.orderBy("track_no").collect()] == ["RED GIZMO", "RED GIZMO"]


def test_clusters_read_their_frames_once(spark):
    """The texts of a frame are gathered once, not in each branch of the score."""
    row = (1, 0, 0, 16, 0.9, 0, 1, "small star", 0.5, 0.5)
    members = spark.createDataFrame([row], "video_id int, cluster_id long, sample_index int, sample_count int, confidence double, x1 int, cand_no long, text string, cx double, cy double")
    scored = R.score_clusters(members)
    assert [r.frame_hits for r in scored.collect()] == [1]
    assert "collect_list" not in scored._jdf.queryExecution().optimizedPlan().toString()
