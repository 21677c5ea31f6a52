"""Text search, sparse alignment, greedy matching and components against brute force."""

import random
import time
import tracemalloc
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from captrail.functions import similarity as SIM
from captrail.functions.similarity import caption_score
from captrail.operators import evaluate as EV
from captrail.operators import refine as RF
from captrail.operators import textjoin
from captrail.operators import components as stars
from captrail.operators.components import components


def texts(rng, n):
    out = [None, "", "a", "e" * 150, "e" * 140, "e" * 300, "日本語字幕", "日本語の字幕", "é😀é😀", "😀é😀"]
    words = ["stone", "river", "lamp", "view", "click", "signup", "zebra", "quiz", "the", "and"]
    for _ in range(n):
        base = "".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) + "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(12)))
        out += [base, "".join(c for c in base if rng.random() > 0.15)]
    return out


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@pytest.mark.parametrize(("threshold", "block", "whole"), [(0.72, 2048, 0), (0.72, 7, 0), (0.9, 2048, 1024), (0.4, 20, 130)])
def test_similar_texts(spark, monkeypatch, threshold, block, whole):
    monkeypatch.setattr(textjoin, "BLOCK", block)
    monkeypatch.setattr(textjoin, "WHOLE", whole)
    monkeypatch.setattr(textjoin, "CELLS", 3000 if block == 7 else 1 << 22)
    rng = random.Random(block)
    some = 2 if whole == 130 else 1  # one key over the bound, one below
    sides = [[(v, t) for v in (1, 2) for t in texts(rng, 60 // (some if v == 1 else 1))] for _ in range(2)]
    for v in (1, 2):
        sides[1] += rng.sample([x for x in sides[0] if x[0] == v], 25)
    left, right = (spark.createDataFrame(s + [(None, "view")], "video_id long, compact string") for s in sides)
    got = {(r.video_id, r.truth_text, r.pred_text): r.similarity for r in EV.similar_texts(left, right, threshold).collect()}
    assert len(got) == EV.similar_texts(left, right, threshold).count()
    for v in (1, 2):
        a, b = ({t for w, t in s if w == v and t} for s in sides)
        want = {(v, x, y): ratio(x, y) for x in a for y in b if ratio(x, y) >= threshold}
        assert {k: s for k, s in got.items() if k[0] == v} == want


def test_no_texts(spark):
    none = spark.createDataFrame([], "video_id long, compact string")
    assert EV.similar_texts(none, none, 0.72).count() == 0


def test_ranks_order_repeats_from_rare_to_frequent():
    n = np.zeros((textjoin.CLASSES, textjoin.REPEATS), np.int64)
    n[5, :4], n[9, :3] = (9, 9, 2, 1), (4, 4, 4)
    rarity = textjoin.Rarity(n)
    assert (np.diff(rarity.rank[5]) < 0).all() and (np.diff(rarity.of(np.full(200, 5), np.arange(200))) < 0).all()
    every = [(c, k) for c in (0, 5, 9, 1023) for k in range(70)]
    ranks = rarity.of(*np.array(every).T)
    for at in range(0, len(every), 7):
        first = rarity.first_repeat_before(np.array([0, 5, 9, 1023]), int(ranks[at]))
        for c, least in zip((0, 5, 9, 1023), first, strict=True):
            earlier = [k + 1 for (d, k), r in zip(every, ranks, strict=True) if d == c and r < ranks[at]]
            assert not earlier and least > 64 or least == min(earlier)


def test_common_subsequences():
    rng = random.Random(9)
    some = ["".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 7, 30, 63, 64, 90]))) for _ in range(40)]
    left, right = (x.ravel() for x in np.meshgrid(range(40), range(40)))

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_next(row, x, b)]
        return row[-1]

    def _next(row, x, b):
        out, before = [], 0
        for k, y in enumerate(b):
            before = row[k] + 1 if x == y else max(before, row[k + 1])
            out.append(before)
        return out

    for threshold in (0.3, 0.6, 0.8):
        got = textjoin.Subsequences(some).reach(left, right, threshold)
        for i, j, able in zip(left, right, got, strict=True):
            a, b = some[i], some[j]
            if max(len(a), len(b)) <= 63 and a + b:
                assert able == (2.0 * longest(a, b) / (len(a) + len(b)) >= threshold)
            elif a + b:
                assert able


class Table:
    """The best pairing from the full table of both sides."""

    def solve(self, truth, pred):
        best = [[EV.NO_CHAIN] * (len(pred) + 1)]
        moves = []
        for t in truth:
            scores = {s["k"]: s["similarity"] for s in t["similar"] or ()}
            row, move = [best[-1][0]], [1]
            for j, p in enumerate(pred, 1):
                top, step = (best[-1][j], 1) if best[-1][j] >= row[-1] else (row[-1], 0)
                if p["k"] in scores:
                    n, sim, inter, err = best[-1][j - 1]
                    centre = abs(t["start_frame"] + t["end_frame"] - p["start_frame"] - p["end_frame"])
                    pair = (n + 1, sim + scores[p["k"]], inter + EV.Alignment._overlap(t, p), err - centre)
                    top, step = (pair, 2) if pair >= top else (top, step)
                row.append(top)
                move.append(step)
            best.append(row)
            moves.append(move)
        i, j, out = len(truth), len(pred), []
        while i and j:
            step = moves[i - 1][j]
            if step == 2:
                out.append((truth[i - 1]["idx"], pred[j - 1]["idx"]))
            i, j = i - (step >= 1), j - (step != 1)
        return out


def block(rng, n, m, names):
    row = lambda k, side: {"video_id": 1, "side": side, "idx": k, "start_frame": 5 * (k // 2), "end_frame": 5 * (k // 2) + rng.randrange(4), "k": rng.choice(names)}
    truth, pred = [row(k, 0) for k in range(n)], [row(k, 1) for k in range(m)]
    alike = {a: [{"k": b, "similarity": 1.0 if a == b else rng.choice([0.75, 0.8])} for b in names if a == b or rng.random() < 0.3] for a in names}
    for t in truth:
        t["similar"] = alike[t["k"]] if rng.random() < 0.9 else None
    return truth, pred


def aligned(truth, pred):
    fold = EV.Alignment()
    for row in truth + pred:
        fold.push(dict(row))
    return fold.finish()


def test_alignment_equals_the_full_table():
    for seed in range(300):
        rng = random.Random(seed)
        truth, pred = block(rng, rng.randrange(12), rng.randrange(12), "abcdefg"[: rng.randrange(1, 8)])
        assert [(r["truth_idx"], r["pred_idx"]) for r in aligned(truth, pred)] == Table().solve(truth, pred)


def test_alignment_of_a_large_block():
    rng = random.Random(1)
    truth, pred = block(rng, 50_000, 50_000, [f"t{k}" for k in range(25_000)][:1])
    for side in (truth, pred):
        for r in side:
            r["k"] = f"t{r['idx'] // 3 + rng.randrange(3)}"
    for t in truth:
        t["similar"] = [{"k": t["k"], "similarity": 1.0}, {"k": t["k"] + "0", "similarity": 0.8}]
    tracemalloc.start()
    began = time.time()
    out = aligned(truth, pred)
    assert len(out) > 20_000 and tracemalloc.get_traced_memory()[1] < 1 << 30 and time.time() - began < 120
    tracemalloc.stop()


def test_components(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((top(a), top(b)))
            root[hi] = lo
    for held in (1 << 18, 10):
        monkeypatch.setattr(stars, "HELD", held)
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
        assert Counter((r.node, r.component) for r in got) == Counter((x, top(x)) for x in list(root))
    pairs = spark.createDataFrame(edges, "a long, b long").select(F.struct(F.lit("x").alias("s"), "a").alias("a"), F.struct(F.lit("x").alias("s"), F.col("b").alias("a")).alias("b"), F.lit(1).alias("k"))
    assert Counter((r.node.a, r.component.a) for r in components(pairs, "k").collect()) == Counter((x, top(x)) for x in list(root))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_greedy_match_is_the_sequential_rule(spark):
    rng = random.Random(8)
    words = ["red", "lamp", "on", "the", "river", "old", "road"]
    row = lambda v, k: (v, k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))), float(4 * k + rng.randrange(3)), float(4 * k + 3 + rng.randrange(6)))
    ref, pred = ([row(v, k) for v in (1, 2, 3) for k in range(25)] for _ in range(2))
    ref.append((1, 99, "on the river", 1e9, 1e9 + 1))
    schema = "video_id long, idx long, text string, start_time double, end_time double"
    got = {(r.video_id, r.ref_idx, r.pred_idx): r.score for r in EV.greedy_match(spark.createDataFrame(ref, schema), spark.createDataFrame(pred, schema)).collect()}
    used, want = defaultdict(set), {}
    for v, i, a, s, e in sorted(ref):
        best = None
        for w, j, b, s2, e2 in sorted(pred):
            if w != v or j in used[v]:
                continue
            inter, span = max(0.0, min(e, e2) - max(s, s2)), max(e, e2) - min(s, s2)
            sim = caption_score(a, b)
            if (s < e2 and s2 < e) or sim > 0.55:
                score = inter / span * 0.6 + sim * 0.4
                if best is None or score > best[0]:
                    best = (score, j)
        if best:
            used[v].add(best[1])
            want[v, i, best[1]] = best[0]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_contained_pairs(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["ab", "b", "cab", "c", "a"]) for _ in range(rng.randrange(1, 5))) for _ in range(80)]
    pool += [t[1:-1].strip() for t in pool if len(t) > 4]
    left = {(v, t) for v in (1, 2) for t in rng.sample(pool, 50)}
    right = {(v, t) for v in (1, 2) for t in rng.sample(pool, 50)}
    frame = lambda s: spark.createDataFrame(sorted(s), "key long, text string")
    got = Counter(tuple(r) for r in textjoin.contained_pairs(frame(left), frame(right)).collect())
    assert got == Counter((v, a, b) for v, a in left for w, b in right if v == w and " " in a and a in b)


def test_able_drops_no_pair_that_the_matcher_accepts():
    rng = np.random.default_rng(5)
    words = ["small star", "power", "guide", "cold river", "s", "x" * 70, "straße ok"]
    a, b = ([" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(400)] for _ in range(2))
    a, b = np.array(a + ["", "zq"], object), np.array(b + ["", "power"], object)
    for threshold in (0.42, 0.5, 0.9):
        ok = SIM.able(a, b, threshold)
        for x, y, may in zip(a, b, ok, strict=True):
            assert may or SequenceMatcher(None, x, y).ratio() < threshold
    assert not SIM.able(a, b, 0.5)[-1]


def test_frame_hits_join_no_texts(spark):
    """The joined rows of events and detections carry hashes; the texts meet once per distinct pair."""
    events = spark.createDataFrame([(1, k, 0.0, 9.0, "Small STAR power") for k in range(40)], "video_id int, cue_id long, a double, b double, text string")
    events = events.withColumn("box", F.struct(*[F.lit(v).alias(k) for k, v in (("x1", 0), ("y1", 0), ("x2", 90), ("y2", 20))]))
    texts = ["small star", "SMALL STAR P0WER", "", "cold river", None]
    obs = spark.createDataFrame([(1, t, float(t), texts[t], 0, 0, 90, 20) for t in range(5)], "video_id int, frame_index long, ts double, text string, x1 int, y1 int, x2 int, y2 int")
    hits = RF.event_frame_hits(events, obs, (F.col("a"), F.col("b")), 0.5)
    assert sorted({r.frame_index for r in hits.collect()}) == [0, 1] and hits.count() == 80
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    handed = [line for line in plan.splitlines() if "Project [" in line]
    assert handed and not any("_en#" in line or "_on#" in line for line in handed)


def test_ratios_of_many_pairs_are_the_matchers():
    rng = random.Random(3)
    letters = ["ab", "abcdefgh", "aé𝒳 日b", "0123456789abcdef "]
    text = lambda: "".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(0, SIM.SHORT + 1)))
    a, b = ([text() for _ in range(500)] for _ in range(2))
    a, b = a + ["", "x", "purchase 12ab", a[0]], b + ["", "", "12ab purchase", a[0]]
    b[:100] = [x[7:] + x[:7] for x in a[:100]]
    assert SIM.ratios(a, b).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("whole", [1024, 8])
def test_candidate_pairs_with_contained_ones(spark, monkeypatch, whole):
    """One pass finds both kinds of pairs, each once, in keys compared as they are and in indexed ones."""
    monkeypatch.setattr(textjoin, "WHOLE", whole)
    rng = random.Random(6)
    pool = sorted({" ".join(rng.choice(["ab", "b", "cab", "c", "a", "lamp"]) for _ in range(rng.randrange(1, 9))) for _ in range(90)})
    left, right = ({(v, t) for v in (1, 2) for t in rng.sample(pool, 40)} for _ in range(2))
    frame = lambda s: spark.createDataFrame(sorted(s), "key long, text string")
    got = Counter(tuple(r) for r in textjoin.candidate_pairs(frame(left), frame(right), 0.55, contained=True).collect())
    held = lambda a, b: (" " in a and a in b) or (" " in b and b in a)
    pairs = {(v, a, b) for v, a in left for w, b in right if v == w}
    assert set(got.values()) == {1} and set(got) <= pairs
    assert {p for p in pairs if held(*p[1:]) or SequenceMatcher(None, *p[1:]).ratio() >= 0.55} <= set(got)
    assert any(held(*p[1:]) and SequenceMatcher(None, *p[1:]).ratio() < 0.55 for p in pairs)


@pytest.mark.parametrize("crowded", [20000, 10])
def test_greedy_match_by_video_and_by_component(spark, monkeypatch, crowded):
    """Matchers go over a pair once; the parts of a crowded video take the same pairs as the whole of it."""
    monkeypatch.setattr(EV, "GREEDY_PAIRS", crowded)
    rows = [(v, k, f"{w} {k % 5}{v}", 9.0 * k, 9.0 * k + 2) for v in (1, 2) for k, w in enumerate(["red lamp", "old road", "lamp red", "x"] * 6)]
    schema = "video_id long, idx long, text string, start_time double, end_time double"
    table = spark.createDataFrame(rows, schema)
    out = EV.greedy_match(table, table.withColumn("text", F.reverse("text")).unionByName(table.where("idx % 3 = 0").withColumn("idx", F.col("idx") + 100)))
    got = sorted((r.video_id, r.ref_idx, r.pred_idx) for r in out.collect())
    assert len({x[:2] for x in got}) == len(got) == len({x[::2] for x in got}) and len(got) > 40
    monkeypatch.setattr(EV, "GREEDY_PAIRS", 20010 - crowded)
    again = EV.greedy_match(table, table.withColumn("text", F.reverse("text")).unionByName(table.where("idx % 3 = 0").withColumn("idx", F.col("idx") + 100)))
    assert got == sorted((r.video_id, r.ref_idx, r.pred_idx) for r in again.collect())
