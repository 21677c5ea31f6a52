"""Evaluation of predicted timelines against truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrail.functions import geometry as G
from captrail.functions import text as TX
from captrail.functions.numeric import half_even, safe_ratio
from captrail.functions.similarity import caption_similarity, eval_similarity
from captrail.operators.components import components
from captrail.operators.folds import Fold, cut, fold_groups
from captrail.operators.intervals import overlap_join, points_in_spans
from captrail.operators.ordered import ordered
from captrail.operators.textjoin import candidate_pairs

CHUNK_ROWS = 20000
#: Texts more alike than this are candidates of a greedy matching whenever they are shown.
GREEDY_TEXT = 0.55
#: Candidate pairs of a video that one greedy matching goes through, a row at a time.
GREEDY_PAIRS = 20000


class MultilineMerge(Fold):
    """Join stacked lines shown at the same time into one event."""

    def __init__(self):
        self.held: dict | None = None

    @staticmethod
    def _pairs(a, b) -> bool:
        if a["box"] is None or b["box"] is None:
            return False
        slop, brief = max(2, round(b["fps"] * 0.06)), max(3, round(b["fps"] * 0.12))
        if abs(a["start_frame"] - b["start_frame"]) > slop:
            return False
        shorter = min(r["end_frame"] - r["start_frame"] + 1 for r in (a, b))
        if abs(a["end_frame"] - b["end_frame"]) > slop and shorter > brief:
            return False
        p, q = a["box"], b["box"]
        hp, hq = p["y2"] - p["y1"], q["y2"] - q["y1"]
        if min(hp, hq) <= 0:
            return False
        apart = abs((p["y1"] + p["y2"]) / 2 - (q["y1"] + q["y2"]) / 2)
        if not 0.65 * min(hp, hq) <= apart <= 1.35 * max(hp, hq):
            return False
        down = max(0.0, min(p["y2"], q["y2"]) - max(p["y1"], q["y1"]))
        across = max(0.0, min(p["x2"], q["x2"]) - max(p["x1"], q["x1"]))
        narrow = min(p["x2"] - p["x1"], q["x2"] - q["x1"])
        return down / min(hp, hq) <= 0.6 and narrow > 0 and across / narrow >= 0.35

    def push(self, row):
        if self.held is not None and self._pairs(self.held, row):
            a, p, q = self.held, self.held["box"], row["box"]
            lines = [a, row] if p["y1"] <= q["y1"] else [row, a]
            self.held = a | {
                "text": " / ".join(x["text"] for x in lines),
                "start_frame": min(a["start_frame"], row["start_frame"]),
                "end_frame": max(a["end_frame"], row["end_frame"]),
                "sources": a["sources"] + row["sources"],
                "box": {"x1": min(p["x1"], q["x1"]), "y1": min(p["y1"], q["y1"]),
                        "x2": max(p["x2"], q["x2"]), "y2": max(p["y2"], q["y2"])},
            }
            return ()
        done, self.held = self.held, row
        return [done] if done is not None else ()

    def finish(self):
        return [self.held] if self.held is not None else ()


def merge_multiline(pred: DataFrame, videos: DataFrame) -> DataFrame:
    """Merge simultaneous stacked lines and number the result per video.

    ``pred``: (video_id, idx, text, start_frame, end_frame, box); ``videos``:
    (video_id, fps). Starts further apart than the frame slop cannot merge, so
    rows between two such gaps are an exact parallel group. A row alone between them
    is the result as it is.
    """
    chunk = F.floor(F.col("start_frame") / F.lit(CHUNK_ROWS))
    order = ["start_frame", "end_frame", "idx"]
    timed = pred.join(videos.select("video_id", F.col("fps").cast("double").alias("fps")), "video_id", "left")
    timed = timed.withColumn("fps", F.coalesce("fps", F.lit(DEFAULT_FPS)))
    slop = F.greatest(F.lit(2), half_even(F.col("fps") * F.lit(0.06)).cast("long"))
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    near = ordered(timed, ["video_id"], order, chunk, lag={"_p": "start_frame"}, lead={"_q": "start_frame"})
    opens = F.col("_p").isNull() | (F.col("start_frame") - F.col("_p") > slop)
    closes = F.col("_q").isNull() | (F.col("_q") - F.col("start_frame") > slop)
    # Read for the rows that stand alone and for the others.
    near = cut(near.select(
        "video_id", "idx", "text", F.col("start_frame").cast("long").alias("start_frame"),
        F.col("end_frame").cast("long").alias("end_frame"), F.col("box").cast(box).alias("box"),
        F.array(F.col("idx").cast("long")).alias("sources"), "fps", opens.alias("_opens"), (opens & closes).alias("_alone"),
    ))
    runs = ordered(
        near.where(~F.col("_alone")).withColumn("_open", F.when(F.col("_opens"), F.col("start_frame"))),
        ["video_id"], order, chunk, last_seen={"_run": "_open"},
    ).drop("_opens", "_alone", "_open")
    # Written, since two branches read what comes next and each would fold anew.
    merged = cut(fold_groups(runs, ["video_id", "_run"], order, MultilineMerge, runs.schema).drop("_run"))
    out = ordered(near.where("_alone").select(*merged.columns).unionByName(merged), ["video_id"], order, chunk, number="_n")
    return out.select(
        "video_id", (F.col("_n") - 1).alias("idx"), "text", "start_frame", "end_frame", "box", "sources"
    )


def similar_texts(truth: DataFrame, pred: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct compact texts of one video with similarity >= ``threshold``.

    Candidates come from the index over numbered characters; the matcher sees those alone, each once.
    """
    left = truth.select(F.col("video_id").alias("key"), F.col("compact").alias("text"))
    right = pred.select(F.col("video_id").alias("key"), F.col("compact").alias("text"))
    pairs = candidate_pairs(left, right, threshold).select(
        F.col("key").alias("video_id"), F.col("left_text").alias("truth_text"), F.col("right_text").alias("pred_text"))
    # Written before it is filtered: a condition on a Python value is worked out twice otherwise.
    return cut(pairs.withColumn("similarity", eval_similarity(F.col("truth_text"), F.col("pred_text"), threshold))).where(F.col("similarity") >= threshold)


class BestBefore:
    """A Fenwick tree of maxima: the best chain that ends before a column."""

    def __init__(self, columns: int):
        self.best: list[tuple] = [NO_CHAIN] * (columns + 1)

    def before(self, column: int) -> tuple:
        out = NO_CHAIN
        while column > 0:
            if self.best[column] > out:
                out = self.best[column]
            column &= column - 1
        return out

    def put(self, column: int, chain: tuple) -> None:
        column += 1
        while column < len(self.best):
            if chain > self.best[column]:
                self.best[column] = chain
            column += column & -column


#: Pairs, similarity, overlap and minus the centre error of a chain.
NO_CHAIN = (0, 0.0, 0.0, 0)


class Alignment(Fold):
    """Best order-preserving pairing inside one block, by chains of similar pairs.

    Compares (pairs, similarity, overlap, -centre error); on a tie a pair wins over skipping the truth row, and that over
    skipping the prediction. Memory and time follow the number of similar pairs, not of rows on either side multiplied.
    """

    def __init__(self):
        self.truth: list[dict] = []
        self.pred: list[dict] = []

    def push(self, row):
        (self.truth if row["side"] == 0 else self.pred).append(row)
        return ()

    @staticmethod
    def _overlap(t, p) -> float:
        inter = max(0, min(t["end_frame"], p["end_frame"]) - max(t["start_frame"], p["start_frame"]) + 1)
        span = max(t["end_frame"], p["end_frame"]) - min(t["start_frame"], p["start_frame"]) + 1
        return inter / span if span > 0 else 0.0

    def _chains(self) -> dict[tuple, list[tuple]]:
        """Every similar pair (truth row, column, similarity, overlap, the best chain before it), by its chain's worth."""
        columns: dict[str, list[int]] = {}
        for j, p in enumerate(self.pred):
            columns.setdefault(p["k"], []).append(j)
        tree, ends = BestBefore(len(self.pred)), {}
        for i, t in enumerate(self.truth):
            row = []
            for s in t["similar"] or ():
                for j in columns.get(s["k"], ()):
                    p = self.pred[j]
                    before, inter = tree.before(j), self._overlap(t, p)
                    n, sim, overlap, err = before
                    centre = abs(t["start_frame"] + t["end_frame"] - p["start_frame"] - p["end_frame"])
                    worth = (n + 1, sim + s["similarity"], overlap + inter, err - centre)
                    ends.setdefault(worth, []).append((i, j, s["similarity"], inter, before))
                    row.append((j, worth))
            for j, worth in row:
                tree.put(j, worth)
        return ends

    def finish(self):
        ends, out = self._chains(), []
        i, j = len(self.truth), len(self.pred)
        worth = max(ends, default=NO_CHAIN)
        while worth != NO_CHAIN:
            # A pair in the last column comes first, the latest of them; else the earliest row decides, its last column.
            open_ = [e for e in ends[worth] if e[0] < i and e[1] < j]
            last = [e for e in open_ if e[1] == j - 1]
            first = min(e[0] for e in open_)
            found = max(last) if last else max(e for e in open_ if e[0] == first)
            i, j, similarity, inter, worth = found
            t, p = self.truth[i], self.pred[j]
            out.append({
                "video_id": t["video_id"], "truth_idx": t["idx"], "pred_idx": p["idx"],
                "similarity": similarity, "exact": t["k"] == p["k"], "temporal_iou": inter,
            })
        return out


def _blocks(truth: DataFrame, pred: DataFrame, similar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assign rows that can match to independent blocks.

    A cut lies where every earlier truth row's partners precede every later
    row's partners: no pairing can cross it, so each block is solved alone. The
    ranges come from per-text aggregates; no pair of rows is built.
    """
    def ends(df, name):
        return df.groupBy("video_id", F.col("compact").alias(f"{name}_text")).agg(
            F.min("idx").alias("_lo"), F.max("idx").alias("_hi")
        )

    reach = similar.join(ends(pred, "pred"), ["video_id", "pred_text"]).groupBy(
        "video_id", F.col("truth_text").alias("compact")
    ).agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        F.collect_list(F.struct(F.col("pred_text").alias("k"), "similarity")).alias("similar"),
    )
    t = truth.join(reach, ["video_id", "compact"]).withColumn("_neg", -F.col("idx"))
    slim = cut(t.select("video_id", "idx", "_neg", "_lo", "_hi"))
    ahead = ordered(
        slim, ["video_id"], ["_neg"], F.floor(F.col("_neg") / F.lit(CHUNK_ROWS)), max_before={"_x": -F.col("_lo")}
    )
    chunk = F.floor(F.col("idx") / F.lit(CHUNK_ROWS))
    behind = ordered(ahead, ["video_id"], ["idx"], chunk, max_before={"_reach": "_hi"})
    coming = F.least(F.col("_lo"), F.coalesce(-F.col("_x"), F.col("_lo")))
    opens = F.col("_reach").isNull() | (coming > F.col("_reach"))
    marked = ordered(
        behind.withColumn("_open", F.when(opens, F.col("idx"))), ["video_id"], ["idx"], chunk,
        last_seen={"block": "_open"},
    ).select("video_id", "idx", "block")
    marked = cut(marked)
    # All partners of one prediction lie in one block; its first partner names it.
    home = similar.join(ends(truth, "truth"), ["video_id", "truth_text"]).groupBy(
        "video_id", F.col("pred_text").alias("compact")
    ).agg(F.min("_lo").alias("_first"))
    p = pred.join(home, ["video_id", "compact"])
    first_block = marked.select("video_id", F.col("idx").alias("_first"), "block")
    return t.join(marked, ["video_id", "idx"]), p, first_block


def align_timelines(truth: DataFrame, pred: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Order-preserving one-to-one alignment per video.

    Both sides: (video_id, idx, text, start_frame, end_frame), idx giving the order.
    """
    cols = ["video_id", "idx", "start_frame", "end_frame"]
    as_long = [F.col(c).cast("long").alias(c) for c in cols[1:]]
    # Several branches read both sides, the similar texts and the block marks.
    t = cut(truth.select("video_id", *as_long, TX.compact_eval(F.col("text")).alias("compact")))
    p = cut(pred.select("video_id", *as_long, TX.compact_eval(F.col("text")).alias("compact")))
    similar = similar_texts(t, p, threshold)
    tb, ph, first_block = _blocks(t, p, similar)
    k = F.col("compact").alias("k")
    t_rows = tb.select("video_id", "block", F.lit(0).alias("side"), *cols[1:], k, "similar")
    p_rows = ph.join(first_block, ["video_id", "_first"]).select(
        "video_id", "block", F.lit(1).alias("side"), *cols[1:], k,
        F.lit(None).cast("array<struct<k:string,similarity:double>>").alias("similar"),
    )
    schema = T.StructType([
        truth.schema["video_id"], T.StructField("truth_idx", T.LongType()), T.StructField("pred_idx", T.LongType()),
        T.StructField("similarity", T.DoubleType()), T.StructField("exact", T.BooleanType()),
        T.StructField("temporal_iou", T.DoubleType()),
    ])
    return fold_groups(t_rows.unionByName(p_rows), ["video_id", "block"], ["side", "idx"], Alignment, schema)


def unmatched(events: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Events without a match: side 'pred' gives false positives, 'truth' false negatives."""
    used = matches.select("video_id", F.col(f"{side}_idx").alias("idx"))
    return events.join(used, ["video_id", "idx"], "left_anti")


def match_rows(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches with the signed boundary errors in frames."""
    t = truth.select(
        "video_id", F.col("idx").alias("truth_idx"), F.col("text").alias("truth_text"), "tier", "uncertainty",
        F.col("start_frame").alias("_ts"), F.col("end_frame").alias("_te"),
    )
    p = pred.select(
        "video_id", F.col("idx").alias("pred_idx"), F.col("text").alias("pred_text"),
        F.col("start_frame").alias("_ps"), F.col("end_frame").alias("_pe"),
    )
    return matches.join(t, ["video_id", "truth_idx"]).join(p, ["video_id", "pred_idx"]).select(
        *matches.columns, "truth_text", "pred_text", "tier", "uncertainty",
        (F.col("_ps") - F.col("_ts")).alias("start_error"), (F.col("_pe") - F.col("_te")).alias("end_error"),
    )


def tier_a_rows(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Every truth event of tier A with how exactly it was found; null errors where it was not."""
    found = match_rows(truth, pred, matches).select(
        "video_id", F.col("truth_idx").alias("idx"), "pred_idx", "pred_text", "start_error", "end_error")
    exact = lambda *c: F.coalesce(reduce(lambda a, b: a & b, [F.col(x) == 0 for x in c]), F.lit(False))
    return truth.where("tier = 'A'").select("video_id", "idx", "text").join(found, ["video_id", "idx"], "left").select(
        "video_id", F.col("idx").alias("truth_idx"), F.col("text").alias("truth_text"), "pred_idx", "pred_text",
        F.col("pred_idx").isNotNull().alias("matched"), exact("start_error").alias("exact_start"), exact("end_error").alias("exact_end"),
        exact("start_error", "end_error").alias("exact_both"), "start_error", "end_error",
    )


#: Frames per second of videos that nobody described.
DEFAULT_FPS = 30.0


def timeline_report(
    truth: DataFrame, pred: DataFrame, matches: DataFrame, videos: DataFrame, raw_pred: DataFrame | None = None
) -> DataFrame:
    """One report row per video of either side or of ``videos`` (video_id, fps); ratios on nothing are 0."""
    six = lambda c: half_even(c, 6)
    n_truth = truth.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("truth"), F.count_if(F.col("tier") == "A").alias("tier_a_truth")
    )
    n_pred = pred.groupBy("video_id").agg(F.count(F.lit(1)).alias("evaluated_prediction"))
    n_raw = (raw_pred if raw_pred is not None else pred).groupBy("video_id").agg(F.count(F.lit(1)).alias("prediction"))
    rows = match_rows(truth, pred, matches)
    s, e = F.abs("start_error"), F.abs("end_error")
    a = F.col("tier") == "A"
    agg = rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("matched"), F.count_if("exact").alias("exact_text"),
        F.avg("similarity").alias("_mean"), F.min("similarity").alias("_min"),
        F.avg(s).alias("_s"), F.avg(e).alias("_e"),
        F.count_if((s <= F.col("uncertainty")) & (e <= F.col("uncertainty"))).alias("within_uncertainty"),
        F.count_if(a).alias("tier_a_matched"), F.count_if(a & (s == 0)).alias("tier_a_exact_start"),
        F.count_if(a & (e == 0)).alias("tier_a_exact_end"), F.count_if(a & (s == 0) & (e == 0)).alias("tier_a_exact_both"),
        F.avg(F.when(a, s)).alias("_as"), F.avg(F.when(a, e)).alias("_ae"),
    )
    raw = raw_pred if raw_pred is not None else pred
    every = reduce(DataFrame.union, [x.select("video_id") for x in (videos, truth, raw)]).distinct()
    described = every.join(videos.select("video_id", "fps"), "video_id", "left").withColumn("fps", F.coalesce(F.col("fps").cast("double"), F.lit(DEFAULT_FPS)))
    j = described.join(n_truth, "video_id", "left").join(n_pred, "video_id", "left").join(
        n_raw, "video_id", "left").join(agg, "video_id", "left").fillna(0)
    m, nt, np_ = F.col("matched"), F.col("truth"), F.col("evaluated_prediction")
    precision, recall = safe_ratio(m, np_), safe_ratio(m, nt)
    return j.select(
        "video_id", "fps", "truth", "prediction", "evaluated_prediction",
        (F.col("prediction") - np_).alias("merged_groups"), "matched",
        (np_ - m).alias("false_positive"), (nt - m).alias("false_negative"),
        six(precision).alias("precision"), six(recall).alias("recall"),
        six(safe_ratio(precision * recall * 2, precision + recall)).alias("f1"),
        "exact_text", six(safe_ratio(F.col("exact_text"), m)).alias("exact_text_rate"),
        six(F.col("_mean")).alias("mean_similarity"), six(F.col("_min")).alias("min_similarity"),
        six(F.col("_s")).alias("start_frame_mae"), six(F.col("_e")).alias("end_frame_mae"),
        six(F.col("_s") / F.col("fps")).alias("start_seconds_mae"), six(F.col("_e") / F.col("fps")).alias("end_seconds_mae"),
        "within_uncertainty", six(safe_ratio(F.col("within_uncertainty"), m)).alias("within_uncertainty_rate"),
        "tier_a_truth", "tier_a_matched", "tier_a_exact_start", "tier_a_exact_end", "tier_a_exact_both",
        six(F.col("_as")).alias("tier_a_start_mae"), six(F.col("_ae")).alias("tier_a_end_mae"),
        ((F.col("tier_a_truth") > 0) & (F.col("tier_a_truth") == F.col("tier_a_exact_both"))).alias("tier_a_passed"),
    )


def report_lines(report: DataFrame, false_positives: DataFrame, false_negatives: DataFrame) -> DataFrame:
    """The report as text lines, (video_id, line_no, line), with a line for each unmatched event.

    Unmatched events: (video_id, idx, text, start_frame, end_frame). They stay rows, numbered in chunks.
    """
    f = F.format_string
    label = F.when(
        F.col("prediction") != F.col("evaluated_prediction"),
        f("%d (semantic: %d)", "prediction", "evaluated_prediction"),
    ).otherwise(F.col("prediction").cast("string"))
    wrong, missed = F.col("false_positive"), F.col("false_negative")
    second = F.greatest(F.lit(1), wrong) + HEAD_LINES
    none = lambda n, at: F.when(n == 0, F.struct(at.cast("long").alias("line_no"), F.lit("    (none)").alias("line")))
    head = [
        F.lit("Visual subtitle timeline evaluation"),
        f("  Truth: %d | Prediction: %s | Matched: %d", "truth", label, "matched"),
        f("  Detection: precision=%.4f recall=%.4f f1=%.4f", "precision", "recall", "f1"),
        f("  Text: exact=%d/%d mean_similarity=%.4f", "exact_text", "matched", "mean_similarity"),
        f("  Boundaries: start_MAE=%.3f frames end_MAE=%.3f frames", "start_frame_mae", "end_frame_mae"),
        f("  Tier A: matched=%d/%d exact_both=%d/%d result=%s", "tier_a_matched", "tier_a_truth",
          "tier_a_exact_both", "tier_a_truth", F.when(F.col("tier_a_passed"), "PASS").otherwise("FAIL")),
        f("  False positives (%d):", "false_positive"),
    ]
    fixed = [F.struct(F.lit(k).cast("long").alias("line_no"), x.alias("line")) for k, x in enumerate(head)]
    fixed.append(F.struct(second.cast("long").alias("line_no"), f("  False negatives (%d):", "false_negative").alias("line")))
    fixed += [none(wrong, F.lit(HEAD_LINES)), none(missed, second + 1)]
    lines = report.select("video_id", F.explode(F.array_compact(F.array(*fixed))).alias("x")).select("video_id", "x.*")

    def unmatched_lines(events, first):
        rows = ordered(events, ["video_id"], ["idx"], F.floor(F.col("idx") / F.lit(CHUNK_ROWS)), number="_n")
        row = f("    [%d] %d-%d %s", "idx", "start_frame", "end_frame", "text")
        return rows.join(report.select("video_id", first.alias("_first")), "video_id").select(
            "video_id", (F.col("_first") + F.col("_n") - 1).cast("long").alias("line_no"), row.alias("line"))

    return lines.union(unmatched_lines(false_positives, F.lit(HEAD_LINES))).union(unmatched_lines(false_negatives, second + 1))


#: Lines of a report before its unmatched events.
HEAD_LINES = 7


def report_sections(
    truth: DataFrame, pred: DataFrame, matches: DataFrame, videos: DataFrame, threshold: float = 0.72, raw_pred: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The whole report as tables: a summary per video, and rows for matches, tier A and unmatched events."""
    summary = timeline_report(truth, pred, matches, videos, raw_pred).withColumns({
        "text_threshold": F.lit(threshold), "merge_simultaneous_multiline": F.lit(raw_pred is not None)})
    normal = lambda c: TX.norm_eval(F.col(c))
    return {
        "summary": summary,
        "matches": match_rows(truth, pred, matches).withColumns({"truth_normalized": normal("truth_text"), "pred_normalized": normal("pred_text")}),
        "tier_a": tier_a_rows(truth, pred, matches),
        "false_positives": unmatched(pred, matches, "pred"),
        "false_negatives": unmatched(truth, matches, "truth"),
    }


def evaluate_timelines(truth: DataFrame, pred: DataFrame, videos: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Merge stacked lines, align and report, for all videos at once."""
    merged = cut(merge_multiline(pred, videos))
    matches = cut(align_timelines(truth, merged, threshold))
    return timeline_report(truth, merged, matches, videos, raw_pred=pred)


class GreedyPick(Fold):
    """Each reference row takes its best candidate that is still free."""

    def __init__(self):
        self.used: set[int] = set()
        self.served: int | None = None

    def push(self, row):
        if row["ref_idx"] == self.served or row["pred_idx"] in self.used:
            return ()
        self.served = row["ref_idx"]
        self.used.add(row["pred_idx"])
        return [row]


def greedy_match(ref: DataFrame, pred: DataFrame) -> DataFrame:
    """Greedy proxy matching of (video_id, idx, text, start_time, end_time) tables.

    Rows that share no candidate, directly or through others, cannot take one from each other: in a video of more than
    ``GREEDY_PAIRS`` pairs each component of the graph of candidate pairs is matched on its own.
    """
    norm = TX.norm_caption(F.col("text"))
    side = lambda df, p: cut(df.select(
        "video_id", F.col("idx").alias(f"{p}_idx"), norm.alias(f"{p}_text"),
        F.col("start_time").alias(f"{p}_start"), F.col("end_time").alias(f"{p}_end"),
    ))
    r, p = side(ref, "ref"), side(pred, "pred")
    rt, pt = (x.select(F.col("video_id").alias("key"), F.col(f"{n}_text").alias("text")) for x, n in ((r, "ref"), (p, "pred")))
    a, b = F.col("ref_text"), F.col("pred_text")
    related = candidate_pairs(rt, pt, GREEDY_TEXT, contained=True).toDF("video_id", "ref_text", "pred_text")
    # Written before it is filtered: a condition on a Python value is worked out twice otherwise.
    alike = cut(related.withColumn("similarity", caption_similarity(a, b, GREEDY_TEXT))).where(F.col("similarity") > GREEDY_TEXT)
    cols = ["video_id", "ref_idx", "pred_idx", "ref_start", "ref_end", "pred_start", "pred_end", "similarity"]
    by_text = r.join(alike, ["video_id", "ref_text"]).join(p, ["video_id", "pred_text"]).select(*cols)
    by_time = overlap_join(
        r, p, ["video_id"], (F.col("ref_start"), F.col("ref_end")), (F.col("pred_start"), F.col("pred_end")),
        G.intervals_overlap(F.col("ref_start"), F.col("ref_end"), F.col("pred_start"), F.col("pred_end")),
    ).withColumn("similarity", caption_similarity(a, b)).select(*cols)
    keys = cols[:-1]
    pairs = by_text.union(by_time).groupBy(*keys).agg(F.max("similarity").alias("similarity"))
    inter = F.greatest(F.lit(0.0), F.least("ref_end", "pred_end") - F.greatest("ref_start", "pred_start"))
    span = F.greatest("ref_end", "pred_end") - F.least("ref_start", "pred_start")
    score = F.coalesce(F.try_divide(inter, span), F.lit(0.0)) * F.lit(0.6) + F.col("similarity") * F.lit(0.4)
    scored = cut(pairs.withColumn("score", score).withColumn("_rank", -F.col("score")))
    crowded = cut(scored.groupBy("video_id").count().where(F.col("count") > GREEDY_PAIRS).select("video_id"))
    placed = scored.withColumns({"_side": F.lit(0), "_least": F.lit(0).cast("long")})
    if not crowded.isEmpty():
        node = lambda s: F.struct("video_id", F.lit(s).alias("side"), F.col(("ref_idx", "pred_idx")[s]).cast("long").alias("idx"))
        many = scored.join(crowded, "video_id", "left_semi")
        parts = components(many.select("video_id", node(0).alias("a"), node(1).alias("b")), "video_id")
        parted = many.withColumn("node", node(0)).join(parts, "node").select(
            *scored.columns, F.col("component.side").alias("_side"), F.col("component.idx").alias("_least"))
        placed = placed.join(crowded, "video_id", "left_anti").unionByName(parted)
    out = fold_groups(placed, ["video_id", "_side", "_least"], ["ref_idx", "_rank", "pred_idx"], GreedyPick, scored.schema)
    return out.drop("_rank")


def proxy_report(ref: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Coverage, similarity and boundary errors of a greedy matching, four decimals."""
    four = lambda c: half_even(F.coalesce(c, F.lit(0.0)), 4)
    n_ref = ref.groupBy("video_id").agg(F.count(F.lit(1)).alias("reference_count"))
    n_pred = pred.groupBy("video_id").agg(F.count(F.lit(1)).alias("prediction_count"))
    m = matches.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("matched_count"), F.avg("similarity").alias("_sim"),
        F.avg(F.abs(F.col("ref_start") - F.col("pred_start"))).alias("_s"),
        F.avg(F.abs(F.col("ref_end") - F.col("pred_end"))).alias("_e"),
    )
    j = n_ref.join(n_pred, "video_id", "full").join(m, "video_id", "left").fillna(
        0, ["reference_count", "prediction_count", "matched_count"]
    )
    return j.select(
        "video_id", "reference_count", "prediction_count", "matched_count",
        four(safe_ratio(F.col("matched_count"), F.col("reference_count"))).alias("coverage"),
        four(F.col("_sim")).alias("mean_similarity"), four(F.col("_s")).alias("mean_start_error"),
        four(F.col("_e")).alias("mean_end_error"),
    )


def binned_boundary_errors(reference: DataFrame, cues: DataFrame) -> DataFrame:
    """How far the ends of coarse reference segments are from the first and last cue in them, per video.

    ``reference``: (video_id, segment, start_time, end_time); a cue belongs to the segment that holds its middle, the end
    excluded. Segments without a cue are counted only.
    """
    ref = reference.select("video_id", "segment", F.col("start_time").alias("_rs"), F.col("end_time").alias("_re"))
    own = cues.select("video_id", F.col("start_time").alias("_s"), F.col("end_time").alias("_e"), ((F.col("start_time") + F.col("end_time")) / 2).alias("_mid"))
    held = points_in_spans(ref, own, ["video_id"], (F.col("_rs"), F.col("_re")), F.col("_mid"), width=64.0).where("_mid < _re")
    bins = held.groupBy("video_id", "segment", "_rs", "_re").agg(F.min("_s").alias("_first"), F.max("_e").alias("_last"), F.count(F.lit(1)).alias("_n"))
    start, end = F.abs(F.col("_first") - F.col("_rs")), F.abs(F.col("_last") - F.col("_re"))
    found = bins.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("filled"), F.sum("_n").alias("cues"), half_even(F.avg(start), 6).alias("start_mae"),
        half_even(F.avg(end), 6).alias("end_mae"), half_even(F.max(end), 6).alias("max_end_error"),
    )
    return reference.groupBy("video_id").agg(F.count(F.lit(1)).alias("segments")).join(found, "video_id", "left").fillna(0, ["filled", "cues"])


def error_rates(a_norm: Column, b_norm: Column) -> dict[str, Column]:
    """Word and character edits of ``b`` against reference ``a`` (normal forms)."""
    ta, tb = TX.tokens(a_norm), TX.tokens(b_norm)
    vocabulary = F.array_distinct(F.concat(ta, tb))

    def letter(word):  # one code point per distinct word, clear of the surrogates
        at = F.array_position(vocabulary, word) + F.lit(255)
        return F.format_string("%c", F.when(at < 0xD800, at).otherwise(at + F.lit(0x800)).cast("int"))

    code = lambda ts: F.array_join(F.transform(ts, letter), "")
    return {
        "word_edits": F.levenshtein(code(ta), code(tb)), "words": F.size(ta),
        "char_edits": F.levenshtein(a_norm, b_norm), "chars": F.length(a_norm),
    }


def corpus_error_rates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """WER and CER per key over (reference, hypothesis) text pairs."""
    normal = pairs.withColumns({c: TX.norm_eval(F.col(c)) for c in ("reference", "hypothesis")})
    edits = error_rates(F.col("reference"), F.col("hypothesis"))
    totals = normal.withColumns(edits).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("word_edits", "words", "char_edits", "chars")]
    )
    return totals.withColumns({
        "wer": half_even(safe_ratio(F.col("word_edits"), F.col("words")), 6),
        "cer": half_even(safe_ratio(F.col("char_edits"), F.col("chars")), 6),
    })
