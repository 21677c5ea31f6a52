"""Registered queries evaluating predicted timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.functions import text as TX
from captrail.operators import evaluate as EV
from captrail.operators.folds import cut
from captrail.operators.ordered import ordered
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources.tables import load, oracle


def timeline(spark, d, name):
    """Truth or prediction rows numbered per video."""
    rows = load(spark, d, name)
    out = ordered(
        rows, ["video_id"], ["start_frame", "end_frame", "event_key"], F.floor(F.col("start_frame") / 20000), number="_n"
    ).withColumn("idx", F.col("_n") - 1).drop("_n")
    if name == "pred":
        k = F.col("event_key")
        box = F.struct((k % 90).cast("double").alias("x1"), ((k % 2) * 60).cast("double").alias("y1"),
                       (k % 90 + 200).cast("double").alias("x2"), ((k % 2) * 60 + 50).cast("double").alias("y2"))
        out = out.withColumn("box", box)
    return out


def videos(truth):
    return truth.select("video_id").distinct().withColumn("fps", F.lit(30.0))


_IDX = """t as (select *, row_number() over (partition by video_id order by start_frame, end_frame, event_key) - 1 as idx from truth),
p as (select *, row_number() over (partition by video_id order by start_frame, end_frame, event_key) - 1 as idx from pred)"""
_C = lambda x: f"replace({Q.norm_eval(x)}, ' ', '')"
_MATCH = f"""{_IDX},
m as (select t.video_id, t.idx as truth_idx, p.idx as pred_idx, true as exact, p.start_frame - t.start_frame as se, p.end_frame - t.end_frame as ee, t.tier, t.uncertainty
  from t join p on p.video_id = t.video_id and p.event_key = t.event_key where {_C('t.text')} = {_C('p.text')})"""


def _key_matches(spark, d):
    """Matches that plain SQL can state too: same source row and equal evaluation text."""
    t, p = timeline(spark, d, "truth"), timeline(spark, d, "pred")
    a = t.select("video_id", "event_key", F.col("idx").alias("truth_idx"), TX.compact_eval(F.col("text")).alias("a"))
    b = p.select("video_id", "event_key", F.col("idx").alias("pred_idx"), TX.compact_eval(F.col("text")).alias("b"))
    m = a.join(b, ["video_id", "event_key"]).where("a = b").select(
        "video_id", "truth_idx", "pred_idx", F.lit(1.0).alias("similarity"), F.lit(True).alias("exact"), F.lit(0.5).alias("temporal_iou")
    )
    return t, p, m


_R = lambda x: f"coalesce(round_even({x}, 6), 0)"


_REPORT = f"""with {_MATCH},
v as (select distinct video_id from truth),
nt as (select video_id, count(*) as truth, count(*) filter (tier = 'A') as ta from t group by 1),
np as (select video_id, count(*) as n from p group by 1),
g as (select video_id, count(*) as matched, avg(abs(se)) as s, avg(abs(ee)) as e, count(*) filter (abs(se) <= uncertainty and abs(ee) <= uncertainty) as wu,
  count(*) filter (tier = 'A') as am, count(*) filter (tier = 'A' and se = 0) as axs, count(*) filter (tier = 'A' and ee = 0) as axe, count(*) filter (tier = 'A' and se = 0 and ee = 0) as axb,
  avg(abs(se)) filter (tier = 'A') as aas, avg(abs(ee)) filter (tier = 'A') as aae from m group by 1),
z as (select v.video_id, coalesce(truth, 0) as truth, coalesce(n, 0) as n, coalesce(matched, 0) as mt, coalesce(wu, 0) as wu, coalesce(ta, 0) as ta, coalesce(am, 0) as am, coalesce(axs, 0) as axs, coalesce(axe, 0) as axe, coalesce(axb, 0) as axb, coalesce(s, 0) as s, coalesce(e, 0) as e, coalesce(aas, 0) as aas, coalesce(aae, 0) as aae from v left join nt using (video_id) left join np using (video_id) left join g using (video_id)),
pr as (select *, coalesce(mt/nullif(n, 0), 0) as prec, coalesce(mt/nullif(truth, 0), 0) as rec from z)
select video_id, 30::double as fps, truth, n as prediction, n as evaluated_prediction, 0::bigint as merged_groups, mt as matched, n - mt as false_positive, truth - mt as false_negative,
 {_R('prec')} as precision, {_R('rec')} as recall, {_R('prec*rec*2/nullif(prec+rec, 0)')} as f1, mt as exact_text, case when mt > 0 then 1 else 0 end::double as exact_text_rate,
 case when mt > 0 then 1 else 0 end::double as mean_similarity, case when mt > 0 then 1 else 0 end::double as min_similarity, {_R('s')} as start_frame_mae, {_R('e')} as end_frame_mae, {_R('s/30')} as start_seconds_mae, {_R('e/30')} as end_seconds_mae,
 wu as within_uncertainty, {_R('wu/nullif(mt, 0)')} as within_uncertainty_rate, ta as tier_a_truth, am as tier_a_matched, axs as tier_a_exact_start, axe as tier_a_exact_end, axb as tier_a_exact_both,
 {_R('aas')} as tier_a_start_mae, {_R('aae')} as tier_a_end_mae, ta > 0 and ta = axb as tier_a_passed from pr"""


@query("timeline_report", oracle("truth pred", _REPORT))
def timeline_report(spark, d):
    t, p, m = _key_matches(spark, d)
    return EV.timeline_report(t, p, m, videos(t))


@query("match_rows", oracle("truth pred", f"with {_MATCH} select video_id, truth_idx, pred_idx, tier, uncertainty, se as start_error, ee as end_error from m"))
def match_rows(spark, d):
    t, p, m = _key_matches(spark, d)
    return EV.match_rows(t, p, m).select("video_id", "truth_idx", "pred_idx", "tier", "uncertainty", "start_error", "end_error")


@query("false_positives", oracle("truth pred", f"with {_MATCH} select video_id, idx, text, start_frame, end_frame from p where not exists (select 1 from m where m.video_id = p.video_id and m.pred_idx = p.idx)"))
def false_positives(spark, d):
    _, p, m = _key_matches(spark, d)
    return EV.unmatched(p, m, "pred").select("video_id", "idx", "text", "start_frame", "end_frame")


@query("false_negatives", oracle("truth pred", f"with {_MATCH} select video_id, idx, text, start_frame, end_frame from t where not exists (select 1 from m where m.video_id = t.video_id and m.truth_idx = t.idx)"))
def false_negatives(spark, d):
    t, _, m = _key_matches(spark, d)
    return EV.unmatched(t, m, "truth").select("video_id", "idx", "text", "start_frame", "end_frame")


@query("merge_multiline")
def merge_multiline(spark, d):
    t = load(spark, d, "truth")
    return EV.merge_multiline(timeline(spark, d, "pred"), videos(t))


@query("similar_texts")
def similar_texts(spark, d):
    side = lambda n: load(spark, d, n).select("video_id", TX.compact_eval(F.col("text")).alias("compact"))
    return EV.similar_texts(side("truth"), side("pred"), 0.72)


@query("align_timelines")
def align_timelines(spark, d):
    return EV.align_timelines(timeline(spark, d, "truth"), timeline(spark, d, "pred"))


@query("evaluate_timelines")
def evaluate_timelines(spark, d):
    t = cut(timeline(spark, d, "truth"))
    return EV.evaluate_timelines(t, cut(timeline(spark, d, "pred")), videos(t))


def _fixed(value: str, digits: int) -> str:
    """The number with so many decimals, halves rounded up as decimals."""
    return f"cast(cast(round(cast({value} as decimal(28, 6)), {digits}) as decimal(28, {digits})) as varchar)"


@query("tier_a_rows", oracle("truth pred", f"""with {_MATCH}
select t.video_id, t.idx as truth_idx, t.text as truth_text, pred_idx, p.text as pred_text, pred_idx is not null as matched,
 coalesce(se = 0, false) as exact_start, coalesce(ee = 0, false) as exact_end, coalesce(se = 0 and ee = 0, false) as exact_both, se as start_error, ee as end_error
from t left join m on m.video_id = t.video_id and m.truth_idx = t.idx left join p on p.video_id = t.video_id and p.idx = pred_idx where t.tier = 'A'"""))
def tier_a_rows(spark, d):
    return EV.tier_a_rows(*_key_matches(spark, d))


@query("report_lines", oracle("truth pred", f"""with rep as ({_REPORT}), {_MATCH},
bad as (select p.video_id, p.idx, p.text, p.start_frame, p.end_frame, 0 as side from p where not exists (select 1 from m where m.video_id = p.video_id and m.pred_idx = p.idx)
 union all select t.video_id, t.idx, t.text, t.start_frame, t.end_frame, 1 from t where not exists (select 1 from m where m.video_id = t.video_id and m.truth_idx = t.idx))
select video_id, (case when i < 7 then i else 7 + greatest(1, false_positive) end)::bigint as line_no, case i when 0 then 'Visual subtitle timeline evaluation'
 when 1 then '  Truth: '||truth||' | Prediction: '||prediction||' | Matched: '||matched
 when 2 then '  Detection: precision='||{_fixed('precision', 4)}||' recall='||{_fixed('recall', 4)}||' f1='||{_fixed('f1', 4)}
 when 3 then '  Text: exact='||exact_text||'/'||matched||' mean_similarity='||{_fixed('mean_similarity', 4)}
 when 4 then '  Boundaries: start_MAE='||{_fixed('start_frame_mae', 3)}||' frames end_MAE='||{_fixed('end_frame_mae', 3)}||' frames'
 when 5 then '  Tier A: matched='||tier_a_matched||'/'||tier_a_truth||' exact_both='||tier_a_exact_both||'/'||tier_a_truth||' result='||case when tier_a_passed then 'PASS' else 'FAIL' end
 when 6 then '  False positives ('||false_positive||'):' else '  False negatives ('||false_negative||'):' end as line
 from rep, unnest([0, 1, 2, 3, 4, 5, 6, 7]) u(i)
union all select video_id, 7, '    (none)' from rep where false_positive = 0
union all select video_id, 8 + greatest(1, false_positive), '    (none)' from rep where false_negative = 0
union all select video_id, case side when 0 then 7 else 8 + greatest(1, false_positive) end + row_number() over (partition by video_id, side order by idx) - 1,
 '    ['||idx||'] '||start_frame||'-'||end_frame||' '||text from bad join rep using (video_id)"""))
def report_lines(spark, d):
    t, p, m = _key_matches(spark, d)
    return EV.report_lines(EV.timeline_report(t, p, m, videos(t)), EV.unmatched(p, m, "pred"), EV.unmatched(t, m, "truth"))


def _timed(spark, d, name):
    out = timeline(spark, d, name)
    return out.select("video_id", "idx", "text", (F.col("start_frame") / 30).alias("start_time"), ((F.col("end_frame") + 1) / 30).alias("end_time"))


@query("greedy_match")
def greedy_match(spark, d):
    return EV.greedy_match(_timed(spark, d, "truth"), _timed(spark, d, "pred"))


@query("proxy_report", oracle("truth pred", f"""with {_MATCH}, nt as (select video_id, count(*) as a from t group by 1), np as (select video_id, count(*) as b from p group by 1),
x as (select m.video_id, t.start_frame/30 as rs, (t.end_frame+1)/30 as re, p.start_frame/30 as ps, (p.end_frame+1)/30 as pe from m join t on t.video_id = m.video_id and t.idx = truth_idx join p on p.video_id = m.video_id and p.idx = pred_idx),
g as (select video_id, count(*) as c, avg(abs(rs-ps)) as s, avg(abs(re-pe)) as e from x group by 1)
select video_id, coalesce(a, 0) as reference_count, coalesce(b, 0) as prediction_count, coalesce(c, 0) as matched_count, coalesce(round_even(c/a, 4), 0) as coverage,
 case when c > 0 then 1 else 0 end::double as mean_similarity, coalesce(round_even(s, 4), 0) as mean_start_error, coalesce(round_even(e, 4), 0) as mean_end_error
from nt full join np using (video_id) left join g using (video_id)"""))
def proxy_report(spark, d):
    t, p, m = _key_matches(spark, d)
    rt, pt = _timed(spark, d, "truth"), _timed(spark, d, "pred")
    side = lambda df, n: df.select("video_id", F.col("idx").alias({"ref": "truth", "pred": "pred"}[n] + "_idx"), F.col("start_time").alias(f"{n}_start"), F.col("end_time").alias(f"{n}_end"))
    matches = m.join(side(rt, "ref"), ["video_id", "truth_idx"]).join(side(pt, "pred"), ["video_id", "pred_idx"])
    return EV.proxy_report(rt, pt, matches)


_CODED = "list_reduce(list_prepend('', list_transform({0}, lambda w: chr((33 + list_position(u, w))::int))), lambda x, y: x || y)"


@query("corpus_error_rates", oracle("truth pred", f"""with j as (select t.video_id, {Q.norm_eval('t.text')} as a, {Q.norm_eval('p.text')} as b from truth t join pred p on p.video_id = t.video_id and p.event_key = t.event_key),
s as (select *, list_filter(string_split(a, ' '), lambda w: w <> '') as wa, list_filter(string_split(b, ' '), lambda w: w <> '') as wb from j),
d as (select *, list_distinct(wa || wb) as u from s),
g as (select video_id, cast(sum(levenshtein({_CODED.format('wa')}, {_CODED.format('wb')})) as bigint) as word_edits, cast(sum(len(wa)) as bigint) as words,
 cast(sum(levenshtein(a, b)) as bigint) as char_edits, cast(sum(length(a)) as bigint) as chars from d group by 1)
select *, coalesce(round_even(word_edits/nullif(words, 0), 6), 0) as wer, coalesce(round_even(char_edits/nullif(chars, 0), 6), 0) as cer from g"""))
def corpus_error_rates(spark, d):
    t = load(spark, d, "truth").select("video_id", "event_key", F.col("text").alias("reference"))
    p = load(spark, d, "pred").select("video_id", "event_key", F.col("text").alias("hypothesis"))
    return EV.corpus_error_rates(t.join(p, ["video_id", "event_key"]), ["video_id"])


@query("character_error_rates", oracle("truth pred", f"""with j as (select t.video_id, {Q.norm_eval('t.text')} as a, {Q.norm_eval('p.text')} as b from truth t join pred p on p.video_id = t.video_id and p.event_key = t.event_key),
g as (select video_id, cast(sum(levenshtein(a, b)) as bigint) as char_edits, cast(sum(length(a)) as bigint) as chars, cast(sum({Q.ntok('a')}) as bigint) as words from j group by 1)
select *, coalesce(round_even(char_edits/nullif(chars, 0), 6), 0) as cer from g"""))
def character_error_rates(spark, d):
    return corpus_error_rates(spark, d).select("video_id", "char_edits", "chars", "words", "cer")


@query("binned_boundary_errors", oracle("truth pred", """with r as (select video_id, cast(floor(start_frame/4000) as bigint) as segment, min(start_frame)/30 as rs, max(end_frame + 1)/30 as re from truth group by all),
c as (select video_id, start_frame/30 as s, (end_frame + 1)/30 as e from pred),
b as (select r.video_id, segment, rs, re, min(s) as f, max(e) as l, count(*) as n from r join c on c.video_id = r.video_id and (s + e)/2 >= rs and (s + e)/2 < re group by all),
g as (select video_id, count(*) as filled, sum(n)::bigint as cues, round_even(avg(abs(f - rs)), 6) as start_mae, round_even(avg(abs(l - re)), 6) as end_mae, round_even(max(abs(l - re)), 6) as max_end_error from b group by 1)
select t.video_id, segments, coalesce(filled, 0) as filled, coalesce(cues, 0) as cues, start_mae, end_mae, max_end_error from (select video_id, count(*) as segments from r group by 1) t left join g using (video_id)"""))
def binned_boundary_errors(spark, d):
    segments = load(spark, d, "truth").groupBy("video_id", F.floor(F.col("start_frame") / 4000).alias("segment")).agg(
        (F.min("start_frame") / 30).alias("start_time"), (F.max(F.col("end_frame") + 1) / 30).alias("end_time"))
    cues = load(spark, d, "pred").select("video_id", (F.col("start_frame") / 30).alias("start_time"), ((F.col("end_frame") + 1) / 30).alias("end_time"))
    return EV.binned_boundary_errors(segments, cues)
