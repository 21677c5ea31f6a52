"""Registered queries over change scores and boundary refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.config import CaptionConfig
from captrail.operators import changes as CH
from captrail.operators import refine as RF
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources.tables import load, oracle

_CS = """sig as (select label as video_id, vec_id % 2 as variant, vec_id as frame_index, embedding as sg from embeddings),
lagd as (select *, lag(sg) over (partition by video_id, variant order by frame_index) as bf from sig),
ex as (select video_id, variant, frame_index, unnest(sg)::double as a, unnest(bf)::double as b from lagd where bf is not null),
cs as (select video_id, variant, frame_index, avg(abs(a-b)) as score from ex group by all)"""


def _signatures(spark, d):
    return load(spark, d, "embeddings").select(
        F.col("label").alias("video_id"), (F.col("vec_id") % 2).alias("variant"), F.col("vec_id").alias("frame_index"),
        F.col("embedding").cast("array<double>").alias("signature"),
    )


@query("change_scores", f"with {_CS} select video_id, variant, frame_index, round(score, 9) as score from cs")
def change_scores(spark, d):
    return CH.change_scores(_signatures(spark, d)).withColumn("score", F.round("score", 9))


# Scores with clear peaks, from prices of one part of the lines.
_SC = """sc as (select l_partkey % 100 as video_id, l_linenumber % 3 as variant, l_orderkey as frame_index,
  cast(cast(max(l_extendedprice) as bigint) % 60 as double) / 10 + case when l_orderkey % 9 = 0 then 8 else 0 end as score from lineitem group by 1, 2, 3)"""


def _scores(spark, d):
    li = load(spark, d, "lineitem")
    base = li.groupBy(
        (F.col("l_partkey") % 100).alias("video_id"), (F.col("l_linenumber") % 3).alias("variant"),
        F.col("l_orderkey").alias("frame_index"),
    ).agg(F.max("l_extendedprice").alias("p"))
    return base.select(
        "video_id", "variant", "frame_index",
        ((F.col("p").cast("bigint") % 60).cast("double") / 10 + F.when(F.col("frame_index") % 9 == 0, 8).otherwise(0)).alias("score"),
    )


_IV = f"""{_SC.replace('cast(max(l_extendedprice) as bigint)', 'cast(trunc(max(l_extendedprice)) as bigint)')},
md as (select video_id, variant, median(score) as b, count(*) as n from sc group by all),
th as (select sc.video_id, sc.variant, greatest({Q.f(2)}, any_value(b) + greatest(1, median(abs(score-b))*5)) as threshold from sc join md using (video_id, variant) where n >= 2 group by all),
raw as (select sc.*, threshold from sc join th using (video_id, variant) where score >= threshold),
lg as (select *, case when lag(frame_index) over w is null or frame_index - lag(frame_index) over w > 2 then frame_index end as op from raw window w as (partition by video_id, variant order by frame_index)),
cl as (select *, last_value(op ignore nulls) over (partition by video_id, variant order by frame_index) as c from lg),
pk as (select video_id, variant, frame_index, score, threshold from (select *, row_number() over (partition by video_id, variant, c order by score desc, frame_index) as rn from cl) where rn = 1),
pr as (select *, lead(frame_index) over w as nf, lead(score) over w as ns from pk window w as (partition by video_id, variant order by frame_index)),
sp as (select video_id, variant, frame_index as start_frame, nf - 1 as end_frame, least(score, ns) as priority, threshold from pr where nf is not null and nf - frame_index between 4 and 69),
iv as (select * from sp where not exists (select 1 from sc o where o.video_id = sp.video_id and o.frame_index % 40 = 0 and o.frame_index between start_frame and end_frame))"""


def _videos(scores):
    return scores.select("video_id").distinct().withColumn("fps", F.lit(40.0))


def _intervals(spark, d):
    s = _scores(spark, d)
    observed = s.where("frame_index % 40 = 0").select("video_id", "frame_index").distinct()
    cfg = CaptionConfig(sample_fps=0.6667)
    return CH.stable_intervals(s, observed, _videos(s), cfg), observed, s


@query("stable_intervals", f"""with {_IV} select video_id, variant, start_frame, end_frame, cast(floor((start_frame+end_frame)/2) as bigint) as frame_index, priority,
 priority/greatest(1, threshold) as strength from iv""")
def stable_intervals(spark, d):
    return _intervals(spark, d)[0]


@query("merge_variants", f"""with {_IV} select video_id, cast(floor((start_frame+end_frame)/2) as bigint) as frame_index, max(priority/greatest(1, threshold)) as strength,
 max(priority) as priority, count(*) as support from iv group by all""")
def merge_variants(spark, d):
    return CH.merge_variants(_intervals(spark, d)[0])


@query("select_probes", f"""with recursive {_IV},
mv as (select video_id, cast(floor((start_frame+end_frame)/2) as bigint) as frame_index, max(priority/greatest(1, threshold)) as strength, max(priority) as priority, count(*) as support from iv group by all),
c as (select *, frame_index % 40 = 0 and exists (select 1 from sc where sc.video_id = mv.video_id and sc.frame_index = mv.frame_index) as observed,
 row_number() over (partition by video_id order by strength desc, support desc, priority desc, frame_index desc) as n from mv),
r as (select distinct video_id, 0::bigint as n, []::bigint[] as taken, null::bigint as frame_index, null::double as strength from mv
 union all select c.video_id, c.n, case when ok then list_append(taken, c.frame_index) else taken end, case when ok then c.frame_index end, c.strength
 from (select r.video_id, r.n as before, r.taken, c.n, c.frame_index, c.strength, len(r.taken) < 24 and not c.observed and not list_bool_or(list_transform(list_append(r.taken, -9), lambda t: abs(c.frame_index - t) <= 1)) as ok
  from r join c on c.video_id = r.video_id and c.n = r.n + 1) c)
select video_id, frame_index, strength from r where frame_index is not null""")
def select_probes(spark, d):
    intervals, observed, s = _intervals(spark, d)
    return CH.select_probes(CH.merge_variants(intervals), observed, _videos(s), 24)


def _coarse(spark, d):
    """Coarse events and observations around them, from the detections."""
    obs = load(spark, d, "obs")
    events = obs.select(
        "video_id", F.xxhash64("cand_no", "x1", "x2", "text", "y2").alias("cue_id"), "text",
        (F.col("ts") + 0.25).alias("start_time"), (F.col("ts") + 0.75).alias("end_time"),
        "confidence", F.struct("x1", "y1", "x2", "y2").alias("box"),
    ).dropDuplicates(["video_id", "cue_id"])
    videos = obs.groupBy("video_id").agg((F.max("ts") + 0.5).alias("duration"), F.lit(2.0).alias("fps"))
    return events, obs, videos


@query("event_frame_hits")
def event_frame_hits(spark, d):
    events, obs, _ = _coarse(spark, d)
    return RF.event_frame_hits(events, obs, (F.col("start_time") - 1, F.col("end_time")), 0.5)


@query("refine_boundaries")
def refine_boundaries(spark, d):
    events, obs, videos = _coarse(spark, d)
    return RF.refine_boundaries(events, obs, videos).select("video_id", "cue_id", "start_time", "end_time")


_ST = """states as (select user_id % 50 as video_id, cast(floor(event_id / 400) as bigint) as cue_id, event_id as frame_index, (event_id % 400) > 150 + (user_id % 7) * 20 as hit from events),
ss as (select user_id % 50 as video_id, event_id as frame_index, cast(cast(floor(value*10) as bigint) % 50 as double) as score from events)"""


@query("locate_transitions", f"""with {_ST},
p as (select video_id, cue_id, min(frame_index) filter (hit) as positive from states group by all),
b as (select s.video_id, s.cue_id, positive, max(frame_index) filter (not hit and frame_index < positive) as negative from states s join p using (video_id, cue_id) where positive is not null group by all),
c as (select b.video_id, b.cue_id, arg_min(ss.frame_index, (-score, ss.frame_index)) as candidate from b join ss on ss.video_id = b.video_id and ss.frame_index > negative and ss.frame_index <= positive group by all)
select b.video_id, b.cue_id, negative, positive, candidate,
 coalesce(a.hit, false) and not coalesce(z.hit, true) as confirmed,
 case when coalesce(a.hit, false) and not coalesce(z.hit, true) then candidate else positive end as transition
from b left join c using (video_id, cue_id) left join states a on a.video_id = b.video_id and a.cue_id = b.cue_id and a.frame_index = candidate
left join states z on z.video_id = b.video_id and z.cue_id = b.cue_id and z.frame_index = candidate - 1""")
def locate_transitions(spark, d):
    ev = load(spark, d, "events")
    states = ev.select(
        (F.col("user_id") % 50).alias("video_id"), F.floor(F.col("event_id") / 400).alias("cue_id"),
        F.col("event_id").alias("frame_index"), ((F.col("event_id") % 400) > 150 + (F.col("user_id") % 7) * 20).alias("hit"),
    )
    scores = ev.select(
        (F.col("user_id") % 50).alias("video_id"), F.col("event_id").alias("frame_index"),
        (F.floor(F.col("value") * 10) % 50).cast("double").alias("score"),
    )
    return RF.locate_transitions(states, scores)
