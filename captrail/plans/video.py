"""Registered queries over frame timing and caption regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.operators import frames as FR
from captrail.operators import roi as R
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources.tables import cues, load, oracle

_TIMED = """
st as (select *, lead(pts) over (partition by video_id order by pts) as nx,
   row_number() over (partition by video_id order by pts) - 1 as frame_index from frames),
ty as (select video_id, greatest(1, cast(round_even(median(nx - pts) filter (nx > pts), 0) as bigint)) as typical, min(pts) as start_pts from st group by 1),
timed as (select st.video_id, frame_index, pts, coalesce(nx - pts, case when duration_pts > 0 then duration_pts end, typical) as duration_pts,
   start_pts, (pts - start_pts)::double / 11988 as ts, nx is null as last from st join ty using (video_id)),
meta as (select video_id, count(*) as frame_count, min(start_pts) as start_pts, max(pts + duration_pts) as end_pts,
   median(duration_pts) filter (not last) as median_step, min(duration_pts) filter (not last) as lo, max(duration_pts) filter (not last) as hi from timed group by 1),
bounds as (select video_id, frame_index, pts, ts from timed union all
   select video_id, frame_index + 1, pts + duration_pts, (pts + duration_pts - start_pts)::double / 11988 from timed where last)
"""


def timed(spark, d):
    return FR.frame_durations(load(spark, d, "frames"))


@query("frame_durations", oracle("frames", f"with {_TIMED} select video_id, frame_index, pts, duration_pts, start_pts, ts from timed"))
def frame_durations(spark, d):
    return timed(spark, d).select("video_id", "frame_index", "pts", "duration_pts", "start_pts", "ts")


@query("video_metadata", oracle("frames", f"""with {_TIMED} select video_id, frame_count, start_pts, end_pts, median_step,
 coalesce(hi - median_step > greatest(1, median_step*{Q.f(.001)}) or median_step - lo > greatest(1, median_step*{Q.f(.001)}), false) as variable_frame_rate,
 (end_pts - start_pts)::double/11988 as duration, frame_count::double/((end_pts - start_pts)::double/11988) as fps,
 start_pts::double/11988 as start_time from meta"""))
def video_metadata(spark, d):
    return FR.video_metadata(timed(spark, d))


@query("sample_frames", oracle("frames", f"""with {_TIMED}, b as (select *, cast(floor((ts + 1e-9::double)*2) as bigint) as bucket from timed)
select video_id, bucket, frame_index, pts, ts from (select *, row_number() over (partition by video_id, bucket order by ts, frame_index) as rn from b) where rn = 1"""))
def sample_frames(spark, d):
    return FR.sample_frames(timed(spark, d), 2.0)


@query("representative_frames", oracle("frames", f"""with {_TIMED},
m as (select video_id, (end_pts - start_pts)::double/11988 as duration, frame_count::double/((end_pts - start_pts)::double/11988) as fps from meta),
g as (select video_id, i as sample_index, least(greatest(0, duration - {Q.f(.5)}/fps), i*duration/15) - {Q.f(.5)}/fps as t from m, range(16) r(i)),
h as (select g.video_id, g.sample_index, coalesce((select min(frame_index) from timed x where x.video_id = g.video_id and x.ts >= g.t),
   (select max(frame_index) from timed x where x.video_id = g.video_id)) as frame_index from g)
select h.video_id, h.frame_index, x.pts, x.ts, cast(min(sample_index) as int) as sample_index from h join timed x on x.video_id = h.video_id and x.frame_index = h.frame_index group by all"""))
def representative_frames(spark, d):
    t = timed(spark, d)
    return FR.representative_frames(t, FR.video_metadata(t), 16)


_SNAP = f"""{_TIMED},
near as (select c.video_id, c.cue_id,
  (select frame_index from bounds b where b.video_id = c.video_id order by abs(b.ts - c.start_time), b.frame_index limit 1) as s,
  (select frame_index from bounds b where b.video_id = c.video_id order by abs(b.ts - c.end_time), b.frame_index limit 1) as e from cues c),
fr as (select n.*, least(frame_count - 1, s) as start_frame, greatest(least(frame_count - 1, s) + 1, least(frame_count, e)) as end_frame_excl from near n join meta using (video_id))
select fr.video_id, cue_id, start_frame, end_frame_excl, a.pts as start_pts, b.pts as end_pts, a.ts as start_time, b.ts as end_time
from fr join bounds a on a.video_id = fr.video_id and a.frame_index = start_frame join bounds b on b.video_id = fr.video_id and b.frame_index = end_frame_excl"""


@query("snap_to_frames", oracle("frames cues", f"with {_SNAP}"))
def snap_to_frames(spark, d):
    out = FR.snap_to_frames(cues(spark, d), timed(spark, d))
    return out.select("video_id", "cue_id", "start_frame", "end_frame_excl", "start_pts", "end_pts", "start_time", "end_time")


@query("frames_in_windows", oracle("frames cues", f"""with {_TIMED} select c.video_id, cue_id as window_id, frame_index, pts, ts
from cues c join timed t on t.video_id = c.video_id and ts >= start_time - 1e-9::double and ts <= end_time + 1e-9::double"""))
def frames_in_windows(spark, d):
    windows = cues(spark, d).select("video_id", F.col("cue_id").alias("window_id"), F.col("start_time").alias("w_start"), F.col("end_time").alias("w_end"))
    out = FR.frames_in_windows(timed(spark, d), windows)
    return out.select("video_id", "window_id", "frame_index", "pts", "ts")


@query("focus_box", oracle("cues", """with m as (select video_id, cast(trunc(median(y1)) as int) as t, cast(trunc(median(y2)) as int) as b, median(greatest(1, y2-y1)) as h
  from cues where x1 is not null group by 1)
select video_id, 154::bigint as x1, greatest(562, t - greatest(6, cast(round_even(h*0.35::double, 0) as bigint))) as y1, 1766::bigint as x2,
 least(821, b + greatest(6, cast(round_even(h*0.35::double, 0) as bigint))) as y2 from m"""))
def focus_box(spark, d):
    c = cues(spark, d)
    roi = F.struct(*[F.lit(v).alias(k) for k, v in R.DEFAULT_ROI.items()])
    videos = c.select("video_id").distinct().select(
        "video_id", F.lit(1920).alias("frame_w"), F.lit(1080).alias("frame_h"), roi.alias("roi")
    )
    return R.focus_box(c, videos)


_SCREEN = f"""sc as (select video_id, frame_index, cand_no, trim(text) as text, confidence, x1::bigint as x1, y1::bigint as y1, x2::bigint as x2, y2::bigint as y2,
  (x2-x1)/{Q.f(1920)} as w, (y2-y1)/{Q.f(1080)} as h, (x1+x2)/2/{Q.f(1920)} as cx, (y1+y2)/2/{Q.f(1080)} as cy
  from (select video_id, frame_index, cand_no, text, confidence, greatest(0, least(1920, x1)) as x1, greatest(0, least(1080, y1)) as y1,
     greatest(0, least(1920, x2)) as x2, greatest(0, least(1080, y2)) as y2 from obs)
  where confidence > {Q.f(.75)} and x2 > x1 and y2 > y1 and (x2-x1)/{Q.f(1920)} >= {Q.f(.01)} and (y2-y1)/{Q.f(1080)} between {Q.f(.008)} and {Q.f(.22)})"""


@query("screen_roi_candidates", oracle("obs", f"with {_SCREEN} select * from sc"))
def screen_roi_candidates(spark, d):
    out = R.screen_candidates(load(spark, d, "obs"), 1920, 1080, 0.75)
    return out.select("video_id", "frame_index", "cand_no", "text", "confidence", "x1", "y1", "x2", "y2", "w", "h", "cx", "cy")


_MEMBERS = f"""{_SCREEN},
mb as (select *, cast(floor(cy*20) as bigint) as cluster_id, frame_index % 16 as sample_index, 16 as sample_count from sc)"""


def _members(spark, d):
    out = R.screen_candidates(load(spark, d, "obs"), 1920, 1080, 0.75)
    return out.withColumns({
        "cluster_id": F.floor(F.col("cy") * 20), "sample_index": F.col("frame_index") % 16, "sample_count": F.lit(16),
    })


@query("score_roi_clusters", oracle("obs", f"""with {_MEMBERS},
pf as (select video_id, cluster_id, sample_index, avg(confidence) as conf, {Q.compact_caption("string_agg(text, ' ' order by x1, cand_no, text)")} as txt from mb group by all),
rn as (select video_id, cluster_id, max(n) as longest_run from (select video_id, cluster_id, count(*) as n from
   (select *, sample_index - row_number() over (partition by video_id, cluster_id order by sample_index) as g from pf) group by video_id, cluster_id, g) group by all),
tx as (select video_id, cluster_id, count(*) as kinds, max(n) as top from (select video_id, cluster_id, txt, count(*) as n from pf where txt <> '' group by all) group by all),
fr as (select video_id, cluster_id, count(*) as frame_hits, avg(conf) as mc, max(sample_index) - min(sample_index) + 1 as span from pf group by all),
bx as (select video_id, cluster_id, median(cy) as mcy, stddev_pop(cy) as spread, avg(greatest(0, 1 - abs(cx-0.5::double)/0.5::double)) as centring from mb group by all)
select video_id, cluster_id, frame_hits, longest_run, cast(floor(mc*1000003 + 0.5::double) as bigint) as mean_confidence, round(mcy, 9) as median_cy,
 round(frame_hits/16*{Q.f(.24)} + mc*{Q.f(.16)} + greatest(0, least(1, (mcy-{Q.f(.25)})/{Q.f(.7)}))*{Q.f(.25)} + (1-least(1, spread/{Q.f(.06)}))*{Q.f(.12)}
  + centring*{Q.f(.08)} + (longest_run/16 + frame_hits/span)/2*{Q.f(.07)} + least(1, coalesce(kinds, 0)/greatest(2, frame_hits*{Q.f(.35)}))*{Q.f(.08)}
  - case when frame_hits/16 >= {Q.f(.6)} and coalesce(top, 0)/frame_hits >= {Q.f(.8)} then 0.5::double else 0 end, 6) as score
from bx join fr using (video_id, cluster_id) join rn using (video_id, cluster_id) left join tx using (video_id, cluster_id)"""))
def score_roi_clusters(spark, d):
    out = R.score_clusters(_members(spark, d))
    return out.select(
        "video_id", "cluster_id", "frame_hits", "longest_run", F.floor(F.col("mean_confidence") * 1000003 + F.lit(0.5)).alias("mean_confidence"),
        F.round("median_cy", 9).alias("median_cy"), F.round("score", 6).alias("score"),
    )


@query("roi_from_cluster", oracle("obs", f"""with {_MEMBERS},
c as (select *, cx between {Q.f(.08)} and {Q.f(.92)} or w >= {Q.f(.3)} as inside from mb),
s as (select video_id, cluster_id,
 coalesce(quantile_cont(x1/{Q.f(1920)}, 0.03) filter (inside), quantile_cont(x1/{Q.f(1920)}, 0.03)) as l,
 coalesce(quantile_cont(x2/{Q.f(1920)}, 0.97) filter (inside), quantile_cont(x2/{Q.f(1920)}, 0.97)) as r,
 quantile_cont(y1/{Q.f(1080)}, 0.03) as t, quantile_cont(y2/{Q.f(1080)}, 0.97) as b, median(h) as th from c group by all),
z as (select *, least({Q.f(.92)}, greatest({Q.f(.4)}, r-l+greatest({Q.f(.04)}, th*{Q.f(1.2)})*2)) as w, least({Q.f(.36)}, greatest({Q.f(.07)}, b-t+greatest({Q.f(.012)}, th*{Q.f(.45)})*2)) as h from s)
select video_id, cluster_id, round_even(greatest(0, least(1-w, (l+r)/2-w/2)), 6) as x, round_even(greatest(0, least(1-h, (t+b)/2-h/2)), 6) as y, round_even(w, 6) as width, round_even(h, 6) as height from z"""))
def roi_from_cluster(spark, d):
    return R.roi_from_cluster(_members(spark, d), 1920, 1080)


@query("estimate_roi")
def estimate_roi(spark, d):
    obs = load(spark, d, "obs")
    shots = obs.select("video_id", "frame_index", F.col("ts")).distinct().withColumn("pts", F.col("frame_index"))
    videos = shots.groupBy("video_id").agg((F.max("ts") + 0.5).alias("duration"), F.lit(2.0).alias("fps"))
    picked = FR.representative_frames(shots, videos, 16)
    counted = picked.groupBy("video_id").agg(F.count(F.lit(1)).alias("sample_count"))
    samples = obs.join(picked.select("video_id", "frame_index", "sample_index"), ["video_id", "frame_index"]).join(counted, "video_id")
    return R.estimate_roi(samples, 1920, 1080)
