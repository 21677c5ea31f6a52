"""Registered queries over cue timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.operators import cues as C
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources.tables import cues, load, oracle



def _roi():
    return F.struct(*[F.lit(v).alias(k) for k, v in (("x1", 80), ("y1", 450), ("x2", 640), ("y2", 760))])


_ORD = "start_time, end_time, cue_id"
_NEXT = f"""
nx as (select *, lead(struct_pack(start_time := start_time, x1 := x1, y1 := y1, x2 := x2, y2 := y2))
         over (partition by video_id order by {_ORD}) as n from cues),
nb as (select *, n.start_time as n_start, n.x1 as n_x1, n.y1 as n_y1, n.x2 as n_x2, n.y2 as n_y2 from nx),
res as (select video_id, cue_id, text, start_time, confidence,
  case when n is not null and abs(start_time - n_start) > {Q.f(.005)} and end_time > n_start
        and (x1 is null or n_x1 is null or {Q.spatial('', 'n_')} > 0 or {Q.stream('', 'n_')})
       then round_even(greatest(start_time + {Q.f(.05)}, n_start), 3) else end_time end as end_time
  from nb)
"""


def _marked(src: str) -> str:
    return f"""
mk0 as (select *, cast(round_even(start_time*1000, 0) as bigint) as s, cast(round_even(end_time*1000, 0) as bigint) as e from {src}),
mk1 as (select *, coalesce(max(e) over (partition by video_id order by {_ORD}
          rows between unbounded preceding and 1 preceding), 0) as reach from mk0),
mk as (select *, greatest(0, s - reach) as gap_before, greatest(0, e - greatest(s, reach)) as new_time from mk1)
"""


@query("resolve_overlaps", oracle("cues", f"with {_NEXT} select video_id, cue_id, start_time, end_time from res"))
def resolve_overlaps(spark, d):
    return C.resolve_overlaps(cues(spark, d)).select("video_id", "cue_id", "start_time", "end_time")


@query("timeline_quality", oracle("cues", f"""with {_NEXT}, {_marked('res')}
select video_id, count(*) as cues, cast(sum(new_time) as bigint) as covered_ms, max(gap_before) as longest_gap_ms
from mk group by video_id"""))
def timeline_quality(spark, d):
    return C.timeline_quality(cues(spark, d))


@query("timeline_stats", oracle("cues", f"""with {_marked('cues')},
d as (select *, cast(round_even((end_time-start_time)*1000, 0) as bigint) as dur,
        length(regexp_replace(text, '\\s', '', 'g')) as chars from mk)
select video_id, count(*) as cues, min(dur) as min_ms, median(dur) as median_ms, max(dur) as max_ms,
  count(*) filter (dur < 600) as short_cues, count(*) filter (chars*1000 > dur*20) as fast_cues,
  cast(sum(new_time) as bigint) as covered_ms, max(e) as last_ms, max(gap_before) as longest_gap_ms,
  round_even(sum(new_time)/max(e), 6) as covered_share
from d group by video_id"""))
def timeline_stats(spark, d):
    return C.timeline_stats(cues(spark, d))


@query("audit_order", oracle("cues", f"""with p as (select *, lag(cue_id) over w as previous_id, lag(end_time) over w as previous_end,
  max(end_time) over (partition by video_id order by {_ORD} rows between unbounded preceding and 1 preceding) as reach
  from cues window w as (partition by video_id order by {_ORD}))
select video_id, cue_id, previous_id, previous_end, start_time, previous_end > start_time as adjacent
from p where reach > start_time"""))
def audit_order(spark, d):
    return C.audit_order(cues(spark, d))


@query("number_cues", oracle("cues", f"""select video_id, cue_id,
  row_number() over (partition by video_id order by {_ORD}) as number from cues"""))
def number_cues(spark, d):
    return C.number_cues(cues(spark, d)).select("video_id", "cue_id", "number")


def _clock_sql(ms: str, sep: str) -> str:
    return (
        f"lpad(cast({ms}//3600000 as varchar), 2, '0')||':'||lpad(cast(({ms}//60000)%60 as varchar), 2, '0')||':'||"
        f"lpad(cast(({ms}//1000)%60 as varchar), 2, '0')||'{sep}'||lpad(cast({ms}%1000 as varchar), 3, '0')"
    )


def _srt_sql(round_fn: str) -> str:
    ms = lambda c: f"cast({round_fn.format(c + '*1000')} as bigint)"
    return oracle("cues", f"""select video_id, row_number() over (partition by video_id order by {_ORD}) as number,
  cast(row_number() over (partition by video_id order by {_ORD}) as varchar)||chr(10)||
  {_clock_sql(ms('start_time'), ',')}||' --> '||{_clock_sql(ms('end_time'), ',')}||chr(10)||trim(text) as block from cues""")


@query("srt_blocks", _srt_sql("round_even({}, 0)"))
def srt_blocks(spark, d):
    return C.srt_blocks(cues(spark, d))


@query("srt_blocks_service", _srt_sql("floor({} + 0.5::double)"))
def srt_blocks_service(spark, d):
    return C.srt_blocks(cues(spark, d), style="service")


@query("cue_at", oracle("frames cues", """
select f.video_id, f.pts, cast((f.pts-3)*1 as double)/11988 as t,
  case when cast((f.pts-3)*1 as double)/11988 < c.end_time then c.cue_id end as cue_id,
  case when cast((f.pts-3)*1 as double)/11988 < c.end_time then c.text end as text
from frames f left join lateral (
  select * from cues c where c.video_id = f.video_id and c.start_time <= cast((f.pts-3)*1 as double)/11988
  order by start_time desc, end_time desc, cue_id desc limit 1) c on true"""))
def cue_at(spark, d):
    points = load(spark, d, "frames").select(
        "video_id", "pts", (((F.col("pts") - 3) * 1).cast("double") / 11988).alias("t")
    )
    return C.cue_at(points, cues(spark, d))


@query("cues_in_window", oracle("cues", """with win as (select video_id, cue_id as view_id,
    start_time - 1 as view_start, start_time + 4 as view_end from cues)
select w.video_id, w.view_id, c.cue_id,
  round_even((greatest(c.start_time, view_start) - view_start)*100/(view_end-view_start), 4) as left_pct,
  round_even((least(c.end_time, view_end) - greatest(c.start_time, view_start))*100/(view_end-view_start), 4) as width_pct
from win w join cues c on c.video_id = w.video_id and c.start_time < view_end and c.end_time > view_start"""))
def cues_in_window(spark, d):
    c = cues(spark, d)
    views = c.select(
        "video_id", F.col("cue_id").alias("view_id"), (F.col("start_time") - 1).alias("view_start"),
        (F.col("start_time") + 4).alias("view_end"),
    )
    return C.cues_in_window(c, views)


@query("active_at_grid", oracle("cues", """with v as (select video_id, max(end_time) as duration from cues group by 1),
g as (select video_id, i as sample_index, i*duration/15 as t from v, range(16) r(i))
select g.video_id, cast(sample_index as int) as sample_index, t, cue_id from g join cues c on c.video_id = g.video_id
and c.start_time <= t and t < c.end_time"""))
def active_at_grid(spark, d):
    c = cues(spark, d)
    videos = c.groupBy("video_id").agg(F.max("end_time").alias("duration"))
    return C.active_at_grid(c, videos, 16)


_DIMS = "dims as (select *, greatest(1, x2-x1)::double as w, greatest(1, y2-y1)::double as h, (x1+x2)/2 as cx, (y1+y2)/2 as cy from cues where x1 is not null)"
_DOM = f"""{_DIMS},
sup as (select a.video_id, a.cue_id, a.h, a.cy, a.start_time, a.end_time,
   sum(cast(round_even(least({Q.f(6)}, b.w/b.h)*greatest({Q.f(.2)}, b.confidence)*1000000000, 0) as bigint)) as support
 from dims a join dims b on a.video_id = b.video_id and abs(b.cy-a.cy) <= greatest({Q.f(18)}, a.h*{Q.f(.55)}, b.h*{Q.f(.4)})
 group by all),
seed as (select video_id, h as sh, cy as scy from (select *, row_number() over (partition by video_id order by support desc, {_ORD}) as rn from sup) where rn = 1),
domset as (select d.* from dims d join seed using (video_id) where abs(cy-scy) <= greatest({Q.f(18)}, sh*{Q.f(.55)}, h*{Q.f(.4)})),
dom as (select video_id, median(cy) as dominant_cy, median(h) as dominant_h, count(*) as dominant_events,
   (select count(*) from dims x where x.video_id = domset.video_id) as boxed_events from domset group by video_id)"""


@query("dominant_geometry", oracle("cues", f"with {_DOM} select * from dom"))
def dominant_geometry(spark, d):
    return C.dominant_geometry(cues(spark, d))


def _losers(src: str) -> str:
    return f"""
lb as (select *, {Q.norm_caption('text')} as norm, contains(text, chr(10)) as multi from {src} where x1 is not null),
wins as (select e.video_id, e.cue_id as e_id, s.cue_id as s_id from lb e join lb s on e.video_id = s.video_id and e.multi and not s.multi
  and s.confidence >= {Q.f(.96)} and s.confidence - e.confidence >= {Q.f(.06)} and {Q.substantial('e.', 's.')}
  and {Q.run_contained('e.norm', 's.norm')} and {Q.smaller_overlap('e.', 's.')} >= {Q.f(.88)}),
hang as (select c.video_id, c.cue_id from wins w join lb e on e.video_id = w.video_id and e.cue_id = w.e_id
  join lb s on s.video_id = w.video_id and s.cue_id = w.s_id
  join lb c on c.video_id = w.video_id and c.cue_id <> w.e_id and c.cue_id <> w.s_id
   and s.confidence - c.confidence >= {Q.f(.06)} and {Q.substantial('s.', 'c.')} and {Q.substantial('e.', 'c.')}
   and {Q.smaller_overlap('e.', 'c.')} >= {Q.f(.08)} and {Q.stacked('s.', 'c.')}),
losers as (select video_id, e_id as cue_id from wins union select video_id, cue_id from hang)"""


@query("suppress_competitors", oracle("cues", f"with {_losers('cues')} select * from losers"))
def suppress_competitors(spark, d):
    return C.competitor_losers(cues(spark, d))


_FILTER = f"""{_DOM},
j as (select c.*, d.w, d.h, d.cx, d.cy, dom.dominant_h as dh, abs(d.cy-dom.dominant_cy) as vo, abs(d.cx-{Q.f(360)}) as ho,
  c.end_time - c.start_time >= {Q.f(1.25)} as lasting, least(abs(c.x1-80), abs(640-c.x2)) as edge, dom.boxed_events
  from cues c left join dims d using (video_id, cue_id) left join dom on dom.video_id = c.video_id),
rj as (select * from j where coalesce(boxed_events, 0) < 2 or x1 is null or not (
  h < greatest({Q.f(6)}, dh*{Q.f(.3)})
  or (lasting and w/h < {Q.f(2.6)} and (vo > dh*{Q.f(.25)} or ho > 560*{Q.f(.18)}))
  or (lasting and h < dh*{Q.f(.75)} and vo > dh*{Q.f(.4)})
  or (h < dh*{Q.f(.55)} and vo > dh*{Q.f(.4)})
  or (vo > dh*{Q.f(.6)} and ho > 560*{Q.f(.2)} and w < 560*{Q.f(.55)})
  or (ho > 560*{Q.f(.35)} and w < 560*{Q.f(.16)} and h < dh*{Q.f(.8)})
  or (edge <= greatest({Q.f(3)}, 560*{Q.f(.01)}) and w < 560*{Q.f(.6)} and (h < dh*{Q.f(.75)} or h > dh*{Q.f(1.2)})))),
{_losers('rj')}"""


@query("filter_dominant", oracle("cues", f"""with {_FILTER}
select video_id, cue_id from rj where not exists (select 1 from losers l where l.video_id = rj.video_id and l.cue_id = rj.cue_id)"""))
def filter_dominant(spark, d):
    return C.filter_dominant(cues(spark, d), _roi(), 2.0).select("video_id", "cue_id")


@query("adopt_visual_track", oracle("cues", """select video_id, md5('visual|'||video_id||'|'||cue_id) as cue_id, trim(text) as text,
  start_time, end_time, confidence, x1, y2, 'visual' as source from cues
  where trim(text) <> '' and start_time >= 0 and end_time > start_time"""))
def adopt_visual_track(spark, d):
    out = C.adopt_track(cues(spark, d), "visual")
    return out.withColumns({"x1": F.col("box.x1"), "y2": F.col("box.y2")}).drop("box")


@query("api_cues", oracle("cues", f"""select video_id, row_number() over (partition by video_id order by {_ORD}) as number,
  trim(text) as text, start_time, end_time, confidence from cues"""))
def api_cues(spark, d):
    return C.to_api(cues(spark, d))


_BAD = """bad as (select video_id, cue_id, case when cue_id % 29 = 0 then '  ' else text end as text,
  case when cue_id % 31 = 0 then -start_time when cue_id % 37 = 0 then cast('nan' as double) else start_time end as start_time,
  case when cue_id % 41 = 0 then start_time when cue_id % 43 = 0 then null else end_time end as end_time from cues)"""


def _bad(spark, d):
    i = F.col("cue_id")
    return cues(spark, d).select(
        "video_id", "cue_id", F.when(i % 29 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(i % 31 == 0, -F.col("start_time")).when(i % 37 == 0, F.lit(float("nan"))).otherwise(F.col("start_time")).alias("start_time"),
        F.when(i % 41 == 0, F.col("start_time")).when(i % 43 == 0, F.lit(None)).otherwise(F.col("end_time")).alias("end_time"),
    )


@query("lint_cues", oracle("cues", f"""with {_BAD}, r as (select video_id, cue_id, case when trim(text) = '' then 'blank_text'
  when start_time is null or end_time is null or isnan(start_time) or isnan(end_time) then 'bad_time'
  when start_time < 0 or end_time <= start_time then 'bad_range' end as rule from bad)
select video_id, min(cue_id) as cue_id, arg_min(rule, cue_id) as rule, count(*) as violations from r where rule is not null group by 1"""))
def lint_cues(spark, d):
    return C.lint_cues(_bad(spark, d))


@query("editor_form", oracle("cues", f"""with {_BAD}, s as (select *, greatest(0, case when isnan(start_time) or start_time is null then 0 else start_time end)::double as st from bad)
select video_id, cue_id, text, st as start_time, greatest(st, coalesce(end_time, st + 2)) as end_time from s"""))
def editor_form(spark, d):
    return C.editor_form(_bad(spark, d))


@query("apply_cue_patches", oracle("cues", """select video_id, cue_id, case when cue_id % 3 = 0 then lower(text) else text end as text,
  case when cue_id % 6 = 0 then start_time + 1 else start_time end as start_time, end_time,
  case when cue_id % 6 = 0 then null else cue_id end as start_frame from cues"""))
def apply_cue_patches(spark, d):
    c = cues(spark, d).select("video_id", "cue_id", "text", "start_time", "end_time", F.col("cue_id").alias("start_frame"))
    patches = c.where("cue_id % 3 = 0").select(
        "video_id", "cue_id", F.lower("text").alias("text"),
        F.when(F.col("cue_id") % 6 == 0, F.col("start_time") + 1).alias("start_time"),
        F.when(F.col("cue_id") % 9 == 0, F.col("end_time")).alias("end_time"),
    )
    return C.apply_cue_patches(c, patches)


@query("coverage_gaps", oracle("truth", """with v as (select video_id, max(end_frame) + 100 as frame_count from truth group by 1),
p as (select *, coalesce(max(end_frame) over (partition by video_id order by start_frame, end_frame, event_key
  rows between unbounded preceding and 1 preceding), -1) + 1 as gap_start from truth)
select video_id, gap_start, start_frame - 1 as gap_end from p where gap_start <= start_frame - 1
union all select video_id, frame_count - 99 as gap_start, frame_count - 1 as gap_end from v"""))
def coverage_gaps(spark, d):
    t = load(spark, d, "truth")
    videos = t.groupBy("video_id").agg((F.max("end_frame") + 100).alias("frame_count"))
    return C.coverage_gaps(t, videos)
