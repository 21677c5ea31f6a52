"""Registered queries from detections to caption events."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.config import CaptionConfig
from captrail.functions import text as TX
from captrail.operators import compose as CO
from captrail.operators import tracks as TR
from captrail.operators.folds import cut
from captrail.operators.ordered import top_k_per
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources.tables import load, oracle

REGION = (50, 350, 1000, 900)


def _crop():
    """Frame width, crop height and crop offsets."""
    return tuple(F.lit(v) for v in (1000, 600, 0, 200))


@query("filter_candidates", oracle("obs", f"""select video_id, frame_index, cand_no, text, confidence from obs
where confidence >= {Q.f(.8)} and length(trim(text)) >= 4 and length(regexp_replace(trim(text), '[^\\p{{L}}]', '', 'g')) >= 2
 and length(regexp_replace(trim(text), '[^\\p{{L}}]', '', 'g'))/length(trim(text)) >= {Q.f(.35)}
 and not regexp_full_match(regexp_replace(trim(text), '\\s+', '', 'g'), '[\\d/:%+.-]+') and not regexp_matches(trim(text), '\\b\\d+\\s*[hmsHMS]\\b')
 and ((y1+y2)/2-200)/600 between {Q.f(.27)} and {Q.f(.84)} and ((x1+x2)/2/1000 between {Q.f(.17)} and {Q.f(.83)} or (x2-x1)/1000 >= {Q.f(.55)})"""))
def filter_candidates(spark, d):
    out = CO.filter_candidates(load(spark, d, "obs"), *_crop(), CaptionConfig(min_ocr_confidence=0.8))
    return out.select("video_id", "frame_index", "cand_no", "text", "confidence")


_SCORE = f"""(confidence*{Q.f(.45)} + least(1, {Q.ntok("trim(regexp_replace(text, chr(92)||'s+', ' ', 'g'))")}/{Q.f(5)})*{Q.f(.15)}
 + least(1, greatest(1, x2-x1)/greatest(1, 1000*{Q.f(.65)}))*{Q.f(.15)} + greatest(0, 1 - abs(((y1+y2)/2-200)/600-{Q.f(.54)})/{Q.f(.28)})*{Q.f(.2)}
 + greatest(0, 1 - abs((x1+x2)/2/1000-{Q.f(.5)})/{Q.f(.5)})*{Q.f(.05)})"""


@query("rank_candidates", oracle("obs", f"""with s as (select *, {_SCORE} as sc from obs)
select video_id, frame_index, cand_no, text, confidence, round(sc, 9) as score,
 row_number() over (partition by video_id, frame_index order by sc desc, cand_no, x1, x2, y1, y2, text) as rank from s"""))
def rank_candidates(spark, d):
    ranked = CO.rank_candidates(load(spark, d, "obs"), *_crop())
    return ranked.select("video_id", "frame_index", "cand_no", "text", "confidence", F.round("score", 9).alias("score"), "rank")


@query("top_candidates", oracle("obs", f"""with s as (select video_id, cand_no, text, x1, y1, x2, y2, confidence, {_SCORE} as sc from obs)
select video_id, cand_no, text, rank from (select *, row_number() over (partition by video_id order by sc desc, cand_no, x1, x2, y1, y2, text) as rank from s) q where rank <= 24"""))
def top_candidates(spark, d):
    obs = load(spark, d, "obs").withColumn("sc", CO.candidate_score(*_crop()))
    order = [F.desc("sc"), *[F.col(c) for c in ("cand_no", "x1", "x2", "y1", "y2", "text")]]
    return top_k_per(obs, ["video_id"], order, 24, ["frame_index"]).select("video_id", "cand_no", "text", "rank")


@query("sessionize", oracle("obs", f"""with t as (select distinct video_id, ts from obs),
g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > {Q.f(1.3)} + 1e-6::double then ts end as o from t window w as (partition by video_id order by ts)),
s as (select video_id, ts, last_value(o ignore nulls) over (partition by video_id order by ts) as session_id from g)
select o.video_id, s.session_id, count(*) as n, min(o.ts) as first_ts, max(o.ts) as last_ts from obs o join s on s.video_id = o.video_id and s.ts = o.ts group by all"""))
def sessionize(spark, d):
    return TR.sessionize(load(spark, d, "obs")).groupBy("video_id", "session_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def _durations(spark, d):
    return load(spark, d, "obs").groupBy("video_id").agg((F.max("ts") + 0.25).alias("duration"))


def composed(spark, d):
    """Composed observations, stored once because several branches read them."""
    return cut(CO.unnest_frames(CO.compose_lines(CO.nest_frames(load(spark, d, "obs")), REGION)))


@query("summarize_tracks", oracle("obs", f"""with a as (select *, cast(floor(frame_index/4) as bigint) as session_id, 0 as lines, cast(floor(y1/55) as bigint) as track_no, {Q.norm_caption('text')} as norm from obs),
r as (select *, row_number() over (partition by video_id, session_id, track_no order by length(norm) desc, confidence desc, ts, cand_no, text desc) as rn from a),
du as (select video_id, max(ts) + 0.25::double as duration from obs group by 1),
t as (select r.video_id, session_id, track_no, max(text) filter (rn = 1) as text, min(ts) as f, max(ts) as l, avg(confidence) as conf, count(*) as hits,
  min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from r group by all)
select t.video_id, session_id, track_no, text, round_even(f, 3) as start_time, round_even(greatest(least(duration, l+0.5::double), f+0.1::double), 3) as end_time,
 round(round_even(conf, 4), 3) as confidence, hits, x1, y1, x2, y2 from t join du using (video_id) where least(duration, l+0.5::double) - f >= 0.1::double"""))
def summarize_tracks(spark, d):
    a = load(spark, d, "obs").withColumns({
        "session_id": F.floor(F.col("frame_index") / 4), "lines": F.lit(0), "track_no": F.floor(F.col("y1") / 55),
    })
    out = TR.summarize_tracks(a, _durations(spark, d))
    return out.select("video_id", "session_id", "track_no", "text", "start_time", "end_time",
                      F.round("confidence", 3).alias("confidence"), "hits", "box.*")


@query("union_observations", oracle("obs", """with p as (select video_id, frame_index, cand_no, case when frame_index % 3 = 0 then 1 else 0 end as stage from obs
 union all select video_id, frame_index, cand_no + 1000000, 1 from obs where frame_index % 2 = 0),
f as (select video_id, frame_index, stage, min(cand_no) as first_cand, count(*) as n from p group by all)
select video_id, frame_index, arg_min(first_cand, stage) as first_cand, arg_min(n, stage) as n from f group by all"""))
def union_observations(spark, d):
    obs = load(spark, d, "obs")
    pack = lambda df: df.groupBy("video_id", "frame_index").agg(F.min("cand_no").alias("first_cand"), F.count(F.lit(1)).alias("n"))
    coarse = pack(obs.where("frame_index % 3 <> 0"))
    later = obs.where("frame_index % 3 = 0").unionByName(
        obs.where("frame_index % 2 = 0").withColumn("cand_no", F.col("cand_no") + 1000000)
    )
    return CO.union_observations(coarse, pack(later)).drop("stage")


@query("compose_lines")
def compose_lines(spark, d):
    return CO.unnest_frames(CO.compose_lines(CO.nest_frames(load(spark, d, "obs")), REGION))


@query("associate_tracks")
def associate_tracks(spark, d):
    return TR.associate_tracks(composed(spark, d))


@query("merge_duplicates")
def merge_duplicates(spark, d):
    """Merging over summarised tracks of a coarse, overlap-rich association."""
    a = load(spark, d, "obs").withColumns({
        "session_id": F.floor(F.col("frame_index") / 4), "lines": F.lit(0).cast("int"), "track_no": F.floor(F.col("y1") / 55),
    })
    return TR.merge_duplicates(cut(TR.summarize_tracks(a, _durations(spark, d))))


@query("build_events")
def build_events(spark, d):
    return TR.build_events(composed(spark, d), _durations(spark, d))
