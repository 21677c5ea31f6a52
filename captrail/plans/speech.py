"""Registered queries over speech segments and their fusion with visual events."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.operators import fusion as FU
from captrail.operators.folds import cut
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources.tables import load, oracle


def segments(spark, d):
    """Decoder segments: word i of a turn starts .3 i seconds into it."""
    asr = load(spark, d, "asr")
    pieces = F.split("text", r"\s+")
    at = lambda i, add: F.col("seg_start") + (i * 300 + add).cast("double") / 1000
    words = F.transform(pieces, lambda w, i: F.struct(
        F.concat(F.lit(" "), w).alias("word"), at(i, F.lit(0)).alias("start"), at(i, F.lit(250)).alias("end"),
        F.when(F.length(w) % 5 != 0, (F.length(w) % 10).cast("double") / 10 + F.lit(0.05)).alias("confidence"),
    ))
    n = F.size("words")
    return asr.withColumn("words", F.when(F.col("seg_idx") % 6 != 5, words)).select(
        "video_id", "seg_idx", "text", F.col("seg_start").alias("start_time"),
        (F.col("seg_start") + F.greatest(n, F.lit(1)) * F.lit(0.3)).alias("end_time"),
        F.lit(0.5).alias("base_confidence"), "words",
    )


def speech_cues(spark, d):
    out = FU.resegment_asr(segments(spark, d))
    return out.withColumn("asr_id", F.col("seg_idx") * 100000 + F.col("part"))


@query("resegment_asr")
def resegment_asr(spark, d):
    return FU.resegment_asr(segments(spark, d))


def _aligned(spark, d):
    asr = load(spark, d, "asr")
    i = F.col("seg_idx")
    score = lambda w: (F.length(w) % 12).cast("double") / 8 - F.lit(0.125)
    words = F.transform(F.split("text", " "), lambda w, k: F.struct(
        w.alias("word"), (F.col("seg_start") + k * F.lit(0.5)).alias("start"),
        (F.col("seg_start") + k * F.lit(0.5) + (F.length(w) - 3) * F.lit(0.25)).alias("end"), score(w).alias("score"),
    ))
    base = asr.withColumn("words", words)
    aligned = base.where("video_id % 9 <> 4").select(
        "video_id", "seg_idx", F.when(i % 3 == 1, "").otherwise(F.col("text")).alias("text"),
        F.when(i % 2 == 0, F.col("seg_start")).alias("start"),
        F.when(i % 4 < 2, F.col("seg_start") + 20).when(i == 6, F.col("seg_start") - 1).alias("end"),
        F.lit(0.7).alias("score"), F.when(i % 5 != 3, F.col("words")).alias("words"),
    )
    transcript = base.select(
        "video_id", "seg_idx", F.when(i % 2 == 0, F.concat(F.lit(" "), F.col("text"))).alias("text"),
        F.when(i != 3, F.col("seg_start") + 1).alias("start"), F.when(i % 3 != 2, F.col("seg_start") + 9).alias("end"),
        F.lit(0.4).alias("score"), F.lit(None).cast("array<struct<word:string,start:double,end:double,score:double>>").alias("words"),
    )
    return aligned, transcript


_NORM_ASR = f"""al as (select video_id, seg_idx, case when seg_idx % 3 = 1 then '' else text end as text,
   case when seg_idx % 2 = 0 then seg_start end as s, case when seg_idx % 4 < 2 then seg_start + 20 when seg_idx = 6 then seg_start - 1 end as e,
   {Q.f(.7)} as score, seg_idx % 5 <> 3 as has_words, text as full_text, seg_start from asr where video_id % 9 <> 4),
tr as (select video_id, seg_idx, case when seg_idx % 2 = 0 then ' '||text end as text, case when seg_idx <> 3 then seg_start + 1 end as s,
   case when seg_idx % 3 <> 2 then seg_start + 9 end as e, {Q.f(.4)} as score, false as has_words, text as full_text, seg_start from asr),
src as (select * from al union all select * from tr where video_id % 9 = 4),
w0 as (select video_id, seg_idx, seg_start, unnest(string_split(full_text, ' ')) as word, generate_subscripts(string_split(full_text, ' '), 1) - 1 as k from src where has_words),
w1 as (select *, seg_start + k*0.5::double as a, seg_start + k*0.5::double + (length(word)-3)*0.25::double as b, greatest(0, least(1, (length(word)%12)::double/8 - 0.125::double)) as c from w0 where trim(word) <> ''),
w2 as (select *, case when a >= 0 and b >= 0 and b < a then null when a >= 0 then round_even(a, 3) end as ws, case when a >= 0 and b >= 0 and b < a then null when b >= 0 then round_even(b, 3) end as we, round_even(c, 4) as wc from w1),
wa as (select video_id, seg_idx, string_agg(word, '' order by k) as spelled, arg_min(ws, k) filter (ws is not null and we is not null) as fs, arg_max(we, k) filter (ws is not null and we is not null) as le, avg(wc) as conf, count(*) as nw from w2 group by all),
j as (select src.video_id, src.seg_idx, trim(coalesce(nullif(src.text, ''), tr.text, '')) as given, spelled, coalesce(src.s, tr.s, fs) as st, coalesce(src.e, tr.e, le) as en, coalesce(conf, src.score) as confidence, coalesce(nw, 0) as nw
  from src left join tr using (video_id, seg_idx) left join wa using (video_id, seg_idx))
select video_id, seg_idx, case when given <> '' then given else trim(spelled) end as text, round_even(st, 3) as start_time, round_even(en, 3) as end_time, round_even(confidence, 4) as confidence, nw as words
from j where coalesce(nullif(given, ''), trim(spelled), '') <> '' and en > st"""


@query("normalize_asr", oracle("asr", f"with {_NORM_ASR}"))
def normalize_asr(spark, d):
    out = FU.normalize_asr(*_aligned(spark, d))
    return out.withColumn("words", F.size("words").cast("bigint"))


def visual_events(spark, d):
    """Visual events that quote a turn, some of them misread."""
    asr = load(spark, d, "asr")
    i = F.col("seg_idx")
    quote = F.upper("text")
    text = F.when(i % 4 == 1, F.replace(quote, F.lit("E"), F.lit("F"))).when(i % 4 == 2, F.replace(quote, F.lit(" "), F.lit(""))).otherwise(quote)
    conf = F.when(i % 5 == 0, 0.98).when(i % 5 == 1, 0.93).otherwise(0.7)
    return asr.select(
        "video_id", F.col("seg_idx").alias("cue_id"), text.alias("text"), (F.col("seg_start") + 0.6).alias("start_time"),
        (F.col("seg_start") + 1.6).alias("end_time"), conf.alias("confidence"),
        F.struct(F.lit(100).alias("x1"), F.lit(500).alias("y1"), F.lit(400).alias("x2"), F.lit(550).alias("y2")).alias("box"),
        F.lit("ocr").alias("source"),
    )


@query("join_asr", oracle("asr cues", f"""with sp as (select user_id % 50 as video_id, event_id as asr_id, (event_id*25 + 300)::double/1000 as a, (event_id*25 + 900)::double/1000 as b from events)
select c.video_id, cue_id, asr_id from cues c join sp on sp.video_id = c.video_id and least(c.end_time, b + {Q.f(.45)}) > greatest(c.start_time, greatest(0, a - {Q.f(.45)}))"""))
def join_asr(spark, d):
    speech = load(spark, d, "events").select(
        (F.col("user_id") % 50).alias("video_id"), F.col("event_id").alias("asr_id"), F.lit("x").alias("text"), F.lit(0.5).alias("confidence"),
        ((F.col("event_id") * 25 + 300).cast("double") / 1000).alias("start_time"),
        ((F.col("event_id") * 25 + 900).cast("double") / 1000).alias("end_time"),
    )
    return FU.join_asr(load(spark, d, "cues"), speech).select("video_id", "cue_id", "asr_id")


@query("fuse_asr")
def fuse_asr(spark, d):
    out = FU.fuse_asr(visual_events(spark, d), cut(speech_cues(spark, d)))
    return out.drop("box")
