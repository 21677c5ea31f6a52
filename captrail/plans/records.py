"""Registered queries over documents and loosely typed records."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.operators import clean as CL
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources import readers as RD
from captrail.sources import writers as WR
from captrail.sources.tables import cues, load, oracle


def _items(spark, d):
    """Loose cue records as JSON: aliases, strings, faults."""
    c = load(spark, d, "cues")
    i = F.col("cue_id")
    start, end = F.col("start_time").cast("string"), F.col("end_time").cast("string")
    fields = F.struct(
        F.when(i % 3 == 0, start).alias("start_time"), F.when(i % 3 == 1, start).alias("startTime"), F.when(i % 3 == 2, start).alias("start"),
        F.when(i % 2 == 0, end).alias("end_time"), F.when((i % 2 == 1) & (i % 21 != 0), end).alias("end"),
        F.when(i % 5 != 0, F.concat(F.lit("  "), F.col("text"), F.lit("\r\n"))).alias("text"),
        F.when(i % 7 == 0, (F.col("confidence") * 2).cast("string")).when(i % 7 == 1, "oops").when(i % 7 < 6, F.col("confidence").cast("string")).alias("confidence"),
        F.when(i % 4 == 0, F.array("x1", "y1", "x2", "y2").cast("array<string>")).when(i % 4 == 1, F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("position"),
        F.when(i % 6 < 4, F.col("start_ms").cast("string")).when(i % 6 == 4, "1.5").alias("start_frame"),
        F.when(i % 6 == 0, (F.col("start_ms") - 5).cast("string")).otherwise((F.col("start_ms") + 5).cast("string")).alias("end_frame_exclusive"),
        F.when(i % 10 != 0, F.concat(F.lit("c"), i.cast("string"))).alias("id"),
    )
    return c.select(F.col("video_id").alias("owner"), i.alias("n"), F.parse_json(F.to_json(fields)).alias("item"))


_ITEMS = f"""it as (select video_id as owner, cue_id as n, start_time as s, case when cue_id % 2 = 0 or cue_id % 21 <> 0 then end_time end as e,
 case when cue_id % 7 = 0 then confidence*2 when cue_id % 7 between 2 and 5 then confidence end as conf, cue_id % 7 < 6 as conf_given, cue_id as i, x1 is null as nobox, start_ms, text as raw from cues),
jd as (select *, (e is null or e <= s) as bad_time, conf_given and (conf is null or conf > 1) as bad_conf, (i % 4 = 1 or (i % 4 = 0 and nobox)) as bad_box, i % 6 = 4 as bad_int, (i % 6 = 0 and start_ms - 5 >= 1) as bad_order, (i % 6 = 0 and start_ms - 5 < 1) as low_end from it),
pb as (select *, case when bad_time then 'time' when bad_conf then 'confidence' when bad_box then 'position' when bad_int or low_end then 'integer' when bad_order then 'frame_order' end as problem from jd)"""


@query("judge_cues", oracle("cues", f"""with {_ITEMS} select owner, n, case when i % 10 = 0 then 'subtitle-'||n else 'c'||i end as id,
 case when i % 5 = 0 then '' else trim(raw) end as text, s as start_time, e as end_time, case when conf_given then greatest(0, least(1, coalesce(conf, 0))) end::double as confidence,
 case when i % 6 < 4 then start_ms end as start_frame, case when low_end then null when i % 6 = 0 then start_ms - 5 else start_ms + 5 end as end_frame_excl, problem from pb"""))
def judge_cues(spark, d):
    return CL.judge_cues(_items(spark, d)).select("owner", "n", "id", "text", "start_time", "end_time", "confidence", "start_frame", "end_frame_excl", "problem")


@query("normalize_cues_strict", oracle("cues", f"with {_ITEMS} select owner, n, problem from pb where problem is not null"))
def normalize_cues_strict(spark, d):
    return CL.normalize_cues(_items(spark, d), strict=True)[1]


@query("normalize_cues_lenient", oracle("cues", f"with {_ITEMS} select owner, n, s as start_time, e as end_time from pb where not bad_time"))
def normalize_cues_lenient(spark, d):
    return CL.normalize_cues(_items(spark, d), strict=False)[0].select("owner", "n", "start_time", "end_time")


@query("normalize_visual", oracle("cues", f"with {_ITEMS} select cast(owner as varchar) as owner, n, s as start_time, e as end_time, case when conf is not null then greatest(0, least(1, conf)) end as confidence, case when i % 4 = 0 and not nobox then 4 when i % 4 = 1 then 3 else 0 end as sides from pb where not bad_time"))
def normalize_visual(spark, d):
    out = CL.normalize_visual(_items(spark, d))[0]
    return out.select("owner", "n", "start_time", "end_time", "confidence", F.size("bbox").alias("sides"))


def _audio_items(spark, d):
    a = load(spark, d, "asr")
    i = F.col("seg_idx")
    words = F.transform(F.split("text", " "), lambda w, k: F.struct(
        w.alias("word"), F.when(k % 5 != 3, F.col("seg_start") + k).alias("start"), F.when(k % 7 != 4, F.col("seg_start") + k + (F.length(w) - 4)).alias("end"),
        (F.length(w) / 8).alias("score"),
    ))
    fields = F.struct(F.col("text"), F.when(i % 2 == 0, F.col("seg_start")).alias("start"), F.when(i % 3 == 0, F.col("seg_start") + 9).alias("end_time"), words.alias("words"))
    return a.select(F.col("video_id").alias("owner"), i.alias("n"), F.parse_json(F.to_json(fields)).alias("item"))


@query("normalize_audio", oracle("asr", """with w as (select video_id, seg_idx, seg_start, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) - 1 as k from asr),
t as (select *, case when k % 5 <> 3 then seg_start + k end as a, case when k % 7 <> 4 and seg_start + k + length(word) - 4 >= 0 then seg_start + k + length(word) - 4 end as b from w where trim(word, ' '||chr(10)) <> ''),
v as (select *, a is not null and b is not null and b > a as timed from t),
g as (select video_id, seg_idx, count(*) as words, min(a) filter (timed) as ws, max(b) filter (timed) as we from v group by 1, 2)
select s.video_id as owner, s.seg_idx as n, case when s.seg_idx % 6 = 0 then seg_start else ws end as start_time, case when s.seg_idx % 6 = 0 then seg_start + 9 else we end as end_time, coalesce(words, 0) as words
from asr s left join g on g.video_id = s.video_id and g.seg_idx = s.seg_idx"""))
def normalize_audio(spark, d):
    out = CL.normalize_audio(_audio_items(spark, d))
    return out.select("owner", "n", "start_time", "end_time", F.size("words").cast("bigint").alias("words"))


def _docs(spark, d, name, fields):
    """Documents of at most 200 records, made from a derived table."""
    df = load(spark, d, name).withColumn("_doc", F.concat_ws("-", F.col("video_id").cast("string"), F.floor(F.col("event_key") / 200).cast("string")))
    rows = df.select(F.col("_doc").alias("doc"), F.struct(F.col("event_key").alias("k"), *fields).alias("r"))
    return rows.groupBy("doc").agg(F.array_sort(F.collect_list("r")).alias("rows"))


def _truth_docs(spark, d):
    k = F.col("event_key")
    fields = [
        F.when(k % 53 != 0, F.col("text")).alias("text"), F.when(k % 59 == 0, -F.col("start_frame")).otherwise(F.col("start_frame")).alias("first_frame"),
        F.when(k % 61 == 0, F.col("start_frame") - 5).otherwise(F.col("end_frame")).alias("last_frame"),
        F.when(k % 4 == 0, F.array(F.lit(1), F.lit(2), F.lit(30), F.lit(40))).when(k % 67 == 0, F.array(F.lit(9), F.lit(2), F.lit(3), F.lit(4))).alias("position"),
        F.col("tier").alias("verification_tier"), F.when(k % 2 == 0, F.col("uncertainty")).alias("boundary_uncertainty_frames"),
    ]
    video = F.struct(F.lit(30.0).alias("fps"))
    return _docs(spark, d, "truth", fields).select("doc", F.to_json(F.struct(video.alias("video"), F.col("rows").alias("events"))).alias("text"))


_TRUTH_RULES = f"""r as (select concat(video_id, '-', cast(floor(event_key/200) as bigint)) as doc, event_key as k, case when event_key % 53 <> 0 then text end as text,
 case when event_key % 59 = 0 and event_key > 0 then null else start_frame end as s, case when event_key % 61 = 0 then case when start_frame >= 5 then start_frame - 5 end else end_frame end as e, event_key % 67 = 0 and event_key % 4 <> 0 as bad_box, tier, case when event_key % 2 = 0 then uncertainty else 0 end as uncertainty from truth),
o as (select *, row_number() over w - 1 as idx, lag(s) over w as ps, lag(e) over w as pe from r window w as (partition by doc order by k)),
j as (select *, case when trim(coalesce(text, '')) = '' then 'text' when s is null or e is null or e < s then 'frames' when bad_box then 'position' when s < ps then 'order' when s <= pe then 'overlap' end as rule from o)"""


@query("read_truth", oracle("truth", f"with {_TRUTH_RULES} select doc, idx, text, s as start_frame, e as end_frame, tier, uncertainty from j where rule is null"))
def read_truth(spark, d):
    return RD.parse_truth(_truth_docs(spark, d))[0].select("doc", "idx", "text", "start_frame", "end_frame", "tier", "uncertainty")


@query("read_truth_rejects", oracle("truth", f"with {_TRUTH_RULES} select doc, idx, rule from j where rule is not null"))
def read_truth_rejects(spark, d):
    return RD.parse_truth(_truth_docs(spark, d))[1]


@query("read_predictions", oracle("pred", """with r as (select concat(video_id, '-', cast(floor(event_key/200) as bigint)) as doc, event_key as k, text, start_frame as s, end_frame as e from pred),
o as (select *, row_number() over (partition by doc order by k) - 1 as raw_idx from r),
g as (select doc, raw_idx, text, greatest(0, s) as start_frame, greatest(greatest(0, s), e) as end_frame from o where not (s < 0 and k % 3 = 0) and k % 41 <> 0)
select *, row_number() over (partition by doc order by start_frame, end_frame, raw_idx) - 1 as idx from g"""))
def read_predictions(spark, d):
    k = F.col("event_key")
    fields = [
        F.when(k % 41 != 0, F.col("text")).alias("text"), F.when(k % 3 == 0, F.col("start_frame")).alias("first_frame"),
        F.when(k % 3 == 0, F.col("end_frame")).alias("last_frame"), F.when(k % 3 != 0, F.greatest(F.lit(0.0), F.col("start_frame") / 30)).alias("start_time"),
        F.when(k % 3 != 0, (F.col("end_frame") + 1) / 30).alias("end_time"),
    ]
    docs = _docs(spark, d, "pred", fields)
    body = F.when(F.pmod(F.hash("doc"), F.lit(2)) == 0, F.to_json("rows")).otherwise(F.to_json(F.struct(F.col("rows").alias("items"))))
    docs = docs.select("doc", body.alias("text"))
    fps = docs.select("doc", F.lit(30.0).alias("fps"))
    return RD.parse_predictions(docs, fps)[0].select("doc", "idx", "raw_idx", "text", "start_frame", "end_frame")


@query("read_srt", """with b as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
x as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as n from b)
select cast(doc_id as varchar) as doc, n as cue_id, trim(regexp_replace(line, '\\s+', ' ', 'g')) as text, n*2::double as start_time, n*2 + 1.5::double as end_time from x where trim(regexp_replace(line, '\\s+', ' ', 'g')) <> '' and n % 7 <> 0""")
def read_srt(spark, d):
    docs = load(spark, d, "documents")
    clock = lambda ms: F.concat(F.lit("00:"), F.lpad(F.floor(ms / 60000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit("\r\n"), F.when((i + 1) % 7 == 0, "no time").otherwise(F.concat(clock((i + 1) * 2000), F.lit(" --> "), clock((i + 1) * 2000 + 1500))),
        F.lit("\r\n"), F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^ | $", "")))
    srt = docs.select(F.col("doc_id").cast("string").alias("doc"), F.concat(F.lit("﻿"), F.array_join(lines, "\r\n\r\n"), F.lit("\r\n")).alias("text"))
    return RD.parse_srt(srt).select("doc", "cue_id", "text", "start_time", "end_time")


@query("read_asr", oracle("asr", """select cast(video_id*10+seg_idx as varchar) as doc, 'audio-0' as cue_id, text, seg_start as start_time, seg_start + 5 as end_time, case when seg_idx % 3 = 0 then 0 else 1 end as words from asr where seg_idx % 4 <> 3"""))
def read_asr(spark, d):
    return RD.parse_asr(_asr_docs(spark, d))[0].select("doc", "cue_id", "text", "start_time", "end_time", F.size("words").alias("words"))


def _asr_docs(spark, d):
    a, i = load(spark, d, "asr"), F.col("seg_idx")
    word = F.array(F.struct(F.lit("w").alias("word"), F.col("seg_start").alias("start"), F.lit(0.5).alias("confidence")))
    cue = F.struct("text", F.col("seg_start").alias("start"), (F.col("seg_start") + 5).alias("end"), F.when(i % 3 != 0, word).alias("words"))
    ok = F.to_json(F.struct(F.lit(True).alias("ok"), F.array(cue).alias("subtitles")))
    bad = F.to_json(F.struct(F.lit(False).alias("ok"), F.lit("no audio").alias("error"), F.lit("ValueError").alias("error_type")))
    return a.select((F.col("video_id") * 10 + i).cast("string").alias("doc"), F.when(i % 4 == 3, bad).otherwise(ok).alias("text"))


@query("read_asr_errors", oracle("asr", "select cast(video_id*10+seg_idx as varchar) as doc, 'ValueError: no audio' as error from asr where seg_idx % 4 = 3"))
def read_asr_errors(spark, d):
    return RD.parse_asr(_asr_docs(spark, d))[1]


@query("read_tasks", oracle("tasks", "select id, filename, status, revision, subtitle_count from tasks where task_no % 13 <> 0"))
def read_tasks(spark, d):
    t = load(spark, d, "tasks")
    item = F.struct(F.when(F.col("task_no") % 13 != 0, F.col("id")).alias("id"), "filename", "status", "revision", F.col("subtitle_count").alias("subtitleCount"))
    docs = t.groupBy(F.floor(F.col("task_no") / 100).cast("string").alias("doc")).agg(F.collect_list(item).alias("tasks"))
    docs = docs.select("doc", F.when(F.pmod(F.hash("doc"), F.lit(2)) == 0, F.to_json("tasks")).otherwise(F.to_json(F.struct("tasks"))).alias("text"))
    return RD.parse_tasks(docs)[0].select("id", "filename", "status", "revision", "subtitle_count")


@query("read_jobs", oracle("tasks", "select id, case when task_no % 2 = 0 then 'audio' else 'visual' end as kind, status, task_no % 3 = 0 as completion_pending from tasks where task_no % 17 <> 0"))
def read_jobs(spark, d):
    n = F.col("task_no")
    job = F.struct(F.col("id").alias("task_id"), F.when(n % 2 == 0, "audio").otherwise("visual").alias("kind"), "status", (n % 3 == 0).alias("completion_pending"))
    docs = load(spark, d, "tasks").select(F.col("id").alias("doc"), F.when(n % 17 == 0, '{"task_id": ').otherwise(F.to_json(job)).alias("text"))
    return RD.parse_jobs(docs).select("id", "kind", "status", "completion_pending")


@query("lint_truth", oracle("truth", """with t as (select video_id, event_key, start_frame, case when event_key % 19 = 0 then end_frame + 40 else end_frame end as end_frame, case when event_key % 23 = 0 then 'D' else tier end as tier,
  case when event_key % 10 = 0 and event_key % 3 = 0 then 1 else uncertainty end as uncertainty, event_key % 29 = 0 as off from truth),
o as (select *, row_number() over w - 1 as idx, lag(end_frame) over w as pe from t window w as (partition by video_id order by event_key))
select video_id, idx, 'tier' as rule from o where tier = 'D' union all select video_id, idx, 'tier_a_uncertainty' from o where tier = 'A' and uncertainty <> 0
union all select video_id, idx, 'overlap' from o where start_frame <= pe union all select video_id, idx, 'start_time' from o where off"""))
def lint_truth(spark, d):
    from captrail.operators.ordered import ordered

    k = F.col("event_key")
    t = load(spark, d, "truth")
    t = ordered(t, ["video_id"], ["event_key"], F.floor(k / 20000), number="_n").select(
        "video_id", (F.col("_n") - 1).alias("idx"), "text", "start_frame", F.when(k % 19 == 0, F.col("end_frame") + 40).otherwise(F.col("end_frame")).alias("end_frame"),
        (F.col("start_frame") / 30 + F.when(k % 29 == 0, 0.01).otherwise(0.0)).alias("start_time"),
        F.when(k % 23 == 0, "D").otherwise(F.col("tier")).alias("tier"),
        F.when((k % 10 == 0) & (k % 3 == 0), 1).otherwise(F.col("uncertainty")).alias("uncertainty"), F.lit(0.9).alias("confidence"),
        F.struct(F.lit(1).alias("x1"), F.lit(1).alias("y1"), F.lit(9).alias("x2"), F.lit(9).alias("y2")).alias("box"),
    ).withColumn("end_time", (F.col("end_frame") + 1) / 30)
    videos = t.groupBy("video_id").agg((F.max("end_frame") + 1).alias("frame_count"), F.lit(30.0).alias("fps"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    return CL.lint_truth(t, videos)


@query("audit_media_manifest", """select cast(page_id as varchar) as task_id, case when page_id % 3 = 0 then 'clip'||page_id||'.MP4' when page_id % 3 = 1 then 'a b.wav' else 'page.html' end as filename,
 case when page_id % 3 = 0 then 'mp4' when page_id % 3 = 1 then 'wav' else 'html' end as suffix,
 case when page_id % 3 = 2 or (page_id % 3 = 1 and page_id % 2 = 0) then 'suffix' when length(html) > 1500 then 'too_large' end as problem from pages""")
def audit_media_manifest(spark, d):
    n = F.col("page_id")
    m = load(spark, d, "pages").select(
        n.cast("string").alias("task_id"),
        F.when(n % 3 == 0, F.concat(F.lit("up/clip\x01"), n.cast("string"), F.lit(".MP4"))).when(n % 3 == 1, "a b.wav").otherwise("page.html").alias("filename"),
        F.when(n % 2 == 0, "video").otherwise("audio").alias("kind"), F.length("html").alias("size_bytes"),
    )
    return CL.audit_media_manifest(m, 1500)


@query("build_diagnostics", oracle("cues", """with v as (select video_id, 30::double as fps, cast(ceil(max(end_time)*30) as bigint) as frame_count from cues group by 1)
select video_id, cue_id, greatest(0, least(frame_count-1, cast(round_even(start_time*fps, 0) as bigint))) as start_frame,
 greatest(greatest(0, least(frame_count-1, cast(round_even(start_time*fps, 0) as bigint)))+1, least(frame_count, cast(ceil(end_time*fps) as bigint))) as end_frame_excl from cues join v using (video_id)"""))
def build_diagnostics(spark, d):
    c = cues(spark, d)
    videos = c.groupBy("video_id").agg(F.lit(30.0).alias("fps"), F.ceil(F.max("end_time") * 30).alias("frame_count"), F.max("end_time").alias("duration"))
    stats = c.groupBy("video_id").agg(F.count(F.lit(1)).alias("cues"))
    return WR.build_diagnostics(c, videos, stats).select("video_id", "cue_id", "event.start_frame", "event.end_frame_excl")
