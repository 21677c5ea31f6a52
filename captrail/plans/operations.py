"""Registered queries over the task table and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.operators import changes as CH
from captrail.operators import eventlog as EL
from captrail.operators import tasks as TK
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources.tables import load, oracle


def tasks(spark, d):
    return load(spark, d, "tasks").withColumn("progress", F.lit("40"))


_SRC = """src as (select *, case when analysis_mode = 'audio' then 'skipped' else coalesce(visual_status, case when status in ('queued','processing','completed','failed') then status end, 'pending') end as vs, audio_status as s_as,
  coalesce(visual_progress, 40)::double as vp, audio_progress::double as ap from tasks)"""


@query("task_summary", oracle("tasks", f"""with {_SRC} select id, filename, case when analysis_mode = 'audio' then 'audio' else 'audio_visual' end as analysis_mode, status, vs as visual_status, s_as as audio_status,
 case when analysis_mode = 'audio' then 0 else least(100, vp) end::double as visual_progress, least(100, ap) as audio_progress, visual_error, audio_error, coalesce(revision, 0) as revision, subtitle_count, visual_count, audio_count, archived_at, created_at, updated_at from src"""))
def task_summary(spark, d):
    return TK.task_summary(tasks(spark, d))


@query("parent_state", oracle("tasks", f"""with {_SRC}, f as (select *, vs <> 'skipped' as v, s_as <> 'skipped' as a from src),
g as (select *, (v::int + a::int) as n, (not v or vs in ('completed','failed')) and (not a or s_as in ('completed','failed')) as over, (v and vs = 'completed') or (a and s_as = 'completed') as won,
 (v and vs = 'failed') or (a and s_as = 'failed') as lost, cast(floor((case when v then least(100, vp) else 0 end + case when a then least(100, ap) else 0 end)/greatest(1, v::int + a::int) + 0.5::double) as bigint) as mean,
 case when v then 'Visual' else 'Audio' end as one from f)
select id, case when n = 0 then 'failed' when not over then 'processing' when won then 'completed' else 'failed' end as status, case when n = 0 then 0 when over and won then 100 else mean end as progress,
 case when n = 0 then 'No subtitle source is enabled' when not over then concat_ws(' · ', case when v then 'Visual '||vs end, case when a then 'Audio '||s_as end)
  when won then case when n = 1 then one||' subtitle extraction completed' when lost then 'Subtitle extraction completed with one source unavailable' else 'Visual and audio subtitle extraction completed' end
  else case when n = 1 then one||' subtitle extraction failed' else 'Visual and audio subtitle extraction failed' end end as message,
 case when n = 0 then 'No subtitle source is enabled' when over and not won then coalesce(nullif(concat_ws(' | ', case when v then visual_error end, case when a then audio_error end), ''), 'AI processing failed') end as error from g"""))
def parent_state(spark, d):
    return TK.parent_state(tasks(spark, d))


@query("list_tasks", oracle("tasks", """with m as (select * from tasks where archived_at is null and status = 'processing' and contains(lower(filename), '00')),
p as (select * from m order by coalesce(updated_at, created_at) desc, id limit 20 offset 20)
select id, filename, (select count(*) from m) as total, cast(ceil((select count(*) from m)/20) as bigint) as pages, subtitle_count from p"""))
def list_tasks(spark, d):
    return TK.list_tasks(tasks(spark, d), page=2, limit=20, status="processing", search="00").select("id", "filename", "total", "pages", "subtitle_count")


@query("normalize_job_status", """select o_orderkey as id, case when lower(p) in ('queued','pending') then 'queued' when lower(p) in ('started') then 'processing' when lower(p) in ('done') then 'completed' when lower(p) = 'error' then 'failed' else 'processing' end as status,
 case when o_orderkey % 4 = 0 then case when lower(p) = 'done' then 100 else 0 end else least(100, greatest(0, o_totalprice/1000 - 100)) end::double as progress,
 case when o_orderkey % 3 = 0 then repeat('x', cast(o_orderkey % 5000 + 1 as int)) end as error
 from (select *, case o_orderkey % 5 when 0 then 'Pending' when 1 then 'STARTED' when 2 then 'done' when 3 then 'error' else 'other' end as p from orders)""")
def normalize_job_status(spark, d):
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*[F.lit(w) for w in ("Pending", "STARTED", "done", "error", "other")]), (k % 5 + 1).cast("int"))
    jobs = load(spark, d, "orders").select(
        k.alias("id"), word.alias("status"), F.when(k % 4 == 0, "n/a").otherwise((F.col("o_totalprice") / 1000 - 100).cast("string")).alias("progress"),
        F.when(k % 3 == 0, F.expr("repeat('x', cast(o_orderkey % 5000 + 1 as int))")).alias("error"),
    )
    return TK.normalize_job_status(jobs)


@query("apply_transitions", oracle("tasks edits", """with c as (select task_no, edit_no, arrival_ts as atm, case when expected_revision < 2 then 'start' when expected_revision = 3 then 'archive' else 'noop' end as command from edits),
g as (select task_no, arg_min(edit_no, (atm, edit_no)) filter (command = 'start') as st, min(atm) filter (command = 'archive') as ar, count(*) filter (command = 'start') as n from c group by 1)
select t.id, case when t.status = 'awaiting_roi' and st is not null then 'queued' else t.status end as status, coalesce(archived_at, ar) as archived_at,
 case when t.status = 'awaiting_roi' then st end as started_by, coalesce(n, 0) - case when t.status = 'awaiting_roi' and st is not null then 1 else 0 end as conflicts from tasks t left join g on g.task_no = t.task_no"""))
def apply_transitions(spark, d):
    e = F.col("expected_revision")
    commands = load(spark, d, "edits").select(
        F.concat(F.lit("t"), F.col("task_no").cast("string")).alias("id"), F.col("edit_no").alias("command_no"), F.col("arrival_ts").alias("at"),
        F.when(e < 2, "start").when(e == 3, "archive").otherwise("noop").alias("command"),
    )
    return TK.apply_transitions(tasks(spark, d), commands).select("id", "status", "archived_at", "started_by", "conflicts")


_DECISIONS = """with recursive e as (select e.task_no, edit_no, expected_revision::bigint as expected_revision, e.cue_count::bigint as cue_count, row_number() over (partition by e.task_no order by arrival_ts, edit_no, tie) as n from edits e join tasks t on t.task_no = e.task_no),
r as (select task_no, null::bigint as edit_no, null::bigint as expected_revision, null::boolean as accepted, coalesce(revision, 0)::bigint as revision, null::bigint as cue_count, 0::bigint as n from tasks
 union all select r.task_no, e.edit_no, e.expected_revision, e.expected_revision = r.revision, r.revision + (e.expected_revision = r.revision)::int, e.cue_count, e.n
 from r join e on e.task_no = r.task_no and e.n = r.n + 1)
select task_no, edit_no, expected_revision, accepted, revision, cue_count from r where n > 0"""


@query("replay_edits", oracle("tasks edits", _DECISIONS).replace("with tasks", "with recursive tasks", 1).replace(", recursive e as", ", e as", 1))
def replay_edits(spark, d):
    return TK.replay_edits(tasks(spark, d), load(spark, d, "edits"))


_EDIT_STATE = """with recursive e as (select e.task_no, expected_revision, cue_count, row_number() over (partition by e.task_no order by arrival_ts, edit_no, tie) as n from edits e join tasks t on t.task_no = e.task_no),
r as (select task_no, 0::bigint as n, coalesce(revision, 0) as rev, 0::bigint as acc, 0::bigint as con, null::bigint as cue from tasks
 union all select r.task_no, e.n, r.rev + (e.expected_revision = r.rev)::int, r.acc + (e.expected_revision = r.rev)::int, r.con + (e.expected_revision <> r.rev)::int, case when e.expected_revision = r.rev then e.cue_count else r.cue end
 from r join e on e.task_no = r.task_no and e.n = r.n + 1)
select task_no, arg_max(rev, n) as revision, arg_max(acc, n) as accepted, arg_max(con, n) as conflicts, max_by(cue, n) as cue_count from r where task_no in (select task_no from e) group by 1"""


@query("edit_state", oracle("tasks edits", _EDIT_STATE).replace("with tasks", "with recursive tasks", 1).replace(", recursive e as", ", e as", 1))
def edit_state(spark, d):
    return TK.edit_state(TK.replay_edits(tasks(spark, d), load(spark, d, "edits")))


@query("merge_job_updates", oracle("tasks", """select id, case when task_no % 2 = 0 then case when task_no % 3 = 0 then 'completed' else 'failed' end else status end as status,
 'a' as old_key, case when task_no % 2 = 0 then 'new' else 'old' end as shared, case when task_no % 2 = 0 then case when task_no % 4 = 0 then 'r1' else 'r2' end else 'r1' end as run_id,
 case when task_no % 2 = 1 then 'e5' when task_no % 6 = 0 then 'e9' when task_no % 4 = 0 and task_no % 10 = 0 then 'e5' end as latest_event,
 case when task_no % 2 = 1 or task_no % 4 = 0 then 'f4' end as latest_frame_event from tasks"""))
def merge_job_updates(spark, d):
    n = F.col("task_no")
    base = tasks(spark, d)
    snap = F.struct(F.lit("r1").alias("run_id"), F.lit(5).cast("long").alias("latest_seq"), F.lit("e5").alias("latest_event"), F.lit("f4").alias("latest_frame_event"))
    t = base.select("id", "status", F.create_map(F.lit("k"), F.lit("a"), F.lit("s"), F.lit("old")).alias("metadata"), snap.alias("snapshot"))
    u = base.where(n % 2 == 0).select(
        "id", F.when(n % 3 == 0, "done").otherwise("error").alias("status"), F.create_map(F.lit("s"), F.lit("new")).alias("metadata"),
        F.when(n % 4 == 0, "r1").otherwise("r2").alias("run_id"), F.when(n % 10 == 0, 5).otherwise(6).cast("long").alias("latest_seq"),
        F.when(n % 6 == 0, "e9").alias("latest_event"), F.lit(None).cast("string").alias("latest_frame_event"),
    )
    out = TK.merge_job_updates(t, u)
    return out.select(
        "id", "status", F.col("metadata")["k"].alias("old_key"), F.col("metadata")["s"].alias("shared"),
        "snapshot.run_id", "snapshot.latest_event", "snapshot.latest_frame_event",
    )


def progress(spark, d):
    """Progress events; stage, work counts and preview ids come from the row."""
    e = load(spark, d, "progress")
    k = F.col("k")
    return e.select(
        "task_id", "run_id", "seq", "type", "occurred_at", "progress", "message",
        F.when(k % 4 == 0, "coarse_ocr").when(k % 4 == 1, "boundary_refinement").otherwise("probing").alias("stage"),
        F.when(k % 3 != 0, F.col("seq") % 90).alias("processed"), F.when(k % 5 != 0, F.lit(90)).cast("long").alias("total"),
        F.when(k % 2 == 0, F.concat(F.lit("p"), (k % 12).cast("string"))).alias("preview_id"),
        (F.col("seq") % 50 + k / 100).alias("media_time"), F.concat(F.lit("cue-"), (k % 10).cast("string")).alias("cue_id"),
        F.when(k % 7 == 0, F.concat(F.lit("part "), (k % 9).cast("string"))).alias("label"),
        F.when(k % 6 != 0, F.col("seq") % 140 - 20).alias("stage_progress"), F.when(k % 8 == 0, F.col("seq") % 33).alias("cue_count"),
    )


_PG = """pg as (select task_id, run_id, seq, type, occurred_at, progress, message, k, case k % 4 when 0 then 'coarse_ocr' when 1 then 'boundary_refinement' else 'probing' end as stage,
 case when k % 3 <> 0 then seq % 90 end as processed, case when k % 5 <> 0 then 90::bigint end as total, case when k % 2 = 0 then 'p'||(k % 12) end as preview_id,
 seq % 50 + k/100 as media_time, 'cue-'||(k % 10) as cue_id, case when k % 7 = 0 then 'part '||(k % 9) end as label,
 case when k % 6 <> 0 then seq % 140 - 20 end as stage_progress, case when k % 8 = 0 then seq % 33 end as cue_count from progress)"""


@query("validate_events", oracle("progress", """select task_id, run_id, seq, type, message from progress where event_is_ok""".replace("event_is_ok", "seq % 37 <> 0 and seq % 41 <> 0 and seq % 43 <> 0")))
def validate_events(spark, d):
    e = load(spark, d, "progress")
    s = F.col("seq")
    dirty = e.withColumns({
        "run_id": F.when(s % 37 == 0, F.upper(F.concat("run_id", F.lit("X")))).otherwise(F.col("run_id")),
        "type": F.when(s % 41 == 0, "Bad Type").otherwise(F.col("type")), "_seq": F.when(s % 43 == 0, -s).otherwise(s),
    }).drop("seq").withColumnRenamed("_seq", "seq")
    late = dirty.where("seq % 3 = 0").withColumns({"occurred_at": F.col("occurred_at") + F.expr("interval 1 hour"), "message": F.lit("copy")})
    return EL.validate_events(dirty.unionByName(late)).select("task_id", "run_id", "seq", "type", "message")


@query("keep_increasing", oracle("progress", """with p as (select *, seq * 7 % 1001 as jumbled from progress),
m as (select *, max(jumbled) over (partition by task_id, run_id order by seq rows between unbounded preceding and 1 preceding) as top from p)
select task_id, run_id, seq as position, jumbled as seq from m where top is null or jumbled > top"""))
def keep_increasing(spark, d):
    log = load(spark, d, "progress").select("task_id", "run_id", F.col("seq").alias("position"), (F.col("seq") * 7 % 1001).alias("seq"))
    return EL.keep_increasing(log, "position")


@query("assign_seq", oracle("progress", """with old as (select task_id, run_id, max(seq) as last from progress where seq % 2 = 0 group by all),
n as (select task_id, run_id, seq as position, row_number() over (partition by task_id, run_id order by seq) as n from progress where seq % 2 = 1)
select n.task_id, n.run_id, position, coalesce(last, 0) + n as seq from n left join old using (task_id, run_id)"""))
def assign_seq(spark, d):
    e = load(spark, d, "progress").select("task_id", "run_id", "seq")
    new = e.where("seq % 2 = 1").select("task_id", "run_id", F.col("seq").alias("position"))
    return EL.assign_seq(new, e.where("seq % 2 = 0"), "position")


@query("replay", oracle("progress", """with r as (select task_id, run_id from progress where task_key = 0 group by all order by run_id limit 1),
x as (select p.* from progress p join r using (task_id, run_id)), w as (select * from x where seq > 50)
select task_id, run_id, seq, type, (select max(seq) from x) as latest_seq, (select count(*) > 3 from w) as has_more from w order by seq limit 3"""))
def replay(spark, d):
    e = load(spark, d, "progress")
    first = e.where("task_key = 0").groupBy("task_id").agg(F.min("run_id").alias("run_id")).first()
    return EL.replay(e, first.task_id, first.run_id, 50, 3).select("task_id", "run_id", "seq", "type", "latest_seq", "has_more")


@query("parse_cursor", oracle("progress", """select task_id, run_id, seq, case when seq % 3 = 0 then run_id end as cursor_run, case when seq % 3 < 2 then seq end as cursor_seq from progress"""))
def parse_cursor(spark, d):
    s = F.col("seq")
    text = F.when(s % 3 == 0, F.concat("run_id", F.lit(":"), s.cast("string"))).when(s % 3 == 1, s.cast("string")).otherwise(F.concat(F.lit("x:"), s.cast("string")))
    e = load(spark, d, "progress").withColumn("c", EL.parse_cursor(text))
    return e.select("task_id", "run_id", "seq", F.col("c.run_id").alias("cursor_run"), F.col("c.seq").alias("cursor_seq"))


@query("cursor_requests", oracle("progress", """select task_id, run_id, seq, case when seq % 5 in (0, 3) then null when seq % 5 = 1 then run_id when seq % 5 = 2 and seq % 2 = 0 then run_id end as asked_run,
 case seq % 5 when 0 then null when 1 then seq when 2 then seq when 3 then null else 0 end as asked_seq,
 case seq % 5 when 0 then 'conflict' when 3 then 'unreadable' end as error from progress"""))
def cursor_requests(spark, d):
    s, run = F.col("seq"), F.col("run_id")
    other = F.when(s % 5 == 0, F.lit("f" * 32)).when((s % 5 == 1) | ((s % 5 == 2) & (s % 2 == 0)), run)
    event = F.when(s % 5 < 2, F.concat(run, F.lit(":"), s.cast("string"))).when(s % 5 == 3, "x:1")
    asked = F.when(s % 5 == 2, s.cast("string"))
    out = load(spark, d, "progress").withColumn("c", EL.cursor_request(other, event, asked))
    return out.select("task_id", "run_id", "seq", F.col("c.run_id").alias("asked_run"), F.col("c.seq").alias("asked_seq"), F.col("c.error").alias("error"))


@query("resume_cursors", oracle("progress", """with r as (select task_id, run_id, max(seq) as latest, max((occurred_at, seq)) as newest from progress group by all),
n as (select task_id, arg_max(run_id, newest) as run, arg_max(latest, newest) as latest from r group by 1),
c as (select task_id, run_id as reader, case when latest % 3 = 0 then null else run_id end as run_id, case when latest % 2 = 0 then latest + 5 else latest // 2 end as seq from r)
select c.task_id, reader, c.run_id, c.seq, run, case when c.seq > latest or coalesce(c.run_id <> run, false) then 0 else c.seq end as after,
 c.seq > latest or coalesce(c.run_id <> run, false) as reset from c join n using (task_id)"""))
def resume_cursors(spark, d):
    e = load(spark, d, "progress")
    latest = F.col("latest")
    runs = e.groupBy("task_id", "run_id").agg(F.max("seq").alias("latest"))
    cursors = runs.select(
        "task_id", F.col("run_id").alias("reader"), F.when(latest % 3 != 0, F.col("run_id")).alias("run_id"),
        F.when(latest % 2 == 0, latest + 5).otherwise(F.floor(latest / 2)).alias("seq"))
    return EL.resume_cursors(cursors, e)


@query("retain_previews", oracle("progress", f"""with {_PG}, e as (select distinct task_id, run_id from pg where type in ('job.completed', 'job.failed') and seq % 2 = 0),
v as (select task_id, run_id, preview_id, max(seq) filter (k % 5 = 0) as kept, max(seq) as seq from pg where preview_id is not null group by all),
o as (select *, row_number() over (partition by task_id, run_id order by seq desc) as rn from v where kept is null and not exists (select 1 from e where e.task_id = v.task_id and e.run_id = v.run_id))
select task_id, run_id, preview_id, kept as seq, true as evidence from v where kept is not null union all select task_id, run_id, preview_id, seq, false from o where rn <= 2"""))
def retain_previews(spark, d):
    p = progress(spark, d)
    k = load(spark, d, "progress").select("task_id", "run_id", "seq", (F.col("k") % 5 == 0).alias("evidence"))
    previews = p.where("preview_id is not null").join(k, ["task_id", "run_id", "seq"])
    ended = p.where("type in ('job.completed', 'job.failed') and seq % 2 = 0").select("task_id", "run_id").distinct()
    return EL.retain_previews(previews, ended, 2)


@query("retain_latest", oracle("progress", f"""with {_PG}, l as (select task_id, preview_id, max(seq) as seq from pg where preview_id is not null group by all)
select task_id, preview_id, seq, rank from (select *, row_number() over (partition by task_id order by seq desc) as rank from l) q where rank <= 5"""))
def retain_latest(spark, d):
    return EL.retain_latest(progress(spark, d).where("preview_id is not null"), ["task_id"], "preview_id", 5)


@query("latest_snapshot", oracle("progress", f"""with {_PG}, r as (select task_id, run_id, max(occurred_at) as occ, max(seq) as le, max(seq) filter (type = 'frame.analyzed') as lf, max(seq) filter (type = 'frame.analyzed' and preview_id is not null) as lp from pg group by all)
select task_id, arg_max(run_id, occ) as run_id, max_by(le, occ) as event_seq, arg_max_null(lf, occ) as frame_seq, arg_max_null(lp, occ) as preview_seq from r group by 1"""))
def latest_snapshot(spark, d):
    return EL.latest_snapshot(progress(spark, d)).select(
        "task_id", "run_id", F.col("latest_event.seq").alias("event_seq"), F.col("latest_frame_event.seq").alias("frame_seq"),
        F.col("latest_preview_event.seq").alias("preview_seq"),
    )


@query("stage_stats", oracle("progress", f"""with {_PG}, s as (select task_id, run_id, stage, count(*) as events, count(*) filter (type = 'frame.analyzed') as ocr_calls, max(processed) as processed, max(total) as total,
 (epoch_us(max(occurred_at)) - epoch_us(min(occurred_at)))//1000 as elapsed_ms from pg group by all)
select *, round_even(ocr_calls*1000/nullif(elapsed_ms, 0), 6) as per_second from s"""))
def stage_stats(spark, d):
    return EL.stage_stats(progress(spark, d))


@query("audit_sequences", oracle("progress", """with p as (select task_id, run_id, seq, type, occurred_at from progress union all select task_id, run_id, seq, type, occurred_at from progress where seq % 10 = 0),
q as (select task_id, run_id, seq, count(*) as n, count(*) filter (type in ('job.completed','job.failed')) as t, min(occurred_at) as occ from p group by all),
l as (select *, lag(occ) over (partition by task_id, run_id order by seq) as b from q)
select task_id, run_id, cast(sum(n) as bigint) as events, min(seq) as first_seq, max(seq) as last_seq, max(seq)-min(seq)+1-count(*) as missing, cast(sum(n) as bigint)-count(*) as duplicates, count(*) filter (occ < b) as inversions, cast(sum(t) as bigint) as terminals from l group by all"""))
def audit_sequences(spark, d):
    e = load(spark, d, "progress")
    return EL.audit_sequences(e.unionByName(e.where("seq % 10 = 0")))


@query("audit_media_time", oracle("progress", f"""with {_PG}, l as (select *, lag(media_time) over (partition by task_id, run_id, stage order by seq) as p from pg)
select task_id, run_id, stage, seq, media_time, p as previous_media_time from l where media_time < p"""))
def audit_media_time(spark, d):
    return EL.audit_media_time(progress(spark, d))


def _payloads(spark, d):
    s, k = F.col("seq"), F.col("k")
    cands = F.transform(F.sequence(F.lit(1), (k % 60 + 1).cast("int")), lambda i: F.struct(
        F.concat(F.lit("w"), i.cast("string")).alias("text"), F.when(i % 2 == 0, i / 100).alias("confidence"), F.when(i % 2 == 1, i / 100).alias("score"),
        F.array(i, i + 1, i + 2, i + 3).alias("box"),
    ))
    fields = F.struct(
        F.when(s % 2 == 0, s).alias("frame_index"), F.when(s % 2 == 1, s).alias("frameIndex"), (s * 400).alias("pts"), F.lit(1).alias("time_base_num"),
        (s / 30).alias("media_time"), F.when(s % 3 == 0, "roi").alias("coordinateSpace"), F.when(s % 5 != 0, F.concat(F.lit("p"), k.cast("string"))).alias("previewId"),
        cands.alias("candidates"), F.lit(-3).alias("processed"),
    )
    return load(spark, d, "progress").withColumn("payload", F.to_json(fields))


@query("flatten_frames", oracle("progress", """select task_id, run_id, seq, seq as frame_index, seq*400::double as pts, round(seq/30, 9) as media_time, null::bigint as processed, case when seq % 3 = 0 then 'roi' else 'video' end as coordinate_space,
 case when seq % 5 <> 0 then 'p'||k else '' end as preview_id, k % 60 + 1 as candidates from progress where type = 'frame.analyzed'"""))
def flatten_frames(spark, d):
    out = EL.flatten_frames(_payloads(spark, d))
    return out.select("task_id", "run_id", "seq", "frame_index", "pts", F.round("media_time", 9).alias("media_time"), "processed", "coordinate_space", "preview_id", F.size("candidates").alias("candidates"))


@query("explode_candidates", oracle("progress", """select task_id, run_id, seq, cast(i - 1 as int) as n, 'w'||i as text, i/100 as confidence, i + 3::double as y2, case when seq % 3 = 0 then 'roi' else 'video' end as coordinate_space
 from progress, range(1, 61) r(i) where type = 'frame.analyzed' and i <= k % 60 + 1"""))
def explode_candidates(spark, d):
    out = EL.explode_candidates(EL.flatten_frames(_payloads(spark, d)))
    return out.select("task_id", "run_id", "seq", "n", "text", "confidence", F.get("position", F.lit(3)).alias("y2"), "coordinate_space")


@query("progress_state", oracle("progress", f"""with {_PG}, th as (select task_id, run_id, preview_id, max(seq) as seq from pg where type = 'frame.analyzed' and preview_id is not null group by all),
tr as (select task_id, run_id, string_agg(preview_id, ',' order by seq) as thumbnails from (select *, row_number() over (partition by task_id, run_id order by seq desc) as rn from th) q where rn <= 5 group by all),
b as (select task_id, run_id, max(seq) as last_seq, arg_max(stage, seq) as stage, arg_max(message, seq) as message,
 arg_max(case when type = 'job.completed' then 100 else greatest(0, least(100, progress)) end::double, seq) as progress, arg_max(processed, seq) filter (processed is not null) as processed, arg_max(total, seq) filter (total is not null) as total,
 arg_max(string_split(type, '.')[2], seq) filter (type in ('job.completed', 'job.failed')) as terminal, arg_max(message, seq) filter (type = 'job.failed') as failure,
 arg_max(label, seq) filter (label is not null) as label, arg_max(greatest(0, least(100, stage_progress))::double, seq) filter (stage_progress is not null) as stage_progress,
 arg_max(cue_count, seq) filter (cue_count is not null) as cue_count, max(seq) filter (type = 'frame.analyzed') as frame_seq,
 max(seq) filter (type = 'frame.analyzed' and preview_id is not null) as preview_seq from pg group by all)
select b.*, thumbnails from b left join tr using (task_id, run_id)"""))
def progress_state(spark, d):
    return EL.progress_state(progress(spark, d)).withColumn("thumbnails", F.array_join("thumbnails", ","))


@query("cue_table", oracle("progress", f"with {_PG} select task_id, run_id, cue_id, max(seq) as seq, arg_max(message, seq) as message, count(*) as versions from pg where type = 'cue.upserted' group by all"))
def cue_table(spark, d):
    return EL.cue_table(progress(spark, d))


@query("first_terminal", oracle("progress", "select task_id, run_id, min(seq) as seq, arg_min(type, seq) as type, arg_min(message, seq) as message from progress where type in ('job.completed', 'job.failed') group by all"))
def first_terminal(spark, d):
    return EL.first_terminal(progress(spark, d))


@query("classify_interrupted", oracle("tasks", """select id, case when task_no % 4 = 0 then 'audio' else 'visual' end as kind, case when task_no % 5 <> 0 then 'r' end as run_id, status,
 case when task_no % 4 = 0 and status = 'processing' then 'failed' when status = 'processing' and task_no % 5 <> 0 and task_no % 7 <> 0 then case when task_no % 3 = 0 then 'completed' else 'failed' end else status end as final_status,
 (status = 'processing' and task_no % 5 <> 0 and task_no % 7 <> 0) or task_no % 7 = 0 or (task_no % 4 = 0 and status = 'processing') as recovered from tasks"""))
def classify_interrupted(spark, d):
    n = F.col("task_no")
    jobs = tasks(spark, d).select(
        "id", F.when(n % 4 == 0, "audio").otherwise("visual").alias("kind"), "status", F.when(n % 5 != 0, "r").alias("run_id"),
        (n % 3 == 0).alias("completion_pending"), (n % 7 == 0).alias("recovery_pending"),
    )
    return EL.classify_interrupted(jobs)


@query("rate_limit", oracle("progress", """with recursive p as (select task_id, 'r' as run_id, seq, seq / 20 as "at", seq % 9 = 0 as evidence,
 row_number() over (partition by task_id order by seq) as n from progress where type = 'frame.analyzed'),
r as (select task_id, 0::bigint as n, null::bigint as seq, null::double as "at", null::boolean as evidence, false as kept, null::double as last from p where n = 1
 union all select p.task_id, p.n, p.seq, p."at", p.evidence, p.evidence or r.last is null or p."at" - r.last >= 5,
  case when not p.evidence and (r.last is null or p."at" - r.last >= 5) then p."at" else r.last end from r join p on p.task_id = r.task_id and p.n = r.n + 1)
select task_id, 'r' as run_id, seq, "at", evidence from r where kept""").replace("with progress", "with recursive progress", 1).replace(", recursive p as", ", p as", 1))
def rate_limit(spark, d):
    p = progress(spark, d).where("type = 'frame.analyzed'").select(
        "task_id", F.lit("r").alias("run_id"), "seq", (F.col("seq") / 20).alias("at"), (F.col("seq") % 9 == 0).alias("evidence")
    )
    return EL.rate_limit(p, 5.0)


_POLL = 'over (partition by task_id, run_id order by "at", cursor rows between unbounded preceding and'


@query("stalled_runs", oracle("progress", f"""with p as (select task_id, run_id, (seq*2)::double as "at", seq - seq % 200 as cursor, seq % 3 = 0 as ok from progress),
a as (select *, max(cursor) {_POLL} 1 preceding) as top, sum((not ok)::int) {_POLL} current row) as bad from p),
b as (select *, top is null or cursor > top as moved from a),
c as (select *, last_value(case when moved then "at" end ignore nulls) {_POLL} current row) as moved_at,
 last_value(case when moved then bad - (not ok)::int end ignore nulls) {_POLL} current row) as before from b),
e as (select *, case when bad - before >= 5 then 'errors' when "at" - moved_at > 600 then 'stalled' end as reason from c)
select task_id, run_id, min("at") as "at", arg_min(greatest(cursor, top), ("at", cursor)) as cursor, arg_min(reason, ("at", cursor)) as reason
 from e where reason is not null group by 1, 2"""))
def stalled_runs(spark, d):
    polls = progress(spark, d).select(
        "task_id", "run_id", (F.col("seq") * 2).cast("double").alias("at"), (F.col("seq") - F.col("seq") % 200).alias("cursor"), (F.col("seq") % 3 == 0).alias("ok")
    )
    return EL.stalled_runs(polls, 600.0, 5)


@query("minus_observed", oracle("cues", "select video_id, cue_id from cues except all select video_id, cue_id from cues where confidence >= 0.75"))
def minus_observed(spark, d):
    c = load(spark, d, "cues")
    return CH.minus_observed(c.select("video_id", "cue_id"), c.where("confidence >= 0.75"), "video_id", "cue_id")
