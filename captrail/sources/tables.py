"""Caption tables derived from the driver tables.

Each derivation is one SELECT that Spark and an ANSI engine read alike: integer
milliseconds and frames, doubles only at the end, no window per video.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_CUES = """
select video_id, cue_id, text, start_ms, end_ms,
       cast(start_ms as double) / 1000 as start_time, cast(end_ms as double) / 1000 as end_time,
       case when cue_id % 4 = 1 then cast(98 as double) / 100 else cast(50 + cue_id % 50 as double) / 100 end as confidence,
       case when boxed then x1 end as x1, case when boxed then y1 end as y1,
       case when boxed then x1 + w end as x2, case when boxed then y1 + h end as y2
from (
  select user_id % 50 as video_id, event_id as cue_id,
    case when event_id % 19 = 0 then concat(upper(event_type), chr(10),
              case when event_id % 2 = 0 then 'CLICK' else 'VIEW' end)
         when event_id % 4 = 0 then concat(upper(event_type), ' NOW')
         else upper(event_type) end as text,
    event_id * 25 + event_id % 7 as start_ms,
    event_id * 25 + event_id % 7 + 200 + cast(floor(value * 10) as bigint) % 1500 as end_ms,
    event_id % 23 <> 0 as boxed,
    cast(100 + (event_id % 3) * 20 as int) as x1,
    cast(500 + (event_id % 3) * 60 as int) as y1,
    cast(240 + (event_id % 5) * 40 as int) as w,
    cast(case when event_id % 19 = 0 then 110 when event_id % 11 = 0 then 15 else 50 end as int) as h
  from {events}
) e
"""

_FRAMES = """
select user_id % 50 as video_id, event_id * 300 + event_id % 3 as pts,
       case when event_id % 5 = 0 then 0 else 300 end as duration_pts,
       cast(1 as bigint) as time_base_num, cast(11988 as bigint) as time_base_den
from {events}
"""

_OBS = """
select video_id, frame_index, cast(frame_index as double) / 2 as ts, cand_no,
       case when noise = 0 then replace(words, 'O', '0') when noise = 1 then upper(p_name)
            when frame_index % 6 < 3 then first_word else words end as text,
       confidence, x1, y1, x2, y1 + h as y2
from (
  select l_partkey % 100 as video_id, cast(floor(l_orderkey / 64) as bigint) as frame_index,
         l_orderkey * 8 + l_linenumber as cand_no, p_name, l_orderkey % 11 as noise,
         concat(split_part('SMALL STAR,LARGE MOON,OLD ROAD,COLD RIVER,BRIGHT DOOR,FAST ROCKET,QUIET HOUSE,GOLDEN BOOK', ',',
                cast((floor(l_orderkey / 384) + l_linenumber * 3 + l_partkey % 100) % 8 + 1 as int)), ' ',
                split_part('POWER,GUIDE,LESSON,STORY,CORNER,NUMBER,WINDOW,FOLLOW', ',',
                cast((floor(l_orderkey / 384) * 5 + l_linenumber + l_partkey % 100) % 8 + 1 as int))) as words,
         split_part('SMALL STAR,LARGE MOON,OLD ROAD,COLD RIVER,BRIGHT DOOR,FAST ROCKET,QUIET HOUSE,GOLDEN BOOK', ',',
                cast((floor(l_orderkey / 384) + l_linenumber * 3 + l_partkey % 100) % 8 + 1 as int)) as first_word,
         cast(64 - 2 * cast(round(l_discount * 100) as int) as double) / 64 as confidence,
         cast(200 + (l_partkey % 7) * 30 as int) as x1,
         cast(400 + (l_linenumber % 5) * 55 + l_orderkey % 4 as int) as y1,
         cast(200 + (l_partkey % 7) * 30 + 320 + p_size * 4 as int) as x2,
         cast(40 + (l_orderkey % 3) * 6 as int) as h
  from {lineitem} join {part} on l_partkey = p_partkey
) o
"""

_ASR = """
select conv_id as video_id, turn as seg_idx, text,
       cast(turn * 30000 as double) / 1000 as seg_start
from {conversations}
"""

_TRUTH = """
select user_id as video_id, event_id as event_key,
       case when event_id % 6 = 5 then concat('unread ', substr(md5(cast(event_id * 37 as string)), 1, 20))
            when event_id % 13 = 0 then concat('thank you ', cast(floor(event_id / 2000) as bigint))
            else concat(event_type, ' ', substr(md5(cast(event_id as string)), 1, 16)) end as text,
       event_id * 2 as start_frame, event_id * 2 + 1 as end_frame,
       case when event_id % 10 = 0 then 'A' else 'B' end as tier,
       case when event_id % 10 = 0 then cast(0 as bigint) else event_id % 3 end as uncertainty
from {events}
"""

_PRED = """
select user_id as video_id, event_id as event_key,
       case when event_id % 17 = 0 or event_id % 7 = 0 then concat('noise ', substr(md5(cast(event_id * 31 as string)), 1, 20))
            when event_id % 13 = 0 then concat('thank you ', cast(floor(event_id / 2000) as bigint))
            when event_id % 11 = 0 then replace(concat(event_type, ' ', substr(md5(cast(event_id as string)), 1, 16)), 'e', 'c')
            when event_id % 3 = 0 then upper(concat(event_type, '-', substr(md5(cast(event_id as string)), 1, 16)))
            else concat(event_type, ' ', substr(md5(cast(event_id as string)), 1, 16)) end as text,
       case when event_id % 10 = 0 then event_id * 2 else event_id * 2 + event_id % 3 - 1 end as start_frame,
       case when event_id % 20 = 0 then event_id * 2 + 1 else event_id * 2 + 2 + event_id % 2 end as end_frame
from {events}
"""

_PROGRESS = """
select user_id as task_key, concat('task-', cast(user_id as string)) as task_id,
       md5(concat(cast(user_id as string), '-', cast(cast(floor(event_id / 700) as bigint) as string))) as run_id,
       event_id + 1 as seq,
       case event_type when 'view' then 'stage.progress' when 'click' then 'frame.analyzed'
            when 'purchase' then 'cue.upserted' when 'signup' then 'job.completed'
            else 'job.failed' end as type,
       ts as occurred_at,
       cast(regexp_extract(props, '[0-9]+', 0) as int) as k,
       cast(floor(value) as bigint) as progress,
       concat('step ', cast(event_id % 9 as string)) as message
from {events}
"""

_TASKS = """
select o_orderkey as task_no, concat('t', cast(o_orderkey as string)) as id,
       concat(c_name, '.mp4') as filename,
       case o_orderstatus when 'O' then 'processing' when 'F' then 'completed' else 'awaiting_roi' end as status,
       case when o_orderkey % 9 = 0 then 'audio' when o_orderkey % 9 = 1 then cast(null as string)
            else 'audio_visual' end as analysis_mode,
       case o_orderkey % 5 when 0 then 'completed' when 1 then 'failed' when 2 then 'processing'
            when 3 then cast(null as string) else 'queued' end as visual_status,
       case o_orderkey % 4 when 0 then 'completed' when 1 then 'failed' when 2 then 'skipped'
            else 'processing' end as audio_status,
       case when o_orderkey % 3 = 0 then cast(null as bigint) else o_orderkey % 130 end as visual_progress,
       o_orderkey % 101 as audio_progress,
       case when o_orderkey % 5 = 1 then 'visual worker lost' end as visual_error,
       case when o_orderkey % 8 = 1 then 'audio worker lost' end as audio_error,
       case when o_orderkey % 6 = 0 then cast(null as bigint) else o_orderkey % 6 end as revision,
       case when o_orderkey % 10 = 0 then o_orderdate end as archived_at,
       o_orderdate as created_at,
       case when o_orderkey % 11 = 0 then cast(null as timestamp) else o_orderdate end as updated_at,
       o_orderkey % 12 as subtitle_count, o_orderkey % 7 as visual_count, o_orderkey % 5 as audio_count
from {orders} join {customer} on o_custkey = c_custkey
"""

_EDITS = """
select l_orderkey as task_no, l_shipdate as arrival_ts,
       l_partkey * 1000 + l_suppkey as edit_no, l_extendedprice as tie,
       cast(l_linenumber - 1 as bigint) as expected_revision, cast(l_quantity as bigint) as cue_count
from {lineitem}
"""

_TEXTS = """
select d.doc_id, d.text as a, b.text as b, d.source
from (select *, doc_id % (select count(*) from {benchmark}) as item from {documents}) d join {benchmark} b on d.item = b.item_id
"""

_BOXES = """
select l_orderkey * 8 + l_linenumber as pair_id, l_partkey, l_suppkey,
       cast(l_partkey % 90 as int) as ax1, cast(l_suppkey % 60 as int) as ay1,
       cast(l_partkey % 90 + l_quantity * 3 as int) as ax2, cast(l_suppkey % 60 + 30 + l_linenumber as int) as ay2,
       cast(l_orderkey % 80 as int) as bx1, cast(l_partkey % 70 as int) as by1,
       cast(l_orderkey % 80 + l_linenumber * 20 as int) as bx2, cast(l_partkey % 70 + 25 + l_orderkey % 15 as int) as by2,
       l_quantity, l_discount, l_extendedprice
from {lineitem}
"""

SQL = {
    "cues": _CUES, "frames": _FRAMES, "obs": _OBS, "asr": _ASR, "truth": _TRUTH, "pred": _PRED,
    "progress": _PROGRESS, "tasks": _TASKS, "edits": _EDITS, "texts": _TEXTS, "boxes": _BOXES,
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a driver table by its own name."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE}))


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with their box as one nullable struct."""
    return with_box(load(spark, sf_dir, "cues"))


def with_box(df: DataFrame) -> DataFrame:
    box = F.when(F.col("x1").isNotNull(), F.struct("x1", "y1", "x2", "y2"))
    return df.withColumn("box", box).drop("x1", "y1", "x2", "y2")


def oracle(names: str, body: str) -> str:
    """Prefix ``body`` with the named derived tables as common table expressions."""
    parts = [f"{n} as ({SQL[n].strip().format(**{t: t for t in BASE})})" for n in names.split()]
    head = f"with {', '.join(parts)}"
    follow = re.match(r"\s*with\s+", body, re.I)
    return f"{head}, {body[follow.end():]}" if follow else f"{head} {body}"
