"""Registered queries over the text, box and clock column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from captrail.functions import geometry as G
from captrail.functions import numeric as N
from captrail.functions import text as T
from captrail.functions import timecode as TC
from captrail.operators import roi as R
from captrail.plans import sqlparts as Q
from captrail.plans.registry import query
from captrail.sources.tables import load, oracle

_FORMS = f"""select doc_id, {Q.norm_caption('text')} as caption, {Q.norm_fragment('text')} as fragment,
  {Q.norm_eval('text')} as eval, replace({Q.norm_eval('text')}, ' ', '') as eval_compact,
  {Q.compact_caption('text')} as caption_compact, {Q.compact_caption('text')} as variation,
  trim(regexp_replace(replace(text, '|', 'I'), '\\s+', ' ', 'g')) as ocr_clean,
  regexp_replace(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g') as editor_clean
from documents"""


@query("text_forms", _FORMS)
def text_forms(spark, d):
    t, folded, normal = F.col("text"), F.col("_folded"), F.col("_eval")
    docs = load(spark, d, "documents").select("doc_id", "text", T.fold(t).alias("_folded"), T.norm_eval(t).alias("_eval"))
    return docs.select(
        "doc_id", T.caption_of(folded).alias("caption"), T.fragment_of(folded).alias("fragment"),
        normal.alias("eval"), T.without_spaces(normal).alias("eval_compact"),
        T.compact_of(folded).alias("caption_compact"), T.compact_of(folded).alias("variation"),
        T.clean_ocr(t).alias("ocr_clean"), T.clean_text(t).alias("editor_clean"),
    )


@query("token_tests", oracle("texts", f"""with n as (select doc_id, {Q.norm_caption('a')} as a, {Q.norm_caption('b')} as b from texts)
select doc_id, {Q.ntok('a')} as tokens_a, {Q.ntok('b')} as tokens_b, {Q.run_contained('a', 'b')} as run,
  {Q.run_contained('a', 'b', strict=False)} as run_loose,
  (b <> '' and a <> '' and list_has_all(string_split(a, ' '), string_split(b, ' '))) as subset,
  case when a = '' or b = '' then 0::double when contains(a, b) or contains(b, a) then
    case when {Q.ntok('case when length(a) <= length(b) then a else b end')} >= 2
         then {Q.f(.72)} + (least(length(a), length(b)) / greatest(length(a), length(b))) * {Q.f(.28)}
         else least(length(a), length(b)) / greatest(length(a), length(b)) end end as contained
from n"""))
def token_tests(spark, d):
    n = load(spark, d, "texts").select(
        "doc_id", T.norm_caption(F.col("a")).alias("a"), T.norm_caption(F.col("b")).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return n.select(
        "doc_id", T.token_count(a).alias("tokens_a"), T.token_count(b).alias("tokens_b"),
        T.token_run_contained(a, b).alias("run"), T.token_run_contained(a, b, False).alias("run_loose"),
        T.token_subset(b, a).alias("subset"), T.containment_score(a, b).alias("contained"),
    )


@query("edit_distance", """select p.p_partkey, s.n_name, levenshtein(lower(p.p_name), lower(s.n_name)) as distance
from part p join nation s on p.p_partkey % 25 = s.n_nationkey""")
def edit_distance(spark, d):
    n = load(spark, d, "nation")
    p = load(spark, d, "part")
    return p.join(n, p.p_partkey % 25 == n.n_nationkey).select(
        "p_partkey", "n_name", F.levenshtein(F.lower("p_name"), F.lower("n_name")).alias("distance")
    )


@query("word_ends", """with w as (select conv_id, turn, word from (select conv_id, turn, unnest(string_split(text, ' ')) as word from conversations))
select conv_id, turn, count(*) as words, count(*) filter (regexp_matches(trim(word), '[.!?]["'']?$')) as sentence_ends,
 count(*) filter (regexp_matches(trim(word), '[,;:]["'']?$')) as clause_ends from w group by all""")
def word_ends(spark, d):
    words = load(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("words"),
        F.count_if(T.ends_sentence(F.col("word"))).alias("sentence_ends"),
        F.count_if(T.ends_clause(F.col("word"))).alias("clause_ends"),
    )


_AB = "select *, ax1 as a_x1, ay1 as a_y1, ax2 as a_x2, ay2 as a_y2, bx1 as b_x1, by1 as b_y1, bx2 as b_x2, by2 as b_y2 from boxes"
_TALL = f"greatest({Q.h('a_')},{Q.h('b_')})"
_SHORT = f"least({Q.h('a_')},{Q.h('b_')})"
_DRIFT = f"abs({Q.cy('a_')}-{Q.cy('b_')})"
_NARROW = "greatest(1, least(a_x2-a_x1, b_x2-b_x1))"
_SHIFT = f"abs({Q.cx('a_')}-{Q.cx('b_')})"


def _touch(p):
    return f"(least(abs({p}x1-10), abs(160-{p}x2)) <= 3)"


_SHARE_LINE = f"""({_SHORT}/{_TALL} >= {Q.f(.68)} and {Q.sy('a_', 'b_')}/{_SHORT} >= {Q.f(.58)} and {_DRIFT} <= {_TALL}*{Q.f(.38)}
  and not ({_touch('a_')} <> {_touch('b_')} and ({_DRIFT} > {_TALL}*{Q.f(.25)} or abs(a_y2-b_y2) > {_TALL}*{Q.f(.22)}))
  and greatest(0, case when a_x1 <= b_x1 then a_x2-b_x1 else b_x2-a_x1 end)/{_NARROW} <= {Q.f(.55)}
  and greatest(0, case when a_x1 <= b_x1 then b_x1-a_x2 else a_x1-b_x2 end) <= greatest(24, round_even({_TALL}*{Q.f(.9)}, 0)))"""


@query("box_metrics", oracle("boxes", f"""with ab as ({_AB}),
m as (select pair_id, l_partkey, l_suppkey, l_quantity, l_extendedprice, {Q.area('a_')} as area_a, {Q.inter('a_', 'b_')} as shared, {Q.iou('a_', 'b_')} as iou,
  {Q.smaller_overlap('a_', 'b_')} as overlap, {Q.spatial('a_', 'b_')} as spatial, {Q.stream('a_', 'b_')} as stream,
  {Q.stacked('a_', 'b_')} as stacked,
  case when {Q.hr('a_', 'b_')} >= {Q.f(.72)} and {Q.cy('b_')}-{Q.cy('a_')} >= {_TALL}*{Q.f(.52)} and {Q.cy('b_')}-{Q.cy('a_')} <= {_TALL}*{Q.f(1.25)}
    and {Q.sx('a_', 'b_')}/{_NARROW} >= {Q.f(.6)} and {_SHIFT} <= greatest(a_x2-a_x1, b_x2-b_x1)*{Q.f(.3)}
    then {Q.sx('a_', 'b_')}/{_NARROW} - {_SHIFT}/{_NARROW}*{Q.f(.1)} end as stack_score,
  {_SHARE_LINE} as one_line, least(a_x1, b_x1) as union_x1, greatest(a_y2, b_y2) as union_y2 from ab)
select * from m"""))
def box_metrics(spark, d):
    df = load(spark, d, "boxes")
    a = G.make_box(*[F.col("a" + c) for c in ("x1", "y1", "x2", "y2")])
    b = G.make_box(*[F.col("b" + c) for c in ("x1", "y1", "x2", "y2")])
    df = df.withColumns({"a": a, "b": b})
    a, b = F.col("a"), F.col("b")
    roi = G.make_box(F.lit(10), F.lit(0), F.lit(160), F.lit(100))
    union = G.union_box(a, b)
    return df.select(
        "pair_id", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        G.area(a).alias("area_a"), G.intersection(a, b).alias("shared"), G.box_iou(a, b).alias("iou"),
        G.overlap_over_smaller(a, b).alias("overlap"), G.spatial_compatibility(a, b).alias("spatial"),
        G.same_caption_stream(a, b).alias("stream"), G.boxes_stacked(a, b).alias("stacked"),
        G.stacked_line_score(a, b).alias("stack_score"),
        G.fragments_share_line(a, b, roi).alias("one_line"),
        union["x1"].alias("union_x1"), union["y2"].alias("union_y2"),
    )


@query("interval_tests", oracle("boxes", f"""select pair_id, l_partkey, l_suppkey, l_extendedprice,
 greatest(0, least(ax2, bx2)-greatest(ax1, bx1)+1) / (greatest(ax2, bx2)-least(ax1, bx1)+1) as frame_iou,
 least(ax2, bx2) > greatest(ax1, bx1) as overlaps,
 least(ax2-ax1, bx2-bx1) > 0 and (least(ax2, bx2)-greatest(ax1, bx1))/least(ax2-ax1, bx2-bx1) >= {Q.f(.55)} as substantial from boxes"""))
def interval_tests(spark, d):
    span = [F.col(c) for c in ("ax1", "ax2", "bx1", "bx2")]
    return load(spark, d, "boxes").select(
        "pair_id", "l_partkey", "l_suppkey", "l_extendedprice", G.frame_iou(*span).alias("frame_iou"),
        G.intervals_overlap(*span).alias("overlaps"), G.substantial_overlap(*span).alias("substantial"),
    )


@query("polygon_to_box", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  case when l_linenumber = 7 then null else cast(trunc(least(l_quantity*1.5::double, l_extendedprice/100)) as int)+300 end as x1,
  case when l_linenumber = 7 then null else cast(trunc(least(l_discount*900, l_tax*700)) as int)+200 end as y1,
  case when l_linenumber = 7 then null else cast(trunc(greatest(l_quantity*1.5::double, l_extendedprice/100)) as int)+300 end as x2,
  case when l_linenumber = 7 then null else cast(trunc(greatest(l_discount*900, l_tax*700)) as int)+200 end as y2 from lineitem""")
def polygon_to_box(spark, d):
    p, q = F.col("l_quantity") * F.lit(1.5), F.col("l_extendedprice") / 100
    y, z = F.col("l_discount") * 900, F.col("l_tax") * 700
    points = F.array(F.array(p, y), F.array(q, y), F.array(q, z), F.array(p, F.when(F.col("l_linenumber") != 7, z)))
    box = G.polygon_to_box(points, F.lit(300), F.lit(200))
    df = load(spark, d, "lineitem").withColumn("b", box)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "b.*")


_ROI = """select pair_id, l_partkey, l_suppkey, l_extendedprice, l_discount*8 as x, ay1::double/80 as y,
  l_quantity/60 as width, by1::double/90 as height from boxes"""


@query("validate_roi", oracle("boxes", f"""with r as ({_ROI})
select pair_id, l_partkey, l_suppkey, l_extendedprice,
 (x between 0 and 1 and y between 0 and 1 and width > 0 and width <= 1 and height > 0 and height <= 1 and x+width <= {Q.f(1.000001)} and y+height <= {Q.f(1.000001)}) as model_ok,
 (x between 0 and 1 and y between 0 and 1 and width between {Q.f(.01)} and 1 and height between {Q.f(.01)} and 1 and x+width <= 1 and y+height <= 1) as api_ok,
 (x >= 0 and y >= 0 and width > 0 and height > 0 and x+width <= 1 and y+height <= 1) as ui_ok,
 case when x >= 0 and y >= 0 and width > 0 and height > 0 and x+width <= 1 and y+height <= 1
   then floor(greatest(0, least(1-greatest({Q.f(.03)}, least(1, width)), x))*1000000+{Q.f(.5)})/1000000 else {Q.f(.08)} end as ui_x from r"""))
def validate_roi(spark, d):
    df = load(spark, d, "boxes").withColumn("roi", F.struct(
        (F.col("l_discount") * 8).alias("x"), (F.col("ay1").cast("double") / 80).alias("y"),
        (F.col("l_quantity") / 60).alias("width"), (F.col("by1").cast("double") / 90).alias("height"),
    ))
    roi = F.col("roi")
    return df.select(
        "pair_id", "l_partkey", "l_suppkey", "l_extendedprice",
        R.validate_roi(roi, "model").alias("model_ok"), R.validate_roi(roi, "api").alias("api_ok"),
        R.validate_roi(roi, "ui").alias("ui_ok"), R.sanitize_roi(roi)["x"].alias("ui_x"),
    )


@query("roi_pixels", oracle("boxes", f"""with r as ({_ROI}), p as (select *,
  greatest(0, least(cast(round_even(1920*x, 0) as bigint), 1919)) as x1, greatest(0, least(cast(round_even(1080*y, 0) as bigint), 1079)) as y1 from r)
select pair_id, l_partkey, l_suppkey, l_extendedprice, x1, y1, greatest(x1+1, least(1920, cast(round_even(1920*(x+width), 0) as bigint))) as x2,
  greatest(y1+1, least(1080, cast(round_even(1080*(y+height), 0) as bigint))) as y2 from p"""))
def roi_pixels(spark, d):
    roi = F.struct(
        (F.col("l_discount") * 8).alias("x"), (F.col("ay1").cast("double") / 80).alias("y"),
        (F.col("l_quantity") / 60).alias("width"), (F.col("by1").cast("double") / 90).alias("height"),
    )
    df = load(spark, d, "boxes").withColumn("p", G.roi_pixels(roi, F.lit(1920), F.lit(1080)))
    return df.select("pair_id", "l_partkey", "l_suppkey", "l_extendedprice", "p.*")


@query("normalize_box", oracle("boxes", """with s as (select *, case l_partkey % 3 when 0 then 'video' when 1 then 'normalized' else 'roi-local' end as space from boxes),
p as (select *, case space when 'video' then ax1::double/200*100 when 'normalized' then l_discount*4*100 else (20+ax1)::double/200*100 end as l,
  case space when 'video' then ax2::double/200*100 when 'normalized' then l_quantity/40*100 else (20+ax2)::double/200*100 end as r,
  case space when 'video' then ay1::double/100*100 when 'normalized' then l_discount*100 else (10+ay1)::double/100*100 end as t,
  case space when 'video' then ay2::double/100*100 when 'normalized' then l_quantity/50*100 else (10+ay2)::double/100*100 end as b from s),
c as (select *, greatest(0, least(100, least(l, r))) as cl, greatest(0, least(100, greatest(l, r))) as cr, greatest(0, least(100, least(t, b))) as ct, greatest(0, least(100, greatest(t, b))) as cb from p)
select pair_id, l_partkey, l_suppkey, l_extendedprice, case when cr > cl and cb > ct then round(cl, 6) end as "left",
 case when cr > cl and cb > ct then round(ct, 6) end as top, case when cr > cl and cb > ct then round(cr-cl, 6) end as width,
 case when cr > cl and cb > ct then round(cb-ct, 6) end as height from c"""))
def normalize_box(spark, d):
    space = F.when(F.col("l_partkey") % 3 == 0, "video").when(F.col("l_partkey") % 3 == 1, "normalized").otherwise("roi-local")
    unit = F.col("space") == "normalized"
    pick = lambda a, b: F.when(unit, a).otherwise(F.col(b).cast("double"))
    df = load(spark, d, "boxes").withColumn("space", space)
    box = F.array(pick(F.col("l_discount") * 4, "ax1"), pick(F.col("l_discount"), "ay1"),
                  pick(F.col("l_quantity") / 40, "ax2"), pick(F.col("l_quantity") / 50, "ay2"))
    roi = G.make_box(F.lit(20), F.lit(10), F.lit(180), F.lit(90))
    rect = R.normalize_box(box, F.lit(200), F.lit(100), F.col("space"), roi)
    return df.withColumn("r", rect).select(
        "pair_id", "l_partkey", "l_suppkey", "l_extendedprice",
        *[F.round(F.col(f"r.{c}"), 6).alias(c) for c in ("left", "top", "width", "height")],
    )


@query("focus_variants", oracle("obs", """with b as (select distinct x1, y1, x2, y2 from obs)
select x1, y1, x2, y2, y1+d1 as top, y2+d2 as bottom from b,
  (values (0,0),(-1,-1),(1,1),(-2,-2),(2,2),(-1,0),(1,0),(0,-1),(0,1),(-2,0),(2,0),(0,2),(0,-2)) a(d1, d2) where y2+d2 > y1+d1"""))
def focus_variants(spark, d):
    boxes = load(spark, d, "obs").select("x1", "y1", "x2", "y2").distinct()
    box = F.struct("x1", "y1", "x2", "y2")
    return boxes.withColumn("v", F.explode(R.focus_variants(box))).select(
        "x1", "y1", "x2", "y2", F.col("v.y1").alias("top"), F.col("v.y2").alias("bottom")
    )


@query("clock_strings", oracle("cues", """with m as (select cue_id, start_ms * 53 as ms, start_ms*53::double/1000 as s from cues)
select cue_id, lpad(cast(ms//3600000 as varchar), cast(greatest(2, length(cast(ms//3600000 as varchar))) as int), '0')||':'||lpad(cast((ms//60000)%60 as varchar), 2, '0')||':'||lpad(cast((ms//1000)%60 as varchar), 2, '0')||','||lpad(cast(ms%1000 as varchar), 3, '0') as srt,
 lpad(cast(ms//3600000 as varchar), cast(greatest(2, length(cast(ms//3600000 as varchar))) as int), '0')||':'||lpad(cast((ms//60000)%60 as varchar), 2, '0')||':'||lpad(cast((ms//1000)%60 as varchar), 2, '0')||'.'||lpad(cast(ms%1000 as varchar), 3, '0') as clock,
 case when ms >= 3600000 then cast(ms//3600000 as varchar)||':' else '' end||lpad(cast((ms//60000)%60 as varchar), 2, '0')||':'||lpad(cast((ms//1000)%60 as varchar), 2, '0') as short,
 round(s, 3) as parsed, round(s, 3) as parsed_srt from m"""))
def clock_strings(spark, d):
    s = (F.col("start_ms") * 53).cast("double") / 1000
    df = load(spark, d, "cues").select("cue_id", TC.srt_time(s).alias("srt"), TC.clock(s).alias("clock"), TC.clock_compact(s).alias("short"))
    return df.withColumns({
        "parsed": F.round(TC.parse_clock(F.col("clock")), 3),
        "parsed_srt": F.round(TC.parse_srt_time(F.col("srt")), 3),
    })


@query("frame_arithmetic", oracle("frames", """select video_id, pts, (pts-3)*1::double/11988 as seconds,
 cast(round_even((pts-3)*1::double/11988*30, 0) as bigint) as nearest, cast(floor((pts-3)*1::double/11988*30) as bigint) as down,
 cast(ceil((pts-3)*1::double/11988*30) as bigint) as up, 1 as num, 11988 as den from frames"""))
def frame_arithmetic(spark, d):
    tb = TC.time_base(F.concat(F.col("time_base_num").cast("string"), F.lit("/"), F.col("time_base_den").cast("string")))
    df = load(spark, d, "frames").withColumn("tb", tb)
    s = TC.pts_seconds(F.col("pts"), F.lit(3), F.col("tb.num"), F.col("tb.den"))
    fps = F.lit(30)
    return df.select(
        "video_id", "pts", s.alias("seconds"), TC.to_frame(s, fps).alias("nearest"),
        TC.to_frame(s, fps, "floor").alias("down"), TC.to_frame(s, fps, "ceil").alias("up"), "tb.num", "tb.den",
    )


@query("numeric_guards", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 greatest(0, least(1, (l_discount-{Q.f(.02)})*20)) as clamped, coalesce(l_tax/nullif(l_discount, 0), 0) as ratio,
 case when l_discount-{Q.f(.05)} >= 0 then l_discount-{Q.f(.05)} end as nonneg,
 round(greatest({Q.f(.05)}, least(1, exp(least(0, l_tax-{Q.f(.5)}))*(1-l_discount*5))), 9) as confidence from lineitem""")
def numeric_guards(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        N.clamp01((F.col("l_discount") - F.lit(0.02)) * 20).alias("clamped"),
        N.safe_ratio(F.col("l_tax"), F.col("l_discount")).alias("ratio"),
        N.finite_nonneg(F.col("l_discount") - F.lit(0.05)).alias("nonneg"),
        F.round(N.asr_confidence(F.col("l_tax") - F.lit(0.5), F.col("l_discount") * 5), 9).alias("confidence"),
    )
