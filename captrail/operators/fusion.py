"""Speech: segment normalisation, re-segmentation, bounded correction of visual events."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from captrail.config import CaptionConfig
from captrail.functions import text as TX
from captrail.functions.numeric import clamp01, finite_nonneg, half_even
from captrail.operators.cues import resolve_overlaps
from captrail.operators.folds import plain, spread
from captrail.operators.intervals import overlap_join

WORD = "struct<word:string,start:double,end:double,confidence:double>"


def normalize_words(words: Column) -> Column:
    """Drop blank words, void bad or inverted times, clamp confidence."""

    def one(w):
        start, end = finite_nonneg(w["start"]), finite_nonneg(w["end"])
        inverted = start.isNotNull() & end.isNotNull() & (end < start)
        return F.struct(
            w["word"].alias("word"), half_even(F.when(~F.coalesce(inverted, F.lit(False)), start), 3).alias("start"),
            half_even(F.when(~F.coalesce(inverted, F.lit(False)), end), 3).alias("end"),
            half_even(clamp01(w["score"]), 4).alias("confidence"),
        )

    kept = F.filter(F.coalesce(words, F.array().cast("array<struct<word:string,start:double,end:double,score:double>>")),
                    lambda w: F.trim(F.coalesce(w["word"], F.lit(""))) != "")
    return F.transform(kept, one)


def normalize_asr(aligned: DataFrame, transcript: DataFrame) -> DataFrame:
    """Aligned segments to audio cues, with the transcript of the same index as fallback.

    Both: (video_id, seg_idx, text, start, end, score, words). Videos without
    aligned segments use the transcript itself.
    """
    bare = transcript.join(aligned.select("video_id").distinct(), "video_id", "left_anti")
    source = aligned.unionByName(bare)
    back = transcript.select(
        "video_id", "seg_idx", F.col("text").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e")
    )
    j = source.join(back, ["video_id", "seg_idx"], "left").withColumn("words", normalize_words(F.col("words")))
    spelled = F.trim(F.array_join(F.transform("words", lambda w: w["word"]), ""))
    given = F.trim(F.coalesce(F.when(F.col("text") != "", F.col("text")), F.col("_t"), F.lit("")))
    timed = F.filter("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull())
    start = F.coalesce(finite_nonneg(F.col("start")), finite_nonneg(F.col("_s")), F.try_element_at(timed, F.lit(1))["start"])
    end = F.coalesce(finite_nonneg(F.col("end")), finite_nonneg(F.col("_e")), F.try_element_at(timed, F.lit(-1))["end"])
    known = F.filter(F.transform("words", lambda w: w["confidence"]), lambda c: c.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)
    confidence = F.when(F.size(known) > 0, mean).otherwise(F.coalesce(clamp01(F.col("score")), F.lit(0.0)))
    out = j.select(
        "video_id", "seg_idx", F.when(given != "", given).otherwise(spelled).alias("text"),
        start.alias("start_time"), end.alias("end_time"), "words", confidence.alias("confidence"),
    )
    return out.where((F.col("text") != "") & (F.col("end_time") > F.col("start_time"))).withColumns({
        "start_time": half_even(F.col("start_time"), 3),
        "end_time": half_even(F.col("end_time"), 3), "confidence": half_even(F.col("confidence"), 4),
    })


CHUNKS = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("start_time", T.DoubleType()),
    T.StructField("end_time", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
]))

# Ends of sentences and clauses.
_SENTENCE = re.compile(r"[.!?][\"']?$")
_CLAUSE = re.compile(r"[,;:][\"']?$")


def _mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def split_words(words) -> list[dict]:
    """Words of one decoder segment to short cues."""
    runs: list[list] = []
    run: list = []
    for w in words:
        if run and w["start"] - run[-1]["end"] >= 0.32 and run[-1]["end"] - run[0]["start"] >= 1.1:
            runs.append(run)
            run = []
        run.append(w)
        word, lasts = w["word"].strip(), w["end"] - run[0]["start"]
        if lasts >= 3.1 or (lasts >= 0.75 and _SENTENCE.search(word)) or (lasts >= 1.4 and _CLAUSE.search(word)):
            runs.append(run)
            run = []
    if run:
        runs.append(run)
    out: list[dict] = []
    for run in runs:
        text = "".join(w["word"] for w in run).strip()
        start, end = max(0.0, run[0]["start"]), run[-1]["end"]
        if not text or end <= start:
            continue
        conf = _mean([w["confidence"] for w in run])
        tiny = end - start < 0.75 or (len(text.split()) < 3 and end - start < 1.0)
        if out and tiny:
            last = out[-1]
            last["text"] = f"{last['text'].rstrip()} {text.lstrip()}"
            last["end_time"], last["confidence"] = end, _mean([last["confidence"], conf])
        else:
            out.append({"text": text, "start_time": start, "end_time": end, "confidence": conf})
    return out


#: Segments whose words are Python objects at a time.
SEGMENTS = 64


def split_segments(values: pa.Array) -> pa.Array:
    """The cues of every segment; only a few segments of the batch are held as Python objects at once."""
    kind = to_arrow_type(CHUNKS)
    parts = [
        pa.array([None if v is None else split_words(v) for v in plain(values.slice(at, SEGMENTS))], kind)
        for at in range(0, len(values), SEGMENTS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(CHUNKS)
def _split_words(values: pa.Array) -> pa.Array:
    return split_segments(values)


def resegment_asr(segments: DataFrame) -> DataFrame:
    """Cut segments into editor-friendly cues. One segment is one row; nothing is shuffled.

    ``segments``: (video_id, seg_idx, text, start_time, end_time, base_confidence,
    words array<struct<word,start,end,confidence>>). Segments without words pass.
    """
    has_words = F.size(F.coalesce("words", F.array().cast(f"array<{WORD}>"))) > 0
    text = F.trim("text")
    whole = F.when(
        (text != "") & (F.col("end_time") > F.greatest(F.lit(0.0), F.col("start_time"))),
        F.array(F.struct(text.alias("text"), F.greatest(F.lit(0.0), F.col("start_time")).alias("start_time"),
                         F.col("end_time").alias("end_time"), F.lit(None).cast("double").alias("confidence"))),
    )
    chunks = F.coalesce(_split_words(F.when(has_words, F.col("words"))), F.when(~has_words, whole))
    return segments.select("video_id", "seg_idx", "base_confidence", F.posexplode(chunks).alias("part", "c")).select(
        "video_id", "seg_idx", F.col("part").cast("long").alias("part"), "c.text",
        half_even(F.col("c.start_time"), 3).alias("start_time"), half_even(F.col("c.end_time"), 3).alias("end_time"),
        half_even(F.coalesce("c.confidence", "base_confidence"), 4).alias("confidence"),
    )


def join_asr(events: DataFrame, asr: DataFrame, pad: float = 0.45, width: float = 8.0) -> DataFrame:
    """Pairs of events and padded speech cues that overlap in time.

    ``asr``: (video_id, asr_id, text, start_time, end_time, confidence).
    """
    speech = asr.select(
        "video_id", "asr_id", F.col("text").alias("asr_text"), F.col("confidence").alias("asr_confidence"),
        F.col("start_time").alias("asr_start"), F.col("end_time").alias("asr_end"),
    )
    low, high = F.greatest(F.lit(0.0), F.col("asr_start") - F.lit(pad)), F.col("asr_end") + F.lit(pad)
    return overlap_join(
        events, speech, ["video_id"], (F.col("start_time"), F.col("end_time")), (low, high),
        F.least(F.col("end_time"), high) > F.greatest(F.col("start_time"), low), width,
    )


# What counts as a spoken word, and what parts words.
_SPOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_NOT_WORD = re.compile(r"[^\w]+")
_GAPS = re.compile(r"[^\w']+")


def _norm(text: str) -> str:
    return _GAPS.sub(" ", text.casefold().replace("_", " ")).strip()


def _one_edit_apart(a: str, b: str) -> bool:
    """Edit distance at most 1."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[at + (len(short) == len(long)):] == long[at + 1:]


def window_match(ocr: str, speech: str, band: int) -> tuple[float, str] | None:
    """Best run of spoken words for a visual text.

    ``band`` 2: near certain, only spacing may change; 1: one edit at most;
    0: up to one extra word with a good score.
    """
    want = _norm(ocr).split()
    spoken = [(w, n) for w in _SPOKEN.findall(speech) if (n := _norm(w))]
    if not want or not spoken:
        return None
    joined, n = " ".join(want), len(want)
    target = _NOT_WORD.sub("", joined)
    spans = [
        (start, size) for size in range(n, min(len(spoken), n + 2) + 1)
        for start in range(len(spoken) - size + 1)
    ]
    compact = {s: _NOT_WORD.sub("", "".join(t for _, t in spoken[s[0]:s[0] + s[1]])) for s in spans}

    def words(span):
        return [t for _, t in spoken[span[0]:span[0] + span[1]]]

    def shown(span):
        return " ".join(w for w, _ in spoken[span[0]:span[0] + span[1]])

    def raw(span):
        have = words(span)
        chars = SequenceMatcher(None, joined, " ".join(have)).ratio()
        return chars * 0.6 + SequenceMatcher(None, want, have).ratio() * 0.4

    def grade(span):
        score = raw(span)
        extra = span[1] - n
        return score - 0.10 * extra, score, -extra

    exact = [s for s in spans if compact[s] == target]
    if exact:
        fewest = min(s[1] for s in exact)
        close = [s for s in exact if s[1] == fewest]
        return 1.0, shown(close[0] if len(close) == 1 else max(close, key=lambda s: grade(s)[0]))
    if band == 2:
        return None
    if band == 1:
        pool = [s for s in spans if _one_edit_apart(compact[s], target)]
    else:
        pool = [s for s in spans if s[1] <= n + 1]
    graded = [(grade(s), s) for s in pool]
    if not graded:
        return None
    (_, score, _), best = max(graded, key=lambda g: g[0])
    if band == 0 and score < 0.72:
        return None
    return score, shown(best)


MATCH = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("correction", T.StringType())])


@F.pandas_udf(MATCH)
def asr_window_match(ocr: pd.Series, speech: pd.Series, band: pd.Series) -> pd.DataFrame:
    rows = [window_match(o, s, int(b)) or (None, None) for o, s, b in zip(ocr, speech, band)]
    return pd.DataFrame(rows, columns=["score", "correction"])


def fuse_asr(events: DataFrame, asr: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Correct event texts by overlapping speech; speech alone never creates a cue."""
    band = F.when(F.col("confidence") >= 0.97, 2).when(F.col("confidence") >= 0.90, 1).otherwise(0)
    pairs = join_asr(
        events.select("video_id", "cue_id", "start_time", "end_time", "text", band.alias("_band")), asr, cfg.asr_pad_seconds
    )
    texts = spread(pairs.select("text", "asr_text", "_band"), "text", "asr_text", "_band").distinct()
    graded = texts.withColumn("_m", asr_window_match("text", "asr_text", "_band")).select(
        "text", "asr_text", "_band", "_m.score", "_m.correction"
    )
    keys = ["video_id", "cue_id"]
    best = pairs.join(graded, ["text", "asr_text", "_band"]).groupBy(*keys).agg(
        F.min_by("correction", F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), "asr_start", "asr_end", "asr_id"))).alias("_fix"),
        F.max("asr_confidence").alias("_spoken"),
    )
    same = TX.norm_caption(F.col("_fix")) == TX.norm_caption(F.col("text"))
    sure = F.least(F.lit(1.0), F.col("confidence") * F.lit(0.75) + F.col("_spoken") * F.lit(0.25))
    fixed = F.col("_fix").isNotNull()
    out = events.join(best, keys, "left").withColumns({
        "text": F.when(fixed & ~same, F.col("_fix")).otherwise(F.col("text")),
        "confidence": F.when(fixed, half_even(sure, 4)).otherwise(F.col("confidence")),
        "source": F.when(fixed, "ocr+whisper").otherwise(F.col("source")),
    }).select(*events.columns)
    return resolve_overlaps(out, cfg.chunk_seconds)
