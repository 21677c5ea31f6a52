"""Caption tracks: sessions, association, event summaries and duplicate merging."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrail.config import CaptionConfig
from captrail.functions import pybox as B
from captrail.functions import text as TX
from captrail.functions.numeric import half_even
from captrail.functions.similarity import caption_score, common, could_reach
from captrail.operators.folds import Fold, cut, fold_groups
from captrail.operators.ordered import ordered, time_chunk

_GAPS = re.compile(r"[^\w']+")


@lru_cache(1 << 16)
def caption_norm(text: str) -> str:
    return _GAPS.sub(" ", text.casefold().replace("_", " ")).strip()


@lru_cache(1 << 16)
def caption_words(norm: str) -> frozenset[str]:
    return frozenset(norm.split())


@lru_cache(1 << 17)
def known_score(a: str, b: str, at_least: float = 0.0) -> float:
    """Caption score; 0 where shared characters cannot bring it to ``at_least``.

    Captions repeat from group to group, so it is kept for all groups of a worker.
    """
    if at_least and a and b and a not in b and b not in a and 2.0 * common(a, b) / (len(a) + len(b)) < at_least:
        return 0.0
    return caption_score(a, b)


def sessionize(obs: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Add ``session_id``: the first time stamp of a stretch no track can leave.

    Works on distinct time stamps, so its cost does not grow with detections.
    """
    times = cut(obs.select("video_id", "ts").distinct())
    chunk = time_chunk("ts", cfg.chunk_seconds)
    lagged = ordered(times, ["video_id"], ["ts"], chunk, lag={"_p": "ts"})
    opens = F.col("_p").isNull() | (F.col("ts") - F.col("_p") > cfg.track_reach)
    marked = ordered(
        lagged.select("video_id", "ts", F.when(opens, F.col("ts")).alias("_open")),
        ["video_id"], ["ts"], chunk, last_seen={"session_id": "_open"},
    )
    return obs.join(marked.select("video_id", "ts", "session_id"), ["video_id", "ts"])


class _Track:
    __slots__ = ("number", "last", "norm", "words", "conf", "spot")

    def __init__(self, number: int, seen: dict):
        self.number, self.last, self.norm = number, seen["ts"], None
        self.take(seen)

    def take(self, seen: dict) -> None:
        """The longest reading speaks for the track; the first wins a tie."""
        self.last = seen["ts"]
        if self.norm is None or (len(seen["norm"]), seen["confidence"]) > (len(self.norm), self.conf):
            self.norm, self.conf, self.spot, self.words = seen["norm"], seen["confidence"], seen["spot"], seen["words"]


#: Least score of a caption whose words contain those of the other.
GROWS = 0.70


class Association(Fold):
    """Assign the detections of each instant to open tracks, best pairs first."""

    def __init__(self, cfg: CaptionConfig):
        self.cfg = cfg
        self.open: list[_Track] = []
        self.count = 0
        self.now: list[dict] = []

    def push(self, row):
        out = []
        if self.now and row["ts"] != self.now[0]["ts"]:
            out = self._settle()
        row["norm"] = caption_norm(row["text"])
        row["words"] = caption_words(row["norm"])
        row["spot"] = B.Spot.of((row["x1"], row["y1"], row["x2"], row["y2"]))
        self.now.append(row)
        return out

    def finish(self):
        return self._settle() if self.now else ()

    def _score(self, a: str, b: str) -> float:
        """Caption score; 0 where it reaches neither the threshold nor what growing captions score at least."""
        least = self.cfg.text_similarity_threshold
        return known_score(a, b, min(least, GROWS)) if could_reach(a, b, least) else 0.0

    def _pair(self, track: _Track, seen: dict, gap: float) -> float | None:
        near = track.spot.nearness(seen["spot"])
        if near <= 0:
            return None
        score, words = self._score(track.norm, seen["norm"]), seen["words"]
        grows = (
            bool(words and track.words) and (words <= track.words or track.words <= words)
            and min(len(track.norm), len(seen["norm"])) >= 4
        )
        if score < self.cfg.text_similarity_threshold and not grows:
            return None
        span = self.cfg.max_missing_seconds + self.cfg.interval
        recency = max(0.0, 1 - gap / max(self.cfg.interval, span))
        return (max(score, GROWS) if grows else score) * 0.75 + near * 0.2 + recency * 0.05

    def _settle(self):
        ts, seen = self.now[0]["ts"], self.now
        self.now = []
        self.open = [t for t in self.open if ts - t.last <= self.cfg.track_reach]
        pairs = []
        for slot, track in enumerate(self.open):
            for c, row in enumerate(seen):
                score = self._pair(track, row, ts - track.last)
                if score is not None:
                    pairs.append((score, track.number, c, slot))
        home: dict[int, _Track] = {}
        busy: set[int] = set()
        for _score, number, c, slot in sorted(pairs, reverse=True):
            if number not in busy and c not in home:
                busy.add(number)
                home[c] = self.open[slot]
        for c, row in enumerate(seen):
            if c in home:
                home[c].take(row)
            else:
                home[c] = _Track(self.count, row)
                self.count += 1
                self.open.append(home[c])
        return [
            {k: row[k] for k in _KEPT} | {"track_no": row["band"] * BAND_TRACKS + home[c].number} for c, row in enumerate(seen)
        ]


_KEPT = ("video_id", "session_id", "lines", "band", "ts", "cand_no", "text", "confidence", "x1", "y1", "x2", "y2")


#: Track numbers of one band.
BAND_TRACKS = 1 << 32


def bands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``band``: rows of one key in different bands are too far apart in height for one caption.

    Boxes near enough to be one caption touch once each is widened to its height and 4 pixels at least on both sides of
    its centre; a band is a run of touching ones. Worked out on distinct heights, so bounded by the pixels of a frame.
    """
    middle, reach = F.col("y1") + F.col("y2"), F.greatest(F.lit(8), F.col("y2") - F.col("y1"))
    placed = rows.withColumns({"_low": (middle - reach).cast("long"), "_high": (middle + reach).cast("long")})
    seen = Window.partitionBy(*keys).orderBy("_low", "_high")
    spans = placed.select(*keys, "_low", "_high").distinct()
    spans = spans.withColumn("_reach", F.max("_high").over(seen.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("_reach").isNull() | (F.col("_low") > F.col("_reach")), F.col("_low"))
    spans = spans.withColumn("band", F.last(opens, ignorenulls=True).over(seen)).drop("_reach")
    return placed.join(spans, [*keys, "_low", "_high"]).drop("_low", "_high")


def associate_tracks(obs: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Add ``track_no`` per (video_id, session_id, lines).

    Tracks never leave a session or a band of rows and never change their number of lines, so these columns together are
    an exact parallel key. The number holds the band, so it is unique without it.
    """
    rows = sessionize(obs, cfg).withColumn("lines", TX.line_breaks(F.col("text")))
    rows = bands(rows, ["video_id", "session_id", "lines"]).select(*_KEPT)
    schema = T.StructType(list(rows.schema.fields) + [T.StructField("track_no", T.LongType())])
    tracked = fold_groups(
        rows, ["video_id", "session_id", "lines", "band"], ["ts", "cand_no"], lambda: Association(cfg), schema
    )
    return tracked.drop("band")


def summarize_tracks(assoc: DataFrame, videos: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """One event per track. ``videos``: (video_id, duration). Readings equal in all else: the text last in order wins."""
    keys = ["video_id", "session_id", "lines", "track_no"]
    length = F.length(TX.norm_caption(F.col("text")))
    rank = F.struct(length, "confidence", -F.col("ts"), -F.col("cand_no"), "text")
    tracks = assoc.groupBy(*keys).agg(
        F.max_by("text", rank).alias("text"), F.min("ts").alias("_first"), F.max("ts").alias("_last"),
        F.avg("confidence").alias("_conf"), F.count(F.lit(1)).alias("hits"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    ).join(videos.select("video_id", "duration"), "video_id")
    start = F.greatest(F.lit(0.0), F.col("_first"))
    end = F.least(F.col("duration"), F.col("_last") + F.lit(cfg.interval))
    return tracks.where(end - start >= cfg.min_event_duration).select(
        *keys, "text", half_even(start, 3).alias("start_time"),
        half_even(F.greatest(end, start + F.lit(cfg.min_event_duration)), 3).alias("end_time"),
        half_even(F.col("_conf"), 4).alias("confidence"),
        F.struct("x1", "y1", "x2", "y2").alias("box"), "hits", F.lit("ocr").alias("source"),
    )


class DuplicateMerge(Fold):
    """Fold near-identical simultaneous events into the latest kept event they match."""

    def __init__(self, interval: float):
        self.interval = interval
        self.kept: list[dict] = []

    def push(self, row):
        row["norm"] = caption_norm(row["text"])
        row["b"] = tuple(row["box"][c] for c in ("x1", "y1", "x2", "y2")) if row["box"] else None
        # Rows arrive by start: what ended before can never match again.
        done = [k for k in self.kept if k["end_time"] <= row["start_time"]]
        self.kept = [k for k in self.kept if k["end_time"] > row["start_time"]]
        for at in reversed(range(len(self.kept))):
            kind = self._kind(self.kept[at], row)
            if kind:
                self.kept[at] = self._merge(self.kept[at], row, kind)
                break
        else:
            self.kept.append(row)
        return [self._clean(k) for k in done]

    def finish(self):
        return [self._clean(k) for k in self.kept]

    @staticmethod
    def _clean(row):
        out = {k: v for k, v in row.items() if k not in ("norm", "b")}
        out["box"] = dict(zip(("x1", "y1", "x2", "y2"), row["b"])) if row["b"] else None
        return out

    def _kind(self, a, b):
        inter = min(a["end_time"], b["end_time"]) - max(a["start_time"], b["start_time"])
        if inter <= 0 or (a["b"] is None) != (b["b"] is None):
            return None
        if a["b"] and B.overlap_over_smaller(a["b"], b["b"]) < 0.45:
            return None
        if known_score(a["norm"], b["norm"]) >= 0.92:
            return "same"
        wa, wb = a["norm"].split(), b["norm"].split()
        if not wa or not wb or len(wa) == len(wb):
            return None
        short, long = (a, b) if len(wa) < len(wb) else (b, a)
        if f" {short['norm']} " not in f" {long['norm']} ":
            return None
        shorter = min(a["end_time"] - a["start_time"], b["end_time"] - b["start_time"])
        if shorter <= 0 or inter / shorter < 0.60:
            return None
        if short["start_time"] + self.interval * 0.5 < long["start_time"]:
            return None  # the short form came first: a reveal, not a nested reading
        return "contained"

    @staticmethod
    def _merge(a, b, kind):
        conf = round(max(a["confidence"], b["confidence"]), 4)
        box = B.union([a["b"], b["b"]]) if a["b"] and b["b"] else a["b"]
        if kind == "contained":
            weight = lambda r: (len(r["norm"].split()), len(r["norm"]))
            lead = a if weight(a) >= weight(b) else b
            return lead | {"confidence": conf, "b": box}
        longer = b if len(b["norm"]) > len(a["norm"]) else a
        return a | {
            "start_time": min(a["start_time"], b["start_time"]), "end_time": max(a["end_time"], b["end_time"]),
            "confidence": conf, "b": box, "text": longer["text"], "norm": longer["norm"],
        }


def merge_duplicates(events: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Merge duplicate events; groups are runs of overlapping events of equal line count.

    Runs with a single event, the common case, skip Python.
    """
    keys, order = ["video_id", "lines"], ["start_time", "end_time", "x1", "y1", "x2", "y2", "session_id", "track_no"]
    flat = events.withColumns({c: F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")})
    chunk = time_chunk("start_time", cfg.chunk_seconds)
    seen = ordered(flat, keys, order, chunk, max_before={"_reach": "end_time"})
    opens = F.col("_reach").isNull() | (F.col("start_time") >= F.col("_reach"))
    runs = ordered(
        seen.withColumn("_open", F.when(opens, F.col("start_time"))), keys, order, chunk,
        last_seen={"_run": "_open"}, lead={"_next_open": F.col("_open").isNotNull()},
    )
    runs = cut(runs)
    alone = F.col("_open").isNotNull() & F.coalesce(F.col("_next_open"), F.lit(True))
    columns = events.columns
    single = runs.where(alone).select(*columns)
    crowd = runs.where(~alone).select(*columns, "_run", "x1", "y1", "x2", "y2")
    schema = events.schema
    merged = fold_groups(
        crowd, [*keys, "_run"], order, lambda: _Narrow(DuplicateMerge(cfg.interval), columns), schema
    )
    return single.unionByName(merged)


class _Narrow(Fold):
    """Run a fold and keep only the named columns of what it emits."""

    def __init__(self, inner: Fold, columns: list[str]):
        self.inner, self.columns = inner, columns

    def push(self, row):
        return [{c: r[c] for c in self.columns} for r in self.inner.push(row)]

    def finish(self):
        return [{c: r[c] for c in self.columns} for r in self.inner.finish()]


def build_events(obs: DataFrame, videos: DataFrame, cfg: CaptionConfig = CaptionConfig()) -> DataFrame:
    """Observations to caption events, with a stable ``cue_id``."""
    events = cut(summarize_tracks(associate_tracks(obs, cfg), videos, cfg))
    events = merge_duplicates(events, cfg)
    stable = F.xxhash64("video_id", "session_id", "lines", "track_no")
    return events.withColumn("cue_id", stable)
