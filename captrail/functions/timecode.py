"""Clock strings, frames and presentation time stamps as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clock(ms: Column, separator: str) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(ms / 3600000)
    return F.concat(
        F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"),
        two(F.floor(ms / 60000) % 60), F.lit(":"),
        two(F.floor(ms / 1000) % 60), F.lit(separator),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm with half-even milliseconds."""
    return _clock(F.greatest(F.lit(0), F.bround(seconds * 1000, 0).cast("long")), ",")


def srt_time_js(seconds: Column) -> Column:
    """HH:MM:SS,mmm with half-up milliseconds."""
    return _clock(F.greatest(F.lit(0), F.floor(seconds * 1000 + F.lit(0.5))), ",")


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm as the editor shows it."""
    return _clock(F.greatest(F.lit(0), F.floor(seconds * 1000 + F.lit(0.5))), ".")


def clock_compact(seconds: Column) -> Column:
    """H:MM:SS from one hour on, otherwise MM:SS."""
    whole = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours, minutes, secs = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    short = F.concat(two(minutes), F.lit(":"), two(secs))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), short)).otherwise(short)


def parse_srt_time(text: Column) -> Column:
    parts = F.split(F.translate(text, ",", "."), ":")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    return (
        part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60
        + part(3).try_cast("double")
    )


def parse_clock(text: Column) -> Column:
    """Seconds, MM:SS(.mmm) or HH:MM:SS[,.]mmm; out-of-range parts give null."""
    value = F.translate(F.trim(text), ",", ".")
    parts = F.split(value, ":")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    plain = value.rlike(r"^\d+(\.\d+)?$")
    two = value.rlike(r"^\d+(\.\d+)?(:\d+(\.\d+)?){1}$")
    three = value.rlike(r"^\d+(\.\d+)?(:\d+(\.\d+)?){2}$")
    return (
        F.when(plain, value.try_cast("double"))
        .when(two & (part(2) < 60), part(1) * 60 + part(2))
        .when(three & (part(2) < 60) & (part(3) < 60), part(1) * 3600 + part(2) * 60 + part(3))
    )


def time_base(text: Column) -> Column:
    """'n/d' to struct<num,den>; null when malformed or zero."""
    num = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("long")
    den = F.split_part(text, F.lit("/"), F.lit(2)).try_cast("long")
    ok = text.rlike(r"^\d+/\d+$") & (num > 0) & (den > 0)
    return F.when(ok, F.struct(num.alias("num"), den.alias("den")))


def pts_seconds(pts: Column, start_pts: Column, num: Column, den: Column) -> Column:
    """Exact integer product first, so only the division rounds."""
    return ((pts - start_pts) * num).cast("double") / den.cast("double")


def to_frame(seconds: Column, fps: Column, mode: str = "round") -> Column:
    scaled = seconds * fps
    if mode == "round":
        return F.bround(scaled, 0).cast("long")
    if mode == "floor":
        return F.floor(scaled)
    if mode == "ceil":
        return F.ceil(scaled)
    raise ValueError(f"unknown mode {mode!r}")
