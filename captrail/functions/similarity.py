"""Caption and evaluation similarity.

Equality and containment are decided by Spark expressions; only pairs left over,
and able to reach the asked-for score by their lengths, go through the sequence
matcher in an Arrow UDF.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrail.functions import text as TX
from captrail.operators.textjoin import Subsequences


def common(a: str, b: str) -> int:
    """Shared characters with repeats: no matching of the two is larger."""
    return sum(min(a.count(c), b.count(c)) for c in set(a) & set(b))


def bounded_ratio(matcher: SequenceMatcher, a: str, b: str, at_least: float) -> float:
    """The matcher's ratio of its two texts; 0 as soon as what is left open cannot bring it to ``at_least``."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    matched, hope, open_ = 0, common(a, b), [(0, len(a), 0, len(b))]
    while open_:
        if 2.0 * hope / total < at_least:
            return 0.0
        at, to, bt, bo = open_.pop()
        i, j, n = matcher.find_longest_match(at, to, bt, bo)
        hope -= common(a[at:to], b[bt:bo])
        if n:
            matched += n
            hope += n
            for part in ((at, i, bt, j), (i + n, to, j + n, bo)):
                shared = common(a[part[0]: part[1]], b[part[2]: part[3]])
                if shared:
                    hope += shared
                    open_.append(part)
    return 2.0 * matched / total


#: Characters of the texts whose ratios are worked out for many pairs at once: a bit each.
SHORT = 64


def _grid(texts: list[str], blank: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points (texts x ``SHORT``, filled up with ``blank``) and lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), SHORT), blank, np.uint32)
    out[np.arange(SHORT) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def _longest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per interval the length of its longest run, and the last column and bit of the earliest one; length 0 without any.

    ``rows`` (intervals x columns): a bit for each place of the second text that equals the column's character.
    """
    size, column, place = (np.zeros(len(rows), np.int64) for _ in range(3))
    alive = np.flatnonzero(rows.any(axis=1))
    rows = rows[alive]
    runs, length = rows, 0
    while len(alive):
        length += 1
        longer = np.zeros_like(runs)
        longer[:, 1:] = rows[:, 1:] & (runs[:, :-1] << np.uint64(1))
        on = longer.any(axis=1)
        done = np.flatnonzero(~on)
        if len(done):
            at, ends = alive[done], runs[done]
            first = (ends != 0).argmax(axis=1)
            bits = ends[np.arange(len(done)), first]
            size[at], column[at], place[at] = length, first, np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))
            alive, rows, longer = alive[on], rows[on], longer[on]
        runs = longer
    return size, column, place


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The matcher's ratios of pairs of texts of ``SHORT`` characters at most, all pairs at once.

    The matcher takes the longest common run, the earliest in the first text and then in the second, and goes on left and
    right of it; here a round does so for the open intervals of all pairs. Texts this short have no popular characters.
    """
    (first, la), (second, lb) = _grid(a, 0xFFFFFFFE), _grid(b, 0xFFFFFFFF)
    width = max(1, int(la.max(initial=0)))
    equal = np.empty((len(a), width), np.uint64)
    for p in range(width):
        equal[:, p] = np.packbits(first[:, p, None] == second, axis=1, bitorder="little").view("<u8").ravel()
    below = np.concatenate([(np.uint64(1) << np.arange(SHORT, dtype=np.uint64)) - np.uint64(1), [np.uint64(2**64 - 1)]])
    matched = np.zeros(len(a), np.int64)
    pair, lo, hi, low, high = np.arange(len(a)), np.zeros_like(la), la, np.zeros_like(lb), lb
    while len(pair):
        columns = lo[:, None] + np.arange(int((hi - lo).max()))
        rows = equal[pair[:, None], np.minimum(columns, width - 1)] & (below[high] & ~below[low])[:, None]
        rows[columns >= hi[:, None]] = 0
        size, column, place = _longest(rows)
        np.add.at(matched, pair, size)
        end, stop = lo + column + 1, place + 1
        left = (size > 0) & (end - size > lo) & (stop - size > low)
        right = (size > 0) & (end < hi) & (stop < high)
        pair, lo, hi, low, high = (np.concatenate(x) for x in (
            (pair[left], pair[right]), (lo[left], end[right]), ((end - size)[left], hi[right]),
            (low[left], stop[right]), ((stop - size)[left], high[right])))
    total = la + lb
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def able(a: np.ndarray, b: np.ndarray, at_least: float) -> np.ndarray:
    """Which pairs of texts have a common subsequence long enough for ``at_least``; the matcher's blocks are one."""
    texts, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a):]
    return (left == right) | Subsequences(texts.tolist()).reach(left, right, at_least)


def matcher_udf(autojunk: bool, at_least: float = 0.0):
    """Arrow UDF of the matcher ratio; may be 0 where it provably stays below ``at_least``."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full(len(a), np.nan)
        todo = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        left, right = a.to_numpy(), b.to_numpy()
        brief = np.fromiter((len(left[i]) <= SHORT and len(right[i]) <= SHORT for i in todo), bool, len(todo))
        short, todo = todo[brief], todo[~brief]
        out[short] = ratios(left[short].tolist(), right[short].tolist())
        # The matcher indexes its second text, so pairs sharing it are kept together.
        matcher, indexed = None, None
        for i in todo[np.argsort(right[todo], kind="stable")]:
            if right[i] != indexed:
                matcher, indexed = SequenceMatcher(None, "", right[i], autojunk=autojunk), right[i]
            matcher.set_seq1(left[i])
            out[i] = bounded_ratio(matcher, left[i], right[i], at_least)
        return pd.Series(out)

    return ratio


def caption_similarity(a_norm: Column, b_norm: Column, at_least: float = 0.0) -> Column:
    """Similarity of two association texts in normal form.

    Values below ``at_least`` may come back as 0 when the lengths rule them out.
    """
    shortcut = TX.containment_score(a_norm, b_norm)
    open_pair = shortcut.isNull() & (TX.matcher_bound(a_norm, b_norm) >= at_least)
    ratio = matcher_udf(True, at_least)(F.when(open_pair, a_norm), F.when(open_pair, b_norm))
    return F.coalesce(shortcut, F.nanvl(ratio, F.lit(0.0)), F.lit(0.0))


def eval_similarity(a_compact: Column, b_compact: Column, at_least: float = 0.0) -> Column:
    """Similarity of two compact evaluation texts (order matters)."""
    shortcut = (
        F.when((a_compact == "") | (b_compact == ""), F.lit(0.0))
        .when(a_compact == b_compact, F.lit(1.0))
    )
    open_pair = shortcut.isNull() & (TX.matcher_bound(a_compact, b_compact) >= at_least)
    ratio = matcher_udf(False, at_least)(F.when(open_pair, a_compact), F.when(open_pair, b_compact))
    return F.coalesce(shortcut, F.nanvl(ratio, F.lit(0.0)), F.lit(0.0))


def caption_score(a_norm: str, b_norm: str) -> float:
    """The same score inside Python kernels."""
    if not a_norm or not b_norm:
        return 0.0
    if a_norm in b_norm or b_norm in a_norm:
        short, long = sorted((a_norm, b_norm), key=len)
        share = len(short) / len(long)
        return 0.72 + share * 0.28 if " " in short else share
    return SequenceMatcher(None, a_norm, b_norm).ratio()


def could_reach(a_norm: str, b_norm: str, at_least: float) -> bool:
    """False when the lengths alone keep the matcher below ``at_least``."""
    la, lb = len(a_norm), len(b_norm)
    return 2 * min(la, lb) >= at_least * (la + lb) or a_norm in b_norm or b_norm in a_norm
