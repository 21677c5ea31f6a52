"""Hard negatives of anchors by exact integer products of whole tiles.

Anchors and candidates are dealt into strips and parts; each pair of a strip and a part is one tile, multiplied by
Strassen's recursion in int64. Sums and products there are exact modulo 2**64, so the result is exact wherever it fits. A
first pass keeps a heap of the best same-label rows of each anchor, a second one a heap for each window below a positive.
Heaps of tiles merge by keeping the best of both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

STRIP = 2048
PART = 8192
LEAF = 16
SCALE = 256
#: Scores stay below this, so that a hundredfold fits a long.
MOST = 2**56


def _even(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2)))


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of int64 matrices by seven products of halves; odd sides are padded with zeros."""
    if min(*a.shape, b.shape[1]) <= LEAF:
        return a @ b
    rows, columns = a.shape[0], b.shape[1]
    a, b = _even(a), _even(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1, p2 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11)
    p3, p4 = strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6, p7 = strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones continued by zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _ranked(anchors: pa.Table, rows: pa.Table):
    """For each anchor: its place, and the other rows' ids, scores and whether they share its label, best first."""
    if not (anchors.num_rows and rows.num_rows):
        return
    rows = rows.sort_by("id")
    width = max(1, *(pc.max(pc.list_value_length(t.column("vector"))).as_py() for t in (anchors, rows)))
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    x, y = _matrix(anchors.column("vector"), width), np.ascontiguousarray(_matrix(rows.column("vector"), width).T)
    own, own_label = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    for at in range(0, len(own), 256):
        scores = strassen(x[at: at + 256], y)
        for k, row in enumerate(scores, at):
            order = np.argsort(-row, kind="stable")
            order = order[ids[order] != own[k]]
            yield k, ids[order], row[order], labels[order] == own_label[k]


POSITIVES = "anchor_id long, anchor_key long, positive_id long, positive_score long"


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        for place, ids, scores, same in _ranked(anchors, rows):
            first = np.flatnonzero(same)[:k]
            named = [np.full(len(first), anchors.column(c)[place].as_py()) for c in ("id", "key")]
            for column, values in zip(out, (*named, ids[first], scores[first]), strict=True):
                column.append(values)
        return _table(out, ("anchor_id", "anchor_key", "positive_id", "positive_score"))

    return run


def _table(columns: tuple[list, ...], names: tuple[str, ...]) -> pa.Table:
    arrays = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64()) for c in columns]
    return pa.table(dict(zip(names, arrays, strict=True)))


WINDOWS = "anchor_id long, anchor_key long, place long, positive_id long, positive_score long, negative_id long, negative_score long"


def _windows(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [], [], [], [], [])
        for place, ids, scores, same in _ranked(anchors, rows):
            ids, scores = ids[~same], scores[~same]
            a, key = anchors.column("id")[place].as_py(), anchors.column("key")[place].as_py()
            for p in anchors.column("positives")[place].as_py():
                from_ = np.searchsorted(-scores, -(high * p["score"] // 100), "left")
                to = np.searchsorted(-scores, -(-(-low * p["score"] // 100)), "right")
                to = max(from_, min(to, from_ + k))
                found = (np.full(to - from_, v) for v in (a, key, p["place"], p["id"], p["score"]))
                for column, values in zip(out, (*found, ids[from_:to], scores[from_:to]), strict=True):
                    column.append(values)
        return _table(out, tuple(c.split()[0] for c in WINDOWS.split(", ")))

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, parts: int, strips: int, run, schema: str) -> DataFrame:
    """Every strip of anchors against every part of the rows."""
    to = anchors.withColumn("strip", F.pmod(F.xxhash64("key"), F.lit(strips)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    return to.groupBy("strip", "part").cogroup(dealt.groupBy("strip", "part")).applyInArrow(run, schema)


def _best(heaps: DataFrame, by: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """Merged heaps: the first k of each, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return heaps.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, k_positives: int = 5, k_negatives: int = 5, low: int = 80, high: int = 100,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the hard negatives of each positive.

    Anchors are the rows whose id is divisible by ``every``. Scores are inner products of floor(256*x); the best come first,
    ties by the smaller id. A positive's negatives are the first rows of another label whose score is ``low`` to ``high``
    per cent of its own. No row is a partner of its own id. Rows with a null id or label, a vector that is null or has null
    or non-finite components take no part, nor do those whose components are so large that a score might pass 2**56.
    Equal rows (id, label and vector) count once; rows of one id that differ are rows of their own, also as anchors.
    Shorter vectors count as continued by zeros, empty ones score 0. An empty table, or one without anchors, gives an
    empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where("id is not null and label is not null and x is not null").where(usable)
    bound = F.sqrt(F.lit(float(MOST)) / F.greatest(F.size("x"), F.lit(1))) / SCALE - 1
    rows = rows.where(F.forall("x", lambda v: F.abs(v) <= bound))
    rows = rows.select("id", "label", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("vector"))
    rows = stage(rows.withColumn("key", F.xxhash64("id", "label", "vector")).dropDuplicates(["id", "label", "vector"]))
    anchors = rows.where(F.col("id") % every == 0)
    n, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    parts, strips = -(-n // PART), -(-n_anchors // STRIP)
    heaps = _tiles(anchors, rows, parts, strips, _positives(k_positives), POSITIVES)
    positives = _best(heaps, ["anchor_id", "anchor_key"], "positive_score", "positive_id", k_positives)
    listed = positives.groupBy("anchor_key").agg(F.collect_list(F.struct(F.col("rank").alias("place"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives"))
    asked = stage(anchors.join(listed, F.col("key") == F.col("anchor_key")).drop("anchor_key"))
    heaps = _tiles(asked, rows, parts, strips, _windows(k_negatives, low, high), WINDOWS)
    negatives = _best(heaps, ["anchor_id", "anchor_key", "place", "positive_id", "positive_score"], "negative_score", "negative_id", k_negatives)
    return negatives.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
