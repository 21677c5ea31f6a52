"""Mixing sources to target weights by balanced sampling (cube method).

A source that is to give ``t`` words of its ``s`` takes every document floor(t/s) times, and each once more with the
fractional probability that is left. The flight phase moves these probabilities through the null space of the
constraints (words, documents), three documents at a time, so that both totals stay as they are while one document
after the other comes to 0 or 1. Blocks of a source fly side by side; what each leaves undecided, three documents at
most, and its part of ``LANDING`` documents that do not fly meet in the next round. A source that is down to one block
lands there, whatever the others do: ``LANDING`` documents that did not fly and what the flight left, solved by trying
every choice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BLOCK = 4096
CLOSE = 1e-9
LANDING = 10
# Weights of the sources in order, repeating, and the share of all sizes to hand out.
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST_COPIES = 2.0


def word_sizes(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The named columns and ``size``, the number of words of the text (null: 0)."""
    rows = docs.select(*keep, F.col(text_col).alias("words"))
    schema = rows.select(*keep, F.lit(0).cast("long").alias("size")).schema

    def run(batches):
        for batch in batches:
            n = pa.array([len(t.as_py().encode().split()) if t.is_valid else 0 for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, "size"])

    return rows.mapInArrow(run, schema)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target``: a row per source; weights repeat in code point order, null last.

    A source never gives more than ``MOST_COPIES`` times its size; what exceeds that is shared anew by weight. The
    common level of the others is the largest over the sources in the order in which they fill up.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    rows = totals.withColumn("w", weights[(F.row_number().over(order) - 1) % len(WEIGHTS)])
    rows = rows.withColumn("full", F.col("source_size") * MOST_COPIES)
    fills = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    filled = F.coalesce(F.sum("full").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(fills.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * TOTAL_SHARE - filled) / open_weight)
    rows = rows.withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least("full", F.col("level") * F.col("w")).alias("target"))


def fly(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase: probabilities after the moves; at most three, in fact two of unequal size, stay between 0 and 1."""
    p = [float(x) for x in p]
    size, draw = size.astype(float).tolist(), draw.tolist()
    held: list[int] = []
    for k in range(len(p)):
        if not CLOSE < p[k] < 1 - CLOSE:
            p[k] = float(round(p[k]))
            continue
        held.append(k)
        while len(held) == 3 or len(held) == 2 and size[held[0]] == size[held[1]]:
            a, b, c = [*held, held[-1]][:3]
            if size[a] == size[b]:
                move = [(a, 1.0), (b, -1.0)]
            elif size[b] == size[c]:
                move = [(b, 1.0), (c, -1.0)]
            elif size[a] == size[c]:
                move = [(a, 1.0), (c, -1.0)]
            else:
                move = [(a, size[c] - size[b]), (b, size[a] - size[c]), (c, size[b] - size[a])]
            up = min(((1 - p[i]) / u if u > 0 else p[i] / -u) for i, u in move)
            down = min((p[i] / u if u > 0 else (1 - p[i]) / -u) for i, u in move)
            way = up if draw[k] * (up + down) < down else -down
            for i, u in move:
                p[i] += way * u
                if p[i] < CLOSE or p[i] > 1 - CLOSE:
                    p[i] = float(round(p[i]))
            held = [i for i in held if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Landing phase: the 0/1 choice for the few that are left whose words, then documents, come nearest to what is due."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        choice = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs(choice @ size[left] - (size[left] * p[left]).sum())
        rows = np.abs(choice.sum(axis=1) - p[left].sum())
        p[left] = choice[np.lexsort((rows, words))[0]]
    return p


UNITS = "doc_id long, source string, size long, source_size long, target double, copy long, whole double, p double"


def sample(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words that the mix takes of every document, repeats counted.

    A null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows that agree
    in id, source and size are told apart by a number, so that reruns agree; a null id stays null. An empty table
    gives an empty result. Blocks hold about ``BLOCK`` documents whatever the size of a source.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    sizes = stage(word_sizes(named, "doc_id", "source"))
    targets = source_targets(sizes)
    same = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    units = same.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).alias("u")
    units = units.join(targets.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", "u.source", "size", "source_size", "target", "copy")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("whole", F.floor(rate).cast("double")).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
    decided, largest = [], BLOCK + 1
    while largest > BLOCK:
        rows = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        blocks = rows.select("source", F.ceil(F.col("n") / BLOCK).alias("blocks"))
        largest = rows.agg(F.max("n")).first()[0] or 0
        dealt = units.alias("u").join(blocks.alias("b"), F.col("u.source").eqNullSafe(F.col("b.source"))).select(
            "u.*", F.xxhash64("doc_id", "size", "copy").alias("h"), "blocks")
        dealt = dealt.withColumn("block", F.pmod("h", "blocks"))
        moved = stage(dealt.groupBy("source", "block").applyInArrow(_move, UNITS))
        still = F.col("p").between(CLOSE, 1 - CLOSE)
        decided.append(moved.where(~still))
        units = moved.where(still)
    out = decided[0]
    for more in decided[1:]:
        out = out.union(more)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("p"))).cast("long").alias("taken"))


def _move(rows: pa.Table) -> pa.Table:
    """Fly a block; the only one of its source lands as well, others hold back their part of the ``LANDING`` documents."""
    h = rows.column("h").to_numpy()
    order = np.argsort(h, kind="stable")
    rows, h = rows.take(order), h[order]
    draw = (np.roll(h, 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / 2.0**53
    size, blocks = rows.column("size").to_numpy(), rows.column("blocks")[0].as_py()
    p, kept = rows.column("p").to_numpy().copy(), np.zeros(len(h), bool)
    kept[np.flatnonzero((p > CLOSE) & (p < 1 - CLOSE))[: -(-LANDING // blocks)]] = True
    p[~kept] = fly(size[~kept], p[~kept], draw[~kept])
    at = rows.column_names.index("p")
    return rows.set_column(at, "p", pa.array(land(size, p) if blocks == 1 else p, pa.float64())).drop_columns(["h", "block", "blocks"])
