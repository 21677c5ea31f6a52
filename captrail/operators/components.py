"""Connected components by alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrail.operators.folds import cut, plain, spread

#: Edges that a task joins to stars at a time.
HELD = 1 << 18


def _least(edges: DataFrame) -> DataFrame:
    """Each node with the least of its neighbours and itself."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("_least"))


def _nodes(column: pa.Array) -> list:
    """The nodes, structs as tuples, read field by field."""
    return list(zip(*map(plain, column.flatten()), strict=True)) if pa.types.is_struct(column.type) else plain(column)


def _packed(nodes: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_struct(kind):
        return pa.array(nodes, kind)
    fields = list(kind)
    return pa.StructArray.from_arrays([pa.array([n[k] for n in nodes], f.type) for k, f in enumerate(fields)], fields=fields)


def _stars(edges: DataFrame) -> DataFrame:
    """Edges of each part of ``HELD`` rows as stars around their least nodes: as many at most, and nothing left unlinked."""

    def run(batches):
        root: dict = {}

        def head(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = root[x]
            return x

        def stars():
            pairs = [(x, r) for x in root if (r := head(x)) != x]
            yield pa.RecordBatch.from_arrays([_packed([p[k] for p in pairs], kind) for k in (0, 1)], names=["a", "b"])

        kind, held = None, 0
        for batch in batches:
            kind = batch.schema.field("a").type
            for a, b in zip(_nodes(batch.column("a")), _nodes(batch.column("b")), strict=True):
                low, high = sorted((head(a), head(b)))
                root[high] = low
            held += batch.num_rows
            if held >= HELD:
                yield from stars()
                root.clear()
                held = 0
        if root:
            yield from stars()

    return edges.mapInArrow(run, edges.schema)


def components(edges: DataFrame, together: str | None = None) -> DataFrame:
    """``node, component``: the smallest node that each node of the edges (a, b) reaches.

    Tasks first join what they hold; ``together`` names a column that mostly keeps components in one task. Then two steps
    alternate until the edges stay as they are: a node hands its larger neighbours to its least one, then all its smaller
    ones. The edges never grow in number, and a node's neighbours are never gathered, only joined with their least one.
    Nodes are longs, strings or structs of such, never null.
    """
    found = (spread(edges, together) if together else edges).select("a", "b").where("a <> b")
    found = cut(_stars(found).distinct())
    while not _settled(found):
        sides = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(sides.join(_least(sides), "a").where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b")).distinct())
        other = F.when(F.col("b") == F.col("_least"), F.col("a")).otherwise(F.col("b"))
        small = large.join(_least(large), "a").select(other.alias("a"), F.col("_least").alias("b"))
        found = cut(small.where("a <> b").distinct())
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).union(found.select("b", "b").distinct())


def _settled(stars: DataFrame) -> bool:
    """Every node hangs on one centre, and no centre on another."""
    nodes = stars.select(F.col("a").alias("node"), F.lit(1).alias("hangs")).union(stars.select("b", F.lit(0)).distinct())
    return nodes.groupBy("node").count().where("count > 1").isEmpty()
