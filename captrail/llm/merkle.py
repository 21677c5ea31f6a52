"""A Merkle manifest of a table: a tree of SHA-256 digests per language, and one over their roots, with a proof per row.

Leaves are numbered in order and cut into blocks, each an aligned subtree. Blocks fold their leaves on their own; then a
butterfly exchange goes up: in each round, aligned groups of ``FANOUT`` nodes swap the digests they have reached, lane by
lane, and every block hashes the common parent itself. So each block ends up with the root and with all siblings on its
way to it, and nothing has to be passed down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, stage
from .linedups import lower_ascii

FANOUT = 8
#: Leaves of a block: FANOUT to the power of BLOCK_LEVELS.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RANGES = 64_000


def encoded(value: Column) -> Column:
    """A value as the hash takes it: ``-`` if null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def numbered(rows: DataFrame, order: list[Column | str], schema: str) -> tuple[DataFrame, int]:
    """The rows with ``at``, their place in their ``tree``, counted from 0, and ``leaves``, its size; the largest size.

    Rows are dealt in ranges of the order and counted within each; the ranges' counts, a row per range and tree, are added
    up. ``schema``: of the columns to keep.
    """
    kept = [c.split()[0] for c in schema.split(", ")]
    ranges = max(1, rows.count() // RANGES)
    order = [F.col("tree").asc_nulls_first(), *order]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for key in batch.column("tree").to_pylist():
                known, n = key, n + 1 if key == known else 0
                places.append(n)
            new = [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, "range", "place"])

    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = stage(dealt.select(*kept).mapInArrow(count, f"{schema}, range int, place long"))
    per = found.groupBy("tree", "range").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(per.select(F.col("tree").alias("of"), F.col("range").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(tree).alias("leaves")))
    at = found.join(starts, F.col("tree").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    return at.withColumn("at", F.col("start") + F.col("place")).select(*kept, "at", "leaves"), starts.agg(F.max("leaves")).first()[0] or 0


def levels(leaves: int) -> int:
    """How often nodes are joined until one remains."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FANOUT), n + 1
    return n


def hashed(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def fold(nodes: list[str], times: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(times):
        nodes = out[-1]
        out.append([hashed(nodes[k: k + FANOUT]) for k in range(0, len(nodes), FANOUT)])
    return out


STEP = "array<struct<left:array<string>,right:array<string>>>"


def block_roots(blocks: DataFrame) -> DataFrame:
    """``tree, block, leaves, digest``: what each block's leaves fold to."""

    def run(batches):
        for batch in batches:
            trees, numbers, sizes, leaves = (batch.column(c).to_pylist() for c in ("tree", "block", "leaves", "rows"))
            roots = [fold([r["leaf"] for r in rows], min(BLOCK_LEVELS, levels(n)))[-1][0] for rows, n in zip(leaves, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), pa.array(roots)], names=["tree", "block", "leaves", "digest"])

    return blocks.mapInArrow(run, "tree string, block long, leaves long, digest string")


def butterfly(nodes: DataFrame, most: int) -> DataFrame:
    """``tree, block, steps, digest``: each block's siblings on the way up, and the root. ``most``: blocks of the largest tree.

    In round r a node is a run of up to FANOUT**r blocks. Block l of a node swaps with block l of the neighbours in its
    group; a node with fewer blocks, the last one of a tree, serves the lanes left over by turns. So a block sends and
    gets FANOUT - 1 digests at most, but for those of a last node, and no block hears from all others.
    """
    state = nodes.withColumn("steps", F.array().cast(STEP)).withColumn("blocks", F.ceil(F.col("leaves") / FANOUT**BLOCK_LEVELS))
    span = 1
    while span < most:
        node, last = F.floor(F.col("block") / span), F.floor((F.col("blocks") - 1) / span)
        lane, width = F.col("block") % span, F.least(F.lit(span), F.col("blocks") - F.floor(F.col("block") / span) * span)
        # Lanes that the fullest node of the group has; a group of a single node needs its own only.
        first = F.floor(F.col("block") / (span * FANOUT)) * FANOUT
        lanes = F.when(first == last, width).otherwise(F.lit(span))
        served = F.sequence(lane, lanes - 1, width)
        sent = state.where(F.col("blocks") > span).withColumn("group", F.floor(F.col("block") / (span * FANOUT)))
        sent = sent.withColumn("to", F.explode(served)).withColumn("own", F.col("to") == lane)
        entry = F.struct(node.alias("node"), "digest", "own", "block", F.when(F.col("own"), F.col("steps")).alias("steps"), "leaves", "blocks")
        met = sent.groupBy("tree", "group", "to").agg(F.sort_array(F.collect_list(entry)).alias("met"))
        digests = F.transform("met", lambda m: m["digest"])
        met = met.withColumn("parent", F.sha2(F.array_join(digests, ""), 256)).withColumn("digests", digests)
        each = met.select("tree", "parent", "digests", F.posexplode("met").alias("k", "m")).where("m.own")
        step = F.struct(F.slice("digests", F.lit(1), F.col("k")).alias("left"), F.slice("digests", F.col("k") + 2, F.lit(FANOUT)).alias("right"))
        up = each.select("tree", "m.block", "m.leaves", F.col("parent").alias("digest"), F.concat("m.steps", F.array(step)).alias("steps"), "m.blocks")
        done = state.where(F.col("blocks") <= span).select(up.columns)
        state = stage(done.unionByName(up))
        span *= FANOUT
    return state.select("tree", "block", "steps", "digest")


def grown(rows: DataFrame, most: int, columns: str) -> tuple[DataFrame, DataFrame]:
    """The blocks, ``tree, block, leaves, rows``, and their way up, ``tree, block, steps, digest``."""
    names = [c.split()[0] for c in columns.split(", ")]
    blocks = rows.withColumn("block", F.floor(F.col("at") / FANOUT**BLOCK_LEVELS))
    packed = stage(blocks.groupBy("tree", "block", "leaves").agg(F.sort_array(F.collect_list(F.struct("at", *names))).alias("rows")))
    return packed, butterfly(block_roots(packed), -(-most // FANOUT**BLOCK_LEVELS))


def proofs(packed: DataFrame, ups: DataFrame, columns: str, roots: tuple[str, ...]) -> DataFrame:
    """``columns``, ``steps`` from the leaf upwards, and ``roots``, which come from ``ups``, of every leaf."""
    names = [c.split()[0] for c in columns.split(", ")]
    above = ups.select(F.col("tree").alias("of"), F.col("block").alias("in"), F.col("steps").alias("ups"), *roots)
    both = packed.join(above, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in"))).select("rows", "leaves", "ups", *roots)
    types = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, ups = batch.column("rows")[k].values, batch.column("ups")[k].as_py()
                own = fold(rows.field("leaf").to_pylist(), min(BLOCK_LEVELS, levels(batch.column("leaves")[k].as_py())))
                steps = []
                for at in range(len(rows)):
                    path = []
                    for nodes in own[:-1]:
                        low = at - at % FANOUT
                        path.append({"left": nodes[low:at], "right": nodes[at + 1: low + FANOUT]})
                        at //= FANOUT
                    steps.append(path + ups)
                new = [pa.array([batch.column(c)[k].as_py()] * len(rows), pa.string()) for c in roots]
                yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in names), pa.array(steps, types), *new], names=[*names, "steps", *roots])

    return both.mapInArrow(run, f"{columns}, steps {STEP}, " + ", ".join(f"{c} string" for c in roots))


def manifest(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, leaf, tampered_leaf, steps, subroot, root``: every row's digest and proof.

    A leaf hashes id, source, lang, n_chars and text; leaves of a language ascend by id (null first, equal ids by leaf);
    the languages' roots, null first, make the tree on top. ``steps`` holds the siblings to the left and right on each
    level, from the leaf to the root. ``tampered``: a column of texts to put in place of the text, whose leaf is then
    ``tampered_leaf``, else null. Rows that repeat are leaves of their own; a null text differs from an empty one; texts
    of any length are hashed whole. An empty table gives an empty result; further columns are ignored.
    """
    parts = [encoded(F.col(text_col if c == "text" else id_col if c == "doc_id" else c)) for c in FIELDS]
    changed = F.lit(None).cast("string") if tampered is None else digest(*parts[:-1], encoded(tampered))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("tree"), digest(*parts).alias("leaf"), changed.alias("tampered_leaf"))
    # The order of equal rows must not change between runs of a task: staged rows keep their numbers.
    rows = stage(rows).withColumn("tie", F.monotonically_increasing_id())
    columns = "doc_id long, leaf string, tampered_leaf string"
    packed, ups = grown(*numbered(rows, [F.col("doc_id").asc_nulls_first(), "leaf", "tie"], f"tree string, {columns}"), columns)
    tops = stage(ups.groupBy("tree").agg(F.first("digest").alias("leaf")).select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "leaf"))
    pair = "lang string, leaf string"
    above = proofs(*grown(*numbered(tops, [F.col("lang").asc_nulls_first()], f"tree string, {pair}"), pair), pair, ("digest",))
    above = stage(above.select("lang", F.col("steps").alias("more"), F.col("digest").alias("root")))
    whole = ups.join(above, F.col("tree").eqNullSafe(F.col("lang"))).select("tree", "block", F.concat("steps", "more").alias("steps"), F.col("digest").alias("subroot"), "root")
    return proofs(packed, whole, columns, ("subroot", "root"))


def verify(proofs: DataFrame, leaf: Column) -> DataFrame:
    """The proofs with ``folded_root``, what ``leaf`` and the siblings fold to, and ``verified``: whether it is the root."""
    siblings = F.array_join(F.flatten(F.transform("steps", lambda s: F.concat(s["left"], s["right"]))), "")
    joined = F.aggregate("steps", leaf, lambda acc, s: F.sha2(F.concat(F.array_join(s["left"], ""), acc, F.array_join(s["right"], "")), 256))
    return proofs.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", joined).withColumn("verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame, modulus: int = 3) -> DataFrame:
    """The manifest's digests, and how rows fare whose text is lower-cased (A-Z) where ``modulus`` divides crc32(doc_id).

    A null id counts as empty text there. A null text stays null, so its row still verifies, as do texts without A-Z.
    """
    hit = crc_mod("doc_id", modulus) == 0
    found = verify(manifest(docs, F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))), F.col("tampered_leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
