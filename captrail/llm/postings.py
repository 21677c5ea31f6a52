"""Approximate nearest neighbours from balanced posting lists.

Centroids come from balanced bisections of a bounded sample. A graph over the centroids, held in memory, finds those near
a vector. A vector is stored with its nearest centroid and, if it lies at a boundary, with several: those hardly farther
and not behind one that is already chosen. A query searches the graph and reads the lists whose centroids are within a
distance ratio of the nearest, at least as many as a sample of queries needs: their true neighbours, found by brute force,
tell how many of the nearest lists hold ``RECALL`` of them. Distances are exact, in double precision, on the original vectors.
Neighbouring lists make groups: a query goes to a group once, with the lists that it reads there, and comes back with its
nearest rows of all of them, so that what is shuffled follows the queries and not the lists they read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SAMPLE = 40_000
LIST_SIZE = 160
MAX_LISTS = 4096
DEGREE = 24
BEAM = 64
REPLICAS = 6
STORE_RATIO = 1.15
SHIELD = 0.6
READ_RATIO = 1.25
LEAST_LISTS = 12
#: Stored rows are dealt in so many groups; in more, once a group would hold over TASK_ROWS rows or TASK_CELLS components.
GROUPS = 16
TASK_ROWS = 65_536
TASK_CELLS = 1 << 22
TASK_QUERIES = 16_384
PROBES = 256
RECALL = 0.97


def bisect(points: np.ndarray, size: int) -> np.ndarray:
    """Centroids of lists of at most ``size`` sample points: halves on either side of a two-means axis."""
    open_, done = [np.unique(points, axis=0)], []
    while open_:
        part = open_.pop()
        if len(part) <= size:
            done.append(part.mean(axis=0))
            continue
        centre = part.mean(axis=0)
        a = part[np.argmax(((part - centre) ** 2).sum(axis=1))]
        b = part[np.argmax(((part - a) ** 2).sum(axis=1))]
        half = len(part) // 2
        for _ in range(6):
            order = np.argsort(((part - a) ** 2).sum(axis=1) - ((part - b) ** 2).sum(axis=1), kind="stable")
            a, b = part[order[:half]].mean(axis=0), part[order[half:]].mean(axis=0)
        open_ += [part[order[:half]], part[order[half:]]]
    return np.array(done)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


class CentroidGraph:
    """Each centroid knows its nearest ones and a few far ones; a beam walks from a fixed start towards the query."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        degree = min(DEGREE, n - 1)
        self.links = np.zeros((n, max(1, degree)), np.int64)
        for at in range(0, n, 512):
            d = squared(centroids[at: at + 512], centroids)
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            if degree:
                self.links[at: at + 512] = np.argsort(d, axis=1, kind="stable")[:, :degree]
        if degree > 4:
            self.links[:, -4:] = np.random.Generator(np.random.PCG64(3)).integers(0, n, (n, 4))
        self.start = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of up to ``beam`` near centroids for each row, nearest first."""
        n, b = len(self.centroids), len(x)
        beam = min(beam, n)
        known = np.full((b, n), np.inf)
        rows = np.arange(b)[:, None]
        fresh = np.broadcast_to(self.start, (b, len(self.start)))
        opened = np.zeros((b, n), bool)
        while True:
            known[rows, fresh] = ((x[:, None, :] - self.centroids[fresh]) ** 2).sum(axis=2)
            best = np.argpartition(known, beam - 1, axis=1)[:, :beam] if beam < n else np.broadcast_to(np.arange(n), (b, n))
            value = np.where(opened[rows, best], np.inf, known[rows, best])
            pick = np.argsort(value, axis=1, kind="stable")[:, :4]
            todo = np.take_along_axis(best, pick, axis=1)
            live = np.isfinite(np.take_along_axis(value, pick, axis=1))
            if not live.any():
                break
            todo = np.where(live, todo, todo[:, :1])
            opened[rows, todo] = True
            fresh = self.links[todo].reshape(b, -1)
        order = np.argsort(known[rows, best], axis=1, kind="stable")
        best = np.take_along_axis(best, order, axis=1)
        return best, np.sqrt(known[rows, best])


def stored_lists(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and list: the nearest, and boundary replicas by ratio unless a chosen centroid shields the next."""
    near, d = graph.search(x)
    width = min(near.shape[1], 4 * REPLICAS)
    near, d = near[:, :width], d[:, :width]
    keep = np.zeros(near.shape, bool)
    keep[:, 0] = True
    for k in range(1, width):
        gap = np.sqrt(((graph.centroids[near[:, :k]] - graph.centroids[near[:, k]][:, None, :]) ** 2).sum(axis=2))
        shielded = ((gap < SHIELD * d[:, k: k + 1]) & keep[:, :k]).any(axis=1)
        keep[:, k] = (d[:, k] <= STORE_RATIO * d[:, 0]) & ~shielded & (keep.sum(axis=1) < REPLICAS)
    row, at = np.nonzero(keep)
    return row, near[row, at]


def read_lists(graph: CentroidGraph, x: np.ndarray, least: int = LEAST_LISTS) -> tuple[np.ndarray, np.ndarray]:
    """Row and list: those within the distance ratio, the ``least`` nearest in any case."""
    near, d = graph.search(x, max(BEAM, least))
    keep = d <= READ_RATIO * d[:, :1]
    keep[:, :least] = True
    row, at = np.nonzero(keep)
    return row, near[row, at]


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lists(sent, dim: int, choose):
    def run(batches):
        graph = sent.value
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                row, found = choose(graph, _matrix(part.column(1), dim))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(found), taken.column(0), taken.column(1)], names=["list", "id", "vector"])

    return run


FOUND = "query_id long, vec_id long, score double"


def closest(q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and distance of the k nearest other rows of each query, ties to smaller ids; equal rows count once.

    Products of matrices tell which rows can be among them; their distances are then worked out from the differences.
    """
    if len(np.unique(ids)) < len(ids):
        _, one = np.unique(np.column_stack([ids.astype(np.float64), ids >> 32, y]), axis=0, return_index=True)
        ids, y = ids[one], y[one]
    out: tuple[list, list, list] = ([], [], [])
    slack = 1e-9 * ((y * y).sum(axis=1).max() if len(y) else 0.0)
    step = max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x) if len(y) else 0, step):
        own, part = q_ids[at: at + step], x[at: at + step]
        d = squared(part, y)
        d[own[:, None] == ids[None, :]] = np.inf
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= len(y) else np.full(len(part), np.inf)
        bound = bound + slack + 1e-9 * (part * part).sum(axis=1)
        row, col = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        score = np.sqrt(((y[col] - part[row]) ** 2).sum(axis=1))
        order = np.lexsort((ids[col], score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row, "left")
        kept = np.arange(len(row)) - first < k
        for column, value in zip(out, (own[row[kept]], ids[col[kept]], score[kept]), strict=True):
            column.append(value)
    q, v, score = (np.concatenate(c) if c else np.zeros(0) for c in out)
    return q.astype(np.int64), v.astype(np.int64), score.astype(np.float64)


def _table(columns: tuple[np.ndarray, ...]) -> pa.Table:
    return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def merged(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k nearest of each query among those found in several lists; equal rows count once, ties go to smaller ids."""
    q, v, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((v, score, q))
    q, v, score = q[order], v[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (score[1:] != score[:-1])
    q, v, score = q[new], v[new], score[new]
    kept = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[kept], v[kept], score[kept]


def _nearest(dim: int, k: int):
    """The k nearest rows of each query among the lists of a group that it reads."""

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        order = np.argsort(stored.column("list").to_numpy(), kind="stable")
        held, ids = stored.column("list").to_numpy()[order], stored.column("id").to_numpy()[order]
        y = _matrix(stored.column("vector").combine_chunks(), dim)[order]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, asked.num_rows, 1024):
            part = asked.slice(at, 1024)
            q_ids, x = part.column("id").to_numpy(), _matrix(part.column("vector").combine_chunks(), dim)
            lists = part.column("lists").combine_chunks()
            wanted, row = lists.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            by = np.argsort(wanted, kind="stable")
            names, begin = np.unique(wanted[by], return_index=True)
            near = out[:1]
            for name, own in zip(names, np.split(row[by], begin[1:]), strict=True):
                these = slice(*np.searchsorted(held, [name, name + 1]))
                near.append(closest(q_ids[own], x[own], ids[these], y[these], k))
            out.append(merged(near, k))
        return _table(merged(out, k))

    return run


def _probed(sent, dim: int, k: int):
    """The k nearest rows of each probe among the rows of a batch."""

    def run(batches):
        q_ids, x = sent.value
        for rows in batches:
            ids, y = rows.column(0).to_numpy(), _matrix(rows.column(1), dim)
            if len(ids):
                yield from _table(closest(q_ids, x, ids, y, k)).to_batches()

    return run


def needed_lists(rows: DataFrame, queries: DataFrame, stored: DataFrame, graph: CentroidGraph, dim: int, k: int) -> int:
    """How many of its nearest lists a query has to read to find ``RECALL`` of its true neighbours.

    Measured by brute force on at most ``PROBES`` queries, drawn by hash, over all rows: a neighbour needs as many lists
    as the place of the first that holds it.
    """
    spark = rows.sparkSession
    drawn = queries.dropDuplicates(["id"]).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(PROBES).select("id", "vector").toArrow()
    if not drawn.num_rows:
        return LEAST_LISTS
    q_ids, x = drawn.column("id").to_numpy(), _matrix(drawn.column("vector").combine_chunks(), dim)
    probes = spark.sparkContext.broadcast((q_ids, x))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    true = rows.mapInArrow(_probed(probes, dim, k), FOUND).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    true = true.select("query_id", "vec_id")
    held = stored.join(F.broadcast(true.select(F.col("vec_id").alias("id")).distinct()), "id", "left_semi").select("id", "list").distinct()
    found = true.join(held, F.col("vec_id") == F.col("id")).select("query_id", "vec_id", "list").toPandas()
    if found.empty:
        return LEAST_LISTS
    place = np.empty((len(q_ids), len(graph.centroids)), np.int64)
    order = np.argsort(squared(x, graph.centroids), axis=1, kind="stable")
    place[np.arange(len(q_ids))[:, None], order] = np.arange(1, order.shape[1] + 1)
    at = {q: n for n, q in enumerate(q_ids.tolist())}
    found["place"] = place[[at[q] for q in found["query_id"]], found["list"]]
    first = np.sort(found.groupby(["query_id", "vec_id"])["place"].min().to_numpy())
    return max(LEAST_LISTS, int(first[int(np.ceil(RECALL * len(first))) - 1]))


def placed(sizes: dict[int, int], lists: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First group of each list, and how many hold it: neighbouring lists share a group of ``most`` rows, a longer one has its own."""
    first, parts = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    group, rows = 0, 0
    for name, n in sorted(sizes.items()):
        if rows and rows + n > most:
            group, rows = group + 1, 0
        first[name], parts[name] = group, -(-n // most)
        group, rows = group + parts[name] - 1, rows + n if parts[name] == 1 else most
    return first, parts


def _asked(sent, dim: int, choose: Callable):
    """A row for each query and group, with the lists it reads there."""

    def run(batches):
        graph, first, parts = sent.value
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                row, found = choose(graph, _matrix(part.column(1), dim))
                held = parts[found]
                nth = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
                row, found = np.repeat(row, held), np.repeat(found, held)
                group = first[found] + nth
                order = np.lexsort((found, group, row))
                row, found, group = row[order], found[order], group[order]
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (group[1:] != group[:-1]))) if len(row) else np.zeros(0, np.int64)
                taken = part.take(pa.array(row[new]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(found.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(group[new]), taken.column(0), taken.column(1), lists], names=["group", "id", "vector", "lists"])

    return run


def _every_list(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(x)), len(graph.centroids)), np.tile(np.arange(len(graph.centroids)), len(x))


def _search(asked: DataFrame, dealt: DataFrame, slices: int, dim: int, k: int) -> DataFrame:
    """The k nearest stored rows of each query; beyond ``TASK_QUERIES`` queries, each slice of them meets the groups anew."""
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("id", "vector"), F.lit(slices)).cast("int"))
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))) if slices > 1 else F.lit(0))
    found = asked.groupBy("group", "slice").cogroup(dealt.groupBy("group", "slice")).applyInArrow(_nearest(dim, k), FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of every row whose id is divisible by ``every``.

    Rows with a null id, a vector that is null, zero, of another length than most, or with null or non-finite components
    take no part. A row is no neighbour of its own id; equal rows count once. Ties go to the smaller id. A query that
    finds too few in its lists reads all lists. The index is fitted on ``SAMPLE`` vectors and holds all of them; there
    are ``MAX_LISTS`` lists at most, and long ones are dealt over several groups. Where the vectors have no near
    lists, as noise in many dimensions, the measured number of lists to read rises up to all of them.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where("id is not null and vector is not null")
    usable = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.where(usable).withColumn("dim", F.size("vector"))
    most = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, dim, n = rows.where(F.col("dim") == most.dim).drop("dim"), most.dim, most.n
    chosen = rows.withColumn("h", F.xxhash64("id", "vector")).orderBy("h").limit(SAMPLE).select("vector").toArrow()
    points = _matrix(chosen.column("vector").combine_chunks(), dim)
    lists = max(1, min(MAX_LISTS, n // LIST_SIZE))
    graph = CentroidGraph(bisect(points, max(1, -(-len(points) // lists))))
    sent = spark.sparkContext.broadcast(graph)
    schema = "list long, id long, vector array<double>"
    stored = stage(rows.mapInArrow(_lists(sent, dim, stored_lists), schema))
    queries = rows.where(F.col("id") % every == 0)
    least = min(len(graph.centroids), needed_lists(rows, queries, stored, graph, dim, k))
    sizes = {x.list: x.n for x in stored.groupBy("list").agg(F.count("*").alias("n")).collect()}
    most = max(1, min(-(-sum(sizes.values()) // GROUPS), TASK_ROWS, TASK_CELLS // dim))
    first, parts = placed(sizes, len(graph.centroids), most)
    places = spark.createDataFrame([(name, int(first[name]), int(parts[name])) for name in sizes], "list long, first long, parts long")
    dealt = stored.join(places, "list").select("list", "id", "vector", (F.col("first") + F.pmod(F.xxhash64("id", "vector"), F.col("parts"))).alias("group"))
    sent = spark.sparkContext.broadcast((graph, first, parts))
    schema = "group long, id long, vector array<double>, lists array<long>"
    asked = stage(queries.mapInArrow(_asked(sent, dim, partial(read_lists, least=least)), schema))
    slices = -(-queries.count() // TASK_QUERIES) or 1
    found = stage(_search(asked, dealt, slices, dim, k))
    others = rows.select("id").distinct().count() - 1
    short = queries.select("id", "vector").join(
        found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, others)), F.col("id") == F.col("query_id"), "left_anti")
    short = stage(short)
    if others > 0 and not short.isEmpty():
        again = short.mapInArrow(_asked(sent, dim, _every_list), schema)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(_search(again, dealt, slices, dim, k))
    return found
