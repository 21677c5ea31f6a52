"""Lines that many documents share, counted in levelled sorted runs of line hashes, in DataFrame functions alone.

A run is a table of line hashes with the number of documents that hold them, bucketed and sorted by the hash, so that runs
meet in merge joins without a shuffle. Each batch of documents leaves out, by a merge anti-join, the hashes that the runs
have already settled as common, and adds a run of its own counts. When a level has ``FANOUT`` runs, they are merged into
one of the next level. A manifest, written last, says which runs are alive; a broken batch leaves the one before it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_folder, stage

BATCHES = 4
FANOUT = 2
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]
RUN = "h1 long, h2 long, docs long"
MANIFEST = "place int, level int, name string, buckets int"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does so where all is ASCII."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(lines: Column, least_chars: int) -> Column:
    """Two 64-bit hashes of each line's key; null for keys shorter than ``least_chars``."""
    keys = F.transform(lines, lambda x: F.trim(x, F.lit(SPACES)))

    def hashed(k: Column) -> Column:
        return F.when(F.char_length(k) >= least_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))

    return F.transform(keys, hashed)


class LineRuns:
    """Counts of line hashes over batches of documents, in levelled sorted runs under ``folder``.

    A hash in ``least`` documents is settled: later batches need not count it again. The folder's manifest holds the level
    and name of each live run, so that another session can go on with the next batch.
    """

    def __init__(self, spark: SparkSession, folder: str, least: int, buckets: int | None = None):
        self.spark, self.folder, self.least = spark, folder, least
        self.version, self.runs = 0, []
        self.buckets = buckets or partitions(spark)
        try:
            known = spark.read.schema(f"{MANIFEST}, version int").json(f"{folder}/manifest").orderBy("version", "place").collect()
        except AnalysisException:  # no folder yet: no batch came before
            known = []
        if known:
            self.version, self.buckets = known[-1].version, known[-1].buckets
            self.runs = [(r.level, r.name) for r in known if r.version == self.version]

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        rows = [(k, level, name, self.buckets) for k, (level, name) in enumerate(runs)]
        self.version += 1
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(f"{self.folder}/manifest/version={self.version}")
        self.runs = runs

    def _write(self, run: DataFrame) -> str:
        """Bucketed as the shuffle before it deals the hashes, so that a task writes whole buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _read(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs' hashes with the sums of their counts: a full merge join of sorted runs."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.hint("merge").join(b.withColumnRenamed("docs", "more"), HASH, "full")
            return both.select(*HASH, (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))

        return reduce(merge, [self._read(n) for n in names]) if names else self.spark.createDataFrame([], RUN)

    def settled(self) -> DataFrame:
        """``h1, h2`` of the hashes that ``least`` documents hold."""
        return self._merged([name for _, name in self.runs]).where(F.col("docs") >= self.least).select(*HASH)

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """What of ``h1, h2, docs`` no single run has settled: one merge anti-join per run."""
        for _, name in self.runs:
            counts = counts.join(self._read(name).where(F.col("docs") >= self.least).select(*HASH).hint("merge"), HASH, "left_anti")
        return counts

    def add(self, held: DataFrame) -> None:
        """Add one batch: ``h1, h2``, a row for each document and hash that it holds."""
        counts = held.groupBy(*HASH).agg(F.count("*").alias("docs"))
        runs = [*self.runs, (0, self._write(self.unsettled(counts)))]
        level = 0
        while len(same := [name for at, name in runs if at == level]) >= FANOUT:
            runs = [r for r in runs if r[0] != level] + [(level + 1, self._write(self._merged(same)))]
            level += 1
        self._commit(runs)


def drop_common_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the lines whose key occurs in ``least_docs`` documents: ``doc_id, kept, n_lines, n_dropped``.

    A text is split at newlines; a key is the line without spaces at its ends, A-Z in lower case. Keys shorter than
    ``least_chars`` are never dropped. Every row is a document, so repeated rows count as often as they occur and give
    repeated rows; null ids too. A null or empty text is one empty line. Lines are told apart by 128 bits of hashes. A text
    of any length is one row, of any number of lines. An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("t", F.xxhash64("text"))
    # What a document loses depends on its text alone, so id and hash of the text name a row well enough.
    lines = rows.select("doc_id", "t", line_hashes(F.split(lower_ascii(F.col("text")), "\n"), least_chars).alias("hashes"))
    held = stage(lines.withColumn("batch", F.pmod(F.xxhash64("doc_id", "t"), F.lit(batches)).cast("int")), "batch")
    runs = LineRuns(spark, f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}", least_docs)
    for batch in range(batches):
        distinct = F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull())))
        runs.add(held.where(F.col("batch") == batch).select(distinct.alias("h")).select("h.*"))
    common = stage(runs.settled())
    found = held.select("doc_id", "t", F.posexplode("hashes").alias("at", "h")).where("h is not null")
    marked = found.select("doc_id", "t", "at", "h.h1", "h.h2").join(common, HASH)
    drops = marked.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("at")).alias("drops"))
    same = (F.col("r.t") == F.col("d.t")) & F.col("r.doc_id").eqNullSafe(F.col("d.doc_id"))
    both = rows.alias("r").join(drops.alias("d").hint("merge"), same, "left")
    none = F.array().cast("array<int>")
    both = both.select("r.doc_id", F.split("r.text", "\n").alias("lines"), F.coalesce("d.drops", none).alias("drops"))
    ends = F.concat(F.array(F.lit(-1)), F.col("drops"), F.array(F.size("lines")))
    # The lines between one dropped line and the next.
    parts = F.transform(F.sequence(F.lit(0), F.size("drops")), lambda k: F.slice("lines", F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1))
    return both.select("doc_id", F.array_join(F.flatten(parts), "\n").alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.size("drops").cast("long").alias("n_dropped"))
