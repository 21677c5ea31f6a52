"""Fingerprints by one-permutation MinHash, in DataFrame functions alone.

Every shingle is hashed once; the top bits of the hash name its bin, and a bin keeps its least hash. An empty bin borrows
from a full one that a random order of its own names first, so that equal sets borrow alike and every bin stays a fair
sample (optimal densification). The low bits of each bin are packed; agreement by chance is taken out of the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
WIDTH = 5
TRIES = 6
CHUNK_ROWS = 1500


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of ``width`` words in lower case; fewer words make one shingle, none make none."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), shingles)[0]


def with_bins(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Add ``name``: an array of ``BINS`` low-order values, or an empty array for a text without words."""
    hashes, least, table = f"__{name}_hashes", f"__{name}_least", f"__{name}_table"
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS)
    df = df.withColumn(hashes, F.sort_array(shingle_hashes(text)))
    first = F.filter(F.col(hashes), lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(hashes), i - 1))))
    df = df.withColumn(least, first).drop(hashes)
    df = df.withColumn(table, F.map_from_arrays(F.transform(least, lambda x: bin_of(x)), F.transform(least, lambda x: x.bitwiseAND((1 << LOW_BITS) - 1))))

    def value(j: Column) -> Column:
        tries = [F.try_element_at(F.col(table), F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS))) for t in range(TRIES)]
        nearest = F.array_min(F.transform(F.map_entries(F.col(table)), lambda e: F.struct(F.xxhash64(j, e["key"]).alias("h"), e["value"].alias("v"))))["v"]
        return F.coalesce(F.try_element_at(F.col(table), j), *tries, nearest)

    bins = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), value)
    return df.withColumn(name, F.when(F.size(least) > 0, bins).otherwise(F.array().cast("array<bigint>"))).drop(least, table)


def packed(bins: Column) -> Column:
    """Low-order bits of all bins, in hexadecimal; empty for an empty set."""
    return F.lower(F.array_join(F.transform(bins, lambda v: F.lpad(F.hex(v), LOW_BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sets by their bins: agreement beyond chance; two empty sets are alike."""
    chance = 2.0**-LOW_BITS
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(BINS)
    corrected = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    both, either = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(both, 1.0).when(either, 0.0).otherwise(corrected)


def with_next(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``next``, a struct of the columns of the next row by descending doc_id; after the last comes the first.

    Rows with equal ids follow each other by a hash of the text, rows without id come last. Ids are cut into chunks of
    about ``CHUNK_ROWS``; a chunk's last row gets the first row of the next chunk.
    """
    span = df.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low = span.low or 0
    width = max(1, -(-((span.high or 0) - low + 1) // max(1, -(-span.n // CHUNK_ROWS))))
    spot = F.struct("doc_id", F.xxhash64("text").alias("h"))
    chunk = F.coalesce(F.floor((F.col("doc_id").cast("decimal(20,0)") - low) / width).cast("long"), F.lit(-1))
    df = df.withColumn("__chunk", chunk)
    carried = F.struct(*columns)
    follow = Window.partitionBy("__chunk").orderBy(F.desc_nulls_last("doc_id"), F.desc("__h"))
    placed = df.withColumn("__h", F.xxhash64("text")).withColumn("__next", F.lead(carried).over(follow))
    firsts = df.groupBy("__chunk").agg(F.max_by(carried, spot).alias("__first"))
    down = Window.orderBy(F.desc("__chunk"))
    ring = df.select("__chunk").distinct().withColumn("__to", F.coalesce(F.lead("__chunk").over(down), F.max("__chunk").over(Window.partitionBy(F.lit(0)))))
    after = ring.join(firsts.withColumnRenamed("__chunk", "__to"), "__to").select("__chunk", "__first")
    return placed.join(after, "__chunk").withColumn("next", F.coalesce("__next", "__first")).drop("__chunk", "__h", "__next", "__first")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike it is to that and to the next document.

    The edited text has its last floor(n/2) code points replaced by as many of the next document's first ones. A null
    text is an empty one, with an empty fingerprint; it is like other empty ones (1) and unlike all else (0). Equal texts
    have equal fingerprints. Repeated rows give repeated rows; a null id stays null and comes last; a single document
    follows itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = with_next(with_bins(rows, F.col("text"), "bins"), "text", "bins")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = own.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left(F.col("text"), n - half), F.left(F.col("next.text"), half)))
    both = with_bins(edited.withColumn("next_bins", F.col("next.bins")).drop("next", "text"), F.col("edited"), "edited_bins")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"))
