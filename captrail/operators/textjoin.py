"""Exact candidate search for similar texts: an inverted index over numbered characters.

The matcher's ratio is at most 2 * shared / (length + length), where shared counts common characters with repeats. So a
text is taken as a set of numbered characters, ("e", 1), ("e", 2), ..., and partners at a threshold share enough of them.
Ordered from rare to frequent, a text and each of its partners then share one of the first few: only those are indexed.
Rows that meet at a character are judged by their whole counts at once, then by their longest common subsequence; a pair
is reported at the rarest character that it shares, so once. Characters of very many texts are dealt in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from captrail.operators.folds import cut, spread

#: Characters are counted in so many classes, and told apart up to so many repeats; more repeats are rarer still.
CLASSES, REPEATS = 1024, 64
#: Texts of one side that meet at a character in one task.
BLOCK = 2048
#: Keys of so many texts a side need no index; their texts meet at the token ALL.
WHOLE, ALL = 1024, -(2**40)
CELLS = 1 << 22
SLACK = 1e-9


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All characters one after the other, as numbers of the classes that occur; those classes, and the texts' lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES
    used = np.flatnonzero(np.bincount(codes, minlength=CLASSES))
    number = np.zeros(CLASSES, np.int64)
    number[used] = np.arange(len(used))
    return number[codes], used, lengths


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts (texts x classes that occur), the classes, and the lengths."""
    codes, used, lengths = letters(texts)
    at = np.repeat(np.arange(len(texts)), lengths) * max(1, len(used)) + codes
    return np.bincount(at, minlength=len(texts) * len(used)).reshape(len(texts), len(used)).astype(np.int32), used, lengths


class Subsequences:
    """Longest common subsequences of many pairs of short texts at once, a bit per character of the first text.

    The matcher's blocks lie in order, so they are one; it bounds the ratio more tightly than the shared characters do.
    """

    SHORT = 63

    def __init__(self, texts: list[str]):
        codes, used, self.lengths = letters(texts)
        ends = np.cumsum(self.lengths)
        rows = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(len(codes)) - np.repeat(ends - self.lengths, self.lengths)
        near = place < self.SHORT
        self.codes = np.full((len(texts), self.SHORT), len(used), np.int64)
        self.codes[rows[near], place[near]] = codes[near]
        self.masks = np.zeros((len(texts), len(used) + 1), np.uint64)
        for p in range(min(self.SHORT, int(self.lengths.max(initial=0)))):
            has = np.flatnonzero(self.lengths > p)
            self.masks[has, self.codes[has, p]] |= np.uint64(1 << p)

    def reach(self, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs can reach the threshold; pairs with a longer text count as such."""
        out = np.ones(len(left), bool)
        short = np.flatnonzero((self.lengths[left] <= self.SHORT) & (self.lengths[right] <= self.SHORT))
        for at in range(0, len(short), CELLS // 8):
            part = short[at: at + CELLS // 8]
            i, j = left[part], right[part]
            open_ = np.full(len(part), np.iinfo(np.uint64).max)
            for p in range(int(self.lengths[j].max(initial=0))):
                taken = open_ & self.masks[i, self.codes[j, p]]
                open_ = (open_ + taken) | (open_ - taken)
            own = (np.uint64(1) << self.lengths[i].astype(np.uint64)) - np.uint64(1)
            out[part] = 2.0 * np.bitwise_count(~open_ & own) / (self.lengths[i] + self.lengths[j]) >= threshold
        return out


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of bounded size."""
    held, size = [], 0
    for text in column.to_pylist():
        if held and size + len(text) > CELLS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts a class occurs k times or more, for all classes and k up to ``REPEATS``: a table of fixed size."""

    def run(batches):
        total = np.zeros((CLASSES, REPEATS), np.int64)
        for batch in batches:
            for part in _slices(batch.column(0)):
                n, used, _ = bags(part)
                for k in range(min(REPEATS, int(n.max(initial=0)))):
                    total[used, k] += (n > k).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "n"])

    out = np.zeros(CLASSES * REPEATS, np.int64)
    for row in texts.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out.reshape(CLASSES, REPEATS)


class Rarity:
    """An order of numbered characters in which a later repeat always comes before an earlier one."""

    def __init__(self, counts: np.ndarray):
        classes, repeats = np.divmod(np.arange(CLASSES * REPEATS), REPEATS)
        order = np.lexsort((classes, -repeats, counts.ravel()))
        self.rank = np.empty(CLASSES * REPEATS, np.int64)
        self.rank[order] = np.arange(len(order))
        self.rank = self.rank.reshape(CLASSES, REPEATS)

    def of(self, classes: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Ranks of repeats counted from 0; those beyond the table are negative, the higher the rarer."""
        beyond = -(repeats.astype(np.int64) * CLASSES + (CLASSES - classes))
        return np.where(repeats < REPEATS, self.rank[classes, np.minimum(repeats, REPEATS - 1)], beyond)

    def first_repeat_before(self, classes: np.ndarray, rank: int) -> np.ndarray:
        """For each class the least count that holds a numbered character of a smaller rank than ``rank``."""
        if rank >= 0:
            earlier = self.rank[classes] < rank
            return np.where(earlier.any(axis=1), earlier.argmax(axis=1), REPEATS) + 1
        repeat, own = divmod(-rank, CLASSES)  # -rank = repeat * CLASSES + (CLASSES - class), class in 0 .. CLASSES - 1
        repeat, own = (repeat, CLASSES - own) if own else (repeat - 1, 0)
        return np.where(classes < own, repeat, repeat + 1) + 1


def least_shared(length: int, threshold: float) -> int:
    """What a partner of any length has to share with a text of ``length``."""
    return max(1, int(np.ceil(length * threshold / (2.0 - threshold) - SLACK)))


def _postings(rarity, threshold: float, side: int):
    def run(batches):
        for batch in batches:
            start = 0
            for part in _slices(batch.column("text")):
                rows, tokens = [], []
                n, used, lengths = bags(part)
                for k, length in enumerate(lengths.tolist()):
                    has = np.flatnonzero(n[k])
                    classes = np.repeat(used[has], n[k][has])
                    repeats = np.arange(len(classes)) - np.repeat(np.cumsum(n[k][has]) - n[k][has], n[k][has])
                    ranks = rarity.value.of(classes, repeats)
                    first = length - least_shared(length, threshold) + 1
                    tokens.append(np.partition(ranks, first - 1)[:first] if first < length else ranks)
                    rows.append(np.full(len(tokens[-1]), start + k))
                start += len(part)
                taken = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("key"), pa.array(np.concatenate(tokens), pa.int64()), taken.column("text"), pa.array(np.full(taken.num_rows, side), pa.int32())],
                    names=["key", "token", "text", "side"])

    return run


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared characters of all pairs of texts, by their counts (classes x texts), a class at a time."""
    total = np.zeros((left.shape[1], right.shape[1]), left.dtype)
    for k in np.flatnonzero(left.any(axis=1) & right.any(axis=1)):
        total += np.minimum(left[k][:, None], right[k])
    return total


def _holds(a: str, b: str) -> bool:
    """One of the texts has two words or more and lies in the other."""
    short, long = sorted((a, b), key=len)
    return " " in short and short in long


def _meet(rarity, threshold: float, keys: list[str], contained: bool):
    def pairs(batch: pa.Table, cuts: np.ndarray):
        texts, sides, tokens = batch.column("text").to_pylist(), batch.column("side").to_numpy(), batch.column("token").to_numpy()
        n, used, lengths = bags(texts)
        counts = np.ascontiguousarray(n.T, np.uint16 if lengths.max(initial=0) < 1 << 16 else np.int64)
        left, right, inside, found = [], [], [], 0
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            middle = low + int(np.searchsorted(sides[low:high], 1))
            if low == middle or middle == high:
                continue
            before = None if tokens[low] == ALL else rarity.value.first_repeat_before(used, int(tokens[low]))
            step = max(1, CELLS // max(1, (high - middle) * len(used)))
            for at in range(low, middle, step):
                end = min(middle, at + step)
                total = _shared(counts[:, at:end], counts[:, middle:high])
                near = 2.0 * total / (lengths[at:end, None] + lengths[None, middle:high]) >= threshold
                if contained and before is None:
                    within = total == np.minimum(lengths[at:end, None], lengths[None, middle:high])
                    near |= within
                i, j = np.nonzero(near)
                if before is not None:
                    first = ~(np.minimum(n[i + at], n[j + middle]) >= before).any(axis=1)
                    i, j = i[first], j[first]
                elif contained:
                    inside.append(np.flatnonzero(within[i, j]) + found)
                found += len(i)
                left.append(i + at)
                right.append(j + middle)
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        able = Subsequences(texts).reach(left, right, threshold)
        for k in np.concatenate(inside) if inside else ():
            able[k] |= _holds(texts[left[k]], texts[right[k]])
        left, right = left[able], right[able]
        a, b = batch.take(pa.array(left)), batch.take(pa.array(right))
        return pa.table({"key": a.column("key"), "left_text": a.column("text"), "right_text": b.column("text")})

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            opens = np.arange(rows.num_rows) == 0
            for name in keys:
                values = rows.column(name).to_numpy()
                opens[1:] |= values[1:] != values[:-1]
            cuts = np.flatnonzero(opens) if len(opens) else np.zeros(1, np.int64)
            held = rows.slice(int(cuts[-1]))
            if len(cuts) > 1:
                yield from pairs(rows.slice(0, int(cuts[-1])).combine_chunks(), cuts).to_batches()
        if held is not None and held.num_rows:
            yield from pairs(held.combine_chunks(), np.array([0, held.num_rows])).to_batches()

    return run


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries with their parts ``lp`` and ``rp``: where too many meet, blocks of one side meet blocks of the other."""
    count = lambda k: F.count_if(F.col("side") == k)
    hubs = entries.groupBy("key", "token").agg(count(0).alias("_l"), count(1).alias("_r")).where(f"_l > {BLOCK} or _r > {BLOCK}")
    entries = entries.join(hubs.where("_l > 0 and _r > 0"), ["key", "token"], "left")
    parts = {k: F.ceil(F.coalesce(F.col(f"_{k}"), F.lit(1)) / BLOCK).cast("int") for k in "lr"}
    at = {k: F.pmod(F.xxhash64("text"), parts[k]).cast("int") for k in "lr"}
    every = {k: F.sequence(F.lit(0), parts[k] - 1) for k in "lr"}
    own = F.col("side") == 0
    entries = entries.withColumn("lp", F.explode(F.when(own, F.array(at["l"])).otherwise(every["l"])))
    return entries.withColumn("rp", F.explode(F.when(own, every["r"]).otherwise(F.array(at["r"])))).drop("_l", "_r")


def candidate_pairs(left: DataFrame, right: DataFrame, threshold: float, contained: bool = False) -> DataFrame:
    """``key, left_text, right_text``: all pairs of distinct texts of one key that share enough characters for ``threshold``.

    Both sides: (key, text). Empty and null texts have no partners. Threshold: above 0, up to 1. Keys of ``WHOLE`` texts a
    side at most are compared as they are, in one pass of arrays; those of more texts go through the index. ``contained``
    adds the pairs of which one has two words or more and lies in the other, whatever they share. No pair comes twice.
    """
    spark = left.sparkSession
    kind = left.schema["key"].dataType
    sides = [x.select("key", "text", F.lit(k).alias("side")).where("key is not null and text <> ''") for k, x in enumerate((left, right))]
    texts = cut(sides[0].unionByName(sides[1]).distinct())
    count = lambda k: F.count_if(F.col("side") == k)
    large = texts.groupBy("key").agg(count(0).alias("_l"), count(1).alias("_r")).where(f"_l > {WHOLE} or _r > {WHOLE}")
    large = cut(large.where("_l > 0 and _r > 0").select("key"))
    schema = T.StructType([T.StructField("key", kind), T.StructField("token", T.LongType()), T.StructField("text", T.StringType()), T.StructField("side", T.IntegerType())])
    keys = ["key", "token", "lp", "rp"]
    rarity = None
    entries = texts.select("key", F.lit(ALL).alias("token"), "text", "side", F.lit(0).alias("lp"), F.lit(0).alias("rp"))
    if not large.isEmpty():
        many = texts.join(large, "key", "left_semi")
        rarity = spark.sparkContext.broadcast(Rarity(frequencies(many)))
        indexed = [spread(many.where(F.col("side") == k), "key", "text").mapInArrow(_postings(rarity, threshold, k), schema) for k in (0, 1)]
        entries = entries.join(large, "key", "left_anti").unionByName(_dealt(cut(indexed[0].unionByName(indexed[1]))))
    out = T.StructType([T.StructField("key", kind), T.StructField("left_text", T.StringType()), T.StructField("right_text", T.StringType())])
    placed = spread(entries, *keys).sortWithinPartitions(*keys, "side")
    pairs = placed.mapInArrow(_meet(rarity, threshold, keys, contained), out)
    if rarity is None or not contained:
        return pairs
    # The index reports those that reach the threshold.
    small, great = (many.where(F.col("side") == k).select("key", "text") for k in (0, 1))
    names = ["key", "left_text", "right_text"]
    held = contained_pairs(small, great).union(contained_pairs(great, small).select("key", "right_text", "left_text").toDF(*names))
    a, b = F.length("left_text"), F.length("right_text")
    return pairs.unionByName(held.where(F.least(a, b) * F.lit(2.0) / (a + b) < threshold).distinct())


def contained_pairs(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``key, left_text, right_text``: texts of ``inner`` with two words or more, and those of ``outer`` that contain them.

    Both sides: (key, text), words parted by single spaces. A text's rarest crossing between two words (last letter, space,
    first letter) leads to its containers, which hold it among their own. Crossings of very many containers are dealt in
    blocks of them.
    """
    words = F.split("text", " ")
    crossing = lambda i: F.concat(F.right(F.get(words, i - 1), F.lit(1)), F.lit(" "), F.left(F.get(words, i), F.lit(1)))
    crossings = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), crossing)))
    sides = [x.select("key", "text").where("text like '% %'").distinct().withColumn("crossing", crossings) for x in (inner, outer)]
    held = cut(sides[1])
    common = held.groupBy("key", "crossing").agg(F.count("*").alias("_n"))
    rarest = sides[0].join(common, ["key", "crossing"]).groupBy("key", "text").agg(F.min_by("crossing", F.struct("_n", "crossing")).alias("crossing"))
    hubs = cut(common.where(F.col("_n") > BLOCK))
    parts = F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / BLOCK).cast("int")
    dealt = lambda df, name, part: df.join(hubs, ["key", "crossing"], "left").select("key", "crossing", F.col("text").alias(name), part.alias("part"))
    left = dealt(rarest, "left_text", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = dealt(held, "right_text", F.pmod(F.xxhash64("text"), parts).cast("int"))
    return left.join(right, ["key", "crossing", "part"]).where(F.contains("right_text", "left_text")).select("key", "left_text", "right_text")
