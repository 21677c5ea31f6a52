"""Repeated byte strings by blockwise suffix sorting with a difference cover.

Every string of ``LENGTH`` bytes has an anchor, the least hash among its inner grams; equal strings have equal anchors at
equal places. So suffixes are dealt into buckets by anchor gram and place, and only buckets that several anchors share
carry text. A task sorts one block of buckets at a time: by the first ``PERIOD`` bytes, then, for the long ties, by the
ranks of cover samples. The cover has for any two suffixes a common shift below ``PERIOD`` at which both are samples; the
sample ranks reach over ``LENGTH - PERIOD`` bytes and the last ``PERIOD`` bytes are compared directly. Memory is bounded
by the block, never by the corpus. In buckets of very many anchors, those with equal surroundings count as one, and what
is left is dealt by whole strings instead, which two 64-bit hashes tell apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .shingles import mix

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1
PERIOD = 8
COVER = (0, 1, 2, 4)
PIECE = 1 << 18
BLOCK = 3 << 18
AT_ONCE = 300_000
BIG = 12_000
_LETTERS, _OTHERS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_STEP = np.uint64(0xD1342543DE82EF95)
_SHIFT = np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
                    for j in range(PERIOD)] for i in range(PERIOD)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _STEP), np.full(n, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(PIECE + (1 << 17))


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every position that has as many after it."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[data] * _UP[: len(data)], dtype=np.uint64)))
    return mix((sums[width:] - sums[:-width]) * _DOWN[: len(data) - width + 1])


def context_hashes(data: np.ndarray, letters: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Hashes of the ``width`` bytes from each start, which may differ in length."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(letters[data] * _UP[: len(data)], dtype=np.uint64)))
    return mix((sums[start + width] - sums[start]) * _DOWN[start])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor position of the string at every start, and the gram hashes."""
    hashes = string_hashes(data, GRAM)
    n = len(hashes)
    packed = ((hashes >> np.uint64(20)) << np.uint64(20)) | np.arange(n, dtype=np.uint64)
    full = -(-n // SPAN) * SPAN
    padded = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    rows = padded.reshape(-1, SPAN)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - SPAN + 1
    least = np.minimum(behind[:starts], ahead[SPAN - 1: SPAN - 1 + starts])
    return (least & np.uint64((1 << 20) - 1)).astype(np.int64), hashes


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Bytes in pieces: owner and offset of each text in it, where each begins, and the data; long texts overlap."""
    held, owner, offset, begin, size = [], [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[at: at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and size + len(part) > PIECE + LENGTH:
                yield owner, offset, np.array(begin), np.frombuffer(b"".join(held), np.uint8)
                held, owner, offset, begin, size = [], [], [], [], 0
            held.append(part)
            owner.append(k)
            offset.append(at)
            begin.append(size)
            size += len(part)
    if held:
        yield owner, offset, np.array(begin), np.frombuffer(b"".join(held), np.uint8)


ANCHORS = "t long, bucket long, start long, n int, place int, one long, two long"


def _find(batches):
    for rows in batches:
        t = rows.column(0).to_numpy()
        texts = [x.as_py() for x in rows.column(1)]
        for owner, offset, begin, data in _pieces(texts):
            at, hashes = anchors(data)
            text = np.searchsorted(begin, np.arange(len(at)), "right") - 1
            ends = np.append(begin[1:], len(data))
            good = np.arange(len(at)) + LENGTH <= ends[text]
            new = np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
            first = np.flatnonzero(good & (new | ~np.concatenate(([False], good[:-1]))))
            run = np.searchsorted(first, np.flatnonzero(good), "right") - 1
            n = np.bincount(run, minlength=len(first))
            who = text[first]
            key = np.array(owner)[who]
            one, two = (context_hashes(data, letters, first, n + LENGTH - 1).view(np.int64) for letters in (_LETTERS, _OTHERS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[key]), pa.array(hashes[at[first]].view(np.int64)),
                 pa.array(first - begin[who] + np.array(offset)[who]), pa.array(n.astype(np.int32)), pa.array((at[first] - first).astype(np.int32)),
                 pa.array(one), pa.array(two)],
                names=["t", "bucket", "start", "n", "place", "one", "two"])


def _several(batches):
    """Anchors whose gram occurs at two places or more. Rows come sorted by bucket, then text and start."""
    open_, held = None, None
    for rows in batches:
        table = pa.Table.from_batches([rows])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        bucket = table.column("bucket").to_numpy()
        spots = [table.column(c).to_numpy() for c in ("t", "start")]
        new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        other = new | np.concatenate(([True], np.any([x[1:] != x[:-1] for x in spots], axis=0)))
        run = np.cumsum(new) - 1
        many = np.bincount(run, weights=other) > 1
        many[0] |= bucket[0] == open_
        last = run == run[-1]
        yield from table.filter(pa.array(other & many[run])).to_batches()
        if many[-1]:
            open_, held = bucket[-1], None
        else:
            open_, held = None, table.filter(pa.array(other & last))


CONTEXTS = "bucket long, t long, start long, place int, context binary"


def _cut(batches):
    """Contexts of shared anchors: the bytes of all strings that have the anchor.

    The strings of crowded buckets go one by one instead, into a bucket by a hash of the whole string, with a second hash
    in place of the context.
    """
    for rows in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for t, text, size, marks in zip(*(c.to_pylist() for c in rows.columns[:3]), rows.column(3), strict=True):
            text = unpack(text, size)
            for bucket, start, n, place, crowded in {(m["bucket"], m["start"], m["n"], m["place"], m["crowded"]) for m in marks.as_py()}:
                context = text[start: start + n + LENGTH - 1]
                if crowded:
                    data = np.frombuffer(context, np.uint8)
                    one = string_hashes(data, LENGTH).view(np.int64).tolist()
                    two = string_hashes(data[::-1], LENGTH)[::-1]
                    strings = [(h, t, start + k, -1, two[k].tobytes()) for k, h in enumerate(one)]
                else:
                    strings = [(bucket, t, start, place, context)]
                for row in strings:
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                         names=["bucket", "t", "start", "place", "context"])


def _dense(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.concatenate(([0], keys[order][1:] != keys[order][:-1])))
    return ranks


def sample_ranks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the cover samples by their first LENGTH - PERIOD bytes, and where each sample's rank is.

    ``words`` has the eight bytes at every position. Doubling steps by multiples of the period go from sample to sample.
    """
    n = len(words)
    positions = np.flatnonzero(np.resize(np.isin(np.arange(PERIOD), COVER), n))
    where = np.zeros(n + LENGTH, np.int32)
    where[positions] = np.arange(len(positions), dtype=np.int32)
    ranks, reach = _dense(words[positions]), PERIOD
    while reach < LENGTH - PERIOD:
        step = min(reach, LENGTH - PERIOD - reach)
        ahead = positions + step
        later = np.where(ahead < n, ranks[where[np.minimum(ahead, n - 1)]], 0)
        ranks = _dense(ranks * (len(ranks) + 1) + later)
        reach += step
    return ranks, where


def repeated(text: np.ndarray, starts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Which starts have, elsewhere in the same bucket, a string equal over LENGTH bytes. ``text`` ends in padding."""
    words = np.zeros(len(text) - PERIOD + 1, np.uint64)
    for k in range(PERIOD):
        words = (words << np.uint64(8)) | text[k: len(text) - PERIOD + 1 + k]
    found = np.zeros(len(starts), bool)
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1))
    samples, at = None, 0
    while at < len(order):
        some = order[at: edges[max(np.searchsorted(edges, at + AT_ONCE, "right") - 1, np.searchsorted(edges, at, "right"))]]
        at += len(some)
        some = some[np.argsort(words[starts[some]], kind="stable")]
        some = some[np.argsort(buckets[some], kind="stable")]
        head, bucket = words[starts[some]], buckets[some]
        tied, group = _shared(some, np.cumsum(np.concatenate(([0], (bucket[1:] != bucket[:-1]) | (head[1:] != head[:-1])))))
        if len(tied):
            samples = samples or sample_ranks(words)
            _resolve(found, starts, tied, group, words, *samples)
    return found


def _resolve(found, starts, order, group, words, ranks, where) -> None:
    """Split groups that tie over the first bytes until the equal ones are told; a pivot each parts less, equal, greater."""
    while len(order):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(first, append=len(group))
        i, j = starts[order], np.repeat(starts[order[first + size // 2]], size)
        shift = _SHIFT[i % PERIOD, j % PERIOD]
        a, b = ranks[where[i + shift]], ranks[where[j + shift]]
        c, d = words[i + LENGTH - PERIOD], words[j + LENGTH - PERIOD]
        side = np.where(a != b, np.where(a < b, 0, 2), np.where(c == d, 1, np.where(c < d, 0, 2)))
        equal = side == 1
        many = np.bincount(group, weights=equal, minlength=group[-1] + 1) > 1
        found[order[equal & many[group]]] = True
        order, group = order[~equal], group[~equal] * 3 + side[~equal]
        again = np.argsort(group, kind="stable")
        order, group = _shared(order[again], group[again])


def _shared(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of sorted groups of two or more, with groups numbered from 0."""
    if not len(group):
        return order, group
    new = np.concatenate(([True], group[1:] != group[:-1]))
    number = np.cumsum(new) - 1
    keep = np.bincount(number)[number] > 1
    return order[keep], np.cumsum(new[keep]) - 1 if keep.any() else number[keep]


SPANS = "t long, first long, last long"


def _sort(batches):
    """Runs of repeated starts. Rows come sorted by bucket, context, place, text and start."""
    held: list[tuple] = []
    size, now = 0, None

    def solve(rows):
        buckets, owners, starts, places, contexts = zip(*rows, strict=True)
        text = np.frombuffer(b"".join([*contexts, bytes(2 * LENGTH)]), np.uint8)
        lengths = np.array([len(c) for c in contexts])
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        n = lengths - LENGTH + 1
        row = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        bucket = np.cumsum([0, *(a != b for a, b in zip(buckets[1:], buckets, strict=False))])
        hit = repeated(text, begin[row] + inner, bucket[row] * (SPAN + 1) + np.array(places)[row] - inner)
        edge = np.concatenate(([True], (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])))
        opens = np.flatnonzero(edge & hit)
        closes = np.flatnonzero(np.append(edge[1:], True) & hit)
        start = np.array(starts)[row[opens]]
        return spans(np.array(owners, np.int64)[row[opens]], start + inner[opens], start + inner[closes])

    def spans(t, first, last):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (t, first, last)], names=["t", "first", "last"])

    single = None  # the last string that came one by one
    for batch in batches:
        same: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bucket, t, start, place, context = row
            before = single if place < 0 else held[-1] if held else None
            if before and (before[0], before[3], before[4]) == (bucket, place, context):
                if before[1:3] == (t, start):
                    continue
                if now != before:
                    same.append(before)
                    now = before
                same.append(row)
                continue
            if place < 0:
                single = row
                continue
            if size >= BLOCK and before[0] != bucket:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(context)
        if same:
            yield spans([r[1] for r in same], [r[2] for r in same], [r[2] + max(0, len(r[4]) - LENGTH) for r in same])
    if held:
        yield solve(held)


def _pack(batches):
    """Texts compressed one by one, as they move between machines twice."""
    for rows in batches:
        texts = [t.as_py() for t in rows.column(2)]
        yield pa.RecordBatch.from_arrays(
            [*rows.columns[:2], pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64())],
            names=["doc_id", "t", "packed", "size"])


def unpack(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, size, "zstd", asbytes=True)


KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(batches):
    for rows in batches:
        n_bytes, n_removed, n_spans, digest, texts = [], [], [], [], []
        for text, size, copies, spans in zip(*(c.to_pylist() for c in rows.columns[1:4]), rows.column(4), strict=True):
            text = unpack(text, size)
            gone = [(0, len(text))] if copies > 1 and len(text) >= LENGTH else []
            if not gone and spans.is_valid:
                for first, last in sorted((s["first"], s["last"]) for s in spans.as_py()):
                    if gone and first <= gone[-1][1]:
                        gone[-1] = (gone[-1][0], max(gone[-1][1], last + LENGTH))
                    else:
                        gone.append((first, last + LENGTH))
            at, kept = 0, []
            for a, b in gone:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            texts.append(kept)
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept))
            n_spans.append(len(gone))
            digest.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(texts, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
             pa.array(digest, pa.string())], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bytes that are left of every text, with counts and digest, after every repeated 200-byte string is removed.

    A null text is an empty one; texts shorter than 200 bytes stay whole. Rows with equal texts are removed whole,
    repeated rows among them. A null id stays null; further columns are not read. What is left may end inside a
    character, so it is binary. Texts are told apart by two 64-bit hashes together.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows, keys = _named(raw)
    found = stage(rows.where(F.length("text") >= LENGTH).select("t", "text").mapInArrow(_find, ANCHORS))
    placed = found.repartition("bucket").sortWithinPartitions("bucket", "t", "start")
    anchored = stage(placed.mapInArrow(_several, ANCHORS))
    big = stage(anchored.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > BIG))
    anchored, whole = anchored.withColumn("members", F.lit(None).cast("long")), None
    if not big.isEmpty():
        anchored, whole = _crowded(anchored.drop("members").join(big, "bucket", "left"))
    marks = anchored.groupBy("t").agg(F.collect_set(
        F.struct("bucket", "start", "n", "place", F.col("members").isNotNull().alias("crowded"))).alias("marks"))
    packed = rows.mapInArrow(_pack, "doc_id long, t long, packed binary, size long")
    lone = keys.select("t", "doc_id").join(marks, "t")
    # The id is compared after the join on names alone, so that the marks stay where their grouping put them.
    same = F.when(F.col("r.doc_id").isNull(), F.col("k.doc_id").isNull()).otherwise(F.col("r.doc_id") == F.col("k.doc_id"))
    texts = packed.alias("r").join(lone.alias("k"), F.col("r.t") == F.col("k.t")).where(same)

    contexts = texts.select("r.t", "r.packed", "r.size", "k.marks").mapInArrow(_cut, CONTEXTS)
    contexts = contexts.repartition("bucket").sortWithinPartitions("bucket", "context", "place", "t", "start")
    spans = contexts.mapInArrow(_sort, SPANS)
    spans = spans if whole is None else spans.union(whole)
    per_text = spans.groupBy("t").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    facts = keys.select("t", "copies").join(per_text, "t", "left")
    return packed.join(facts, "t").select("doc_id", "packed", "size", "copies", "spans").mapInArrow(_remove, KEPT)


def _crowded(anchored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The anchors whose strings are still to be compared, and the runs of those that are repeated as a whole.

    In a crowded bucket, anchors of equal contexts, by two hashes, are one class: each member's run is repeated as it is,
    one row for it, and only one member stays for comparison with contexts that differ.
    """
    same = ["bucket", "place", "n", "one", "two"]
    spot = F.struct("t", "start")
    crowd = anchored.where("members is not null")
    classes = crowd.groupBy(*same).agg(F.min(spot).alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    crowd = stage(crowd.join(classes, same, "left"))
    rest = crowd.where(F.col("first").isNull() | (F.col("first") == spot)).drop("first")
    whole = crowd.where("first is not null").select("t", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last"))
    return anchored.where("members is null").unionByName(rest), whole


def _named(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a 64-bit name ``t`` of their text, and a row per text with its least id and its copies.

    A second hash shows whether two texts share a name; then all are named anew by another seed.
    """
    for seed in range(100):
        rows = raw.select("doc_id", F.xxhash64(F.lit(seed), "text").alias("t"), "text")
        named = rows.select("doc_id", "t", F.xxhash64(F.lit(-1), "text").alias("other")).groupBy("t").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), (F.min("other") == F.max("other")).alias("one"))
        keys = stage(named)
        if keys.where("not one").isEmpty():
            return rows, keys
    raise ValueError("texts cannot be told apart")
