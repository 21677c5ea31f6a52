"""Language-model scores by context-tree weighting over bytes.

The model's text is the token sequence: words in ASCII lower case, a space after each, then an end byte. Every byte is
eight binary decisions; a decision has a node in the context of the last 0, 1, ... ``DEPTH`` bytes, each with a
Krichevsky-Trofimov estimate. The weighted probability of a node is half its own estimate and half the product of the
nodes one byte deeper, so that all depths are mixed by how well they code the training text. A context that never
occurred in training adds nothing: the mixture ends at the deepest context that did.

A prediction depends on ``DEPTH`` bytes and the byte itself: a gram. Documents are dealt into batches of bounded size; a
batch asks once for each of its distinct grams and words, and gets back log probabilities and counts. So what moves
between machines is distinct grams per batch, never the model as a whole and never a row per position.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, partitions, stage

DEPTH = 5
BATCH_BYTES = 32 << 20
LEAST_BYTES = 32 << 20
PIECE = 1 << 20
END = b"\xff"
HALF = float(np.log(0.5))


def sequence(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.lower().split()
    return words, b" ".join([*words, b""]) + END


def grams(data: bytes) -> np.ndarray:
    """A gram per byte: the preceding bytes, nearest first, then the byte; so contexts that end alike sort together."""
    s = np.frombuffer(b"\0" * DEPTH + data, np.uint8)
    n = len(data)
    out = s[DEPTH:].astype(np.int64)
    for back in range(1, DEPTH + 1):
        out |= s[DEPTH - back: DEPTH - back + n].astype(np.int64) << (8 * (DEPTH + 1 - back))
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys starts."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


class Tally:
    """Distinct grams and words of a batch, with their counts in training documents (0: only held out)."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: dict[bool, list[tuple[bytes, int]]] = {True: [], False: []}
        self.size = 0
        self.words: Counter[bytes] = Counter()

    def add(self, text: bytes, train: bool) -> None:
        words, data = sequence(text)
        words.append(b"")
        if train:
            self.words.update(words)
        else:
            for w in words:
                self.words[w] += 0
        for at in range(0, len(data), PIECE):
            self.held[train].append((data[max(0, at - DEPTH): at + PIECE], min(at, DEPTH)))
            self.size += PIECE if at + PIECE < len(data) else len(data) - at
            if self.size >= 2 * PIECE:
                self.flush()

    def flush(self) -> None:
        for train, pieces in self.held.items():
            if pieces:
                found = np.concatenate([grams(p)[skip:] for p, skip in pieces])
                found.sort()
                at = _runs(found)
                n = np.diff(at, append=len(found)) if train else np.zeros(len(at), np.int64)
                self.keys, self.n = _merged(np.concatenate([self.keys, found[at]]), np.concatenate([self.n, n]))
        self.held, self.size = {True: [], False: []}, 0

    def tables(self, batch: int):
        self.flush()
        words = list(self.words)
        for gram, word, n in (
            (pa.array(self.keys), pa.nulls(len(self.keys), pa.binary()), pa.array(self.n)),
            (pa.nulls(len(words), pa.int64()), pa.array(words, pa.binary()), pa.array([self.words[w] for w in words], pa.int64())),
        ):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch)), gram, word, n], names=["batch", "gram", "word", "n"])


ASKED = "batch long, gram long, word binary, n long"


def _ask(batches):
    now, tally = None, Tally()
    for rows in batches:
        for batch, train, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
            if batch != now:
                if now is not None:
                    yield from tally.tables(now)
                now, tally = batch, Tally()
            tally.add(text.as_py(), train)
    if now is not None:
        yield from tally.tables(now)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument up by eight."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x * (x + 1) * (x + 2) * (x + 3)
    return series - np.log(product) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of a binary sequence with these counts under the Krichevsky-Trofimov estimator."""
    n0, n1 = np.asarray(n0, float), np.asarray(n1, float)
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 1.1447298858494002 - log_gamma(n0 + n1 + 1.0)


class Level:
    """Nodes of one depth and one bit position, over sorted ``context << 8 | byte`` keys with counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bit: int):
        self.bit = bit
        prefix = keys >> (8 - bit)
        at = _runs(prefix)
        self.nodes = prefix[at]
        ones = np.add.reduceat(n * ((keys >> (7 - bit)) & 1), at)
        self.total = np.add.reduceat(n, at)
        self.n1, self.n0 = ones, self.total - ones
        self.estimate = kt_log(self.n0, self.n1)
        self.weighted = self.estimate

    def weigh(self, deeper: Level) -> None:
        up = (deeper.nodes >> (8 + self.bit) << self.bit) | (deeper.nodes & ((1 << self.bit) - 1))
        below = np.bincount(np.searchsorted(self.nodes, up), weights=deeper.weighted, minlength=len(self.nodes))
        self.weighted = np.logaddexp(HALF + self.estimate, HALF + below)

    def at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own estimate of each key's bit, weight of stopping here, and whether training has been here."""
        k = np.searchsorted(self.nodes, keys >> (8 - self.bit))
        own = np.where((keys >> (7 - self.bit)) & 1, self.n1[k], self.n0[k])
        return (own + 0.5) / (self.total[k] + 1.0), np.exp(HALF + self.estimate - self.weighted)[k], self.total[k] > 0


def deep(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Mixture over the depths from ``DEPTH`` to 3 for sorted whole groups of depth-3 contexts.

    Gives the probability of each gram's eight bits (-1: no training below depth 2), and per bit position the depth-2
    nodes with their counts and summed weighted logs of the depth-3 nodes.
    """
    tables = {DEPTH: (keys, n)}
    for d in range(DEPTH - 1, 2, -1):
        k, m = tables[d + 1]
        tables[d] = _merged((k >> 16 << 8) | (k & 255), m)
    values, sums = np.empty((len(keys), 8), np.float32), []
    for bit in range(8):
        value = seen = deeper = None
        for d in range(DEPTH, 2, -1):
            level = Level(*tables[d], bit)
            if deeper is not None:
                level.weigh(deeper)
            own = (keys >> (8 * (DEPTH - d + 1)) << 8) | (keys & 255)
            estimate, stop, here = level.at(own)
            value = estimate if value is None else np.where(seen, stop * estimate + (1 - stop) * value, estimate)
            seen, deeper = here, level
        values[:, bit] = np.where(seen, value, -1.0)
        node = (deeper.nodes >> (8 + bit) << 8) | (1 << bit) | (deeper.nodes & ((1 << bit) - 1))
        order = np.argsort(node, kind="stable")
        at = _runs(node[order])
        sums.append((node[order][at], *(np.add.reduceat(x[order], at) for x in (deeper.n0, deeper.n1, deeper.weighted))))
    return values, sums


DEEP = "gram long, v array<float>, node long, n0 long, n1 long, below double"


def _deep_batches(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def tables(keys, n):
        values, sums = deep(keys, n)
        m = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.ListArray.from_arrays(np.arange(0, 8 * m + 1, 8, dtype=np.int32), values.ravel()),
             *(pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
            names=["gram", "v", "node", "n0", "n1", "below"])
        for node, n0, n1, below in sums:
            m = len(node)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.float32())), pa.array(node), pa.array(n0), pa.array(n1), pa.array(below)],
                names=["gram", "v", "node", "n0", "n1", "below"])

    for rows in batches:
        held.append((rows.column(0).to_numpy(), rows.column(1).to_numpy()))
        size += rows.num_rows
        if size >= 200_000:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys >> 24, keys[-1] >> 24))
            if cut:
                yield from tables(keys[:cut], n[:cut])
            held, size = [(keys[cut:], n[cut:])], len(keys) - cut
    if size:
        yield from tables(*(np.concatenate(x) for x in zip(*held, strict=True)))


@F.pandas_udf(T.DoubleType())
def _kt(n0: pd.Series, n1: pd.Series) -> pd.Series:
    return pd.Series(kt_log(n0.to_numpy(), n1.to_numpy()))


def _weighted(df: DataFrame) -> DataFrame:
    """Add the node's own estimate, its weighted log, the weight of stopping and the chance of a one."""
    df = df.withColumn("pe", _kt("n0", "n1"))
    top = F.greatest("pe", "below")
    df = df.withColumn("pw", F.lit(HALF) + top + F.log(F.exp(F.col("pe") - top) + F.exp(F.col("below") - top)))
    return df.withColumn("stop", F.exp(F.lit(HALF) + F.col("pe") - F.col("pw"))).withColumn(
        "kt", (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1))


def shallow(nodes: DataFrame) -> DataFrame:
    """Depths 2 to 0: ``node`` (depth-2 context and bit prefix), and the chance of a one as ``a + b * deeper``.

    There are at most 256^2 contexts of 255 nodes each, whatever the corpus.
    """
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    two = _weighted(nodes.groupBy("node").agg(*sums, F.sum("below").alias("below")))
    two = stage(two.withColumn("up", F.shiftright("node", 16) * 256 + F.col("node") % 256))
    one = _weighted(two.groupBy("up").agg(*sums, F.sum("pw").alias("below"))).withColumn("root", F.col("up") % 256)
    none = _weighted(one.groupBy("root").agg(*sums, F.sum("pw").alias("below")))
    one = one.join(none.select("root", F.col("stop").alias("stop0"), F.col("kt").alias("kt0")), "root").select(
        "up", F.col("stop").alias("stop1"), F.col("kt").alias("kt1"), "stop0", "kt0", (F.col("n0") + F.col("n1") > 0).alias("seen1"))
    seen2 = F.col("n0") + F.col("n1") > 0
    from1 = F.when(F.col("seen1"), 1 - F.col("stop0")).otherwise(0.0)
    from2 = F.when(seen2, from1 * (1 - F.col("stop1"))).otherwise(0.0)
    b = from2 * (1 - F.col("stop"))
    a = (F.when(F.col("seen1"), F.col("stop0")).otherwise(1.0) * F.col("kt0")
         + F.when(seen2, from1 * F.col("stop1")).otherwise(from1) * F.col("kt1") + from2 * F.col("stop") * F.col("kt"))
    return two.join(one, "up").select("node", a.alias("a"), b.alias("b"), F.col("kt").alias("k"))


def gram_scores(found: DataFrame) -> DataFrame:
    """``gram, logp``: log10 probability of each gram's byte in its context."""
    g = found.where("gram is not null").select("gram", "v")
    pair = (F.shiftright("gram", 8 * (DEPTH - 1)) * 256 + F.col("gram") % 256).alias("pair")
    nodes = shallow(found.where("node is not null"))
    bits = g.select(pair).distinct().withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(7))))
    context = F.shiftright("pair", 8)
    prefix = F.expr("shiftleft(1, bit) + cast(pair % 256 as bigint) div cast(shiftleft(1, 8 - bit) as bigint)")
    bits = bits.withColumn("node", context * 256 + prefix).withColumn(
        "one", F.expr("(cast(pair % 256 as bigint) div cast(shiftleft(1, 7 - bit) as bigint)) % 2 = 1"))
    mix = bits.join(nodes, "node").select(
        "pair", F.struct("bit", F.when(F.col("one"), F.col("a")).otherwise(1 - F.col("a") - F.col("b")).alias("a"), "b",
                         F.when(F.col("one"), F.col("k")).otherwise(1 - F.col("k")).alias("k")).alias("x"))
    mix = mix.groupBy("pair").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def bit_log(j: int) -> Column:
        x, v = F.col("x")[j], F.col("v")[j].cast("double")
        return F.log10(x["a"] + x["b"] * F.when(v < 0, x["k"]).otherwise(v))

    total = bit_log(0)
    for j in range(1, 8):
        total = total + bit_log(j)
    return g.withColumn("pair", pair).join(mix, "pair").select("gram", total.alias("logp"))


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, code_bits_per_byte double")


def _answer(train_tokens: int, train_words: int):
    unknown = float(np.log10(0.1 / (train_tokens + 0.1 * (train_words + 1))))
    scale = train_tokens + 0.1 * (train_words + 1)

    def run(batches):
        now = None
        for rows in batches:
            out = []
            kinds = rows.column("kind").to_numpy()
            batch = rows.column("batch").to_numpy()
            cuts = _runs(batch * 4 + kinds)
            for lo, hi in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                part, kind = rows.slice(lo, hi - lo), kinds[lo]
                if batch[lo] != now:
                    now, keys, logs, words, ready = batch[lo], [], [], {}, False
                if kind == 0:
                    keys.append(part.column("k").to_numpy())
                    logs.append(part.column("v").to_numpy())
                elif kind == 1:
                    logc = np.log10((part.column("v").to_numpy() + 0.1) / scale).tolist()
                    words.update(zip(part.column("b").to_pylist(), logc, strict=True))
                else:
                    if not ready:
                        keys, logs = np.concatenate(keys), np.concatenate(logs)
                        order = np.argsort(keys)
                        keys, logs, ready = keys[order], logs[order], True
                    for doc_id, held, text in zip(part.column("k"), part.column("v").to_pylist(), part.column("b"), strict=True):
                        out.append(_score(doc_id.as_py(), held, text.as_py(), keys, logs, words))
            if out:
                d, h, n, known, base, score, size = zip(*out, strict=True)
                base = np.array(base) + (np.array(n) - np.array(known)) * unknown
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array([x > 0 for x in h], pa.bool_()), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                     pa.array([train_tokens] * len(n), pa.int64()), pa.array(base), pa.array(score, pa.float64()),
                     pa.array(-np.array(score) / np.log10(2) / np.array(size))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_bits_per_byte"])

    return run


def _score(doc_id, held, text, keys, logs, words):
    tokens, data = sequence(text)
    tokens.append(b"")
    known = [words[w] for w in tokens if w in words]
    score = 0.0
    for at in range(0, len(data), PIECE):
        skip = min(at, DEPTH)
        found = grams(data[at - skip: at + PIECE])[skip:]
        found.sort()
        score += float(logs[np.searchsorted(keys, found)].sum())
    return doc_id, held, len(tokens), len(known), float(np.sum(known)), score, len(data)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by the context-tree model and by add-0.1 token counts, both learned from training rows.

    A null text is an empty one: it has the end token alone. Documents whose crc32(id) mod 10 is 0 are held out; a null
    id counts as empty text there and stays null. Repeated rows are scored alike. Without any training document every
    bit has probability 1/2. Further columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    spread = min(partitions(docs.sparkSession), size // LEAST_BYTES)
    batches = max(1, -(-size // BATCH_BYTES), spread)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(batches)).alias("batch"), F.col(id_col).cast("long").alias("doc_id"),
        (crc_mod(id_col, 10) != 0).alias("train"), text.cast("binary").alias("text"))
    placed = rows.repartitionById(batches, F.col("batch").cast("int"))
    asked = stage(placed.select("batch", "train", "text").mapInArrow(_ask, ASKED))
    counts = asked.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    found = stage(counts.repartition(F.shiftright("gram", 24)).sortWithinPartitions("gram").mapInArrow(_deep_batches, DEEP))
    words = stage(asked.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    grams_back = asked.where("gram is not null").join(gram_scores(found), "gram").select(
        "batch", F.lit(0).alias("kind"), F.col("gram").alias("k"), F.col("logp").alias("v"), F.lit(None).cast("binary").alias("b"))
    words_back = asked.where("word is not null").join(words, "word").select(
        "batch", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("k"), F.col("c").cast("double").alias("v"), F.col("word").alias("b"))
    texts = rows.select("batch", F.lit(2).alias("kind"), F.col("doc_id").alias("k"),
                        (~F.col("train")).cast("double").alias("v"), F.col("text").alias("b"))
    together = grams_back.union(words_back).union(texts).repartitionById(batches, F.col("batch").cast("int")).sortWithinPartitions("kind")
    return together.mapInArrow(_answer(totals.n, totals.v), SCORES)
