"""Language identification by mixtures: every word of a document is drawn from one of its languages.

Hashed letter trigrams are counted per language. A document's words get a likelihood under each language; expectation
maximisation estimates the proportions in which the languages are mixed. Nested language sets (the strongest one, the
strongest two, and so on) are fitted, and the penalised likelihood says which set describes the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, fresh

BUCKETS = 1 << 16
MODEL_BYTES = 64 << 20
BATCH_BYTES = 2 << 20
STEPS = 8
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
# ASCII letters in lower case; other ASCII bytes part words; the rest are pieces of letters beyond ASCII.
_TO_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
LANGUAGES = "lang_pred string, score double, share map<string,double>"


def letters(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_TO_LETTERS) + b"  "


def trigram_buckets(data: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the trigram around each inner byte."""
    x = data.astype(np.uint32)
    key = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(buckets)))).astype(np.int64)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of trigram buckets (buckets x languages, at most ``MODEL_BYTES``)."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    buckets = BUCKETS
    while len(langs) * buckets * 4 > MODEL_BYTES and buckets > 256:
        buckets //= 2

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(letters(text.as_py()), np.uint8)
                at = trigram_buckets(data, buckets)[data[1:-1] != 32]
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                sums[lang] += np.bincount(at, minlength=buckets) if len(at) > buckets else 0
                if len(at) <= buckets:
                    np.add.at(sums[lang], at, 1)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((buckets, max(1, len(langs))), np.float64)
    if counts.num_rows:
        where = {x: k for k, x in enumerate(langs)}
        column = np.array([where[x] for x in counts.column("lang").to_pylist()])
        table[counts.column("bucket").to_numpy(), column] = counts.column("n").to_numpy()
    table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * buckets))
    return langs, table.astype(np.float32)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def proportions(odds: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per document by expectation maximisation, and the log likelihood beyond the words' own peaks."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for step in range(steps + 1):
        joint = odds * np.repeat(share, sizes, axis=0)
        total = joint.sum(axis=1)
        np.maximum(total, 1e-37, out=total)
        if step == steps:
            return share, _sums(np.log(total), starts)
        joint /= total[:, None]
        share = _sums(joint, starts) / sizes[:, None]
    raise AssertionError


def fit(odds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions over the language set with the best penalised likelihood, per document."""
    n, k = len(starts), odds.shape[1]
    full, value = proportions(odds, starts, sizes, np.ones((n, k), np.float32))
    if k == 1:
        return full
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    price = 0.5 * np.log(sizes + 1.0)
    best, cost = full.copy(), price * (k - 1) - value
    for m in range(1, k):
        share, value = proportions(odds, starts, sizes, (rank < m).astype(np.float32), 0 if m == 1 else STEPS)
        now = price * (m - 1) - value
        better = now <= cost
        best[better], cost[better] = share[better], now[better]
    return best


def shares_of(texts: list[bytes], model: np.ndarray) -> np.ndarray:
    """Proportions for documents given as letters; each has at least one word."""
    odds, sizes = [], []
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= BATCH_BYTES // max(1, model.shape[1] // 4) or k + 1 == len(texts):
            _likelihoods(held, model, odds, sizes)
            held, size = [], 0
    sizes = np.concatenate(sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return fit(np.concatenate(odds), starts, sizes)


def _likelihoods(texts: list[bytes], model: np.ndarray, odds: list, sizes: list) -> None:
    data = np.frombuffer(b"".join(texts), np.uint8)
    inside = data[1:-1] != 32
    at = np.flatnonzero(inside)
    logs = model[trigram_buckets(data, model.shape[0])[at]]
    opens = np.flatnonzero(inside & (data[:-2] == 32))
    words = np.add.reduceat(logs, np.searchsorted(at, opens), axis=0)
    words -= words.max(axis=1, keepdims=True)
    odds.append(np.exp(words))
    ends = np.cumsum([len(t) for t in texts])
    sizes.append(np.diff(np.searchsorted(opens + 1, ends), prepend=0))


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
             name: str = "language") -> DataFrame:
    """The kept columns and a struct of ``lang_pred``, its proportion ``score``, and ``share``, those of the chosen set.

    A null text, a text without a letter, and any text when no language was learned give ``und`` with score 0. Ties go
    to the language that sorts first. Repeated rows give repeated rows; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((langs, model))
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    rows = docs.select(*kept.columns, F.col(text_col).alias(fresh(kept, "text")))
    found = T.StructType([*kept.schema.fields, T.StructField(name, T.StructType.fromDDL(LANGUAGES))])

    def run(batches):
        langs, model = sent.value
        for batch in batches:
            n = batch.num_rows
            pred, score, share = [UNKNOWN] * n, [0.0] * n, [[] for _ in range(n)]
            held, rows_held, size = [], [], 0
            for k, text in enumerate(batch.column(len(keep))):
                text = text.as_py()
                if langs and text and _LETTER.search(text):
                    found = letters(text)
                    if found.strip():
                        held.append(found)
                        rows_held.append(k)
                        size += len(found)
                if held and (size >= 16 * BATCH_BYTES // max(4, len(langs)) or k + 1 == n):
                    for row, mix in zip(rows_held, shares_of(held, model), strict=True):
                        top = int(np.argmax(mix))
                        pred[row], score[row] = langs[top], min(1.0, float(mix[top]))
                        share[row] = [(langs[j], float(mix[j])) for j in np.flatnonzero(mix > 1e-4)]
                    held, rows_held, size = [], [], 0
            mix = pa.StructArray.from_arrays(
                [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.map_(pa.string(), pa.float64()))],
                names=["lang_pred", "score", "share"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], mix], names=[*keep, name])

    return rows.mapInArrow(run, found)


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Learn from three quarters of the labelled documents, by their id, and predict all."""
    langs, model = learn(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs, langs, model).select(
        F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "language.lang_pred", "language.score")
