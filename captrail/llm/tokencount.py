"""Token counts by whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come out as one token form a set that is proven, not
assumed. A pre-token in the set counts one without any merge; only the others are merged. Texts are cut at single
spaces between two visible characters, where the pre-token pattern always has a boundary.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, MergeTable

# Fixed value: how byte-level vocabularies of this family split text before their merges.
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OUTER = regex.compile(r"\A\s|\s\Z")
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def whole_tokens(table: MergeTable) -> list[str]:
    """Vocabulary strings that encode alone as exactly one token, themselves."""
    out = []
    for piece, i in table.vocab.items():
        try:
            word = bytes(table.bytes_of[c] for c in piece)
        except KeyError:
            continue
        if table.merged(list(table.symbols(word))) == [i]:
            out.append(word)
    return out


class Counter:
    def __init__(self, table: MergeTable, whole: list[bytes]):
        self.table, self.whole = table, frozenset(whole)
        self.first, self.spaced = Memo(self._count), Memo(self._spaced)
        self.word = Memo(self._word)

    def _word(self, word: str) -> int:
        """Tokens of a pre-token: one if it is proven whole, else what its merges leave."""
        data = word.encode()
        return 1 if data in self.whole else sum(1 for _ in self.table.tokens(data))

    def _count(self, text: str) -> int:
        return sum(map(self.word.__getitem__, BYTE_PATTERN.findall(text)))

    def _spaced(self, chunk: str) -> int:
        """Tokens of the chunk with its space before it; -1 where that space is no sure boundary."""
        return -1 if not chunk or _OUTER.search(chunk) or chunk[0].isspace() or chunk[-1].isspace() else self._count(" " + chunk)

    def count(self, text: str) -> int:
        n = 0
        for part, special in self.table.parts(text):
            if special is not None:
                n += 1
                continue
            chunks = part.split(" ")
            counts = [self.spaced[c] for c in chunks[1:]]
            outer = not chunks[0] or _OUTER.search(chunks[0]) or chunks[0][-1].isspace() or chunks[0][0].isspace()
            if not outer and -1 not in counts:
                n += self.first[chunks[0]] + sum(counts)
            else:
                n += self._runs(chunks, counts, bool(outer))
        return n

    def _runs(self, chunks: list[str], counts: list[int], outer: bool) -> int:
        """As ``count``, where some spaces are no boundaries: stretches around those are matched as one text."""
        n, held = 0, [chunks[0]]
        sound = not outer
        for chunk, c in zip(chunks[1:], counts, strict=True):
            if c >= 0 and sound:
                if held:
                    n += self._count(" ".join(held)) if held[0] is not None else 0
                    held = []
                n += c
                continue
            if c >= 0 or held:
                held.append(chunk)
            else:
                held = ["", chunk]  # the space before the stretch belongs to it
            sound = c >= 0
        return n + (self._count(" ".join(held)) if held else 0)


def count_documents(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed ``limit``.

    A null text is an empty one: 0 bytes, 0 tokens. Repeated rows give repeated rows; a null id stays null; further
    columns are not read. A special string in a text counts one token. Vocabulary and proof are of fixed size.
    """
    table = MergeTable(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, whole_tokens(table)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        counter = _counter(sent)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = pa.array([counter.count(t) for t in texts], pa.int64())
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, over], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, COUNTS)


_COUNTERS: dict[int, Counter] = {}


def _counter(sent) -> Counter:
    """One counter per Python worker and vocabulary: its memo serves all tasks of the worker."""
    key = hash(sent.value[0])
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(MergeTable(sent.value[0]), sent.value[1])
    return _COUNTERS[key]
