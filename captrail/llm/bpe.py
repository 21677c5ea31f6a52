"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

The merge list alone fixes how far to the right a token can depend on (`sufficient_lookahead`). The encoder
therefore emits every token that ends that far before the end of what it has seen; it holds one window, whatever
the length of the text. The decoder holds at most the bytes of one unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_ENTRIES = 400_000
WINDOW = 256
LETTERS_KEPT = 128


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stay, others move past 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(moved)}


class Memo(dict):
    """A dict that computes missing values and starts afresh when it is full, so that its memory is bounded."""

    def __init__(self, make, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LETTERS_KEPT:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class MergeTable:
    """Vocabulary and merges of a byte-level BPE tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added: dict[str, int] = {a["content"]: a["id"] for a in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = [self.vocab[a] for a, _ in pairs]
        self.right = [self.vocab[b] for _, b in pairs]
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.ranks = {a << 20 | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.pieces = {i: t for t, i in {**self.vocab, **self.added}.items()}
        letters = byte_letters()
        self.inner = [self.vocab.get(letters[b]) for b in range(256)]
        self.last = [self.vocab.get(letters[b] + self.suffix) for b in range(256)]
        self.bytes_of = {c: b for b, c in letters.items()}

    @cached_property
    def sufficient_lookahead(self) -> int:
        """Symbols to the right of a token on which the token can depend.

        A merge yields only to a merge of lower rank that starts in its right part; that one yields only to one of
        still lower rank, and so on. Going through the merges by rank, ``reach`` of a token is the longest such
        chain that starts with it, in symbols.
        """
        length = {}
        child: dict[int, int] = {}
        reach: dict[int, int] = {}
        most = 0
        for a, b, c in zip(self.left, self.right, self.made, strict=True):
            length[c] = length.get(a, 1) + length.get(b, 1)
            child.setdefault(c, b)
            onward, x = 0, b
            while x is not None:
                onward = max(onward, reach.get(x, 0))
                x = child.get(x)
            reach[a] = max(reach.get(a, 0), length.get(b, 1) + onward)
            most = max(most, reach[a])
        return most + max(length.values(), default=1)

    def merged(self, ids: list[int]) -> list[int]:
        """Apply the merges to a window of symbols, lowest rank first, leftmost first."""
        rank, made, none = self.ranks.get, self.made, len(self.made)
        found = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            k = found.index(best)
            ids[k] = made[best]
            del ids[k + 1], found[k]
            if k:
                found[k - 1] = rank(ids[k - 1] << 20 | ids[k], none)
            if k < len(found):
                found[k] = rank(ids[k] << 20 | ids[k + 1], none)
        return ids

    def symbols(self, word: bytes) -> list[int]:
        """Single-byte symbols of a word; those that the vocabulary lacks are left out, as there is no unknown token."""
        inner = self.inner
        found = [inner[b] for b in word[:-1]]
        found.append(self.last[word[-1]])
        return [s for s in found if s is not None] if self.gaps else found

    @cached_property
    def gaps(self) -> bool:
        return None in self.inner or None in self.last

    def tokens(self, word: bytes) -> Iterable[int]:
        """Token ids of one word: short words at once, longer ones as a stream."""
        symbols = self.symbols(word)
        return self.merged(symbols) if len(symbols) <= WINDOW else self.stream(symbols)

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Token ids of one word, each as soon as nothing further to the right can change it."""
        look, window = self.sufficient_lookahead, []
        for s in symbols:
            window.append(s)
            if len(window) >= look + WINDOW:
                done = 0
                for t in self.merged(list(window)):
                    if done + self.lengths.get(t, 1) > len(window) - look:
                        break
                    yield t
                    done += self.lengths.get(t, 1)
                window = window[done:]
        yield from self.merged(window)

    @cached_property
    def lengths(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for a, b, c in zip(self.left, self.right, self.made, strict=True):
            out[c] = out.get(a, 1) + out.get(b, 1)
        return out

    @cached_property
    def specials(self) -> regex.Pattern:
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches of a text, and the special strings in it with their ids."""
        if not self.added or not any(a in text for a in self.added):
            yield text, None
            return
        for k, part in enumerate(self.specials.split(text)):
            if k % 2:
                yield part, self.added[part]
            elif part:
                yield part, None


# Fixed value: how the word vocabulary splits text before its merges. Letters are those of the regex package's
# Unicode version; the tokenizer's own may lack the newest ones.
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter: a capital sigma never becomes a final one."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class WordEncoder:
    """Encodes whole texts: no merge crosses a space, so what lies between two spaces is looked up or streamed."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.memo = Memo(self._chunk)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        table = self.table
        words = WORD_PATTERN.findall(chunk)
        if len(words) != 1 or words[0] != chunk:
            found = [self.memo[w] for w in words]
            return b"".join([f[0] for f in found]), "".join([f[1] for f in found])
        ids = list(table.tokens(chunk.encode()))
        return struct.pack(f"<{len(ids)}I", *ids), "".join([table.pieces[t] + " " for t in ids])

    def encode(self, text: str) -> Iterator[tuple[bytes, str]]:
        """Packed ids and pieces, stretch by stretch."""
        memo = self.memo
        for part, special in self.table.parts(text):
            if special is not None:
                yield struct.pack("<I", special), part + " "
            else:
                for chunk in lowered(part).split(" "):
                    yield memo[chunk]


class TextDecoder:
    """Bytes in, text out: at most one unfinished character is held; broken bytes become U+FFFD."""

    def __init__(self):
        self._state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def push(self, data: bytes) -> str:
        return self._state.decode(data)

    def finish(self) -> str:
        return self._state.decode(b"", True)


def decode_bytes(table: MergeTable, ids: Iterable[int]) -> Iterator[str]:
    """Text that the ids stand for, piece by piece; word ends become spaces, special tokens stay as they are."""
    machine, special = TextDecoder(), {i: t for t, i in table.added.items()}
    for i in ids:
        if i in special:
            yield machine.finish() + special[i]
            machine = TextDecoder()
            continue
        piece = table.pieces[i]
        end = bool(table.suffix) and piece.endswith(table.suffix)
        body = piece[: len(piece) - len(table.suffix)] if end else piece
        yield machine.push(bytes(table.bytes_of[c] for c in body) + b" " * end)
    yield machine.finish()


ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Token ids (little-endian unsigned 32 bits) and decoded text of every whole text, or the digests of both.

    A null text is an empty one: no ids. Repeated rows give repeated rows; a null id stays null; further columns are
    not read. The decoded text joins the pieces of the vocabulary by spaces, as files without a decoder have it.
    ``vocabulary`` is the text of the tokenizer file, whose size does not depend on the data.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        encoder = _encoder(sent)
        for batch in batches:
            ids, n, packed, decoded = batch.column(0), [], [], []
            for text in batch.column(1):
                got = list(encoder.encode(text.as_py()))
                data = b"".join([g[0] for g in got])
                machine = TextDecoder()
                back = machine.push("".join([g[1] for g in got])[:-1].encode()) + machine.finish()
                n.append(len(data) // 4)
                packed.append(hashlib.sha256(data).hexdigest() if digests else data)
                decoded.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
            names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(packed, pa.string() if digests else pa.binary()), pa.array(decoded, pa.string())],
                names=names)

    return rows.mapInArrow(run, DIGESTS if digests else ENCODED)


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(sent) -> WordEncoder:
    """One encoder per Python worker and vocabulary: its memo serves all tasks of the worker."""
    key = hash(sent.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(MergeTable(sent.value))
    return _ENCODERS[key]
