"""Encoding, decoding and counting against the tokenizers library; streams against whole words."""

import hashlib
import random
import struct
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from captrail.llm import bpe, tokencount
from captrail.llm.queries import vocabulary


@pytest.fixture(scope="module")
def word_file():
    return vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_file():
    return vocabulary("byte_bpe_50k.json")


def test_encoding_equals_library(docs, word_file):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encode_documents(docs, word_file, digests=True).collect()]
    assert Counter(got) == Counter(want)


def test_counts_equal_library(docs, byte_file):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 1024))
    assert Counter(map(tuple, tokencount.count_documents(docs, byte_file).collect())) == Counter(want)


def test_spaces_and_specials(byte_file, word_file):
    byte_library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    word_library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    table = bpe.MergeTable(byte_file)
    counter = tokencount.Counter(table, tokencount.whole_tokens(table))
    encoder = bpe.WordEncoder(bpe.MergeTable(word_file))
    rng = random.Random(1)
    cases = ["a  b", " a", "a ", "a\n  b\n", " \n a", "<|endoftext|>", "x <|endoftext|> y<|startoftext|>", "   ", " a　 b\x1c c", "ΣΑΣ İ é"]
    cases += ["".join(rng.choice("ab  \n\t.'sé漢1") for _ in range(rng.randrange(40))) for _ in range(2000)]
    for text in cases:
        assert counter.count(text) == len(byte_library.encode(text, add_special_tokens=False).ids), text
        data = b"".join(g[0] for g in encoder.encode(text))
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == word_library.encode(text, add_special_tokens=False).ids, text


def test_stream_equals_whole(byte_file):
    table = bpe.MergeTable(byte_file)
    rng = random.Random(3)
    assert table.sufficient_lookahead < 2000
    for _ in range(30):
        word = "".join(rng.choice(["the", "in", "er", "a", "n", "th", "ing", "zq"]) for _ in range(rng.randrange(1500))).encode()
        if word:
            assert list(table.stream(iter(table.symbols(word)))) == table.merged(table.symbols(word))


def test_decoder_round_trip(byte_file):
    table = bpe.MergeTable(byte_file)
    text = "Grüße, 日本 🙂 done"
    ids = [t for w in tokencount.BYTE_PATTERN.findall(text) for t in table.tokens(w.encode())]
    assert "".join(bpe.decode_bytes(table, ids)) == text
    machine = bpe.TextDecoder()
    assert "".join([machine.push(bytes([b])) for b in text.encode()] + [machine.finish()]) == text


def test_empty_table(empty, word_file, byte_file):
    assert bpe.encode_documents(empty, word_file).count() == 0
    assert tokencount.count_documents(empty, byte_file).count() == 0
