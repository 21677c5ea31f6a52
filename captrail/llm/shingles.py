"""Word and shingle hashes of whole texts as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, dtype=np.uint64)
_SPACES = (32, 9, 10, 11, 12, 13)
_TABLE[list(_SPACES)] = 0
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PLACES = _RNG.integers(0, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _STEP), np.full(size, _BACK)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word: a polynomial over random letters, by differences of one running sum."""
    x = np.frombuffer(data, np.uint8)
    up, down = _powers(len(x))
    sums = np.cumsum(_TABLE[x] * up[: len(x)], dtype=np.uint64)
    word = ~_IS_SPACE[x]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))
    return starts, mix((sums[ends - 1] - before) * down[starts])


def _pieces(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while len(data) - at > PIECE:
        end = at + PIECE
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def _word_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of a few texts in a row, and where each text's words begin and the last one's end."""
    held: list[bytes] = []
    size = 0

    def flush():
        starts, hashes = _piece_hashes(b"\n".join(held))
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in held])[:-1])
        return hashes, np.concatenate(([0], cuts, [len(hashes)]))

    for text in texts:
        if held and size + len(text) > PIECE:
            yield flush()
            held, size = [], 0
        if len(text) > PIECE:
            hashes = np.concatenate([_piece_hashes(p)[1] for p in _pieces(text)])
            yield hashes, np.array([0, len(hashes)])
            continue
        held.append(text)
        size += len(text) + 1
    if held:
        yield flush()


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text, already in the case to compare, the hashes of its words in order."""
    for hashes, ends in _word_runs(texts):
        yield from np.split(hashes, ends[1:-1])


def first_of(ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the first ``n`` items of each of the groups that end at ``ends[1:]``."""
    before = np.cumsum(n) - n
    return np.repeat(ends[:-1] - before, n) + np.arange(n.sum())


def shingle_runs(texts: list[bytes], width: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of ``shingle_set`` for a few texts in a row, one after the other, and where each begins and the last ends."""
    for words, ends in _word_runs(texts):
        n = np.diff(ends)
        size = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        cuts = np.concatenate(([0], np.cumsum(size)))
        last = max(0, len(words) - width + 1)
        total = words[:last] * _PLACES[0]
        for k in range(1, width):
            total += words[k: last + k] * _PLACES[k]
        found = np.zeros(cuts[-1], np.uint64)
        long = np.where(n >= width, size, 0)
        found[first_of(cuts, long)] = mix(total[first_of(ends, long)])
        for k in np.flatnonzero((n > 0) & (n < width)):
            found[cuts[k]] = shingle_set(words[ends[k]: ends[k + 1]], width)[0]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[cuts[:-1][size > 0]] = True
        yield found[new], np.concatenate(([0], np.cumsum(new)))[cuts]


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width`` words in a row; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < width:
        return mix(np.array([(words * _PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
    total = words[: n - width + 1] * _PLACES[0]
    for k in range(1, width):
        total = total + words[k: n - width + 1 + k] * _PLACES[k]
    found = mix(total)
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))]
