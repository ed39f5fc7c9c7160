"""64-bit hashes of all words of many texts, computed on whole byte buffers.

Each byte has a random 64-bit value, zero for those that separate words; capital letters have that
of their small ones. A word's hash is the sum of its values times powers of an odd number, from one
running sum over the buffer, then mixed with its length. All of it is modulo 2**64, so a slice of
the running sum times the inverse power is the same wherever the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes taken together; a longer text is cut at a separator.
SLICE = 300_000
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits."""
    z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _values(separators: list[int]) -> np.ndarray:
    table = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE)) | np.uint64(1)
    table[65:91] = table[97:123]
    table[separators] = 0
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = _values([32, *range(9, 14)])
#: Words of 0-9, letters and everything beyond ASCII.
PLAIN = _values([b for b in range(128) if not chr(b).isalnum()])


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, SLICE + 1)
            cls.up, cls.down = (cls._run(b, n) for b in (_BASE, _BASE_INVERSE))
        return cls.up, cls.down

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


def _hashed(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a buffer that ends with a separator."""
    up, down = _Powers.of(len(data) + 1)
    values = table[data]
    inside = values != 0
    values *= up[: len(values)]
    total = np.cumsum(values)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    hashes = (total[ends - 1] - before) * down[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def _slices(text: bytes, table: np.ndarray) -> Iterator[bytes]:
    """A long text in slices that end with a separator."""
    begin = 0
    while begin < len(text):
        end = begin + SLICE
        while end < len(text):
            cut = np.flatnonzero(table[np.frombuffer(text[max(begin, end - 4096) : end], np.uint8)] == 0)
            if len(cut):
                end = max(begin, end - 4096) + int(cut[-1]) + 1
                break
            end += 4096
        yield text[begin:end]
        begin = end


def word_hashes(texts: list[bytes], table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one entry more)."""
    if sum(map(len, texts)) + len(texts) > SLICE:
        if len(texts) == 1:
            found = [word_hashes([s], table)[0] if len(s) + 1 <= SLICE else _whole(s, table)
                     for s in _slices(texts[0], table)]
            hashes = np.concatenate(found)
            return hashes, np.array([0, len(hashes)])
        parts = [word_hashes(texts[a:b], table) for a, b in portions([len(t) for t in texts], SLICE // 2)]
        counts = np.concatenate([np.diff(offsets) for _, offsets in parts])
        return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(counts)])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    hashes, starts = _hashed(data, table)
    begins = np.cumsum(sizes) - sizes
    return hashes, np.append(np.searchsorted(starts, begins), len(hashes))


def _whole(text: bytes, table: np.ndarray) -> np.ndarray:
    return _hashed(np.frombuffer(text + b" ", np.uint8), table)[0]


def portions(sizes: list[int], most: int, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of up to `rows` neighbours of `most` in all; a larger one has a range of its own."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > most or i - begin == rows):
            yield begin, i
            begin, total = i, 0
        total += size + 1
    if begin < len(sizes):
        yield begin, len(sizes)
