"""Words and shingles of whole texts as 64-bit hashes, many texts at a time.

A word is a maximal run of bytes other than space and \\t..\\r; A-Z count as
a-z.  Both rules touch ASCII bytes only, so they hold on UTF-8 as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_SHIFT = np.uint64(33)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _SHIFT)
    x = x * _M1
    x = x ^ (x >> _SHIFT)
    x = x * _M2
    return x ^ (x >> _SHIFT)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``base**i`` or its inverse modulo 2**64 for i < n."""
    name = "inverse" if inverse else "power"
    have = _powers.get(name)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * CHUNK:
            _powers[name] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    raw = (sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~BLANK[data]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of texts of about CHUNK bytes; long texts are cut at blanks."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        start = 0
        while start < len(text):
            end = min(start + CHUNK, len(text))
            if end < len(text):
                cut = max(text.rfind(b, start, end) for b in (b" ", b"\n", b"\t"))
                if cut > start:
                    end = cut
                else:
                    found = [x for b in (b" ", b"\n", b"\t") if (x := text.find(b, end)) >= 0]
                    end = min(found, default=len(text))
            owners.append(i)
            parts.append(text[start:end])
            size += end - start + 1
            start = end
            if size >= CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the offsets of each text."""
    counts = np.zeros(len(texts), np.int64)
    hashes = []
    for owners, parts in _pieces(texts):
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        if fold:
            data = LOWER[data]
        starts, ends = word_spans(data)
        hashes.append(span_hashes(prefix_sums(data), starts, ends))
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        part = np.searchsorted(begins, starts, "right") - 1
        np.add.at(counts, np.asarray(owners)[part], 1)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """One hash of a whole short sequence of words."""
    value = np.array([len(hashes)], np.uint64)
    for h in hashes:
        value = mix(value * np.uint64(_BASE) + h)
    return value[0]


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Each text's distinct ``width``-word shingles, ascending.

    A text with fewer words has its whole sequence as its one shingle; a text
    without words has none.
    """
    hashes, offsets = word_hashes(texts)
    rolled = np.full(max(0, len(hashes) - width + 1), width, np.uint64)
    for k in range(width):
        rolled = mix(rolled * np.uint64(_BASE) + hashes[k:k + len(rolled)])
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= width:
            yield np.unique(rolled[a:b - width + 1])
        elif b > a:
            yield np.array([sequence_hash(hashes[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
