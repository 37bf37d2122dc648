"""The draws of :mod:`gapwise.functions.hashing` for many keys held in a task.

Held rows are drawn from again and again under other seeds.  Here the md5 of
``seed|key`` is taken of many short keys at once with numpy, in any task.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapwise.functions.hashing import RANK_BITS

AT_ONCE = 1 << 16  #: keys whose digests are made together; numpy is slow on few
ONE_BLOCK = 55  #: bytes that fit into one block of md5

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = ((1, 0), (5, 1), (3, 5), (7, 0))
_ADDED = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]


class Keys:
    """Keys as text (NULL joins nothing, as in ``concat_ws``), ready for ranks under many seeds."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        self.null = texts.is_null().to_numpy(zero_copy_only=False)
        self.offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        self.sizes = np.diff(self.offsets)
        self.words: dict[int, tuple] = {}

    def __len__(self) -> int:
        return len(self.null)

    def ranks(self, seed) -> np.ndarray:
        """What :func:`gapwise.functions.hashing.hash_rank` gives for each key."""
        head = f"{seed}|".encode()
        out = np.empty(len(self), np.uint64)
        used, long = self._laid(len(head))
        start = np.zeros(64, np.uint8)
        start[:len(head)] = list(head)[:64]
        constant = start.view("<u4")
        for at in range(0, len(self), AT_ONCE):
            words = [w[at:at + AT_ONCE] | constant[i] if constant[i] else w[at:at + AT_ONCE] for i, w in enumerate(used[:-1])]
            out[at:at + AT_ONCE] = _first_bits([*words, *[np.uint32(0)] * (14 - len(words)), used[-1][at:at + AT_ONCE],
                                                np.uint32(0)])
        for i in long:
            out[i] = _one(head + self.data[self.offsets[i]:self.offsets[i + 1]].tobytes())
        if self.null.any():
            out[self.null] = _one(str(seed).encode())
        return out

    def _laid(self, at: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Words of the padded blocks with room for ``at`` bytes (their sizes last), keys that need more blocks."""
        if at not in self.words:
            fits = self.sizes + at <= ONE_BLOCK
            widest = int(self.sizes[fits].max()) if fits.any() else 0
            cells = np.zeros((len(self), min(14, (at + widest) // 4 + 1) * 4), np.uint8)
            for size in np.unique(self.sizes[fits]):
                own = np.flatnonzero(self.sizes == size)
                cells[own[:, None], at + np.arange(size)] = self.data[self.offsets[own][:, None] + np.arange(size)]
                cells[own, at + size] = 0x80
            bits = ((self.sizes + at) * 8).astype(np.uint32)
            self.words[at] = [*np.ascontiguousarray(cells.view("<u4").T), bits], np.flatnonzero(~fits & ~self.null)
        return self.words[at]


def _one(text: bytes) -> int:
    return int(hashlib.md5(text).hexdigest()[:RANK_BITS // 4], 16)


def _first_bits(words: list) -> np.ndarray:
    """The first RANK_BITS bits of the md5 of blocks given as 16 words, each an array or one number."""
    n = len(words[14])
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    new, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=new)
            new &= b
            new ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=new)
            new &= d
            new ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=new)
            new ^= d
        else:
            np.invert(d, out=new)
            new |= b
            new ^= c
        new += a
        word = words[(_PLACES[kind][0] * i + _PLACES[kind][1]) % 16]
        if isinstance(word, np.ndarray):
            new += word
        elif word:
            new += word
        new += np.uint32(_ADDED[i])
        turn = _TURNS[kind][i % 4]
        np.left_shift(new, np.uint32(turn), out=turned)
        new >>= np.uint32(32 - turn)
        new |= turned
        new += b
        a, b, c, d, new = d, new, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    whole = (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()
    return whole >> np.uint64(64 - RANK_BITS)


def pack_rows(df: DataFrame) -> DataFrame:
    """The rows in blocks of up to AT_ONCE of a task, each an Arrow stream in column ``block``."""
    some = AT_ONCE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if held and (batch is None or sum(b.num_rows for b in held) + batch.num_rows > some):
                yield pa.RecordBatch.from_arrays([pa.array([to_stream(pa.Table.from_batches(held))], pa.binary())], ["block"])
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)
    return df.mapInArrow(pack, "block binary")


def to_stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of blocks made by :func:`pack_rows`."""
    for batch in batches:
        for block in batch.column(0):
            yield from pa.ipc.open_stream(block.as_buffer())
