"""Two tokenizers aligned on the bytes that both end at, and how often their ids meet.

The cumulative ends of either side's tokens become a dictionary from end to
number of tokens; the sorted intersection of the two key sets cuts both id
lists into groups, and every pair of ids inside a group is a link.

Texts are cut first where both tokenizers must end a token whatever stands
around: before a single blank or line end between two characters that are no
white space.  Each different piece is then aligned once for a worker (two bounded
generations are remembered), and a text's groups are those of its pieces in a
row.  That needs a byte-level tokenizer with the usual split pattern and a piece
vocabulary whose blank marks only begin pieces; with others a text is one piece.

An id pair's count is the number of rows that hold it.  Rows are packed into
blocks of some megabytes: a block sends each of its different pairs once with
the number of its rows, the sums come back to the blocks, and a block's rows
read them by position.  What is shuffled is blocks x different pairs, and no
pair, however common, has more rows than there are blocks.

Tokenizer files are read where the session runs and travel with the tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.store import bound_batches, keep, only, slices

SPACE = "▁"
MEMO = 200_000  #: pieces in each of the two generations that a worker remembers
LONGEST = 64  #: characters of a piece worth remembering
SLICE = 8 << 20  #: bytes of text in a block
ASKED = 512  #: pieces given to the tokenizers at a time
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_CLOSE = f"{_WHITE}{_WHITE}|^{_WHITE}|{_WHITE}$"  #: white space beside white space or a text's end
_BLANK = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """A byte-level tokenizer (JSON text) and a piece tokenizer (model bytes), with their tables."""

    def __init__(self, byte_level: str, pieces: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(SPACE, " ").encode()
                        for i, n in enumerate(names)]
        for i in range(len(names)):
            if self.b.is_control(i) or self.b.is_unknown(i):
                self.bytes_b[i] = b""
        self.sizes_a, self.sizes_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        split = json.loads(byte_level).get("pre_tokenizer") or {}
        normal = [n for i, n in enumerate(names) if not self.b.is_byte(i)]
        self.cuts = (split.get("type") == "ByteLevel" and split.get("use_regex", True)
                     and not any(SPACE in n.lstrip(SPACE) or "\n" in n for n in normal)
                     and self.spelt("\na")[1][:1] == [b"\n"])
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def spelt(self, chunk: str) -> tuple[list[bytes], list[bytes]]:
        """The bytes of a chunk's tokens on both sides."""
        a, b = self.encoded(chunk)
        return [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]

    def encoded(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids of a chunk, a blank or line end and what follows, on both sides.

        The piece tokenizer writes a blank before every text: it stands for the
        chunk's own, and before a line end it is taken off.
        """
        a = self.a.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
        if chunk[0] != "\n":
            return a, self.b.encode(chunk[1:])
        b = self.b.encode(chunk)
        return a, b[1:] if b and self.bytes_b[b[0]] == b" " else b

    def lossless(self, raw: bytes, ids_a: list[int], ids_b: list[int]) -> bool:
        return (b"".join([self.bytes_a[i] for i in ids_a]) == raw
                and b"".join([self.bytes_b[i] for i in ids_b]) == raw)

    def cuts_of(self, ids_a: list[int], ids_b: list[int]) -> tuple[list[int], list[int], list[int]]:
        """(ends, tokens of a, tokens of b) at every byte where a token of both ends."""
        at_a = dict(zip(accumulate([self.sizes_a[i] for i in ids_a]), count(1)))
        at_b = dict(zip(accumulate([self.sizes_b[i] for i in ids_b]), count(1)))
        ends = sorted(at_a.keys() & at_b.keys())
        return ends, [at_a[e] for e in ends], [at_b[e] for e in ends]

    def aligned(self, chunks: list[str]) -> list[tuple | None]:
        """For each chunk (groups as text, tokens a, tokens b, groups, linked pairs as bytes).

        None where a side does not spell the chunk.  The chunks are read as one
        text, so both sides must end a token at the end of each.
        """
        text = "".join(chunks)
        flat_a, flat_b = self.encoded(text)
        if not self.lossless(text.encode(), flat_a, flat_b):
            half = len(chunks) // 2
            return self.aligned(chunks[:half]) + self.aligned(chunks[half:]) if half else [None]
        ends, cut_a, cut_b = self.cuts_of(flat_a, flat_b)
        from_a, from_b = [0, *cut_a[:-1]], [0, *cut_b[:-1]]
        name_a, name_b = [self.names[i] for i in flat_a], [self.names[i] for i in flat_b]
        spelt = [name_a[i] + "|" + name_b[j] if k - i == 1 and m - j == 1
                 else ",".join(name_a[i:k]) + "|" + ",".join(name_b[j:m])
                 for i, k, j, m in zip(from_a, cut_a, from_b, cut_b)]
        start_a, start_b = np.array(from_a, np.int64), np.array(from_b, np.int64)
        wide_b = np.array(cut_b, np.int64) - start_b
        links = (np.array(cut_a, np.int64) - start_a) * wide_b
        total = np.concatenate([[0], np.cumsum(links)])
        group = np.repeat(np.arange(len(links)), links)
        k = np.arange(total[-1]) - total[group]
        pairs = ((np.array(flat_a, np.int64)[start_a[group] + k // wide_b[group]] << 32)
                 | np.array(flat_b, np.int64)[start_b[group] + k % wide_b[group]]).tobytes()
        last = np.searchsorted(np.array(ends), np.cumsum([len(c.encode()) for c in chunks]), "right")
        tokens_a, tokens_b = np.array(cut_a)[last - 1].tolist(), np.array(cut_b)[last - 1].tolist()
        out, g, p, x, y = [], 0, 0, 0, 0
        for h, q, i, j in zip(last.tolist(), (8 * total[last]).tolist(), tokens_a, tokens_b):
            out.append((";".join(spelt[g:h]), i - x, j - y, h - g, pairs[p:q]))
            g, p, x, y = h, q, i, j
        return out

    def entries(self, keys: list[str]) -> list[tuple | None]:
        """The entry of every key; see :func:`pieces_of` for what a key stands for."""
        out, missing = [], []
        for at, key in enumerate(keys):
            known = self.memo.get(key, self)
            if known is self and (known := self.older.get(key, self)) is not self:
                self.remember(key, known)
            if known is self:
                missing.append(at)
            out.append(known)
        chunks = [k if k[0] in " \n" else " " + k for k in (keys[at] for at in missing)]
        # one with white space beside white space or at its end may read differently in a row: alone
        close = [c[1:2].isspace() or c[-1].isspace() for c in chunks]
        rows = [[n] for n, alone in enumerate(close) if alone]
        plain = [n for n, alone in enumerate(close) if not alone]
        for row in chain(rows, (plain[i:i + ASKED] for i in range(0, len(plain), ASKED))):
            for n, entry in zip(row, self.aligned([chunks[n] for n in row])):
                out[missing[n]] = entry
                if len(chunks[n]) <= LONGEST:
                    self.remember(keys[missing[n]], entry)
        return out

    def remember(self, key: str, entry: tuple | None) -> None:
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        self.memo[key] = entry


def pieces_of(texts: pa.StringArray, cuts: bool) -> tuple[pa.StringArray, np.ndarray]:
    """(keys of the pieces of all texts in a row, offsets of each text).

    A key is its piece without the blank before it; one that begins with a
    blank or a line end is the whole piece itself.
    """
    texts = pc.fill_null(texts, "")
    close = pc.match_substring_regex(texts, _CLOSE) if cuts else pa.array([True] * len(texts))
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    if not pc.any(pc.or_(close, pc.equal(texts, ""))).as_py():
        return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    parts, counts = [], []
    for start, end, special in _stretches(np.asarray(pc.or_(close, pc.equal(texts, "")))):
        if not special:
            some = lists.slice(start, end - start)
            parts.append(some.flatten())
            counts.extend(pc.list_value_length(some).to_pylist())
            continue
        for text in texts.slice(start, end - start).to_pylist():
            cut = [] if not text else _BLANK.split(text) if cuts else [" " + text]
            keys = [" " + p if cuts and p[0] in " \n" else p for p in cut]
            parts.append(pa.array(keys, pa.string()))
            counts.append(len(keys))
    return pa.concat_arrays(parts), np.cumsum([0, *counts])


def _stretches(marks: np.ndarray) -> Iterator[tuple[int, int, bool]]:
    ends = np.append(np.flatnonzero(marks[1:] != marks[:-1]) + 1, len(marks))
    start = 0
    for end in ends.tolist():
        if end > start:
            yield start, end, bool(marks[start])
        start = end


_aligners: dict[bytes, Aligner] = {}


def _aligner(byte_level: str, pieces: bytes) -> Aligner:
    """One aligner for each worker, so that its memory outlives a task."""
    name = hashlib.blake2b(byte_level.encode() + pieces, digest_size=16).digest()
    if name not in _aligners:
        _aligners.clear()
        _aligners[name] = Aligner(byte_level, pieces)
    return _aligners[name]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _block(aligner: Aligner, texts: pa.StringArray) -> dict:
    """One block: figures of each text, the block's different pairs, and each text's pairs by position."""
    keys, offsets = pieces_of(texts, aligner.cuts)
    coded = keys.dictionary_encode()
    codes = coded.indices.to_numpy()
    entries = aligner.entries(coded.dictionary.to_pylist())
    bad = np.array([e is None for e in entries], bool)
    entries = [e or ("", 0, 0, 0, b"") for e in entries]
    spelt = [e[0] for e in entries]
    n_a, n_b, n_groups = (np.array([e[i] for e in entries], np.int64) for i in (1, 2, 3))
    held = np.array([len(e[4]) // 8 for e in entries], np.int64)
    good = (_sums(bad[codes], offsets) == 0) & (np.diff(offsets) > 0)
    digests = []
    for fine, low, high in zip(good.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        text = ";".join([spelt[c] for c in codes[low:high].tolist()]) if fine else ""
        digests.append(hashlib.sha256(text.encode()).hexdigest() if fine else "")
    # the pairs of each text with the number of times it holds them
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    fine = good[text]
    width = max(1, len(entries))
    used, times = np.unique(text[fine] * width + codes[fine], return_counts=True)
    owner, code = used // width, used % width
    flat = np.frombuffer(b"".join([e[4] for e in entries]), np.int64)
    names, flat = np.unique(flat, return_inverse=True)
    first = np.cumsum(held) - held
    ends = np.cumsum(held[code])
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - held[code], held[code]) + np.repeat(first[code], held[code])
    size = max(1, len(names))
    cell = np.repeat(owner, held[code]) * size + flat[at]
    order = np.argsort(cell, kind="stable")
    cell, weight = cell[order], np.repeat(times, held[code])[order]
    head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[:len(cell)])
    weight = np.add.reduceat(weight, head) if len(head) else weight
    cell = cell[head]
    pair, rows = cell % size, np.bincount(cell // size, minlength=len(texts))
    docs = np.bincount(pair, minlength=size)
    there = np.flatnonzero(docs)
    place = np.cumsum(docs > 0) - 1
    zero = lambda values: np.where(good, _sums(values[codes], offsets), 0)
    return {"n_a": zero(n_a), "n_b": zero(n_b), "n_groups": zero(n_groups), "n_links": zero(held),
            "groups_sha256": digests, "pairs": names[there] if len(names) else names, "docs": docs[there],
            "held": rows, "at": _packed(place[pair]), "times": _packed(weight)}


def _packed(numbers: np.ndarray) -> bytes:
    raw = numbers.astype(np.uint32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd"), np.uint32) if size else np.zeros(0, np.uint32)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(rows: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    lists = [*FIGURES, "groups_sha256", "pairs", "docs", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _aligner(byte_level, pieces), TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, 1, SLICE)):
            ids = batch.column(0)
            made = _block(aligner, batch.column(1).cast(pa.string()))
            kinds = {"groups_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 *[pa.array([made[n]], pa.list_(kinds.get(n, pa.int64()))) for n in lists],
                 pa.array([made["at"]], pa.binary()), pa.array([made["times"]], pa.binary())],
                ["block", "ids", *lists, "at", "times"])
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, " + ", ".join(
        f"{n} array<{'string' if n == 'groups_sha256' else 'long'}>" for n in lists) + ", at binary, times binary")


def align(df: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Both tokenizers read a blank and the whole text, special tokens as plain
    text.  ``n_links`` counts all id pairs inside groups, ``count_sum`` adds up
    for them how many rows hold that pair, ``n_best`` counts those whose count
    is the highest of their first id, ties included.  The digest is that of
    :func:`spell`.  A text that is null or empty, or that either side does not
    spell to the byte, has zeros and an empty digest and links nothing.  Each
    row counts as one document, repeated rows and ids included; other columns
    are not read.
    """
    bound_batches(df.sparkSession)
    rows = only(df, id=id_col, text=text_col)
    with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
        kept = keep(_blocks(rows, a.read(), b.read()), "aligned")
    pairs = kept.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "p")).select(
        "block", "place", F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs"))
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("first")).agg(F.max("count").alias("most"))
    known = counts.withColumn("first", F.shiftright("pair", 32)).join(best, "first").select(
        "pair", (2 * F.col("count") + (F.col("count") == F.col("most")).cast("long")).alias("code"))
    # a block has as many elements as different pairs: bounded by the slice it was made from
    told = pairs.select("block", "place", "pair").join(known, "pair").groupBy("block").agg(
        F.collect_list(F.struct("place", "code")).alias("told"))
    joined = kept.select("block", "ids", *FIGURES, "groups_sha256", "held", "at", "times").hint("merge").join(
        told, "block", "left").drop("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                ids, told = row["ids"].values, row["told"].values
                figures = [row[n].values for n in FIGURES]
                code = np.zeros(0 if told is None else len(told), np.int64)
                if told is not None:
                    code[told.field(0).to_numpy()] = told.field(1).to_numpy()
                at, times = _unpacked(row["at"].as_py()), _unpacked(row["times"].as_py()).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(row["held"].values.to_numpy())])
                n_best = _sums(times * (code[at] & 1), offsets)
                total = _sums(times * (code[at] >> 1), offsets)
                yield pa.RecordBatch.from_arrays(
                    [ids, *figures, pa.array(n_best), pa.array(total), row["groups_sha256"].values],
                    ["id", *FIGURES, "n_best", "count_sum", "groups_sha256"])
    kind = dict(rows.dtypes)["id"]
    return joined.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                  "count_sum long, groups_sha256 string")


def spell(df: DataFrame, byte_level_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): the groups of every row as ``a1,a2|b1;a3|b2,b3``; empty where there are no tokens."""
    bound_batches(df.sparkSession)
    rows = only(df, id=id_col, text=text_col)
    with open(byte_level_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
        byte_level, pieces = a.read(), b.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_level, pieces)
        for batch in slices(batches, 1, SLICE):
            keys, offsets = pieces_of(batch.column(1).cast(pa.string()), aligner.cuts)
            entries = aligner.entries(keys.to_pylist())
            spelt = ["" if None in entries[a:b] else ";".join([e[0] for e in entries[a:b]])
                     for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelt, pa.string())], ["id", "groups"])
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, groups string")
