"""Passages that repeat across documents: content-defined chunks, one digest each.

A gear hash rolls over the bytes of a text; a word start where its bits meet
the mask may begin a new chunk.  A boundary depends on the few bytes before it
and on nothing else, so an insertion moves only the chunks that it touches and
equal passages fall into equal chunks wherever they stand.  Successive chunks
that just make up a passage are a stretch with a digest of its own.  The first
place of a stretch (least id, then position) owns it; the same stretch elsewhere
is a copy and cut out.  So each removed word belongs to a whole passage that
stands in one earlier place, and short common phrases stay, also side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.store import bound_batches, keep, only, slices, texts_of
from gapwise.llm.words import BYTE_VALUES, LOWER, mix, powers, prefix_sums, span_hashes, word_spans

WINDOW = 16  #: bytes that a boundary depends on
MASK_BITS = 2  #: one word start in four may begin a chunk
LEAST_WORDS, MOST_WORDS = 4, 64  #: of a chunk
PASSAGE_WORDS = 16  #: copied stretches shorter than this are left alone

_GEAR = (BYTE_VALUES >> np.uint64(48)).astype(np.uint16)
_MASK = np.uint16(((1 << MASK_BITS) - 1) << (WINDOW - MASK_BITS))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: h = 2 h + gear[byte]."""
    values = _GEAR[data]
    rolled = values.copy()
    for age in range(1, min(WINDOW, len(data))):
        rolled[age:] += values[:-age] << np.uint16(age)
    return rolled


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> list[int]:
    """Numbers of the words that begin a chunk."""
    if not len(starts):
        return []
    rolled = gear_hashes(data)
    open_ = (starts > 0) & ((rolled[np.maximum(starts - 1, 0)] & _MASK) == 0)
    chosen, last = [0], 0
    for word in np.flatnonzero(open_).tolist():
        while word - last > MOST_WORDS:
            last += MOST_WORDS
            chosen.append(last)
        if word - last >= LEAST_WORDS:
            chosen.append(word)
            last = word
    while len(starts) - last > MOST_WORDS:
        last += MOST_WORDS
        chosen.append(last)
    return chosen


def chunks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, word counts and digests of a text's chunks.

    The digest covers the words of the chunk up to the end of its last word,
    case and white space as they are except that A-Z count as a-z.
    """
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = word_spans(data)
    first = np.array(chunk_starts(data, starts), np.int64)
    if not len(first):
        return first, first, np.zeros(0, np.uint64)
    after = np.append(first[1:], len(starts))
    return starts[first], after - first, span_hashes(prefix_sums(data), starts[first], ends[after - 1])


def stretches(words: np.ndarray, digests: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, chunk after the last, and digest of the shortest stretches of ``least`` words.

    One begins and one ends at each chunk where the text has room, so that those
    inside any longer run of chunks cover all of it.
    """
    sums = np.append(0, np.cumsum(words))
    count = len(words)
    until = np.searchsorted(sums, sums[:-1] + least)
    first = np.flatnonzero(until <= count)
    since = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    last = np.flatnonzero(since >= 0)
    other = last[until[since[last]] != last + 1]
    begin, end = np.append(first, since[other]), np.append(until[first], other + 1)
    rolled = np.append(np.uint64(0), np.cumsum(digests * powers(count), dtype=np.uint64))
    raw = (rolled[end] - rolled[begin]) * powers(count + 1, inverse=True)[begin]
    return begin, end, mix(raw + (end - begin).astype(np.uint64)).view(np.int64)


def stretch_table(docs: DataFrame, least: int) -> DataFrame:
    """(digest, id, seq, n) of every shortest stretch of ``least`` words: its first chunk and number of chunks."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [stretches(*chunks(text)[1:], least) for text in texts_of(batch.column(1))]
            begin, end, digests = (np.concatenate(part) for part in zip(*found))
            owner = np.repeat(np.arange(batch.num_rows), [len(f[0]) for f in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests), batch.column(0).take(pa.array(owner)), pa.array(begin.astype(np.int32)),
                 pa.array((end - begin).astype(np.int32))], ["digest", "id", "seq", "n"])
    return docs.mapInArrow(cut, "digest long, id long, seq int, n int")


def copied_stretches(docs: DataFrame, least: int) -> DataFrame:
    """(id, copies): each document's stretches that another place owns, with the owner's id.

    In one text a copy begins after the end of the first.
    """
    table = stretch_table(docs, least)
    place = F.struct("id", "seq")
    owners = table.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        "first != last").select("digest", "first")
    copies = table.join(owners, "digest").where("id != first.id or seq >= first.seq + n")
    return copies.groupBy("id").agg(F.collect_list(
        F.struct("seq", "digest", F.col("first.id").alias("owner"))).alias("copies"))


def cut_runs(text: bytes, copies: dict[tuple[int, int], int], least: int) -> tuple[bytes, int, int, set[int]]:
    """The text without its copied stretches, words removed, runs removed, their owners.

    ``copies`` has the owner by first chunk and digest, so that a stretch of
    another text with the same id is never taken for one of this text.
    """
    starts, words, digests = chunks(text)
    copied, owners = np.zeros(len(starts) + 1, bool), set()
    for begin, end, digest in zip(*(part.tolist() for part in stretches(words, digests, least))):
        if (begin, digest) in copies:
            copied[begin:end] = True
            owners.add(copies[begin, digest])
    edges = np.flatnonzero(np.diff(copied, prepend=False)).reshape(-1, 2).tolist()
    out, at = [], 0
    for begin, end in edges:
        out.append(text[at:starts[begin]])
        at = starts[end] if end < len(starts) else len(text)
    out.append(text[at:])
    return b"".join(out), int(words[copied[:-1]].sum()), len(edges), owners


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per document: id, text, n_removed, n_passages, first_ids, before; all other columns unread.

    ``text`` lacks every passage of ``passage_words`` or more words that stands
    earlier in the corpus in one place (less id, or earlier in the same text); ``n_removed``
    counts the removed words and ``first_ids`` lists the documents that keep
    them.  Null texts stay null and texts without words stay as they are.  Rows
    with a null id are returned unchanged.  Rows that share an id are each
    cleaned of the copies found in their own text; ``before``, a hash of the
    text as it was, tells them apart.
    """
    bound_batches(df.sparkSession)
    docs = only(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    found = keep(copied_stretches(docs.where("id is not null"), passage_words), "copies")
    rows = docs.join(found, "id", "left").select("id", "text", "copies.seq", "copies.digest", "copies.owner",
                                                 F.xxhash64("text").alias("before"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts, removed, passages, firsts = batch.column(1).to_pylist(), [], [], []
            seqs, digests, owners = batch.column(2), batch.column(3), batch.column(4)
            for i, text in enumerate(texts):
                count, runs, from_ = 0, 0, set()
                if text is not None and seqs[i].is_valid:
                    copies = dict(zip(zip(seqs[i].as_py(), digests[i].as_py()), owners[i].as_py()))
                    rest, count, runs, from_ = cut_runs(text.encode(), copies, passage_words)
                    texts[i] = rest.decode()
                removed.append(count)
                passages.append(runs)
                firsts.append(sorted(from_))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64()),
                 pa.array(passages, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                 batch.column(5)], ["id", "text", "n_removed", "n_passages", "first_ids", "before"])
    return rows.mapInArrow(
        clean, "id long, text string, n_removed long, n_passages long, first_ids array<long>, before long")
