"""Language of whole texts by n-gram filters that answer for all languages at once.

Each language has a Bloom filter of its most common character n-grams.  All
filters have one size and the same hash functions and are kept bit-sliced: a
position holds a mask with one bit for each language.  The masks at an n-gram's
positions, joined by AND, are the set of all languages that contain it.  A text
counts, for each language, the n-grams whose mask has the language's bit; what
that filter would answer by chance is taken off, and the highest count decides.

N-grams are taken inside words of letters and marks, lower-cased, with one
boundary at either end.  Languages are learned from at most about ``SAMPLE``
rows each, drawn by a hash of the text (a bound on the fit alone: every whole
text is judged), and n-grams are counted in Spark: what reaches the driver is
``GRAMS`` numbers a language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.store import bound_batches, only, slices
from gapwise.llm.words import mix

SIZES = (3, 4)  #: characters of an n-gram, boundaries included
GRAMS = 5_000  #: n-grams of a language in its filter, at most
SAMPLE = 4_000  #: rows that a language is learned from, nearly at most
HASHES, BITS = 3, 16  #: hash functions, and positions for each n-gram of the largest filter
SLICE = 4 << 20
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """2 for each letter, 1 for each mark, 0 for every other code point."""
    if not _kinds:
        first = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        _kinds.append(np.array([2 if c == "L" else 1 if c == "M" else 0 for c in first], np.uint8))
    return _kinds[0]


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of all n-grams of all texts, and which texts hold a letter."""
    joined = "\n".join(texts).lower()
    codes = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    # lower case may change a text's length, so texts are found by their line ends
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    kind = kinds()[codes]
    breaks = np.cumsum(codes == ord("\n")) - 1  # line number of each place; a line end opens its line
    owner = np.repeat(np.arange(len(texts)), lines)
    owner = np.append(owner, len(texts))[breaks]
    has = np.zeros(len(texts) + 1, bool)
    has[owner[kind == 2]] = True
    inside = kind > 0
    rest = inside | np.append(True, inside[:-1])  # one boundary after each word
    codes, inside, owner = np.where(inside, codes, 0)[rest].astype(np.uint64), inside[rest], owner[rest]
    hashes, owners, rolled, whole = [], [], codes + np.uint64(1), np.ones(len(codes), bool)
    for size in range(2, max(SIZES) + 1):
        if len(codes) < size:
            break
        rolled = rolled[:-1] * _BASE + codes[size - 1:]
        # all but the ends must be inside a word
        whole = whole[:-1] & inside[size - 2:-1] if size > 2 else np.ones(len(codes) - 1, bool)
        if size in SIZES:
            at = np.flatnonzero(whole)
            hashes.append(mix(rolled[at] + np.uint64(size)))
            owners.append(owner[at + 1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has[:-1]
    return np.concatenate(hashes), np.concatenate(owners), has[:-1]


class Filters:
    """Bit-sliced Bloom filters of all languages; plain arrays that pickle."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.languages = list(grams)
        self.words = max(1, -(-len(grams) // 64))
        most = max((len(g) for g in grams.values()), default=1)
        self.size = 1 << max(10, int(most * BITS - 1).bit_length())
        self.masks = np.zeros((self.words, self.size), np.uint64)
        for i, values in enumerate(grams.values()):
            bit = np.uint64(1) << np.uint64(i % 64)
            for at in self.places(values):
                self.masks[i // 64, at] |= bit
        filled = [np.count_nonzero(self.bit(self.masks, i)) / self.size for i in range(len(grams))]
        #: chance that a filter holds an n-gram it was never given
        self.chance = np.array(filled) ** HASHES

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((hashes + np.uint64(k) * step) & np.uint64(self.size - 1)).astype(np.int64)

    @staticmethod
    def bit(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def holders(self, hashes: np.ndarray) -> np.ndarray:
        """The mask of the languages that contain each n-gram."""
        held = None
        for at in self.places(hashes):
            some = self.masks[:, at]
            held = some if held is None else held & some
        return held

    def counts(self, hashes: np.ndarray, owners: np.ndarray, texts: int) -> np.ndarray:
        """N-grams of each text (row) in each language (column), less what chance adds."""
        masks, total = self.holders(hashes), np.bincount(owners, minlength=texts)
        out = np.empty((texts, len(self.languages)))
        for i, chance in enumerate(self.chance):
            found = np.bincount(owners, self.bit(masks, i).astype(np.float64), minlength=texts)
            out[:, i] = np.maximum(found - total * chance, 0) / (1 - chance)
        return out


def learn(taught: DataFrame, sample: int = SAMPLE, grams: int = GRAMS) -> Filters:
    """Filters from (text, lang); languages by their number of rows, then by name."""
    taught = taught.where("lang is not null and text is not null")
    rows = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(rows, key=lambda name: (-rows[name], name))
    if not names:
        return Filters({})
    rates = F.create_map([F.lit(v) for name in names for v in (name, min(1.0, sample / rows[name]))])
    draw = (F.xxhash64("text") / F.lit(2.0 ** 64)) + F.lit(0.5)
    drawn = taught.where(draw <= rates[F.col("lang")]).select("text", "lang")
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, SLICE):
            hashes, owners, _ = grams_of(batch.column(0).to_pylist())
            languages = np.array([number[x] for x in batch.column(1).to_pylist()])[owners]
            order = np.lexsort((hashes, languages))
            hashes, languages = hashes[order], languages[order]
            head = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (languages[1:] != languages[:-1]))[:len(order)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(languages[head], pa.int32()), pa.array(hashes[head].view(np.int64)),
                 pa.array(np.diff(np.append(head, len(order))))], ["language", "gram", "n"])
    counted = drawn.mapInArrow(count, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram"))
    best = counted.withColumn("place", place).where(F.col("place") <= grams).select("language", "gram").toArrow()
    languages, values = best.column(0).to_numpy(), best.column(1).to_numpy().view(np.uint64)
    return Filters({name: values[languages == i] for i, name in enumerate(names)})


def identify(df: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             keep_cols: dict[str, Column] | None = None) -> DataFrame:
    """(id, lang_pred, score) of every row; ``keep_cols`` adds columns computed from its id.

    ``learn_from`` says, of an id, whether a row's language may be learned; rows
    without text or language never teach.  ``lang_pred`` is the learned language
    with the highest corrected count; ties go to the one with more rows, then
    to the smaller name, and a text whose n-grams no filter holds gets the most
    common language.  A text that is null or has no letter is ``und``, as is
    every text when nothing is learned.  ``score`` is the winner's part of all
    corrected counts (0 where there are none).  Repeated rows stay; other
    columns are not read.
    """
    bound_batches(df.sparkSession)
    rows = only(df, id=id_col, text=text_col, lang=lang_col)
    filters = learn(rows.where(learn_from).select("text", "lang"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = np.array([*filters.languages, UNDETERMINED], object)
        for batch in slices(batches, 1, SLICE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            hashes, owners, has = grams_of(texts)
            picked, score = np.full(len(texts), -1), np.zeros(len(texts))
            if filters.languages:
                counts = filters.counts(hashes, owners, len(texts))
                picked = np.where(has, counts.argmax(axis=1), -1)
                total = counts.sum(axis=1)
                score = np.where(has & (total > 0), counts.max(axis=1) / np.where(total > 0, total, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages[picked], pa.string()), pa.array(score)], ["id", "lang_pred", "score"])
    judged = rows.select("id", "text").mapInArrow(judge, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")
    return judged.select("id", *[c.alias(n) for n, c in (keep_cols or {}).items()], "lang_pred", "score")
