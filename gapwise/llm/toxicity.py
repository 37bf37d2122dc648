"""Toxicity classifier, regularised by counterfactual texts.

First level: each distinct word of a text is its own feature together with its
byte 6-grams, hashed to a fixed number of weights, and a logistic model is
fitted to labelled texts.  For texts that name a group, a counterfactual twin
names another group of the same kind; the squared change of the score is
penalised, so that a mere mention earns no weight.  Second level: a text's
strongest word, three strongest and overall evidence are calibrated on labelled
texts that their first level did not see (each half of the sample is judged by
the other), because one insult in a long text must count as much as in a short
one.

The models are fitted on the driver on a bounded sample (``SAMPLE``); scoring
runs over all whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.store import slices, texts_of
from gapwise.llm.words import LOWER, prefix_sums, span_hashes, word_spans

DIMS = 1 << 18
GRAM = 6  #: bytes
SAMPLE = 10_000  #: labelled texts at most, nearly
PENALTY = 1.0  #: weight of the squared change under a swap
LEAST_TEXTS = 3  #: texts that a feature must occur in
THRESHOLD = 0.3

#: Identity terms by kind; a swap takes the next term of the same kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("americans", "germans", "french", "spaniards", "mexicans", "chinese"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_SWAP = {a.encode(): kind[(i + 1) % len(kind)].encode() for kind in IDENTITY_TERMS for i, a in enumerate(kind)}
_EDGE = b".,;:!?\"'()"


def counterfactual(text: bytes) -> bytes | None:
    """The text with every identity term swapped; None if it has none."""
    out, found = [], False
    for word in bytes(LOWER[np.frombuffer(text, np.uint8)]).split():
        bare = word.strip(_EDGE)
        if bare in _SWAP:
            word, found = word.replace(bare, _SWAP[bare]), True
        out.append(word)
    return b" ".join(out) if found else None


def word_features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed features of the distinct words, the word each belongs to, and the number of words."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    sums = prefix_sums(data)
    words = span_hashes(sums, starts, ends)
    words, first = np.unique(words, return_index=True)
    starts, grams = starts[first], np.maximum(ends[first] - starts[first] - GRAM + 1, 0)
    owner = np.repeat(np.arange(len(words)), grams)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + starts[owner]
    hashed = np.concatenate([words, span_hashes(sums, at, at + GRAM) ^ np.uint64(0x1234567)])
    return ((hashed % np.uint64(DIMS)).astype(np.int64),
            np.concatenate([np.arange(len(words)), owner]), len(words))


def evidence(text: bytes, weights: np.ndarray) -> list[float]:
    """The strongest word, the three strongest, and the mean pull of a text."""
    hashed, owner, count = word_features(text)
    if not count:
        return [0.0, 0.0, 0.0]
    pull = np.bincount(owner, weights=weights[hashed], minlength=count)
    top = np.sort(np.partition(pull, max(0, count - 3))[max(0, count - 3):])[::-1]
    return [float(top[0]), float(top.sum()), float(pull.sum() / math.sqrt(len(hashed)))]


def fit_words(texts: list[np.ndarray], twins: dict[int, np.ndarray], toxic: np.ndarray,
              rounds: int = 80, ridge: float = 1e-5) -> np.ndarray:
    """First-level weights (AdaGrad): log loss plus the counterfactual penalty."""
    n = max(1, len(texts))
    counts = np.bincount(np.concatenate(texts), minlength=DIMS) if texts else np.zeros(DIMS)
    frequent = counts >= LEAST_TEXTS
    texts = [t[frequent[t]] for t in texts]

    def flat(parts):
        sizes = np.array([len(p) for p in parts], np.int64)
        return (np.concatenate(parts) if len(parts) else np.zeros(0, np.int64),
                np.repeat(np.arange(len(parts)), sizes), 1 / np.sqrt(np.maximum(sizes, 1)))
    index, row, scale = flat(texts)
    numbers = np.array(sorted(twins), np.int64)
    t_index, t_row, t_scale = flat([twins[i][frequent[twins[i]]] for i in numbers])
    weights, bias, square, bias_square = np.zeros(DIMS), -2.0, np.full(DIMS, 1e-8), 1e-8
    for _ in range(rounds):
        raw = np.bincount(row, weights=weights[index], minlength=len(texts)) * scale
        error = 1 / (1 + np.exp(-(raw + bias))) - toxic
        pull = error.copy()
        gradient = ridge * weights
        if len(numbers):
            change = raw[numbers] - np.bincount(t_row, weights=weights[t_index], minlength=len(numbers)) * t_scale
            pull[numbers] += 2 * PENALTY * change
            gradient -= np.bincount(t_index, weights=(2 * PENALTY * change * t_scale)[t_row], minlength=DIMS) / n
        gradient += np.bincount(index, weights=(pull * scale)[row], minlength=DIMS) / n
        square += gradient ** 2
        weights -= gradient / np.sqrt(square)
        bias_square += error.mean() ** 2 if len(texts) else 0
        bias -= 0.5 * error.mean() / math.sqrt(bias_square) if len(texts) else 0
    weights[~frequent] = 0
    return weights


class Calibration:
    """Logistic regression on the three evidence values."""

    def __init__(self, rows: np.ndarray, toxic: np.ndarray):
        self.mean, self.scale = np.zeros(3), np.ones(3)
        self.theta = np.array([0.0, 0.0, 0.0, math.log((toxic.sum() + 1) / (len(toxic) - toxic.sum() + 1))])
        if 0 < toxic.sum() < len(toxic):
            self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-9
            z = self._design(rows)
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ self.theta, -30, 30)))
                hessian = z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(4)
                self.theta = self.theta - np.linalg.solve(hessian, z.T @ (p - toxic) + 1e-3 * self.theta)

    def _design(self, rows: np.ndarray) -> np.ndarray:
        return np.hstack([(rows - self.mean) / self.scale, np.ones((len(rows), 1))])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(rows) @ self.theta, -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, toxic, features, twin) of (level, toxic, text)."""
    for batch in slices(batches, 2):
        texts = texts_of(batch.column(2))
        own = [np.unique(word_features(t)[0]).astype(np.int32) for t in texts]
        twins = [None if (c := counterfactual(t)) is None else np.unique(word_features(c)[0]).astype(np.int32)
                 for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.int32())),
             pa.array(twins, pa.list_(pa.int32()))], ["level", "toxic", "own", "twin"])


def _evidence_of(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [evidence(t, weights) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                             [batch.schema.names[0], "evidence"])
    return run


def score(df: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(id, score, predicted) of every row of ``df``.

    The model learns from rows of ``labels`` (id and 0/1 label) where
    ``learn_from``, a condition on the id column, holds; only texts enter a
    score.  Null and empty texts get the score of no evidence.  Null labels and
    null ids teach nothing; rows that share an id share its label.  Without
    labels of both kinds every text gets the base rate.
    """
    known = labels.where(learn_from).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("long").alias("toxic")).where(
        "id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit(8), "id"), F.lit(1 << 20))
    picked = known.where(draw < math.ceil(share * (1 << 20))).withColumn("level", F.pmod(draw, F.lit(2)))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # the sample is bounded by its parameter, so its keys may be broadcast
    taught = docs.join(F.broadcast(picked), "id")
    seen = taught.select("level", "toxic", "text").mapInArrow(
        _features, "level long, toxic long, own array<int>, twin array<int>").toArrow()
    own = seen.column("own").combine_chunks()
    flat, ends = own.values.to_numpy(), own.offsets.to_numpy()
    texts = [flat[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:])]
    twins = {i: np.array(t, np.int64) for i, t in enumerate(seen.column("twin").to_pylist()) if t is not None}
    toxic, half = seen.column("toxic").to_numpy().astype(float), seen.column("level").to_numpy()

    def fitted(rows: np.ndarray) -> np.ndarray:
        place = {int(r): n for n, r in enumerate(rows)}
        return fit_words([texts[r] for r in rows], {place[i]: t for i, t in twins.items() if i in place},
                         toxic[rows]).astype(np.float32)
    # each half is judged by what the other half taught; scoring uses what both teach
    other = [fitted(np.flatnonzero(half != h)) for h in (0, 1)]
    weights = fitted(np.arange(len(texts)))
    second = [r for h in (0, 1) for r in taught.where(F.col("level") == h).select("toxic", "text").mapInArrow(
        _evidence_of(other[h]), "toxic long, evidence array<double>").collect()]
    model = Calibration(np.array([r["evidence"] for r in second]).reshape(-1, 3),
                        np.array([r["toxic"] for r in second], float))
    kind = dict(docs.dtypes)["id"]
    values = docs.mapInArrow(_evidence_of(weights), f"id {kind}, evidence array<double>")

    @F.pandas_udf("double")
    def calibrated(column: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(column.tolist()).reshape(-1, 3)))
    return values.select("id", calibrated("evidence").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
