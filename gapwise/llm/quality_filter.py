"""Quality classifier with hierarchical empirical Bayes over sites and paths.

A logistic model on a few measures of the whole text gives each document's own
evidence.  Labelled outcomes of a site, and of a path inside it, add what is
known about the place: beta-binomial posteriors shrink from the global rate to
the site and from the site to the path, with prior strengths estimated from the
spread between groups.  Sparse sites stay near the global rate.  Both kinds of
evidence add up in log-odds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.llm.store import bound_batches, slices, texts_of
from gapwise.llm.words import BLANK, LOWER, prefix_sums, span_hashes, word_spans

SAMPLE = 20_000  #: labelled rows at most, nearly, that the text model is fitted on
MEASURES = 9
_KIND = np.zeros(256, np.int8)
_KIND[128:] = 1
_KIND[[*range(ord("a"), ord("z") + 1)]] = 1
_KIND[[*range(ord("A"), ord("Z") + 1)]] = 2
_KIND[[*range(ord("0"), ord("9") + 1)]] = 3
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_KIND[BLANK] = 4


def measures(text: bytes) -> np.ndarray:
    """Shares of symbols, capitals, digits and punctuation; repetition; length and shape of words."""
    data = np.frombuffer(text, np.uint8)
    folded = LOWER[data]
    starts, ends = word_spans(folded)
    if not len(starts):
        return np.zeros(MEASURES)
    kinds = np.bincount(_KIND[data], minlength=6) / len(data)
    _, counts = np.unique(span_hashes(prefix_sums(folded), starts, ends), return_counts=True)
    sizes = ends - starts
    return np.array([kinds[0], kinds[2], kinds[3], kinds[5], len(counts) / len(starts), counts.max() / len(starts),
                     math.log1p(len(starts)) / 5, sizes.mean() / 10, (sizes <= 3).mean()])


def measured(df: DataFrame, text_col: str, model: TextModel | None = None) -> DataFrame:
    """``df`` without its text, with the measures of it or, given a model, their log-odds ``own``."""
    at = df.columns.index(text_col)
    others = [(n, t) for n, t in df.dtypes if n != text_col]
    name, kind = ("measures", "array<double>") if model is None else ("own", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            rows = [measures(t) for t in texts_of(batch.column(at))]
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            made = pa.array(rows, pa.list_(pa.float64())) if model is None else pa.array(
                np.asarray(model.log_odds(np.array(rows).reshape(-1, MEASURES)), float))
            yield pa.RecordBatch.from_arrays([*columns, made], [n for n, _ in others] + [name])
    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in others) + f", {name} {kind}")


def _expanded(rows: np.ndarray) -> np.ndarray:
    low = np.minimum(rows, 5)
    return np.hstack([low, np.sqrt(low), low ** 2])


class TextModel:
    """Standardised logistic regression, fitted by Newton's method."""

    def __init__(self, rows: np.ndarray, good: np.ndarray):
        self.base = math.log((good.sum() + 1) / (len(good) - good.sum() + 1))
        self.mean, self.scale, self.weights = np.zeros(3 * MEASURES), np.ones(3 * MEASURES), np.zeros(3 * MEASURES + 1)
        self.weights[-1] = self.base
        if 0 < good.sum() < len(good):
            wide = _expanded(rows)
            self.mean, self.scale = wide.mean(0), wide.std(0) + 1e-9
            z = self._design(rows)
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                hessian = z.T @ (z * (p * (1 - p))[:, None]) + 0.1 * np.eye(z.shape[1])
                self.weights = self.weights - np.linalg.solve(hessian, z.T @ (p - good) + 0.1 * self.weights)

    def _design(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((_expanded(rows) - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.ones((len(z), 1))])

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(self._design(rows) @ self.weights, -30, 30)


def prior_strength(groups: DataFrame) -> float:
    """Prior weight in rows: the moment estimate from groups (n, good) of one level.

    From the variance between and within groups of binary outcomes; between 1
    and 1000, and 1000 where the groups show no spread.
    """
    n, k = F.col("n").cast("double"), F.col("good").cast("double")
    s = groups.agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"),
                   F.sum(k * k / n).alias("kk")).first()
    if not s.n or s.g < 2 or s.n <= s.g:
        return 1000.0
    mean = s.k / s.n
    between = max(0.0, s.kk - s.n * mean * mean) / (s.g - 1)
    within = max(0.0, s.k - s.kk) / (s.n - s.g)
    size = (s.n - s.nn / s.n) / (s.g - 1)
    rho = (between - within) / (between + (size - 1) * within) if between + (size - 1) * within > 0 else 0.0
    return min(1000.0, max(1.0, (1 - rho) / rho)) if rho > 0 else 1000.0


def place_posteriors(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Posterior means of (site, path, good): per site, per path, and the global rate."""
    paths = outcomes.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = sites.agg(F.sum("n"), F.sum("good")).first()
    rate = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    site_weight, path_weight = prior_strength(sites), prior_strength(paths)
    site = sites.select("site", ((F.col("good") + site_weight * rate) / (F.col("n") + site_weight)).alias("site_rate"))
    path = paths.join(site, "site").select("site", "path", (
        (F.col("good") + path_weight * F.col("site_rate")) / (F.col("n") + path_weight)).alias("path_rate"))
    return site, path, rate


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          site: Column | None = None, path: Column | None = None, label_col: str = "quality",
          least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(id, text_score, place_rate, score, kept) of each row.

    ``labels`` has the id and a 0/1 label for some rows; null labels count as
    unlabelled.  ``site`` and ``path`` default to the columns source and lang;
    null is a place like any other.  ``score`` is the probability that the
    document is good and ``kept`` says that it reaches ``least``.  Texts that
    are null or have no words are judged as having no measures.  Repeated rows
    are judged alike; a null id is never labelled.
    """
    bound_batches(df.sparkSession)
    site = F.col("source") if site is None else site
    path = F.col("lang") if path is None else path
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                     F.coalesce(site.cast("string"), F.lit("\0")).alias("site"),
                     F.coalesce(path.cast("string"), F.lit("\0")).alias("path"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("long").alias("good")).where(
        "id is not null and good in (0, 1)").groupBy("id").agg(F.min("good").alias("good"))
    count = known.count()
    share = min(1.0, sample / max(1, count))
    picked = known.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    # the sample is bounded by its parameter, so its keys may be broadcast
    rows = measured(docs.join(F.broadcast(picked), "id").select("text", "good"), "text").collect()
    model = TextModel(np.array([r["measures"] for r in rows]).reshape(-1, MEASURES),
                      np.array([r["good"] for r in rows], float))
    per_site, per_path, rate = place_posteriors(docs.select("id", "site", "path").join(known, "id"))
    base = math.log(rate / (1 - rate))
    scored = measured(docs, "text", model)
    scored = (scored.join(per_path, ["site", "path"], "left").join(per_site, ["site"], "left")
              .withColumn("place_rate", F.coalesce("path_rate", "site_rate", F.lit(rate))))
    odds = F.col("own") + F.log(F.col("place_rate") / (1 - F.col("place_rate"))) - F.lit(base)
    text_score = 1 / (1 + F.exp(-F.col("own")))
    return scored.select("id", text_score.alias("text_score"), "place_rate",
                         (1 / (1 + F.exp(-odds))).alias("score")).withColumn("kept", F.col("score") >= least)
