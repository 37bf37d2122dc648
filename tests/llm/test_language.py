"""Language filters against plain sets, and on held-out rows."""

import unicodedata
import zlib

import numpy as np
from pyspark.sql import functions as F

from gapwise.llm import language_id
from gapwise.llm.language_id import Filters, grams_of, identify
from gapwise.llm.queries import QUERIES


def plain_grams(text):
    """The n-grams of one text as strings, one place after another."""
    words, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words.append(f" {word} ")
            word = ""
    return [w[i:i + n] for n in language_id.SIZES for w in words for i in range(len(w) - n + 1)]


TEXTS = ["", "a", "Ab\nCd ef", "x1y", "ÉCOLE İstanbul", "日本語", "12 34!", "हिन्दी भाषा", "\n\n", "straße\tΣΑΣ", "ab" * 200]


def test_grams_equal_a_plain_walk():
    hashes, owners, has = grams_of(TEXTS)
    names = {}
    for i, text in enumerate(TEXTS):
        want = plain_grams(text)
        got = hashes[owners == i].tolist()
        assert len(got) == len(want)
        for g, h in zip(want, got):
            assert names.setdefault(g, h) == h
    assert len(set(names.values())) == len(names)
    assert has.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]


def test_filters_answer_for_all_languages_at_once():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2 ** 63, 200 * 300, dtype=np.uint64).reshape(200, 300)
    filters = Filters({f"l{i}": values[max(0, i - 1):i + 1].ravel() for i in range(200)})  # neighbours share
    assert filters.words == 4
    held = filters.holders(values.ravel())
    for i in range(200):
        has = Filters.bit(held, i).reshape(200, 300).astype(bool)
        assert has[max(0, i - 1):i + 1].all()
        assert abs(np.delete(has, [i, i - 1], 0).mean() - filters.chance[i]) < 0.005
    strange = rng.integers(0, 2 ** 63, 40_000, dtype=np.uint64)
    counts = filters.counts(strange, np.zeros(40_000, np.int64), 1)
    assert counts.max() < 100  # false positives are taken off


def test_edge_rows(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(
        [("the house and the tree", "en"), ("das haus und der baum", "de"), ("the the", None), (None, "fr"), ("der der", "de"),
         ("das und", "de")] * 3)]
    rows += [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "12 - 3", "en", "s", 0), (None, "the tree", "en", "s", 0),
             (93, "qqqq", "en", "s", 0), (94, "the tree " * 50_000, "de", "s", 0), (94, "das haus", "de", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score int")
    got = [(r["id"], r["lang_pred"]) for r in identify(df, F.col("id") < 90).collect()]
    assert len(got) == len(rows)
    found = dict(got[18:22] + got[22:23])
    assert found[90] == found[91] == found[92] == "und" and found[None] == "en" and found[93] == "de"
    assert sorted(x for i, x in got if i == 94) == ["de", "en"]
    assert {r["lang_pred"] for r in identify(df, F.lit(False)).collect()} == {"und"}
    assert identify(df.limit(0), F.lit(True)).count() == 0


def test_held_out_rows(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op11_language"](spark, folder).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    judged = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert len(judged) > 200 and np.mean(judged) > 0.99
