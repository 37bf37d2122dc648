"""The corpus pipeline, stage by stage, each against what its input holds."""

import re

import numpy as np

import corpus_pipeline
from gapwise.llm.store import keep


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs = keep(stage(spark, docs, folder), name)
        if name != "sentencepiece":
            assert docs.columns == columns
    before = {r["doc_id"]: r["text"] for r in seen["quality_classifier"].collect()}
    after = {r["doc_id"] for r in seen["minhash_near_dedup"].collect()}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    sets = {i: shingles(t) for i, t in before.items()}
    kept = sorted(after)
    for n, a in enumerate(kept):
        for b in kept[n + 1:]:
            assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    for gone in set(before) - after:
        assert any(100 * len(sets[gone] & sets[k]) >= 50 * len(sets[gone] | sets[k]) for k in kept)
    assert all(r["exact"] for r in seen["sentencepiece"].collect())
    assert seen["sentencepiece"].count() == seen["source_mixing"].count() > 0


def _words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))


def test_passages_of_rows_under_one_id(spark, folder):
    rng = np.random.default_rng(31)
    passage, tails = _words(rng, 80), [_words(rng, 20) for _ in range(4)]
    rows = [(1, f"{passage} {tails[0]}"), (7, f"{passage} {tails[1]}"), (7, tails[2]), (None, f"{passage} {tails[3]}"),
            (8, passage), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "r", 5, 6) for i, t in rows], "doc_id long, text string, rest string, before int, id int")
    out = corpus_pipeline.repeated_passages(spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    texts = [(r["doc_id"], r["text"]) for r in got]
    assert rows[0] in texts and rows[2] in texts and rows[3] in texts and texts.count((9, None)) == 2
    cut = [t for i, t in texts if i == 7 and t != tails[2]]
    assert len(cut) == 1 and cut[0].endswith(tails[1]) and len(cut[0].split()) < 60
    assert all((r["rest"], r["before"], r["id"]) == ("r", 5, 6) for r in got)


def test_mixture_of_null_ids_and_clashing_columns(spark, folder):
    names = ("size", "taken", "shard", "place", "copies", "copy", "words", "id", "doc")
    rows = [(i, f"w{i} " * 10, "a") for i in range(40)] + [(None, "n " * 10, "a")] * 3 + [(50, "x " * 10, "a"), (50, "y " * 25, "a")]
    docs = spark.createDataFrame([(*r, *names) for r in rows],
                                 "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = corpus_pipeline.mixture(spark, docs, folder)
    assert out.columns == docs.columns
    # one source: everything is due once
    got = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    none = docs.limit(0)
    assert corpus_pipeline.mixture(spark, none, folder).count() == corpus_pipeline.repeated_passages(spark, none, folder).count() == 0
