"""Token alignment against both libraries on whole texts, pair by pair."""

import hashlib
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from gapwise.llm.queries import BYTE_LEVEL, QUERIES, VOCABULARY
from gapwise.llm.token_alignment import align, byte_letters, spell

ODD = ["", None, " ", "  ", "a", "  a b", " a\n\nb\n", "x\ny z", "tab\there", "a \n b", "\nx\n y", "\n", "a  b  c   d",
       "<|endoftext|> hi<s></s><unk><0x41>", "▁a b", "ﬁ ＡＢ é x", "日本語 テスト　x y", "x\x1cy \x1c z", "a b c  d",
       "it's I'll we 's 'S", "﻿abc", "a\r\nb", "ab\x00c d", "😀 👩‍👩‍👧 x", "   \n ", "don't\nstop 12,345 x " * 3,
       "word " * 3000 + "x" * 5000]


def by_the_rule(texts):
    """Every figure from the bytes of whole texts, byte by byte."""
    a = Tokenizer.from_file(BYTE_LEVEL)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=VOCABULARY)
    letters = byte_letters()
    names = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b.is_byte(i) else name.replace("▁", " ").encode()
    rows = []
    for text in texts:
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        spelt = [names[i] for i in ids[0]], [piece(i) for i in ids[1]]
        raw = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(spelt[0]) == raw and b"".join(spelt[1]) == raw:
            ends = [{0: 0} | {len(b"".join(side[:k + 1])): k + 1 for k in range(len(side))} if len(side) < 300 else
                    _ends(side) for side in spelt]
            cuts = [e for e in ends[0] if e in ends[1]]
            groups = [(ids[0][ends[0][x]:ends[0][y]], ids[1][ends[1][x]:ends[1][y]]) for x, y in zip(cuts, cuts[1:])]
        rows.append(groups)
    pairs = [Counter((i, j) for x, y in groups for i in x for j in y) for groups in rows]
    count = Counter(p for c in pairs for p in c)
    most = {}
    for (i, _), n in count.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for groups, held in zip(rows, pairs):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(held.values()),
                    sum(n for p, n in held.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in held.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return out


def _ends(side):
    out, at = {0: 0}, 0
    for k, token in enumerate(side):
        at += len(token)
        out[at] = k + 1
    return out


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("rows", [ODD, ["same text here"] * 5 + [None]])
def test_odd_texts(spark, rows):
    df = spark.createDataFrame([(i % 7 or None, t, 1, "x") for i, t in enumerate(rows)],
                               "doc_id long, text string, n_a int, id string").repartition(3)
    want = sorted(((i % 7 or None) or 0, *r[:7]) for i, r in enumerate(by_the_rule(rows)))
    got = sorted((r["id"] or 0, *[r[f] for f in FIGURES]) for r in align(df, BYTE_LEVEL, VOCABULARY).collect())
    assert got == want
    assert (sorted((r["id"] or 0, r["groups"]) for r in spell(df, BYTE_LEVEL, VOCABULARY).collect())
            == sorted(((i % 7 or None) or 0, r[7]) for i, r in enumerate(by_the_rule(rows))))
    assert align(df.limit(0), BYTE_LEVEL, VOCABULARY).count() == 0


def test_query_equals_whole_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: r[:7] for d, r in zip(docs, by_the_rule([d["text"] for d in docs]))}
    got = {r["doc_id"]: tuple(r[f] for f in FIGURES) for r in QUERIES["op12_token_groups"](spark, folder).collect()}
    assert got == want


def test_memory_of_pieces_is_bounded(spark, monkeypatch):
    from gapwise.llm import token_alignment
    monkeypatch.setattr(token_alignment, "MEMO", 4)
    with open(BYTE_LEVEL, encoding="utf-8") as a, open(VOCABULARY, "rb") as b:
        aligner = token_alignment.Aligner(a.read(), b.read())
    keys = [f"w{i % 11}" for i in range(100)]
    assert [e[0] for e in aligner.entries(keys)] == [aligner.aligned([" " + k])[0][0] for k in keys]
    assert len(aligner.memo) <= 4 and len(aligner.older) <= 4


def test_lanes_equal_streams_and_the_library(monkeypatch):
    from gapwise.llm import sentencepiece_codec, viterbi_lanes
    monkeypatch.setattr(viterbi_lanes, "LANES", 3)
    monkeypatch.setattr(viterbi_lanes, "FITS", 5)
    vocabulary = sentencepiece_codec.load_vocabulary(VOCABULARY)
    coder, library = sentencepiece_codec.StreamingViterbi(vocabulary), SentencePieceProcessor(model_file=VOCABULARY)
    texts = [t for t in ODD if t is not None] + ["a ▁ b▁", "x" * 63, "y" * 64 + " z", "é" * 70 + "\n\n q"]
    made = coder.id_lists([*texts, None]).to_pylist()
    assert made.pop() is None
    for text, ids in zip(texts, made):
        assert ids == memoryview(coder.encode(text)).cast("i").tolist()
        assert coder.decode(ids) == text
        if "▁" not in text:
            assert ids == library.encode(text)
    assert coder.id_lists([]).to_pylist() == [] and coder.id_lists(["", None]).to_pylist() == [[], None]
