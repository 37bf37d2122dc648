"""SentencePiece ids by a streaming Viterbi search, and texts back from ids.

The search walks the text once.  For every position inside a window of the
longest piece it keeps one survivor: the last piece of the best path to there.
Whenever all survivors' back-pointers meet at one boundary the ids up to that
boundary are final, are handed out, and their state is dropped, so that even a
text without any blank needs a bounded window only.

Unigram models add up piece scores.  In BPE models a score is a merge rank and
a path is valid when every two neighbours are what merging their joint text
would give; exactly one path is, and the search finds it without merging the
text (Neubeck and Nazarov, 2024).  Both give the ids of the model's own library.

Where no piece goes on over a blank, the short segments between blanks of some
megabytes of text are searched side by side (:mod:`gapwise.llm.viterbi_lanes`),
each different one once; longer stretches are streamed.

Vocabulary files are read where the session runs and travel with the tasks:
their size is fixed (about 1 MB), not a function of the data.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapwise.llm.store import bound_batches, give_back, only, slices
from gapwise.llm.viterbi_lanes import Lanes

SPACE = "▁"
BPE, UNIGRAM = "bpe", "unigram"
FITS = 200_000  #: pairs of pieces whose fit a worker remembers
SLICE, BATCH = 1 << 20, "4m"  #: bytes of text worked on at a time, and of an Arrow batch
SHORT = 64  #: characters of a segment that is searched side by side with others
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces, scores and byte pieces of one model; plain data that pickles."""

    def __init__(self, pieces: dict[str, int], scores: list[float], texts: list[bytes],
                 byte_ids: dict[int, int], unknown: int, kind: str, prefix: bool = True):
        self.pieces, self.scores, self.texts = pieces, scores, texts
        self.byte_ids, self.unknown, self.kind, self.prefix = byte_ids, unknown, kind, prefix
        self.longest = max(map(len, pieces), default=1)
        #: no piece goes on with a blank mark after another character: such places always part
        self.parts_at_blanks = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.least_score = min((scores[i] for i in pieces.values()), default=0.0)
        #: what makes two vocabularies one and the same to a worker
        self.name = hashlib.blake2b(repr((sorted(pieces.items()), scores, unknown, kind, prefix)).encode(),
                                    digest_size=16).digest()

    def __reduce__(self):
        """Travels as bytes that a worker unpacks once, however many tasks name the vocabulary."""
        return _restored, (self.name, zlib.compress(pickle.dumps(self.__dict__), 1))


_vocabularies: dict[bytes, Vocabulary] = {}


def _restored(name: bytes, packed: bytes) -> Vocabulary:
    if name not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[name] = made = Vocabulary.__new__(Vocabulary)
        made.__dict__.update(pickle.loads(zlib.decompress(packed)))
    return _vocabularies[name]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file; whole scores 0, -1, -2, ... are merge ranks and mark a BPE model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, scores, texts, byte_ids = {}, [], [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        scores.append(model.get_score(i))
        texts.append(piece.replace(SPACE, " ").encode())
        if model.is_byte(i):
            texts[i] = bytes([int(piece[3:5], 16)])
            byte_ids[texts[i][0]] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts[i] = b""
        else:
            pieces[piece] = i
    ranks = [scores[i] for i in pieces.values()]
    kind = BPE if ranks and all(r <= 0 and r == int(r) for r in ranks) else UNIGRAM
    return Vocabulary(pieces, scores, texts, byte_ids, model.unk_id(), kind, model.encode("a", out_type=str)[0][0] == SPACE)


class StreamingViterbi:
    """Feed a text in parts and take the ids as they become final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pieces, self.scores, self.longest = vocabulary.pieces, vocabulary.scores, vocabulary.longest
        self.bpe = vocabulary.kind == BPE
        self.names = {i: p for p, i in vocabulary.pieces.items()}
        self.fits: dict[int, bool] = {}
        self.ids = len(vocabulary.scores)
        self.lanes = Lanes(vocabulary.pieces, self.ids, self.longest, vocabulary.byte_ids, vocabulary.unknown,
                           self.fitting) if self.bpe and vocabulary.parts_at_blanks and vocabulary.pieces else None

    @cached_property
    def tails(self) -> dict[str, int]:
        """Every end of a piece, with the piece's id where it is one itself; made when a text is streamed."""
        return {p[k:]: -1 for p in self.pieces for k in range(len(p))} | self.pieces

    def merged(self, text: str) -> list[int]:
        """What merging by rank makes of a short known text."""
        parts = list(text)
        get, scores = self.v.pieces.get, self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [get(p, -1) for p in parts]

    def follows(self, before: int, piece: int) -> bool:
        """May ``piece`` stand after ``before`` (-1: a start or an unknown character)?"""
        key = before * self.ids + piece
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[key] = self.fitting(before, piece)
        return known

    def fitting(self, before: int, piece: int) -> bool:
        if before < 0:
            return self.merged(self.names[piece]) == [piece]
        return self.merged(self.names[before] + self.names[piece]) == [before, piece]

    def advance(self, text: str, ends: list) -> None:
        """Find the survivor, (start, piece, score), of every further position of ``text``."""
        tails, fits, bpe, scores, longest = self.tails, self.fits, self.bpe, self.scores, self.longest
        for i in range(len(ends), len(text) + 1):
            best = None
            for j in range(i - 1, max(-1, i - longest - 1), -1):
                piece = tails.get(text[j:i])
                if piece is None:
                    break
                if piece < 0 or ends[j] is None:
                    continue
                before = ends[j]
                if not bpe:
                    score = before[2] + scores[piece]
                    if best is None or score >= best[2]:
                        best = (j, piece, score)
                else:
                    fit = fits.get(before[1] * self.ids + piece)
                    if fit or fit is None and self.follows(before[1], piece):
                        best = (j, piece, 0.0)
                        break  # no other last piece is valid
            if ends[i - 1] is not None and tails.get(text[i - 1], -1) < 0:
                score = ends[i - 1][2] + self.v.least_score - UNKNOWN_PENALTY
                if best is None or score > best[2]:
                    best = (i - 1, -1, score)
            ends.append(best)

    def meeting(self, ends: list, i: int) -> int:
        """The last boundary that the paths of all survivors share."""
        live = {k for k in range(i - self.v.longest + 1, i + 1) if ends[k] is not None}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(max(0, ends[last][0]))
        return live.pop()

    def pieces_to(self, ends: list, text: str, end: int) -> list[int]:
        """Ids of the path that ends at ``end``; unknown characters fall back to bytes."""
        path = []
        while end > 0:
            start, piece, _ = ends[end]
            path.append((piece, text[start:end]))
            end = start
        out = []
        for piece, chars in reversed(path):
            if piece >= 0:
                out.append(piece)
            elif self.v.byte_ids:
                out.extend(self.v.byte_ids[b] for b in chars.encode())
            else:
                out.append(self.v.unknown)
        return out

    def stream(self, parts: Iterable[str]) -> Iterator[int]:
        """Ids of a text that comes in parts, each as soon as it is final."""
        longest, text, ends = self.longest, "", [(0, -1, 0.0)]
        for part in parts:
            for at in range(0, len(part), longest):
                text += part[at:at + longest]
                self.advance(text, ends)
                if len(text) >= 4 * longest and (final := self.meeting(ends, len(text))):
                    yield from self.pieces_to(ends, text, final)
                    text = text[final:]
                    ends = [e and (e[0] - final, e[1], e[2]) for e in ends[final:]]
        yield from self.pieces_to(ends, text, len(text))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit numbers, streamed.

        A literal blank mark is spelt in bytes, so that it never turns into a
        space: decoding gives back every text as it was.
        """
        if not text:
            return b""
        out, mark = array("i"), []
        for n, plain in enumerate(text.split(SPACE)):
            if n:
                mark = mark or ([self.v.byte_ids[b] for b in SPACE.encode()] if self.v.byte_ids else [self.v.unknown])
                out.extend(mark)
            plain = plain.replace(" ", SPACE)
            out.extend(self.stream([SPACE + plain if n == 0 and self.v.prefix else plain]))
        return out.tobytes()

    def row_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids of each), their short segments searched side by side.

        Texts part where a blank mark follows another character.  A text with a
        literal mark or a longer segment is streamed by itself.
        """
        joined = "".join([SPACE + t.replace(" ", SPACE) if self.v.prefix and t else t.replace(" ", SPACE) for t in texts])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + (1 if self.v.prefix and t else 0) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        blank = codes == ord(SPACE)
        parts = np.append(True, blank[1:] & ~blank[:-1])[:len(codes)]
        parts[bounds[:-1][sizes > 0]] = True
        starts = np.flatnonzero(parts)
        ends = np.append(starts[1:], len(codes))[:len(starts)]
        owner = np.searchsorted(bounds, starts, "right") - 1
        alone = np.array([SPACE in t for t in texts], bool)
        alone[owner[ends - starts > SHORT]] = True
        row = ~alone[owner]
        tokens, each = self.lanes.encode(codes, starts[row], ends[row]) if row.any() else (np.zeros(0, np.int64),) * 2
        counts = np.bincount(owner[row], each, minlength=len(texts)).astype(np.int64)
        if alone.any():
            begin = np.cumsum(counts) - counts
            made, at = [], 0
            for i in np.flatnonzero(alone).tolist():
                own = np.frombuffer(self.encode(texts[i]), np.int32)
                made += [tokens[at:begin[i]], own]
                at, counts[i] = begin[i], len(own)
            tokens = np.concatenate([*made, tokens[at:]])
        return tokens.astype(np.int32), counts

    def id_lists(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of many texts; null for a null text."""
        if self.lanes:
            values, counts = self.row_of([t or "" for t in texts])
        else:
            coded = [self.encode(t or "") for t in texts]
            values, counts = np.frombuffer(b"".join(coded), np.int32), [len(c) // 4 for c in coded]
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array([t is None for t in texts], pa.bool_()))

    def decode(self, ids: Iterable[int]) -> str:
        texts = self.v.texts
        raw = b"".join([texts[i] for i in ids])
        if self.v.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_coders: dict[bytes, StreamingViterbi] = {}


def _coder(vocabulary: Vocabulary) -> StreamingViterbi:
    """One coder for each worker, so that what it remembers outlives a task."""
    give_back()  # what an earlier stage's batches took
    if vocabulary.name not in _coders:
        _coders.clear()
        _coders[vocabulary.name] = StreamingViterbi(vocabulary)
    return _coders[vocabulary.name]


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens) of every row: its whole text's ids.

    A null text has null ids and no tokens, an empty text empty ids.  Repeated
    rows stay repeated; other columns are not read.
    """
    bound_batches(df.sparkSession, BATCH)
    rows = only(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in slices(batches, 1, SLICE):
            ids = coder.id_lists(batch.column(1).to_pylist())
            sizes = pa.array(np.diff(ids.offsets.to_numpy()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, sizes], ["id", "ids", "n_tokens"])
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>, n_tokens long")


def decode(coded: DataFrame, vocabulary: Vocabulary, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of every row's ids; null ids give a null text."""
    bound_batches(coded.sparkSession, BATCH)
    rows = only(coded, id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in slices(batches, 1, SLICE):
            lists = batch.column(1)
            flat, ends = lists.values.to_pylist(), lists.offsets.to_pylist()
            texts = [coder.decode(flat[a:b]) if lists[i].is_valid else None
                     for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, text string")


def round_trip(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, exact): encode and decode every row in one pass.

    ``exact`` says that decoding the ids gives the very text back; null for a
    null text.
    """
    bound_batches(df.sparkSession, BATCH)
    rows = only(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in slices(batches, 1, SLICE):
            texts = batch.column(1).to_pylist()
            ids = coder.id_lists(texts)
            flat, ends = ids.values.to_numpy().tolist(), ids.offsets.to_pylist()
            exact = [None if t is None else coder.decode(flat[a:b]) == t
                     for t, a, b in zip(texts, ends[:-1], ends[1:])]
            sizes = pa.array([b - a for a, b in zip(ends[:-1], ends[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, sizes, pa.array(exact, pa.bool_())],
                                             ["id", "ids", "n_tokens", "exact"])
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>, n_tokens long, exact boolean")
