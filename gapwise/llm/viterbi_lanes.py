"""The Viterbi search of :mod:`gapwise.llm.sentencepiece_codec` for many short segments at once.

Each different segment of some megabytes of text is a lane.  All lanes advance
one character at a time; at a position each lane tries its last pieces from the
shortest on, along a trie of reversed pieces, until one fits what came before.
It is the one valid last piece (see there), so a survivor is a piece and its
length, and the path back is a few array steps.
"""

from __future__ import annotations

import numpy as np

from gapwise.llm.words import mix, powers, span_hashes

LANES = 1 << 13  #: lanes that advance together
FITS = 200_000  #: pairs of pieces remembered
_NONE, _UNKNOWN = -2, -1


class Lanes:
    """Tables of one BPE vocabulary; ``follows`` decides pairs of pieces never met before."""

    def __init__(self, pieces: dict[str, int], ids: int, longest: int, byte_ids: dict[int, int], unknown: int, follows):
        self.ids, self.longest, self.byte_ids, self.unknown, self.follows = ids, longest, byte_ids, unknown, follows
        letters = sorted({c for p in pieces for c in p})
        self.letter = np.zeros(0x110001, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        number = {c: i + 1 for i, c in enumerate(letters)}
        steps: dict[int, int] = {}
        held = [-1]
        for piece, name in pieces.items():
            at = 0
            for c in reversed(piece):
                key = at * self.letters + number[c]
                at = steps.setdefault(key, len(held))
                if at == len(held):
                    held.append(-1)
            held[at] = name
        self.held = np.array(held, np.int32)
        self.keys = np.array(sorted(steps), np.int64)
        self.into = np.array([steps[k] for k in self.keys.tolist()], np.int32)
        self.known, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next state of the trie, or -1."""
        key = state.astype(np.int64) * self.letters + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.into[at], -1)

    def fit(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = before.astype(np.int64) * self.ids + piece
        if len(self.known) > FITS:
            self.known, self.fits = self.known[:0], self.fits[:0]
        at = np.searchsorted(self.known, key)
        if len(self.known):
            at = np.minimum(at, len(self.known) - 1)
            new = self.known[at] != key
        else:
            new = np.ones(len(key), bool)
        if new.any():
            fresh = np.unique(key[new])
            answers = np.array([self.follows(k // self.ids, k % self.ids) for k in fresh.tolist()], bool)
            names = np.concatenate([self.known, fresh])
            order = np.argsort(names, kind="stable")
            self.known, self.fits = names[order], np.concatenate([self.fits, answers])[order]
            at = np.searchsorted(self.known, key)
        return self.fits[at]

    def search(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, tokens of each lane); lanes by falling size.  A token below 0 is -1 - code point."""
        many, most = len(starts), int(sizes[0])
        raw = codes[np.minimum(starts[:, None] + np.arange(most), len(codes) - 1)]
        letter = self.letter[raw]
        last = np.full((many, most + 1), _NONE, np.int32)
        last[:, 0] = _UNKNOWN
        size = np.zeros((many, most + 1), np.int8)
        for i in range(1, most + 1):
            live = int(np.searchsorted(-sizes, -i, "right"))
            lane, state = np.arange(live), np.zeros(live, np.int32)
            alone = np.zeros(live, bool)  # the character is a piece itself
            for length in range(1, min(i, self.longest) + 1):
                state = self.step(state, letter[lane, i - length])
                going = state >= 0
                lane, state = lane[going], state[going]
                if not len(lane):
                    break
                piece, before = self.held[state], last[lane, i - length]
                if length == 1:
                    alone[lane[piece >= 0]] = True
                some = np.flatnonzero((piece >= 0) & (before != _NONE))
                good = some[self.fit(before[some], piece[some])] if len(some) else some
                last[lane[good], i], size[lane[good], i] = piece[good], length
                rest = np.ones(len(lane), bool)
                rest[good] = False
                lane, state = lane[rest], state[rest]
            lost = np.flatnonzero((last[:live, i] == _NONE) & (last[:live, i - 1] != _NONE) & ~alone)
            last[lost, i], size[lost, i] = _UNKNOWN, 1
        at, lane, turns = sizes.copy(), np.arange(many), []
        while len(lane):
            piece = last[lane, at[lane]].astype(np.int64)
            piece = np.where(piece < 0, -1 - raw[lane, at[lane] - 1].astype(np.int64), piece)
            turns.append((lane, piece))
            at[lane] -= size[lane, at[lane]]
            lane = lane[at[lane] > 0]
        if not turns:
            return np.zeros(0, np.int64), np.zeros(many, np.int64)
        lane, piece = (np.concatenate(x) for x in zip(*reversed(turns)))  # later turns stand earlier in the text
        order = np.argsort(lane, kind="stable")
        return piece[order], np.bincount(lane, minlength=many)

    def spelt(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters as byte pieces, or as the unknown piece."""
        odd = tokens < 0
        if not odd.any():
            return tokens, counts
        names, which = np.unique(tokens[odd], return_inverse=True)
        parts = [[self.byte_ids[b] for b in chr(-1 - n).encode()] if self.byte_ids else [self.unknown] for n in names.tolist()]
        width = np.array([len(p) for p in parts])
        times = np.ones(len(tokens), np.int64)
        times[odd] = width[which]
        out = np.repeat(tokens, times)
        ends = np.cumsum(times)
        first = (ends - times)[odd]
        table = np.array([p + [0] * (4 - len(p)) for p in parts])
        for k in range(4):
            has = width[which] > k
            out[first[has] + k] = table[which[has], k]
        lanes = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(lanes, times, minlength=len(counts)).astype(np.int64)

    def encode(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all segments in a row, tokens of each); equal segments are searched once."""
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes)), dtype=np.uint64, out=sums[1:])
        _, first, which = np.unique(span_hashes(sums, starts, ends), return_index=True, return_inverse=True)
        sizes = (ends - starts)[first]
        order = np.argsort(-sizes, kind="stable")
        made = [self.search(codes, starts[first[part]], sizes[part])
                for part in (order[i:i + LANES] for i in range(0, len(order), LANES))]
        tokens, counts = self.spelt(*(np.concatenate(x) for x in zip(*made)))
        begin = np.cumsum(counts) - counts
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lane = place[which]
        each = counts[lane]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[lane], each)
        return tokens[at], each
