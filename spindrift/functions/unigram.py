"""Unigram segmentation: each word's best path over pieces and their scores, all words of a batch at once."""

from __future__ import annotations

import numpy as np

from .trie import Trie, code_points

#: Fixed: the mark of a piece that begins a word, and how far below the worst piece an unknown character scores.
WORD_BEGIN, UNKNOWN_PENALTY = "▁", 10.0


class Unigram:
    """Pieces with scores. A path's score is the sum of its pieces'; of equal paths the one whose last piece is longer wins.
    A character that no piece of its own covers may be unknown; unknown characters in a row are one piece."""

    def __init__(self, pieces: list[str], scores: np.ndarray, unknown: int):
        self.trie, self.scores, self.unknown = Trie(pieces), np.asarray(scores, np.float64), unknown
        self.worst = self.scores.min() - UNKNOWN_PENALTY

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers of all words one after another, pieces of each word)."""
        codes, lens = code_points(words)
        first = np.cumsum(lens) - lens
        word = np.repeat(np.arange(len(words)), lens)
        place = np.arange(len(codes)) - first[word]
        start, length, piece = self.trie.matches(codes, lens[word] - place)
        alone = np.ones(len(codes), bool)
        alone[start[length == 1]] = False
        lone = np.flatnonzero(alone)
        start, length = np.append(start, lone), np.append(length, np.ones(len(lone), np.int64))
        score = np.append(self.scores[piece], np.full(len(lone), self.worst))
        piece = np.append(piece, np.full(len(lone), self.unknown))
        order = np.argsort(place[start], kind="stable")
        start, length, piece, score = start[order], length[order], piece[order], score[order]
        # Node first[w] + w + p lies before the code point p of word w. All words take the step from place p at once.
        node = start + word[start]
        best, back = np.full(len(codes) + len(words), -np.inf), np.zeros(len(codes) + len(words), np.int64)
        best[first + np.arange(len(words))] = 0
        cuts = np.searchsorted(place[start], np.arange(lens.max(initial=0) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            to, total = node[a:b] + length[a:b], best[node[a:b]] + score[a:b]
            better = np.flatnonzero(total > best[to])
            best[to[better]], back[to[better]] = total[better], a + better
        at, left = first + np.arange(len(words)) + lens, lens.copy()
        found, owner = [], []
        live = np.flatnonzero(left > 0)
        while len(live):
            edge = back[at[live]]
            found.append(piece[edge])
            owner.append(live)
            at[live] -= length[edge]
            left[live] -= length[edge]
            live = live[left[live] > 0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(found[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(owner, kind="stable")
        ids, owner = ids[order], owner[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (owner[1:] == owner[:-1])
        return ids[~again], np.bincount(owner[~again], minlength=len(words))
