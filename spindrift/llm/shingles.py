"""Word shingles of texts as 64-bit hashes, a whole group of texts at a time in numpy."""

from __future__ import annotations

import numpy as np

from .arrays import BYTES, U, mix, powers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): text i's distinct shingles are hashes[cuts[i]:cuts[i + 1]], sorted.

    A shingle is `width` words in a row; a text of fewer words has one shingle of all of them, one without words none."""
    raw = np.frombuffer(b" ".join([*texts, b""]) + b" ", np.uint8)
    text = LOWER[raw]
    space = IS_SPACE[text]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, stop = edge[0::2], edge[1::2] if len(edge) % 2 == 0 else np.append(edge[1::2], len(text))
    ends = np.cumsum([len(t) + 1 for t in texts])
    pw, inverse = powers(len(text) + 1)
    h = np.zeros(len(text) + 1, U)
    np.cumsum(BYTES[text] * pw[: len(text)], out=h[1:])
    word = mix((h[stop] - h[start]) * inverse[start] + (stop - start).astype(U))
    owner = np.searchsorted(ends, start, side="right")
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    size = len(word) - width + 1
    factors = powers(width + 2)[0]
    if size > 0:
        whole = np.flatnonzero(owner[:size] == owner[width - 1 :])
        total = np.zeros(len(whole), U)
        for j in range(width):
            total += word[whole + j] * factors[j + 1]
    else:
        whole, total = np.zeros(0, np.int64), np.zeros(0, U)
    few = np.flatnonzero((count > 0) & (count < width))
    short = np.zeros(len(few), U)
    for k, i in enumerate(few):
        w = word[first[i] : first[i] + count[i]]
        short[k] = (w * factors[1 : len(w) + 1]).sum(dtype=U) + U(len(w))
    token, of = mix(np.concatenate([total, short])), np.concatenate([owner[whole], few])
    order = np.argsort(token)
    order = order[np.argsort(of[order].astype(np.uint16) if len(texts) < 1 << 16 else of[order], kind="stable")]
    token, of = token[order], of[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (of[1:] != of[:-1])
    token, of = token[new], of[new]
    return token, np.searchsorted(of, np.arange(len(texts) + 1))
