"""Many strings in one automaton of sorted arrays, walked for all places of many texts at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Bits of a code point.
CODE = 21


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, length of each text)."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), lens


def ragged(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows `which` of rows of given sizes that lie one after another, and their sizes."""
    many = sizes[which]
    ends = np.cumsum(many)
    return values[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - many), many) + np.arange(many.sum())], many


def each_distinct(encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words one after another, numbers of each word), each distinct word encoded once."""
    coded = words.dictionary_encode()
    return ragged(*encode(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))


class Trie:
    """Strings as paths of code points from node 0. An edge is one number, parent node and code point; all edges are sorted,
    and the edge at place i leads to node i + 1, since nodes are numbered level by level."""

    def __init__(self, strings: list[str], values: np.ndarray | None = None):
        """values: numbers from 0 on, by default the strings' places; of equal strings the last one's holds."""
        codes, lens = code_points(strings)
        first, values = np.cumsum(lens) - lens, np.arange(len(strings)) if values is None else np.asarray(values)
        live, node, edges, ends = np.arange(len(strings)), np.zeros(len(strings), np.int64), [], []
        self.longest, depth, nodes = int(lens.max(initial=0)), 0, 1
        while True:
            done = lens[live] == depth
            ends.append((node[done], values[live[done]]))
            live, node = live[~done], node[~done]
            if not len(live):
                break
            level, place = np.unique((node << CODE) | codes[first[live] + depth], return_inverse=True)
            edges.append(level)
            node = nodes + place
            nodes, depth = nodes + len(level), depth + 1
        self.edges = np.concatenate([*edges, np.array([np.iinfo(np.int64).max])])
        self.value = np.full(nodes, -1)
        for at, v in ends:
            self.value[at] = v  # in the order of the strings

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node behind each node's edge, -1 where it has none of this code point."""
        key = (node << CODE) | code
        at = np.searchsorted(self.edges, key)
        return np.where(self.edges[at] == key, at + 1, -1)

    def matches(self, codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, value) of every string at every place; room: code points from a place to its text's end."""
        live, node, depth = np.flatnonzero(room > 0), None, 0
        node = np.zeros(len(live), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            node = self.step(node, codes[live + depth])
            depth += 1
            live, node = live[node >= 0], node[node >= 0]
            hit = self.value[node] >= 0
            out.append((live[hit], np.full(hit.sum(), depth), self.value[node[hit]]))
            more = room[live] > depth
            live, node = live[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def longest_at(self, codes: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, value) of the longest string from each place `at` on, before `stop`; value is -1 where there is none."""
        length, value = np.zeros(len(at), np.int64), np.full(len(at), -1)
        live, node, depth = np.flatnonzero(at < stop), None, 0
        node = np.zeros(len(live), np.int64)
        while len(live):
            node = self.step(node, codes[at[live] + depth])
            depth += 1
            live, node = live[node >= 0], node[node >= 0]
            hit = self.value[node] >= 0
            length[live[hit]], value[live[hit]] = depth, self.value[node[hit]]
            more = at[live] + depth < stop[live]
            live, node = live[more], node[more]
        return length, value
