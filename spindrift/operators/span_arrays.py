"""Spans of many texts at once in flat arrays: the browser profile's chain for spans of tokens, without a loop over rows.

A span is a row (its text's place), start, end, label (a place in a list of labels), score, and its turn among the spans of its
row. All functions take spans of all rows together; `spans.py` and `browser.py` say the same for one row as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import BROWSER_GENDERS, DATE, GENDERS, MARK, MARKED_WORD, MONTHS, NEEDED, PATTERNS, PLACES, STOPWORDS, TRIM, parts, unicode_pattern
from ..functions.trie import code_points
from .spans import RULE_SCORE

#: More than a text's length, so that row and place make one number.
ROW = 1 << 32
#: Characters of texts that are worked on at once: what a task holds beside its batch is in proportion to it.
AT_ONCE = 1 << 20
#: White space as `patterns.SPACE` has it.
SPACES = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
TRIMMED = np.array(sorted(map(ord, TRIM)))
GENDER = "|".join(map(re.escape, BROWSER_GENDERS))


def slabs(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of consecutive items of some `most` together, or of a single larger one."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, stop
        at = stop


def lists(rows: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(values one after another, number of each row) of a list array, sliced or not."""
    return rows.flatten(), np.diff(rows.offsets.to_numpy())


def counts_before(codes: np.ndarray, lens: np.ndarray, row: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """How many characters that are no white space lie before places of the row's text."""
    sums, first = np.append(0, np.cumsum(~np.isin(codes, SPACES))), np.cumsum(lens) - lens
    return [sums[first[row] + np.clip(x, 0, lens[row])] - sums[first[row]] for x in places]


def filled(text: Column, starts: Column, ends: Column) -> Column:
    """array<struct<_at_start, _at_end>>: how many characters that are no white space lie before both places, beside the text."""

    def counted(texts: pa.Array, *places: pa.ListArray) -> pa.Array:
        codes, lens = code_points(texts.to_pylist())
        many = lists(places[0])[1]
        row = np.repeat(np.arange(len(many)), many)
        counts = counts_before(codes, lens, row, *[lists(x)[0].to_numpy(zero_copy_only=False) for x in places])
        found = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in counts], ["_at_start", "_at_end"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), found)

    @F.arrow_udf("array<struct<_at_start:int,_at_end:int>>")
    def count(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in slabs(pc.binary_length(batch[0]).to_numpy(zero_copy_only=False)):
                yield counted(*[x.slice(a, b - a) for x in batch])

    return count.asNondeterministic()(text, starts, ends)  # so that it is evaluated where it stands, once


def every_second(cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, start, end, text) of the matches among `patterns.parts`."""
    flat, sizes = lists(cut)
    lens = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    row, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    end = np.cumsum(lens)
    start = end - lens
    odd = np.flatnonzero((np.arange(len(lens)) - first[row]) & 1)
    row, base = row[odd], start[first[row[odd]]]
    return row, start[odd] - base, end[odd] - base, flat.take(pa.array(odd))


@dataclass
class Spans:
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray
    score: np.ndarray
    turn: np.ndarray

    def __getitem__(self, which: np.ndarray) -> Spans:
        return Spans(*[getattr(self, f.name)[which] for f in fields(self)])

    def __len__(self) -> int:
        return len(self.row)


def joined(some: list[Spans]) -> Spans:
    return Spans(*[np.concatenate([getattr(s, f.name) for s in some]) for f in fields(Spans)])


def begins(*keys: np.ndarray) -> np.ndarray:
    """Whether an item's keys differ from those of the item before it."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def reach(group: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest end so far within the item's group; groups are numbered in their order."""
    return np.maximum.accumulate(group * ROW + end) - group * ROW


def by_code(tokens: Spans, codes: np.ndarray, names: list[str], labels: list[str]) -> Spans:
    """Spans of tokens by the places of their BIO names, as `evaluation.bio_decode`."""
    of = np.array([labels.index(n[2:]) for n in names])
    plain, goes_on = (np.array([test(n) for n in names], bool) for test in (lambda n: n == "O", lambda n: n.startswith("I")))
    label, out = of[codes], plain[codes]
    grows = ~out & goes_on[codes] & ~begins(tokens.row, label)
    grows[1:] &= ~out[:-1]
    kept = np.flatnonzero(~out)
    first = np.flatnonzero(~grows[kept])
    if not len(first):
        return tokens[kept]
    last = np.append(first[1:], len(kept)) - 1
    found = tokens[kept[first]]
    return replace(found, end=tokens.end[kept[last]], label=label[kept[first]], score=np.fmin.reduceat(tokens.score[kept], first))


class Texts:
    """Texts and their code points."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes, self.lens = code_points(texts)
        self.first = np.cumsum(self.lens) - self.lens
        plain = np.flatnonzero(~np.isin(self.codes, TRIMMED))
        at = np.arange(len(self.codes) + 1)
        #: The first place from each on that isn't trimmed, and the one behind the last such place before each.
        self.next = np.append(plain, len(self.codes))[np.searchsorted(plain, at)]
        self.last = np.append(-1, plain)[np.searchsorted(plain, at)] + 1

    def trimmed(self, s: Spans) -> Spans:
        """As `spans.normalise`, but for the labels."""
        base, n = self.first[s.row], self.lens[s.row]
        a, b = np.maximum(s.start, 0), np.minimum(s.end, n)
        b = np.maximum(a, b)
        inside = a <= n
        a, b = np.where(inside, a, n) + base, np.where(inside, b, n) + base
        a = np.minimum(self.next[a], b)
        b = np.maximum(self.last[b], a)
        out = replace(s, start=a - base, end=b - base)
        return out[out.end > out.start]

    def merged(self, s: Spans) -> Spans:
        """As `browser.merge_last`. What a span may join is the island before it, which reaches as far as the spans of its
        label that stand together: one that does not join begins, and so ends, behind them."""
        s = s[np.lexsort((s.turn, -s.score, s.start, s.row))]
        fresh = begins(s.row, s.label)
        far = np.append(0, reach(np.cumsum(fresh), s.end)[:-1])
        between = self.codes[np.minimum(self.first[s.row] + far, len(self.codes) - 1)] if len(s) else far
        opens = fresh | ~((s.start <= far) | ((s.start == far + 1) & np.isin(between, SPACES)))
        first = np.flatnonzero(opens)
        if not len(first):
            return s
        return replace(s[first], end=np.maximum.reduceat(s.end, first), score=np.maximum.reduceat(s.score, first), turn=np.arange(len(first)))

    def genders(self, s: Spans, person: int, gender: int, odd: np.ndarray) -> Spans:
        """As `browser.split_gender`; odd: rows whose text may hold a gender word."""
        keep, place, cut = np.ones(len(s), bool), [], []
        for i in np.flatnonzero((s.label == person) & odd[s.row]).tolist():
            start, end = int(s.start[i]), int(s.end[i])
            low = self.texts[s.row[i]][start:end].lower()
            word = next((w for w in BROWSER_GENDERS if w in low), None)
            if word:
                at = start + low.index(word)
                keep[i] = False
                place += [i, i]
                cut += [(start, at, person), (at, at + len(word), gender)]
        if not cut:
            return s
        start, end, label = (np.array(x, np.int64) for x in zip(*cut, strict=True))
        new = s[np.array(place)]
        new = replace(new, start=start, end=end, label=label, turn=2 * new.turn + (label == gender))
        return joined([replace(s[keep], turn=2 * s.turn[keep]), self.trimmed(new[label == person]), new[label == gender]])


def resolved(s: Spans) -> Spans:
    """As `spans.resolve`: round by round the best span left of each cluster stays, and what overlaps it goes."""
    s = s[np.lexsort((s.start, s.row))]
    if not len(s):
        return s
    rows = np.cumsum(begins(s.row))
    far = np.append(0, reach(rows, s.end)[:-1])
    cluster = np.cumsum(begins(rows) | (s.start >= far)) - 1
    alone = np.bincount(cluster)[cluster] == 1
    done, left, of = [s[alone]], s[~alone], cluster[~alone]
    order = np.lexsort((left.turn, left.start, -left.score, of))
    left, of = left[order], of[order]
    while len(left):
        first = np.flatnonzero(begins(of))
        best = left[first]
        done.append(best)
        mine = np.cumsum(begins(of)) - 1
        apart = (left.start >= best.end[mine]) | (best.start[mine] >= left.end)
        left, of = left[apart], of[apart]
    s = joined(done)
    return s[np.lexsort((s.start, s.row))]


def clear(s: Spans, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a span overlaps none of some matches, which lie in their order and apart. The last one that begins before the
    span's end is the one that reaches farthest."""
    at = np.searchsorted(row * ROW + start, s.row * ROW + s.end) - 1
    hit = (at >= 0) & (row[at] == s.row) & (end[at] > s.start) if len(row) else np.zeros(len(s), bool)
    return ~hit


def verified(texts: Texts, s: Spans, matches: list[tuple], labels: list[str], rows: np.ndarray) -> pa.ListArray:
    """Entities of all texts as `spans.verify` gives them in the browser profile: matches (row, start, end, text) of each structured
    pattern, and the resolved spans that overlap none. Nothing in it stands twice, so nothing is left to be deduplicated.
    rows: whether a row has entities at all."""
    for m in matches:
        s = s[clear(s, *m[:3])]
    n = [len(m[0]) for m in matches]
    own = [np.concatenate(x) for x in zip(*[m[:3] for m in matches], (s.row, s.start, s.end), strict=True)]
    label = np.concatenate([*[np.full(k, labels.index(x)) for k, x in zip(n, PATTERNS, strict=True)], s.label])
    score, checked = np.append(np.full(sum(n), RULE_SCORE), s.score), np.arange(len(label)) < sum(n)
    cut = pa.array([texts.texts[r][a:b] for r, a, b in zip(s.row.tolist(), s.start.tolist(), s.end.tolist(), strict=True)], pa.string())
    text = pa.concat_arrays([*[m[3] for m in matches], cut])
    order = np.lexsort((own[1], own[0]))  # stable: matches first
    order = order[rows[own[0][order]]]
    many = np.bincount(own[0][order], minlength=len(rows))
    columns = {
        "start": pa.array(own[1][order], pa.int32()), "end": pa.array(own[2][order], pa.int32()), "label": pa.array(labels, pa.string()).take(pa.array(label[order])),
        "text": text.take(pa.array(order)), "score": pa.array(score[order]), "verified": pa.array(checked[order]),
    }
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def browser_entities(texts: pa.Array, tokens: Spans, codes: np.ndarray, names: list[str], matches: list[tuple], rows: np.ndarray, min_score: float) -> pa.ListArray:
    """The browser's chain from the BIO codes of tokens (of which the labels don't count) to verified entities."""
    stripped = [n[2:][2:] if len(n[2:]) > 2 and n[3] == "-" else n[2:] for n in names]
    labels = list(dict.fromkeys([n[2:] for n in names] + stripped + [*PATTERNS, "PER", "GENDER"]))
    plain = {labels.index(n[2:]): labels.index(x) for n, x in zip(names, stripped, strict=True)}
    whole = Texts(texts.to_pylist())
    found = whole.trimmed(by_code(tokens, codes, names, labels))
    found = replace(found, label=np.array([plain.get(i, i) for i in range(len(labels))])[found.label])
    islands = whole.merged(found[~(found.score < min_score)])
    odd = pc.match_substring_regex(texts, GENDER, ignore_case=True).to_numpy(zero_copy_only=False)
    best = resolved(whole.genders(islands, labels.index("PER"), labels.index("GENDER"), odd))
    return verified(whole, best, matches, labels, rows)


def ruled_spans(text: Column) -> Column:
    """array<struct<start, end, label, score, seq, _at_start, _at_end>>: the rule classifier's spans as `spans.normalise` leaves them,
    with the characters that are no white space before both ends. The JVM cuts the text at the patterns."""
    kind = "start:int,end:int,label:string,score:double,seq:int,_at_start:int,_at_end:int"
    labels = [*PATTERNS, "DATE_TIME", "LOC", "GENDER", "PER"]
    scores = np.array([0.95] * len(PATTERNS) + [0.9, 0.9, 0.85, 0.7])
    place, gender, person = (labels.index(x) for x in ("LOC", "GENDER", "PER"))

    def label_of(word: str) -> int:
        """-1: no name. A marked word begins with a capital, or with a letter of the lists, where only these are small."""
        low, small = word.lower(), word[0] == "ſ" or "a" <= word[0] <= "z"
        return place if low in PLACES else gender if low in GENDERS else -1 if small or low in MONTHS or low in STOPWORDS else person

    def some(text: pa.Array, *patterns: pa.ListArray) -> pa.Array:
        found = [every_second(p) for p in patterns]
        row, start, end, word = found.pop()
        coded = word.dictionary_encode()
        of = np.array([label_of(w) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        fits = (of >= 0) & ((of != person) | (start > 0))
        found.append((row[fits], start[fits], end[fits]))
        label = np.concatenate([*[np.full(len(f[0]), i) for i, f in enumerate(found[:-1])], of[fits]])
        row, start, end = (np.concatenate(x) for x in zip(*[f[:3] for f in found], strict=True))
        order = np.lexsort((start, row))  # stable: equal starts as the patterns come
        row, start, end, label = row[order], start[order], end[order], label[order]
        many = np.bincount(row, minlength=len(text))
        seq = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        whole = Texts(text.to_pylist())
        s = whole.trimmed(Spans(row, start, end, label, scores[label], seq))
        before = counts_before(whole.codes, whole.lens, s.row, s.start, s.end)
        columns = {
            "start": pa.array(s.start, pa.int32()), "end": pa.array(s.end, pa.int32()), "label": pa.array(labels, pa.string()).take(pa.array(s.label, pa.int64())), "score": pa.array(s.score),
            "seq": pa.array(s.turn, pa.int32()), "_at_start": pa.array(before[0], pa.int32()), "_at_end": pa.array(before[1], pa.int32()),
        }
        sizes = np.bincount(s.row, minlength=len(text))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    @F.arrow_udf(f"array<struct<{kind}>>")
    def ruled(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in slabs(pc.binary_length(batch[0]).to_numpy(zero_copy_only=False)):
                yield some(*[x.slice(a, b - a) for x in batch])

    cut = [parts(text, unicode_pattern(p), needed=NEEDED[label]) for label, p in PATTERNS.items()]
    cut += [parts(text, unicode_pattern(DATE, True), needed=NEEDED["DATE_TIME"]), parts(text, unicode_pattern(MARKED_WORD), f"$1{MARK}$2{MARK}")]
    return ruled.asNondeterministic()(text, *cut)  # so that it is evaluated where it stands, once
