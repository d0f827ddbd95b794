"""A model over token ids as a step of a plan: batches by length, the best class of each token, and entities of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ENTITY
from ..functions.labels import BIO
from ..functions.patterns import NEEDED, PATTERNS, not_blank, parts, unicode_pattern
from ..functions.trie import each_distinct
from ..functions.wordpiece import WORDS, WordPieces
from ..plans.options import Options
from ..plans.pipeline import clip
from . import span_arrays as arrays
from . import stats
from .classify import in_batches

Predict = Callable[[list[np.ndarray]], list[np.ndarray]]
#: Token ids that a model is given at once, and the most cells that a trained matrix may have.
TOKENS, CELLS = 16_384, 64_000_000


def best_classes(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first largest class, its softmax probability) of each row."""
    logits = np.asarray(logits, np.float64)
    best = logits.argmax(axis=1)
    top = logits[np.arange(len(logits)), best]
    return best, 1 / np.exp(logits - top[:, None]).sum(axis=1)


class Tagger:
    """A model of two matrices of logits: a piece's own, and of the one before it by half. It also takes all texts at once."""

    def __init__(self, own: np.ndarray, last: np.ndarray, begin: int):
        self.own, self.last, self.begin = own, last, begin

    def __call__(self, some: list[np.ndarray]) -> list[np.ndarray]:
        return [self.pairs(ids, np.append(self.begin, ids[:-1])) for ids in some]

    def pairs(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        return self.own[ids] + 0.5 * self.last[before]


def all_classes(model: Predict, ids: np.ndarray, sizes: np.ndarray, tokens: int = TOKENS) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(best class, score) of all tokens of texts of given sizes, and the error of each text. Texts of like length go together;
    what the model raises on a text is its own error."""
    best, score, error = np.zeros(len(ids), np.int64), np.zeros(len(ids)), [None] * len(sizes)
    first = np.cumsum(sizes) - sizes
    if isinstance(model, Tagger):  # no text of its can fail, and a token needs but its own id and the one before
        before = np.append(model.begin, ids[:-1])
        before[first] = model.begin
        for a in range(0, len(ids), tokens):
            best[a : a + tokens], score[a : a + tokens] = best_classes(model.pairs(ids[a : a + tokens], before[a : a + tokens]))
        return best, score, error

    def whole(some: list[np.ndarray]) -> list[np.ndarray]:
        out = model(some)
        for own, logits in zip(some, out, strict=True):
            if len(own) != len(logits):
                raise ValueError(f"{len(logits)} rows for {len(own)} tokens")
        return out

    order = np.argsort(sizes, kind="stable").tolist()
    found = in_batches(whole, [ids[first[i] : first[i] + sizes[i]] for i in order], [int(sizes[i]) for i in order], tokens)
    for i, (logits, failed) in zip(order, found, strict=True):
        error[i] = failed
        if logits is not None and len(logits):
            best[first[i] : first[i] + sizes[i]], score[first[i] : first[i] + sizes[i]] = best_classes(logits)
    return best, score, error


def edged(pieces: WordPieces, rows: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids with the CLS and SEP of n texts, number of each text, places of the inner ones) of inner ids with their texts."""
    sizes = np.bincount(rows, minlength=n) + 2
    out, ends = np.full(sizes.sum(), pieces.begin), np.cumsum(sizes)
    place = np.arange(len(ids)) + 2 * rows + 1
    out[place], out[ends - 1] = ids, pieces.end
    return out, sizes, place


def entities_of(docs: DataFrame, pieces: WordPieces, load: Callable[[], Predict], names: list[str], least: float) -> Callable[[Column], Column]:
    """A function from text to struct<entities, error>: the browser's chain over all texts of a batch at once. The JVM cuts the text
    at words and patterns, so classes of characters are its own. `load` runs once in each Python worker."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    other = names.index("O")

    def some(predict: Predict, text: pa.Array, words: pa.ListArray, *patterns: pa.ListArray) -> pa.StructArray:
        row, start, end, word = arrays.every_second(words)
        ids, many = each_distinct(sent.value.encode, word)
        of = np.repeat(np.arange(len(row)), many)
        whole, sizes, place = edged(sent.value, row[of], ids, len(text))
        best, score, error = all_classes(predict, whole, sizes)
        fine = np.array([e is None for e in error], bool)
        best = np.where((best >= 0) & (best < len(names)), best, other)[place]
        tokens = arrays.Spans(row[of], start[of], end[of], best, score[place], np.arange(len(of)))
        kept = fine[tokens.row]
        found = arrays.browser_entities(text, tokens[kept], best[kept], names, [arrays.every_second(p) for p in patterns], fine, least)
        return pa.StructArray.from_arrays([found, pa.array(error, pa.string())], ["entities", "error"])

    @F.arrow_udf(f"struct<entities:array<{ENTITY}>,error:string>")
    def chain(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        predict = load()
        for batch in batches:
            sizes = pc.binary_length(batch[0]).to_numpy(zero_copy_only=False)
            for a, b in arrays.slabs(sizes):
                yield some(predict, *[x.slice(a, b - a) for x in batch])

    def of(text: Column) -> Column:
        cut = [parts(text, WORDS), *[parts(text, unicode_pattern(p, profile="browser"), needed=NEEDED[label]) for label, p in PATTERNS.items()]]
        return chain.asNondeterministic()(text, *cut)  # so that it is evaluated where it stands, once

    return of


def analyze_tokens(
    docs: DataFrame, pieces: WordPieces, load: Callable[[], Predict], options: Options | None = None, names: list[str] = BIO, text: str = "text", error: str | None = None
) -> DataFrame:
    """`docs` with truncated, entities and stats by the browser's chain: pieces of words, classes of pieces, BIO spans of the
    words that own them, then its rules. A class without a name counts as O. One row-local plan, without a shuffle."""
    options = options or Options.browser()
    out = clip(docs, options, text).withColumn("truncated", F.lit(False))
    out = out.withColumn("_found", entities_of(docs, pieces, load, names, options.min_score)(F.col(text)))
    out = out.withColumn("entities", F.col("_found.entities"))
    out = out.withColumn("stats", stats.stats(F.col(text), F.col("entities"), not_blank(F.col(text)).cast("int"), "browser"))
    return (out.withColumn(error, F.col("_found.error")) if error else out).drop("_found")


def word_codes(row: np.ndarray, start: np.ndarray, end: np.ndarray, spans: tuple[np.ndarray, ...]) -> np.ndarray:
    """The id of the BIO name of each word, as `evaluation.bio_encode`: it belongs to the first span by start that holds it.
    spans: (row, start, end, label), labels as places among the BIO names of their B-, 0 for a label without one."""
    first = np.lexsort((spans[1], spans[0]))
    of, a, b, label = (x[first[(spans[2] > spans[1])[first]]] for x in spans)
    out = np.zeros(len(row), np.int64)
    if not len(of):
        return out
    near = np.flatnonzero((of[1:] == of[:-1]) & (a[1:] < b[:-1]))
    at = np.searchsorted(of * arrays.ROW + a, row * arrays.ROW + start, "right") - 1
    own = np.where((at >= 0) & (of[at] == row) & (end <= b[at]), at, -1)
    for i in np.flatnonzero(np.isin(row, of[near])).tolist():  # of texts whose spans overlap
        held = range(np.searchsorted(of, row[i]), at[i] + 1)
        own[i] = next((k for k in held if end[i] <= b[k]), -1)
    code = label[own] + ((start != a[own]) & (label[own] > 0))
    return np.where(own >= 0, code, 0)


def trained_tagger(gold: DataFrame, pieces: WordPieces, names: list[str] = BIO, smooth: float = 0.1) -> Callable[[], Predict]:
    """A small model of labelled rows (text, entities): the logarithm of how often a piece and the one before it stood in words
    of each class. Two matrices of vocabulary by classes, counted by Spark in one pass; their size is checked."""
    size = 1 + max(pieces.unknown, pieces.begin, pieces.end, int(pieces.first.value.max()))
    if size * len(names) > CELLS:
        raise ValueError(f"the vocabulary is too large for a matrix: {size} ids")
    sent = gold.sparkSession.sparkContext.broadcast(pieces)
    known = {n[2:]: i for i, n in enumerate(BIO) if n.startswith("B-")}

    def counted(words: pa.ListArray, starts: pa.ListArray, ends: pa.ListArray, labels: pa.ListArray) -> pa.RecordBatch:
        row, start, end, word = arrays.every_second(words)
        ids, many = each_distinct(sent.value.encode, word)
        of = np.repeat(np.arange(len(row)), many)
        whole, _, place = edged(sent.value, row[of], ids, len(words))
        a, sizes = arrays.lists(starts)
        b, label = arrays.lists(ends)[0], np.array([known.get(x, 0) for x in arrays.lists(labels)[0].to_pylist()], np.int64)
        spans = (np.repeat(np.arange(len(sizes)), sizes), a.to_numpy(zero_copy_only=False).astype(np.int64), b.to_numpy(zero_copy_only=False).astype(np.int64), label)
        code = word_codes(row, start, end, spans)[of]
        seen, n = zip(*[np.unique(x * len(BIO) + code, return_counts=True) for x in (whole[place], whole[place - 1])], strict=True)
        columns = {"before": np.repeat([False, True], [len(x) for x in seen]), "id": np.concatenate(seen) // len(BIO), "code": np.concatenate(seen) % len(BIO), "n": np.concatenate(n)}
        return pa.RecordBatch.from_pydict(columns)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in arrays.slabs(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)):
                yield counted(*[batch[c].slice(a, b - a) for c in ("words", "starts", "ends", "labels")])

    text = F.coalesce("text", F.lit(""))
    held = F.filter(F.coalesce("entities", F.array().cast(gold.schema["entities"].dataType)), lambda e: e["start"].isNotNull() & e["end"].isNotNull())
    rows = gold.select(text.alias("text"), parts(text, WORDS).alias("words"), held.alias("e"))
    rows = rows.select("text", "words", F.col("e.start").alias("starts"), F.col("e.end").alias("ends"), F.col("e.label").alias("labels"))
    seen = rows.mapInArrow(counts, "before boolean, id long, code long, n long").groupBy("before", "id", "code").agg(F.sum("n").alias("n")).toPandas()

    def matrix(before: bool) -> np.ndarray:
        own = seen[seen["before"] == before]
        out = np.full((size, len(names)), smooth)
        out[own["id"].to_numpy(np.int64), own["code"].to_numpy(np.int64)] += own["n"].to_numpy()
        return np.log(out / out.sum(axis=1, keepdims=True))

    tagger = Tagger(matrix(False), matrix(True), pieces.begin)
    return lambda: tagger
