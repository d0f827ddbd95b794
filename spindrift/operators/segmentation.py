"""A tokenizer's pieces over collections: what it emits, how its ids change when it is pruned, and the pruned file.

A vocabulary goes to every task, so its size is checked; texts stay where they are. In each batch every distinct word is
segmented once."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trie import each_distinct
from ..functions.unigram import WORD_BEGIN, Unigram
from ..sources.readers import read_tokenizer
from .corpus import renumber, renumber_added

#: The most pieces and bytes of pieces that a task is sent.
MOST_PIECES, MOST_BYTES = 4_000_000, 64 << 20


def load_unigram(tokenizer: DataFrame, unknown: int) -> tuple[Unigram, np.ndarray]:
    """The model of (id, piece, score), and the id of each of its pieces by their numbers; `unknown` is an id."""
    size = tokenizer.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("bytes")).first()
    if size.n > MOST_PIECES or size.bytes > MOST_BYTES:
        raise ValueError(f"the vocabulary is too large for a task: {size.n} pieces, {size.bytes} bytes")
    rows = tokenizer.select("id", "piece", "score").orderBy("id").toPandas()
    ids = rows["id"].to_numpy(np.int64)
    place = np.flatnonzero(ids == unknown)
    if not len(place):
        raise ValueError("the unknown piece is not in the vocabulary")
    return Unigram(rows["piece"].tolist(), rows["score"].to_numpy(np.float64), int(place[0])), ids


def plain_words(text: Column) -> Column:
    """The words between white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)([^\s\x1c-\x1f]+)"), F.lit(1))


def marked(words: list[str]) -> list[str]:
    """Words as the pieces spell them: in compatibility form, with the mark before them."""
    return [WORD_BEGIN + unicodedata.normalize("NFKC", w or "") for w in words]


def each_word(encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows one after another, numbers of each row) of rows of words, each distinct word encoded once."""
    out, many = each_distinct(encode, words.flatten())
    total = np.append(0, np.cumsum(many))[words.offsets.to_numpy() - words.offsets[0].as_py()]
    return out, np.diff(total)


def emitted_pieces(texts: DataFrame, tokenizer: DataFrame, unknown: int, text: str = "text") -> DataFrame:
    """(id, piece, n): the pieces that the tokenizer emits over all texts, and how often."""
    model, ids = load_unigram(tokenizer, unknown)
    sent = texts.sparkSession.sparkContext.broadcast(model)
    words = texts.select(F.explode(plain_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            found, sizes = sent.value.encode(marked(batch.column(0).to_pylist()))
            np.add.at(total, found, np.repeat(batch.column(1).to_numpy(), sizes))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(total[seen])], ["id", "n"])

    counts = words.mapInArrow(cut, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.join(tokenizer.select(F.col("id").cast("long").alias("id"), "piece"), "id").select("id", "piece", "n")


def encoded(texts: DataFrame, tokenizer: DataFrame, unknown: int, text: str = "text") -> DataFrame:
    """`texts` with ids, the tokenizer's ids of each text. Row-local: no shuffle."""
    model, ids = load_unigram(tokenizer, unknown)
    sent = texts.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<bigint>")
    def encode(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in words:
            found, sizes = each_word(lambda w: sent.value.encode(marked(w)), batch)
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids[found]))

    return texts.withColumn("ids", encode(plain_words(F.col(text))))


def divergence(texts: DataFrame, old: DataFrame, new: DataFrame, mapping: DataFrame, unknown: tuple[int, int], text: str = "text") -> DataFrame:
    """One row (lines, changed): texts, and those whose ids by the old tokenizer, carried over by mapping (old_id, new_id; -1
    where a piece is gone), are not their ids by the new one. unknown: the unknown piece's old and new id."""
    (before, old_ids), (after, new_ids) = load_unigram(old, unknown[0]), load_unigram(new, unknown[1])
    moved = {r.old_id: r.new_id for r in mapping.select("old_id", "new_id").collect()}  # no more than the vocabulary
    carried = np.array([moved.get(int(i), -1) for i in old_ids])
    sent = texts.sparkSession.sparkContext.broadcast((before, carried, after, new_ids))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, carried, b, new_ids = sent.value
        for batch in batches:
            (x, m), (y, n) = (each_word(lambda w, model=model: model.encode(marked(w)), batch.column(0)) for model in (a, b))
            x, y, same = carried[x], new_ids[y], m == n
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n)
            met = same[row]
            differs = np.zeros(len(n), bool)
            differs[row[met][x[(np.cumsum(m) - m)[row[met]] + place[met]] != y[met]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(differs | ~same)], ["changed"])

    rows = texts.select(plain_words(F.col(text)).alias("words")).mapInArrow(compare, "changed boolean")
    return rows.agg(F.count("*").alias("lines"), F.count_if("changed").alias("changed"))


def rewrite_tokenizer(spark: SparkSession, source: str, destination: str, keep: DataFrame) -> DataFrame:
    """Write the tokenizer's JSON with the pieces of keep only, its unknown id and added tokens renumbered, to a folder; returns
    the mapping (piece, old_id, new_id), as written. A vocabulary fits the driver (see load_unigram), as its file is one value."""
    payload = json.loads(spark.read.text(source, wholetext=True).first()[0])
    model = payload["model"]
    if model.get("type") != "Unigram":
        raise ValueError(f"not a Unigram tokenizer: {model.get('type')}")
    unknown = model.get("unk_id") or 0
    vocab = read_tokenizer(spark, source).withColumn("id", F.col("id").cast("long"))
    mapping = renumber(vocab, keep, model["vocab"][unknown][0])
    rows = mapping.orderBy("new_id").collect()
    model["vocab"] = [model["vocab"][r.old_id] for r in rows]
    model["unk_id"] = next(r.new_id for r in rows if r.old_id == unknown)
    tokens = payload.get("added_tokens") or []
    out = spark.createDataFrame([(r.piece, r.old_id, r.new_id) for r in rows], "piece string, old_id long, new_id long")
    added = spark.createDataFrame([(t["id"], t["content"]) for t in tokens], "id long, content string")
    ids = {(r.content, r.id): r.new_id for r in renumber_added(added, out, keep).collect()}
    payload["added_tokens"] = [t | {"id": ids[t["content"], t["id"]]} for t in tokens if (t["content"], t["id"]) in ids]
    spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "value string").coalesce(1).write.text(destination)
    return out


def unigram_json(pieces: list[str], scores: list[float], unknown: int, special: list[str] = ()) -> str:
    """A tokenizer file of pieces and scores, with the special pieces as added tokens."""
    plain = dict.fromkeys(("single_word", "lstrip", "rstrip", "normalized"), False)
    added = [{"id": pieces.index(s), "content": s, **plain, "special": True} for s in special]
    model = {"type": "Unigram", "unk_id": unknown, "vocab": [list(x) for x in zip(pieces, scores, strict=True)], "byte_fallback": False}
    return json.dumps({"version": "1.0", "added_tokens": added, "model": model}, ensure_ascii=False)
