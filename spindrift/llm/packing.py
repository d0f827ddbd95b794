"""Operator 11, packing: all documents' tokens laid end to end and cut into sequences of equal length.

Two passes. The first tokenises each partition, writes the ids with their place in the partition, and sums up the
partitions' tokens. The prefix sums of these totals, one number a partition, give each document its place among all
tokens; the second pass then works row by row: a document's tokens are cut where fixed windows end, and each piece is
one record. Only the last sequence isn't full. No token moves through a shuffle.

Texts are tokenised by distinct chunk: a cut before a single blank or line feed between two visible characters, or
between a Latin letter and a stop, never lies within a pre-token of a byte-level vocabulary, so a chunk's ids don't depend on its neighbours, and each distinct
chunk of a group of texts goes through the tokenizer once.

Defined results: a null or empty text is the end token alone; rows that share a doc_id, or have none, are documents of
their own; a table without rows gives an empty result; other columns are ignored, whatever their names. Documents come
in the order of partitions and of rows within them, so the same files read in the same splits give the same sequences.
Long texts are taken whole; a task holds one text or group of texts some 20 times over. Strings of special tokens in a
text become those tokens, as the tokenizer's file says, unless `plain_specials`. Sequences are padded to `length`, but
for one whose own length is a power of two; padding isn't a piece (see `sequences`).
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import text_groups
from .common import stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LENGTH, END = 2048, 1
#: Bytes of text that a task tokenises at once.
GROUP = 12 << 20
#: Chunks whose ids a task keeps from one group of texts to the next.
KNOWN = 300_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: 1: visible ASCII, or the lead of a two-byte character that is no white space; 2: what follows such a lead.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 1
_KIND[0xC3:0xE0] = 1
_KIND[0x80:0xC0] = 2
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?"]] = True


def chunk_starts(text: np.ndarray) -> np.ndarray:
    """Where a text in UTF-8 may be cut without a change of its ids, in no order."""
    at = np.flatnonzero((text == 0x20) | (text == 0x0A))
    at = at[(at > 1) & (at + 1 < len(text))]
    kind, before = _KIND[text], _KIND[text[at - 1]]
    two_bytes = (before == 2) & (text[at - 2] >= 0xC3) & (text[at - 2] < 0xE0)
    left = ((before == 1) & (text[at - 1] < 0x80)) | two_bytes
    stop = np.flatnonzero(_STOP[text])
    stop = stop[stop > 0]
    return np.concatenate([at[left & (kind[at + 1] == 1)], stop[_LETTER[text[stop - 1]]]])


class Encoder:
    """A tokenizer over groups of texts, each distinct chunk once."""

    def __init__(self, file: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given the task its core
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = plain_specials
        self.known: dict[bytes, list[int]] = {}

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, tokens of each text)."""
        stops = np.cumsum([len(t) for t in texts])
        raw = b"".join(texts)
        text = np.frombuffer(raw, np.uint8)
        edge = np.zeros(len(raw) + 1, bool)
        edge[0] = edge[stops] = edge[chunk_starts(text)] = True
        cuts = np.flatnonzero(edge)
        coded = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        lists = [self.known.get(c) for c in chunks]
        new = [i for i, x in enumerate(lists) if x is None]
        found = self.tokenizer.encode_batch_fast([chunks[i].decode("utf-8", "surrogatepass") for i in new], add_special_tokens=False)
        for i, e in zip(new, found, strict=True):
            lists[i] = e.ids
            if len(self.known) < KNOWN:
                self.known[chunks[i]] = lists[i]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(lens.sum()))
        which = coded.indices.to_numpy()
        many = lens[which] if len(which) else np.zeros(0, np.int64)
        place = np.cumsum(many)
        ids = flat[np.repeat((np.cumsum(lens) - lens)[which] - (place - many), many) + np.arange(many.sum())] if len(which) else flat
        ends = np.concatenate([[0], place])[np.searchsorted(cuts, stops)]
        return ids, np.diff(ends, prepend=0)


def with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end token behind each document's ids."""
    sizes = sizes + 1
    out = np.full(int(sizes.sum()), end, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes) - 1] = False
    out[own] = ids
    return out, sizes


def token_rows(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, plain_specials: bool = False) -> DataFrame:
    """First pass, stored: (part, before, doc_id, n, ids) of each row of docs; `before` counts the tokens before it in its
    partition `part`, ids are little-endian unsigned 32-bit numbers."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches):
        encoder, part, before = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            encoder = encoder or Encoder(sent.value, plain_specials)
            for a, b, texts in text_groups(batch.column(1), GROUP):
                ids, sizes = with_ends(*encoder.ids(texts), end)
                stops = np.cumsum(sizes)
                at = pa.py_buffer(np.concatenate([[0], stops * 4]).astype(np.int64))
                values = pa.Array.from_buffers(pa.large_binary(), b - a, [None, at, pa.py_buffer(ids)]).cast(pa.binary())
                places = pa.array(before + stops - sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part)), places, batch.column(0).slice(a, b - a), pa.array(sizes), values], ["part", "before", "doc_id", "n", "ids"]
                )
                before += int(stops[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "part long, before long, doc_id long, n long, ids binary")
    return stored(rows, "tokens", compression="zstd")


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end: int = END, plain_specials: bool = False, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and sequence_tokens; with_ids adds
    the piece's ids as an array."""
    rows = token_rows(docs, tokenizer, end, plain_specials)
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a number a partition
    firsts, all_tokens = {}, 0
    for r in totals:
        firsts[r.part] = all_tokens
        all_tokens += r.n
    sent = rows.sparkSession.sparkContext.broadcast(firsts)
    schema = PIECE + ", sequence_tokens long" + ", ids array<long>" * with_ids

    def cut(batches):
        for batch in batches:
            part, before, doc_ids, sizes, values = (batch.column(i) for i in range(5))
            first = np.array([sent.value[p] for p in part.to_pylist()], np.int64) + before.to_numpy()
            sizes = sizes.to_numpy()
            count = (first + sizes - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(first)), count)
            window = (first // length)[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(window * length, first[row])
            stop = np.minimum((window + 1) * length, (first + sizes)[row])
            start, held = begin - first[row], [memoryview(v.as_buffer()) for v in values]
            crc = [zlib.crc32(held[r][4 * a : 4 * b]) for r, a, b in zip(row.tolist(), start.tolist(), (stop - first[row]).tolist(), strict=True)]
            out = [
                doc_ids.take(pa.array(row)), pa.array(start), pa.array(stop - begin), pa.array(crc, pa.int64()), pa.array(sizes[row]), pa.array(window),
                pa.array(begin - window * length), pa.array(np.minimum(length, all_tokens - window * length)),
            ]
            if with_ids:
                ids = np.frombuffer(b"".join(held), np.uint32).astype(np.int64)
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(stop - begin)), pa.int32()), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in schema.split(", ")])

    return rows.select("part", "before", "doc_id", "n", "ids").mapInArrow(cut, schema)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces with ids: each sequence whole, padded to `length` unless its own length is a
    power of two. A sequence has at most `length` pieces."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    rows = rows.select("sequence_id", F.flatten("held.ids").alias("ids"))
    n = F.size("ids")
    padded = F.when((n > 0) & (F.bit_count(n) == 1), n).otherwise(F.lit(length))
    return rows.select("sequence_id", n.cast("long").alias("n_tokens"), F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), padded - n)).alias("ids"))


def op11_packing(spark, sf_dir) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
