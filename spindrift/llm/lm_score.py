"""Operator 7, LM scoring: the marginal probability of a text over all its subword segmentations.

The vocabulary and its ranks are those of an existing tokenizer; the ranks give a prior weight 1 / (rank + 10) to
each piece. The weights are re-estimated by `rounds` steps of expectation maximisation over all words of the training
documents, counted by Spark, each distinct word once with its count. A word's probability is the log-space forward
sum over its lattice of pieces; pieces don't cross white space, so a text's probability is the product over its
words, each drawn against the end of the text. Characters without a piece are spelled by the byte pieces.

Documents meet their words' scores without a big join: words above a count that keeps them under `broadcast_words`
and `broadcast_bytes` are broadcast, and only the rest, a small part of the tokens, is joined by word.

Defined results: a null or empty text is the end token alone; rows that share a doc_id are scored one by one; a null
doc_id counts as a training row; an empty table gives an empty result; other columns are ignored. Long texts are taken
whole; a word of any length is one lattice, of which a task holds some 200 bytes a character.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import grouped, mix, powers
from .common import WORD, lower_az, stored, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of words that a task lays out at once.
GROUP = 1 << 19
LN10 = math.log(10)
BEGIN = "▁"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


class Pieces:
    """The vocabulary: for each piece length sorted hashes with piece ids, log weights, and the ids of the byte pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.get_piece_size()
        self.bytes = np.full(256, -1)
        strings, ids = [], []
        for i in range(self.size):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                strings.append(model.id_to_piece(i))
                ids.append(i)
        if (self.bytes < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        lens = np.array([len(s) for s in strings])
        self.longest = int(lens.max())
        self.by_length = {}
        for n in np.unique(lens):
            mine = np.flatnonzero(lens == n)
            codes = np.frombuffer("".join(strings[i] for i in mine).encode("utf-32-le"), np.uint32)
            hashes = sub_hashes(prefix_hashes(codes), int(n))[:: int(n)]
            order = np.argsort(hashes)
            seen = np.zeros(1 << 20, bool)
            seen[hashes >> np.uint64(44)] = True
            self.by_length[int(n)] = (hashes[order], np.array(ids)[mine][order], seen)
        rank = -np.array([model.get_score(i) for i in range(self.size)])
        prior = np.where(np.isin(np.arange(self.size), [*ids, *self.bytes]), 1 / (np.maximum(rank, 0) + 10), 0)
        prior[self.bytes] = prior[ids].min()
        self.prior = prior / prior.sum()
        self.log = np.log(np.maximum(self.prior, 1e-300))

    def learn(self, counts: np.ndarray, strength: float = 1000.0) -> None:
        """New weights from expected counts, with `strength` pseudo-counts spread as the prior."""
        weights = counts + strength * self.prior
        self.log = np.log(np.maximum(weights / weights.sum(), 1e-300))


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """h[i] = sum of codes[j] * RADIX^j over j < i, modulo 2^64."""
    h = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes))[0][: len(codes)], out=h[1:])
    return h


def sub_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each substring of n codes, mixed."""
    size = len(h) - n
    return mix((h[n:] - h[:-n]) * powers(size)[1][:size])


class Lattice:
    """All pieces in a group of words: edges from code point `start` to `end` with their `piece` (-1: spelled by bytes,
    whose log weight is in `spelled`), sorted by end offset within the word, then by end."""

    def __init__(self, words: list[str], pieces: Pieces):
        text = BEGIN + BEGIN.join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.array([len(w) + 1 for w in words])
        self.stop = np.cumsum(lens)  # node after the last code point
        self.first = self.stop - lens
        left = np.repeat(self.stop, lens) - np.arange(len(codes))  # code points to the word's end
        h = prefix_hashes(codes)
        starts, ends, ids = [], [], []
        single = np.zeros(len(codes), bool)
        for n, (hashes, piece, seen) in pieces.by_length.items():
            if n > len(codes):
                continue
            sub = sub_hashes(h, n)
            at = np.flatnonzero(seen[sub >> np.uint64(44)] & (left[: len(sub)] >= n))
            place = np.minimum(np.searchsorted(hashes, sub[at]), len(hashes) - 1)
            hit = hashes[place] == sub[at]
            at, place = at[hit], place[hit]
            starts.append(at)
            ends.append(at + n)
            ids.append(piece[place])
            if n == 1:
                single[at] = True
        odd = np.flatnonzero(~single)
        self.odd_bytes = [text[i].encode("utf-8", "surrogatepass") for i in odd]
        start, end, ids = np.concatenate([*starts, odd]), np.concatenate([*ends, odd + 1]), np.concatenate([*ids, -1 - np.arange(len(odd))])
        # A word is its own run of nodes: node i of a word stands before its code point i, the last one is shared with the
        # next word's begin, so ends are kept apart by the word's number.
        word = np.repeat(np.arange(len(words)), lens)[start]
        self.start, self.end, self.piece = start + word, end + word, ids
        self.first, self.stop = self.first + np.arange(len(words)), self.stop + np.arange(len(words))
        self.offset = self.end - self.first[word]
        self.word = word
        order = np.lexsort((self.end, self.offset))
        for name in ("start", "end", "piece", "offset", "word"):
            setattr(self, name, getattr(self, name)[order])
        self.nodes = len(codes) + len(words)

    def weights(self, pieces: Pieces) -> np.ndarray:
        spelled = np.array([pieces.log[pieces.bytes[list(b)]].sum() for b in self.odd_bytes] or [0.0])
        return np.where(self.piece >= 0, pieces.log[np.maximum(self.piece, 0)], spelled[np.maximum(-1 - self.piece, 0)])

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log of the sum over all ways to reach each node."""
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.first] = 0
        cut = np.flatnonzero(np.append(True, self.offset[1:] != self.offset[:-1])) if len(self.offset) else []
        for a, b in zip(cut, [*cut[1:], len(self.offset)], strict=True):
            value = alpha[self.start[a:b]] + weight[a:b]
            end = self.end[a:b]
            new = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            alpha[end[new]] = log_sums(value, new)
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        """Log of the sum over all ways from each node to its word's end."""
        beta = np.full(self.nodes, -np.inf)
        beta[self.stop] = 0
        place = self.start - self.first[self.word]
        order = np.lexsort((self.start, -place))
        start, end, w, place = self.start[order], self.end[order], weight[order], place[order]
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else []
        for a, b in zip(cut, [*cut[1:], len(place)], strict=True):
            value = beta[end[a:b]] + w[a:b]
            new = np.flatnonzero(np.append(True, start[a + 1 : b] != start[a : b - 1]))
            beta[start[a:b][new]] = log_sums(value, new)
        return beta


def log_sums(value: np.ndarray, new: np.ndarray) -> np.ndarray:
    """log(sum(exp(value))) of the runs that begin at `new`."""
    top = np.maximum.reduceat(value, new)
    count = np.diff(np.append(new, len(value)))
    return top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), new))


def word_groups(words: list[str]) -> list[tuple[int, int]]:
    return grouped([len(w) + 1 for w in words], GROUP)


def word_scores(words: list[str], pieces: Pieces) -> np.ndarray:
    """Natural log of the marginal probability of each word."""
    out = np.zeros(len(words))
    for a, b in word_groups(words):
        lattice = Lattice(words[a:b], pieces)
        out[a:b] = lattice.forward(lattice.weights(pieces))[lattice.stop]
    return out


def expected_counts(words: list[str], counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece is expected in the words, each of which occurs counts times."""
    out = np.zeros(pieces.size)
    for a, b in word_groups(words):
        lattice = Lattice(words[a:b], pieces)
        weight = lattice.weights(pieces)
        alpha, beta = lattice.forward(weight), lattice.backward(weight)
        share = np.exp(alpha[lattice.start] + weight + beta[lattice.end] - alpha[lattice.stop][lattice.word]) * counts[a:b][lattice.word]
        whole = lattice.piece >= 0
        out += np.bincount(lattice.piece[whole], share[whole], pieces.size)
        for k, x in zip(lattice.piece[~whole], share[~whole], strict=True):
            out += np.bincount(pieces.bytes[list(lattice.odd_bytes[-1 - k])], minlength=pieces.size) * x
    return out


def learned(words: DataFrame, pieces: Pieces, rounds: int) -> Pieces:
    """`pieces` with weights re-estimated from (word, c)."""
    spark = words.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(pieces)

        def expect(batches, sent=sent):
            total = np.zeros(sent.value.size)
            for batch in batches:
                total += expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy(), sent.value)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

        rows = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        found = rows.toPandas()  # a row a piece of the vocabulary at most
        counts = np.zeros(pieces.size)
        counts[found["piece"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
        pieces.learn(counts)
    return pieces


def score_texts(
    docs: DataFrame, training: Column, model_file: str = VOCABULARY, rounds: int = 1, broadcast_words: int = 200_000, broadcast_bytes: int = 16 << 20
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of docs, learned from the `training` rows."""
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(training, F.lit(True)).alias("training"), words_of(F.col("text")).alias("words")
    )
    tokens = rows.select("row", "doc_id", "training", F.explode_outer("words").alias("word"))
    seen = tokens.where(F.col("word").isNotNull()).groupBy("word").agg(
        F.count("*").alias("n"), F.sum(F.col("training").cast("long")).alias("c")
    )
    words = stored(seen, "words")
    texts = docs.where(F.coalesce(training, F.lit(True))).count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = total["n"] + texts, total["v"] + (texts > 0)
    pieces = learned(words, Pieces(model_file), rounds)
    end = (texts + 1) / (n + 2)
    sent = spark.sparkContext.broadcast(pieces)

    def score(batches):
        for batch in batches:
            lm = (word_scores(batch.column(0).to_pylist(), sent.value) + math.log(1 - end)) / LN10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lm)], ["word", "c", "lm"])

    def scored(part: DataFrame) -> DataFrame:
        out = part.select("word", "c").mapInArrow(score, "word string, c long, lm double")
        return out.select(
            "word", "lm", F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("base"), (F.col("c") > 0).cast("long").alias("known")
        )

    # The least power of two over which few enough words stand: some rows of a histogram. A row of a broadcast table
    # takes its word and some 64 bytes.
    sizes = words.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("rows"), F.sum(F.octet_length("word") + 64).alias("bytes")).collect()
    power = max((r.k for r in sizes), default=0) + 1
    above = lambda p: [sum(r[c] for r in sizes if r.k >= p) for c in ("rows", "bytes")]
    while power > 0 and above(power - 1)[0] <= broadcast_words and above(power - 1)[1] <= broadcast_bytes:
        power -= 1
    often = F.col("n") >= 2**power
    top = scored(words.where(often)).withColumnRenamed("word", "top")
    rare = scored(words.where(~often)).select(*[F.col(c).alias(f"rare_{c}") for c in ("word", "lm", "base", "known")])

    met = tokens.join(F.broadcast(top), F.col("word") == F.col("top"), "left")
    # Tokens that are settled fall together in one row of their document, under a key that no word has.
    open_word = F.col("word").isNotNull() & F.col("top").isNull()
    met = met.withColumn("key", F.when(open_word, F.col("word")).otherwise(F.concat(F.lit(" "), F.col("row").cast("string"))))
    met = met.groupBy("row", "doc_id", "key").agg(
        F.count("word").alias("n"), F.coalesce(F.sum("base"), F.lit(0.0)).alias("base"), F.coalesce(F.sum("lm"), F.lit(0.0)).alias("lm"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("known"),
    )
    met = met.join(rare.hint("merge"), F.col("key") == F.col("rare_word"), "left")
    add = lambda name: F.sum(F.col(name) + F.coalesce(F.col("n") * F.col(f"rare_{name}"), F.lit(0)))
    out = met.groupBy("row", "doc_id").agg(F.sum("n").alias("words"), add("base").alias("base"), add("lm").alias("lm"), add("known").alias("known"))
    return out.select(
        "doc_id", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + int(texts > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + math.log10((texts + 1) / (n + v + 1))).alias("base_score"), (F.col("lm") + math.log10(end)).alias("score"),
    )


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))


def op7_lm_score(spark, sf_dir) -> DataFrame:
    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
