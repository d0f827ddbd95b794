"""WordPiece: words with offsets from SQL, pieces of distinct words from a small Python helper or from two automata."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .patterns import find_all
from .trie import Trie, code_points, each_distinct, ragged

#: Fixed pattern of a word or a single sign.
PIECE_WORD = r"[\p{L}\p{N}]+(?:[.@+_'-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"
WORDS = f"(?U){PIECE_WORD}"


def words_of(text: Column) -> Column:
    """array<struct<start, end, text>>"""
    return find_all(text, WORDS)


def plain_word(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


def _reorders(c: str) -> bool:
    """Whether a character is folded by its neighbours too: the sigma, and marks that stay but change places."""
    return c == "Σ" or any(unicodedata.combining(x) and unicodedata.category(x) != "Mn" for x in unicodedata.normalize("NFD", c))


def folded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of plain_word of all words, one after another, and their number by word: by a table of the characters
    that occur."""
    codes, lens = code_points(words)
    seen, place = np.unique(codes, return_inverse=True)
    odd = np.array([_reorders(chr(c)) for c in seen], bool)
    if odd.any():
        owners = set(np.repeat(np.arange(len(words)), lens)[odd[place]].tolist())
        codes, lens = code_points([plain_word(w) if i in owners else w for i, w in enumerate(words)])
        seen, place = np.unique(codes, return_inverse=True)
    new, many = ragged(*code_points([plain_word(chr(c)) for c in seen]), place)
    return new, np.bincount(np.repeat(np.arange(len(words)), lens), many, len(words)).astype(np.int64)


class WordPieces:
    """A vocabulary as two automata, one of pieces that begin a word and one of pieces that go on."""

    def __init__(self, tokens: list[str], ids: np.ndarray):
        ids = np.asarray(ids, np.int64)
        inner = [i for i, t in enumerate(tokens) if t.startswith("##") and len(t) > 2]
        self.first, self.inner = Trie(tokens, ids), Trie([tokens[i][2:] for i in inner], ids[inner])
        known = dict(zip(tokens, ids.tolist(), strict=True))
        #: Fixed: the ids of these tokens where the vocabulary lacks them.
        self.unknown, self.begin, self.end = (known.get(t, i) for t, i in (("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3)))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids of each word), as longest_pieces gives them."""
        codes, lens = folded(words)
        at = np.cumsum(lens) - lens
        stop, live, trie = at + lens, np.flatnonzero(lens), self.first
        owner, found, lost = [], [], np.zeros(len(words), bool)
        while len(live):
            length, piece = trie.longest_at(codes, at[live], stop[live])
            lost[live[piece < 0]] = True
            live, length, piece = live[piece >= 0], length[piece >= 0], piece[piece >= 0]
            owner.append(live)
            found.append(piece)
            at[live] += length
            live, trie = live[at[live] < stop[live]], self.inner
        owner_, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, found))
        kept = ~lost[owner_]
        owner_, ids = np.append(owner_[kept], np.flatnonzero(lost)), np.append(ids[kept], np.full(lost.sum(), self.unknown))
        order = np.argsort(owner_, kind="stable")
        return ids[order], np.bincount(owner_, minlength=len(words))


def load_wordpieces(vocab: DataFrame, most: int = 4_000_000, most_bytes: int = 64 << 20) -> WordPieces:
    """The automata of (token, id), which go to every task; so the vocabulary's size is checked."""
    size = vocab.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0)).alias("bytes")).first()
    if size.n > most or size.bytes > most_bytes:
        raise ValueError(f"the vocabulary is too large for a task: {size.n} tokens, {size.bytes} bytes")
    rows = vocab.select("token", "id").orderBy("id").toPandas()
    return WordPieces(rows["token"].tolist(), rows["id"].to_numpy(np.int64))


def encoded(docs: DataFrame, pieces: WordPieces, text: str = "text") -> DataFrame:
    """`docs` with tokens, array<struct<id, start, end>>: CLS, the pieces with the words that own them, SEP. Row-local."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("array<array<int>>")
    def cut(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in words:
            ids, sizes = each_distinct(sent.value.encode, batch.flatten())
            rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.ListArray.from_arrays(batch.offsets if not batch.offset else pa.array(batch.offsets.to_numpy() - batch.offsets[0].as_py(), pa.int32()), rows)

    out = docs.withColumn("_words", words_of(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("_ids", cut.asNondeterministic()(F.transform("_words", lambda w: w["text"])))
    token = lambda i, w: F.struct(i.alias("id"), w["start"].alias("start"), w["end"].alias("end"))
    edge = lambda i: F.array(F.struct(F.lit(i).alias("id"), *[F.lit(None).cast("int").alias(c) for c in ("start", "end")]))
    inner = F.flatten(F.zip_with("_ids", "_words", lambda ids, w: F.transform(ids, lambda i: token(i, w))))
    return out.withColumn("tokens", F.concat(edge(pieces.begin), inner, edge(pieces.end))).drop("_words", "_ids")


def longest_pieces(word: str, vocab: dict[str, int], unknown: int, first: tuple[int, int] | None = None) -> list[int]:
    """Greedy longest match; one unknown id if any part has no piece. first: length and id of another piece that the
    word begins with."""
    plain = plain_word(word)
    out, at = [], 0
    while at < len(plain):
        for end in range(len(plain), at, -1):
            found = first[1] if first and not at and end == first[0] else vocab.get(("##" if at else "") + plain[at:end])
            if found is not None:
                out.append(found)
                at = end
                break
        else:
            return [unknown]
    return out


def longest_first(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, first): the longest of pieces (piece, id) that the plain word begins with, as (n, id); null if there is none.

    A word's prefixes of the lengths that pieces have are joined with them."""

    @F.pandas_udf("string")
    def plain(words: pd.Series) -> pd.Series:
        return words.map(plain_word)

    lengths = sorted(r[0] for r in pieces.select(F.length("piece")).distinct().collect())
    rows = words.select("word", plain("word").alias("_plain"))
    n = F.explode(F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda n: n <= F.length("_plain")))
    rows = rows.select("word", "_plain", n.alias("n")).select("word", "n", F.expr("left(_plain, n)").alias("piece"))
    found = rows.join(pieces, "piece").groupBy("word").agg(F.max(F.struct("n", "id")).alias("first"))
    return words.join(found, "word", "left")


def encode(docs: DataFrame, vocab: dict[str, int], text: str = "text", more: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, id, start, end): a document's ids between its CLS and SEP, with the word that owns each.

    vocab goes to every task; more (piece, id) has any number of further pieces that begin words, which are joined.

    Every distinct word is cut once and joined back, so that Python sees the vocabulary of the corpus, not its text."""
    spark: SparkSession = docs.sparkSession
    unknown, first, last = (vocab.get(t, i) for t, i in (("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3)))
    sent = spark.sparkContext.broadcast(vocab)

    @F.pandas_udf("array<int>")
    def cut(words: pd.Series) -> pd.Series:
        return words.map(lambda w: longest_pieces(w, sent.value, unknown))

    @F.pandas_udf("array<int>")
    def cut_after(words: pd.Series, n: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([longest_pieces(w, sent.value, unknown, None if pd.isna(k) else (int(k), int(i))) for w, k, i in zip(words, n, ids, strict=True)])

    tokens = docs.select("doc_id", F.posexplode(words_of(F.col(text))).alias("n", "w")).select("doc_id", "n", "w.start", "w.end", F.col("w.text").alias("word"))
    pieces = tokens.select("word").distinct()
    if more is None:
        pieces = pieces.withColumn("ids", cut("word"))
    else:
        pieces = longest_first(pieces, more).select("word", cut_after("word", F.col("first.n"), F.col("first.id")).alias("ids"))
    ids = tokens.join(pieces, "word").select("doc_id", F.col("n").cast("long").alias("n"), "start", "end", F.posexplode("ids").alias("k", "id"))
    none = F.lit(None).cast("int")
    edges = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("n"), F.lit(first).alias("id")), F.struct(F.lit(1 << 40).cast("long").alias("n"), F.lit(last).alias("id")))).alias("e"))
    edges = edges.select("doc_id", "e.n", none.alias("start"), none.alias("end"), F.lit(0).alias("k"), "e.id")
    all_ = ids.unionByName(edges)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "k")) - 1
    return all_.select("doc_id", place.alias("pos"), "id", "start", "end")
