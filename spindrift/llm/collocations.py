"""Operator 12, phrase collocation mining over a weighted de Bruijn graph of words.

Nodes are runs of four words, edges runs of five that join overlapping nodes; an edge's weight is how often it occurs. At
each word the longest run that starts there (five words, fewer at a piece's end) is counted, and nothing else: edges, and
what pieces end with. Chains of edges that carry all the flow of the nodes between them are compacted into paths. The
count of a shorter phrase is then the flow that leaves its nodes plus the piece ends that begin with it, that is the sum
of all paths' places and of all ends of which it is a prefix.

Before edges are counted, rare words are told, then rare pairs of other words, then rare triples of other pairs, and a run
ends where it would take one in: a phrase that occurs `min_count` times has only words, pairs and triples that do, so no count
that matters changes. The others stand in bitmaps of fixed size, made by Spark; their false hits only keep more of the text,
and all counts are of the words themselves.

Scores are exact: decimals of 38 digits hold 1000 * a * n for counts up to 10^17. A longer candidate with the same count
implies one that is a single word longer, so only those are looked up.

Defined results: a null or empty text has no words; a null lang is "und"; repeated rows count again; an empty table gives
an empty result; other columns are ignored, whatever their names. Long texts are taken whole; a task holds a text some
60 times over. A path lies within one piece, so its row is no longer than that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BYTES, U, mix, powers, text_groups
from .common import stored, table

#: Words of an edge; a node has one less.
LONGEST = 5
#: Bits of a key that are sent to be counted; keys that fall together only keep more of the text.
KEY_BITS = 40
#: Up to so many words, rare runs are told before edges are counted.
PRUNED = 3
#: Bytes of text that a task lays out at once, and distinct keys that it holds before it sends them.
GROUP, HELD = 1 << 20, 1_500_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 1: between words, 2: between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class Words:
    """The words of a group of texts, one after another, with what tells pieces and languages apart."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        text = LOWER[raw]
        kind = KIND[text]
        edge = np.flatnonzero(np.diff(kind > 0, prepend=True, append=True))
        start, stop = edge[0::2], edge[1::2]
        h = np.zeros(len(text) + 1, U)
        pw, inverse = powers(len(text) + 1)
        np.cumsum(BYTES[text] * pw[: len(text)], out=h[1:])
        self.hash = mix((h[stop] - h[start]) * inverse[start] + (stop - start).astype(U))
        piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        #: Whether the next word stands in the same piece.
        self.joined = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)
        self.lang = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
        names = {name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in set(langs)}
        self.salt = np.array([names[x] for x in langs], U)[self.lang] if len(langs) else np.zeros(0, U)
        # Words with one blank behind each, so that phrases are slices.
        kept = kind == 0
        kept[stop[stop < len(text)]] = True
        self.text = np.where(kind == 0, text, 0x20).astype(np.uint8)[kept]
        place = np.cumsum(kept, dtype=np.int32) - kept
        self.start, self.stop = place[start], place[start] + (stop - start)

    def keys(self, at: np.ndarray, many: int) -> np.ndarray:
        """A hash of the `many` words from each place on, apart by language."""
        total, factors = self.salt[at].copy(), powers(LONGEST + 2)[0]
        for j in range(many):
            total += self.hash[at + j] * factors[j + 1]
        return mix(total + U(many))

    def often(self, bitmaps: list) -> list[np.ndarray]:
        """For each of the bitmaps, of runs of 1, 2, ... words: whether a run that may be frequent starts at each word."""
        out = []
        for many, bitmap in enumerate(bitmaps, 1):
            at, hit = self.candidates(out), np.zeros(len(self.hash), bool)
            hit[at[bitmap(self.keys(at, many))]] = True
            out.append(hit)
        return out

    def candidates(self, often: list[np.ndarray]) -> np.ndarray:
        """Where a run one word longer starts that has only such runs in it."""
        if not often:
            return np.arange(len(self.hash))
        both = often[-1][:-1] & often[-1][1:]
        return np.flatnonzero(both & self.joined[:-1] if len(often) == 1 else both)

    def phrases(self, at: np.ndarray, many: np.ndarray) -> pa.Array:
        lens = self.stop[at + many - 1] - self.start[at]
        ends = np.cumsum(lens)
        flat = self.text[np.repeat(self.start[at] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat))


def word_groups(batches):
    """(Words, languages of the texts) of each group of texts in batches of (lang, text)."""
    for batch in batches:
        for a, b, texts in text_groups(batch.column(1), GROUP):
            langs = batch.column(0).slice(a, b - a).to_pylist()
            yield Words(texts, langs), langs


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(n, begin) if len(begin) else n


def counted(bitmaps: list):
    """A function from batches of texts to (key, n) of runs one word longer than those of the bitmaps, summed up as far as a
    task's memory goes."""

    def count(batches):
        keys, counts, held = [], [], 0

        def sent():
            key, n = summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

        for words, _ in word_groups(batches):
            at = words.candidates(words.often(bitmaps))
            key, n = np.unique(words.keys(at, len(bitmaps) + 1) >> U(64 - KEY_BITS), return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > HELD:
                keys[:], counts[:] = zip(summed(keys, counts), strict=True)
                held = len(keys[0])
                if held > HELD // 2:
                    yield sent()
                    keys, counts, held = [], [], 0
        if held:
            yield sent()

    return count


class Bitmap:
    """Whether a key may be one of those that occur often."""

    def __init__(self, sent, bits: int):
        self.sent, self.bits = sent, bits

    def __call__(self, key: np.ndarray) -> np.ndarray:
        place = key >> U(64 - self.bits)
        return (self.sent.value[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) > 0


def frequent(texts: DataFrame, shorter: list[Bitmap], min_count: int, bits: int) -> Bitmap:
    """The runs one word longer than those of `shorter` that occur often enough, by the leading bits of their keys: 2^bits
    places, 64 in a row."""
    rows = texts.mapInArrow(counted(shorter), "key long, n long")
    often = rows.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    place = F.shiftrightunsigned("key", KEY_BITS - bits)
    slots = often.select(F.shiftrightunsigned(place, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {KEY_BITS - bits}) & 63 as int))").alias("bit"))
    found = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^(bits - 6) rows at most
    out = np.zeros(1 << max(bits - 6, 0), np.int64)
    out[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return Bitmap(texts.sparkSession.sparkContext.broadcast(out.view(U)), bits)


def longest_runs(texts: DataFrame, bitmaps: list[Bitmap]) -> DataFrame:
    """(lang, m, phrase, n): the longest run of which all parts may be frequent, of m words, that starts at each word; m = 0 has
    all words of a language. Runs of LONGEST words are edges, shorter ones are what pieces end with."""

    def count(batches):
        for words, langs in word_groups(batches):
            size = len(words.hash)
            often = words.often(bitmaps)
            many, going = sum(x.astype(np.int64) for x in often), often[-1]
            for _ in range(LONGEST - len(bitmaps)):
                going = np.append(going[:-1] & going[1:], np.zeros(min(size, 1), bool)) & often[-1]
                many += going
            key = np.zeros(size, U)
            for m in range(1, LONGEST + 1):
                mine = np.flatnonzero(many == m)
                key[mine] = words.keys(mine, m)
            at = np.flatnonzero(many)
            _, first, n = np.unique(key[at], return_index=True, return_counts=True)
            at = at[first]
            names = pa.array(langs)
            for a in range(0, len(at), 100_000):
                part = at[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(words.lang[part])), pa.array(many[part].astype(np.int32)), words.phrases(part, many[part]), pa.array(n[a : a + 100_000])],
                    ["lang", "m", "phrase", "n"],
                )
            all_words = np.bincount(words.lang, minlength=len(langs))
            totals = pa.table({"lang": names, "n": pa.array(all_words)}).group_by("lang").aggregate([("n", "sum")])
            zero = pa.array(np.zeros(len(totals), np.int32))
            yield pa.RecordBatch.from_arrays([totals["lang"].combine_chunks(), zero, pa.nulls(len(totals), pa.string()), totals["n_sum"].combine_chunks()], ["lang", "m", "phrase", "n"])

    rows = texts.mapInArrow(count, "lang string, m int, phrase string, n long")
    return stored(rows.groupBy("lang", "m", "phrase").agg(F.sum("n").alias("n")), "runs")


def part(words: Column, first: int | Column, many: int | Column) -> Column:
    """The phrase of `many` words from place `first` (1 is the first)."""
    return F.array_join(F.slice(words, first, many), " ")


def unary_paths(runs: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, n): the edges of weight `min_count` or more, those in a row joined into one phrase where they carry all
    the flow of the nodes between them. By pointer doubling, so in as many rounds as the longest path has bits."""
    words = F.split("phrase", " ")
    flow = runs.where(F.col("m") >= LONGEST - 1).groupBy("lang", part(words, 1, LONGEST - 1).alias("node")).agg(F.sum("n").alias("n"))
    often = runs.where((F.col("m") == LONGEST) & (F.col("n") >= min_count)).select("lang", "phrase", "n")
    often = stored(often.withColumns({"head": part(words, 1, LONGEST - 1), "tail": part(words, 2, LONGEST - 1)}), "edges")
    flow = flow.where(F.col("n") >= min_count)
    into = often.select("lang", F.col("tail").alias("node"), "n", F.col("phrase").alias("before"))
    out = often.select("lang", F.col("head").alias("node"), "n", "phrase")
    links = flow.join(into, ["lang", "node", "n"]).join(out, ["lang", "node", "n"]).select("lang", "phrase", "before")
    now = often.select("lang", "phrase").join(links, ["lang", "phrase"], "left")
    now = stored(now.select("lang", "phrase", F.coalesce("before", "phrase").alias("root"), F.col("before").isNotNull().cast("long").alias("far")), "paths")
    reach = -1
    while (total := now.agg(F.coalesce(F.sum("far"), F.lit(0))).first()[0]) != reach:
        reach = total
        further = now.select("lang", F.col("phrase").alias("root"), F.col("root").alias("next"), F.col("far").alias("more"))
        now = now.join(further, ["lang", "root"])
        now = stored(now.select("lang", "phrase", F.col("next").alias("root"), (F.col("far") + F.col("more")).alias("far")), "paths")
    steps = now.join(often.select("lang", "phrase", "n"), ["lang", "phrase"])
    paths = steps.groupBy("lang", "root").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("far", F.element_at(words, -1).alias("word")))).alias("steps"))
    tail = F.transform(F.slice("steps", 2, F.greatest(F.size("steps") - 1, F.lit(0))), lambda s: s["word"])
    return paths.select("lang", F.array_join(F.concat(F.split("root", " "), tail), " ").alias("phrase"), "n")


def phrase_counts(texts: DataFrame, min_count: int = 100, bits: int = 27) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, n) of all phrases of up to five words that occur `min_count` times, (lang, n) of all words), stored."""
    texts = texts.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bitmaps: list[Bitmap] = []
    for _ in range(PRUNED):
        bitmaps.append(frequent(texts, bitmaps, min_count, bits))
    runs = longest_runs(texts, bitmaps)
    paths = unary_paths(runs, min_count)
    words, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    # Where a run starts, with its words: each edge of a path, and each other run.
    on_paths = paths.select("lang", "n", words.alias("w"), F.explode(F.sequence(F.lit(1), size - LONGEST + 1)).alias("i"))
    starts = on_paths.select("lang", "n", F.slice("w", F.col("i"), LONGEST).alias("w"))
    rest = runs.where((F.col("m") > 0) & ((F.col("m") < LONGEST) | (F.col("n") < min_count))).select("lang", "n", words.alias("w"))
    flows = starts.union(rest).select("lang", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("m"))
    counts = flows.groupBy("lang", "m", part(F.col("w"), 1, F.col("m")).alias("phrase")).agg(F.sum("n").alias("n"))
    totals = runs.where(F.col("m") == 0).select("lang", "n")
    return stored(counts.where(F.col("n") >= min_count), "phrases"), totals


def collocations(texts: DataFrame, min_count: int = 100, top: int = 2000, absorbed: int = 100, bits: int = 27) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `top` phrases of two to five words. A phrase within one a
    word longer that has `absorbed` percent of its count or more is left out."""
    counts, totals = phrase_counts(texts, min_count, bits)
    phrases = counts.where(F.col("m") > 1)
    words = F.split("phrase", " ")
    longer = phrases.where(F.col("m") > 2).select("lang", "n", F.explode(F.array(part(words, 1, F.col("m") - 1), part(words, 2, F.col("m") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("n")))
    cuts = left.select("lang", "phrase", "m", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(words, 1, F.col("k")), "rest": part(words, F.col("k") + 1, F.col("m") - F.col("k"))})
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("cast((cast(1000 as decimal(4,0)) * wa) * wn as decimal(38,0)) div cast(wl * wr as decimal(38,0))")
    cuts = cuts.withColumns({"wa": F.col("a").cast("decimal(17,0)"), "wn": F.col("n").cast("decimal(17,0)"), "wl": wide("l"), "wr": wide("r")})
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rows = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task ranks all phrases of one.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), counts AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS c FROM (
    SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (
      SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, range(1, 6) AS t(m)))
  GROUP BY lang, m, phrase HAVING count(*) >= 100
), phrases AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE m > 1
), inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM phrases s JOIN phrases b
    ON s.lang = b.lang AND b.m > s.m AND 100 * b.c >= 100 * s.c AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
), cuts AS (
  SELECT p.lang, p.phrase, p.c AS a, k, f.c AS l, e.c AS r, t.n,
         (1000::HUGEINT * p.c * t.n) // (f.c::HUGEINT * e.c) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM phrases) p
  JOIN counts f ON f.lang = p.lang AND f.phrase = array_to_string(p.w[1 : k], ' ')
  JOIN counts e ON e.lang = p.lang AND e.phrase = array_to_string(p.w[k + 1 :], ' ')
  JOIN totals t ON t.lang = p.lang
  WHERE (p.lang, p.phrase) NOT IN (SELECT (lang, phrase) FROM inside)
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""
