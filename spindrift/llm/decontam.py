"""Operator 6, benchmark decontamination: a broadcast hash set of n-grams, with DataFrame functions only.

The benchmark's windows are normalised and their hashes go to every task as literals of an IN filter, which Spark
keeps as one hash set in the broadcast task. Scanning is row-local: positions whose first two words start no window
are skipped, then whole windows are looked up, and the few hits are verified by an equality join on the window's
words. The set's size is checked: beyond `max_literals` windows or `max_bytes` of their words, positions are matched
by an ordinary join instead.

Defined results: null texts have no words and no hits; an item of fewer than `n` words is one window, one without
words none; rows that share a doc_id are judged one by one; an empty table on either side gives no hits; long texts
are scanned whole, one row at a time; other columns pass through `decontaminate`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, let, lower_az, stored, table

#: A word: letters and digits of ASCII, and everything beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOKEN_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(
        F.regexp_extract_all(lower_az(text), F.lit(f"({TOKEN})"), F.lit(1)), F.array().cast("array<string>")
    )


def listed(values) -> str:
    """The inside of an SQL IN (...). SQL text, since thousands of literals are slow to hand over one by one."""
    return ", ".join(f"{v}L" for v in sorted(set(values)))


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, len, head, gram): the distinct windows of each item, words joined by a space."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    one = F.transform(starts, lambda i: F.slice("w", i, n))
    items = items.select("item_id", F.explode(F.array_distinct(one)).alias("v"))
    return items.select("item_id", F.size("v").alias("len"), head(F.col("v"), F.lit(1), F.size("v")).alias("head"), F.array_join("v", " ").alias("gram"))


def head(words: Column, at: Column, length: Column) -> Column:
    """Hash of the first two words of a window of that length (of the only word of a window of one)."""
    return F.when(length == 1, F.xxhash64(F.get(words, at - 1))).otherwise(
        F.xxhash64(F.get(words, at - 1), F.get(words, at))
    )


def scan_sql(windows: list[tuple[int, int, int]] | None, lengths: list[int]) -> str:
    """SQL for the array<struct<pos, len, gram>> of the words array w. windows: (len, head, hash) of the hash set, or
    None to return every position's window."""
    parts = []
    for size in lengths:
        at = f"CASE WHEN size(w) >= {size} THEN sequence(1, size(w) - {size - 1}) ELSE array() END"
        if windows is not None:
            first_two = "xxhash64(w[i - 1], w[i])" if size > 1 else "xxhash64(w[i - 1])"
            at = f"filter({at}, i -> {first_two} IN ({listed(x[1] for x in windows if x[0] == size)}))"
        grams = f"transform({at}, i -> named_struct('pos', i, 'len', {size}, 'gram', array_join(slice(w, i, {size}), ' ')))"
        if windows is not None:
            grams = f"filter({grams}, h -> xxhash64(h.gram) IN ({listed(x[2] for x in windows if x[0] == size)}))"
        parts.append(grams)
    return f"concat({', '.join(parts)})" if parts else "CAST(array() AS array<struct<pos:int, len:int, gram:string>>)"


def merge_spans(hits: Column) -> Column:
    """array<struct<pos, stop>>: the maximal runs of words (1-based, stop exclusive) that hits struct<pos, len> cover."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["pos"].alias("pos"), (h["pos"] + h["len"]).alias("stop"))))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["pos"].alias("pos"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= x["pos"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<struct<pos:int,stop:int>>"), add)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_literals: int = 200_000, keys: tuple[str, ...] = ("doc_id",), max_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_words, spans, items) of each row of docs: merged hit spans, and the ids of the items that occur.

    keys: the columns that a row is known by, which come out in place of doc_id."""
    grams = stored(item_windows(benchmark, n), "benchmark-grams")
    lengths = [r[0] for r in grams.select("len").distinct().collect()]  # n at most
    size = grams.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    small = size["rows"] <= max_literals and size["bytes"] <= max_bytes
    windows = None
    if small:
        windows = [tuple(r) for r in grams.select("len", "head", F.xxhash64("gram")).distinct().collect()]
    scan = F.expr(f"transform(array(_words), w -> named_struct('n_words', size(w), 'hits', {scan_sql(windows, sorted(lengths))}))[0]")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keys, words_of(F.col("text")).alias("_words"))
    rows = rows.select("_row", *keys, scan.alias("s")).select(
        "_row", *keys, F.col("s.n_words").alias("n_words"), F.explode_outer("s.hits").alias("h")
    )
    known = grams.select("item_id", "gram")
    hits = rows.join(F.broadcast(known) if small else known, F.col("h.gram") == F.col("gram"), "left")
    hit = F.when(F.col("gram").isNotNull(), F.struct(F.col("h.pos").alias("pos"), F.col("h.len").alias("len")))
    found = hits.groupBy("_row", *keys, "n_words").agg(F.collect_set(hit).alias("hits"), F.collect_set("item_id").alias("items"))
    return found.select(*keys, F.col("n_words").cast("long").alias("n_words"), merge_spans(F.col("hits")).alias("spans"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, drop_share: float = 0.8) -> DataFrame:
    """`docs` without the words of benchmark windows; documents of which these are at least `drop_share` go whole.

    Each row is judged and cut by its own spans, whatever its doc_id: spans come back by doc_id and 128 bits of the text's
    hash, and rows that agree in both have the same spans."""
    h, g, id_, fh, fg, total, spans = fresh_names(docs, "_h", "_g", "_id", "_fh", "_fg", "_n", "_spans")
    hashes = {h: F.xxhash64("text"), g: F.xxhash64(F.lit(1), "text")}
    found = contamination(docs.select("doc_id", "text").withColumns(hashes), benchmark, n, keys=("doc_id", h, g)).where(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias(id_), F.col(h).alias(fh), F.col(g).alias(fg)).agg(F.first("n_words").alias(total), F.first("spans").alias(spans))
    hit_words = F.aggregate(spans, F.lit(0), lambda a, s: a + s["stop"] - s["pos"])
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(fh)) & (F.col(g) == F.col(fg))
    joined = docs.withColumns(hashes).join(found, same, "left")
    joined = joined.where(F.col(spans).isNull() | (hit_words < F.col(total) * drop_share))
    words = F.regexp_extract_all("text", F.lit(f"({TOKEN_ANY_CASE})"), F.lit(1))
    gaps = F.split("text", TOKEN_ANY_CASE, -1)

    def rebuilt(v: Column) -> Column:
        hit = lambda i: F.exists(spans, lambda s: (s["pos"] <= i) & (i < s["stop"]))
        piece = lambda g, i: F.concat(
            F.when(hit(i) & hit(i + 1), "").otherwise(g), F.when(hit(i + 1), "").otherwise(F.coalesce(F.get(v["words"], i), F.lit("")))
        )
        return F.array_join(F.transform(v["gaps"], piece), "")

    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(
        let(F.struct(words.alias("words"), gaps.alias("gaps")), rebuilt)
    )
    return joined.withColumn("text", text).drop(id_, total, spans, h, g, fh, fg)


def op6_decontamination(spark, sf_dir) -> DataFrame:
    found = contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    )
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["pos"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), positions AS (
  SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i
  FROM d, (SELECT DISTINCT n FROM grams)
), hits AS (
  SELECT p.doc_id, p.i, g.n, g.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM positions) p
  JOIN grams g ON p.gram = g.gram AND p.n = g.n
), covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
