"""Operator 5, line dedup: levelled sorted runs of line hashes, with DataFrame functions only.

Documents are dealt into batches by a hash of doc_id. The lines of a batch become (hash, number of documents) rows that
are written as one level-0 run; before that they are merge-anti-joined with the keys that the runs already show to be
over the threshold, since those need no more counting. When a level holds `fanout` runs they are merged into one run of
the next level. At the end the runs are merged once more, and keys over the threshold lose their lines.

A run is a bucketed table: its rows are dealt by key hash into as many buckets as a shuffle has partitions, and sorted
within each. So the counts of a batch meet each run bucket by bucket, and no anti-join moves a run's rows. A compaction
reads its runs' files as they are and sums them up by an ordinary aggregate, with an exchange. A batch has some
`batch_docs` documents, and there are four at least.

Defined results: a null or empty text is one empty line; keys shorter than `min_chars` are never dropped; a row
without doc_id counts as the one document null; rows that share a doc_id count as one document but are each returned;
an empty table gives an empty result; long texts are taken whole, one row at a time; columns n_lines and n_dropped are
added, or replaced if docs has them; all other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh_names, lower_az, scratch, stored, table


def line_key(line: Column) -> Column:
    return lower_az(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits: two 64-bit hashes whose seeds differ."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled runs. A run is a table of (a, b, n), bucketed and sorted by the key hashes a and b; `levels[k]` lists
    the names of level k."""

    def __init__(self, spark, min_docs: int, fanout: int):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame, level: int) -> None:
        path = scratch(self.spark, f"lines-{level}")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        run.select("a", "b", "n").write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", path).saveAsTable(name)
        self.paths[name] = path
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.merged(self.levels[level]), []
            self._write(merged, level + 1)

    def merged(self, names: list[str] | None = None) -> DataFrame:
        names = [n for level in self.levels for n in level] if names is None else names
        # By path: a union of bucketed scans counts as dealt by key, but its groups came out in pieces (Spark 4.1.2).
        rows = self.spark.read.schema("a bigint, b bigint, n bigint").parquet(*(self.paths[n] for n in names))
        return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Take in one batch of (key, n), each key once."""
        counts = counts.select("key.a", "key.b", "n")
        for name in (n for level in self.levels for n in level):
            closed = self.spark.table(name).where(F.col("n") >= self.min_docs).select("a", "b")
            counts = counts.join(closed.hint("merge"), ["a", "b"], "left_anti")
        self._write(counts, 0)

    def frequent(self) -> DataFrame:
        """(key, n) of the keys over the threshold."""
        return self.merged().where(F.col("n") >= self.min_docs).select(F.struct("a", "b").alias("key"), "n")

    def forget(self) -> None:
        """Take the runs out of the catalog."""
        for name in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


#: Beyond as many batches rows are dealt to their batch's tasks before they are written, so that files stay few.
FEW_BATCHES = 16


def line_signatures(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """(doc_id, h, batch, a, b), stored: the distinct line keys of each row, known by its doc_id and its text's hash h."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars), key_hash))
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), batch, F.explode(keys).alias("key"))
    rows = rows.select("doc_id", "h", "batch", "key.a", "key.b")
    if batches > FEW_BATCHES:
        parts = max(batches, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(parts, "batch", F.pmod("h", F.lit(parts // batches)))
    path = scratch(docs.sparkSession, "line-keys")
    rows.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def line_dedup(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int | None = None, fanout: int = 3, batch_docs: int = 50_000_000
) -> DataFrame:
    """`docs` with lines dropped from text whose key at least `min_docs` documents hold, plus n_lines and n_dropped."""
    spark = docs.sparkSession
    if batches is None:
        batches = max(4, -(-docs.count() // batch_docs))
    signatures = line_signatures(docs, min_chars, batches)
    runs = LineRuns(spark, min_docs, fanout)
    for i in range(batches):
        one = signatures.where(F.col("batch") == i)
        # A doc_id that stands on several rows counts once; the inner level is already distinct within a row.
        runs.add(one.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("*").alias("n")).select(F.struct("a", "b").alias("key"), "n"))
    frequent = stored(runs.frequent().select("key.a", "key.b"), "frequent-lines")
    runs.forget()

    # AQE splits the partitions of a very common line, which the join then meets in several tasks.
    drop, id_, h, of, kept = fresh_names(docs, "_drop", "_id", "_h", "_of", "_kept")
    drops = signatures.join(frequent, ["a", "b"]).groupBy(F.col("doc_id").alias(id_), F.col("h").alias(of)).agg(F.collect_set(F.struct("a", "b")).alias(drop))
    lines = lines_of(F.col("text"))
    gone = lambda x: (F.length(line_key(x)) >= min_chars) & F.array_contains(F.col(drop), key_hash(line_key(x)))
    joined = docs.withColumn(h, F.xxhash64("text"))
    joined = joined.join(drops, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(of)), "left")
    out = joined.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~gone(x))))
    new = {
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": (F.size(lines) - F.size(kept)).cast("long"),
        "text": F.array_join(kept, "\n"),
    }
    return out.withColumns(new).drop(drop, id_, h, of, kept)


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), flagged AS (
  SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AS dropped
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
