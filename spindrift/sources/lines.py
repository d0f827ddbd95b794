"""Lines of text files with their places, however many files and splits there are.

Spark packs splits into partitions by size, so the order of rows says nothing of the order of lines. Here a line's place is
its split's, known by path, file and first byte, and then its own within the split, which one task reads from front to
back. Counts by split, a row each, give the numbers at which splits begin; no file is held as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What ends a line for Python's splitlines, beside what ends a row of Spark's text source.
INNER_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85  ]"
SPLIT = ["path_no", "file", "block"]


def line_rows(spark: SparkSession, paths: list[str], feeds_only: bool = False) -> DataFrame:
    """(path_no, file, block, at, part, value): the lines of the paths (files, folders or patterns), numbered from 0 in the
    order given. `at` and `part` order the lines of a split. With feeds_only a line ends at a line feed and nowhere else."""
    reader = spark.read.option("lineSep", "\n") if feeds_only else spark.read
    rows = None
    for i, path in enumerate(paths):
        one = reader.text(path).select(
            F.lit(i).alias("path_no"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"), F.make_valid_utf8("value").alias("value"),
        )
        rows = one if rows is None else rows.union(one)
    if feeds_only:
        return rows.withColumn("part", F.lit(0))
    return rows.select(*SPLIT, "at", F.posexplode(F.split("value", INNER_BREAKS, -1)).alias("part", "value"))


def split_starts(rows: DataFrame, *within: str) -> DataFrame:
    """(path_no, file, block, n, before, first, plain): how many rows a split has and how many lie before it (within equal
    columns `within`), its first `at`, and whether each row of it is a line of its own."""
    sizes = rows.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.min("at").alias("first"), (F.max("part") == 0).alias("plain"))
    order = Window.partitionBy(*within).orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # over splits, not lines
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def _placed(rows: DataFrame) -> Column:
    """A row's number within its split, from 1."""
    return F.row_number().over(Window.partitionBy(*SPLIT).orderBy("at", "part"))


def physical_lines(spark: SparkSession, paths: list[str], feeds_only: bool = False) -> DataFrame:
    """(path_no, line_no, value): all lines, numbered from 1 within their path; a folder's files come by name.

    Where a row of the text source is a line, its number is a difference; only splits with other breaks are sorted."""
    rows = line_rows(spark, paths, feeds_only)
    met = rows.join(split_starts(rows, "path_no"), SPLIT)
    plain = met.where("plain").select("path_no", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")
    if feeds_only:
        return plain
    other = met.where("NOT plain").select("path_no", (F.col("before") + _placed(met)).alias("line_no"), "value")
    return plain.union(other)


def first_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of rows as line_rows gives them, or of those that a filter left: whole splits up to the one that the
    limit falls into, and of this one its first rows."""
    met = rows.join(split_starts(rows).where(F.col("before") < limit).drop("first", "plain"), SPLIT)
    whole = met.where(F.col("before") + F.col("n") <= limit)
    cut = met.where(F.col("before") + F.col("n") > limit)
    cut = cut.withColumn("_place", _placed(cut)).where(F.col("_place") <= limit - F.col("before")).drop("_place")
    return whole.union(cut).drop("n", "before")


def running_total(rows: DataFrame, value: str, out: str) -> DataFrame:
    """`rows` with out, the sum of `value` over all rows before each, in their order: by split, and within splits."""
    sums = rows.groupBy(*SPLIT).agg(F.sum(value).alias("_n"))
    order = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # over splits, not lines
    starts = sums.select(*SPLIT, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*SPLIT).orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, SPLIT)
    return met.withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, value): a CSV file's records, numbered from 0, as their text; empty ones are skipped and don't count.

    A line begins a record where the quotes before it are even in number, which sums by split tell, so a file of quoted line
    feeds is read by as many tasks as it has splits. Quotes must stand around fields, or be doubled within these; a record's
    lines meet in one row."""
    rows = line_rows(spark, [path], feeds_only=True)
    rows = rows.withColumn("_quotes", (F.length("value") - F.length(F.replace("value", F.lit('"')))).cast("long"))
    rows = running_total(rows, "_quotes", "_before").withColumn("_begins", (F.col("_before") % 2 == 0).cast("long"))
    rows = running_total(rows, "_begins", "_earlier").withColumn("_record", F.col("_earlier") + F.col("_begins"))
    one = F.array_sort(F.collect_list(F.struct(*SPLIT, "at", "value")))
    records = rows.groupBy("_record").agg(F.array_join(F.transform(one, lambda x: x["value"]), "\n").alias("value"))
    records = records.withColumn("value", F.regexp_replace("value", r"\r\z", "")).where("value <> ''")
    # Numbered as lines are: by ranges of records.
    records = records.withColumns({"path_no": F.lit(0), "file": F.lit(""), "block": F.floor(F.col("_record") / 100_000), "at": F.col("_record"), "part": F.lit(0), "_one": F.lit(1)})
    return running_total(records, "_one", "record").select("record", "value")
