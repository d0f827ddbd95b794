"""Readers: text and CSV uploads, JSON Lines, line corpora and vocabularies as DataFrames."""

from __future__ import annotations

import csv
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import not_blank
from .lines import csv_records, first_rows, line_rows, physical_lines

#: Fixed: column names that hold the text, tried in the order of the header.
TEXT_COLUMNS = {"text", "teks", "content", "isi"}
#: Every line break that Python's splitlines knows.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
GOLD = "text string, entities array<struct<start:int,end:int,label:string,text:string>>"


def split_lines(text: Column) -> Column:
    """array<string> of the lines; a break at the very end opens no further line."""
    parts = F.split(text, BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def numbered_lines(files: DataFrame, limit: int | None = None, text: str = "value") -> DataFrame:
    """(id, text) of whole-file rows: one document a line that isn't blank, numbered by its physical line from 1.

    The limit counts physical lines, so blank ones use it up."""
    lines = files.select(F.posexplode(split_lines(F.make_valid_utf8(F.col(text)))).alias("pos", "text"))
    if limit is not None:
        lines = lines.where(F.col("pos") < limit)
    return lines.where(not_blank(F.col("text"))).select((F.col("pos") + 1).cast("string").alias("id"), "text")


def read_txt(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, text) of one uploaded text file in its order, one document a line; numbers and limit as in numbered_lines."""
    lines = physical_lines(spark, [path])
    if limit is not None:
        lines = lines.where(F.col("line_no") <= limit)
    return some(lines.where(not_blank(F.col("value"))).orderBy("line_no").select(F.col("line_no").cast("string").alias("id"), F.col("value").alias("text")))


def text_column(names: list[str]) -> str:
    """The first column with a known name, else the first column."""
    for name in names:
        if name.strip().lower() in TEXT_COLUMNS:
            return name
    return names[0] if names else ""


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, text) of one uploaded CSV file with a header, numbered by row from 1; rows without text are left out."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    name = text_column(rows.columns)
    # A multi-line CSV file is read by one task in order, so the id's low bits count its rows.
    rows = rows.select(F.monotonically_increasing_id().alias("pos"), F.col(f"`{name}`").alias("text")) if name else rows.select(F.lit(0).alias("pos"), F.lit(None).cast("string").alias("text"))
    if limit is not None:
        rows = rows.where(F.col("pos") < limit)
    return some(rows.where(F.col("text").isNotNull() & not_blank(F.col("text"))).select((F.col("pos") + 1).cast("string").alias("id"), "text"))


def read_large_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """As read_csv, in many tasks, for files that quote whole fields or none (see csv_records). Rows keep no order."""
    records = csv_records(spark, path)
    header = records.where("record = 0").first()
    plain = {"quote": '"', "escape": '"'}
    if header is None:
        return some(records.select(F.col("record").cast("string").alias("id"), F.col("value").alias("text")))
    names = next(csv.reader(header.value.splitlines(keepends=True)))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    text = F.from_csv("value", fields, plain)[f"c{names.index(text_column(names))}"]
    rows = records.where("record > 0").select(F.col("record").alias("pos"), text.alias("text"))
    if limit is not None:
        rows = rows.where(F.col("pos") <= limit)
    return some(rows.where(F.col("text").isNotNull() & not_blank(F.col("text"))).select(F.col("pos").cast("string").alias("id"), "text"))


def read_upload(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return read_csv(spark, path, limit) if path.lower().endswith(".csv") else read_txt(spark, path, limit)


def some(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("no readable rows in file")
    return rows


def browser_lines(text: Column, csv: bool = False) -> Column:
    """array<struct<id, text>> of pasted text or, naively, of CSV text: the header and all up to each first comma go."""
    lines = F.split(text, "\n", -1)
    if csv:
        lines = F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.array_join(F.slice(F.split(x, ","), 2, 1 << 20), ","))
    kept = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")), lambda x: x != "")
    return F.transform(kept, lambda x, i: F.struct((i + 1).cast("string").alias("id"), x.alias("text")))


def read_jsonl(spark: SparkSession, path: str, schema: str = GOLD) -> DataFrame:
    return spark.read.schema(schema).json(path)


def corpus_text(text: Column) -> Column:
    return F.regexp_replace(F.make_valid_utf8(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def fits_corpus(text: Column) -> Column:
    return (F.length(text) > 15) & (F.length(text) < 600)


def read_corpus(spark: SparkSession, paths: list[str], limit: int | None = None) -> DataFrame:
    """(text) lines of many files, stripped, of 16 to 599 characters; with a limit the first of these, path after path."""
    rows = line_rows(spark, paths).withColumn("value", corpus_text(F.col("value"))).where(fits_corpus(F.col("value")))
    return (rows if limit is None else first_rows(rows, limit)).select(F.col("value").alias("text"))


def corpus_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """(text) of rows that are lines already."""
    return lines.select(corpus_text(F.col(text)).alias("text")).where(fits_corpus(F.col("text")))


def vocabulary(files: DataFrame, text: str = "value") -> DataFrame:
    """(token, id) of a vocabulary file: the line number is the id; empty lines are skipped but count; the last of equal
    tokens holds."""
    rows = files.select(F.posexplode(F.split(text, "\n", -1)).alias("id", "token"))
    rows = rows.select(F.regexp_replace("token", r"\r\z", "").alias("token"), "id").where("token <> ''")
    return rows.groupBy("token").agg(F.max("id").alias("id"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The same of a file, of whose lines none but single ones are held."""
    rows = physical_lines(spark, [path], feeds_only=True)
    rows = rows.select(F.regexp_replace("value", r"\r\z", "").alias("token"), (F.col("line_no") - 1).alias("id")).where("token <> ''")
    return rows.groupBy("token").agg(F.max("id").alias("id"))


def read_tokenizer(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece, score) of a tokenizer's JSON file; a task reads it, as one value."""

    def entries(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                pieces, scores = zip(*json.loads(text)["model"]["vocab"], strict=True)
                ids = pa.array(range(len(pieces)), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.array(pieces), pa.array(map(float, scores), pa.float64())], ["id", "piece", "score"])

    return spark.read.text(path, wholetext=True).mapInArrow(entries, "id int, piece string, score double")


def folder_mb(spark: SparkSession, path: str) -> DataFrame:
    """One row: the folder's size in MB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg((F.coalesce(F.sum("length"), F.lit(0)) / 1e6).alias("mb"))
