"""Overlapping character windows whose ends are moved back to white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import empty, let, row

CHUNK = "struct<offset:int,text:string>"


def snapped_end(text: Column, start: Column, end: Column) -> Column:
    """The place after the last white space in the last quarter of [start, end), or end."""
    floor = start + F.floor((end - start) * 3 / 4).cast("int")
    tail = F.length(F.regexp_extract(text.substr(floor + 1, end - floor), r"(?U)([^\s\x1c-\x1f]*)\z", 1))
    return let(tail, lambda n: F.when(n < end - floor, end - n).otherwise(end))


def steps(length: Column, window: int, overlap: int) -> Column:
    """How many windows a text can need: a window advances by three quarters of its width less the overlap at least."""
    least = max(1, window * 3 // 4 - overlap)
    return F.floor(length / least).cast("int") + 1


def windows(text: Column, window: int = 1200, overlap: int = 200) -> Column:
    """array<struct<offset, text>>: each start depends on the end before, so this is a fold over window numbers."""
    def of(n: Column) -> Column:
        def add(a: Column, _: Column) -> Column:
            def put(end: Column) -> Column:
                chunk = row(offset=a["start"], text=text.substr(a["start"] + 1, end - a["start"]))
                return row(start=F.greatest(end - overlap, a["start"] + 1), done=end >= n, out=F.concat(a["out"], F.array(chunk)))

            whole = F.least(a["start"] + window, n)
            end = F.when(whole < n, snapped_end(text, a["start"], whole)).otherwise(whole)
            return F.when(a["done"], a).otherwise(let(end, put))

        begin = row(start=F.lit(0), done=n == 0, out=empty(CHUNK))
        many = F.aggregate(F.sequence(F.lit(1), steps(n, window, overlap)), begin, add, lambda a: a["out"])
        single = F.when(n == 0, empty(CHUNK)).otherwise(F.array(row(offset=F.lit(0), text=text)))
        return F.when(n <= window, single).otherwise(many)

    return let(F.length(text), of)


def window_rows(docs: DataFrame, window: int = 1200, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_no, offset, text), one row a window."""
    return docs.select("doc_id", F.posexplode(windows(F.col("text"), window, overlap)).alias("chunk_no", "c")).select(
        "doc_id", "chunk_no", F.col("c.offset").alias("offset"), F.col("c.text").alias("text")
    )
