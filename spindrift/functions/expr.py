"""Small builders for nested column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,score:double,seq:int>"
ENTITY = "struct<start:int,end:int,label:string,text:string,score:double,verified:boolean>"


def row(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def empty(item: str) -> Column:
    return F.array().cast(f"array<{item}>")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`: a lambda would evaluate a column that Spark inlines each time."""
    return F.transform(F.array(value), body)[0]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def any_of(items: Column, test) -> Column:
    return F.exists(items, test)
