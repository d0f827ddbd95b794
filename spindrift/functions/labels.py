"""The label dimension and its lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code, display, colour, sensitivity, structured.
LABELS = [
    ("PER", "Person", "#e2504f", 4, False),
    ("LOC", "Location", "#d99b2b", 2, False),
    ("DATE_TIME", "Date or time", "#8a63d2", 3, False),
    ("EMAIL", "Email", "#2a9d8f", 4, True),
    ("PHONE", "Phone", "#3b82c4", 4, True),
    ("GENDER", "Gender", "#7d8597", 1, False),
    ("SSN", "National ID", "#b5179e", 5, True),
]
#: Fixed values of a code that isn't listed.
OTHER_COLOUR, OTHER_SENSITIVITY = "#94a3b8", 2
STRUCTURED = [x[0] for x in LABELS if x[4]]
#: BIO names in their fixed order: O, then B- and I- of each label.
BIO = ["O", *(f"{p}-{x[0]}" for x in LABELS for p in "BI")]


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "code string, display string, color string, sensitivity int, structured boolean")


def _lookup(code: Column, field: int) -> Column:
    table = F.create_map(*[F.lit(v) for x in LABELS for v in (x[0], x[field])])
    return F.try_element_at(table, code)


def sensitivity(code: Column) -> Column:
    return F.coalesce(_lookup(code, 3), F.lit(OTHER_SENSITIVITY))


def color(code: Column) -> Column:
    return F.coalesce(_lookup(code, 2), F.lit(OTHER_COLOUR))


def display(code: Column, profile: str = "server") -> Column:
    """The name shown; an unknown code is title-cased by the server profile and shown as it is by the browser's."""
    return F.coalesce(_lookup(code, 1), title(code) if profile == "server" else code)


def title(text: Column) -> Column:
    """Upper case for each letter that no letter precedes, lower case for the others."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def strip_bio(label: Column) -> Column:
    """`B-PER` becomes `PER`; so does any label whose second character is a dash."""
    tagged = (F.length(label) > 2) & (F.substring(label, 2, 1) == "-")
    return F.when(tagged, F.substring(label, 3, 1 << 30)).otherwise(label)
