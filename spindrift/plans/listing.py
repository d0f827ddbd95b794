"""What a client may choose from, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.labels import label_table
from ..operators.redaction import strategy_names
from ..sources.sinks import MEDIA_TYPES
from .options import Options
from .pipeline import limits


def listing(spark: SparkSession, what: str, options: Options = Options()) -> DataFrame:
    """`labels` as label_table, or (name, value) of `strategies`, `formats` with their media types, or `limits`."""
    if what == "labels":
        return label_table(spark)
    rows = {
        "strategies": [(x, None) for x in strategy_names()], "formats": sorted(MEDIA_TYPES.items()),
        "limits": [(k, None if v is None else str(v)) for k, v in limits(options).items()],
    }
    if what not in rows:
        raise ValueError(f"unknown listing: {what}")
    return spark.createDataFrame(rows[what], "name string, value string")
