"""Training rows labelled by a model: its spans rejoined and verified, the rows split and written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from ..plans.options import Options
from ..plans.pipeline import analyze
from ..sources.sinks import write_dataset
from .classify import Classifier
from .corpus import split_rows

#: Fixed: the share of rows for the second set, and the seed of the split.
DEV_SHARE, SEED = 0.05, 11


def labelled_rows(lines: DataFrame, model: Classifier, options: Options = Options(max_characters=None)) -> DataFrame:
    """(row, text, entities) of (text), written: the model's spans over whole lines, joined, cut to size and verified, and a
    number of the row. The model runs once. A line on which it raises is left out, since it would pass for one without
    entities."""
    whole = Options(min_score=options.min_score, window=1 << 30, overlap=0, max_characters=None, max_word_gap=options.max_word_gap)
    out = analyze(lines.select("text"), whole, model, error="error")
    short = F.transform("entities", lambda e: F.struct(e["start"], e["end"], e["label"])).alias("entities")
    return scratch.checkpointed(out.select(F.monotonically_increasing_id().alias("row"), "text", short, "error")).where(F.col("error").isNull()).drop("error")


def write_labelled(lines: DataFrame, model: Classifier, train: str, dev: str, share: float = DEV_SHARE, seed: int = SEED, options: Options = Options(max_characters=None)) -> None:
    """Write both sets as JSON Lines, split by a digest of each row's number."""
    rows = labelled_rows(lines, model, options)
    marks = split_rows(rows.select("row"), "row", share, seed)  # numbers only; texts move once, to their mark
    met = rows.join(marks.where("is_dev").select("row", F.lit(True).alias("is_dev")), "row", "left")
    write_dataset(met.where(F.col("is_dev").isNull()), train)
    write_dataset(met.where(F.col("is_dev")), dev)


def labelled(rows: DataFrame, *by: str) -> DataFrame:
    """Rows and labelled entities of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("labelled"))
