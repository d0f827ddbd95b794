"""Analysis of a stream of documents: the batch plan is row-local, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import Classifier, rule_classifier
from ..plans.options import Options
from ..plans.pipeline import analyze, entity_rows


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def entity_stream(docs: DataFrame, options: Options = Options(), classifier: Classifier = rule_classifier) -> DataFrame:
    """One row an entity, as documents arrive."""
    return entity_rows(analyze(docs, options, classifier), "doc_id")


def label_counts_by_window(entities: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, label, entities) of a stream of entity rows with a time column; later rows than `late` are left out."""
    return entities.withWatermark(time, late).groupBy(F.window(time, width), "label").agg(F.count("*").alias("entities"))


def write_entities(entities: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Start writing to Parquet, each input row once."""
    writer = entities.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
