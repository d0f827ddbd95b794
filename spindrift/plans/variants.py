"""Evaluation of classifiers against gold spans and against one of them as the baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation
from ..operators.chunking import windows
from ..operators.classify import Classifier, ModelClassifier, classify_windows, place_windows
from .options import Options
from .pipeline import analyze, clip
from .scratch import checkpointed

#: With all steps of the analysis, or with the spans as they leave the classifier.
MODES = ("production", "raw")


def variant_keys(docs: DataFrame, classifier: Classifier, mode: str, options: Options = Options()) -> DataFrame:
    """The distinct (doc_id, start, end, label) that a classifier gives for docs (doc_id, text)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "production":
        return evaluation.span_keys(analyze(docs, options, classifier))
    out = clip(docs, options).withColumn("_chunks", windows(F.col("text"), options.window, options.overlap))
    if isinstance(classifier, ModelClassifier):
        out = out.withColumn("_found", classifier.windows(F.transform("_chunks", lambda c: c["text"])))
        spans = place_windows(F.col("_chunks"), F.col("_found.spans"))
    else:
        spans = classify_windows(F.col("_chunks"), classifier)
    return evaluation.span_keys(out.select("doc_id", F.filter(spans, lambda s: s["score"] >= options.min_score).alias("entities")))


def compare_variants(docs: DataFrame, gold: DataFrame, variants: dict[str, Classifier], baseline: str, options: Options = Options()) -> DataFrame:
    """One row a variant and mode: hit, extra, miss, precision, recall and f1 against gold (doc_id, start, end, label), and
    span_agreement and exact_documents against the baseline's spans in the same mode."""
    if baseline not in variants:
        raise ValueError(f"unknown baseline: {baseline}")
    rows = []
    for mode in MODES:
        keys = {name: checkpointed(variant_keys(docs, c, mode, options)) for name, c in variants.items()}
        for name, found in keys.items():
            # One row on each side.
            row = evaluation.scores(found, gold).crossJoin(evaluation.fidelity(docs, found, keys[baseline]))
            rows.append(row.select(F.lit(name).alias("variant"), F.lit(mode).alias("mode"), "*"))
    return reduce(DataFrame.unionByName, rows)
