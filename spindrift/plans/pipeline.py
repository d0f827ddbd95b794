"""The analysis of a DataFrame of documents: one lazy, row-local plan without a shuffle, so it also runs on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ENTITY, empty
from ..functions.patterns import not_blank
from ..operators import redaction, spans, stats
from ..operators.chunking import windows
from ..operators.classify import Classifier, ModelClassifier, classify_windows, place_windows, rule_classifier
from .options import Options


def clip(docs: DataFrame, options: Options, text: str = "text") -> DataFrame:
    """The first max_characters of text, and whether it was longer. Without a limit the text is whole."""
    whole = F.coalesce(F.col(text), F.lit(""))
    if options.max_characters is None:
        return docs.withColumns({"truncated": F.lit(False), text: whole})
    return docs.withColumns({"truncated": F.length(whole) > options.max_characters, text: F.substring(whole, 1, options.max_characters)})


def entities_of(text: Column, clean: Column, options: Options) -> Column:
    """Entities of normalised spans: filter, merge, resolve, hydrate and verify, in this order."""
    clean = F.filter(clean, lambda s: s["score"] >= options.min_score)
    resolved = spans.resolve(spans.merge_islands(text, clean, options.max_word_gap))
    return spans.verify(text, spans.hydrate(text, resolved))


def analyze(docs: DataFrame, options: Options = Options(), classifier: Classifier = rule_classifier, text: str = "text", error: str | None = None) -> DataFrame:
    """`docs` with text clipped, and truncated, entities and stats. A blank text has no entities and no chunks.

    A document on which a model raises has no entities; the column named by `error`, if any, gets what it raised."""
    out = clip(docs, options, text)
    chunks = F.when(not_blank(F.col(text)), windows(F.col(text), options.window, options.overlap)).otherwise(empty("struct<offset:int,text:string>"))
    out = out.withColumn("_chunks", chunks)
    failed = F.lit(None).cast("string")
    if isinstance(classifier, ModelClassifier):
        out = out.withColumn("_found", classifier.windows(F.transform("_chunks", lambda c: c["text"])))
        clean, failed = place_windows(F.col("_chunks"), F.col("_found.spans")), F.col("_found.error")
    else:
        clean = classify_windows(F.col("_chunks"), classifier)
    out = out.withColumns({"_clean": clean} | ({error: F.coalesce(error, failed) if error in out.columns else failed} if error else {}))
    found = F.when(F.size("_chunks") > 0, entities_of(F.col(text), F.col("_clean"), options)).otherwise(empty(ENTITY))
    out = out.withColumn("entities", found)
    return out.withColumn("stats", stats.stats(F.col(text), F.col("entities"), F.size("_chunks"))).drop("_chunks", "_clean", "_found")


def analyze_distinct(docs: DataFrame, options: Options = Options(), classifier: Classifier = rule_classifier, text: str = "text") -> DataFrame:
    """As analyze, but equal clipped texts are analysed once: worth its shuffle where texts repeat and the classifier is
    a model. The truncated flag is each row's own."""
    rows = clip(docs, options, text)
    once = analyze(rows.select(text).distinct(), options, classifier, text).drop("truncated")
    return rows.join(once, text)


def redact(
    analysed: DataFrame, strategy: str = "mask", min_sensitivity: int = 0, include_mapping: bool = False, salt: str = "", text: str = "text", profile: str = "server"
) -> DataFrame:
    """`analysed` with the column redaction: struct<text, strategy, replaced, mapping>; entities stay as they are."""
    out = analysed.withColumn("_targets", redaction.targets(F.col("entities"), min_sensitivity))
    out = out.withColumn("_tokens", redaction.tokens(F.col("_targets"), strategy, salt, profile))
    out = out.withColumn("_spliced", redaction.splice(F.col(text), F.col("_targets"), F.col("_tokens")))
    mapping = F.col("_spliced.mapping") if include_mapping else F.create_map().cast("map<string,string>")
    redacted = F.struct(F.col("_spliced.text").alias("text"), F.lit(strategy).alias("strategy"), F.col("_spliced.replaced").alias("replaced"), mapping.alias("mapping"))
    return out.withColumn("redaction", redacted).drop("_targets", "_tokens", "_spliced")


def batch(docs: DataFrame, options: Options = Options(), classifier: Classifier = rule_classifier, check_size: bool = False) -> DataFrame:
    """(id, text, truncated, entities, stats, error) for documents (id, text). A null text, or one on which a model raises,
    is an error of its row only.

    `check_size` counts the rows and refuses more than max_batch."""
    if check_size and docs.limit(options.max_batch + 1).count() > options.max_batch:
        raise ValueError(f"at most {options.max_batch} documents")
    out = analyze(docs.withColumn("error", F.when(F.col("text").isNull(), "text is null")), options, classifier, error="error")
    blank = F.col("error").isNull()
    return out.withColumns({c: F.when(blank, F.col(c)) for c in ("entities", "stats")})


def batch_summary(analysed: DataFrame) -> DataFrame:
    return stats.batch_totals(analysed)


def entity_rows(analysed: DataFrame, *keys: str) -> DataFrame:
    """One row an entity: the keys, index, start, end, label, text, score, verified."""
    return analysed.select(*keys, F.posexplode("entities").alias("index", "e")).select(*keys, "index", "e.*")


def response(analysed: DataFrame) -> DataFrame:
    """Entities with scores rounded to four places and their sensitivity."""
    from ..functions.labels import sensitivity

    shown = F.transform("entities", lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["text"].alias("text"), F.round(e["score"], 4).alias("score"),
        e["verified"].alias("verified"), sensitivity(e["label"]).alias("sensitivity")))
    return analysed.withColumn("entities", shown)


def limits(options: Options = Options()) -> dict[str, float | None]:
    return {"max_characters": options.max_characters, "max_batch": options.max_batch, "min_score": options.min_score, "window": options.window, "overlap": options.overlap}
