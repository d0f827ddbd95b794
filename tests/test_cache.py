"""The cache of results over several runs, and small lookups of settings."""

import pytest
from pyspark.sql import functions as F

from spindrift import Options, analyze
from spindrift.operators.classify import model_classifier
from spindrift.plans.cache import ResultCache
from spindrift.plans.listing import listing
from spindrift.plans.options import deployment


def test_second_run_classifies_new_texts_only(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            seen.add(len(texts))
            return [[{"start": 0, "end": 3, "entity_group": "PER", "score": 0.9}] for _ in texts]

        return predict

    model = model_classifier(load)
    cache = ResultCache(spark, str(tmp_path / "cache"), "model-1")
    docs = spark.createDataFrame([(i, f"Nia di {i % 5}") for i in range(20)] + [(20, None), (21, "bad one"), (22, " ")], "doc_id int, text string")
    plain = analyze(docs, Options(), model, error="e").where("e IS NULL").select("doc_id", "entities", "stats", "truncated")
    want = {r.doc_id: r for r in plain.collect()}
    seen.value = 0
    for run, extra in ((1, 0), (2, 2), (3, 0)):
        more = docs.union(spark.createDataFrame([(100 + i, f"Ani {i}") for i in range(extra)], docs.schema)) if extra else docs
        got = {r.doc_id: r for r in cache.analyze(more, run, Options(), model).collect()}
        assert all((got[i].entities, got[i].stats, got[i].truncated) == (w.entities, w.stats, w.truncated) for i, w in want.items())
        assert got[21].entities is None and len(got) == 23 + extra
    assert seen.value == 5 + 2  # each distinct text once, over all runs
    assert cache.entries().count() == 5 + 2 + 2 and cache.entries().select("address").distinct().count() == 9  # and two blank ones
    other = ResultCache(spark, str(tmp_path / "cache"), "model-2")
    other.analyze(docs, 4, Options(), model).count()
    assert seen.value == 12 and cache.entries().count() == 16
    cache.analyze(docs.where("doc_id < 3"), 5, Options(), model).count()
    cache.evict(9)
    assert cache.generation() == 1 and cache.entries().count() == 9
    kept = {r.address: r.run for r in cache.uses().collect()}
    assert sorted(kept.values()) == [4] * 6 + [5] * 3
    cache.analyze(docs.where("doc_id < 3"), 6, Options(), model).count()
    assert seen.value == 12
    cache.evict(100)
    assert cache.entries().count() == 9 and cache.generation() == 2


def test_cache_in_a_stream(spark, tmp_path):
    """Micro-batches share the cache."""
    cache = ResultCache(spark, str(tmp_path / "cache"), "rules")
    for i, texts in enumerate([["email a@b.co", "x y"], ["email a@b.co", "new c@d.co"]]):
        spark.createDataFrame([(i * 10 + k, t) for k, t in enumerate(texts)], "doc_id int, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("doc_id int, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def batch(df, number):
        cache.analyze(df, number).select("doc_id", F.size("entities").alias("n")).write.mode("append").parquet(str(tmp_path / "out"))

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r.doc_id: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: 1, 1: 0, 10: 1, 11: 1}
    assert cache.entries().count() == 3


def test_settings_and_listings(spark):
    out = deployment({"NER_BACKEND": " Fake ", "NER_CACHE_SIZE": "5", "NER_WARMUP": "Yes", "NER_CORS_ORIGINS": "a, b,", "NER_MIN_SCORE": "0.7"})
    assert (out["backend"], out["cache_size"], out["warmup"], out["cors_origins"], out["min_score"], out["window"]) == ("fake", 5, True, ["a", "b"], 0.7, 1200)
    assert listing(spark, "labels").count() == 7 and {r.name for r in listing(spark, "strategies").collect()} == {"label", "mask", "partial", "pseudonym", "remove"}
    assert {r.name: r.value for r in listing(spark, "formats").collect()}["csv"] == "text/csv" and {r.name: r.value for r in listing(spark, "limits").collect()}["window"] == "1200"
    with pytest.raises(ValueError):
        listing(spark, "colours")
