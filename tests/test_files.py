"""Readers and writers of files, and small operators on entities and vocabularies."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions.expr import ENTITY
from spindrift.operators import corpus, evaluation, spans
from spindrift.plans import pipeline
from spindrift.plans.options import Options
from spindrift.sources import readers, sinks
from spindrift.streaming import stream


def test_datasets_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("Nia di Depok", [(0, 3, "PER", "Nia")]), ("x", [])], readers.GOLD)
    sinks.write_dataset(rows, str(tmp_path / "set"))
    assert sorted(readers.read_jsonl(spark, str(tmp_path / "set")).collect(), key=str) == sorted(rows.collect(), key=str)
    sinks.write_lines(rows, str(tmp_path / "lines"))
    lines = [" Nia di Depok, kota  ", "short", "y" * 600, "sixteen letters!"]
    (tmp_path / "corpus.txt").write_text("\n".join(lines))
    assert [r.text for r in readers.read_corpus(spark, [str(tmp_path / "corpus.txt")]).collect()] == ["Nia di Depok, kota", "sixteen letters!"]
    assert [r.text for r in readers.read_corpus(spark, [str(tmp_path / "corpus.txt")], 1).collect()] == ["Nia di Depok, kota"]
    size = sum(f.stat().st_size for f in (tmp_path / "lines").iterdir() if f.name[0] not in "._")
    assert readers.folder_mb(spark, str(tmp_path / "lines")).first().mb == pytest.approx(size / 1e6)


def test_tokenizer_file(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": [["<unk>", 0.0], ["a", -1.5]]}}))
    assert [tuple(r) for r in readers.read_tokenizer(spark, str(tmp_path / "t.json")).collect()] == [(0, "<unk>", 0.0), (1, "a", -1.5)]


def test_vocabulary_tables(spark):
    mapping = spark.createDataFrame([(3, 0), (7, 1)], "old_id long, new_id long")
    weights = spark.createDataFrame([(3, 0.5), (4, 0.6), (7, 0.7)], "id long, w double")
    assert {(r.id, r.w) for r in corpus.gather_rows(weights, mapping).collect()} == {(0, 0.5), (1, 0.7)}
    pairs = spark.createDataFrame([("a", "a"), ("b", "c"), (None, None), ("d", None)], "old string, new string")
    assert evaluation.divergence(pairs).first()[0] == 0.5 and evaluation.divergence(pairs.limit(0)).first()[0] == 0
    numbers = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    assert all(r.k == r.place for r in corpus.numbered(numbers, "k").collect())
    split = corpus.split_rows(numbers, "k", 0.0123).where("is_dev").count()
    assert (split, corpus.split_rows(numbers.limit(3), "k", 0.01).where("is_dev").count()) == (12, 1)


def test_entity_lists(spark):
    items = [(0, 3, "PER", "Nia", 0.7, False), (7, 12, "LOC", "Depok", 0.9, False)]
    df = spark.createDataFrame([(1, items, [(8, 9, "SSN", "e", 0.99, True), (20, 21, "SSN", "z", 0.99, True)])], f"doc_id int, e array<{ENTITY}>, m array<{ENTITY}>")
    row = df.select(evaluation.active_only(F.col("e"), ["LOC"]).alias("a"), evaluation.active_only(F.col("e"), []).alias("b"), spans.missing(F.col("e"), F.col("m")).alias("c")).first()
    assert ([x.text for x in row.a], len(row.b), [x.text for x in row.c]) == (["Depok"], 2, ["Nia", "Depok", "z"])
    rows = df.select(F.inline("e"))
    assert [r.text for r in evaluation.sorted_entities(rows, "text").collect()] == ["Depok", "Nia"] and [r.text for r in evaluation.sorted_entities(rows, "score", True).collect()] == ["Depok", "Nia"]
    with pytest.raises(ValueError):
        evaluation.sorted_entities(rows, "end")
    assert pipeline.limits(Options(window=300))["window"] == 300


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "PER"), ("2024-01-01 00:09:00", "PER"), ("2024-01-01 00:11:00", "LOC")], "at string, label string").withColumn("at", F.to_timestamp("at"))
    assert sorted((r.label, r.entities) for r in stream.label_counts_by_window(rows, "at").collect()) == [("LOC", 1), ("PER", 2)]
