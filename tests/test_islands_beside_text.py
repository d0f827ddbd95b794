"""Islands whose white space is counted beside the text, and what a pattern needs."""

import random

from pyspark.sql import functions as F

from spindrift.functions import patterns
from spindrift.operators import span_arrays, spans
from spindrift.operators.classify import rule_classifier
from spindrift.queries import QUERIES

DATA = "/root/testdata/sf0.001"
KIND = "doc_id int, start int, end int, label string, score double, seq int, continued boolean"


def test_text_stays(spark):
    """No text is moved: spans are dealt once, by document and label, and the documents once, to all cores."""
    plan = QUERIES["text_islands"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange ") <= 2 and "Join" not in plan


def test_space(spark):
    """White space is what the patterns' class has, over all code points."""
    points = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    got = points.where(F.col("c").rlike(f"(?U)^{patterns.SPACE}$")).orderBy("id").collect()
    assert [r.id for r in got] == span_arrays.SPACES.tolist()


def test_filled(spark):
    """As counted from cells of the texts that the spans are joined with."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab é😀 \n\x1c ") for _ in range(n)) for n in (0, 1, 60, 5, 9000, 300)]
    rows = [(d, a := rng.randint(0, len(t) - 1), min(len(t), a + rng.randint(1, 4)), rng.choice("AB"), 0.5, i, i % 3 == 0) for d, t in enumerate(texts) if t for i in range(80)]
    docs, flat = spark.createDataFrame([*enumerate(texts)], "doc_id int, text string"), spark.createDataFrame(rows, KIND)
    held = flat.groupBy("doc_id").agg(F.collect_list(F.struct(*flat.columns[1:])).alias("s")).join(docs, "doc_id", "right")
    held = held.select("doc_id", "text", F.coalesce("s", F.array()).alias("s")).repartition(1)
    both = held.withColumn("f", span_arrays.filled(F.col("text"), F.col("s.start"), F.col("s.end")))
    both = both.select("doc_id", F.inline(F.arrays_zip("s", "f"))).select("doc_id", "s.*", "f.*")
    key = lambda r: (r.doc_id, r.seq)
    want = {key(r): (r._at_start, r._at_end) for r in spans.filled_before(flat, docs).collect()}
    assert {key(r): (r._at_start, r._at_end) for r in both.collect()} == want and len(want) == 400
    assert sorted(spans.merge_island_rows(both).collect()) == sorted(spans.merge_island_rows(flat, texts=docs).collect())


def test_needed(spark):
    """Every text with a match has what the pattern is said to need, in both profiles; so matches are the same with it."""
    rng = random.Random(2)
    items = ["+62", "62", "0", "8", "812", "3456", "1234", " ", ".", "-", "٣٤٥٦", " ", "@", "a.b", "é", "id", "12", "/", "Mei", "MARET", "2020", "x", "1234567812345678", "08123456789", "a1@b-c.id", "12 mei 2020"]
    df = spark.createDataFrame([("".join(rng.choice(items) for _ in range(rng.randint(1, 14))),) for _ in range(6000)], "t string")
    found = patterns.PATTERNS | {"DATE_TIME": patterns.DATE}
    assert set(found) == set(patterns.NEEDED)
    for label, p in found.items():
        for pattern in {patterns.unicode_pattern(p, label == "DATE_TIME"), patterns.unicode_pattern(p, label == "DATE_TIME", "browser")}:
            hits = df.where(F.col("t").rlike(pattern))
            assert hits.count() > 50 and hits.where(~F.col("t").rlike(patterns.NEEDED[label])).isEmpty()
            a, b = (patterns.parts(F.col("t"), pattern, needed=n) for n in (patterns.NEEDED[label], None))
            assert df.where(a != b).isEmpty()


def test_ruled_spans(spark):
    """The rule classifier's spans in arrays, over odd texts and a whole table, as its expressions leave them."""
    rng = random.Random(12)
    items = ["Jakarta", "jakarta", "ſurabaya", "laKi-laKi", "PRIA", "female", "Nia", "Élan", "ǅx", "nik", "Maret", "12 mei 2020", "1/2/2020", "08123456789", "0812 3456 7890", "a1@b-c.id",
             "1234 5678 9012 3456", ".", "-", "_x", "İ", "Σ", " ", " ", "\n", "\x1c", ",", "(", "￿", "😀", "٣"]
    docs = [("".join(rng.choice(items) for _ in range(rng.randint(0, 25))),) for _ in range(1500)]
    df = spark.createDataFrame(docs, "t string").union(spark.read.parquet(f"{DATA}/documents.parquet").select(F.coalesce("text", F.lit("")))).repartition(3)
    own = spans.normalise(F.col("t"), rule_classifier(F.col("t")))
    want = df.select("t", own.alias("s")).withColumn("f", span_arrays.filled(F.col("t"), F.col("s.start"), F.col("s.end")))
    want = want.select("t", F.inline(F.arrays_zip("s", "f"))).select("t", "s.*", "f.*").drop("continued")
    got = df.select("t", F.inline(span_arrays.ruled_spans(F.col("t"))))
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 5000
