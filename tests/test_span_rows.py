"""Spans one row each against plain Python, over many bins and in one large document; find-all on long texts."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spindrift.functions.patterns import find_all
from spindrift.operators import spans
from spindrift.operators.classify import rule_classifier
from spindrift.queries import QUERIES

DATA = "/root/testdata/sf0.001"
KIND = "doc_id int, start int, end int, label string, score double, seq long"


@pytest.fixture(params=[8, 4096])
def bins(request, monkeypatch):
    monkeypatch.setattr(spans, "BIN", request.param)


def made(seed, n, docs=6, nulls=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.randint(0, 300)
        b = a + rng.choice([0, 1, 2, 5, 9, 40, 120, -3])
        rows.append((rng.randint(0, docs), a, b, rng.choice("AB"), rng.randint(0, 9) / 10, i))
    if nulls:
        rows += [(None, 1, 50, "A", 0.5, n), (1, None, 50, "A", 0.5, n + 1), (1, 3, None, "B", 0.5, n + 2), (1, 3, 9, None, 0.5, n + 3), (-1, 5, 9, "A", 0.5, n + 4)]
    return rows


def meets(a, b):
    return None not in (a[0], a[1], a[2], b[0], b[1], b[2]) and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


def test_unmatched(spark, bins):
    left, right = made(1, 200) + made(1, 5), made(2, 60)
    got = spans.unmatched_rows(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND)).collect()
    assert Counter(map(tuple, got)) == Counter(x for x in left if not any(meets(x, m) for m in right)) and len(got) > 20
    assert spans.unmatched_rows(spark.createDataFrame(left, KIND), spark.createDataFrame([], KIND)).count() == len(left)


def test_repaired(spark, bins):
    left, right = made(3, 200), made(4, 90)
    got = spans.repair_rows(spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND)).collect()
    want = Counter()
    for x in left:
        own = min(((m[1], m[2]) for m in right if meets(x, m) and m[3] == x[3] and x[3] is not None), default=None)
        want[(x[0], x[5], *(own or x[1:3]), x[3], max(x[4], 0.99) if own else x[4], own is not None)] += 1
    assert Counter(map(tuple, got)) == want and sum(r.verified for r in got) > 50


def test_resolved(spark, bins):
    rows = [r for r in made(5, 300, nulls=False) if r[2] > r[1]]
    want = []
    for d in {r[0] for r in rows}:
        kept = []
        for x in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[4], r[1], r[5])):
            if not any(x[1] < o[2] and o[1] < x[2] for o in kept):
                kept.append(x)
        want += kept
    got = spans.resolve_rows(spark.createDataFrame(rows, KIND)).select("doc_id", "start", "end", "label", "score", "pos").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def joined(text, rows, gap=1):
    """(label, start, end, score) of (start, end, label, score, continued) in a text."""
    done, last = [], {}
    for a, b, label, score, more in sorted(rows, key=lambda r: (r[0], -r[3])):
        old = last.get(label)
        if old and (a <= old[2] or ((more or a - old[2] <= gap) and not text[old[2] : a].strip())):
            old[2], old[3] = max(old[2], b), max(old[3], score)
        else:
            last[label] = [label, a, b, score]
            done.append(last[label])
    return sorted(map(tuple, done))


def test_islands_with_text(spark, bins):
    rng = random.Random(9)
    docs, rows = [], []
    for d in range(30):
        text = "".join(rng.choice("ab   \n\tx ") for _ in range(rng.randint(0, 120)))
        docs.append((d, text))
        for _ in range(rng.randint(0, 40) if text else 0):
            a = rng.randint(0, len(text) - 1)
            rows.append((d, a, min(len(text), a + rng.randint(1, 4)), rng.choice("AB"), rng.randint(1, 9) / 10, len(rows), rng.random() < 0.4))
    got = spans.merge_island_rows(spark.createDataFrame(rows, KIND + ", continued boolean"), texts=spark.createDataFrame(docs, "doc_id int, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.label, r.start, r.end, r.score))
    for d, text in docs:
        assert sorted(by.get(d, [])) == joined(text, [(r[1], r[2], r[3], r[4], r[6]) for r in rows if r[0] == d])


def test_islands_of_all_documents(spark):
    """The row form is the array form, over a whole table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = spans.merge_islands(F.col("text"), spans.normalise(F.col("text"), rule_classifier(F.col("text"))))
    want = docs.select("doc_id", F.inline(whole)).select("doc_id", "label", "start", "end", "score").collect()
    got = QUERIES["text_islands"](spark, DATA).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and len(got) > 1000


def test_one_large_document(spark):
    """A document of many spans is dealt over many tasks, by bins."""
    n = 200_000
    left = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 4).cast("int").alias("end"), F.lit("A").alias("label"), F.lit(0.5).alias("score"), F.col("id").alias("seq"))
    right = left.where("seq % 4 = 0")
    assert spans.unmatched_rows(left, right).count() == n * 3 // 4
    assert spans.repair_rows(left, right).where("verified").count() == n // 4
    assert spans.resolve_rows(left).count() == n


def test_long_texts(spark):
    """All matches, and time in proportion to the text."""
    rng, took = random.Random(7), {}
    for n in (40, 255, 256, 257, 5_000, 40_000):
        text = " ".join("".join(rng.choice("abé.-") for _ in range(rng.randint(1, 7))) for _ in range(n))
        df = spark.createDataFrame([(text,)], "t string")
        begin = time.time()
        got = df.select(find_all(F.col("t"), r"(?U)\w+").alias("f")).first().f
        took[n] = time.time() - begin
        assert [(x.start, x.end, x.text) for x in got] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", text)]
    assert took[40_000] < 30
