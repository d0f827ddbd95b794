"""The analysis of whole tables against a plain Python statement of it, and classifiers that fail on some documents."""

import re

import pytest
from pyspark.sql import functions as F

from spindrift import Options, analyze
from spindrift.functions.labels import LABELS
from spindrift.functions.patterns import DATE, GENDERS, MONTHS, PATTERNS, PLACES, STOPWORDS, WORD
from spindrift.operators import generator
from spindrift.operators.classify import model_classifier, rule_classifier
from spindrift.plans import pipeline
from spindrift.queries import QUERIES

from .test_spans import loop

DATA = "/root/testdata/sf0.001"
CUT = " \t\n\r.,;:!?()[]{}\"'"
WEIGHT = {code: sensitivity for code, _, _, sensitivity, _ in LABELS}


def cut(text, window=1200, overlap=200):
    if not text.strip():
        return []
    out, start = [], 0
    while True:
        end = min(start + window, len(text))
        if end < len(text):
            floor = start + (end - start) * 3 // 4
            spaces = [k for k in range(floor, end) if text[k].isspace()]
            end = spaces[-1] + 1 if spaces else end
        out.append((start, text[start:end]))
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


def rules(text):
    found = [(m.start(), m.end(), label, 0.95) for label, p in PATTERNS.items() for m in re.finditer(p, text)]
    found += [(m.start(), m.end(), "DATE_TIME", 0.9) for m in re.finditer(DATE, text, re.I)]
    for m in re.finditer(WORD, text):
        low = m[0].lower()
        if low in PLACES or low in GENDERS:
            found.append((*m.span(), *(("LOC", 0.9) if low in PLACES else ("GENDER", 0.85))))
        elif m[0][0].isupper() and m.start() > 0 and low not in MONTHS + STOPWORDS:
            found.append((*m.span(), "PER", 0.7))
    return sorted(found, key=lambda x: x[0])


def entities(text):
    """(start, end, label, score, verified) of a document."""
    raw = [(at + a, at + b, label, score) for at, piece in cut(text) for a, b, label, score in rules(piece)]
    spans = loop(text, [(*x, i) for i, x in enumerate(raw)])
    if not text.strip():
        return []
    matches = [(m.start(), m.end(), label, 0.99, True) for label, p in PATTERNS.items() for m in re.finditer(p, text)]
    found = matches + [(*x, False) for x in spans if not any(x[0] < m[1] and m[0] < x[1] for m in matches)]
    out = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not any(o[2] == x[2] and o[0] <= x[0] and x[1] <= o[1] for o in out):
            out.append(x)
    return out


def summary(found):
    labels = [x[2] for x in found]
    order = sorted(dict.fromkeys(labels), key=lambda x: -labels.count(x))
    risk = min(100, 15 * max(WEIGHT[x] for x in labels) + min(25, 2 * len(labels))) if labels else 0
    return len(labels), risk, [(x, labels.count(x)) for x in order]


def test_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["analyze_documents"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        total, risk, counts = summary(entities(text))
        r = got[i]
        assert (r.total, r.risk, r.characters, r.chunks, r.by_label, r.truncated) == (total, risk, len(text), len(cut(text)), " ".join(f"{a}={b}" for a, b in counts), False)


def test_conversations(spark):
    turns = {f"{r.conv_id}/{r.turn}": r.text for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    for r in QUERIES["analyze_conversations"](spark, DATA).collect():
        total, risk, counts = summary(entities(turns[r.id]))
        band = "High" if risk >= 60 else "Medium" if risk >= 30 else "Low" if risk else "None"
        assert (r.total, r.risk, r.band, r.labels) == (total, risk, band, ", ".join(x for x, _ in counts))


def test_gold(spark):
    from spindrift.operators import corpus

    gold = generator.gold_sentences(spark.read.parquet(f"{DATA}/customer.parquet"), "c_custkey").collect()
    got = sorted((r.doc_id, r["index"], r.start, r.end, r.label, r.text, r.score, r.verified) for r in QUERIES["analyze_gold"](spark, DATA).collect())
    want = [(g.doc_id, i, a, b, label, g.text[a:b], score, ok) for g in gold for i, (a, b, label, score, ok) in enumerate(entities(g.text))]
    assert got == sorted(want)
    pred, true = {(w[0], w[2], w[3], w[4]) for w in want}, {(g.doc_id, e.start, e.end, e.label) for g in gold for e in g.entities}
    r, hit = QUERIES["gold_scores"](spark, DATA).first(), len(pred & true)
    assert (r.hit, r.extra, r.miss) == (hit, len(pred - true), len(true - pred)) and r.precision == pytest.approx(hit / len(pred)) and r.recall == pytest.approx(hit / len(true))


def test_variants(spark):
    from spindrift.operators import corpus

    gold = generator.gold_sentences(spark.read.parquet(f"{DATA}/customer.parquet"), "c_custkey").collect()
    true = {(g.doc_id, e.start, e.end, e.label) for g in gold for e in g.entities}
    fixed = lambda text: sorted((m.start(), m.end(), label) for label, p in PATTERNS.items() for m in re.finditer(p, text))
    trimmed = lambda text, a, b: (a + len(text[a:b]) - len(text[a:b].lstrip(CUT)), a + len(text[a:b].rstrip(CUT)))
    keys = {
        ("rules", "production"): {(g.doc_id, *x[:3]) for g in gold for x in entities(g.text)},
        ("rules", "raw"): {(g.doc_id, *trimmed(g.text, *x[:2]), x[2]) for g in gold for x in rules(g.text)},
        ("structured", "production"): {(g.doc_id, *x) for g in gold for x in fixed(g.text)}, ("structured", "raw"): {(g.doc_id, *x) for g in gold for x in fixed(g.text)},
    }
    got = {(r.variant, r.mode): r for r in QUERIES["variant_scores"](spark, DATA).collect()}
    assert set(got) == set(keys)
    for (name, mode), pred in keys.items():
        r, base = got[name, mode], keys["rules", mode]
        p, q = len(pred & base) / len(pred), len(pred & base) / len(base)
        same = sum({x for x in pred if x[0] == g.doc_id} == {x for x in base if x[0] == g.doc_id} for g in gold)
        assert (r.hit, r.extra, r.miss) == (len(pred & true), len(pred - true), len(true - pred))
        assert r.span_agreement == pytest.approx(2 * p * q / (p + q) if p + q else 0) and r.exact_documents == pytest.approx(same / len(gold))


@pytest.mark.parametrize("text", [
    "x Adi Pratama.., --Bandung.. JAKARTA-x jAKARTA a.B -.Nia_k Été 5 Mei 1988 NIK Wanita/pria", "kata " * 300 + "Nia Kurnia di Medan " * 80, " ..-Kota --. -Adi ", "A B C D"])
def test_odd_words(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(rule_classifier(F.col("text")).alias("r")).first().r
    assert [(x.start, x.end, x.label, x.score) for x in row] == rules(text)


def test_model_that_fails_on_a_document(spark):
    def load():
        def predict(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("too hot")
            return [[{"start": t.index("Nia"), "end": t.index("Nia") + 3, "entity_group": "PER", "score": 0.9}] if "Nia" in t else [] for t in texts]

        return predict

    long = "kata " * 500 + "Nia"
    docs = spark.createDataFrame([("a", "di Nia"), ("b", "boom Nia"), ("c", None), ("d", long), ("e", " ")], "id string, text string")
    rows = {r.id: r for r in pipeline.batch(docs, Options(), model_classifier(load)).collect()}
    assert rows["b"].error == "RuntimeError: too hot" and rows["b"].stats is None and rows["c"].error == "text is null" and rows["e"].stats.total == 0
    assert [(e.start, e.end, e.label) for e in rows["a"].entities] == [(3, 6, "PER")] and [(e.start, e.label) for e in rows["d"].entities] == [(2500, "PER")]
    assert rows["d"].stats.chunks > 1 and rows["a"].error is None and tuple(pipeline.batch_summary(pipeline.batch(docs, Options(), model_classifier(load))).first()) == (5, 2)
    plain = analyze(docs, Options(), model_classifier(load))
    assert "error" not in plain.columns and {r.id: len(r.entities) for r in plain.collect()} == {"a": 1, "b": 0, "c": 0, "d": 1, "e": 0}
