"""Models within plans: batches that survive bad documents, the token chain and the browser profile against plain Python,
dictionaries and WordPiece automata against the slow ways, and a teacher's training rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from spindrift import Options, queries
from spindrift.functions import wordpiece
from spindrift.functions.labels import BIO
from spindrift.functions.patterns import BROWSER_GENDERS, PATTERNS
from spindrift.operators import classify, generator, teacher, token_model
from spindrift.operators.classify import dictionary_classifier, in_batches, marker_classifier, model_classifier
from spindrift.plans import pipeline
from spindrift.queries import QUERIES

from .test_analysis import CUT, DATA, entities, rules, summary

WORDS = regex.compile(wordpiece.PIECE_WORD)


def trimmed(text, a, b):
    while a < b and text[a] in CUT:
        a += 1
    while b > a and text[b - 1] in CUT:
        b -= 1
    return a, b


def browser(text, raw, least=0.5):
    """(start, end, label, score, verified) of raw spans by the browser's rules."""
    clean = [(*trimmed(text, a, b), label, score) for a, b, label, score in raw]
    joined = []
    for a, b, label, score in sorted((x for x in clean if x[1] > x[0] and x[3] >= least), key=lambda x: (x[0], -x[3])):
        if joined and joined[-1][2] == label and a <= joined[-1][1] + 1 and not text[joined[-1][1] : a].strip():
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]), label, max(score, joined[-1][3]))
        else:
            joined.append((a, b, label, score))
    parted = []
    for a, b, label, score in joined:
        word = next((w for w in BROWSER_GENDERS if w in text[a:b].lower()), None) if label == "PER" else None
        if word is None:
            parted.append((a, b, label, score))
        else:
            at = a + text[a:b].lower().index(word)
            head = trimmed(text, a, at)
            parted += [(*head, label, score)] * (head[1] > head[0]) + [(at, at + len(word), "GENDER", score)]
    kept = []
    for x in sorted(parted, key=lambda x: (-x[3], x[0])):
        if not any(x[0] < o[1] and o[0] < x[1] for o in kept):
            kept.append(x)
    exact = [(m.start(), m.end(), label, 0.99, True) for label, p in PATTERNS.items() for m in re.finditer(p, text, re.A)]
    found = exact + [(*x, False) for x in sorted(kept) if not any(x[0] < m[1] and m[0] < x[1] for m in exact)]
    best = {}
    for x in found:
        if x[:3] not in best or x[3] > best[x[:3]][3]:
            best[x[:3]] = x
    return sorted(best.values(), key=lambda x: x[0])


def test_browser_documents(spark):
    """The browser profile over a whole table."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["analyze_browser"](spark, DATA).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        total, risk, _ = summary(browser(text, rules(text)) if text.strip() else [])
        assert tuple(got[i])[1:] == (total, risk, len(text), int(bool(text.strip()))), i


@pytest.fixture(scope="module")
def tagger(spark):
    gold = queries.gold_documents(spark, DATA)
    vocab = {r.token: r.id for r in queries.sentence_vocabulary(gold).collect()}
    pieces = wordpiece.WordPieces(list(vocab), list(vocab.values()))
    return gold.collect(), vocab, token_model.trained_tagger(gold, pieces)()


def encode(text, vocab):
    """(id, word's span or None)"""
    inner = [(i, m.span()) for m in WORDS.finditer(text) for i in wordpiece.longest_pieces(m[0], vocab, vocab["[UNK]"])]
    return [(vocab["[CLS]"], None), *inner, (vocab["[SEP]"], None)]


def test_trained_tagger(tagger):
    """The matrices are the counts of pieces, and of those before them, by class."""
    gold, vocab, predict = tagger
    own, last = Counter(), Counter()
    for r in gold:
        tokens = encode(r.text, vocab)
        for (before, _), (i, span) in zip(tokens, tokens[1:], strict=False):
            if span:
                e = next((e for e in r.entities if e.start <= span[0] and span[1] <= e.end), None)
                c = BIO.index(("B-" if e.start == span[0] else "I-") + e.label) if e else 0
                own[i, c] += 1
                last[before, c] += 1
    logs = [np.full((len(vocab), len(BIO)), 0.1) for _ in range(2)]
    for m, counts in zip(logs, (own, last), strict=True):
        for (i, c), n in counts.items():
            m[i, c] += n
        m[:] = np.log(m / m.sum(axis=1, keepdims=True))
    ids = np.array([i for i, _ in encode(gold[3].text, vocab)])
    assert predict([ids])[0] == pytest.approx(logs[0][ids] + 0.5 * logs[1][np.append(2, ids[:-1])])


def test_token_chain(spark, tagger):
    _, vocab, predict = tagger
    docs = queries.order_sentences(spark, DATA).collect()
    got = {}
    for r in QUERIES["analyze_tokens"](spark, DATA).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.label, round(r.score, 9), r.verified))
    want = {}
    for r in docs:
        tokens, spans, current = encode(r.text, vocab), [], None
        for (_, span), row in zip(tokens, predict([np.array([i for i, _ in tokens])])[0], strict=True):
            if span is None:
                continue
            best = int(row.argmax())
            score, name = float(np.exp(row[best]) / np.exp(row).sum()), BIO[best]
            if name == "O":
                current = None
            elif name[0] == "B" or current is None or current[2] != name[2:]:
                spans.append(current := [*span, name[2:], score])
            else:
                current[1], current[3] = span[1], min(current[3], score)
        found = [(a, b, label, round(s, 9), ok) for a, b, label, s, ok in browser(r.text, map(tuple, spans))]
        if found:
            want[r.doc_id] = found
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert sum(map(len, want.values())) > 3000


def test_token_model_odd_rows(spark):
    """A model that fails on some texts, blank and null texts, and classes without a name."""
    pieces = wordpiece.WordPieces(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "nia", "bad", "odd"], range(7))

    def load():
        def predict(some):
            if any(5 in ids for ids in some):
                raise RuntimeError("no")
            out = [np.zeros((len(ids), 20)) for ids in some]
            for ids, logits in zip(some, out, strict=True):
                logits[ids == 4, 1] = logits[ids == 6, 19] = 9.0
            return out

        return predict

    rows = [(i, "Nia x") for i in range(300)] + [(300, "bad Nia"), (301, " "), (302, None), (303, "Nia odd Nia"), (304, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    out = {r.doc_id: r for r in token_model.analyze_tokens(docs, pieces, load, error="why").collect()}
    assert out[300].why == "RuntimeError: no" and not out[300].entities and all(r.why is None for i, r in out.items() if i != 300)
    assert all([e.text for e in out[i].entities] == ["Nia"] for i in range(300))
    assert [(e.start, e.end) for e in out[303].entities] == [(0, 3), (8, 11)] and [out[i].stats.chunks for i in (0, 301, 302, 304)] == [1, 0, 0, 0]


def test_batches():
    """One bad item of 1,000 costs some 2 log n calls; order stays; sizes are kept."""
    for bad in ({617}, {0, 999}, set()):
        calls = []

        def call(some, bad=bad, calls=calls):
            calls.append(len(some))
            if bad & set(some):
                raise ValueError("bad")
            return [x * 2 for x in some]

        out = in_batches(call, list(range(1000)), [1] * 1000, 10_000)
        assert out == [(None, "ValueError: bad") if i in bad else (i * 2, None) for i in range(1000)]
        assert len(calls) <= 1 + 2 * 10 * len(bad)
    sizes = [random.Random(1).randint(1, 40) for _ in range(500)] + [900, 1]
    seen = []
    in_batches(lambda some: seen.append(sum(sizes[i] for i in some)) or some, list(range(502)), sizes, 100)
    assert max(seen) == 900 and sum(s <= 100 for s in seen) == len(seen) - 1 and len(seen) < 2 * sum(sizes) / 100
    assert in_batches(lambda some: some[1:], [1, 2], [1, 1], 9)[0][1] and in_batches(list, [], [], 9) == []


def test_model_batches_cross_documents(spark):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def predict(texts):
            seen.add(1)
            if any("boom" in t for t in texts):
                raise RuntimeError("boom")
            return [[{"start": 0, "end": 3, "entity_group": "PER", "score": 0.9}] for _ in texts]

        return predict

    docs = spark.createDataFrame([(str(i), "boom" if i == 700 else f"Nia di {i} rumah") for i in range(1000)], "id string, text string").coalesce(1)
    rows = {r.id: r for r in pipeline.batch(docs, Options(), model_classifier(load, batch=1000)).collect()}
    assert rows["700"].error == "RuntimeError: boom" and sum(r.error is None for r in rows.values()) == 999
    assert all(r.entities[0].text == "Nia" for i, r in rows.items() if i != "700") and seen.value <= 30


def test_dictionary(spark):
    """As the markers, one word after another, over random texts with words within words; and many words at once."""
    rng = random.Random(4)
    words = {w: rng.choice(["A", "B"]) for w in ["aa", "a", "aba", "ab", "b a", "é", "éa", "bb", "zz"]}
    texts = [(i, "".join(rng.choice("ab é") for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    out = docs.select("doc_id", dictionary_classifier(words)(F.coalesce("text", F.lit(""))).alias("a"), marker_classifier(words)(F.coalesce("text", F.lit(""))).alias("b")).collect()
    assert all(r.a == r.b for r in out) and sum(len(r.a) for r in out) > 1000
    many = {f"w{i:06d}": "X" for i in range(100_000)}
    one = spark.createDataFrame([("w000017 w099999 w100000 xw000018x",)], "text string").select(dictionary_classifier(many)("text").alias("s")).first()
    assert [(s.start, s.end, s.seq) for s in one.s] == [(0, 7, 0), (8, 15, 1), (25, 32, 2)]
    assert docs.select(dictionary_classifier({})(F.coalesce("text", F.lit(""))).alias("s")).where(F.size("s") > 0).isEmpty()


def test_wordpiece_automata(spark):
    """All distinct words of a table, and odd ones, are cut as by the greedy loop; folding too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = [r[0] for r in docs.select(F.explode(wordpiece.words_of(F.col("text"))).alias("w")).select("w.text").distinct().collect()]
    rng = random.Random(6)
    words += ["ΟΔΟΣ", "Σ", "İstanbul", "ẞ", "éÊ", "ạ᭄b", "᭄〮", "日本", "ﬁ", ""]
    words += ["".join(rng.choice("aÀéΣσ᭄〮́ßİ") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    codes, lens = wordpiece.folded(words)
    assert "".join(map(chr, codes)) == "".join(map(wordpiece.plain_word, words)) and lens.tolist() == [len(wordpiece.plain_word(w)) for w in words]
    plain = [wordpiece.plain_word(w) for w in words]
    tokens = ["[UNK]", *dict.fromkeys(p[: rng.randint(1, 4)] for p in plain[::7] if p), *dict.fromkeys("##" + p[k : k + rng.randint(1, 3)] for p in plain[::5] for k in (1, 2) if p[k:])]
    vocab = {t: i for i, t in enumerate(tokens)}
    ids, sizes = wordpiece.WordPieces(list(vocab), list(vocab.values())).encode(words)
    want = [wordpiece.longest_pieces(w, vocab, 0) for w in words]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_encoded_documents(spark):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "joko", "##wi", "jo", "cafe", "."])}
    table = spark.createDataFrame(list(vocab.items()), "token string, id int")
    docs = spark.createDataFrame([(1, "Jokowi Café. zzz"), (2, None), (3, "")], "doc_id int, text string")
    rows = {r.doc_id: [tuple(t) for t in r.tokens] for r in wordpiece.encoded(docs, wordpiece.load_wordpieces(table)).collect()}
    assert rows[1] == [(2, None, None), (4, 0, 6), (5, 0, 6), (7, 7, 11), (8, 11, 12), (1, 13, 16), (3, None, None)] and rows[2] == rows[3] == [(2, None, None), (3, None, None)]
    with pytest.raises(ValueError):
        wordpiece.load_wordpieces(table, most=3)


def test_teacher(spark):
    """All rows come through, labelled as the teacher's spans merged and verified; the split is exact."""
    gold = [r.text for r in queries.gold_documents(spark, DATA).collect()]
    lines = [x.strip() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for x in (r.text or "").split("\n")]
    texts = [x for x in lines + gold if 15 < len(x) < 600]
    predict = queries.place_model()
    labelled = 0
    for text, raw in zip(texts, predict(texts), strict=True):
        spans = [(x["start"], x["end"], x["entity_group"], x["score"], i) for i, x in enumerate(raw)]
        labelled += len(verified(text, spans))
    rows = {r.part: r for r in QUERIES["teacher_rows"](spark, DATA).collect()}
    assert rows["dev"]["rows"] == int(len(texts) * 0.05) and rows["train"]["rows"] + rows["dev"]["rows"] == len(texts)
    assert rows["train"].labelled + rows["dev"].labelled == labelled > 300


def verified(text, raw):
    """As test_analysis.entities, of given spans over the whole text."""
    from .test_spans import loop

    exact = [(m.start(), m.end(), label) for label, p in PATTERNS.items() for m in re.finditer(p, text)]
    found = exact + [x[:3] for x in loop(text, raw) if not any(x[0] < m[1] and m[0] < x[1] for m in exact)]
    out = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not any(o[2] == x[2] and o[0] <= x[0] and x[1] <= o[1] for o in out):
            out.append(x)
    return out


def test_teacher_skips_failed_lines(spark):
    def load():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError
            return [[] for _ in texts]

        return predict

    lines = spark.createDataFrame([("a line that is fine",), ("a bad line, this one",), ("ada 0812 3456 7890 di sini",)], "text string")
    rows = teacher.labelled_rows(lines, classify.model_classifier(load)).collect()
    assert {r.text: [e.label for e in r.entities] for r in rows} == {"a line that is fine": [], "ada 0812 3456 7890 di sini": ["PHONE"]}
    assert generator.FIRST and entities("x") == []
