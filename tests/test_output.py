"""Redaction, exports, readers, evaluation, the browser profile, corpora and streams."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from spindrift import analyze, redact
from spindrift.functions import wordpiece
from spindrift.functions.expr import ENTITY
from spindrift.functions.labels import BIO, display, sensitivity, title
from spindrift.operators import corpus, evaluation, generator, redaction, stats
from spindrift.plans import browser, pipeline
from spindrift.sources import readers, sinks
from spindrift.streaming import stream

TEXT = "Pesan Tika dari kota Depok: hubungi 085711223344 / tika.k@pos.example"
WORDS = [("Tika", "PER", 0.9, False), ("Depok", "LOC", 0.95, False), ("085711223344", "PHONE", 0.99, True), ("tika.k@pos.example", "EMAIL", 0.99, True)]
ENTITIES = [(TEXT.index(w), TEXT.index(w) + len(w), label, w, score, ok) for w, label, score, ok in WORDS]


def replaced(*tokens):
    """TEXT with the entities' words replaced, those with None left."""
    out = TEXT
    for (word, *_), token in zip(WORDS, tokens, strict=True):
        out = out.replace(word, word if token is None else token)
    return out


@pytest.fixture(scope="module")
def sample(spark):
    df = spark.createDataFrame([(1, TEXT, ENTITIES)], f"doc_id int, text string, entities array<{ENTITY}>")
    return df.withColumn("stats", stats.stats(F.col("text"), F.col("entities"), F.lit(1)))


@pytest.mark.parametrize("strategy, tokens", [
    ("mask", ["•" * len(w) for w, *_ in WORDS]), ("label", [f"[{label}]" for _, label, *_ in WORDS]),
    ("partial", ["••••", "•••••", "••••••••3344", "t•••••@pos.example"]), ("remove", [""] * 4),
])
def test_strategies(sample, strategy, tokens):
    row = redact(sample, strategy).first().redaction
    assert (row.text, row.replaced, row.mapping) == (replaced(*tokens), 4, {})


@pytest.mark.parametrize("salt", ["", "x"])
def test_pseudonyms(sample, salt):
    mapping = redact(sample, "pseudonym", include_mapping=True, salt=salt).first().redaction.mapping
    name = lambda word, label: f"{label}_{hashlib.blake2s((salt + label + word.lower()).encode(), digest_size=3).hexdigest()}"
    assert mapping == {w: name(w, label) for w, label, *_ in WORDS}


def test_pseudonyms_of_the_whole_table(spark):
    """The registered query: texts with every match of a pattern replaced from right to left."""
    from spindrift.functions.patterns import PATTERNS
    from spindrift.queries import QUERIES

    data = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.redacted_sha256, r.replaced) for r in QUERIES["redact_pseudonym"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        text = d.text or ""
        found = [(m.start(), m.end(), label, i, m[0]) for i, (label, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text)]
        for a, b, label, _, word in sorted(found, key=lambda x: (-x[0], -x[1], x[3])):
            text = text[:a] + f"{label}_{hashlib.blake2s((label + word.lower()).encode(), digest_size=3).hexdigest()}" + text[b:]
        assert got[d.doc_id] == (hashlib.sha256(text.encode()).hexdigest(), len(found))


def test_browser_pseudonym(spark):
    df = spark.createDataFrame([("joko", [(0, 4, "PER", "joko", 0.9, False)])], f"text string, e array<{ENTITY}>")
    assert df.select(redaction.tokens(F.col("e"), "pseudonym", profile="browser").alias("t")).first().t == ["PER_bc273e"]


def test_sensitivity_and_unknown_names(sample):
    assert redact(sample, "label", 4).first().redaction.text == replaced("[PER]", None, "[PHONE]", "[EMAIL]")
    with pytest.raises(ValueError):
        redact(sample, "other")
    with pytest.raises(ValueError):
        redact(sample, "mask", 9)
    with pytest.raises(ValueError):
        sinks.export(sample, "xml")
    assert redaction.strategy_names() == ["label", "mask", "partial", "pseudonym", "remove"] and sinks.format_names() == ["csv", "json", "jsonl"]


@pytest.mark.parametrize("text, wanted, n", [
    ("081234567890@mail.com", "[PHONE]", 2), ("0812345678901234", "[SSN]", 2), ("+62 812-3456-7890@mail.com", "[PHONE]", 2)])
def test_overlapping_entities_are_spliced_in_turn(spark, text, wanted, n):
    row = redact(analyze(spark.createDataFrame([(text,)], "text string")), "label").first().redaction
    assert (row.text, row.replaced) == (wanted, n)


def test_exports(sample):
    row = sinks.export(sample, "csv").first().export
    assert row.split("\r\n")[:2] == [sinks.HEADER, "0,PER,Tika,6,10,0.9,False"] and row.endswith("True\r\n")
    lines = sinks.export(sample, "jsonl").first().export.split("\n")
    assert json.loads(lines[1]) == {"index": 1, "label": "LOC", "text": "Depok", "start": 21, "end": 26, "score": 0.95, "verified": False}
    doc = json.loads(sinks.export(sample, "json").first().export)
    assert doc["stats"]["total"] == 4 and doc["text"] == TEXT and len(doc["entities"]) == 4 and "chunks" not in doc["stats"]
    assert '"Tika"' in sinks.export(sample, "csv", "browser").first().export
    assert sinks.file_name("csv") == "entities.csv"


def test_csv_quotes(spark):
    df = spark.createDataFrame([('a,"b"', "plain")], "a string, b string")
    row = df.select(sinks.quoted(F.col("a")).alias("a"), sinks.quoted(F.col("b")).alias("b")).first()
    assert tuple(row) == ('"a,""b"""', "plain")


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Joko di Bandung\r\n\n  \nemail a@b.co \xff\n")
    rows = [(r.id, r.text) for r in readers.read_upload(spark, str(tmp_path / "a.txt")).collect()]
    assert rows == [("1", "Joko di Bandung"), ("4", "email a@b.co �")]
    assert [r.id for r in readers.read_txt(spark, str(tmp_path / "a.txt"), 3).collect()] == ["1"]
    (tmp_path / "b.csv").write_text('id, Teks ,x\n1,"Joko, di",y\n2,,\n3,"a ""b"""\n')
    assert [(r.id, r.text) for r in readers.read_upload(spark, str(tmp_path / "b.csv")).collect()] == [("1", "Joko, di"), ("3", 'a "b"')]
    (tmp_path / "c.txt").write_text("\n\n")
    with pytest.raises(ValueError):
        readers.read_txt(spark, str(tmp_path / "c.txt"))
    assert [readers.text_column(x) for x in (["id", "isi"], ["a", "b"], [])] == ["isi", "a", ""]


def test_browser_lines_and_vocabulary(spark):
    df = spark.createDataFrame([("id,text\n1, a,b \n\n2,c",)], "value string")
    assert [(x.id, x.text) for x in df.select(readers.browser_lines(F.col("value"), True).alias("l")).first().l] == [("1", "a,b"), ("2", "c")]
    vocab = spark.createDataFrame([("a\r\n\nb\na",)], "value string")
    assert {r.token: r.id for r in readers.vocabulary(vocab).collect()} == {"a": 3, "b": 2}


def test_labels(spark):
    df = spark.createDataFrame([("PER",), ("foo_bar 1x",)], "code string")
    rows = df.select(display(F.col("code")).alias("d"), sensitivity(F.col("code")).alias("s"), title(F.col("code")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("Person", 4, "Per"), ("Foo_Bar 1X", 2, "Foo_Bar 1X")]


def test_scores(spark):
    kind = "doc_id int, start int, end int, label string"
    pred = spark.createDataFrame([(1, 0, 4, "PER"), (1, 5, 9, "LOC"), (2, 0, 1, "PER")], kind)
    gold = spark.createDataFrame([(1, 0, 4, "PER"), (1, 5, 9, "PER")], kind)
    r = evaluation.scores(pred, gold).first()
    assert (r.hit, r.extra, r.miss) == (1, 2, 1) and r.precision == pytest.approx(1 / 3) and r.recall == 0.5
    none = evaluation.scores(pred.limit(0), gold.limit(0)).first()
    assert (none.precision, none.recall, none.f1) == (0, 0, 0)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    assert evaluation.fidelity(docs, pred, gold).first().exact_documents == pytest.approx(1 / 3)


def test_bio_round_trip(spark):
    tokens = [(0, 0), (0, 4), (5, 9), (10, 12), (13, 15), (0, 0)]
    df = spark.createDataFrame([(tokens, [(0, 9, "PER"), (13, 15, "LOC"), (13, 15, "PER")])], "t array<struct<start:int,end:int>>, s array<struct<start:int,end:int,label:string>>")
    codes = evaluation.bio_encode(F.col("t"), F.col("s"))
    row = df.select(codes.alias("c"), evaluation.bio_decode(F.col("t"), codes).alias("d")).first()
    assert [BIO[c] if c >= 0 else None for c in row.c] == [None, "B-PER", "I-PER", "O", "B-LOC", None]
    assert [(x.start, x.end, x.label) for x in row.d] == [(0, 9, "PER"), (13, 15, "LOC")]
    best = spark.createDataFrame([([1.0, 3.0, 3.0],)], "l array<double>").select(evaluation.argmax(F.col("l")).alias("a")).first().a
    assert best.best == 1 and 0 < best.score < 0.5


def test_segments(sample):
    got = sample.select(evaluation.segments(F.col("text"), F.col("entities")).alias("s")).first().s
    assert "".join(x.text for x in got) == TEXT and [x.label for x in got if x.label] == ["PER", "LOC", "PHONE", "EMAIL"]


def test_browser_profile(spark):
    docs = spark.createDataFrame([(1, "x Joko Widodo di Medan, a@b.co"), (2, " ")], "doc_id int, text string")
    rows = {r.doc_id: r for r in browser.analyze_browser(docs).collect()}
    assert [(e.label, e.text) for e in rows[1].entities] == [("PER", "Joko Widodo"), ("LOC", "Medan"), ("EMAIL", "a@b.co")]
    assert (rows[1].stats.chunks, rows[2].stats.chunks, rows[1].truncated) == (1, 0, False)
    islands = F.array(F.struct(F.lit(0).alias("start"), F.lit(16).alias("end"), F.lit("PER").alias("label"), F.lit(0.9).alias("score"), F.lit(0).alias("pos")))
    split = spark.createDataFrame([("Siti wanita baik",)], "text string").select(browser.split_gender(F.col("text"), islands).alias("s")).first().s
    assert [(x.start, x.end, x.label) for x in split] == [(0, 4, "PER"), (5, 11, "GENDER")]


def test_corpus(spark):
    gold = generator.gold_sentences(spark.range(8).withColumnRenamed("id", "k"), "k")
    assert all(r.text[e.start : e.end] == e.text for r in gold.collect() for e in r.entities)
    vocab = spark.createDataFrame([("<unk>", 0), ("▁", 5), ("▁ab", 7), ("▁длин", 9), ("▁longword", 11), ("42", 10000)], "piece string, id long")
    kept = corpus.renumber(vocab, corpus.keep_set(vocab, ["<unk>"], "latin"), "<unk>")
    assert {r.piece: r.new_id for r in kept.collect()} == {"<unk>": 0, "▁": 1, "▁ab": 2, "▁longword": 3, "42": 4}
    with pytest.raises(ValueError):
        corpus.renumber(vocab, vocab.limit(0), "<unk>")
    added = spark.createDataFrame([("<unk>", 0), ("▁ab", 7), ("<extra>", 90), ("▁длин", 9)], "content string, id long")
    keep = corpus.keep_set(vocab, ["<unk>"], "latin").union(spark.createDataFrame([("<extra>",)], "piece string"))
    assert {r.content: r.new_id for r in corpus.renumber_added(added, kept, keep).collect()} == {"<unk>": 0, "▁ab": 2, "<extra>": 90}
    files = spark.createDataFrame([("f", f"  {'x' * 21}\nshort\n{'y' * 21}"), ("g", None), ("h", "")], "f string, t string")
    assert [(r.f, r.line_no, r.line) for r in corpus.sampled_lines(files, "f", "t", 2).collect()] == [("f", 0, "x" * 21)]
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "alias string, target string")
    assert {r.alias: r.target for r in corpus.resolve_aliases(pairs).collect()} == {"a": "d", "b": "d", "c": "d", "x": "y"}
    edges = pairs.select(F.col("alias").alias("source"), "target")
    used = corpus.used_names(edges, spark.createDataFrame([("b",)], "name string"))
    assert {r.name for r in used.collect()} == {"b", "c", "d"}


def test_generated_values(spark):
    """Each form comes at its stated share, and drawn values don't move together."""
    rows = generator.gold_sentences(spark.range(20_000).withColumnRenamed("id", "k"), "k").collect()
    values = {label: [e.text for r in rows for e in r.entities if e.label == label] for label in generator.FORMS}
    share = lambda label, pattern: sum(bool(re.fullmatch(pattern, v)) for v in values[label]) / len(values[label])
    for label, pattern, want in [
        ("PER", r"\w+", 0.25), ("PER", r"\w+ \w+ \w+", 0.09), ("LOC", r".* No\. \d+, \w+", 0.2), ("DATE_TIME", r"\d+ [A-Z]\w+ \d{4}", 0.45),
        ("DATE_TIME", r"\d+-\d+-\d{4}", 0.2), ("PHONE", r"0\d{10}", 0.35), ("SSN", r"\d{4}( \d{4}){3}", 0.4), ("EMAIL", r"\w+\.\w+@.*", 0.3),
    ]:
        assert share(label, pattern) == pytest.approx(want, abs=0.02), (label, pattern)
    assert len({r.text.split("{")[0] for r in rows}) > 19_000 and set(values["GENDER"]) == set(generator.POOLS["sex"])
    assert generator.gold_sentences(spark.createDataFrame([(None,)], "k long"), "k").first().text is None


def test_wordpiece(spark):
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "joko", "##wi", "jo", "cafe", "."])}
    docs = spark.createDataFrame([(1, "Jokowi Café. zzz")], "doc_id int, text string")
    rows = wordpiece.encode(docs, vocab).orderBy("pos").collect()
    assert [r.id for r in rows] == [2, 4, 5, 7, 8, 1, 3] and (rows[1].start, rows[2].end, rows[0].start) == (0, 6, None)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "hp 081234567890"), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    found = stream.entity_stream(stream.read_documents(spark, str(tmp_path / "in")))
    stream.write_entities(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.doc_id, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "PHONE")]


def test_written_entities(spark, tmp_path, sample):
    for fmt in ("csv", "jsonl"):
        sinks.write_entities(sample, str(tmp_path / fmt), fmt, "doc_id")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4 == spark.read.json(str(tmp_path / "jsonl")).count()
    assert pipeline.response(sample).first().entities[0].sensitivity == 4
