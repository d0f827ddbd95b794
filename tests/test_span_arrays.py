"""The token chain in flat arrays, against the same chain as column expressions."""

import random

import numpy as np
from pyspark.sql import functions as F

from spindrift.functions import wordpiece
from spindrift.functions.expr import row
from spindrift.functions.labels import BIO
from spindrift.operators import evaluation, generator, span_arrays, token_model
from spindrift.plans.browser import assemble
from spindrift.plans.options import Options

DATA = "/root/testdata/sf0.001"
LETTERS = ["a", "b", "0", "9", "é", "É", "İ", "K", "😀", "￿", ".", ",", "-", "@", " ", " ", " ", "\x1c", "\n", "Σ"]
WORDS = ["Pria", "wanita", "PRİA", "laki-laki", "lakilaki", "xfemale", "0813-1234-5678", "0813 1234 5678", "1234 5678 9012 3456", "ab@c9.id", "Nia", "(Nia)", "é,", "ab"]


def texts(n: int) -> list[str]:
    rng = random.Random(11)
    return ["".join(rng.choice([*LETTERS, *WORDS, *[f" {w} " for w in WORDS]]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_chain_of_arrays(spark):
    """Any classes of any pieces over odd texts: the same spans, bit by bit, as the expressions give."""
    names = [*BIO[:5], "I-GENDER", "B-I-PER", "X", "B-PER"]
    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *[f"{p}{c}" for p in ("", "##") for c in "abcdefghijklmnopqrstuvwxyz0123456789.,-@"], "nia", "pria"]
    pieces = wordpiece.WordPieces(tokens, range(len(tokens)))

    def load():
        table = np.random.default_rng(5).integers(0, 4, (len(tokens), 11)) * 1.5

        def predict(some):
            return [table[ids] + table[np.roll(ids, 1)] for ids in some]

        return predict

    docs = spark.createDataFrame([*enumerate(texts(1500)), (-1, None), (-2, "")], "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.entities for r in token_model.analyze_tokens(docs, pieces, load, Options.browser(max_characters=None, min_score=0.2), names).collect()}
    predict = load()

    @F.udf("struct<best:array<int>,score:array<double>>")
    def classes(ids):
        best, score = token_model.best_classes(predict([np.array(ids)])[0])
        return [int(b) if b < len(names) else 0 for b in best], score.tolist()

    out = wordpiece.encoded(docs.withColumn("text", F.coalesce("text", F.lit(""))), pieces).withColumn("f", classes(F.transform("tokens", lambda t: t["id"])))
    spans = evaluation.bio_decode(F.col("tokens"), F.col("f.best"), F.col("f.score"), names)
    raw = F.transform(spans, lambda s, i: row(start=s["start"], end=s["end"], label=s["label"], score=s["score"], seq=i.cast("int")))
    want = {r.doc_id: r.e for r in out.select("doc_id", assemble(F.col("text"), raw, Options.browser(min_score=0.2)).alias("e")).collect()}
    assert got == want and sum(map(len, want.values())) > 3000
    assert {"GENDER", "PER", "PHONE", "SSN", "EMAIL"} <= {e.label for x in want.values() for e in x}


def test_chain_folds_no_row(spark):
    """Neither the chain nor the scores fold arrays of a row in the JVM; the chain moves nothing."""
    pieces = wordpiece.WordPieces(["[PAD]", "[UNK]", "[CLS]", "[SEP]"], range(4))
    keys = spark.range(10).withColumnRenamed("id", "key")
    out = token_model.analyze_tokens(generator.gold_sentences(keys, "key").select("doc_id", "text"), pieces, lambda: None).select("doc_id", "entities")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "lambda" not in plan and "Exchange" not in plan


def test_word_codes(spark):
    """Of each word the name that `bio_encode` gives, for spans that overlap, are empty, or have no name."""
    rng = random.Random(3)
    words, spans = [], []
    for r in range(200):
        words += [(r, a * 3, a * 3 + rng.randint(1, 3)) for a in range(rng.randint(0, 9))]
        spans += [(r, a := rng.randint(0, 25), a + rng.randint(0, 9), rng.choice(["PER", "LOC", "ODD"])) for _ in range(rng.randint(0, 5))]
    known = {n[2:]: i for i, n in enumerate(BIO) if n.startswith("B-")}
    w, s = (list(map(np.array, zip(*x, strict=True))) for x in (words, [(r, a, b, known.get(x, 0)) for r, a, b, x in spans]))
    got = token_model.word_codes(*w, tuple(s)).tolist()
    rows = [(r, [x[1:] for x in words if x[0] == r], [x[1:] for x in spans if x[0] == r]) for r in range(200)]
    df = spark.createDataFrame(rows, "r int, t array<struct<start:int,end:int>>, s array<struct<start:int,end:int,label:string>>")
    want = df.select("r", evaluation.bio_encode(F.col("t"), F.col("s")).alias("c")).orderBy("r").collect()
    assert got == [c for r in want for c in r.c] and len(set(got)) > 4


def test_row_scores(spark):
    """As over spans of both sides, one row each; repeated spans count once, null sides as empty."""
    e = lambda *spans: [(a, b, x) for a, b, x in spans]
    rows = [(1, e((0, 3, "A"), (0, 3, "A"), (4, 6, "B")), e((0, 3, "A"), (7, 9, "B"))), (2, None, e((0, 1, "A"))), (3, [], []), (4, e((2, 3, "A")), None)]
    df = spark.createDataFrame(rows, "doc_id int, entities array<struct<start:int,end:int,label:string>>, gold array<struct<start:int,end:int,label:string>>")
    gold = df.select("doc_id", F.col("gold").alias("entities"))
    want = evaluation.scores(evaluation.span_keys(df), evaluation.span_keys(gold))
    got = evaluation.row_scores(df, F.col("entities"), F.col("gold"))
    assert got.collect() == want.collect() and got.first().hit == 1 and got.schema == want.schema


def test_slabs():
    sizes = np.array([3, 0, 9, 1, 1, 1, 0])
    assert list(span_arrays.slabs(sizes, 4)) == [(0, 2), (2, 3), (3, 7)] and list(span_arrays.slabs(sizes[:0], 4)) == []
