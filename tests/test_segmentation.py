"""Unigram segmentation against the tokenizer library, over whole tables; the automaton, character classes and pruned files."""

import json
import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from spindrift import queries
from spindrift.functions.trie import Trie, code_points
from spindrift.functions.unigram import Unigram
from spindrift.operators import corpus, segmentation
from spindrift.sources import readers

DATA = "/root/testdata/sf0.001"
#: Fixed: the categories of Latin pieces' characters beyond ASCII.
FIXED = set("Lu Ll Lt Lm Nd No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs".split())


@pytest.fixture(scope="module")
def tokenizer(spark):
    """(path, library's model, pieces)"""
    path = queries.tokenizer_file(spark)
    payload = json.loads(spark.read.text(path, wholetext=True).first()[0])
    vocab = [tuple(x) for x in payload["model"]["vocab"]]
    return path, models.Unigram(vocab, payload["model"]["unk_id"], False), [p for p, _ in vocab]


def test_trie():
    rng = random.Random(3)
    strings = sorted({"".join(rng.choice("abé😀") for _ in range(rng.randint(1, 5))) for _ in range(200)})
    trie = Trie(strings + [strings[0]])
    text = "".join(rng.choice("abé😀x") for _ in range(500))
    codes, lens = code_points([text])
    got = {(int(s), int(n), int(v)) for s, n, v in zip(*trie.matches(codes, lens[0] - np.arange(lens[0])), strict=True)}
    number = {s: i for i, s in enumerate(strings)} | {strings[0]: len(strings)}
    assert got == {(i, n, number[text[i : i + n]]) for i in range(len(text)) for n in range(1, 6) if text[i : i + n] in number and i + n <= len(text)}
    length, value = trie.longest_at(codes, np.arange(len(text)), np.full(len(text), len(text)))
    best = [max((n for n in range(1, 6) if i + n <= len(text) and text[i : i + n] in number), default=0) for i in range(len(text))]
    assert length.tolist() == best and all((v < 0) == (n == 0) for n, v in zip(best, value, strict=True))
    assert Trie([]).matches(codes, lens[0] - np.arange(lens[0]))[0].size == 0


def test_every_word(spark, tokenizer):
    """All distinct words of a table of documents, and odd ones, are cut as by the library."""
    path, library, pieces = tokenizer
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = [r[0] for r in docs.select(F.explode(segmentation.plain_words(F.col("text"))).alias("w")).distinct().collect()]
    rng = random.Random(2)
    words += ["".join(rng.choice("ab▁éñ日本語😀zxq1") for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["x" * 2000, "日本" * 400, ""]
    model, ids = segmentation.load_unigram(readers.read_tokenizer(spark, path), 0)
    marked = segmentation.marked(words)
    found, sizes = model.encode(marked)
    assert np.split(ids[found], np.cumsum(sizes)[:-1])[0].tolist() == [x.id for x in library.tokenize(marked[0])]
    want = [x.id for w in marked for x in library.tokenize(w)]
    assert ids[found].tolist() == want and sizes.tolist() == [len(library.tokenize(w)) for w in marked]


def test_ties():
    """Of equal paths the one with the longer last piece; unknown characters in a row are one piece."""
    model = Unigram(["?", "a", "ab", "b", "bc", "c"], [0, -1, -1, -1, -1, -1], 0)
    assert model.encode(["abc", "", "xxa", "yxz"])[0].tolist() == [1, 4, 0, 1, 0]
    library = models.Unigram([("?", 0.0), ("a", -1.0), ("ab", -1.0), ("b", -1.0), ("bc", -1.0), ("c", -1.0)], 0, False)
    assert [x.id for x in library.tokenize("abc")] == [1, 4]


def pieces_of(library, line):
    return [x.id for w in line.split() for x in library.tokenize("▁" + unicodedata.normalize("NFKC", w))]


def test_emitted(spark, tokenizer):
    _, library, pieces = tokenizer
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        for i in pieces_of(library, r.text or ""):
            want[i] = want.get(i, 0) + 1
    got = {r.id: (r.piece, r.n) for r in queries.unigram_pieces(spark, DATA).collect()}
    assert got == {i: (pieces[i], n) for i, n in want.items()}


def test_pruned(spark, tokenizer):
    """The pruned file keeps order and scores; the share of changed lines is that of the library's own two tokenizers."""
    _, library, pieces = tokenizer
    used = {i for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() for i in pieces_of(library, r.text or "")}
    latin = lambda p: all(c.isascii() or (unicodedata.category(c) in FIXED and "LATIN" in unicodedata.name(c, "")) for c in p)
    body = [p.lstrip("▁") for p in pieces]
    keep = [i for i, b in enumerate(body) if i in used or pieces[i] in ("<unk>", "<s>", "</s>") or not b or b.isdigit() or (len(b) <= 3 and latin(b))]
    rows = sorted(queries.pruned_tokenizer(spark, DATA).collect())
    assert [(r.id, r.old_id, r.piece) for r in rows] == [(n, i, pieces[i]) for n, i in enumerate(keep)]
    small, moved = models.Unigram([(r.piece, r.score) for r in rows], 0, False), {i: n for n, i in enumerate(keep)}
    lines = [x for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() for x in (r.text or "").split("\n") if len(x.strip(" ")) > 20]
    changed = sum([moved.get(i, -1) for i in pieces_of(library, x)] != pieces_of(small, x) for x in lines)
    assert tuple(queries.unigram_divergence(spark, DATA).first()) == (len(lines), changed) and changed


def test_rewritten_file(spark, tmp_path):
    text = segmentation.unigram_json(["<s>", "<unk>", "▁a", "b", "</s>"], [0, 0, -1, -2.5, 0], 1, ["<s>", "</s>"])
    (tmp_path / "t.json").write_text(text)
    keep = spark.createDataFrame([("<unk>",), ("b",), ("</s>",)], "piece string")
    mapping = segmentation.rewrite_tokenizer(spark, str(tmp_path / "t.json"), str(tmp_path / "out"), keep)
    assert sorted(map(tuple, mapping.collect())) == [("</s>", 4, 2), ("<unk>", 1, 0), ("b", 3, 1)]
    out = json.loads(spark.read.text(str(tmp_path / "out"), wholetext=True).first()[0])
    assert out["model"]["unk_id"] == 0 and out["model"]["vocab"] == [["<unk>", 0], ["b", -2.5], ["</s>", 0]]
    assert [(t["id"], t["content"], t["special"]) for t in out["added_tokens"]] == [(2, "</s>", True)]
    assert Tokenizer.from_str(json.dumps(out)).encode("b").ids == [1]
    with pytest.raises(ValueError):
        segmentation.rewrite_tokenizer(spark, str(tmp_path / "t.json"), str(tmp_path / "no"), keep.where("piece <> '<unk>'"))
    (tmp_path / "bpe.json").write_text('{"model": {"type": "BPE", "vocab": []}}')
    with pytest.raises(ValueError):
        segmentation.rewrite_tokenizer(spark, str(tmp_path / "bpe.json"), str(tmp_path / "no"), keep)


def test_encoded(spark, tokenizer):
    path, library, _ = tokenizer
    docs = spark.createDataFrame([(1, "Der  Hund\tist 日本ﬁ da"), (2, ""), (3, None), (4, "x " * 3000)], "doc_id int, text string")
    out = segmentation.encoded(docs, readers.read_tokenizer(spark, path), 0).collect()
    assert {r.doc_id: r.ids for r in out} == {r.doc_id: pieces_of(library, r.text or "") for r in docs.collect()}


def test_classes(spark):
    """Every code point, as Python classes it."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c != 0x2581]
    rows = spark.createDataFrame(pd.DataFrame({"id": codes, "c": [chr(c) for c in codes]}))
    got = {r.id for r in rows.where(corpus.is_latin(F.col("c"))).select("id").collect()}
    assert got == {c for c in codes if chr(c).isascii() or (unicodedata.category(chr(c)) in FIXED and "LATIN" in unicodedata.name(chr(c), ""))}
