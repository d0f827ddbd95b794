"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeats, odd texts and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import centroids, collocations, packing, suffix_dedup
from spindrift.llm.queries import QUERIES

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = "/root/testdata/sf0.001"


# 11


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


def check_pieces(rows, docs, tokenizer, length):
    """Each document's ids lie in its pieces, once and in order; sequences have no gaps and are full but for the last."""
    want = Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, tuple(ids)] += 1
    by_doc, got = defaultdict(list), Counter()
    for r in rows:
        by_doc[r.doc_id, r.sequence_id * length + r.offset - r.start].append(r)
    left = defaultdict(list)
    for (i, ids), n in want.items():
        left[i, len(ids)] += [ids] * n
    for (i, _), pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        ends = [0]
        for r in pieces:
            assert r.start == ends[-1] and r.length > 0
            ends.append(r.start + r.length)
        n = pieces[0].doc_tokens
        assert ends[-1] == n and all(r.doc_tokens == n for r in pieces)
        crc = [r.ids_crc32 for r in pieces]
        ids = next(x for x in left[i, n] if [zlib.crc32(np.array(x[a:b], "<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)] == crc)
        left[i, n].remove(ids)
        got[i, ids] += 1
    assert got == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sorted(held) == list(range(-(-total // length)))
    for s, parts in held.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == min(length, total - s * length)


def test_packing(spark, tokenizer):
    rng = random.Random(3)
    odd = ["ab z'  \n\n\t.,1९é 　中ñ😀\r\x0b ſ\x1c\x85A", "<|endoftext|>", "it's we'll THE.end a.b,c:d", " ", "\n", "x" * 5000, "word " * 9000]
    texts = ["".join(rng.choice(odd[0]) for _ in range(rng.randint(0, 80))) for _ in range(60)] + odd
    docs = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (1, "another"), (None, "no id"), (None, "no id"), (None, None), (2**63 - 1, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for length in (2048, 64, 7):
        check_pieces(packing.packed(table, length=length).collect(), docs, tokenizer, length)


def test_packing_whole_table(spark, tokenizer):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = QUERIES["op11_packing"](spark, DATA).collect()
    check_pieces(rows, docs, tokenizer, 2048)
    assert sorted(rows) == sorted(QUERIES["op11_packing"](spark, DATA).collect())


def test_packed_sequences(spark, tokenizer):
    """The sequences themselves, padded unless their length is a power of two; clashing names and empty tables do no harm."""
    docs = spark.createDataFrame([(i, f"text number {i} " * i) for i in range(20)], "doc_id long, text string").withColumns({"ids": F.lit(1), "part": F.lit(2), "N": F.lit(3), "start": F.lit(4)})
    pieces = packing.packed(docs, length=32, with_ids=True)
    rows = {r.sequence_id: r for r in packing.sequences(pieces, 32, pad=9).collect()}
    want = [i for r in sorted(pieces.select("doc_id", "start", "ids").collect(), key=lambda r: (r.doc_id, r.start)) for i in r.ids]
    flat = [x for d in range(20) for x in [*tokenizer.encode(f"text number {d} " * d, add_special_tokens=False).ids, 1]]
    assert want == flat
    got = [x for s in range(len(rows)) for x in rows[s].ids[: rows[s].n_tokens]]
    assert Counter(got) == Counter(flat) and all(len(r.ids) == 32 for r in rows.values() if r.n_tokens & (r.n_tokens - 1))
    assert all(set(r.ids[r.n_tokens :]) <= {9} for r in rows.values())
    four = spark.createDataFrame([(1, None)] * 4, "doc_id long, text string")
    assert [(r.n_tokens, r.ids) for r in packing.sequences(packing.packed(four, with_ids=True)).collect()] == [(4, [1] * 4)]
    assert packing.packed(docs.limit(0)).count() == 0
    plain = packing.packed(spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string"), plain_specials=True, with_ids=True).first()
    assert 50256 not in plain.ids and len(plain.ids) > 4


# 12


def brute_phrases(docs, least, top, absorbed=100):
    words_of, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(AZ)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                words_of[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in words_of.items():
        rows = []
        longer = [p for p, a in f.items() if a >= least and len(p) > 2]
        inside = {p[i : i + k] for p in longer for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * f[p] >= absorbed * f[p[i : i + k]]}
        for p, a in f.items():
            if len(p) > 1 and a >= least and p not in inside:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    words = ["a", "b", "the", "É", "日本", "x\xa0y", "Z"]
    phrase = ["the quick brown fox jumps over the lazy dog again", "in spite of", "A b the É"]
    rows = []
    for i in range(150):
        parts = [rng.choice(phrase) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 8))]
        rows.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([". ", ",", "\t", "  ", "\n", "; ", "!?", "\r"]) for p in parts)))
    long = ("en", " ".join(rng.choice(words) for _ in range(30_000)))
    return rows + [rows[3]] * 3 + [(None, None), ("en", None), ("xx", ""), ("fr", " .,"), ("en", "a " * 4000), long]


@pytest.mark.parametrize("least, top, absorbed", [(2, 2000, 100), (5, 7, 100), (20, 30, 90), (10**6, 9, 100)])
def test_collocations(spark, prose, least, top, absorbed):
    docs = spark.createDataFrame(prose, "lang string, text string").withColumns({"n": F.lit(1), "phrase": F.lit("p"), "M": F.lit(0), "key": F.lit("k")}).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least, top, absorbed).collect())
    assert got == brute_phrases(prose, least, top, absorbed)


def test_collocations_prune_nothing(spark, prose, monkeypatch):
    """A bitmap so small that nearly all is kept, and small groups, give the same counts."""
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "GROUP", 200)
    docs = spark.createDataFrame(prose[:60], "lang string, text string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, 4, 500, bits=6).collect())
    assert got == brute_phrases(prose[:60], 4, 500) and got


def test_unary_paths(spark):
    """A repeated passage is one path; where passages part or pieces end, paths do."""
    w = [f"w{i}" for i in range(40)]
    texts = [" ".join(w)] * 5 + [" ".join(w[20:])] * 2 + [" ".join([*w[5:15], "else"])] * 3
    texts = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    bitmaps = []
    for _ in range(collocations.PRUNED):
        bitmaps.append(collocations.frequent(texts, bitmaps, 2, 20))
    paths = {r.phrase: r.n for r in collocations.unary_paths(collocations.longest_runs(texts, bitmaps), 2).collect()}
    cut = lambda a, b: " ".join(w[a:b])
    assert paths == {cut(0, 9): 5, cut(5, 15): 8, " ".join([*w[11:15], "else"]): 3, cut(11, 24): 5, cut(20, 40): 7}
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(empty).count() == 0


# 13


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 2**21 for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centre = [q for _, q in sorted(((name(i), q) for i, q in kept))][:k]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((away(q, c), j) for j, c in enumerate(centre)) for _, q in kept]
    for _ in range(rounds):
        near = assign()
        for j in range(len(centre)):
            mine = [q for (_, q), (_, c) in zip(kept, near, strict=True) if c == j]
            if mine:
                centre[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    near = assign()
    inertia = Counter()
    for d, c in near:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, near, strict=True))


def vectors(seed, n):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(base)]) for i in range(n)]
    rows += [(3, rows[3][1])] * 5 + [(7, rows[8][1]), (None, rows[9][1]), (None, rows[10][1])]  # repeated ids, none
    rows += [(n + i, [float(i % 2)] * 64) for i in range(30)]  # ties and copies
    rows += [(n + 99, None), (n + 98, [0.1] * 63), (n + 97, [0.1] * 65), (n + 96, []), (n + 95, [None] + [0.1] * 63)]
    return rows + [(n + 94, [float("nan")] + [0.1] * 63), (n + 93, [float("inf")] * 64), (n + 92, [-float("inf")] * 64), (n + 91, [1e20] * 64), (-5, [-0.001] * 64), (-6, [2.0**20] * 64)]


@pytest.mark.parametrize("n, kind", [(400, "double"), (12, "float")])
def test_centroids(spark, n, kind):
    rows = vectors(5, n)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"q": F.lit(1), "to": F.lit(2), "cluster": F.lit(3), "OF": F.lit(4)}).repartition(4)
    got = Counter(tuple(r) for r in centroids.cluster_vectors(df).collect())
    assert got == brute_clusters(rows)


def test_centroids_few(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, centroids.cluster_vectors(frame(rows)).collect())) == brute_clusters(rows)
    assert centroids.cluster_vectors(frame([])).count() == centroids.cluster_vectors(frame([(1, [0.5])])).count() == 0
    same = [(i, [0.25] * 64) for i in range(40)]
    assert Counter(map(tuple, centroids.cluster_vectors(frame(same)).collect())) == brute_clusters(same)


def test_bounds_only_skip(spark):
    """Any pivots give the nearest centroid; good ones spare most distances."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-2000, 2000, (12, 64))
    q = middle[rng.integers(0, 12, 3000)] + rng.integers(-20, 20, (3000, 64))
    want = ((q[:, None, :] - middle[None]) ** 2).sum(axis=2)
    for pivots in (middle[:8], q[:1], centroids.choose_pivots(q[:200], 8), np.zeros((3, 64), np.int64)):
        best, least, told = centroids.nearest(q, centroids.to_pivots(q, pivots), middle, pivots)
        assert (best == want.argmin(axis=1)).all() and (least == want.min(axis=1)).all()
    _, _, told = centroids.nearest(q, centroids.to_pivots(q, middle[:8]), middle, middle[:8])
    assert told < 1.5 * len(q)
    huge = np.array([[2**27 - 1] * 64, [-(2**27)] * 64])
    assert centroids.nearest(huge, centroids.to_pivots(huge, huge), huge[::-1], huge)[0].tolist() == [1, 0]


# 9


@pytest.mark.parametrize("repeated", [False, True])
def test_largest_id_and_none(spark, repeated):
    """The largest doc_id is an id like any other, beside rows without one."""
    most, text = 2**63 - 1, "a passage of more than fifty bytes, which stands in several rows of the table"
    rows = [(1, text), (most, "x" + text), (None, text + "y"), (None, "alone")] + [(most, "once more " + text), (None, text + "y")] * repeated
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, len(t), 0 if i == 1 or t == "alone" else len(text)) for i, t in rows)
