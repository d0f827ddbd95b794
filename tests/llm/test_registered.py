"""The registered queries without SQL, and the pipeline's stages, against brute force on a table with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import language_id, lm_score
from spindrift.llm.common import fresh_names
from spindrift.llm.components import components
from spindrift.llm.queries import QUERIES

from .test_operators import AZ, WORD, brute_components

LETTERS = {"aa": "abcdeo ", "bb": "xyzuvi ", "cc": "éñüörst "}
ITEM = " ".join(f"q{i}" for i in range(14))
#: Names that the operators might use themselves.
CLASH = ["_id", "_drop", "_kept", "_n", "_spans", "_h", "_g", "_fh", "_node", "_gone", "_row", "n_lines", "rank", "block", "component"]


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source): copies, a shared line, benchmark passages, repeats, nulls, blanks and long texts."""
    rng = random.Random(31)
    make = lambda k, n: "".join(rng.choice(LETTERS[k]) for _ in range(n))
    out, base = [], make("aa", 900)
    for i in range(120):
        lang = rng.choice(list(LETTERS))
        text = make(lang, rng.randint(30, 300))
        if i % 6 == 0:
            text += "\n A Shared LINE \n" + make(lang, 40)
        if i % 15 == 1:
            text, lang = base + " extra" * (i % 2), "aa"
        if i % 20 == 3:
            text += " " + ITEM.upper() + " end"
        out.append((i, text, lang, rng.choice(["s1", "s1", "s1", "s2", "É", None])))
    odd = [(500, None, "aa", "s1"), (501, "", "bb", "s2"), (502, " \n\t", None, None), (503, ITEM, "cc", "s1"), (504, make("bb", 40_000), "bb", "s2"), (505, "x" * 3000, "bb", None)]
    shared = [(7, out[7][1], "aa", "s1"), (7, make("aa", 200), "aa", "s1"), (None, base, "aa", "s2"), (None, base, "aa", "s2"), (None, make("cc", 150), "cc", "s2"), (None, None, None, None)]
    return out + odd + shared


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def tokens(text):
    return WORD.findall((text or "").translate(AZ))


def key_of(i):
    return 0 if i is None else zlib.crc32(str(i).encode())


def test_op3(spark, folder, rows):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in QUERIES["op3_media"](spark, folder).collect())
    want = Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        body = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        want[i, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:])] += 1
    assert got == want
    by_text = defaultdict(set)
    for r in QUERIES["op3_media"](spark, folder).collect():
        by_text[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())


def test_op4(spark, folder, rows):
    out = QUERIES["op4_mixing"](spark, folder).collect()
    size, source_size = Counter(), Counter()
    for i, t, _, s in rows:
        size[i, s] += len(tokens(t))
        source_size[s] += len(tokens(t))
    names = sorted((s for s in source_size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, total, full = {s: 1 + k % 3 for k, s in enumerate(names)}, sum(source_size.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left, heavy = total - sum(full.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / heavy > 3 * source_size[s]]
        if not over:
            break
        full |= {s: 3 * source_size[s] for s in over}
    target = full | {s: left * weight[s] / heavy for s in rest}
    want = Counter((i, n, source_size[s], round(target[s], 6)) for (i, s), n in size.items())
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in out) == want
    taken = defaultdict(int)
    for r in out:
        assert r.taken <= 3 * r["size"]
        taken[round(r.target, 6)] += r.taken
    assert all(abs(n - t) <= 128 for t, n in taken.items())
    assert sorted(map(str, out)) == sorted(map(str, QUERIES["op4_mixing"](spark, folder).collect()))


def ways(word, ids, pieces, log):
    """(edges (start, end, piece ids, log weight), forward, backward) of a word's lattice."""
    text = lm_score.BEGIN + word
    edges = []
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - pieces.longest), e):
            if text[s:e] in ids:
                edges.append((s, e, [ids[text[s:e]]]))
        if text[e - 1] not in ids:
            edges.append((e - 1, e, [int(x) for x in pieces.bytes[list(text[e - 1].encode())]]))
    edges = [(s, e, p, sum(log[x] for x in p)) for s, e, p in edges]
    forward, backward = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
    for s, e, _, w in sorted(edges, key=lambda x: x[1]):
        forward[e] += forward[s] * math.exp(w)
    for s, e, _, w in sorted(edges, key=lambda x: -x[0]):
        backward[s] += math.exp(w) * backward[e]
    return edges, forward, backward


def test_op7(spark, tmp_path):
    """With its re-estimated weights, by sums over the lattices of single words."""
    import sentencepiece

    texts = [(i, " ".join(random.Random(i).choices(["the", "there", "Thé", "other", "日x", "ing", "o", "re-used"], k=1 + i % 9))) for i in range(40)] + [(90, None), (None, "the end")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = lm_score.Pieces(lm_score.VOCABULARY)
    m = sentencepiece.SentencePieceProcessor(model_file=lm_score.VOCABULARY)
    ids = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    log = list(pieces.log)
    train = [t for i, t in texts if i is None or key_of(i) % 7 != 2]
    count = Counter(w for t in train for w in tokens(t))
    expected = [1000.0 * p for p in pieces.prior]
    for word, n in count.items():
        edges, forward, backward = ways(word, ids, pieces, log)
        for s, e, p, w in edges:
            for x in p:
                expected[x] += n * forward[s] * math.exp(w) * backward[e] / forward[-1]
    total = sum(expected)
    log = [math.log(max(x / total, 1e-300)) for x in expected]
    n, v = sum(count.values()) + len(train), len(count) + 1
    end = (len(train) + 1) / (n + 2)
    want = Counter()
    for i, t in texts:
        words = tokens(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        lm = sum(math.log10(ways(w, ids, pieces, log)[1][-1]) + math.log10(1 - end) for w in words) + math.log10(end)
        want[i, i is not None and key_of(i) % 7 == 2, len(words) + 1, sum(count[w] > 0 for w in words) + 1, n, f"{base:.5f}", f"{lm:.4f}"] += 1
    got = QUERIES["op7_lm_score"](spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.5f}", f"{r.score:.4f}") for r in got) == want


def characters(text):
    """Lower-case letters, a space for each run of others, with three spaces of context before."""
    return "  " + re.sub(r" +", " ", " " + "".join(c.lower() if c.isalpha() else " " for c in text or ""))


class Dictionary:
    """Interpolated Kneser-Ney of one language in dictionaries."""

    def __init__(self, texts, alphabet):
        grams, self.levels, self.alphabet = Counter(), {}, alphabet
        for t in texts:
            c = characters(t)
            grams.update(c[k - 3 : k + 1] for k in range(3, len(c)))
        for n in (4, 3, 2, 1):
            ones, twos = (sum(x == k for x in grams.values()) for k in (1, 2))
            total, kinds = Counter(), Counter()
            for g, x in grams.items():
                total[g[:-1]] += x
                kinds[g[:-1]] += 1
            self.levels[n] = (grams, total, kinds, ones / (ones + 2 * twos) if ones and twos else 0.5)
            lower = Counter()
            for g in grams:
                lower[g[1:]] += 1
            grams = lower

    def p(self, gram):
        grams, total, kinds, d = self.levels[len(gram)]
        head = gram[:-1]
        below = 1 / (self.alphabet + 1) if len(gram) == 1 else self.p(gram[1:])
        if not total[head]:
            return below
        return max(grams[gram] - d, 0) / total[head] * (gram in grams) + d * kinds[head] / total[head] * below


def test_op10(spark, folder, rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = F.pmod(F.xxhash64("doc_id", "text", F.lit("calibration")), F.lit(1000)) < int(1000 / 3)
    sample = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(~language_id.held_out()).select("doc_id", "text", "lang", held.alias("held")).distinct().collect()
    learn = {k: [r.text for r in sample if r.lang == k and not r.held] for k in LETTERS}
    alphabet = len({c for texts in learn.values() for t in texts for c in characters(t)[3:]})
    models = {k: Dictionary(t, alphabet) for k, t in learn.items()}
    full = {(r.doc_id, r.nats, r.lang_pred) for r in language_id.identify(docs, language_id.learned(docs)).collect()}
    by_id = {i: (n, p) for i, n, p in full if i is not None and i != 7}
    for i, text, *_ in rows:
        if i is None or i == 7 or i == 504:
            continue
        c = characters(text)
        if not any(x.isalpha() for x in text or ""):
            assert by_id[i][1] == "und"
            continue
        nats = {k: -sum(math.log(m.p(c[j - 3 : j + 1])) for j in range(3, len(c))) / (len(c) - 3) for k, m in models.items()}
        assert by_id[i][0] == pytest.approx(min(nats.values()), abs=2e-3) and by_id[i][1] == min(nats, key=nats.get)
    got = QUERIES["op10_language_id"](spark, folder).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, i is not None and key_of(i) % 4 == 2) for i, *_ in rows)
    wrong = [r.doc_id for r in got if r.held_out and r.doc_id != 7 and r.lang_pred != "und" and r.lang_pred != dict((i, k) for i, _, k, _ in rows)[r.doc_id]]
    assert len(wrong) <= 1 and all(0 <= r.score <= 1 for r in got)


def test_fresh_names(spark):
    df = spark.range(1).selectExpr("id AS _id", "id AS __ID", "id AS x")
    assert fresh_names(df, "_id", "_id", "y") == ["___id", "____id", "y"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(c) for c in CLASH})


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "source_mixing"])
def test_stages(spark, folder, rows, name):
    """Each stage on odd rows, with columns whose names clash, and on an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stage, docs = dict(corpus_pipeline.STAGES)[name], clashing(spark, rows)
    assert stage(spark, docs.limit(0), folder).count() == 0
    out = stage(spark, docs, folder)
    got = out.collect()
    if name == "source_mixing":
        words, taken = Counter(w for _, t, *_ in rows for w in (t or "").split()), Counter(w for r in got for w in r.text.split())
        assert set(taken) <= set(words) and abs(sum(taken.values()) - sum(words.values())) <= 128 * 5 and all(taken[w] <= 3 * words[w] for w in words)
        return
    assert out.columns == docs.columns and all(getattr(r, c) == c for r in got for c in CLASH if c != "n_lines" or name != "line_dedup")
    texts = Counter((r.doc_id, r.text) for r in got)
    if name == "language_id":
        want = Counter((i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or ""))
        assert not texts - want and sum((want - texts).values()) <= 4  # the odd ones may be rejected
    elif name == "line_dedup":
        seen, key = defaultdict(set), lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
        for i, t, *_ in rows:
            for x in (t or "").split("\n"):
                seen[key(x)].add(i)
        assert texts == Counter((i, "\n".join(x for x in (t or "").split("\n") if not key(x) or len(seen[key(x)]) < 10)) for i, t, *_ in rows)
        assert all("Shared" not in (r.text or "") for r in got)
    elif name == "ngram_jaccard_join":
        ids = {k: (r[0] if r[0] is not None else 10_000 + k) for k, r in enumerate(rows)}
        ids = {k: i if list(ids.values()).count(i) == 1 else 20_000 + k for k, i in ids.items()}
        group = {i: c for i, (_, c) in brute_components([(ids[k], r[1]) for k, r in enumerate(rows)]).items()}
        empty = [(r[0], r[1]) for r in rows if not tokens(r[1])]
        full = {t: group[ids[k]] for k, (_, t, *_) in enumerate(rows) if tokens(t)}
        kept = [t for i, t in texts.elements() if tokens(t)]
        assert sorted(full[t] for t in kept) == sorted(set(full.values())) and Counter(x for x in texts.elements() if not tokens(x[1])) == Counter(empty)
    else:
        find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
        item, want = find(ITEM), Counter()
        for i, t, *_ in rows:
            w, hit = find(t), set()
            for k in range(len(w) - 9):
                if " ".join(w[k : k + 10]) in {" ".join(item[j : j + 10]) for j in range(5)}:
                    hit |= set(range(k, k + 10))
            if len(hit) < 0.8 * max(1, len(w)):
                want[i, tuple(x for k, x in enumerate(w) if k not in hit)] += 1
        assert Counter((i, tuple(find(t))) for i, t in texts.elements()) == want


@pytest.mark.parametrize("docs_each", [40, 600])
def test_unseen_writing_is_rejected(spark, docs_each):
    """Whatever the language a text is taken for, and however few documents calibrated it: other alphabets and letters at
    random go, documents of the language stay."""
    rng = random.Random(docs_each)
    grown = {k: ["".join(rng.choice(v.strip()) for _ in range(rng.randint(2, 7))) for _ in range(60)] for k, v in LETTERS.items()}
    text = lambda k, n: " ".join(rng.choice(grown[k]) for _ in range(n))
    rows = [(i, text(k, rng.randint(5, 60)), k) for i, k in enumerate(sorted(LETTERS) * docs_each)]
    models = language_id.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = ["Всички хора се раждат свободни и равни", "Όλοι οι άνθρωποι", "人人生而自由在尊严和权利上", "qwk jhf gmp tlw"] + ["".join(rng.choice("бвгджзклм") for _ in range(n)) for n in (10, 100, 3000)]
    for i in range(len(LETTERS)):
        nats, letters = models.entropies(odd)
        assert models.rejected(np.full(len(odd), i), nats[:, i], letters).all()
    new = [(i, text(k, rng.randint(5, 60)), k) for i, k in enumerate(sorted(LETTERS) * 300)]
    out = language_id.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), models).collect()
    assert sum(r.rejected for r in out) <= 9 and all(r.lang_pred == k for r, (_, _, k) in zip(sorted(out), new, strict=True))


def test_pipeline_plans_stay_small(spark, folder):
    """No job of the pipeline has a plan of more than 80 nodes: the driver plans what is left anew at every stage of a job, so large plans
    filled its memory (173 nodes in the mix, 91 in the join's edges, 73 in each step of its components before)."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from spindrift.llm.common import stored

    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def plans():
        bus.waitUntilEmpty(30_000)
        found = store.executionsList()
        return [found.apply(i).executionId() for i in range(found.size())]

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        last = max(plans(), default=-1)
        docs = stored(stage(spark, docs, folder), name)
        sizes = [store.planGraph(i).allNodes().size() for i in plans() if i > last]
        assert sizes and max(sizes) <= 80, (name, sorted(sizes)[-5:])


def test_components_of_chains_hubs_and_pairs(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000 + i, 999) for i in range(80)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(5, 5), (7, 6), (6, 7), (-3, 9)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == len(least) and {r.node: r.component for r in got} == least
