"""The operators of spindrift.llm against brute force on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import decontam, language_id, line_dedup, lm_score, media, mixing, ngram_join, suffix_dedup, url_filter, warc
from spindrift.llm.common import scratch

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


def corpus(seed=1, n=40):
    """Random texts with near copies, exact copies, a common line, nulls, blanks and a long text."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["Été", "ÉTÉ", "日本", "Der", "the", "😀"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows, base = [], text(120)
    for i in range(n):
        kind = i % 8
        if kind == 0:
            own = base.split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((i, " ".join(own)))
        elif kind == 1:
            rows.append((i, base))
        elif kind == 2:
            rows.append((i, text(rng.randint(1, 8)) + "\nA common LINE\t\n" + text(3)))
        else:
            rows.append((i, text(rng.randint(1, 60)) + "\n" + base[: rng.randint(0, 200)]))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, text(3000)), (n + 4, "a b c"), (n + 5, "A b C"), (-7, "one"), (n + 6, "x" * 5000)]


# 1


def shingles(text):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = corpus(seed, 64)
    out = ngram_join.join_components(frame(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(rows)


def test_ngram_join_of_small_and_chained_sets(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        k = rng.randint(1, 24)
        rows.append((i, " ".join(f"t{j}" if rng.random() > 0.04 else f"z{rng.randint(0, 3)}" for j in range(k))))
    out = ngram_join.join_components(frame(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(rows)


def test_ngram_join_of_large_sets(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(2100)]
    rows = []
    for i in range(30):
        own = base[: rng.choice([1250, 1550, 2100])]
        for _ in range(rng.randint(0, 60)):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 50)}"
        rows.append((i, " ".join(own)))
    out = ngram_join.join_components(frame(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_components(rows)


def test_ngram_join_odd_rows(spark):
    docs = frame(spark, [(None, "a b c", 1), (3, "a b c", 2), (3, "a b c", 3), (5, "A B C", 4)], "doc_id long, text string, component long")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in ngram_join.join_components(docs).collect()) == [(-1, -1), (3, 3), (3, 3), (5, 3)]
    assert sorted((r.doc_id or -1) for r in ngram_join.keep_one(docs).collect()) == [-1, 3, 3] and ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.join_components(docs.limit(0)).count() == 0


# 2


def pages():
    return [(i, f"http://x.org/{i}", f"<p>{i % 7}</p>" if i % 3 else None) for i in range(50)] + [(60, None, "é" * 3000), (61, "u\n v", "\r\n\r\n")]


def test_warc(spark):
    rows = pages()
    manifest = warc.write_archives(frame(spark, rows, "page_id long, url string, html string"), scratch(spark, "t"), archive_records=7)
    assert manifest.count() > 4
    got = {r.page_id: r for r in warc.read_archives(manifest, range_bytes=600).collect()}
    first = {}
    for i, _, html in rows:
        first[html or ""] = max(i, first.get(html or "", i))
    assert set(got) == {r[0] for r in rows}
    for i, _, html in rows:
        body, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(body) and (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
        assert r.payload is None or bytes(r.payload) == body
        assert r.payload_digest == __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()


def test_warc_of_nothing(spark):
    empty = frame(spark, pages(), "page_id long, url string, html string").limit(0)
    assert warc.read_archives(warc.write_archives(empty, scratch(spark, "t"))).count() == 0


def test_zip64_directory(tmp_path):
    import io
    import zipfile

    import pyarrow.fs as pafs

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):  # more members than a plain end record can count
            z.writestr(f"m{i}", b"x%d" % i)
        z.writestr("packed", b"y" * 100, zipfile.ZIP_DEFLATED)
    with pafs.LocalFileSystem().open_input_file(str(path)) as file:
        found = warc.members(file, file.size())
        assert len(found) == 66_000 and "packed" not in found
        at, n = found["m65999"]
        assert file.read_at(n, at) == b"x65999"
    with pytest.raises(ValueError), pafs.LocalFileSystem().open_input_file(str(tmp_path / "b")) if (tmp_path / "b").write_bytes(b"no") else io.BytesIO() as file:
        warc.members(file, file.size())


# 3


def test_media_round_trip(spark, tmp_path):
    rows = corpus(5) + [(1000, "é" * 100_000), (1001, "z" * (192 * 8192 + 5))]
    out = {r.doc_id: r for r in media.media_features(media.encode_media(frame(spark, rows))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
    assert media.media_features(media.encode_media(frame(spark, rows).limit(0))).count() == 0


def test_media_is_what_other_decoders_read(spark, tmp_path):
    text = ("Ünïcode and plain text. " * 40).encode()
    payload = text.ljust(-(-len(text) // 192) * 192)
    (tmp_path / "a.jpg").write_bytes(media.encode_images([payload])[0])
    image = spark.read.format("image").load(str(tmp_path / "a.jpg")).first().image
    samples = np.frombuffer(bytes(image.data), np.uint8).reshape(image.height, image.width, image.nChannels)[4::8, 4::8, 0]
    assert samples.tobytes()[: len(payload)] == payload


def test_jpeg_of_another_encoder(spark, tmp_path):
    """A colour JPEG with subsampling and AC coefficients, as the JVM's encoder writes it."""
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(40, 24, 1)
    for y in range(24):
        for x in range(40):
            image.setRGB(x, y, ((x * 6) << 16) | ((y * 10) << 8) | ((x ^ y) * 4))
    path = str(tmp_path / "b.jpg")
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(path))
    (one, grid), = media.decode_all([open(path, "rb").read()])[0]
    assert (one.width, one.height, grid.shape) == (40, 24, (3, 5))
    for by in range(3):
        for bx in range(5):
            luma = np.mean([0.299 * x * 6 + 0.587 * y * 10 + 0.114 * (x ^ y) * 4 for y in range(by * 8, by * 8 + 8) for x in range(bx * 8, bx * 8 + 8)])
            assert abs(grid[by, bx] - luma) < 6


# 4


def test_targets(spark):
    rng = random.Random(7)
    for _ in range(3):
        sizes = {s: rng.choice([0, 1, 5, 100, 1000, 20_000]) for s in ["a", "b", "É", "z", "", None][: rng.randint(2, 6)]}
        df = frame(spark, [(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
        weight = {s: 1 + i % 3 for i, s in enumerate(names)}
        total, full = sum(sizes.values()), {}
        while True:
            rest = [s for s in names if s not in full]
            left = total - sum(full.values())
            over = [s for s in rest if left * weight[s] / sum(weight[r] for r in rest) > 3 * sizes[s]]
            if not over:
                break
            full |= {s: 3 * sizes[s] for s in over}
        want = full | {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        assert all(got[s] == pytest.approx(want[s]) for s in names)


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing.shuffled_index(F.col("id"), F.lit(n), F.lit(3), 5).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(rng.randint(0, 300))), rng.choice(["a", "a", "a", "b", None])) for i in range(90)] + [(500, None, "c")]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    sources, spans, slots = mixing.mix_sources(docs, block_tokens=16, shard_blocks=20)
    times = Counter((r["rank"], r.block) for r in slots.collect())
    targets = {r.source: (r.target, r.source_size, r["rank"]) for r in sources.collect()}
    size, taken, by_source = Counter(), Counter(), Counter()
    for r in spans.where(~F.col("bare")).collect():
        size[r.doc_id] += r.n_words
        taken[r.doc_id] += r.n_words * times[r["rank"], r.block]
        by_source[r.source] += r.n_words * times[r["rank"], r.block]
    assert all(size[i] == len((t or "").split()) for i, t, _ in rows) and all(taken[i] <= 3 * size[i] for i in size)
    assert all(abs(by_source[s] - t) <= 16 for s, (t, _, _) in targets.items())
    blocks = mixing.mixed_blocks(docs, block_tokens=16, shard_blocks=20).collect()
    words = {i: (t or "").split() for i, t, _ in rows}
    assert Counter(w for b in blocks for w in b.text.split()) == Counter({w: times_ for i in words for w, times_ in counted(i, words[i], spans, times).items()})
    assert sorted(map(str, blocks)) == sorted(map(str, mixing.mixed_blocks(docs, block_tokens=16, shard_blocks=20).collect()))
    assert mixing.mixed_blocks(docs.limit(0)).count() == 0


_SPANS: dict = {}


def counted(doc, words, spans, times):
    if id(spans) not in _SPANS:
        _SPANS[id(spans)] = spans.where(~F.col("bare")).collect()
    out = Counter()
    for r in _SPANS[id(spans)]:
        if r.doc_id == doc:
            for w in words[r.from_word : r.from_word + r.n_words]:
                out[w] += times[r["rank"], r.block]
    return {w: n for w, n in out.items() if n}


# 5


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n  Common line\t\n\n{'rare' if i < 9 else 'Éx'}") for i in range(14)] + [(20, None), (21, ""), (22, "common LINE"), (None, "own 1"), (22, "again")]
    docs = frame(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, n_lines int")
    count = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    for i, t in rows:
        for line in (t or "").split("\n"):
            count[key(line)].add(i)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(count[key(x)]) < 10]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs).collect()) == want
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for k in range(5):
        runs.add(frame(spark, [((1, 1), 1), ((2, k), 1)], "key struct<a:bigint,b:bigint>, n bigint"))
    assert sum(map(len, runs.levels)) == 2 and [tuple(r.key) for r in runs.frequent().collect()] == [(1, 1)]


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_line_runs_of_many_keys(spark, fanout):
    """Sums over many runs and levels; a key that a run shows over the threshold needs no more counting."""
    rng, runs, total = random.Random(fanout), line_dedup.LineRuns(spark, min_docs=6, fanout=fanout), Counter()
    for _ in range(7):
        batch = Counter(rng.randrange(3000) for _ in range(4000))
        runs.add(frame(spark, [((k * 7919, -k), n) for k, n in batch.items()], "key struct<a:bigint,b:bigint>, n bigint"))
        total.update(batch)
    got = runs.frequent().collect()
    assert {r.key.a // 7919 for r in got} == {k for k, n in total.items() if n >= 6} and len(got) == len({r.key for r in got})
    runs.forget()


# 6


@pytest.mark.parametrize("literals", [200_000, 1])
def test_decontamination(spark, literals):
    rng = random.Random(9)
    item = lambda k: " ".join(f"q{rng.randint(0, 60)}" for _ in range(k))
    bench = [(1, item(25)), (10, item(12)), (2, "Tiny ITEM"), (3, None), (4, ""), (5, item(25)), (6, "solo")]
    text = dict(bench)
    rows = [(1, "a, " + text[1].upper() + "! b"), (2, text[10][:30]), (3, None), (4, "x tiny-item y"), (5, "Tiny ITEM tiny item " + text[5]), (6, "Solo soLo"),
            (7, "clean words only"), (8, text[1] + " " + text[1]), (8, "dup id"), (None, "tiny item")] + [(50 + i, item(40)) for i in range(20)]
    docs, items = frame(spark, rows), frame(spark, bench, "item_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = defaultdict(set)
    for i, t in bench:
        w = find(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    want = Counter()
    for i, t in rows:
        w, hit, who = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    who |= windows[tuple(w[k : k + n])]
        want[i, len(w), len(hit), tuple(sorted(who))] += 1
    got = decontam.contamination(docs, items, max_literals=literals).collect()
    assert Counter((r.doc_id, r.n_words, sum(s.stop - s.pos for s in r.spans), tuple(sorted(r.items))) for r in got) == want
    assert decontam.contamination(docs, items.limit(0)).count() == len(rows) and decontam.contamination(docs.limit(0), items).count() == 0
    left = {r.doc_id: r.text for r in decontam.decontaminate(docs.where("doc_id < 8"), items).collect()}
    assert left[7] == "clean words only" and left[4] == "x  y" and 6 not in left and 1 not in left


def test_decontamination_of_rows_that_share_an_id(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    clean = [" ".join(f"{c}{i}" for i in range(12)) for c in "abc"]
    half = f"{item} {clean[2]} more"
    kind = "doc_id long, text string, source string"
    rows = [(i, t, "x") for i in (None, 7) for t in (item, item, clean[0], clean[0], half, None)] + [(None, clean[1], "y")]
    out = decontam.decontaminate(frame(spark, rows, kind), frame(spark, [(1, item)], "item_id long, text string"))
    cut = " " + clean[2] + " more"
    want = [(i, t, "x") for i in (None, 7) for t in (clean[0], clean[0], cut, None)] + [(None, clean[1], "y")]
    assert out.columns == ["doc_id", "text", "source"] and Counter(tuple(r) for r in out.collect()) == Counter(want)


# 7


def test_lm_score(spark):
    rows = [(i, t) for i, t in corpus(11) if i % 9] + [(None, "the x"), (5, "again")]
    docs = frame(spark, rows)
    train = F.coalesce(F.pmod("doc_id", F.lit(3)) != 2, F.lit(True))
    for top in (200_000, 3):
        out = lm_score.score_texts(docs, train, broadcast_words=top, rounds=0).collect()
        token = lambda t: WORD.findall((t or "").translate(AZ)) + [None]
        c = Counter(w for i, t in rows if i is None or i % 3 != 2 for w in token(t))
        n, v, texts = sum(c.values()), len(c), c[None]
        pieces = lm_score.Pieces(lm_score.VOCABULARY)
        stop = (texts + 1) / (n + 2)
        want = Counter()
        for i, t in rows:
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t))
            lm = math.log10(stop) + sum((brute_word(w, pieces) + math.log(1 - stop)) / math.log(10) for w in token(t) if w)
            want[i, len(token(t)), sum(c[w] > 0 for w in token(t)), n, f"{base:.5f}", f"{lm:.4f}"] += 1
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.5f}", f"{r.score:.4f}") for r in out) == want
    assert lm_score.score_texts(docs.limit(0), train).count() == 0


_WORDS: dict = {}


def brute_word(word, pieces):
    if word not in _WORDS:
        import sentencepiece

        if "" not in _WORDS:
            m = sentencepiece.SentencePieceProcessor(model_file=lm_score.VOCABULARY)
            _WORDS[""] = {m.id_to_piece(i): i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        ids, text = _WORDS[""], lm_score.BEGIN + word
        a = [-math.inf] * (len(text) + 1)
        a[0] = 0.0
        for e in range(1, len(text) + 1):
            terms = [a[s] + pieces.log[ids[text[s:e]]] for s in range(max(0, e - 20), e) if text[s:e] in ids]
            if text[e - 1] not in ids:
                terms.append(a[e - 1] + pieces.log[pieces.bytes[list(text[e - 1].encode())]].sum())
            top = max(terms)
            a[e] = top + math.log(sum(math.exp(x - top) for x in terms))
        _WORDS[word] = a[-1]
    return _WORDS[word]


def test_expected_counts_are_a_gradient():
    """The expected count of a piece is the derivative of the log probability by its log weight."""
    pieces = lm_score.Pieces(lm_score.VOCABULARY)
    words, n = ["there", "thé", "日x"], np.array([1.0, 2.0, 1.0])
    counts = lm_score.expected_counts(words, n, pieces)
    for k in np.flatnonzero(counts)[::7]:
        kept = pieces.log[k]
        pieces.log[k] = kept + 1e-5
        up = (lm_score.word_scores(words, pieces) * n).sum()
        pieces.log[k] = kept - 1e-5
        down = (lm_score.word_scores(words, pieces) * n).sum()
        pieces.log[k] = kept
        assert counts[k] == pytest.approx((up - down) / 2e-5, abs=1e-4)


# 8


def test_url_filters(spark):
    rng = random.Random(12)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'A.', 'b.'])}{rng.choice(['example.org', 'x.com', 'y.com', 'z.net', 'q.com'])}{rng.choice(['/de/1', '/fr/', '/en/1', '/es/x', '', '?q', '#f'])}"
            for _ in range(300)] + [None, "no scheme", "://", "ftp://h"]
    rows = list(enumerate(urls))
    want, listed = {}, set()
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], host.translate(AZ)
        fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        want[i] = (host, path, best and best[1] + best[2], best and best[0])
        if best and best[0] == "block":
            listed.add(host)
    pages_ = frame(spark, rows, "page_id long, url string")
    for keys, size in ((200_000, 1 << 26), (2, 1)):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages_, shard_keys=keys, broadcast_bytes=size).collect()}
        assert got == {i: (h, p, r, v or ("block" if h and h in listed else "allow")) for i, (h, p, r, v) in want.items()}
    assert url_filter.filter_urls(pages_.limit(0)).count() == 0


def test_cascade_is_exact():
    import pandas as pd

    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(1 << 63), (1 << 63) - 1, 5000, dtype=np.int64) for _ in range(2))
    for share in (0.0, 0.01, 0.5, 1.0):
        listed = rng.random(5000) < share
        levels = url_filter.cascade(pd.DataFrame({"shard": 0, "a": a, "b": b, "listed": listed}))
        depth, live = np.zeros(5000, int), np.arange(5000)
        for r in levels.itertuples():
            ok = url_filter.passes(np.frombuffer(r.bits, np.uint8), r.size, r.hashes, r.level, a.view(np.uint64)[live], b.view(np.uint64)[live])
            live = live[ok]
            depth[live] += 1
        assert ((depth % 2 == 1) == listed).all()


# 9


def brute_passages(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            g = b[k : k + 50]
            least[g] = min(i, least.get(g, i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", [13, 14])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed, 48)
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdef ") for _ in range(300))
    for k in range(30):
        a = rng.randint(0, 200)
        rows.append((100 + k, passage[a : a + rng.randint(40, 90)] + rng.choice("xyz") * rng.randint(0, 3) + passage[a : a + 51] * rng.randint(0, 2)))
    rows += [(200, "a" * 300), (201, "a" * 120), (202, "ab" * 100)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_passages(frame(spark, rows)).collect()}
    assert got == brute_passages(rows)


def test_suffix_dedup_odd_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=200))
    docs = frame(spark, [(4, text), (4, text[:100]), (None, text), (2, text[50:])])
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_passages(docs).collect())
    assert got == [(2, 150, 0), (4, 100, 50), (4, 200, 150), (99, 200, 200)]
    assert suffix_dedup.remove_passages(docs.limit(0)).count() == 0


def test_long_texts_are_cut_in_slices(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "GROUP", 128)
    text = "".join(random.Random(2).choices("abcdefgh", k=2000)).encode()
    whole = np.frombuffer(text, np.uint8)
    want, *_ = suffix_dedup.anchors(whole, np.zeros(len(text), np.int32))
    found = set()
    for group in suffix_dedup.pieces(pa.array([text])):
        for _, at, part in group:
            places, *_ = suffix_dedup.anchors(np.frombuffer(part, np.uint8), np.zeros(len(part), np.int32))
            found |= {int(p) + at for p in places}
    assert found == {int(p) for p in want}


# 10


def language_rows():
    rng = random.Random(15)
    letters = {"aa": "abcdeo ", "bb": "xyzuvi ", "cc": "éñüörst "}
    make = lambda k, n: "".join(rng.choice(letters[k]) for _ in range(n))
    rows = [(i, make(k, rng.randint(20, 300)), k) for i, k in enumerate(rng.choice(list(letters)) for _ in range(400))]
    return rows + [(500, None, "aa"), (501, "123 !!", "bb"), (502, "", None), (503, "abc ode", None), (504, "ЖЖЩЩ ЪЪ ФФ", None)]


def test_language_id(spark):
    docs = frame(spark, language_rows(), "doc_id long, text string, lang string")
    models = language_id.learned(docs)
    out = {r.doc_id: r for r in language_id.identify(docs, models).collect()}
    wrong = [i for i, _, k in language_rows()[:400] if out[i].lang_pred != k]
    assert len(wrong) <= 2 and all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "aa"] and out[504].rejected
    assert not any(out[i].rejected for i in range(400))
    kept = language_id.keep_identified(docs, models)
    assert {r.doc_id for r in kept.collect()} == set(range(400)) | {503} and kept.columns == docs.columns
    assert language_id.identify(docs.limit(0), models).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.learned(docs.where("lang IS NULL"))).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    """For each context the probabilities of all characters, the unseen one included, add up to one."""
    sym, owner = language_id.symbols(["the cat sat on the mat", "that hat"])
    keys = language_id.contexts(sym, owner)[language_id.scored(owner)]
    models = language_id.Models(["x"], [np.unique(keys, return_counts=True)])
    alphabet = models.grams[1]
    for head in np.unique(keys >> np.uint64(16)):
        logp = models.score((head << np.uint64(16)) | alphabet)[:, 0]
        assert np.exp(logp.astype(float)).sum() + np.exp(models.score(np.array([(head << np.uint64(16)) | np.uint64(0x3042)]))[0, 0]) == pytest.approx(1, abs=1e-3)
