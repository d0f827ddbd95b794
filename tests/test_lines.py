"""Lines of many files in many splits, against Python's own reading."""

import csv
import io
import random

import pytest

from spindrift.sources import lines, readers


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.fixture
def files(tmp_path):
    """Files of growing size, the first one the smallest; with and without a last line feed, and with every kind of break."""
    rng, out = random.Random(5), []
    for i, n in enumerate([3, 40, 0, 90, 25]):
        parts = ["".join(rng.choice("abc é ") for _ in range(rng.choice([0, 3, 17, 30, 700]))) for _ in range(n)]
        breaks = ["\n", "\r\n", "\r"] if i != 3 else ["\n", "\x0b", "\x85", " ", "\n\n", "\x1c", "\x0c"]
        text = "".join(p + rng.choice(breaks) for p in parts) + "end of file number %d" % i * (i % 2)
        path = tmp_path / f"{i}.txt"
        path.write_bytes(text.encode())
        out.append(path)
    return out


def test_physical_lines(spark, small_splits, files):
    want = [(i, k, x) for i, f in enumerate(files) for k, x in enumerate(f.read_bytes().decode().splitlines(), 1)]
    got = [tuple(r) for r in lines.physical_lines(spark, [str(f) for f in files]).collect()]
    full = lambda rows: sorted(r for r in rows if r[2].strip())
    assert full(got) == full(want)
    assert lines.line_rows(spark, [str(files[3])]).rdd.getNumPartitions() > 4
    for f in files[3:]:
        want = [(str(k), x) for k, x in enumerate(f.read_bytes().decode().splitlines(), 1) if x.strip()]
        assert sorted((r.id, r.text) for r in readers.read_txt(spark, str(f)).collect()) == sorted(want)
        assert sorted((r.id, r.text) for r in readers.read_txt(spark, str(f), 9).collect()) == sorted(w for w in want if int(w[0]) <= 9)
    with pytest.raises(ValueError):
        readers.read_txt(spark, str(files[2]))


def test_first_lines(spark, small_splits, files):
    paths = [str(f) for f in files]
    want = [x.strip() for f in files for x in f.read_bytes().decode().splitlines() if 15 < len(x.strip()) < 600]
    assert sorted(r.text for r in readers.read_corpus(spark, paths).collect()) == sorted(want)
    for n in (1, 2, 10, 41, len(want), len(want) + 5):
        assert sorted(r.text for r in readers.read_corpus(spark, paths, n).collect()) == sorted(want[:n])
    back = [x.strip() for f in files[::-1] for x in f.read_bytes().decode().splitlines() if 15 < len(x.strip()) < 600]
    assert sorted(r.text for r in readers.read_corpus(spark, paths[::-1], 7).collect()) == sorted(back[:7])


def test_vocabulary_file(spark, small_splits, tmp_path):
    tokens = ["[PAD]", "", "a\r", "é", "a", "b\x0bc"] + [f"t{i}" for i in range(300)]
    (tmp_path / "vocab.txt").write_bytes("\n".join(tokens).encode())
    want = {t.rstrip("\r"): i for i, t in enumerate(tokens) if t.rstrip("\r")}
    assert {r.token: r.id for r in readers.read_vocabulary(spark, str(tmp_path / "vocab.txt")).collect()} == want


def test_large_csv(spark, small_splits, tmp_path):
    """Quoted line feeds, commas and quotes, in many splits, as Python's csv module reads them."""
    rng = random.Random(11)
    for end in ("\n", "\r\n"):
        out = io.StringIO()
        write = csv.writer(out, lineterminator=end)
        write.writerow(["id", "Teks ", "x"])
        for i in range(300):
            text = "".join(rng.choice('ab,"\n é') for _ in range(rng.choice([0, 2, 9, 300])))
            write.writerow([i, text, rng.choice(["y", "", 'q"'])])
            out.write(end * (i % 40 == 0))
        path = tmp_path / f"{len(end)}.csv"
        path.write_bytes(out.getvalue().encode())
        rows = list(csv.DictReader(io.StringIO(out.getvalue(), newline="")))
        want = {str(i): r["Teks "] for i, r in enumerate(rows, 1) if r["Teks "].strip()}
        got = {r.id: r.text for r in readers.read_large_csv(spark, str(path)).collect()}
        assert got == want
        assert {r.id for r in readers.read_large_csv(spark, str(path), 20).collect()} == {k for k in want if int(k) <= 20}
        assert lines.line_rows(spark, [str(path)], feeds_only=True).rdd.getNumPartitions() > 20
    (tmp_path / "empty.csv").write_text("\n")
    with pytest.raises(ValueError):
        readers.read_large_csv(spark, str(tmp_path / "empty.csv"))
