"""The registered queries work on whole texts and tables."""

import duckdb
import pytest

from spindrift.functions import wordpiece
from spindrift.oracles import ORACLES
from spindrift.queries import QUERIES

from .test_queries import values

#: Queries over texts, whose SQL reads them whole too.
OVER_TEXTS = """analyze_distinct_texts batch_totals distinct_texts doc_risk export_csv export_csv_browser export_json export_jsonl export_rows highlight_segments
redact_label redact_mapping redact_mask redact_min_sensitivity redact_partial redact_remove streamed_entities upload_lines""".split()


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Two texts and two pages with one prefix of 50,000 characters, and entities behind it."""
    folder = str(tmp_path_factory.mktemp("long"))
    head = "kata " * 10_000
    rows = [(1, head + "surat a@b.co di Medan"), (2, head + "HP 081234567890 dan a@b.co"), (3, "c@d.co"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", OVER_TEXTS)
def test_long_texts_are_whole(spark, long_texts, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{long_texts}/{t}.parquet/*.parquet'")
    assert "50000" not in ORACLES[name]
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, long_texts).toPandas()
    assert len(got) and values(got, sorted(got.columns)) == values(want, sorted(want.columns))


@pytest.mark.parametrize("name, wanted", [("analyze_documents", {1: 2, 2: 2, 3: 1, 4: 0}), ("analyze_browser", {1: 2, 2: 2, 3: 1, 4: 0}), ("export_json", {1: 1, 2: 2, 3: 1})])
def test_long_texts_are_analysed_whole(spark, long_texts, name, wanted):
    got = {r.doc_id: r.total for r in QUERIES[name](spark, long_texts).collect()}
    assert {k: got[k] for k in wanted} == wanted


def test_long_texts_are_pseudonymised_whole(spark, long_texts):
    assert {r.doc_id: r.replaced for r in QUERIES["redact_pseudonym"](spark, long_texts).collect()} == {1: 1, 2: 2, 3: 1, 4: 0}


def test_wordpiece_vocabulary_is_whole(spark, tmp_path):
    """Over 30,000 words: ids are places in the order of all, and the last ones are known too."""
    words = sorted({f"w{i:05d}" for i in range(30_500)} | {"a", "zebra", "été", "zeb"})
    spark.createDataFrame([(" ".join(words),), (None,)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "Zebra zebras w30499 w30499x a Ete w0 quiz 日 zeb"
    spark.createDataFrame([(1, 2, text), (3, 4, ""), (5, 6, None)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    letters = [f"{p}{c}" for p in ("", "##") for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    vocab = {t: i for i, t in enumerate(dict.fromkeys(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters, *words]))}
    got = [tuple(r) for r in QUERIES["wordpiece_ids"](spark, str(tmp_path)).collect()]
    wanted = [2, *[i for w in text.split() for i in wordpiece.longest_pieces(w, vocab, 1)], 3]
    assert [r[2] for r in sorted(got, key=lambda r: (r[0], r[1])) if r[0] == 1002] == wanted and vocab["zebra"] in wanted
    assert sorted(r[:3] for r in got if r[0] != 1002) == [(3004, 0, 2), (3004, 1, 3), (5006, 0, 2), (5006, 1, 3)]
