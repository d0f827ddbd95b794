"""The training-data pipeline: five operators of spindrift.llm one after another over the table documents.

Each stage works on all that its predecessor kept. All but the last return the columns of documents; the last gives
the mixed blocks. Documents that a stage doesn't judge against stay as they are.

Defined results of every stage but the first for rows that are out of the ordinary: a null or empty text has no lines to
lose, no copies and no benchmark words, so its row stays as it is; rows without doc_id, and rows that share one, are
judged one by one by their texts; an empty table gives an empty table; columns beside doc_id, text, lang, source and
n_chars pass through, whatever their names. Each stage says what it does else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import decontam, language_id, line_dedup, mixing, ngram_join
from spindrift.llm.common import stored, table


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars, if it has that, told anew from the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know. What they reject goes: null and empty texts, texts without letters, and
    texts like none that the models were fitted on; without any labelled row all go."""
    return language_id.keep_identified(docs, language_id.learned(docs))


def drop_common_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that ten or more documents share. Rows of one doc_id, or of none, count as one document.
    A text of such lines only becomes empty, one that was null too."""
    return _as_before(line_dedup.line_dedup(docs), docs)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one of the smallest doc_id; exact copies are near copies, also where they
    share a doc_id or have none. Rows without words all stay."""
    return ngram_join.keep_one_row(docs)


def drop_benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages of the table benchmark; those of which these are four fifths of the words or more go."""
    return _as_before(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of the mix: (shard, slot, source, pass, block, n_words, doc_ids, text). Each row is packed by itself, also where
    rows share a doc_id or have none. Texts without words fill none; no rows, no blocks."""
    return mixing.mixed_blocks(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("source_mixing", mix),
]

#: SQL has no character language models.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
