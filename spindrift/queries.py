"""The registered queries: each runs an operator over whole tables. The SQL in oracles.py says the same for DuckDB."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import wordpiece
from .functions.expr import ENTITY, empty
from .functions.labels import BIO, label_table, title
from .functions.patterns import not_blank
from .operators import chunking, classify, corpus, evaluation, generator, segmentation, span_arrays, spans, stats, teacher, token_model
from .operators.classify import marker_classifier, rule_classifier, structured_classifier
from .plans import browser, pipeline, scratch, variants
from .plans.options import Options
from .sources import lines, readers, sinks
from .streaming import stream

#: The registered queries work on whole texts; only clip_flags clips.
WHOLE = Options(max_characters=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores is dealt out before row-local work; a larger one stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def order_lines(spark, sf_dir) -> DataFrame:
    """One row for each order and line number."""
    top = [F.max(c).alias(c) for c in ("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*top)


def found(docs: DataFrame) -> DataFrame:
    """(…, text, entities) of the structured labels over whole texts."""
    docs = pipeline.clip(docs, WHOLE)
    return docs.withColumn("entities", spans.verify(F.col("text"), empty(ENTITY)))


def pii_scan(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.inline(spans.structured_matches(F.col("text"))))
    return rows.select("doc_id", "label", "start", "end", "text")


def pii_scan_pages(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.inline(spans.structured_matches(F.col("html"))))
    return rows.select("page_id", "label", "start", "end", "text")


def pii_label_counts(spark, sf_dir) -> DataFrame:
    return stats.label_counts(pii_scan(spark, sf_dir))


def pii_by_source(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", F.inline(spans.structured_matches(F.col("text"))))
    return docs.groupBy("source", "lang", "label").agg(F.count("*").alias("entities"))


def doc_risk(spark, sf_dir) -> DataFrame:
    out = found(documents(spark, sf_dir)).withColumn("risk", stats.risk(F.col("entities")))
    return out.select("doc_id", F.size("entities").alias("total"), "risk", stats.risk_band(F.col("risk")).alias("band"))


def _redacted(strategy: str, least: int = 0):
    def query(spark, sf_dir) -> DataFrame:
        out = pipeline.redact(found(documents(spark, sf_dir)), strategy, least)
        return out.select("doc_id", F.sha2("redaction.text", 256).alias("redacted_sha256"), F.col("redaction.replaced").alias("replaced"))

    return query


def redact_mapping(spark, sf_dir) -> DataFrame:
    out = pipeline.redact(found(documents(spark, sf_dir)), "label", include_mapping=True)
    return out.select("doc_id", F.explode("redaction.mapping").alias("value", "token"))


def clip_flags(spark, sf_dir) -> DataFrame:
    out = pipeline.clip(documents(spark, sf_dir), Options(max_characters=2000))
    return out.select("doc_id", F.length("text").alias("characters"), "truncated", (~not_blank(F.col("text"))).alias("blank"))


def chunk_windows(spark, sf_dir) -> DataFrame:
    rows = chunking.window_rows(documents(spark, sf_dir))
    return rows.select("doc_id", F.col("chunk_no").alias("chunk_no"), F.col("offset").alias("start"), F.length("text").alias("characters"))


def batch_totals(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    wide = Options(window=1 << 30, overlap=0, max_characters=None)  # a page is one window
    return pipeline.batch_summary(pipeline.batch(pages, wide, structured_classifier))


def analyze_documents(spark, sf_dir) -> DataFrame:
    out = pipeline.analyze(documents(spark, sf_dir), WHOLE)
    return out.select("doc_id", "truncated", "stats.total", "stats.risk", "stats.characters", "stats.chunks",
                      F.array_join(F.transform("stats.by_label", lambda x: F.concat_ws("=", x["label"], x["count"])), " ").alias("by_label"))


def analyze_conversations(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    return stats.preview(pipeline.batch(turns, WHOLE)).select("id", "total", "risk", "band", "labels")


def analyze_distinct_texts(spark, sf_dir) -> DataFrame:
    out = pipeline.analyze_distinct(documents(spark, sf_dir), WHOLE, classifier=structured_classifier)
    return out.select("doc_id", "stats.total", "stats.risk", "truncated")


def analyze_browser(spark, sf_dir) -> DataFrame:
    out = browser.analyze_browser(documents(spark, sf_dir), Options.browser(max_characters=None))
    return out.select("doc_id", "stats.total", "stats.risk", "stats.characters", "stats.chunks")


def gold_documents(spark, sf_dir) -> DataFrame:
    """A sentence for each customer, written: what reads its text does not draw it anew each time."""
    return scratch.checkpointed(generator.gold_sentences(spread(table(spark, sf_dir, "customer")), "c_custkey"))


def analyze_gold(spark, sf_dir) -> DataFrame:
    gold = gold_documents(spark, sf_dir)
    out = pipeline.analyze(gold.select("doc_id", "text"), WHOLE)
    return pipeline.entity_rows(out, "doc_id")


def gold_scores(spark, sf_dir) -> DataFrame:
    gold = gold_documents(spark, sf_dir)
    found_ = pipeline.analyze(gold.select("doc_id", "text"), WHOLE)
    return evaluation.scores(evaluation.span_keys(found_), evaluation.span_keys(gold))


def variant_scores(spark, sf_dir) -> DataFrame:
    gold = gold_documents(spark, sf_dir)
    docs, known = gold.select("doc_id", "text"), evaluation.span_keys(gold)
    return variants.compare_variants(docs, known, {"rules": rule_classifier, "structured": structured_classifier}, "rules", WHOLE)


def gold_sentences(spark, sf_dir) -> DataFrame:
    gold = gold_documents(spark, sf_dir)
    return gold.select("doc_id", F.inline("entities"))


def markers(spark, sf_dir) -> DataFrame:
    out = documents(spark, sf_dir).select("doc_id", F.inline(marker_classifier({"the": "PER", "und": "LOC"})(F.col("text"))))
    return out.groupBy("doc_id", "label").agg(F.count("*").alias("spans"), F.sum("start").alias("starts"))


def line_spans(spark, sf_dir) -> DataFrame:
    """Spans made of order lines: a document is eight orders."""
    return order_lines(spark, sf_dir).select(
        F.expr("l_orderkey div 8").alias("doc_id"), (F.col("l_partkey") % 500).cast("int").alias("start"),
        (F.col("l_partkey") % 500 + F.col("l_quantity")).cast("int").alias("end"), F.col("l_returnflag").alias("label"),
        (F.col("l_linenumber").cast("double") / 10).alias("score"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("seq"),
        F.col("l_linestatus").alias("status"),
    )


def merge_islands(spark, sf_dir) -> DataFrame:
    return spans.merge_island_rows(line_spans(spark, sf_dir).drop("status")).select("doc_id", "label", "start", "end", "score", "pos")


def text_islands(spark, sf_dir) -> DataFrame:
    """The rule classifier's spans in all documents, one row each, joined where only white space parts them."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", F.inline(span_arrays.ruled_spans(F.col("text"))))
    return spans.merge_island_rows(rows).select("doc_id", "label", "start", "end", "score")


def resolve_overlaps(spark, sf_dir) -> DataFrame:
    return spans.resolve_rows(line_spans(spark, sf_dir)).select("doc_id", "start", "end", "label", "score", "pos")


def unmatched_spans(spark, sf_dir) -> DataFrame:
    rows = line_spans(spark, sf_dir)
    return spans.unmatched_rows(rows.where("status = 'O'"), rows.where("status = 'F'")).select("doc_id", "start", "end", "label", "seq")


def repaired_spans(spark, sf_dir) -> DataFrame:
    rows = line_spans(spark, sf_dir)
    return spans.repair_rows(rows.where("status = 'O'").drop("status"), rows.where("status = 'F'"))


def contained_spans(spark, sf_dir) -> DataFrame:
    return spans.drop_contained_rows(line_spans(spark, sf_dir)).select("doc_id", "start", "end", "label", "seq")


def deduped_spans(spark, sf_dir) -> DataFrame:
    rows = line_spans(spark, sf_dir).withColumns({"start": F.col("start") % 20, "end": F.lit(30)})
    return spans.dedupe_rows(rows).select("doc_id", "start", "end", "label", "score", "seq")


def label_join(spark, sf_dir) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in ("PER", "LOC", "EMAIL", "SSN", "misc")])
    rows = table(spark, sf_dir, "lineitem").select(F.get(codes, F.col("l_partkey") % 5).alias("code"))
    joined = rows.groupBy("code").agg(F.count("*").alias("lines")).join(label_table(spark), "code", "left")
    return joined.select(
        "code", F.coalesce("display", title(F.col("code"))).alias("display"), F.coalesce("sensitivity", F.lit(2)).alias("sensitivity"),
        F.coalesce("color", F.lit("#94a3b8")).alias("color"), F.coalesce("structured", F.lit(False)).alias("structured"), "lines",
    )


def export_rows(spark, sf_dir) -> DataFrame:
    out = found(documents(spark, sf_dir)).select("doc_id", F.inline(sinks.export_rows(F.col("entities"))))
    return out.select("doc_id", "index", "label", "text", "start", "end", "score", "verified")


def _exported(fmt: str, profile: str = "server"):
    def query(spark, sf_dir) -> DataFrame:
        return sinks.export(found(documents(spark, sf_dir)), fmt, profile).select("doc_id", "export")

    return query


def export_json(spark, sf_dir) -> DataFrame:
    """What the exported JSON says, read back."""
    out = sinks.export(pipeline.analyze(documents(spark, sf_dir), WHOLE, structured_classifier), "json")
    read = F.from_json("export", "text string, stats struct<total:int,risk:int,characters:int>, entities array<struct<index:int,label:string,text:string,start:int>>")
    rows = out.select("doc_id", read.alias("j"))
    labels = F.array_join(F.transform("j.entities", lambda e: F.concat_ws(":", e["start"], e["label"], e["text"])), " ")
    return rows.select("doc_id", F.length("j.text").alias("characters"), "j.stats.total", "j.stats.risk", F.sha2(labels, 256).alias("entities_sha256"))


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = line_spans(spark, sf_dir)
    moved = (F.col("end") - F.col("start") > 40).cast("int")
    return (rows.where("score >= 0.2").withColumn("start", F.col("start") + moved), rows.where("score <= 0.4"))


def span_scores(spark, sf_dir) -> DataFrame:
    return evaluation.scores(*_sides(spark, sf_dir))


def span_fidelity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 8").alias("doc_id")).distinct()
    return evaluation.fidelity(docs, *_sides(spark, sf_dir))


def bio_tokens(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(BIO[i]) for i in (0, 1, 2, 2, 7, 8)])
    pos = F.col("l_linenumber")
    return order_lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("doc_id"), pos.alias("pos"), (pos * 10).cast("int").alias("start"), (pos * 10 + 5).cast("int").alias("end"),
        F.get(names, F.col("l_partkey") % 6).alias("name"), (F.col("l_partkey") % 100 / 100.0).alias("score"),
    )


def bio_decode(spark, sf_dir) -> DataFrame:
    return evaluation.decode_rows(bio_tokens(spark, sf_dir)).select("doc_id", "start", "end", "label", "score")


def bio_decode_arrays(spark, sf_dir) -> DataFrame:
    names = F.create_map(*[x for i, n in enumerate(BIO) for x in (F.lit(n), F.lit(i))])
    rows = bio_tokens(spark, sf_dir).withColumn("code", F.element_at(names, F.col("name")))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "code", "score"))).alias("t"))
    out = evaluation.bio_decode(F.transform("t", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))), F.col("t.code"), F.col("t.score"))
    return docs.select("doc_id", F.inline(out))


def bio_encode(spark, sf_dir) -> DataFrame:
    rows = order_lines(spark, sf_dir)
    n = F.col("l_linenumber")
    token = F.struct((n * 10).cast("int").alias("start"), (n * 10 + 5).cast("int").alias("end"))
    label = F.get(F.array(F.lit("PER"), F.lit("LOC"), F.lit("ODD")), F.col("l_partkey") % 3)
    span = F.struct((n * 20).cast("int").alias("start"), (n * 20 + 15).cast("int").alias("end"), label.alias("label"))
    docs = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(token)).alias("tokens"), F.array_sort(F.collect_list(span)).alias("spans"))
    codes = docs.select("doc_id", "tokens", F.posexplode(evaluation.bio_encode(F.col("tokens"), F.col("spans"))).alias("pos", "code"))
    return codes.select("doc_id", "pos", F.get("tokens", F.col("pos"))["start"].alias("start"), "code")


def highlight_segments(spark, sf_dir) -> DataFrame:
    out = found(documents(spark, sf_dir))
    rows = out.select("doc_id", F.posexplode(evaluation.segments(F.col("text"), F.col("entities"))).alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.label", F.length("s.text").alias("characters"))


def distinct_texts(spark, sf_dir) -> DataFrame:
    docs = pipeline.clip(documents(spark, sf_dir), WHOLE)
    return docs.agg(F.count("*").alias("documents"), F.count_distinct("text").alias("texts"))


def upload_lines(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.posexplode(readers.split_lines(F.col("text"))).alias("pos", "line"))
    docs = docs.where(F.col("line").rlike(r"(?U)[^\s\x1c-\x1f]"))
    return docs.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.length("line").alias("characters"))


def pasted_lines(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.inline(readers.browser_lines(F.col("text"))))
    return rows.select("doc_id", F.col("id"), F.length("text").alias("characters"))


def pasted_csv(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.inline(readers.browser_lines(F.col("text"), csv=True)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters"))


def corpus_lines(spark, sf_dir) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.explode(F.split("text", "\n", -1)).alias("value"))
    return corpus.unique_lines(readers.corpus_lines(rows))


def _files(spark, sf_dir, name: str) -> list[str]:
    """The documents' texts as text files, a folder a language, written in the order of doc_id; the folders by language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"), F.coalesce("lang", F.lit("-")).alias("lang"))
    path = scratch.new_path(spark, name)
    rows.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").text(path)
    return [f"{path}/lang={r.lang}" for r in rows.select("lang").distinct().orderBy("lang").collect()]  # a path a language


def file_lines(spark, sf_dir) -> DataFrame:
    """All lines of the files, with their physical numbers."""
    rows = lines.physical_lines(spark, _files(spark, sf_dir, "lines"))
    return rows.where(not_blank(F.col("value"))).select("path_no", "line_no", F.length("value").alias("characters"))


def corpus_head(spark, sf_dir) -> DataFrame:
    """The first 3,000 fitting lines of the files, taken one after another: the limit is the feature."""
    return readers.read_corpus(spark, _files(spark, sf_dir, "corpus"), 3000).select(F.sha2("text", 256).alias("line_sha256"))


def piece_vocabulary(spark, sf_dir) -> DataFrame:
    """(piece, id): the distinct words of the documents, numbered in the order of their first places."""
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "piece"))
    first = words.groupBy("piece").agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("piece", "at.doc_id", "at.pos")
    return corpus.numbered(first, "doc_id", "pos").select("piece", F.col("place").alias("id"))


def vocabulary_trim(spark, sf_dir) -> DataFrame:
    vocab = piece_vocabulary(spark, sf_dir)
    used = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("piece"))
    return corpus.renumber(vocab, corpus.keep_set(vocab, ["the"], "corpus", used))


def vocabulary_latin(spark, sf_dir) -> DataFrame:
    vocab = piece_vocabulary(spark, sf_dir)
    return corpus.keep_set(vocab, ["the"], "latin").agg(F.count("*").alias("pieces"), F.sum(F.length("piece")).alias("characters"))


def translated_ids(spark, sf_dir) -> DataFrame:
    vocab = piece_vocabulary(spark, sf_dir)
    mapping = vocabulary_trim(spark, sf_dir)
    ids = corpus.translate_ids(vocab.select("id"), mapping)
    return ids.agg(F.count("*").alias("ids"), F.count_if(F.col("new_id") < 0).alias("pruned"), F.max("new_id").alias("last"))


def added_tokens(spark, sf_dir) -> DataFrame:
    """Added tokens are the words of benchmark; those that the vocabulary lacks have numbers beyond it."""
    vocab = piece_vocabulary(spark, sf_dir)
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("content")).distinct()
    beyond = vocab.select("piece").union(words.select("content")).distinct()  # what the tokenizer keeps may be an added token only
    own = F.length("content") + F.lit(1 << 40)
    added = words.join(vocab.select(F.col("piece").alias("content"), "id"), "content", "left").withColumn("id", F.coalesce("id", own))
    keep = corpus.keep_set(beyond, ["the"], "latin")
    return corpus.renumber_added(added, corpus.renumber(vocab, keep), keep)


def divergence_sample(spark, sf_dir) -> DataFrame:
    """How many sampled lines lose a word to the pruned vocabulary; a document is a corpus file."""
    sample = corpus.sampled_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    words = sample.select("doc_id", "line_no", F.posexplode(F.split("line", " ", -1)).alias("pos", "piece"))
    kept = vocabulary_trim(spark, sf_dir).select("piece", "new_id")
    new = words.join(kept, "piece", "left").groupBy("doc_id", "line_no").agg(F.count_if(F.col("new_id").isNull()).alias("lost"))
    pairs = new.select(F.lit(0).alias("old"), F.col("lost").alias("new"))
    return evaluation.divergence(pairs).crossJoin(pairs.agg(F.count("*").alias("lines")))  # one row each


#: Pieces and ranks of a public vocabulary, which stand for a Unigram model's: the weight of a rank is 1 / (rank + 10).
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def tokenizer_file(spark) -> str:
    """The vocabulary as a tokenizer's JSON file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_unknown(i))]
    special = [model.id_to_piece(i) for i in ids if model.is_control(i)]
    scores = [0.0] + [-math.log(10 - model.get_score(i)) for i in ids]
    text = segmentation.unigram_json(["<unk>"] + [model.id_to_piece(i) for i in ids], scores, 0, ["<unk>", *special])
    path = scratch.new_path(spark, "tokenizer")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def unigram_pieces(spark, sf_dir) -> DataFrame:
    """The pieces that the tokenizer emits over all documents."""
    return segmentation.emitted_pieces(documents(spark, sf_dir), readers.read_tokenizer(spark, tokenizer_file(spark)), 0)


def _pruned(spark, sf_dir) -> tuple[str, str, DataFrame]:
    """(tokenizer's path, pruned tokenizer's path, mapping): pieces that the tokenizer emits over benchmark stay, and the safe ones."""
    source, out = tokenizer_file(spark), scratch.new_path(spark, "pruned")
    vocab = readers.read_tokenizer(spark, source)
    used = segmentation.emitted_pieces(table(spark, sf_dir, "benchmark"), vocab, 0)
    return source, out, segmentation.rewrite_tokenizer(spark, source, out, corpus.keep_set(vocab, ["<unk>", "<s>", "</s>"], "corpus", used))


def pruned_tokenizer(spark, sf_dir) -> DataFrame:
    """The pruned tokenizer's file, read back, with the ids that its pieces had before."""
    _, out, mapping = _pruned(spark, sf_dir)
    return readers.read_tokenizer(spark, out).join(mapping.select("piece", "old_id"), "piece").select("id", "piece", "score", "old_id")


def unigram_divergence(spark, sf_dir) -> DataFrame:
    """How many of all lines of more than 20 characters the pruned tokenizer segments in another way."""
    source, out, mapping = _pruned(spark, sf_dir)
    rows = documents(spark, sf_dir).select(F.explode(F.split("text", "\n", -1)).alias("text")).where(F.length(F.trim("text")) > 20)
    unknown = mapping.where("old_id = 0").first().new_id
    return segmentation.divergence(rows, readers.read_tokenizer(spark, source), readers.read_tokenizer(spark, out), mapping, (0, unknown))


def alias_chains(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0 AND c_custkey % 10 <> 1").select(F.col("c_custkey").alias("alias"), (F.col("c_custkey") - 1).alias("target"))
    return corpus.resolve_aliases(rows)


def reached_names(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    edges = rows.select(F.col("c_custkey").alias("source"), (F.col("c_custkey") * 2).alias("target"))
    roots = rows.where("c_custkey % 100 = 1").select(F.col("c_custkey").alias("name"))
    return corpus.prune(rows.select(F.col("c_custkey").alias("name"), "c_mktsegment"), corpus.used_names(edges, roots))


def dev_split(spark, sf_dir) -> DataFrame:
    return corpus.split_rows(documents(spark, sf_dir), "doc_id", 0.05).select("doc_id", "is_dev")


def wordpiece_ids(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(wordpiece.words_of(F.lower("text"))).alias("w")).select(F.col("w.text").alias("piece")).distinct()
    letters = [f"{p}{c}" for p in ("", "##") for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    vocab = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *letters])}
    known = corpus.numbered(words.where(~F.col("piece").isin(letters)), "piece")
    known = known.select("piece", (F.col("place") + len(vocab)).cast("int").alias("id"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return wordpiece.encode(turns, vocab, more=known)


def sentence_vocabulary(sentences: DataFrame) -> DataFrame:
    """(token, id): special tokens, letters and digits alone and going on, and all words of letters in the sentences."""
    fixed = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *[f"{p}{c}" for p in ("", "##") for c in "abcdefghijklmnopqrstuvwxyz0123456789.,;:+@-_"]]
    words = sentences.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(wordpiece.WORDS), F.lit(0))).alias("token"))
    words = corpus.numbered(words.where(F.col("token").rlike("^[a-z]{2,}$")).distinct(), "token")
    first = sentences.sparkSession.createDataFrame(list(enumerate(fixed)), "id int, token string")
    return first.select("token", "id").union(words.select("token", (F.col("place") + len(fixed)).cast("int")))


def _tagged(spark, sf_dir):
    """(pieces, model): a tagger trained on a sentence for each customer."""
    gold = gold_documents(spark, sf_dir)
    pieces = wordpiece.load_wordpieces(scratch.checkpointed(sentence_vocabulary(gold)))
    return pieces, token_model.trained_tagger(gold, pieces)


def order_keys(spark, sf_dir) -> DataFrame:
    """The key of each order's sentence, one that no customer has."""
    return spread(table(spark, sf_dir, "orders").select((F.col("o_orderkey") + (1 << 40)).alias("key")))


def order_sentences(spark, sf_dir) -> DataFrame:
    """A sentence for each order, of draws that no customer's has."""
    return generator.gold_sentences(order_keys(spark, sf_dir), "key")


def analyze_tokens(spark, sf_dir) -> DataFrame:
    """Entities of the orders' sentences by the trained token model and the browser's chain."""
    out = token_model.analyze_tokens(order_sentences(spark, sf_dir).select("doc_id", "text"), *_tagged(spark, sf_dir), Options.browser(max_characters=None))
    return pipeline.entity_rows(out, "doc_id")


def token_scores(spark, sf_dir) -> DataFrame:
    """What the token model finds in the orders' sentences, against what was filled in. A sentence follows from its key, so equal
    keys are one document, and what was found stands beside what was filled in."""
    gold = generator.gold_sentences(order_keys(spark, sf_dir).distinct(), "key").withColumnRenamed("entities", "gold")
    found_ = token_model.analyze_tokens(gold, *_tagged(spark, sf_dir), Options.browser(max_characters=None))
    return evaluation.row_scores(found_, F.col("entities"), F.col("gold"))


def dictionary_spans(spark, sf_dir) -> DataFrame:
    """How often the words of benchmark, as long as a dictionary goes to a task, stand in each document."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("w")).where(F.length("w") > 3).distinct().collect()
    find = classify.dictionary_classifier({r.w: r.w for r in words})
    out = documents(spark, sf_dir).select("doc_id", F.explode(find(F.coalesce("text", F.lit("")))).alias("s"))
    return out.groupBy("doc_id", F.col("s.label").alias("word")).agg(F.count("*").alias("spans"))


def place_model():
    """A teacher: a function that finds the generator's names and towns in a list of texts."""
    from .functions.trie import Trie, code_points

    names = [(w, "PER") for w in generator.FIRST + generator.LAST] + [(w, "LOC") for w in generator.POOLS["town"]]
    trie = Trie([w for w, _ in names])

    def predict(texts: list[str]) -> list[list[dict]]:
        out = []
        for text in texts:
            codes, lens = code_points([text])
            hits = sorted(zip(*[x.tolist() for x in trie.matches(codes, lens[0] - np.arange(lens[0]))], strict=True))
            out.append([{"start": a, "end": a + n, "entity_group": names[w][1], "score": 0.8} for a, n, w in hits])
        return out

    return predict


def teacher_rows(spark, sf_dir) -> DataFrame:
    """Training rows: fitting lines of documents and sentences of customers, labelled by a teacher, verified, split and written;
    read back as (part, rows, labelled), the rows and labelled entities of each part."""
    lines_ = readers.corpus_lines(documents(spark, sf_dir).select(F.explode(F.split("text", "\n", -1)).alias("value")))
    rows = lines_.union(gold_documents(spark, sf_dir).select("text").where(readers.fits_corpus(F.col("text"))))
    out = scratch.new_path(spark, "teacher")
    teacher.write_labelled(rows, classify.model_classifier(place_model), f"{out}/train", f"{out}/dev", options=WHOLE)
    parts = [readers.read_jsonl(spark, f"{out}/{part}").withColumn("part", F.lit(part)) for part in ("train", "dev")]
    return teacher.labelled(parts[0].union(parts[1]), "part")


def streamed_entities(spark, sf_dir) -> DataFrame:
    """The entities of all documents, found by a stream that reads the table's files once."""
    docs = stream.read_documents(spark, f"{sf_dir}/documents.parque[t]")  # a pattern may also match a single file
    out, state = (scratch.new_path(spark, x) for x in ("stream-out", "stream-state"))
    entities = stream.entity_stream(docs, WHOLE, structured_classifier).select("doc_id", "label", "start", "end", "text")
    query = stream.write_entities(entities, out, state)
    query.awaitTermination()
    return spark.read.schema(entities.schema).parquet(out)


QUERIES = {
    "pii_scan": pii_scan, "pii_scan_pages": pii_scan_pages, "pii_label_counts": pii_label_counts, "pii_by_source": pii_by_source, "doc_risk": doc_risk,
    "redact_label": _redacted("label"), "redact_mask": _redacted("mask"), "redact_partial": _redacted("partial"), "redact_remove": _redacted("remove"),
    "redact_pseudonym": _redacted("pseudonym"), "redact_min_sensitivity": _redacted("label", 5), "redact_mapping": redact_mapping,
    "clip_flags": clip_flags, "chunk_windows": chunk_windows, "batch_totals": batch_totals, "analyze_documents": analyze_documents,
    "analyze_conversations": analyze_conversations, "analyze_distinct_texts": analyze_distinct_texts, "analyze_browser": analyze_browser,
    "analyze_gold": analyze_gold, "gold_scores": gold_scores, "variant_scores": variant_scores, "gold_sentences": gold_sentences, "markers": markers, "merge_islands": merge_islands, "text_islands": text_islands,
    "resolve_overlaps": resolve_overlaps, "unmatched_spans": unmatched_spans, "repaired_spans": repaired_spans, "contained_spans": contained_spans,
    "deduped_spans": deduped_spans, "label_join": label_join, "export_rows": export_rows, "export_jsonl": _exported("jsonl"), "export_csv": _exported("csv"),
    "export_csv_browser": _exported("csv", "browser"), "export_json": export_json, "span_scores": span_scores, "span_fidelity": span_fidelity,
    "bio_decode": bio_decode, "bio_decode_arrays": bio_decode_arrays, "bio_encode": bio_encode, "highlight_segments": highlight_segments,
    "distinct_texts": distinct_texts, "upload_lines": upload_lines, "pasted_lines": pasted_lines, "pasted_csv": pasted_csv, "corpus_lines": corpus_lines, "file_lines": file_lines, "corpus_head": corpus_head,
    "vocabulary_trim": vocabulary_trim, "vocabulary_latin": vocabulary_latin, "translated_ids": translated_ids, "added_tokens": added_tokens, "divergence_sample": divergence_sample, "unigram_pieces": unigram_pieces,
    "pruned_tokenizer": pruned_tokenizer, "unigram_divergence": unigram_divergence, "alias_chains": alias_chains,
    "reached_names": reached_names, "dev_split": dev_split, "wordpiece_ids": wordpiece_ids, "streamed_entities": streamed_entities,
    "analyze_tokens": analyze_tokens, "token_scores": token_scores, "dictionary_spans": dictionary_spans, "teacher_rows": teacher_rows,
}
