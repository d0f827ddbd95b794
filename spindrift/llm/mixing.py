"""Operator 4, mixing sources to target weights, with DataFrame functions only.

Each source's words are packed into blocks of `block_tokens` (the last may be shorter). The output is shards of
`shard_blocks` slots each (the last may have fewer). Every shard draws its counts by source from the multinomial
distribution whose weights are the sources' wanted slots: each of its slots draws one of all wanted slots by a hash, and
the draws are counted. So that targets hold exactly, the draws of a source beyond its wanted slots, which stand in the
last shards that drew it, are given to sources that drew too few. Draw j of a source reads block perm(j mod blocks), where
perm is a swap-or-not shuffle of the source's block numbers, and blocks are joined by number. Draws beyond the number of
blocks start another pass, so no block is read more often than ceil(target / size) times.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a null doc_id is a document
of its source like any other; each row is packed by itself, equal rows as often as they stand there, and rows that share
doc_id and source are one document whose sizes add up; sources of size 0 get the target 0; an empty table gives an empty result; long texts are taken
whole, one row at a time; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, stored, table

#: Shards whose counts one window sums up.
RANGE = 1 << 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(source, docs, source_size, rank, target) from (source, size): `share` of all sizes is split by the weights, which
    go round by code point; no target exceeds `cap` times its source, and what is cut off goes to the others by weight.

    Water filling in closed form: in order of cap / weight a source is full if its cap is at most its weight's part
    of what the sources before leave. The windows run over sources, not over rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    src = src.withColumn("rank", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1).cast("int") % len(weights) + 1)
    src = src.withColumns({"weight": weight, "limit": F.col("source_size") * F.lit(float(cap))})
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    src = src.withColumn("level", left / F.sum("weight").over(rest))
    src = src.withColumn("full", F.col("limit") <= F.col("weight") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    src = src.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * level))
    return src.select("source", "docs", "source_size", "rank", F.coalesce("target", F.lit(0.0)).alias("target"))


def shuffled_index(x: Column, n: Column, key: Column, seed: int, rounds: int = 20) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by key and seed, puts x (swap-or-not: any n, no table)."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, r), n) - at, n)
        high = F.greatest(at, partner)
        return F.when(F.pmod(F.xxhash64(F.lit(seed + 1), key, r, high), F.lit(2)) == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, step)


def running(rows: DataFrame, value: str, key: str, order: str, out: str) -> DataFrame:
    """`rows` with out, the sum of `value` over the rows of the same key before in `order`; no window holds a whole key.

    Order numbers are dealt into ranges of RANGE; windows run over the ranges' sums and within a range."""
    rows = rows.withColumn("_range", F.expr(f"{order} div {RANGE}"))
    sums = rows.groupBy(key, "_range").agg(F.sum(value).alias("_n"))
    ranges = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "_range", F.coalesce(F.sum("_n").over(ranges), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(starts, [key, "_range"]).withColumn(out, F.col("_start") + F.col("_before")).drop("_range", "_start", "_before")


def drawn_counts(src: DataFrame, total: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, rank, n): how many slots each shard draws from each source (rank, wanted, low), wanted slots low to low + wanted - 1.

    A draw finds its source by an equality join on a cell of CELL-th parts of all slots, and its place in the cell."""
    spark, cells = src.sparkSession, 4 * max(1, src.count())
    cell = lambda x: f"CAST(({x}) * {cells}D / {total} AS bigint)"
    known = src.select("rank", "low", (F.col("low") + F.col("wanted")).alias("high"))
    known = known.withColumn("cell", F.explode(F.expr(f"sequence({cell('low')}, {cell('high - 1')})")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    draws = spark.range(0, total, 1, parts).select(
        F.expr(f"id div {shard_blocks}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(total)).alias("draw")
    )
    met = draws.withColumn("cell", F.expr(cell("draw"))).join(known, "cell").where("low <= draw AND draw < high")
    return met.groupBy("shard", "rank").agg(F.count("*").alias("n"))


def draw_slots(sources: DataFrame, block_tokens: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, slot, rank, pass, block): every block read of the mix."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / block_tokens).cast("long")
    src = sources.where(F.col("source_size") > 0).withColumn("blocks", blocks)
    src = src.withColumn("wanted", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).where("wanted > 0")
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # over sources, not over rows
    src = stored(src.select("rank", "blocks", "wanted", F.coalesce(F.sum("wanted").over(by_rank), F.lit(0)).alias("low")), "mix-wanted")
    total = src.agg(F.coalesce(F.sum("wanted"), F.lit(0))).first()[0]
    if not total:
        empty = "shard long, slot long, rank long, pass long, block long"
        return spark.createDataFrame([], empty)
    counts = stored(drawn_counts(src, total, shard_blocks, seed), "mix-counts")
    counts = stored(running(counts, "n", "rank", "shard", "first").join(src.select("rank", "wanted"), "rank"), "mix-counts")

    # What was drawn too often and too seldom, unit by unit in the order of the sources: the k-th of the one becomes the k-th of the other.
    drawn = src.join(counts.groupBy("rank").agg(F.sum("n").alias("drawn")), "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    drawn = stored(drawn, "mix-drawn")

    def units(first: str, stop: str, names: tuple[str, str]) -> DataFrame:
        over = drawn.where(f"{first} < {stop}").withColumn("_n", F.expr(f"{stop} - {first}"))
        over = over.withColumn("_low", F.coalesce(F.sum("_n").over(by_rank), F.lit(0)))
        return over.select(F.col("rank").alias(names[0]), F.posexplode(F.expr(f"sequence({first}, {stop} - 1)")).alias("_k", names[1]), "_low").select(
            *names, (F.col("_low") + F.col("_k")).alias("unit")
        )

    moved = units("wanted", "drawn", ("rank", "draw")).join(units("drawn", "wanted", ("to_rank", "to_draw")), "unit").drop("unit")
    inside = counts.where("first < wanted").select("shard", "rank", "first", F.expr("least(first + n, wanted) - 1").alias("last"))
    beyond = counts.where("first + n > wanted").select("shard", "rank", F.explode(F.expr("sequence(greatest(first, wanted), first + n - 1)")).alias("draw"))
    settled = beyond.join(moved, ["rank", "draw"]).select("shard", F.col("to_rank").alias("rank"), F.col("to_draw").alias("first"), F.col("to_draw").alias("last"))
    slots = inside.unionByName(settled).select("shard", "rank", F.explode(F.sequence("first", "last")).alias("draw")).join(src.select("rank", "blocks"), "rank")
    slots = slots.select(
        "shard",
        F.col("draw").alias("slot"),
        "rank",
        F.expr("draw div blocks").alias("pass"),
        shuffled_index(F.pmod("draw", "blocks"), F.col("blocks"), F.col("rank"), seed).alias("block"),
    )
    return stored(slots, "mix-slots")


#: A row's identity: 128 bits of doc_id, source and text, and which of equal rows it is.
ROW = ("h", "g", "copy")


def row_keys(docs: DataFrame) -> DataFrame:
    said = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source"))))
    return docs.select("doc_id", "source", "text", F.xxhash64(said, "text").alias("h"), F.xxhash64(F.lit("row"), "text", said).alias("g"))


def row_sizes(docs: DataFrame) -> DataFrame:
    """(h, g, doc_id, source, size, copies) of the distinct rows of docs, stored."""
    units = row_keys(docs).groupBy("h", "g", "doc_id", "source").agg(F.max(size_of(F.col("text"))).alias("size"), F.count("*").alias("copies"))
    return stored(units, "mix-rows")


def block_spans(docs: DataFrame, sources: DataFrame, block_tokens: int) -> DataFrame:
    """(h, g, copy, doc_id, source, size, rank, block, from_word, n_words): which words of which row fill each block.

    Offsets are prefix sums in two levels, over some sqrt(rows) hash buckets and within a bucket, so that no
    window holds a whole source. A row without words has a null block.
    """
    rows = sources.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    buckets = max(1, round(rows**0.5))
    base = docs.join(
        sources.select(F.col("source").alias("_source"), "rank"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    base = base.withColumn("bucket", F.pmod(F.xxhash64(*ROW), F.lit(buckets)))
    sums = base.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rank", "bucket").orderBy(*ROW).rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["rank", "bucket"])
    base = stored(base.select(*ROW, "doc_id", "source", "size", "rank", (F.col("start") + F.col("before")).alias("at")), "mix-offsets")
    end = F.col("at") + F.col("size")
    of = F.sequence(F.expr(f"at div {block_tokens}"), F.expr(f"(at + size - 1) div {block_tokens}"))
    spans = base.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, of)))
    begin = F.greatest(F.col("block") * block_tokens, F.col("at"))
    stop = F.least((F.col("block") + 1) * block_tokens, end)
    return spans.select(
        *ROW, "doc_id", "source", "size", "rank", "block", (begin - F.col("at")).alias("from_word"), (stop - begin).alias("n_words"),
        F.col("block").isNull().alias("bare"), begin.alias("position"),
    )


def mix_sources(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, spans, slots): targets by source, the rows' words by block, and the reads that make up the mix."""
    return mix_rows(row_sizes(docs), **options)


def mix_rows(
    units: DataFrame, weights=(1, 2, 3), share=1.0, cap=3.0, block_tokens=128, shard_blocks=4096, seed=20
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of what row_sizes gives."""
    rows = units.select("h", "g", "doc_id", "source", "size", F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    sources = stored(source_targets(rows, weights, share, cap), "mix-sources")
    return sources, block_spans(rows, sources, block_tokens), draw_slots(sources, block_tokens, shard_blocks, seed)


def mixed_blocks(docs: DataFrame, block_tokens: int = 128, **options) -> DataFrame:
    """The mix itself: (shard, slot, source, pass, block, n_words, doc_ids, text), one row a slot; words are joined by a space.

    Each row of docs is packed by itself, so rows that share a doc_id or have none are never gathered. A text moves once, to
    what is read of it; a block within one text is then whole, and only the others' parts, at the ends of texts, meet."""
    units = row_sizes(docs)
    sources, spans, slots = mix_rows(units, block_tokens=block_tokens, **options)

    # A block is read once a pass, so its list of reads is as short as a source may be repeated.
    reads = slots.groupBy("rank", "block").agg(F.collect_list(F.struct("shard", "slot", "pass")).alias("reads"))
    spans = spans.where(~F.col("bare")).join(sources.select("rank", "source_size"), "rank")
    full = F.least(F.lit(block_tokens), F.col("source_size") - F.col("block") * block_tokens)
    parts = spans.join(reads.hint("merge"), ["rank", "block"]).withColumn("alone", F.col("n_words") == full)
    parts = stored(parts.select(*ROW, "doc_id", "source", "rank", "block", "position", "from_word", "n_words", "alone", "reads"), "mix-parts")
    texts = row_keys(docs).select("h", "g", F.col("text").alias("_text"))
    if not units.where("copies > 1").isEmpty():
        texts = texts.groupBy("h", "g").agg(F.first("_text").alias("_text"))

    def pieces(some: DataFrame) -> DataFrame:
        fields = ("rank", "block", "position", "from_word", "n_words", "reads")
        each = some.groupBy(*ROW, "doc_id", "source").agg(F.collect_list(F.struct(*fields)).alias("parts")).join(texts.hint("merge"), ["h", "g"])
        words = lambda w, p: F.array_join(F.slice(w, (p["from_word"] + 1).cast("int"), p["n_words"].cast("int")), " ")
        cut = let(F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)), lambda w: F.transform(
            "parts", lambda p: F.struct(*[p[f].alias(f) for f in fields if f != "from_word"], words(w, p).alias("text"))))
        return each.select("doc_id", "source", F.inline(cut))

    whole = pieces(parts.where("alone")).select("source", "block", "n_words", F.array("doc_id").alias("doc_ids"), "text", "reads")
    ends = pieces(parts.where("NOT alone")).groupBy("rank", "block").agg(
        F.array_sort(F.collect_list(F.struct("position", "doc_id", "n_words", "text"))).alias("p"), F.first("source").alias("source"), F.first("reads").alias("reads")
    )
    met = ends.select(
        "source", "block", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n_words"]).alias("n_words"), F.col("p.doc_id").alias("doc_ids"),
        F.array_join("p.text", " ").alias("text"), "reads",
    )
    out = whole.unionByName(met).select("source", "block", "n_words", "doc_ids", "text", F.inline("reads"))
    return out.select("shard", "slot", "source", "pass", "block", "n_words", "doc_ids", "text")


def op4_mixing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sources, spans, slots = mix_sources(docs)
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times"))
    # Spark guesses the size of times from that of the few source rows it unfolds from, and would broadcast it.
    taken = spans.join(times.hint("merge"), ["rank", "block"], "left").groupBy("doc_id", "rank").agg(
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.col("n_words") * F.col("times")), F.lit(0)).alias("taken")
    )
    return taken.join(sources.select("rank", "source_size", "target"), "rank").select(
        "doc_id", "size", "source_size", "target", "taken"
    )
