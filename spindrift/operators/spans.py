"""Span algebra. Row-local functions work on arrays within a document; *_rows functions on one row a span, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ENTITY, any_of, empty, let, overlaps, row
from ..functions.labels import STRUCTURED, strip_bio
from ..functions.patterns import NEEDED, PATTERNS, SPACE, TRIM, all_space, find_all, unicode_pattern

RULE_SCORE = 0.99
ISLAND = "struct<start:int,end:int,label:string,score:double,pos:int>"
#: The same for collections, whose numbers go beyond an int.
ISLAND_ROW = "struct<start:int,end:int,label:string,score:double,pos:bigint>"


def normalise(text: Column, spans: Column) -> Column:
    """Clamp to the text, cut the trim set off both ends, drop what is empty, split BIO prefixes off."""

    def one(s: Column, n: Column) -> Column:
        a, b = F.greatest(s["start"], F.lit(0)), F.least(s["end"], n)

        def cut(piece: Column) -> Column:
            return let(F.ltrim(piece, F.lit(TRIM)), lambda left: bounds(a + F.length(piece) - F.length(left), F.length(F.rtrim(left, F.lit(TRIM)))))

        def bounds(start: Column, n: Column) -> Column:
            return row(
                start=start.cast("int"), end=(start + n).cast("int"), label=strip_bio(s["label"]), score=s["score"], seq=s["seq"],
                continued=F.startswith(s["label"], F.lit("I-")),
            )

        return let(text.substr(a + 1, F.greatest(b - a, F.lit(0))), cut)

    return let(F.length(text), lambda n: F.filter(F.transform(spans, lambda s: one(s, n)), lambda s: s["end"] > s["start"]))


def by_start(spans: Column) -> Column:
    """By start, higher scores first, then as they came."""
    keyed = F.array_sort(F.transform(spans, lambda s: row(start=s["start"], less=-s["score"], seq=s["seq"], s=s)))
    return F.transform(keyed, lambda k: k["s"])


def merge_islands(text: Column, spans: Column, max_gap: int = 1) -> Column:
    """Unite spans with the last island of their label if they touch it, or if only white space lies between, of at
    most `max_gap` characters unless the span is a continuation. Score and end become the largest."""

    # Only the last island of a label is open; what it is closed by, it leaves for `done`.
    def add(state: Column, s: Column) -> Column:
        def put(before: Column) -> Column:
            gap = s["start"] - before["end"]
            between = text.substr(before["end"] + 1, gap)
            close = (gap <= 0) | ((s["continued"] | (gap <= max_gap)) & all_space(between))
            joined = row(start=before["start"], end=F.greatest(before["end"], s["end"]), label=before["label"], score=F.greatest(before["score"], s["score"]), pos=before["pos"])
            fresh = row(start=s["start"], end=s["end"], label=s["label"], score=s["score"], pos=state["n"])
            others = F.filter(state["open"], lambda x: x["label"] != s["label"])
            grown = row(open=F.concat(others, F.array(joined)), done=state["done"], n=state["n"])
            closed = F.when(before.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(before)))
            return F.when(before.isNotNull() & close, grown).otherwise(row(open=F.concat(others, F.array(fresh)), done=closed, n=state["n"] + 1))

        return let(F.get(F.filter(state["open"], lambda x: x["label"] == s["label"]), F.lit(0)), put)

    def finish(state: Column) -> Column:
        keyed = F.array_sort(F.transform(F.concat(state["done"], state["open"]), lambda x: row(pos=x["pos"], x=x)))
        return F.transform(keyed, lambda k: k["x"])

    return F.aggregate(by_start(spans), row(open=empty(ISLAND), done=empty(ISLAND), n=F.lit(0)), add, finish)


def resolve(islands: Column, kind: str = ISLAND) -> Column:
    """Greedy by score: the better span stays, what overlaps it goes; then by start. Spans that overlap no one, directly
    or by others, are no one's concern: the greedy choice is made within each cluster of spans that do."""

    def best(cluster: Column) -> Column:
        keyed = F.array_sort(F.transform(cluster, lambda x: row(less=-x["score"], start=x["start"], pos=x["pos"], x=x)))
        return F.aggregate(
            F.transform(keyed, lambda k: k["x"]), empty(kind),
            lambda done, x: F.when(any_of(done, lambda o: overlaps(x, o)), done).otherwise(F.concat(done, F.array(x))),
        )

    def settled(state: Column) -> Column:
        return F.concat(state["done"], F.when(F.size(state["cluster"]) < 2, state["cluster"]).otherwise(best(state["cluster"])))

    def add(state: Column, x: Column) -> Column:
        inside = row(done=state["done"], cluster=F.concat(state["cluster"], F.array(x)), reach=F.greatest(state["reach"], x["end"]))
        return F.when(x["start"] < state["reach"], inside).otherwise(row(done=settled(state), cluster=F.array(x), reach=x["end"]))

    return F.array_sort(F.aggregate(F.array_sort(islands), row(done=empty(kind), cluster=empty(kind), reach=F.lit(-(1 << 31)).cast("int")), add, settled))


def hydrate(text: Column, spans: Column) -> Column:
    """Entities with their surface text."""
    return F.transform(spans, lambda s: row(
        start=s["start"], end=s["end"], label=s["label"], text=text.substr(s["start"] + 1, s["end"] - s["start"]), score=s["score"], verified=F.lit(False)
    ))


def structured_matches(text: Column, profile: str = "server") -> Column:
    """Entities of all structured patterns, pattern after pattern."""
    def of(label: str, pattern: str) -> Column:
        return F.transform(find_all(text, unicode_pattern(pattern, profile=profile), needed=NEEDED[label]), lambda m: row(
            start=m["start"], end=m["end"], label=F.lit(label), text=m["text"], score=F.lit(RULE_SCORE), verified=F.lit(True)))

    return F.concat(*[of(label, pattern) for label, pattern in PATTERNS.items()])


def dedupe_best(entities: Column) -> Column:
    """One entity for each (start, end, label), of the highest score, at the place of the first."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["label"] == b["label"])

    def add(done: Column, x: Column) -> Column:
        better = F.transform(done, lambda o: F.when(same(o, x) & (x["score"] > o["score"]), x).otherwise(o))
        return F.when(any_of(done, lambda o: same(o, x)), better).otherwise(F.concat(done, F.array(x)))

    def one(all_: Column) -> Column:
        places = F.transform(all_, lambda x: F.shiftleft(x["start"].cast("long"), 32) + x["end"])
        return F.when(F.size(F.array_distinct(places)) == F.size(all_), all_).otherwise(F.aggregate(all_, empty(ENTITY), add))

    return let(entities, one)


def by_place(entities: Column) -> Column:
    """By start, longer ones first, then as they came."""
    keyed = F.array_sort(F.transform(entities, lambda x, i: row(start=x["start"], less=x["start"] - x["end"], i=i, x=x)))
    return F.transform(keyed, lambda k: k["x"])


def drop_contained(entities: Column) -> Column:
    """Without entities that lie within an earlier one of their label; sorted by place, that is one that reaches as far."""
    reach = "struct<label:string,end:int>"

    def add(state: Column, x: Column) -> Column:
        def put(end: Column) -> Column:
            others = F.filter(state["reach"], lambda r: r["label"] != x["label"])
            kept = row(out=F.concat(state["out"], F.array(x)), reach=F.concat(others, F.array(row(label=x["label"], end=x["end"]))))
            return F.when(x["end"] <= end, state).otherwise(kept)

        return let(F.get(F.filter(state["reach"], lambda r: r["label"] == x["label"]), F.lit(0))["end"], put)

    return F.aggregate(entities, row(out=empty(ENTITY), reach=empty(reach)), add, lambda s: s["out"])


def repair(entities: Column, matches: Column) -> Column:
    """Structured entities take over the first match of their label that they overlap."""

    def one(x: Column) -> Column:
        own = F.get(F.filter(matches, lambda m: (m["label"] == x["label"]) & overlaps(x, m)), F.lit(0))
        fixed = row(start=own["start"], end=own["end"], label=x["label"], text=own["text"], score=F.greatest(x["score"], F.lit(RULE_SCORE)), verified=F.lit(True))
        return F.when(x["label"].isin(STRUCTURED) & own.isNotNull(), fixed).otherwise(x)

    return F.transform(entities, one)


def missing(entities: Column, matches: Column) -> Column:
    """The entities and those matches that overlap none."""
    return F.concat(entities, F.filter(matches, lambda m: ~any_of(entities, lambda x: overlaps(m, x))))


def verify(text: Column, entities: Column, recover: bool = True, profile: str = "server") -> Column:
    """Pattern matches own their text: entities that overlap one go, the matches come in. Without `recover` the
    entities are only repaired."""

    def with_matches(matches: Column) -> Column:
        if recover:
            found = F.concat(matches, F.filter(entities, lambda x: ~any_of(matches, lambda m: overlaps(x, m))))
        else:
            found = repair(entities, matches)
        found = dedupe_best(found)
        if profile == "browser":
            keyed = F.array_sort(F.transform(found, lambda x, i: row(start=x["start"], i=i, x=x)))
            return F.transform(keyed, lambda k: k["x"])
        return drop_contained(by_place(found))

    return let(structured_matches(text, profile), with_matches)


# One row a span: (doc_id, start, end, label, score, seq), for collections whose spans don't fit a row.


#: Characters of a bin: what windows hold at once is one bin of a document, beside one row for each of its bins.
BIN = 4096


def _bins(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn("_bin", F.floor(F.col(at) / BIN))


def before(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """`rows` with out, the largest value of the rows of the same keys before each in `order`, of which the first column is a
    place. Windows run over the bins' maxima and within bins, so no task sorts a whole document."""
    rows = _bins(rows, order[0])
    tops = rows.groupBy(*keys, "_bin").agg(F.max(value).alias("_top"))
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bin").alias("_of"), F.max("_top").over(over).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("_inside", F.max(value).over(inside)).join(
        tops, (F.col("_bin") == F.col("_of")) & F.expr(" AND ".join(f"{k} <=> _{k}" for k in keys)), "left"
    )
    return met.withColumn(out, F.greatest("_earlier", "_inside")).drop("_bin", "_of", "_earlier", "_inside", "_top", *[f"_{k}" for k in keys])


def after(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """`rows` with out, the first value that isn't null of the rows of the same keys behind each in `order`; by bins as `before`."""
    rows = _bins(rows, order[0])
    firsts = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_bin").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    bins = rows.select(*keys, "_bin").distinct().join(firsts, [*keys, "_bin"], "left")
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    bins = bins.select(*keys, "_bin", F.first("_first", ignorenulls=True).over(over).alias("_later"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    met = rows.withColumn("_inside", F.first(value, ignorenulls=True).over(inside)).join(bins, [*keys, "_bin"], "left")
    return met.withColumn(out, F.coalesce("_inside", "_later")).drop("_bin", "_inside", "_later")


def filled_before(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """`spans` with _at_start and _at_end: how many characters of their document's text that are no white space lie before
    both. Texts (doc_id, text) are cut into bins, each row meets the two that it begins and ends in."""
    n = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / BIN)
    cells = texts.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.substring(F.col("text"), (i * BIN + 1).cast("int"), F.lit(BIN)))).alias("_cell", "_piece"))
    filled = lambda c: F.length(F.regexp_replace(c, rf"(?U){SPACE}", ""))
    over = Window.partitionBy("doc_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_filled", filled(F.col("_piece")).cast("long"))
    sums = cells.select("doc_id", "_cell", F.coalesce(F.sum("_filled").over(over), F.lit(0)).alias("_sum"))  # no text in the window
    cells = cells.drop("_filled").join(sums, ["doc_id", "_cell"])
    for place, name in (("start", "_at_start"), ("end", "_at_end")):
        spans = spans.withColumn("_cell", F.floor(F.greatest(F.col(place) - 1, F.lit(0)) / BIN).cast("int")).join(cells, ["doc_id", "_cell"], "left")
        inner = F.substring(F.col("_piece"), F.lit(1), (F.col(place) - F.col("_cell") * BIN).cast("int"))
        spans = spans.withColumn(name, F.coalesce(F.col("_sum") + filled(inner), F.lit(0))).drop("_cell", "_piece", "_sum")
    return spans


def merge_island_rows(spans: DataFrame, max_gap: int = 1, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, label, start, end, score, pos): gaps and islands. With texts (doc_id, text) a gap must be white space and may be
    longer before a span that is `continued` (a column of spans, if it has that); without, any gap of up to max_gap will do.
    Spans that come with _at_start and _at_end, as `span_arrays.filled` counts them beside the text, need no texts for that."""
    order = Window.partitionBy("doc_id", "label").orderBy("start", F.desc("score"), "seq")
    known = "_at_start" in spans.columns
    if texts is not None:
        spans, known = filled_before(spans, texts), True
    elif not known:
        spans = spans.withColumns({"_at_start": F.lit(0), "_at_end": F.lit(0)})
    reach = F.max(F.struct("end", "_at_end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start") - F.col("_reach.end")
    near = gap <= max_gap
    if known and "continued" in spans.columns:
        near = near | F.coalesce("continued", F.lit(False))
    joins = (gap <= 0) | (near & (F.col("_at_start") == F.col("_reach._at_end")))
    spans = spans.withColumn("_reach", reach).withColumn("opens", F.when(F.col("_reach").isNull() | ~joins, 1).otherwise(0))
    numbered = spans.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "label", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.min("seq").alias("pos")
    )


def resolve_rows(spans: DataFrame) -> DataFrame:
    """Greedy resolution of (doc_id, start, end, label, score, seq). Spans that overlap, directly or by others, are gathered in
    one row, and no others: a cluster begins where no earlier span of the document reaches."""
    rows = before(spans, ["doc_id"], ["start", "end", "seq"], "end", "_reach")
    rows = rows.withColumn("_begins", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start")))
    rows = before(rows, ["doc_id"], ["start", "end", "seq"], "_begins", "_cluster").withColumn("_cluster", F.coalesce("_begins", "_cluster"))
    items = F.collect_list(row(start=F.col("start"), end=F.col("end"), label=F.col("label"), score=F.col("score"), pos=F.col("seq")))
    return rows.groupBy("doc_id", "_cluster").agg(items.alias("s")).select("doc_id", F.inline(resolve(F.col("s").cast(f"array<{ISLAND_ROW}>"), ISLAND_ROW)))


def unmatched_rows(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """Spans that overlap no match of their document. One does where the farthest end of the matches that begin before the
    span's end lies behind its start; so no pairs are made."""
    names = spans.columns
    m = matches.where("doc_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    m = m.select("doc_id", F.col("start").alias("_place"), F.lit(1).alias("_kind"), F.col("end").alias("_match"))
    own = spans.withColumns({"_place": F.col("end"), "_kind": F.lit(0)})
    met = before(own.unionByName(m, allowMissingColumns=True), ["doc_id"], ["_place", "_kind"], "_match", "_far")
    return met.where((F.col("_kind") == 0) & ~F.coalesce(F.col("_far") > F.col("start"), F.lit(False))).select(*names)


def repair_rows(spans: DataFrame, matches: DataFrame) -> DataFrame:
    """Spans with the bounds of the first match (by start, then end) of their label that they overlap.

    A match that ends no later than one before it is never the first. The others' ends rise with their starts, so a span's
    match is the next one that ends behind the span's start, if it begins before the span's end."""
    keys = ["doc_id", "label"]
    m = matches.where("doc_id IS NOT NULL AND label IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").select(*keys, "start", "end")
    m = before(m, keys, ["start", "end"], "end", "_far").where(F.col("_far").isNull() | (F.col("end") > F.col("_far")))
    m = m.select(*keys, F.col("end").alias("_place"), F.lit(0).alias("_kind"), F.struct(F.col("start").alias("start"), F.col("end").alias("end")).alias("_match"))
    own = spans.select("doc_id", "start", "end", "label", "score", "seq").distinct().withColumns({"_place": F.col("start"), "_kind": F.lit(1)})
    met = after(own.unionByName(m, allowMissingColumns=True), keys, ["_place", "_kind"], "_match", "_next").where("_kind = 1")
    hit = F.coalesce(F.col("_next.start") < F.col("end"), F.lit(False))
    return met.select(
        "doc_id", "seq", F.when(hit, F.col("_next.start")).otherwise(F.col("start")).alias("start"), F.when(hit, F.col("_next.end")).otherwise(F.col("end")).alias("end"), "label",
        F.when(hit, F.greatest("score", F.lit(RULE_SCORE))).otherwise(F.col("score")).alias("score"), hit.alias("verified"),
    )


def dedupe_rows(spans: DataFrame) -> DataFrame:
    """One row for each (doc_id, start, end, label): the highest score, of these the first."""
    best = F.max_by(F.struct("score", "seq"), F.struct("score", -F.col("seq")))
    return spans.groupBy("doc_id", "start", "end", "label").agg(best.alias("b")).select("doc_id", "start", "end", "label", "b.score", "b.seq")


def drop_contained_rows(spans: DataFrame) -> DataFrame:
    """Rows that no earlier row of their document and label contains."""
    order = Window.partitionBy("doc_id", "label").orderBy("start", F.desc("end"), "seq")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("end") > F.col("_before"))).drop("_before")
