"""BIO codes, span keys, precision and recall, agreement, and segments for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import empty, row
from ..functions.labels import BIO

KEY = ["doc_id", "start", "end", "label"]


def span_keys(analysed: DataFrame) -> DataFrame:
    """The distinct (doc_id, start, end, label) of analysed documents."""
    return analysed.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.start", "e.end", "e.label").distinct()


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def span_counts(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, hit, extra, miss) of documents with any span on either side."""
    sides = pred.select(*KEY, F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select(*KEY, F.lit(0).alias("p"), F.lit(1).alias("g")))
    merged = sides.groupBy(*KEY).agg(F.max("p").alias("p"), F.max("g").alias("g"))
    return merged.groupBy("doc_id").agg(
        F.sum(F.col("p") * F.col("g")).alias("hit"), F.sum(F.col("p") * (1 - F.col("g"))).alias("extra"), F.sum((1 - F.col("p")) * F.col("g")).alias("miss")
    )


def scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: hit, extra, miss, precision, recall, f1 over all spans; a ratio with nothing below the line is 0."""
    return rated(span_counts(pred, gold))


def row_scores(docs: DataFrame, pred: Column, gold: Column) -> DataFrame:
    """The same where both sides of a document stand in its row, and each document has one row: nothing is shuffled."""
    keys = lambda all_: F.array_distinct(F.transform(F.coalesce(all_, F.array()), lambda e: row(start=e["start"], end=e["end"], label=e["label"])))
    sides = docs.select(keys(pred).alias("p"), keys(gold).alias("g"))
    sides = sides.select(F.size("p").alias("p"), F.size("g").alias("g"), F.size(F.array_intersect("p", "g")).cast("long").alias("hit"))
    return rated(sides.select("hit", (F.col("p") - F.col("hit")).alias("extra"), (F.col("g") - F.col("hit")).alias("miss")))


def rated(counts: DataFrame) -> DataFrame:
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hit", "extra", "miss")])
    total = total.withColumns({"precision": ratio(F.col("hit"), F.col("hit") + F.col("extra")), "recall": ratio(F.col("hit"), F.col("hit") + F.col("miss"))})
    return total.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def fidelity(docs: DataFrame, pred: DataFrame, base: DataFrame) -> DataFrame:
    """One row: span_agreement (the F1 against a baseline) and exact_documents, the share of docs whose span sets agree."""
    per_doc = docs.select("doc_id").join(span_counts(pred, base), "doc_id", "left")
    exact = F.coalesce(F.avg((F.coalesce(F.col("extra"), F.lit(0)) + F.coalesce(F.col("miss"), F.lit(0)) == 0).cast("double")), F.lit(0.0))
    return scores(pred, base).crossJoin(per_doc.agg(exact.alias("exact_documents"))).select(F.col("f1").alias("span_agreement"), "exact_documents")


def divergence(pairs: DataFrame) -> DataFrame:
    """One row: the share of (old, new) pairs that differ."""
    return pairs.agg(F.coalesce(F.avg((~F.col("old").eqNullSafe(F.col("new"))).cast("double")), F.lit(0.0)).alias("divergence"))


def bio_encode(tokens: Column, spans: Column) -> Column:
    """array<int>: for each token struct<start, end> the id of its BIO name; -100 for empty (special) tokens.

    A token belongs to the first span by start that holds it whole; a label without a name leaves O."""
    ordered = F.array_sort(F.transform(spans, lambda s, i: row(start=s["start"], i=i, end=s["end"], label=s["label"])))
    names = F.create_map(*[x for i, name in enumerate(BIO) for x in (F.lit(name), F.lit(i))])

    def code(t: Column) -> Column:
        own = F.get(F.filter(ordered, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"])), F.lit(0))
        name = F.concat(F.when(t["start"] == own["start"], "B-").otherwise("I-"), own["label"])
        return F.when(t["start"] == t["end"], F.lit(-100)).otherwise(F.coalesce(F.try_element_at(names, name), F.lit(0)))

    return F.transform(tokens, code)


def bio_decode(tokens: Column, codes: Column, scores_: Column | None = None, bio: list[str] = BIO) -> Column:
    """array<struct<start, end, label, score>> from tokens and places in the list of BIO names. A span opens at B, after O and where the label
    changes; its score is its tokens' least."""
    kind = "struct<start:int,end:int,label:string,score:double>"
    names = F.array(*[F.lit(x) for x in bio])
    given = scores_ if scores_ is not None else F.transform(tokens, lambda t: F.lit(1.0))
    items = F.zip_with(F.zip_with(tokens, codes, lambda t, c: row(t=t, c=c)), given, lambda x, s: row(start=x["t"]["start"], end=x["t"]["end"], name=F.get(names, x["c"]), score=s))
    items = F.filter(items, lambda x: (x["start"] != x["end"]) & x["name"].isNotNull())

    def add(a: Column, x: Column) -> Column:
        label = F.substring(x["name"], 3, 1 << 20)
        last = F.element_at(a["out"], -1)
        grows = a["open"] & (F.substring(x["name"], 1, 1) == "I") & (last["label"] == label)
        longer = row(start=last["start"], end=x["end"], label=last["label"], score=F.least(last["score"], x["score"]))
        fresh = row(start=x["start"], end=x["end"], label=label, score=x["score"])
        out = F.when(a["open"], F.when(grows, F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(longer)))).otherwise(F.lit(None))
        return F.when(x["name"] == "O", row(open=F.lit(False), out=a["out"])).otherwise(row(open=F.lit(True), out=F.coalesce(out, F.concat(a["out"], F.array(fresh)))))

    return F.aggregate(items, row(open=F.lit(False), out=empty(kind)), lambda a, x: F.when(
        F.size(a["out"]) == 0, F.when(x["name"] == "O", a).otherwise(row(open=F.lit(True), out=F.array(
            row(start=x["start"], end=x["end"], label=F.substring(x["name"], 3, 1 << 20), score=x["score"]))))
    ).otherwise(add(a, x)), lambda a: a["out"])


def decode_rows(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, score) from rows (doc_id, pos, start, end, name, score): BIO decoding as windows."""
    tokens = tokens.where(F.col("start") != F.col("end"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    label = F.when(F.col("name") != "O", F.substring("name", 3, 1 << 20))
    tokens = tokens.withColumns({"label": label, "_last": F.lag(label).over(order)})
    opens = (F.substring("name", 1, 1) == "B") | F.col("_last").isNull() | (F.col("_last") != F.col("label"))
    tokens = tokens.withColumn("_new", F.when(F.col("label").isNotNull() & opens, 1).otherwise(0))
    tokens = tokens.withColumn("_span", F.sum("_new").over(order)).where(F.col("label").isNotNull())
    return tokens.groupBy("doc_id", "_span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"), F.min("score").alias("score")
    ).drop("_span")


def argmax(logits: Column) -> Column:
    """struct<best, score>: the first largest class and its softmax probability."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x))
    return row(best=(F.array_position(logits, top) - 1).cast("int"), score=F.exp(top) / F.when(total == 0, F.lit(1.0)).otherwise(total))


def segments(text: Column, entities: Column) -> Column:
    """array<struct<text, label>>: the text cut at its entities; label is null between them. Where entities overlap, a
    later one starts again at its own place."""
    kind = "struct<text:string,label:string>"

    def add(a: Column, e: Column) -> Column:
        gap = row(text=text.substr(a["at"] + 1, e["start"] - a["at"]), label=F.lit(None).cast("string"))
        before = F.when(e["start"] > a["at"], F.concat(a["out"], F.array(gap))).otherwise(a["out"])
        own = row(text=text.substr(e["start"] + 1, e["end"] - e["start"]), label=e["label"])
        return row(at=e["end"], out=F.concat(before, F.array(own)))

    def finish(a: Column) -> Column:
        tail = row(text=text.substr(a["at"] + 1, F.length(text)), label=F.lit(None).cast("string"))
        return F.when(a["at"] < F.length(text), F.concat(a["out"], F.array(tail))).otherwise(a["out"])

    ordered = F.array_sort(F.transform(entities, lambda e, i: row(start=e["start"], i=i, end=e["end"], label=e["label"])))
    return F.aggregate(ordered, row(at=F.lit(0), out=empty(kind)), add, finish)


def active_only(entities: Column, labels: list[str]) -> Column:
    """Entities of the active labels; no labels mean all."""
    return F.filter(entities, lambda e: e["label"].isin(labels)) if labels else entities


def sorted_entities(rows: DataFrame, by: str = "start", descending: bool = False) -> DataFrame:
    """Entity rows by start, label, text or score; strings in the order of a dictionary."""
    if by not in ("start", "label", "text", "score"):
        raise ValueError(f"can't sort by {by}")
    key = F.collate(F.col(by), "UNICODE") if by in ("label", "text") else F.col(by)
    return rows.orderBy(key.desc() if descending else key.asc())
