"""Corpora and vocabularies: splits, keep sets, renumbering and alias chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import characters
from ..functions.unigram import WORD_BEGIN
from ..plans.scratch import checkpointed


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with place, their number from 0 on in the order of the given columns.

    A place is one within a range of sorted rows and the sizes of the ranges before, so no task sorts all rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("_at", F.monotonically_increasing_id()))  # the range in the upper 31 bits, the place in the others
    ranged = ranged.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over ranges, not rows
    starts = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", before.alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn("place", F.col("_start") + F.col("_place")).drop("_at", "_range", "_place", "_start")


def split_rows(rows: DataFrame, key: str, fraction: float, seed: int = 11) -> DataFrame:
    """`rows` with is_dev: `fraction` of the rows, rounded down but one at least, the same ones each time: those that come
    first by a digest of seed and key. Rows of one key stay together, so repeated keys may take a few more.

    Only keys are numbered; the last digest that counts is found, and rows are told by it where they are."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col(key)).cast("binary"))
    wanted = max(1, int(rows.count() * fraction))
    last = numbered(rows.select(digest.alias("_digest"), key), "_digest", key).where(F.col("place") == wanted - 1).first()
    if last is None:
        return rows.withColumn("is_dev", F.lit(False))
    mine = F.struct(digest.alias("d"), F.col(key).alias("k"))
    return rows.withColumn("is_dev", mine <= F.struct(F.lit(last["_digest"]).alias("d"), F.lit(last[key]).cast(rows.schema[key].dataType).alias("k")))


def unique_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.count_distinct(text).alias("unique_lines"))


def is_latin(piece: Column) -> Column:
    """ASCII and Latin characters only, after the mark, by category and name."""
    return F.ltrim(piece, F.lit(WORD_BEGIN)).rlike(rf"^{characters.latin()}*\z")


def keep_set(vocab: DataFrame, special: list[str], mode: str, used: DataFrame | None = None, floor: int = 3) -> DataFrame:
    """(piece): special tokens, bare marks, digit runs and short Latin pieces; in mode `latin` all Latin pieces, in mode
    `corpus` those that `used` has."""
    if mode not in ("latin", "corpus"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "corpus" and used is None:
        raise ValueError("corpus mode needs a corpus")
    piece = F.col("piece")
    body = F.ltrim(piece, F.lit(WORD_BEGIN))
    safe = (body == "") | body.rlike(rf"^{characters.digit()}+\z") | ((F.length(body) <= floor) & is_latin(piece))
    kept = vocab.where(piece.isin(special) | safe | (is_latin(piece) if mode == "latin" else F.lit(False))).select("piece")
    if mode == "corpus":
        kept = kept.union(vocab.join(used.select("piece").distinct(), "piece", "left_semi").select("piece"))
    return kept.distinct()


def renumber(vocab: DataFrame, keep: DataFrame, unknown: str | None = None) -> DataFrame:
    """(piece, old_id, new_id): kept pieces numbered from 0 in the order of their ids."""
    kept = vocab.join(keep.select("piece"), "piece", "left_semi").select("piece", F.col("id").alias("old_id"))
    if unknown is not None and kept.where(F.col("piece") == unknown).isEmpty():
        raise ValueError("the unknown piece was pruned")
    return numbered(kept, "old_id").select("piece", "old_id", F.col("place").alias("new_id"))


def renumber_added(added: DataFrame, mapping: DataFrame, keep: DataFrame) -> DataFrame:
    """The added tokens (id, content) that are kept, with new_id: that of their piece in mapping, or their own where they
    number a place outside the vocabulary."""
    stay = added.join(keep.select(F.col("piece").alias("content")), "content", "left_semi")
    return stay.join(mapping.select(F.col("old_id").alias("id"), "new_id"), "id", "left").select("content", "id", F.coalesce("new_id", "id").alias("new_id"))


def sampled_lines(files: DataFrame, file: str, text: str, first: int = 500, shorter: int = 20) -> DataFrame:
    """(file, line_no, line): of each file's first lines, stripped, those of more than `shorter` characters. A sample for
    a quick look at a pruned vocabulary; whole corpora go through corpus_lines."""
    lines = files.select(file, F.posexplode(F.slice(F.split(text, "\n", -1), 1, first)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    return lines.where(F.length("line") > shorter)


def translate_ids(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """`ids` (column id) with new_id, -1 where the piece was pruned."""
    m = mapping.select(F.col("old_id").alias("id"), "new_id")
    return ids.join(m, "id", "left").withColumn("new_id", F.coalesce("new_id", F.lit(-1)))


def gather_rows(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows (id, ...) of a table under their new ids."""
    return table.join(mapping.select(F.col("old_id").alias("id"), "new_id"), "id").drop("id").withColumnRenamed("new_id", "id")


def resolve_aliases(aliases: DataFrame, rounds: int = 40) -> DataFrame:
    """(alias, target) with targets followed to the end of their chains, by pointer doubling: the number of joins is the
    logarithm of the longest chain. A cycle has no end and is refused."""
    now = aliases.select("alias", "target")
    for _ in range(rounds):
        onward = now.select(F.col("alias").alias("_a"), F.col("target").alias("_t"))
        ahead = now.join(onward, F.col("target") == F.col("_a"), "left")
        ahead = checkpointed(ahead.select("alias", F.coalesce("_t", "target").alias("target"), F.col("_t").isNotNull().alias("_moved")))
        if ahead.where("_moved").isEmpty():
            return ahead.select("alias", "target")
        now = ahead.select("alias", "target")
    raise ValueError("the aliases form a cycle")


#: Fronts that a search keeps apart before it writes them as one.
FRONTS = 16


def used_names(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name) of all that the roots reach over edges (source, target), a step at a time, for as many steps as it takes. Each
    step writes what it finds anew; what was found before is written again once in FRONTS steps."""
    fronts = [checkpointed(roots.select("name").distinct())]
    found = front = fronts[0]
    while True:
        reached = edges.join(front, edges["source"] == front["name"], "left_semi").select(F.col("target").alias("name")).distinct()
        front = checkpointed(reached.join(found, "name", "left_anti"))
        if front.isEmpty():
            return found
        fronts.append(front)
        found = found.union(front)
        if len(fronts) > FRONTS:
            found = checkpointed(found)
            fronts = [found]


def prune(items: DataFrame, used: DataFrame, name: str = "name") -> DataFrame:
    """Items that are used."""
    return items.join(used.select(F.col("name").alias(name)), name, "left_semi")
