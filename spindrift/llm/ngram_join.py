"""Operator 1, n-gram Jaccard join: a size-aware heavy-light self-join of shingle sets.

Equal sets are one node of the join, their smallest doc_id. The nodes are split by size, at a boundary that a cost
model picks from the sizes' histogram:

* Light sets enumerate their subsets of the sizes that an overlap can have. Two light sets link exactly if they meet
  in a subset of the size that they need, so no check follows, and linking all to the smallest set of a subset's
  group loses no component.
* Heavy sets (and light ones near the boundary, for their heavy partners) are found by inverted lists. Shingles
  of a fixed hash range are counted over all sets; those of one set only are dropped. With a = |A| - ceil(0.8 |A|)
  shingles that a partner may lack, any partner has one of A's a + 1 rarest; if more than a are A's alone there is
  no partner. The lists of these prefixes are scanned in two rounds: every set against its list's leader; then,
  components being known, only sets of different components, the lists' minorities against the rest. All
  candidates are verified on the whole sets.

There are lists of a hash range's shingles, for large sets and those near to them in size, and lists of all
shingles, for small sets; the counting argument holds in any fixed part of the universe in which a set has over a
shingles. Sets whose rarest shingles already leave too little for the partner's size are not met.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; rows that share a
doc_id are one node by their doc_id, with the size of one of them (the largest); a null doc_id is dropped from
links but returned; an empty table gives an empty result; other columns are ignored. Memory of a task: a group of
texts of GROUP bytes, or one longer text some 20 times over, and one hash bucket of shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import U, buffers, from_planes, mix, planes, text_groups
from .common import WORD, fresh_names, stored, table
from .components import components
from .shingles import shingle_sets

#: Similarity as percent: 100 * intersection >= LINK * union.
LINK = 80
#: Sets of at least LARGE shingles are indexed by those in the first SHARE of the hash range.
LARGE, SHARE = 1500, 0.4
#: Tells the hash range's lists from those of all shingles; buckets leave this bit free.
RANGED = U(1 << 62)
LOW = (1 << 48) - 1
#: Sets that one task may know to share a shingle before it sends them apart from the shingle's other sets.
COMMON = 64
#: Bytes of text taken at once, shingles that a task gathers before it sends them, sets that it remembers as sent.
GROUP, GATHER, SENT = 1 << 19, 1 << 19, 1 << 17
#: How many list rows a prefix shingle is taken to cost. From MOST_LIGHT on a set has over a million subsets, so that no
#: histogram makes enumerating them the cheaper way: the cost model alone decides below.
LIST_COST, MOST_LIGHT = 20, 40
#: Pairs of one set that a task verifies; a set with more is copied to several tasks.
HUB = 256


def spare(n):
    """How many of n shingles a partner may lack."""
    return n - -(-n * LINK // 100)


def texts_of(batch, at: int = 1):
    """Ranges of a batch with their texts' sets: (first row, last row, hashes, cuts)."""
    for a, b, texts in text_groups(batch.column(at), GROUP):
        hashes, cuts = shingle_sets(texts)
        yield a, b, hashes, cuts


def in_range(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U(LOW)) < U(int(SHARE * (1 << 48)))


def set_sizes(batches):
    """(doc_id, n, ranged, a, b): size, shingles in the hash range, and 128 bits that name the set."""
    for batch in batches:
        for first, last, hashes, cuts in texts_of(batch):
            at = np.append(0, np.cumsum(in_range(hashes)))
            sums = [np.append(U(0), np.cumsum(x, dtype=U)) for x in (mix(hashes + U(1)), mix(hashes ^ U(0x5851F42D4C957F2D)))]
            columns = [np.diff(cuts), np.diff(at[cuts]), *((s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *map(pa.array, columns)], ["doc_id", "n", "ranged", "a", "b"])


OPEN, KNOWN, MARK = 0, 1, 2
BLOCK = "bucket int, kind byte, tokens binary, docs binary"


def token_blocks(batches, buckets: int, least: int):
    """BLOCK rows with the indexed shingles of sets of at least `least`; of the equal sets that a task remembers one."""
    known: set[tuple[int, int]] = set()
    tokens, docs, held = [], [], 0

    def flush():
        token, doc = np.concatenate(tokens), np.concatenate(docs)
        tokens.clear()
        docs.clear()
        order = np.argsort(token)
        token, doc = token[order], doc[order]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.diff(np.append(begin, len(token)))
        common = np.repeat(count >= COMMON, count)
        lead = np.zeros(len(token), bool)
        lead[begin] = True
        bucket = ((token >> U(48)) % U(buckets)).astype(np.int32)
        for kind, mask in ((OPEN, ~common), (KNOWN, common), (MARK, common & lead)):
            mine = np.flatnonzero(mask)
            mine = mine[np.lexsort((doc[mine], bucket[mine]))]
            rows = np.split(mine, np.flatnonzero(np.diff(bucket[mine])) + 1) if len(mine) else []
            yield pa.RecordBatch.from_arrays([
                pa.array([int(bucket[r[0]]) for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int8()),
                pa.array([planes(token[r], 6) for r in rows], pa.binary()),
                pa.array([b"" if kind == MARK else planes(doc[r], 8) for r in rows], pa.binary()),
            ], ["bucket", "kind", "tokens", "docs"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for first, last, hashes, cuts in texts_of(batch):
            name = np.append(U(0), np.cumsum(mix(hashes + U(1)), dtype=U))
            n, ranged = np.diff(cuts), np.append(0, np.cumsum(in_range(hashes)))
            name, ranged = name[cuts[1:]] - name[cuts[:-1]], np.diff(ranged[cuts])
            take = np.zeros(last - first, bool)
            for k in np.flatnonzero(n >= least):
                key = (int(n[k]), int(name[k]))
                if key not in known:
                    if len(known) >= SENT:  # sending equal sets twice costs time only: their rows become one later
                        known.clear()
                    known.add(key)
                    take[k] = True
            partly = (n >= LARGE) & (ranged > spare(n))
            keep = np.repeat(take, n) & (~np.repeat(partly, n) | in_range(hashes))
            tokens.append(hashes[keep])
            docs.append(np.repeat(ids[first:last], n)[keep])
            held += len(tokens[-1])
            if held >= GATHER:
                yield from flush()
                held = 0
    if held:
        yield from flush()


def shared_tokens(batches):
    """(doc_id, token, sets) of the shingles that two sets have, from blocks sorted by bucket; sets is their number, or
    2^31 - 1 if many. One bucket is held at a time."""
    tokens, docs, marks, now = [], [], [], None

    def finish():
        token, doc = np.concatenate(tokens), np.concatenate(docs)
        order = np.argsort(token)
        token, doc = token[order], doc[order]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        count = np.diff(np.append(begin, len(token)))
        if marks:
            count = np.where(np.isin(token[begin], np.concatenate(marks)), (1 << 31) - 1, count)
        count = np.repeat(count, np.diff(np.append(begin, len(token))))
        rows = np.flatnonzero(count > 1)
        for a in range(0, len(rows), 1 << 17):
            r = rows[a : a + (1 << 17)]
            yield shared_rows(doc[r], token[r], count[r])

    for batch in batches:
        for bucket, kind, raw, ids in zip(*(batch.column(c).to_pylist() for c in range(2)), *(buffers(batch.column(c)) for c in (2, 3)), strict=True):
            if bucket != now:
                if tokens:
                    yield from finish()
                tokens, docs, marks, now = [], [], [], bucket
            token = from_planes(raw, 6) | U(bucket) << U(48)
            if kind == MARK:
                marks.append(token)
            elif kind == KNOWN:
                yield shared_rows(from_planes(ids, 8), token, np.full(len(token), (1 << 31) - 1))
            else:
                tokens.append(token)
                docs.append(from_planes(ids, 8))
    if tokens:
        yield from finish()


def shared_rows(doc, token, count) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.view(np.int64)), pa.array(token.view(np.int64)), pa.array(count.astype(np.int32))], ["doc_id", "token", "sets"])


def prefixes(batches):
    """(token, node, n, place) from (node, n, ranged, tokens array<struct<sets, token>>): the rarest shingles, one of
    which a partner must have, and how many rarer ones the set has before each."""
    for batch in batches:
        out = []
        items = batch.column(3).flatten()
        sets, token = items.field(0).to_numpy(), items.field(1).to_numpy().view(U)
        cuts = batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
        for k, (node, n, ranged) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            t, s = token[cuts[k] : cuts[k + 1]], sets[cuts[k] : cuts[k + 1]]
            t = t[np.lexsort((t, s))]
            most = spare(n) + 1
            # Shingles that no other set has come first in any order; they are known by their number only.
            if n * 100 >= LARGE * LINK:  # the lists of the hash range, where large sets are
                inside = t[in_range(t)]
                place = ranged - len(inside) + np.arange(len(inside))
                wanted = place < most if ranged >= most else place >= 0
                out.append((inside[wanted] | RANGED, np.full(wanted.sum(), node), np.full(wanted.sum(), n), place[wanted]))
            if n < LARGE or ranged < most:  # the lists of all shingles, where small sets are
                place = n - len(t) + np.arange(len(t))
                wanted = place < most
                out.append((t[wanted], np.full(wanted.sum(), node), np.full(wanted.sum(), n), place[wanted]))
        token_, node_, n_, place_ = (np.concatenate(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
        columns = [np.asarray(token_, U).view(np.int64), node_, n_, place_]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "node", "n", "place"])


def light_subsets(batches, light: int):
    """(subset, size, node, n): hashes of the subsets that light sets can share with a partner."""
    from itertools import combinations

    for batch in batches:
        rows = []
        ids = batch.column(0).to_pylist()
        for first, last, hashes, cuts in texts_of(batch):
            for k in range(last - first):
                own = hashes[cuts[k] : cuts[k + 1]]
                n = len(own)
                if 0 < n <= light:
                    values = mix(own + U(7))
                    whole = int(values.sum(dtype=U))
                    for gone in range(spare(n) + 1):
                        for out in combinations(range(n), gone):
                            name = (whole - int(values[list(out)].sum(dtype=U)) + (1 << 63)) % (1 << 64) - (1 << 63)
                            rows.append((name, n - gone, ids[first + k], n))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["subset", "size", "node", "n"])


def light_bound(histogram: dict[int, int]) -> int:
    """The size up to which enumerating subsets costs less than index rows and scanned lists."""
    def enumerated(n):
        return sum(math.comb(n, k) for k in range(spare(n) + 1))

    def scanned(n):
        return n + (spare(n) + 1) * LIST_COST

    total = lambda x: sum(c * (enumerated(n) if n <= x else scanned(n)) for n, c in histogram.items())
    return min(range(1, MOST_LIGHT + 1), key=lambda x: (total(x), x))


def whole_sets(batches):
    """(node, tokens) of each row."""
    for batch in batches:
        for first, last, hashes, cuts in texts_of(batch):
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), lists], ["node", "tokens"])


class Join:
    """The steps that need the documents: their texts once more for the sets of candidates."""

    def __init__(self, docs: DataFrame, broadcast_ids: int = 1_000_000):
        self.docs, self.broadcast_ids = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()), broadcast_ids

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose sets are similar enough, as edges (u, v).

        Of a pair's sets that of the node with fewer pairs goes to the other's. That one, say a group's hub, is copied
        to a task for every HUB of its pairs, so that no task has all pairs of one set. Rows that share a doc_id are
        each tried."""
        ends = pairs.select(F.col("x").alias("node")).union(pairs.select("y"))
        nodes = stored(ends.groupBy("node").agg(F.count("*").alias("pairs")), "join-nodes")
        few = nodes.count() <= self.broadcast_ids  # 16 MB at most
        wanted = nodes.select(F.col("node").alias("doc_id"))
        rows = self.docs.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
        sets = stored(rows.mapInArrow(whole_sets, "node long, tokens array<long>"), "join-sets")
        for c in "xy":
            pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("pairs").alias(f"n{c}")), c)
        swap = F.col("nx") > F.col("ny")
        pairs = pairs.select(
            F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), F.greatest("nx", "ny").alias("pairs")
        )
        pairs = stored(pairs.select("x", "y", F.pmod(F.xxhash64("x"), F.expr(f"(pairs - 1) div {HUB} + 1")).alias("copy")), "join-dealt")
        x = sets.select(F.col("node").alias("x"), F.col("tokens").alias("tx"))
        y = sets.join(nodes, "node").select(F.col("node").alias("y"), F.explode(F.expr(f"sequence(0L, (pairs - 1) div {HUB})")).alias("copy"), F.col("tokens").alias("ty"))
        met = pairs.hint("merge").join(x.hint("merge"), "x").join(y.hint("merge"), ["y", "copy"])
        both = F.size(F.array_intersect("tx", "ty")).cast("long")
        met = met.select(F.col("x").alias("u"), F.col("y").alias("v"), both.alias("both"), (F.size("tx") + F.size("ty")).cast("long").alias("sizes"))
        return met.where(100 * F.col("both") >= LINK * (F.col("sizes") - F.col("both"))).select("u", "v")


def near(n, m):
    """Sizes of sets that can be similar enough."""
    return (100 * F.least(n, m)) >= LINK * F.greatest(n, m)


def most_partner(n, place):
    """The largest partner of a set of n whose `place` rarest shingles the partner lacks: n - place shingles in common
    must be at least LINK / (100 + LINK) of both sizes."""
    return F.floor(((100 + LINK) * (n - place) - LINK * n) / LINK)


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, copy_of) of each row of docs; copy_of is the smallest doc_id with an equal set."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text")
    sizes = stored(docs.mapInArrow(set_sizes, "doc_id long, n long, ranged long, a long, b long"), "join-sizes")
    real = sizes.where("doc_id IS NOT NULL AND n > 0")
    copies = real.groupBy("n", "a", "b").agg(F.min("doc_id").alias("node"))
    members = stored(real.join(copies, ["n", "a", "b"]).select("doc_id", "node", "n", "ranged"), "join-members")

    small = {r.n: r["count"] for r in members.where((F.col("n") <= MOST_LIGHT) & (F.col("doc_id") == F.col("node"))).groupBy("n").count().collect()}
    light = light_bound(small)
    least = -(-(light + 1) * LINK // 100)  # the smallest partner of a heavy set

    subsets = docs.where("doc_id IS NOT NULL").mapInArrow(lambda b: light_subsets(b, light), "subset long, size long, node long, n long")
    lead = subsets.groupBy("subset", "size").agg(F.min(F.struct("n", "node")).alias("lead"))
    light_edges = subsets.join(lead, ["subset", "size"]).where(
        ((100 + LINK) * F.col("size") >= LINK * (F.col("n") + F.col("lead.n"))) & (F.col("node") != F.col("lead.node"))
    ).select(F.col("node").alias("u"), F.col("lead.node").alias("v"))

    buckets = min(16 * parts, 1 << 15)
    real_docs = docs.where("doc_id IS NOT NULL")
    blocks = real_docs.mapInArrow(lambda b: token_blocks(b, buckets, least), BLOCK)
    shared = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(shared_tokens, "doc_id long, token long, sets int")
    listed = shared.groupBy("doc_id").agg(F.collect_list(F.struct("sets", "token")).alias("tokens"))
    listed = listed.join(members, "doc_id").select("node", "n", "ranged", "tokens")
    lists = stored(listed.mapInArrow(prefixes, "token long, node long, n long, place long").distinct(), "join-lists")

    join = Join(docs)
    # The leader is the set with the fewest shingles that no one shares, the hub of a group of near copies if there is one.
    lists = lists.withColumn("most", most_partner(F.col("n"), F.col("place")))
    lead = lists.groupBy("token").agg(F.min(F.struct("place", "node", "n", "most")).alias("l"), F.count("*").alias("rows")).where("rows > 1")
    lead = stored(lead.drop("rows"), "join-lead")
    first = lists.join(lead.select("token", F.col("l.node").alias("y"), F.col("l.n").alias("m"), F.col("l.most").alias("most_y")), "token")
    first = first.where(near(F.col("n"), F.col("m")) & (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("most_y")) & (F.col("node") != F.col("y")))
    first = stored(first.select(F.col("node").alias("x"), "y").distinct(), "join-pairs")
    edges = stored(join.linked(first), "join-edges").unionByName(stored(light_edges, "join-edges"))
    found = components(edges, "join-components")

    # Second scan: what the first left apart. A set whose rarest shingles leave only partners smaller than the list's
    # least set has none there. Within a list, sets of its most frequent component are met by the others.
    named = lists.join(lead.select("token"), "token", "left_semi").join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = stored(named.select("token", "node", "n", "most", F.coalesce("component", "node").alias("component")), "join-named")
    least_n = named.groupBy("token").agg(F.min("n").alias("least"))
    named = stored(named.join(least_n, "token").where("most >= least").drop("least"), "join-named")
    groups = named.groupBy("token", "component").agg(F.count("*").alias("rows"))
    groups = groups.groupBy("token").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("parts"))
    groups = groups.where("parts > 1").select("token", "main")
    open_lists = stored(named.join(groups, "token"), "join-open")
    side = lambda x: [F.col(c).alias(f"{c[0] if c != 'most' else 'most_'}{x}") for c in ("n", "most", "component")]
    few = open_lists.where("component <> main").select("token", F.col("node").alias("x"), *side("x"))
    rest = open_lists.select("token", F.col("node").alias("y"), *side("y"), (F.col("component") == F.col("main")).alias("is_main"))
    second = few.join(rest, "token").where("cx <> cy AND (is_main OR x < y) AND ny <= most_x AND nx <= most_y").where(near(F.col("nx"), F.col("ny")))
    second = second.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    second = stored(second.join(first.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti"), "join-pairs")
    more = stored(join.linked(second), "join-edges")
    # The first round's components stand for their edges.
    all_edges = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
    final = components(all_edges, "join-components")

    out = members.join(final, members["node"] == final["node"], "left").select(
        "doc_id", members["node"].alias("copy_of"), F.coalesce("component", members["node"]).alias("component_id")
    ).distinct()
    out = stored(out, "join-found")
    out = sizes.join(out.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component, the one of the smallest doc_id; all columns stay, whatever their names.

    All rows of that doc_id stay, and rows without doc_id."""
    (gone,) = fresh_names(docs, "_gone")
    found = join_components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(gone), "left_anti")


def keep_one_row(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component; all columns stay, whatever their names.

    As keep_one where each row has a doc_id of its own. Rows without doc_id, and rows that share one, are known by their
    doc_id and text and get numbers after the largest doc_id, so that a row with a doc_id of its own stays before them.
    Rows without words are linked with nothing and all stay."""
    again = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id")
    if again.isEmpty():
        return keep_one(docs)
    names = fresh_names(docs, "_h", "_g", "_node", "_id", "_kh", "_kg", "_gone")
    h, g, node, id_, kh, kg, gone = names
    hashed = docs.withColumns({h: F.xxhash64("text"), g: F.xxhash64(F.lit(1), "text")})
    keys = hashed.select("doc_id", h, g).join(again.withColumnRenamed("doc_id", id_), F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi").distinct()
    keys = stored(keys.withColumn(node, F.monotonically_increasing_id()), "join-rows")
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).first()[0]
    keys = keys.select(F.col("doc_id").alias(id_), F.col(h).alias(kh), F.col(g).alias(kg), (F.col(node) + (top + 1)).alias(node))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(kh)) & (F.col(g) == F.col(kg))
    rows = hashed.join(keys, same, "left")
    found = join_components(rows.select(F.coalesce(node, "doc_id").alias("doc_id"), "text"))
    found = found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    rows = rows.join(found, F.coalesce(node, "doc_id") == F.col(gone), "left_anti")
    one = F.col(node).isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return rows.where(~one).unionByName(rows.where(one).dropDuplicates([node])).select(*docs.columns)


def op1_ngram_join(spark, sf_dir) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), edges AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), links AS (
  SELECT x, y FROM edges UNION ALL SELECT y, x FROM edges
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.node = l.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.lowest, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(node) AS lowest FROM reach GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""
