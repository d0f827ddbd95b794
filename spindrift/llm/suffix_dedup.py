"""Operator 9, removal of repeated passages: suffixes sorted bucket by bucket, long ties settled by cover-sample ranks.

Two suffixes count as repeats if their first `LENGTH` bytes agree. Sorting all suffixes of a corpus would move each
with its prefix, many times the text; so suffixes whose prefix can't recur in another document leave first:

1. Anchors: a window of LENGTH bytes is represented by its least `GRAM`-byte string (by hash). Equal windows have
   equal anchors at equal places, so only windows around an anchor that two documents share can be equal. A task
   sends its anchors in packed blocks, each with a 56-bit hash of its context, the bytes of all windows over it. Of
   equal contexts the smallest document's is left, the others are settled on the spot: all their windows go. Contexts
   are compared only within one anchor, so N contexts of an anchor are mistaken with a chance of N * N / 2^57 (for a
   million of them one in 140,000). Anchors with many contexts in one task are sent apart with one marker, so that no
   anchor gathers too many rows.
2. Contexts: where a shared anchor has several contexts, windows may still agree in part. Their bytes (SPAN) are
   taken from the texts.
3. Buckets: a bucket holds the contexts of a range of anchors and sorts all their windows, one place after the other.
   A window reaches a place of the cover sample (every PERIOD bytes) within PERIOD - 1 bytes; the ranks of the
   sample's strings of LENGTH - PERIOD bytes are computed once per block, so a window's order is a rank and PERIOD
   bytes, not LENGTH. Windows that tie are one class, of which the smallest doc_id keeps its bytes.

A cover with one residue is enough, since equal windows lie alike around their anchor. Memory of a task: one group of
texts, one block of contexts.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; rows that share a doc_id are no smaller
than one another, so they don't clear each other; a null doc_id is larger than any other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTES, RADIX, U, buffers, from_planes, mix, planes, powers, runs, spread, text_groups
from .common import table

LENGTH, GRAM, PERIOD = 50, 16, 17
#: Windows over an anchor begin at up to EDGE bytes before it.
EDGE = LENGTH - GRAM
SPAN = 2 * EDGE + GRAM
BLOCK = LENGTH - PERIOD
#: Bytes of text hashed at once, anchors that a task gathers before it sends them, contexts that are sorted at once.
GROUP, GATHER, SORTED = 1 << 19, 1 << 18, 1 << 15
NO_ID = (1 << 63) - 1
def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    m, span = a, 1
    while span * 2 <= width:
        m, span = np.minimum(m[:-span], m[span:]), span * 2
    rest = width - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def anchors(text: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(positions, hashes, prefix hashes of the text) of the anchors of all windows that lie within one owner."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(1, U)
    pw, inverse = powers(len(text) + 1)
    h = np.zeros(len(text) + 1, U)
    np.cumsum(BYTES[text] * pw[: len(text)], out=h[1:])
    size = len(text) - GRAM + 1
    gram = mix((h[GRAM:] - h[:-GRAM]) * inverse[:size])
    least = sliding_min(gram, EDGE + 1)
    least = np.where(owner[: len(least)] == owner[LENGTH - 1 :], least, U(0))
    # A position is an anchor if it is the minimum of some window over it, that is if the largest minimum equals it.
    pad = np.zeros(EDGE, U)
    most = ~sliding_min(~np.concatenate([pad, least, pad]), EDGE + 1)
    at = np.flatnonzero((most[:size] == gram) & (gram != 0))
    return at, gram[at], h


def pieces(column: pa.Array):
    """Groups of (row, offset, bytes) of some GROUP bytes; long texts in slices that overlap by a window less a byte."""
    group, held = [], 0
    for first, _, texts in text_groups(column, GROUP):
        for row, t in enumerate(texts, first):
            for at in range(0, max(1, len(t) - LENGTH + 1), GROUP):
                part = t[at : at + GROUP + LENGTH - 1]
                group.append((row, at, part))
                held += len(part)
                if held >= GROUP:
                    yield group
                    group, held = [], 0
    if group:
        yield group


OPEN, KNOWN, MARK, SETTLED = 0, 1, 2, 3
#: Contexts of one anchor that a task may have before they are sent apart.
COMMON = 64
BLOCKS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("grams", pa.binary()), ("rows", pa.binary())])
#: What a block has of each anchor: name, type, bytes sent. A block's rows are sorted by document and place.
FIELDS = [("doc", np.int64, 8), ("version", np.int64, 8), ("at", np.int64, 5), ("left", np.int64, 1), ("right", np.int64, 1), ("context", U, 7)]
#: Bytes of an anchor's hash that are sent; the bits above choose the bucket.
LOW = 4
#: A place whose bytes are needed, or with a width a span that is settled.
FOUND = "doc_id long, version long, at int, width int"


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def settle(gram: np.ndarray, rows: dict) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """(rows sorted by gram and context, whether a smaller document has a row's context, contexts and whether several
    documents there are of a row's gram)."""
    order = np.lexsort((rows["doc"], rows["context"], gram))
    rows, gram = {k: v[order] for k, v in rows.items()} | {"gram": gram[order]}, gram[order]
    begin = runs(gram, rows["context"])
    of = spread(begin, len(gram))
    repeat = rows["doc"] > rows["doc"][begin][of]
    first = runs(gram)
    group = spread(first, len(gram))
    contexts_ = np.add.reduceat(np.isin(np.arange(len(gram)), begin).astype(np.int64), first)[group]
    several = (np.minimum.reduceat(rows["doc"], first) != np.maximum.reduceat(rows["doc"], first))[group]
    return rows, repeat, contexts_, several


def located(rows: dict, mask: np.ndarray, settled: bool):
    """FOUND rows: places whose bytes are needed, or spans that are settled, united where they touch."""
    doc, version, at = (rows[k][mask] for k in ("doc", "version", "at"))
    if settled:
        doc, version, at, stop = merged(doc, version, at - rows["left"][mask], at + GRAM + rows["right"][mask])
    n = len(doc)
    for a in range(0, n, 1 << 18):
        b = min(n, a + (1 << 18))
        width = pa.array((stop - at)[a:b].astype(np.int32)) if settled else pa.nulls(b - a, pa.int32())
        columns = [pa.array(doc[a:b]), pa.array(version[a:b]), pa.array(at[a:b].astype(np.int32)), width]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "at", "width"])


def anchor_blocks(batches, buckets: int):
    """BLOCKS of the texts' anchors. Document ids go as differences, which compress."""
    store: list[tuple] = []
    sent = {OPEN: FIELDS, KNOWN: FIELDS, MARK: [], SETTLED: FIELDS[:-1]}

    def block(rows: dict, mask: np.ndarray, kind: int):
        mine = np.flatnonzero(mask)
        bucket = ((rows["gram"][mine] >> U(8 * LOW)) % U(buckets)).astype(np.int32)
        order = np.lexsort((rows["at"][mine], rows["doc"][mine], bucket))
        mine, bucket = mine[order], bucket[order]
        cuts = np.split(mine, runs(bucket)[1:]) if len(mine) else []
        yield pa.RecordBatch.from_arrays([
            pa.array(bucket[runs(bucket)]), pa.array([kind] * len(cuts), pa.int8()),
            pa.array([b"" if kind == SETTLED else planes(rows["gram"][r], LOW) for r in cuts], pa.binary()),
            pa.array([b"".join(planes(np.diff(rows[n][r], prepend=0) if n == "doc" else rows[n][r], w) for n, _, w in sent[kind]) for r in cuts], pa.binary()),
        ], schema=BLOCKS)

    def flush():
        gram, *columns = (np.concatenate(c) for c in zip(*store, strict=True))
        store.clear()
        rows, repeat, contexts_, several = settle(gram, {n: c for (n, _, _), c in zip(FIELDS, columns, strict=True)})
        lead = np.zeros(len(gram), bool)
        lead[runs(rows["gram"])] = True
        common = several & (contexts_ >= COMMON)
        yield from block(rows, ~repeat & ~common, OPEN)
        yield from block(rows, ~repeat & common, KNOWN)
        # Another task's only row of a gram must learn that the gram is shared, and that it has several contexts.
        yield from block(rows, lead & common, MARK)
        yield from block(rows, repeat, SETTLED)

    held = 0
    for batch in batches:
        ids, versions = ids_of(batch.column(0)), batch.column(1).to_numpy()
        for group in pieces(batch.column(2)):
            row, at0 = np.array([g[0] for g in group]), np.array([g[1] for g in group])
            lens = np.array([len(g[2]) for g in group])
            owner = np.repeat(np.arange(len(group), dtype=np.int32), lens)
            at, gram, h = anchors(np.frombuffer(b"".join(g[2] for g in group), np.uint8), owner)
            which = owner[at]
            begin = np.cumsum(lens) - lens
            left, right = np.minimum(at - begin[which], EDGE), np.minimum(begin[which] + lens[which] - at - GRAM, EDGE)
            around = mix((h[at + GRAM + right] - h[at - left]) * powers(len(h))[1][at - left] + left.astype(U) * U(RADIX) + right.astype(U))
            store.append((gram, ids[row[which]], versions[row[which]], at - begin[which] + at0[which], left, right, around))
            held += len(at)
            if held >= GATHER:
                yield from flush()
                held = 0
    if held:
        yield from flush()


def shared_anchors(batches):
    """FOUND rows of BLOCKS sorted by bucket. One bucket is held at a time."""
    grams, seen, marks, now = [], [], [], None

    def finish():
        rows, repeat, contexts_, several = settle(np.concatenate(grams), {n: np.concatenate([s[n] for s in seen]) for n, _, _ in FIELDS})
        yield from located(rows, repeat, True)
        marked = np.isin(rows["gram"], np.concatenate([*marks, np.zeros(0, U)]))
        yield from located(rows, ~repeat & (marked | (several & (contexts_ > 1))), False)

    for batch in batches:
        for bucket, kind, low, data in zip(*(batch.column(c).to_pylist() for c in range(2)), *(buffers(batch.column(c)) for c in (2, 3)), strict=True):
            if bucket != now:
                if grams:
                    yield from finish()
                grams, seen, marks, now = [], [], [], bucket
            fields = FIELDS[:-1] if kind == SETTLED else FIELDS
            n, at, rows = len(data) // sum(w for _, _, w in fields), 0, {}
            if kind != SETTLED:
                gram = from_planes(low, LOW) | U(bucket) << U(8 * LOW)
            if kind == MARK:
                marks.append(gram)
                continue
            for name, type_, wide in fields:
                rows[name] = from_planes(data[at : at + n * wide], wide, type_)
                at += n * wide
            rows["doc"] = np.cumsum(rows["doc"])
            if kind == OPEN:
                grams.append(gram)
                seen.append(rows)
            else:
                yield from located(rows, np.ones(n, bool), kind == SETTLED)
    if grams:
        yield from finish()


#: An anchor's context with the bytes it has before and after the anchor, or, without context, a settled span from at on.
CONTEXT = "deal int, doc_id long, version long, at int, left int, right int, context binary"
CONTEXT_SCHEMA = pa.schema([
    ("deal", pa.int32()), ("doc_id", pa.int64()), ("version", pa.int64()), ("at", pa.int32()), ("left", pa.int32()),
    ("right", pa.int32()), ("context", pa.binary()),
])
SPANS = "doc_id long, version long, start int, stop int"


def merged(doc, text, start, stop) -> tuple[np.ndarray, ...]:
    """The spans united where they touch, by document."""
    order = np.lexsort((start, text, doc))
    doc, text, start, stop = doc[order], text[order], start[order], stop[order]
    if not len(doc):
        return doc, text, start, stop
    # Spans are sorted by start; a running maximum of stop per document, made one sequence by a shift for each document.
    begin = runs(doc, text)
    group = spread(begin, len(doc))
    shift = group.astype(np.int64) << 32
    reach = np.maximum.accumulate(stop + shift)
    new = np.append(True, (start[1:] + shift[1:] > reach[:-1]) | (group[1:] != group[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], text[first], start[first], (reach[last] - shift[last]).astype(stop.dtype)


def contexts(batches):
    """CONTEXT rows of (doc_id, version, text, places, settled spans): a row without context is a settled span."""
    weights = powers(SPAN + 1)[0][:SPAN]
    store, held = [], 0

    def flush():
        doc, version, at, size = (np.concatenate([s[k] for s in store]) for k in range(4))
        data = np.concatenate([s[4] for s in store])
        store.clear()
        gram = np.zeros(len(at), U)
        for j in range(GRAM):
            gram += BYTES[data[:, EDGE + j]] * weights[j]
        order = np.argsort(gram)  # like contexts side by side, which compress
        gram, doc, version, at, size, data = gram[order], doc[order], version[order], at[order], size[order], data[order]
        left, right = np.minimum(at, EDGE), np.minimum(size - at - GRAM, EDGE)
        offsets = pa.py_buffer(np.arange(0, (len(at) + 1) * SPAN, SPAN, dtype=np.int32).tobytes())
        binary = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(data.tobytes())])
        short = (pa.array(x.astype(np.int32)) for x in (at, left, right))
        yield pa.RecordBatch.from_arrays([pa.array((mix(gram) >> U(33)).astype(np.int32)), pa.array(doc), pa.array(version), *short, binary], schema=CONTEXT_SCHEMA)

    reach = np.arange(SPAN)
    for batch in batches:
        ids, versions, texts, places, spans = ids_of(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)
        flat, cuts = places.flatten().to_numpy(), places.offsets.to_numpy() - places.offsets[0].as_py()
        items, edges = spans.flatten(), spans.offsets.to_numpy() - spans.offsets[0].as_py()
        row = np.repeat(np.arange(len(ids)), np.diff(edges))
        d, v, a, b = merged(ids[row], versions[row], *(items.field(k).to_numpy().astype(np.int64) for k in range(2)))
        short = (pa.array(x.astype(np.int32)) for x in (a, np.zeros(len(d)), b - a))
        yield pa.RecordBatch.from_arrays(
            [pa.array((mix(d.view(U)) >> U(33)).astype(np.int32)), pa.array(d), pa.array(v), *short, pa.nulls(len(d), pa.binary())], schema=CONTEXT_SCHEMA
        )
        for k, t in enumerate(texts):
            at = np.sort(flat[cuts[k] : cuts[k + 1]]).astype(np.int64)
            body = np.frombuffer(bytes(EDGE) + t + bytes(EDGE), np.uint8)
            for first in range(0, len(at), SORTED):
                part = at[first : first + SORTED]
                n = len(part)
                store.append((np.full(n, ids[k]), np.full(n, versions[k]), part, np.full(n, len(t)), body[part[:, None] + reach]))
                held += n
                if held >= SORTED:
                    yield from flush()
                    held = 0
    if held:
        yield from flush()


def words(data: np.ndarray) -> list[np.ndarray]:
    """The rows' bytes as big-endian numbers of 8 bytes, the last one padded."""
    wide = -(-data.shape[1] // 8) * 8
    out = np.zeros((len(data), wide), np.uint8)
    out[:, : data.shape[1]] = data
    return list(out.view(">u8").astype(U).T)


def sorted_classes(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, begin of each class) of rows that agree in all keys.

    Rows are sorted by a hash of the keys; should different keys ever meet in one hash, by the keys themselves."""
    hashed = np.zeros(len(keys[0]), U)
    for k in keys:
        hashed = mix(hashed * U(RADIX) + k + U(1))
    order = np.argsort(hashed)
    begin = runs(*[k[order] for k in keys])
    if len(begin) != len(runs(hashed[order])):
        order = np.lexsort(keys[::-1])
        begin = runs(*[k[order] for k in keys])
    return order, begin


def sort_block(doc: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context the first and last place (EDGE + 1: none) whose window a smaller document has too.

    left, right: where within data a context's own bytes begin and end."""
    ranks = {}
    for s in range(0, EDGE + 1, PERIOD):
        order, begin = sorted_classes(words(data[:, s : s + BLOCK]))
        ranks[s] = np.empty(len(doc), U)
        ranks[s][order] = spread(begin, len(doc)).astype(U)
    first, last = np.full(len(doc), EDGE + 1), np.full(len(doc), -1)
    for o in range(EDGE + 1):
        live = np.flatnonzero((left <= o) & (right >= o + LENGTH))
        if len(live) < 2:
            continue
        s = -(-o // PERIOD) * PERIOD
        rest = np.concatenate([data[live, o:s], data[live, s + BLOCK : o + LENGTH]], axis=1)
        order, begin = sorted_classes([ranks[s][live], *words(rest)])
        d = doc[live[order]]
        least = np.minimum.reduceat(d, begin)[spread(begin, len(d))]
        hit = live[order[d > least]]
        first[hit] = np.minimum(first[hit], o)
        last[hit] = o
    return first, last


def bucket_spans(batches):
    """SPANS from a partition's CONTEXT rows, sorted by deal: whole anchors, in blocks of at least SORTED contexts."""
    store, held, found = [], 0, []

    def solve(table_: pa.Table) -> None:
        doc, text = table_["doc_id"].to_numpy(), table_["version"].to_numpy()
        at, left, right = (table_[c].to_numpy().astype(np.int64) for c in ("at", "left", "right"))
        data = np.frombuffer(b"".join(table_["context"].to_pylist()), np.uint8).reshape(-1, SPAN)
        # Where a text begins or ends within reach, data is padded.
        first, last = sort_block(doc, EDGE - left, EDGE + GRAM + right, data)
        hit = np.flatnonzero(last >= 0)
        base = at[hit] - EDGE
        found.append((doc[hit], text[hit], base + first[hit], base + last[hit] + LENGTH))

    def give():
        d, t, a, b = merged(*(np.concatenate(c) for c in zip(*found, strict=True)))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "version", "start", "stop"])

    for batch in batches:
        settled = batch.filter(batch.column(6).is_null())
        if len(settled):
            at, width = settled.column(3), settled.column(5)
            stop = pa.array(at.to_numpy() + width.to_numpy())
            yield pa.RecordBatch.from_arrays([settled.column(1), settled.column(2), at, stop], ["doc_id", "version", "start", "stop"])
        open_ = batch.filter(batch.column(6).is_valid())
        if not len(open_):
            continue
        deal = open_.column(0).to_numpy()
        if held >= SORTED and (cut := np.flatnonzero(deal != store[-1]["deal"][-1].as_py())).size:
            if cut[0]:
                store.append(pa.Table.from_batches([open_.slice(0, cut[0])]))
            solve(pa.concat_tables(store))
            store, held, open_ = [], 0, open_.slice(cut[0])
            if found:
                yield give()
        store.append(pa.Table.from_batches([open_]))
        held += len(open_)
    if store:
        solve(pa.concat_tables(store))
    if found:
        yield give()


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, body, spans) of each row of docs: its bytes and array<struct<start, stop>> of what is to go, sorted."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(16 * parts, 1 << 15)
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = docs.select("doc_id", "text")
    again = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id"))
    # Rows that share a doc_id are told apart by their texts; odd versions are those of rows without one.
    version = F.when(F.col("doc_id").isNull(), F.xxhash64("text").bitwiseOR(F.lit(1)))
    if not again.isEmpty():
        docs = docs.join(again, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        version = version.when(F.col("_id").isNotNull(), F.xxhash64("text").bitwiseAND(F.lit(~1)))
    version = version.otherwise(F.lit(0).cast("long"))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), version.alias("version"), body.alias("body"))
    blocks = rows.mapInArrow(lambda b: anchor_blocks(b, buckets), "bucket int, kind byte, grams binary, rows binary")
    found = blocks.repartition(2 * parts, "bucket").sortWithinPartitions("bucket").mapInArrow(shared_anchors, FOUND)
    key = ["doc_id", "version"]
    span = F.when(F.col("width").isNotNull(), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("width")).alias("stop")))
    place = F.when(F.col("width").isNull(), F.col("at"))
    # Dealt out before they are gathered: gathering twice would send lists of one.
    places = found.repartition(parts, *key).groupBy(key).agg(F.collect_set(place).alias("places"), F.collect_list(span).alias("settled"))
    # Both joins read the texts dealt out by the same key; Spark moves them once.
    met = rows.hint("merge").join(places.hint("merge"), key).select(*key, "body", "places", "settled")
    around = met.mapInArrow(contexts, CONTEXT)
    spans = around.repartition(parts, "deal").sortWithinPartitions("deal").mapInArrow(bucket_spans, SPANS)
    spans = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    return rows.hint("merge").join(spans.hint("merge"), key, "left").select(
        F.when((F.col("doc_id") != NO_ID) | (F.col("version").bitwiseAND(F.lit(1)) == 0), F.col("doc_id")).alias("doc_id"), "body", "spans"
    )


def remove_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of each row of docs: the maximal removed runs and the bytes left."""
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,stop:int>>, kept binary"
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("spans", pa.list_(span)), ("kept", pa.binary())])

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, body, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                united: list[list[int]] = []
                for x in spans or ():
                    if united and x["start"] <= united[-1][1]:
                        united[-1][1] = max(united[-1][1], x["stop"])
                    else:
                        united.append([x["start"], x["stop"]])
                edges = [0, *(e for u in united for e in u), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((doc_id, len(body), len(body) - len(kept), len(united), [{"start": a, "stop": b} for a, b in united], kept))
            for a in range(0, len(rows), 1000):
                columns = zip(*rows[a : a + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return passages(docs).mapInArrow(cut, kinds)


def op9_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)
), hit AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS least FROM w) WHERE least < doc_id
), islands AS (
  SELECT doc_id, p, sum(CASE WHEN prev IS NULL OR p > prev + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island
  FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM hit)
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM islands GROUP BY doc_id, island
), removed AS (
  SELECT doc_id, list({'a': a, 'b': b} ORDER BY a) AS s, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
), cuts AS (
  SELECT d.doc_id, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         list_concat([0], coalesce(list_transform(s, lambda x: x.b), [])) AS froms,
         list_concat(coalesce(list_transform(s, lambda x: x.a), []), [length(h) // 2]) AS tos
  FROM d LEFT JOIN removed r ON d.doc_id = r.doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(froms) + 1), lambda i:
         substr(h, 2 * froms[i] + 1, 2 * (tos[i] - froms[i]))), ''))) AS kept_sha256
FROM cuts
"""