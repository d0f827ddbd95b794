"""Operator 8, URL filters: rules by longest match, and Bloom filter cascades for exact list membership.

The key universe is every distinct host of the table. It is dealt by hash into shards of some `shard_keys` keys. A
shard's cascade is built in one task: level 0 encodes the listed keys, level 1 those unlisted keys of the shard that
pass level 0, level 2 the listed keys that pass level 1, and so on until no key passes wrongly. Membership of any key
of the universe is then exact and takes a few bit tests, without a join. Cascades are sent to the tasks in groups of
at most `broadcast_bytes`; beyond that the table is probed in several passes, each over its own shards and written
before the next group is sent.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is never listed;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, stored, table

#: The rules of the query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
CASCADE = "shard int, level int, hashes int, size long, bits binary"


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host (lower-cased A-Z) and path."""
    rest = F.when(F.locate("://", F.col("url")) > 0, F.expr("substring(url, locate('://', url) + 3)"))
    pages = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    pages = pages.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate("_host", UPPER, UPPER.lower()), "path": path}).drop("_rest", "_host")


def longest_rule(rules, value) -> Column:
    """value(verdict, host, path) of the longest rule that fits host and path, else null."""
    found = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        found = F.when(fits, value(verdict, host, path)).otherwise(found)
    return found


def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a + b * np.uint64(2 * salt + 1) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def passes(bits: np.ndarray, size: int, hashes: int, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ok = np.ones(len(a), bool)
    for k in range(hashes):
        at = mixed(a, b, level * 64 + k) % np.uint64(size)
        ok &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def bloom(a: np.ndarray, b: np.ndarray, level: int, false_rate: float) -> tuple[np.ndarray, int, int]:
    hashes = max(1, round(-np.log2(false_rate)))
    size = max(8, int(np.ceil(len(a) * hashes / np.log(2))))
    bits = np.zeros((size + 7) // 8, np.uint8)
    for k in range(hashes):
        at = mixed(a, b, level * 64 + k) % np.uint64(size)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits, size, hashes


def cascade(pdf: pd.DataFrame) -> pd.DataFrame:
    """The levels of one shard from its keys' hashes (a, b) and the flag listed."""
    a, b, listed = (pdf[c].to_numpy() for c in ("a", "b", "listed"))
    a, b, levels = a.view(np.uint64), b.view(np.uint64), []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        level = len(levels)
        if level > 60:
            raise ValueError("two keys of a shard share all 128 hash bits")
        # Level 0 lets about as many others pass as are listed; halving each time is best from there on.
        rate = min(0.5, len(inside) / (1.42 * max(1, len(outside)))) if level == 0 else 0.5
        bits, size, hashes = bloom(a[inside], b[inside], level, rate)
        levels.append((int(pdf["shard"].iloc[0]), level, hashes, size, bits.tobytes()))
        outside = outside[passes(bits, size, hashes, level, a[outside], b[outside])]
        inside, outside = outside, inside
    return pd.DataFrame(levels, columns=["shard", "level", "hashes", "size", "bits"])


def hashed(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumns({
        "a": F.xxhash64(key), "b": F.xxhash64(F.lit("cascade"), key),
        "shard": F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int"),
    })


def build_cascades(keys: DataFrame, shard_keys: int = 200_000) -> tuple[DataFrame, int]:
    """(cascades, shards) for the universe `keys` (key, listed), each key once."""
    shards = max(1, -(-keys.count() // shard_keys))
    built = hashed(keys, "key", shards).select("shard", "a", "b", "listed").groupBy("shard").applyInPandas(cascade, CASCADE)
    return stored(built, "cascades"), shards


def membership(sent):
    """UDF (shard, a, b) -> boolean over the broadcast levels: a key is listed if it passes an odd number in a row."""

    @F.pandas_udf("boolean")
    def member(shard: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        shard, a, b = shard.to_numpy(), a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)
        depth = np.zeros(len(a), np.int64)
        for s in np.unique(shard):
            live = np.flatnonzero(shard == s)
            for level, (bits, size, hashes) in enumerate(sent.value.get(int(s), [])):
                live = live[passes(bits, size, hashes, level, a[live], b[live])]
                depth[live] += 1
        return pd.Series(depth % 2 == 1)

    return member


def probe(df: DataFrame, key: str, cascades: DataFrame, shards: int, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """`df` with the column `listed`: whether the cascades hold the key, exact for keys of the universe."""
    spark = df.sparkSession
    sizes = cascades.groupBy("shard").agg(F.sum(F.length("bits")).alias("n")).orderBy("shard").collect()
    groups, held = [[]], 0
    for shard, n in sizes:  # a row for some 200,000 keys
        if groups[-1] and held + n > broadcast_bytes:
            groups.append([])
            held = 0
        groups[-1].append(shard)
        held += n
    if not sizes:
        return df.withColumn("listed", F.lit(False))
    known = hashed(df, key, shards)
    out = known.where(~F.col("shard").isin([s for g in groups for s in g])).withColumn("listed", F.lit(False))
    for group in groups:
        levels: dict[int, list] = {}
        for r in cascades.where(F.col("shard").isin(group)).orderBy("shard", "level").collect():
            levels.setdefault(r.shard, []).append((np.frombuffer(r.bits, np.uint8), r["size"], r.hashes))
        sent = spark.sparkContext.broadcast(levels)

        part = known.where(F.col("shard").isin(group)).withColumn("listed", membership(sent)("shard", "a", "b"))
        if len(groups) > 1:  # written before the next group goes out, so that one group's levels are held at a time
            part = stored(part, "probed")
            sent.destroy()
        out = out.unionByName(part)
    return out.drop("shard", "a", "b")


def filter_urls(pages: DataFrame, rules=RULES, shard_keys: int = 200_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every url.

    Listed are the hosts of which the rules block at least one page. A url that no rule fits is blocked if its host
    is listed, so that the rest of a blocked host's pages go too."""
    urls = with_host_path(pages.select("page_id", "url"))
    by_rule = longest_rule(rules, lambda verdict, host, path: F.lit(verdict))
    urls = urls.withColumns({"rule": longest_rule(rules, lambda verdict, host, path: F.lit(host + path)), "_by_rule": by_rule})
    blocked = F.coalesce(F.col("_by_rule") == "block", F.lit(False))
    keys = urls.where(F.col("host") != "").groupBy(F.col("host").alias("key")).agg(F.max(blocked).alias("listed"))
    cascades, shards = build_cascades(keys, shard_keys)
    out = probe(urls, "host", cascades, shards, broadcast_bytes)
    listed = F.col("listed") & (F.col("host") != "")
    verdict = F.coalesce("_by_rule", F.when(listed, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), listed.alias("listed"))


def op8_url_filters(spark, sf_dir) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), judged AS (
  SELECT p.*, rule, action FROM p LEFT JOIN fits ON p.page_id = fits.page_id
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN host <> '' AND host IN (
  SELECT host FROM judged WHERE action = 'block') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
