"""Operator 7: URL rules and listed URLs behind a blocked Bloom filter.

Rules and listed URLs are (host, path) prefixes.  A URL's candidate keys are the
suffixes of its host with the prefixes of its path that are as long as some rule's;
rules are looked up by the host and path as they are, listed URLs by their canonical
form.  A blocked Bloom filter (one block of 256 bits per key, eight bits set in it)
passes possible hits; only those of different URLs reach the exact hash join with the
rules, which removes false positives.  Only DataFrame functions are used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import hidden, join_counted, shown, table

#: The rules of the production query: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Listed canonical URL prefixes of the production query, blocked where no rule fits: each name under each domain.
JUNK_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{domain}/" for name in JUNK_NAMES for domain in DOMAINS)
#: The filter has at most so many blocks of four 64-bit words (2 MB); more keys make more false positives, never misses.
MAX_BLOCKS = 65536
KEYS_PER_BLOCK = 16


def host_of(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """A host (lower-cased) without user information, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "\\.+$", "")


def canonical_path(path: Column) -> Column:
    """The empty path is /."""
    return F.when(path == "", F.lit("/")).otherwise(path)


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)).cast("int")


def bits_of(key: Column) -> list[Column]:
    """Eight bit numbers in 0..255, two for each 64-bit word of a block."""
    h = F.xxhash64(key, F.lit(2))
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(8)]


def build_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of the distinct keys (column key), one row per block that has any."""
    bits = bits_of(F.col("key"))
    parts = keys.select(block_of(F.col("key"), blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    words = [F.expr(f"bit_or(shiftleft(1L, b{2 * i}) | shiftleft(1L, b{2 * i + 1}))").alias(f"w{i}") for i in range(4)]
    return parts.groupBy("block").agg(*words)


def may_hold(key: Column, words: list[Column]) -> Column:
    """Whether all eight bits of the key are set in the four words of its block."""
    bits = bits_of(key)
    test = F.lit(True)
    for i, b in enumerate(bits):
        test = test & (F.getbit(words[i // 2], b) == 1)
    return F.coalesce(test, F.lit(False))


def filter_column(keys: DataFrame, blocks: int) -> Column:
    """The filter as one constant array (2 MB at most): four words of each block, one after the other."""
    words = np.zeros(4 * blocks, dtype=np.int64)
    for r in build_filter(keys, blocks).collect():
        words[4 * r["block"] : 4 * r["block"] + 4] = [r[f"w{i}"] for i in range(4)]
    return F.lit(words)


def candidates(kind: str, host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of the suffixes of the host with the prefixes of the path that have one of the lengths."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.lit(lengths), lambda n: n <= F.length(path)) if lengths else F.array().cast("array<int>")
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(F.lit(kind), s, F.lit("\n"), path.substr(F.lit(1), n)))))


RESULTS = ("host", "path", "rule", "rule_verdict", "listed")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule, rule_verdict and listed.

    rules has host, path, verdict; a verdict of null marks a listed URL prefix, which
    is compared with the URL in canonical form.  The longest fitting rule wins (host
    and path together, then the longer host); of equal rules with different
    verdicts, block wins.  Rules without host or path fit nothing.  A null url or one
    without :// has an empty host and path, which only a rule with an empty host
    and path fits.  Repeated rows are judged each, urls of any length are, and no rows
    give no rows.  Columns of pages called like the results (in any case) are
    replaced, all others keep their values.
    """
    clean = rules.where("host IS NOT NULL AND path IS NOT NULL").select(F.when(F.col("verdict").isNull(), F.lit("l")).otherwise(F.lit("r")).alias("kind"), "host", "path", "verdict")
    clean = clean.groupBy("kind", "host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", F.concat("kind", "host", F.lit("\n"), "path"))
    # A row per path length that occurs: small by the shape of rules, not by the pages.
    shapes = clean.groupBy("kind", F.length("path").alias("chars")).agg(F.count("*").alias("n")).collect()
    blocks = max(1, min(MAX_BLOCKS, -(-sum(r["n"] for r in shapes) // KEYS_PER_BLOCK)))
    rows = pages.select(*hidden(pages), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    lengths = {kind: sorted(r["chars"] for r in shapes if r["kind"] == kind) for kind in "rl"}
    keys = F.concat(candidates("r", F.col("host"), F.col("path"), lengths["r"]), candidates("l", canonical_host(F.col("host")), canonical_path(F.col("path")), lengths["l"]))
    words = filter_column(clean.select("key"), blocks)

    def possible(key: Column) -> Column:
        at = 4 * block_of(key, blocks)
        return may_hold(key, [F.get(words, at + i) for i in range(4)])

    rows = rows.withColumn("maybe", F.filter(keys, possible))
    hits = rows.where(F.size("maybe") > 0).groupBy("host", "path").agg(F.first("maybe").alias("maybe"), F.count("*").alias("copies"))
    exact = hits.select("host", "path", "copies", F.explode("maybe").alias("key")).join(clean.select("key", "kind", "verdict", F.col("host").alias("h"), F.col("path").alias("p")), "key")
    is_rule = F.col("kind") == "r"
    best = F.max_by(F.when(is_rule, F.struct(F.concat("h", "p").alias("rule"), "verdict")), F.when(is_rule, F.struct(F.length("h") + F.length("p"), F.length("h"))))
    judged = exact.groupBy("host", "path").agg(F.first("copies").alias("copies"), best.alias("best"), F.max(~is_rule).alias("listed"))
    judged = judged.select("host", "path", "copies", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"), "listed")
    out = join_counted(rows.where(F.size("maybe") > 0).drop("maybe").withColumn("deal", F.xxhash64(*[f"in__{i}" for i in range(len(pages.columns))])), judged, ["host", "path"], "copies", "deal").drop("deal")
    none = rows.where(F.size("maybe") == 0).drop("maybe").withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string"), "listed": F.lit(False)})
    out = out.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(none)
    return out.select(*shown(pages.columns, RESULTS), *RESULTS)


def rule_table(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    rows = [*rules, *[(u.partition("/")[0], "/" + u.partition("/")[2], None) for u in listed]]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, rule_table(spark))
    verdict = F.coalesce("rule_verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


OP7_SQL = f"""
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split0 AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
split AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS canonical, CASE WHEN path = '' THEN '/' ELSE path END AS whole FROM split0),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
listed(h, p) AS (VALUES {", ".join(str((u.partition("/")[0], "/" + u.partition("/")[2])) for u in LISTED)}),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
hit AS (SELECT DISTINCT page_id FROM split JOIN listed ON (canonical = h OR ends_with(canonical, '.' || h)) AND starts_with(whole, p))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, hit.page_id IS NOT NULL AS listed
FROM split LEFT JOIN best USING (page_id) LEFT JOIN hit USING (page_id)
"""
