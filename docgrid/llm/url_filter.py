"""URL verdicts from a rule list: blocked Bloom filter, then an exact hash join.

A rule is a host and the beginning of a path. For a URL, each parent domain of its
host with each beginning of its path (of the lengths that occur in rules) is a
possible listed key. The keys go past a Bloom filter whose blocks are 256 bits
wide; one lookup by block number decides, and only possible hits reach the exact
join with the rules, which removes the false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
#: Filter and rules are broadcast up to so many rows, else joined by a shuffle.
BROADCAST_ROWS = 200_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    rest = F.when(F.position(F.lit("://"), url) > 0, F.substring(url, F.position(F.lit("://"), url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _marks(blocks: int) -> list[Column]:
    """Block number of a key (host, path), and one bit in each of the block's four words."""
    bits = F.xxhash64(F.lit(1), "key_host", "key_path")
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)]
    return [F.pmod(F.xxhash64("key_host", "key_path"), F.lit(blocks)).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter: block, f0..f3 (64 bits each), blocks without keys left out."""
    marked = keys.select(*_marks(blocks))
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"f{i}") for i in range(4)])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url).

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the
    path begins with the rule's; the longest (host and path together, then host)
    wins; repeated rules count once, and of two verdicts for one rule the later in the
    alphabet, block, wins. Where none fits, rule is null and the verdict
    ``default``. Null and malformed urls have empty host and path. Repeated pages each
    give a row; other columns are ignored; empty tables give no rows, or defaults."""
    rules = rules.select(F.coalesce(F.translate("host", UPPER, LOWER), F.lit("")).alias("key_host"), F.coalesce("path", F.lit("")).alias("key_path"), "verdict")
    rules = rules.groupBy("key_host", "key_path").agg(F.max("verdict").alias("verdict"))
    facts = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("key_path")).alias("lengths")).first()  # lengths: a few numbers
    n, lengths = facts["n"], sorted(facts["lengths"])
    host, path = host_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not n:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = max(1, math.ceil(n * BITS_PER_KEY / 256))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("path"))
    keys = F.flatten(F.transform(parents, lambda h: F.transform(cuts, lambda k: F.struct(h.alias("key_host"), F.substring(F.col("path"), F.lit(1), k).alias("key_path")))))
    asked = urls.select("host", "path").distinct().select("host", "path", F.inline(keys))
    marked = asked.select("host", "path", "key_host", "key_path", *_marks(blocks))
    hit = F.lit(True)
    for i in range(4):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"f{i}")) != 0)
    possible = marked.join(_small(bloom(rules, blocks), blocks), "block").where(hit).select("host", "path", "key_host", "key_path")
    listed = possible.join(_small(rules, n), ["key_host", "key_path"])
    rule = F.concat("key_host", "key_path")
    best = listed.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("key_host").alias("h"), rule.alias("rule"), "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


SQL = r"""
with rules(h, p, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as pos
  from rest),
met as (
  select pos, h || p as rule, verdict, row_number() over (partition by pos order by length(h || p) desc, length(h) desc) as k
  from parts join rules on (host = h or host like '%.' || h) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join (select * from met where k = 1) using (pos)
"""
