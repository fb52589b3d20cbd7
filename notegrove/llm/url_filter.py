"""URL filters: rules on host and path, then exact membership in a list of hosts by a cascade of Bloom filters.

Level 1 encodes the listed keys; level 2 those keys of the universe that level 1 takes for listed wrongly; level 3 the
listed ones that level 2 takes for such; and so on until none is left. A key of the universe is listed exactly if the
first level that misses it is an even one, or none misses it and their number is odd. The filters are constants of the
projection: nothing is joined, and nothing runs in Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Wrong hits of each level after the first.
LATER = 1 / 8
#: Bits of one level that are sent to all tasks (8 MiB). A list that needs more is cut into shards by a hash of the key, each
#: with a cascade of its own.
MOST_BITS = 1 << 26


@dataclass(frozen=True)
class Level:
    """One Bloom filter: a table of one row with its bits in 64-bit words."""

    table: DataFrame
    bits: int
    seeds: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(self.bits)) for seed in self.seeds]

    def has(self, key: Column) -> Column:
        words = self.table.scalar()
        tests = [
            F.call_function("shiftright", F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
            for p in self.positions(key)
        ]
        return reduce(lambda a, b: a & b, tests)


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no `://`."""
    text, pattern = F.col(url).cast("string"), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(text, pattern, 2), F.lit(""))


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and by_rule (its verdict)."""
    host, path = parts(url)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        rule, verdict = F.when(r.fits(), r.name).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(verdict)
    split = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    return split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))


def _size(n: int, wrong: float) -> tuple[int, int]:
    """Bits and hashes of a filter of n keys with that share of wrong hits."""
    hashes = max(1, round(math.log2(1 / wrong)))
    return max(64, 64 * math.ceil(n * hashes / math.log(2) / 64)), hashes


def _built(keys: DataFrame, n: int, wrong: float, first_seed: int) -> Level:
    bits, hashes = _size(n, wrong)
    empty = Level(keys, bits, tuple(range(first_seed, first_seed + hashes)))
    at = keys.select(F.explode(F.array(*empty.positions(F.col("host")))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    set_bits = at.select(F.shiftright("at", 6).alias("word"), bit.alias("bits"))
    all_words = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = set_bits.unionByName(all_words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits").alias("words"))
    return Level(written(row, "bloom-level"), bits, empty.seeds)


def _first_wrong(listed_keys: int, others: int) -> float:
    """Wrong hits of the first level: as many as there are listed keys, or so."""
    return min(0.5, max(1e-6, listed_keys / max(1, others) / math.sqrt(2)))


def sizes(universe: DataFrame) -> tuple[int, int]:
    """Listed keys and others."""
    found = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    return found.get(True, 0), found.get(False, 0)


def shards(listed_keys: int, others: int) -> int:
    """So many parts, by a hash, keep the first level within MOST_BITS in each; later ones are smaller."""
    bits, _ = _size(listed_keys, _first_wrong(listed_keys, others))
    return 1 if bits <= MOST_BITS else math.ceil(1.1 * bits / MOST_BITS)


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for the universe, a table of distinct host and listed, until no key is taken wrongly."""
    listed_keys, others = sizes(universe)
    levels: list[Level] = []
    while True:
        left = universe.filter(F.col("listed") if len(levels) % 2 == 0 else ~F.col("listed"))
        left = reduce(lambda rows, level: rows.filter(level.has(F.col("host"))), levels, left)
        n = left.count() if levels else listed_keys
        if n == 0:
            return levels
        levels.append(_built(left, n, LATER if levels else _first_wrong(listed_keys, others), 64 * len(levels)))


def listed(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for k, level in reversed([*enumerate(levels, 1)]):
        out = F.when(~level.has(key), F.lit(k % 2 == 0)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", blocked_hosts: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. Where no rule fits, pages of blocked_hosts (column host) are
    blocked and the rest are allowed; by default a host is listed once a rule blocks one of its pages. Null urls and
    urls without `://` have an empty host, which is a key like others. Other columns are ignored; repeated rows give
    repeated rows."""
    found = ruled(pages, rules, url)
    if blocked_hosts is None:
        universe = found.groupBy("host").agg(F.max(F.coalesce(F.col("by_rule") == "block", F.lit(False))).alias("listed"))
    else:
        marked = blocked_hosts.select("host", F.lit(True).alias("listed")).unionByName(found.select("host", F.lit(False).alias("listed")))
        universe = marked.groupBy("host").agg(F.max("listed").alias("listed"))
    universe = written(universe, "url-hosts")
    n = shards(*sizes(universe))
    if n == 1:
        return _judged(found, cascade(universe))
    shard = F.pmod(F.xxhash64("host", F.lit(-1)), F.lit(n))
    found, universe = (written(rows.withColumn("shard", shard), "url-shards") for rows in (found, universe))
    parts = [_judged(found.filter(F.col("shard") == k), cascade(universe.filter(F.col("shard") == k).drop("shard"))) for k in range(n)]
    return reduce(DataFrame.unionByName, parts)


def _judged(found: DataFrame, levels: list[Level]) -> DataFrame:
    method = F.when(listed(levels, F.col("host")), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"))


ORACLE_SQL = r"""
with split as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
ruled as (
  select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule
  from split),
judged as (
  select *, case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' when rule is not null then 'allow' end as by_rule from ruled)
select page_id, host, path, rule,
  coalesce(by_rule, case when host in (select host from judged where by_rule = 'block') then 'block' else 'allow' end) as verdict
from judged
"""
