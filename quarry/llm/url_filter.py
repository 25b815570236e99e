"""URL filters by a Bloom filter cascade over the corpus's complete key universe.

A rule is (host, path prefix). It fits its host and every subdomain when the url's path starts with the rule's
path; the longest rule wins. Every url has a few candidate keys: its host's suffixes with as many labels as some
rule's host, joined to its path's prefixes as long as some rule's path. Rules fit exactly the urls that have the
rule's string as a candidate key, so a verdict needs only exact membership of candidate keys.

Level 0 of a cascade encodes the listed keys, level 1 the unlisted keys of the corpus that level 0 takes for
listed, level 2 the listed keys that level 1 takes for unlisted, and so on until a level has nothing to encode.
For keys of that universe the cascade is exact. The filters' size depends on the number of rules only (times the
logarithm of the number of keys), so they travel inside the plan: no join, and no Python on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lower_ascii

MAX_BITS = 1 << 23  # of one level; 131,072 words at most travel to the driver and into the plan
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    verdict: str  # "block" or "allow"
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or end, A-Z lower-cased; empty without :// or for null."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or end; empty without :// or for null."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """All strings that a rule fitting this url can have, given the rules' label counts and path lengths."""
    labels = F.split(host, r"\.")
    keys = []
    for n in sorted({r.host.count(".") + 1 for r in rules}):
        suffix = F.array_join(F.slice(labels, -n, n), ".")
        for m in sorted({len(r.path) for r in rules}):
            keys.append(F.when((F.size(labels) >= n) & (F.length(path) >= m), F.concat(suffix, F.substring(path, 1, m))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(seed))
    a, b = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    return [(a + b * F.lit(i)) % F.lit(bits) for i in range(hashes)]


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the n keys in column `key`, by a distributed bit_or of its words."""
    bits = min(MAX_BITS, max(64, 64 * math.ceil(n * -math.log2(rate) / math.log(2) / 64)))
    hashes = max(1, round(-math.log2(rate)))
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p"))
    rows = (
        pos.groupBy(F.expr("p div 64").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("word")).collect()
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["word"]
    return Level(tuple(words), bits, hashes, seed)


def passes(key: Column, level: Level) -> Column:
    words = F.array(*[F.lit(w).cast("bigint") for w in level.words]) if len(level.words) < 64 else F.from_json(
        F.lit(str(list(level.words))), "array<bigint>")
    hit = F.lit(True)
    for p in _positions(key, level.bits, level.hashes, level.seed):
        hit = hit & (F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)
    return hit


def _listed(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))


def build_cascade(spark: SparkSession, listed: list[str], universe: DataFrame, n_universe: int) -> list[Level]:
    """Levels for the listed keys against `universe` (distinct column `key`), exact for all its keys."""
    if not listed:
        return []
    inside, outside = _listed(spark, listed), universe.where(~F.col("key").isin(listed))
    n = len(listed)
    rate = min(0.5, math.sqrt(0.5) * n / max(1, n_universe))
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade did not end: raise MAX_BITS")
        side = inside if len(levels) % 2 == 0 else outside
        level = build_level(side, n, rate, seed=1000 + len(levels))
        levels.append(level)
        if len(levels) % 2:
            outside = outside.where(passes(F.col("key"), level))
            n = outside.count()
        else:
            inside = inside.where(passes(F.col("key"), level))
            n = inside.count()
        rate = 0.5
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Exact membership for keys of the universe that the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(passes(key, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages; unmatched urls get `allow`, which is what a key
    outside the block cascade means.

    Null urls and urls without :// have empty host and path. Repeated rows and null ids stay, each judged by
    itself. A key listed with both verdicts counts as block; of two rules of equal length that both fit, the one whose
    string sorts last wins. Urls of any length are read whole; an empty table gives no rows. Other columns of pages are
    ignored.
    """
    if any(r.verdict not in ("block", "allow") for r in rules):
        raise ValueError("a rule's verdict is block or allow")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = base.select("id", host.alias("host"), path.alias("path"))
    if not rules:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keyed = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    scratch = Scratch(spark, "url-keys")
    universe = scratch.keep(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    n = universe.count()
    block = sorted({r.key for r in rules if r.verdict == "block"})
    allow = sorted({r.key for r in rules if r.verdict == "allow"} - set(block))
    blocked, allowed = (build_cascade(spark, keys, universe, n) for keys in (block, allow))
    scratch.drop(universe)
    judged = F.transform("keys", lambda k: F.struct(
        F.length(k).alias("n"), k.alias("key"),
        F.when(member(k, blocked), F.lit("block")).when(member(k, allowed), F.lit("allow")).alias("verdict")))
    best = F.array_max(F.filter(judged, lambda x: x["verdict"].isNotNull()))
    return keyed.withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"))
