"""URL filters by cascades of Bloom filters that are exact over the corpus's keys. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import col, fresh
from corpusmill.session import materialize

#: A filter is sent to every task. Keys that need a larger one, about ten million, are split by hash into several cascades.
MAX_FILTER_BITS = 1 << 28

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


@dataclass
class Filter:
    """One level: ``words`` is a table of one row that holds the bits, 64 to a word."""

    words: DataFrame
    bits: int
    hashes: int
    salt: int

    def positions(self, key: Column) -> list[Column]:
        h = F.xxhash64(F.lit(self.salt), key)
        low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
        return [(low + F.lit(i).cast("long") * high) % F.lit(self.bits).cast("long") for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        out = F.lit(True)
        for p in self.positions(key):
            out = out & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
        return out


@dataclass
class Cascade:
    """Filters in turn of listed keys, of the universe's keys that pass by mistake, of listed keys that pass that one, and so on."""

    levels: list[Filter] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed; no join."""
        if not self.levels:
            return F.lit(False)
        # past the last level a key belongs to the kind that the level was made of
        out = F.lit((len(self.levels) - 1) % 2 == 0)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return out


@dataclass
class Shares:
    """Cascades over shares of the keys; a key asks only that of its share."""

    cascades: list[Cascade]

    def holds(self, key: Column) -> Column:
        out = F.lit(False)
        for i, cascade in enumerate(self.cascades):
            out = F.when(share_of(key, len(self.cascades)) == i, cascade.holds(key)).otherwise(out)
        return out


def share_of(key: Column, shares: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("share"), key), F.lit(shares))


def filter_size(count: int, wrong: float) -> tuple[int, int]:
    """(bits, hashes) of a filter over so many keys."""
    hashes = max(1, math.ceil(-math.log2(wrong)))
    return max(64, math.ceil(count * hashes / math.log(2) / 64) * 64), hashes


def _filter(keys: DataFrame, count: int, wrong: float, salt: int) -> Filter:
    """A Bloom filter over ``keys`` (key) with a share ``wrong`` of other keys passing."""
    bits, hashes = filter_size(count, wrong)
    made = Filter(keys, bits, hashes, salt)
    at = keys.select(F.explode(F.array(*made.positions(F.col("key")))).alias("p"))
    set_bits = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63).cast("long")).cast("int"))).alias("b"))
    zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("b"))
    whole = set_bits.unionByName(zeros).groupBy("word").agg(F.bit_or("b").alias("b"))
    made.words = materialize(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "b"))), lambda x: x["b"]).alias("words")), "cascade-words")
    return made


def build(listed: DataFrame, universe: DataFrame) -> Cascade | Shares:
    """What tells the keys of ``listed`` (key) exactly among those of ``universe`` (key). Both are sets.

    One cascade, or one for each share of the keys, so that no filter is larger than MAX_FILTER_BITS.
    """
    keys = listed.join(universe, "key", "left_semi")  # a key that no row has can't be asked for
    keys = materialize(keys, "cascade-listed")
    others = universe.join(listed, "key", "left_anti")
    count, rest = keys.count(), universe.count()
    wrong = min(0.5, max(2.0**-30, math.sqrt(0.5) * count / max(1, rest)))
    # Shares differ a little in size.
    shares = math.ceil(1.1 * filter_size(count, wrong)[0] / MAX_FILTER_BITS) if filter_size(count, wrong)[0] > MAX_FILTER_BITS else 1
    if shares == 1:
        return _cascade(keys, others, count, wrong)
    made = []
    for i in range(shares):
        mine, rest_of = (df.where(share_of(F.col("key"), shares) == i) for df in (keys, others))
        made.append(_cascade(mine, rest_of, mine.count(), wrong))
    return Shares(made)


def _cascade(inside: DataFrame, outside: DataFrame, count: int, wrong: float) -> Cascade:
    out, level = Cascade(), 0
    while count:
        made = _filter(inside, count, wrong, level)
        out.levels.append(made)
        passing = materialize(outside.where(made.holds(F.col("key"))), f"cascade-{level}")
        inside, outside = passing, inside
        count, wrong, level = passing.count(), 0.5, level + 1
    return out


def key_shapes(keys: Sequence[tuple[str, str]]) -> list[tuple[int, int]]:
    """The different (labels of the host, characters of the path) of listed keys."""
    return sorted({(host.count(".") + 1, len(path)) for host, path in keys})


def candidate_keys(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys of one url that could be listed: a domain it lies in with the beginning of its path, for each shape."""
    keys = [
        F.when((F.length(path) >= n) & (F.length(host) > 0), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n) if n else F.lit(""))) for labels, n in shapes
    ]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def judged(pages: DataFrame, rules: Sequence[Rule], listed_hosts: DataFrame | None = None) -> DataFrame:
    """The columns of ``pages`` (url) with host, path, rule and verdict.

    The longest rule that fits decides; without one a url is blocked where its
    host lies in a listed domain (``listed_hosts``: column host), and allowed
    else. Urls may be of any length; where two rules have one key block wins. rule is host and path of the rule, null without one. A null url, or
    one without ``://``, has empty host and path, fits nothing and is allowed.
    Repeated urls are judged alike. An empty table gives no rows. Columns of
    these names in ``pages`` are kept under their names; the added ones then
    get an underscore.
    """
    spark = pages.sparkSession
    names = {n: fresh(pages, n) for n in ("host", "path", "rule", "verdict", "_keys", "_hosts")}
    host, path = host_and_path(col("url"))
    rows = pages.withColumns({names["host"]: host, names["path"]: path})
    host, path = col(names["host"]), col(names["path"])
    shapes = key_shapes([(h, p) for _, h, p in rules])
    keys = candidate_keys(host, path, shapes)
    universe = materialize(rows.select(F.explode(keys).alias("key")).distinct(), "cascade-universe")
    fits = {v: build(_keys(spark, [h + p for verdict, h, p in rules if verdict == v]), universe) for v in ("allow", "block")}
    listed = F.lit(False)
    if listed_hosts is not None:
        domains = materialize(listed_hosts.select(col("host").alias("key")).where("key <> ''").distinct(), "cascade-domains")
        depths = [r["n"] for r in domains.select(F.size(F.split("key", r"\.")).alias("n")).distinct().collect()]
        suffixes = candidate_keys(host, F.lit(""), [(n, 0) for n in depths])
        hosts = materialize(rows.select(F.explode(suffixes).alias("key")).distinct(), "cascade-hosts")
        inside = build(domains, hosts)
        for i in range(len(depths)):
            suffix = F.get(suffixes, F.lit(i))
            listed = listed | (suffix.isNotNull() & inside.holds(suffix))
    found = []
    for i in range(len(shapes)):
        key = F.get(keys, F.lit(i))
        for v in ("allow", "block"):
            found.append(F.when(key.isNotNull() & fits[v].holds(key), F.struct(F.length(key).alias("n"), key.alias("key"), F.lit(v).alias("v"))))
    best = F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<n:int,key:string,v:string>")
    out = rows.withColumn(names["_keys"], best)
    verdict = F.coalesce(col(names["_keys"])["v"], F.when(listed, F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumns({names["rule"]: col(names["_keys"])["key"], names["verdict"]: verdict}).drop(names["_keys"])


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string")


# Words of domains that a list of advertisers holds.
SPAM_WORDS = ("cheap", "casino", "pills", "loans")


def spam_domains(pages: DataFrame) -> DataFrame:
    """(host) the domains in ``pages`` (url) of which a label holds one of SPAM_WORDS, from that label on."""
    host, _ = host_and_path(col("url"))
    found = F.regexp_extract(host, r"(?:^|\.)([^.]*(?:" + "|".join(SPAM_WORDS) + r")[^.]*\..*)$", 1)
    return pages.select(found.alias("host")).where("host <> ''").distinct()
