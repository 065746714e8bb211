"""URL rules by a cascade of Bloom filters, exact for every key the corpus can ask for.

A rule is a host and a path prefix. The keys a URL can ask for are its host and the domains
above it, each followed by the prefixes of its path that are as long as some rule's path. All
such keys of a corpus are its key universe. Level 0 of the cascade encodes the listed keys;
level 1 the universe's keys that level 0 takes for listed though they aren't; level 2 the
listed keys that level 1 takes for those; and so on until a level has no false positives left.
A key is listed if the first level that doesn't know it is an odd one, so membership is exact
over the universe, and a lookup reads a few bits of a literal: no join, no shuffle.

Level 0 is given log2(universe / listed) bits a key and more, so the false positives, and with them
all deeper levels, are about as many as the listed keys. The cascade is bounded by the rules, not the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.llm.common import ascii_lower, free_name

MAX_RULES = 1_000_000


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits, and how many of them each key sets."""

    number: int
    hashes: int
    words: tuple[int, ...]

    @classmethod
    def of(cls, keys: Sequence[str], number: int, false_positives: float) -> Level:
        bits = max(64, math.ceil(len(keys) * math.log(1 / false_positives) / math.log(2) ** 2))
        size, hashes = -(-bits // 64), max(1, round(math.log2(1 / false_positives)))
        words, level = [0] * size, cls(number, hashes, (0,) * size)
        for key in keys:
            for bit in level.bits(key):
                words[bit // 64] |= 1 << (bit % 64)
        return cls(number, hashes, tuple(words))

    def bits(self, key: str) -> list[int]:
        h = xxhash.xxh64_intdigest(f"{self.number}|{key}".encode(), seed=42)
        low, high = h & 0x7FFFFFFF, h >> 33
        return [(low + i * high) % (64 * len(self.words)) for i in range(self.hashes)]

    def knows(self, key: str) -> bool:
        return all(self.words[b // 64] >> (b % 64) & 1 for b in self.bits(key))

    def test(self, key: Column) -> Column:
        """The same question to a column of keys."""
        h = F.xxhash64(F.concat(F.lit(f"{self.number}|"), key))
        low, high = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
        signed = [w - (1 << 64) if w >> 63 else w for w in self.words]
        words = F.array(*[F.lit(w).cast("long") for w in signed]) if len(signed) < 64 else F.lit(signed)
        asked = F.lit(True)
        for i in range(self.hashes):
            bit = F.pmod(low + F.lit(i) * high, F.lit(64 * len(self.words)))
            word = F.get(words, F.shiftright(bit, 6).cast("int"))
            asked = asked & (F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return asked


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(~level.test(key), F.lit(level.number % 2 == 1)).otherwise(answer)
        return answer

    @classmethod
    def of(cls, listed: Sequence[str], universe: DataFrame, key: str) -> Cascade:
        """The cascade for ``listed`` over the keys of ``universe``, column ``key``, repeats allowed.

        The keys that level 0 takes for listed are collected. They are expected to be about as many as the
        listed ones; where a scan finds over four times that, level 0 is built anew with twice the bits.
        """
        listed = sorted(set(listed))
        if not listed:
            return cls(())
        size = max(1, universe.agg(F.approx_count_distinct(key)).first()[0])
        wrong, most = min(0.5, len(listed) / (math.sqrt(2) * size)), 4 * len(listed) + 1000
        known = universe.sparkSession.createDataFrame([(k,) for k in listed], f"{key} string")
        while True:
            first = Level.of(listed, 0, wrong)
            strays = universe.filter(first.test(F.col(key))).select(key).distinct().join(known, key, "left_anti")
            found = [r[0] for r in strays.limit(most + 1).collect()]
            if len(found) <= most:
                return cls(deepened(listed, found, first))
            wrong = wrong * wrong


def deepened(listed: list[str], strays: list[str], first: Level) -> tuple[Level, ...]:
    """Level 0 and the ones that follow, alternating, until nothing is mistaken."""
    levels, inside, outside = [first], listed, sorted(strays)
    while outside:
        level = Level.of(outside, len(levels), 0.5)
        levels.append(level)
        inside, outside = outside, [k for k in inside if level.knows(k)]
    return tuple(levels)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``."""
    host = ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """The keys a URL can ask for, longest first, ties to the longer host."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    heads = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)])
    heads = F.filter(heads, lambda p: p.isNotNull())
    keys = F.flatten(F.transform(domains, lambda d: F.transform(heads, lambda p: F.concat(d, p))))
    ranked = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), F.instr(F.concat(k, F.lit("/")), "/").alias("h"), k.alias("k")))
    ordered = F.array_sort(F.transform(ranked, lambda r: F.struct(r["n"].alias("n"), (-r["h"]).alias("h"), r["k"].alias("k"))))
    return F.when(host != "", F.transform(ordered, lambda r: r["k"])).otherwise(F.array().cast("array<string>"))


def judge(df: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule and verdict; columns of these names are replaced.

    ``rule`` is the longest that fits (its host is the URL's or a domain above it, and the URL's path
    starts with its path), else null. ``verdict`` is the rule's action; a URL that no rule fits is
    not listed and allowed. Null URLs and those without ``://`` have empty host and path and are allowed.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the cascade is sent with the plan and made for {MAX_RULES} at most")
    actions = {r.key: r.action for r in rules}
    df = df.drop("host", "path", "rule", "verdict")
    wanted = free_name(df, "_keys")
    host, path = parts(F.col(url))
    asked = df.withColumns({"host": host, "path": path})
    keys = candidates(F.col("host"), F.col("path"), sorted({len(r.path) for r in rules}))
    universe = asked.select(F.explode(keys).alias("key"))
    listed = Cascade.of(list(actions), universe, "key")
    ruled = df.sparkSession.createDataFrame([(k,) for k in sorted(actions)], "key string")
    blocked = Cascade.of([k for k, a in actions.items() if a == "block"], ruled, "key")
    asked = asked.withColumn(wanted, keys)
    rule = F.get(F.filter(F.col(wanted), listed.holds), F.lit(0))
    asked = asked.withColumn("rule", rule).drop(wanted)
    return asked.withColumn("verdict", F.when(F.col("rule").isNotNull() & blocked.holds(F.col("rule")), "block").otherwise("allow"))
