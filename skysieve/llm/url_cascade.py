"""URL filters: exact membership in rule lists with a Bloom filter cascade, in column expressions only.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus that level 1 takes in by mistake,
level 3 the listed keys that level 2 takes in, and so on, until a level makes no mistake over the complete key
universe of the corpus. A key is listed if and only if the first level that refuses it is an even one (or no
level refuses it and their number is odd). Each level is one row with an array of 64-bit words, read through a
scalar subquery, so pages are judged in their scan: no join, no shuffle.

Nulls and odd input: a null url, or one without `://`, has an empty host and path and fits no rule. Null and
empty rules are ignored; a rule listed as both block and allow blocks. Repeated pages are judged row by row, an
empty table gives an empty result, and other columns pass through. A column of the input with the name of an
output column is replaced.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, functions as F

from skysieve.session import materialise

#: Share of other keys that one level may take in by mistake, and its hash functions.
MISTAKES, PROBES = 0.02, 6
#: Bits of one level at most (16 MB); longer lists are judged slice by slice.
LEVEL_BITS = 1 << 27
VERDICTS = ("block", "allow")


def url_part(url: Column, group: int) -> Column:
    """1: host, lower case in A-Z; 2: path. Both are empty without `://`."""
    part = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(part, string.ascii_uppercase, string.ascii_lowercase) if group == 1 else part


def rule_parts(rules: DataFrame) -> DataFrame:
    """Rules as (key, verdict, labels, path_chars): `host/path`, the host in lower case."""
    host = F.translate(F.substring_index("rule", "/", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")
    return (
        rules.where("length(rule) > 0")
        .select(
            F.concat(host, path).alias("key"), "verdict",
            F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("path_chars"),
        )
        .distinct()
    )


def candidates(host: str, path: str, labels: int, path_chars: list[int]) -> Column:
    """All keys that could fit: each host suffix with each path prefix of a length that rules have."""
    suffixes = F.array_distinct(F.expr(f"transform(sequence(1, {labels}), k -> substring_index({host}, '.', -k))"))
    lengths = F.filter(F.array(*[F.lit(n) for n in path_chars]), lambda n: n <= F.length(path))
    keys = F.transform(
        suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(F.col(path), F.lit(1), n)))
    )
    return F.when(F.length(host) > 0, F.flatten(keys)).otherwise(F.array().cast("array<string>"))


def _probe(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits))


def _encode(keys: DataFrame, n: int, level: int) -> tuple[DataFrame, int]:
    """One row with the level's bits, and their number."""
    spark = keys.sparkSession
    words = max(1, math.ceil(-n * math.log(MISTAKES) / math.log(2) ** 2 / 64))
    bits = 64 * words
    probes = keys.select(F.explode(F.array(*[_probe(F.col("key"), level, i, bits) for i in range(PROBES)])).alias("p"))
    one = F.expr("shiftleft(1L, cast(p % 64 as int))")
    set_bits = probes.select(F.expr("p div 64").alias("word"), one.alias("bits"))
    dense = (
        set_bits.unionAll(spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    # at most LEVEL_BITS / 64 words meet here
    row = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bits"))
    return materialise(row, f"cascade-{level}"), bits


def _passes(key: Column, column: str, level: int, bits: int) -> Column:
    found = F.lit(True)
    for i in range(PROBES):
        at = _probe(key, level, i, bits)
        word = F.get(F.col(column), F.shiftright(at, 6).cast("int"))
        found = found & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return found


class Cascade:
    """Exact membership of `listed` keys among the keys of `universe` (both: column `key`, distinct)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, name: str):
        self.levels: list[tuple[DataFrame, int]] = []
        self.name = name
        take = materialise(listed.join(universe, "key", "left_semi"), "cascade-listed")
        mistaken = None
        n = take.count()
        while n:
            self.levels.append(_encode(take, n, len(self.levels) + 1))
            level = len(self.levels)
            row, bits = self.levels[-1]
            rest = universe.join(take, "key", "left_anti") if mistaken is None else mistaken
            took = rest.withColumn("_bits", row.scalar()).where(_passes(F.col("key"), "_bits", level, bits)).select("key")
            # what this level takes in by mistake is what the next one encodes
            take, mistaken = materialise(took, "cascade-mistakes"), take
            n = take.count()

    def carry(self, rows: DataFrame) -> DataFrame:
        """The levels as columns; the optimizer puts them where they are read."""
        return rows.withColumns({f"_{self.name}{i}": row.scalar() for i, (row, _) in enumerate(self.levels, 1)})

    def has(self, key: Column) -> Column:
        listed = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            through = _passes(key, f"_{self.name}{level}", level, self.levels[level - 1][1])
            listed = F.when(through, listed).otherwise(F.lit(level % 2 == 0))
        return listed


def _ranked(verdict: str):
    """A key as a struct whose largest value is the rule that wins."""
    return lambda key: F.struct(
        F.length(key).alias("chars"),
        F.length(F.substring_index(key, "/", 1)).alias("host_chars"),
        F.lit(verdict == "block").alias("blocks"),
        key.alias("key"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Each row of `pages` with host, path, rule (the longest that fits, else null) and verdict.

    `rules` has columns rule (`host/path`; the path may be empty) and verdict (block or allow). A rule fits its
    host and all subdomains if the path starts with its own. Of rules of equal length the longer host wins.
    """
    out = pages.withColumns({"host": url_part(F.col(url), 1), "path": url_part(F.col(url), 2)})
    parts = materialise(rule_parts(rules), "url-rules")
    facts = parts.agg(
        F.count("*").alias("n"), F.max("labels").alias("labels"), F.array_sort(F.collect_set("path_chars")).alias("chars")
    ).first()
    rule = F.lit(None).cast("struct<chars:int,host_chars:int,blocks:boolean,key:string>")
    if facts["n"]:
        keys = candidates("host", "path", facts["labels"], facts["chars"])
        universe = materialise(out.select(F.explode(keys).alias("key")).distinct(), "url-keys")
        slices = math.ceil(facts["n"] * -math.log(MISTAKES) / math.log(2) ** 2 / LEVEL_BITS)
        found = []
        out = out.withColumn("_keys", keys)
        for s in range(slices):
            for verdict in VERDICTS:
                mine = parts.where((F.col("verdict") == verdict) & (F.pmod(F.xxhash64("key"), F.lit(slices)) == s))
                cascade = Cascade(mine.select("key"), universe, f"{verdict}{s}_")
                out = cascade.carry(out)
                found.append(F.transform(F.filter("_keys", cascade.has), _ranked(verdict)))
        rule = F.array_max(F.concat(*found))
    verdict = F.when(rule["blocks"], "block").when(~rule["blocks"], "allow").otherwise(default)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*kept, "host", "path", rule["key"].alias("rule"), verdict.alias("verdict"))
