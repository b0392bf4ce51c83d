"""URL filters by a Bloom filter cascade: exact membership over the corpus's key universe, with no join per URL.

Every URL gives a few keys: each host suffix at a label, joined to each path prefix that has the length of some rule's
path. The first level of a cascade holds the listed keys; the second holds the keys of the corpus that pass the first
though they are not listed; the third the listed ones that pass the second; and so on until no key is judged wrongly.
For the keys of the corpus the answer is then exact. Levels are bit arrays made by ``bit_or`` and probed inside the
expression, so a URL is judged in the scan: no join, no shuffle. The keys of the corpus are gathered once, distinct,
into the checkpoint folder. A list that needs more bits than a level may have is split by a hash of the key into
several cascades, so any list is exact; what it costs is the size of the plan, about ten bits a listed key.

Defined results: a null URL or one without ``://`` has an empty host and path and no key, so it is allowed; repeated
rows are judged alike; no rows give no rows; other columns are kept, but for those named host, path, rule and verdict.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


class Cascade:
    """Exact membership of the keys of a universe in a list: one or more parts, by a hash of the key, each a list of levels."""

    #: Levels at most; each holds about a quarter of the one before the last, so this is never reached but by a bug.
    DEEPEST = 64

    def __init__(self, parts: list[list[tuple[list[int], int]]]):
        self.parts = parts

    @staticmethod
    def _places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]

    @staticmethod
    def _size(n: int, rate: float) -> int:
        return max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))

    @classmethod
    def _level(cls, keys: DataFrame, level: int, n: int, rate: float) -> tuple[list[int], int]:
        hashes, bits = max(1, round(-math.log2(rate))), cls._size(n, rate)
        places = keys.select(F.explode(F.array(*cls._places(F.col("key"), level, hashes, bits))).alias("at"))
        words = places.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("set"))
        out = [0] * (bits // 64)
        for row in words.collect():  # at most bits / 64 rows
            out[row["word"]] = row["set"]
        return out, hashes

    @classmethod
    def _passes(cls, key: Column, level: int, held: tuple[list[int], int]) -> Column:
        words, hashes = held

        def test(bits: Column) -> Column:
            hit = F.lit(True)
            for at in cls._places(key, level, hashes, 64 * len(words)):
                hit = hit & (F.getbit(F.get(bits, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
            return hit

        # The level is one literal, bound to a name for all its probes.
        return F.exists(F.array(F.from_json(F.lit(str(words)), "array<bigint>")), test)

    @staticmethod
    def _part(key: Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: it is if the first level that it fails is an even one (from 1), or if it passes all and their number is odd."""
        found = None
        for part, levels in enumerate(self.parts):
            out = F.lit(len(levels) % 2 == 1)
            for level in reversed(range(len(levels))):
                out = F.when(~self._passes(key, level, levels[level]), F.lit(level % 2 == 1)).otherwise(out)
            found = out if found is None else F.when(self._part(key, len(self.parts)) == part, out).otherwise(found)
        return found

    @classmethod
    def over(cls, listed: DataFrame, universe: DataFrame, most_bits: int = 1 << 24) -> Cascade:
        """``listed`` and ``universe`` have a string column key, the universe's distinct. What a level holds is written to the checkpoint folder, never gathered."""
        listed = checkpointed(listed.select("key").where("key IS NOT NULL").distinct())
        n = listed.count()
        if not n:
            return cls([[([0], 1)]])
        rate = min(0.5, max(n, 16) / max(2 * universe.count(), 1))
        parts = -(-cls._size(n, rate) // most_bits)
        out = []
        for part in range(parts):
            mine = [x.where(cls._part(F.col("key"), parts) == part) if parts > 1 else x for x in (listed, universe.select("key"))]
            out.append(cls._levels(*mine, rate))
        return cls(out)

    @classmethod
    def _levels(cls, right: DataFrame, rest: DataFrame, rate: float) -> list[tuple[list[int], int]]:
        n = right.count()
        if not n:
            return [([0], 1)]
        levels = [cls._level(right, 0, n, rate)]
        wrong = checkpointed(rest.where(cls._passes(F.col("key"), 0, levels[0])).join(right, "key", "left_anti"))
        while n := wrong.count():
            level = len(levels)
            if level == cls.DEEPEST:
                raise RuntimeError(f"{n} keys are judged wrongly after {level} levels")
            levels.append(cls._level(wrong, level, n, 0.25))
            right, wrong = wrong, checkpointed(right.where(cls._passes(F.col("key"), level, levels[level])))
        return levels


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def filter_urls(pages: DataFrame, rules: Mapping[str, str], listed_hosts: Sequence[str] | DataFrame = (), url: str = "url", most_bits: int = 1 << 24) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: host and path prefix joined, to allow or block; a rule fits its host and all subdomains if the URL's
    path starts with the rule's, and the longest wins. A URL that no rule fits is blocked if its host or a domain
    above it is in ``listed_hosts``, hosts or a table with a column host. ``most_bits``: of a cascade's first level.
    """
    spark = pages.sparkSession
    host, path = host_and_path(url)
    others = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*others, host.alias("host"), path.alias("path"))
    suffixes = _suffixes(F.col("host"))
    lengths = sorted({len(r) - r.index("/") for r in rules})

    def with_prefix(n: int) -> Column:
        return F.transform(suffixes, lambda s: F.when(F.length("path") >= n, F.concat(s, F.substring("path", 1, n))))

    with_path = [with_prefix(n) for n in lengths]
    keys = F.filter(F.concat(*with_path), lambda k: k.isNotNull()) if with_path else F.array().cast("array<string>")
    # Host suffixes have no slash and rule keys have one, so both kinds are one universe.
    universe = checkpointed(pages.select(F.explode(F.array_distinct(F.concat(suffixes, keys))).alias("key")).distinct())

    def listing(values: Sequence[str] | DataFrame) -> DataFrame:
        if isinstance(values, DataFrame):
            return values.select(F.col("host").alias("key"))
        return spark.range(1).select(F.explode(F.array(*map(F.lit, values)).cast("array<string>")).alias("key"))

    rule_keys, hosts = universe.where(F.instr("key", "/") > 0), universe.where(F.instr("key", "/") == 0)
    lists = {v: Cascade.over(listing([r for r, x in rules.items() if x == v]), rule_keys, most_bits) for v in ("allow", "block")}
    bad = Cascade.over(listing(listed_hosts), hosts, most_bits)

    def marked(found: Column, verdict: str) -> Column:
        return F.transform(found, lambda k: F.struct((-F.length(k)).alias("less"), k.alias("rule"), F.lit(verdict).alias("verdict")))

    def fitting(all_keys: Column) -> Column:
        """The longest rule among the keys, with its verdict."""
        return F.get(F.array_sort(F.concat(*(marked(F.filter(all_keys, c.has), v) for v, c in lists.items()))), 0)

    otherwise = F.when(F.exists(suffixes, bad.has), "block").otherwise("allow")
    found = F.get(F.transform(F.array(keys), fitting), 0)
    judged = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), found.alias("found"), otherwise.alias("otherwise"))
    return judged.select("row.*", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "otherwise").alias("verdict"))
