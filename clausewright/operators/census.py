"""Counts by domain, zero members included."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.vocab import DOMAINS


def census(rows: DataFrame, codes: Column, members: Sequence[str], no_value: bool = False) -> DataFrame:
    """code, n: rows of each member, 0 included, and of no value (code null) where there are any, or always with ``no_value``. ``codes``: an array column."""
    spark = rows.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*map(F.lit, members))).alias("_rank", "code"))
    counts = rows.select(F.explode_outer(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    known = listed.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    none = counts.where("code IS NULL").select("code", "n")
    if no_value:
        none = none.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(None).cast("string").alias("code"), "n")
    return known.unionByName(none)


def or_none(codes: Column) -> Column:
    """An array of codes; one null where there are none, so that the row counts as one without a value."""
    return F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, codes).otherwise(F.array(F.lit(None).cast("string")))


def census_all(rows: DataFrame, domains: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """domain, code, n for every member of every domain, 0 included, and of no value (code null) for each domain: one pass over the rows and one sum.

    ``domains``: name: (codes, members); ``codes``: an array column, whose nulls are counted as no value. Codes that are no members are not counted.
    """
    spark = rows.sparkSession
    listed = spark.createDataFrame([(name, code) for name, (_, members) in domains.items() for code in [*members, None]], "domain string, code string")
    one = lambda name, codes: F.transform(codes.cast("array<string>"), lambda c: F.struct(F.lit(name).alias("domain"), c.alias("code")))
    empty = F.array().cast("array<struct<domain:string,code:string>>")
    pairs = rows.select(F.explode(F.concat(*(F.coalesce(one(name, codes), empty) for name, (codes, _) in domains.items()))).alias("p"))
    counts = pairs.groupBy("p.domain", "p.code").agg(F.count("*").alias("n")).withColumnsRenamed({"domain": "_domain", "code": "_code"})
    there = listed.join(counts, (F.col("domain") == F.col("_domain")) & F.col("code").eqNullSafe(F.col("_code")), "left")
    return there.select("domain", "code", F.coalesce("n", F.lit(0)).alias("n"))


def index_census(index: DataFrame) -> DataFrame:
    """domain, code, n of index rows (``entities.index_rows``): entities by their own codes, clauses by theirs. No value: entities without a code of an axis, and clauses without one of theirs; subtypes have none."""
    single = {"cat": "cat", "attr": "attr", "race": "race", "rarity": "rarity", "ot": "region", "ban_o": "ban_o", "ban_t": "ban_t", "ban_m": "ban_m"}
    codes = {name: or_none(F.array_compact(F.array(F.col(c)))) for name, c in single.items()} | {"lm": or_none(F.col("markers"))}
    codes |= {f"sub_{s}": F.when(F.col("cat") == s, F.col("subs")) for s in ("m", "s", "t")}
    codes |= {name: F.col(f"clauses.{c}") for name, c in (("kind", "kind"), ("optional", "opt"), ("role", "role"))}
    return census_all(index, {name: (c, [m.code for m in DOMAINS[name].members]) for name, c in codes.items()})


def bucketed(rows: DataFrame, column: str, missing: str = "null") -> DataFrame:
    """value, n with nulls under a name of their own."""
    return rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias("value")).agg(F.count("*").alias("n"))


def entities_per_kind(clauses: DataFrame, kinds: Sequence[str], shown: Column) -> DataFrame:
    """kind, n: entities with a clause whose ``shown`` kind it is (own types null)."""
    spark = clauses.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    counts = clauses.select("id", shown.alias("kind")).where("kind IS NOT NULL").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    return listed.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n of keys that are not unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def tally(rows: DataFrame, said: Column, wanted: str, excluded: Column) -> DataFrame:
    """outcome, n: how a rule does on rows whose answer is ``wanted``: agree, disagree, or why it says nothing (``excluded``, a reason)."""
    outcome = F.when(said.isNull(), excluded).when(said == wanted, "agree").otherwise("disagree")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def preview(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a list, for a report."""
    return rows.orderBy(*order).limit(n)
