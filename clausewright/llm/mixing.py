"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Token counts per source give targets; blocks of equal size go to the sources by highest quotients
target / (2 seats + 1), then within a source to its groups of ``GROUP`` shards, and within a group to its shards, by
their tokens, so no ranking sees more than the sources, or the groups of one, or the shards of a group. In a shard,
documents lie in a seeded order; whole passes and then one run of blocks from a seeded place are taken. All of it is
built-in functions: text is read once, and what is shuffled is a row of numbers for each document.

Defined results: a null text has size 0 and nothing is taken of it; a null source is a source of its own, last in
order; repeated rows and rows that share a doc_id or have none are mixed as rows of their own; no documents give no
rows; other columns are ignored, and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm._shared import checkpointed, word_count


def sainte_lague(items: DataFrame, keys: Sequence[str], order: Sequence[str], seats: str, weight: str, out: str) -> DataFrame:
    """``items`` with their seats in ``out``: in each group of ``keys``, which shares ``seats``, the highest quotients weight / (2 k + 1) get one each; ties go by ``order``.

    Quotients above a level that at most ``seats`` of them reach are counted in closed form, so only about two rows for
    each item are ranked, whatever the number of seats. Items of weight 0 get no seat.
    """
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    known = items.columns
    n, w = F.count(F.when(F.col(weight) > 0, 1)).over(by), F.sum(weight).over(by)
    level = F.greatest(F.lit(0.0), F.try_divide(F.col(seats) - n / 2, w))
    based = items.withColumn("_base", F.when(F.col(weight) > 0, F.floor(level * F.col(weight) + 0.5)).otherwise(0).cast("long")).withColumn(
        "_more", F.when(F.col(weight) > 0, F.ceil(n * F.try_divide(F.col(weight), w)) + 1).otherwise(0).cast("int")
    )
    spread = based.withColumn("_rest", F.col(seats) - F.sum("_base").over(by)).withColumn("_k", F.explode(F.sequence(F.lit(0), "_more")))
    quotient = F.col(weight) / (2 * (F.col("_base") + F.col("_k")) + 1)
    ranked = spread.withColumn("_rank", F.row_number().over(by.orderBy(quotient.desc(), *order)))
    won = F.sum(F.when((F.col("_rank") <= F.col("_rest")) & (F.col(weight) > 0), 1).otherwise(0))
    return ranked.groupBy(*known, "_base").agg(won.alias("_won")).select(*known, (F.col("_base") + F.col("_won")).cast("long").alias(out))


def _drawn(*parts: Column | int) -> Column:
    """28 seeded bits; md5, as other engines have it too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("-")) for p in parts))), 1, 7), 16, 10).cast("long")


#: Shards of a group at most, and documents of a shard, about.
GROUP, SHARD_DOCS = 1024, 1 << 16


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target (double, the source's), blocks (the shard's quota), taken (words, repeats counted).

    Sources by code point, null last, have ``weights`` in turn and share ``share`` times all sizes; a target stops at
    ``repeats`` times its source's size, and what is over is shared again by weight. A source is cut into shards of
    about ``shard_words`` words, so a hot source is many groups and none grows with the input.
    """
    return _mixed(docs, **settings).drop("text_hash")


def _mixed(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 17, block: int = 64, shard_words: int = 1 << 18
) -> DataFrame:
    docs = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_hash"))
    docs = checkpointed(docs)
    ranked = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    first = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.get(turn, F.pmod(F.row_number().over(first) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", (repeats * F.col("source_size")).cast("double")).withColumn("stop", F.col("cap") / F.col("weight"))
    rising = Window.partitionBy(F.lit(0)).orderBy("stop", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    words = share * F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("words", words).withColumn("level", (words - capped) / free)
    level = F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everything)
    ranked = ranked.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))))
    ranked = ranked.withColumn("blocks", F.round(F.sum("target").over(everything) / block).cast("long"))
    sources = sainte_lague(ranked.select("source", "source_size", "source_docs", "target", "blocks"), [], [F.col("source").asc_nulls_last()], "blocks", "target", "source_blocks")
    sources = checkpointed(sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_docs") / SHARD_DOCS)).cast("long")))

    named = sources.withColumnRenamed("source", "_source")
    rows = docs.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "blocks", "source_docs")
    # Rows without doc_id are told apart by their texts.
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("text_hash").cast("string")))
    rows = rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), ident))).withColumn("shard", F.pmod(_drawn(F.lit(seed + 1), ident), F.col("shards")))
    shards = rows.groupBy("source", "source_blocks", "shard").agg(F.sum("size").alias("shard_size"))
    shards = checkpointed(shards.withColumn("group", F.floor(F.col("shard") / GROUP)))
    groups = shards.groupBy("source", "source_blocks", "group").agg(F.sum("shard_size").alias("group_size"))
    groups = sainte_lague(groups, ["source", "source_blocks"], ["group"], "source_blocks", "group_size", "group_blocks")
    groups = groups.select(F.col("source").alias("_source"), F.col("group").alias("_group"), "group_blocks")
    shards = shards.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("group") == F.col("_group"))).drop("_source", "_group")
    shards = sainte_lague(shards, ["source", "group", "group_blocks"], ["shard"], "group_blocks", "shard_size", "blocks")
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "blocks")
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")

    line = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size", "text_hash")
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    some = F.greatest(F.col("shard_size"), F.lit(1))
    quota = F.least(F.col("blocks") * block, repeats * F.col("shard_size"))
    rows = rows.withColumn("passes", F.floor(quota / some)).withColumn("rest", quota - F.col("passes") * F.col("shard_size"))
    start = F.pmod(_drawn(F.lit(seed + 2), F.col("source"), F.col("shard")), some)
    rows = rows.withColumn("start", start - F.pmod(start, F.lit(block)))

    def inside(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a))

    end = F.col("start") + F.col("rest")
    taken = F.col("passes") * F.col("size") + inside(F.col("start"), end) + inside(F.lit(0), end - F.col("shard_size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "blocks", taken.cast("long").alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix has them: a row for each whole time that the mix takes a document, to the nearest; documents that it takes less than half of go, empty ones stay once.

    Rows with one doc_id and text are interchangeable: they come as often as they are taken together.
    """
    mixed = _mixed(docs, **settings)
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))).cast("int")
    times = mixed.select(F.struct("doc_id", "text_hash").alias("key"), times.alias("times")).groupBy("key").agg(F.sum("times").cast("int").alias("times"), F.count("*").alias("held"))
    times = checkpointed(times.where("times > 0"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key")).join(times, "key")
    if not times.where("held > 1").isEmpty():
        several = rows.where("held > 1").groupBy("key", "times").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        rows = rows.where("held = 1").select("row", "times").unionByName(several.select("row", "times"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
