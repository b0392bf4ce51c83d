"""A trie of conversation prefixes: how many conversations share each, and what storing a prefix once would save.

Turns are numbered by one range sort over all conversations, so that a very long one is no task of its own. The digest of
a prefix is a sum of hashes of its turns and their places: sums over blocks of turns are added up, then those before a
block. Nodes are digests; an edge leads from each to the digest without its last turn. Leaves and savings go up by pointer
jumping: in round k a node hands what its subtree holds within 2^k edges to the node 2^k above, and then points to the one
that that points to, so the rounds are the logarithm of the greatest depth. Pointers that very many share are joined by a
broadcast of at most ``HOT`` rows.

Defined results: rows with a null conv_id belong to no conversation and are left out; turns of one number are put in the
order of a hash of role and text, repeated rows each count; null roles and texts are empty; no rows give no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm._shared import checkpointed, in_small_batches

#: Conversations are rebuilt upon the first of each so many ids, with fewer than ``HEADS`` of its turns.
SHARED, HEADS = 100, 6
#: Turns whose hashes are added up in one window.
BLOCK = 4096
#: Ids in a piece of a list of members.
PIECE = 8192
#: Pointers that more than one node in so many has; there are fewer than this.
HOT = 500

_LANES = ("a", "b", "c", "d")
#: The part of a row numbered by monotonically_increasing_id.
_PART = "shiftright(_at, 33)"


def _node(depth: Column, lanes: list[Column]) -> Column:
    """The digest of a prefix, from its depth and the sums of its turns' hashes."""
    return F.unhex(F.md5(F.concat_ws(",", depth, *lanes).cast("binary")))


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, idx (from 0), hash, chars, n (turns of the conversation), head (turns taken from the first of its hundred), skip (its own turns that these replace)."""
    said = F.concat(F.char_length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")
    plain = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    small = plain.select("conv_id", "turn", F.md5(said).alias("hash"), F.char_length("text").cast("long").alias("chars"))
    cut = checkpointed(small.orderBy("conv_id", F.col("turn").asc_nulls_first(), "hash").withColumn("_at", F.monotonically_increasing_id())).withColumn("part", F.expr(_PART))
    parts = cut.groupBy("conv_id", "part").agg(F.min("_at").alias("first"), F.count("*").alias("m"))
    ids = conversations(parts.groupBy("conv_id").agg(F.sum("m").alias("n")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    begun = parts.withColumn("begins", F.coalesce(F.sum("m").over(before), F.lit(0))).join(ids, "conv_id")
    out = cut.join(begun.select("conv_id", "part", "first", "begins", "n", "head", "skip"), ["conv_id", "part"])
    return out.select("conv_id", (F.col("_at") - F.col("first") + F.col("begins")).alias("idx"), "hash", "chars", "n", "head", "skip")


def conversations(sizes: DataFrame) -> DataFrame:
    """conv_id, n, skip, head of rows of (conv_id, n)."""
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    known = sizes.select("conv_id", "n", skip.alias("skip"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"))
    return known.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv_id", "n", "skip", F.least("skip", F.coalesce("base_n", F.lit(0))).alias("head"), "base")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of all conversations, and their turns: conv_id, depth (from 1), hash, chars, length."""
    rows = checkpointed(numbered(turns))
    length = (F.col("head") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))).alias("length")
    first = rows.where("idx = 0")
    own = rows.where("idx >= skip").select("conv_id", (F.col("head") + F.col("idx") - F.col("skip") + 1).alias("depth"), "hash", "chars", length)
    heads = rows.where((F.col("conv_id") % SHARED == 0) & (F.col("idx") < HEADS - 1)).select(F.col("conv_id").alias("base"), "idx", "hash", "chars")
    taken = first.where("head > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).select("conv_id", "base", "head", length).join(heads, "base").where("idx < head")
    return first.select("conv_id", length), own.unionByName(taken.select("conv_id", (F.col("idx") + 1).alias("depth"), "hash", "chars", "length"))


def prefixes(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """node, parent, conv_id, depth, chars, length: each conversation's prefixes, the empty one included."""
    two = [F.xxhash64("depth", "hash"), F.xxhash64("hash", F.lit(20240229), "depth")]
    lanes = [x for t in two for x in (F.shiftrightunsigned(t, 32), t.bitwiseAND(0xFFFFFFFF))]  # sums of these cannot overflow
    rows = turns.withColumn("block", F.expr(f"(depth - 1) DIV {BLOCK}")).withColumns({c: x for c, x in zip(_LANES, lanes, strict=True)})
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    summed = rows.withColumns({f"s{c}": F.sum(c).over(inside) for c in _LANES})
    blocks = rows.groupBy("conv_id", "block").agg(*(F.sum(c).alias(f"t{c}") for c in _LANES))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    later = blocks.withColumns({f"t{c}": F.sum(f"t{c}").over(before) for c in _LANES}).where("block > 0")
    whole = summed.join(later, ["conv_id", "block"], "left").withColumns({f"s{c}": F.col(f"s{c}") + F.coalesce(f"t{c}", F.lit(0)) for c in _LANES})
    sums = [F.col(f"s{c}") for c in _LANES]
    out = whole.select(_node(F.col("depth"), sums).alias("node"), _node(F.col("depth") - 1, [s - F.col(c) for s, c in zip(sums, _LANES, strict=True)]).alias("parent"), "conv_id", "depth", "chars", "length")
    none = F.lit(0).cast("long")
    roots = ids.select(_node(none, [none] * 4).alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", none.alias("depth"), none.alias("chars"), "length")
    return out.unionByName(roots)


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: of the comma-joined conv_ids of each node's rows, in rising order. Lists go through in pieces, so none is held whole."""
    cut = checkpointed(ends.select("node", "conv_id").orderBy("node", "conv_id").withColumn("_at", F.monotonically_increasing_id()))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = cut.groupBy("node", F.expr(_PART).alias("part"), F.expr(f"(_at & 8589934591) DIV {PIECE}").alias("piece")).agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()
        done: list[tuple[bytes, str]] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
            done.clear()
            return batch

        for batch in batches:
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == current:
                    state.update(b",")
                else:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = node, hashlib.sha256()
                state.update(ids.encode())
                if len(done) >= 4096:
                    yield out()
        if current is not None:
            done.append((current, state.hexdigest()))
        if done:
            yield out()

    dealt = in_small_batches(pieces).repartition("node").sortWithinPartitions("node", "part", "piece").select("node", "ids")
    return dealt.mapInArrow(run, "node binary, ends_sha256 string")


def _followed(rows: DataFrame, pointed: DataFrame, bound: int) -> DataFrame:
    """``rows`` with the columns of ``pointed`` (one row a node, ``ptr``; n: how many point to it) in place of their pointer; rows that point to none of these go."""
    facts = [c for c in pointed.columns if c != "n"]
    hot = pointed.where(F.col("n") > bound).select(facts)  # fewer than HOT rows
    if hot.isEmpty():
        return rows.join(pointed.select(facts), "ptr").drop("ptr")
    rest = rows.join(F.broadcast(hot.select("ptr")), "ptr", "left_anti").join(pointed.where(F.col("n") <= bound).select(facts), "ptr")
    return rows.join(F.broadcast(hot), "ptr").unionByName(rest).drop("ptr")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """Adds n_children, parent_conv_id, n_leaves and saved_tokens to checkpointed rows of (node, parent, conv_id, depth, chars, n_convs).

    A round has the nodes that are deep enough to hand something up, and gives what others gain by it.
    """
    size, deepest = nodes.agg(F.count("*"), F.max("depth")).head()
    bound = max(1000, size // HOT)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = checkpointed(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    parents = known.where("n_children > 0").select(F.col("node").alias("ptr"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = _followed(known.where("parent IS NOT NULL").withColumnRenamed("parent", "ptr"), parents, bound)
    named = known.where("parent IS NULL").drop("parent").withColumn("parent_conv_id", F.lit(None).cast("long")).unionByName(below)

    own = [(F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")]
    gains = [known.select("node", *own)]
    active = known.where("parent IS NOT NULL").select("node", F.col("parent").alias("ptr"), *own)
    reach = 1
    while reach <= (deepest or 0):
        sums = active.groupBy("ptr").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        gained = checkpointed(sums.join(active.select(F.col("node").alias("ptr"), F.col("ptr").alias("next")), "ptr", "left"))
        gains.append(gained.select(F.col("ptr").alias("node"), "n_leaves", "saved_tokens"))
        reach *= 2
        if reach <= deepest:
            more = gained.select(F.col("ptr").alias("node"), F.col("n_leaves").alias("_leaves"), F.col("saved_tokens").alias("_saved"))
            moved = _followed(active, gained.where("next IS NOT NULL").select("ptr", "next", "n"), bound).withColumnRenamed("next", "ptr").join(more, "node", "left")
            active = checkpointed(moved.select("node", "ptr", (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens")))
    total = reduce(DataFrame.unionByName, gains).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return named.join(total, "node")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    members = checkpointed(prefixes(*rebuilt(turns)))
    grouped = members.groupBy("node").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.count("*").alias("n_convs"))
    out = rolled_up(checkpointed(grouped)).join(ends_digests(members.where("depth = length")), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
