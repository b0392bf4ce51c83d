"""A Merkle manifest of a dataset: leaf hashes by document, a tree for each source, a tree over the sources' roots.

Leaves are put in order by one range sort. Each part of it is read as a stream with a mountain-range stack: a node waits on
its level until its run of ``FANOUT`` is whole, whose hash is then carried a level up, so a part of any size leaves only
some nodes a level at its two ends. Those whose runs reach into other parts are merged by Spark, ``BLOCK`` levels at once, and
a source's last run is shorter, without padding. Nodes of every ``BLOCK``-th level are kept; a leaf's proof is made of the
lower levels, from the leaves of its block, and of its block's path, which is made in the same way from the block's own
neighbours. So neither the number of jobs nor the size of their plans grows with each level of a tree.

Defined results: a null doc_id comes first and is not tampered with; rows of one doc_id stand in the order of their leaf
hashes, repeated rows each count; a null source comes first and is none of the others; null fields are hashed as ``-``;
no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm._shared import checkpointed

FANOUT = 3
#: Levels of a block: of those between its nodes and its root none is kept, they are made again.
BLOCK = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_LAID = "grp string, level int, idx long, total long, digest binary, open boolean, leaf boolean, doc_id long, changed binary"
_NODES = ("grp", "level", "idx", "total", "digest")
_NODE = "grp string, level int, idx long, total long, digest binary"
_SCHEMA = pa.schema([("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("total", pa.int64()), ("digest", pa.binary()), ("open", pa.bool_()), ("leaf", pa.bool_()), ("doc_id", pa.int64()), ("changed", pa.binary())])


def framed(value: Column) -> Column:
    """``-`` for null, else the bytes of its UTF-8 text, counted, and the text."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256))


def height(total: int) -> int:
    """Levels above the leaves of a tree of ``total`` leaves."""
    out = 0
    while total > 1:
        total, out = -(-total // FANOUT), out + 1
    return out


def joined(digests: list[bytes]) -> bytes:
    """The hash of a run."""
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


class Mountains:
    """The stack of one group's stretch of leaves in one part.

    A run of ``FANOUT`` is hashed as its last node comes, and the hash carried a level up. ``nodes`` gets (level, idx,
    digest, open) of what is to be kept: a node is open if its run isn't wholly in this stretch, so that its parent is made
    elsewhere.
    """

    def __init__(self):
        self.waiting: list[list[tuple[int, bytes]]] = []
        self.nodes: list[tuple[int, int, bytes, bool]] = []

    def _settle(self, level: int) -> None:
        run, self.waiting[level] = self.waiting[level], []
        whole = run[0][0] % FANOUT == 0
        if level >= BLOCK or not whole:
            self.nodes += [(level, idx, digest, not whole) for idx, digest in run]
        if whole:
            self.push(level + 1, run[0][0] // FANOUT, joined([d for _, d in run]))

    def push(self, level: int, idx: int, digest: bytes) -> None:
        if level == len(self.waiting):
            self.waiting.append([])
        self.waiting[level].append((idx, digest))
        if idx % FANOUT == FANOUT - 1:
            self._settle(level)

    def close(self, total: int, ended: bool) -> None:
        """Leaves end here. If the group of ``total`` ends too, last runs are short ones, up to its root; else what waits has the rest of its run in the next part."""
        top = height(total)
        level = 0
        while level < len(self.waiting):
            if ended and level < top and self.waiting[level]:
                self._settle(level)
            self.nodes += [(level, idx, digest, level != top) for idx, digest in self.waiting[level]]
            level += 1


@dataclass(frozen=True)
class Forest:
    """Trees of groups. ``leaves``: grp, idx, digest, doc_id, changed; ``nodes``: grp, level, idx, total, digest of every ``BLOCK``-th level and of roots; ``roots``: grp, total, digest."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    most: int


def _height(total: Column, most: int) -> Column:
    """``height`` as a column, for totals of up to ``most``."""
    out = F.lit(0)
    for level in range(height(most)):
        out = out + F.when(total > FANOUT**level, 1).otherwise(0)
    return out


def merging(low: int):
    """Of the open nodes (grp, level, idx, total, digest) under one node ``BLOCK`` levels above ``low``, that node, or the root."""

    def merge(nodes: pa.Table) -> pa.Table:
        rows = nodes.to_pylist()
        grp, total = rows[0]["grp"], rows[0]["total"]
        top = min(low + BLOCK, height(total))
        up: list[tuple[int, bytes]] = []
        for level in range(low, top):
            pool = sorted(up + [(r["idx"], r["digest"]) for r in rows if r["level"] == level])
            up = [(above, joined([d for _, d in run])) for above, run in groupby(pool, key=lambda n: n[0] // FANOUT)]
        n = len(up)
        columns = ([grp] * n, [top] * n, [i for i, _ in up], [total] * n, [d for _, d in up])
        return pa.table([pa.array(c, _SCHEMA.field(name).type) for c, name in zip(columns, _NODES, strict=True)], names=list(_NODES))

    return merge


def forest(leaves: DataFrame, *order: str) -> Forest:
    """Trees over rows of (grp, doc_id, digest, changed), grp never null, in the order of ``order``, nulls first."""
    cut = checkpointed(leaves.orderBy("grp", *(F.col(c).asc_nulls_first() for c in order)).withColumn("_at", F.monotonically_increasing_id()))
    counts = cut.groupBy("grp", F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("grp")
    before = by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = checkpointed(counts.withColumn("total", F.sum("n").over(by_group)).withColumn("begins", F.coalesce(F.sum("n").over(before), F.lit(0))))
    cut_groups = parts.where(F.col("total") > F.col("n")).collect()  # a part's first and last group at most
    most = parts.agg(F.max("total")).head()[0] or 0
    shared = cut.sparkSession.sparkContext.broadcast({(r["part"], r["grp"]): (r["begins"], r["total"]) for r in cut_groups})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current, stack, idx, begins, total = None, Mountains(), 0, 0, None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            rows.clear()
            return batch

        def end() -> None:
            size = total or idx
            stack.close(size, idx == size)
            rows.extend((current, level, at, size, digest, is_open, False, None, None) for level, at, digest, is_open in stack.nodes)

        for batch in batches:
            for grp, doc_id, digest, changed, at in zip(*(batch.column(c).to_pylist() for c in ("grp", "doc_id", "digest", "changed", "_at")), strict=True):
                if grp != current:
                    if current is not None:
                        end()
                    begins, total = shared.value.get((at >> 33, grp), (0, None))
                    current, stack, idx = grp, Mountains(), begins
                rows.append((grp, 0, idx, None, digest, False, True, doc_id, changed))
                stack.push(0, idx, digest)
                idx += 1
                if len(rows) >= 4096:
                    yield out()
        if current is not None:
            end()
        if rows:
            yield out()

    laid = checkpointed(cut.mapInArrow(run, _LAID))
    nodes = checkpointed(laid.where("NOT leaf").select("grp", "level", "idx", "total", "digest", "open"))
    kept = nodes.drop("open")
    below = None
    for low in range(0, height(max((r["total"] for r in cut_groups), default=0)), BLOCK):
        pool = nodes.where(F.col("open") & F.col("level").between(low, low + BLOCK - 1)).drop("open")
        pool = pool if below is None else pool.unionByName(below.where((F.col("level") == low) & (_height(F.col("total"), most) > low)))
        above = F.expr(f"idx DIV CAST(POW({FANOUT}, {low + BLOCK} - level) AS BIGINT)")
        below = checkpointed(pool.groupBy("grp", above.alias("above")).applyInArrow(merging(low), _NODE))
        kept = kept.unionByName(below)
    top = _height(F.col("total"), most)
    kept = checkpointed(kept.where((F.col("level") == top) | ((F.col("level") > 0) & (F.col("level") % BLOCK == 0))))
    return Forest(laid.where("leaf").select("grp", "idx", "digest", "doc_id", "changed"), kept, kept.where(F.col("level") == top).select("grp", "total", "digest"), most)


def block_paths(trees: Forest, above: DataFrame) -> DataFrame:
    """grp, blk, total, path, subroot, root: the steps from each block of leaves to the root of all; ``above`` has (grp, path, subroot, root) for each tree's own root. Steps are joined by commas.

    The nodes of every ``BLOCK``-th level are the leaves of a layer of blocks; each layer's paths begin the next one's.
    """
    roots = trees.roots.join(above, "grp").select("grp", F.lit(0).cast("long").alias("blk"), "total", "path", "subroot", "root")
    top = _height(F.col("total"), trees.most)
    layer_of = F.greatest(F.lit(0), F.floor((top - 1) / BLOCK))
    here = None
    for layer in range(max(0, height(trees.most) - 1) // BLOCK, -1, -1):
        heads = roots.where(layer_of == layer)
        here = heads if here is None else heads.unionByName(here)
        if layer:
            nodes = trees.nodes.where((F.col("level") == layer * BLOCK) & (top > layer * BLOCK)).select("grp", "idx", "digest")
            here = _by_block(nodes, here).mapInArrow(block_steps(layer), "grp string, blk long, total long, path string, subroot binary, root binary")
    return here


def climb(digest: bytes, path: str) -> bytes:
    """The root that a leaf's hash leads to by the steps of ``path``."""
    for step in path.split(",") if path else ():
        at = 1 + 64 * int(step[0])
        digest = hashlib.sha256((step[1:at] + digest.hex() + step[at:]).encode()).digest()
    return digest


def local_paths(digests: list[bytes], levels: int) -> list[list[str]]:
    """The lowest ``levels`` steps of each leaf of a block."""
    out: list[list[str]] = [[] for _ in digests]
    for level in range(levels):
        span = FANOUT**level
        up = []
        for low in range(0, len(digests), FANOUT):
            names = [d.hex() for d in digests[low : low + FANOUT]]
            for k in range(len(names)):
                step = str(k) + "".join(names[:k] + names[k + 1 :])
                for leaf in out[(low + k) * span : (low + k + 1) * span]:
                    leaf.append(step)
            up.append(hashlib.sha256("".join(names).encode()).digest())
        digests = up
    return out


def _by_block(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Leaves (or nodes) with, before those of each block, a row of the block's path; blocks whole and in order in a part."""
    both = rows.withColumn("blk", F.expr(f"idx DIV {FANOUT**BLOCK}L")).unionByName(paths, allowMissingColumns=True)
    return both.repartition("grp", "blk").sortWithinPartitions("grp", "blk", F.col("idx").asc_nulls_first())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """The path's row of each block and its leaves, at most ``FANOUT ** BLOCK``."""
    head, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            for r in batch.slice(at, 4096).to_pylist():
                if r["idx"] is None:
                    if head:
                        yield head, rows
                    head, rows = r, []
                else:
                    rows.append(r)
    if head:
        yield head, rows


def _paths(head: dict, rows: list[dict], layer: int = 0) -> list[str]:
    """The path of each leaf of a block, or of each node of one of a layer above."""
    steps = local_paths([r["digest"] for r in rows], min(BLOCK, height(head["total"]) - layer * BLOCK))
    return [",".join([*s, *([head["path"]] if head["path"] else [])]) for s in steps]


def block_steps(layer: int):
    """Paths of the nodes of a layer, which are the blocks of the layer below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, rows in _blocks(batches):
            n = len(rows)
            columns = ([head["grp"]] * n, [r["idx"] for r in rows], [head["total"]] * n, _paths(head, rows, layer), [head["subroot"]] * n, [head["root"]] * n)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["grp", "blk", "total", "path", "subroot", "root"])

    return run


def _top_paths(trees: Forest) -> DataFrame:
    """grp, path, root: of each leaf of a single tree, whose name is in ``changed``."""
    above = trees.roots.select("grp", F.lit("").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, rows in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r["changed"].decode() for r in rows]), pa.array(_paths(head, rows), pa.string()), pa.array([head["root"]] * len(rows), pa.binary())], ["grp", "path", "root"])

    return _by_block(trees.leaves, block_paths(trees, above)).mapInArrow(run, "grp string, path string, root binary")


def tampered(doc_id: str = "doc_id") -> Column:
    """Rows whose text is changed for the test: where 2 divides the crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves_of(docs: DataFrame) -> DataFrame:
    """grp, doc_id, digest, changed: grp names the source, in the order of sources; changed is the hash after tampering, where there is any."""
    fields = [F.col(c) for c in FIELDS]
    shorter = F.translate("text", "\n", "")
    changed = F.when(tampered() & F.col("text").contains("\n"), leaf_hash(*fields[:-1], shorter))
    grp = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(*fields).alias("digest"), changed.alias("changed"))


def prove(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    sources = forest(checkpointed(leaves_of(docs)), "doc_id", "digest")  # texts are read once: the sort looks at its rows twice
    tops = sources.roots
    over = forest(tops.select(F.lit("").alias("grp"), F.lit(None).cast("long").alias("doc_id"), F.col("grp").cast("binary").alias("changed"), "digest"), "changed")
    above = tops.join(_top_paths(over), "grp").select("grp", "path", F.col("digest").alias("subroot"), "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, rows in _blocks(batches):
            paths = _paths(head, rows)
            proofs = [hashlib.sha256("".join([s[1:] for s in p.split(",")]).encode()).hexdigest() for p in paths]
            folded = [climb(r["changed"] or r["digest"], p) for r, p in zip(rows, paths, strict=True)]
            n, root = len(rows), head["root"]
            columns = [[r["doc_id"] for r in rows], [r["digest"].hex() for r in rows], [head["subroot"].hex()] * n, [root.hex()] * n, proofs, [f.hex() for f in folded], [f == root for f in folded]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 5, pa.bool_()), strict=True)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return _by_block(sources.leaves, block_paths(sources, above)).mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
