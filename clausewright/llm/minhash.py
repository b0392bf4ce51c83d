"""MinHash near-duplicates with tensored banding.

Two small collections of ``tables`` sub-keys, each of ``rows`` minhashes, give tables ** 2 table keys: a key is a pair of
sub-keys, one of each collection. 48 minhashes do the work of 384. As many sub-keys are taken as a pair at the threshold
needs to share a table with a probability of 0.999: 8 at 85 percent, 11 at 80.

Documents with equal shingle sets are one class from the start, so groups of copies are one row; a class, not a
doc_id, is what has a text, so rows that share a doc_id and have different texts keep their own links. In every bucket
the members are compared with its least class (a star, not all pairs). The members of buckets whose members are still in
different components after that are joined exactly, by prefixes: of a set, the rarest shingles, as many as may be missing
from a partner and one more, of which two linked sets share one at least. So a template's copies that stay below the
threshold by words of their own meet nowhere, however many they are. A shingle that brings together at most ``FEW`` classes
of different components gives their pairs; the members of one that brings together more are compared in blocks of
bounded size, each pair at the first such shingle that its prefixes share, and a block pair yields a spanning forest, not pairs. Every link is
confirmed on the full sets. Shingles are 64-bit hashes.

Defined results: null and empty texts and texts without words have no shingles and link with nothing; fewer words than a
shingle are one shingle; repeated rows are equal classes; rows of one doc_id with different texts are judged each by its
own; a null doc_id links with nothing; no rows give no rows; other columns are ignored, and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._graph import components
from clausewright.llm._shared import array_pieces, checkpointed, in_small_batches, pieces
from clausewright.llm._words import Words, mix, windows

_SEED = 88172645463325252
#: Classes that a shingle of their prefixes brings together for their pairs to be listed.
FEW = 32


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    runs = windows(hashes, width)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if n >= width:
            row = np.sort(runs[a : a + n - width + 1])
            out.append(row[np.concatenate(([True], row[1:] != row[:-1]))])
        else:
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(hashes[a : a + n] + np.arange(1, n + 1, dtype=np.uint64)))])) if n else np.zeros(0, np.uint64))
    return out


def _sums(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits that tell sets apart: two sums of each set's hashes, as signed integers."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), 2), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate(sets)
        at = (np.cumsum(sizes) - sizes)[some]
        out[some, 0] = np.add.reduceat(flat, at)
        out[some, 1] = np.add.reduceat(mix(flat), at)
    return out.view(np.int64)


def _same_set(width: int):
    """The fingerprint (n_shingles, f1, f2) of a text column, for rows that the sketch does not reach."""

    @F.arrow_udf("struct<n_shingles:bigint,f1:bigint,f2:bigint>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            for part in array_pieces(array):
                sets = shingle_sets(part, width)
                sums = _sums(sets)
                yield pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], ["n_shingles", "f1", "f2"])

    return of


def _matching(width: int):
    """Rows (id, n_shingles, f1, f2, text) whose text has the fingerprint beside it. A map, so that it runs after the join and not on every text before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column("text"), width)
                n, f1, f2 = (part.column(c).to_numpy() for c in ("n_shingles", "f1", "f2"))
                sums = _sums(sets)
                same = (n == [len(s) for s in sets]) & (f1 == sums[:, 0]) & (f2 == sums[:, 1])
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text")], ["id", "text"]).filter(pa.array(same, pa.bool_()))

    return run


def _sketcher(width: int, tables: int, rows: int):
    count = 2 * tables * rows
    drawn = np.random.default_rng(_SEED)
    factors = drawn.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = drawn.integers(1, 2**63, count, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column("text"), width)
                sizes = np.array([len(s) for s in sets])
                some = np.flatnonzero(sizes)
                keys = np.zeros((len(sets), 2 * tables), np.uint64)
                if len(some):
                    flat = np.concatenate(sets)
                    at = (np.cumsum(sizes) - sizes)[some]
                    least = np.stack([np.minimum.reduceat((flat ^ masks[i]) * factors[i], at) for i in range(count)])
                    for k in range(2 * tables):
                        keys[some, k] = windows(least[k * rows : (k + 1) * rows].T.reshape(-1), rows)[::rows]
                sums = _sums(sets)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(sets) + 1) * 2 * tables).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), *(pa.array(sums[:, i].copy()) for i in (0, 1)), lists], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    common = _common(a, b)
    return 100 * common >= percent * (small + large - common)


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text_a", 1 << 18):
                a, b = (shingle_sets(part.column(c), width) for c in ("text_a", "text_b"))
                keep = pa.array([_alike(x, y, percent) for x, y in zip(a, b, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(keep)

    return run


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of the pairs (left, right) of sets, by bit rows of the elements that more than one set has."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = (np.cumsum(count > 1) - 1)[place]
    keep = count[place] > 1
    owner, column = owner[keep], column[keep]
    out = np.zeros(len(left), np.int64)
    for low in range(0, int(column.max(initial=-1)) + 1, columns):
        part = (column >= low) & (column < low + columns)
        at = column[part] - low
        bits = np.zeros((len(sets), (int(at.max()) >> 6) + 1), np.uint64)
        np.bitwise_or.at(bits, (owner[part], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        step = max(1, (1 << 18) // bits.shape[1])
        for k in range(0, len(left), step):
            out[k : k + step] += np.bitwise_count(bits[left[k : k + step]] & bits[right[k : k + step]]).sum(1, dtype=np.int64)
    return out


def _block_links(width: int, percent: int):
    """Links of a block pair whose members are not yet in one component, as a spanning forest. A pair is compared at the first shingle that its prefixes share, and nowhere else."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels, own = (table.column(c).to_numpy() for c in ("id", "component", "own"))
        p, q = (table.column(c)[0].as_py() for c in ("p", "q"))
        sets = [s for batch in table.select(["text"]).to_batches() for part in pieces(batch) for s in shingle_sets(part.column("text"), width)]
        before = [np.array(x, np.int64).view(np.uint64) for x in table.column("before").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        rows, columns = np.flatnonzero(own == p), np.flatnonzero(own == q)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            low, high = np.minimum(sizes[some][:, None], sizes[columns]), np.maximum(sizes[some][:, None], sizes[columns])
            open_ = (labels[some][:, None] != labels[columns]) & (100 * low >= percent * high)
            if p == q:
                open_ &= some[:, None] < columns
            x, y = np.nonzero(open_)
            left, right = some[x], columns[y]
            if len(left):
                fresh = _shared(before, left, right) == 0
                left, right = left[fresh], right[fresh]
            if not len(left):
                continue
            common = _shared(sets, left, right)
            good = 100 * common >= percent * (sizes[left] + sizes[right] - common)
            for x, y in zip(left[good].tolist(), right[good].tolist(), strict=True):
                a, b = find(int(labels[x])), find(int(labels[y]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _shingles(width: int):
    """The shingles of texts, one a row, with the text's id and its number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column("text"), width)
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(), n)), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(flat.view(np.int64))], ["id", "n", "s"])

    return run


def _prefix_links(texts: DataFrame, labels: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Links (a, b) between the different components of ``labels`` (id, component): enough of them to join what linked texts (id, text) join."""
    dealt = texts.join(labels, "id", "left_semi").mapInArrow(_shingles(width), "id long, n int, s long")
    often = dealt.groupBy("s").agg(F.count("*").alias("held"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("s", "held")
    shared = dealt.join(often, "s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "s"))).alias("line"))
    # Shingles that no other has come first in every prefix and meet nothing, so they only shorten what is left of it.
    short = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - (F.col("n") - F.size("line"))
    prefix = F.transform(F.slice("line", 1, F.greatest(short, F.lit(0))), lambda x: x["s"])
    prefixes = checkpointed(shared.select("id", "n", prefix.alias("prefix")).where("size(prefix) > 0").join(labels, "id"))
    postings = prefixes.select("id", "component", "n", F.explode("prefix").alias("key"))
    open_keys = postings.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"), F.sum("n").alias("size")).where("low < high")
    open_keys = checkpointed(open_keys.select("key", "m", "size"))

    met = postings.join(open_keys.where(F.col("m") <= FEW).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("id", "component", "n")).alias("all"))
    fits = lambda x, y: (x["id"] < y["id"]) & (x["component"] != y["component"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"]))
    listed = F.flatten(F.transform("all", lambda x: F.transform(F.filter("all", lambda y: fits(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    few = _confirmed(met.select(F.explode(listed).alias("p")).select("p.a", "p.b").distinct(), texts, width, percent)

    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("size") / (block * 1024))).cast("int")
    many = postings.drop("n").join(open_keys.where(F.col("m") > FEW).select("key", blocks.alias("blocks")), "key")
    lines = many.groupBy("id").agg(F.collect_list("key").alias("line"))
    rest = many.join(lines, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "component", F.filter("line", lambda x: x < F.col("key")).alias("before"))
    return few.unionByName(rest.join(texts, "id").groupBy("key", "p", "q").applyInArrow(_block_links(width, percent), "a long, b long"))


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are alike."""
    held = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return held.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "a long, b long")


def sub_keys(percent: int, rows: int) -> int:
    """Sub-keys of a collection for a pair at the threshold to share one in both collections with a probability of 0.999."""
    return max(1, math.ceil(math.log(0.0005) / math.log(1 - min(0.999, percent / 100) ** rows)))


def _linked(docs: DataFrame, width: int, percent: int, tables: int | None, rows: int, block: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2, component_id of each row, as ``near_duplicates`` defines them, and root, the number of its component."""
    tables = tables or sub_keys(percent, rows)
    docs = in_small_batches(docs).select("doc_id", "text")
    sketched = docs.mapInArrow(_sketcher(width, tables, rows), "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>")
    sketched = checkpointed(sketched)
    classes = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "f1", "f2", "keys").agg(F.min("doc_id").alias("first"))
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))

    def keyed(rows: DataFrame) -> DataFrame:
        t = F.col("t")
        out = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables * tables - 1))))
        return out.withColumn("key", F.xxhash64(t, F.get("keys", F.floor(t / tables).cast("int")), F.get("keys", tables + F.pmod(t, F.lit(tables)))))

    bucketed = keyed(classes.select("id", "keys")).select("id", "key")
    leads = bucketed.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    stars = checkpointed(bucketed.join(leads, "key").where("id > lead").select("id", "lead").distinct())

    # A class's text is one of its first doc_id's; where that has several, the one with the class's fingerprint.
    members = stars.select("id").unionByName(stars.select(F.col("lead").alias("id"))).distinct()
    wanted = classes.join(members, "id", "left_semi").select("id", F.col("first").alias("doc_id"), "n_shingles", "f1", "f2")
    texts = docs.join(wanted, "doc_id").select("id", "n_shingles", "f1", "f2", "text").mapInArrow(_matching(width), "id long, text string")
    texts = checkpointed(texts.groupBy("id").agg(F.min("text").alias("text")))
    links = checkpointed(_confirmed(stars.select(F.col("lead").alias("a"), F.col("id").alias("b")), texts, width, percent))
    found = components(links)

    # Buckets whose members are not in one component: their members are joined by prefixes.
    told = classes.join(members, "id", "left_semi").join(found, "id", "left").select("id", "keys", F.coalesce("component", "id").alias("component"))
    dealt = keyed(told).select("key", "id", "component")
    open_keys = dealt.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    labels = checkpointed(dealt.join(open_keys, "key", "left_semi").select("id", "component").distinct())
    more = _prefix_links(texts, labels, width, percent, block)
    more = checkpointed(more)
    if not more.isEmpty():
        found = components(links.unionByName(more).unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    # Classes are numbered as they come; a component is named by its least doc_id.
    found = found.join(classes.select("id", "first"), "id")
    named = found.groupBy("component").agg(F.min("first").alias("component_id"))
    found = found.join(named, "component").select("id", "component_id", F.col("component").alias("root"))
    owners = classes.join(found, "id", "left").select("n_shingles", "f1", "f2", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "id").alias("root"))
    joined = sketched.drop("keys").join(owners, ["n_shingles", "f1", "f2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", "f1", "f2", component.alias("component_id"), "root")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, tables: int | None = None, rows: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included), kept.

    Documents link if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles. ``tables``:
    sub-keys of a collection, by default as many as the threshold needs; ``block``: documents of a block, and 1024
    times as many shingles.
    """
    return _linked(docs, width, percent, tables, rows, block).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, tables: int | None = None, rows: int = 3, block: int = 1024) -> DataFrame:
    """``docs`` with one row of each component: one of its least doc_id. Rows without words or doc_id all stay."""
    judged = checkpointed(_linked(docs, width, percent, tables, rows, block))
    repeated = judged.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return docs.join(judged.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    # A doc_id is several rows: of those of a component's least one, the text with the least fingerprint, and of equal rows one.
    some = judged.where("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id", "root").agg(F.min(F.struct("n_shingles", "f1", "f2")).alias("as"))
    wrapped = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), _same_set(width)(F.coalesce("text", F.lit(""))).alias("as"))
    free = wrapped.where("as.n_shingles = 0 OR id IS NULL").select("row.*")
    chosen = wrapped.join(some.select(F.col("doc_id").alias("id"), "as"), ["id", "as"]).groupBy("id", "as").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return free.unionByName(chosen.select("row.*"))
