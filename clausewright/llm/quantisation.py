"""Embedding near-duplicates by product quantisation.

Unit vectors are assigned to coarse inverted lists; their residuals are coded by a codebook for each subspace, and each
code keeps its distance from the vector. A query goes to every list behind whose plane it lies by a margin at most:
(|q - c|^2 - |q - c0|^2) / (2 |c - c0|), for the nearest centre c0. A link between two lists crosses their plane, so the
margins of its ends together are at most its length: with half the radius of the threshold, one end at least asks for
the other, and no link is lost. A link that only one end asks for counts for both. In a list, look-ups in a query's
table of products with all codes give asymmetric distances; a row is a candidate if its distance less its own coding
error is within the radius, which by the triangle inequality no link exceeds. Candidates are reranked by exact cosine in
double precision. Centres and codebooks are fitted on a bounded sample; every row is indexed and queried.

Vectors of every length are compared with those of their own length. The quantiser is of the commonest length; it sees
others cut or filled up with zeros, which brings no two vectors further apart, so its bounds hold for them too.

Equal vectors are one row with a count. Lists are cut into blocks of bounded size, so a hot list is many groups. A
block yields counts for each vector and a spanning forest of its links, not pairs.

Defined results: null, empty and zero vectors and ones with null or non-finite components have no links; vectors of
different lengths do not link; repeated rows link with each other, rows of one vec_id by their own vectors; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._graph import components
from clausewright.llm._shared import checkpointed, drawn


def _clusters(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


@dataclass
class ProductQuantiser:
    """``centres``: lists x dimensions; ``books``: subspaces x codes x dimensions of a subspace."""

    centres: np.ndarray
    books: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, subspaces: int, codes: int = 256, seed: int = 5) -> ProductQuantiser:
        centres = _clusters(sample, lists, seed)
        rest = sample - centres[cls(centres, np.zeros((0, 0, 0))).nearest(sample)]
        width = math.ceil(sample.shape[1] / subspaces)
        rest = np.pad(rest, ((0, 0), (0, width * subspaces - sample.shape[1])))
        books = [_clusters(rest[:, s * width : (s + 1) * width], codes, seed + 1 + s) for s in range(subspaces)]
        return cls(centres, np.stack(books))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.centres * self.centres).sum(1) - 2 * x @ self.centres.T, 0))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.argmin(self.distances(x), axis=1)

    def _parts(self, rest: np.ndarray) -> np.ndarray:
        subspaces, _, width = self.books.shape
        return np.pad(rest, ((0, 0), (0, subspaces * width - rest.shape[1]))).reshape(len(rest), subspaces, width)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Products of each row's subvectors with all codes: subspaces x codes x rows, in single precision."""
        return np.matmul(self.books.astype(np.float32), np.ascontiguousarray(self._parts(x).transpose(1, 2, 0), np.float32))

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, coding errors and decoded residuals."""
        parts = self._parts(rest)
        codes = np.stack([np.argmin((self.books[s] ** 2).sum(1) - 2 * parts[:, s] @ self.books[s].T, axis=1) for s in range(len(self.books))], axis=1)
        held = np.concatenate([self.books[s][codes[:, s]] for s in range(len(self.books))], axis=1)[:, : rest.shape[1]]
        return codes.astype(np.uint8), np.sqrt(((rest - held) ** 2).sum(1)), held

    def probes(self, x: np.ndarray, most: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each row, and the lists behind whose planes it lies by ``most`` or less, with its own."""
        d = self.distances(x)
        own = np.argmin(d, axis=1)
        apart = self.distances(self.centres)
        # Not divided, so that centres that are all but equal leave no rounding errors to lose a list by.
        ahead = d**2 - np.take_along_axis(d, own[:, None], 1) ** 2 - 2 * apart[own] * (most + 1e-6)
        return own, [np.flatnonzero(m <= 1e-9) for m in ahead]


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles; very large and very small ones are scaled by a power of two, which no cosine feels."""
    x = column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)
    most = np.abs(x).max(1, initial=0)
    odd = (most > 1e150) | (most < 1e-150)
    if odd.any():
        x[odd] = np.ldexp(x[odd], -np.frexp(most[odd])[1][:, None])
    return x


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _fitted(unit: np.ndarray, width: int) -> np.ndarray:
    """Cut or filled up with zeros to ``width`` columns."""
    return unit[:, :width] if unit.shape[1] >= width else np.pad(unit, ((0, 0), (0, width - unit.shape[1])))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Some of the links (a, b) that join the same of n nodes: least labels spread, and each node keeps the link that gave it its last one."""
    label, source = np.arange(n), np.full(n, -1)
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        better = (new[a] < label[a]) & (label[b] == new[a])
        if not better.any():
            break
        source[a[better]] = b[better]
        label = new
    got = np.flatnonzero(source >= 0)
    return got, source[got]


def _search_block(shared, threshold: float, radius: float, chunk: int = 1024):
    def run(table: pa.Table) -> pa.Table:
        quantiser = shared.value
        width, count = quantiser.centres.shape[1], len(quantiser.centres)
        ids, weight, role, own = (table.column(c).to_numpy() for c in ("id", "copies", "role", "own"))
        raw = _vectors(table.column("embedding").combine_chunks())
        norms = _norms(raw)
        place = int(table.column("list")[0].as_py())
        held, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        centre = quantiser.centres[place]
        seen = _fitted(raw / norms[:, None], width)
        codes, errors, decoded = quantiser.encode(seen[held] - centre)
        # |q - c - b|^2 = |q - c|^2 + (|b|^2 + 2 c b) - 2 q b, and q b is looked up.
        fixed = ((decoded * decoded).sum(1) + 2 * decoded @ centre - (radius + errors) ** 2).astype(np.float32)
        first = {int(i): k for k, i in enumerate(ids[held])}
        lists = table.column("lists").combine_chunks().take(pa.array(held))
        asks = np.repeat(np.arange(len(held)), lists.value_lengths().to_numpy()) * count + lists.flatten().to_numpy()
        links, back, edges = np.zeros(len(asked), np.int64), np.zeros(len(held), np.int64), []
        for at in range(0, len(asked), chunk):
            some = asked[at : at + chunk]
            tables = quantiser.tables(seen[some])
            near = np.zeros((len(held), len(some)), np.float32)
            for s in range(codes.shape[1]):
                near += tables[s][codes[:, s]]
            away = ((seen[some] - centre) ** 2).sum(1).astype(np.float32)
            # 1e-4 is above any rounding of these sums in single precision.
            h, q = np.nonzero(2 * near - fixed[:, None] >= away - np.float32(1e-4))
            good = np.zeros(len(q), bool)
            for k in range(0, len(q), 20_000):
                a, b = some[q[k : k + 20_000]], held[h[k : k + 20_000]]
                good[k : k + 20_000] = ((raw[a] * raw[b]).sum(1) / (norms[a] * norms[b]) >= threshold) & (ids[a] != ids[b])
            q, h = q[good], h[good]
            links[at : at + len(some)] = np.bincount(q, weight[held[h]], len(some)).astype(np.int64)
            # Held rows that do not ask the query's own list hear of the link here.
            away = np.flatnonzero(own[some[q]] != place)
            away = away[~np.isin(h[away] * count + own[some[q[away]]], asks)]
            back += np.bincount(h[away], weight[some[q[away]]], len(held)).astype(np.int64)
            nodes = np.array([first.get(i, len(held) + k) for k, i in enumerate(ids[some].tolist())], np.int64)
            left, right = _forest(nodes[q], h, len(held) + len(some))
            names = np.concatenate((ids[held], ids[some]))
            edges += zip(names[left].tolist(), names[right].tolist(), strict=True)
        told = np.flatnonzero(back)
        n = pa.array(np.concatenate((links, back[told], np.zeros(len(edges), np.int64))))
        a = np.concatenate((ids[asked], ids[held[told]], np.array([e[0] for e in edges], np.int64)))
        b = pa.array([None] * (len(asked) + len(told)) + [e[1] for e in edges], pa.int64())
        return pa.table({"a": pa.array(a), "b": b, "n": n})

    return run


def _router(shared, radius: float):
    """Each row once as held in its own list, with the lists that it asks, and once as a query in each of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = shared.value
        width = quantiser.centres.shape[1]
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for n in np.unique(sizes).tolist():
                mine = batch.take(pa.array(np.flatnonzero(sizes == n)))
                for at in range(0, mine.num_rows, 1024):
                    part = mine.slice(at, 1024)
                    raw = _vectors(part.column("embedding"))
                    own, probes = quantiser.probes(_fitted(raw / _norms(raw)[:, None], width), radius / 2)
                    asks = [len(p) for p in probes]
                    probed = np.concatenate(probes).astype(np.int32)
                    rows = np.concatenate((np.arange(len(raw)), np.repeat(np.arange(len(raw)), asks)))
                    places = np.concatenate((own.astype(np.int32), probed))
                    role = np.repeat(np.array([0, 1], np.int32), [len(raw), len(probed)])
                    ends = np.concatenate(([0], np.cumsum(asks), np.full(len(probed), len(probed)))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(probed))
                    out = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(role), pa.array(own[rows].astype(np.int32)), lists, *(out.column(c) for c in ("id", "copies", "size", "embedding"))], ["list", "role", "own", "lists", "id", "copies", "size", "embedding"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, lists: int | None = None, subspaces: int = 8, sample_rows: int = 16384, block: int = 4096, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept, from vec_id and embedding, an array of floats or doubles.

    ``lists``: by default a quarter of the square root of the number of vectors, from 4 to a quarter of the sample.
    ``sample_rows`` bounds what the centres and codebooks are fitted on, the first by a hash; with billions of vectors
    it should grow, as the lists do. ``block``: rows of a list, and queries, that meet at once.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vectors = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"))
    most = F.array_max(F.transform("embedding", lambda x: F.abs(F.coalesce(x, F.lit(float("nan"))))))  # NaN is above all others
    fine = F.coalesce((most > 0) & (most < float("inf")) & ~F.isnan(most) & F.col("vec_id").isNotNull(), F.lit(False))
    vectors = vectors.withColumn("fine", fine)
    alone = vectors.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usable = vectors.where("fine").select("vec_id", F.transform("embedding", lambda x: x + F.lit(0).cast(kind[6:-1])).alias("embedding"))
    classes = checkpointed(usable.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("size", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()))
    lengths = classes.groupBy("size").count().orderBy(F.col("count").desc(), "size").head()
    if lengths is None:
        return alone
    sample = drawn(classes.where(F.col("size") == lengths["size"]).select("embedding"), sample_rows, F.xxhash64("embedding", F.lit(seed))).collect()
    x = _vectors(pa.array([r["embedding"] for r in sample], pa.list_(pa.float64())))
    x /= _norms(x)[:, None]
    lists = lists or min(max(4, len(x) // 4), max(4, math.isqrt(lengths["count"]) // 4))
    shared = vectors.sparkSession.sparkContext.broadcast(ProductQuantiser.fit(x, lists, min(subspaces, x.shape[1]), seed=seed))
    radius = math.sqrt(2 - 2 * threshold)

    routed = classes.select("id", "copies", "size", "embedding").mapInArrow(_router(shared, radius), f"list int, role int, own int, lists array<int>, id long, copies long, size int, embedding {kind}")
    sizes = routed.where("role = 0").groupBy("size", "list").count()
    sizes = checkpointed(sizes.select("size", "list", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    # An indexed row lies in one block of its list; a query goes to all of them, in slices of bounded size too.
    routed = routed.join(sizes, ["size", "list"])
    own = F.array(F.pmod(F.xxhash64("embedding", F.lit(1)), F.col("blocks")).cast("int"))
    routed = routed.withColumn("part", F.explode(F.when(F.col("role") == 0, own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    slices = F.when(F.col("role") == 1, F.array(F.pmod(F.xxhash64("embedding", F.lit(2)), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    routed = routed.withColumn("slice", F.explode(slices))
    found = checkpointed(routed.groupBy("size", "list", "part", "slice").applyInArrow(_search_block(shared, threshold, radius), "a long, b long, n long"))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    # Classes are numbered as they come; a component is named by its least vec_id.
    joined = components(found.where("b IS NOT NULL").select("a", "b")).join(classes.select("id", "first"), "id")
    joined = joined.join(joined.groupBy("component").agg(F.min("first").alias("least")), "component").select("id", "least")
    told = classes.join(counts, "id", "left").join(joined, "id", "left").select("embedding", F.coalesce("least", "first").alias("least"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = usable.join(told, "embedding")
    return alone.unionByName(out.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("least").alias("component_id"), (F.col("vec_id") == F.col("least")).alias("kept")))
