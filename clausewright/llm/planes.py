"""Token ids in binary files whose blocks are transposed into planes.

A shard's file holds the ids of consecutive documents as one sequence, cut into blocks of a fixed number of ids. A block is
transposed into byte planes (the lowest bytes of all its ids, then the next ones) or bit planes, and each plane is one
zstandard frame. Behind the blocks stand the index of chunks (place, ids, bytes of each plane) and that of documents (id,
ids), so that a reader opens any range of blocks without those before it.

Spark deals documents to shards by ranges of doc_id, whose bounds come from the ids alone; a task sorts and writes one shard
as a stream and returns a row of the manifest, which names the file of the attempt that succeeded. Where a shard's ids
begin among all follows from the rows of the manifest. Files stand in the shared folder; a lost task writes another file,
which the manifest does not name unless it ends.

Defined results: null and empty texts have the end id alone; a null doc_id comes first; rows of one doc_id stand in the order
of their ids (tokens), repeated rows each count; no rows give no files; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.llm._shared import array_pieces, checkpoint_path, checkpointed, in_small_batches
from clausewright.llm.library import LONG, LibraryEncoder, cut

MAGIC = b"IDPLANE1"
#: Ids in a block.
BLOCK = 1 << 16
LEVEL = 3
#: Bytes of text whose words are made distinct together.
TOGETHER = 24 << 20
#: Shards are planned for about so many documents each, and are never more than ``MOST_SHARDS``.
DOCUMENTS_A_SHARD, MOST_SHARDS = 20_000, 20_000
#: Chunks that one reader's row covers.
CHUNKS_A_READ = 32


def to_planes(ids: np.ndarray, bits: bool = False) -> np.ndarray:
    """Planes of unsigned ids, one a row: byte k of all ids, or bit k of all ids (eight ids a byte, the first in the lowest bit)."""
    width = ids.dtype.itemsize
    raw = np.ascontiguousarray(ids.astype(ids.dtype.newbyteorder("<"))).view(np.uint8).reshape(-1, width)
    if not bits:
        return np.ascontiguousarray(raw.T)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, width: int, bits: bool = False) -> np.ndarray:
    """The ``n`` ids of ``to_planes``."""
    raw = planes.T if not bits else np.packbits(np.unpackbits(planes, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).reshape(-1).view(f"<u{width}")


class ShardWriter:
    """Writes one shard to ``stream`` as documents come; ids of less than a block are held."""

    def __init__(self, stream, width: int, block: int = BLOCK, bits: bool = False):
        self.stream, self.width, self.block, self.bits = stream, width, block, bits
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.chunks: list[list[int]] = []
        self.docs: list[int] = []
        self.nulls: list[bool] = []
        self.counts: list[int] = []
        self.at = stream.write(MAGIC + np.array([width, block, bits], "<u4").tobytes())

    def _flush(self, ids: np.ndarray) -> None:
        frames = [self.zstd.compress(p.tobytes()) for p in to_planes(ids, self.bits)]
        self.chunks.append([self.at, len(ids), *map(len, frames)])
        for f in frames:
            self.at += self.stream.write(f)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """The next document; its ids have the width of the file."""
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            full = len(whole) - len(whole) % self.block
            for at in range(0, full, self.block):
                self._flush(whole[at : at + self.block])
            self.held, self.n_held = [whole[full:].copy()], len(whole) - full

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        index = [np.array(self.chunks, "<i8").tobytes(), np.array(self.docs, "<i8").tobytes(), np.packbits(np.array(self.nulls, bool)).tobytes(), np.array(self.counts, "<i8").tobytes()]
        places = [len(self.docs)]
        for part in index:
            frame = self.zstd.compress(part)
            places += [self.at, len(frame)]
            self.at += self.stream.write(frame)
        self.stream.write(np.array(places, "<i8").tobytes() + MAGIC)
        self.stream.close()


class Shard:
    """A shard's file, opened for reading: its indexes are read, its blocks when they are asked for."""

    def __init__(self, file):
        self.file = file
        head = file.read_at(20, 0)
        end = file.size()
        tail = file.read_at(80, end - 80)
        if head[:8] != MAGIC or tail[-8:] != MAGIC:
            raise ValueError("not a whole file of token planes")
        self.width, self.block, self.bits = (int(x) for x in np.frombuffer(head[8:], "<u4"))
        n, *places = np.frombuffer(tail[:-8], "<i8").tolist()
        self.zstd = zstandard.ZstdDecompressor()
        chunks, docs, nulls, counts = (self.zstd.decompress(file.read_at(size, at)) for at, size in zip(places[::2], places[1::2], strict=True))
        planes = self.width * (8 if self.bits else 1)
        self.chunks = np.frombuffer(chunks, "<i8").reshape(-1, 2 + planes)
        self.docs, self.counts = np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<i8")
        self.nulls = np.unpackbits(np.frombuffer(nulls, np.uint8), count=n).astype(bool)
        self.starts = np.cumsum(self.counts) - self.counts

    def ids(self, chunk: int) -> np.ndarray:
        """The ids of a block."""
        at, n, *sizes = self.chunks[chunk].tolist()
        frames, low, rows = self.file.read_at(sum(sizes), at), 0, []
        for size in sizes:
            rows.append(np.frombuffer(self.zstd.decompress(frames[low : low + size]), np.uint8))
            low += size
        return from_planes(np.stack(rows), n, self.width, self.bits)

    def documents(self, first: int, last: int) -> Iterator[tuple[int | None, int, Iterator[np.ndarray]]]:
        """(doc_id, start in the shard, pieces of its ids) of documents that begin in blocks ``first`` to ``last`` - 1, each to be read before the next; the last blocks have all that begin later too."""
        held = (-1, np.zeros(0, "<u2"))

        def block(c: int) -> np.ndarray:
            nonlocal held
            if held[0] != c:
                held = (c, self.ids(c))
            return held[1]

        def pieces(start: int, n: int) -> Iterator[np.ndarray]:
            while n:
                c, low = divmod(start, self.block)
                part = block(c)[low : low + n]
                yield part
                start, n = start + len(part), n - len(part)

        low, high = np.searchsorted(self.starts, [first * self.block, last * self.block]).tolist()
        for i in range(low, high if last < len(self.chunks) else len(self.starts)):
            yield None if self.nulls[i] else int(self.docs[i]), int(self.starts[i]), pieces(int(self.starts[i]), int(self.counts[i]))


def _file(path: str, write: bool = False):
    system, at = pyarrow.fs.FileSystem.from_uri(path)
    return system.open_output_stream(at) if write else system.open_input_file(at)


_ENCODERS: dict[int, LibraryEncoder] = {}


def _encoder(source: str) -> LibraryEncoder:
    """This worker's encoder of the file; building one takes longer than many a batch."""
    key = zlib.crc32(source.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(source)
    return _ENCODERS[key]


def token_ids(docs: DataFrame, source: str, end: int | None, bounds: list[int], longest: int = LONG) -> DataFrame:
    """part, doc_id, ids: the ids of each text with ``end`` behind them, as little-endian bytes of 2 or 4 each; part: how many ``bounds`` lie below doc_id (null: 0). Texts of more than ``longest`` bytes are encoded in parts."""
    spark = in_small_batches(docs).sparkSession
    shared = spark.sparkContext.broadcast((source, np.array(bounds, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, edges = shared.value
        encoder = _encoder(text_of)
        kind = f"<u{encoder.width}"
        tail = np.array([] if end is None else [end], kind).tobytes()

        def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            found = [encoder.encode(p) for p in array_pieces(texts, TOGETHER)]
            return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch = held[0] if len(held) == 1 else pa.concat_batches(held)
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            if (pc.max(pc.binary_length(texts)).as_py() or 0) > longest:
                parts = [cut(t or "", longest) for t in texts.to_pylist()]
                ids, counts = encoded(pa.array([p for t in parts for p in t], pa.string()))
                counts = np.add.reduceat(counts, np.cumsum([0, *map(len, parts[:-1])]))
            else:
                ids, counts = encoded(texts)
            raw, to = ids.astype(kind).tobytes(), np.cumsum(counts) * encoder.width
            part = np.searchsorted(edges, pc.fill_null(doc_ids, 0).to_numpy(), "left").astype(np.int32)
            part[pc.is_null(doc_ids).to_numpy(zero_copy_only=False)] = 0
            rows = [raw[a:b] + tail for a, b in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(part[at : at + 4096]), doc_ids.slice(at, 4096), pa.array(rows[at : at + 4096], pa.binary())], ["part", "doc_id", "ids"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if held and size + batch.nbytes > TOGETHER:
                yield from out(held)
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
        if size:
            yield from out(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, doc_id long, ids binary")


def shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """The greatest doc_id of each of about ``shards`` ranges but the last, at most ``MOST_SHARDS`` numbers: of the ids alone, dealt by Spark's range sort."""
    ranges = docs.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(shards, "doc_id")
    return sorted(r["most"] for r in ranges.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("most")).collect())[:-1]


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end: int | None = None, shards: int | None = None, block: int = BLOCK, bits: bool = False) -> DataFrame:
    """Writes the files and returns their manifest: shard, path, n_docs, n_ids, n_chunks, begins (ids of the shards before it)."""
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{checkpoint_path(spark)}/planes-{uuid.uuid4().hex}"
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    shards = shards or min(MOST_SHARDS, max(1, -(-docs.select("doc_id").count() // DOCUMENTS_A_SHARD)))
    bounds = shard_bounds(docs, shards)
    width = LibraryEncoder(source).width
    system, at = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        writer, current, path = None, None, ""

        def done() -> pa.RecordBatch:
            writer.close()
            row = {"shard": current, "path": path, "n_docs": len(writer.docs), "n_ids": writer.n_ids, "n_chunks": len(writer.chunks)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_chunks", pa.int64())]))

        for batch in batches:
            for part, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if part != current:
                    if writer:
                        yield done()
                    current, path = part, f"{folder}/shard-{part:05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.planes"
                    writer = ShardWriter(_file(path, write=True), width, block, bits)
                writer.add(doc_id, np.frombuffer(ids, f"<u{width}"))
        if writer:
            yield done()

    dealt = token_ids(docs, source, end, bounds).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    written = checkpointed(dealt.mapInArrow(run, "shard int, path string, n_docs long, n_ids long, n_chunks long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return written.withColumn("begins", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (crc32 of the ids as little-endian unsigned 32-bit integers), from the files."""
    first = F.explode(F.expr(f"sequence(0L, greatest(n_chunks - 1, 0L), {CHUNKS_A_READ}L)"))
    n = manifest.agg(F.sum(F.expr(f"n_chunks DIV {CHUNKS_A_READ} + 1"))).head()[0] or 1
    ranges = manifest.select("path", "begins", "n_chunks", first.alias("first")).repartition(min(n, MOST_SHARDS), "path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _file(r["path"]) as file:
                    rows: list[tuple] = []
                    for doc_id, start, pieces in Shard(file).documents(r["first"], min(r["first"] + CHUNKS_A_READ, r["n_chunks"])):
                        n = crc = 0
                        for p in pieces:
                            n, crc = n + len(p), zlib.crc32(p.astype("<u4").tobytes(), crc)
                        rows.append((doc_id, r["begins"] + start, n, crc))
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(4)], names)

    return ranges.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
