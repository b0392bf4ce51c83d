"""What the operators share: parquet reading and Arrow batch helpers."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.plans.lineage import checkpoint_path, checkpointed, in_small_batches

__all__ = ["WORD", "array_pieces", "checkpoint_path", "checkpointed", "drawn", "in_small_batches", "most_frequent", "pieces", "table", "word_count"]

#: A word, by code points: anything but blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str) -> F.Column:
    """Words of a text column; null counts as no words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def drawn(rows: DataFrame, size: int, draw: F.Column) -> DataFrame:
    """The ``size`` rows with the least draws, a hash of 64 bits that is even over the rows.

    Rows are counted first and cut at a draw that about twice ``size`` of them lie below, so that what the tasks hand to
    the driver does not grow with their number. Many equal draws may leave fewer rows.
    """
    bound = -(2**63) + 2**64 * (2 * size + 100) // max(1, rows.count())
    return (rows if bound >= 2**63 else rows.where(draw < F.lit(bound))).orderBy(draw).limit(size)


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of (word, n, ...) with the greatest n, and of equal ones those whose words have the least hashes.

    All of them and no others, found by three rounds of counts: of eighths of a power of two, of the values of n in the last
    of these that fits in part, and of 1,024 ranges of the hash where n is that of the last row. What the tasks hand to the
    driver does not grow with their number.
    """
    draw = F.pmod(F.xxhash64("word"), F.lit(1 << 40))
    left, sure, edge = size, F.lit(False), F.lit(True)
    for key in (F.floor(8 * F.log2("n")).cast("int"), F.col("n"), -F.shiftright(draw, 30)):
        for r in sorted(counts.where(edge).groupBy(key.alias("key")).count().collect(), reverse=True):
            if r["count"] > left:
                break
            left -= r["count"]
        else:
            return counts
        sure, edge = sure | (edge & (key > r["key"])), edge & (key == r["key"])
    return counts.where(sure | edge).orderBy(F.col("n").desc(), draw, "word").limit(size)


#: Bytes of a slice of an Arrow batch of texts over which numpy works.
SLICE = 1 << 19


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = SLICE):
    """Slices of a batch whose texts hold about ``most`` bytes, so that numpy arrays over them stay small; a longer text gets a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < len(lengths):
        yield batch.slice(at)


def array_pieces(texts: pa.Array, most: int = SLICE):
    """The same of one array."""
    for part in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text", most):
        yield part.column("text")
