"""Quality by compression: dictionaries of good and of bad text, and the difference of the compressed sizes as a score.

A text has three views: its bytes; its words' shapes (letters, capitals and digits as one sign each, runs as one sign),
a word that occurred a few words before marked by the distance; and one sign a word, said before or not. For each view
two zstandard dictionaries are built from labelled text, of good and of bad documents. A document's views are
compressed in short blocks with both, so that what a block knows comes from the dictionary and not from the document,
and the differences of the sizes, normalised by their sum, are calibrated to a probability by a logistic model on other
labelled documents. Nothing but these three differences goes into the score.

What is gathered for the fit is bounded by ``per_class`` labelled rows of each class: half of them give a slice of
``slice_bytes`` from the middle of the text to the dictionaries (all of them are used), the others three numbers each.
Scoring is one Arrow function of the whole text; no other column leaves the JVM.

Defined results: null and empty texts are scored as empty; a document with two labels counts as its lowest; repeated rows are
scored alike; with labels of one class or none every score is the smoothed share of good ones; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import array_pieces, drawn, in_small_batches
from clausewright.llm._words import Words, mix

_SHAPE = np.array([97 if 97 <= i <= 122 or i >= 128 else 65 if 65 <= i <= 90 else 48 if 48 <= i <= 57 else i for i in range(256)], np.uint8)
#: Bytes of a block of each view.
BLOCKS = (256, 64, 32)
#: Words back to which a repeated word is marked.
BACK = 12


def _since(words: Words) -> np.ndarray:
    """For each word the number of words since it last occurred in its text, BACK + 1 where that is more."""
    same = mix(words.hashes()) + words.doc().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(same, kind="stable")
    out = np.full(len(same), BACK + 1, np.int64)
    equal = same[order][1:] == same[order][:-1]
    out[order[1:][equal]] = np.minimum(np.diff(order)[equal], BACK + 1)
    return out


def views(texts: pa.Array) -> list[list[bytes]]:
    """The three views of each text."""
    words = Words(texts)
    since = _since(words)
    marked = since <= BACK
    signs = _SHAPE[words.data]
    change = np.zeros(len(signs) + 1, np.int64)
    change[words.starts] = 1
    change[words.ends] -= 1
    keep = np.cumsum(change[:-1]).astype(bool)
    first = np.zeros(len(signs), bool)
    first[words.starts] = True
    keep[1:] &= first[1:] | (signs[1:] != signs[:-1])
    kept = np.append(0, np.cumsum(keep))
    sizes = kept[words.ends] - kept[words.starts] + marked + 1  # a mark, the shape, a blank
    ends = np.cumsum(sizes)
    shapes = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    shapes[(ends - sizes)[marked]] = 192 + since[marked]
    place = np.repeat(ends - sizes + marked, sizes - marked - 1) + np.arange(kept[-1]) - np.repeat(kept[words.starts], sizes - marked - 1)
    shapes[place] = signs[keep]
    said = np.where(marked, np.uint8(61), np.uint8(126))
    bounds = np.append(0, ends)[words.first]
    return [[body[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)] for body, at in ((words.data, words.offsets), (shapes, bounds), (said, words.first))]


@dataclass
class CompressionScorer:
    """``dictionaries``: good and bad, for each view in turn."""

    dictionaries: tuple[bytes, ...] = ()
    level: int = 6
    prior: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    _made: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": []}

    def differences(self, texts: pa.Array) -> np.ndarray:
        """(bad - good) / (bad + good + 64) of the compressed sizes of each view: texts x 3."""
        if not self._made:
            for raw in self.dictionaries:
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=self.level)
                self._made.append(zstandard.ZstdCompressor(level=self.level, dict_data=held, write_content_size=False, write_dict_id=False))
        out = np.zeros((len(texts), len(BLOCKS)))
        for v, (bodies, block) in enumerate(zip(views(texts), BLOCKS, strict=True)):
            good_size, bad_size = (c.compress for c in self._made[2 * v : 2 * v + 2])
            for i, body in enumerate(bodies):
                good = bad = 0
                for at in range(0, max(1, len(body)), block):
                    piece = body[at : at + block]
                    good += len(good_size(piece))
                    bad += len(bad_size(piece))
                out[i, v] = (bad - good) / (bad + good + 64)
        return out

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        design = self._design(x)
        w = np.zeros(design.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            slope = design.T @ (p - y) + ridge * w
            w = w - np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w)), slope)
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of a good text, from its differences."""
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = 2000, slice_bytes: int = 512) -> CompressionScorer:
    """A scorer from rows of ``labels`` for which ``allowed`` holds: at most ``per_class`` of each class, the first by a hash of doc_id.

    Half of them go into the dictionaries, so each holds per_class / 2 slices of at most 2 * ``slice_bytes`` bytes or so; the others into the calibration.
    """
    labels = labels.select("doc_id", "quality").where(allowed & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = labels.withColumn("draw", F.xxhash64("doc_id", F.lit(11)))
    chosen = drawn(labels.where("quality = 1"), per_class, F.col("draw")).unionByName(drawn(labels.where("quality = 0"), per_class, F.col("draw")))
    ids = chosen.select("doc_id", "quality", (F.pmod("draw", F.lit(2)) == 0).alias("for_dictionary"))
    ids = ids.sparkSession.createDataFrame(ids.collect(), ids.schema)  # at most 2 * per_class rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").withColumn("draw", F.xxhash64("doc_id", "text", F.lit(12)))
    middle = F.greatest(F.lit(1), F.floor(F.length("text") / 2) - slice_bytes // 2).cast("int")
    slices = texts.where("for_dictionary").select("quality", F.substring("text", middle, F.lit(slice_bytes)).alias("text"), "draw").orderBy("draw", "text").limit(2 * per_class).collect()
    raw = []
    for q in (1, 0):
        seen = views(pa.array([r["text"] for r in slices if r["quality"] == q], pa.string()))
        raw.append([b"\n".join(v) or b"\n" for v in seen])
    scorer = CompressionScorer(tuple(x for pair in zip(*raw, strict=True) for x in pair))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("array<double>")
    def differences(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            for part in array_pieces(array):
                yield pa.array(shared.value.differences(part).tolist(), pa.list_(pa.float64()))

    rows = texts.where("NOT for_dictionary").orderBy("draw", "text").limit(2 * per_class).select("quality", "draw", differences("text").alias("x"))
    rows = sorted(in_small_batches(rows).collect(), key=lambda r: (r["draw"], r["x"]))  # a sum's last digits follow the order
    y = np.array([r["quality"] for r in rows], float)
    scorer.prior = float((y.sum() + 1) / (len(y) + 2))
    if 0 < y.sum() < len(y):
        scorer.calibrate(np.array([r["x"] for r in rows]), y)
    return scorer


def scored(docs: DataFrame, scorer: CompressionScorer, text: str = "text") -> Column:
    """The score (0 to 1) of a text column of ``docs``."""
    shared = in_small_batches(docs).sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            for part in array_pieces(array):
                yield pa.array(shared.value.score(shared.value.differences(part)))

    return of(F.coalesce(F.col(text), F.lit("")))


def score(docs: DataFrame, scorer: CompressionScorer) -> DataFrame:
    """doc_id, score (0 to 1)."""
    return docs.select("doc_id", scored(docs, scorer).alias("score"))


def accepted(docs: DataFrame, scorer: CompressionScorer, least: float) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    return docs.where(scored(docs, scorer) >= least)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
