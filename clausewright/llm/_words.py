"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


#: Bytes that are hashed at a time; memory for powers and sums follows this, not the longest text or word.
STEP = 1 << 16
_POWER, _UNPOWER = _powers(STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """``data``: bytes; word i is data[starts[i]:ends[i]]; text t has words first[t]:first[t + 1]. Null texts have none."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.data = _LOWER[data] if lower else data
        inside = ~_SPACE[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[offsets] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.offsets = offsets
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit word hashes, the same in every process: a polynomial in the bytes, scrambled with the length."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            low = int(self.starts[at])
            to = int(np.searchsorted(self.ends, low + STEP, "right"))
            if to > at:
                sums = np.zeros(STEP + 1, np.uint64)
                part = self.data[low : int(self.ends[to - 1])]
                np.cumsum(_BYTE[part] * _POWER[: len(part)], out=sums[1 : len(part) + 1])
                starts = self.starts[at:to] - low
                out[at:to] = (sums[self.ends[at:to] - low] - sums[starts]) * _UNPOWER[starts]
            else:  # a word of more than a step
                to, total, scale, step = at + 1, 0, 1, pow(_BASE, STEP, 2**64)
                for k in range(low, int(self.ends[at]), STEP):
                    part = self.data[k : min(k + STEP, int(self.ends[at]))]
                    total += scale * int((_BYTE[part] * _POWER[: len(part)]).sum(dtype=np.uint64))
                    scale = scale * step % 2**64
                out[at] = total % 2**64
            at = to
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def where(self) -> np.ndarray:
        """The place of each word in its text, from 0."""
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.counts)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n items that begin at each place but the last n - 1; across texts too, for the caller to leave out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : len(hashes) - n + 1 + i]
    return mix(out)
