"""Substring dedup: windows of words that an earlier document has too are removed, found by FM-indexes of word runs.

Every window of ``width`` words has a minimizer, the least hash of its 5-word grams. Equal windows have equal
minimizers, so a run of windows with one minimizer is a piece that need only meet the pieces with the same one: that is
the shard in which it is indexed or streamed, whatever the size of the corpus. Minimizers that no second document has
are dropped by a count before any piece moves; one that many documents of a slice have moves as two rows for all of
them. Equal pieces are one row with their least and greatest document; pieces of a minimizer that is frequent are cut
into single windows, each with a key of its own, and a task sends each of those once, so that no group grows with the
input.

Of a shard's pieces, those that some later document might repeat are indexed, and those that some earlier one might
hold are streamed. The index is compressed: the Burrows-Wheeler transform as a wavelet matrix of packed bits, lengths of
common prefixes as bytes, and for each run of suffixes with equal first ``width`` words the least document that has
them, kept at the run's first place only. A streamed piece is searched backward from its end, and gives its matching
statistics: the length of the longest match, up to ``width`` words, that begins at each place. Where a word cannot be put before a match, the
match is cut from behind to the next length at which more suffixes share it, and the word is tried again.
Matches of ``width`` words, whose interval's least document is an earlier one, are reported.

Pieces are the words themselves, so a match is exact; hashes of 64 bits only say which pieces meet.

Defined results: null and empty texts have no words; a null doc_id is neither earlier nor later than any and loses
nothing; rows with equal doc_id do not take words from each other; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import in_small_batches, pieces
from clausewright.llm._words import _SPACE, Words, mix, windows

GRAM = 5
#: Windows in a piece at most.
LONGEST = 32


class _Runs:
    """Runs of windows with one minimizer, over the texts of a slice."""

    def __init__(self, texts: pa.Array, width: int):
        self.words = Words(texts)
        self.hashes = self.words.hashes()
        n = len(self.hashes) - width + 1
        if n <= 0:
            self.at = self.length = self.doc = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        least = grams = windows(self.hashes, GRAM)
        held = 1
        while held < width - GRAM + 1:
            step = min(held, width - GRAM + 1 - held)
            least = np.minimum(least[: len(least) - step], least[step:])
            held += step
        doc = self.words.doc()
        at = np.flatnonzero(doc[:n] == doc[width - 1 :])
        value, doc = least[at] >> np.uint64(16), doc[at]  # 48 bits: it only says which pieces meet
        new = np.ones(len(at), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        new[(np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % LONGEST == 0] = True
        first = np.flatnonzero(new)
        self.at, self.key, self.doc = at[first], value[first], doc[first]
        self.length = np.diff(np.append(first, len(at)))


def _whole(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of all the words of each text, to tell rows with equal doc_id apart."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + words.where().astype(np.uint64)), out=total[1:])
    return (mix(total[words.first[1:]] - total[words.first[:-1]] + words.counts.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: they are shuffled once, and that is most of what the shuffle writes."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in pieces(batch):
            texts = [None if x is None else pack.compress(x.encode()) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])


def _unpacked_texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, with the texts as they were."""
    unpack = zstandard.ZstdDecompressor()
    for part in pieces(batch, most=1 << 19):
        texts = [None if x is None else unpack.decompress(x) for x in part.column("text").to_pylist()]
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))


def _minimizers(width: int, local: int):
    """Minimizers with the documents that have them. One that ``local`` or more documents of a slice have is two rows there, for the least and the greatest of them (kind 1), whatever their number; those documents are told at once (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                runs = _Runs(part.column("text"), width)
                ident = part.column("doc_id").to_numpy(zero_copy_only=False)[runs.doc] if len(runs.doc) else np.zeros(0, np.int64)
                order = np.lexsort((ident, runs.key))
                key, ident = runs.key[order], ident[order]
                once = np.ones(len(key), bool)
                once[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
                key, ident = key[once], ident[once]
                first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
                n = np.diff(np.append(first, len(key)))
                many = np.repeat(n >= local, n)
                ends = np.concatenate((first[n >= local], (first + n - 1)[n >= local]))
                key, ident, kind = np.concatenate((key, key[ends])), np.concatenate((ident, ident[ends])), np.concatenate((np.where(many, 2, 0), np.ones(len(ends), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ident.astype(np.int64)), pa.array(kind.astype(np.int8))], ["m", "doc_id", "kind"])

    return run


def _cut(part: pa.RecordBatch, width: int) -> tuple[_Runs, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces whose minimizer is shared: their text, first word, windows and key; windows of frequent minimizers one by one."""
    runs = _Runs(part.column("text"), width)
    lists = part.column("shared")
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    flat = lists.flatten()
    m, often = flat.field("m").to_numpy(zero_copy_only=False).view(np.uint64), flat.field("often").to_numpy(zero_copy_only=False)
    known = mix(m) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(known)
    own = mix(runs.key) + runs.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    where = np.minimum(np.searchsorted(known[order], own), max(len(known) - 1, 0))
    held = (known[order][where] == own) if len(known) else np.zeros(len(own), bool)
    split = held & (often[order][where] if len(known) else held)
    held &= ~split
    at, length, key, doc = runs.at[held], runs.length[held], runs.key[held], runs.doc[held]
    if split.any():
        n = runs.length[split]
        one = np.repeat(runs.at[split], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        single = windows(runs.hashes, width)[one] >> np.uint64(16)
        at, length, key, doc = np.append(at, one), np.append(length, np.ones(len(one), length.dtype)), np.append(key, single), np.append(doc, np.repeat(runs.doc[split], n))
    return runs, doc, at, length, key


def _piece_hash(hashes: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of the words of each piece that does not depend on where it is."""
    order = np.repeat(np.cumsum(words) - words, words)
    place = np.arange(words.sum()) - order
    scrambled = mix(hashes[np.repeat(at, words) + place] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    total = np.zeros(len(scrambled) + 1, np.uint64)
    np.cumsum(scrambled, out=total[1:])
    return mix(total[np.cumsum(words)] - total[np.cumsum(words) - words] + words.astype(np.uint64))


def _plain(words: Words) -> tuple[bytes, np.ndarray]:
    """All words with one blank after each, and where each begins there."""
    sizes = words.ends - words.starts + 1
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inside = np.arange(len(out) - len(sizes)) + np.repeat(np.arange(len(sizes)), sizes - 1)
    out[inside] = words.data[np.repeat(words.starts - (ends - sizes - np.arange(len(sizes))), sizes - 1) + np.arange(len(inside))]
    return out.tobytes(), np.append(0, ends)


_PIECES = ["key", "words", "low", "high"]
#: Single windows that a task holds back, so as to send each once.
HELD = 100_000


def _indexed_pieces(width: int):
    """Each different piece of a slice once, with its least and greatest document; single windows once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def rest() -> pa.RecordBatch:
            rows = [pa.array(list(held), pa.int64()), *(pa.array([x[i] for x in held.values()], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64())))]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, _PIECES)

        for batch in batches:
            for part in _unpacked_texts(batch):
                runs, doc, at, length, key = _cut(part, width)
                words = length + width - 1
                same = key ^ _piece_hash(runs.hashes, at, words)
                order = np.argsort(same, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], same[order][1:] != same[order][:-1]))) if len(order) else order
                owner = pc.fill_null(part.column("doc_id"), 0).to_numpy()[doc][order]  # rows without an id have no pieces
                low, high = ((f.reduceat(owner, first) if len(first) else owner).astype(np.int64) for f in (np.minimum, np.maximum))
                keep = order[first]
                key, at, words = key[keep].view(np.int64), at[keep], words[keep]
                body, begin = _plain(runs.words)
                pieces_ = [body[a:b] for a, b in zip(begin[at].tolist(), begin[at + words].tolist(), strict=True)]
                one = words == width
                for i in np.flatnonzero(one).tolist():
                    x = held.setdefault((k := int(key[i])), [pieces_[i], int(low[i]), int(high[i])])
                    if x[0] == pieces_[i]:
                        x[1], x[2] = min(x[1], int(low[i])), max(x[2], int(high[i]))
                    else:  # another window with this key
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pieces_[i]], pa.binary()), pa.array([low[i]]), pa.array([high[i]])], _PIECES)
                more = np.flatnonzero(~one)
                yield pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array([pieces_[i] for i in more.tolist()], pa.binary()), pa.array(low[more]), pa.array(high[more])], _PIECES)
                if len(held) > HELD:
                    yield rest()
        if held:
            yield rest()

    return run


def _places(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _unpacked_texts(batch):
                runs, doc, at, length, key = _cut(part, width)
                whole = _whole(runs.words, runs.hashes)
                h = _piece_hash(runs.hashes, at, length + width - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), part.column("doc_id").take(pa.array(doc)), pa.array(whole[doc]), pa.array((at - runs.words.first[doc]).astype(np.int32))],
                    ["key", "h", "doc_id", "row", "at"],
                )

    return run


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit array for each bit of a symbol; bits are packed, with a count for each 64."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in reversed(range(self.depth)):
            bits = (symbols >> level & 1).astype(bool)
            packed = np.zeros(8 * (len(bits) // 64 + 1), np.uint8)
            raw = np.packbits(bits, bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed))[:-1])).astype(np.int64))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        self.origin = self._down(np.zeros(sigma + 1, np.int64), np.arange(sigma + 1))

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k in range(self.depth):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.depth - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(at, symbol) - self.origin[symbol]


class FMIndex:
    """A compressed index of pieces, each an array of symbols from 1 to ``sigma``, with the least document that has each run of ``width`` symbols.

    What is kept: the transform's wavelet matrix, the counts of lesser symbols, a byte a suffix for the length that it
    shares with the one before it (up to ``width``), and the first suffix and the least document of each run of those
    that share ``width``. The text and the order of the suffixes are let go.
    """

    def __init__(self, pieces_of_words: list[np.ndarray], documents: np.ndarray, sigma: int, width: int):
        self.width = width
        lengths = np.array([len(p) for p in pieces_of_words])
        n = int(lengths.sum() + len(lengths))
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[np.cumsum(lengths + 1) - 1] = False  # a 0 after each piece
        text[inside] = np.concatenate(pieces_of_words)
        rank, ranks = text, {}
        for step in (1, 2, 4, 8):
            ranks[step] = rank
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 3) + after if step == 1 else rank * (n + 2) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        # The suffixes are in the order of their first 16 symbols; what neighbours share is found by halves.
        shared = np.zeros(n - 1, np.int64)
        for step in (8, 4, 2, 1):
            a, b = order[:-1] + shared, order[1:] + shared
            both = (a < n) & (b < n)
            both[both] = ranks[step][a[both]] == ranks[step][b[both]]
            shared += step * both
        self.lcp = np.zeros(n + 1, np.uint8)
        self.lcp[1:n] = np.minimum(shared, width)
        first = np.flatnonzero(self.lcp[:n] < width)
        self.first = np.append(first, n).astype(np.int32)
        self.least = np.minimum.reduceat(np.repeat(documents, lengths + 1)[order], first)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        self.ranks = WaveletMatrix(text[order - 1], sigma)
        self._cuts: dict[int, np.ndarray] = {}

    def _cut(self, depth: int) -> np.ndarray:
        """The suffixes that share less than ``depth`` with the one before: where the intervals of that depth begin and end."""
        if depth not in self._cuts:
            self._cuts[depth] = np.flatnonzero(self.lcp < max(1, depth)).astype(np.int32) if depth else np.array([0, len(self.lcp) - 1], np.int32)
        return self._cuts[depth]

    def statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pieces text[starts:ends]: for each place the length of the longest match that begins there, up to ``width``, and
        where it is ``width`` the least document that has those symbols. All pieces are streamed together, from their ends."""
        n = len(self.lcp) - 1
        matched, earliest = np.zeros(len(text), np.int64), np.full(len(text), np.iinfo(np.int64).max)
        at = ends - 1
        low, high, length = np.zeros(len(at), np.int64), np.full(len(at), n), np.zeros(len(at), np.int64)
        live = np.flatnonzero(at >= starts)
        while len(live):
            symbol = text[at[live]]
            found = self.smaller[symbol] + self.ranks.rank(np.tile(symbol, 2), np.concatenate((low[live], high[live]))).reshape(2, -1)
            fits = found[0] < found[1]
            some = live[fits]
            low[some], high[some] = found[0, fits], found[1, fits]
            length[some] += 1
            full = some[length[some] >= self.width]
            run = np.searchsorted(self.first, low[full], "right") - 1
            low[full], high[full], length[full] = self.first[run], self.first[run + 1], self.width
            earliest[at[full]] = self.least[run]
            # No match can be made longer here: it is cut to the next length that more suffixes share, or there is none.
            over = live[~fits & (length[live] > 0)]
            shorter = np.maximum(self.lcp[low[over]], self.lcp[high[over]]).astype(np.int64)
            for d in np.unique(shorter).tolist():
                mine, cuts = over[shorter == d], self._cut(d)
                low[mine] = cuts[np.searchsorted(cuts, low[mine], "right") - 1]
                high[mine] = cuts[np.searchsorted(cuts, high[mine], "left")]
            length[over] = shorter
            done = np.setdiff1d(live, over, assume_unique=True)
            matched[at[done]] = length[done]
            at[done] -= 1
            live = live[at[live] >= starts[live]]
        return matched, earliest


def _search(width: int, shard_words: int):
    """For the pieces of each shard that an earlier document might hold, the least document of each of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch) -> pa.RecordBatch:
            key, low, high = (rows.column(c).to_numpy() for c in ("key", "low", "high"))
            words = Words(rows.column("words").cast(pa.string()))
            data = words.data.tobytes()
            said = pc.dictionary_encode(pa.array([data[s:e] for s, e in zip(words.starts.tolist(), words.ends.tolist(), strict=True)], pa.binary()))
            symbols = said.indices.to_numpy().astype(np.int64) + 1
            group = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(group, len(key)))
            indexed = low < np.repeat(np.maximum.reduceat(high, group), sizes)
            streamed = np.flatnonzero(high > np.repeat(np.minimum.reduceat(low, group), sizes))
            begin, end = words.first[:-1], words.first[1:]
            kept: list[int] = []
            found: list[np.ndarray] = []
            if indexed.any() and len(streamed):
                index = FMIndex([symbols[a:b] for a, b in zip(begin[indexed].tolist(), end[indexed].tolist(), strict=True)], low[indexed], len(said.dictionary), width)
                matched, earliest = index.statistics(symbols, begin[streamed], end[streamed])
                hits = np.where(matched >= width, earliest, np.iinfo(np.int64).max)
                for i, a, b in zip(streamed.tolist(), begin[streamed].tolist(), end[streamed].tolist(), strict=True):
                    row = hits[a : b - width + 1]
                    if (row < high[i]).any():
                        kept.append(i)
                        found.append(row)
            h = _piece_hash(words.hashes(), begin[kept], (end - begin)[kept]) if kept else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(h.view(np.int64)), pa.array(found, pa.list_(pa.int64()))], ["key", "h", "earliest"])

        rest = None
        for batch in batches:
            rest = pa.concat_batches([rest, batch]) if rest is not None else batch
            while rest.num_rows:
                # Up to the end of the key with which the shard is full.
                count = np.cumsum(pc.binary_length(rest.column("words")).to_numpy(zero_copy_only=False)) // 6
                full = int(np.searchsorted(count, shard_words))
                key = rest.column("key").to_numpy()
                change = np.flatnonzero(key[full:][1:] != key[full:][:-1]) if full < len(key) else []
                if not len(change):
                    break
                cut = full + int(change[0]) + 1
                yield out(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield out(rest)

    return run


def _strip(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _unpacked_texts(batch):
                words = Words(part.column("text"))
                whole = _whole(words, words.hashes())
                # All windows that go, of all texts of the slice at once; those of rows with the same doc_id and other words are passed over.
                lists = part.column("found")
                owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                flat = lists.flatten()
                places = pc.struct_field(flat, "at")
                sizes = pc.list_value_length(places).to_numpy()
                mine = np.repeat(pc.struct_field(flat, "row").to_numpy() == whole[owner], sizes)
                at = (words.first[np.repeat(owner, sizes)] + places.flatten().to_numpy())[mine]
                n = len(words.starts)
                gone = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1))[:n] > 0
                kept = np.append(0, np.cumsum(~gone))
                lost = words.counts - (kept[words.first[1:]] - kept[words.first[:-1]])
                # A text that keeps all its words, with one blank of any kind between them, is a run of the bytes.
                blank = words.data.copy()
                blank[_SPACE[blank]] = 32
                data = blank.tobytes()
                wide = np.append(0, np.cumsum(np.append(words.starts[1:] - words.ends[:-1] != 1, True))) if n else np.zeros(1, np.int64)
                texts = []
                for t, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
                    if a < b and not lost[t] and wide[b - 1] == wide[a]:
                        texts.append(data[words.starts[a] : words.ends[b - 1]])
                    else:
                        keep = np.flatnonzero(~gone[a:b]) + a
                        texts.append(b" ".join([data[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), pa.array(lost), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, width: int = 13, often: int = 1000, local: int = 8, shard_words: int = 1 << 18) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one blank).

    A word goes if it lies in a window of ``width`` words (8 to 16) that also starts in a document with a smaller doc_id.
    """
    if not 8 <= width <= 15:
        raise ValueError("width must be from 8 to 15: suffixes are sorted by 16 words")
    docs = in_small_batches(docs).select("doc_id", "text")
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = some.mapInArrow(_minimizers(width, local), "m long, doc_id long, kind tinyint")
    # One shuffle serves the count and the join with it, as both read the same columns under the same filter (the
    # join below asks for doc_id anyway, so it is named here for both); a frequent
    # minimizer is a few rows a slice in it, not one a document.
    dealt = found.where("kind < 2 AND doc_id IS NOT NULL").repartition("m")
    shared = dealt.groupBy("m").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("kind").alias("kind"), F.count("*").alias("n")).where("low < high").select("m", ((F.col("kind") == 1) | (F.col("n") > often)).alias("often"))
    told_here = found.where("kind = 2").select("doc_id", "m", F.lit(True).alias("often"))
    told_there = dealt.join(shared, "m").select("doc_id", "m", (F.col("often") | (F.col("kind") == 1)).alias("often"))
    by_doc = told_here.unionByName(told_there).groupBy("doc_id").agg(F.collect_list(F.struct("m", "often")).alias("shared"))
    # Both joins with the texts are left joins of the same rows, so the texts are shuffled once.
    packed = docs.mapInArrow(_packed, "doc_id long, text binary")
    told = packed.join(by_doc, "doc_id", "left")
    indexed = told.mapInArrow(_indexed_pieces(width), "key long, words binary, low long, high long").repartition("key")
    indexed = indexed.groupBy("key", "words").agg(F.min("low").alias("low"), F.max("high").alias("high")).sortWithinPartitions("key")
    searched = indexed.mapInArrow(_search(width, shard_words), "key long, h long, earliest array<long>")
    places = told.mapInArrow(_places(width), "key long, h long, doc_id long, row int, at int")
    later = F.filter(F.transform("earliest", lambda x, i: F.when(x < F.col("doc_id"), F.col("at") + i)), lambda x: x.isNotNull())
    gone = places.join(searched, ["key", "h"]).select("doc_id", "row", later.alias("at")).where(F.size("at") > 0)
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("row", "at")).alias("found"))
    return packed.join(gone, "doc_id", "left").mapInArrow(_strip(width), "doc_id long, n_words long, n_removed long, kept_text string")
