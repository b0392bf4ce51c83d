"""Token ids of many texts by the tokenizers library, which sees every distinct word of a block of texts once.

Where a tokenizer's file says that white space only separates (the split removes it, and every pre-token ends with a token
that closes a word), the ids of a text are those of its words one after another. Words are then made distinct by Arrow;
words of letters go to the library in lines of many, and the tokens that close words tell them apart; all others go one by
one. Any other file's texts go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Signs that stand behind a word and are a pre-token of their own there, and letters and digits before which that is so.
_TAIL, _BEFORE = ".,;:!?", "[a-z0-9À-ÖØ-öø-ÿ]$"
#: Words in a line that the library gets.
LINE = 500
#: Words whose ids are put together at a time.
STEP = 1 << 18
#: Longer texts, in bytes, are cut at white space before they are split.
LONG = 8 << 20
_SPACES = re.compile(r"[ \t\n\v\f\r]")


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all items of segments, one segment after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def cut(text: str, most: int = LONG) -> list[str]:
    """``text`` in parts of about ``most`` signs that end at white space; a part without any is not cut."""
    out, at = [], 0
    while len(text) - at > most:
        found = _SPACES.search(text, at + most)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class LibraryEncoder:
    """``source``: the text of a tokenizer's JSON file. Truncation and padding are switched off."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        file = json.loads(source)
        special = [t["content"] for t in file["added_tokens"]]
        size = 1 + max([*self.library.get_vocab(with_added_tokens=True).values()])
        self.width = 2 if size <= 1 << 16 else 4
        self.closes = np.zeros(size, bool)
        suffix = file["model"].get("end_of_word_suffix")
        if suffix:
            self.closes[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        kinds = lambda part, many: [x["type"] for x in ((file.get(part) or {}).get(many) or [])]
        split = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_words = bool(
            suffix
            and kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"]
            and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
            and (split.get("behavior"), split.get("invert")) == ("Removed", True)
            and all("<|" in t and not re.search(r"\s", t) for t in special)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"])
        )

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each of the distinct ``words`` has."""
        plain = pc.and_(pc.match_substring_regex(words, r"^\p{L}+$"), pc.invert(pc.match_substring(words, "İ")))
        plain = plain.to_numpy(zero_copy_only=False)
        listed = words.to_pylist()
        places = np.flatnonzero(plain)
        lines, of = [], []
        odd = [np.flatnonzero(~plain)]
        for at in range(0, len(places), LINE):
            group = places[at : at + LINE]
            line = " ".join([listed[i] for i in group.tolist()])
            if unicodedata.is_normalized("NFC", line):
                lines.append(line)
                of.append(group)
            else:
                odd.append(group)
        parts, sizes, order = [], [], []
        for at in range(0, len(lines), 64):
            for e, group in zip(self.library.encode_batch_fast(lines[at : at + 64], add_special_tokens=False), of[at : at + 64], strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(group) and ends[-1] == len(ids):
                    parts.append(ids)
                    sizes.append(np.diff(ends, prepend=0))
                    order.append(group)
                else:  # the library knows letters that this Arrow does not, or the other way round
                    odd.append(group)
        rest = np.concatenate(odd)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            ids, counts = self._one_by_one([listed[i] for i in some.tolist()])
            parts.append(ids)
            sizes.append(counts)
            order.append(some)
        if not order:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat, lengths, order = np.concatenate(parts), np.concatenate(sizes), np.concatenate(order)
        starts = np.cumsum(lengths) - lengths
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return flat[_ragged(starts[back], lengths[back])], lengths[back]

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct strings without white space: what stands behind a word is split off and words in capitals are made small first, which leaves fewer."""
        special = pc.match_substring(chunks, "<|")
        small = pc.if_else(special, chunks, pc.ascii_lower(chunks)).dictionary_encode()
        words = small.dictionary
        core = pc.utf8_rtrim(words, _TAIL)
        tailed = pc.and_(pc.match_substring_regex(core, _BEFORE), pc.less(pc.binary_length(core), pc.binary_length(words)))
        tail = pc.if_else(tailed, pc.struct_field(pc.extract_regex(words, f"(?P<t>[{_TAIL}]*)$"), "t"), "").dictionary_encode()
        core = pc.if_else(tailed, core, words).dictionary_encode()
        at = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (small, core, tail)]
        ids, counts = self._words(core.dictionary)
        tail_ids, tail_counts = self._one_by_one(tail.dictionary.to_pylist())
        starts, tail_starts = np.cumsum(counts) - counts, np.cumsum(tail_counts) - tail_counts + len(ids)
        both = np.concatenate([ids, tail_ids])
        first, second = at[1][at[0]], at[2][at[0]]
        begin = np.stack([starts[first], tail_starts[second]], 1).ravel()
        length = np.stack([counts[first], tail_counts[second]], 1)
        return both[_ragged(begin, length.ravel())], length.sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and how many each has. Null texts have none."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        if not self.by_words:
            return self._one_by_one(texts.to_pylist())
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids, counts = self._distinct(coded.dictionary)
        starts = np.cumsum(counts) - counts
        indices = coded.indices.to_numpy(zero_copy_only=False)
        out, total = [], np.zeros(len(indices) + 1, np.int64)
        for low in range(0, len(indices), STEP):
            some = indices[low : low + STEP]
            out.append(ids[_ragged(starts[some], counts[some])])
            total[low + 1 : low + 1 + len(some)] = counts[some]
        total = np.cumsum(total)
        offsets = np.asarray(split.offsets)
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.diff(total[offsets - offsets[0]])
