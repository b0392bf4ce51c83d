"""Secret scans: fixed patterns, and strings that a primed compressor finds novel beside sensitive words.

A candidate is a run of 16 or more key characters, shortly after or before a sensitive word. Its novelty is the
marginal compressed size: the bytes that zstandard needs for the surrounding text (``context`` characters on each side)
with the candidate in it, less those for that text alone, both primed with a dictionary of identifiers: common ones by
rule, and those that documents of the corpus share, counted by Spark over all documents. Other
places of the candidate are cut from the text after it, and a string that occurs again gets the verdict of its first
place, so a repeated key is reported each time. Ordinary identifiers cost little; keys cost nearly their entropy. What
a key would cost is measured too: by random strings of the candidate's length and alphabet in the same text (of at most
``LONGEST`` characters, and in proportion beyond), so that short alphabets and long strings, which zstandard codes in
fewer bytes a character, count as novel all the same. Candidates with ``least`` of that cost or more are reported, if they
are incompressible at all: ``LEAST_BITS`` a character, and signs of an alphabet of ``LEAST_SIGNS`` or more, so that rules of
dashes, underscores and the like are none. The time is linear in the text.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; no rows give no rows; other
columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm._shared import checkpointed, in_small_batches, most_frequent

#: Kinds in the order in which spans that begin at the same place are listed.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_SENSITIVE = re.compile(r"(?:secret|token|passw|passphrase|credential|bearer|authorization|private|signature|access.?key|api.?key|client.?id)", re.I | re.A)
LEAST_LENGTH = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")
_HEX_RUN = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Random strings that a candidate is compared with, and their greatest length.
_DRAWS, LONGEST = 6, 1024
#: What a novel string takes at least: bits a character, and signs that it may be drawn from (digits are ten).
LEAST_BITS, LEAST_SIGNS = 2.0, 10
_VERBS = "get set is has make create update delete read write load save open close send parse find check add remove init test run".split()
_NOUNS = "name value key user file path data type id index list map config token secret password client server request response session url host port message error result".split()
#: Identifiers of the corpus that are taken.
IDENTIFIERS = 2048


def corpus_identifiers(docs: DataFrame) -> list[str]:
    """At most ``IDENTIFIERS`` names of 4 to 15 letters and underscores that most documents have, and two at least.

    Shorter than any candidate and without digits, so that no key that many copies hold becomes known. Each text is
    searched once, in Spark; what is shuffled are a task's counts.
    """
    name = F.lit(r"(?<![A-Za-z0-9+/=_-])[A-Za-z][A-Za-z_]{3,14}(?![A-Za-z0-9+/=_-])")
    names = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", name, F.lit(0)))).alias("word"))
    counts = names.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return sorted(r["word"] for r in most_frequent(checkpointed(counts), IDENTIFIERS).collect())


def identifier_dictionary(names: Sequence[str] = ()) -> bytes:
    """``names``, then identifiers in the usual styles and lines of code that hold them, by rule."""
    styled = [style(v, n) for n in _NOUNS for v in _VERBS for style in (lambda v, n: f"{v}_{n}", lambda v, n: v + n.capitalize(), lambda v, n: f"{v}-{n}", lambda v, n: f"{v}_{n}".upper())]
    lines = [form.format(n) for n in _NOUNS for form in ('{0} = "', "export {0}=", '"{0}": "', "{0}: ", "self.{0} = {0}", "--{0}=", "def get_{0}(self):", "return {0}", "0123456789abcdef ", "import {0}")]
    return "\n".join([*names, *styled, *lines]).encode()


def alphabet(candidate: str) -> str:
    """The signs that a key like this is drawn from: hexadecimal digits of one case, or classes of letters, digits and each sign that occurs."""
    if _HEX_RUN.fullmatch(candidate):
        return string.digits + ("" if candidate.isdigit() else "abcdef" if candidate.islower() else "ABCDEF")
    held = set(candidate)
    return "".join(c for c in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if held & set(c)) + "".join(sorted(held & set("+/_=-")))


def _base(text: str) -> list[tuple[int, int, int]]:
    found = []
    if _HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that the spans cover."""
    starts, ends = [], []
    for s, _, e in sorted(spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


class Scanner:
    """Spans (start, kind, end) of a text; the compressor is made where it is used."""

    def __init__(self, dictionary: bytes, near: int = 64, context: int = 512, least: float = 0.8):
        self.dictionary, self.near, self.context, self.least = dictionary, near, context, least
        self._size = None

    def __getstate__(self):
        return self.__dict__ | {"_size": None}

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """The candidate's marginal compressed bytes, as a part of what a random string would take in its place; 0 where it is compressible by itself."""
        signs = alphabet(candidate)
        if len(signs) < LEAST_SIGNS:
            return 0.0
        if self._size is None:
            words = zstandard.ZstdCompressionDict(self.dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=9)
            compress = zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False, write_dict_id=False).compress
            self._size = lambda x: len(compress(x))
        a, b = before.encode("utf-8", "replace"), after.encode("utf-8", "replace")
        alone = self._size(a + b)
        n = min(len(candidate), LONGEST)
        own = self._size(a + candidate.encode() + b) - alone
        if 8 * own < LEAST_BITS * len(candidate):
            return 0.0
        rng = random.Random(len(candidate))
        random_one = min(self._size(a + "".join(rng.choices(signs, k=n)).encode() + b) for _ in range(_DRAWS)) - alone
        return own / max(1, random_one * len(candidate) / n)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found = _base(text)
        starts, ends = _merged(found)
        verdicts: dict[str, bool] = {}
        seen = last = 0

        def consider(start: int, end: int) -> None:
            at = bisect_left(ends, start + 1)
            if at < len(starts) and starts[at] < end:
                return
            candidate = text[start:end]
            if candidate not in verdicts:
                after = text[end : end + self.context].replace(candidate, "")
                verdicts[candidate] = self.novelty(text[max(0, start - self.context) : start], candidate, after) >= self.least
            if verdicts[candidate]:
                found.append((start, 3, end))

        for m in _SENSITIVE.finditer(text):
            # Runs between the last sensitive word and this one that end shortly before it.
            for c in _CANDIDATE.finditer(text, max(last, seen), m.start()):
                if m.start() - c.end() <= self.near:
                    consider(*c.span())
            last = m.end()
            # Runs that begin shortly after it: the search stops where none can begin any more, then the run is followed to its end.
            while c := _CANDIDATE.search(text, max(last, seen), last + self.near + LEAST_LENGTH):
                seen = _CANDIDATE.match(text, c.start()).end()
                consider(c.start(), seen)
        return sorted(found)


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _shared_scanner(docs: DataFrame, names: Sequence[str] | None, settings: dict):
    names = corpus_identifiers(docs) if names is None else names
    return in_small_batches(docs).sparkSession.sparkContext.broadcast(Scanner(identifier_dictionary(names), **settings))


def scan(docs: DataFrame, names: Sequence[str] | None = None, **settings) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) in code points, end exclusive, by start and then by ``KINDS``.

    ``names``: identifiers of the dictionary besides those made by rule; by default counted from ``docs``.
    """
    scanner = _shared_scanner(docs, names, settings)

    @F.arrow_udf(_SPANS)
    def spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            yield pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scanner.value.spans(t.as_py() or "")] for t in array], _SPAN)

    return docs.select("doc_id", spans("text").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", names: Sequence[str] | None = None, **settings) -> Column:
    """The column text with every span replaced by ``mark``; overlapping spans by one."""
    scanner = _shared_scanner(docs, names, settings)

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            out = []
            for text in array:
                text = text.as_py()
                parts, at = [], 0
                for start, _, end in scanner.value.spans(text or ""):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield pa.array(out, pa.string())

    return clean("text")


def redact(docs: DataFrame, mark: str = "[SECRET]", **settings) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and n_chars, where there is such a column, set to the new length."""
    out = docs.withColumn("text", redacted(docs, mark, **settings))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def digest_columns(spans: str = "spans") -> list:
    """n_assign, n_access, n_hex, base_sha256 and spans, of the column of spans."""

    def joined(array):
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [_count(spans, kind) for kind in KINDS[:3]]
    return [*counts, F.sha2(joined(F.filter(spans, lambda x: x["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans")]


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
