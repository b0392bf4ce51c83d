"""Text as column expressions: segmentation, coverage, hashing, masking, corrections. Small helpers run in Arrow where nesting needs a counter."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: Numerals that begin a numbered clause, and heads of sections.
NUMERALS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫"
BULLET = "●"
HEAD_PENDULUM = "【靈擺效果】"
HEAD_MONSTER = r"【怪獸(效果|敘述|描述)】"
FLAVOR_HEADS = ("敘述", "描述")
BLANK = r"(?U)\s+"
_DASHES = "-―‐−–—ー"


@F.arrow_udf(BinaryType())
def packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text compressed, for a shuffle of whole texts: its own compression is a weaker one. Null stays null."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for array in texts:
        yield pa.array([None if t is None else pack(t.encode()) for t in array.to_pylist()], pa.binary())


@F.arrow_udf(StringType())
def unpacked(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts that ``packed`` was given."""
    unpack = zstandard.ZstdDecompressor().decompress
    for array in texts:
        yield pa.array([None if z is None else unpack(z) for z in array.to_pylist()], pa.binary()).cast(pa.string())


def trimmed(text: Column) -> Column:
    """Without any Unicode blanks at the ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: None if a is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in a])


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _DASHES, "-" * len(_DASHES)), r"(?U)[\s…‥]+", "")


def normalised_each(texts: Column) -> Column:
    return F.transform(nfkc_each(texts), _folded)


def normalised(text: Column) -> Column:
    """For comparing quotes: NFKC, one kind of dash, no blanks and no dots of omission."""
    return _folded(nfkc(text))


def text_hash(ja: Column, zh: Column) -> Column:
    """16 hex digits of the original text, or of the translation where there is none."""
    return F.substring(F.sha1(F.coalesce(F.nullif(ja, F.lit("")), zh, F.lit("")).cast("binary")), 1, 16)


def split_hash(zh: Column, ja: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("\u001f", F.coalesce(zh, F.lit("")), F.coalesce(ja, F.lit(""))).cast("binary")), 1, 16)


# Segmentation


def segments(text: Column) -> Column:
    """array<struct<pos, label, text>>: the part before the first numeral (label 0), then each numbered part; a text without numerals is one part labelled 1.

    A numeral cuts at the start of the text or of a line, or before a full-width colon.
    """
    cut = rf"(?=[{NUMERALS}])(?:(?<=\n)|(?<!.)(?<!\n)|(?=[{NUMERALS}]：))"  # the sign first: most places fail at once
    parts = F.filter(F.transform(F.split(text, cut), trimmed), lambda p: p != "")
    numbered = text.rlike(rf"(?:\A|\n)[{NUMERALS}]|[{NUMERALS}]：")
    starts = lambda p: F.substring(p, 1, 1).isin(list(NUMERALS))
    one = lambda label: F.transform(parts, lambda p, i: F.struct(i.alias("pos"), label(p).alias("label"), p.alias("text")))
    # Asked once a text: inside the lambda it would be asked of the whole text for every part.
    return F.when(numbered, one(lambda p: F.when(starts(p), F.substring(p, 1, 1)).otherwise("0"))).when(~numbered, one(lambda p: F.lit("1")))


def lines(text: Column) -> Column:
    """Lines with a word, trimmed, in order."""
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")


def sentences(text: Column, stop: str = "。") -> Column:
    """Sentences with their stop, trimmed, in order."""
    return F.filter(F.transform(F.split(text, rf"(?<={stop})"), trimmed), lambda x: x != "")


def sections(body: Column) -> Column:
    """array<struct<section, text>> by the heads of sections; a part of flavour text is left out."""
    pend = F.substring_index(body, HEAD_PENDULUM, -1)
    kind = F.regexp_extract(pend, HEAD_MONSTER, 1)
    parts = F.split(pend, HEAD_MONSTER, 2)
    one = lambda name, x: F.struct(F.lit(name).alias("section"), x.alias("text"))
    both = F.array(one("pendulum", F.get(parts, 0)), one("main", F.get(parts, 1)))
    return F.when(F.instr(body, HEAD_PENDULUM) == 0, F.array(one("main", body))).when(kind == "", F.array(one("pendulum", pend))).when(kind.isin(*FLAVOR_HEADS), F.array(one("pendulum", F.get(parts, 0)))).otherwise(both)


def _free(labels: list[str]) -> list[str]:
    seen: set[str] = set()
    tried: dict[str, int] = {}
    out = []
    for label in labels:
        name = label
        while name in seen:
            tried[label] = tried.get(label, 1) + 1
            name = f"{label}-{tried[label]}"
        seen.add(name)
        out.append(name)
    return out


@F.pandas_udf(ArrayType(StringType()))
def deduplicated_labels(labels: pd.Series) -> pd.Series:
    """Labels in order, repeated ones with the next free -k, k from 2."""
    return labels.map(lambda x: None if x is None else _free(list(x)))


# Coverage


def coverage(text: Column, parts: Column) -> Column:
    """struct<gaps: array<string>, missing: array<string>>: what the parts, found in order, leave of the text, and parts that are not found."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("gaps"), F.array().cast("array<string>").alias("missing"))

    def step(s: Column, part: Column) -> Column:
        place = F.call_function("locate", part, text, s["at"])
        gap = trimmed(F.substring(text, s["at"], F.greatest(place - s["at"], F.lit(0))))
        found = F.struct((place + F.length(part)).cast("int").alias("at"), F.when(gap != "", F.concat(s["gaps"], F.array(gap))).otherwise(s["gaps"]).alias("gaps"), s["missing"].alias("missing"))
        return F.when(place > 0, found).otherwise(F.struct(s["at"].alias("at"), s["gaps"].alias("gaps"), F.concat(s["missing"], F.array(part)).alias("missing")))

    def finish(s: Column) -> Column:
        rest = trimmed(F.substring(text, s["at"], F.length(text)))
        return F.struct(F.when(rest != "", F.concat(s["gaps"], F.array(rest))).otherwise(s["gaps"]).alias("gaps"), s["missing"].alias("missing"))

    return F.aggregate(parts, start, step, finish)


def covers(text: Column, parts: Column) -> Column:
    """Whether the parts, one after another, are the text but for blanks."""
    return without_blanks(F.array_join(parts, "")) == without_blanks(text)


# Corrections


def occurrences(text: Column, part: Column) -> Column:
    return F.when(part == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))).cast("int"))


def corrected(text: Column, old: Column, new: Column) -> Column:
    """``text`` with ``old`` replaced where it occurs exactly once; null elsewhere."""
    return F.when(occurrences(text, old) == 1, F.replace(text, old, new))


def reversed_corrections(text: Column, corrections: Column) -> Column:
    """The text before ``corrections`` (array<struct<from,to>>) were made, last to first; null if a result does not occur exactly once."""
    return F.aggregate(F.reverse(corrections), text, lambda t, c: corrected(t, c["to"], c["from"]))


# Masks and quotes


def quotes(text: Column) -> Column:
    """Quoted passages, once each, in order; references to numbers alone are left out."""
    found = F.regexp_extract_all(text, F.lit("『([^』]*)』"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda q: ~q.rlike(rf"\A[{NUMERALS}]+\z")))


def without_sentences(text: Column, pattern: str, stop: str = "。") -> Column:
    """The text line by line without the sentences that match; lines with nothing left go."""
    kept = F.transform(F.split(text, "\n"), lambda x: F.array_join(F.filter(F.split(x, rf"(?<={stop})"), lambda s: ~s.rlike(pattern)), ""))
    return F.array_join(F.filter(kept, lambda x: trimmed(x) != ""), "\n")


def alias_line(body: Column, mark: str = "※") -> Column:
    """The last line where it begins with the mark; null elsewhere."""
    return F.nullif(F.regexp_extract(body, rf"\n{mark}([^\n]*)\z", 1), F.lit(""))


_OPEN, _CLOSE = "（(", "）)"


def _outside(text: str) -> str:
    depth, out = 0, []
    for sign in text:
        if sign in _OPEN:
            depth += 1
        elif sign in _CLOSE and depth:
            depth -= 1
        elif not depth:
            out.append(sign)
    return "".join(out)


@F.pandas_udf(StringType())
def _outside_each(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _outside(t))


def _opens(text: Column) -> Column:
    return F.contains(text, F.lit(_OPEN[0])) | F.contains(text, F.lit(_OPEN[1]))


def _where_open(counted: Callable[[Column], Column], text: Column, plain: Column) -> Column:
    """``counted`` of texts with an opening parenthesis, which alone are handed to Python; ``plain`` of the others."""
    return F.when(_opens(text), counted(F.when(_opens(text), text))).otherwise(plain)


def outside_parentheses(text: Column | str) -> Column:
    """What lies in no parentheses; a closing one without its opening is kept."""
    text = F.col(text) if isinstance(text, str) else text
    return _where_open(_outside_each, text, text)


_MARK = re.compile(f"[{_OPEN}{_CLOSE}。]")


def _sentence(text: str) -> str:
    depth = 0
    for m in _MARK.finditer(text):
        depth += (m[0] in _OPEN) - (m[0] in _CLOSE and depth > 0)
        if m[0] == "。" and not depth:
            return text[: m.start()]
    return text


@F.pandas_udf(StringType())
def _sentence_each(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _sentence(t))


def first_sentence(text: Column | str) -> Column:
    """Up to the first full stop that lies in no parentheses."""
    text = F.col(text) if isinstance(text, str) else text
    return _where_open(_sentence_each, text, F.substring_index(text, "。", 1))


def activation_clause(text_ja: Column) -> Column:
    """The first sentence of a clause, without its label and without remarks in parentheses at its end; null where nothing is left."""
    bare = F.regexp_replace(trimmed(text_ja), rf"\A(?:[{NUMERALS}][：:]*|{BULLET})(?U)\s*", "")
    head = F.regexp_replace(trimmed(first_sentence(bare)), r"(?U)(?:\s*[（(][^（()）]*[）)]\s*)+\z", "")
    return F.nullif(trimmed(head), F.lit(""))


def optional_by_rule(text_ja: Column, activation: Column | None = None) -> Column:
    """o (the player may) or m (mandatory) by the end of the activation clause, which is made of the text if it is not given; null where it tells nothing."""
    clause = activation_clause(text_ja) if activation is None else activation
    return F.when(clause.rlike(r"(できる|できます)\z"), "o").when(clause.rlike(r"(?<!た)事で"), "o").when(F.contains(clause, F.lit("発動")), "m")


# Presentation


def padded(ident: Column, width: int = 8) -> Column:
    """Zero-padded; longer numbers stay whole."""
    text = ident.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def shown_time(value: Column) -> Column:
    """``2026-08-22T12:34:56+0800`` as ``2026-08-22 12:34``; anything else unchanged."""
    pattern = r"\A(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2})(:\d{2})?\+0800\z"
    return F.when(value.rlike(pattern), F.regexp_replace(value, pattern, "$1 $2")).otherwise(value)


def escaped(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out
