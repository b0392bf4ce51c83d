"""Places in short texts: spans (start, end) of what is cut from a text, so that every part is a slice of it.

Plain functions over one text of a few hundred signs, for the Arrow functions of the operators; each returns places in
the text as it was, whatever blanks or forms of signs the comparison leaves out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from itertools import accumulate

from clausewright.functions.text import NUMERALS

Span = tuple[int, int]

#: What a piece is, before blanks at its ends go: a line, a sentence with its stop, a sentence or line.
LINE, SENTENCE, UNIT = r"[^\n]+", r"[^。]*。|[^。]+", r"[^\n。]*。|[^\n。]+"
# Dashes that count as one, and signs that do not count where texts are compared.
_DASHES = dict.fromkeys(map(ord, "-―‐−–—ー"), "-")
_NOISE = re.compile(r"[\s…‥]+")


def normal(text: str | None) -> str:
    """A text for comparing quotes with: compatibility forms, one kind of dash, no blanks and dots of omission."""
    return _NOISE.sub("", unicodedata.normalize("NFKC", text or "").translate(_DASHES))


def quoted(text: str | None) -> list[str]:
    """Passages in quotation marks, in order, without bare references to a number."""
    return [q for q in re.findall("『([^』]*)』", text or "") if not (q and all(c in NUMERALS for c in q))]


def condensed(text: str) -> tuple[str, list[int]]:
    """The text without blanks, and where each of its signs was."""
    places = [i for i, sign in enumerate(text) if not sign.isspace()]
    return "".join(map(text.__getitem__, places)), places


def stripped(text: str, start: int, end: int) -> Span | None:
    """A span without the blanks at its ends; None where nothing is left."""
    part = text[start:end]
    start += len(part) - len(part.lstrip())
    return (start, start + len(part.strip())) if part.strip() else None


def pieces(text: str, kind: str, within: Span | None = None) -> list[Span]:
    """The pieces of a text, or of a span of it, that are not blank."""
    found = re.compile(kind).finditer(text, *(within or (0, len(text))))
    return [s for m in found if (s := stripped(text, *m.span()))]


def covering(text: str, parts: Sequence[str]) -> list[Span | None] | None:
    """Where each part lies, if the parts one after another are the text but for blanks; None if they are not. A blank part lies nowhere."""
    body, places = condensed(text)
    bare = [condensed(p)[0] for p in parts]
    if "".join(bare) != body:
        return None
    return [(places[end - len(b)], places[end - 1] + 1) if b else None for b, end in zip(bare, accumulate(map(len, bare)), strict=True)]


def severed(text: str, spans: Sequence[Span | None], quotes: Sequence[str]) -> list[str]:
    """Quotes that the text holds and none of its spans does."""
    body = normal(text)
    parts = [normal(text[s[0] : s[1]]) for s in spans if s]
    return [q for q in quotes if (n := normal(q)) and n in body and not any(n in p for p in parts)]


def seamed(text: str, lines: Sequence[Span], quotes: Sequence[str]) -> list[Span]:
    """Lines, those joined between which some quote runs on.

    A quote of n signs crosses the seam between two lines if it lies within n - 1 signs to either side of it.
    """
    parts = [normal(text[a:b]) for a, b in lines]
    body, seams = "".join(parts), list(accumulate(map(len, parts)))
    marks = [n for q in quotes if len(n := normal(q)) > 1]
    out = list(lines[:1])
    for seam, line in zip(seams, lines[1:], strict=False):
        crossed = any(n in body[max(0, seam - len(n) + 1) : seam + len(n) - 1] for n in marks)
        out[-1:] = [(out[-1][0], line[1])] if crossed else [out[-1], line]
    return out


def cuts(text: str, rule: str, exception: str | None = None) -> list[int]:
    """Places inside the text where ``rule`` begins, but for sentences there that ``exception`` is found in."""
    at = [m.start() for m in re.finditer(rule, text) if 0 < m.start() < len(text)]
    return [i for i in at if not (exception and re.search(exception, text[i:].split("。", 1)[0]))]


def quotes_cut(text: str, places: Sequence[int], quotes: Sequence[str]) -> list[str]:
    """Quotes whose first occurrence in the text runs over one of the places."""
    body = normal(text)
    seams = [len(normal(text[:i])) for i in places]
    found = [(q, body.find(n), len(n)) for q in quotes if (n := normal(q))]
    return [q for q, at, n in found if at >= 0 and any(at < s < at + n for s in seams)]
