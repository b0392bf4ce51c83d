"""Predicates of the query engine as column expressions; none of them is ever null."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def term(value: str | None) -> str | None:
    """A keyword without blanks at its ends; None where nothing is left."""
    return (value or "").strip() or None


def like_parts(keyword: str | None) -> list[str]:
    """The parts of a keyword between ``%``; empty ones are dropped."""
    return [p for p in (keyword or "").split("%") if p]


def like_match(text: Column, parts: Sequence[str]) -> Column:
    """Whether the parts occur in this order, anything between and around them. ``_`` is an ordinary sign."""
    if not parts:
        return F.lit(True)
    pattern = "%" + "%".join(re.sub(r"([\\_%])", r"\\\1", p) for p in parts) + "%"
    return F.coalesce(text.like(pattern), F.lit(False))


def like_ranges(text: Column, parts: Sequence[str]) -> Column:
    """Leftmost places of the parts in order as array<struct<start,end>> from 0, end exclusive; empty where one is missing."""
    empty = "array<struct<start:int,end:int>>"
    if not parts:
        return F.array().cast(empty)
    start = F.struct(F.lit(1).alias("at"), F.array().cast(empty).alias("found"))

    def step(state: Column, part: Column) -> Column:
        place = F.when(state["at"] > 0, F.call_function("locate", part, text, state["at"])).otherwise(0)
        hit = F.struct((place - 1).cast("int").alias("start"), (place - 1 + F.length(part)).cast("int").alias("end"))
        return F.struct(F.when(place > 0, place + F.length(part)).otherwise(0).cast("int").alias("at"), F.when(place > 0, F.concat(state["found"], F.array(hit))).otherwise(F.array().cast(empty)).alias("found"))

    done = F.aggregate(F.array(*map(F.lit, parts)), start, step)
    return F.coalesce(F.when(done["at"] > 0, done["found"]), F.array().cast(empty))


def name_hit(names: Mapping[str, Column], alias: Column | None, keyword: str | None, language: str = "zh") -> Column:
    """By a name in one language; zh and ja also by the alias, en without regard to case and without the alias."""
    keyword = term(keyword)
    parts = like_parts(keyword)
    if keyword is None or not parts:
        return F.lit(True)
    if language == "en":
        return like_match(F.lower(names["en"]), [p.lower() for p in parts])
    hit = like_match(names[language], parts)
    return hit if alias is None else hit | like_match(alias, parts)


def id_hit(ident: Column, others: Column | None, entered: str | None) -> Column:
    """By an exact number, the entity's own or another of its ids; anything but digits finds nothing."""
    entered = term(entered)
    if entered is None:
        return F.lit(True)
    if not re.fullmatch(r"[0-9]+", entered) or int(entered) >= 2**63:
        return F.lit(False)
    hit = F.coalesce(ident == int(entered), F.lit(False))
    return hit if others is None else hit | F.coalesce(F.array_contains(others, F.lit(int(entered)).cast("long")), F.lit(False))


def chosen(selection: Mapping[str, int] | None) -> tuple[list[str], list[str]]:
    """(included, excluded) codes of a selection {code: 1 or -1}."""
    selection = selection or {}
    return [c for c, s in selection.items() if s > 0], [c for c, s in selection.items() if s < 0]


def tri_hit(value: Column, selection: Mapping[str, int] | None, many: bool = False) -> Column:
    """Included codes are alternatives, an excluded one wins; with exclusions alone, rows without a value pass."""
    include, exclude = chosen(selection)
    if not include and not exclude:
        return F.lit(True)
    if many:
        has = lambda codes: F.exists(F.coalesce(value, F.array().cast("array<string>")), lambda v: F.coalesce(v.isin(codes), F.lit(False)))
    else:
        has = lambda codes: F.coalesce(value.isin(codes), F.lit(False))
    out = ~has(exclude) if exclude else F.lit(True)
    return out & has(include) if include else out


def range_hit(value: Column, low: float | None, high: float | None) -> Column:
    """Within bounds that are set; where any is, nulls and negative values (unknown) fail."""
    if low is None and high is None:
        return F.lit(True)
    tests = [value >= 0] + ([value >= low] if low is not None else []) + ([value <= high] if high is not None else [])
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def unknown_hit(value: Column, want: int | None) -> Column:
    """1: only unknown (negative) values; -1: all but those, absent ones included."""
    if not want:
        return F.lit(True)
    unknown = F.coalesce(value < 0, F.lit(False))
    return unknown if want > 0 else ~unknown


def sub_codes(cat: Column, subs: Column) -> Column:
    """Subtype codes with their category: ``cat:sub``."""
    return F.transform(subs, lambda s: F.concat(cat, F.lit(":"), s))


def kind_at(kind: Column, cat: Column, subs: Column, own: Sequence[tuple[str, str, str]]) -> Column:
    """A clause's kind; null where it is the entity's own type."""
    suppressed = F.lit(False)
    for code, c, s in own:
        suppressed = suppressed | ((kind == code) & (cat == c) & F.array_contains(subs, s))
    return F.when(~F.coalesce(suppressed, F.lit(False)), kind)


def optional_at(kind: Column, optional: Column, combos: Sequence[tuple[str, str, str, str]]) -> Column:
    """A clause's value codes: the value and the combination of kind and value, as far as there are any."""
    combined = F.lit(None).cast("string")
    for code, k, v, _ in combos:
        combined = F.when((kind == k) & (optional == v), code).otherwise(combined)
    return F.array_compact(F.array(optional, combined))
