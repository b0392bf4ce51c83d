"""The search: conditions on entities, and conditions that must hold together on one clause."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import predicates as P
from clausewright.functions.vocab import KIND, OPTIONAL

Selection = Mapping[str, int]
Range = tuple[float | None, float | None]

#: Entity axes: condition field, column, whether the column is an array.
TRI_AXES = (("cat", "cat", False), ("attr", "attr", False), ("race", "race", False), ("lm", "markers", True), ("rarity", "rarity", False), ("ot", "region", False), ("ban_o", "ban_o", False), ("ban_t", "ban_t", False), ("ban_m", "ban_m", False))
RANGE_AXES = (("lv", "level"), ("lk", "link"), ("sc", "scale"), ("atk", "atk"), ("df", "def"), ("gy", "points"))
UNKNOWN_AXES = (("atkq", "atk"), ("dfq", "def"))


@dataclass(frozen=True)
class Condition:
    """A query; what is not set filters nothing. Selections are {code: 1 or -1}, ranges (low, high)."""

    name: str = ""
    name_language: str = "zh"
    code: str = ""
    text: str = ""
    text_materials: bool = False
    cat: Selection = field(default_factory=dict)
    kind: Selection = field(default_factory=dict)
    opt: Selection = field(default_factory=dict)
    sub: Selection = field(default_factory=dict)
    attr: Selection = field(default_factory=dict)
    race: Selection = field(default_factory=dict)
    lm: Selection = field(default_factory=dict)
    rarity: Selection = field(default_factory=dict)
    ot: Selection = field(default_factory=dict)
    ban_o: Selection = field(default_factory=dict)
    ban_t: Selection = field(default_factory=dict)
    ban_m: Selection = field(default_factory=dict)
    lv: Range = (None, None)
    lk: Range = (None, None)
    sc: Range = (None, None)
    atk: Range = (None, None)
    df: Range = (None, None)
    gy: Range = (None, None)
    atkq: int = 0
    dfq: int = 0

    def cleared(self, *fields: str) -> Condition:
        """Without what ``fields`` set; with none, without anything."""
        blank = Condition()
        return replace(self, **{f: getattr(blank, f) for f in fields}) if fields else blank


def entity_predicate(q: Condition) -> Column:
    """All entity axes, the plain columns first so that they reach the scan."""
    tests = [P.tri_hit(F.col(c), getattr(q, f), many) for f, c, many in TRI_AXES]
    tests += [P.range_hit(F.col(c), *getattr(q, f)) for f, c in RANGE_AXES]
    tests += [P.unknown_hit(F.col(c), getattr(q, f)) for f, c in UNKNOWN_AXES]
    tests += [P.id_hit(F.col("id"), F.col("alt_ids"), q.code)]
    tests += [P.tri_hit(P.sub_codes(F.col("cat"), F.col("subs")), q.sub, True)] if q.sub else []
    tests += [P.name_hit({x: F.col(f"name_{x}") for x in ("zh", "ja", "en")}, F.col("alias"), q.name, q.name_language)]
    return reduce(lambda a, b: a & b, tests)


def clause_marks(q: Condition) -> list[tuple[str, str | None]]:
    """The clause conditions that are set, for display: (type, value)."""
    text = P.term(q.text)
    parts = P.like_parts(text)
    return ([("text", text)] if parts else []) + [(n, c) for n in ("kind", "opt") for c in getattr(q, n) if getattr(q, n)[c]]


def clause_predicate(q: Condition, clause: Column, cat: Column, subs: Column) -> Column | None:
    """The conjunction that one clause must meet; None where no clause condition is set.

    Exclusion says that this clause is not so; an entity qualifies by any such clause. The keyword passes over material
    lines unless ``text_materials`` is set; kind and value conditions still see them.
    """
    parts = P.like_parts(P.term(q.text))
    tests = []
    if parts:
        hit = P.like_match(clause["text"], parts)
        tests.append(hit if q.text_materials else hit & ~F.coalesce(clause["role"] == "mat", F.lit(False)))
    if any(q.kind.values()):
        tests.append(P.tri_hit(P.kind_at(clause["kind"], cat, subs, KIND.own), q.kind))
    if any(q.opt.values()):
        tests.append(P.tri_hit(P.optional_at(clause["kind"], clause["opt"], OPTIONAL.combos), q.opt, True))
    return reduce(lambda a, b: a & b, tests) if tests else None


def run(entities: DataFrame, q: Condition, clauses: str = "clauses") -> DataFrame:
    """Entities that meet the query, with ``rows``: places of the clauses that meet all clause conditions, null where none is set."""
    out = entities.where(entity_predicate(q))
    if clause_predicate(q, F.struct(*(F.lit("").alias(n) for n in ("text", "role", "kind", "opt"))), F.lit(""), F.array().cast("array<string>")) is None:
        return out.withColumn("rows", F.lit(None).cast("array<int>"))
    hits = F.filter(F.col(clauses), lambda c: clause_predicate(q, c, F.col("cat"), F.col("subs")))
    return out.withColumn("rows", F.transform(hits, lambda c: c["pos"])).where(F.size("rows") > 0)
