"""Query state as a shareable string, and counters of what a query sets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import quote, unquote_to_bytes

from clausewright.functions.vocab import DOMAINS, Domain
from clausewright.plans.order import KEYS, sort_of
from clausewright.plans.query import Condition

LANGUAGES = ("zh", "ja", "en")


@dataclass(frozen=True)
class Field:
    """A block of the query form. ``tri``: field of a selection with the ``domain`` (codes of a ``side`` have it before them); ``range``: field of a range; neither: a title alone."""

    key: str
    tri: str = ""
    range: str = ""
    side: str = ""
    states: int = 3
    parent: str = ""
    grouped: bool = False
    unknown: str = ""
    monster: bool = False


#: In the order of the form; a key is a domain, a range or a title.
FIELDS = (
    Field("cat", tri="cat", states=2),
    Field("kind", tri="kind"),
    Field("optional", tri="opt"),
    Field("sub_m", tri="sub", side="m", parent="cat", grouped=True),
    Field("sub_s", tri="sub", side="s", parent="cat"),
    Field("sub_t", tri="sub", side="t", parent="cat"),
    Field("attr", tri="attr", parent="sub_m", monster=True),
    Field("race", tri="race", parent="sub_m", monster=True),
    Field("lv", range="lv", parent="sub_m", monster=True),
    Field("lk", range="lk", parent="sub_m", monster=True),
    Field("sc", range="sc", parent="sub_m", monster=True),
    Field("atk", range="atk", parent="sub_m", unknown="atkq", monster=True),
    Field("df", range="df", parent="sub_m", unknown="dfq", monster=True),
    Field("lm", tri="lm", parent="sub_m", monster=True),
    Field("rarity", tri="rarity"),
    Field("gy", range="gy"),
    Field("ot", tri="ot"),
    Field("ban"),
    Field("ban_o", tri="ban_o", parent="ban"),
    Field("ban_t", tri="ban_t", parent="ban"),
    Field("ban_m", tri="ban_m", parent="ban"),
)


@dataclass(frozen=True)
class State:
    query: Condition = field(default_factory=Condition)
    sort: str = "dom"
    direction: str = ""


def _codes(domain: Domain) -> list[str]:
    return [c for _, codes in domain.groups for c in codes] or [m.code for m in domain.members if m.filterable]


def tri_codes(fields: tuple[Field, ...] = FIELDS, domains: dict[str, Domain] | None = None) -> dict[str, tuple[list[str], int]]:
    """Selection fields with their codes in declaration order and the number of states."""
    out: dict[str, tuple[list[str], int]] = {}
    for f in fields:
        if f.tri:
            codes = [f"{f.side}:{c}" if f.side else c for c in _codes((domains or DOMAINS)[f.key])]
            out[f.tri] = (out[f.tri][0] + codes, out[f.tri][1]) if f.tri in out else (codes, f.states)
    return out


def _shown(x: float | None) -> str:
    return "" if x is None else str(int(x)) if float(x).is_integer() else repr(float(x))


def stringify(state: State) -> str:
    """Only what is set and is not a default, codes in declaration order, so that equal queries are equal strings."""
    q, parts = state.query, []
    parts += [f"{key}={quote(getattr(q, key).strip(), safe=_SAFE)}" for key in ("name", "code", "text") if getattr(q, key).strip()]
    parts += ["textMat=1"] if q.text_materials else []
    parts += [f"nameLang={q.name_language}"] if q.name_language in LANGUAGES[1:] else []
    for key, (codes, _) in tri_codes().items():
        chosen = [("-" if getattr(q, key)[c] < 0 else "") + c for c in codes if getattr(q, key).get(c)]
        parts += [f"{key}={','.join(chosen)}"] if chosen else []
    for f in FIELDS:
        if f.range:
            low, high = getattr(q, f.range)
            parts += [f"{f.range}={_shown(low)}-{_shown(high)}"] if low is not None or high is not None else []
            parts += [f"{f.unknown}={'-1' if getattr(q, f.unknown) < 0 else '1'}"] if f.unknown and getattr(q, f.unknown) else []
    key, direction = sort_of(state.sort, state.direction)
    if key != "dom":
        parts += [f"sort={key}"] + ([f"dir={direction}"] if direction != KEYS[key] else [])
    return "&".join(parts)


#: Signs that stay as they are beside letters and digits.
_SAFE = "-_.!~*'()"


def _decoded(text: str) -> str | None:
    """Percent-decoded; None where an escape or the UTF-8 is broken."""
    for at, sign in enumerate(text):
        if sign == "%" and not (len(text) >= at + 3 and all(x in "0123456789abcdefABCDEF" for x in text[at + 1 : at + 3])):
            return None
    try:
        return unquote_to_bytes(text).decode("utf-8")
    except UnicodeDecodeError:
        return None


def number(text: str) -> float | int | None:
    """A number as the browser reads it: decimal, exponents, 0x, 0o and 0b; None for anything else."""
    text = text.strip()
    try:
        if text[:2].lower() in ("0x", "0o", "0b"):
            return int(text, 0) if "_" not in text else None
        if not text or "_" in text or text.lower().lstrip("+-") in ("nan", "inf", "infinity"):
            return None
        value = float(text)
        return int(value) if value.is_integer() else value
    except (ValueError, OverflowError):
        return None


def parse(source: str | None) -> State:
    """The reverse of ``stringify``; whatever is unknown or broken is passed over, the rest holds."""
    out: dict = {}
    raw: dict[str, str] = {}
    selections, ranges = tri_codes(), {f.range: f for f in FIELDS if f.range}
    unknowns = {f.unknown for f in FIELDS if f.unknown}
    for part in (source or "").removeprefix("#").split("&"):
        key, given, value = part.partition("=")
        value = _decoded(value) if given and key else None
        if value is None:
            continue
        if key in ("name", "code", "text"):
            out[key] = value.strip()
        elif key == "textMat":
            out |= {"text_materials": True} if value == "1" else {}
        elif key == "nameLang":
            out["name_language"] = value if value in LANGUAGES else LANGUAGES[0]
        elif key in ("sort", "dir"):
            raw[key] = value
        elif key in selections:
            codes, states = selections[key]
            chosen = {t.removeprefix("-"): -1 if t.startswith("-") else 1 for t in value.split(",") if t.removeprefix("-") in codes and not (t.startswith("-") and states == 2)}
            out |= {key: chosen} if chosen else {}
        elif key in ranges:
            low, dash, high = value.partition("-")
            bounds = (number(low), number(high))
            out |= {key: bounds} if dash and bounds != (None, None) else {}
        elif key in unknowns and value in ("1", "-1"):
            out[key] = int(value)
    return State(replace(Condition(), **out), *sort_of(raw.get("sort"), raw.get("dir")))


def canonical(source: str | None) -> str:
    return stringify(parse(source))


def count(q: Condition) -> int:
    """How many conditions are set; the language and the material switch only say how."""
    blank = Condition()
    fields = [f for f in q.__dataclass_fields__ if f not in ("name_language", "text_materials")]
    return sum(any(x is not None for x in v) if isinstance(v := getattr(q, f), tuple) else bool(v) and v != getattr(blank, f) for f in fields)


def axis_counts(q: Condition) -> dict[str, int]:
    """How many choices each block has; blocks with named groups also have ``key/i`` for group i."""
    out = {}
    for f in FIELDS:
        if f.tri:
            chosen = [c for c, s in getattr(q, f.tri).items() if s and (not f.side or c.startswith(f"{f.side}:"))]
            out[f.key] = len(chosen)
            if f.grouped:
                for i, (_, codes) in enumerate(DOMAINS[f.key].groups):
                    out[f"{f.key}/{i}"] = sum((f"{f.side}:{c}" if f.side else c) in chosen for c in codes)
        elif f.range:
            out[f.key] = int(getattr(q, f.range) != (None, None)) + int(bool(f.unknown and getattr(q, f.unknown)))
        else:
            out[f.key] = 0
    return out


def tree_counts(q: Condition) -> dict[str, int]:
    """Each block with all blocks below it; a category does not count where the blocks of its side have choices."""
    counts = axis_counts(q)

    def own(key: str) -> int:
        if key != "cat":
            return counts[key]
        return sum(bool(s) and not any(f.parent == "cat" and f.side == c and total(f.key) for f in FIELDS) for c, s in q.cat.items())

    def total(key: str) -> int:
        return own(key) + sum(total(f.key) for f in FIELDS if f.parent == key)

    return {f.key: total(f.key) for f in FIELDS}


def optional_available(kind: dict[str, int]) -> list[bool]:
    """Whether each group of value codes can find anything with the kinds that are included."""
    domain = DOMAINS["optional"]
    included = {c for c, s in kind.items() if s > 0}
    carried = {c: {k} for c, k, _, _ in domain.combos}
    return [not included or any(carried.get(c, set(domain.carriers)) & included for c in codes) for _, codes in domain.groups]


def expanded(q: Condition) -> list[str]:
    """Blocks to open for a restored query: those with choices and all above them, and the values' block where an included kind carries values."""
    counts, parents = axis_counts(q), {f.key: f.parent for f in FIELDS}
    carrying = any(s > 0 and c in DOMAINS["optional"].carriers for c, s in q.kind.items())
    opened = set()
    for f in FIELDS:
        key = f.key if counts[f.key] or (f.tri == "opt" and carrying) else ""
        while key:
            opened.add(key)
            key = parents[key]
    groups = [k for k in counts if "/" in k and counts[k]]
    return [f.key for f in FIELDS if f.key in opened] + groups


def next_state(state: int, states: int = 3) -> int:
    """Unset, included, excluded, unset; with two states without excluded."""
    return {0: 1, 1: -1 if states == 3 else 0, -1: 0}[state]


def normalised(q: Condition) -> Condition:
    """As the form would hold it: subtypes only of included categories, monster axes only with monsters, value codes only where a group of them is available."""
    sides = {c for c, s in q.cat.items() if s > 0}
    out = replace(q, sub={c: s for c, s in q.sub.items() if c.split(":")[0] in sides})
    if "m" not in sides:
        out = out.cleared(*(x for f in FIELDS if f.monster for x in (f.tri or f.range, f.unknown) if x))
    shown = {c for ok, (_, codes) in zip(optional_available(dict(q.kind)), DOMAINS["optional"].groups, strict=True) if ok for c in codes}
    return replace(out, opt={c: s for c, s in q.opt.items() if c in shown})
