"""The vocabulary: ordered domains of codes, their stored values, and decoding as column expressions."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Member:
    code: str
    label: str
    value: int | str | None = None
    filterable: bool = True


@dataclass(frozen=True)
class Domain:
    """Members in declaration order, which is also their sort order.

    ``source``: bitmask (many bits), bit (one bit), int or text. ``fallback``: the code where no bit is set.
    ``groups``: (title, codes). ``own``: (code, category, subtype) for which an entity's own type hides the code.
    ``carriers``: kinds on which the values of this domain occur; ``combos``: (code, kind, value, label).
    """

    title: str
    source: str
    members: tuple[Member, ...]
    groups: tuple[tuple[str, tuple[str, ...]], ...] = ()
    fallback: str | None = None
    own: tuple[tuple[str, str, str], ...] = ()
    carriers: tuple[str, ...] = ()
    combos: tuple[tuple[str, str, str, str], ...] = ()

    @property
    def codes(self) -> list[str]:
        return [m.code for m in self.members]

    @property
    def labels(self) -> dict[str, str]:
        return {m.code: m.label for m in self.members}

    @cached_property
    def mask(self) -> int:
        out = 0
        for m in self.members:
            out |= m.value if isinstance(m.value, int) else 0
        return out

    def stored(self, m: Member) -> int | str | None:
        return m.code if self.source == "text" and m.value is None else m.value

    # Columns

    def code_of(self, value: Column) -> Column:
        """The code of a single stored value; null where there is none or it is unknown."""
        out = F.lit(None).cast("string")
        for m in reversed(self.members):
            if self.stored(m) is not None:
                out = F.when(value == F.lit(self.stored(m)), m.code).otherwise(out)
        return out

    def is_unknown(self, value: Column) -> Column:
        """Whether a value is set (not null, 0 or empty) and has no code."""
        unset = (value == "") if self.source == "text" else (value == 0)
        return F.coalesce(~unset & self.code_of(value).isNull(), F.lit(False))

    def codes_of(self, value: Column) -> Column:
        """The codes of a bitmask in declaration order; the fallback alone where no bit is set."""
        hits = F.array_compact(F.array(*(F.when(value.bitwiseAND(F.lit(m.value)) != 0, m.code) for m in self.members if m.value)))
        return F.when(F.size(hits) == 0, F.array(F.lit(self.fallback))).otherwise(hits) if self.fallback else hits

    def unexplained(self, value: Column, *others: Domain) -> Column:
        """Bits that no member of this domain or of ``others`` stands for."""
        mask = self.mask
        for d in others:
            mask |= d.mask
        return value.bitwiseAND(F.lit(~mask))

    def rank(self, code: Column) -> Column:
        """The place of a code in declaration order; unknown and absent codes come after all."""
        out = F.lit(len(self.members))
        for i, m in reversed(list(enumerate(self.members))):
            out = F.when(code == m.code, i).otherwise(out)
        return out

    def label_of(self, code: Column) -> Column:
        out = code
        for m in self.members:
            out = F.when(code == m.code, m.label).otherwise(out)
        return out

    def last_rank(self, codes: Column, among: tuple[str, ...] | None = None) -> Column:
        """The rank of the last declared member of ``among`` that an array of codes has; after all where there is none."""
        order = list(among or self.codes)
        ranks = F.transform(codes, lambda c: F.array_position(F.array(*map(F.lit, order)), c).cast("int"))
        return F.coalesce(F.array_max(F.filter(ranks, lambda r: r > 0)) - 1, F.lit(len(order)))


def single(title: str, source: str, pairs: list[tuple], **more) -> Domain:
    return Domain(title, source, tuple(Member(*p) for p in pairs), **more)


# Codes, labels and bits of the catalog format.
CAT = single("大類", "bitmask", [("m", "怪獸", 0x1), ("s", "魔法", 0x2), ("t", "陷阱", 0x4)])
SUB_M = single(
    "怪獸子類型",
    "bitmask",
    [
        ("normal", "通常", 0x10),
        ("effect", "效果", 0x20),
        ("fusion", "融合", 0x40),
        ("ritual", "儀式", 0x80),
        ("synchro", "同步", 0x2000),
        ("xyz", "超量", 0x800000),
        ("pendulum", "靈擺", 0x1000000),
        ("link", "連結", 0x4000000),
        ("tuner", "協調", 0x1000),
        ("flip", "反轉", 0x200000),
        ("spsummon", "特殊召喚", 0x2000000),
        ("dual", "二重", 0x800),
        ("spirit", "靈魂", 0x200),
        ("union", "聯合", 0x400),
        ("toon", "卡通", 0x400000),
        ("token", "衍生物", 0x4000, False),
    ],
    groups=(("卡框", ("normal", "effect", "fusion", "ritual", "synchro", "xyz", "pendulum", "link")), ("能力", ("tuner", "flip", "spsummon", "dual", "spirit", "union", "toon"))),
)
SUB_S = single("魔法子類型", "bitmask", [("normal", "通常"), ("quick", "速攻", 0x10000), ("continuous", "永續", 0x20000), ("equip", "裝備", 0x40000), ("field", "場地", 0x80000), ("ritual", "儀式", 0x80)], fallback="normal")
SUB_T = single("陷阱子類型", "bitmask", [("normal", "通常"), ("continuous", "永續", 0x20000), ("counter", "反擊", 0x100000)], fallback="normal")
ATTR = single("屬性", "bit", [("earth", "地", 0x1), ("water", "水", 0x2), ("fire", "炎", 0x4), ("wind", "風", 0x8), ("light", "光", 0x10), ("dark", "闇", 0x20), ("divine", "神", 0x40)])
#: Races, each the next bit.
RACES = [
    ("warrior", "戰士族"), ("spellcaster", "魔法使族"), ("fairy", "天使族"), ("fiend", "惡魔族"), ("zombie", "不死族"), ("machine", "機械族"), ("aqua", "水族"),
    ("pyro", "炎族"), ("rock", "岩石族"), ("winged_beast", "鳥獸族"), ("plant", "植物族"), ("insect", "昆蟲族"), ("thunder", "雷族"), ("dragon", "龍族"),
    ("beast", "獸族"), ("beast_warrior", "獸戰士族"), ("dinosaur", "恐龍族"), ("fish", "魚族"), ("sea_serpent", "海龍族"), ("reptile", "爬蟲類族"), ("psychic", "超能族"),
    ("divine_beast", "幻神獸族"), ("creator_god", "創造神族"), ("wyrm", "幻龍族"), ("cyberse", "電子界族"), ("illusion", "幻想魔族"),
]
RACE = single("種族", "bit", [(code, label, 1 << i) for i, (code, label) in enumerate(RACES)])
KIND = single(
    "效果類型",
    "text",
    [
        ("x", "效果外文本"), ("u", "無種類效果"), ("c", "永續效果"), ("q", "誘發即時效果(2速)"), ("t", "誘發效果(1速)"), ("i", "啟動效果"),
        ("sn", "通常魔法卡效果"), ("sq", "速攻魔法卡效果"), ("sr", "儀式魔法卡效果"), ("sc", "永續魔法卡效果"), ("se", "裝備魔法卡效果"), ("sf", "場地魔法卡效果"),
        ("sp", "靈擺魔法卡效果"), ("tn", "通常陷阱卡效果"), ("tc", "永續陷阱卡效果"), ("tk", "反擊陷阱卡效果"),
    ],
    groups=(("怪獸側", ("x", "u", "c", "q", "t", "i")), ("跨類型魔陷效果", ("sn", "sq", "sr", "sc", "se", "sf", "sp", "tn", "tc", "tk"))),
    own=(
        ("sn", "s", "normal"), ("sq", "s", "quick"), ("sr", "s", "ritual"), ("sc", "s", "continuous"), ("se", "s", "equip"), ("sf", "s", "field"),
        ("sp", "m", "pendulum"), ("tn", "t", "normal"), ("tc", "t", "continuous"), ("tk", "t", "counter"),
    ),
)
OPTIONAL = single(
    "必發/選發",
    "text",
    [("m", "必發"), ("o", "選發")],
    groups=(("全部", ("m", "o")), ("怪獸側", ("qm", "qo", "tm", "to"))),
    carriers=("q", "t", "sn", "sq", "sr", "sc", "se", "sf", "sp", "tn", "tc", "tk"),
    combos=(("qm", "q", "m", "誘發即時(必發)"), ("qo", "q", "o", "誘發即時(選發)"), ("tm", "t", "m", "誘發(必發)"), ("to", "t", "o", "誘發(選發)")),
)
ROLE = single("效果外文本種別", "text", [("mat", "素材指定"), ("cond", "召喚條件"), ("limit", "使用次數限制")])
LINK_MARKER = single("連結標記", "bitmask", [("TL", "↖", 0x40), ("T", "↑", 0x80), ("TR", "↗", 0x100), ("L", "←", 0x8), ("R", "→", 0x20), ("BL", "↙", 0x1), ("B", "↓", 0x2), ("BR", "↘", 0x4)])
RARITY = single("MD 稀有度", "text", [("N", "N"), ("R", "R"), ("SR", "SR"), ("UR", "UR")])
OT = single("OCG・TCG", "int", [("o", "OCG 限定", 1), ("t", "TCG 限定", 2), ("b", "兩者", 3)])
_BAN = [("f", "禁止"), ("l", "限制"), ("s", "準限制")]
BAN_O, BAN_T, BAN_M = (single(f"{x} 禁限", "text", _BAN) for x in ("OCG", "TCG", "MD"))

DOMAINS: dict[str, Domain] = {
    "cat": CAT, "sub_m": SUB_M, "sub_s": SUB_S, "sub_t": SUB_T, "attr": ATTR, "race": RACE, "kind": KIND, "optional": OPTIONAL, "role": ROLE,
    "lm": LINK_MARKER, "rarity": RARITY, "ot": OT, "ban_o": BAN_O, "ban_t": BAN_T, "ban_m": BAN_M,
}
SIZES = {"cat": 3, "sub_m": 16, "sub_s": 6, "sub_t": 3, "attr": 7, "race": 26, "kind": 16, "optional": 2, "role": 3, "lm": 8, "rarity": 4, "ot": 3, "ban_o": 3, "ban_t": 3, "ban_m": 3}


def subtypes(type_bits: Column) -> tuple[Column, Column]:
    """(category, subtype codes); both null unless exactly one category bit is set."""
    cats = CAT.codes_of(type_bits)
    cat = F.when(F.size(cats) == 1, F.get(cats, 0))
    return cat, F.when(cat == "m", SUB_M.codes_of(type_bits)).when(cat == "s", SUB_S.codes_of(type_bits)).when(cat == "t", SUB_T.codes_of(type_bits))


def unexplained_type_bits(type_bits: Column) -> Column:
    return CAT.unexplained(type_bits, SUB_M, SUB_S, SUB_T)


def problems(domains: dict[str, Domain] | None = None, sizes: dict[str, int] | None = None) -> list[str]:
    """What is wrong with a vocabulary: sizes, repeated codes, labels and values, overlapping bits, and references to codes that do not exist."""
    domains, sizes = domains or DOMAINS, SIZES if sizes is None else sizes
    out = []
    for name, d in domains.items():
        if name in sizes and len(d.members) != sizes[name]:
            out.append(f"{name}: {len(d.members)} members, {sizes[name]} expected")
        for what, values in (("code", d.codes), ("label", [m.label for m in d.members]), ("value", [m.value for m in d.members if m.value is not None])):
            out += [f"{name}: {what} {v!r} is given twice" for v in sorted({str(x) for x in values if values.count(x) > 1})]
        if d.source in ("bit", "bitmask"):
            seen = 0
            for m in d.members:
                if m.value is None:
                    if m.code != d.fallback:
                        out.append(f"{name}: {m.code} has no bit and is not the fallback")
                    continue
                if not m.value or m.value & (m.value - 1):
                    out.append(f"{name}: {m.code} is not one bit")
                if seen & m.value:
                    out.append(f"{name}: {m.code} shares a bit")
                seen |= m.value
        if d.fallback is not None and d.fallback not in d.codes:
            out.append(f"{name}: fallback {d.fallback} is no member")
        combos = [c[0] for c in d.combos]
        if d.groups:
            grouped = [c for _, codes in d.groups for c in codes]
            wanted = [m.code for m in d.members if m.filterable] + combos
            out += [f"{name}: {c} is in no group" for c in wanted if c not in grouped]
            out += [f"{name}: group has {c}, which is no member" for c in grouped if c not in wanted]
            out += [f"{name}: {c} is in two groups" for c in sorted({c for c in grouped if grouped.count(c) > 1})]
        kinds = domains["kind"].codes if "kind" in domains else []
        out += [f"{name}: carrier {c} is no kind" for c in d.carriers if c not in kinds]
        for code, kind, value, _ in d.combos:
            if code in d.codes or combos.count(code) > 1:
                out.append(f"{name}: combination {code} is not a code of its own")
            if kind not in d.carriers:
                out.append(f"{name}: combination {code} is of {kind}, which carries no value")
            if value not in d.codes:
                out.append(f"{name}: combination {code} has no value {value}")
        for code, cat, sub in d.own:
            if code not in d.codes:
                out.append(f"{name}: own type of {code}, which is no member")
            if f"sub_{cat}" not in domains or sub not in domains[f"sub_{cat}"].codes:
                out.append(f"{name}: own type {cat}:{sub} does not exist")
        out += [f"{name}: {code} has two own types" for code in sorted({o[0] for o in d.own if [x[0] for x in d.own].count(o[0]) > 1})]
    return out


def export(domains: dict[str, Domain] | None = None) -> dict:
    """What a client needs: items that can be filtered, groups, combinations, carriers and own types."""
    out = {}
    for name, d in (domains or DOMAINS).items():
        one: dict = {"label": d.title, "items": [{"code": m.code, "label": m.label} for m in d.members if m.filterable]}
        if d.groups:
            one["groups"] = [{"label": t, "codes": list(c)} for t, c in d.groups]
        if d.combos:
            one["combos"] = {c: f"{k}:{v}" for c, k, v, _ in d.combos}
            one["items"] += [{"code": c, "label": label} for c, _, _, label in d.combos]
        if d.carriers:
            one["carriers"] = list(d.carriers)
        if d.own:
            one["own"] = {c: f"{cat}:{sub}" for c, cat, sub in d.own}
        out[name] = one
    return out


def digest(domains: dict[str, Domain] | None = None) -> str:
    """A fingerprint of the exported vocabulary."""
    return hashlib.sha256(json.dumps(export(domains), ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def vocabulary(spark: SparkSession, domains: dict[str, Domain] | None = None) -> DataFrame:
    """domain, code, label, value, rank, filterable: one row a member."""
    rows = [(name, m.code, m.label, None if d.stored(m) is None else str(d.stored(m)), i, m.filterable) for name, d in (domains or DOMAINS).items() for i, m in enumerate(d.members)]
    return spark.createDataFrame(rows, "domain string, code string, label string, value string, rank int, filterable boolean")
