"""The entity table: decoding packed rows, exclusions, faces by class, and the searchable index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import vocab as V
from clausewright.functions.text import alias_line, trimmed

#: Ids from here on are provisional; the token bit; the monster and link bits.
PROVISIONAL, TOKEN, MONSTER, LINK = 100_000_000, 0x4000, 0x1, 0x4000000
PARAMETERS = ("race", "attribute", "level", "atk", "def")


def exclusion_reason() -> Column:
    """The first reason to leave a raw row out; null to keep it."""
    return F.when(F.col("id") >= PROVISIONAL, "provisional").when(F.col("type").bitwiseAND(TOKEN) != 0, "token")


def exclusions(raw: DataFrame) -> DataFrame:
    """reason, n."""
    return raw.select(exclusion_reason().alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def stale_parameters() -> Column:
    """Whether a row that is no monster has a monster's parameters."""
    some = F.lit(False)
    for c in PARAMETERS:
        some = some | (F.col(c) != 0)
    return F.coalesce((F.col("type").bitwiseAND(MONSTER) == 0) & some, F.lit(False))


def decoded(raw: DataFrame) -> DataFrame:
    """Raw rows (id, type, atk, def, level, race, attribute, setcode, ot, alias, name, desc) as entities: parameters of monsters only, level and scale unpacked, and a link entity's defence as its markers."""
    monster = F.col("type").bitwiseAND(MONSTER) != 0
    link = F.col("type").bitwiseAND(LINK) != 0
    only = lambda c: F.when(monster, c)
    return raw.where(exclusion_reason().isNull()).select(
        "id", "type", "setcode", "ot", "alias", "name", "desc",
        only(F.col("race")).alias("race"), only(F.col("attribute")).alias("attribute"), only(F.col("level").bitwiseAND(0xFF)).alias("level"),
        only(F.col("atk")).alias("atk"), F.when(monster & ~link, F.col("def")).alias("def"),
        F.when(monster & (F.col("type").bitwiseAND(0x1000000) != 0), F.shiftright("level", 24).bitwiseAND(0xFF)).alias("scale"),
        F.when(monster & link, F.col("def")).alias("link_marker"),
    )


def faces(cards: DataFrame) -> DataFrame:
    """Entities as the search sees them, without clauses: codes for stored values, faces by class.

    ``cards``: decoded entities with alt_ids, name_zh, name_ja, name_en, body, rarity, points, ban_o, ban_t, ban_m.
    """
    cat, subs = V.subtypes(F.col("type"))
    link = F.col("type").bitwiseAND(LINK) != 0
    faced = cards.withColumn("cat", cat).withColumn("subs", subs)
    return faced.select(
        "id", "alt_ids", "name_zh", "name_ja", "name_en", alias_line(F.col("body")).alias("alias"), "body", "cat", "subs",
        V.ATTR.code_of(F.col("attribute")).alias("attr"), V.RACE.code_of(F.col("race")).alias("race"),
        F.when(~link, F.col("level")).alias("level"), F.when(link, F.col("level")).alias("link"),
        F.when(F.col("link_marker").isNotNull(), V.LINK_MARKER.codes_of(F.col("link_marker"))).alias("markers"),
        "scale", "atk", "def", V.RARITY.code_of(F.col("rarity")).alias("rarity"), V.OT.code_of(F.col("ot")).alias("region"),
        "ban_o", "ban_t", "ban_m", F.when(F.col("points") != 0, F.col("points")).alias("points"),
    )


def index_rows(cards: DataFrame, clauses: DataFrame) -> DataFrame:
    """``faces`` of ``cards``, with clauses (id, pos, section, label, text, kind, opt, role) as one array by place."""
    nested = clauses.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "section", "label", "text", "kind", "opt", "role"))).alias("clauses"))
    return faces(cards).join(nested, "id", "left").withColumn("clauses", F.coalesce("clauses", F.array().cast(nested.schema["clauses"].dataType)))


def ban_display(code: Column, released: Column) -> Column:
    """What a list says of an entity: its code, else whether it is free or not released."""
    return F.coalesce(code, F.when(released, "free").otherwise("unreleased"))


def ban_row() -> Column:
    """struct<ban_o, ban_t, ban_m> of an index row, each as ``ban_display``; null where no list has the entity. Released: by region, and by rarity for the game."""
    released = {"ban_o": F.coalesce(F.col("region") != "t", F.lit(True)), "ban_t": F.coalesce(F.col("region") != "o", F.lit(True)), "ban_m": F.col("rarity").isNotNull()}
    shown = F.struct(*(ban_display(F.col(c), r).alias(c) for c, r in released.items()))
    return F.when(F.coalesce(*released).isNotNull(), shown)


def card_type(type_bits: Column) -> Column:
    """One of ten labels by priority; null where there is no category bit. Monsters are one label."""
    has = lambda bit: type_bits.bitwiseAND(F.lit(bit)) != 0

    def kind(table: tuple[tuple[int, str], ...], plain: str) -> Column:
        out = F.lit(plain)
        for bit, label in reversed(table):
            out = F.when(has(bit), label).otherwise(out)
        return out

    return F.when(has(MONSTER), "怪獸").when(has(0x2), kind(SPELLS, "通常魔法")).when(has(0x4), kind(TRAPS, "通常陷阱"))


# Finer kinds in the order in which they count.
SPELLS = ((0x10000, "速攻魔法"), (0x80, "儀式魔法"), (0x20000, "永續魔法"), (0x40000, "裝備魔法"), (0x80000, "場地魔法"))
TRAPS = ((0x100000, "反擊陷阱"), (0x20000, "永續陷阱"))
FLAVOR_HEAD = "【怪獸敘述】"


def flavor(body: Column, has_clauses: Column) -> Column:
    """Flavour text: what follows its head, or the whole body of an entity without clauses; empty elsewhere."""
    at = F.instr(body, FLAVOR_HEAD)
    return F.when(at > 0, trimmed(F.substring(body, at + len(FLAVOR_HEAD), F.length(body)))).when(has_clauses, "").otherwise(trimmed(body))


def named(cards: DataFrame, names: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(cards, counts): ``column`` from names (id, name), empty where there is none; counts: named, missing."""
    out = cards.join(names.select("id", F.col("name").alias(column)), "id", "left").withColumn(column, F.coalesce(column, F.lit("")))
    return out, out.agg(F.count_if(F.col(column) != "").alias("named"), F.count_if(F.col(column) == "").alias("missing"))


def coverage_counts(cards: DataFrame, *columns: str) -> DataFrame:
    """column, filled, missing: entities that have a value, neither null nor empty."""
    filled = [F.count_if(F.coalesce(F.col(c).cast("string") != "", F.lit(False))).alias(c) for c in columns]
    row = cards.agg(F.count("*").alias("_n"), *filled)
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), (F.col("_n") - F.col(c)).alias("missing")) for c in columns))).alias("x")).select("x.*")


def metadata(index: DataFrame, built_at: str, sources: dict[str, str], data_updated_at: str | None = None) -> DataFrame:
    """One row: built_at, data_updated_at (only where given), cards, clauses, vocab_digest, sources."""
    row = index.agg(F.count("*").alias("cards"), F.coalesce(F.sum(F.size("clauses")), F.lit(0)).alias("clauses"))
    given = [F.lit(data_updated_at).alias("data_updated_at")] if data_updated_at else []
    held = F.map_from_arrays(F.array(*map(F.lit, sources)).cast("array<string>"), F.array(*map(F.lit, sources.values())).cast("array<string>"))
    return row.select(F.lit(built_at).alias("built_at"), *given, "cards", "clauses", F.lit(V.digest()).alias("vocab_digest"), held.alias("sources"))
