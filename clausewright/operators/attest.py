"""Attestation: kinds and mandatory flags that official statements give to clauses.

Statements are lines of a text in blocks with headings. Every line is a row; the clauses of its section are joined to it
as one array (dozens at most), and the ladder that finds what a line speaks of is column expressions over both. Lines
are then added up for each clause: one kind is an assignment, several are a conflict, and whatever cannot be attributed
is a note, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.plans.lineage import stored

# The words that state a kind, and marks of statements that do not count.
KIND_WORDS = {"誘発即時効果": "q", "誘発効果": "t", "起動効果": "i", "永続効果": "c"}
CARD_WORDS = {"通常魔法": "sn", "速攻魔法": "sq", "儀式魔法": "sr", "永続魔法": "sc", "装備魔法": "se", "フィールド魔法": "sf", "通常罠": "tn", "永続罠": "tc", "カウンター罠": "tk"}
CARD_PREDICATES = "扱います|扱われます|適用されます|適用します|発動します|処理を行います"
UNCLASSIFIED, FORBIDDEN, MANDATORY = "分類されない", "効果ではありません", "必ず発動"
NON_EFFECT = "効果(?:としては?|としての|の)(?:扱いません|扱われません|扱いではありません|扱いにはなりません)"
INDEX_HEADING = rf"\A([{T.NUMERALS}])[のに]?(?:モンスター|ペンデュラム)?の?効果について\z"
BULLET_HEADING = rf"\A(?:[{T.NUMERALS}]の)?(?:([１-９1-9①-⑩])つ目の)?(?:『(●[^』]*)』|(●))[のな]?(?:効果|処理)?について\z"
ORDINALS = "１２３４５６７８９", "123456789", T.NUMERALS
ALL_BEFORE, ALL_AFTER = "(?:いずれの|どちらの|どの|全ての|すべての|[２-９2-9]つ(?:以上)?の)『●』", "『●』[^。]{0,20}?(?:いずれも|どちらも)"
GRANT = r"以下の効果を得る。?\s*\z"


def stated_kinds(line: Column) -> Column:
    """Codes of the kinds that a line states, sentence by sentence."""
    words, cards = "|".join(KIND_WORDS), "|".join(CARD_WORDS)

    def coded(found: Column, table: dict[str, str]) -> Column:
        return F.transform(found, lambda w: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), w))

    def one(s: Column) -> Column:
        card = coded(F.regexp_extract_all(s, F.lit(rf"({cards})カードの効果として(?=.*(?:{CARD_PREDICATES}))"), F.lit(1)), CARD_WORDS)
        several = F.size(F.array_distinct(F.regexp_extract_all(s, F.lit(f"({words})"), F.lit(1)))) > 1
        said = coded(F.regexp_extract_all(s, F.lit(f"({words})です"), F.lit(1)), KIND_WORDS)
        none = F.array().cast("array<string>")
        return F.when(F.contains(s, F.lit(FORBIDDEN)), none).when(F.contains(s, F.lit(UNCLASSIFIED)), F.array(F.lit("u"))).otherwise(F.concat(card, F.when(several, none).otherwise(said)))

    return F.array_distinct(F.flatten(F.transform(F.split(line, "。"), one)))


def states_mandatory(line: Column) -> Column:
    bare = F.regexp_replace(line, "[”“][^”“]*[”“]", "")
    return F.exists(F.split(bare, "。"), lambda s: F.contains(s, F.lit(MANDATORY)) & ~F.contains(s, F.lit(FORBIDDEN)))


def statements(supplements: DataFrame) -> DataFrame:
    """id, section, name_ja, pos, heading (null before the first), line: lines with text of id, section, name_ja, supplement."""
    cut = F.regexp_replace("supplement", r"(?m)(?<=.)(【[^】]*】)[ 　\t]*$", "\n$1")
    rows = supplements.where("supplement IS NOT NULL").select("id", "section", "name_ja", F.posexplode(F.split(cut, "\n")).alias("pos", "raw"))
    own = F.when(F.col("raw").rlike(r"\A【[^】]*】"), F.regexp_extract("raw", r"\A【([^】]*)】", 1))
    above = Window.partitionBy("id", "section").orderBy("pos")
    rows = rows.withColumn("heading", F.last(own, ignorenulls=True).over(above)).withColumn("line", T.trimmed(F.regexp_replace("raw", r"\A【[^】]*】", "")))
    return rows.where("line <> ''").drop("raw")


def _numbered_place(sign: Column) -> Column:
    """1 for 1, １ and ①, and so on."""
    return F.greatest(*(F.call_function("locate", sign, F.lit(x)) for x in ORDINALS))


def _targets() -> Column:
    """struct<labels, ladder, note> of a line; columns: line, heading, quoted, quoted_raw, heading_quotes, effects, name_ja."""
    effects, open_ = F.col("effects"), F.filter("effects", lambda c: ~c["unsplit"])
    none = F.array().cast("array<string>")

    def told(labels: Column, ladder: str) -> Column:
        return F.struct(labels.alias("labels"), F.lit(ladder).alias("ladder"), F.lit(None).cast("string").alias("note"))

    def noted(note: str) -> Column:
        return F.struct(none.alias("labels"), F.lit(None).cast("string").alias("ladder"), F.lit(note).alias("note"))

    def labels(found: Column) -> Column:
        return F.transform(found, lambda c: c["label"])

    def has(label: Column) -> Column:
        return F.exists(effects, lambda c: c["label"] == label)

    bullets = F.filter(effects, lambda c: F.contains(c["label"], F.lit("-●")))
    one_group = F.size(F.array_distinct(F.transform(bullets, lambda c: F.split(c["label"], "-●")[0]))) == 1
    group = F.when(one_group, bullets).otherwise(F.slice(bullets, 1, 0))
    hits = lambda q: F.filter(open_, lambda c: (q != "") & F.contains(c["norm"], q))
    quote, raw = F.get("quoted", 0), F.get("quoted_raw", 0)
    bare = F.coalesce(quote == T.BULLET, F.lit(False))
    nth = F.regexp_extract("line", r"([１-９1-9①-⑫])つ目の『●』", 1)
    whole = F.col("line").rlike(ALL_BEFORE) | F.col("line").rlike(ALL_AFTER)
    placed = F.get(group, _numbered_place(nth) - 1)["label"]

    by_quote = (
        F.when(bare & (nth != ""), F.when(placed.isNotNull(), told(F.array(placed), "quote")).otherwise(noted("quote_unmatched")))
        .when(bare & whole & (F.size(group) > 0), told(labels(group), "quote"))
        .when(F.size(hits(quote)) == 1, told(labels(hits(quote)), "quote"))
        .when(F.size(hits(quote)) == 0, noted("quote_unmatched"))
        .otherwise(noted("quote_ambiguous"))
    )
    only = F.when((F.size(effects) == 1) & (F.size(open_) == 1), labels(effects))
    names = F.regexp_extract_all("line", F.lit("「([^」]*)」"), F.lit(1))
    by_name = F.when(F.array_contains(names, F.col("name_ja")), F.when(only.isNotNull(), told(only, "name_single")).otherwise(noted("attribution_deferred"))).otherwise(noted("other_card_only"))
    alone = F.when(only.isNotNull(), told(only, "single")).otherwise(noted("attribution_deferred"))

    seq = F.regexp_extract("line", rf"『([{T.NUMERALS}])』", 1)
    numbered = F.exists(effects, lambda c: F.substring(c["label"], 1, 1).isin(list(T.NUMERALS)))
    ordinal = _numbered_place(seq).cast("string")
    blob = (F.size(effects) == 1) & (F.size(open_) == 0)
    by_seq = F.when(has(seq), told(F.array(seq), "seq")).when(numbered, noted("seq_missing")).when(blob, told(labels(effects), "seq")).when(has(ordinal), told(F.array(ordinal), "seq")).otherwise(noted("seq_missing"))

    index = F.regexp_extract("heading", INDEX_HEADING, 1)
    spoken = F.filter(effects, lambda c: F.contains(c["label"], F.lit("-●")) & F.startswith(quote, F.lit(T.BULLET)) & (quote != T.BULLET) & F.contains(c["norm"], quote))
    by_index = F.when(F.size(spoken) == 1, told(labels(spoken), "header")).when(has(index), told(F.array(index), "header")).otherwise(noted("header_index_missing"))
    is_bullet = F.col("heading").rlike(BULLET_HEADING)
    h_nth, h_label = (F.regexp_extract("heading", BULLET_HEADING, i) for i in (1, 2))
    h_norm = F.get("heading_quotes", 0)
    starting = F.filter(group, lambda c: F.startswith(c["norm"], h_norm))
    h_place = F.get(group, _numbered_place(h_nth) - 1)["label"]
    h_found = F.when(h_nth != "", F.when(h_place.isNotNull(), F.array(h_place))).when(h_label != "", F.when(F.size(starting) == 1, labels(starting))).when(F.size(group) == 1, labels(group))
    by_bullet = F.when(h_found.isNotNull(), told(h_found, "header")).otherwise(noted("attribution_deferred"))
    unique = F.get(F.filter(F.transform("heading_quotes", lambda q: labels(hits(q))), lambda x: F.size(x) == 1), 0)
    by_heading = F.when(index != "", by_index).when(is_bullet, by_bullet).when(unique.isNotNull(), told(unique, "header")).otherwise(noted("attribution_deferred"))

    found = F.when(F.col("heading").isNotNull(), by_heading).when((seq != "") & ~F.coalesce(F.startswith(raw, F.lit(T.BULLET)), F.lit(False)), by_seq).when(quote.isNotNull(), by_quote).when(F.size(names) > 0, by_name).otherwise(alone)
    # A lead that only grants its bullets, which are not split off: nothing, unless the quote begins in the lead.
    lead = F.exists(effects, lambda c: F.array_contains(found["labels"], c["label"]) & (c["lead"] != "") & ~F.coalesce((F.call_function("locate", quote, c["norm"]) > 0) & (F.call_function("locate", quote, c["norm"]) <= F.length(c["lead"])), F.lit(False)))
    return F.when(lead, noted("attribution_deferred")).otherwise(found)


def attest(supplements: DataFrame, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned, notes) from id, section, name_ja, supplement and id, section, label, pos, text_ja, unsplit.

    assigned: id, section, label, kind (null where only the flag is stated), ladder, mandatory; notes: id, section, pos,
    note, line. Clauses labelled 0 or 0-k are preambles, which only statements that a passage is no effect reach.
    """
    lines = statements(supplements)
    lines = lines.withColumns({"kinds": stated_kinds(F.col("line")), "mandatory": states_mandatory(F.col("line")), "outside": T.outside_parentheses("line"), "quoted_raw": T.quotes(F.col("line")), "heading_raw": T.quotes(F.coalesce("heading", F.lit("")))})
    lines = lines.withColumns({"quoted": T.normalised_each(F.col("quoted_raw")), "heading_quotes": T.normalised_each(F.col("heading_raw")), "no_effect": F.col("outside").rlike(NON_EFFECT)})
    lines = stored(lines.where("no_effect OR mandatory OR size(kinds) > 0"))
    by_label = F.col("heading").isNull() & F.col("line").rlike(rf"『[{T.NUMERALS}]』") & ~F.coalesce(F.startswith(F.get("quoted_raw", 0), F.lit(T.BULLET)), F.lit(False)) & ~F.col("no_effect")
    spoken_of = lines.groupBy("id", "section").agg(F.bool_or(~by_label).alias("by_text"))  # texts of the others need not move
    clauses = clauses.join(spoken_of, ["id", "section"])
    grant = F.when(F.contains("text_ja", F.lit(T.BULLET)) & F.split("text_ja", T.BULLET)[0].rlike(GRANT), F.split("text_ja", T.BULLET)[0]).otherwise("")
    norm = F.when(F.col("by_text") | (T.normalised(grant) != ""), T.normalised(F.coalesce("text_ja", F.lit(""))))
    told = clauses.select("id", "section", F.struct("pos", "label", norm.alias("norm"), F.coalesce("unsplit", F.lit(False)).alias("unsplit"), T.normalised(grant).alias("lead")).alias("c"))
    preamble = lambda c: c["label"].rlike(r"\A0(-.*)?\z")
    nested = told.groupBy("id", "section").agg(F.array_sort(F.collect_list("c")).alias("all"))
    nested = nested.select("id", "section", F.filter("all", lambda c: ~preamble(c)).alias("effects"), F.filter("all", preamble).alias("preambles"))
    rows = lines.join(nested, ["id", "section"])

    said = F.when(F.size("quoted") > 0, F.col("quoted")).otherwise(F.col("heading_quotes"))
    hit = F.filter("preambles", lambda c: F.exists(said, lambda q: (q != "") & F.contains(c["norm"], q)))
    covered = F.filter("preambles", lambda c: F.exists(said, lambda q: (q != "") & F.contains(q, F.regexp_replace(c["norm"], "。+\\z", ""))))
    entire = F.filter("effects", lambda c: F.exists(said, lambda q: (q != "") & F.regexp_replace(c["norm"], r"\A[0-9]{0,2}[:：]?|。\z", "").eqNullSafe(F.regexp_replace(q, r"\A[0-9]{0,2}[:：]?|。\z", ""))))
    passages = F.when(F.size(hit) > 0, hit).when(F.size(covered) > 0, covered).otherwise(entire)
    silent = F.struct(F.transform(passages, lambda c: c["label"]).alias("labels"), F.when(F.size(passages) > 0, "non_effect").alias("ladder"), F.when(F.size(passages) == 0, "non_effect_outside_preamble").alias("note"))
    unclear = F.struct(F.array().cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("ladder"), F.lit("kind_ambiguous").alias("note"))
    rows = rows.withColumn("t", F.when(F.col("no_effect"), silent).when(F.size("kinds") > 1, unclear).otherwise(_targets()))
    rows = stored(rows.select("id", "section", "pos", "line", "kinds", "mandatory", "no_effect", "t"))  # both results are made of it
    kind = F.when(F.col("no_effect"), "x").otherwise(F.get("kinds", 0))
    deferred = F.when((F.size("kinds") == 0) & ~F.col("no_effect"), "mandatory_deferred").otherwise(F.col("t")["note"])
    notes = rows.where("t.note IS NOT NULL").select("id", "section", "pos", deferred.alias("note"), "line")

    each = rows.select("id", "section", "pos", F.explode("t.labels").alias("label"), kind.alias("kind"), F.col("t")["ladder"].alias("ladder"), (F.col("mandatory") & ~F.col("no_effect")).alias("mandatory"))
    by = each.groupBy("id", "section", "label").agg(F.count_distinct("kind").alias("n"), F.min("kind").alias("kind"), F.min_by("ladder", "pos").alias("ladder"), F.bool_or("mandatory").alias("mandatory"), F.min("pos").alias("pos"))
    conflicts = by.where("n > 1").select("id", "section", "pos", F.lit("kind_conflicts").alias("note"), F.col("label").alias("line"))
    assigned = by.select("id", "section", "label", F.when(F.col("n") == 1, F.col("kind")).alias("kind"), "ladder", "mandatory").where("kind IS NOT NULL OR mandatory")
    return assigned, notes.unionByName(conflicts)
