"""The sheet of clauses, built in one from entities, official texts, split records, judgments and the sheet of the run before.

Sections are cut into preambles, numbered parts and texts without numerals; split records apply where they hold; bullets
that official texts speak of become clauses; official statements give kinds, judgments give the others, and optional values
follow; a flagged clause flags its entity; then the sheet of the run before is merged in by the authority of its sources.

Every entity has a stamp, a hash of all that its clauses are made from. A later run cuts, attests, judges and merges only
the entities whose stamps are new; the others' rows go on as they are. What depends on all rows, which rules cover enough
and what they predict, is made again from the stored hits of each clause and reads no texts.

Texts are shuffled once, packed, where both languages of a section meet, and stored once; all that is read from them is stored beside
them, and every step after that joins and sorts without them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import clauses as C
from clausewright.operators import merge, rules, splits
from clausewright.operators.attest import attest
from clausewright.plans.lineage import in_small_batches, stored

SECTION = ("id", "section")
KEYS = merge.KEYS
# Class bits of monsters, of those without effects, and of those with a second section.
MONSTER, PLAIN, PENDULUM = 0x1, 0x10, 0x1000000
#: A last line in which a text names its other versions.
FOOTNOTE = r"\n\n※[^\n]*\z"
COLUMNS = ("id", "section", "label", "pos", "text_zh", "text_ja", "text_hash", "confidence", "kind", "optional", "role", "source", "needs_review", "tags", "hits", "predicted")
_REPORT = ("id", "section", "label", "check", "detail")


@dataclass(frozen=True)
class Sheet:
    """``clauses``: the rows, with ``COLUMNS``, of a first run joined with their stored texts when they are asked for; ``report``: id, section, label, check, detail of all that a run noticed; ``stamps``: id, stamp; ``touched``: id of the entities that this run made anew."""

    clauses: DataFrame
    report: DataFrame
    stamps: DataFrame
    touched: DataFrame


def _says(rows: DataFrame, check: str | Column, detail: Column | None = None, where: Column | None = None) -> DataFrame:
    """Rows of a report of the rows where a condition holds."""
    check = F.lit(check) if isinstance(check, str) else check
    label = F.col("label") if "label" in rows.columns else F.lit(None)
    section = F.col("section") if "section" in rows.columns else F.lit(None)
    held = rows if where is None else rows.where(where)
    return held.select("id", section.cast("string").alias("section"), label.cast("string").alias("label"), check.alias("check"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def _all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def fingerprints(entities: DataFrame, supplements: DataFrame, records: DataFrame | None = None, judgments: DataFrame | None = None) -> DataFrame:
    """id, stamp of each entity: of its row, its official texts, its split records and its judgments, whatever their order."""
    told = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    out = entities.select("id", told(entities).alias("stamp"))
    for n, other in enumerate((supplements, records, judgments)):
        if other is not None:
            held = other.select("id", told(other).alias("h")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias(f"h{n}"))
            out = out.join(held, "id", "left").withColumn("stamp", F.concat_ws("|", "stamp", F.coalesce(f"h{n}", F.lit("")))).drop(f"h{n}")
    return out.select("id", F.sha2(F.col("stamp").cast("binary"), 256).alias("stamp"))


def changed(stamps: DataFrame, before: DataFrame | None) -> DataFrame:
    """id of entities whose stamp is not that of the run before."""
    if before is None:
        return stamps.select("id")
    old = before.select("id", F.col("stamp").alias("old"))
    return stamps.join(old, "id", "left").where(~F.col("stamp").eqNullSafe(F.col("old"))).select("id")


def sections(entities: DataFrame, supplements: DataFrame) -> DataFrame:
    """id, section, type, zh, sound, ja, supplement of each section of entities (id, type, body) with what official texts (id, section, text_ja, supplement) say of it; sound: whether its text is a part of the body, blanks aside. Plain monsters have none."""
    kind = F.coalesce(F.col("type").cast("long"), F.lit(0).cast("long"))
    plain = (kind.bitwiseAND(MONSTER | PLAIN) == MONSTER | PLAIN) & (kind.bitwiseAND(PENDULUM) == 0)
    rows = entities.where(~plain).select("id", kind.alias("type"), "body", F.explode(T.sections(F.regexp_replace(F.coalesce("body", F.lit("")), FOOTNOTE, ""))).alias("s"))
    rows = rows.select("id", "type", "body", "s.section", F.coalesce(F.col("s")["text"], F.lit("")).alias("zh"))
    part = (F.col("body") == F.col("zh")) | F.contains(T.without_blanks(F.col("body")), T.without_blanks(F.col("zh")))
    rows = rows.withColumn("sound", F.coalesce(part, F.lit(True))).drop("body").withColumn("zh", T.packed("zh"))  # nothing is held against no body
    told = supplements.select(*SECTION, T.packed(F.coalesce("text_ja", F.lit(""))).alias("ja"), "supplement")
    return rows.join(told, list(SECTION), "left").withColumns({"zh": T.unpacked("zh"), "ja": F.coalesce(T.unpacked("ja"), F.lit(""))})


def _parts(texts: DataFrame) -> DataFrame:
    """The pieces of each section: part (0 preamble, 1 numbered, 2 text without numerals), pos, label, text_zh, text_ja, sound (it is a part of the entity's text for certain), and on the first piece what was noticed. Both languages go together by their places where they have as many numerals."""
    numbered = lambda c: F.filter(c, lambda x: ~x["label"].isin("0", "1"))
    one = lambda c, label: F.get(F.filter(c, lambda x: x["label"] == label), 0)["text"]
    labels = lambda c: F.transform(c, lambda x: x["label"])
    rows = texts.withColumns({"a": T.segments(F.col("zh")), "b": T.segments(F.col("ja"))})
    rows = rows.withColumns({"na": numbered("a"), "nb": numbered("b"), "has_ja": T.trimmed(F.col("ja")) != ""})
    rows = rows.withColumn("aligned", F.col("has_ja") & (F.size("na") == F.size("nb")))
    double = lambda c: F.size(F.array_distinct(labels(c))) < F.size(c)
    swapped = F.col("aligned") & double(F.col("na")) & ~double(F.col("nb"))
    names = T.deduplicated_labels(F.when(swapped, labels(F.col("nb"))).otherwise(labels(F.col("na"))))
    pre, pre_ja = one(F.col("a"), "0"), one(F.col("b"), "0")
    some = F.size("a") > 0
    noticed = F.array_compact(
        F.array(
            F.when(some & ~F.col("has_ja"), "no_japanese_text"),
            F.when(some & F.col("has_ja") & ~F.col("aligned"), "numeral_mismatch"),
            F.when(some & swapped, "numeral_relabelled"),
            F.when(some & F.col("aligned") & (pre.isNull() != pre_ja.isNull()) & (F.size("na") > 0), "preamble_one_sided"),
            F.when(~some & F.col("has_ja"), "empty_section_with_japanese"),
        )
    )
    piece = lambda part, label, zh, ja: F.struct(F.lit(part).alias("part"), label.alias("label"), zh.alias("zh"), F.when(F.col("aligned"), ja).alias("ja"))
    whole = F.col("sound") & T.covers(F.col("zh"), F.transform("a", lambda x: x["text"]))  # the pieces one after another are the section
    rows = rows.withColumns({"names": names, "noticed": noticed, "sound": whole})
    head = F.when(pre.isNotNull(), F.array(piece(0, F.lit("0"), pre, pre_ja)))
    body = F.transform("na", lambda x, i: piece(1, F.get("names", i), x["text"], F.get("nb", i)["text"]))
    blob = F.when(F.size("na") == 0, F.transform(F.filter("a", lambda x: x["label"] == "1"), lambda x: piece(2, F.lit("1"), x["text"], one(F.col("b"), "1"))))
    kind = "array<struct<part:int,label:string,zh:string,ja:string>>"
    empty = F.array().cast(kind)
    pieces = F.concat(*(F.coalesce(x.cast(kind), empty) for x in (head, body, blob)))
    rows = rows.select(*SECTION, "type", "supplement", "sound", "noticed", F.posexplode_outer(pieces).alias("p", "x"))
    return rows.select(*SECTION, "type", "sound", F.when(F.coalesce("x.part", F.lit(0)) != 1, F.col("supplement")).alias("supplement"), F.when(F.coalesce("p", F.lit(0)) == 0, F.col("noticed")).alias("noticed"), F.coalesce("p", F.lit(0)).alias("p"), "x.part", "x.label", F.col("x.zh").alias("text_zh"), F.coalesce("x.ja", F.lit("")).alias("text_ja"))


def _read(rows: DataFrame) -> DataFrame:
    """Clauses (label, text_zh, text_ja, unsplit, lead) with all that is read from their texts: text_hash, hits, and rule, the optional value by the activation clause. Later steps do without the texts."""
    spoken_of = ~F.col("label").rlike(r"\A0(-.*)?\z") & (F.coalesce("text_ja", F.lit("")) != "")
    rows = rows.withColumn("activation", T.activation_clause(F.col("text_ja")))
    hits = F.when(spoken_of, rules.rule_hits(F.col("text_ja"), F.col("activation"), F.col("lead"))).otherwise(F.array().cast("array<string>"))
    rule = merge.optional_by_rule(F.col("text_ja"), F.col("unsplit"), F.col("activation"))
    return rows.withColumns({"text_hash": T.text_hash(F.col("text_ja"), F.col("text_zh")), "hits": hits, "rule": rule}).drop("activation", "lead")


def cut(texts: DataFrame, supplements: DataFrame, records: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(clauses, reports) of sections: id, section, label, pos, text_zh, text_ja, kind, role, source, unsplit, sound, and what ``_read`` reads.

    A split record that holds stands for a section's preamble or its text without numerals; other preambles are cut by lines and
    sentences, and where they are, their parts are 0-1, 0-2 and so on. Preambles are no effect (x), by rule. Texts are stored once;
    clauses whose bullets are cut off are stored beside them.
    """
    parts = _parts(in_small_batches(texts))
    stays = F.col("part").isNotNull()
    told = None
    if records is not None:
        parts = stored(parts)
        open_ = parts.where("part <> 1").select(*SECTION, "text_zh", "text_ja", "supplement", (F.col("part") == 0).alias("numbered"), "type")
        told = stored(splits.judged_splits(records, open_))
        applied = told.where("problem IS NULL").select(*SECTION, F.lit(True).alias("applied")).distinct()
        parts = parts.join(applied, list(SECTION), "left")
        stays = stays & ((F.col("part") == 1) | F.col("applied").isNull())

    rows = parts.withColumn("stays", stays)
    before = F.col("stays") & (F.col("part") == 0)
    whole = F.array(F.struct(F.col("text_zh").alias("zh"), F.col("text_ja").alias("ja")))
    rows = rows.withColumn("cut", C.preamble_parts(*(F.when(before, F.col(c)) for c in ("text_zh", "text_ja", "supplement"))))
    rows = rows.withColumn("many", F.coalesce(F.size("cut.parts") > 1, F.lit(False)))
    rows = rows.select(*SECTION, "type", "p", "part", "label", "many", "stays", "sound", "noticed", F.col("cut.reason").alias("reason"), F.posexplode(F.coalesce("cut.parts", whole)).alias("k", "x"))
    label = F.when(F.col("many"), F.concat("label", F.lit("-"), (F.col("k") + 1).cast("string"))).otherwise(F.col("label"))
    first = F.col("k") == 0
    rows = rows.select(
        *SECTION, F.when(F.col("stays"), label).alias("label"), (F.col("p") * 1000 + F.col("k")).alias("pos"), F.when(F.col("stays"), F.col("x.zh")).alias("text_zh"), F.when(F.col("stays"), F.col("x.ja")).alias("text_ja"),
        F.when(before, "x").alias("kind"), F.when(before, C.preamble_role(F.col("x.zh"), F.col("type"))).alias("role"), F.when(before, "rule").alias("source"), (F.col("part") == 2).alias("unsplit"),
        (F.col("sound") & ~F.col("many")).alias("sound"), F.when(first, F.col("noticed")).alias("noticed"), F.when(first, F.col("reason")).alias("reason"),
    )
    if told is not None:
        by_record = splits.split_clauses(told).select(*SECTION, "label", "pos", "text_zh", "text_ja", "kind", "role", "source", F.lit(False).alias("unsplit"), F.lit(False).alias("sound"))
        rows = rows.unionByName(by_record, allowMissingColumns=True)
    every = stored(_read(rows.withColumn("lead", F.lit(None).cast("string"))))
    found = every.where("label IS NOT NULL").drop("noticed", "reason")
    noticed = every.where("size(noticed) > 0").select(*SECTION, F.explode("noticed").alias("what"))
    reports = [_says(noticed, F.col("what")), _says(every, "preamble_split_fallback", F.col("reason"), F.col("reason").isNotNull())]
    if told is not None:
        reports.append(_says(told.where("problem IS NOT NULL"), F.col("problem"), F.col("detail")))

    allowed = stored(C.bullet_authority(found, supplements).select(*KEYS).distinct())
    mine, problems = C.split_bullets(found.join(allowed, list(KEYS), "left_semi"), supplements, allowed)
    mine = stored(mine.drop("hits", "rule").withColumn("sound", F.lit(False)))
    others = found.join(allowed, list(KEYS), "left_anti")
    return others.unionByName(stored(_read(rules.bullet_leads(mine)))), [*reports, _says(problems, F.col("problem"))]


def stage(entities: DataFrame, supplements: DataFrame, records: DataFrame | None, judgments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clauses, texts, report) of entities by themselves: cut, attested, judged, with optional values, and flagged as a whole. The clauses are without their texts, which ``texts`` has by ``KEYS``."""
    names = entities.select("id", F.coalesce("name_ja", F.lit("")).alias("_name")) if "name_ja" in entities.columns else entities.select("id", F.lit("").alias("_name"))
    named = supplements.join(names, "id").withColumn("name_ja", F.coalesce(F.col("name_ja") if "name_ja" in supplements.columns else F.lit(None).cast("string"), "_name")).drop("_name")
    made, reports = cut(sections(entities, supplements), named, records)
    assigned, notes = attest(named, made.select(*KEYS, "pos", "text_ja", "unsplit"))
    spoken = supplements.select(*SECTION, (F.coalesce("supplement", F.lit("")) != "").alias("spoken"))
    rows = merge.attested(made.drop("text_zh", "text_ja"), assigned).withColumn("needs_review", F.lit(False)).join(spoken, list(SECTION), "left")
    rows = rows.withColumn("confidence", F.when(F.col("spoken"), "high").otherwise("low")).drop("spoken")
    rows = stored(merge.spread_review(merge.optionals(merge.judged(rows, judgments), F.col("rule"))).drop("rule"))
    against = stored(rows.where("validation = 'disagree'").select(*KEYS))
    loose = stored(made.where("NOT sound").select(*KEYS, "text_zh"))
    reports += [
        _says(notes, F.col("note"), F.col("line")),
        _says(rows, F.col("judgment"), where=F.col("judgment").isNotNull() & (F.col("judgment") != "judged")),
        _says(rows.withColumn("what", F.explode("dropped")), F.col("what"), F.col("kind")),
        _says(rows, "optional_pending", F.col("pending"), F.col("pending").isNotNull()),
        _says(made.join(against, list(KEYS)), "optional_disagree", F.col("text_ja")),
        _says(rows, "pending_split", F.col("text_hash"), F.col("unsplit")),
        _says(C.substring_faults(loose, entities), "substring"),
    ]
    return rows, made.select(*KEYS, "text_zh", "text_ja"), _all(reports)


def build_sheet(entities: DataFrame, supplements: DataFrame, records: DataFrame | None = None, judgments: DataFrame | None = None, prior: Sheet | None = None, least: int = rules.MIN_COVERAGE) -> Sheet:
    """The sheet of entities (id, type, body, name_ja).

    ``supplements``: id, section, text_ja, supplement; ``records``: id, section, text_hash, segments, ja_order; ``judgments``: id,
    section, label, seq, kind, optional, role, and rejudge, where a new judgment is to replace the stored one; ``prior``: the
    sheet of the run before. A run on its own output changes nothing.

    Entities of ``prior`` that are gone leave the sheet; those with a null id have no clauses. Judgments whose clauses are gone are
    in the report as judgment_orphans, stored rows as orphaned.
    """
    spark = entities.sparkSession
    judgments = spark.createDataFrame([], "id long, section string, label string, seq long, kind string, optional string, role string") if judgments is None else judgments
    judgments = judgments if "rejudge" in judgments.columns else judgments.withColumn("rejudge", F.lit(False))
    entities = entities.where("id IS NOT NULL")
    stamps = stored(fingerprints(entities, supplements, records, judgments))
    touched = stored(changed(stamps, prior.stamps if prior else None))
    mine = (lambda df: df.join(touched, "id", "left_semi")) if prior else (lambda df: df)
    asked = mine(judgments)
    fresh, texts, report = stage(mine(entities), mine(supplements), mine(records) if records is not None else None, asked)

    again = asked.groupBy(*KEYS).agg(F.max_by("rejudge", "seq").alias("rejudge"))
    fresh = fresh.join(again, list(KEYS), "left").withColumns({"optional_official": F.coalesce(F.col("optional_by") == "official", F.lit(False)), "tags": F.lit(None).cast("array<string>")})
    fresh = fresh.select(*KEYS, "pos", "text_hash", "confidence", "kind", "optional", "role", "source", "needs_review", "tags", "hits", "rejudge", "optional_official")
    if prior:
        earlier = mine(prior.clauses)
        merged = merge.merge(fresh, earlier)
        lost = _says(merge.orphans(earlier, fresh), "orphaned", F.col("source"))
        report = _all([report, _says(merged, F.col("event"), F.col("source"), F.col("event").isNotNull()), lost])
    else:
        merged = fresh
    rows = stored(merged.drop("event", "rejudge", "optional_official"))
    whole = rows.join(texts, list(KEYS), "left")
    if prior:
        held = stamps.join(touched, "id", "left_anti")
        kept = prior.clauses.join(held, "id", "left_semi")
        rows, whole = rows.unionByName(kept.select(*rows.columns)), whole.unionByName(kept.select(*whole.columns))
        report = report.unionByName(prior.report.where("check <> 'judgment_orphans'").join(held, "id", "left_semi").select(*_REPORT))
    report = report.unionByName(_says(merge.orphans(judgments, rows), "judgment_orphans"))
    out = rules.predict(whole, least=least, over=rows)
    out = out.withColumn("source", merge.upgraded_source(F.col("source"), F.col("kind"), F.col("predicted"))).select(*COLUMNS)
    return Sheet(stored(out) if prior else out, stored(report), stamps, touched)
