"""Clauses from entity texts: sections, numbered parts, preambles by role, and bullets as clauses of their own."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from clausewright.functions import spans as S
from clausewright.functions import text as T
from clausewright.operators.attest import BULLET_HEADING, GRANT, stated_kinds, statements
from clausewright.plans.lineage import in_small_batches

# Class bits whose first line may name materials, and the wording of conditions and limits.
MONSTER, MATERIAL_CLASSES = 0x1, 0x40 | 0x80 | 0x2000 | 0x800000 | 0x4000000
MATERIAL = "藉由.{0,30}?降臨|降臨所必需|降臨所必須|降臨必需"
SUMMON = (
    "不能通常召喚|不能特殊召喚|不能召喚|不能同步召喚|不能超量召喚|不能連結召喚|不能融合召喚|不能儀式召喚|不能作為|才能特殊召喚|只能特殊召喚"
    "|只能.{0,40}?召喚|規則上.{0,20}?當作等級|此卡.{0,30}?上級召喚|必須解放.{0,20}?召喚|此卡.{0,20}?不能.{0,20}?召喚"
)
USAGE = "1回合.{0,30}?(?:使用|發動|選擇)|回合只能|各能使用|最多.{0,4}次|決鬥中.{0,10}?(?:使用|發動)|同一連鎖上.{0,10}?(?:使用|發動)"


def is_material_line(text: Column, type_bits: Column) -> Column:
    """Whether the first line of an entity of certain classes names materials: it is a phrase, so it has no full stop."""
    first = T.trimmed(F.split(text, "\n", 2)[0])
    fits = (type_bits.bitwiseAND(MONSTER) != 0) & (type_bits.bitwiseAND(MATERIAL_CLASSES) != 0)
    return F.coalesce(fits & (first != "") & ~F.endswith(first, F.lit("。")), F.lit(False))


def unit_role(text: Column) -> Column:
    """mat, cond or limit of the first part between commas and stops that has one; null where none has."""

    def one(part: Column) -> Column:
        return F.when(part.rlike(MATERIAL), "mat").when(part.rlike(SUMMON), "cond").when(part.rlike(USAGE), "limit")

    return F.get(F.array_compact(F.transform(F.split(text, "[\n。，]"), one)), 0)


#: Parts of a text in both languages.
_PARTS = StructType().add("parts", ArrayType(StructType().add("zh", StringType()).add("ja", StringType())))
_ROLES = (("mat", MATERIAL), ("cond", SUMMON), ("limit", USAGE))


@lru_cache(1024)
def _role(unit: str) -> str | None:
    """The same of one text; units recur."""
    return next((role for part in re.split("[\n。，]", unit) for role, pattern in _ROLES if re.search(pattern, part)), None)


def preamble_role(text: Column, type_bits: Column) -> Column:
    return F.when(is_material_line(text, type_bits), "mat").otherwise(unit_role(text))


def role_runs(text: Column, type_bits: Column) -> Column:
    """array<struct<role, text>>: lines of a preamble, neighbours of equal role joined; a line without a role joins the one before it."""
    units = T.lines(text)
    roles = F.transform(units, lambda x, i: F.when((i == 0) & is_material_line(text, type_bits), "mat").otherwise(unit_role(x)))
    empty = F.array().cast("array<struct<role:string,text:string>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(F.coalesce(last["role"], x["role"]).alias("role"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"))
        same = x["role"].isNull() | last["role"].isNull() | (x["role"] == last["role"])
        return F.when((F.size(done) > 0) & same, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.zip_with(units, roles, lambda u, r: F.struct(r.alias("role"), u.alias("text"))), empty, step)


def _runs(roles: list[str | None]) -> list[list[int]]:
    """Places of neighbours with one role; one without a role goes with those before it, or with the first that has one."""
    out: list[list[int]] = []
    held = None
    for i, role in enumerate(roles):
        if out and (held is None or role in (None, held)):
            out[-1].append(i)
        else:
            out.append([i])
        held = role or held
    return out


def _pairs(zh: str, ja: str, quotes: list[str]) -> tuple[list | None, str | None]:
    """Spans of the parts of a preamble in both languages, or why it stays whole.

    The original's lines are the parts, those joined that a quote runs over. Sentences of both languages go together by
    their number. Within a part, neighbours of different roles are cut apart, unless a quote would be.
    """
    lines = S.pieces(ja, S.LINE)
    groups = S.seamed(ja, lines, quotes)
    if S.severed(ja, groups, quotes):
        return None, "quote"
    counts = [max(1, ja[a:b].count("。")) for a, b in groups]
    units = S.pieces(zh, S.UNIT)
    if len(units) != sum(counts):
        return None, "units" if len(groups) > 1 else None
    out = []
    for (a, b), n in zip(groups, counts, strict=True):
        mine, units = units[:n], units[n:]
        sentences = S.pieces(ja, S.SENTENCE, (a, b))
        cut = _runs([_role(zh[x:y]) for x, y in mine]) if len(sentences) == n > 1 else []
        inner = [(sentences[r[0]][0], sentences[r[-1]][1]) for r in cut]
        if len(cut) > 1 and not S.severed(ja[a:b], [(x - a, y - a) for x, y in inner], quotes):
            out += [(mine[r[0]][0], mine[r[-1]][1], *span) for r, span in zip(cut, inner, strict=True)]
        else:
            out.append((mine[0][0], mine[-1][1], a, b))
    if len(out) < 2:
        return None, None
    return (None, "quote") if S.severed(ja, [(x[2], x[3]) for x in out], quotes) else (out, None)


@F.pandas_udf(StructType(_PARTS.fields[:1]).add("reason", StringType()))
def preamble_parts(zh: pd.Series, ja: pd.Series, supplement: pd.Series) -> pd.DataFrame:
    """parts: a preamble's parts in both languages; null where it is one, or for a reason: quote (one would be cut apart) or units (the languages do not have as many)."""
    rows = []
    for z, j, s in zip(zh, ja, supplement, strict=True):
        found, reason = _pairs(z or "", j or "", S.quoted(s)) if j and j.strip() else (None, None)
        rows.append((found and [{"zh": z[x[0] : x[1]], "ja": j[x[2] : x[3]]} for x in found], reason))
    return pd.DataFrame(rows, columns=["parts", "reason"])


def preambles(texts: DataFrame) -> DataFrame:
    """id, section, pos, label (0, 0-1 and so on), text_zh, text_ja, role, reason of preambles (id, section, type, text_zh, text_ja, supplement)."""
    texts = in_small_batches(texts).repartition("id", "section")  # a file of few row groups would leave the work to few tasks
    rows = texts.withColumn("p", preamble_parts("text_zh", "text_ja", "supplement"))
    whole = F.array(F.struct(F.col("text_zh").alias("zh"), F.col("text_ja").alias("ja")))
    rows = rows.select("id", "section", "type", F.col("p.reason").alias("reason"), F.posexplode(F.coalesce("p.parts", whole)).alias("pos", "x"))
    label = F.when(F.col("pos") == 0, "0").otherwise(F.concat(F.lit("0-"), F.col("pos").cast("string")))
    role = F.when((F.col("pos") == 0) & is_material_line(F.col("x.zh"), F.col("type")), "mat").otherwise(unit_role(F.col("x.zh")))
    return rows.select("id", "section", "pos", label.alias("label"), F.col("x.zh").alias("text_zh"), F.col("x.ja").alias("text_ja"), role.alias("role"), "reason")


def bullets(text: Column) -> Column:
    """The lead and the bullets of a text, each bullet at the start of a line or after a full stop."""
    return F.filter(F.transform(F.split(text, rf"(?:\n|(?<=。))(?={T.BULLET})"), T.trimmed), lambda x: x != "")


def build(entities: DataFrame, split_bullets: DataFrame | None = None) -> DataFrame:
    """id, section, pos, label, text_zh, text_ja, text_hash, role, unsplit of entities (id, type, body, ja_main, ja_pendulum).

    Parts of both languages go together where they have the same labels. ``split_bullets`` (id, section) says where
    bullets are clauses of their own. A text without numerals is one part, unsplit.
    """
    rows = entities.select("id", "type", "ja_main", "ja_pendulum", F.explode(T.sections(F.coalesce("body", F.lit("")))).alias("s")).select("id", "type", "s.section", F.col("s")["text"].alias("zh"), F.when(F.col("s")["section"] == "pendulum", F.col("ja_pendulum")).otherwise(F.col("ja_main")).alias("ja"))
    if split_bullets is not None:
        rows = rows.join(split_bullets.select("id", "section", F.lit(True).alias("cut")).distinct(), ["id", "section"], "left")
    else:
        rows = rows.withColumn("cut", F.lit(False))
    rows = rows.withColumns({"a": T.segments(F.col("zh")), "b": T.segments(F.coalesce("ja", F.lit("")))})
    labels = lambda c: F.transform(c, lambda x: x["label"])
    rows = rows.withColumn("together", labels("a") == labels("b")).withColumn("names", T.deduplicated_labels(labels("a")))
    parts = rows.select("id", "type", "section", "cut", F.posexplode("a").alias("p", "x"), "b", "together", "names")
    parts = parts.select("id", "type", "section", "cut", "p", F.get("names", F.col("p")).alias("label"), F.col("x")["text"].alias("zh"), F.when(F.col("together"), F.get("b", F.col("p"))["text"]).alias("ja"))

    # A preamble is cut by role, a clause by its bullets; either gives an array of (suffix, zh, ja, role).
    kind = "array<struct<suffix:string,zh:string,ja:string,role:string>>"
    runs = role_runs(F.col("zh"), F.col("type"))
    preamble = F.transform(runs, lambda r, i: F.struct(F.when(i == 0, "").otherwise(F.concat(F.lit("-"), i.cast("string"))).alias("suffix"), r["text"].alias("zh"), F.when(F.size(runs) == 1, F.col("ja")).alias("ja"), r["role"].alias("role")))
    ja = bullets(F.coalesce("ja", F.lit("")))
    zh = bullets(F.col("zh"))
    cut = F.transform(zh, lambda x, i: F.struct(F.when(i == 0, "").otherwise(F.concat(F.lit("-●"), i.cast("string"))).alias("suffix"), x.alias("zh"), F.when(F.size(zh) == F.size(ja), F.get(ja, i)).alias("ja"), F.lit(None).cast("string").alias("role")))
    whole = F.array(F.struct(F.lit("").alias("suffix"), F.col("zh"), F.col("ja"), F.lit(None).cast("string").alias("role")))
    pieces = F.when(F.col("label") == "0", preamble.cast(kind)).when(F.coalesce("cut", F.lit(False)) & ~F.startswith("zh", F.lit(T.BULLET)), cut.cast(kind)).otherwise(whole.cast(kind))
    out = parts.select("id", "section", "label", "p", F.posexplode(pieces).alias("k", "c"))
    return out.select(
        "id", "section", (F.col("p") * 1000 + F.col("k")).alias("pos"), F.concat("label", F.col("c")["suffix"]).alias("label"), F.col("c")["zh"].alias("text_zh"), F.col("c")["ja"].alias("text_ja"),
        T.text_hash(F.col("c")["ja"], F.col("c")["zh"]).alias("text_hash"), F.col("c")["role"].alias("role"), (F.col("label") == "1").alias("unsplit"),
    )


def bullets_spoken_of(supplements: DataFrame) -> DataFrame:
    """id, section whose official text has a heading about a bullet: what lets bullets be clauses."""
    return statements(supplements).where(F.col("heading").rlike(BULLET_HEADING)).select("id", "section").distinct()


@F.pandas_udf(StructType(_PARTS.fields[:1]).add("problem", StringType()))
def _bullet_parts(zh: pd.Series, ja: pd.Series, supplement: pd.Series) -> pd.DataFrame:
    rows = []
    for z, j, s in zip(zh.fillna(""), ja.fillna(""), supplement, strict=True):
        sides = [[x.strip() for x in re.split(f"(?={T.BULLET})", t)] for t in (z, j)]
        sides = [x if not x[0].startswith(T.BULLET) else ["", *x] for x in sides]
        if not j:
            sides[1] = [""] * len(sides[0])
        at = [S.covering(t, x) for t, x in zip((z, j), sides, strict=True)]
        if len(sides[0]) != len(sides[1]):
            rows.append((None, "bullet_split_mismatch"))
        elif None in at:
            rows.append((None, "bullet_coverage_failed"))
        elif S.severed(j, at[1], S.quoted(s)):
            rows.append((None, "bullet_quote_violations"))
        else:
            rows.append(([{"zh": a, "ja": b} for a, b in zip(*sides, strict=True)], None))
    return pd.DataFrame(rows, columns=["parts", "problem"])


def bullet_authority(clauses: DataFrame, supplements: DataFrame) -> DataFrame:
    """id, section, label, by: what lets a clause's bullets be clauses of their own.

    heading: the section's official text has a heading about a bullet. typed: its lines about bullets of this clause, which has two
    or more, state different kinds. quoted: the clause is a lead that grants what follows, and a quote from a bullet on lies in it.
    ``clauses``: id, section, label, text_zh, text_ja; ``supplements``: id, section, name_ja, supplement.
    """
    held = clauses.where(F.contains(F.concat_ws("", "text_zh", "text_ja"), F.lit(T.BULLET)) & ~F.col("label").rlike(r"\A0(-.*)?\z"))
    held = held.select("id", "section", "label", "text_ja").withColumn("norm", T.normalised(F.coalesce("text_ja", F.lit(""))))
    lines = statements(supplements).withColumn("quotes_raw", T.quotes(F.col("line"))).withColumn("quotes", T.normalised_each(F.col("quotes_raw")))
    heading = held.join(lines.where(F.col("heading").rlike(BULLET_HEADING)).select("id", "section").distinct(), ["id", "section"]).withColumn("by", F.lit("heading"))
    both = held.join(lines.select("id", "section", "quotes", stated_kinds(F.col("line")).alias("kinds")), ["id", "section"])
    subject = F.get(F.filter("quotes", lambda q: F.startswith(q, F.lit(T.BULLET))), 0)
    many = F.length("norm") - F.length(F.replace("norm", F.lit(T.BULLET), F.lit(""))) > 1
    apart = both.where(many & ((subject == T.BULLET) | F.contains("norm", subject))).select("id", "section", "label", F.explode("kinds").alias("kind"))
    typed = apart.groupBy("id", "section", "label").agg(F.count_distinct("kind").alias("n")).where("n > 1").withColumn("by", F.lit("typed"))
    grants = F.contains("text_ja", F.lit(T.BULLET)) & F.split("text_ja", T.BULLET)[0].rlike(GRANT)
    quoted = both.where(grants & F.exists("quotes", lambda q: F.startswith(q, F.lit(T.BULLET)) & F.contains("norm", q))).withColumn("by", F.lit("quoted"))
    found = [x.select("id", "section", "label", "by") for x in (heading, typed, quoted)]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def split_bullets(clauses: DataFrame, supplements: DataFrame, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clauses, problems): bullets that official texts allow cut off as clauses label-●1, label-●2 and so on.

    A clause stays whole, with a problem (id, section, label, problem), where both languages do not have as many bullets, where the
    parts are not the text, or where a quote would be cut apart. ``allowed``: the keys by ``bullet_authority``, where they are known.
    """
    allowed = bullet_authority(clauses, supplements).select("id", "section", "label").distinct() if allowed is None else allowed
    rows = clauses.join(allowed.withColumn("allowed", F.lit(True)), ["id", "section", "label"], "left").join(supplements.select("id", "section", "supplement"), ["id", "section"], "left")
    rows = rows.withColumn("b", F.when(F.col("allowed"), _bullet_parts(*(F.when(F.col("allowed"), F.col(c)) for c in ("text_zh", "text_ja", "supplement")))))
    problems = rows.where("b.problem IS NOT NULL").select("id", "section", "label", "b.problem")
    whole = F.array(F.struct(F.lit(0).alias("k"), F.col("text_zh").alias("zh"), F.col("text_ja").alias("ja")))
    parts = F.filter(F.transform("b.parts", lambda x, k: F.struct(k.alias("k"), x["zh"].alias("zh"), x["ja"].alias("ja"))), lambda x: (x["zh"] != "") | (x["ja"] != ""))
    cut = rows.withColumn("x", F.explode(F.coalesce(parts, whole)))
    label = F.when(F.col("x.k") == 0, F.col("label")).otherwise(F.concat("label", F.lit(f"-{T.BULLET}"), F.col("x.k").cast("string")))
    others = [c for c in clauses.columns if c not in ("id", "section", "label", "text_zh", "text_ja", "text_hash")]
    hashed = [T.text_hash(F.col("x.ja"), F.col("x.zh")).alias("text_hash")] if "text_hash" in clauses.columns else []
    return cut.select("id", "section", label.alias("label"), F.col("x.zh").alias("text_zh"), F.col("x.ja").alias("text_ja"), *hashed, *others), problems


@F.pandas_udf(ArrayType(BooleanType()))
def _lacks(body: pd.Series, parts: pd.Series) -> pd.Series:
    """Of each part whether the text lacks it; each is sought from the end of the one before, then from the start, so parts in order take one pass."""

    def one(text: str | None, parts) -> list[bool | None]:
        at, out = 0, []
        for p in parts:
            found = None if text is None or p is None else max(text.find(p, at), text.find(p) if text.find(p, at) < 0 else -1)
            out.append(None if found is None else found < 0)
            at = at if found is None or found < 0 else found + len(p)
        return out

    return pd.Series([one(t, p) for t, p in zip(body, parts, strict=True)], dtype=object)


def substring_faults(clauses: DataFrame, entities: DataFrame) -> DataFrame:
    """Clauses whose text is not a part of the entity's text, blanks aside. An entity's text is looked at once for all its clauses."""
    held = clauses.select("id", F.struct(*clauses.columns).alias("c"), T.without_blanks(F.col("text_zh")).alias("t"))
    nested = held.groupBy("id").agg(F.collect_list(F.struct("c", "t")).alias("all"))
    joined = nested.join(entities.select("id", T.without_blanks(F.col("body")).alias("body")), "id")
    lacking = joined.select("all", _lacks("body", F.transform("all", lambda x: x["t"])).alias("lacks"))
    each = lacking.select(F.explode(F.arrays_zip("all", "lacks")).alias("x")).where("x.lacks")
    return each.select("x.all.c.*")
