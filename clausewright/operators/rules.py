"""Rules that predict a clause's kind, as column predicates, and their validation against attested kinds."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions.text import activation_clause

#: A rule needs this coverage and, where as many are attested, this agreement.
MIN_COVERAGE, MIN_ATTESTED, AGREEMENT = 8, 8, 0.99


@dataclass(frozen=True)
class Rule:
    """``scope``: activation or clause, what ``pattern`` is sought in; ``exclude`` is sought in the whole clause; ``lead`` must match the lead of a bullet clause."""

    id: str
    kind: str
    scope: str
    pattern: str
    exclude: str = ""
    lead: str = ""
    merged_into: str = ""


# The rules' patterns.
_EVENT = "た場合|た時|時に|時、|度に|毎に|ダメージ計算|宣言"
RULES = (
    Rule("R1", "t", "activation", "た場合に.{0,14}?発動", "だった場合"),
    Rule("R2", "t", "activation", "^リバース[：:]"),
    Rule("R3", "t", "activation", "(エンド|スタンバイ)フェイズに.{0,10}?発動"),
    Rule("R4", "i", "activation", "自分メインフェイズに.{0,8}?発動"),
    Rule("R5", "q", "activation", "自分・相手ターンに", "存在する限り"),
    Rule("R6", "u", "clause", "手札から特殊召喚できる", f"発動|{_EVENT}"),
    Rule("R7", "c", "clause", "^[^。]*(フィールド|モンスターゾーン)[^。]*存在する限り[^。]*。?$", f"発動|として扱う|フェイズ|事ができる|以下の効果を得る|{_EVENT}"),
    Rule("R8", "c", "clause", "効果を受けない", f"発動|として扱う|素材とした|使用した|召喚に成功したターン|リリースした|{_EVENT}"),
    Rule("R9", "c", "clause", "対象に.{0,6}ならない", f"発動|として扱う|素材とした|使用して|{_EVENT}"),
    Rule("R10", "u", "clause", "しか表側表示で存在できない", f"発動|{_EVENT}"),
    Rule("R11", "u", "clause", "召喚は無効化されない", f"発動|存在する限り|{_EVENT}"),
    Rule("R12", "u", "clause", "フィールドから離れた場合に除外される", "発動|存在する限り"),
    Rule("R13", "x", "clause", "^[^。]*このカードは[^。]*以下の効果を得る。?$", f"発動|{_EVENT}"),
    Rule("R14", "u", "clause", "(フィールド・墓地|墓地・フィールド|墓地またはフィールド上?)[^。]*として扱う", f"発動|{_EVENT}"),
    Rule("R15", "i", "clause", "^[^。]*装備カード扱い[^。]*に装備、または装備を解除して[^。]*。?$"),
    Rule("R16", "t", "clause", "コイントス[^。]*以下の効果を得る"),
    Rule("R17", "c", "clause", "直接攻撃", f"発動|リバース|召喚に成功したターン|手札から特殊召喚|{_EVENT}", "^[^。]*以下の効果を得る。?$"),
)


def active(rules: Sequence[Rule] = RULES) -> list[Rule]:
    return [r for r in rules if not r.merged_into]


def merged_groups(rules: Sequence[Rule] = RULES) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in rules:
        if r.merged_into:
            out.setdefault(r.merged_into, []).append(r.id)
    return out


def problems(rules: Sequence[Rule], kinds: Sequence[str]) -> list[str]:
    """What is wrong with a registry; any of it switches the whole layer off."""
    ids = [r.id for r in rules]
    out = [f"{i} is given twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for r in rules:
        out += [] if re.fullmatch("R[1-9][0-9]*", r.id) else [f"{r.id} is no rule id"]
        out += [] if r.kind in kinds else [f"{r.id}: no kind {r.kind}"]
        out += [] if r.scope in ("activation", "clause") else [f"{r.id}: no scope {r.scope}"]
        if r.merged_into:
            into = next((x for x in rules if x.id == r.merged_into), None)
            out += [f"{r.id} is merged into {r.merged_into}, which does not exist"] if into is None else [f"{r.id} is merged into {into.id}, which is merged itself"] if into.merged_into else []
    return out


def digest(rules: Sequence[Rule] = RULES) -> str:
    """A fingerprint of the definitions."""
    return hashlib.sha256(json.dumps([asdict(r) for r in rules], ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def hit(rule: Rule, text: Column, activation: Column, lead: Column) -> Column:
    """``lead``: null for what is no bullet, empty for a bullet without a lead."""
    seen = activation if rule.scope == "activation" else text
    out = seen.rlike(rule.pattern)
    if rule.exclude:
        out = out & ~text.rlike(rule.exclude)
    if rule.lead:
        out = out & (lead.isNull() | lead.rlike(rule.lead))
    return F.coalesce(out, F.lit(False))


def rule_hits(text: Column, activation: Column, lead: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Ids of the active rules that a clause meets."""
    return F.array_compact(F.array(*(F.when(hit(r, text, activation, lead), r.id) for r in active(rules)))) if active(rules) else F.array().cast("array<string>")


def covered(df: DataFrame, hits: str = "hits") -> DataFrame:
    """rule, n: how many clauses each rule meets."""
    return df.select(F.explode(hits).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def predict(df: DataFrame, rules: Sequence[Rule] = RULES, least: int = MIN_COVERAGE, hits: str = "hits", over: DataFrame | None = None) -> DataFrame:
    """``df`` with ``predicted``: the kind that all met rules of enough coverage agree on; null where there is none or they differ.

    Coverage is a count over all clauses (``over``, where these are to be read without their texts); which rules have enough of it is at most one id a rule, so it goes into the plan.
    """
    enough = {r["rule"] for r in covered(df if over is None else over, hits).where(F.col("n") >= least).collect()}
    said = F.array_compact(F.array(*(F.when(F.array_contains(hits, r.id), r.kind) for r in active(rules) if r.id in enough))) if enough else F.array().cast("array<string>")
    said = F.array_distinct(said)
    return df.withColumn("predicted", F.when(F.size(said) == 1, F.get(said, 0)))


def validate(df: DataFrame, rules: Sequence[Rule] = RULES, attested: str = "attested", hits: str = "hits") -> DataFrame:
    """rule, coverage, attested, agree, rate and verdict of each active rule, those that meet nothing included."""
    spark = df.sparkSession
    table = spark.createDataFrame([(r.id, r.kind) for r in active(rules)], "rule string, kind string")
    each = df.select(F.explode(hits).alias("rule"), F.col(attested).alias("given")).join(F.broadcast(table), "rule")
    counts = each.groupBy("rule").agg(F.count("*").alias("coverage"), F.count("given").alias("attested"), F.count_if(F.col("given") == F.col("kind")).alias("agree"))
    out = table.join(counts, "rule", "left").na.fill(0, ["coverage", "attested", "agree"])
    rate = F.try_divide(F.col("agree"), F.col("attested"))
    verdict = F.when((F.col("coverage") < MIN_COVERAGE) | (F.col("attested") < MIN_ATTESTED), "insufficient").when(rate >= AGREEMENT, "pass").otherwise("fail")
    return out.select("rule", "kind", "coverage", "attested", "agree", rate.alias("rate"), verdict.alias("verdict"))


def bullet_leads(clauses: DataFrame) -> DataFrame:
    """Clauses (id, section, label, text_ja) with ``lead``: the text of the clause that a bullet belongs to, empty where that is missing, null for others."""
    whole = F.split("label", "-●").getItem(0)
    bullet = F.contains("label", F.lit("-●"))
    leads = clauses.select(F.col("id").alias("_i"), F.col("section").alias("_s"), F.col("label").alias("_l"), F.col("text_ja").alias("_lead"))
    joined = clauses.join(leads, (F.col("id") == F.col("_i")) & (F.col("section") == F.col("_s")) & (whole == F.col("_l")), "left")
    return joined.withColumn("lead", F.when(bullet, F.coalesce("_lead", F.lit("")))).drop("_i", "_s", "_l", "_lead")


def annotate(clauses: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Clauses with activation, hits and predicted."""
    led = bullet_leads(clauses).withColumn("activation", activation_clause(F.col("text_ja")))
    return predict(led.withColumn("hits", rule_hits(F.col("text_ja"), F.col("activation"), F.col("lead"), rules)), rules)


def targets(clauses: DataFrame) -> DataFrame:
    """Clauses that rules may speak of: with an original text, and no preambles."""
    return clauses.where(~F.col("label").rlike(r"\A0(-.*)?\z") & (F.coalesce("text_ja", F.lit("")) != ""))


def stated_digest(document: str) -> str | None:
    """The registry's fingerprint that a generated document states; None where it states none."""
    found = re.search(r"`([0-9a-f]{16,64})`", document)
    return found[1] if found else None
