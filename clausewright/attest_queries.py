"""Queries of statements, cuts and diffs over stand-in texts: parts with a clause for their name, type and brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import attest, clauses, joins, splits
from clausewright.queries import _long, query

_K = "p_partkey"


def _pick(k: Column, *values) -> Column:
    """One of the values by turns."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


@query(r"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS digest, length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS n FROM documents")
def texts_without_blanks(t):
    """Texts as they are compared, blanks aside."""
    bare = T.without_blanks(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", F.md5(bare).alias("digest"), F.length(bare).cast("long").alias("n"))


@query("""WITH l AS (SELECT doc_id AS id, i - 1 AS pos, l[i] AS line, i % 3 = 1 AS head FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)),
s AS (SELECT *, last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS heading FROM l)
SELECT id, count(*) AS n, md5(string_agg(heading || '>' || line, '|' ORDER BY pos)) AS digest FROM s WHERE NOT head GROUP BY id""")
def statement_lines(t):
    """Lines of official texts under their headings: every third line of a document is one."""
    rows = t("documents").select(F.col("doc_id").alias("id"), F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))
    marked = rows.withColumn("line", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("【"), "line", F.lit("】"))).otherwise(F.col("line")))
    said = marked.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("supplement"))
    found = attest.statements(said.select("id", F.lit("main").alias("section"), F.lit("").alias("name_ja"), "supplement"))
    one = F.array_sort(F.collect_list(F.struct("pos", F.concat("heading", F.lit(">"), "line").alias("x"))))
    return found.groupBy("id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(one, lambda r: r["x"]), "|")).alias("digest"))


_STATED = ("『①』は誘発効果です。", "『①』は誘発即時効果です。必ず発動する効果です。", "永続効果ではありません。", "起動効果です。誘発効果です。", "必ず発動する効果です。", "分類されない効果です。", "速攻魔法カードの効果として扱います。", "何でもない。")


@query(f"SELECT {_K} AS id, ['t', 'q', NULL, 'i,t', '', 'u', 'sq', ''][{_K} % 8 + 1] AS kinds, {_K} % 8 IN (1, 4) AS mandatory FROM part WHERE {_K} % 8 <> 2")
def stated_kinds(t):
    """Kinds that a line states and whether it says that the player must."""
    k = F.col(_K)
    line = _pick(k, *_STATED)
    return t("part").where(k % 8 != 2).select(k.alias("id"), F.array_join(F.array_sort(attest.stated_kinds(line)), ",").alias("kinds"), attest.states_mandatory(line).alias("mandatory"))


def _said(t) -> tuple[DataFrame, DataFrame]:
    """(supplements, clauses): three numbered clauses a part, and statements by turns."""
    k = F.col(_K)
    text = lambda n, c: F.struct(F.lit(n).alias("pos"), F.lit("①②③"[n]).alias("label"), F.concat(F.lit("①②③"[n] + "："), c).alias("text_ja"))
    rows = t("part").select(k.alias("id"), F.lit("main").alias("section"), F.explode(F.array(text(0, F.col("p_name")), text(1, F.concat("p_type", F.lit("!!"))), text(2, F.concat("p_brand", F.lit("??"))))).alias("c"))
    said = _pick(k, "『①』は誘発効果です。", F.concat(F.lit("『"), "p_type", F.lit("!!』は起動効果です。")), "永続効果です。", "『②』は必ず発動する効果です。", "『①』は誘発効果です。\n『①』は起動効果です。", "『④』は誘発効果です。")
    supplements = t("part").select(k.alias("id"), F.lit("main").alias("section"), F.lit("自分").alias("name_ja"), said.alias("supplement"))
    return supplements, rows.select("id", "section", "c.*", F.lit(False).alias("unsplit"))


@query(f"SELECT {_K} AS id, ['①', '②', NULL, '②'][{_K} % 6 + 1] AS label, ['t', 'i', NULL, NULL][{_K} % 6 + 1] AS kind, ['seq', 'quote', NULL, 'seq'][{_K} % 6 + 1] AS ladder, {_K} % 6 = 3 AS mandatory FROM part WHERE {_K} % 6 IN (0, 1, 3)")
def attested_clauses(t):
    """What official statements assign: by a number, by a quote, or the flag alone."""
    return attest.attest(*_said(t))[0].select("id", "label", "kind", "ladder", "mandatory")


@query(f"SELECT {_K} AS id, ['', '', 'attribution_deferred', '', 'kind_conflicts', 'seq_missing'][{_K} % 6 + 1] AS note FROM part WHERE {_K} % 6 IN (2, 4, 5)")
def attestation_notes(t):
    """What cannot be attributed, and kinds that contradict each other: noted, never guessed."""
    return attest.attest(*_said(t))[1].select("id", "note")


_UNITS = ("此卡不能通常召喚。", "1回合只能使用1次。", "藉由儀式降臨。", "只是說明。")


@query(f"SELECT {_K} AS id, ['cond', 'limit', 'mat', 'cond'][{_K} % 4 + 1] AS first, ['limit', 'mat'][{_K} % 4 + 1] AS second, [2, 2, 1, 1][{_K} % 4 + 1]::BIGINT AS n FROM part")
def preamble_cuts(t):
    """Preambles of two sentences in both languages, cut where their roles differ; a sentence without a role stays with the one beside it."""
    k = F.col(_K)
    zh = F.concat(_pick(k, *_UNITS), _pick(k + 1, *_UNITS))
    texts = t("part").select(k.alias("id"), F.lit("main").alias("section"), F.lit(0x21).cast("long").alias("type"), zh.alias("text_zh"), F.concat("p_name", F.lit("。"), "p_type", F.lit("。")).alias("text_ja"), F.lit(None).cast("string").alias("supplement"))
    held = clauses.preambles(texts).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "role"))).alias("r"), F.count("*").alias("n"))
    return held.select("id", F.get("r", 0)["role"].alias("first"), F.get("r", 1)["role"].alias("second"), "n")


@query(f"SELECT {_K} AS id, string_agg(label, ',' ORDER BY label) AS labels, [NULL, NULL, 'bullet_split_mismatch'][{_K} % 3 + 1] AS problem FROM (SELECT {_K}, unnest([['①', '①-●1', '①-●2'], ['①'], ['①']][{_K} % 3 + 1]) AS label FROM part) GROUP BY {_K}")
def bullet_clauses(t):
    """Bullets as clauses of their own where official text speaks of them; whole where it does not, and where the languages do not have as many."""
    k = F.col(_K)
    zh = F.concat(F.lit("①：選。●"), "p_name", F.lit("●"), "p_type")
    ja = F.when(k % 3 == 2, F.concat(F.lit("①：選ぶ。●"), "p_name")).otherwise(F.concat(F.lit("①：選ぶ。●"), "p_name", F.lit("●"), "p_type"))
    rows = t("part").select(k.alias("id"), F.lit("main").alias("section"), F.lit("①").alias("label"), zh.alias("text_zh"), ja.alias("text_ja"))
    said = t("part").select(k.alias("id"), F.lit("main").alias("section"), F.lit("x").alias("name_ja"), F.when(k % 3 != 1, "【『●』の効果について】\n永続効果です。").otherwise("").alias("supplement"))
    said = said.withColumn("supplement", F.replace("supplement", F.lit("『●』の"), F.lit("●の")))
    cut, problems = clauses.split_bullets(rows, said)
    held = cut.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))
    return held.join(problems.select("id", "problem"), "id", "left").select("id", "labels", "problem")


@query("""SELECT c_custkey, old, new, CASE WHEN c_custkey % 4 = 0 THEN true ELSE false END AS same_entity FROM (
  SELECT c_custkey, c_custkey * 10 AS old, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 10 + 1 WHEN c_custkey % 4 = 1 THEN c_custkey * 10 + 20 ELSE -c_custkey END AS new FROM customer WHERE c_custkey % 4 < 3)""")
def benign_mapping(t):
    """A mapping whose changes stay with their entity, go to another, or to an id that nothing has."""
    k = F.col("c_custkey")
    old = t("customer").select(k, (k * 10).alias("v"))
    new = t("customer").select(k, F.when(k % 4 == 0, k * 10 + 1).when(k % 4 == 1, k * 10 + 20).when(k % 4 == 2, -k).otherwise(k * 10).alias("v"))
    held = t("customer").select((k * 10).alias("id"), F.array(k * 10 + 1).alias("alt_ids"))
    return joins.benign_changes(joins.mapping_diff(old, new, "c_custkey", "v"), held).select("c_custkey", "old", "new", "same_entity")


@query("SELECT doc_id AS id, ['record', 'not_open', 'no_reason', 'skipped'][doc_id % 4 + 1] AS outcome FROM documents")
def split_results(t):
    """Judgment results as split records, or why they give none."""
    k = F.col("doc_id")
    part = lambda zh: F.array(F.struct(F.lit("1").alias("label"), zh.alias("text_zh"), F.lit("").alias("text_ja")))
    none = F.array().cast("array<struct<label:string,text_zh:string,text_ja:string>>")
    results = t("documents").select(_long(k).alias("id"), F.lit("main").alias("section"), F.lit(True).alias("split"), F.when(k % 4 == 3, "unclear").alias("note"), F.when(k % 4 < 2, part(F.coalesce("text", F.lit("")))).otherwise(none).alias("clauses"), F.lit(None).cast("array<int>").alias("ja_order"))
    blobs = t("documents").where(k % 4 != 1).select(_long(k).alias("id"), F.lit("main").alias("section"), F.col("text").alias("text_zh"), F.lit("").alias("text_ja"))
    records, rest = splits.records_of_judgments(results, blobs, "t1")
    return records.select("id", F.lit("record").alias("outcome")).unionByName(rest.select("id", F.col("reason").alias("outcome")))
