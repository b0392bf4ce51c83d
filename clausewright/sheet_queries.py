"""Queries over the sheet of clauses: documents stand for entities, their lines for numbered clauses, labels for official texts and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import merge, sheet
from clausewright.queries import query

_NUMERALS_SQL = f"'{T.NUMERALS}'"


def _inputs(t) -> dict[str, DataFrame]:
    """Entities whose lines are numbered by twelve numerals in turn (every seventh begins without one), with the same in capitals E for an original; official texts of good documents, judgments of all labelled ones."""
    docs = t("documents").select(F.col("doc_id").alias("id"), T.lines(F.coalesce("text", F.lit(""))).alias("l"))
    sign = lambda i: F.concat(F.substring(F.lit(T.NUMERALS), i % 12 + 1, F.lit(1)), F.lit("："))
    numbered = F.transform("l", lambda x, i: F.concat(F.when((F.col("id") % 7 == 0) & (i == 0), "").otherwise(sign(i - F.when(F.col("id") % 7 == 0, 1).otherwise(0))), x))
    bodies = docs.select("id", F.array_join(numbered, "\n").alias("body"), (F.size("l") > 1).alias("many"))
    labels = t("labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    main = F.lit("main").alias("section")
    supplement = F.when(F.col("quality") == 1, "『①』は誘発効果です。")
    entities = bodies.select("id", F.lit(0x21).cast("long").alias("type"), "body", F.lit("").alias("name_ja"))
    supplements = bodies.join(labels, "id", "left").select("id", main, F.replace("body", F.lit("e"), F.lit("E")).alias("text_ja"), supplement.alias("supplement"))
    kind = F.when(F.col("toxic") == 1, "c").when(F.col("quality") == 0, "q")
    judgments = labels.select("id", main, F.lit("①").alias("label"), F.lit(1).cast("long").alias("seq"), kind.alias("kind"), F.when(kind == "q", "o").alias("optional"), F.lit(None).cast("string").alias("role"))
    return {"entities": entities, "supplements": supplements, "judgments": judgments}


_SHEET_SQL = f"""l AS (SELECT doc_id AS id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
n AS (SELECT id, i - 1 AS p, l[i] AS x, len(l) AS m, (id % 7 = 0)::INT AS pre FROM l, unnest(range(1, len(l) + 1)) AS t(i)),
c AS (
  SELECT id, CASE WHEN pre = 1 AND m = 1 THEN '1' WHEN pre = 1 AND p = 0 THEN '0' ELSE substr({_NUMERALS_SQL}, ((p - pre) % 12 + 1)::INT, 1) || CASE WHEN p - pre < 12 THEN '' ELSE '-' || ((p - pre) // 12 + 1)::VARCHAR END END AS label,
    replace(CASE WHEN pre = 1 AND p = 0 THEN x ELSE substr({_NUMERALS_SQL}, ((p - pre) % 12 + 1)::INT, 1) || '：' || x END, 'e', 'E') AS text, pre = 1 AND p = 0 AND m > 1 AS head FROM n),
k AS (
  SELECT c.id, label, text, head, quality, toxic, label IN ('①', '1') AND quality = 1 AS official, label = '①' AND (toxic = 1 OR quality = 0) AS told, CASE WHEN toxic = 1 THEN 'c' WHEN quality = 0 THEN 'q' END AS given
  FROM c LEFT JOIN labels ON c.id = doc_id),
r AS (
  SELECT *, coalesce(official AND told AND given <> 't', false) AS conflict,
    CASE WHEN coalesce(told, false) THEN given WHEN coalesce(official, false) THEN 't' WHEN head THEN 'x' END AS kind,
    CASE WHEN coalesce(told, false) THEN 'llm' WHEN coalesce(official, false) THEN 'official' WHEN head THEN 'rule' END AS source FROM k)"""


@query(f"WITH {_SHEET_SQL} SELECT id, label, substr(sha1(text), 1, 16) AS text_hash, kind, CASE WHEN kind = 'q' THEN 'o' END AS optional, source, bool_or(conflict) OVER (PARTITION BY id) AS needs_review FROM r")
def sheet_build(t):
    """The whole build: cut, aligned, attested, judged, with optional values and contagious review."""
    return sheet.build_sheet(**_inputs(t)).clauses.select("id", "label", "text_hash", "kind", "optional", "source", "needs_review")


@query(f"""WITH {_SHEET_SQL}, said AS (
  SELECT id, CASE WHEN official THEN CASE WHEN conflict THEN 'late_official_conflict' ELSE 'judgment_confirmed' END WHEN told THEN NULL ELSE 'judgment_blank' END AS what FROM r WHERE label = '①' AND quality IS NOT NULL
  UNION ALL SELECT id, 'optional_pending' FROM r WHERE kind = 't'
  UNION ALL SELECT id, 'pending_split' FROM r WHERE label = '1'
  UNION ALL SELECT doc_id, 'judgment_orphans' FROM labels WHERE doc_id NOT IN (SELECT id FROM r WHERE label = '①'))
SELECT what AS "check", count(*) AS n FROM said WHERE what IS NOT NULL GROUP BY what""")
def sheet_report(t):
    """What a build notices, counted."""
    return sheet.build_sheet(**_inputs(t)).report.groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id FROM documents WHERE contains(text, 'ing') UNION SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents)")
def sheet_touched(t):
    """Entities that a later run makes anew: a word of the text or a judgment is another than in the run before."""
    now = _inputs(t)
    before = now | {"entities": now["entities"].withColumn("body", F.replace("body", F.lit("ing"), F.lit("ung"))), "judgments": now["judgments"].withColumn("kind", F.when(F.col("kind") == "c", "i").otherwise(F.col("kind")))}
    return sheet.changed(sheet.fingerprints(**now), sheet.fingerprints(**before))


_LADDER = "['q', 't', 'sn', 'c', NULL][p_partkey % 5 + 1]"
_LADDER_SQL = f"""p AS (
  SELECT p_partkey AS id, {_LADDER} AS kind, p_partkey % 4 = 0 AS must, CASE WHEN p_partkey % 3 = 0 THEN 'o' END AS told, p_partkey % 7 = 0 AS unsplit,
    CASE WHEN p_partkey % 6 = 1 THEN 'no_text' WHEN p_partkey % 6 = 2 THEN 'no_activation' WHEN p_partkey % 6 < 5 THEN 'o' ELSE 'm' END AS said FROM part),
q AS (SELECT *, CASE WHEN NOT unsplit AND said IN ('o', 'm') THEN said END AS ruled, CASE WHEN unsplit THEN 'unsplit' WHEN said NOT IN ('o', 'm') THEN said END AS reason, coalesce(kind IN ('q', 't'), false) AS act, coalesce(kind = 'sn', false) AS carry FROM p),
o AS (SELECT *, CASE WHEN act OR carry THEN CASE WHEN must THEN 'm' ELSE coalesce(told, CASE WHEN act THEN ruled END) END END AS optional FROM q)"""


def _ladder(t) -> DataFrame:
    """Parts as clauses of kinds by turns, some with an official flag, a judged value, a text that the rule reads, or none."""
    k = F.col("p_partkey")
    text = F.element_at(F.array(*map(F.lit, ("①：発動できる。", "", "①：強い。", "①：発動できる。", "①：捨てる事で発動する。", "①：この効果は発動する。"))), (k % 6 + 1).cast("int"))
    kind = F.get(F.array(*map(F.lit, ("q", "t", "sn", "c", None))), (k % 5).cast("int"))
    rows = t("part").select(k.alias("id"), kind.alias("kind"), text.alias("text_ja"), (k % 7 == 0).alias("unsplit"), (k % 4 == 0).alias("mandatory"), F.when(k % 3 == 0, "o").alias("judged_optional"))
    return merge.optionals(rows)


@query(f"""WITH {_LADDER_SQL} SELECT id, kind, optional, CASE WHEN act OR carry THEN CASE WHEN must THEN 'official' WHEN told IS NOT NULL THEN 'llm' WHEN act AND ruled IS NOT NULL THEN 'rule' END END AS optional_by,
  CASE WHEN act AND optional IS NULL THEN reason END AS pending,
  concat_ws(',', CASE WHEN NOT act AND NOT carry AND must THEN CASE WHEN kind IS NULL THEN 'mandatory_kind_unknown' ELSE 'mandatory_other_kind' END END, CASE WHEN NOT act AND NOT carry AND told IS NOT NULL THEN 'judgment_optional_dropped' END) AS dropped FROM o""")
def optional_ladder(t):
    """Optional values by official text, judgment and rule, with why there is none."""
    return _ladder(t).select("id", "kind", "optional", "optional_by", "pending", F.array_join("dropped", ",").alias("dropped"))


@query(f"""WITH {_LADDER_SQL} SELECT count(*) FILTER (must) AS attested, count(*) FILTER (must AND ruled IS NOT NULL) AS predicted, count(*) FILTER (must AND ruled = 'm') AS agree, count(*) FILTER (must AND ruled = 'o') AS disagree,
  count(*) FILTER (must AND reason = 'unsplit') AS unsplit, count(*) FILTER (must AND reason = 'no_text') AS no_text, count(*) FILTER (must AND reason = 'no_activation') AS no_activation FROM o""")
def optional_validation(t):
    """How far the rule reaches the values that official texts give."""
    return merge.optional_tally(_ladder(t))


_JUDGED_SQL = """j AS (SELECT l_orderkey AS id, arg_max({'k': CASE l_returnflag WHEN 'A' THEN 't' WHEN 'R' THEN 'q' END, 'o': CASE WHEN l_linestatus = 'F' THEN 'm' END}, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey) AS j FROM lineitem GROUP BY l_orderkey),
c AS (SELECT o_orderkey AS id, ['t', 'x', NULL][o_orderkey % 3 + 1] AS kind, ['official', 'rule', NULL][o_orderkey % 3 + 1] AS source FROM orders),
b AS (SELECT c.id, kind, source, j IS NOT NULL AS here, j.k AS given, j.o AS opt FROM c LEFT JOIN j ON c.id = j.id),
d AS (SELECT *, CASE WHEN NOT here THEN NULL WHEN source = 'official' THEN CASE WHEN given IS NOT NULL AND given <> kind THEN 'late_official_conflict' ELSE 'judgment_confirmed' END
  WHEN kind IS NOT NULL THEN CASE WHEN given IS DISTINCT FROM kind THEN 'judgment_vs_rule' END WHEN given IS NULL THEN 'judgment_blank' ELSE 'judged' END AS judgment FROM b)"""


@query(f"""WITH {_JUDGED_SQL} SELECT id, judgment, CASE WHEN judgment IN ('judged', 'late_official_conflict') THEN given ELSE kind END AS kind, CASE WHEN judgment IN ('judged', 'late_official_conflict') THEN 'llm' ELSE source END AS source,
  coalesce(judgment = 'late_official_conflict', false) AS needs_review, CASE WHEN judgment IN ('judged', 'late_official_conflict', 'judgment_confirmed') THEN opt END AS judged_optional FROM d""")
def judgment_outcomes(t):
    """Judgments (the last line of an order, by number, part and supplier) on official kinds, kinds by rule, and clauses without one."""
    key = [F.lit("main").alias("section"), F.lit("1").alias("label")]
    at = lambda *values: F.get(F.array(*map(F.lit, values)), (F.col("o_orderkey") % 3).cast("int"))
    clauses = t("orders").select(F.col("o_orderkey").alias("id"), *key, at("t", "x", None).alias("kind"), F.lit(None).cast("string").alias("role"), at("official", "rule", None).alias("source"), F.lit(False).alias("needs_review"))
    kind = F.when(F.col("l_returnflag") == "A", "t").when(F.col("l_returnflag") == "R", "q")
    given = t("lineitem").select(F.col("l_orderkey").alias("id"), *key, (F.col("l_linenumber") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("seq"), kind.alias("kind"), F.when(F.col("l_linestatus") == "F", "m").alias("optional"), F.lit(None).cast("string").alias("role"))
    return merge.judged(clauses, given).select("id", "judgment", "kind", "source", "needs_review", "judged_optional")
