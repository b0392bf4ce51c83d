"""Queries over whole indexes and whole versions: censuses, all checks in one pass, planted faults, differences by digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewright.functions import vocab as V
from clausewright.operators import census, checks, entities, joins, versions
from clausewright.queries import _RAW_SQL, _cards, _clauses, _index, _long, query

_MEMBERS_SQL = ", ".join(f"('{name}', {'NULL' if code is None else repr(code)})" for name, d in V.DOMAINS.items() for code in [*(m.code for m in d.members), None])
_MARKERS_SQL = ", ".join(f"CASE WHEN def & {m.value} <> 0 THEN '{m.code}' END" for m in V.LINK_MARKER.members)
_LINES_SQL = "lines AS (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS pos, l_linenumber::VARCHAR AS label, map {'A': 't', 'R': 'q', 'N': 'c'}[l_returnflag] AS kind, CASE WHEN l_returnflag IN ('A', 'R') THEN CASE WHEN l_linestatus = 'F' THEN 'm' ELSE 'o' END END AS opt, CASE WHEN l_linenumber = 1 THEN 'mat' END AS role FROM lineitem)"


@query(f"""WITH {_RAW_SQL} {_LINES_SQL}, members(domain, code) AS (VALUES {_MEMBERS_SQL}),
pairs AS (
  SELECT 'cat' AS domain, ['m', 'm', 'm', 's', 't'][t + 1] AS code FROM ent UNION ALL SELECT 'attr', CASE WHEN t < 3 THEN attr END FROM ent UNION ALL SELECT 'race', CASE WHEN t < 3 THEN race END FROM ent
  UNION ALL SELECT 'rarity', ['N', 'R', 'SR', 'UR'][id % 4 + 1] FROM ent UNION ALL SELECT 'ot', ['o', 't', 'b'][ot] FROM ent
  UNION ALL SELECT 'ban_o', CASE WHEN id % 10 = 0 THEN 'f' END FROM ent UNION ALL SELECT 'ban_t', CASE WHEN id % 15 = 0 THEN 'l' END FROM ent UNION ALL SELECT 'ban_m', NULL FROM ent
  UNION ALL SELECT 'lm', unnest(CASE WHEN t = 1 AND len(list_filter([{_MARKERS_SQL}], lambda x: x IS NOT NULL)) > 0 THEN list_filter([{_MARKERS_SQL}], lambda x: x IS NOT NULL) ELSE [NULL] END) FROM ent
  UNION ALL SELECT ['sub_m', 'sub_m', 'sub_m', 'sub_s', 'sub_t'][t + 1], unnest([['effect'], ['effect', 'link'], ['effect', 'fusion', 'pendulum'], ['quick'], ['counter']][t + 1]) FROM ent
  UNION ALL SELECT d, c FROM lines JOIN ent USING (id), LATERAL (VALUES ('kind', kind), ('optional', lines.opt), ('role', role)) v(d, c))
SELECT m.domain, m.code, count(p.domain) AS n FROM members m LEFT JOIN pairs p ON m.domain = p.domain AND m.code IS NOT DISTINCT FROM p.code GROUP BY m.domain, m.code""")
def census_domains(t):
    """All fifteen domains in one pass over the index, members that nothing has and what has no value included."""
    return census.index_census(_index(t))


_PLANTED_SQL = """faults AS (
  SELECT 'not_exported' AS "check", id, 'rarity:ZZ' AS detail FROM ent WHERE id % 7 = 0
  UNION ALL SELECT 'not_exported', id, 'ban_t:gone' FROM ent WHERE id % 11 = 0)"""


def _planted(t):
    """The stand-in index with codes that are no buttons on some rows."""
    k = F.col("id")
    return _index(t).withColumns({"rarity": F.when(k % 7 == 0, "ZZ").otherwise(F.col("rarity")), "ban_t": F.when(k % 11 == 0, "gone").otherwise(F.col("ban_t"))})


@query(f'WITH {_RAW_SQL} {_PLANTED_SQL} SELECT "check", id, detail FROM faults')
def planted_codes(t):
    """Codes that are no buttons, on rows that have some."""
    return checks.unexported(_planted(t))


@query(f"""WITH {_RAW_SQL} {_LINES_SQL}, {_PLANTED_SQL}, cards AS (SELECT id FROM ent UNION ALL SELECT id FROM ent WHERE id % 14 = 0), told AS (
  SELECT "check" FROM faults WHERE id % 9 <> 0
  UNION ALL SELECT 'unknown_race' FROM ent WHERE t < 3 AND id % 16 = 0
  UNION ALL SELECT 'monster_without_parameters' FROM ent WHERE t < 3 AND id % 12 = 0 AND id % 16 <> 0
  UNION ALL SELECT 'missing_from_index' FROM cards WHERE id % 9 = 0
  UNION ALL SELECT 'without_clause_entry' FROM cards WHERE id NOT IN (SELECT id FROM lines WHERE id % 10 <> 0)
  UNION ALL SELECT 'duplicate_id' FROM ent WHERE id % 14 = 0
  UNION ALL SELECT 'clause_without_kind' FROM lines JOIN ent USING (id) WHERE id % 9 <> 0 AND kind = 'c' AND pos % 5 = 0)
SELECT "check", count(*) AS n FROM told GROUP BY "check" """)
def index_checks(t):
    """All checks of an index, counted: cards, index and clauses are read once each. Faults are planted in all three."""
    k = F.col("id")
    plain = _cards(t).select("id", "type", "race", "attribute", "level", "atk", "def")
    broken = plain.withColumns({"race": F.when((k % 16 == 0) & (F.col("type").bitwiseAND(1) != 0), F.lit(1).cast("long") * (1 << 40)).when((k % 12 == 0) & (F.col("type").bitwiseAND(1) != 0), F.lit(0).cast("long")).otherwise(F.col("race"))})
    cards = broken.unionByName(broken.where(k % 14 == 0).withColumn("race", F.when(F.col("type").bitwiseAND(1) != 0, F.lit(1).cast("long"))))
    lines = _clauses(t).withColumns({"kind": F.when((F.col("kind") == "c") & (F.col("pos") % 5 == 0), None).otherwise(F.col("kind")), "text": F.lit("")})
    index = entities.index_rows(_cards(t), lines).withColumns({"rarity": F.when(k % 7 == 0, "ZZ").otherwise(F.col("rarity")), "ban_t": F.when(k % 11 == 0, "gone").otherwise(F.col("ban_t")), "body": F.lit(""), "alias": F.lit(None).cast("string")})
    found = checks.index_problems(cards, index.where(k % 9 != 0), _clauses(t).where(k % 10 != 0).select("id"))
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def unmatched_rows(t):
    """Customers that no large order has used."""
    return joins.unmatched(t("customer"), "c_custkey", t("orders").where("o_totalprice > 400000"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey IN (c_custkey, c_custkey + 1) AND o_totalprice > 400000)")
def uncovered_entities(t):
    """Neither the id nor an alternate one has a large order."""
    rows = t("customer").select("c_custkey", F.array(F.col("c_custkey") + 1).alias("others"))
    return joins.not_covered(rows, "c_custkey", "others", t("orders").where("o_totalprice > 400000"), "o_custkey").select("c_custkey")


@query("""SELECT o_orderkey, o_orderstatus, side FROM (
  SELECT o_orderkey, o_orderstatus, 'a' AS side FROM orders WHERE o_orderkey % 1000 IN (1, 2)
  UNION ALL SELECT o_orderkey, 'X', 'b' FROM orders WHERE o_orderkey % 1000 = 1 UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, 'b' FROM orders WHERE o_orderkey % 1000 = 3)""")
def version_rows(t):
    """Rows in which two versions differ: some changed, some gone, some new; only the buckets of such keys are joined."""
    k = F.col("o_orderkey")
    old = t("orders").select(_long("o_orderkey").alias("o_orderkey"), "o_orderstatus")
    new = old.where(k % 1000 != 2).withColumn("o_orderstatus", F.when(k % 1000 == 1, "X").otherwise(F.col("o_orderstatus"))).unionByName(old.where(k % 1000 == 3).withColumn("o_orderkey", k + 100_000_000))
    return versions.differing(old, new, ["o_orderkey"])
