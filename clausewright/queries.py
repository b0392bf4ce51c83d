"""Queries over the test tables, one for each operator of the catalog search, with their SQL for DuckDB.

Orders with their line items stand for entities with clauses, as do conversations with their turns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import predicates as P
from clausewright.functions import text as T
from clausewright.functions.vocab import Domain, Member
from clausewright.operators import batches, census, checks, entities, joins, merge, rules, sampling, splits
from clausewright.plans import index as stored
from clausewright.plans import order
from clausewright.plans import query as search
from clausewright.sources import pages as page_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query of a function that gives a table by its name, with its SQL."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(partial(_table, spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# Clause coupling


def _coupled(c: Column) -> Column:
    return P.tri_hit(c["flag"], {"A": 1}) & P.range_hit(c["qty"], 11, None) & P.range_hit(c["disc"], 0.02, 0.06)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A' AND l_quantity >= 11 AND l_discount BETWEEN 0.02 AND 0.06)")
def coupled_hits(t):
    """All conditions on one line: the lines are filtered in their scan and meet the orders in a semi join."""
    c = {"flag": F.col("l_returnflag"), "qty": F.col("l_quantity"), "disc": F.col("l_discount")}
    return t("orders").join(t("lineitem").where(_coupled(c)), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def uncoupled_contrast(t):
    """The same order may meet the conditions on different lines; lines that meet neither stay in their scan."""
    lines = t("lineitem").where((F.col("l_returnflag") == "A") | (F.col("l_quantity") > 45)).groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_quantity") > 45).alias("b"))
    return t("orders").join(lines.where("a AND b"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS matched FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' AND l_quantity >= 11 AND l_discount BETWEEN 0.02 AND 0.06 GROUP BY o_orderkey")
def coupled_rows(t):
    """With the places of the lines that match: the lines are filtered in their scan, so only places of hits move."""
    c = {"flag": F.col("l_returnflag"), "qty": F.col("l_quantity"), "disc": F.col("l_discount")}
    hits = t("lineitem").where(_coupled(c)).groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("at"))
    found = t("orders").select("o_orderkey").join(hits, F.col("o_orderkey") == F.col("l_orderkey"))
    return found.select("o_orderkey", F.array_join(F.array_sort("at"), ",").alias("matched"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')")
def clause_exclude(t):
    """Exclusion at clause level: some line is not R."""
    return t("orders").join(t("lineitem").where(P.tri_hit(F.col("l_returnflag"), {"R": -1})), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query(
    """SELECT conv_id, count(*) AS n FROM conversations WHERE text LIKE '%the%' AND role <> 'system' GROUP BY conv_id"""
)
def role_skip_keyword(t):
    """A keyword that passes over clauses of one role."""
    hit = P.like_match(F.col("text"), ["the"]) & ~F.coalesce(F.col("role") == "system", F.lit(False))
    return t("conversations").where(hit).groupBy("conv_id").agg(F.count("*").alias("n"))


_OWN = [("click", 0), ("view", 1), ("purchase", 2)]


@query(
    """SELECT event_type, count(DISTINCT user_id) AS n FROM events
    WHERE NOT ((event_type = 'click' AND user_id % 5 = 0) OR (event_type = 'view' AND user_id % 5 = 1) OR (event_type = 'purchase' AND user_id % 5 = 2)) GROUP BY event_type"""
)
def own_type_suppressed(t):
    """A value is hidden where it is the entity's own type."""
    side = F.pmod(F.col("user_id"), F.lit(5)).cast("string")
    shown = P.kind_at(F.col("event_type"), F.lit("u"), F.array(side), [(k, "u", str(s)) for k, s in _OWN])
    return t("events").withColumn("event_type", shown).where("event_type IS NOT NULL").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))


@query(
    """SELECT code, count(*) AS n FROM (
      SELECT CASE WHEN value >= 10 THEN 'hi' ELSE 'lo' END AS code FROM events UNION ALL
      SELECT 'c-hi' FROM events WHERE event_type = 'click' AND value >= 10 UNION ALL
      SELECT 'v-lo' FROM events WHERE event_type = 'view' AND NOT value >= 10) GROUP BY code"""
)
def combo_kind_value(t):
    """Values and combinations of kind and value."""
    codes = P.optional_at(F.col("event_type"), F.when(F.col("value") >= 10, "hi").otherwise("lo"), [("c-hi", "click", "hi", ""), ("v-lo", "view", "lo", "")])
    return t("events").select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# Entity predicates


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
def tri_include(t):
    return t("part").where(P.tri_hit(F.col("p_brand"), {"Brand#11": 1, "Brand#22": 1, "Brand#33": 1})).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE nullif(p_brand, 'Brand#12') IS NULL OR p_brand NOT IN ('Brand#11', 'Brand#22')")
def tri_exclude(t):
    """With exclusions alone rows without a value pass."""
    return t("part").where(P.tri_hit(F.nullif("p_brand", F.lit("Brand#12")), {"Brand#11": -1, "Brand#22": -1})).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22') AND p_brand <> 'Brand#22'")
def tri_exclude_wins(t):
    return t("part").where(P.tri_hit(F.col("p_brand"), {"Brand#11": 1, "Brand#22": -1})).select("p_partkey")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderstatus = 'P')")
def tri_array(t):
    held = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return held.where(P.tri_hit(F.col("s"), {"F": 1, "P": -1}, True)).select("o_custkey")


_SIZE = "nullif(p_size, (p_size // 10) * 10)"


@query(f"SELECT p_partkey FROM part WHERE {_SIZE} >= 25")
def range_one_side(t):
    return t("part").where(P.range_hit(F.expr("nullif(p_size, (p_size DIV 10) * 10)"), 25, None)).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE {_SIZE} BETWEEN 11 AND 29")
def range_both(t):
    return t("part").where(P.range_hit(F.expr("nullif(p_size, (p_size DIV 10) * 10)"), 11, 29)).select("p_partkey")


def _stat() -> Column:
    return F.when(F.col("p_partkey") % 50 == 0, -2).when(F.col("p_partkey") % 7 == 0, None).otherwise(F.col("p_size"))


_STAT = "CASE WHEN p_partkey % 50 = 0 THEN -2 WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END"


@query(f"SELECT p_partkey FROM part WHERE {_STAT} < 0")
def unknown_only(t):
    return t("part").where(P.unknown_hit(_stat(), 1)).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE {_STAT} IS NULL OR {_STAT} >= 0")
def unknown_not(t):
    return t("part").where(P.unknown_hit(_stat(), -1)).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%'")
def name_wildcard(t):
    return t("part").where(P.like_match(F.col("p_name"), P.like_parts("a%e"))).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a%'")
def name_ci(t):
    return t("part").where(P.name_hit({"en": F.col("p_name")}, None, " A% ", "en")).select("p_partkey")


@query(
    """SELECT p_partkey, (strpos(p_name, 'a') - 1)::INT AS s1, (strpos(p_name, 'a'))::INT AS e1,
    (strpos(p_name, 'a') + strpos(substr(p_name, strpos(p_name, 'a') + 1), 'e') - 1)::INT AS s2, (strpos(p_name, 'a') + strpos(substr(p_name, strpos(p_name, 'a') + 1), 'e'))::INT AS e2
    FROM part WHERE p_name LIKE '%a%e%'"""
)
def match_ranges(t):
    """Leftmost places of the parts of a keyword."""
    found = t("part").select("p_partkey", P.like_ranges(F.col("p_name"), ["a", "e"]).alias("r")).where(F.size("r") > 0)
    return found.select("p_partkey", *(F.col("r")[i][f].alias(f"{f[0]}{i + 1}") for i in (0, 1) for f in ("start", "end")))


@query("SELECT p_partkey FROM part WHERE p_partkey = 17 OR p_partkey + 1 = 17")
def id_exact_alt(t):
    return t("part").where(P.id_hit(F.col("p_partkey"), F.array(F.col("p_partkey") + 1), "17")).select("p_partkey")


# Order and pages

_PRIORITY = Domain("priority", "text", tuple(Member(c, c) for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")))
_PRIORITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 4 END"


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_PRIORITY_SQL}, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey)::BIGINT AS rank FROM orders")
def domain_order(t):
    """Ranks in declaration order, undeclared members last."""
    status = Domain("status", "text", (Member("P", "P"), Member("O", "O")))
    rows = t("orders").select("o_orderkey", _PRIORITY.rank(F.col("o_orderpriority")).alias("a"), status.rank(F.col("o_orderstatus")).alias("b"))
    return order.ranked(rows, F.col("a"), F.col("b"), F.col("o_orderkey")).select("o_orderkey", _long("rank").alias("rank"))


_BITS = Domain("bits", "bitmask", (Member("one", "1", 1), Member("four", "4", 4), Member("two", "2", 2), Member("none", "-")), fallback="none")


@query("SELECT p_partkey, (CASE WHEN p_size & 2 <> 0 THEN 2 WHEN p_size & 4 <> 0 THEN 1 WHEN p_size & 1 <> 0 THEN 0 ELSE 3 END)::INT AS frame FROM part")
def frame_last_member(t):
    """The last declared member that a row has; rows with none come last."""
    return t("part").select("p_partkey", _BITS.last_rank(_BITS.codes_of(_long("p_size")), ("one", "four", "two")).cast("int").alias("frame"))


def _sorted(t, direction: str) -> DataFrame:
    rows = t("part").select("p_partkey", order.known(_stat()).alias("v"))
    by = F.col("v").desc_nulls_last() if direction == "desc" else F.col("v").asc_nulls_last()
    return order.ranked(rows, by, F.col("p_partkey")).select("p_partkey", _long("rank").alias("rank"))


_SORT_SQL = f"SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN {_STAT} >= 0 THEN {_STAT} END {{}} NULLS LAST, p_partkey)::BIGINT AS rank FROM part"


@query(_SORT_SQL.format("ASC"))
def sort_nulls_last_asc(t):
    return _sorted(t, "asc")


@query(_SORT_SQL.format("DESC"))
def sort_nulls_last_desc(t):
    return _sorted(t, "desc")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def page_slice(t):
    """The third page of 50, sought in a sort of all orders."""
    held = order.Sorted.of(t("orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))
    return held.page(3, 50)


@query("SELECT p_partkey, ceil(row_number() OVER (ORDER BY p_retailprice, p_partkey) / 300)::BIGINT AS batch FROM part")
def fixed_batches(t):
    return batches.numbered_batches(t("part").select("p_partkey", "p_retailprice"), 300, F.col("p_retailprice"), F.col("p_partkey")).select("p_partkey", "batch")


# Decoding


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size & 1 <> 0 THEN 'one' END, CASE WHEN p_size & 4 <> 0 THEN 'four' END, CASE WHEN p_size & 2 <> 0 THEN 'two' END], lambda x: x IS NOT NULL), ',') AS codes FROM part WHERE p_size & 7 <> 0")
def bitmask_decode(t):
    return t("part").where("p_size & 7 <> 0").select("p_partkey", F.array_join(_BITS.codes_of(_long("p_size")), ",").alias("codes"))


@query("SELECT count(*) AS n FROM part WHERE p_size & 7 = 0")
def bitmask_fallback(t):
    return t("part").where(F.array_contains(_BITS.codes_of(_long("p_size")), "none")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, (p_size & ~7)::BIGINT AS rest FROM part WHERE p_size & ~7 <> 0")
def unexplained_bits(t):
    return t("part").select("p_partkey", _BITS.unexplained(_long("p_size")).alias("rest")).where("rest <> 0")


@query("SELECT o_orderkey, (o_orderkey & 255)::BIGINT AS low, ((o_orderkey >> 8) & 255)::BIGINT AS high FROM orders")
def packed_decode(t):
    return t("orders").select("o_orderkey", F.col("o_orderkey").bitwiseAND(255).alias("low"), F.shiftright("o_orderkey", 8).bitwiseAND(255).alias("high"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN s_acctbal < 0 THEN 'negative' WHEN s_nationkey % 5 = 0 THEN 'region' END AS reason FROM supplier) WHERE reason IS NOT NULL GROUP BY reason")
def exclusion_reasons(t):
    """The first reason counts."""
    reason = F.when(F.col("s_acctbal") < 0, "negative").when(F.col("s_nationkey") % 5 == 0, "region")
    return t("supplier").select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) < 8 THEN lpad(c_custkey::VARCHAR, 8, '0') ELSE c_custkey::VARCHAR END AS padded, replace(replace(replace(replace(c_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS name FROM customer")
def display_names(t):
    return t("customer").select("c_custkey", T.padded(F.col("c_custkey")).alias("padded"), T.escaped(F.col("c_name")).alias("name"))


# Joins with precedence


@query("SELECT p.p_partkey, coalesce(a.n, b.n)::BIGINT AS found FROM part p LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) a ON a.k = p.p_partkey LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1) b ON b.k = p.p_partkey + 1")
def fallback_key_join(t):
    """By the own key, else by the alternate one."""
    counts = t("lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("found"))
    parts = t("part").select("p_partkey", F.array(F.col("p_partkey") + 1).alias("others"))
    return joins.lookup_with_fallback(parts, "p_partkey", "others", counts, "k", "found").select("p_partkey", "found")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unmatched_source(t):
    return joins.unmatched(t("customer"), "c_custkey", t("orders"), "o_custkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey IN (c_custkey, c_custkey + 1))")
def missing_entities(t):
    """Neither the id nor an alternate one is covered."""
    rows = t("customer").select("c_custkey", F.array(F.col("c_custkey") + 1).alias("others"))
    return joins.not_covered(rows, "c_custkey", "others", t("orders"), "o_custkey").select("c_custkey")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_wins_mapping(t):
    rows = t("events").select("user_id", "event_id", "event_type")
    return joins.one_per_key(rows, ["user_id"], [F.col("event_id")]).select("user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins_mapping(t):
    rows = t("events").select("user_id", "event_id", "event_type")
    return joins.one_per_key(rows, ["user_id"], [F.col("event_id")], last=True).select("user_id", "event_type")


@query("SELECT coalesce(o.k, b.k) AS k, coalesce(o.v, b.v) AS v FROM (SELECT p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 <> 0) b FULL JOIN (SELECT p_partkey AS k, 'own' AS v FROM part WHERE p_partkey % 5 = 0) o ON o.k = b.k")
def override_merge(t):
    base = t("part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))
    over = t("part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("k"), F.lit("own").alias("v"))
    return joins.overridden(base, over, "k", "v")


@query("SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS event_type, arg_max(value, event_id) FILTER (value > 10) AS value FROM events GROUP BY user_id")
def per_field_merge(t):
    """The last value of each field that is set."""
    rows = t("events").select("user_id", "event_id", F.nullif("event_type", F.lit("view")).alias("event_type"), F.when(F.col("value") > 10, F.col("value")).alias("value"))
    return joins.per_field_last(rows, ["user_id"], [F.col("event_id")], ["event_type", "value"])


_ALIAS_ROWS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 OR p_partkey < 4 THEN 0 ELSE p_partkey - 1 END::BIGINT AS up, CASE WHEN p_partkey % 12 = 7 THEN 'x' ELSE (p_partkey // 4)::VARCHAR END AS name FROM part"


@query(
    f"""WITH RECURSIVE r AS ({_ALIAS_ROWS}),
    s AS (SELECT r.id, r.up, r.up <> 0 AND t.id IS NOT NULL AND t.name = r.name AS goes FROM r LEFT JOIN r t ON t.id = r.up),
    walk AS (SELECT id, id AS root FROM s WHERE NOT goes UNION ALL SELECT s.id, walk.root FROM s JOIN walk ON s.up = walk.id WHERE s.goes)
    SELECT root AS id, count(*) FILTER (id <> root) AS merged, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (id <> root), '') AS alts FROM walk GROUP BY root"""
)
def alias_merge(t):
    """Chains of pointers merge into the nearest row that stays."""
    k = F.col("p_partkey")
    rows = t("part").select(k.alias("id"), F.when((k % 4 == 0) | (k < 4), 0).otherwise(k - 1).cast("long").alias("alias"), F.when(k % 12 == 7, "x").otherwise(F.floor(k / 4).cast("string")).alias("name"))
    merged, _ = joins.alias_merge(rows)
    return merged.select("id", _long(F.size("alt_ids")).alias("merged"), F.array_join("alt_ids", ",").alias("alts"))


@query(
    f"""WITH RECURSIVE r AS ({_ALIAS_ROWS})
    SELECT r.id, CASE WHEN t.id IS NULL THEN 'target_missing' ELSE 'name_mismatch' END AS reason FROM r LEFT JOIN r t ON t.id = r.up WHERE r.up <> 0 AND (t.id IS NULL OR t.name <> r.name)"""
)
def alias_exceptions(t):
    k = F.col("p_partkey")
    rows = t("part").select(k.alias("id"), F.when((k % 4 == 0) | (k < 4), 0).otherwise(k - 1).cast("long").alias("alias"), F.when(k % 12 == 7, "x").otherwise(F.floor(k / 4).cast("string")).alias("name"))
    return joins.alias_merge(rows)[1]


# Differences


def _next_part(t) -> DataFrame:
    k = F.col("p_partkey")
    return t("part").where(k % 11 != 0).select(k, F.when(k % 13 == 0, F.lit("new")).otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 17 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'added' ELSE 'changed' END AS change,
    CASE WHEN p_partkey % 10 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN p_partkey % 13 = 0 THEN 'p_brand' END, CASE WHEN p_partkey % 17 = 0 THEN 'p_size' END], lambda x: x IS NOT NULL), ',') END AS fields
    FROM part WHERE p_partkey % 11 <> 0 AND (p_partkey % 10 = 0 OR p_partkey % 13 = 0 OR p_partkey % 17 = 0)"""
)
def snapshot_diff(t):
    old = t("part").where("p_partkey % 10 <> 0").select("p_partkey", "p_brand", "p_size")
    return joins.snapshot_diff(old, _next_part(t), "p_partkey").withColumn("fields", F.array_join("fields", ","))


@query(
    """WITH o AS (SELECT p_partkey AS k, p_brand AS old FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN 'new' ELSE p_brand END AS new FROM part WHERE p_partkey % 11 <> 0)
    SELECT coalesce(o.k, n.k) AS p_partkey, old, new, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR old <> new"""
)
def mapping_diff(t):
    old = t("part").where("p_partkey % 10 <> 0").select("p_partkey", F.col("p_brand").alias("v"))
    return joins.mapping_diff(old, _next_part(t).select("p_partkey", F.col("p_brand").alias("v")), "p_partkey", "v")


@query("(SELECT c_nationkey AS k, 'missing' AS side FROM customer EXCEPT SELECT s_nationkey, 'missing' FROM supplier WHERE s_acctbal > 5000) UNION ALL (SELECT s_nationkey, 'extra' FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey, 'extra' FROM customer)")
def expected_vs_actual(t):
    expected = t("customer").select(F.col("c_nationkey").alias("k"))
    return joins.key_differences(expected, t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), ["k"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'own' ELSE p_brand END AS v FROM part")
def keyed_upsert(t):
    base = t("part").select("p_partkey", F.col("p_brand").alias("v"))
    return joins.upserted(base, t("part").where("p_partkey % 3 = 0").select("p_partkey", F.lit("own").alias("v")), ["p_partkey"])


# Census

_EVENTS = ["click", "view", "purchase", "refund"]


@query("SELECT d.code, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('refund')) d(code) LEFT JOIN events e ON e.event_type = d.code GROUP BY d.code")
def census_zero_members(t):
    """Members that nothing has are counted as 0."""
    rows = t("events").where(F.col("event_type").isin(_EVENTS))
    return census.census(rows, F.array("event_type"), _EVENTS)


@query("SELECT d.code, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('gone')) d(code) LEFT JOIN events e ON e.event_type = d.code GROUP BY d.code UNION ALL SELECT NULL, count(*) FILTER (event_type = 'purchase') FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def census_no_value(t):
    """With the rows of no value, whether there are any or not."""
    rows = t("events").where(F.col("event_type").isin(["click", "view", "purchase"]))
    value = F.nullif("event_type", F.lit("purchase"))
    return census.census(rows, F.when(value.isNotNull(), F.array(value)), ["click", "view", "gone"], no_value=True)


@query("SELECT d.kind, count(DISTINCT CASE WHEN NOT ((event_type = 'click' AND user_id % 5 = 0) OR (event_type = 'view' AND user_id % 5 = 1)) THEN user_id END) AS n FROM (VALUES ('click'), ('view'), ('refund')) d(kind) LEFT JOIN events e ON e.event_type = d.kind GROUP BY d.kind")
def cross_type_counts(t):
    side = F.pmod(F.col("user_id"), F.lit(5)).cast("string")
    shown = P.kind_at(F.col("event_type"), F.lit("u"), F.array(side), [("click", "u", "0"), ("view", "u", "1")])
    return census.entities_per_kind(t("events").withColumnRenamed("user_id", "id").withColumn("user_id", F.col("id")), ["click", "view", "refund"], shown)


@query("SELECT coalesce(nullif(o_orderstatus, 'P'), 'null') AS value, count(*) AS n FROM orders GROUP BY 1")
def bucket_counts(t):
    return census.bucketed(t("orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P"))), "s")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return census.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


# Text


_TITLE_SQL = r"""SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;?', '&', 'g')) AS title FROM pages"""


@query(_TITLE_SQL)
def page_title(t):
    """By the HTML walk, entities resolved."""
    return page_source.extract(t("pages"), "page_id").select("page_id", "title")


@query(_TITLE_SQL)
def page_title_all(t):
    """The same under its former name."""
    return page_title(t)


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a [^>]*href'))::INT AS links FROM pages")
def page_links(t):
    return page_source.extract(t("pages"), "page_id").select("page_id", "links")


@query(r"SELECT doc_id, len(l)::INT AS n_lines, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)")
def segment_lines(t):
    held = T.lines(F.col("text"))
    return t("documents").select("doc_id", F.size(held).alias("n_lines"), F.md5(F.array_join(held, "|")).alias("digest"))


_SENTENCE_SQL = r"SELECT doc_id, unnest(range(len(s)))::INT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '. ', '.' || chr(1)), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS s FROM documents)"


@query(_SENTENCE_SQL)
def sentence_units(t):
    return t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"), r"\. ")).alias("pos", "sentence"))


@query(_SENTENCE_SQL)
def sentence_units_all(t):
    """The same under its former name."""
    return sentence_units(t)


@query("SELECT doc_id, substr(sha1(coalesce(text, '')), 1, 16) AS hash FROM documents")
def text_hash(t):
    return t("documents").select("doc_id", T.text_hash(F.lit(None).cast("string"), F.col("text")).alias("hash"))


@query("SELECT substr(sha1(text), 1, 16) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_text(t):
    rows = t("documents").select(T.text_hash(F.lit(None).cast("string"), F.col("text")).alias("hash"))
    return rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string(list_filter(string_split(replace(x, '. ', '. ' || chr(1)), chr(1)), lambda s: NOT regexp_matches(s, 'stupid|idiot')), '')), lambda x: trim(x) <> ''), chr(10))) AS digest FROM documents")
def mask_sentences(t):
    """Sentences with a marker go, and lines with nothing left."""
    return t("documents").select("doc_id", F.md5(T.without_sentences(F.col("text"), "stupid|idiot", r"\. ")).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN (length(text) - length(replace(text, 'the', ''))) / 3 = 1 THEN replace(text, 'the', 'THE') END) AS digest FROM documents")
def errata_exactly_once(t):
    return t("documents").select("doc_id", F.md5(T.corrected(F.col("text"), F.lit("the"), F.lit("THE"))).alias("digest"))


_GAPS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x, i: i % 2 = 1) AS parts FROM documents),
s AS (
  SELECT doc_id, 1 AS k, 1 AS pos, []::VARCHAR[] AS gaps FROM d
  UNION ALL
  SELECT doc_id, k + 1, CASE WHEN p > 0 THEN pos + p - 1 + length(part) ELSE pos END, CASE WHEN p > 0 AND gap <> '' THEN list_append(gaps, gap) ELSE gaps END
  FROM (SELECT s.doc_id, s.k, s.pos, s.gaps, d.parts[k] AS part, strpos(substr(d.text, pos), d.parts[k]) AS p, regexp_replace(substr(d.text, pos, greatest(strpos(substr(d.text, pos), d.parts[k]) - 1, 0)), '^\s+|\s+$', '', 'g') AS gap FROM s JOIN d USING (doc_id) WHERE k <= len(d.parts)))
SELECT doc_id, CASE WHEN documents.text IS NOT NULL THEN array_to_string(CASE WHEN rest <> '' THEN list_append(gaps, rest) ELSE gaps END, '|') END AS gaps
FROM documents JOIN (SELECT s.*, regexp_replace(substr(d.text, pos), '^\s+|\s+$', '', 'g') AS rest FROM s JOIN d ON s.doc_id = d.doc_id AND s.k = len(d.parts) + 1) s USING (doc_id)"""


@query(_GAPS_SQL)
def coverage_gaps(t):
    """What every other line, sought in order, leaves of a text."""
    every = F.filter("l", lambda x, i: i % 2 == 0)
    rows = t("documents").select("doc_id", "text").withColumn("l", T.lines(F.col("text")))
    return rows.select("doc_id", F.array_join(T.coverage(F.col("text"), every)["gaps"], "|").alias("gaps"))


@query(_GAPS_SQL)
def coverage_gaps_all(t):
    """The same under its former name."""
    return coverage_gaps(t)


# Rules

_DOC_RULES = (
    rules.Rule("R1", "junk", "clause", r"\*\*\*", ""),
    rules.Rule("R2", "junk", "clause", r"!! .*!! ", ""),
    rules.Rule("R3", "toxic", "clause", "stupid|idiot", r"\*\*\*"),
    rules.Rule("R4", "rare", "clause", "xyzzyx", ""),
)
_HITS_SQL = r"list_filter([CASE WHEN regexp_matches(text, '\*\*\*') THEN 'R1' END, CASE WHEN regexp_matches(text, '!! .*!! ') THEN 'R2' END, CASE WHEN regexp_matches(text, 'stupid|idiot') AND NOT regexp_matches(text, '\*\*\*') THEN 'R3' END], lambda x: x IS NOT NULL)"


def _ruled(t) -> DataFrame:
    none = F.lit(None).cast("string")
    return t("documents").select("doc_id", rules.rule_hits(F.col("text"), none, none, _DOC_RULES).alias("hits"))


@query(f"SELECT doc_id, array_to_string({_HITS_SQL}, ',') AS hits FROM documents")
def rule_hits(t):
    return _ruled(t).select("doc_id", F.array_join("hits", ",").alias("hits"))


@query(f"WITH h AS (SELECT doc_id, {_HITS_SQL} AS hits FROM documents), c AS (SELECT r, count(*) AS n FROM (SELECT unnest(hits) AS r FROM h) GROUP BY r HAVING count(*) >= 8), k AS (SELECT doc_id, list_distinct(list(CASE WHEN r = 'R3' THEN 'toxic' ELSE 'junk' END)) AS kinds FROM (SELECT doc_id, unnest(hits) AS r FROM h) JOIN c USING (r) GROUP BY doc_id) SELECT h.doc_id, CASE WHEN len(kinds) = 1 THEN kinds[1] END AS predicted FROM h LEFT JOIN k USING (doc_id)")
def rule_shadow(t):
    """Rules with enough coverage predict where they agree."""
    return rules.predict(_ruled(t), _DOC_RULES).select("doc_id", "predicted")


@query(f"WITH h AS (SELECT {_HITS_SQL} AS hits, CASE WHEN quality = 0 THEN 'junk' WHEN toxic = 1 THEN 'toxic' ELSE 'none' END AS attested FROM documents JOIN labels USING (doc_id)), e AS (SELECT unnest(hits) AS rule, attested FROM h), r(rule, kind) AS (VALUES ('R1', 'junk'), ('R2', 'junk'), ('R3', 'toxic'), ('R4', 'rare')), c AS (SELECT r.rule, kind, count(attested) AS attested, count(*) FILTER (attested = kind) AS agree FROM r LEFT JOIN e USING (rule) GROUP BY ALL) SELECT rule, kind, attested AS coverage, attested, agree, CASE WHEN attested > 0 THEN agree / attested END AS rate, CASE WHEN attested < 8 THEN 'insufficient' WHEN agree / attested >= 0.99 THEN 'pass' ELSE 'fail' END AS verdict FROM c")
def rule_validation(t):
    label = F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("none")
    return rules.validate(_ruled(t).join(t("labels"), "doc_id").withColumn("attested", label), _DOC_RULES)


@query(f"SELECT array_to_string({_HITS_SQL}, ',') AS hits, count(*) AS n FROM documents GROUP BY 1")
def rule_overlap(t):
    return _ruled(t).groupBy(F.array_join("hits", ",").alias("hits")).agg(F.count("*").alias("n"))


# Merging by authority


def _sheet(t, fresh: bool) -> DataFrame:
    k = F.col("p_partkey")
    source = F.element_at(F.array(*map(F.lit, ["rule", "llm", "official", "manual", "llm_then_rule"] if not fresh else ["official", "llm", "rule"])), ((k % (3 if fresh else 5)) + 1).cast("int"))
    kind = F.when(k % (7 if fresh else 9) == 0, None).otherwise(F.concat(F.lit("k"), (k % (2 if fresh else 4)).cast("string")))
    rows = t("part").where(k % (6 if fresh else 8) != 0)
    out = rows.select(
        k.alias("id"), F.lit("main").alias("section"), F.lit("1").alias("label"), F.col("p_name").alias("text"), (k % (10 if fresh else 11)).cast("string").alias("text_hash"),
        kind.alias("kind"), F.when(k % 3 == 0, "m").alias("optional"), F.lit(None).cast("string").alias("role"), source.alias("source"), (k % 19 == 0).alias("needs_review"), F.array().cast("array<string>").alias("tags"),
    )
    return out.withColumn("rejudge", F.col("id") % 4 == 0) if fresh else out


_SHEET_SQL = """
WITH f AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'k' || (p_partkey % 2) END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'm' END AS optional, ['official', 'llm', 'rule'][p_partkey % 3 + 1] AS source, p_partkey % 19 = 0 AS review, (p_partkey % 10)::VARCHAR AS h, p_partkey % 4 = 0 AS rejudge FROM part WHERE p_partkey % 6 <> 0),
p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 'k' || (p_partkey % 4) END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'm' END AS optional, ['rule', 'llm', 'official', 'manual', 'llm_then_rule'][p_partkey % 5 + 1] AS source, p_partkey % 19 = 0 AS review, (p_partkey % 11)::VARCHAR AS h FROM part WHERE p_partkey % 8 <> 0),
j AS (SELECT f.id, f.kind AS fk, p.kind AS pk, f.optional AS fo, p.optional AS po, f.source AS fs, p.source AS ps, f.review AS fr, p.review AS pr, f.h AS fh, p.h AS ph, rejudge AND f.source = 'llm' AS rejudge,
  CASE WHEN p.id IS NULL THEN 'new' WHEN p.source = 'rule' THEN 'fresh' WHEN p.source = 'official' AND f.source = 'official' THEN 'official' WHEN p.source IN ('llm', 'llm_then_rule') AND rejudge AND f.source = 'llm' THEN 'rejudged'
    WHEN f.source = 'official' AND p.source <> 'manual' AND (p.kind IS NULL OR p.kind = f.kind) THEN 'upgrade' WHEN f.source = 'official' AND p.kind IS DISTINCT FROM f.kind THEN 'conflict' ELSE 'kept' END AS m
  FROM f LEFT JOIN p USING (id)),
d AS (SELECT *, fk IS DISTINCT FROM pk OR fo IS DISTINCT FROM po AS differ FROM j)
SELECT id, CASE WHEN m IN ('new', 'fresh', 'rejudged') THEN fk WHEN m IN ('official', 'upgrade') THEN coalesce(fk, pk) ELSE pk END AS kind,
  CASE WHEN m IN ('new', 'fresh', 'rejudged') THEN fo WHEN m = 'official' THEN coalesce(po, fo) WHEN m = 'upgrade' THEN coalesce(fo, po) ELSE po END AS optional,
  CASE WHEN m IN ('new', 'fresh', 'rejudged', 'official', 'upgrade') THEN fs ELSE ps END AS source,
  CASE WHEN m IN ('new', 'fresh', 'rejudged', 'official') THEN fr ELSE pr OR fr OR fh <> ph END AS needs_review,
  CASE WHEN m = 'fresh' AND differ THEN 'rule_changed' WHEN m = 'official' AND differ THEN 'official_changed' WHEN m = 'rejudged' AND differ THEN 'judgment_rejudged' WHEN m = 'kept' AND rejudge AND differ THEN 'judgment_rejudge_refused'
    WHEN m = 'upgrade' THEN 'late_official_upgrade' WHEN m = 'conflict' THEN 'late_official_conflict' WHEN m = 'kept' AND fs = 'llm' AND differ THEN 'judgment_overridden' END AS event
FROM d"""


@query(_SHEET_SQL)
def authority_merge(t):
    return merge.merge(_sheet(t, True), _sheet(t, False)).select("id", "kind", "optional", "source", "needs_review", "event")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 8 <> 0 AND p_partkey % 6 = 0")
def orphans(t):
    return merge.orphans(_sheet(t, False), _sheet(t, True)).select("id")


@query("SELECT conv_id, turn, max(length(text) > 400) OVER (PARTITION BY conv_id) AS needs_review FROM conversations")
def review_contagion(t):
    rows = t("conversations").select("conv_id", "turn", (F.length("text") > 400).alias("needs_review"))
    return merge.spread_review(rows, "conv_id")


# Samples, scores and checks


@query("SELECT class, least(n, CASE class WHEN 'bad' THEN 20 ELSE 30 END)::BIGINT AS n FROM (SELECT CASE WHEN quality = 0 THEN 'bad' ELSE 'good' END AS class, count(*) AS n FROM labels GROUP BY 1)")
def stratified_quota(t):
    rows = t("labels").select("doc_id", F.when(F.col("quality") == 0, "bad").otherwise("good").alias("class"))
    return sampling.stratified(rows, "class", {"bad": 20, "good": 30}, 7, "doc_id").groupBy("class").agg(F.count("*").alias("n"))


@query(r"SELECT CASE WHEN quality = 0 THEN 'bad' ELSE 'good' END AS class, count(*) AS n, count(*) FILTER ((quality = 0) = regexp_matches(text, '\*\*\*|!! ')) AS right, count(*) FILTER ((quality = 0) = regexp_matches(text, '\*\*\*|!! ')) / count(*) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def recall_by_class(t):
    said = F.when(F.col("text").rlike(r"\*\*\*|!! "), "bad").otherwise("good")
    rows = t("documents").join(t("labels"), "doc_id").withColumn("said", said)
    return sampling.recall_by_class(rows, F.when(F.col("quality") == 0, "bad").otherwise("good"), F.col("said"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 100000)")
def invariant_both_ways(t):
    return t("orders").where(checks.both_ways(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000)).select("o_orderkey")


@query("SELECT 'low_price' AS \"check\", o_orderkey AS id, o_orderstatus AS detail FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT 'pending', o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def violations_union(t):
    return checks.violations(t("orders"), {"low_price": (F.col("o_totalprice") < 2000, F.col("o_orderstatus")), "pending": (F.col("o_orderstatus") == "P", F.col("o_orderpriority"))}, "o_orderkey")


@query("SELECT gate, count(o_orderkey) = 0 AS ok, count(o_orderkey) AS n FROM (VALUES ('pending'), ('negative')) g(gate) LEFT JOIN orders ON gate = 'pending' AND o_orderstatus = 'P' OR gate = 'negative' AND o_totalprice < 0 GROUP BY gate")
def gate_summary(t):
    found = checks.violations(t("orders"), {"pending": (F.col("o_orderstatus") == "P", F.lit("")), "negative": (F.col("o_totalprice") < 0, F.lit(""))}, "o_orderkey")
    return checks.gates(found, ["pending", "negative"])


# The search over stand-in entities: parts, with their line items as clauses


def _raw(t) -> DataFrame:
    """Parts as packed rows: kinds by turns, unknown statistics, markers of link monsters in the defence, scale over level, and some tokens."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, (0x21, 0x4000021, 0x1000061, 0x10002, 0x100004))), (k % 5 + 1).cast("int"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), (k % n).cast("int"))
    return t("part").select(
        k.alias("id"), (kind + F.when(k % 97 == 0, 0x4000).otherwise(0)).cast("long").alias("type"), F.when(k % 11 == 0, -2).otherwise(F.col("p_size") * 100).cast("long").alias("atk"), _long("p_size").alias("def"),
        (k % 12 + 1 + (k % 8) * (1 << 24)).alias("level"), bit(5).alias("race"), bit(7).alias("attribute"), F.lit(0).cast("long").alias("setcode"), (k % 3 + 1).alias("ot"), F.lit(0).cast("long").alias("alias"), F.col("p_name").alias("name"), F.col("p_type").alias("desc"),
    )


_RAW_SQL = """raw AS (SELECT p_partkey AS id, [33, 67108897, 16777313, 65538, 1048580][p_partkey % 5 + 1] + CASE WHEN p_partkey % 97 = 0 THEN 16384 ELSE 0 END AS type, CASE WHEN p_partkey % 11 = 0 THEN -2 ELSE p_size * 100 END::BIGINT AS atk, p_size::BIGINT AS def,
  p_partkey % 12 + 1 AS level, p_partkey % 8 AS scale, ['warrior', 'spellcaster', 'fairy', 'fiend', 'zombie'][p_partkey % 5 + 1] AS race, ['earth', 'water', 'fire', 'wind', 'light', 'dark', 'divine'][p_partkey % 7 + 1] AS attr, p_partkey % 3 + 1 AS ot, p_name, p_type FROM part),
ent AS (SELECT *, p_partkey IS NULL AS no FROM (SELECT *, id AS p_partkey, id % 5 AS t FROM raw WHERE id % 97 <> 0)),
"""
_CODE_OF_FLAG = {"A": "t", "R": "q", "N": "c"}


def _cards(t) -> DataFrame:
    return entities.decoded(_raw(t)).select(
        "*", F.array(F.col("id") + 1_000_000).alias("alt_ids"), F.col("name").alias("name_zh"), F.lit(None).cast("string").alias("name_ja"), F.upper("name").alias("name_en"), F.concat("name", F.lit("\n※"), "desc").alias("body"),
        F.element_at(F.array(*map(F.lit, ("N", "R", "SR", "UR"))), (F.col("id") % 4 + 1).cast("int")).alias("rarity"), (F.col("id") % 6).alias("points"), F.when(F.col("id") % 10 == 0, "f").alias("ban_o"), F.when(F.col("id") % 15 == 0, "l").alias("ban_t"), F.lit(None).cast("string").alias("ban_m"),
    )


def _clauses(t) -> DataFrame:
    kind = F.element_at(F.create_map(*(F.lit(x) for p in _CODE_OF_FLAG.items() for x in p)), F.col("l_returnflag"))
    return t("lineitem").select(
        F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("pos"), F.lit("main").alias("section"), F.col("l_linenumber").cast("string").alias("label"), F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("text"),
        kind.alias("kind"), F.when(kind.isin("t", "q"), F.when(F.col("l_linestatus") == "F", "m").otherwise("o")).alias("opt"), F.when(F.col("l_linenumber") == 1, "mat").alias("role"),
    )


def _index(t) -> DataFrame:
    """The stand-in entities as the search sees them, with their clauses in one array."""
    return entities.index_rows(_cards(t), _clauses(t))


#: Stored indexes of this process, by session and folder of the tables.
_STORED: dict[tuple[str, str], stored.Index] = {}


def _stored(t) -> stored.Index:
    """The stored index of the stand-in entities, written when it is first asked for."""
    spark, folder = t.args
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        _STORED[key] = stored.write(entities.faces(_cards(t)), _clauses(t))
    return _STORED[key]


@query(f"WITH {_RAW_SQL} x AS (SELECT 1) SELECT id, type, atk AS atk_raw, CASE WHEN t < 3 THEN atk END AS atk, CASE WHEN t IN (0, 2) THEN def END AS def, CASE WHEN t < 3 THEN level END AS level, CASE WHEN t = 2 THEN scale END AS scale, CASE WHEN t = 1 THEN def END AS link_marker FROM ent")
def decoded_entities(t):
    """Packed rows unpacked: parameters of monsters only, scale and level apart, markers of link monsters; tokens left out."""
    raw = _raw(t)
    out = entities.decoded(raw).join(raw.select("id", F.col("atk").alias("atk_raw")), "id")
    return out.select("id", "type", "atk_raw", "atk", "def", *(_long(c).alias(c) for c in ("level", "scale", "link_marker")))


@query("SELECT 'token' AS reason, count(*) AS n FROM part WHERE p_partkey % 97 = 0 HAVING count(*) > 0")
def excluded_entities(t):
    return entities.exclusions(_raw(t))


@query("SELECT p_partkey AS id, ['怪獸', '怪獸', '怪獸', '速攻魔法', '反擊陷阱'][p_partkey % 5 + 1] AS label FROM part")
def card_type_labels(t):
    return _raw(t).select("id", entities.card_type(F.col("type")).alias("label"))


_HIT_SQL = "l_returnflag = 'A' AND l_linestatus = 'F' AND contains(l_returnflag || ' ' || l_linestatus || ' ' || l_quantity::INT, '1') AND l_linenumber <> 1"
_FOUND_SQL = f"found AS (SELECT ent.*, (SELECT string_agg(pos::VARCHAR, ',' ORDER BY pos, label) FROM (SELECT l_orderkey * 10 + l_linenumber AS pos, l_linenumber AS label FROM lineitem WHERE l_partkey = id AND {_HIT_SQL})) AS rows FROM ent WHERE t < 3 AND attr NOT IN ('dark') AND atk >= 500)"
_SEARCH = search.Condition(cat={"m": 1}, attr={"dark": -1}, atk=(500, None), text="1", kind={"t": 1}, opt={"m": 1})


@query(f"WITH {_RAW_SQL} {_FOUND_SQL} SELECT id, rows FROM found WHERE rows IS NOT NULL")
def search_entities(t):
    """Conditions on entities, and a keyword, a kind and a value that must hold on one clause; materials are passed over by the keyword."""
    return _stored(t).run(_SEARCH).select("id", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


@query(f"WITH {_RAW_SQL} x AS (SELECT 1) SELECT id FROM ent WHERE (t < 2 OR t = 3) AND (contains(p_name, 'a') OR contains(p_type, 'a')) AND id % 10 = 0 AND id % 4 IN (1, 2)")
def search_by_name_and_lists(t):
    """Subtypes qualified by their category, a name or alias, a list and a rarity; no clause condition, so no rows."""
    q = search.Condition(name="a", sub={"m:normal": 1, "m:effect": 1, "s:quick": 1, "m:fusion": -1}, ban_o={"f": 1}, rarity={"R": 1, "SR": 1})
    return _stored(t).run(q).where("rows IS NULL").select("id")


_FRAME_SQL = "CASE t WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 2 END"
_LEVEL_SQL = "CASE WHEN t < 3 THEN level ELSE -1 END"
_DOMAIN_SQL = f"CASE WHEN t < 3 THEN 0 WHEN t = 3 THEN 1 ELSE 2 END, {_FRAME_SQL}, (t = 2)::INT, {_LEVEL_SQL} DESC, CASE WHEN t < 3 THEN list_position(['earth', 'water', 'fire', 'wind', 'light', 'dark', 'divine'], attr) ELSE 99 END, CASE WHEN t < 3 THEN id % 5 ELSE 99 END, id"


@query(f"WITH {_RAW_SQL} x AS (SELECT 1) SELECT id, row_number() OVER (ORDER BY {_DOMAIN_SQL})::BIGINT AS rank FROM ent")
def search_domain_order(t):
    """The domain order of seven levels over all entities, as the index stores it."""
    return _stored(t).entities.select("id", _long("rank").alias("rank"))


@query(f"WITH {_RAW_SQL} x AS (SELECT 1) SELECT id, CASE WHEN t < 3 THEN atk END AS atk FROM ent ORDER BY CASE WHEN t < 3 AND atk >= 0 THEN atk END DESC NULLS LAST, {_DOMAIN_SQL} LIMIT 50 OFFSET 100")
def search_page(t):
    """The third page of 50 by a statistic; unknown and absent ones last."""
    return order.page(_stored(t).entities.drop("body"), 3, 50, "atk", "desc").select("id", "atk")


@query(f"WITH {_RAW_SQL} x AS (SELECT 1) SELECT 'entities' AS part, count(*) AS n FROM ent UNION ALL SELECT 'clauses', count(*) FROM lineitem WHERE l_partkey % 97 <> 0 UNION ALL SELECT 'postings', count(DISTINCT (g, l_partkey)) FROM (SELECT l_partkey, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS g FROM (SELECT l_partkey, l_returnflag || ' ' || l_linestatus || ' ' || l_quantity::INT AS x FROM lineitem WHERE l_partkey % 97 <> 0))")
def search_index(t):
    """Writing the index anew: rows of its tables, and ids in its postings."""
    made = stored.write(entities.faces(_cards(t)), _clauses(t))
    counts = [("entities", made.entities.agg(F.count("*").alias("n"))), ("clauses", made.clauses.agg(F.count("*").alias("n"))), ("postings", made.postings.agg(F.sum(F.size("ids")).cast("long").alias("n")))]
    _STORED[t.args[0].sparkContext.applicationId, t.args[1]] = made
    return reduce(DataFrame.unionByName, [n.select(F.lit(part).alias("part"), "n") for part, n in counts])


@query("SELECT l_partkey AS id, string_agg((l_orderkey * 10 + l_linenumber)::VARCHAR, ',' ORDER BY l_orderkey * 10 + l_linenumber) AS rows FROM lineitem WHERE l_partkey % 97 <> 0 AND regexp_matches(l_returnflag || ' ' || l_linestatus || ' ' || l_quantity::INT, 'N O.*3') GROUP BY l_partkey")
def search_postings(t):
    """A keyword of two parts on all clauses, materials too: the postings of its first part say which entities are looked at."""
    found = _stored(t).run(search.Condition(text="N O%3", text_materials=True))
    return found.select("id", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


_LINES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (ORDER BY l_quantity DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM ({_LINES}) WHERE r // 100 = (n * 9 // 10) // 100")
def late_page(t):
    """A page of 100 after nine tenths of all lines, which many share a quantity with, read from the parts of the sort that hold it."""
    rows = t("lineitem").select("l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = order.Sorted.of(rows, F.col("l_quantity").desc_nulls_last(), *map(F.col, rows.columns[1:]))
    return lines.page(lines.total * 9 // 10 // 100 + 1, 100).drop("l_quantity")


@query(f"WITH {_RAW_SQL} x AS (SELECT 1) SELECT id, CASE WHEN id % 10 = 0 THEN 'f' WHEN ot = 2 THEN 'unreleased' ELSE 'free' END AS ban_o, CASE WHEN id % 15 = 0 THEN 'l' WHEN ot = 1 THEN 'unreleased' ELSE 'free' END AS ban_t, 'free' AS ban_m FROM ent WHERE id % 10 = 0 OR id % 15 = 0")
def ban_rows(t):
    return _index(t).select("id", entities.ban_row().alias("b")).where("b IS NOT NULL").select("id", "b.*")


@query("SELECT 'not_exported' AS \"check\", l_partkey AS id, 'opt:' || l_shipmode AS detail FROM (SELECT l_partkey, 'x' AS l_shipmode FROM lineitem WHERE false)")
def unexported_codes(t):
    """Codes of the index that are no buttons: none here."""
    return checks.unexported(_index(t))


@query("SELECT 'optional_on_non_carrier' AS \"check\", l_partkey AS id, l_linenumber::VARCHAR AS detail FROM lineitem WHERE l_partkey % 97 <> 0 AND l_returnflag = 'A'")
def optional_off_carriers(t):
    """With quick effects as the only carriers, the values of triggers are out of place."""
    return checks.optional_off_carriers(_index(t), ("q",))


@query(f"""WITH {_RAW_SQL} r AS (SELECT id, t, p_name, p_type, id % 5 AS k FROM ent)
SELECT "check", id, detail FROM (
  SELECT 'coverage_gaps' AS "check", id, replace(p_name, ' ', '') AS detail FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = id AND false)
  UNION ALL SELECT 'clauses_not_in_text', l_partkey, l_returnflag || l_linestatus || l_quantity::INT FROM lineitem WHERE l_partkey % 97 <> 0) ORDER BY ALL""")
def coverage_faults(t):
    """Every clause of the stand-ins is foreign to the entity's text, whose name is then a gap; the alias after it is one of the kinds that may stay."""
    index = _index(t).withColumn("body", F.concat("name_zh", F.lit("\n")))
    return checks.coverage_faults(index.withColumn("alias", F.lit("")))


@query("SELECT column0 AS \"column\", filled, n - filled AS missing FROM (SELECT 'rarity' AS column0, count(*) AS filled, count(*) AS n FROM part WHERE p_partkey % 97 <> 0 UNION ALL SELECT 'ban_o', count(*) FILTER (p_partkey % 10 = 0), count(*) FROM part WHERE p_partkey % 97 <> 0 UNION ALL SELECT 'name_ja', 0, count(*) FROM part WHERE p_partkey % 97 <> 0)")
def coverage_stats(t):
    return entities.coverage_counts(_index(t), "rarity", "ban_o", "name_ja")


# Official entries


@query("SELECT 'named' AS what, count(*) FILTER (o IS NOT NULL) AS n FROM (SELECT c_custkey, (SELECT 1 FROM orders WHERE o_custkey = c_custkey LIMIT 1) AS o FROM customer) UNION ALL SELECT 'missing', count(*) FILTER (o IS NULL) FROM (SELECT c_custkey, (SELECT 1 FROM orders WHERE o_custkey = c_custkey LIMIT 1) AS o FROM customer)")
def names_filled(t):
    """A left join of names, empty where there is none, with what was found and missed."""
    names = t("orders").select(F.col("o_custkey").alias("id"), F.lit("n").alias("name")).distinct()
    _, counts = entities.named(t("customer").select(F.col("c_custkey").alias("id")), names, "name_zh")
    return counts.select(F.explode(F.create_map(F.lit("named"), F.col("named"), F.lit("missing"), F.col("missing"))).alias("what", "n"))


_SOURCE_SQL = "src AS (SELECT l_partkey AS id, min(l_suppkey) AS v FROM lineitem WHERE l_quantity > 48 GROUP BY 1), used AS (SELECT p_partkey, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS key, coalesce(a.v, b.v) AS v FROM part LEFT JOIN src a ON a.id = p_partkey LEFT JOIN src b ON b.id = p_partkey + 1 WHERE p_partkey % 2 = 0)"


def _consumed(t) -> tuple[DataFrame, DataFrame]:
    source = t("lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("v"))
    rows = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.array(F.col("p_partkey") + 1).alias("alt_ids"))
    return joins.consuming_lookup(rows, "id", "alt_ids", {"found": source}, "v")


@query(f"WITH {_SOURCE_SQL} SELECT p_partkey AS id, v AS found FROM used")
def consuming_join(t):
    return _consumed(t)[0].select("id", "found")


@query(f"WITH {_SOURCE_SQL} SELECT 'found' AS source, id FROM src WHERE id NOT IN (SELECT key FROM used WHERE key IS NOT NULL)")
def consuming_rest(t):
    """Source rows that no entity has used, one on an alternate id among them where the main id has its own."""
    return _consumed(t)[1]


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 2 THEN 'excluded' ELSE 'missing' END AS side FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (c_custkey, c_custkey + 1))")
def missing_by_region(t):
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_custkey") + 1).alias("alt_ids"), F.pmod("c_nationkey", F.lit(3)).alias("ot"))
    missing, elsewhere = joins.missing_by_region(rows, t("orders").where("o_orderstatus = 'P'"), "o_custkey")
    return missing.select("id", F.lit("missing").alias("side")).unionByName(elsewhere.select("id", F.lit("excluded").alias("side")))


_TARGET_SQL = "m AS (SELECT p_partkey AS id, p_size AS cid FROM part WHERE p_partkey % 3 = 0)"


@query(f"WITH {_TARGET_SQL} SELECT p.p_partkey AS id, coalesce(a.cid, b.cid)::BIGINT AS cid FROM part p LEFT JOIN m a ON a.id = p.p_partkey LEFT JOIN m b ON b.id = p.p_partkey + 1 WHERE coalesce(a.cid, b.cid) IS NOT NULL")
def resolved_targets(t):
    """By id, else by an alternate one."""
    mapping = t("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), _long("p_size").alias("cid"))
    rows = t("part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_partkey") + 1).alias("alt_ids"))
    return joins.resolved(rows, mapping, "cid")[0].select("id", "cid")


@query("SELECT p_partkey AS id FROM part WHERE CASE WHEN p_partkey % 3 = 0 THEN p_size > 25 WHEN (p_partkey + 1) % 3 = 0 AND p_partkey + 1 <= (SELECT max(p_partkey) FROM part) THEN (SELECT p_size > 25 FROM part q WHERE q.p_partkey = part.p_partkey + 1) ELSE false END")
def verified_entries(t):
    """The first id that has an entry counts, even where its text is empty."""
    entries = t("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("password"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("").alias("card_text"))
    rows = t("part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_partkey") + 1).alias("alt_ids"))
    return joins.verified(rows, entries, "password", "card_text")[0].select("id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'a,b' WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS gained FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def newly_filled(t):
    """Text fields that a second crawl has and the first had not."""
    k = F.col("p_partkey")
    old = t("part").select(k, F.lit("").alias("a"), F.lit(None).cast("string").alias("b"), F.lit("x").alias("c"))
    new = t("part").select(k, F.when(k % 2 == 0, "x").alias("a"), F.when(k % 3 == 0, "x").otherwise("").alias("b"), F.lit("y").alias("c"))
    return joins.newly_filled(old, new, "p_partkey", ["c", "b", "a"]).withColumn("gained", F.array_join("gained", ","))


@query("SELECT coalesce(o.user_id, d.user_id) AS user_id, coalesce(o.v, d.v) AS v FROM (SELECT user_id, arg_min(event_id, event_id) AS v FROM events GROUP BY user_id) d FULL JOIN (SELECT c_custkey AS user_id, -1::BIGINT AS v FROM customer WHERE c_custkey % 10 = 0) o ON o.user_id = d.user_id")
def effective_mapping(t):
    """The first of all dumps, with overrides over it."""
    dumps = t("events").select("user_id", F.col("event_id").alias("v"), "event_id")
    over = t("customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("v"))
    return joins.effective_mapping(dumps, over, "user_id", "v", [F.col("event_id")])


@query("SELECT p_brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS keys FROM part GROUP BY p_brand")
def inverted_mapping(t):
    return joins.inverted(t("part"), "p_partkey", "p_brand").select("p_brand", F.array_join("keys", ",").alias("keys"))


# Sheets, blind samples and seals


def _turns(t) -> DataFrame:
    """Conversations as entities, their turns as clauses; every third is a preamble."""
    turn = F.col("turn")
    label = F.when(turn % 3 == 0, F.when(turn == 0, "0").otherwise(F.concat(F.lit("0-"), turn.cast("string")))).otherwise(turn.cast("string"))
    kind = F.when(turn % 4 == 1, None).otherwise(F.element_at(F.array(F.lit("t"), F.lit("c")), (turn % 2 + 1).cast("int")))
    source = F.when(turn % 5 < 3, "official").otherwise("llm")
    return t("conversations").select(F.col("conv_id").alias("id"), F.lit("main").alias("section"), turn.cast("int").alias("pos"), label.alias("label"), F.col("role").alias("text_zh"), F.col("text").alias("text_ja"), kind.alias("kind"), source.alias("source"))


_TURN_SQL = "turns AS (SELECT conv_id AS id, turn, CASE WHEN turn % 3 = 0 THEN CASE WHEN turn = 0 THEN '0' ELSE '0-' || turn END ELSE turn::VARCHAR END AS label, text, CASE WHEN turn % 4 = 1 THEN NULL ELSE ['t', 'c'][turn % 2 + 1] END AS kind, CASE WHEN turn % 5 < 3 THEN 'official' ELSE 'llm' END AS source FROM conversations)"


@query(f"WITH {_TURN_SQL} SELECT id, count(*) AS n FROM turns WHERE kind IS NULL GROUP BY id")
def pending_clauses(t):
    return batches.pending(_turns(t)).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8)")
def only_listed(t):
    return batches.only(t("part"), [3, 5, 8, 5], "p_partkey").select("p_partkey", "p_name")


@query(f"WITH {_TURN_SQL} SELECT id, count(*) AS n FROM turns WHERE source = 'official' AND kind = 't' AND id NOT IN (SELECT conv_id FROM conversations WHERE length(text) > 800) AND id <> 4 GROUP BY id")
def sample_candidates(t):
    """Official clauses; entities of earlier samples go whole."""
    out = sampling.excluded_ids(t("conversations").where(F.length("text") > 800).select(F.col("conv_id").alias("id")), ids=[4])
    return sampling.candidates(_turns(t), ["t"], out).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {_TURN_SQL} SELECT id, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM turns WHERE turn % 3 = 0 AND text <> '' GROUP BY id")
def preamble_contexts(t):
    return sampling.preamble_contexts(_turns(t)).select("id", F.md5("preamble").alias("digest"))


@query(f"WITH {_TURN_SQL} SELECT id, count(*) AS n FROM turns WHERE turn % 3 <> 0 AND text <> '' GROUP BY id")
def rule_targets(t):
    return rules.targets(_turns(t)).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {_TURN_SQL} SELECT coalesce(CASE WHEN source = 'official' THEN kind END, 'none') AS kind, count(*) AS n FROM turns GROUP BY 1")
def answer_key(t):
    return sampling.answer_key(_turns(t), ["id", "label"]).groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


_SCORE_SQL = """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'stale' WHEN p_partkey % 7 = 0 THEN 'withdrawn' WHEN p_partkey % 101 = 0 THEN 'ambiguous' WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 17 = 0 THEN 'blank' WHEN p_partkey % 19 = 0 THEN 'invalid' WHEN p_partkey % 5 = 0 THEN 'wrong' ELSE 'right' END AS status FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 'extra' FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 23 = 0 AND p_partkey % 11 <> 0)"""


def _scored(t) -> DataFrame:
    k = F.col("p_partkey")
    sample = t("part").where(k % 2 == 0).select(k.alias("id"), F.col("p_name").alias("text"))
    now = t("part").select(k.alias("id"), F.when(k % 13 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name")).alias("text"), F.when(k % 3 == 0, "t").otherwise("c").alias("kind"), F.when(k % 7 == 0, "llm").otherwise("official").alias("source"))
    said = F.when(k % 17 == 0, None).when(k % 19 == 0, "zz").otherwise(F.when((k % 3 == 0) != (k % 5 == 0), "t").otherwise("c"))
    answers = t("part").where(((k % 2 == 0) | (k % 23 == 0)) & (k % 11 != 0)).select(k.alias("id"), said.alias("kind"))
    unclear = t("part").where((k % 101 == 0) & (k % 2 == 0)).select(k.alias("id"))
    return sampling.score(sample, answers, now, ["id"], ["t", "c"], ambiguous=unclear)


@query(f"{_SCORE_SQL} SELECT status, count(*) AS n FROM r GROUP BY status")
def blind_scores(t):
    return _scored(t).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{_SCORE_SQL} SELECT count(*) AS scored, count(*) FILTER (status = 'right') AS right, count(*) FILTER (status = 'right') / count(*) AS accuracy FROM r WHERE status IN ('right', 'wrong', 'blank')")
def blind_accuracy(t):
    return sampling.overall(_scored(t))


@query("SELECT CASE WHEN p_partkey % 4 = 0 THEN 'no_clause' WHEN p_partkey % 3 = 0 THEN 'agree' ELSE 'disagree' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def rule_tally(t):
    k = F.col("p_partkey")
    return census.tally(t("part"), F.when(k % 4 == 0, None).when(k % 3 == 0, "m").otherwise("o"), "m", F.lit("no_clause"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'q' WHEN p_partkey % 5 = 0 THEN 't' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'official' ELSE 'rule' END AS source, p_partkey % 3 = 0 OR p_partkey % 7 = 0 AS mandatory FROM part")
def attested_kinds(t):
    """Official kinds written to the sheet; a statement of the flag alone leaves the kind."""
    k = F.col("p_partkey")
    key = [k.alias("id"), F.lit("main").alias("section"), F.lit("1").alias("label")]
    sheet = t("part").select(*key, F.when(k % 5 == 0, "t").alias("kind"), F.lit("rule").alias("source"))
    assigned = t("part").where((k % 3 == 0) | (k % 7 == 0)).select(*key, F.when(k % 3 == 0, "q").alias("kind"), F.lit(True).alias("mandatory"))
    return merge.attested(sheet, assigned).select("id", "kind", "source", "mandatory")


_DOC_PARTS_SQL = "doc AS (SELECT doc_id AS id, coalesce(text, '') AS text, CASE WHEN contains(text, chr(10)) THEN regexp_extract(text, '^([^\\n]*)\\n', 1) ELSE '' END AS head FROM documents)"


def _doc_records(t) -> tuple[DataFrame, DataFrame]:
    """Documents as texts of one language, cut after their first line: good records, stale ones, ones that leave the head out, ones with a label twice, and ones of no text."""
    docs = t("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("head", F.when(F.contains("text", F.lit("\n")), F.substring_index("text", "\n", 1)).otherwise(""))
    rest = F.substring("text", F.length("head") + 1, F.length("text"))
    part = lambda label, zh: F.struct(label.alias("label"), zh.alias("text_zh"), F.lit("").alias("text_ja"))
    k = F.col("id") % 5
    segments = F.when(k == 2, F.array(part(F.lit("1"), F.substring(rest, F.lit(1), F.length(rest) - 2)))).otherwise(F.array(part(F.lit("0"), F.col("head")), part(F.when(k == 3, "0").otherwise("1"), rest)))
    hashed = F.when(k == 1, "0" * 16).otherwise(T.split_hash(F.col("text"), F.lit("")))
    none = F.lit(None)
    records = docs.select("id", F.lit("main").alias("section"), hashed.alias("text_hash"), segments.alias("segments"), none.cast("array<int>").alias("ja_order"))
    texts = docs.where(k != 4).select("id", F.lit("main").alias("section"), F.col("text").alias("text_zh"), F.lit("").alias("text_ja"), none.cast("string").alias("supplement"), F.lit(False).alias("numbered"), F.lit(0x21).cast("long").alias("type"))
    return records, texts


@query("SELECT doc_id AS id, ['none', 'split_stale', CASE WHEN length(regexp_replace(right(rtrim(text, ' ' || chr(10)), 2), '\\s', '', 'g')) > 0 THEN 'split_coverage_failed' ELSE 'none' END, 'split_malformed', 'split_unused'][doc_id % 5 + 1] AS problem FROM documents WHERE doc_id % 5 <> 2 OR text <> ''")
def split_records(t):
    """What is wrong with each split record, in the order in which that is looked for."""
    return splits.judged_splits(*_doc_records(t)).select("id", F.coalesce("problem", F.lit("none")).alias("problem"))


@query(rf"WITH {_DOC_PARTS_SQL} SELECT id, count(*) AS n, md5(string_agg(regexp_replace(p, '\s', '', 'g'), '|' ORDER BY i)) AS digest FROM (SELECT id, 0 AS i, head AS p FROM doc WHERE id % 5 = 0 UNION ALL SELECT id, 1, substr(text, length(head) + 1) FROM doc WHERE id % 5 = 0) GROUP BY id")
def split_clauses(t):
    """The clauses that good records cut a text into."""
    cut = splits.split_clauses(splits.judged_splits(*_doc_records(t)))
    held = cut.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "text_zh"))).alias("all"))
    return held.select("id", "n", F.md5(F.array_join(F.transform("all", lambda x: F.regexp_replace(x["text_zh"], r"\s", "")), "|")).alias("digest"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND contains(text, 'the') THEN substr(sha1(replace(text, 'the', 'THE')), 1, 16) ELSE 'old' END AS text_hash FROM documents")
def synced_clauses(t):
    """Corrections carried over to the sheet, hashes made anew where a text changed."""
    sheet = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("text_zh"), F.lit("").alias("text_ja"), F.lit("old").alias("text_hash"))
    fixes = t("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.lit("the").alias("from"), F.lit("THE").alias("to"))
    return splits.synced_clauses(sheet, fixes).select("id", "text_hash")


@query("SELECT gate, n = 0 AS ok, n FROM (SELECT 'pending' AS gate, (SELECT count(*) FROM part WHERE p_partkey % 4 = 0) AS n UNION ALL SELECT unnest(['judgment_orphans', 'judgment_rejudge_refused', 'late_official_conflict', 'split_malformed', 'split_stale', 'split_coverage_failed', 'split_quote_violations', 'split_unused', 'bullet_split_mismatch', 'bullet_coverage_failed', 'bullet_quote_violations', 'kind_conflicts', 'unique_keys']), 0 UNION ALL SELECT 'fixpoint', (SELECT 2 * count(*) FROM part WHERE p_partkey % 10 = 0))")
def seal_gates(t):
    """All gates before a sheet is sealed; the rerun changes some rows."""
    k = F.col("p_partkey")
    found = checks.violations(t("part"), {"pending": (k % 4 == 0, F.lit(""))}, "p_partkey")
    sheet = t("part").select(k, F.col("p_brand").alias("v"))
    return checks.sealed(found, sheet, sheet.withColumn("v", F.when(k % 10 == 0, "new").otherwise(F.col("v"))), ["p_partkey"])


@query("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def list_preview(t):
    return census.preview(t("part"), 10, F.col("p_retailprice").desc(), F.col("p_partkey")).select("p_partkey")
