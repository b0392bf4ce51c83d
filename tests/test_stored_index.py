"""The stored index gives what the nested search gives, without moving clause texts; pages are read from the parts of a sort."""

import random

import pytest
from pyspark.sql import functions as F

from clausewright.operators import entities
from clausewright.plans import index as stored
from clausewright.plans import order, query
from clausewright.plans.query import Condition

SIGNS = "abc 卡１%é_\n"


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(4)
    cards = [(i, 0x1 | 0x20, rng.choice([-2, 0, 500, 1500]), 100, rng.randrange(1, 12), 1 << rng.randrange(5), 1 << rng.randrange(7), None, None, rng.randrange(1, 4)) for i in range(300)]
    cards += [(1000, 0x2 | 0x10000, None, None, None, None, None, None, None, 3)]
    cards = spark.createDataFrame(cards, "id long, type long, atk long, def long, level long, race long, attribute long, scale int, link_marker long, ot long")
    text = {"name_zh": "n", "name_ja": None, "name_en": "N", "body": "b", "rarity": None, "ban_o": None, "ban_t": None, "ban_m": None}
    cards = cards.withColumns({c: F.lit(v).cast("string") for c, v in text.items()} | {"alt_ids": F.array().cast("array<long>"), "points": F.lit(0)})
    rows = [(i, p, "main", str(p), "".join(rng.choices(SIGNS, k=rng.randrange(12))) if rng.random() > 0.05 else None, rng.choice(["t", "q", "c", "sq", None]), rng.choice(["m", "o", None]), rng.choice([None, None, "mat"])) for i in [*range(250), 1000, 5000] for p in range(rng.randrange(4))]
    rows += [(1000, 9, "main", "9", "abc abc", "sq", "o", None)]
    clauses = spark.createDataFrame(rows, "id long, pos int, section string, label string, text string, kind string, opt string, role string")
    made = stored.write(entities.faces(cards), clauses, 4)
    yield entities.index_rows(cards, clauses).cache(), made
    made.drop()


KEYWORDS = ["", "a", "ab", "abc", "a%b", "abc%a", "卡", "卡１a", " %a", "%%", "c a", "\\", "a_b", "éab%卡 ", "zzz", "zz", "１%", "\n", "ab\n"]


@pytest.mark.parametrize("keyword", KEYWORDS)
def test_same_as_the_nested_search(both, keyword):
    nested, made = both
    for more in ({}, {"kind": {"t": 1, "sq": 1}}, {"kind": {"t": -1}, "opt": {"tm": -1, "m": 1}}, {"text_materials": True, "atk": (500, None)}):
        q = Condition(text=keyword, **more)
        want = {r["id"]: r["rows"] and sorted(r["rows"]) for r in query.run(nested, q).select("id", "rows").collect()}
        assert {r["id"]: r["rows"] for r in made.run(q).select("id", "rows").collect()} == want, (keyword, more)


def test_postings_are_asked_for_parts_of_three_signs():
    assert stored.asked("ab%c") == [] and stored.asked(" abcd%xy ") == ["abc", "bcd"] and stored.asked(None) == []


def test_clause_texts_do_not_move(both, spark):
    _, made = both
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for q in (Condition(text="abc"), Condition(text="ab"), Condition(kind={"t": 1})):
            plan = made.run(q)._jdf.queryExecution().executedPlan().toString()
            below = plan[plan.index("Join") :]
            for exchange in below.split("Exchange hashpartitioning")[1:]:
                scan = exchange[: exchange.index("Scan parquet") + 200]
                assert "_clauses" not in scan and "text#" not in scan, plan
            assert "_clauses" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_index_is_opened_again(both, spark):
    _, made = both
    again = stored.opened(spark, made.folder, made.buckets)
    q = Condition(text="abc", kind={"t": 1})
    assert sorted(r["id"] for r in again.run(q).collect()) == sorted(r["id"] for r in made.run(q).collect())
    assert "Bucketed: true" in again.run(q)._jdf.queryExecution().executedPlan().toString()
    again.drop()
    assert made.entities.count() == 301


def test_rank_is_the_domain_order(both):
    nested, made = both
    want = [r["id"] for r in order.sort(nested).select("id").collect()]
    assert [r["id"] for r in made.entities.orderBy("rank").select("id").collect()] == want


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_every_page_is_that_of_the_sorted_list(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, 1, 2, 3])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v int").repartition(3)
    key = [F.col("v").desc_nulls_last(), F.col("id")]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = order.Sorted.of(df, *key)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert held.total == n and (n < 1000 or len(held.counts) > 1)
    for size in (3, 400):
        last = order.pages(n, size)
        for number in {1, 2, last // 2, last, last + 5, -1}:
            at = (min(max(1, number), last) - 1) * size
            assert [tuple(r) for r in held.page(number, size).collect()] == want[at : at + size]


def test_a_page_reads_the_parts_that_hold_it(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = order.Sorted.of(spark.range(2000), F.col("id"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    files = lambda df: len(df.inputFiles())
    assert files(spark.read.parquet(held.path)) > 2
    plan = held.page(1, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan[plan.index("PartitionFilters") :]


def test_late_and_early_pages_agree(both, monkeypatch):
    nested, _ = both
    early = [r["id"] for r in order.page(nested, 3, 50, "atk", "desc").collect()]
    monkeypatch.setattr(order, "TOP", 0)
    assert [r["id"] for r in order.page(nested, 3, 50, "atk", "desc").collect()] == early and len(early) == 50


def test_buckets_follow_the_clauses(spark, monkeypatch):
    """What a task sorts is a bucket, so their number grows with the clauses; postings are the same with any number."""
    clauses = spark.range(400).select((F.col("id") % 40).alias("id"), F.col("id").cast("int").alias("pos"), F.lit("main").alias("section"), F.lit("1").alias("label"), F.concat(F.lit("x y"), F.col("id") % 7).alias("text"), F.lit("t").alias("kind"), F.lit(None).cast("string").alias("opt"), F.lit(None).cast("string").alias("role"))
    clauses = clauses.unionByName(clauses.limit(3).withColumn("text", F.lit("ab")))
    monkeypatch.setattr(stored, "BUCKET_ROWS", 40)
    rows = spark.createDataFrame([(i, "m", ["effect"]) for i in range(40)], "id long, cat string, subs array<string>")
    faces = rows.withColumns({c: F.lit(None).cast("int") for c in ("level", "link")} | {c: F.lit(None).cast("string") for c in ("attr", "race")})
    made = stored.write(faces, clauses)
    assert made.buckets == 11 and made.clauses.count() == 403
    want = {(t[i : i + 3], k) for k, t in ((r["id"], r["text"]) for r in clauses.collect()) for i in range(len(t) - 2)}
    assert sorted((r["gram"], i) for r in made.postings.collect() for i in r["ids"]) == sorted(want)
