"""Operators on small frames."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from clausewright.functions import text as T
from clausewright.operators import checks, entities, joins, merge, rules, sampling
from clausewright.sources import pages, readers, writers


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_alias_chains_cycles_and_mismatches(spark):
    rows = [(1, 0, "a"), (2, 1, "a"), (3, 2, "a"), (4, 9, "a"), (5, 6, "b"), (6, 5, "b"), (7, 1, "c"), (8, 7, "c"), (10, 10, "d")]
    merged, odd = joins.alias_merge(spark.createDataFrame(rows, "id long, alias long, name string"))
    assert {r["id"]: r["alt_ids"] for r in merged.collect()} == {1: [2, 3], 4: [], 5: [], 6: [], 7: [8], 10: []}
    assert set(values(odd)) == {(4, "target_missing"), (5, "unresolved"), (6, "unresolved"), (7, "name_mismatch"), (10, "unresolved")}


def test_fallback_skips_keys_without_value(spark):
    left = spark.createDataFrame([(1, [11, 12]), (2, []), (3, None)], "id long, alts array<long>")
    right = spark.createDataFrame([(1, None), (11, None), (12, "x"), (3, "y")], "k long, v string")
    assert {r["id"]: r["v"] for r in joins.lookup_with_fallback(left, "id", "alts", right, "k", "v").collect()} == {1: "x", 2: None, 3: "y"}
    assert values(joins.not_covered(left, "id", "alts", right, "k").select("id")) == [(2,)]


def test_last_duplicate_and_per_field(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 5), (1, 3, "c", None)], "k int, seq int, s string, n int")
    assert values(joins.per_field_last(df, ["k"], [F.col("seq")], ["s", "n"])) == [(1, "c", 5)]
    assert values(joins.one_per_key(df, ["k"], [F.col("seq")])) == [(1, 1, "a", None)]


def test_diffs(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id long, s string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "x", None), (4, "d", 1)], "id long, s string, n int")
    assert [(r["id"], r["change"], r["fields"]) for r in joins.snapshot_diff(old, new, "id").orderBy("id").collect()] == [(2, "changed", ["n", "s"]), (4, "added", [])]
    diff = joins.mapping_diff(old, new, "id", "s")
    assert values(diff) == [(2, "b", "x", "changed"), (3, "c", None, "removed"), (4, None, "d", "added")]
    assert not joins.only_grew(diff).head()[0] and joins.only_grew(diff.where("change = 'added'")).head()[0]
    owners = spark.createDataFrame([(7, [8])], "id long, alt_ids array<long>")
    moved = spark.createDataFrame([(1, 7, 8, "changed"), (2, 7, 9, "changed")], "cid long, old long, new long, change string")
    assert {r["cid"]: r["same_entity"] for r in joins.benign_changes(moved, owners).collect()} == {1: True, 2: False}


def test_segments_and_sections(spark):
    df = spark.createDataFrame([("前言\n①：甲①②一次。\n②：乙",), ("無編號",), ("①：甲。②：乙",)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(T.segments(F.col("t"))).collect()]
    assert got == [[(0, "0", "前言"), (1, "①", "①：甲①②一次。"), (2, "②", "②：乙")], [(0, "1", "無編號")], [(0, "①", "①：甲。"), (1, "②", "②：乙")]]
    df = spark.createDataFrame([("甲",), ("x【靈擺效果】p【怪獸效果】m",), ("x【靈擺效果】p【怪獸敘述】m",), ("x【靈擺效果】p",)], "t string")
    assert [[tuple(x) for x in r[0]] for r in df.select(T.sections(F.col("t"))).collect()] == [[("main", "甲")], [("pendulum", "p"), ("main", "m")], [("pendulum", "p")], [("pendulum", "p")]]


def test_labels_coverage_corrections(spark):
    df = spark.createDataFrame([(["a", "b", "a", "a-2", "a"],)], "l array<string>")
    assert df.select(T.deduplicated_labels(F.col("l"))).head()[0] == ["a", "b", "a-2", "a-2-2", "a-3"]
    df = spark.createDataFrame([("head one mid two tail", ["one", "gone", "two"])], "t string, p array<string>")
    got = df.select(T.coverage(F.col("t"), F.col("p")).alias("c")).head()["c"]
    assert got["gaps"] == ["head", "mid", "tail"] and got["missing"] == ["gone"]
    df = spark.createDataFrame([("a b a", "b", "c"), ("a b a", "a", "c"), ("x", "", "c")], "t string, o string, n string")
    assert [r[0] for r in df.select(T.corrected(F.col("t"), F.col("o"), F.col("n"))).collect()] == ["a c a", None, None]


def test_activation_and_optional(spark):
    texts = ["①：このカードを発動できる（１度のみ。）。後。", "●リリースする事で発動する。", "②：相手ターンに発動する。", "以下の効果を得る。", "破壊された事で発動する。", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(T.activation_clause(F.col("t")), T.optional_by_rule(F.col("t"))).collect()]
    assert got[0] == ("このカードを発動できる", "o") and [g[1] for g in got] == ["o", "o", "m", None, "m", None]


def test_rules_shadow_and_validate(spark):
    assert rules.problems(rules.RULES, ["x", "u", "c", "q", "t", "i"]) == [] and len(rules.digest()) == 64
    rows = [(i, "main", "①", "①：このカードが破壊された場合に発動できる。", "t") for i in range(8)]
    rows += [(20, "main", "①", "以下の効果を得る。", None), (20, "main", "①-●1", "直接攻撃できる", "c"), (21, "main", "①-●1", "直接攻撃できる", "c"), (22, "main", "1", "直接攻撃できる", "c")]
    out = rules.annotate(spark.createDataFrame(rows, "id long, section string, label string, text_ja string, attested string")).cache()
    assert {r["id"]: r["predicted"] for r in out.where("id < 20").collect()} == dict.fromkeys(range(8), "t")
    assert {(r["id"], r["label"]): r["hits"] for r in out.where("id >= 20").collect()} == {(20, "①"): [], (20, "①-●1"): ["R17"], (21, "①-●1"): [], (22, "1"): ["R17"]}
    said = {r["rule"]: (r["coverage"], r["agree"], r["verdict"]) for r in rules.validate(out).collect()}
    assert said["R1"] == (8, 8, "pass") and said["R17"] == (2, 2, "insufficient") and said["R2"] == (0, 0, "insufficient")


def test_merge_is_a_fixpoint(spark):
    schema = "id long, section string, label string, text string, text_hash string, kind string, optional string, role string, source string, needs_review boolean, tags array<string>"
    fresh = spark.createDataFrame([(1, "m", "1", "t", "h", "a", None, None, "official", False, []), (2, "m", "1", "t", "h2", None, None, None, None, False, [])], schema)
    prior = spark.createDataFrame([(1, "m", "1", "t", "h", "b", "m", None, "llm", False, []), (2, "m", "1", "t", "h", "k", None, None, "manual", False, ["x"])], schema)
    once = merge.merge(fresh, prior)
    got = {r["id"]: (r["kind"], r["source"], r["needs_review"], r["event"]) for r in once.collect()}
    assert got == {1: ("b", "llm", False, "late_official_conflict"), 2: ("k", "manual", True, None)}
    again = merge.merge(fresh, once.drop("event"))
    assert checks.same_rows(again.drop("event", "needs_review"), once.drop("event", "needs_review"))


def test_quotas_and_scores(spark):
    assert sampling.quotas({"a": 100, "b": 5, "c": 1}, 20, 4) == {"a": 14, "b": 5, "c": 1}
    assert sampling.quotas({"a": 2, "b": 1}, 10) == {"a": 2, "b": 1}
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, "a").otherwise("b").alias("c"))
    one = sampling.stratified(rows, "c", {"a": 7, "b": 20}, 3, "id")
    assert {r["c"]: r["count"] for r in one.groupBy("c").count().collect()} == {"a": 7, "b": 10}
    assert values(one) == values(sampling.stratified(rows.repartition(3), "c", {"a": 7, "b": 20}, 3, "id"))
    assert [r["id"] for r in sampling.evenly(rows, 4, F.col("id")).orderBy("id").collect()] == [0, 33, 66, 99]
    sample = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t"), (4, "t")], "id int, text string")
    answers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, kind string")
    now = spark.createDataFrame([(1, "t", "a", "official"), (2, "t", "a", "official"), (3, "new", "a", "official"), (4, "t", "a", "llm")], "id int, text string, kind string, source string")
    scored = sampling.score(sample, answers, now, ["id"])
    assert {r["id"]: r["status"] for r in scored.collect()} == {1: "right", 2: "wrong", 3: "stale", 4: "withdrawn"} and not sampling.passed(scored)


def test_gates_raise_with_everything(spark):
    found = checks.violations(spark.range(3), {"odd": (F.col("id") % 2 == 1, F.col("id")), "big": (F.col("id") > 5, F.lit("x"))})
    assert {r["gate"]: (r["ok"], r["n"]) for r in checks.gates(found, ["odd", "big"]).collect()} == {"odd": (False, 1), "big": (True, 0)}
    with pytest.raises(checks.CheckFailed, match="odd: 1"):
        checks.require(found)


def test_entities(spark):
    raw = spark.createDataFrame(
        [(1, 0x21, 0, "n", 1000, 2000, 4, 1, 0x10, 0, 1), (2, 0x4000021, 0, "l", 500, 0xC0, 3, 2, 0x20, 0, 3), (3, 0x2, 0, "s", 7, 0, 0, 0, 0, 0, 1), (4, 0x4021, 0, "t", 0, 0, 0, 0, 0, 0, 1), (10**8, 0x21, 0, "p", 0, 0, 0, 0, 0, 0, 1), (5, 0x1000021, 0, "q", 1, 1, 0x05000004, 1, 1, 0, 1)],
        "id long, type long, alias long, name string, atk int, def int, level long, race long, attribute long, setcode long, ot int",
    ).withColumn("desc", F.lit(""))
    assert values(entities.exclusions(raw)) == [("provisional", 1), ("token", 1)]
    got = {r["id"]: (r["level"], r["scale"], r["atk"], r["def"], r["link_marker"]) for r in entities.decoded(raw).collect()}
    assert got == {1: (4, None, 1000, 2000, None), 2: (3, None, 500, None, 0xC0), 3: (None,) * 5, 5: (4, 5, 1, 1, None)}
    assert [r["id"] for r in raw.where(entities.stale_parameters()).collect()] == [3]


def test_pages(spark):
    html = '<title>名前 | x</title>補足情報<!-- 補足情報 --><div id="card_info"><span class="update">2020-01-01</span><div id="card_text">a<br>b &amp; c<div>d</div></div><div id="supplement">s</div></div><div id="supplement">no</div>'
    df = spark.createDataFrame([(1, html), (2, "<title>カードに関連するＱ＆Ａ | x</title>"), (3, None)], "cid int, html string")
    out = pages.extract(df).orderBy("cid").collect()
    assert (out[0]["name_ja"], out[0]["card_text"], out[0]["supplement"], out[0]["supplement_date"], len(out[0]["stray"])) == ("名前", "a\nb & cd", "s", "2020-01-01", 2)
    assert out[1]["name_ja"] is None and out[2]["card_text"] is None
    assert tuple(pages.report(pages.extract(df)).head()) == (1, 2, 0, 0, 2)


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "cards.cdb")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE datas(id INTEGER, ot INTEGER, alias INTEGER, setcode INTEGER, type INTEGER, atk INTEGER, def INTEGER, level INTEGER, race INTEGER, attribute INTEGER, category INTEGER)")
    db.execute('CREATE TABLE texts(id INTEGER, name TEXT, "desc" TEXT)')
    db.executemany("INSERT INTO datas VALUES (?,1,0,0,17,1,1,1,1,1,0)", [(1,), (2,)])
    db.execute("INSERT INTO texts VALUES (1, 'x', 'y')")
    db.commit()
    db.close()
    assert [(r["id"], r["name"]) for r in readers.read_cards(spark, path).collect()] == [(1, "x")]
    split = readers.read_sqlite(spark, path, "SELECT id FROM datas", "id long", key="id", low="1", high="2", partitions="2")
    assert values(split) == [(1,), (2,)]
    (tmp_path / "m.json").write_text(json.dumps({"1": 5, "x": 6}))
    assert values(readers.read_json_map(spark, str(tmp_path / "m.json"), "int")) == [(1, 5)]
    assert readers.read_optional(spark, str(tmp_path / "none"), "a int", lambda: None).count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "12.html").write_text("<p>")
    (tmp_path / "p" / "x.html").write_text("<p>")
    assert values(readers.read_pages(spark, str(tmp_path / "p"))) == [(12, "<p>")]
    df = spark.createDataFrame([(2, None), (1, "a")], "id int, s string")
    writers.write_json_lines(df, str(tmp_path / "out"), "id")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":1,"s":"a"}', '{"id":2}']
    writers.write_versioned(df, str(tmp_path / "v"), "1")
    writers.write_versioned(df.limit(1), str(tmp_path / "v"), "2")
    assert writers.read_latest(spark, str(tmp_path / "v")).count() == 1
