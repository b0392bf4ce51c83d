"""Sinks and sources with failures, batches that are never overwritten, checks and censuses in one pass, versions by digests."""

import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clausewright.functions import vocab as V
from clausewright.operators import batches, census, checks, entities, joins, versions
from clausewright.sources import json_array, paged, writers


def scans(df):
    """How many scans of tables a plan has."""
    return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")


# A JSON array


def test_array_is_that_of_json_dumps(spark, tmp_path):
    rows = [(i, None if i % 3 == 0 else f"é「{i}」\n", [1, i], Row(a=None, b=1.5)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, name string, list array<int>, sub struct<a:string,b:double>").repartition(4).orderBy(F.col("id").desc())
    path = str(tmp_path / "out" / "all.json")
    json_array.write(df, path)
    want = [{"id": i, "name": n, "list": x, "sub": {"a": None, "b": 1.5}} for i, n, x, _ in reversed(rows)]
    with open(path, encoding="utf-8") as f:
        text = f.read()
    assert text == "[\n" + ",\n".join(json.dumps(w, ensure_ascii=False, separators=(", ", ": ")) for w in want) + "\n]\n"
    assert os.listdir(tmp_path / "out") == ["all.json"]


def test_array_of_no_rows_and_of_empty_parts(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "id long").repartition(3)
    json_array.write(df.where("id > 1"), f"{tmp_path}/none.json")
    json_array.write(df, f"{tmp_path}/one.json")
    assert [json.load(open(tmp_path / n)) for n in ("none.json", "one.json")] == [[], [{"id": 1}]]


def test_failed_write_leaves_the_old_file(spark, tmp_path):
    path = f"{tmp_path}/x.json"
    json_array.write(spark.range(3), path)
    before = open(path).read()
    bad = spark.range(100).repartition(4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no"):
        json_array.write(bad, path, overwrite=True)
    assert open(path).read() == before
    with pytest.raises(Exception, match="x.json"):
        json_array.write(spark.range(1), path)
    assert open(path).read() == before


# Pages


BOOK = {1: [{"kid": "7", "r": "N"}, {"kid": "x", "r": "R"}, {"kid": None}], 2: [{"kid": "7", "b": "f"}, {"kid": "8"}, {"kid": "9", "r": ""}], 3: [{"kid": "10", "r": "UR"}]}


def book(book, fails=None):
    """A fetch function over ``book``; it fails on one page."""

    def fetch(page):
        if page == fails:
            raise OSError("timed out")
        return book.get(page, [])

    return fetch


@pytest.mark.parametrize("strides", [1, 2, 5])
def test_pages_until_an_empty_one(spark, strides):
    rows = paged.pages(spark, "book", book(BOOK), strides)
    assert sorted((r["page"], r["pos"], json.loads(r["row"])) for r in rows.collect()) == sorted((p, i, r) for p, rows in BOOK.items() for i, r in enumerate(rows))
    got = paged.numbered(rows, "$.kid", {"rarity": "$.r", "ban": "$.b"})
    assert sorted((r["id"], r["rarity"], r["ban"]) for r in got.collect()) == [(7, "N", "f"), (10, "UR", None)]


def test_all_sources_or_none(spark, tmp_path):
    folder, fetch, broken = str(tmp_path), book(BOOK), book(BOOK, 3)
    with pytest.raises(paged.SourceFailed, match="book"):
        paged.take(spark, {"book": fetch}, folder, "t0", offline=True)
    first = paged.take(spark, {"book": fetch, "more": book({1: [{"a": 1}], 2: [{"a": 2}]})}, folder, "t1")
    assert first["book"].count() == 7 and first["more"].count() == 2 and paged.downloaded_at(spark, folder) == "t1"
    with pytest.raises(paged.SourceFailed, match="book") as told:
        paged.take(spark, {"more": book({}), "book": broken}, folder, "t2")
    assert "page 3" in str(told.value)
    again = paged.take(spark, {"book": broken, "more": broken}, folder, "t3", offline=True)
    assert again["book"].count() == 7 and again["more"].count() == 2 and paged.downloaded_at(spark, folder) == "t1"
    assert sorted(x for x in os.listdir(folder) if not x.startswith(".")) == ["book", "downloaded_at", "more"]
    paged.take(spark, {"book": fetch, "more": book({})}, folder, "t4")
    assert paged.take(spark, {"more": fetch}, folder, "", offline=True)["more"].count() == 0 and paged.downloaded_at(spark, folder) == "t4"


def test_values_of_first_elements_and_formats(spark):
    dump = [{"id": 1, "misc": [{"p": 5}, {"p": 6}], "ban": {"ocg": "Limited", "tcg": ""}}, {"id": 2, "misc": []}, {"id": 3, "misc": [{"q": 1}, {"p": 2}], "ban": {"tcg": "Forbidden"}}, {"id": 4, "misc": [{"p": 0}]}]
    rows = paged.pages(spark, "dump", book({1: dump}))
    assert sorted(tuple(r) for r in paged.with_value(rows, "$.id", "$.misc[0].p", "points").collect()) == [(1, "5"), (4, "0")]
    assert sorted(tuple(r) for r in paged.by_format(rows, "$.id", {"o": "$.ban.ocg", "t": "$.ban.tcg"}).collect()) == [(1, "o", "Limited"), (3, "t", "Forbidden")]


# Batches


def test_batches_are_written_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_SIZES", {"kind": 3, "split": 2})
    payload = spark.createDataFrame([(i, "kind" if i % 3 else "split", [i]) for i in range(9)], "id long, series string, clauses array<int>")
    folder = str(tmp_path)
    with pytest.raises(batches.BatchRefused, match="names one batch, and there are 4"):
        batches.write_batches(payload, folder, name="mine")
    with pytest.raises(batches.BatchRefused, match="no such series: x"):
        batches.write_batches(payload, folder, series=["x"])
    assert os.listdir(folder) == []
    assert batches.write_batches(payload, folder, series=["kind"], limit=1, start=5) == ["kind-005.json"]
    assert [r["id"] for r in json.load(open(tmp_path / "kind-005.json"))] == [1, 2, 4]
    with pytest.raises(batches.BatchRefused, match="there already: kind-005.json"):
        batches.write_batches(payload, folder, start=5)
    assert os.listdir(folder) == ["kind-005.json"]
    assert batches.write_batches(payload, folder) == ["kind-001.json", "kind-002.json", "split-001.json", "split-002.json"]
    assert [r["id"] for r in json.load(open(tmp_path / "split-002.json"))] == [6]
    assert batches.write_batches(payload, folder, ["split"], 1, name="mine") == ["mine.json"]
    rest = {(r["series"], r["batch"]): r["remaining"] for r in batches.chosen_batches(payload).collect()}
    assert rest == {("kind", 1): 1, ("kind", 2): 0, ("split", 1): 1, ("split", 2): 0}


def test_rejudgments_take_no_other_flags(spark, tmp_path):
    clauses = spark.createDataFrame([(1, "main", "①", 0, "a", "b", None, "t", "o", None, "llm"), (2, "main", "①", 0, "a", "b", None, None, None, None, None)], "id long, section string, label string, pos int, text_zh string, text_ja string, rule_predicted string, kind string, optional string, role string, source string")
    context = spark.createDataFrame([(1, "n"), (2, "m")], "id long, name_zh string")
    write = lambda keys, name="fix", **more: batches.write_rejudgments(clauses, context, keys, str(tmp_path), name, **more)
    for call, why in ((lambda: write("1:main:①", None), "needs a name"), (lambda: write("1:main:①", limit=3, only=[1]), "limit, only"), (lambda: write("1-main"), "id:section:label"), (lambda: write("2:main:①"), "not judged yet")):
        with pytest.raises((batches.BatchRefused, KeyError), match=why):
            call()
    assert os.listdir(tmp_path) == [] and write("1:main:①") == "fix.json"
    held = json.load(open(tmp_path / "fix.json"))
    assert held[0]["clauses"][0]["rejudge"] is True and held[0]["clauses"][0]["current"] == {"kind": "t", "optional": "o", "role": None, "source": "llm"}
    with pytest.raises(batches.BatchRefused, match="there already"):
        write("1:main:①")


# Versions


@pytest.mark.parametrize("seed", range(3))
def test_differences_by_digests(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", "b"]), rng.choice([None, 1.5, 2.0])) for i in range(200)] + [(None, "x", None), (5, "dup", None), (5, "dup", None)]
    other = [r if rng.random() > 0.05 else (r[0], "new", r[2]) for r in rows if rng.random() > 0.02] + [(999, "a", None)]
    a, b = (spark.createDataFrame(x, "id long, v string, w double").repartition(3) for x in (rows, other))
    assert versions.same(a, a.orderBy("v"), ["id"]) and not versions.same(a, b, ["id"])
    want = sorted(map(repr, [(*tuple(r), "a") for r in a.exceptAll(b).collect()] + [(*tuple(r), "b") for r in b.exceptAll(a).collect()]))
    assert sorted(repr(tuple(r)) for r in versions.differing(a, b.select("w", "id", "v"), ["id"]).collect()) == want
    assert versions.differing(a, a, ["id"]).count() == 0
    plain = {r[0]: r for r in a.dropDuplicates(["id"]).where("id IS NOT NULL").collect()}
    one, two = (x.dropDuplicates(["id"]).where("id IS NOT NULL") for x in (a, b))
    diff = {r["id"]: (r["change"], r["fields"]) for r in joins.snapshot_diff(one, two, "id").collect()}
    now = {r["id"]: r for r in two.collect()}
    assert diff == {i: ("added", []) if i not in plain else ("changed", [f for f in ("v", "w") if plain[i][f] != r[f]]) for i, r in now.items() if i not in plain or tuple(plain[i]) != tuple(r)}


def test_equal_versions_are_read_once_each(spark, tmp_path):
    a, b = (str(tmp_path / n) for n in ("a", "b"))
    spark.range(1000).withColumn("v", F.col("id") % 7).write.parquet(a)
    spark.read.parquet(a).repartition(5).write.parquet(b)
    old, new = spark.read.parquet(a), spark.read.parquet(b)
    told = versions.digests(old, ["id"]).unionByName(versions.digests(new, ["id"]))
    assert scans(told) == 2
    assert versions.narrowed(old, new, ["id"]) is None and joins.mapping_diff(old, new, "id", "v").count() == 0
    with pytest.raises(ValueError, match="other columns"):
        versions.same(old, new.drop("v"), ["id"])


# The index


def stand_in(spark, folder):
    raw = spark.createDataFrame(
        [(1, 0x21, 2000, -2, 4, 0x2000, 0x20, 3), (2, 0x10002, 0, 0, 0, 0, 0, 2), (3, 0x21, 1, 1, 1, 0, 0x20, 1), (4, 0x100004, 5, 0, 0, 0, 0, 9), (4, 0x100004, 5, 0, 0, 0, 0, 9)],
        "id long, type long, atk long, def long, level long, race long, attribute long, ot int",
    ).withColumns({"setcode": F.lit(0).cast("long"), "alias": F.lit(0).cast("long"), "name": F.lit("n"), "desc": F.lit("")})
    cards = entities.decoded(raw)
    extra = spark.createDataFrame([(1, "一。\n二。", "UR", "f"), (2, "三。", None, None), (3, "四。餘。", None, None), (4, "五。", "X", None)], "id long, body string, rarity string, ban_o string")
    more = cards.dropDuplicates(["id"]).join(extra, "id").withColumns({c: F.lit(None).cast("string") for c in ("name_zh", "name_ja", "name_en", "ban_t", "ban_m")} | {"alt_ids": F.array().cast("array<long>"), "points": F.lit(0)})
    clauses = spark.createDataFrame([(1, 0, "①", "一。", "t", "m"), (1, 1, "②", "二。", "c", "o"), (2, 0, "1", "三。", None, None), (3, 0, "1", "四。", "zz", None)], "id long, pos int, label string, text string, kind string, opt string").withColumns({"section": F.lit("main"), "role": F.lit(None).cast("string")})
    index = entities.index_rows(more, clauses).where("id <> 4")
    for name, df in (("cards", cards), ("index", index), ("clauses", clauses)):
        df.write.parquet(f"{folder}/{name}")
    return [spark.read.parquet(f"{folder}/{n}") for n in ("cards", "index", "clauses")]


def test_index_checks_read_each_table_once(spark, tmp_path):
    cards, index, clauses = stand_in(spark, str(tmp_path))
    found = checks.index_problems(cards, index, clauses)
    assert scans(found) == 3
    got = sorted((r["check"], r["id"], r["detail"]) for r in found.collect() if r["detail"] is not None)
    assert [g for g in got if g[1] != 4] == [("clause_without_kind", 2, "1"), ("coverage_gaps", 3, "餘。"), ("monster_without_parameters", 3, "33"), ("not_exported", 3, "kind:zz"), ("optional_on_non_carrier", 1, "②")]
    assert ("duplicate_id", 4, "2") in got
    assert {(r["check"], r["id"]) for r in found.collect() if r["detail"] is None} == {("missing_from_index", 4), ("without_clause_entry", 4)}
    assert {r["check"] for r in found.select("check").collect()} <= set(checks.INDEX_CHECKS)


def test_index_is_published_only_without_problems(spark, tmp_path):
    cards, index, clauses = stand_in(spark, str(tmp_path))
    out = f"{tmp_path}/out/index"
    with pytest.raises(checks.CheckFailed) as told:
        writers.write_index(checks.checked_index(cards, index, clauses), out)
    assert "coverage_gaps: 1" in str(told.value) and "duplicate_id: 1" in str(told.value)
    assert not os.path.exists(out) and [x for x in os.listdir(tmp_path / "out") if not x.startswith(".")] == []
    good = [df.where("id = 1") for df in (cards, index.withColumn("clauses", F.filter("clauses", lambda c: c["label"] == "①")).withColumn("body", F.lit("一。")), clauses)]
    assert writers.write_index(checks.checked_index(*good), out) == 1
    assert spark.read.parquet(out).columns == index.columns and spark.read.parquet(out).count() == 1
    with pytest.raises(checks.CheckFailed):
        writers.write_index(checks.checked_index(cards, index, clauses), out)
    assert spark.read.parquet(out).count() == 1
    assert writers.write_index(checks.checked_index(*good), out) == 1  # replaces it


def test_census_of_all_domains_in_one_scan(spark, tmp_path):
    _, index, _ = stand_in(spark, str(tmp_path))
    counted = census.index_census(index)
    assert scans(counted) == 1
    got = {(r["domain"], r["code"]): r["n"] for r in counted.collect()}
    assert (got["cat", "m"], got["cat", "s"], got["cat", "t"], got["cat", None]) == (2, 1, 0, 0)
    assert (got["attr", "dark"], got["attr", None], got["rarity", "UR"], got["rarity", None], got["ban_o", "f"]) == (2, 1, 1, 2, 1)
    assert (got["kind", "t"], got["kind", "c"], got["kind", "q"], got["kind", None]) == (1, 1, 0, 1)  # zz is no member
    assert (got["optional", "m"], got["sub_m", "effect"], got["sub_s", "quick"]) == (1, 2, 1)
    assert {d for d, _ in got} == set(V.DOMAINS)
    for name, domain in V.DOMAINS.items():
        assert {c for d, c in got if d == name} == {m.code for m in domain.members} | {None}
